"""Whole runs, sources, reports, streams, the command line."""

import hashlib
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.cli import main
from siftstone.functions.lsh import permutations
from siftstone.params import PLAIN, STRIPPED
from siftstone.plans import report
from siftstone.plans.dedup import deduplicate, deduplicate_stripped, document_bands
from siftstone.queries import QUERIES
from siftstone.sources.tables import CheckpointMismatch, inspect, limited, list_files, path_exists, read_documents, require_unique, stored_or_computed
from siftstone.streaming.incremental import deduplicate_stream, read_stream

LONG = "The quick brown fox jumps over the lazy dog near the quiet river bank every single morning. "


def kept(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r["doc_id"] for r in deduplicate(df, params=PLAIN.with_(**how) if how else PLAIN).kept.collect())


def test_fixtures(spark):
    assert kept(spark, []) == []
    assert kept(spark, [(4, LONG)]) == [4]
    assert kept(spark, [(7, LONG), (3, LONG), (9, LONG)]) == [3]
    assert kept(spark, [(2, "HELLO WORLD, SAID THE MACHINE"), (1, "hello world, said the machine")]) == [1]
    assert kept(spark, [(1, ""), (0, "a"), (5, "abcd")]) == [0]
    assert kept(spark, [(1, ""), (0, "a"), (5, "abcd")], short_docs="keep") == [0, 1, 5]
    assert kept(spark, [(1, None), (2, None), (3, LONG), (4, LONG)]) == [1, 2, 3]
    assert kept(spark, [(9, LONG), (10, LONG)]) == [9]
    assert kept(spark, [(9, LONG), (10, LONG)], id_order="string") == [10]


def test_extra_columns_and_names(spark):
    df = spark.createDataFrame([(1, LONG, "x", 1), (2, LONG, "y", 2), (3, "entirely different words here, all of them", "z", 3)], "node long, root string, doc_id string, minhash int")
    got = deduplicate(df, "node", "root").kept
    assert got.columns == df.columns and sorted(r["node"] for r in got.collect()) == [1, 3]


def test_rerun_removes_nothing_and_partitions_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = deduplicate(docs)
    ids = sorted(r["doc_id"] for r in one.kept.select("doc_id").collect())
    again = deduplicate(one.kept)
    assert again.removed.count() == 0
    assert ids == sorted(r["doc_id"] for r in deduplicate(docs.repartition(7)).kept.select("doc_id").collect())
    m = report.metrics(docs, one.removed).first()
    assert m["n_input"] == docs.count() and m["n_kept"] == len(ids)
    assert report.metrics(docs.limit(0), one.removed.limit(0)).first()["removed_percent"] == 0.0


def test_stripped_keeps_first_of_equal_ids(spark):
    df = spark.createDataFrame([(5, "Some, words. here! again"), (5, "some words here again"), (6, "some words; here again"), (7, "quite another text about boats")], "id long, text string")
    got = deduplicate_stripped(df, "id", "text", STRIPPED)
    assert sorted(r["id"] for r in got.kept.collect()) == [5, 7]
    assert sorted(r["doc_id"] for r in got.removed.collect()) == [5, 6]
    assert sorted(map(tuple, got.links.collect())) == [(5, 5), (5, 6)]
    assert sorted(map(tuple, got.clusters.collect())) == [(5, 5), (5, 5), (6, 5)]
    with pytest.raises(ValueError):
        deduplicate_stripped(df, "id", "text", STRIPPED, "/nowhere")


def test_stripped_with_unique_and_null_ids(spark):
    rows = [(5, "Some, words. here! again"), (8, "some words here again"), (6, "some words; here again"), (7, "quite another text about boats")]
    df = spark.createDataFrame(rows, "id long, text string")
    one = deduplicate_stripped(df, "id", "text", STRIPPED)
    assert sorted(r["id"] for r in one.kept.collect()) == [5, 7] and one.kept.columns == ["id", "text"]
    assert sorted(map(tuple, one.links.collect())) == [(5, 6), (5, 8)]
    with_null = deduplicate_stripped(df.unionByName(spark.createDataFrame([(None, "some words here; again")], "id long, text string")), "id", "text", STRIPPED)
    assert sorted((r["id"] for r in with_null.kept.collect()), key=str) == [7, None]
    assert deduplicate_stripped(df.limit(0), "id", "text").kept.count() == 0


def test_ignore_pattern_and_shingles(spark):
    rows = [(1, LONG + "Page 1 of 22"), (2, LONG + "Page 317 of 9"), (3, None), (4, "")]
    assert kept(spark, rows, ignore_pattern="[0-9]+") == [1, 3, 4]
    words = " ".join(f"word{k}" for k in range(40))
    for tokenizer, other in (("space", words.replace(" ", "\u3000 ")), ("punctuation", None)):
        base = words if tokenizer == "space" else words.replace(" ", ",")
        assert kept(spark, [(1, base), (2, other or base), (3, "few"), (4, ""), (5, None)], tokenizer=tokenizer) == [1, 3, 5]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, text string")
    df.write.parquet(str(tmp_path / "p/deep/one"))
    df.write.json(str(tmp_path / "j"))
    assert read_documents(spark, f"{tmp_path}/p, {tmp_path}/p/*/one").count() == 3  # a file that two paths name is read once
    assert read_documents(spark, f"{tmp_path}/j", "jsonl").count() == 3
    assert all(x.endswith(".parquet") for x in list_files(spark, f"{tmp_path}/p")) and list_files(spark, f"{tmp_path}/p")
    assert path_exists(spark, f"{tmp_path}/p") and not path_exists(spark, f"{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        read_documents(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError):
        read_documents(spark, f"{tmp_path}/p", id_col="nope")
    with pytest.raises(ValueError):
        require_unique(df, "id")
    with pytest.raises(ValueError):
        limited(df, "id", 10)
    assert [r["id"] for r in limited(df, "id", 1).collect()] == [1]
    assert inspect(df, "id")["count"] == 3


def test_stored_bands(spark, tmp_path):
    docs = spark.createDataFrame([(1, LONG), (2, LONG)], "doc_id long, text string")
    path = str(tmp_path / "bands")
    first = stored_or_computed(spark, path, lambda: document_bands(docs, "doc_id", "text", PLAIN)).count()
    assert first == 28
    assert stored_or_computed(spark, path, lambda: pytest.fail("computed again")).count() == 28
    with pytest.raises(CheckpointMismatch):  # made without a stamp of this input
        deduplicate(docs, bands_path=path)
    mine = str(tmp_path / "mine")
    for _ in range(2):
        assert sorted(r["doc_id"] for r in deduplicate(docs, bands_path=mine).kept.collect()) == [1]


def test_stored_bands_of_another_input(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = str(tmp_path / "bands")
    deduplicate(docs.where("doc_id < 200"), bands_path=path)
    with pytest.raises(CheckpointMismatch, match="ids, rows differ"):
        deduplicate(docs, bands_path=path)
    with pytest.raises(CheckpointMismatch, match="params"):
        deduplicate(docs.where("doc_id < 200"), params=PLAIN.with_(seed=1), bands_path=path)
    with pytest.raises(CheckpointMismatch, match="params, raw"):
        deduplicate_stripped(docs.where("doc_id < 200"), bands_path=path)
    (tmp_path / "bands/_SUCCESS").unlink()
    with pytest.raises(CheckpointMismatch, match="not written to its end"):
        deduplicate(docs.where("doc_id < 200"), bands_path=path)
    (tmp_path / "killed").mkdir()
    (tmp_path / "killed/part-0.parquet").write_bytes(b"half")
    with pytest.raises(CheckpointMismatch):
        deduplicate(docs, bands_path=str(tmp_path / "killed"))


def test_globs_and_partitions(spark, tmp_path):
    for k, folder in enumerate(("t/a/keep", "t/keep", "t/a/b/keep", "t/a/other", "t/a/keep/deeper")):
        spark.createDataFrame([(k, str(k))], "id long, text string").coalesce(1).write.parquet(str(tmp_path / folder))
    read = lambda p, **how: sorted(r["id"] for r in read_documents(spark, f"{tmp_path}/{p}", **how).collect())
    assert read("t/**/keep/*.parquet") == [0, 1, 2] and read("t/a/**/*.parquet") == [0, 2, 3, 4] and read("t/**") == [0, 1, 2, 3, 4]
    assert read("**/{keep,other}/part-[0-9]*.parquet") == [0, 1, 2, 3]
    assert path_exists(spark, f"{tmp_path}/t/**/keep/*.parquet") and not path_exists(spark, f"{tmp_path}/t/**/nope/*.parquet")
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "y")], "id long, text string, part string")
    df.write.partitionBy("part").parquet(str(tmp_path / "h"))
    got = read_documents(spark, str(tmp_path / "h"))
    assert sorted(map(tuple, got.select("id", "part").collect())) == [(1, "x"), (2, "y"), (3, "y")]
    assert all("part=y" in f for f in got.where("part = 'y'").select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    both = read_documents(spark, f"{tmp_path}/h, {tmp_path}/t/keep")
    assert sorted(map(tuple, both.select("id", "part").collect()), key=str) == [(1, "x"), (1, None), (2, "y"), (3, "y")]


def test_stream(spark, tmp_path):
    schema = "doc_id long, text string"
    other = "A wholly different text about bridges, tunnels, and the people who maintain them at night."
    for k, rows in enumerate([[(1, LONG), (2, LONG), (3, other)], [(4, LONG), (5, other + other), (6, "Yet another sentence that nobody has seen before now.")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        deduplicate_stream(read_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id").collect())
    assert got[:2] == [1, 3] and 6 in got and 4 not in got and 2 not in got


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, LONG), (2, LONG), (3, "something else entirely, for once")], "id long, text string").write.parquet(str(tmp_path / "in"))
    assert main(["dedup", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--dump-pairs", str(tmp_path / "pairs"), "--size-distribution", "--cluster-samples", "--check-unique", "--num-perm", "64"]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert spark.read.csv(str(tmp_path / "pairs"), header=True).count() == 1
    capsys.readouterr()
    stripped = ["dedup", "--preset", "stripped", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out2"), "--dump-pairs", str(tmp_path / "pairs2"), "--size-distribution", "--cluster-samples", "--band-checkpoint", str(tmp_path / "bands2"), "--bands", "5", "--rows", "7", "--keep-case", "--ignore-pattern", "[0-9]"]
    assert main(stripped) == 0
    said = capsys.readouterr().out
    assert "cluster_size" in said and "|root|" in said and "n_removed" in said
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 2 and spark.read.csv(str(tmp_path / "pairs2"), header=True).count() == 1
    assert spark.read.parquet(str(tmp_path / "bands2")).where("doc_id = 1").count() == 5
    with pytest.raises(SystemExit):
        main([*stripped[:-6], "--bands", "5"])
    assert main(["inspect", "--input", str(tmp_path / "in")]) == 0


def test_queries_agree_with_sql():
    """Every query of the core has SQL, or is listed here with the reason."""
    from siftstone.queries import QUERIES, oracle

    assert set(oracle()) <= set(QUERIES)
    assert set(QUERIES) == set(oracle())


def test_cheap_queries_on_smallest_tables(spark):
    import duckdb

    from siftstone.queries import QUERIES, oracle

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "bands", "edges", "sent_docs"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for name in ("minhash_signature", "lsh_bands_rawkey", "dedup_keep", "components_of_edges", "p5_key_stats", "p5_found", "text_normalized"):
        df = QUERIES[name](spark, d)
        cur = con.execute(oracle()[name])
        cols = [x[0] for x in cur.description]
        assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(cur.fetchall(), key=str), name


def test_entry_without_the_training_data_part():
    """What that part imports may be missing; the core's queries stay."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); assert 'dedup_keep' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0


def test_only_entry_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "siftstone"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "siftstone.llm" not in path.read_text(), path




def test_production_queries_against_brute_force(spark):
    """All 128 permutations in every stage."""
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}

    def signatures(params, clean):
        a, b = (np.array(x, dtype=np.uint64) for x in permutations(params.seed, 128))
        out = {}
        for i, text in texts.items():
            if text is not None:
                t = clean(text.lower())
                grams = {t[k : k + params.ngram] for k in range(len(t) - params.ngram + 1)}
                h = np.array([int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams], dtype=np.uint64)
                values = (h[:, None] * a + b) % np.uint64(2**61 - 1) % np.uint64(2**32)
                out[i] = values.min(axis=0) if grams else np.full(128, 2**32 - 1, dtype=np.uint64)
        return out

    def rows(name):
        return sorted(map(tuple, QUERIES[name](spark, d).collect()))

    plain = signatures(PLAIN, str)
    parts = {(i, k): v[9 * k : 9 * k + 9].astype("<u4").tobytes() for i, v in plain.items() for k in range(14)}
    bands = sorted((*k, hashlib.sha256(v).hexdigest()[:16]) for k, v in parts.items())
    assert rows("minhash_signature") == sorted((i, k, int(x)) for i, v in plain.items() for k, x in enumerate(v))
    assert rows("lsh_bands") == rows("bands_from_signatures") == rows("band_checkpoint_roundtrip") == bands
    assert rows("empty_signature") == sorted((i, 2**32 - 1, 2**32 - 1, 128) for i, t in texts.items() if t is not None and len(t) < 200)

    stripped = signatures(STRIPPED, lambda t: t.translate(str.maketrans("", "", string.punctuation)))
    assert rows("lsh_bands_rawkey") == sorted((i, k, (k.to_bytes(4, "big") + v[13 * k : 13 * k + 13].astype("<u4").tobytes()).hex()) for i, v in stripped.items() for k in range(9))

    least, changed = {str(i): str(i) for i in texts}, True
    while changed:
        groups = {}
        for (i, k), v in parts.items():
            groups[k, v] = min(groups.get((k, v), least[str(i)]), least[str(i)])
        was = dict(least)
        for (i, k), v in parts.items():
            least[str(i)] = min(least[str(i)], groups[k, v])
        changed = was != least
    assert rows("dedup_keep_string_order") == sorted((i,) for i in texts if least[str(i)] == str(i)) != sorted((i,) for i in texts)
