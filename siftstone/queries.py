"""Queries of the core operators and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.bands import explode_bands
from siftstone.functions.lsh import MASK_32, MERSENNE_61, optimal_bands, permutations
from siftstone.functions.text import PUNCTUATION, WORD_BREAK, char_ngrams, fragment_shingles, marked_first, normalized, token_hash32
from siftstone.operators.components import connected_components, large_star, small_star
from siftstone.operators.edges import distinct_pairs, star_edges
from siftstone.operators.layout import spread
from siftstone.operators.ranking import sequential_ids
from siftstone.operators.scratch import scratch_path
from siftstone.operators.skew import salted_key_stats
from siftstone.params import PLAIN, STRIPPED, DedupParams
from siftstone.plans import report
from siftstone.plans.dedup import deduplicate, deduplicate_stripped, document_bands, drop_ids, removed_ids, with_signatures
from siftstone.sources.tables import input_stamp, limited, preview_rows, read_documents, schema_rows, stored_or_computed, write_pairs_csv
from siftstone.streaming.incremental import deduplicate_stream, read_stream

#: What dedup_keep_ignoring deletes.
IGNORED = "[ \t]*[0-9]+[ \t]*"
SIZINGS = [(0.5, 128), (0.7, 16), (0.7, 32), (0.7, 64), (0.7, 128), (0.7, 256), (0.8, 128)]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def links_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").select("src", "dst")


def star_input(spark: SparkSession, d: str) -> DataFrame:
    return links_of(spark, d).dropna().select(F.col("src").alias("node"), F.col("dst").alias("parent"))


# ---- scans, projections, limits


def scan_project(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def row_count(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_rows"))


def limit_by_id(spark, d):
    return limited(table(spark, d, "documents"), "doc_id", 50).select("doc_id", "n_chars")


def preview(spark, d):
    return preview_rows(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id")


def schema_inspect(spark, d):
    return schema_rows(table(spark, d, "documents"))


def glob_read(spark, d):
    return read_documents(spark, f"{d}/docu*.parquet", id_col="doc_id").select("doc_id", "n_chars")


def multi_path_read(spark, d):
    docs = read_documents(spark, f"{d}/documents.parquet, {d}/sent_d*.parquet", id_col="doc_id")
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("text").alias("n_texts"))


def jsonl_roundtrip(spark, d):
    path = scratch_path(spark, "jsonl")
    table(spark, d, "documents").select("doc_id", "text").write.json(path)
    return read_documents(spark, path, "jsonl", "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


def sequential_uid(spark, d):
    return sequential_ids(table(spark, d, "documents").select("doc_id"), "doc_id", "uid").select("doc_id", F.col("uid").cast("bigint").alias("uid"))


# ---- text and hashing


def text_normalized(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(normalized(t)).alias("lower_md5"), F.md5(normalized(t, True, True)).alias("stripped_md5"))


def char_ngram_counts(spark, d):
    """Documents with an n-gram and its occurrences. A document's n-grams are sorted in place to mark the first of each, so one exchange, on the n-gram, is enough."""
    grams = spread(table(spark, d, "documents").select("text")).select(F.explode(marked_first(char_ngrams(F.lower("text"), 5))).alias("g"))
    return grams.groupBy(F.col("g.item").alias("gram")).agg(F.sum("g.first").alias("n_docs"), F.count(F.lit(1)).alias("n_total"))


def punct_shingles(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(fragment_shingles(F.lower("text"), 5)).alias("shingle")).distinct()


def space_shingles(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(fragment_shingles(F.lower("text"), 5, WORD_BREAK)).alias("shingle")).distinct()


def token_hashes(spark, d):
    grams = spread(table(spark, d, "documents").select("text")).select(F.explode(char_ngrams(F.lower("text"), 5)).alias("gram")).distinct()
    return grams.select("gram", token_hash32(F.col("gram")).alias("hash"))


def minhash_signature(spark, d, params=PLAIN):
    signed = with_signatures(spread(table(spark, d, "documents").select("doc_id", "text")), "text", params)
    return signed.where("minhash is not null").select("doc_id", F.posexplode("minhash").alias("perm_id", "value"))


def empty_signature(spark, d, params=PLAIN):
    """Texts with fewer than 200 code points have no 200-gram: their signature is all ones."""
    signed = with_signatures(spread(table(spark, d, "documents").select("doc_id", "text")), "text", params.with_(ngram=200))
    low = F.array_min("minhash").alias("low")
    return signed.select("doc_id", low, F.array_max("minhash").alias("high"), F.size("minhash").alias("n")).where(F.col("low") == MASK_32)


def lsh_bands(spark, d, params=PLAIN):
    return document_bands(table(spark, d, "documents"), "doc_id", "text", params)


def lsh_bands_rawkey(spark, d, params=STRIPPED):
    return document_bands(table(spark, d, "documents"), "doc_id", "text", params, raw=True)


def bands_from_signatures(spark, d, params=PLAIN):
    signed = with_signatures(spread(table(spark, d, "documents").select("doc_id", "text")), "text", params).select("doc_id", "minhash")
    return explode_bands(signed, "doc_id", "minhash", params.bands, params.rows)


def band_checkpoint_roundtrip(spark, d, params=PLAIN):
    path = scratch_path(spark, "bands")
    docs = table(spark, d, "documents")
    make, stamp = partial(document_bands, docs, "doc_id", "text", params), input_stamp(docs, "doc_id")
    stored_or_computed(spark, path, make, stamp)
    return stored_or_computed(spark, path, make, stamp)


def lsh_optimal_params(spark, d):
    rows = [(t, n, *optimal_bands(t, n)) for t, n in SIZINGS]
    return spark.createDataFrame(rows, "threshold double, num_perm int, bands int, rows_per_band int")


# ---- links, stars, components


def band_collisions(spark, d):
    b = table(spark, d, "bands").dropna(subset=["doc_id", "band_id", "band_hash"])
    return b.groupBy("band_id", "band_hash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")).where("members > 1")


def band_star_edges(spark, d):
    return star_edges(table(spark, d, "bands"))


def pairs_csv_roundtrip(spark, d):
    path = scratch_path(spark, "pairs")
    write_pairs_csv(star_edges(table(spark, d, "bands")), path)
    return spark.read.csv(path, header=True, schema="src bigint, dst bigint")


def distinct_edges(spark, d):
    return distinct_pairs(links_of(spark, d), "src", "dst")


def large_star_step(spark, d):
    return large_star(star_input(spark, d))


def small_star_step(spark, d):
    return small_star(star_input(spark, d))


def components_of_edges(spark, d):
    return connected_components(links_of(spark, d))


def components_by_stars(spark, d):
    """Star contraction to its fixpoint, none of it left to one task."""
    return connected_components(links_of(spark, d), task_edges=0)


def components_of_orders(spark, d):
    """Customers and orders as one graph; customers are negative."""
    o = table(spark, d, "orders").select((-F.col("o_custkey") - 1).alias("src"), F.col("o_orderkey").alias("dst"))
    return connected_components(o)


def components_of_strings(spark, d):
    e = links_of(spark, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return connected_components(e)


def band_clusters(spark, d):
    return connected_components(star_edges(table(spark, d, "bands"))).withColumnRenamed("node", "doc_id")


# ---- whole runs


def dedup_keep(spark, d):
    return deduplicate(table(spark, d, "documents")).kept.select("doc_id", "n_chars", "source")


def dedup_keep_by_stars(spark, d):
    """The same with every link contracted in rounds, none left to one task."""
    return deduplicate(table(spark, d, "documents"), params=PLAIN.with_(task_edges=0)).kept.select("doc_id")


def stream_keep(spark, d):
    """Documents that a stream accepts when all of them come in one batch."""
    source, index, out, marks = (scratch_path(spark, name) for name in ("stream-in", "stream-index", "stream-out", "stream-marks"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs.write.parquet(source)
    deduplicate_stream(read_stream(spark, source, docs.schema, 1_000_000), index, out, marks).awaitTermination()
    return spark.read.parquet(out).select("doc_id")


def duplicate_ids(spark, d):
    return deduplicate(table(spark, d, "documents")).removed


def dedup_keep_stripped(spark, d):
    kept = deduplicate_stripped(table(spark, d, "documents")).kept
    return kept.select("doc_id", F.md5("text").alias("text_md5"))


def dedup_keep_string_order(spark, d, params=PLAIN):
    docs = table(spark, d, "documents")
    return deduplicate(docs, params=params.with_(id_order="string")).kept.select("doc_id")


def dedup_keep_punctuation(spark, d):
    """Signatures over runs of five fragments between punctuation marks."""
    return deduplicate(table(spark, d, "documents"), params=PLAIN.with_(tokenizer="punctuation")).kept.select("doc_id")


def dedup_keep_space(spark, d):
    """Signatures over runs of five words."""
    return deduplicate(table(spark, d, "documents"), params=PLAIN.with_(tokenizer="space")).kept.select("doc_id")


def dedup_keep_ignoring(spark, d):
    """Signatures over texts without numbers and the blanks around them."""
    return deduplicate(table(spark, d, "documents"), params=PLAIN.with_(ignore_pattern=IGNORED)).kept.select("doc_id")


def stripped_links(spark, d):
    """Links that the stripped preset dumps."""
    return deduplicate_stripped(table(spark, d, "documents")).links


def stripped_cluster_sizes(spark, d):
    return report.cluster_sizes(deduplicate_stripped(table(spark, d, "documents")).clusters)


def glob_any_depth(spark, d):
    """A glob with two stars matches at any depth, and what follows them counts."""
    path = scratch_path(spark, "deep")
    docs = table(spark, d, "documents").select("doc_id", "text")
    for part, inner in ((0, "x/keep"), (1, "y/z/keep"), (2, "x/other"), (3, "keep")):
        docs.where(F.pmod("doc_id", F.lit(4)) == part).write.parquet(f"{path}/{inner}")
    return read_documents(spark, f"{path}/**/keep/*.parquet", id_col="doc_id").select("doc_id", F.md5("text").alias("text_md5"))


def partition_columns(spark, d):
    """Folders named name=value keep that column, and a filter on it prunes folders."""
    path = scratch_path(spark, "parts")
    table(spark, d, "documents").select("doc_id", "text", F.coalesce(F.lower("lang"), F.lit("none")).alias("part")).write.partitionBy("part").parquet(path)
    return read_documents(spark, path, id_col="doc_id").where("part IN ('en', 'none')").select("doc_id", "part")


def dedup_metrics(spark, d):
    docs = table(spark, d, "documents")
    return report.metrics(docs, deduplicate(docs).removed)


def keep_by_stored_bands(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    gone = removed_ids(connected_components(star_edges(table(spark, d, "bands"))))
    return drop_ids(docs, "doc_id", gone)


def cluster_sizes(spark, d):
    return report.cluster_sizes(band_clusters(spark, d))


def cluster_samples(spark, d):
    return report.cluster_samples(band_clusters(spark, d))


# ---- keys that hold most rows


def p5_key_stats(spark, d):
    """Smallest doc_id and number of distinct doc_ids of each (band_id, band_hash)."""
    b = table(spark, d, "bands").where("band_hash is not null")
    return salted_key_stats(b, ["band_id", "band_hash"], "doc_id").select("band_id", "band_hash", F.col("min_value").alias("min_doc_id"), F.col("n_distinct").alias("n_docs"))


def p5_found(spark, d):
    """Keys with at least 0.5 % of the rows, from the same salted aggregation."""
    b = table(spark, d, "bands").where("band_hash is not null")
    stats = salted_key_stats(b, ["band_id", "band_hash"], "doc_id")
    total = b.agg(F.count(F.lit(1)).alias("n")).scalar()
    return stats.where(F.col("n_rows") * 200 >= total).select("band_id", "band_hash")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_project, row_count, limit_by_id, preview, schema_inspect, glob_read, multi_path_read, jsonl_roundtrip, sequential_uid,
        text_normalized, char_ngram_counts, punct_shingles, space_shingles, token_hashes, minhash_signature, empty_signature,
        lsh_bands, lsh_bands_rawkey, bands_from_signatures, band_checkpoint_roundtrip, lsh_optimal_params,
        band_collisions, band_star_edges, pairs_csv_roundtrip, distinct_edges, large_star_step, small_star_step,
        components_of_edges, components_by_stars, components_of_orders, components_of_strings, band_clusters,
        glob_any_depth, partition_columns, dedup_keep_punctuation, dedup_keep_space, dedup_keep_ignoring, stripped_links, stripped_cluster_sizes,
        dedup_keep, dedup_keep_by_stars, stream_keep, duplicate_ids, dedup_keep_stripped, dedup_keep_string_order, dedup_metrics, keep_by_stored_bands, cluster_sizes, cluster_samples,
        p5_key_stats, p5_found,
    )
}

# ---- SQL

LOWER = "lower(text)"
STRIP = f"regexp_replace(lower(text), '{PUNCTUATION}', '', 'g')"
IGNORE = f"regexp_replace(lower(text), '{IGNORED}', '', 'g')"


def _grams(text: str, n: int, ident: str = "doc_id", source: str = "documents") -> str:
    """(ident, gram), repeated ones included."""
    return f"""SELECT {ident}, c || {" || ".join(f"lead(c, {k}) OVER w" for k in range(1, n))} AS gram
      FROM (SELECT {ident}, unnest(cs) AS c, generate_subscripts(cs, 1) AS i
            FROM (SELECT {ident}, regexp_extract_all({text}, '(?s).') AS cs FROM {source} WHERE text IS NOT NULL))
      WINDOW w AS (PARTITION BY {ident} ORDER BY i)"""


def _shingles(pattern: str, n: int) -> str:
    """(doc_id, gram): runs of n fragments between matches of the pattern."""
    return f"""SELECT doc_id, array_to_string(ps[i:i+{n - 1}], ' ') AS gram FROM (
      SELECT doc_id, ps, unnest(range(1, len(ps) - {n - 2})) AS i FROM (SELECT doc_id, regexp_split_to_array(lower(text), '{pattern}') AS ps FROM documents WHERE text IS NOT NULL))"""


def _signature_ctes(params: DedupParams, text: str, ident: str = "doc_id", source: str = "documents") -> str:
    a, b = permutations(params.seed, params.num_perm)
    pattern = {"punctuation": PUNCTUATION, "space": WORD_BREAK}.get(params.tokenizer)
    grams = _shingles(pattern, params.ngram) if pattern else _grams(text, params.ngram, ident, source)
    short = f"len(regexp_split_to_array({text}, '{pattern}'))" if pattern else f"length({text})"
    perms = ", ".join(f"({k}, {int(x)}, {int(y)})" for k, (x, y) in enumerate(zip(a, b)))
    return f"""perm(perm_id, a, b) AS (VALUES {perms}),
    grams AS MATERIALIZED (SELECT DISTINCT {ident} AS id, gram FROM ({grams}) WHERE gram IS NOT NULL),
    hashes AS MATERIALIZED (SELECT gram, ('0x' || substr(s,7,2) || substr(s,5,2) || substr(s,3,2) || substr(s,1,2))::BIGINT AS h
               FROM (SELECT DISTINCT gram, sha1(gram) AS s FROM grams)),
    permuted AS MATERIALIZED (SELECT h, perm_id, (((h::HUGEINT * a + b) % 18446744073709551616) % {MERSENNE_61} % {MASK_32 + 1})::BIGINT AS v
               FROM (SELECT DISTINCT h FROM hashes), perm),
    sig AS MATERIALIZED (
      SELECT id, perm_id, min(v) AS v FROM grams JOIN hashes USING (gram) JOIN permuted USING (h) GROUP BY id, perm_id
      UNION ALL
      SELECT {ident}, perm_id, {MASK_32} FROM {source}, perm WHERE text IS NOT NULL AND {short} < {params.ngram}),
    le AS (SELECT id, perm_id, printf('%02X%02X%02X%02X', v & 255, (v >> 8) & 255, (v >> 16) & 255, (v >> 24) & 255) AS x FROM sig),
    raw AS MATERIALIZED (SELECT id, (perm_id // {params.rows})::INT AS band_id, string_agg(x, '' ORDER BY perm_id) AS hex
            FROM le WHERE perm_id < {params.bands * params.rows} GROUP BY 1, 2),
    band AS MATERIALIZED (SELECT id, band_id, substr(sha256(unhex(hex)), 1, 16) AS key, lower(printf('%08X', band_id) || hex) AS raw_key FROM raw)"""


def _components_ctes(links: str) -> str:
    """cc(node, root) over links(a, b)."""
    return f"""link AS MATERIALIZED ({links}),
    e AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
    cc(node, root) USING KEY (node) AS (
      SELECT DISTINCT a, a FROM e
      UNION
      (SELECT e.a, min(u.root) FROM cc u JOIN e ON e.b = u.node JOIN recurring.cc c ON c.node = e.a WHERE u.root < c.root GROUP BY e.a))"""


STARS = """SELECT DISTINCT m AS a, doc_id AS b FROM (
      SELECT doc_id, min(doc_id) OVER (PARTITION BY band_id, band_hash) AS m FROM bands
      WHERE doc_id IS NOT NULL AND band_id IS NOT NULL AND band_hash IS NOT NULL) WHERE m < doc_id"""
EDGES = "SELECT DISTINCT src AS a, dst AS b FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL"
BAND_STARS = """SELECT DISTINCT m AS a, id AS b FROM (SELECT id, min(id) OVER (PARTITION BY band_id, {key}) AS m FROM band) WHERE m < id"""
BOTH = "both_ways AS (SELECT src AS u, dst AS v FROM e UNION SELECT dst, src FROM e)"


def _dedup(params: DedupParams, text: str, select: str, ident: str = "doc_id", source: str = "documents", key: str = "key", before: str = "") -> str:
    return f"""WITH RECURSIVE {before}{_signature_ctes(params, text, ident, source)},
    {_components_ctes(BAND_STARS.format(key=key))},
    gone AS (SELECT node FROM cc WHERE root < node)
    {select}"""


def _sizing_sql() -> str:
    """Midpoint sums over 4,000 cells for each candidate."""
    wanted = ", ".join(f"({t}, {n})" for t, n in SIZINGS)
    return f"""WITH want(threshold, num_perm) AS (VALUES {wanted}),
    cand AS (SELECT threshold::DOUBLE AS threshold, num_perm, b, r FROM want, range(1, 257) x(b), range(1, 257) y(r) WHERE b * r <= num_perm),
    cell AS (SELECT (k + 0.5) / 4000 AS x FROM range(4000) t(k)),
    err AS (SELECT threshold, num_perm, b, r,
        avg(0.5 * threshold * (1 - pow(1 - pow(x * threshold, r), b)) + 0.5 * (1 - threshold) * pow(1 - pow(threshold + x * (1 - threshold), r), b)) AS e
        FROM cand, cell GROUP BY threshold, num_perm, b, r)
    SELECT threshold, num_perm, arg_min(b, e)::INT AS bands, arg_min(r, e)::INT AS rows_per_band FROM err GROUP BY 1, 2"""


def oracle() -> dict[str, str]:
    stats = "SELECT band_id, band_hash, min(doc_id) AS min_doc_id, count(DISTINCT doc_id) AS n_docs FROM bands WHERE band_hash IS NOT NULL GROUP BY 1, 2"
    clusters = f"WITH RECURSIVE {_components_ctes(STARS)}"
    uid = "numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS uid, doc_id, text FROM documents), "
    return {
        "scan_project": "SELECT doc_id, text FROM documents",
        "row_count": "SELECT count(*) AS n_rows FROM documents",
        "limit_by_id": "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50",
        "preview": """SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text,
          CASE WHEN length(source) > 100 THEN substr(source, 1, 100) || '...' ELSE source END AS source FROM documents ORDER BY doc_id LIMIT 3""",
        "schema_inspect": """SELECT (ordinal_position - 1)::INT AS position, column_name AS name,
          CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END AS type,
          is_nullable = 'YES' AS nullable FROM information_schema.columns WHERE table_name = 'documents'""",
        "glob_any_depth": "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id % 4 <> 2",
        "partition_columns": "SELECT doc_id, coalesce(lower(lang), 'none') AS part FROM documents WHERE coalesce(lower(lang), 'none') IN ('en', 'none')",
        "dedup_keep_punctuation": _dedup(PLAIN.with_(tokenizer="punctuation"), LOWER, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT node FROM gone)"),
        "dedup_keep_space": _dedup(PLAIN.with_(tokenizer="space"), LOWER, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT node FROM gone)"),
        "dedup_keep_ignoring": _dedup(PLAIN, IGNORE, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT node FROM gone)"),
        "stripped_links": f"WITH {_signature_ctes(STRIPPED, STRIP)} {BAND_STARS.format(key='raw_key').replace('m AS a, id AS b', 'm AS src, id AS dst')}",
        "stripped_cluster_sizes": _dedup(STRIPPED, STRIP, "SELECT cluster_size, count(*) AS n_clusters FROM (SELECT root, count(*) AS cluster_size FROM cc GROUP BY root) GROUP BY 1", key="raw_key"),
        "glob_read": "SELECT doc_id, n_chars FROM documents",
        "multi_path_read": "SELECT doc_id, count(*) AS n_rows, count(text) AS n_texts FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, NULL FROM sent_docs) GROUP BY doc_id",
        "jsonl_roundtrip": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
        "sequential_uid": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS uid FROM documents",
        "text_normalized": f"SELECT doc_id, md5({LOWER}) AS lower_md5, md5({STRIP}) AS stripped_md5 FROM documents",
        "char_ngram_counts": f"SELECT gram, count(*) AS n_docs, sum(n)::BIGINT AS n_total FROM (SELECT gram, doc_id, count(*) AS n FROM ({_grams(LOWER, 5)}) WHERE gram IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
        "punct_shingles": f"SELECT DISTINCT doc_id, gram AS shingle FROM ({_shingles(PUNCTUATION, 5)})",
        "space_shingles": f"SELECT DISTINCT doc_id, gram AS shingle FROM ({_shingles(WORD_BREAK, 5)})",
        "token_hashes": f"""SELECT gram, ('0x' || substr(s,7,2) || substr(s,5,2) || substr(s,3,2) || substr(s,1,2))::BIGINT AS hash
          FROM (SELECT DISTINCT gram, sha1(gram) AS s FROM ({_grams(LOWER, 5)}) WHERE gram IS NOT NULL)""",
        "minhash_signature": f"WITH {_signature_ctes(PLAIN, LOWER)} SELECT id AS doc_id, perm_id, v AS value FROM sig",
        "empty_signature": f"SELECT doc_id, {MASK_32} AS low, {MASK_32} AS high, {PLAIN.num_perm} AS n FROM documents WHERE length(text) < 200",
        "lsh_bands": f"WITH {_signature_ctes(PLAIN, LOWER)} SELECT id AS doc_id, band_id, key AS band_hash FROM band",
        "bands_from_signatures": f"WITH {_signature_ctes(PLAIN, LOWER)} SELECT id AS doc_id, band_id, key AS band_hash FROM band",
        "band_checkpoint_roundtrip": f"WITH {_signature_ctes(PLAIN, LOWER)} SELECT id AS doc_id, band_id, key AS band_hash FROM band",
        "lsh_bands_rawkey": f"WITH {_signature_ctes(STRIPPED, STRIP)} SELECT id AS doc_id, band_id, raw_key AS band_key FROM band",
        "lsh_optimal_params": _sizing_sql(),
        "band_collisions": """SELECT band_id, band_hash, min(doc_id) AS rep, count(*) AS members FROM bands
          WHERE doc_id IS NOT NULL AND band_id IS NOT NULL AND band_hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""",
        "band_star_edges": f"SELECT a AS src, b AS dst FROM ({STARS})",
        "pairs_csv_roundtrip": f"SELECT a AS src, b AS dst FROM ({STARS})",
        "distinct_edges": "SELECT DISTINCT src, dst FROM edges",
        "large_star_step": f"""WITH e AS (SELECT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL), {BOTH},
          m AS (SELECT u, least(u, min(v)) AS m FROM both_ways GROUP BY u)
          SELECT DISTINCT v AS node, m AS parent FROM both_ways JOIN m USING (u) WHERE v > u""",
        "small_star_step": """WITH e AS (SELECT DISTINCT greatest(src, dst) AS u, least(src, dst) AS v FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
          m AS (SELECT u, min(v) AS m FROM e GROUP BY u)
          SELECT v AS node, m AS parent FROM e JOIN m USING (u) UNION SELECT u, m FROM m""",
        "components_of_edges": f"WITH RECURSIVE {_components_ctes(EDGES)} SELECT node, root FROM cc",
        "components_by_stars": f"WITH RECURSIVE {_components_ctes(EDGES)} SELECT node, root FROM cc",
        "components_of_orders": f"WITH RECURSIVE {_components_ctes('SELECT -o_custkey - 1 AS a, o_orderkey AS b FROM orders')} SELECT node, root FROM cc",
        "components_of_strings": "WITH RECURSIVE " + _components_ctes("SELECT DISTINCT src::VARCHAR AS a, dst::VARCHAR AS b FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL") + " SELECT node, root FROM cc",
        "band_clusters": f"{clusters} SELECT node AS doc_id, root FROM cc",
        "dedup_keep": _dedup(PLAIN, LOWER, "SELECT doc_id, n_chars, source FROM documents WHERE doc_id NOT IN (SELECT node FROM gone)"),
        **dict.fromkeys(("dedup_keep_by_stars", "stream_keep"), _dedup(PLAIN, LOWER, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT node FROM gone)")),
        "duplicate_ids": _dedup(PLAIN, LOWER, "SELECT node AS doc_id FROM gone"),
        "dedup_keep_stripped": _dedup(STRIPPED, STRIP, "SELECT doc_id, md5(text) AS text_md5 FROM numbered WHERE uid NOT IN (SELECT node FROM gone)", "uid", "numbered", "raw_key", uid),
        "dedup_keep_string_order": _dedup(PLAIN, LOWER, "SELECT doc_id FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT node FROM gone)", "sid", "(SELECT doc_id::VARCHAR AS sid, text FROM documents)"),
        "dedup_metrics": _dedup(PLAIN, LOWER, """SELECT n_input, n_removed, n_input - n_removed AS n_kept, round(100.0 * n_removed / n_input, 4)::DOUBLE AS removed_percent
          FROM (SELECT (SELECT count(*) FROM documents) AS n_input, (SELECT count(*) FROM gone) AS n_removed)"""),
        "keep_by_stored_bands": f"{clusters} SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT node FROM cc WHERE root < node)",
        "cluster_sizes": f"{clusters} SELECT cluster_size, count(*) AS n_clusters FROM (SELECT root, count(*) AS cluster_size FROM cc GROUP BY root) GROUP BY 1",
        "cluster_samples": f"""{clusters} SELECT root, doc_id FROM (SELECT root, node AS doc_id, row_number() OVER (PARTITION BY root ORDER BY node) AS k FROM cc
          WHERE root IN (SELECT DISTINCT root FROM cc ORDER BY root LIMIT 10)) WHERE k <= 5""",
        "p5_key_stats": stats,
        "p5_found": "SELECT band_id, band_hash FROM bands WHERE band_hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) * 200 >= (SELECT count(*) FROM bands WHERE band_hash IS NOT NULL)",
    }
