"""Functions against plain Python."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftstone.functions.bands import explode_bands
from siftstone.functions.lsh import MERSENNE_61, optimal_bands, permutations
from siftstone.functions.minhash import permuted, signer
from siftstone.functions.text import char_ngrams, fragment_shingles, marked_first, normalized, preview, token_hash32
from siftstone.params import PLAIN, STRIPPED, DedupParams


@pytest.mark.parametrize("threshold,perms,bands,rows", [(0.7, 128, 14, 9), (0.8, 128, 9, 13), (0.5, 128, 25, 5), (0.9, 128, 5, 25), (0.7, 256, 25, 10), (0.7, 64, 8, 8), (0.7, 32, 5, 6), (0.7, 16, 3, 5)])
def test_band_sizes(threshold, perms, bands, rows):
    assert optimal_bands(threshold, perms) == (bands, rows)


def test_first_permutation():
    a, b = permutations(42, 128)
    assert (int(a[0]), int(b[0])) == (2297359619001564596, 1396682528897996046)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=5), st.lists(st.tuples(st.integers(1, MERSENNE_61 - 1), st.integers(0, MERSENNE_61 - 1)), min_size=1, max_size=4))
def test_wrapping_arithmetic(hashes, pairs):
    a, b = (np.array(c, dtype=np.uint64) for c in zip(*pairs))
    got = permuted(np.array(hashes, dtype=np.uint64), a, b).min(axis=0).tolist()
    assert got == [min((h * x + y) % 2**64 % MERSENNE_61 % 2**32 for h in hashes) for x, y in pairs]


def test_signatures_of_edge_texts():
    small = PLAIN.with_(num_perm=16)
    got = signer(small)(pd.Series([None, "", "abcd", "abcde", "abcdf"]))
    assert got[0] is None
    assert set(got[1]) == set(got[2]) == {2**32 - 1}
    assert list(got[3]) != list(got[4])
    kept = signer(small.with_(short_docs="keep"))(pd.Series(["abcd"]))
    assert kept[0] is None


def test_long_text_in_chunks():
    text = "".join(chr(97 + (i * i) % 23) + str(i) for i in range(6000))
    a, b = permutations(42, 16)
    hashes = {int.from_bytes(hashlib.sha1(text[i : i + 5].encode()).digest()[:4], "little") for i in range(len(text) - 4)}
    want = [min((h * int(x) + int(y)) % 2**64 % MERSENNE_61 % 2**32 for h in hashes) for x, y in zip(a, b)]
    assert signer(PLAIN.with_(num_perm=16))(pd.Series([text]))[0].tolist() == want


def test_groups_do_not_change_signatures(monkeypatch):
    from siftstone.functions import minhash

    texts = pd.Series(["some text number %d 😀 %s" % (k, "x" * (k % 9)) for k in range(60)] + ["", None, "日本語文字列"])
    whole = signer(PLAIN.with_(num_perm=16))(texts)
    monkeypatch.setattr(minhash, "GROUP", 40)
    for x, y in zip(whole, signer(PLAIN.with_(num_perm=16))(texts)):
        assert (x is None and y is None) or x.tolist() == y.tolist()


def test_fragment_shingles_as_tokens():
    sign = signer(PLAIN.with_(num_perm=16, tokenizer="space", ngram=2))
    one, two, none = sign(pd.Series(["a b c a b", "b c a b a", "a"]))
    assert one.tolist() != two.tolist() and set(none.tolist()) == {2**32 - 1}


def test_parameters_are_checked():
    for bad in ({"threshold": 1.5}, {"num_perm": 0}, {"ngram": 0}, {"tokenizer": "x"}, {"short_docs": "x"}, {"bands": 20, "rows": 20}):
        with pytest.raises(ValueError):
            DedupParams(**bad)
    with pytest.raises(NotImplementedError):
        DedupParams(tokenizer="sentencepiece")
    assert (STRIPPED.bands, STRIPPED.rows) == (9, 13)


def test_text_columns(spark):
    texts = [None, "", "ab", "日本語文字列😀ab", "A,b;;C d!"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", char_ngrams(F.col("t"), 5).alias("g"), fragment_shingles(F.col("t"), 2).alias("s"), normalized(F.col("t"), True, True).alias("n"), preview(F.col("t"), 3).alias("p")
    ).collect()
    for r in rows:
        t = r["t"]
        assert r["g"] == (None if t is None else [t[i : i + 5] for i in range(len(t) - 4)])
    assert rows[4]["s"] == ["A b", "b ", " C d", "C d "]
    assert rows[4]["n"] == "abc d"
    assert rows[3]["p"] == "日本語..." and rows[2]["p"] == "ab"


def test_token_hash(spark):
    r = spark.createDataFrame([("héllo",), ("",)], "t string").select("t", token_hash32(F.col("t")).alias("h")).collect()
    assert [x["h"] for x in r] == [int.from_bytes(hashlib.sha1(x["t"].encode()).digest()[:4], "little") for x in r]


def test_bands(spark):
    sig = [5, 2**32 - 1, 7, 9, 11]
    df = spark.createDataFrame([(1, sig), (2, None)], "id long, m array<long>")
    got = {(r["doc_id"], r["band_id"]): r["band_hash"] for r in explode_bands(df, "id", "m", 2, 2).collect()}
    want = {(1, k): hashlib.sha256(np.array(sig[2 * k : 2 * k + 2], dtype="<u4").tobytes()).hexdigest()[:16] for k in range(2)}
    assert got == want
    raw = {r["band_id"]: r["band_key"] for r in explode_bands(df, "id", "m", 2, 2, raw=True).collect()}
    assert raw == {k: (k.to_bytes(4, "big") + np.array(sig[2 * k : 2 * k + 2], dtype="<u4").tobytes()).hex() for k in range(2)}


def test_marked_first(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (3, None), (4, ["a"])], "i int, a array<string>").select("i", marked_first(F.col("a")).alias("m"))
    got = {r["i"]: r["m"] and [tuple(x) for x in r["m"]] for r in df.collect()}
    assert got == {1: [("a", 1), ("b", 1), ("b", 0), ("b", 0)], 2: [], 3: None, 4: [("a", 1)]}


def test_mixing_can_be_undone():
    import numpy as np

    from siftstone.functions.windows import mixed, unmixed

    x = np.concatenate([np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64), np.array([0, 1, (1 << 64) - 1], dtype=np.uint64)])
    assert (unmixed(mixed(x)) == x).all() and (mixed(unmixed(x)) == x).all()
