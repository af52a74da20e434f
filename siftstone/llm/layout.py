"""Documents that differ in layout only: letter case, blanks, punctuation, order of named fields."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.units import letters_and_digits
from siftstone.operators.scratch import written
from siftstone.operators.skew import counted_heavy, lookup

LEAST_CHARS = 40
#: Marks of lists, quotations and emphasis that may stand before and after a field's name; marks that a name does not hold.
BEFORE_NAME, AFTER_NAME, NOT_IN_NAME = ">*•-–—#\"'_{", "*\"'_", '\n|;"'


def _filled(parts: list[str]) -> list[str]:
    return [x for x in parts if letters_and_digits(x).size]


def _segmentations(text: str):
    """Ways to cut a text into pieces of which each should be one field: by lines, bars, semicolons."""
    yield _filled(re.split(r"[\r\n]+", text))
    yield _filled(text.split("|"))
    yield _filled(text.split(";"))


def _pairs(parts: list[str]) -> list[tuple[str, str]]:
    """Each part as (name, value), cut at its first colon; empty when one is no field: without a colon, or its name does not begin with a letter."""
    out = []
    for part in parts:
        at = min((k for k in (part.find(":"), part.find("：")) if k >= 0), default=-1)
        name = part[:at].strip() if at >= 0 else ""
        while name and (name[0] in BEFORE_NAME or name[0].isspace()):
            name = name.lstrip(BEFORE_NAME).lstrip()
        while name and (name[-1] in AFTER_NAME or name[-1].isspace()):
            name = name.rstrip(AFTER_NAME).rstrip()
        if not name or not name[0].isalpha() or any(c in name for c in NOT_IN_NAME):
            return []
        out.append((name, part[at + 1 :]))
    return out


class _Fields(list):
    """The (name, value) pairs of a JSON object."""


def _spelled(value) -> str:
    """A JSON value as text: items of a list in their order, fields of an object in that of their names."""
    if isinstance(value, _Fields):
        return " ".join(f"{k} {v}" for k, v in sorted((letters(k), _spelled(v)) for k, v in value))
    if isinstance(value, list):
        return " ".join(map(_spelled, value))
    return value if isinstance(value, str) else json.dumps(value)


def letters(text: str) -> str:
    """The letters and digits of a text, in order, without letter case."""
    return letters_and_digits(text).tobytes().decode("utf-32-le", "surrogatepass")


def named_fields(text: str) -> list[tuple[bytes, bytes]] | None:
    """(name, value) pairs, letters and digits only, when the text consists of two or more named fields and nothing else.

    A text is one JSON object, whatever its values, or pieces that all are a
    name, a colon and a value: its lines, else what bars separate, else what
    semicolons separate.
    """
    start, end = text.find("{"), text.rfind("}")
    pairs: list[tuple[str, str]] = []
    if 0 <= start < end and not letters_and_digits(text[:start]).size and not letters_and_digits(text[end + 1 :]).size:
        try:
            made = json.loads(text[start : end + 1], strict=False, object_pairs_hook=_Fields, parse_float=str, parse_int=str)
            pairs = [(k, _spelled(v)) for k, v in made]
        except (ValueError, RecursionError):
            pairs = []
    if not pairs:
        pairs = next((p for parts in _segmentations(text) if len(p := _pairs(parts)) > 1), [])
    if len(pairs) < 2:
        return None
    out = [(letters_and_digits(k).tobytes(), letters_and_digits(v).tobytes()) for k, v in pairs]
    return out if all(k for k, _ in out) else None


def canonical(text: str) -> tuple[bytes, bytes | None]:
    """SHA-256 of the whole canonical text, and of its sorted fields if it has any."""
    fields = named_fields(text) if ":" in text or "：" in text else None
    key = None
    if fields is not None:
        whole = hashlib.sha256()
        for name, value in sorted(fields):
            whole.update(len(name).to_bytes(8, "little") + name + len(value).to_bytes(8, "little") + value)
        key = whole.digest()
    return hashlib.sha256(letters_and_digits(text).tobytes()).digest(), key


def equal_contents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """(groups, raw): ``groups`` has (content, first_doc, copies), one row per content;
    ``raw`` has (raw, content, raw_copies) for each distinct raw text, both as SHA-256.

    Byte-identical texts collapse first, with counts; only the distinct ones are
    made canonical; these group on their whole canonical text (by its SHA-256, so
    that no text is shuffled a second time), the counts summed; at last contents
    made of named fields group on their sorted fields. All sums have map-side
    partial results, so a text with a third of all rows costs one row a task.
    Null texts and those under ``least_chars`` take no part. A text without
    letters and digits equals every other such text. Every row is a copy, repeated
    rows too. Should equal letters come from cards with different fields, the least
    fields stand for them all. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") >= least_chars)
    distinct = texts.groupBy("text").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))

    @F.pandas_udf("struct<letters: binary, fields: binary>")
    def canonicalise(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([canonical(t) for t in column], columns=["letters", "fields"])

    made = written(
        distinct.select(F.unhex(F.sha2("text", 256)).alias("raw"), canonicalise("text").alias("c"), "first_doc", "copies").select("raw", "c.letters", "c.fields", "first_doc", "copies"),
        "canonical",
    )
    by_letters = made.groupBy("letters").agg(F.min("first_doc").alias("first_doc"), F.sum("copies").alias("copies"), F.min("fields").alias("fields"))
    content = F.coalesce("fields", "letters").alias("content")
    merged = written(by_letters.select("letters", content, "first_doc", "copies"), "contents")
    groups = merged.groupBy("content").agg(F.min("first_doc").alias("first_doc"), F.sum("copies").alias("copies"))
    return groups, made.select("raw", "letters", F.col("copies").alias("raw_copies")).join(merged.select("letters", "content"), "letters").select("raw", "content", "raw_copies")


def copies_by_layout(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(first_doc, doc_id): each document but the first of every group of equal documents, no row twice.

    Members come from a second scan that carries only the raw text's SHA-256; a
    hot text is looked up in a broadcast of the few hot keys, never shuffled.
    """
    groups, raw = equal_contents(docs, id_col, text_col)
    hot = counted_heavy(raw, ["raw"], "raw_copies")
    shared = raw.join(groups.where("copies > 1").select("content", "first_doc"), "content").select("raw", "first_doc")
    mine = docs.where(F.length(text_col) >= LEAST_CHARS).select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.col(text_col), 256)).alias("raw"))
    return lookup(mine, written(shared, "shared"), "raw", hot=hot).where("doc_id <> first_doc").select("first_doc", "doc_id").distinct()
