"""Text normalisation and shingling as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One ASCII punctuation mark; a run of characters that Unicode calls white space. Both mean the same in
#: Java, Python and RE2, so the signatures, these expressions and SQL split alike.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
WORD_BREAK = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def normalized(text: Column, lowercase: bool = True, strip_punctuation: bool = False, ignore_pattern: str | None = None) -> Column:
    """Lower case first, then ASCII punctuation and all matches of ``ignore_pattern`` (a Java regular expression) removed; null stays null."""
    out = F.lower(text) if lowercase else text
    out = F.regexp_replace(out, PUNCTUATION, "") if strip_punctuation else out
    return F.regexp_replace(out, ignore_pattern, "") if ignore_pattern else out


def _windows(parts: Column, n: int, glue: str) -> Column:
    """Each n neighbouring elements joined. The array is zipped with its own shifts: linear in its length, where slicing inside a lambda would build it anew for each element."""
    out = parts
    for k in range(1, n):
        out = F.zip_with(out, F.slice(parts, k + 1, F.size(parts)), lambda x, y: F.concat(x, F.lit(glue), y))
    return F.filter(out, lambda w: w.isNotNull())


def char_ngrams(text: Column, n: int) -> Column:
    """All code-point n-grams in order, repeated ones included; an empty array for shorter texts, null for null."""
    empty = F.array().cast("array<string>")
    return F.when(F.length(text) >= n, _windows(F.split(text, ""), n, "")).when(text.isNotNull(), empty)


def marked_first(items: Column) -> Column:
    """The array's elements in sorted order as (item, first): ``first`` is 1 at the first of equal elements, else 0. Linear after the sort."""
    ordered = F.sort_array(items)
    shifted = F.slice(F.concat(F.array(F.lit(None).cast("string")), ordered), 1, F.size(ordered))
    return F.zip_with(ordered, shifted, lambda x, y: F.struct(x.alias("item"), F.when(x.eqNullSafe(y), 0).otherwise(1).alias("first")))


def fragment_shingles(text: Column, n: int, pattern: str = PUNCTUATION) -> Column:
    """Runs of n neighbouring fragments joined by a blank, repeated ones included; fragments lie between matches of the pattern, empty ones stay."""
    return _windows(F.split(text, pattern, -1), n, " ")


def token_hash32(token: Column) -> Column:
    """First four bytes of SHA-1, little-endian, as a bigint."""
    hex8 = F.substring(F.sha1(F.encode(token, "UTF-8")), 1, 8)
    turned = F.concat(*(F.substring(hex8, i, 2) for i in (7, 5, 3, 1)))
    return F.conv(turned, 16, 10).cast("bigint")


def preview(value: Column, width: int = 100) -> Column:
    """Long strings cut to ``width`` code points with three dots."""
    return F.when(F.length(value) > width, F.concat(F.substring(value, 1, width), F.lit("..."))).otherwise(value)
