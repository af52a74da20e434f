"""Bands of a signature, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _little_endian_hex(value: Column) -> Column:
    word = F.lpad(F.hex(value), 8, "0")
    return F.concat(*(F.substring(word, i, 2) for i in (7, 5, 3, 1)))


def _values(sig: Column, band: Column, rows: int) -> Column:
    return F.array_join(F.transform(F.slice(sig, band * rows + 1, rows), _little_endian_hex), "")


def band_hash(sig: Column, band: Column, rows: int) -> Column:
    """First 16 hex digits of SHA-256 over the band's little-endian 32-bit values."""
    return F.substring(F.sha2(F.unhex(_values(sig, band, rows)), 256), 1, 16)


def raw_band_key(sig: Column, band: Column, rows: int) -> Column:
    """Big-endian 32-bit band number followed by the band's little-endian values, in lower-case hex."""
    return F.lower(F.concat(F.lpad(F.hex(band), 8, "0"), _values(sig, band, rows)))


def explode_bands(signed: DataFrame, id_col: str, sig_col: str, bands: int, rows: int, raw: bool = False) -> DataFrame:
    """(doc_id, band_id, band_hash or band_key): one row per document and band; values past bands*rows play no part; rows without a signature give none."""
    made = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: (raw_band_key if raw else band_hash)(F.col(sig_col), i, rows))
    return (
        signed.where(F.col(sig_col).isNotNull())
        .select(F.col(id_col).alias("doc_id"), F.posexplode(made).alias("band_id", "band_key" if raw else "band_hash"))
    )
