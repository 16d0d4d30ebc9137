"""Subtitle text, timestamps, flag parsing and path names."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T


def format_timestamp(seconds: str, always_hours: bool = False, decimal: str = ".") -> Column:
    """`[HH:]MM:SS.mmm`, milliseconds rounded half to even; a negative time is an error."""
    ms = f"CAST(bround({seconds} * 1000D, 0) AS BIGINT)"
    tail = F.format_string(
        f"%02d:%02d{decimal}%03d", F.expr(f"({ms} div 60000) % 60"), F.expr(f"({ms} div 1000) % 60"), F.expr(f"{ms} % 1000")
    )
    hours = F.expr(f"{ms} div 3600000")
    full = F.concat(F.format_string("%02d:", hours), tail)
    label = full if always_hours else F.when(hours > 0, full).otherwise(tail)
    return F.when(F.expr(f"{seconds} >= 0"), label).when(
        F.expr(f"{seconds} < 0"), F.raise_error(F.lit("negative timestamp")).cast("string")
    )


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sanitise(text: Column, arrow: bool = False, tab: bool = False) -> Column:
    out = strip(text)
    if arrow:
        out = F.replace(out, F.lit("-->"), F.lit("->"))
    return F.translate(out, "\t", " ") if tab else out


#: Bytes of a text that are deflated at a time.
PIECE = 1 << 16


@F.arrow_udf(T.DoubleType())
def compression_ratio(text: pa.Array) -> pa.Array:
    """UTF-8 bytes over deflated bytes of the whole text; high values mean repetition.

    The bytes are read where Arrow has them, and of the deflated ones only the number is kept.
    """

    def ratio(raw: pa.Buffer) -> float:
        press, whole = zlib.compressobj(), memoryview(raw)
        made = sum(len(press.compress(whole[at : at + PIECE])) for at in range(0, len(whole), PIECE))
        return len(whole) / (made + len(press.flush()))

    return pa.array((ratio(t.as_buffer()) if t.is_valid else None for t in text), pa.float64(), size=len(text))


def optional_number(text: str, kind: str = "double") -> Column:
    return F.expr(f"try_cast(nullif({text}, 'None') AS {kind})")


def exact_bool(text: Column) -> Column:
    return F.when(text == "True", F.lit(True)).when(text == "False", F.lit(False))


def speaker_from_path(path: Column, legacy: bool = False) -> Column:
    """File name up to its first dot. `legacy` strips trailing suffix *characters* instead of the suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    if not legacy:
        return F.regexp_replace(name, r"\..*$", "")
    suffixes = F.regexp_extract(name, r"(\..*)$", 1)
    return F.when(suffixes == "", name).otherwise(F.rtrim(name, suffixes))
