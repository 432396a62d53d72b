"""Guarded arithmetic, clamps, time and vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column, otherwise: Column | float = 0.0) -> Column:
    """``n / d`` where ``d`` is positive, else ``otherwise``."""
    return F.when(d > 0, n.cast("double") / d).otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` held between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def estimated_tokens(text: Column) -> Column:
    """Half the characters, rounded up."""
    return F.ceil(F.length(text) / 2)


def elapsed_ms(begin: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(begin)


def iso_of_seconds(seconds: Column) -> Column:
    """Epoch seconds as an ISO string in UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def seconds_of(value: Column) -> Column:
    """An ISO string, or epoch milliseconds as digits, as whole epoch seconds."""
    millis = value.try_cast("long")
    return F.floor(F.coalesce(millis, F.unix_millis(F.try_to_timestamp(value))) / 1000).cast("long")


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, summed in double precision from the first element on."""
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x))


def hash_embedding(text: Column, dimension: int = 16) -> Column:
    """A deterministic stand-in for an embedding: the bytes of MD5 as fractions, 16 dimensions at most."""
    if not 1 <= dimension <= 16:
        raise ValueError("MD5 has 16 bytes")
    # the digest is split once; no lambda takes it again for each dimension
    digits = F.regexp_extract_all(F.md5(text), F.lit("(..)"), 1)
    return F.transform(F.slice(digits, 1, dimension), lambda d: F.conv(d, 16, 10).cast("double") / 255.0)
