"""Numeric expressions: composite distance, histogram bins, vector products, metric ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
# Width of a mention-count bin: an eighth of a year in whole days.
PROFILE_BIN_SECONDS = (365 // 8) * DAY


def composite_distance(para: Column, sent: Column, doc: Column) -> Column:
    """Paragraph distance weighs most, then sentence distance, then characters."""
    return (F.lit(1000000) * para + F.lit(100000) * sent + doc).cast("bigint")


def equal_width_bin(x: Column, low: Column, high: Column, bins: int = 10) -> Column:
    """Bin number of ``x`` in ``bins`` equal parts of [low, high], the last part closed.

    A constant series is widened by half a unit on both sides, which puts it in the middle bin.
    """
    scaled = F.floor(((x - low) * F.lit(bins)) / (high - low))
    return F.when(high == low, F.lit(bins // 2)).otherwise(F.least(scaled, F.lit(bins - 1))).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where the denominator is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)
