"""Pixel arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_level(value: Column, center: Column, width: Column) -> Column:
    """0 to 255: the share of the window below a value, floored."""
    low = center - width / 2
    inside = F.least(F.greatest(value, low), center + width / 2)
    return F.floor((inside - low) / width * 255).cast("int")


def region(x: Column, y: Column, w: Column, h: Column, columns: Column, rows: Column, mode: str = "pixel", scale_x: float = 1.0, scale_y: float = 1.0) -> Column:
    """struct(x0, y0, x1, y1) in whole pixels inside the frame: floor of the start, ceiling of the end. mode: pixel or normalized."""
    if mode not in ("pixel", "normalized"):
        raise ValueError("a single region is in pixel or normalized coordinates")
    kx, ky = (columns, rows) if mode == "normalized" else (F.lit(1), F.lit(1))
    clamp = lambda v, top: F.greatest(F.lit(0), F.least(v, top)).cast("int")
    return F.struct(
        clamp(F.floor(x * kx * scale_x), columns).alias("x0"), clamp(F.floor(y * ky * scale_y), rows).alias("y0"),
        clamp(F.ceil((x + w) * kx * scale_x), columns).alias("x1"), clamp(F.ceil((y + h) * ky * scale_y), rows).alias("y1"),
    )


def percentile_threshold(df: DataFrame, value: str, share: float, keys: Sequence[str] = ()) -> DataFrame:
    """keys, threshold: the least value whose running count passes floor(share * (n - 1)). Counts by value first, so a group's window holds its distinct values only."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    ranked = counts.withColumn("_run", F.sum("_n").over(group.orderBy(value))).withColumn("_all", F.sum("_n").over(group))
    return ranked.filter(F.col("_run") > F.floor(F.lit(share) * (F.col("_all") - 1))).groupBy(*keys).agg(F.min(value).alias("threshold"))
