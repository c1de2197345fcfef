"""Stage 1: weighted share of nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.woe import quoted


def missing_ratios(df: DataFrame, w: Column | None = None, weight: str | None = None) -> DataFrame:
    """(feature, missing_ratio) of every column but the weight, in one pass; greatest first, then in column order."""
    names = [c for c in df.columns if c != weight]
    w = F.lit(1.0) if w is None else w
    sums = df.agg(F.sum(w).alias("all"), F.count(F.lit(1)).alias("rows"), *[F.sum(F.when(quoted(c).isNull(), w).otherwise(0.0)).alias(f"m{i}") for i, c in enumerate(names)])
    lines = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"), F.col(f"m{i}").alias("m")) for i, c in enumerate(names)]))
    checked = F.when(F.abs(F.col("all")) < 2.220446049250313e-16, F.raise_error(F.lit("Total weight is zero"))).otherwise(F.col("all"))
    rows = sums.where("rows > 0").select(checked.alias("all"), lines.alias("x"))
    return rows.select(F.col("x.place"), F.col("x.feature"), (F.col("x.m") / F.col("all")).alias("missing_ratio")).orderBy(F.desc("missing_ratio"), "place").drop("place")


def above_threshold(ratios: DataFrame, threshold: float, target: str) -> DataFrame:
    """Features to drop: strictly above the threshold, never the target."""
    return ratios.where((F.col("missing_ratio") > threshold) & (F.col("feature") != target))
