"""Value histograms and running sums, on which all binning stands.

The histogram has one row for each feature and distinct value, made by partial and final
aggregation. Running sums over it never put a whole feature in one task: rows are dealt out
by ranges of (feature, value), all features together, summed up inside each range, and only
then moved by what the ranges before hold. The number of ranges is the session's number of
shuffle partitions, so it grows with the cluster and not with the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.woe import quoted


@contextmanager
def kept(*tables: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """Tables that are cached inside the block and released behind it."""
    held = [t.persist() for t in tables]
    try:
        yield tuple(held)
    finally:
        for t in held:
            t.unpersist()


def small(df: DataFrame) -> DataFrame:
    """A result of a few rows a feature, held by the driver: it needs no cached table any more."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def long_form(df: DataFrame, features: list[str], kind: str, *keep: str) -> DataFrame:
    """(feature, value, y, w, *keep) of all rows whose target is known."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), quoted(c).cast(kind).alias("value")) for c in features]))
    rows = df.where("__y is not null").select(pairs.alias("x"), F.col("__y").alias("y"), F.col("__w").alias("w"), *keep)
    return rows.select("x.feature", "x.value", "y", "w", *keep)


def histogram(df: DataFrame, features: list[str], kind: str) -> DataFrame:
    """(feature, value, events, non_events, rows); a null value is the missing group."""
    y, w = F.col("y"), F.col("w")
    return long_form(df, features, kind).groupBy("feature", "value").agg(F.sum(y * w).alias("events"), F.sum((1 - y) * w).alias("non_events"), F.count(F.lit(1)).alias("rows"))


@contextmanager
def with_running(df: DataFrame, order: list[str], sums: list[str]) -> Iterator[DataFrame]:
    """df and run_<c>, the running sum of each c within a feature, in ``order``; cached inside the block.

    What the ranges hold is collected: a row for each range and each feature that begins in it.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, "feature", *order).withColumn("__range", F.spark_partition_id())
    inside = Window.partitionBy("feature", "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # cached: a second evaluation may deal the rows out by other ranges
    with kept(dealt.withColumns({f"run_{c}": F.sum(c).over(inside) for c in sums})) as (run,):
        parts = run.groupBy("feature", "__range").agg(*[F.sum(c).alias(c) for c in sums]).collect()
        so_far: dict[str, list] = {}
        base = []
        for p in sorted(parts, key=lambda p: (p.feature, p["__range"])):
            at = so_far.setdefault(p.feature, [0] * len(sums))
            base.append((p.feature, p["__range"], *at))
            so_far[p.feature] = [x + p[c] for x, c in zip(at, sums, strict=True)]
        kind = {c: dict(run.dtypes)[f"run_{c}"] for c in sums}
        rows = [(f, k, *(float(x) if kind[c] == "double" else x for x, c in zip(at, sums, strict=True))) for f, k, *at in base]
        bases = spark.createDataFrame(rows, ", ".join(["feature string", "__range int", *(f"base_{c} {kind[c]}" for c in sums)]))
        moved = run.join(F.broadcast(bases), ["feature", "__range"])
        yield moved.withColumns({f"run_{c}": F.col(f"run_{c}") + F.col(f"base_{c}") for c in sums}).drop("__range", *[f"base_{c}" for c in sums])
