"""Numeric pre-bins: CART over histograms, and positional quantile chunks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.woe import gini_impurity
from .histogram import with_running

INF = float("inf")


@dataclass
class Node:
    """A node of a feature's tree: values in (low, high], sums before it and in it, splits that it may still take."""

    feature: str
    low: float
    high: float
    before: tuple[float, float, int]
    own: tuple[float, float, int]
    budget: int


NODE = "feature string, low double, high double, be double, bn double, br long, e double, n double, r long"


def _rows(nodes: list[Node]) -> list[tuple]:
    return [(x.feature, x.low, x.high, *x.before, *x.own) for x in nodes]


def inside(value: Column) -> Column:
    """value in (low, high]; the top node is open."""
    return (value > F.col("low")) & (value <= F.col("high"))


def split_gain() -> Column:
    """Impurity of a node less that of its halves, for running sums run_*, sums before b* and in the node e, n, r."""
    le, ln = F.col("run_events") - F.col("be"), F.col("run_non_events") - F.col("bn")
    e, n = F.col("e"), F.col("n")
    total = e + n
    left = F.coalesce(F.try_divide(le + ln, total), F.lit(0.0))
    right = F.coalesce(F.try_divide(total - le - ln, total), F.lit(0.0))
    return gini_impurity(e, n) - left * gini_impurity(le, ln) - right * gini_impurity(e - le, n - ln)


def best_splits(running: DataFrame, nodes: list[Node], min_rows: int) -> DataFrame:
    """The split of each node that gains most (lowest value on ties): value is the last one of the left half.

    One aggregation with map-side combine for all features and nodes; only the nodes,
    some tens for each feature, are broadcast.
    """
    spark = running.sparkSession
    open_ = F.broadcast(spark.createDataFrame(_rows(nodes), NODE))
    lr = F.col("run_rows") - F.col("br")
    rows = running.join(open_, "feature").where(inside(F.col("value"))).withColumns({"gain": F.round(split_gain(), 12), "lr": lr})
    fit = rows.where((F.col("lr") >= min_rows) & (F.col("r") - F.col("lr") >= min_rows) & (F.col("gain") > 0))
    best = F.max(F.struct("gain", (-F.col("value")).alias("minus"), (F.col("run_events") - F.col("be")).alias("le"), (F.col("run_non_events") - F.col("bn")).alias("ln"), "lr"))
    return fit.groupBy("feature", "low").agg(best.alias("b")).select("feature", "low", (-F.col("b.minus")).alias("value"), F.col("b.gain").alias("gain"), "b.le", "b.ln", "b.lr")


def cart_nodes(hist: DataFrame, max_bins: int, min_rows: int | dict[str, int]) -> list[Node]:
    """The leaves of every feature's tree, in order of value. hist: feature, value (not null), events, non_events, rows.

    A round splits all open nodes of all features. After a split the left half gets half
    of the budget left (rounded down), the right half the rest.
    """
    least = min_rows if isinstance(min_rows, int) else min(min_rows.values())
    done: list[Node] = []
    with with_running(hist.select("feature", "value", "events", "non_events", "rows"), ["value"], ["events", "non_events", "rows"]) as running:
        tops = running.groupBy("feature").agg(F.sum("events").alias("e"), F.sum("non_events").alias("n"), F.sum("rows").alias("r")).collect()
        open_ = [Node(t.feature, -INF, INF, (0.0, 0.0, 0), (t.e, t.n, t.r), max_bins - 1) for t in tops]
        while open_:
            tried = [x for x in open_ if x.budget > 0 and x.own[2] >= 2 * least]
            done += [x for x in open_ if not (x.budget > 0 and x.own[2] >= 2 * least)]
            if not tried:
                break
            found = {(s.feature, s.low): s for s in best_splits(running, tried, least).collect()}
            open_ = []
            for x in tried:
                s = found.get((x.feature, x.low))
                if s is None:
                    done.append(x)
                    continue
                rest = x.budget - 1
                left = (s.le, s.ln, s.lr)
                right = tuple(a - b for a, b in zip(x.own, left, strict=True))
                after = tuple(a + b for a, b in zip(x.before, left, strict=True))
                open_ += [Node(x.feature, x.low, s.value, x.before, left, rest // 2), Node(x.feature, s.value, x.high, after, right, rest - rest // 2)]
    return sorted(done, key=lambda x: (x.feature, x.low))


def cart_prebins(hist: DataFrame, max_bins: int, min_rows: int) -> DataFrame:
    """(feature, bin, lower, upper, events, non_events); upper is the next bin's lower, infinite for the last."""
    nodes = cart_nodes(hist, max_bins, min_rows)
    at: dict[str, int] = {}
    rows = []
    for x in nodes:
        k = at[x.feature] = at.get(x.feature, -1) + 1
        rows.append((x.feature, x.low, x.high, k))
    ranges = hist.sparkSession.createDataFrame(rows, "feature string, low double, high double, bin int")
    sums = hist.join(F.broadcast(ranges), "feature").where(inside(F.col("value"))).groupBy("feature", "bin").agg(F.min("value").alias("lower"), F.sum("events").alias("events"), F.sum("non_events").alias("non_events"))
    return with_upper(sums)


def with_upper(bins: DataFrame) -> DataFrame:
    nxt = F.lead("lower").over(Window.partitionBy("feature").orderBy("bin"))
    return bins.select("feature", "bin", "lower", F.coalesce(nxt, F.lit(INF)).alias("upper"), "events", "non_events")


def quantile_prebins(hist: DataFrame, rows: DataFrame, prebins: int, ties: list[str]) -> DataFrame:
    """As cart_prebins: chunks of ceil(n / prebins) rows in order of value.

    hist: the histogram of rows (feature, value, y, w, *ties). Its running counts say which
    values lie in one chunk as a whole. Only the rows of the others, at most prebins - 1
    values a feature, are looked at one by one: they are told apart by ``ties``, then by y
    and w. ``ties`` should be as good as a key; without any, equal rows count as one with a number.
    """
    known = hist.where("value is not null").select("feature", "value", "events", "non_events", "rows")
    spark = hist.sparkSession
    with with_running(known, ["value"], ["rows"]) as running:
        n = {r.feature: r.n for r in running.groupBy("feature").agg(F.max("run_rows").alias("n")).collect()}
        chunks = F.broadcast(spark.createDataFrame([(f, -(-x // prebins)) for f, x in n.items()], "feature string, chunk long"))
        first, last = (F.floor(x / F.col("chunk")).cast("int") for x in (F.col("run_rows") - F.col("rows"), F.col("run_rows") - 1))
        placed = running.join(chunks, "feature").withColumns({"first": first, "last": last}).withColumn("cut", F.when(F.col("first") < F.col("last"), F.col("value")))
        # a row for each bin and each value that a bin's end goes through
        found = placed.groupBy("feature", "first", "cut").agg(F.min("value").alias("lower"), F.sum("events").alias("events"), F.sum("non_events").alias("non_events"), F.min(F.col("run_rows") - F.col("rows")).alias("before")).collect()
    whole = [r for r in found if r.cut is None]
    cut = spark.createDataFrame([(r.feature, r.cut, r.before, -(-n[r.feature] // prebins)) for r in found if r.cut is not None], "feature string, value double, before long, chunk long")
    one = [*ties, "y", "w"]
    groups = rows.join(F.broadcast(cut.select("feature", "value")), ["feature", "value"])
    # with columns that tell rows apart there is nothing to count
    groups = groups.withColumn("k", F.lit(1).cast("long")) if ties else groups.groupBy("feature", "value", *one).agg(F.count(F.lit(1)).alias("k"))
    with with_running(groups, ["value", *one], ["k"]) as running:
        # a value's counts go on from those before it: run_k less the least of its value, which is the first row's
        spans = running.join(F.broadcast(running.groupBy("feature", "value").agg(F.min(F.col("run_k") - F.col("k")).alias("base"))), ["feature", "value"]).join(F.broadcast(cut), ["feature", "value"])
        spans = spans.withColumn("end", F.col("before") + F.col("run_k") - F.col("base")).withColumn("start", F.col("end") - F.col("k"))
        bins = F.sequence(F.floor(F.col("start") / F.col("chunk")), F.floor((F.col("end") - 1) / F.col("chunk")))
        parts = spans.withColumn("bin", F.explode(bins)).withColumn("k", F.least("end", (F.col("bin") + 1) * F.col("chunk")) - F.greatest("start", F.col("bin") * F.col("chunk")))
        y, w = F.col("y"), F.col("w") * F.col("k")
        split = parts.groupBy("feature", F.col("bin").cast("int").alias("bin")).agg(F.min("value").alias("lower"), F.sum(y * w).alias("events"), F.sum((1 - y) * w).alias("non_events")).collect()
    sums: dict[tuple[str, int], list] = {}
    for key, r in [*(((r.feature, r["first"]), r) for r in whole), *(((r.feature, r.bin), r) for r in split)]:
        at = sums.setdefault(key, [INF, 0.0, 0.0])
        sums[key] = [min(at[0], r.lower), at[1] + r.events, at[2] + r.non_events]
    made = spark.createDataFrame([(*k, *v) for k, v in sorted(sums.items())], "feature string, bin int, lower double, events double, non_events double")
    return with_upper(made)


def min_rows(n_rows: int, pct: float | None) -> int:
    """Rows that a CART bin needs, of all rows of the table; 5 if no share is given."""
    return 5 if pct is None else max(1, math.floor(n_rows * pct / 100))
