"""Stage 2: bins, WoE, IV and Gini of all features."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ReduceConfig
from ..functions.woe import bin_statistics, iv, left_out, numeric_columns, text_columns, woe
from .binning import cart_nodes, cart_prebins, min_rows, quantile_prebins
from .histogram import histogram, kept, long_form, small, with_running
from .merge import merged

LEAST_ROWS, LEAST_VALUES = 5, 10
#: Features that are unpivoted together. What is broadcast are bins of one batch: at most BATCH x prebins rows.
BATCH = 200


@dataclass
class Totals:
    events: float
    non_events: float
    valid: int
    classes: int
    rows: int


def totals(df: DataFrame) -> Totals:
    """Weighted events and non-events of all rows with a known target; the table's rows."""
    y, w = F.col("__y"), F.col("__w")
    r = df.agg(F.coalesce(F.sum(y * w), F.lit(0.0)).alias("e"), F.coalesce(F.sum((1 - y) * w), F.lit(0.0)).alias("n"), F.count(y).alias("valid"), F.countDistinct(y).alias("classes"), F.count(F.lit(1)).alias("rows")).first()
    return Totals(r.e, r.n, r.valid, r.classes, r.rows)


def with_totals(df: DataFrame, t: Totals) -> DataFrame:
    return df.withColumns({"E": F.lit(float(t.events)), "N": F.lit(float(t.non_events))})


def missing_bins(hist: DataFrame, t: Totals) -> DataFrame:
    """The missing bin of each feature, if it has weight."""
    return bin_statistics(with_totals(hist.where("value is null and events + non_events > 0"), t))


def auc(groups: DataFrame) -> DataFrame:
    """(feature, auc) of rows (feature, score, events, non_events): ties count half; 0.5 if a class is absent."""
    tied = groups.withColumn("score", F.round("score", 10)).groupBy("feature", "score").agg(F.sum("events").alias("p"), F.sum("non_events").alias("q"))
    ahead = Window.partitionBy("feature").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    # the groups are a feature's bins
    run = tied.withColumn("before", F.coalesce(F.sum(F.col("p") + F.col("q")).over(ahead), F.lit(0.0)))
    u = run.groupBy("feature").agg(F.sum(F.col("p") * (F.col("before") + (F.col("p") + F.col("q")) / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    value = F.try_divide(F.col("u") - F.col("p") * F.col("p") / 2, F.col("p") * F.col("q"))
    return u.select("feature", F.when(value.isNull(), 0.5).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).alias("auc"))


def gini_of(scored: DataFrame) -> DataFrame:
    return auc(scored).select("feature", (2 * F.col("auc") - 1).alias("gini"))


def encoded(hist: DataFrame, bins: DataFrame) -> DataFrame:
    """(feature, score, events, non_events): every value under the WoE of the last bin whose lower bound it reaches.

    A value that reaches none takes the first bin's. A feature has some tens of bounds: they are broadcast.
    """
    by_bound = bins.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("lower", "bin", "woe"))).alias("b"))
    rows = hist.where("value is not null").join(F.broadcast(by_bound), "feature")
    fit = F.filter("b", lambda x: x["lower"] <= F.col("value"))
    score = F.coalesce(F.try_element_at(fit, F.lit(-1))["woe"], F.col("b")[0]["woe"])
    return rows.select("feature", score.alias("score"), "events", "non_events").groupBy("feature", "score").agg(F.sum("events").alias("events"), F.sum("non_events").alias("non_events"))


def summed(bins: DataFrame, missing: DataFrame) -> DataFrame:
    """(feature, iv): bins and missing bin."""
    return bins.select("feature", "iv").union(missing.select("feature", "iv")).groupBy("feature").agg(F.sum("iv").alias("iv"))


NUMERIC_BINS = ["feature", "bin", "lower", "upper", "events", "non_events", "woe", "iv", "count", "population_pct", "event_rate"]


def numeric_features(df: DataFrame, features: list[str], c: ReduceConfig, t: Totals, ties: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features: feature, iv, gini), bins and missing bins of numeric features, all held by the driver."""
    with kept(histogram(df, features, "double")) as (hist,):
        enough = F.broadcast(small(hist.where("value is not null").groupBy("feature").agg(F.sum("rows").alias("rows")).where(F.col("rows") >= LEAST_VALUES).select("feature")))
        known = hist.where("value is not null").join(enough, "feature")
        if c.strategy == "cart":
            pre = cart_prebins(known, c.prebins, min_rows(t.rows, c.cart_min_bin_pct))
        else:
            keep = [x for x in ties if x not in features] if ties else []
            pre = quantile_prebins(known, long_form(df, features, "double", *keep).join(enough, "feature"), c.prebins, keep)
        bins = small(bin_statistics(with_totals(merged(pre, c.num_bins, t.events, t.non_events, c.solver if c.use_solver else None), t)).select(NUMERIC_BINS))
        missing = small(missing_bins(hist, t))
        groups = encoded(hist, bins).unionByName(missing.join(enough, "feature").select("feature", F.col("woe").alias("score"), "events", "non_events"))
        every = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
        out = every.join(summed(bins, missing), "feature", "left").join(gini_of(groups), "feature", "left")
        return small(out.select("feature", F.coalesce("iv", F.lit(0.0)).alias("iv"), F.coalesce("gini", F.lit(0.0)).alias("gini"))), bins, missing


def folded(hist: DataFrame, least: int) -> DataFrame:
    """(feature, category, is_other, events, non_events, rows): categories of fewer rows become one, left out if it has no weight."""
    rare = F.col("rows") < least
    df = hist.where("value is not null").withColumn("is_other", rare).withColumn("category", F.when(rare, F.lit("OTHER")).otherwise(F.col("value")))
    out = df.groupBy("feature", "category", "is_other").agg(F.sum("events").alias("events"), F.sum("non_events").alias("non_events"), F.sum("rows").alias("rows"))
    return out.where("not is_other or events + non_events > 0")


def categorical_bins(hist: DataFrame, c: ReduceConfig, t: Totals) -> DataFrame:
    """(feature, bin, categories, events, non_events): one a category, or CART groups of neighbours by event rate, then OTHER."""
    cats = folded(hist, c.min_category_samples)
    if c.strategy != "cart":
        return cats.select("feature", "category", "is_other", F.array("category").alias("categories"), "events", "non_events")
    rate = F.coalesce(F.try_divide(F.col("events"), F.col("events") + F.col("non_events")), F.lit(0.0))
    # rank, from 1 by (event rate, name)
    with with_running(cats.where("not is_other").withColumns({"rate": rate, "one": F.lit(1)}), ["rate", "category"], ["one"]) as running:
        own = running.withColumnRenamed("run_one", "rank")
        # pseudo-rows: one for each class present
        pseudo = (F.col("events") > 0).cast("int") + (F.col("non_events") > 0).cast("int")
        nodes = cart_nodes(own.select("feature", F.col("rank").cast("double").alias("value"), "events", "non_events", pseudo.alias("rows")), c.num_bins, 1)
        ranges = own.sparkSession.createDataFrame([(x.feature, x.low, x.high) for x in nodes], "feature string, low double, high double")
        inside = own.join(F.broadcast(ranges), "feature").where((F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high")))
        names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "category"))), lambda x: x["category"])
        groups = small(inside.groupBy("feature", "low").agg(names.alias("categories"), F.sum("events").alias("events"), F.sum("non_events").alias("non_events")).where("events + non_events > 0"))
    other = cats.where("is_other").select("feature", F.lit(True).alias("is_other"), F.array("category").alias("categories"), "events", "non_events")
    return groups.select("feature", F.lit(False).alias("is_other"), "categories", "events", "non_events").unionByName(other).withColumn("category", F.array_join("categories", ","))


CATEGORY_BINS = ["feature", "category", "categories", "is_other", "events", "non_events", "woe", "iv", "count", "population_pct", "event_rate"]


def categorical_features(df: DataFrame, features: list[str], c: ReduceConfig, t: Totals) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As numeric_features, for text; the bins of a feature are as many as its frequent categories."""
    with kept(histogram(df, features, "string")) as (hist,):
        bins = small(bin_statistics(with_totals(categorical_bins(hist, c, t), t)).select(CATEGORY_BINS))
        missing = small(missing_bins(hist, t))
    groups = bins.select("feature", F.col("woe").alias("score"), "events", "non_events").union(missing.select("feature", F.col("woe").alias("score"), "events", "non_events"))
    out = summed(bins, missing).join(gini_of(groups), "feature", "left")
    return out.select("feature", "iv", F.coalesce("gini", F.lit(0.0)).alias("gini")), bins, missing


@dataclass
class IvResult:
    """features: feature, feature_type, iv, gini; bins in long form by kind."""

    features: DataFrame
    numeric: DataFrame | None
    categorical: DataFrame | None
    missing: DataFrame | None
    skipped: list[str]


def _all(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def analyze_features(df: DataFrame, c: ReduceConfig, *, ties: list[str] | None = None) -> IvResult:
    """df has __y and __w. ties: columns that order rows of equal value for quantile bins.

    Without both classes, or with too few rows of known target, numeric and text features
    are skipped with a warning: they have no result and aren't dropped.
    """
    leave, t = (c.target, c.weight, "__y", "__w"), totals(df)
    numeric, text = numeric_columns(df, leave), text_columns(df, leave)
    skipped: list[str] = []
    if other := left_out(df, leave):
        warnings.warn(f"neither numeric nor text, so not analysed: {', '.join(other)}", stacklevel=2)
    if t.classes < 2 or t.valid < LEAST_ROWS:
        skipped += numeric
        numeric = []
    if t.classes < 2 or t.valid < 1:
        skipped += text
        text = []
    if skipped:
        warnings.warn(f"skipped, as the target has {t.valid} known values of {t.classes} classes: {', '.join(skipped)}", stacklevel=2)
    parts = {"Numeric": [], "Categorical": []}
    bins: dict[str, list] = {"Numeric": [], "Categorical": []}
    missing = []
    for kind, names in (("Numeric", numeric), ("Categorical", text)):
        for k in range(0, len(names), BATCH):
            some = names[k : k + BATCH]
            got = numeric_features(df, some, c, t, ties or []) if kind == "Numeric" else categorical_features(df, some, c, t)
            parts[kind].append(got[0].withColumn("feature_type", F.lit(kind)))
            bins[kind].append(got[1])
            missing.append(got[2])
    found = _all([*parts["Numeric"], *parts["Categorical"]])
    if found is None:
        found = df.sparkSession.createDataFrame([], "feature string, iv double, gini double, feature_type string")
    return IvResult(found.select("feature", "feature_type", "iv", "gini").orderBy(F.desc("iv"), "feature"), _all(bins["Numeric"]), _all(bins["Categorical"]), _all(missing), skipped)


def low_gini(features: DataFrame, threshold: float) -> DataFrame:
    return features.where(F.abs("gini") < threshold)


__all__ = ["analyze_features", "auc", "gini_of", "iv", "low_gini", "woe"]
