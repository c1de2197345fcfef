"""Target and weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.woe import NUMERIC, label, quoted


@dataclass(frozen=True)
class TargetAnalysis:
    """labels: all of them, for a choice of event and non-event."""

    already_binary: bool
    labels: list[str]


def labels(df: DataFrame, target: str) -> DataFrame:
    """The distinct labels of a target, sorted."""
    return df.select(label(df, target).alias("label")).where("label is not null").distinct().orderBy("label")


def analyze_target(df: DataFrame, target: str) -> TargetAnalysis:
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in dataset")
    c = quoted(target)
    numeric = isinstance(df.schema[target].dataType, NUMERIC)
    binary = ((F.abs(c.cast("double")) <= 1e-9) | (F.abs(c.cast("double") - 1) <= 1e-9)) if numeric else F.lit(False)
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.count(c).alias("known"), F.coalesce(F.bool_and(F.when(c.isNotNull(), binary)), F.lit(False)).alias("binary")).first()
    if not r.rows:
        raise ValueError(f"Target column '{target}' is empty")
    if not r.known:
        raise ValueError(f"Target column '{target}' contains only null values")
    if r.binary and df.select(target).where(c.isNotNull()).distinct().limit(3).count() <= 2:
        return TargetAnalysis(True, [])
    return TargetAnalysis(False, [x.label for x in labels(df, target).collect()])


def target_mask(df: DataFrame, target: str, event: str | None = None, non_event: str | None = None) -> Column:
    """1 for the event, 0 for the non-event, null for all else. Without a mapping, the truncated 0/1 value."""
    if event is None:
        v = quoted(target).cast("double")
        y = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2**31), v).cast("int")
        return F.when(y.isin(0, 1), y)
    text = label(df, target)
    return F.when(text == event, 1).when(text == non_event, 0)


def mapped_counts(df: DataFrame, target: str, event: str, non_event: str) -> DataFrame:
    """One row: events, non_events, ignored (nulls included)."""
    y = target_mask(df, target, event, non_event)
    return df.agg(F.count_if(y == 1).alias("events"), F.count_if(y == 0).alias("non_events"), F.count_if(y.isNull()).alias("ignored"))


def validate_binary(df: DataFrame, target: str) -> None:
    if not analyze_target(df, target).already_binary:
        raise ValueError(f"Target column '{target}' must be binary (0/1), or a mapping of its labels is needed")
    if df.where(quoted(target).isNotNull()).select(target).distinct().count() < 2:
        raise ValueError(f"Target column '{target}' has one class only")


def weight_of(df: DataFrame, weight: str | None, *, checked: bool = True) -> Column:
    """The weight of a row: 1 without a weight column or where it is null. NaN, infinite and negative ones are errors."""
    if weight is None:
        return F.lit(1.0)
    if weight not in df.columns:
        raise ValueError(f"Weight column '{weight}' not found in dataset")
    if not isinstance(df.schema[weight].dataType, NUMERIC):
        raise ValueError(f"Weight column '{weight}' must be numeric")
    w = quoted(weight).cast("double")
    if checked:
        r = df.agg(F.count_if(F.isnan(w)).alias("nan"), F.count_if(F.abs(w) == float("inf")).alias("inf"), F.count_if(w < 0).alias("negative")).first()
        for what, n in (("NaN", r.nan), ("infinite", r.inf), ("negative", r.negative)):
            if n:
                raise ValueError(f"Weight column '{weight}' contains {what} values ({n})")
    return F.coalesce(w, F.lit(1.0))


def prepared(df: DataFrame, target: str, event: str | None, non_event: str | None, weight: str | None) -> DataFrame:
    """df with __y (1, 0 or null) and __w."""
    return df.withColumns({"__y": target_mask(df, target, event, non_event), "__w": weight_of(df, weight)})
