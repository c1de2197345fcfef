"""Column expressions: weight of evidence, impurity, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMOOTHING = 0.5
#: Types that are analysed as numbers; decimals are cast to double.
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def quoted(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def share(part, total) -> Column:
    return (part + SMOOTHING) / (total + SMOOTHING)


def woe(events: Column, non_events: Column, all_events: Column, all_non_events: Column) -> Column:
    """ln of the share of events over the share of non-events: positive means riskier."""
    return F.ln(share(events, all_events) / share(non_events, all_non_events))


def iv(events: Column, non_events: Column, all_events: Column, all_non_events: Column) -> Column:
    return (share(events, all_events) - share(non_events, all_non_events)) * woe(events, non_events, all_events, all_non_events)


def gini_impurity(events: Column, non_events: Column) -> Column:
    total = events + non_events
    p = F.try_divide(events, total)
    return F.when(total <= 0, 0.0).otherwise(2 * p * (1 - p))


def bin_statistics(df: DataFrame, totals: Column | None = None) -> DataFrame:
    """Adds woe, iv, count, population_pct and event_rate to rows with events, non_events, E and N."""
    e, n, big_e, big_n = (F.col(c) for c in ("events", "non_events", "E", "N"))
    count = e + n
    return df.withColumns({
        "woe": woe(e, n, big_e, big_n),
        "iv": iv(e, n, big_e, big_n),
        "count": count,
        "population_pct": F.coalesce(F.try_divide(count * 100, big_e + big_n), F.lit(0.0)),
        "event_rate": F.coalesce(F.try_divide(e, count), F.lit(0.0)),
    })


def label(df: DataFrame, name: str) -> Column:
    """A value as the text that targets and strata are compared by: whole floats lose their point."""
    kind, c = df.schema[name].dataType, quoted(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, F.when(whole, c).cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def numeric_columns(df: DataFrame, leave: tuple[str | None, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in leave]


def text_columns(df: DataFrame, leave: tuple[str | None, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in leave]


def left_out(df: DataFrame, leave: tuple[str | None, ...] = ()) -> list[str]:
    """Columns of other types, like booleans, dates and arrays."""
    return [f.name for f in df.schema if not isinstance(f.dataType, (*NUMERIC, T.StringType)) and f.name not in leave]
