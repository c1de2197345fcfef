"""Samples of exact size with inverse-probability weights.

Rows are chosen by a hash of all their columns and the seed, so a sample can be repeated
whatever the layout of the table. A stratum's sample are the rows of least hash. Nothing is
sorted: the hash of its last row is found in three scans that count rows by leading bits.
Equal rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.woe import label, quoted

WEIGHT = "sampling_weight"
#: Low bits of the hash that a scan leaves out; at most 2^16 counts a stratum each time, but in the
#: last, which counts the hashes that are equal in 32 bits to the one sought.
SHIFTS = (48, 32, 0)


def draw(df: DataFrame, seed: int, key: list[str] | None = None) -> Column:
    return F.xxhash64(F.lit(seed), *[quoted(c) for c in (key or df.columns)])


def stratum(df: DataFrame, column: str) -> Column:
    return F.coalesce(label(df, column), F.lit("(null)"))


def strata(df: DataFrame, column: str) -> DataFrame:
    """(value, population): largest first, then by label; null is ``(null)``."""
    if column not in df.columns:
        raise ValueError(f"Column '{column}' not found in dataset")
    return df.groupBy(stratum(df, column).alias("value")).agg(F.count(F.lit(1)).alias("population")).orderBy(F.desc("population"), "value")


def sample_size(rows: int, count: int | None = None, fraction: float | None = None) -> int:
    if count is None and fraction is None:
        raise ValueError("sample_size is required for Random sampling")
    if count is not None:
        if count <= 0:
            raise ValueError("Sample size must be positive")
        return count
    if not 0 < fraction < 1:
        raise ValueError("Fraction must be between 0 and 1 (exclusive)")
    return max(1, int(fraction * rows + 0.5))


def _guard(df: DataFrame) -> None:
    if WEIGHT in df.columns:
        raise ValueError(f"Column '{WEIGHT}' already exists in dataset")


def cutoffs(keyed: DataFrame, sizes: dict[str, int]) -> list[tuple[str, int, int]]:
    """(stratum, h, m) for rows (__s, __h): its rows of hash below h and m of those with it are as many as asked for."""
    spark, found, before = keyed.sparkSession, [(s, n, None) for s, n in sizes.items()], None
    for shift in SHIFTS:
        spec = F.broadcast(spark.createDataFrame(found, "__s string, left long, prefix long"))
        rows = keyed.join(spec, "__s")
        if before is not None:
            rows = rows.where(F.shiftright("__h", before) == F.col("prefix"))
        counts = rows.groupBy("__s", "left", F.shiftright("__h", shift).alias("part")).agg(F.count(F.lit(1)).alias("n"))
        ahead = F.sum("n").over(Window.partitionBy("__s").orderBy("part")) - F.col("n")
        hit = counts.withColumn("ahead", ahead).where((F.col("ahead") < F.col("left")) & (F.col("ahead") + F.col("n") >= F.col("left")))
        found, before = [(r["__s"], r.left - r.ahead, r.part) for r in hit.collect()], shift
    return [(s, h, m) for s, m, h in found]


def least_rows(df: DataFrame, strata_of: Column, sizes: dict[str, int], weights: dict[str, float], seed: int, key: list[str] | None) -> DataFrame:
    """The rows of least hash of each stratum, as many as asked for, and their weight."""
    keyed = df.withColumns({"__s": strata_of, "__h": draw(df, seed, key)})
    cut = [(s, h, m, weights[s]) for s, h, m in cutoffs(keyed.select("__s", "__h"), sizes)]
    spec = F.broadcast(df.sparkSession.createDataFrame(cut, f"__s string, __cut long, __m long, {WEIGHT} double"))
    rows = keyed.join(spec, "__s").where("__h <= __cut")
    columns = [*[quoted(c) for c in df.columns], F.col(WEIGHT)]
    last = rows.where("__h = __cut")
    if key is None:  # equal rows: one stands for all of them
        last = last.dropDuplicates(["__s"]).withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m"))))
    else:
        last = last.withColumn("__k", F.row_number().over(Window.partitionBy("__s").orderBy("__h"))).where("__k <= __m")
    return rows.where("__h < __cut").select(*columns).union(last.select(*columns))


def random_sample(df: DataFrame, count: int | None = None, fraction: float | None = None, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Exactly n rows without replacement, each of weight N / n."""
    _guard(df)
    rows = df.count()
    n = sample_size(rows, count, fraction)
    if n > rows:
        raise ValueError(f"Sample size {n} exceeds population {rows}")
    return least_rows(df, F.lit(""), {"": n}, {"": rows / n}, seed, key)


def stratified_sample(df: DataFrame, column: str, sizes: dict[str, int], seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """n rows of each listed stratum, each of weight N_h / n_h by the population found; other strata are left out."""
    _guard(df)
    found = {r.value: r.population for r in strata(df, column).where(F.col("value").isin(list(sizes))).collect()}
    wanted = {}
    for value, n in sizes.items():
        if n > found.get(value, 0) > 0:
            raise ValueError(f"Sample size {n} for stratum '{value}' exceeds population {found[value]}")
        if found.get(value) and n > 0:
            wanted[value] = n
    if not wanted:
        raise ValueError("Stratified sampling produced no rows: all strata are empty")
    return least_rows(df, stratum(df, column), wanted, {v: found[v] / n for v, n in wanted.items()}, seed, key)


def equal_allocation_sample(df: DataFrame, column: str, count: int | None = None, fraction: float | None = None, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """n rows of every stratum."""
    _guard(df)
    if fraction is not None:
        raise ValueError("Fraction is not applicable to EqualAllocation sampling; use Count instead")
    if count is None:
        raise ValueError("sample_size is required for EqualAllocation sampling")
    if count <= 0:
        raise ValueError("Sample size must be positive")
    found = strata(df, column).collect()
    for r in found:
        if r.population < count:
            raise ValueError(f"Sample size {count} for stratum '{r.value}' exceeds population {r.population}")
    return stratified_sample(df, column, {r.value: count for r in found}, seed, key)


def parsed_sizes(text: str) -> dict[str, int]:
    """``v1:100,v2:200``, each split at its first colon."""
    out = {}
    for part in filter(None, text.split(",")):
        value, colon, n = part.partition(":")
        if not colon or not n.strip().isdigit():
            raise ValueError(f"Invalid stratum spec '{part}'; expected value:count")
        out[value.strip()] = int(n)
    return out
