"""Stage 3: Pearson, Cramér's V and the correlation ratio over all pairs; which of a pair goes.

Each measure takes one scan for up to ``BLOCK`` columns (or ``CELLS`` cells): Arrow batches are summed
up as matrices inside the tasks, and only the sums are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.woe import numeric_columns, quoted, text_columns
from ..session import workers_import

EPSILON = 2.220446049250313e-16
MOST_CATEGORIES = 100
#: Columns whose pairs are summed in one scan: six numbers a pair, in each task.
BLOCK = 400
#: Cells of contingency tables, or sums by category, that a task holds in one scan.
CELLS = 2_000_000
SCHEMA = "feature1 string, feature2 string, correlation double, measure string"
SUMS = ("n", "x", "y", "xx", "yy", "xy")


def weighted_numbers(df: DataFrame, names: list[str], w: Column, *more: Column) -> DataFrame:
    """(w, x: the columns as doubles, *more) of the rows with a positive weight."""
    workers_import(df.sparkSession)
    return df.select(w.cast("double").alias("w"), F.array(*[quoted(c).cast("double") for c in names]).alias("x"), *more).where("w > 0")


def numbers_of(b: pa.RecordBatch, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, values (rows, c) with 0 for nulls, and which values are known."""
    flat = b.column(1).flatten()
    known = ~np.asarray(flat.is_null().to_numpy(zero_copy_only=False)).reshape(-1, c)
    return b.column(0).to_numpy(zero_copy_only=False), flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, c), known


def pair_sums(df: DataFrame, names: list[str], w: Column, first: range, second: range) -> Iterator[tuple[int, np.ndarray]]:
    """For each column i of ``first``, (i, (6, columns)): the sums SUMS over rows where i and the other column are known.

    x is i, y the other one, both less a shift near their means, so large values don't cancel.
    A task shifts by the means of its first batch; sums of different tasks are brought to one shift.
    """
    at = sorted({*first, *second})
    c, left, right = len(at), [at.index(i) for i in first], [at.index(j) for j in second]

    def task(batches):
        total, shift, strange = np.zeros((6, len(left), len(right))), None, np.zeros((len(left), len(right)))
        for b in batches:
            if not b.num_rows:
                continue
            weight, x, known = numbers_of(b, c)
            odd = ~np.isfinite(x)
            x = np.where(odd, 0.0, x)
            if shift is None:
                n = known.sum(axis=0)
                shift = np.where(n > 0, x.sum(axis=0) / np.maximum(n, 1), 0.0)
            x = np.where(known, x - shift, 0.0)
            m, wx = known * weight[:, None], x * weight[:, None]
            ma, mb, xa, xb = known[:, left].astype(float), known[:, right].astype(float), x[:, left], x[:, right]
            total += np.stack((m[:, left].T @ mb, wx[:, left].T @ mb, ma.T @ wx[:, right], (xa * wx[:, left]).T @ mb, ma.T @ (xb * wx[:, right]), xa.T @ wx[:, right]))
            if odd.any():
                strange += odd[:, left].T.astype(float) @ mb + ma.T @ odd[:, right].astype(float)
        if shift is not None:
            total[5][strange > 0] = np.nan
            rows = [np.concatenate((total[:, k].ravel(), [shift[left[k]]], shift[right])) for k in range(len(left))]
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["i", "s"])

    def merge(key, tables):
        n, base, out = len(right), None, None
        for s in tables["s"]:
            s = np.asarray(s)
            own, shift = s[: 6 * n].reshape(6, n), s[6 * n :]
            base = shift if base is None else base
            d, e = shift[0] - base[0], shift[1:] - base[1:]
            k, x, y, xx, yy, xy = own
            own = np.stack((k, x + d * k, y + e * k, xx + 2 * d * x + d * d * k, yy + 2 * e * y + e * e * k, xy + d * y + e * x + d * e * k))
            out = own if out is None else out + own
        import pandas as pd

        return pd.DataFrame({"i": [key[0]], "s": [out.ravel()]})

    sums = weighted_numbers(df, [names[k] for k in at], w).mapInArrow(task, "i int, s array<double>")
    for r in sums.groupBy("i").applyInPandas(merge, "i int, s array<double>").toLocalIterator():
        yield r.i, np.array(r.s, float).reshape(6, -1)  # a NaN comes back as a null


def pearson_pairs(df: DataFrame, names: list[str], w: Column | None = None) -> list[tuple]:
    """(feature1, feature2, r) of all pairs that have one: rows where both are known and the weight is positive.

    Up to BLOCK columns take one scan; more take one for each two blocks.
    """
    w, found = F.lit(1.0) if w is None else w, []
    blocks = [range(k, min(len(names), k + BLOCK)) for k in range(0, len(names), BLOCK)]
    for p, first in enumerate(blocks):
        for second in blocks[p:]:
            if len(names) < 2:
                continue
            for i, (total, x, y, xx, yy, xy) in pair_sums(df, names, w, first, second):
                for k, j in enumerate(second):
                    if j <= i or not total[k]:
                        continue
                    mx, my = x[k] / total[k], y[k] / total[k]
                    sx, sy = (max(v, 0.0) ** 0.5 for v in (xx[k] / total[k] - mx * mx, yy[k] / total[k] - my * my))
                    if xy[k] != xy[k]:
                        found.append((i, j, float("nan")))
                    elif sx >= EPSILON and sy >= EPSILON:
                        found.append((i, j, float(max(-1.0, min(1.0, (xy[k] / total[k] - mx * my) / (sx * sy))))))
    return [(names[i], names[j], r) for i, j, r in sorted(found, key=lambda x: x[:2])]


def correlation_matrix(df: DataFrame, names: list[str], w: Column | None = None) -> np.ndarray:
    """The matrix of pearson_pairs: 1 on the diagonal, NaN where a pair has no correlation."""
    out, at = np.full((len(names), len(names)), np.nan), {c: i for i, c in enumerate(names)}
    np.fill_diagonal(out, 1.0)
    for a, b, r in pearson_pairs(df, names, w):
        out[at[a], at[b]] = out[at[b], at[a]] = r
    return out


def matrix_pairs(matrix: np.ndarray, names: list[str], threshold: float) -> list[tuple[str, str, float]]:
    """The pairs of a correlation matrix beyond a threshold, strongest first."""
    i, j = np.triu_indices(len(names), 1)
    on = np.abs(matrix[i, j]) > threshold
    return sorted(((names[a], names[b], float(matrix[a, b])) for a, b in zip(i[on].tolist(), j[on].tolist(), strict=True)), key=lambda p: -abs(p[2]))


def shifts(df: DataFrame, names: list[str]) -> dict[str, float]:
    """Each column's mean, by which sums are shifted so that large values don't cancel."""
    if not names:
        return {}
    r = df.agg(*[F.avg(F.when(~F.isnan(quoted(c).cast("double")), quoted(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(names)]).first()
    return {c: (r[i] if r[i] is not None and abs(r[i]) < float("inf") else 0.0) for i, c in enumerate(names)}


def categories(df: DataFrame, names: list[str]) -> dict[str, list[str] | None]:
    """The distinct known values of each column, sorted; None if there are more than MOST_CATEGORIES."""
    if not names:
        return {}
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), quoted(c).alias("v")) for i, c in enumerate(names)]))
    each = df.select(values.alias("x")).select("x.c", "x.v").where("v is not null").distinct()
    few = each.groupBy("c").count().where(F.col("count") <= MOST_CATEGORIES).select("c")
    out: dict[str, list[str] | None] = dict.fromkeys(names)
    for c, vs in few.join(each, "c").groupBy("c").agg(F.sort_array(F.collect_list("v")).alias("vs")).collect():
        out[names[c]] = vs
    for c in {names[r[0]] for r in each.select("c").distinct().collect()} ^ set(names):
        out[c] = []
    return out


def distinct_counts(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Distinct known values of each column alone, those of columns with more than MOST_CATEGORIES as one more than that."""
    return {c: MOST_CATEGORIES + 1 if v is None else len(v) for c, v in categories(df, names).items()}


def codes_of(column: pa.Array, values: list[str]) -> np.ndarray:
    """Places in ``values``; nulls are -1."""
    import pyarrow.compute as pc

    return pc.index_in(column, value_set=pa.array(values, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)


def batches_of(items: list, size) -> Iterator[list]:
    """Items in lists whose sizes sum up to CELLS (or of one)."""
    held, total = [], 0
    for x in items:
        if held and total + size(x) > CELLS:
            yield held
            held, total = [], 0
        held.append(x)
        total += size(x)
    if held:
        yield held


def union_of(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cramers_v_pairs(df: DataFrame, names: list[str], w: Column | None = None, known: dict[str, list[str] | None] | None = None) -> DataFrame:
    """(feature1, feature2, v): bias-corrected V of all pairs with weight.

    Tasks count the cells of all pairs of a scan as one array; what is shuffled are the cells that occur.
    """
    w, known = F.lit(1.0) if w is None else w, categories(df, names) if known is None else known
    names = [c for c in names if known[c] is not None]
    spark, out = df.sparkSession, []
    workers_import(spark)
    for some in batches_of(list(combinations(names, 2)), lambda p: max(1, len(known[p[0]]) * len(known[p[1]]))):
        used = sorted({c for p in some for c in p}, key=names.index)

        def task(batches, some=some, used=used):
            sizes = [(len(known[a]), len(known[b])) for a, b in some]
            starts = np.cumsum([0, *(r * c for r, c in sizes)])
            total = np.zeros(starts[-1])
            for batch in batches:
                weight = batch.column(0).to_numpy(zero_copy_only=False)
                code = {c: codes_of(batch.column(k + 1), known[c]) for k, c in enumerate(used)}
                for (a, b), (r, c), at in zip(some, sizes, starts, strict=False):
                    on = (code[a] >= 0) & (code[b] >= 0)
                    total[at : at + r * c] += np.bincount(code[a][on] * c + code[b][on], weight[on], minlength=r * c)
            hit = np.flatnonzero(total)
            pair = np.searchsorted(starts, hit, side="right") - 1
            cols = np.array([c for _, c in sizes])[pair]
            cell = hit - starts[pair]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(cell // cols, pa.int32()), pa.array(cell % cols, pa.int32()), pa.array(total[hit])], names=["i", "a", "b", "o"])

        cells = df.select(w.cast("double").alias("w"), *[quoted(c).alias(f"c{k}") for k, c in enumerate(used)]).where("w > 0").mapInArrow(task, "i int, a int, b int, o double").groupBy("i", "a", "b").agg(F.sum("o").alias("o"))
        part = lambda *c: cells.groupBy(*c).agg(F.sum("o").alias("s"))
        # at most MOST_CATEGORIES^2 cells a pair
        sums = cells.join(part("i", "a").withColumnRenamed("s", "ra"), ["i", "a"]).join(part("i", "b").withColumnRenamed("s", "cb"), ["i", "b"]).groupBy("i").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("s"))
        sizes = spark.createDataFrame([(i, a, b, float(len(known[a])), float(len(known[b]))) for i, (a, b) in enumerate(some)], "i int, feature1 string, feature2 string, r double, c double")
        r, c, n = F.col("r"), F.col("c"), F.col("n")
        chi = F.greatest(n * (F.col("s") - 1), F.lit(0.0))
        phi = F.greatest(F.lit(0.0), chi / n - (r - 1) * (c - 1) / (n - 1))
        less = F.least(r - (r - 1) * (r - 1) / (n - 1) - 1, c - (c - 1) * (c - 1) / (n - 1) - 1)
        v = F.when((r < 2) | (c < 2) | (n <= 1), 0.0).otherwise(F.when(less <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(phi / less))))
        out.append(sums.join(F.broadcast(sizes), "i").select("feature1", "feature2", v.alias("v")))
    return union_of(out, spark, "feature1 string, feature2 string, v double")


def eta_pairs(df: DataFrame, texts: list[str], numbers: list[str], w: Column | None = None, known: dict[str, list[str] | None] | None = None) -> DataFrame:
    """(feature1 (text), feature2 (number), eta) of all pairs with weight, texts of at most MOST_CATEGORIES values."""
    w, known = F.lit(1.0) if w is None else w, categories(df, texts) if known is None else known
    texts = [c for c in texts if known[c] is not None]
    spark, mean, out = df.sparkSession, shifts(df, numbers), []
    for some in batches_of(texts if numbers else [], lambda c: 3 * len(numbers) * max(1, len(known[c]))):

        def task(batches, some=some):
            m = len(numbers)
            total = [np.zeros((3, len(known[c]), m)) for c in some]
            shift = np.array([mean[c] for c in numbers])
            for batch in batches:
                weight, x, there = numbers_of(batch, m)
                x = np.where(there, x - shift, 0.0)
                wm = there * weight[:, None]
                for k, c in enumerate(some):
                    code = codes_of(batch.column(k + 2), known[c])
                    one = (code[:, None] == np.arange(len(known[c]))).astype(float)
                    total[k] += np.stack((one.T @ wm, one.T @ (wm * x), one.T @ (wm * x * x)))
            for k, t in enumerate(total):
                g, j = np.nonzero(t[0])
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k), pa.int32()), pa.array(g, pa.int32()), pa.array(j, pa.int32()), *(pa.array(t[s][g, j]) for s in range(3))], names=["t", "g", "j", "w", "x", "q"])

        groups = weighted_numbers(df, numbers, w, *[quoted(c).alias(f"c{k}") for k, c in enumerate(some)]).mapInArrow(task, "t int, g int, j int, w double, x double, q double").groupBy("t", "g", "j").agg(*[F.sum(c).alias(c) for c in "wxq"])
        tot = groups.groupBy("t", "j").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("W"), F.sum("x").alias("X"), F.sum("q").alias("Q"), F.sum(F.col("x") * F.col("x") / F.col("w")).alias("B"))
        base = F.col("X") * F.col("X") / F.col("W")
        between, whole = F.greatest(F.col("B") - base, F.lit(0.0)), F.col("Q") - base
        eta = F.when((F.col("k") < 2) | (whole <= EPSILON), 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(F.try_divide(between, whole))))
        named = lambda of, k: F.array(*[F.lit(c) for c in of])[F.col(k)]
        out.append(tot.select(named(some, "t").alias("feature1"), named(numbers, "j").alias("feature2"), eta.alias("eta")))
    return union_of(out, spark, "feature1 string, feature2 string, eta double")


@dataclass(frozen=True)
class Pair:
    feature1: str
    feature2: str
    correlation: float
    measure: str


@dataclass(frozen=True)
class Metadata:
    iv: float | None = None
    missing_ratio: float | None = None


def associated_pairs(df: DataFrame, threshold: float, w: Column | None = None, leave: tuple[str | None, ...] = (), categorical: list[str] | None = None) -> list[Pair]:
    """All pairs beyond the threshold, strongest first: number-number, then text-text, then text-number on ties.

    The result is at most the number of pairs of columns; the target takes part.
    """
    numbers = numeric_columns(df, ("__y", "__w", *leave))
    texts = [c for c in text_columns(df, leave) if categorical is None or c in categorical]
    known = categories(df, texts)
    texts = [c for c in texts if known[c] is not None]
    found = [Pair(a, b, r, "Pearson") for a, b, r in pearson_pairs(df, numbers, w)]
    place = {c: i for i, c in enumerate(df.columns)}
    order = lambda x: (place[x.feature1], place[x.feature2])
    if len(texts) > 1:
        found += sorted((Pair(r.feature1, r.feature2, r.v, "CramersV") for r in cramers_v_pairs(df, texts, w, known).collect()), key=order)
    if texts and numbers:
        found += sorted((Pair(r.feature1, r.feature2, r.eta, "Eta") for r in eta_pairs(df, texts, numbers, w, known).collect()), key=order)
    return sorted((p for p in found if abs(p.correlation) > threshold), key=lambda p: -abs(p.correlation))


def loser(pair: Pair, target: str, frequency: Counter, known: dict[str, Metadata]) -> tuple[str, str]:
    """Which feature of a pair is dropped, and why: the first rule that tells them apart decides."""
    a, b = pair.feature1, pair.feature2
    tie = f"({pair.measure} {pair.correlation:.4f})"
    if target in (a, b):
        return (b if a == target else a), f"Correlated with target {tie}; dropped to protect target"
    m, n = known.get(a, Metadata()), known.get(b, Metadata())

    def told(gone: str, other: str, why: str) -> tuple[str, str]:
        return gone, f"Correlated with {other} {tie}; {why}"

    def by(x: float | int | None, y: float | int | None, name: str, spec: str, low_goes: bool):
        if x is None or y is None or abs(x - y) <= EPSILON:
            return None
        first = (x < y) == low_goes
        gone, other = (a, b) if first else (b, a)
        u, v = (x, y) if first else (y, x)
        return told(gone, other, f"{name} ({u:{spec}} vs {v:{spec}})")

    return (
        by(m.iv, n.iv, "lower IV", ".4f", True)
        or by(frequency[a], frequency[b], "higher frequency", "d", False)
        or by(m.missing_ratio, n.missing_ratio, "higher missing ratio", ".4f", False)
        or told(max(a, b), min(a, b), "alphabetical tie-break")
    )


def features_to_drop(pairs: list[Pair], target: str, known: dict[str, Metadata] | None = None) -> list[tuple[str, str]]:
    """(feature, reason), taking pairs strongest first; a pair with a dropped member is settled."""
    frequency = Counter(f for p in pairs for f in (p.feature1, p.feature2))
    out: dict[str, str] = {}
    for p in pairs:
        if p.feature1 in out or p.feature2 in out:
            continue
        gone, why = loser(p, target, frequency, known or {})
        out[gone] = why
    return list(out.items())
