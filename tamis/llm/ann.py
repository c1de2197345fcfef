"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Unit vectors are projected on ``DIMS`` Gaussian directions. For two vectors at distance
d, the squared distance of their projections over d*d follows a chi-square law of DIMS
degrees. A query takes the leaves of a kd-tree of projections from near to far, verifies
their vectors by their cosines, and leaves out what lies so far that a true neighbour,
nearer than its k-th best, would have been met already with probability ``STOP``.

A top kd-tree, fitted to at most ``SAMPLE`` projections, deals all vectors out to blocks;
each block has a kd-tree of its own leaves. A query searches its own block first; its
k-th distance there then says, by the same test, which other blocks it has to visit.
Queries that visit a leaf are verified together, by one matrix product that picks
candidates; the scores of candidates are then summed in double precision, one by one.
What can be left out depends on the vectors: with clusters most leaves, among evenly
spread ones, whose neighbours are hardly nearer than the rest, none. ``verified`` tells.

Equal vectors are collapsed to the k + 1 of least id, which loses no answer as ties go to
smaller ids. Blocks with more than ``BLOCK_MAX`` vectors are split by id, and large query
sets of a block into parts, so no group is unbounded.

Vectors null, zero or with null or non-finite components take no part, nor do rows with
null id or of another length than most (the shorter on ties). Of the rows of one id the one
with the least vector (compared component by component) stands, as query and as candidate.
An empty table gives an empty result; with fewer candidates than k all are returned. Only
vec_id and embedding are read, so other columns' names can't clash.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, map_arrow, prepare, stored, table

DIMS, STOP, LEAF = 8, 0.98, 256
SAMPLE, BLOCK_ROWS, BLOCK_MAX, QUERY_MAX, MAX_DEPTH = 20_000, 8_000, 40_000, 4_000, 12
SEED = 20_240
#: Ranks of a query's leaves after which its k-th distance is tested anew.
WAVES = [0, 1, 4, 16, 1 << 30]
#: What a product of matrices may differ by from a score summed in order.
MARGIN = 1e-9


def chi_square(x: np.ndarray) -> np.ndarray:
    """The chi-square distribution function of DIMS (even) degrees of freedom."""
    h = np.minimum(x / 2, 700)
    return 1 - np.exp(-h) * sum(h**j / math.factorial(j) for j in range(DIMS // 2))


@functools.cache
def directions(length: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((length, DIMS))


def enough(bound2: np.ndarray, kth2) -> np.ndarray:
    """Whether what lies beyond a squared projected distance can be left out."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isinf(kth2), False, np.where(kth2 > 0, chi_square(bound2 / np.maximum(kth2, 1e-300)) >= STOP, bound2 > 1e-12))


class Cells:
    """A kd-tree's leaves over points: boxes low..high, and each point's leaf."""

    def __init__(self, points: np.ndarray, leaf: int, depth: int = 64):
        self.low, self.high, self.members, self.splits = [], [], [], []
        n = points.shape[1]
        self._grow(points, np.arange(len(points)), np.full(n, -np.inf), np.full(n, np.inf), leaf, depth)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points, at, low, high, leaf, depth) -> int:
        own = points[at]
        spread = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(points.shape[1])
        axis = int(spread.argmax())
        if len(at) <= leaf or not depth or spread[axis] <= 0:
            self.low.append(low), self.high.append(high), self.members.append(at)
            return -len(self.low)
        cut = float(np.median(own[:, axis]))
        left = own[:, axis] <= cut
        if left.all():
            left = own[:, axis] < cut
            cut = float(own[left, axis].max())
        me = len(self.splits)
        self.splits.append(None)
        lower, upper = high.copy(), low.copy()
        lower[axis] = upper[axis] = cut
        a = self._grow(points, at[left], low, lower, leaf, depth - 1)
        b = self._grow(points, at[~left], upper, high, leaf, depth - 1)
        self.splits[me] = (axis, cut, a, b)
        return me

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        if not self.splits:
            return np.zeros(len(points), np.int64)
        out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -node - 1
                continue
            axis, cut, a, b = self.splits[node]
            left = points[at, axis] <= cut
            todo += [(a, at[left]), (b, at[~left])]
        return out

    def bounds2(self, points: np.ndarray) -> np.ndarray:
        """(points, leaves): squared distances of points from the leaves' boxes."""
        out = np.zeros((len(points), len(self.low)))
        for axis in range(points.shape[1]):
            x = points[:, axis, None]
            out += np.maximum(0, np.maximum(self.low[:, axis] - x, x - self.high[:, axis])) ** 2
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v): rows that take part, v as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    length = rows.groupBy(F.size("v").alias("m")).count().orderBy(F.desc("count"), "m").first()
    rows = rows.where(F.size("v") == (length.m if length else 0))
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if again.isEmpty():
        return rows
    return rows.join(again, "id", "left_anti").union(rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))


def units(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(axis=1, keepdims=True)
    return v / top / np.sqrt(((v / top) ** 2).sum(axis=1, keepdims=True))


def projected(rows: DataFrame, top: Cells | None) -> DataFrame:
    """Adds p, the projection, and its block."""

    def make():
        def each(b):
            v = np.stack(b.column(1).to_numpy(zero_copy_only=False))
            p = units(v) @ directions(v.shape[1])
            block = top.leaf_of(p) if top else np.zeros(len(p), np.int64)
            yield batch(["id", "v", "p", "block"], b.column(0), b.column(1), pa.array(list(p)), block)

        return each

    return map_arrow(rows, make, "id long, v array<double>, p array<double>, block long")


def best_of(k: int, query: np.ndarray, score: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Places of the k best of each query, ties to smaller ids."""
    order = np.lexsort((near, -score, query))
    q = query[order]
    first = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[rank < k]


def search_block(k: int, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The k nearest of a block for each query, the k-th squared distance, and in one row of each how many were verified."""
    if not len(asked) or not len(data):
        out = pd.DataFrame({"query_id": asked["id"] if len(asked) else [], "vec_id": -1, "score": np.nan, "kth2": np.inf, "verified": 0})
        return out.astype({"query_id": "int64", "vec_id": "int64", "score": float, "kth2": float, "verified": "int64"})
    ids, v, p = data["id"].to_numpy(), np.stack(data["v"]), np.stack(data["p"])
    qids, qv, qp = asked["id"].to_numpy(), np.stack(asked["v"]), np.stack(asked["p"])
    cells, u, qu = Cells(p, LEAF), units(v), units(qv)
    norm, qnorm = np.sqrt((v * v).sum(axis=1)), np.sqrt((qv * qv).sum(axis=1))
    bound = cells.bounds2(qp)
    rank = bound.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    kth = np.full(len(qids), -np.inf)
    verified = np.zeros(len(qids), np.int64)
    found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)  # query, score, place in data
    for first, behind in zip(WAVES, WAVES[1:]):
        if first >= len(cells.members):
            break
        new = [found]
        kth2 = np.where(np.isinf(kth), np.inf, np.maximum(0.0, 2 - 2 * kth))
        kth2[kth2 < 1e-12] = 0.0
        go = (rank >= first) & (rank < behind) & ~enough(bound, kth2[:, None])
        for leaf in np.flatnonzero(go.any(axis=0)):
            on, at = np.flatnonzero(go[:, leaf]), cells.members[leaf]
            near = qu[on] @ u[at].T
            near[qids[on][:, None] == ids[at]] = -np.inf
            verified[on] += len(at)
            least = np.partition(near, -k, axis=1)[:, -k] if len(at) >= k else np.full(len(on), -np.inf)
            r, c = np.nonzero((near >= np.maximum(kth[on], least)[:, None] - MARGIN) & (near > -np.inf))
            q, c = on[r], at[c]
            # summed row by row in one order, so equal vectors have equal scores
            score = (v[c] * qv[q]).sum(axis=1) / (norm[c] * qnorm[q])
            new.append((q, score, c))
            kth[on] = np.maximum(kth[on], least - MARGIN)
        found = tuple(np.concatenate(x) for x in zip(*new, strict=True))
        keep = best_of(k, found[0], found[1], ids[found[2]])
        found = tuple(x[keep] for x in found)
        full = np.bincount(found[0], minlength=len(qids)) >= k
        worst = np.full(len(qids), np.inf)
        np.minimum.at(worst, found[0], found[1])
        kth[full] = worst[full]
    kth2 = np.where(np.bincount(found[0], minlength=len(qids)) >= k, np.maximum(0.0, 2 - 2 * kth), np.inf)
    kth2[kth2 < 1e-12] = 0.0
    q, score, c = found
    out = pd.DataFrame({"query_id": qids[q], "vec_id": ids[c], "score": score, "kth2": kth2[q], "verified": 0})
    told = pd.DataFrame({"query_id": qids, "vec_id": -1, "score": np.nan, "kth2": kth2, "verified": verified})
    return pd.concat([out, told])


def searched(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Queries (with the blocks they visit) against the vectors of those blocks."""
    shards = data.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MAX).cast("int").alias("shards"))
    parts = queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_MAX).cast("int").alias("parts"))
    sizes = shards.join(parts, "block")  # at most 2^MAX_DEPTH rows
    some = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = data.join(F.broadcast(sizes), "block").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).withColumn("part", some("parts"))
    right = queries.join(F.broadcast(sizes), "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("shard", some("shards"))
    cols = ["block", "shard", "part", "id", "v", "p"]
    work = left.select(*cols).groupBy("block", "shard", "part").cogroup(right.select(*cols).groupBy("block", "shard", "part"))
    return work.applyInPandas(lambda a, b: search_block(k, a, b), "query_id long, vec_id long, score double, kth2 double, verified long")


def nearest(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of the rows where is_query (over ``id``) holds; verified counts the vectors compared with the query."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = usable(vectors)
    same = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select("id", "v")
    sample = projected(rows.orderBy(F.xxhash64("id")).limit(SAMPLE), None).select("p").toPandas()
    n = rows.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, n) / BLOCK_ROWS))))
    top = Cells(np.stack(sample["p"]), 1, depth) if len(sample) else Cells(np.zeros((0, DIMS)), 1, 0)
    data = stored(projected(kept, top), "ann-data")
    queries = stored(projected(rows.where(is_query), top), "ann-queries")
    first = stored(searched(data, queries, k), "ann-first")
    reach = first.groupBy(F.col("query_id").alias("id")).agg(F.min("kth2").alias("kth2"))

    def make():
        def each(b):
            p = np.stack(b.column(2).to_numpy(zero_copy_only=False))
            own, kth = b.column(3).to_numpy(), b.column(4).fill_null(np.inf).to_numpy(zero_copy_only=False)
            go = ~enough(top.bounds2(p), kth[:, None])
            go[np.arange(len(own)), own] = False
            asked, block = np.nonzero(go)
            yield batch(["id", "v", "p", "block"], *(b.column(j).take(pa.array(asked)) for j in range(3)), pa.array(block, pa.int64()))

        return each

    others = map_arrow(queries.join(reach, "id", "left").select("id", "v", "p", "block", "kth2"), make, "id long, v array<double>, p array<double>, block long")
    found = stored(first.union(searched(data, others, k)), "ann-found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.where("score is not null and not isnan(score)").select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    cost = found.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    return ranked.join(cost, "query_id").select("query_id", "rank", "vec_id", "score", "verified")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 50 == 0)
