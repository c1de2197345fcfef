"""Near-duplicate documents by ProbMinHash, banding and verification.

Shingles are ``WORDS`` consecutive normalised words (a shorter text is one shingle), all
of weight 1, however often they occur. Every shingle is a Poisson process of arrivals whose
rate is its weight; each arrival falls on a random register, which keeps the shingle
that came first. A shingle stops as soon as its next arrival is later than all registers
of its document. Two documents agree in a register with the probability Jaccard
similarity of their shingles, which at equal weights is the Jaccard similarity of the
sets: candidates are searched by the similarity that makes a link.

``BANDS`` bands of ``ROWS`` registers make buckets: a pair of similarity 0.8 meets with
probability 1 - (1 - 0.8^ROWS)^BANDS > 0.99999. Members of a bucket are compared with
its best connected member, then members of one bucket that are still in different
classes with each other, so a link is found without making all pairs of a group. A link
needs a Jaccard similarity of the shingle sets of ``SIMILARITY`` or more, exactly.
Classes are the connected components.

Equal texts are one node from the start. A null text, or one without words, is a class
of its own. A class is named by its least doc_id (null if it has none).

Rows that repeat a doc_id are judged one by one. An empty table gives an empty result. A very
long text is held whole by one worker, with 8 bytes a word and shingle. classes() reads doc_id
and text alone; one_of_each() keeps all columns of docs, and what it adds for its joins gets
names that docs doesn't have.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, batch, map_arrow, prepare, stored, table, unused
from .common import named as named_column
from .decontam import words
from .substring import CHUNK, WordHashes, grams, mixed, odd

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 6, 40
#: Bits of a document's sketch, each the parity of the number of its shingles that fall on it. A shingle
#: of only one of two documents turns one bit, so they have as many unlike shingles as unlike bits, at least.
SKETCH = 256
#: Comparisons with a bucket's best member; the rest is compared by class.
STAR_ROUNDS = 4
#: Buckets up to this size are compared by a join, larger ones in tiles of so many members and shingles.
SMALL, TILE, TILE_GRAMS = 24, 2_048, 2_000_000
LEAST = -(1 << 63)
BITS = ["s0", "s1", "s2", "s3"]


def shingles(ids: np.ndarray) -> np.ndarray:
    """Hashes of all shingles of a document's word hashes, in order."""
    return grams(ids, odd(3, WORDS)) if len(ids) >= WORDS else grams(ids, odd(4 + len(ids), len(ids))) if len(ids) else ids


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs, m) of documents given as (document, element, weight) without repeats."""
    first, sig = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    time, turn = np.zeros(len(doc)), 0
    while len(doc):
        turn += 1
        r = mixed(element + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log1p(-(r >> np.uint64(11)).astype(float) * 2.0**-53) / weight
        slot = doc * m + (mixed(r) % np.uint64(m)).astype(np.int64)
        latest = first.reshape(n_docs, m).max(axis=1)
        on = time < latest[doc]
        doc, element, weight, time, slot = doc[on], element[on], weight[on], time[on], slot[on]
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        sig[slot[won]] = element[won]
    return sig.reshape(n_docs, m)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS): hashes of each band's registers."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(48), parts.shape[:2]).copy()
    for j in range(ROWS):
        out = mixed(out ^ parts[:, :, j])
    return out


def sketches(doc: np.ndarray, element: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """The SKETCH parities of documents given as (document, element) without repeats, 64 in each of four integers."""
    odd_ = np.bincount(doc * SKETCH + (mixed(element) % np.uint64(SKETCH)).astype(np.int64), minlength=n_docs * SKETCH) & 1
    return list(np.packbits(odd_.astype(np.uint8)).view(np.int64).reshape(n_docs, 4).T)


def may_link(unlike, n, m):
    """Whether sets of n and m shingles with so many unlike bits can reach the similarity, for columns and arrays.

    With c of T = n + m shared, c >= 0.8 (T - c) means 9 c >= 4 T: at most T - 2 c <= T / 9 are
    unlike. No pair that verification accepts is refused. The size bound is SIMILARITY itself.
    """
    return (9 * unlike <= n + m) & (n >= SIMILARITY * m) & (m >= SIMILARITY * n)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, bands): node is the text's digest, null without words; n counts its shingles."""

    def make():
        memo = WordHashes()

        def flush(held):
            d, nodes, parts = zip(*held, strict=True)
            doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            element = np.concatenate(parts)
            order = np.lexsort((element, doc))
            doc, element = doc[order], element[order]
            new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])))) if len(doc) else np.zeros(0, np.int64)
            sig = prob_minhash(doc[new], element[new], np.ones(len(new)), len(parts), ROWS * BANDS)
            bands = band_hashes(sig).view(np.int64)
            n = np.bincount(doc[new], minlength=len(parts))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(parts) + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
            return batch(["doc_id", "node", "n", "bands", *BITS], pa.array(d, pa.int64()), pa.array(nodes, pa.binary()), pa.array(n, pa.int64()), lists, *sketches(doc[new], element[new], len(parts)))

        def each(b):
            held, total = [], 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py()
                ws = words(t)
                ids = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
                held.append((d, hashlib.md5(t, usedforsecurity=False).digest() if ws else None, shingles(ids)))
                total += len(ws)
                if total >= CHUNK:
                    yield flush(held)
                    held, total = [], 0
            if held:
                yield flush(held)

        return each

    return map_arrow(docs.select("doc_id", as_bytes()), make, "doc_id long, node binary, n long, bands array<long>, s0 long, s1 long, s2 long, s3 long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, grams): the sorted distinct shingle hashes."""

    def make():
        memo = WordHashes()

        def each(b):
            out = []
            for t in b.column(1):
                ws = words(t.as_py())
                out.append(np.unique(shingles(np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws)))).tobytes())
            yield batch(["node", "grams"], b.column(0), pa.array(out, pa.binary()))

        return each

    return map_arrow(docs.select("node", "text"), make, "node binary, grams binary")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, ok) of pairs (a, b): whether their sets reach the similarity."""

    def make():
        def each(b):
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= SIMILARITY * (len(x) + len(y) - both))
            yield batch(["a", "b", "ok"], b.column(0), b.column(1), pa.array(ok, pa.bool_()))

        return each

    first = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    return map_arrow(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y"), make, "a binary, b binary, ok boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): label is the least node of its component.

    Every round takes the least label among neighbours and follows it once more.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "near-labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "label": "other"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = stored(step.join(jump, "label", "left").select("node", "was", F.coalesce(F.least("label", "further"), "label").alias("label")), "near-labels")
        labels = after.select("node", "label")
        if after.where("label != was").isEmpty():
            return labels


def linked(docs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(node, label) of the nodes that have a link."""
    nodes = sigs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("keeper"), F.first("bands").alias("bands"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in BITS))
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    # stored before joins on their own key, so that Spark can split a bucket or class that is large
    sizes = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-sizes")
    rows = stored(rows.join(sizes, "bucket"), "near-buckets")
    degree = rows.groupBy("node").agg(F.sum("size").alias("degree"))
    info = nodes.select("node", "keeper", "n", *BITS).join(degree, "node")
    members = stored(info, "near-members")
    rows = stored(rows.drop("size").join(members.select("node", "n", "degree"), "node"), "near-rows")
    keyed = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("keeper"), as_bytes()).withColumn("node", F.unhex(F.md5("text")))
    wanted = members.select("node", F.coalesce("keeper", F.lit(LEAST)).alias("keeper"))
    sets = stored(shingle_sets(keyed.join(wanted.hint("shuffle_hash"), ["node", "keeper"], "left_semi")).dropDuplicates(["node"]), "near-sets")
    judged, rest = None, rows
    for _ in range(STAR_ROUNDS):
        best = F.max(F.struct("degree", "node"))["node"]
        heads = stored(rest.groupBy("bucket").agg(best.alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"), "near-heads")
        told = rest.join(heads, "bucket").where("node != head").select("bucket", F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"), "node", "n", "degree")
        pairs = told.select("a", "b").distinct()
        if judged is not None:
            pairs = pairs.join(judged, ["a", "b"], "left_anti")
        now = stored(similar(pairs, sets), "near-judged")
        judged = now if judged is None else judged.union(now)
        rest = stored(told.join(judged.where("not ok").select("a", "b"), ["a", "b"], "left_semi").select("node", "bucket", "n", "degree"), "near-rest")
        if rest.isEmpty():
            break
    labels = components(judged.where("ok"))
    # members of one bucket in different classes
    named = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_ = stored(named.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("mixed"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("mixed").drop("mixed"), "near-mixed-buckets")
    left = stored(named.join(mixed_, "bucket").select("bucket", "node", "n", "label", "size", "weight"), "near-mixed")
    small = left.where(F.col("size") <= SMALL).join(members.select("node", *BITS), "node")
    x, y = small.alias("x"), small.alias("y")
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in BITS), F.lit(0))
    cross = x.join(y, may_link(apart, F.col("x.n"), F.col("y.n")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")))
    cross = cross.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(judged.select("a", "b"), ["a", "b"], "left_anti")
    large = left.where(F.col("size") > SMALL).join(sets, "node").join(nodes.select("node", "bands", *BITS), "node")
    more = stored(similar(cross, sets).where("ok").select("a", "b").union(links_in_tiles(large)), "near-cross")
    if more.isEmpty():
        return labels
    return components(judged.where("ok").select("a", "b").union(more))


def links_in_tiles(rows: DataFrame) -> DataFrame:
    """Links (a, b) between members of one bucket in different classes, for large buckets.

    A bucket is cut into tiles of at most TILE members (and TILE_GRAMS shingles), and a
    task takes two of them. It compares inside, and emits links only. A pair is looked at
    in the first bucket that it shares, if sizes and sketches allow a link (they refuse what can't be one); one link of a
    document to a class is enough.
    """
    tiles = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("weight") / TILE_GRAMS)).cast("int")
    tiled = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keyed = tiled.select("bucket", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "node", "label", "n", "grams", "bands", *BITS)

    def links(key, g):
        bucket, lo, hi = key
        n, label, tile = g["n"].to_numpy(), g["label"].to_numpy(), g["tile"].to_numpy()
        bands, bits, node = np.stack(g["bands"]), np.ascontiguousarray(g[BITS].to_numpy(np.int64)), g["node"].to_numpy()
        sets, place = [np.frombuffer(x, np.uint64) for x in g["grams"]], int(np.flatnonzero(bands[0] == bucket)[0])
        code = np.unique(label, return_inverse=True)[1]
        a, b = [], []
        for i in range(len(g)):
            on = (code[i + 1 :] != code[i]) & may_link(0, n[i], n[i + 1 :])
            if lo != hi:
                on &= tile[i + 1 :] != tile[i]
            j = np.flatnonzero(on) + i + 1
            j = j[may_link(np.bitwise_count((bits[j] ^ bits[i]).view(np.uint64)).sum(axis=1, dtype=np.int64), n[i], n[j])]
            j = j[~(bands[j, :place] == bands[i, :place]).any(axis=1)]
            met = set()
            for k in j.tolist():
                if code[k] in met:
                    continue
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if both >= SIMILARITY * (len(sets[i]) + len(sets[k]) - both):
                    met.add(code[k])
                    a.append(min(node[i], node[k]))
                    b.append(max(node[i], node[k]))
        return pd.DataFrame({"a": a, "b": b})

    return keyed.groupBy("bucket", "lo", "hi").applyInPandas(links, "a binary, b binary")


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, node and label of every document: node is the text's digest, label its class; both null without words."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = stored(signatures(docs), "near-signatures")
    return sigs.select("doc_id", "node").join(linked(docs, sigs), "node", "left").withColumn("label", F.coalesce("label", "node"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size of every document, and node, its text's digest."""
    named = stored(labelled(docs), "near-named")
    whole = stored(named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "near-classes")
    alone = F.col("label").isNull()
    return named.join(whole, "label", "left").select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"), "node")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class; columns as in docs.

    It is the one with the least doc_id (null comes last), then the least text's digest. A
    text without words is a class of its own, so all of these stay, whatever their ids.
    """
    key = F.col("doc_id").cast("long")
    least, k, node = (unused(docs, c) for c in ("is_null", "key", "node"))
    rank = F.struct(F.col("doc_id").isNull().alias(least), F.coalesce("doc_id", F.lit(LEAST)).alias(k), F.col("node").alias(node))
    wanted = stored(labelled(docs).where("label is not null").groupBy("label").agg(F.min(rank).alias("least")).select("least.*"), "near-keepers")
    worded = F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    keyed = docs.where(worded).withColumns({least: key.isNull(), k: F.coalesce(key, F.lit(LEAST)), node: F.unhex(F.md5(F.col("text").cast("binary")))})
    kept = keyed.join(wanted.hint("shuffle_hash"), [least, k, node], "left_semi").dropDuplicates([least, k, node])
    return kept.select(*map(named_column, docs.columns)).union(docs.where(~worded))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents", "doc_id", "text")).drop("node")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
node AS (
  SELECT row_number() OVER () AS v, text, ws FROM (SELECT DISTINCT text, ws FROM d WHERE len(ws) > 0)),
spots AS (
  SELECT v, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS p FROM node),
shingle AS (
  SELECT DISTINCT v, array_to_string(ws[p:p + 4], ' ') AS s FROM spots),
size AS (
  SELECT v, count(*) AS n FROM shingle GROUP BY v),
sized AS (
  SELECT v, s, n FROM shingle JOIN size USING (v)),
common AS (
  SELECT a.v AS v, b.v AS u, any_value(a.n + b.n) AS total, count(*) AS c
  FROM sized a JOIN sized b ON a.s = b.s AND a.v <> b.v WHERE 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY a.v, b.v),
link AS (
  SELECT v, u FROM common WHERE 5 * c >= 4 * (total - c)),
reach AS (
  SELECT v, v AS u FROM node
  UNION SELECT reach.v, link.u FROM reach JOIN link ON reach.u = link.v),
label AS (
  SELECT v, min(u) AS l FROM reach GROUP BY v),
named AS (
  SELECT doc_id, l FROM d LEFT JOIN node ON d.text = node.text LEFT JOIN label USING (v)),
class AS (
  SELECT l, min(doc_id) AS class_id, count(*) AS class_size FROM named WHERE l IS NOT NULL GROUP BY l)
SELECT doc_id, CASE WHEN l IS NULL THEN doc_id ELSE class_id END AS class_id, coalesce(class_size, 1) AS class_size
FROM named LEFT JOIN class USING (l)
"""
