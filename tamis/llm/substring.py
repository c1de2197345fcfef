"""Substring deduplication on the compacted De Bruijn graph of word k-mers.

An edge of the graph is a window of ``k`` consecutive words, a node the ``k`` - 1 words that
two following windows share. Edges are dealt out under a minimizer (the ``ANCHOR``-word gram
of least hash in the window), so equal edges meet in one task, and following edges with one
anchor travel as one row.

1. Anchors alone are counted. Only edges under an anchor that occurs in two documents are
   sent at all: the rest can't repeat. What a scan's task may leave out is written to the
   shared folder, by the task and the digest of the rows it goes with.
2. Equal edges meet, and a sweep in doc_id order gives every repeated edge the coordinates
   of an earlier document's copy (``src_doc``, ``src_start``).
3. Compaction: edges that enter a node and edges that leave it, in the same document and the
   same source, are joined on it. A node with one of each is no branch and is contracted.
   What is left are the ends of the nonbranching paths.
4. Each path is verified: the document and the source both digest its words. Paths whose
   digests differ (hashes met) are given up, and their windows are asked again by their
   whole words, against all documents.

Skew: copies of a passage in one chunk of a scan are answered there, by their neighbour; only
the first of them asks the other tasks. A source is the nearest earlier copy, so no document
has to answer for a whole group. The sweep holds the distinct edges of one anchor; an anchor
with more than ``HOT`` rows is split by its edges. Joins by document leave a repeated row to
Spark's skew handling, as its other side has one row.

Nulls: a null text has no words; documents with null doc_id neither lose nor cause loss.
Rows that repeat a doc_id don't remove each other's words, whether their texts are equal or
not. An empty table gives an empty result. A very long text is hashed in pieces of ``PIECE``
bytes; a worker holds the text and 8 bytes a word. Columns other than doc_id and text aren't
read, so their names can't clash.

The docs are scanned twice and have to come in the same order both times: a table that is
not read from files or memory directly is stored first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, batch, dropped, fetch_table, fresh_dir, map_arrow, partitions, prepare, stored, table, written

K, ANCHOR = 13, 5
#: Words that are hashed at a time, and word hashes that a task remembers.
CHUNK, MEMO = 400_000, 300_000
#: Bytes of a text that are split into words at a time.
PIECE = 4 << 20
#: Rows of an anchor beyond which its edges are dealt out one by one.
HOT = 50_000
#: Parts that a task of the anchor count takes one after the other.
PARTS = 16
#: Rows after which a sweep begins anew with the next anchor.
SWEEP = 100_000
#: Bits of an edge's hash under its anchor's.
HASH_BITS = 64
#: Edges that are asked again by their words in one scan.
AGAIN = 1_000_000
TOLD = (1 << 64) - 1
KEY = ["doc_id", "th"]


class WordHashes(dict):
    """Word -> 64-bit hash, of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


def odd(seed: int, n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(bytes([j]), seed) | 1 for j in range(n)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(ids: np.ndarray, factors: np.ndarray) -> np.ndarray:
    n = len(ids) - len(factors) + 1
    out = ids[:n] * factors[0]
    for j in range(1, len(factors)):
        out += ids[j : j + n] * factors[j]
    return mixed(out)


def pieces(text: bytes) -> Iterator[bytes]:
    """A text cut behind blanks into pieces of about PIECE bytes."""
    at = 0
    while len(text) - at > PIECE:
        cut = next((k for k in range(at + PIECE, len(text)) if text[k : k + 1].isspace()), len(text))
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def word_hashes(text: bytes, memo: WordHashes) -> np.ndarray:
    found = [np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws)) for ws in map(bytes.split, pieces(text))]
    return found[0] if len(found) == 1 else np.concatenate(found)


class Blocks:
    """The windows of documents laid end to end, in blocks of following windows with a common anchor.

    h, doc, first, size: anchor hash, document number, first window and number of windows of each
    block; gap: distance of the anchor from the first window; w: hashes of all windows, in order,
    of which a block's begin at ``at``.
    """

    def __init__(self, texts: list[np.ndarray], k: int, bits: int = 0):
        """Without ``bits`` windows have no hashes."""
        ids = np.concatenate(texts)
        ends = np.cumsum([len(x) for x in texts])
        self.starts = ends - [len(x) for x in texts]
        a = grams(ids, odd(1, ANCHOR))
        n = len(ids) - k + 1
        best, at = a[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, k - ANCHOR + 1):
            less = a[j : j + n] < best
            best[less] = a[j : j + n][less]
            at[less] = j
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in texts])[:n]
        first = np.flatnonzero(np.arange(n) + k <= ends[doc])
        doc, best, at = doc[first], best[first], at[first] + first
        self.w = (grams(ids, odd(2, k)) & np.uint64((1 << bits) - 1))[first] if bits else None
        self.at = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
        self.size = np.diff(np.append(self.at, len(first)))
        self.h, self.doc, self.first, self.gap = best[self.at], doc[self.at], first[self.at], at[self.at] - first[self.at]

    def __len__(self) -> int:
        return len(self.at)


class Chunk:
    """Documents of one task, of about CHUNK words; equal rows are one."""

    def __init__(self):
        self.ids, self.th, self.texts, self.words, self.met = [], [], [], 0, set()

    def add(self, doc_id: int, th: int, text: np.ndarray) -> None:
        if (doc_id, th) not in self.met:
            self.met.add((doc_id, th))
            self.ids.append(doc_id)
            self.th.append(th)
            self.texts.append(text)
            self.words += len(text)

    def digest(self) -> bytes:
        return xxhash.xxh3_128_digest(np.array([self.ids, self.th], np.int64).tobytes())


def chunks(batches, k: int) -> Iterator[Chunk]:
    memo, held = WordHashes(), Chunk()
    for b in batches:
        for d, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            ids = word_hashes(t.as_py(), memo)
            if len(ids) >= k:
                held.add(d, th, ids)
            if held.words >= CHUNK:
                yield held
                held = Chunk()
    if held.words:
        yield held


def packed(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


# ---- 1: anchors that occur in two documents


def shared_anchors(docs: DataFrame, k: int, hot: int) -> str:
    """Writes, by task and chunk of the scan, the anchors that other chunks have, too, and those with more than ``hot`` rows."""
    n = partitions(docs.sparkSession)
    parts = PARTS * n

    def counted(batches):
        task = TaskContext.get().partitionId()
        for c in chunks(batches, k):
            h, rows = np.unique(Blocks(c.texts, k).h, return_counts=True)
            part = (mixed(h) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            h, rows, part = h[order], rows[order].astype(np.uint32), part[order]
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            m = len(cut)
            yield batch(["part", "task", "chunk", "h", "n"], part[cut], pa.array([task] * m, pa.int32()), pa.array([c.digest()] * m, pa.binary()), packed(np.split(h, cut[1:])), packed(np.split(rows, cut[1:])))

    def of_part(held):
        h = np.concatenate([np.frombuffer(x[2], np.uint64) for x in held])
        name, inverse = np.unique(h, return_inverse=True)
        twice = np.bincount(inverse)[inverse] > 1
        rows = np.bincount(inverse, np.concatenate([np.frombuffer(x[3], np.uint32) for x in held]))[inverse]
        ends, out = np.cumsum([len(x[2]) // 8 for x in held]), []
        for (task, chunk, _, _), a, e in zip(held, [0, *ends[:-1]], ends, strict=True):
            on, many = twice[a:e], rows[a:e] > hot
            out.append((task, chunk, h[a:e][on & ~many].tobytes(), h[a:e][on & many].tobytes()))
        return batch(["task", "chunk", "shared", "hot"], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)))

    def joined(batches):
        now, held = None, []
        for b in batches:
            for part, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now and held:
                    yield of_part(held)
                    held = []
                now = part
                held.append(row)
        if held:
            yield of_part(held)

    sent = docs.mapInArrow(counted, "part long, task int, chunk binary, h binary, n binary")
    back = sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(joined, "task int, chunk binary, shared binary, hot binary")
    path = fresh_dir(docs.sparkSession, "repeat-anchors")
    written(back.repartition(n, "task"), path, "task")
    return path


def anchors_of(path: str, task: int) -> dict[bytes, tuple[np.ndarray, np.ndarray]]:
    """Chunk -> its shared and its hot anchors."""
    rows, got = {}, fetch_table(f"{path}/task={task}")
    for c, s, m in zip(*(got[x].to_pylist() for x in ("chunk", "shared", "hot")), strict=True) if got else ():
        rows.setdefault(c, []).append((s, m))
    return {c: tuple(np.frombuffer(b"".join(x), np.uint64) for x in zip(*r, strict=True)) for c, r in rows.items()}


# ---- 2: equal edges meet


def told_in_chunk(b: Blocks, own: np.ndarray) -> np.ndarray:
    """For each block, an equal one of the nearest document before in the chunk's order of doc_ids; -1 if there is none."""
    place = np.arange(len(b.w)) - np.repeat(b.at, b.size)
    block = mixed(np.add.reduceat(mixed(b.w + mixed(place.astype(np.uint64))), b.at) + (b.h ^ (b.gap.astype(np.uint64) << np.uint64(8))) + b.size.astype(np.uint64))
    order = np.lexsort((own, block))
    count = np.arange(len(order))
    same = np.concatenate(([False], (block[order][1:] == block[order][:-1]) & (b.h[order][1:] == b.h[order][:-1])))
    later = np.concatenate(([False], own[order][1:] != own[order][:-1]))
    run, head = (np.maximum.accumulate(np.where(x, count, 0)) for x in (~same | later, ~same))
    out = np.full(len(order), -1)
    out[order] = np.where(run > head, order[run - 1], -1)
    return out


def several(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where an anchor stands in two documents."""
    order = np.lexsort((own, h))
    a, d = h[order], own[order]
    new = np.concatenate(([True], a[1:] != a[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    out = np.empty(len(h), bool)
    out[order] = np.repeat(d[first] != d[last], last - first + 1)
    return out


def questions(docs: DataFrame, anchors: str, k: int, bits: int) -> DataFrame:
    """(h, doc_id, th, ctx): a block of windows to be looked up, or a stretch that its chunk has answered.

    ctx, in 64-bit words: 16 times the position and the gap, then the windows; or TOLD, start, n, src_doc, src_th, src_start.
    """

    def run(batches):
        known = None
        for c in chunks(batches, k):
            b = Blocks(c.texts, k, bits)
            known = anchors_of(anchors, TaskContext.get().partitionId()) if known is None else known
            if c.digest() not in known:
                raise RuntimeError("the documents came in another order at the second reading; store the table first")
            shared, hot = known[c.digest()]
            ids, th, pos = np.array(c.ids, np.int64), np.array(c.th, np.int64), b.first - b.starts[b.doc]
            own = ids[b.doc]
            source = told_in_chunk(b, own)
            ask = np.flatnonzero(source < 0)
            many = np.isin(b.h[ask], hot)
            ask, split = ask[(several(b.h[ask], own[ask]) | np.isin(b.h[ask], shared)) & ~many], ask[many]
            n = b.size[ask]
            ends = np.cumsum(n + 1)
            flat = np.empty(ends[-1] if len(n) else 0, np.uint64)
            flat[ends - n - 1] = pos[ask] * 16 + b.gap[ask]
            taken = np.zeros(len(b), bool)
            taken[ask] = True
            flat[np.arange(n.sum()) + np.repeat(np.arange(len(n)), n) + 1] = b.w[np.repeat(taken, b.size)]
            ctx = pa.Array.from_buffers(pa.binary(), len(ask), [None, pa.py_buffer((np.append(0, ends) * 8).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            yield batch(["h", *KEY, "ctx"], b.h[ask].view(np.int64), own[ask], th[b.doc[ask]], ctx)
            # the windows of hot anchors one by one
            of = np.repeat(split, b.size[split])
            j = np.arange(len(of)) - np.repeat(np.cumsum(b.size[split]) - b.size[split], b.size[split])
            one = np.stack(((pos[of] + j) * 16 + b.gap[of] - j, b.w[b.at[of] + j].view(np.int64)), axis=1) if len(of) else np.zeros((0, 2), np.int64)
            yield batch(["h", *KEY, "ctx"], mixed(b.h[of] ^ b.w[b.at[of] + j]).view(np.int64), own[of], th[b.doc[of]], packed(list(one)))
            # stretches of blocks that are answered from one document's following blocks
            done = np.flatnonzero(source >= 0)
            if len(done):
                src = source[done]
                goes_on = (b.doc[done][1:] == b.doc[done][:-1]) & (b.doc[src][1:] == b.doc[src][:-1])
                goes_on &= (b.first[done][1:] == (b.first + b.size)[done][:-1]) & (b.first[src][1:] == (b.first + b.size)[src][:-1])
                new = np.flatnonzero(np.concatenate(([True], ~goes_on)))
                d, s = done[new], src[new]
                told = np.stack((np.full(len(d), -1), pos[d], np.add.reduceat(b.size[done], new), own[s], th[b.doc[s]], pos[s]), axis=1)
                spread = mixed(th[b.doc[d]].view(np.uint64) + d.astype(np.uint64)).view(np.int64)
                yield batch(["h", *KEY, "ctx"], spread, own[d], th[b.doc[d]], packed(list(told)))

    return docs.mapInArrow(run, "h long, doc_id long, th long, ctx binary")


ANSWERS = "doc_id long, th long, start int, n int, src_doc long, src_th long, src_start int"


def stretches(h: np.ndarray, doc: np.ndarray, th: np.ndarray, ctx: pa.Array) -> list[np.ndarray]:
    """The columns of ANSWERS for questions that hold all rows of their anchors, sorted by h, doc_id and th."""
    ends = np.frombuffer(ctx.buffers()[1], np.int32, len(ctx) + 1, ctx.offset * 4).astype(np.int64) // 8
    flat = np.frombuffer(ctx.buffers()[2], np.uint64)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint64)
    head, size = ends[:-1] - ends[0], np.diff(ends) - 1
    row = np.repeat(np.arange(len(size)), size)
    j = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    at = flat[head]
    pos = (at >> np.uint64(4)).astype(np.int64)[row] + j
    gap = (at & np.uint64(15)).astype(np.int64)[row] - j
    # the name of a window: its hash, its anchor and where that stands in it
    name = mixed(flat[head[row] + 1 + j] ^ mixed(h.view(np.uint64)[row] + gap.astype(np.uint64)))
    order = np.argsort(name, kind="stable")  # rows are in order of doc_id
    one, own, count = name[order], doc[row][order], np.arange(len(order))
    first = np.concatenate(([True], one[1:] != one[:-1]))
    other = first | np.concatenate(([True], own[1:] != own[:-1]))
    run, group = (np.maximum.accumulate(np.where(x, count, 0)) for x in (other, first))
    earlier = run > group
    before = run[np.maximum(run - 1, 0)]  # where the document before has this window first
    source = np.full(len(order), -1)
    source[order] = np.where(earlier, order[before], -1)
    hit = np.flatnonzero(source >= 0)
    if not len(hit):
        return [np.zeros(0, np.int64)] * 7
    src = source[hit]
    goes_on = (row[hit][1:] == row[hit][:-1]) & (hit[1:] == hit[:-1] + 1) & (pos[src][1:] == pos[src][:-1] + 1)
    goes_on &= (doc[row[src]][1:] == doc[row[src]][:-1]) & (th[row[src]][1:] == th[row[src]][:-1])
    new = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    n = np.diff(np.append(new, len(hit)))
    d, r = hit[new], src[new]
    return [doc[row[d]], th[row[d]], pos[d], n, doc[row[r]], th[row[r]], pos[r]]


def answers(asked: DataFrame) -> DataFrame:
    """For each stretch of repeated windows, an earlier document and where they stand there.

    A task takes its anchors in turn, some batches of rows at a time and each anchor as a whole.
    """
    sign = TOLD.to_bytes(8, "little")
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())

    def table_of(columns):
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names=[*KEY, "start", "n", "src_doc", "src_th", "src_start"])

    def taken(held):
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        h = b.column(0).to_numpy()
        lone = np.concatenate(([True], h[1:] != h[:-1])) & np.concatenate((h[1:] != h[:-1], [True]))
        b = b.take(pa.array(np.flatnonzero(~lone)))
        return table_of(stretches(*(b.column(k).to_numpy() for k in range(3)), b.column(3))) if b.num_rows else None

    def run(batches):
        held, rows = [], 0
        for b in batches:
            told = np.fromiter((x[:8] == sign for x in b.column(3).to_pylist()), bool, b.num_rows)
            if told.any():
                t = b.filter(pa.array(told))
                flat = np.frombuffer(b"".join(t.column(3).to_pylist()), np.int64).reshape(-1, 6)
                yield table_of([t.column(1).to_numpy(), t.column(2).to_numpy(), *flat[:, 1:].T])
                b = b.filter(pa.array(~told))
            if not b.num_rows:
                continue
            h = b.column(0).to_numpy()
            if rows >= SWEEP and h[-1] != held[-1].column(0)[-1].as_py():
                # up to the last anchor's first row all anchors are whole
                cut = int(np.searchsorted(h, held[-1].column(0)[-1].as_py(), side="right"))
                if out := taken([*held, b.slice(0, cut)]):
                    yield out
                held, rows, b = [], 0, b.slice(cut)
            held.append(b)
            rows += b.num_rows
        if held and (out := taken(held)):
            yield out

    n = partitions(asked.sparkSession)
    return asked.repartition(n, "h").sortWithinPartitions("h", *KEY).mapInArrow(run, ANSWERS)


# ---- 3: compaction


def compacted(found: DataFrame) -> DataFrame:
    """Nonbranching paths, as rows like the stretches'.

    A stretch leaves a node at its start and enters one at its end. Both sides are joined on
    the node (named by its place in the document and in the source); where as many stretches
    enter as leave, the paths go on through it. Of the other nodes each line of document and
    source keeps those at which nothing goes on before or behind, which are a path's ends in turn.
    """
    line = [*KEY, "src_doc", "src_th", "shift"]
    edges = found.withColumn("shift", F.col("start") - F.col("src_start"))
    leave = edges.groupBy(*line, F.col("start").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    enter = edges.groupBy(*line, (F.col("start") + F.col("n")).alias("node")).agg(F.count(F.lit(1)).alias("into"))
    turn = F.coalesce("out", F.lit(0)) - F.coalesce("into", F.lit(0))
    branches = leave.join(enter, [*line, "node"], "full_outer").select(*line, "node", turn.alias("turn")).where("turn != 0")
    along = Window.partitionBy(*line).orderBy("node")
    ends = branches.withColumn("behind", F.sum("turn").over(along)).where((F.col("behind") == 0) | (F.col("behind") == F.col("turn")))
    paths = ends.withColumn("end", F.lead("node").over(along)).where("behind != 0")
    return paths.select(*KEY, F.col("node").alias("start"), (F.col("end") - F.col("node")).alias("n"), "src_doc", "src_th", (F.col("node") - F.col("shift")).alias("src_start"))


# ---- 4: verification


def path_key():
    return F.xxhash64(*KEY, "start", "n", "src_doc", "src_start").alias("key")


def spans_of(paths: DataFrame) -> DataFrame:
    """Per document: the stretches it loses and those it has to vouch for, each under the path's key."""
    own = paths.select(*KEY, F.struct(F.lit(True).alias("own"), path_key(), "start", "n").alias("s"))
    source = paths.select(F.col("src_doc").alias("doc_id"), F.col("src_th").alias("th"), F.struct(F.lit(False).alias("own"), path_key(), F.col("src_start").alias("start"), "n").alias("s"))
    return own.union(source).groupBy(*KEY).agg(F.collect_list("s").alias("spans"))


RESULT = "n_words long, n_removed long, kept_sha256 string"


def judged(docs: DataFrame, spans: DataFrame, k: int, with_text: bool) -> DataFrame:
    """Each document without its repeated words, and the digests of its paths."""

    def make():
        def each(b):
            lists = b.column(2)
            flat = lists.flatten()
            own, key, start, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("own", "key", "start", "n"))
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            begin, end, own = start.tolist(), (start + n + k - 1).tolist(), own.tolist()
            rows, digests, at = [], [], 0
            for t, stop in zip(b.column(1), ends.tolist(), strict=True):
                ws = (t.as_py() or b"").split()
                keep = bytearray(b"\1") * len(ws)
                for x in range(at, stop):
                    a, e = begin[x], end[x]
                    digests.append(xxhash.xxh3_128_digest(b" ".join(ws[a:e])))
                    if own[x]:
                        keep[a:e] = bytes(e - a)
                at, left = stop, keep.count(1)
                text = b" ".join(ws if left == len(ws) else compress(ws, keep))
                rows.append((len(ws), len(ws) - left, hashlib.sha256(text).hexdigest(), text if with_text else None))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            names = ["n_words", "n_removed", "kept_sha256", "kept"]
            checks = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.StructArray.from_arrays([pa.array(key, pa.int64()), pa.array(digests, pa.binary())], names=["key", "digest"]))
            yield batch([*KEY, *names, "checks"], b.column(0), b.column(3), *cols, checks)

        return each

    joined = docs.join(spans.hint("shuffle_hash"), KEY, "left").select("doc_id", "text", "spans", "th")
    return map_arrow(joined, make, f"doc_id long, th long, {RESULT}, kept binary, checks array<struct<key:long,digest:binary>>")


def windows_in(docs: DataFrame, paths: DataFrame, k: int, bits: int) -> DataFrame:
    """(w, words, doc_id, th, start) of all windows of the given paths, with their words."""

    def make():
        memo, factors = WordHashes(), odd(2, k)

        def each(b):
            out = []
            for d, th, t, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                ws = t.as_py().split()
                w = grams(np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws)), factors) & np.uint64((1 << bits) - 1)
                for p in sorted({p for s in spans for p in range(s["start"], s["start"] + s["n"])}):
                    out.append((int(w[p : p + 1].view(np.int64)[0]), b" ".join(ws[p : p + k]), d, th, p))
            if out:
                yield batch(["w", "words", *KEY, "start"], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)))

        return each

    spans = paths.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return map_arrow(docs.join(spans, KEY).select(*KEY, "text", "spans"), make, "w long, words binary, doc_id long, th long, start int")


def least_documents(docs: DataFrame, names: np.ndarray, k: int, bits: int) -> DataFrame:
    """(words, doc_id): the windows whose hashes are among ``names`` (sorted), and the least document of each."""
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def make():
        memo, factors, wanted = WordHashes(), odd(2, k), shared.value

        def each(b):
            least: dict[bytes, int] = {}
            for d, t in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                ws = t.as_py().split()
                if len(ws) < k:
                    continue
                w = grams(np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws)), factors) & np.uint64((1 << bits) - 1)
                for p in np.flatnonzero(np.isin(w.view(np.int64), wanted)).tolist():
                    x = b" ".join(ws[p : p + k])
                    least[x] = min(d, least.get(x, d))
            if least:
                yield batch(["words", "doc_id"], pa.array(list(least), pa.binary()), pa.array(list(least.values()), pa.int64()))

        return each

    return map_arrow(docs, make, "words binary, doc_id long").groupBy("words").agg(F.min("doc_id").alias("least"))


def asked_again(docs: DataFrame, wrong: DataFrame, k: int, bits: int) -> DataFrame:
    """(doc_id, th, start, n = 1) of the windows in wrong paths that a smaller doc_id has, compared word by word."""
    asked = stored(windows_in(docs, wrong, k, bits), "repeat-again")
    names = stored(asked.select("w").distinct(), "repeat-names")
    turns, out = max(1, -(-names.count() // AGAIN)), None
    for turn in range(turns):
        of_turn = F.pmod(F.xxhash64("w"), F.lit(turns)) == turn
        some = np.sort(np.array(names.where(of_turn).toArrow()["w"].to_numpy(), np.int64))  # about AGAIN of them
        least = least_documents(docs, some, k, bits)
        true = stored(asked.where(of_turn).join(least, "words").where("least < doc_id").select(*KEY, "start", F.lit(1).alias("n")), "repeat-true")
        out = true if out is None else out.union(true)
    return out


def in_file_order(docs: DataFrame) -> bool:
    """Whether a table is read straight from files or memory, so that its rows come in one order at every reading."""
    return "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()


def without_repeats(docs: DataFrame, k: int = K, *, with_text: bool = False, hash_bits: int = HASH_BITS, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the text left) of every document."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes())
    if not in_file_order(docs):
        docs = stored(docs, "repeat-docs")
    docs = docs.withColumn("th", F.xxhash64("text"))
    sent = docs.where("doc_id is not null and text is not null").select(*KEY, "text")
    anchors = shared_anchors(sent, k, hot)
    paths = stored(compacted(answers(questions(sent, anchors, k, hash_bits))), "repeat-paths")
    dropped(spark, anchors)
    result = stored(judged(docs, spans_of(paths), k, with_text), "repeat-results")
    # a path whose two copies differ: hashes met by chance
    wrong = stored(result.select(F.explode("checks").alias("c")).groupBy("c.key").agg(F.countDistinct("c.digest").alias("kinds")).where("kinds > 1").select("key"), "repeat-wrong")
    out = result
    if not wrong.isEmpty():
        keyed = paths.withColumn("key", path_key())
        failed = stored(keyed.join(wrong, "key", "left_semi"), "repeat-failed")
        these = failed.select(*KEY).distinct()
        again = asked_again(sent, failed, k, hash_bits)
        right = keyed.join(wrong, "key", "left_anti").join(these, KEY, "left_semi").select(*KEY, "start", "n")
        spans = right.union(again).select(*KEY, F.struct(F.lit(True).alias("own"), F.lit(0).cast("long").alias("key"), "start", "n").alias("s")).groupBy(*KEY).agg(F.collect_list("s").alias("spans"))
        anew = stored(judged(docs.join(these, KEY, "left_semi"), spans, k, with_text), "repeat-anew")
        out = result.join(these, KEY, "left_anti").unionByName(anew)
    else:
        dropped(spark, paths)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", *([F.col("kept").cast("string").alias("kept")] if with_text else []))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
g AS (
  SELECT r, doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM d),
win AS (
  SELECT r, doc_id, p, array_to_string(ws[p:p + 12], ' ') AS w FROM g),
least AS (
  SELECT w, min(doc_id) AS d0 FROM win GROUP BY w),
hit AS (
  SELECT r, p FROM win JOIN least USING (w) WHERE doc_id > d0),
word AS (
  SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
judged AS (
  SELECT word.r, word.p, word,
         max(CASE WHEN hit.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY word.r ORDER BY word.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM word LEFT JOIN hit ON word.r = hit.r AND word.p = hit.p),
kept AS (
  SELECT r, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS text FROM judged GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
