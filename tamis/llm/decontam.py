"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items are dealt out to chunks of about ``CHUNK_BYTES`` of text; an item of more than
``PIECE`` words is cut into pieces that overlap by ``n`` - 1 words, so no window is lost.
Tasks build an automaton of each chunk, lay it out as flat arrays (some 10 bytes for each
byte of text) and write it to the shared folder. Workers hold as many automata as fit into
``HELD_BYTES`` and take each batch of documents past all of them, so neither the driver nor a
worker grows with the benchmark. They stream document words through an automaton, track the
longest matching length, and mark every word inside a window of ``n`` consecutive item words.
An item of fewer words is one window.

Nulls: a null text has no words; items with null id or without words take no part.
Repeated documents are judged one by one; items that repeat an id count as one item. Without
items no document is hit; an empty table of documents gives an empty result. A very long text
is held whole, with its words, by one worker. Of docs and benchmark the named columns are read
alone (decontaminate() keeps all of docs and adds none), so other names can't clash.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, batch, fetch, fresh_dir, map_arrow, prepare, put, schema_of, table

CHUNK_BYTES, PIECE = 1 << 20, 50_000
HELD_BYTES = 200 << 20
#: Digits and letters stand, A-Z become a-z, other ASCII separates, bytes of other characters stand.
NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(NORMAL).split() if text else []


class Builder:
    """Grows a generalised suffix automaton over word ids; a state's transitions are a dict."""

    def __init__(self):
        self.next, self.link, self.len = [{}], [-1], [0]

    def extend(self, p: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[p]:
            q = nxt[p][w]
            return q if length[q] == length[p] + 1 else self.clone(p, q, w)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self.clone(p, q, w)
        return cur

    def clone(self, p: int, q: int, w: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c


def flat_lists(lists: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Where each list ends, and all of them one after the other."""
    return np.cumsum([0, *map(len, lists)]).astype(np.int32), np.array([x for one in lists for x in one], np.int32)


class SuffixAutomaton:
    """A generalised suffix automaton as flat arrays, with the windows that end in each state.

    State v goes to ``to[k]`` by word ``by[k]`` for the k in at[v]:at[v + 1]. Lists of windows are
    kept once: ``found`` and ``short`` say which of them a state has (-1: none); a list of found
    holds items, one of short pairs of length and item.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        self.n, self.vocab = n, {}
        self.names = sorted({i for i, ws in items if ws})
        name = {x: k for k, x in enumerate(self.names)}
        held = [(name[i], [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]) for i, ws in items if ws]
        b = Builder()
        for _, ids in held:
            last = 0
            for w in ids:
                last = b.extend(last, w)
        self.link, self.len = np.array(b.link, np.int32), np.array(b.len, np.int32)
        self.at = np.cumsum([0, *map(len, b.next)]).astype(np.int32)
        order = [sorted(x) for x in b.next]
        self.by = np.array([w for ws in order for w in ws], np.int32)
        self.to = np.array([x[w] for x, ws in zip(b.next, order, strict=True) for w in ws], np.int32)
        self._windows(held, b.next)
        self.least = min([n, *(len(ids) for _, ids in held)])
        pairs = sum(max(0, len(ids) - 1) for _, ids in held)
        self.bits = max(12, (16 * pairs).bit_length())
        self.pairs = np.zeros(1 << self.bits, bool)
        for _, ids in held:
            self.pairs[self._slots(np.array(ids, np.int64))] = True

    def _windows(self, held, nxt) -> None:
        n, found, own = self.n, {}, {}
        for item, ids in held:
            v = 0
            for k, w in enumerate(ids, 1):
                v = nxt[v][w]
                if k >= n:
                    found.setdefault(self.window_state(v), set()).add(item)
            if len(ids) < n:
                own.setdefault(v, set()).add((len(ids), item))
        lists: dict[tuple, int] = {}
        self.found = np.full(len(self.len), -1, np.int32)
        for v, x in found.items():
            self.found[v] = lists.setdefault(tuple(sorted(x)), len(lists))
        self.found_end, self.found_item = flat_lists(list(lists))
        short: list[list] = []
        self.short = np.full(len(self.len), -1, np.int32)
        for v in np.argsort(self.len[1:], kind="stable") + 1 if own else ():
            above = int(self.short[self.link[v]])
            if int(v) in own:
                short.append([*(short[above] if above >= 0 else ()), *sorted(own[int(v)])])
                above = len(short) - 1
            self.short[v] = above
        self.short_end, both = flat_lists([[x for pair in one for x in pair] for one in short])
        self.short_pair = both.reshape(-1, 2)

    def window_state(self, v: int) -> int:
        """The state of the last n words of what v has read."""
        while self.len[self.link[v]] >= self.n:
            v = self.link[v]
        return int(v)

    def nbytes(self) -> int:
        arrays = sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))
        return arrays + 120 * len(self.vocab) + 60 * len(self.names)

    def spans(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges of all windows in a document, in order of their ends, and their items."""
        if len(ws) < self.least or not self.vocab:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, ws, repeat(0)), np.int64, len(ws))
        spans, items = [], set()
        for a, b in self._runs(ids):
            self._stream(ids[a:b].tolist(), a, spans, items)
        return spans, items

    def _slots(self, ids: np.ndarray) -> np.ndarray:
        return (ids[:-1] * 1_000_003 + ids[1:] * 7_919) & ((1 << self.bits) - 1)

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches that can hold a window: known words, whose neighbours are pairs of some item."""
        ok, more = ids > 0, self.least - 1
        if more:
            ok = ok[:-1] & ok[1:] & self.pairs[self._slots(ids)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        keep = ends - starts >= max(1, more)
        return list(zip(starts[keep].tolist(), (ends[keep] + (1 if more else 0)).tolist(), strict=True))

    def _stream(self, ids, start, spans, items) -> None:
        at, by, to, link, length = (memoryview(x) for x in (self.at, self.by, self.to, self.link, self.len))
        n, v, matched = self.n, 0, 0
        for i, w in enumerate(ids, start + 1):
            while True:
                hi = at[v + 1]
                k = bisect_left(by, w, at[v], hi)
                if k < hi and by[k] == w:
                    v = to[k]
                    matched += 1
                    break
                if not v:
                    matched = 0
                    break
                v = link[v]
                matched = length[v]
            if not matched:
                continue
            if (s := self.short[v]) >= 0:
                for size, item in self.short_pair[self.short_end[s] // 2 : self.short_end[s + 1] // 2].tolist():
                    if size <= matched:
                        spans.append((i - size, i))
                        items.add(self.names[item])
            if matched >= n:
                f = self.found[self.window_state(v)]
                spans.append((i - n, i))
                items.update(self.names[x] for x in self.found_item[self.found_end[f] : self.found_end[f + 1]].tolist())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def automata(benchmark: DataFrame, n: int, id_col: str, text_col: str, chunk_bytes: int | None = None) -> list[str]:
    """Builds an automaton of each chunk of items, in tasks that write to the shared folder; returns their paths."""
    spark = benchmark.sparkSession
    folder, chunk_bytes = fresh_dir(spark, "automata"), chunk_bytes or CHUNK_BYTES
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("item is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    chunks = max(1, -(-size // chunk_bytes))

    def pieces():
        def each(b):
            items, texts = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ws = words(t.as_py())
                for at in range(0, max(1, len(ws) - n + 1), PIECE):
                    items.append(i)
                    texts.append(b" ".join(ws[at : at + PIECE + n - 1]))
            yield batch(["item", "text"], pa.array(items, pa.string()), pa.array(texts, pa.binary()))

        return each

    def built(key, g):
        g = g.sort_values(["item", "text"])
        path = f"{folder}/{key[0]:06d}-{uuid.uuid4().hex}"  # a retry writes a file of its own
        put(path, pickle.dumps(SuffixAutomaton([(i, bytes(t).split()) for i, t in zip(g["item"], g["text"], strict=True)], n), protocol=5))
        return pd.DataFrame({"chunk": [key[0]], "path": [path]})

    dealt = map_arrow(rows, pieces, "item string, text binary").withColumn("chunk", F.pmod(F.xxhash64("item", "text"), F.lit(chunks)).cast("int"))
    # a row for each chunk: as many as the benchmark has megabytes
    return [r.path for r in dealt.groupBy("chunk").applyInPandas(built, "chunk int, path string").orderBy("chunk").collect()]


_held: dict[str, SuffixAutomaton] = {}


def automaton(path: str) -> SuffixAutomaton:
    """A worker process keeps what fits into HELD_BYTES; later batches and tasks find it."""
    if path not in _held:
        got = pickle.loads(fetch(path))
        if sum(x.nbytes() for x in _held.values()) + got.nbytes() > HELD_BYTES:
            _held.clear()
        _held[path] = got
    return _held[path]


def matches(paths: list[str], texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
    """Of each text: the number of its words, the word ranges hit, the items found."""
    n, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    for k, t in enumerate(texts) if not paths else ():
        n[k] = len(words(t))
    for path in paths:
        machine = automaton(path)
        for k, t in enumerate(texts):
            ws = words(t)
            found, ids = machine.spans(ws)
            n[k] = len(ws)
            spans[k] += found
            items[k] |= ids
    return zip(n, map(merged, spans), items, strict=True)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: words, words hit, items found, digest of the item ids, flag."""
    spark = docs.sparkSession
    prepare(spark)
    paths = automata(benchmark, n, item_col, item_text_col)

    def make():
        def each(b):
            rows = []
            for n_words, spans, items in matches(paths, b.column(1).to_pylist()):
                hit = sum(y - x for x, y in spans)
                rows.append((n_words, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0))
            yield batch(["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)))

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col), as_bytes(text_col)), make, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given word ranges; what separates the words stays."""
    plain = text.translate(NORMAL)
    at, k, bounds = 0, 0, []
    for w in plain.split():
        a = plain.index(w, at)
        at = a + len(w)
        bounds.append((a, at))
    out = []
    for a, b in spans:
        out.append(text[k : bounds[a][0]])
        k = bounds[b - 1][1]
    return b"".join([*out, text[k:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """Documents without their hit spans; one whose words are hit beyond max_coverage goes.

    Keeps the columns of docs; n_chars, if there, is counted anew where text was cut.
    """
    spark = docs.sparkSession
    prepare(spark)
    paths = automata(benchmark, n, "item_id", "text")
    names = docs.columns

    def make():
        k = names.index("text")

        def each(b):
            texts, keep = b.column(k).to_pylist(), []
            counts = b.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for i, (n_words, spans, _) in enumerate(matches(paths, texts)):
                hit = sum(y - x for x, y in spans)
                keep.append(hit <= max_coverage * n_words)
                if hit and keep[-1]:
                    texts[i] = cut(texts[i], spans)
                    if counts:
                        counts[i] = len(texts[i].decode("utf-8", "replace"))
            cols = list(b.columns)
            cols[k] = pa.array(texts, pa.binary())
            if counts:
                cols[names.index("n_chars")] = pa.array(counts, b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

        return each

    sent = docs.withColumn("text", F.col("text").cast("binary"))
    return map_arrow(sent, make, schema_of(sent)).withColumn("text", F.col("text").cast("string"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
i AS (
  SELECT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
spots AS (
  SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS p FROM i WHERE len(ws) > 0),
item_win AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS w FROM spots),
sizes AS (
  SELECT DISTINCT n FROM item_win),
starts AS (
  SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d CROSS JOIN sizes),
doc_win AS (
  SELECT r, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w FROM starts),
found AS (
  SELECT r, doc_win.n, p, item_id FROM doc_win JOIN item_win ON doc_win.w = item_win.w AND doc_win.n = item_win.n),
reach AS (
  SELECT r, p, max(p + n - 1) AS far FROM found GROUP BY r, p),
word AS (
  SELECT r, unnest(range(1, len(ws) + 1)) AS p FROM d),
hit AS (
  SELECT word.r, word.p, max(far) OVER (PARTITION BY word.r ORDER BY word.p ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS far
  FROM word LEFT JOIN reach ON word.r = reach.r AND word.p = reach.p),
hits AS (
  SELECT r, count(*) AS n_hit FROM hit WHERE far >= p GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
