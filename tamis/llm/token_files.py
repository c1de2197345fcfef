"""Token-id files of directly addressable codes.

An id is split into chunks, low bits first. Level k holds the k-th chunks of all ids that
reach it, packed at the level's width, a bitmap that says which of them go on, and a rank
directory over the bitmap. So any token is read by a few shifts and ranks, without
decoding a block. The widths are those that make the file smallest, found by dynamic
programming over the bit lengths of the ids.

File: 8 bytes magic, 8 bytes length of a JSON header, the header, then its sections.

Tasks write files of at most ``FILE_TOKENS`` tokens (or one document) to the shared
folder, in ascending doc_id (nulls first, equal ids by a hash of the text, then by the text).
Each attempt writes names of its own, and only those in the manifest that Spark commits are
read. Null texts count as empty; an empty table gives no files. Repeated rows are written one
by one. A document's ids are held by one worker, with the text; a very long one makes a file of
its own. doc_id and text are read alone, so other columns' names can't clash.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import OTHER, byte_letters, default_path, encoded_latin, piece_cutter
from .common import batch, fetch, fresh_dir, map_arrow, partitions, prepare, put, stored, table

MAGIC = b"DACTOK01"
FILE_TOKENS = 4 << 20
#: Documents that are encoded together.
GROUP = 1_000
BLOCK = 512
#: Pieces that a worker remembers, twice over.
CACHE = 400_000
SEGMENT = 1 << 18
END_ID = 2
#: Pieces that the library may be asked for end to end.
WORD = re.compile(r" [^\W\d_]+")
JOINED = 2_000


# ---- the codes


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits each, most significant bit first, without gaps."""
    out = []
    for k in range(0, len(values), SEGMENT):
        part = values[k : k + SEGMENT].astype(">u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(part, axis=1)[:, 32 - width :].ravel()).tobytes())
    return b"".join(out)


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    out, step = np.empty(n, np.uint32), SEGMENT * width // 8
    for k in range(0, n, SEGMENT):
        m = min(SEGMENT, n - k)
        bits = np.zeros((m, 32), np.uint8)
        at = k // SEGMENT * step
        bits[:, 32 - width :] = np.unpackbits(np.frombuffer(data, np.uint8, (m * width + 7) // 8, at), count=m * width).reshape(m, width)
        out[k : k + m] = np.packbits(bits, axis=1).view(">u4").ravel()
    return out


def best_widths(ids: np.ndarray) -> list[int]:
    """The level widths of least total size."""
    lengths = np.zeros(33, np.int64)
    if len(ids):
        counts = np.bincount(ids)
        at = np.flatnonzero(counts)
        np.add.at(lengths, np.maximum(1, np.ceil(np.log2(at + 1.0))).astype(int), counts[at])
    top = max([1, *np.flatnonzero(lengths).tolist()])
    reach = [int(lengths[k + 1 :].sum()) for k in range(top)]

    @functools.cache
    def best(at: int) -> tuple[float, tuple[int, ...]]:
        if at == top:
            return 0, ()
        choices = []
        for w in range(1, top - at + 1):
            cost, rest = best(at + w)
            own = w + (1 + 32 / BLOCK) * (at + w < top)
            choices.append((reach[at] * own + cost, (w, *rest)))
        return min(choices, key=lambda c: (c[0], len(c[1])))

    return list(best(0)[1])


def encode_file(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """starts: where each document's ids begin, and the end."""
    sections = {"has_id": np.packbits(np.array([d is not None for d in doc_ids], bool)).tobytes(), "doc_ids": np.array([d or 0 for d in doc_ids], "<i8").tobytes(), "starts": starts.astype("<u8").tobytes()}
    widths, rest, counts = best_widths(ids), ids.astype(np.uint32), []
    for k, w in enumerate(widths):
        counts.append(len(rest))
        sections[f"chunks{k}"] = pack_bits(rest & np.uint32((1 << w) - 1), w)
        if k + 1 < len(widths):
            more = (rest >> np.uint32(w)) > 0
            sections[f"bitmap{k}"] = np.packbits(more).tobytes()
            sections[f"rank{k}"] = np.concatenate(([0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64)))).astype("<u4").tobytes() if len(more) else b""
            rest = rest[more] >> np.uint32(w)
    at, where = 0, {}
    for k, v in sections.items():
        where[k] = (at, len(v))
        at += len(v)
    head = json.dumps({"docs": len(doc_ids), "widths": widths, "counts": counts, "sections": where}).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, *sections.values()])


class TokenFile:
    """Random access to an encoded file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n = struct.unpack_from("<Q", data, 8)[0]
        self.head = json.loads(data[16 : 16 + n])
        base, view = 16 + n, memoryview(data)
        self.section = {k: view[base + a : base + a + m] for k, (a, m) in self.head["sections"].items()}
        docs = self.head["docs"]
        known = np.unpackbits(np.frombuffer(self.section["has_id"], np.uint8), count=docs)
        self.doc_ids = [d if k else None for d, k in zip(np.frombuffer(self.section["doc_ids"], "<i8").tolist(), known, strict=True)]
        self.starts = np.frombuffer(self.section["starts"], "<u8").astype(np.int64)
        self.rank = [np.frombuffer(self.section[f"rank{k}"], "<u4") for k in range(len(self.head["widths"]) - 1)]

    def __len__(self) -> int:
        return self.head["counts"][0]

    def __getitem__(self, i: int) -> int:
        """The i-th token, from one chunk, bit and rank a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for k, w in enumerate(self.head["widths"]):
            a, b = i * w, i * w + w
            raw = self.section[f"chunks{k}"][a // 8 : (b + 7) // 8]
            value |= (int.from_bytes(raw, "big") >> (-b % 8) & ((1 << w) - 1)) << shift
            shift += w
            if k == len(self.head["widths"]) - 1:
                break
            bitmap = self.section[f"bitmap{k}"]
            if not bitmap[i // 8] >> (7 - i % 8) & 1:
                break
            block = i // BLOCK
            ahead = bitmap[block * BLOCK // 8 : i // 8]
            i = int(self.rank[k][block]) + int.from_bytes(ahead, "big").bit_count() + (bitmap[i // 8] >> (8 - i % 8) if i % 8 else 0).bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All tokens."""
        counts, widths = self.head["counts"], self.head["widths"]
        out, at, shift = np.zeros(counts[0], np.uint32), None, 0
        for k, w in enumerate(widths):
            part = unpack_bits(self.section[f"chunks{k}"], w, counts[k]) << np.uint32(shift)
            if at is None:
                out = part
            else:
                out[at] |= part
            if k + 1 < len(widths):
                more = np.flatnonzero(np.unpackbits(np.frombuffer(self.section[f"bitmap{k}"], np.uint8), count=counts[k]))
                at = more if at is None else at[more]
            shift += w
        return out


# ---- the tokenizer


class LibraryEncoder:
    """Whole texts through the tokenizers library. A piece that the vocabulary's pattern cuts off gets its ids once.

    The pieces known are bounded: at most CACHE, and as many older ones, between two calls.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pieces = piece_cutter()
        letters, special = byte_letters(), set(self.special)
        vocab = self.tok.get_vocab()
        self.token_bytes = np.zeros(1 + max(vocab.values()), np.int64)
        for t, i in vocab.items():
            self.token_bytes[i] = len(t.encode()) if t in special else len(t) if all(c in letters for c in t) else 0
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(i)}I", *i) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False) if (i := e.ids) is not None]

    def _ask_pieces(self, pieces: list[str]) -> list[bytes]:
        """As _ask, for pieces. Those of a blank and letters are laid end to end, JOINED at a time: the library
        cuts them at the blanks again, and the bytes that each token stands for tell where a piece ends."""
        out: list[bytes] = [b""] * len(pieces)
        word, plain = WORD.fullmatch, []
        for k, p in enumerate(pieces):
            if word(p):
                plain.append(k)
        rest = set(range(len(pieces))).difference(plain)
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            ids = np.array(self.tok.encode_batch_fast(["".join([pieces[k] for k in some])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.token_bytes[ids])
            want = np.cumsum([len(pieces[k].encode()) for k in some])
            cut = np.searchsorted(ends, want) + 1
            if cut[-1] != len(ids) or not np.array_equal(ends[cut - 1], want):
                rest.update(some)
                continue
            raw, a = ids.tobytes(), 0
            for k, b in zip(some, (cut * 4).tolist(), strict=True):
                out[k] = raw[a:b]
                a = b
        if rest:
            left = sorted(rest)
            for k, ids in zip(left, self._ask([pieces[k] for k in left]), strict=True):
                out[k] = ids
        return out

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of distinct pieces (UTF-8), from memory or the library."""
        known, older = self.known, self.older
        out = list(map(known.get, pieces))
        ask = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            if (ids := older.get(pieces[k])) is None:
                ask.append(k)
            else:
                out[k] = known[pieces[k]] = ids
        for k, ids in zip(ask, self._ask_pieces([pieces[k].decode() for k in ask]), strict=True):
            out[k] = ids
            if len(pieces[k]) <= 64:
                known[pieces[k]] = ids
        if len(known) > CACHE:
            self.older, self.known = known, {}
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = [k for k, t in enumerate(texts) if t and not OTHER.search(t) and not any(x in t for x in self.special)]
        for k, ids in zip(plain, encoded_latin([texts[k] for k in plain], self._ids_of) if plain else (), strict=True):
            out[k] = ids
        rest = [k for k in sorted(set(range(len(texts))).difference(plain)) if texts[k]]
        whole = [k for k in rest if any(x in texts[k] for x in self.special)]
        for k, ids in zip(whole, self._ask([texts[k] for k in whole]), strict=True):
            out[k] = ids
        cut = {k: [p.encode() for p in self.pieces(texts[k])] for k in set(rest).difference(whole)}
        names = list(set().union(*cut.values()))
        known = dict(zip(names, self._ids_of(names), strict=True))
        for k, c in cut.items():
            out[k] = b"".join(map(known.__getitem__, c))
        return out


_encoders: dict[str, LibraryEncoder] = {}


def encoder_of(path: str) -> LibraryEncoder:
    """One encoder for each worker process, which later tasks find warm."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


# ---- files


MANIFEST = "part long, seq long, path string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Encodes and writes all documents; returns the manifest (stored): a row for each file, with base, the ids before it."""
    spark, path = docs.sparkSession, path or default_path()
    prepare(spark)
    end = b"" if end_id is None else struct.pack("<I", end_id)
    folder = folder if "://" in folder else f"file://{folder}"

    def run(batches):
        encoder, part, seq = encoder_of(path), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush():
            name = f"{folder}/part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            starts = np.cumsum([0, *(len(x) // 4 for _, x in held)])
            put(name, encode_file([d for d, _ in held], starts, np.frombuffer(b"".join(x for _, x in held), "<u4")))
            return batch(["part", "seq", "path", "n_docs", "n_ids"], [part], [seq], [name], [len(held)], [int(starts[-1])])

        for b in batches:
            for k in range(0, b.num_rows, GROUP):
                part_of = b.slice(k, GROUP)
                for d, ids in zip(part_of.column(0).to_pylist(), encoder.encode(part_of.column(1).to_pylist()), strict=True):
                    if held and size + len(ids) > 4 * FILE_TOKENS:
                        yield flush()
                        seq, held, size = seq + 1, [], 0
                    held.append((d, ids + end))
                    size += len(ids) + len(end)
        if held:
            yield flush()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    # by the text's hash, too: one id with many rows goes to many tasks
    ordered = keyed.repartitionByRange(partitions(spark), "doc_id", "th").sortWithinPartitions("doc_id", "th", "text").select("doc_id", "text")
    files = stored(ordered.mapInArrow(run, MANIFEST), "token-manifest")
    # the driver adds up a number for each task; inside a task the files are in order
    parts, at = [], 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        parts.append((r.part, at))
        at += r.n
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(spark.createDataFrame(parts, "part long, start long"))
    return files.join(starts, "part").withColumn("base", F.col("start") + F.coalesce(before, F.lit(0))).drop("start")


def read_token_files(manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    spark = manifest.sparkSession
    prepare(spark)

    def make():
        def each(b):
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(fetch(path))
                raw, s = f.ids().astype("<u4"), f.starts
                crc = [zlib.crc32(raw[a:e]) for a, e in zip(s[:-1], s[1:], strict=True)]
                more = [pa.array([raw[a:e].astype(np.int32) for a, e in zip(s[:-1], s[1:], strict=True)], pa.list_(pa.int32()))] if with_ids else []
                yield batch(["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])], pa.array(f.doc_ids, pa.int64()), pa.array(s[:-1] + base), pa.array(np.diff(s)), pa.array(crc, pa.int64()), *more)

        return each

    spread = manifest.select("path", "base").repartition(partitions(spark), "path")
    return map_arrow(spread, make, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return read_token_files(write_token_files(docs, fresh_dir(spark, "token-files")))
