"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves hold rank and position of each adjacent pair; the root is the leftmost pair
of the lowest rank. A merge updates three leaves, each in logarithmic time, until no
pair can be merged. Pieces are cut by the vocabulary's own pattern. Pieces that a worker
hasn't met are merged together, a segment tree to a row of one array for those of up to
``WIDTHS[-1]`` bytes; a longer piece has a tree of its own. A worker remembers the ids of at
most ``CACHE`` pieces, and as many older ones.

Nulls encode as an empty text. Special tokens in a text become their ids, as the
tokenizers library does by default. Texts and pieces may be of any length; texts are cut into
pieces ``GROUP`` characters (or one text) at a time. Repeated rows are encoded one by one, ties
between pairs go to the leftmost, an empty table gives an empty result. doc_id and text are
read alone, so other columns' names can't clash.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, prepare, table

CACHE = 120_000
GROUP = 1_000_000
NO_PAIR = 1 << 62
#: Bytes of the pieces that are merged together, by the width of their trees; and what their leaves hold without a pair.
WIDTHS, NO_LEAF = (4, 8, 16, 32), np.int32(1 << 30)


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, the others count up from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


#: Where the standard pattern below cuts as the vocabulary's does: ASCII and the letters of Latin-1 and Latin Extended-A.
OTHER = re.compile("[^\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]")
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@functools.cache
def newer_characters() -> str:
    """Letters and numbers of the regex module's Unicode that the tokenizers library doesn't take for such: they are newer than its tables."""
    from tokenizers.pre_tokenizers import ByteLevel

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    cut, out = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str, []
    for kind, before in (("L", "a"), ("N", "1")):
        out += [c for c in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(c) == "Cn" and len(cut(before + c)) > 1]
    return "".join(out)


def ranges(characters: str) -> str:
    """A pattern's set of characters."""
    out: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out) + "]"


@functools.cache
def piece_cutter():
    """Text -> pieces by the vocabulary's pattern; plain Latin texts by an equal, faster one."""
    pattern, newer = piece_pattern(), newer_characters()
    general, latin, other = regex.compile(pattern).findall, LATIN.findall, OTHER.search
    if not newer:
        return lambda text: general(text) if other(text) else latin(text)
    strange = re.compile(ranges(newer)).search
    older = regex.compile(regex.sub(r"\\p\{[LN]\}", lambda m: f"[{m[0]}--{ranges(newer)}]", pattern), regex.V1).findall
    return lambda text: latin(text) if not other(text) else older(text) if strange(text) else general(text)


#: Classes of the bytes of plain Latin texts: what ends a text, letters (all bytes of longer characters are), digits, blanks, others.
END, LETTER, DIGIT, BLANK, SIGN = range(5)
CLASSES = np.full(256, SIGN, np.uint8)
CLASSES[0], CLASSES[[9, 10, 13, 32]], CLASSES[0x30:0x3A] = END, BLANK, DIGIT
CLASSES[0x41:0x5B] = CLASSES[0x61:0x7B] = CLASSES[0x80:] = LETTER


def latin_starts(b: np.ndarray) -> np.ndarray:
    """Where the pieces begin in the bytes of plain Latin texts, each closed by a zero byte (a piece of its own).

    A piece is a run of one class; a single blank character before a run that isn't blank goes with it
    if it is a space, and stands alone if not; 's, 't, 'm, 'd, 're, 've and 'll are pieces where a run begins with them.
    """
    kind = CLASSES[b]
    starts = np.concatenate(([True], kind[1:] != kind[:-1]))
    run = np.flatnonzero(starts)
    of, nxt = kind[run], np.append(run[1:], len(b))
    joins = np.zeros(len(run), bool)  # whose last byte is a space that goes with the next run
    blank = np.flatnonzero((of == BLANK) & (np.append(of[1:], END) != END))
    last = nxt[blank] - 1
    starts[last] = True
    space = b[last] == 32
    starts[nxt[blank[space]]] = False
    joins[blank[space]] = True
    quote = np.flatnonzero((of == SIGN) & (nxt - run == 1) & (np.append(of[1:], END) == LETTER) & ~np.append(False, joins[:-1]))
    at = run[quote][b[run[quote]] == 0x27]
    one, two = b[at + 1], b[np.minimum(at + 2, len(b) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (((one == 0x72) | (one == 0x76)) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
    for which, size in ((short, 2), (long, 3)):
        starts[at[which] + 1] = False
        starts[at[which] + size] = True
    return np.flatnonzero(starts)


def encoded_latin(texts: list[str], ids_of) -> list[bytes]:
    """The packed ids of plain Latin texts; ids_of(pieces) gives those of distinct pieces (UTF-8)."""
    raw = "\0".join([*texts, ""]).encode()
    starts = latin_starts(np.frombuffer(raw, np.uint8))
    ends = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32).tobytes())
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(raw)]).dictionary_encode()
    names, code = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
    stop = names.index(b"\0")
    packed = ids_of([*names[:stop], *names[stop + 1 :]])
    packed.insert(stop, b"")
    size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    flat, first = np.frombuffer(b"".join(packed), "<u4"), np.cumsum(size) - size
    count = size[code]
    upto = np.cumsum(count)
    out = flat[np.repeat(first[code] - (upto - count), count) + np.arange(upto[-1])].tobytes()
    cuts = (upto[code == stop] * 4).tolist()
    return [out[x:y] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)]


class PairTree:
    """Minimum segment tree over the pairs (rank, place) of a sequence of symbols."""

    def __init__(self, keys: list[int]):
        self.size = size = 1 << max(0, (len(keys) - 1).bit_length())
        self.node = node = [NO_PAIR] * size + keys + [NO_PAIR] * (size - len(keys))
        for k in range(size - 1, 0, -1):
            a, b = node[2 * k], node[2 * k + 1]
            node[k] = a if a < b else b

    def set(self, place: int, key: int) -> None:
        node, k = self.node, self.size + place
        node[k] = key
        while k > 1:
            k >>= 1
            a, b = node[2 * k], node[2 * k + 1]
            low = a if a < b else b
            if node[k] == low:
                return
            node[k] = low


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.single = [0] * 256
        for c, b in letters.items():
            self.single[b] = vocab[c]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.pieces = piece_cutter()
        self.cut = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # the pairs as arrays: names (first << 32 | second) in order, their ranks, and what a rank merges to
        order = sorted(self.pairs, key=lambda p: p[0] << 32 | p[1])
        self.pair_names = np.array([a << 32 | b for a, b in order] or [0], np.int64)
        self.pair_ranks = np.array([self.pairs[p][0] for p in order] or [NO_LEAF >> 5], np.int32)
        self.merged_to = np.zeros(1 + int(self.pair_ranks.max()), np.int32)
        for rank, to in self.pairs.values():
            self.merged_to[rank] = to

    def leaves(self, first: np.ndarray, second: np.ndarray, place) -> np.ndarray:
        """rank << 5 | place of pairs of symbols, NO_LEAF where they don't merge (or second is negative)."""
        name = first.astype(np.int64) << 32 | np.maximum(second, 0)
        at = np.minimum(np.searchsorted(self.pair_names, name), len(self.pair_names) - 1)
        return np.where((self.pair_names[at] == name) & (second >= 0), self.pair_ranks[at] << 5 | place, NO_LEAF).astype(np.int32)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The packed ids of pieces of at most ``width`` bytes: row i of the arrays is the tree of piece i."""
        rows, sizes = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        filled = np.arange(width) < sizes[:, None]
        symbols = np.full((rows, width + 1), -1, np.int32)
        symbols[:, :width][filled] = np.array(self.single, np.int32)[np.frombuffer(b"".join(pieces), np.uint8)]
        node = np.full((rows, 2 * width), NO_LEAF, np.int32)
        node[:, width : 2 * width - 1] = self.leaves(symbols[:, : width - 1], symbols[:, 1:width], np.arange(width - 1))
        for k in range(width - 1, 0, -1):
            np.minimum(node[:, 2 * k], node[:, 2 * k + 1], out=node[:, k])
        after = np.broadcast_to(np.arange(1, width + 2), (rows, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (rows, width + 1)).copy()
        on = np.flatnonzero(node[:, 1] < NO_LEAF)
        while len(on):
            low = node[on, 1]
            a, to = low & 31, self.merged_to[low >> 5]
            b = after[on, a]
            c = np.minimum(after[on, b], width)  # the symbol at the end is always -1
            symbols[on, a], symbols[on, b] = to, -1
            after[on, a], before[on, c] = c, a
            p = before[on, a]
            has = p >= 0
            node[on, width + b] = NO_LEAF
            node[on, width + a] = self.leaves(to, symbols[on, c], a)
            q, some = p[has], on[has]
            node[some, width + q] = self.leaves(symbols[some, q], to[has], q)
            for who, leaf in ((on, b), (on, a), (some, q)):
                k = leaf + width
                for _ in range(width.bit_length() - 1):
                    k = k >> 1
                    node[who, k] = np.minimum(node[who, 2 * k], node[who, 2 * k + 1])
            on = on[node[on, 1] < NO_LEAF]
        left = symbols >= 0
        raw, ends = symbols[left].astype("<u4").tobytes(), np.cumsum(left.sum(axis=1) * 4).tolist()
        return [raw[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_all(self, raw: list[bytes]) -> list[bytes]:
        """The packed ids of pieces (UTF-8)."""
        out: list[bytes] = [b""] * len(raw)
        sizes, low = np.fromiter(map(len, raw), np.int64, len(raw)), 0
        for width in WIDTHS:
            at = np.flatnonzero((sizes > low) & (sizes <= width)).tolist()
            for k, ids in zip(at, self.merge_rows([raw[k] for k in at], width) if at else (), strict=True):
                out[k] = ids
            low = width
        for k in np.flatnonzero(sizes > low).tolist():
            ids = self.merge(raw[k])
            out[k] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: merges the leftmost pair of the lowest rank until none is left."""
        symbols = [self.single[b] for b in piece]
        n, pairs = len(symbols), self.pairs
        if n < 2:
            return symbols
        bits = n.bit_length()

        def key(a: int, b: int) -> int:
            got = pairs.get((symbols[a], symbols[b]))
            return NO_PAIR if got is None else got[0] << bits | a

        tree = PairTree([key(k, k + 1) for k in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := tree.node[1]) != NO_PAIR:
            a = low & ((1 << bits) - 1)
            b = after[a]
            symbols[a] = pairs[symbols[a], symbols[b]][1]
            symbols[b] = -1
            after[a] = c = after[b]
            if b < n - 1:
                tree.set(b, NO_PAIR)
            if c < n:
                before[c] = a
                tree.set(a, key(a, c))
            else:
                tree.set(a, NO_PAIR)
            if before[a] >= 0:
                tree.set(before[a], key(before[a], a))
        return [s for s in symbols if s >= 0]

    def parts(self, text: str | None) -> list[str]:
        """The pieces of a text, and its special tokens."""
        if not text:
            return []
        if self.cut is None or not any(t in text for t in self.special):
            return self.pieces(text)
        return [p for part in self.cut.split(text) if part for p in ([part] if part in self.special else self.pieces(part))]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts, as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= GROUP):
                size += len(texts[end] or "")
                end += 1
            out += self._encode_group(texts[at:end])
            at = end
        return out

    def _ids_of(self, pieces: list) -> list[bytes]:
        """The packed ids of distinct pieces (UTF-8), from memory or merged."""
        known, older = self.known, self.older
        out = list(map(known.get, pieces))
        new = [k for k, ids in enumerate(out) if ids is None]
        ask = []
        for k in new:
            if (ids := older.get(pieces[k])) is None:
                ask.append(k)
            else:
                out[k] = known[pieces[k]] = ids
        for k, ids in zip(ask, self.merge_all([pieces[k] for k in ask]), strict=True):
            out[k] = ids
            if len(pieces[k]) <= 64:  # long pieces aren't kept
                known[pieces[k]] = ids
        if len(known) > CACHE:
            self.older, self.known = known, {}
        return out

    def _encode_group(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = [k for k, t in enumerate(texts) if t and not OTHER.search(t) and not any(x in t for x in self.special)]
        for k, ids in zip(plain, encoded_latin([texts[k] for k in plain], self._ids_of) if plain else (), strict=True):
            out[k] = ids
        rest = sorted(set(range(len(texts))).difference(plain))
        cut = [[p.encode() if p not in self.special else p for p in self.parts(texts[k])] for k in rest]
        names = list(set().union(*cut).difference(self.special))
        ids = dict(zip(names, self._ids_of(names), strict=True)) | {t: struct.pack("<I", i) for t, i in self.special.items()}
        for k, c in zip(rest, cut, strict=True):
            out[k] = b"".join(map(ids.__getitem__, c))
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def tokenised(docs: DataFrame, path: str | None = None, *, with_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 (and ids, if asked) to doc_id; whole texts."""
    spark, path = docs.sparkSession, path or default_path()
    prepare(spark)

    def make():
        codec = codec_of(path)

        def each(b):
            n, ids_sha, text_sha, raw = [], [], [], []
            for ids in codec.encode_all(b.column(1).to_pylist()):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                if with_ids:
                    raw.append(np.frombuffer(ids, "<u4").astype(np.int32))
            more = [pa.array(raw, pa.list_(pa.int32()))] if with_ids else []
            yield batch(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])], b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), *more)

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text")), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of an ``ids`` column; a null list gives a null text."""
    spark, path = ids.sparkSession, path or default_path()
    prepare(spark)

    def make():
        codec = codec_of(path)

        def each(b):
            out = [None if x is None else codec.decode(np.array(x, "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield batch(["doc_id", "text"], b.column(0), pa.array(out, pa.string()))

        return each

    return map_arrow(ids.select("doc_id", "ids"), make, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, text string")


_codecs: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """One codec for each worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents", "doc_id", "text"))
