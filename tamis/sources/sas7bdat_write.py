"""Writes small SAS7BDAT files: numbers and text, plain or compressed. For tests and examples; rows are held in memory."""

from __future__ import annotations

import datetime as dt
import math
import struct

from .sas7bdat import COLUMN_ATTRS, COLUMN_NAME, COLUMN_SIZE, COLUMN_TEXT, DATA, FORMAT, MAGIC, META, MIX, ROW_SIZE

#: Bytes that a name takes in the file.
NAME = 32


def rle(row: bytes) -> bytes:
    out, at = b"", 0
    while at < len(row):
        n = 1
        while at + n < len(row) and row[at + n] == row[at] and n < 17:
            n += 1
        if n >= 3 and row[at] in (0, 0x20):
            out += bytes([(0xF0 if row[at] == 0 else 0xE0) | n - 2])
        else:
            n = 1
            out += bytes([0x80, row[at]])
        at += n
    return out


def rdc(row: bytes) -> bytes:
    items, at = [], 0
    while at < len(row):
        n = 1
        while at + n < len(row) and row[at + n] == row[at] and n < 18:
            n += 1
        if n >= 3:
            items.append((1, bytes([n - 3, row[at]])))
        else:
            n = 1
            items.append((0, row[at : at + 1]))
        at += n
    out = b""
    for k in range(0, len(items), 16):
        some = items[k : k + 16]
        out += struct.pack(">H", sum(bit << 15 - j for j, (bit, _) in enumerate(some))) + b"".join(x for _, x in some)
    return out


def sas_file(columns, rows, *, wide=False, order="<", compression="", page=4096, mix=0, count=None, encoding=20, system="Linux"):
    """The bytes of a file of rows (bytes, laid out as columns: name, width, 1 for a number or 2 for text, format). mix: rows that share the page of the metadata."""
    word, front = (8, 40) if wide else (4, 24)

    def integer(v):
        return struct.pack(order + ("Q" if wide else "I"), v)

    def sig(v):
        low = struct.pack(order + "I", v)
        if not wide:
            return low
        return integer(v | 0xFFFFFFFF << 32) if v >= 0xFFFFF000 and v != FORMAT or v == FORMAT else low + bytes(4)

    width = sum(c[1] for c in columns)
    size = bytearray(808 if wide else 480)
    size[: len(sig(ROW_SIZE))] = sig(ROW_SIZE)
    for k, v in ((5, width), (6, len(rows) if count is None else count), (9, len(columns)), (10, 0), (15, mix)):
        size[k * word : (k + 1) * word] = integer(v)
    names = b"".join(c[0].encode().ljust(NAME) for c in columns)
    formats = b"".join(c[3].encode().ljust(12) for c in columns)
    literal = {"": b" " * 8, "rle": b"SASYZCRL", "rdc": b"SASYZCR2"}[compression]
    body = bytes(10) + literal + bytes(6) + names + formats
    body = struct.pack(order + "H", len(body) + 2) + body
    base = 26
    text = sig(COLUMN_TEXT) + body + bytes(-len(body) % 8)
    name = sig(COLUMN_NAME) + bytes(8) + b"".join(struct.pack(order + "4H", 0, base + NAME * k, len(c[0]), 0) for k, c in enumerate(columns)) + bytes(word + 4)
    attr, at = sig(COLUMN_ATTRS) + bytes(8), 0
    for _, w, kind, _ in columns:
        attr += integer(at) + struct.pack(order + "IHBB", w, 0, kind, 0)
        at += w
    attr += bytes(word + 4)
    subs = [(bytes(size), 0, 0), (sig(COLUMN_SIZE) + integer(len(columns)) + bytes(word), 0, 0), (text, 0, 1), (name, 0, 1), (attr, 0, 1)]
    for k, c in enumerate(columns):
        f = bytearray(sig(FORMAT) + bytes(60))
        struct.pack_into(order + "6H", f, 22 + 3 * word, 0, base + NAME * len(columns) + 12 * k, len(c[3]), 0, 0, 0)
        subs.append((bytes(f), 0, 0))

    def page_of(kind, blocks, subs, plain=b""):
        out = bytearray(page)
        struct.pack_into(order + "HHH", out, front - 8, kind, blocks, len(subs))
        end = page
        for k, (data, compressed, what) in enumerate(subs):
            end -= len(data)
            out[end : end + len(data)] = data
            p = front + k * 3 * word
            out[p : p + 2 * word + 2] = integer(end) + integer(len(data)) + bytes([compressed, what])
        start = -(-(front + len(subs) * 3 * word) // 8) * 8
        assert start + len(plain) <= end
        out[start : start + len(plain)] = plain
        return bytes(out)

    if compression:
        pages, pack = [page_of(META, len(subs), subs)], rle if compression == "rle" else rdc
        packed = [(p, 4, 1) if len(p := pack(r)) < width else (r, 0, 1) for r in rows]
        pages += [page_of(META, 20, packed[k : k + 20]) for k in range(0, len(packed), 20)]
    else:
        pages, rest = [page_of(MIX if mix else META, len(subs) + mix, subs, b"".join(rows[:mix]))], rows[mix:]
        each = (page - front) // width
        pages += [page_of(DATA, len(rest[k : k + each]), [], b"".join(rest[k : k + each])) for k in range(0, len(rest), each)]
    head = bytearray(1024)
    head[12:32] = MAGIC
    head[32], head[35], head[37], head[70] = 0x33 if wide else 0, 0x33 if wide else 0, 1 if order == "<" else 0, encoding
    head[84:92], head[92:100] = b"SAS FILE", b"T       "
    pad = 4 if wide else 0
    head[272 + 2 * pad : 288 + 2 * pad] = system.encode().ljust(16, b"\0")
    struct.pack_into(order + "II", head, 196 + pad, 1024, page)
    head[204 + pad : 204 + pad + word] = integer(len(pages))
    return bytes(head) + b"".join(pages)


def number(v, width, order):
    raw = struct.pack(order + "d", v)
    return raw[8 - width :] if order == "<" else raw[:width]


def cell(v, column: tuple[str, int, int, str], order: str) -> bytes:
    """A value as its column has it: text padded, dates as days and timestamps as seconds since 1960, null as a missing number."""
    _, width, kind, _ = column
    if kind == 2:
        return (v or "").encode()[:width].ljust(width)
    if isinstance(v, dt.datetime):
        v = (v - dt.datetime(1960, 1, 1)) / dt.timedelta(seconds=1)
    elif isinstance(v, dt.date):
        v = (v - dt.date(1960, 1, 1)).days
    return number(math.nan if v is None else float(v), width, order)


def written(columns: list[tuple[str, int, int, str]], rows, order: str = "<", **how) -> bytes:
    """A file of rows of values."""
    return sas_file(columns, [b"".join(cell(v, c, order) for v, c in zip(r, columns, strict=True)) for r in rows], order=order, **how)
