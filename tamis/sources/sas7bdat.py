"""SAS7BDAT files as a Spark data source: ``spark.read.format("sas7bdat").load(path)``.

The driver reads the metadata pages and the header of every page; a partition is a range of
pages, whose rows tasks decode into Arrow batches of one page each. Columns of an uncompressed
page are cut out with numpy at once; compressed rows are expanded one by one.

Numbers are doubles; their display format makes them dates, timestamps (without zone,
milliseconds) or times (day-time intervals). The 28 kinds of missing numbers, NaN, empty text
and values out of range are null. Text loses trailing blanks. Rows beyond the file's own row
count are left out. There is no limit on rows or cells, as no task holds more than a page.
"""

from __future__ import annotations

import codecs
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the file format.
MAGIC = bytes.fromhex("c2ea8160b31411cfbd92080009c7318c181f1011")
META, DATA, MIX, AMD, META2, COMP = 0x0000, 0x0100, 0x0200, 0x0400, 0x4000, 0x9000
ROW_SIZE, COLUMN_SIZE, COLUMN_TEXT, COLUMN_NAME, COLUMN_ATTRS, FORMAT = 0xF7F7F7F7, 0xF6F6F6F6, 0xFFFFFFFD, 0xFFFFFFFF, 0xFFFFFFFC, 0xFFFFFBFE
COUNTS, COLUMN_LIST = 0xFFFFFC00, 0xFFFFFFFE
ENCODINGS = {
    0: "cp1252", 20: "utf-8", 28: "utf-8", 29: "cp1252", 33: "iso8859-2", 34: "iso8859-3", 35: "iso8859-4", 36: "iso8859-5", 37: "iso8859-6", 38: "iso8859-7", 39: "iso8859-8",
    40: "cp1254", 60: "cp1250", 61: "cp1251", 62: "cp1252", 63: "cp1253", 64: "cp1254", 65: "cp1255", 66: "cp1256", 67: "cp1257", 68: "cp1258", 123: "big5", 125: "gbk", 134: "euc_jp", 138: "cp932", 140: "cp949",
}
DATETIMES = {"DATETIME", "DTDATE", "DTMONYY", "DTWKDATX", "E8601DT", "B8601DT", "NLDATM", "DATEAMPM"}
DATES = {"DATE", "DDMMYY", "MMDDYY", "YYMMDD", "YYMMDDD", "JULIAN", "MONYY", "YYMON", "MONNAME", "WEEKDATE", "WEEKDAY", "QTR", "YEAR", "E8601DA", "B8601DA", "EURDFDD"}
TIMES = {"TIME", "TOD", "HHMM", "MMSS", "E8601TM", "B8601TM", "TIMEAMPM", "HOUR"}
MISSING = np.array([ord(c) for c in "._ABCDEFGHIJKLMNOPQRSTUVWXYZ"], np.uint64)
EPOCH_DAYS, EPOCH_SECONDS = 3653, 315_619_200
MOST_PAGE, MOST_ROW = 256 << 20, 1 << 20
#: Bytes of pages that a partition has, about.
PARTITION_BYTES = 64 << 20


class SasError(ValueError):
    """A file that can't be read."""


class NotSas(SasError):
    """No SAS7BDAT file."""


class Truncated(SasError):
    """The file ends within a header or page."""


class NoRows(SasError):
    """The file has no rows."""


class UnknownEncoding(SasError):
    """An encoding without a name."""


class NoColumns(SasError):
    """The file has no columns."""


class BadPage(SasError):
    """A page size that no file has."""


class BadRow(SasError):
    """A row length that no file has."""


class BadSubheader(SasError):
    """A subheader that refers to what isn't there."""


class BadCompression(SasError):
    """A compressed row that can't be expanded."""


@dataclass
class Column:
    name: str
    kind: str
    at: int
    width: int
    format: str = ""
    label: str = ""


@dataclass
class Layout:
    wide: bool = False
    order: str = "<"
    encoding: str = "cp1252"
    header: int = 0
    page: int = 0
    pages: int = 0
    name: str = ""
    system: str = "unknown"
    row: int = 0
    rows: int = 0
    mix_rows: int = 0
    n_columns: int = 0
    compression: str = ""
    columns: list[Column] = field(default_factory=list)

    @property
    def word(self) -> int:
        return 8 if self.wide else 4

    @property
    def front(self) -> int:
        """Where a page's pointers, or its rows, begin."""
        return 40 if self.wide else 24

    def short(self, data: bytes, at: int) -> int:
        return struct.unpack_from(self.order + "H", data, at)[0]

    def integer(self, data: bytes, at: int) -> int:
        return struct.unpack_from(self.order + ("Q" if self.wide else "I"), data, at)[0]


def kind_of_format(text: str) -> str:
    """double, date, timestamp or time, by a number's display format."""
    f = text.strip().rstrip("0123456789.").upper()
    return "timestamp" if f.startswith("DT") or f in DATETIMES else "date" if f in DATES else "time" if f in TIMES else "double"


def opened(path: str):
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))
    return fs.open_input_file(at)


def exactly(f, at: int, n: int) -> bytes:
    data = f.read_at(n, at)
    if len(data) < n:
        raise Truncated(f"file ends at byte {at + len(data)}, {at + n} needed")
    return data


def read_header(f) -> Layout:
    start = exactly(f, 0, 304)
    if start[12:32] != MAGIC:
        raise NotSas("not a SAS7BDAT file")
    lay = Layout(wide=start[32] == 0x33, order="<" if start[37] == 1 else ">")
    pad = 4 if start[35] == 0x33 else 0
    if start[70] not in ENCODINGS:
        raise UnknownEncoding(f"unknown encoding {start[70]}")
    lay.encoding = ENCODINGS[start[70]]
    lay.header, lay.page = struct.unpack_from(lay.order + "II", start, 196 + pad)
    lay.pages = lay.integer(start, 204 + pad)
    lay.name = text_of(start[92:156], lay.encoding)
    lay.system = system_of(text_of(start[272 + pad + (4 if lay.wide else 0) :][:16], "latin-1"))
    if not 0 < lay.page <= MOST_PAGE:
        raise BadPage(f"page size {lay.page}")
    return lay


# What names of operating systems hold.
SYSTEMS = {"windows": ("WIN", "W32"), "unix": ("UNIX", "LINUX", "AIX", "SUN", "HP-UX")}


def system_of(name: str) -> str:
    """The kind of operating system that wrote the file: windows, unix or unknown."""
    return next((kind for kind, parts in SYSTEMS.items() if any(p in name.upper() for p in parts)), "unknown")


def text_of(raw: bytes, encoding: str) -> str:
    return codecs.decode(raw, encoding, "replace").strip("\0 ")


def pointers(lay: Layout, page: bytes, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(offset, length, compression, type) of a page's subheaders."""
    size = 3 * lay.word
    for at in range(lay.front, lay.front + n * size, size):
        if at + size > len(page):
            raise Truncated("subheader pointers exceed the page")
        yield lay.integer(page, at), lay.integer(page, at + lay.word), page[at + 2 * lay.word], page[at + 2 * lay.word + 1]


def page_head(lay: Layout, page: bytes) -> tuple[int, int, int]:
    """Type, blocks and subheaders of a page."""
    return struct.unpack_from(lay.order + "HHH", page, lay.front - 8)


def read_layout(path: str) -> Layout:
    """Header and columns; stops once all columns are known, or at the first page of data."""
    with opened(path) as f:
        lay = read_header(f)
        texts: list[bytes] = []
        names, attrs, formats = [], [], []
        for k in range(lay.pages):
            page = exactly(f, lay.header + k * lay.page, lay.page)
            kind, _, n = page_head(lay, page)
            if kind in (META, MIX, AMD, META2):
                for at, size, compression, _ in pointers(lay, page, n):
                    if size and not compression:
                        if at + size > len(page):
                            raise Truncated("a subheader exceeds its page")
                        _subheader(lay, page[at : at + size], texts, names, attrs, formats)
            if kind in (DATA, MIX) or lay.n_columns and min(len(names), len(attrs), len(formats)) >= lay.n_columns:
                break

    def text(where) -> str:
        block, at, size = where
        return text_of(texts[block][at : at + size], lay.encoding) if block < len(texts) else ""

    for where in [*names, *(x for f in formats for x in f)]:
        if where[2] and texts and where[0] >= len(texts):
            raise BadSubheader(f"text block {where[0]} of {len(texts)}")
    for k, (name, (at, width, numeric)) in enumerate(zip(names, attrs, strict=False)):
        shown, label = map(text, formats[k]) if k < len(formats) else ("", "")
        lay.columns.append(Column(text(name), kind_of_format(shown) if numeric else "string", at, width, shown, label))
    if not lay.rows:
        raise NoRows("the file has no rows")
    if not lay.columns:
        raise NoColumns("the file has no columns")
    if not 0 < lay.row <= MOST_ROW:
        raise BadRow(f"row length {lay.row}")
    return lay


def signature(lay: Layout, data: bytes, at: int) -> int:
    what = struct.unpack_from(lay.order + "I", data, at)[0]
    if lay.wide and lay.order == ">" and what == COLUMN_NAME:
        what = struct.unpack_from(lay.order + "I", data, at + 4)[0]
    return what


def _subheader(lay: Layout, sub: bytes, texts: list, names: list, attrs: list, formats: list) -> None:
    word = lay.word
    if len(sub) < word:
        return
    what = signature(lay, sub, 0)
    if what == ROW_SIZE:
        lay.row, lay.rows, lay.mix_rows = (lay.integer(sub, k * word) for k in (5, 6, 15))
    elif what == COLUMN_SIZE:
        lay.n_columns = lay.integer(sub, word)
    elif what == COLUMN_TEXT:
        if not texts:
            lay.compression = "rle" if b"SASYZCRL" in sub else "rdc" if b"SASYZCR2" in sub else ""
        texts.append(sub[word:])
    elif what == COLUMN_NAME:
        most = (len(sub) - 2 * word - 12) // 8
        for k in range(min(most, lay.n_columns - len(names)) if lay.n_columns else most):
            names.append(struct.unpack_from(lay.order + "HHH", sub, word + 8 + 8 * k))
    elif what == COLUMN_ATTRS:
        step = word + 8
        most = (len(sub) - 2 * word - 12) // step
        for k in range(min(most, lay.n_columns - len(attrs)) if lay.n_columns else most):
            at = word + 8 + step * k
            attrs.append((lay.integer(sub, at), struct.unpack_from(lay.order + "I", sub, at + word)[0], sub[at + word + 6] == 1))
    elif what == FORMAT and len(sub) >= 34 + 3 * word:
        v = struct.unpack_from(lay.order + "6H", sub, 22 + 3 * word)
        formats.append((v[:3], v[3:]))


# ---- compressed rows


def expand_rle(data: bytes, size: int) -> bytes:
    """Run-length commands: the high four bits say what, the low four and maybe a byte how often."""
    out, at = bytearray(), 0
    #: command: (takes a count byte, least count, fill: None copies, -1 takes a byte)
    plan = {0x0: (1, 64, None), 0x1: (1, 64 + 4096, None), 0x2: (0, 96, None), 0x4: (1, 18, -1), 0x5: (1, 17, 0x40), 0x6: (1, 17, 0x20), 0x7: (1, 17, 0), 0x8: (0, 1, None), 0x9: (0, 17, None), 0xA: (0, 33, None), 0xB: (0, 49, None), 0xC: (0, 3, -1), 0xD: (0, 2, 0x40), 0xE: (0, 2, 0x20), 0xF: (0, 2, 0)}
    try:
        while len(out) < size:
            what, n = data[at] >> 4, data[at] & 15
            at += 1
            if what not in plan:
                raise BadCompression(f"unknown command {what} at byte {at - 1}")
            counted, least, fill = plan[what]
            if counted:
                n, at = n * 256 + data[at], at + 1
            n += least
            if fill is None:
                if at + n > len(data):
                    raise BadCompression("a compressed row ends early")
                out += data[at : at + n]
                at += n
            else:
                if fill < 0:
                    fill, at = data[at], at + 1
                out += bytes([fill]) * n
    except IndexError:
        raise BadCompression("a compressed row ends early") from None
    if len(out) != size:
        raise BadCompression(f"a row has {len(out)} bytes, not {size}")
    return bytes(out)


def expand_rdc(data: bytes, size: int) -> bytes:
    """Sixteen control bits announce literals (0) and commands (1): runs, and copies of what came before."""
    out, at, bits, left = bytearray(), 0, 0, 0
    try:
        while len(out) < size:
            if not left:
                bits, left, at = data[at] << 8 | data[at + 1], 16, at + 2
            left -= 1
            if not bits >> left & 1:
                out.append(data[at])
                at += 1
                continue
            what, n = data[at] >> 4, data[at] & 15
            at += 1
            if what == 0:
                out += bytes([data[at]]) * (n + 3)
                at += 1
                continue
            if what == 1:
                out += bytes([data[at + 1]]) * (n + (data[at] << 4) + 19)
                at += 2
                continue
            back, at = n + 3 + (data[at] << 4), at + 1
            if what == 2:
                what, at = data[at] + 16, at + 1
            if back > len(out):
                raise BadCompression("a copy from before the row")
            for _ in range(what):
                out.append(out[-back])
    except IndexError:
        raise BadCompression("a compressed row ends early") from None
    if len(out) != size:
        raise BadCompression(f"a row has {len(out)} bytes, not {size}")
    return bytes(out)


# ---- rows


def plain_row(lay: Layout, compression: int, row: int, n: int) -> bool:
    """Whether a pointer may be that of a row which compression wouldn't make smaller."""
    return compression == 0 and row == 1 and n == lay.row


def packed_rows(lay: Layout, page: bytes, subheaders: int) -> list[tuple[int, int]]:
    known = {ROW_SIZE, COLUMN_SIZE, COLUMN_TEXT, COLUMN_NAME, COLUMN_ATTRS, FORMAT, COUNTS, COLUMN_LIST}
    out = []
    for at, n, compression, row in pointers(lay, page, subheaders):
        if row == 1 and n and at + n <= lay.page and (compression > 1 or plain_row(lay, compression, row, n) and (n < lay.word or signature(lay, page, at) not in known)):
            out.append((at, n))
    return out


def plain_rows(lay: Layout, head: bytes) -> tuple[int, int]:
    """Where the rows of a page of an uncompressed file start, and how many there are."""
    kind, blocks, subheaders = page_head(lay, head)
    start, n = lay.front, 0
    if kind == DATA:
        n = blocks
    elif kind == MIX:
        start = -(-(lay.front + subheaders * 3 * lay.word) // 8) * 8
        n = min(max(0, blocks - subheaders), lay.mix_rows)
    return start, max(0, min(n, (lay.page - start) // lay.row))


def rows_of(lay: Layout, page: bytes, most: int) -> np.ndarray:
    """At most so many of a page's rows, as a matrix of bytes."""
    if not lay.compression:
        start, n = plain_rows(lay, page)
        n = min(n, most)
        return np.frombuffer(page, np.uint8, n * lay.row, start).reshape(n, lay.row)
    kind, _, subheaders = page_head(lay, page)
    found = packed_rows(lay, page, subheaders)[:most] if kind in (META, MIX, AMD, META2) else []
    expand = expand_rle if lay.compression == "rle" else expand_rdc
    made = [page[a : a + n] if n == lay.row else expand(page[a : a + n], lay.row) for a, n in found]
    return np.frombuffer(b"".join(made), np.uint8).reshape(len(made), lay.row)


def counted(lay: Layout, f, k: int) -> int:
    """The rows of page k: from its header and pointers, unless some pointer doesn't tell a row from metadata."""
    at = lay.header + k * lay.page
    head = exactly(f, at, lay.front)
    kind, _, subheaders = page_head(lay, head)
    if not lay.compression:
        return plain_rows(lay, head)[1]
    if kind not in (META, MIX, AMD, META2):
        return 0
    head = exactly(f, at, min(lay.page, lay.front + subheaders * 3 * lay.word))
    if any(plain_row(lay, c, row, n) for _, n, c, row in pointers(lay, head, subheaders)):
        head = exactly(f, at, lay.page)
    return len(packed_rows(lay, head, subheaders))


def numbers(lay: Layout, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and which are null; short numbers keep their most significant bytes."""
    n, w = raw.shape
    full = np.zeros((n, 8), np.uint8)
    if lay.order == "<":
        full[:, 8 - w :] = raw
    else:
        full[:, :w] = raw
    value = full.view(lay.order + "f8").ravel().astype(np.float64)
    bits = full.view(lay.order + "u8").ravel().astype(np.uint64)
    return value, np.isnan(value) | np.isin(bits, MISSING) if w else np.ones(n, bool)


def column_of(lay: Layout, c: Column, rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows[:, c.at : c.at + min(c.width, 8)] if c.kind != "string" else rows[:, c.at : c.at + c.width])
    if c.kind == "string":
        w = raw.shape[1]
        data, decode = raw.tobytes(), codecs.getdecoder(lay.encoding)
        return pa.array([decode(data[k : k + w], "replace")[0].rstrip() or None for k in range(0, len(data), w)] if w else [None] * len(rows), pa.string())
    value, null = numbers(lay, raw)
    if c.kind == "double":
        return pa.array(value, mask=null)
    scaled = {"date": value, "timestamp": (value - EPOCH_SECONDS) * 1000.0, "time": value * 1e6}[c.kind]
    # days fit 32 bits, milliseconds and microseconds 64 bits of microseconds
    low, high = {"date": (-(2.0**31) + EPOCH_DAYS, 2.0**31 - 1 + EPOCH_DAYS), "timestamp": (-9.2e15, 9.2e15), "time": (-9.2e18, 9.2e18)}[c.kind]
    null |= ~((scaled >= low) & (scaled <= high))
    whole = np.trunc(np.where(null, 0.0, scaled)).astype(np.int64)
    if c.kind == "date":
        return pa.array((whole - EPOCH_DAYS * ~null).astype(np.int32), pa.int32(), mask=null).cast(pa.date32())
    return pa.array(whole * 1000 if c.kind == "timestamp" else whole, pa.int64(), mask=null).cast(pa.timestamp("us") if c.kind == "timestamp" else pa.duration("us"))


SPARK_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "time": T.DayTimeIntervalType(0, 3)}


@dataclass
class Pages(InputPartition):
    first: int
    last: int
    rows: int


class SasReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.lay = path, read_layout(path)

    def partitions(self) -> list[Pages]:
        lay, step = self.lay, max(1, PARTITION_BYTES // self.lay.page)
        parts, left = [], lay.rows
        with opened(self.path) as f:
            for a in range(0, lay.pages, step):
                b = min(lay.pages, a + step)
                rows = min(left, sum(counted(lay, f, k) for k in range(a, b)))
                left -= rows
                if rows:
                    parts.append(Pages(a, b, rows))
        return parts

    def read(self, part: Pages) -> Iterator[pa.RecordBatch]:
        lay, left = self.lay, part.rows
        with opened(self.path) as f:
            for k in range(part.first, part.last):
                if left <= 0:
                    return
                rows = rows_of(lay, exactly(f, lay.header + k * lay.page, lay.page), left)
                if len(rows):
                    left -= len(rows)
                    yield pa.RecordBatch.from_arrays([column_of(lay, c, rows) for c in lay.columns], names=[c.name for c in lay.columns])


class SasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sas7bdat"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, SPARK_TYPES[c.kind]) for c in read_layout(self.options["path"]).columns])

    def reader(self, schema: T.StructType) -> SasReader:
        return SasReader(self.options["path"])


def register(spark) -> None:
    """Makes the format known; the code travels with the plan, so workers needn't have this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(SasSource)
