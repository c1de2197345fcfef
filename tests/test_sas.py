"""SAS7BDAT files made here, read by the data source and by pandas."""

import datetime as dt
import math
import struct

import pandas as pd
import pytest

from tamis.sources import sas7bdat as sas
from tamis.sources import sas7bdat_write as write
from tamis.sources import tables

COLUMNS = [("n", 8, 1, ""), ("short", 4, 1, "BEST"), ("day", 8, 1, "DATE"), ("at", 8, 1, "DATETIME"), ("clock", 8, 1, "TIME"), ("txt", 12, 2, "$")]


def sas_file(path, rows, **how):
    path.write_bytes(write.sas_file(COLUMNS, rows, **how))
    return str(path)


def rows_for(n, order):
    out, expected = [], []
    for k in range(n):
        day, at, clock = 20_000 + k, 1.9e9 + k + 0.5, 60.0 * k
        gone = k % 7 == 3
        txt = "" if k % 5 == 4 else f"ä{k}" if k % 2 else "x" * 12
        numeric = [math.nan if gone else k / 8, float(k), float(day), at, clock]
        out.append(b"".join(write.number(v, c[1], order) for v, c in zip(numeric, COLUMNS, strict=False)) + txt.encode().ljust(12))
        expected.append((None if gone else k / 8, float(k), dt.date(1960, 1, 1) + dt.timedelta(day), dt.datetime(1960, 1, 1) + dt.timedelta(seconds=at), dt.timedelta(seconds=clock), txt or None))
    return out, expected


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", ["", "rle", "rdc"])
def test_every_layout(tmp_path, wide, order, compression):
    rows, expected = rows_for(200, order)
    path = sas_file(tmp_path / "t.sas7bdat", rows, wide=wide, order=order, compression=compression)
    reader = sas.SasReader(path)
    got = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert got == expected
    other = pd.read_sas(path, encoding="utf-8")
    assert list(other.columns) == [c[0] for c in COLUMNS] == tables.column_names(None, path)
    assert len(other) == 200 and other["n"].isna().tolist() == [e[0] is None for e in expected]
    assert other["short"].tolist() == [e[1] for e in expected]
    assert [None if isinstance(x, float) else x for x in other["txt"]] == [e[5] for e in expected]
    assert [d.date() for d in other["day"]] == [e[2] for e in expected]


def test_spark_reads_and_converts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sas, "PARTITION_BYTES", 4096)
    rows, expected = rows_for(300, "<")
    path = sas_file(tmp_path / "t.sas7bdat", rows, wide=True)
    df = tables.read(spark, path)
    assert [t for _, t in df.dtypes] == ["double", "double", "date", "timestamp_ntz", "interval day to second", "string"]
    assert df.rdd.getNumPartitions() > 2
    assert sorted(map(tuple, df.collect()), key=lambda r: r[1]) == expected
    out = tables.convert(spark, path)
    assert out.endswith(".parquet") and spark.read.parquet(out).count() == 300
    out = tables.convert(spark, path, str(tmp_path / "u.csv"))
    assert spark.read.option("header", True).csv(out).count() == 300


def test_mix_page_and_row_count(tmp_path):
    rows, expected = rows_for(100, "<")
    path = sas_file(tmp_path / "t.sas7bdat", rows, mix=7, count=60)
    reader = sas.SasReader(path)
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column(1).to_pylist()]
    assert got == [float(k) for k in range(60)]


def test_missing_kinds_and_ranges():
    lay = sas.Layout(row=8)
    import numpy as np

    raw = [bytes([c]) + bytes(7) for c in b"._AZ"] + [bytes(8), struct.pack("<d", math.inf), struct.pack("<d", 1e18), struct.pack("<d", 41.9)]
    m = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 8)
    assert sas.column_of(lay, sas.Column("a", "double", 0, 8), m).to_pylist() == [None] * 4 + [0.0, math.inf, 1e18, 41.9]
    days = sas.column_of(lay, sas.Column("a", "date", 0, 8), m)
    assert days.null_count == 6 and days[7].as_py() == dt.date(1960, 2, 11)
    # a sentinel's byte in an ordinary number is no missing value
    assert sas.numbers(lay, np.frombuffer(b"." + struct.pack("<d", 3.0)[1:], np.uint8).reshape(1, 8))[1].tolist() == [False]


@pytest.mark.parametrize(
    ("data", "row"),
    [
        (bytes([0x00, 0]) + b"q" * 64, b"q" * 64), (bytes([0x10, 0]) + b"q" * 4160, b"q" * 4160), (b"\x20" + b"q" * 96, b"q" * 96), (bytes([0x41, 2]) + b"z", b"z" * 276),
        (bytes([0x50, 1]), b"@" * 18), (bytes([0x60, 1]), b" " * 18), (bytes([0x71, 1]), bytes(274)), (b"\x81ab", b"ab"), (b"\x90" + b"a" * 17, b"a" * 17),
        (b"\xa0" + b"a" * 33, b"a" * 33), (b"\xb0" + b"a" * 49, b"a" * 49), (b"\xc1k", b"kkkk"), (b"\xd0", b"@@"), (b"\xe0", b"  "), (b"\xf1", bytes(3)),
    ],
)
def test_rle_commands(data, row):
    assert sas.expand_rle(data, len(row)) == row


def test_rdc_commands_and_errors():
    assert sas.expand_rdc(b"\x80\x00" + bytes([0x02]) + b"a", 5) == b"aaaaa"
    assert sas.expand_rdc(b"\x80\x00" + bytes([0x11, 1]) + b"b", 36) == b"b" * 36
    assert sas.expand_rdc(b"\x10\x00abc" + bytes([0x30, 0]), 6) == b"abcabc"
    assert sas.expand_rdc(b"\x10\x00abc" + bytes([0x20, 0, 2]), 21) == b"abc" * 7
    for bad in (lambda: sas.expand_rle(b"\x30", 1), lambda: sas.expand_rle(b"\x85a", 6), lambda: sas.expand_rdc(b"\x80\x00\x50\x00", 5), lambda: sas.expand_rdc(b"", 1)):
        with pytest.raises(sas.BadCompression):
            bad()


def test_files_that_cannot_be_read(tmp_path):
    rows, _ = rows_for(3, "<")
    path = tmp_path / "t.sas7bdat"
    sas_file(path, rows)
    whole = path.read_bytes()
    for data, error in ((b"x" * 400, sas.NotSas), (whole[:100], sas.Truncated), (whole[:2000], sas.Truncated), (whole[:70] + b"\xfe" + whole[71:], sas.UnknownEncoding)):
        path.write_bytes(data)
        with pytest.raises(error):
            sas.read_layout(str(path))
    path.write_bytes(whole[:200] + (1 << 30).to_bytes(4, "little") + whole[204:])
    with pytest.raises(sas.BadPage):
        sas.read_layout(str(path))
    sas_file(path, [], count=0)
    with pytest.raises(sas.NoRows):
        sas.read_layout(str(path))


@pytest.mark.parametrize(("name", "kind"), [("Linux", "unix"), ("W32_10PRO", "windows"), ("AIX 64", "unix"), ("X64_SRV", "unknown"), ("", "unknown")])
@pytest.mark.parametrize("wide", [False, True])
def test_systems(tmp_path, name, kind, wide):
    assert sas.read_layout(sas_file(tmp_path / "t.sas7bdat", rows_for(3, "<")[0], wide=wide, system=name)).system == kind
