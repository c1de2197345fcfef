"""Reading, writing and converting tables: CSV, Parquet, SAS7BDAT."""

from __future__ import annotations

import os

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sas7bdat

FORMATS = ("csv", "parquet", "sas7bdat")
INFER_ROWS = 10_000
ROW_GROUP = 100_000


def kind_of(path: str) -> str:
    got = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if got not in FORMATS:
        raise ValueError(f"Unsupported file format '{got}'. Supported: {', '.join(FORMATS)}")
    return got


def has_quoted_lines(spark: SparkSession, path: str) -> bool:
    """Whether a line of the file has an odd number of quotes, that is, a field with a line end."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def records(lines: list[str]) -> list[str]:
    """Lines, of which those inside an open quote are joined."""
    out, open_ = [], False
    for line in lines:
        if open_:
            out[-1] += "\n" + line
        else:
            out.append(line)
        open_ ^= line.count('"') % 2 == 1
    return out[:-1] if open_ and len(out) > 1 else out


def csv_schema(spark: SparkSession, path: str, rows: int = INFER_ROWS, *, lines: bool = False) -> T.StructType:
    """Inferred from the header and the first rows (0: all). Dates and times stay text. lines: fields may hold line ends."""
    options = {"header": "true", "inferSchema": "true", "preferDate": "false", "enforceSchema": "false", "escape": '"', "multiLine": str(lines).lower()}
    if rows:
        head = spark.read.text(path).limit(rows + 1)
        schema = _of_lines(spark, records([r.value for r in head.collect()]), options)
    else:
        schema = spark.read.options(**options).csv(path).schema
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else f.dataType) for f in schema])


def _of_lines(spark: SparkSession, lines: list[str], options: dict[str, str]) -> T.StructType:
    """The first rows only, at most as many as asked for."""
    return spark.read.options(**options).csv(spark.sparkContext.parallelize(lines, 1)).schema


def read(spark: SparkSession, path: str, infer_rows: int = INFER_ROWS, *, quoted_lines: bool | None = None, bad_cells: str = "error") -> DataFrame:
    """A table by its extension.

    CSV: empty cells are null. A cell that doesn't fit the type inferred from the first rows is
    an error when it is read, or null with ``bad_cells="null"``. Fields with line ends make a
    file unsplittable, so a scan looks for them first, unless quoted_lines says.
    """
    kind = kind_of(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        lines = has_quoted_lines(spark, path) if quoted_lines is None else quoted_lines
        mode = {"error": "FAILFAST", "null": "PERMISSIVE"}[bad_cells]
        return spark.read.schema(csv_schema(spark, path, infer_rows, lines=lines)).options(header=True, escape='"', multiLine=lines, mode=mode).csv(path)
    sas7bdat.register(spark)
    return spark.read.format("sas7bdat").load(path)


def column_names(spark: SparkSession, path: str) -> list[str]:
    """Without reading data: the schema alone (of SAS files the metadata pages)."""
    if kind_of(path) == "sas7bdat":
        return [c.name for c in sas7bdat.read_layout(path).columns]
    return read(spark, path, 100).columns


def target_preview(df: DataFrame, column: str, rows: int = 10_000) -> DataFrame:
    return df.select(column).limit(rows)


def stats(df: DataFrame) -> dict[str, float]:
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return {"rows": df.count(), "columns": len(df.columns), "mb": float(str(size)) / 1e6}


def parquet_rows(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count()


def write(df: DataFrame, path: str, *, mode: str = "overwrite", single_file: bool = False) -> None:
    """A folder of CSV or Parquet parts, by the path's extension; single_file: one file, written by one task."""
    kind = kind_of(path)
    if kind == "sas7bdat":
        raise ValueError("Unsupported output format 'sas7bdat'. Supported: csv, parquet")
    folder = f"{path}.parts" if single_file else path
    out = df.coalesce(1) if single_file else df
    if kind == "csv":
        times = [F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.DayTimeIntervalType) else F.col(f"`{f.name}`") for f in df.schema]
        out.select(*times).write.mode(mode).options(header=True, escape='"').csv(folder)
    else:
        out.write.mode(mode).option("compression", "snappy").option("parquet.block.row.count.limit", ROW_GROUP).parquet(folder)
    if single_file:
        sc = df.sparkSession.sparkContext
        at, to = (sc._jvm.org.apache.hadoop.fs.Path(p) for p in (folder, path))
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
        part = next(f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
        fs.delete(to, True)
        fs.rename(part, to)
        fs.delete(at, True)


def put(path: str, data: bytes) -> None:
    """Writes a file of bytes, wherever the path leads."""
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(data)


def output_path(path: str, suffix: str, extension: str | None = None) -> str:
    """``{stem}_{suffix}.{extension}`` beside the input; of SAS input Parquet is made."""
    stem, ext = os.path.splitext(path)
    ext = extension or ("parquet" if ext.lower() == ".sas7bdat" else ext.lstrip("."))
    return f"{stem}_{suffix}.{ext}"


def convert(spark: SparkSession, source: str, target: str | None = None, infer_rows: int = INFER_ROWS, *, by_extension: bool = False, fast: bool = False) -> str:
    """CSV to Parquet, Parquet to CSV, SAS to Parquet (CSV if the target says so); returns where it wrote.

    by_extension: the target's extension decides for every source. fast: the same plan; nothing is held in memory.
    """
    kind = kind_of(source)
    stem = os.path.splitext(source)[0]
    target = target or f"{stem}.{'csv' if kind == 'parquet' else 'parquet'}"
    if not by_extension:
        wanted = "csv" if kind == "parquet" or kind == "sas7bdat" and target.lower().endswith(".csv") else "parquet"
    else:
        wanted = kind_of(target)
    df = read(spark, source, infer_rows)
    if wanted == "csv":
        write(df, target) if target.lower().endswith(".csv") else df.write.mode("overwrite").options(header=True, escape='"').csv(target)
    else:
        df.write.mode("overwrite").option("compression", "snappy").option("parquet.block.row.count.limit", ROW_GROUP).parquet(target)
    return target
