"""What the operators of this subpackage share: shared folders, worker paths, Arrow helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker gets at a time, at most.
BATCH_ROWS = 2_000
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Settings of workers' allocators: what a task has freed goes back to the system, and isn't kept for later tasks.
ALLOCATORS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "1000000", "MALLOC_TRIM_THRESHOLD_": "4000000"}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and make checkpoint() usable.

    The shared folder is the session's ``spark.checkpoint.dir``; only where it is
    unset (local tests) a temporary folder is made.
    """
    sc = spark.sparkContext
    have = sc.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    for name, value in ALLOCATORS.items():
        sc.environment.setdefault(name, value)
    sc.setCheckpointDir(shared_dir(spark))
    # whole texts may be long: smaller batches bound what a worker holds, besides Spark's bound on their bytes
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS or int(spark.conf.get(rows)) <= 0:
        spark.conf.set(rows, BATCH_ROWS)


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI or path."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="tamis-"))
    return _local[0]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path of this run below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """What runs inside leaves no shuffle files behind; the setting is the user's again afterwards."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def written(df: DataFrame, path: str, *parts: str) -> DataFrame:
    """Writes a Parquet table and reads it back; the shuffles that made it are freed."""
    with shuffles_freed(df.sparkSession):
        (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder; it survives lost executors."""
    return written(df, fresh_dir(df.sparkSession, name))


def dropped(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes stored tables (or folders) that nothing reads any more."""
    sc = spark.sparkContext
    for t in tables:
        for path in {t} if isinstance(t, str) else {f.rpartition("/")[0] for f in t.inputFiles()}:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """A worker's way to a path of the shared folder; s3a is Hadoop's name of s3."""
    return pafs.FileSystem.from_uri((path if "://" in path else f"file://{path}").replace("s3a://", "s3://", 1))


def put(path: str, data: bytes) -> None:
    """Writes a file of the shared folder."""
    fs, at = filesystem(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(data)


def fetch(path: str) -> bytes:
    fs, at = filesystem(path)
    with fs.open_input_stream(at) as f:
        return f.readall()


def fetch_table(path: str) -> pa.Table | None:
    """A worker's way to a Parquet folder of the shared folder; None if it isn't there."""
    fs, at = filesystem(path)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.is_file and f.base_name.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read() for f in sorted(files)]) if files else None


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions, which the cluster sizes by its input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with state made once per task: ``make()`` returns the batch function."""

    def run(batches):
        each = make()
        for b in batches:
            if b.num_rows:
                yield from each(b)

    return df.mapInArrow(run, schema)


def batch(names: list[str], *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of df has it in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def schema_of(df: DataFrame) -> str:
    """The columns of df as DDL, whatever their names."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def named(name: str):
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_bytes(name: str = "text"):
    """A text column as UTF-8 bytes: no decoding between the JVM and Python."""
    return F.col(name).cast("binary").alias(name)
