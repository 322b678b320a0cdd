"""What the operators of this subpackage share: the shared folder, staged tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at a time inside a Python worker, so that memory follows the rows and not the Arrow batch.
SLICE_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master only, a temporary one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside, without a path of their own, are deleted in the end; what is wanted later is written before that."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str, path: str | None = None, level: int = 3, page: int = 1 << 20, file_rows: int = 0) -> DataFrame:
    """Write df as Parquet in the shared folder, compressed by zstd at the given level in pages of about the given bytes, and read it again: cuts the lineage, survives lost executors.

    file_rows: rows of a file at most, 0 for any number.
    """
    spark = df.sparkSession
    if not path:
        path = new_path(spark, name)
        for held in _SCRATCH[-1:]:
            held.append(path)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", page).option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(spark, folder)


def file_groups(df: DataFrame, least: int, most: int) -> list[DataFrame]:
    """The rows of a staged table in `most` tables at most, each of whole files of `least` bytes together, but for the last and where files are larger."""
    spark, files = df.sparkSession, []
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files += [(x.getPath().toString(), x.getLen()) for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if x.getPath().getName().endswith(".parquet")]
    each, before, groups = max(least, -(-sum(n for _, n in files) // most)), 0, {}
    for path, n in files:
        groups.setdefault(before // each, []).append(path)
        before += n
    return [spark.read.schema(df.schema).parquet(*paths) for paths in groups.values()] if len(groups) > 1 else [df]


def text_or_empty(df: DataFrame, text_col: str = "text"):
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of the given numbers of bytes that lie one after the other in data."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    wide = offsets[-1] >= 1 << 31
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype("int64" if wide else "int32")), pa.py_buffer(np.ascontiguousarray(data))])


def keep_rows(df: DataFrame, make: Callable[[], Callable[[pa.Array], np.ndarray]], cut: Callable, text_col: str = "text") -> DataFrame:
    """The rows of df whose text make()'s function keeps, all columns as they are; nothing is shuffled."""

    def run(batches):
        keep = make()
        for part in cut(batches, text_col):
            yield part.filter(pa.array(keep(part[text_col])))

    return df.mapInArrow(run, df.schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, cut: Callable = slices) -> DataFrame:
    """mapInArrow over slices. make() builds a function on the executor, once a task: slice -> dict of output columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        each = make()
        for part in cut(batches):
            out = each(part)
            yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)
