"""What the operators of this package share: flat text buffers, staging, small column rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import checkpoint_folder

#: Bounds of what one Arrow batch brings to a Python worker.
BATCH_ROWS = 2000
BATCH_BYTES = "16m"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by rows and bytes, so that very long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_COLLECTING: list[list[str]] = []


@contextmanager
def collecting(paths: list[str]):
    """Note in ``paths`` what is staged inside, for a later ``release``."""
    _COLLECTING.append(paths)
    try:
        yield
    finally:
        _COLLECTING.remove(paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that no frame still to be computed reads."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write an intermediate to the shared folder and read it back: it is computed once and outlives lost executors."""
    path = f"{checkpoint_folder(df.sparkSession)}/llm/{uuid.uuid4().hex}"
    for paths in _COLLECTING:
        paths.append(path)
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(column: pa.Array) -> list[str]:
    """Python strings of a column (null: empty)."""
    return ["" if x is None else x for x in column.to_pylist()]


def parts(offsets: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``budget`` bytes each; one longer row makes a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + budget, "right")) - 1)
        yield row, end
        row = end
