"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a maximal run of characters other than these six.
WORD_SPACE = " \t\n\x0b\x0c\r"


# Bytes of an Arrow batch, unless the session has its own limit: Spark's 64 MB, held twice over on either side, is a
# large part of what an executor of a few GB has beside its heap.
BATCH_BYTES = 2_000_000
_BATCH_LIMIT, _SPARK_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 * 2**20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session to BATCH_BYTES where it has Spark's default.

    For operators that run one after the other in the same executors, as in a pipeline.
    """
    if spark.conf.get(_BATCH_LIMIT, f"{_SPARK_DEFAULT}b").lower() in (f"{_SPARK_DEFAULT}b", str(_SPARK_DEFAULT), "64m", "64mb"):
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; other columns cannot clash with an operator's own."""
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row: a lambda over a one-element array binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks and shares its executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def text_bytes(column: pa.Array, rows: int = 256) -> Iterator[bytes]:
    """UTF-8 of every text of a batch, a few rows at a time; null becomes empty."""
    for at in range(0, len(column), rows):
        for value in column.slice(at, rows).cast(pa.binary()).to_pylist():
            yield value or b""
    give_back()


def each_batch(
    df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], dict[str, object]],
) -> DataFrame:
    """Map every Arrow batch to columns of ``schema``; a batch may return any number of rows."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    types = _arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = step(batch)
            arrays = [columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n], type=t) for n, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    return df.mapInArrow(run, schema)


def _arrow_types(schema: str) -> list[pa.DataType]:
    simple = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
              "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
              "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<binary>": pa.list_(pa.binary())}
    return [simple[part.strip().split(" ")[1]] for part in schema.split(",")]
