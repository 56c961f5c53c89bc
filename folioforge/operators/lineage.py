"""Cutting the lineage of a relation that several later steps read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Paths written on the way to the relation that is being distilled.
_ON_THE_WAY: ContextVar[list[str] | None] = ContextVar("folioforge_on_the_way", default=None)
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and every executor reach.

    That is ``spark.checkpoint.dir`` of the session, else the checkpoint folder of its context, else a
    folder inside ``spark.sql.warehouse.dir``, which tables need to be shared anyway.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = current.get() if current.isDefined() else None
    return configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/folioforge-scratch"


def fresh_path(spark: SparkSession, name: str = "part") -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/folioforge-{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`fresh_path` once nothing reads it any more."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def written_to(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write the relation to a path and read it back with the same schema."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_once(df: DataFrame) -> DataFrame:
    """Write the relation to the shared folder and read it back.

    Later steps then scan columns of a table instead of repeating its plan, and a lost executor
    costs a re-read. The files go when the application ends.
    """
    return written_to(df, _noted(fresh_path(df.sparkSession)))


def _noted(path: str) -> str:
    made = _ON_THE_WAY.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that wrote them ends, unless the session has a setting of its own."""
    if spark.conf.get(_DROP_SHUFFLES, None) is not None:
        yield
        return
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DROP_SHUFFLES)


def distilled(spark: SparkSession, *makes: Callable[[], DataFrame]) -> DataFrame:
    """The relations that ``makes`` return, written once one after the other; all that was written on the way to each is deleted then.

    So a chain of wide intermediates takes the disk of its widest step, not of all steps together. Nothing made inside a ``make``
    may be read afterwards.
    """
    path = _noted(fresh_path(spark))
    for make in makes:
        made: list[str] = []
        token = _ON_THE_WAY.set(made)
        try:
            with shuffles_dropped(spark):
                df = make()
                df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            _ON_THE_WAY.reset(token)
            for other in made:
                remove(spark, other)
    return spark.read.schema(df.schema).parquet(path)


SLICES, SLICE_ROWS = 8, 2_000_000


def distilled_in_slices(
    spark: SparkSession, make: Callable[[], Sequence[DataFrame]], key: str, step: Callable[[DataFrame], DataFrame],
    slices: int = SLICES, rows: int = SLICE_ROWS,
) -> DataFrame:
    """``step`` of the rows of the relations that ``make`` returns (of one schema), written once, one slice of the keys after the other.

    A slice goes when its result is written, so the exchanges and intermediates of ``step`` take the disk of one slice, not of all
    rows. ``step`` must treat each key by itself. Up to ``rows`` rows are done at once; a key is never cut, so one that holds
    most rows takes as much disk as without slices.
    """
    path, made = _noted(fresh_path(spark, "slices")), []
    token = _ON_THE_WAY.set(made)
    try:
        with shuffles_dropped(spark):
            for whole in make():  # one by one, so that the exchanges of one are gone before the next is written
                dealt = whole.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))
                dealt.write.mode("append").partitionBy("slice").option("compression", "zstd").parquet(path)
    finally:
        _ON_THE_WAY.reset(token)
        for other in made:
            remove(spark, other)
    landed = spark.read.schema(StructType([*whole.schema.fields, StructField("slice", IntegerType())])).parquet(path)
    sizes = {r["slice"]: r["count"] for r in landed.groupBy("slice").count().collect()}
    folders = [f"{path}/slice={k}" for k in sorted(sizes)] if sum(sizes.values()) > rows else [path]
    # Noted inside its step, a folder is deleted with what the step made.
    return distilled(spark, *[lambda at=at: step(spark.read.schema(whole.schema).parquet(_noted(at))) for at in folders])
