"""Loads that change several stored tables at once and survive a stop at any point.

A load first stages the new content of every partition it touches, then writes its manifest in one rename. The
manifest is the commit: before it, readers see the old tables; from then on they take the touched partitions of
all tables from the staged files, whether or not these have been copied into the tables yet. :func:`recover` ends
what a stopped writer left: committed loads are copied (again), others are dropped. One writer at a time per root.

Layout under the tables' root: ``_loads/<id>/<table>/part_year=...``, ``_loads/<id>/manifest.json`` and, once the
tables hold the load, ``_loads/<id>/done``. Finished loads stay until the next one begins, for readers that
still scan their files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from folioforge.operators.lineage import remove

PARTITION_COLUMN = "part_year"
# Every load writes the touched partitions twice, so their size counts.
CODEC = "zstd"
_MANIFEST, _DONE = "manifest.json", "done"


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def _folder(root: str) -> str:
    return f"{root}/_loads"


def _loads(spark: SparkSession, root: str) -> list[str]:
    fs, target = _path(spark, _folder(root))
    return [f"{_folder(root)}/{s.getPath().getName()}" for s in fs.listStatus(target)] if fs.exists(target) else []


def _manifest(spark: SparkSession, load: str) -> dict[str, list[int]] | None:
    """Tables of a committed load with the years whose content it replaces; None before the commit."""
    fs, target = _path(spark, f"{load}/{_MANIFEST}")
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and rename it, so that it appears whole or not at all."""
    fs, target = _path(spark, path)
    _, draft = _path(spark, path + ".tmp")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(draft, target):
        raise OSError(f"cannot rename {draft} to {target}")


def pending(spark: SparkSession, root: str, table: str) -> tuple[str, list[int]] | None:
    """Staged path and years of the committed load that ``table`` does not hold yet."""
    for load in _loads(spark, root):
        manifest = _manifest(spark, load)
        if manifest and table in manifest and not exists(spark, f"{load}/{_DONE}"):
            return f"{load}/{table}", manifest[table]
    return None


def _publish_table(spark: SparkSession, root: str, load: str, table: str, years: list[int]) -> None:
    staged, path = f"{load}/{table}", f"{root}/{table}"
    fs, target = _path(spark, staged)
    held = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(target) if "=" in s.getPath().getName()}
    if held:
        (
            spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC)
            .partitionBy(PARTITION_COLUMN).parquet(path)
        )
    for year in set(years) - held:
        remove(spark, f"{path}/{PARTITION_COLUMN}={year}")


def _publish(spark: SparkSession, root: str, load: str, manifest: dict[str, list[int]]) -> None:
    """Copy the staged partitions into the tables; doing it twice changes nothing."""
    for table, years in manifest.items():
        _publish_table(spark, root, load, table, years)
    _create(spark, f"{load}/{_DONE}", "")


def recover(spark: SparkSession, root: str) -> None:
    """Copy committed loads that a stopped writer left and remove finished and uncommitted ones."""
    for load in _loads(spark, root):
        manifest = _manifest(spark, load)
        if manifest is not None and not exists(spark, f"{load}/{_DONE}"):
            _publish(spark, root, load, manifest)
        else:
            remove(spark, load)


def begin(spark: SparkSession, root: str) -> str:
    """End earlier loads and name a new one."""
    recover(spark, root)
    return f"{_folder(root)}/{uuid.uuid4().hex}"


def stage(load: str, table: str, rows: DataFrame) -> None:
    """Write the whole new content of the partitions that the load replaces in ``table``."""
    rows.write.option("compression", CODEC).partitionBy(PARTITION_COLUMN).parquet(f"{load}/{table}")


def commit(spark: SparkSession, root: str, load: str, years: dict[str, set[int]]) -> None:
    """Make the staged partitions of all tables visible at once, then copy them into the tables.

    A table without a changed partition is only created where it is absent.
    """
    for table in years:
        fs, target = _path(spark, f"{root}/{table}")
        fs.mkdirs(target)
    manifest = {table: sorted(parts) for table, parts in years.items() if parts}
    _create(spark, f"{load}/{_MANIFEST}", json.dumps(manifest))
    _publish(spark, root, load, manifest)
