"""Token-id files with shuffled bit planes.

Ids are cut into blocks of a fixed size. The bytes (or bits) of a block are transposed into planes, so that the
rarely changing high parts lie together, and every plane is compressed with zstandard by itself. Blocks are
grouped into segments that begin at a document, hold about 262,144 ids, and are the unit of reading; an index
gives every segment's place in the whole id stream.

Layout under ``path``: ``blocks`` (part, segment, n_ids, doc_ids, doc_lengths, block_ids, planes) and ``index``
(part, segment, start, n_ids). The parts are ranges of ascending doc_id, so ``(part, segment)`` is stream order.

Cases: a null or empty text holds only the end id; a null doc_id sorts first; rows with the same doc_id are
separate documents, in the order of the input's rows; a document longer than a segment is one segment; an
empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import texts
from folioforge.llm.tokens import WORD_BPE, encoder

BLOCK_IDS = 65_536
SEGMENT_IDS = 1 << 18
_BLOCKS = ("part int, segment int, n_ids long, doc_ids array<long>, doc_lengths array<long>, "
           "block_ids array<int>, planes array<binary>")


def to_planes(ids: np.ndarray, unit: str = "byte") -> list[bytes]:
    """Transpose one block of unsigned 32-bit ids: 4 byte planes, or 32 bit planes from the lowest bit up."""
    if unit == "byte":
        return [plane.tobytes() for plane in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(plane).tobytes() for plane in bits.T]


def from_planes(planes: list[bytes], n_ids: int) -> np.ndarray:
    """The inverse of :func:`to_planes`; the unit follows from the number of planes."""
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n_ids) for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").copy().view("<u4").ravel()


def write(documents: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = 2, unit: str = "byte", level: int = 3) -> None:
    """Encode every text, append ``end_id`` to each and write blocks and index under ``path``."""
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        part, segment = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        stream: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(stream), "<u4")
            cut = [ids[at:at + BLOCK_IDS] for at in range(0, len(ids), BLOCK_IDS)]
            planes = [compressor.compress(p) for block in cut for p in to_planes(block, unit)]
            row = {
                "part": part, "segment": segment, "n_ids": len(ids), "doc_ids": doc_ids,
                "doc_lengths": [len(s) // 4 for s in stream], "block_ids": [len(b) for b in cut], "planes": planes,
            }
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                ("doc_lengths", pa.list_(pa.int64())), ("block_ids", pa.list_(pa.int32())), ("planes", pa.list_(pa.binary()))]))

        for batch in batches:
            encoded = encoder(tokenizer).stream(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                doc_ids.append(doc_id)
                stream.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= SEGMENT_IDS:
                    yield closed()
                    doc_ids, stream, size, segment = [], [], 0, segment + 1
        if stream:
            yield closed()

    ordered = (
        texts(documents).withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    )
    ordered.mapInArrow(blocks, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    segments = ordered.sparkSession.read.parquet(f"{path}/blocks").select("part", "segment", "n_ids")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # One row per part: as many as there are tasks, not rows.
    parts = (
        segments.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
        .select("part", F.coalesce(F.sum("part_ids").over(before.orderBy("part")), F.lit(0)).alias("part_start"))
    )
    inside = F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("segment")), F.lit(0))
    index = segments.join(parts, "part").select("part", "segment", (F.col("part_start") + inside).alias("start"), "n_ids")
    index.write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start in the whole stream, n_tokens, ids_crc32 (and ids)."""

    schema = "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in ("part", "segment", "doc_ids", "doc_lengths", "block_ids", "planes")}
                blocks, planes = row["block_ids"], [expand.decompress(p) for p in row["planes"]]
                per = len(planes) // max(1, len(blocks))
                ids = np.concatenate([from_planes(planes[b * per:(b + 1) * per], n) for b, n in enumerate(blocks)])
                ends = np.cumsum(row["doc_lengths"])
                starts = ends - np.array(row["doc_lengths"])
                spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
                raw = memoryview(ids.astype("<u4").tobytes())
                columns = [
                    pa.array([row["part"]] * len(spans), pa.int32()), pa.array([row["segment"]] * len(spans), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["doc_lengths"], pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in spans], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[part.split(" ")[0] for part in schema.split(", ")])

    decoded = spark.read.parquet(f"{path}/blocks").drop("n_ids").mapInArrow(documents, schema)
    index = spark.read.parquet(f"{path}/index").drop("n_ids")
    return decoded.join(index, ["part", "segment"]).select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
