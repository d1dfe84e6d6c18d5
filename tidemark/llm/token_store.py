"""Token ids in fixed-width bit-packed blocks.

A block holds whole documents: their ids side by side, each in the fewest bits that hold any id
of the vocabulary, and the offset of each document among them. Blocks are rows of Parquet, so Spark writes
and commits them; a document is read by one block and two offsets. Unpacking is one numpy
pass over a block. Documents lie in ascending id order: range-partitioned and sorted before they
are encoded, in the task that writes them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import vocab

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16


def width_of(n_ids: int) -> int:
    """Bits that hold 0 to n_ids - 1."""
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids in width bits each, least bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int, start: int = 0) -> np.ndarray:
    """n ids from the start-th on, uint32; only the bytes that hold them are read."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n, start * width // 8).astype(np.uint32)
    first = start * width
    raw = np.frombuffer(data, np.uint8, (first + n * width + 7) // 8 - first // 8, first // 8)
    bits = np.unpackbits(raw, bitorder="little")[first % 8 :][: n * width].reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


def _schema(id_type: pa.DataType) -> pa.Schema:
    kinds = {"shard": pa.int32(), "block": pa.int32(), "base": pa.int64(), "n_ids": pa.int64(), "width": pa.int32(), "first_id": id_type, "last_id": id_type, "nulls": pa.int64(), "doc_ids": pa.list_(id_type), "offsets": pa.list_(pa.int64()), "payload": pa.binary()}
    return pa.schema(list(kinds.items()))


BLOCKS = "shard int, block int, base long, n_ids long, width int, first_id {0}, last_id {0}, nulls long, doc_ids array<{0}>, offsets array<bigint>, payload binary"


def write_blocks(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encodes docs into blocks under folder, in ascending id order (null ids first, ties by text hash).

    Ids other than int and bigint are stored as text. Each document's ids are followed by end_id. shard and block number the blocks in order; base
    is the count of a shard's ids before the block; offsets has one entry more than doc_ids. first_id and last_id are the least and greatest
    id of a block, nulls how many of its documents have none, so that a reader skips blocks by the statistics of these columns. A null text
    is empty; repeated rows are stored as often as they come; an empty table writes no block.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    kind = kind if kind in ("bigint", "int") else "string"
    fields = _schema({"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = vocab.encoder(vocabulary), TaskContext.get().partitionId()
        width, end = width_of(max(enc.vocab_size, end_id + 1)), np.array([end_id], np.uint32)
        block, base, names, parts, n = 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            offsets = np.cumsum([0, *[len(p) for p in parts]]).tolist()
            known = [x for x in names if x is not None]  # names ascend
            row = [shard, block, base, len(ids), width, known[0] if known else None, known[-1] if known else None, len(names) - len(known), names, offsets, pack(ids, width)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, fields, strict=True)], schema=fields)

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for name, ids in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
                names.append(name)
                parts.append(np.concatenate([ids, end]))
                n += len(ids) + 1
                if n >= block_ids:
                    yield close()
                    block, base, names, parts, n = block + 1, base + n, [], [], 0
        if names:
            yield close()

    C.small_batches(docs.sparkSession, 256)
    ranged = docs.select(F.col(id_col).cast(kind).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__th")).repartitionByRange("__id", "__th").sortWithinPartitions("__id", "__th")
    ranged.select("__id", "__text").mapInArrow(run, BLOCKS.format(kind)).write.option("compression", "none").parquet(folder)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks under folder with first: the count of all ids before the block."""
    blocks = spark.read.parquet(folder)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))  # a row for each writing task
    return blocks.join(F.broadcast(before), "shard").withColumn("first", F.coalesce("before", F.lit(0)) + F.col("base")).drop("before")


def documents_in(blocks: DataFrame) -> DataFrame:
    """One row for each document in blocks: doc_id, start, n_tokens, ids_crc32 (of little-endian uint32 ids), read from the payload."""
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["width"], row["n_ids"])
                for name, a, b in zip(row["doc_ids"], row["offsets"], row["offsets"][1:], strict=False):
                    for column, x in zip(out, (name, row["first"] + a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())), strict=True):
                        column.append(x)
            kinds = [batch.schema.field("doc_ids").type.value_type, pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    C.small_batches(blocks.sparkSession, 256)
    return blocks.select("first", "n_ids", "width", "doc_ids", "offsets", "payload").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str, doc_id) -> list[np.ndarray]:
    """The ids of each document of that id (None: of those without one), in stored order: none for an id that isn't there, several where it is repeated.

    Blocks are found by the least and greatest id they hold, which Parquet keeps statistics of; of those few the list of documents is read, and of the payload
    only the bytes that hold a document's ids are unpacked.
    """
    blocks = spark.read.parquet(folder)
    mine = F.col("nulls") > 0 if doc_id is None else (F.col("first_id") <= F.lit(doc_id)) & (F.col("last_id") >= F.lit(doc_id))
    out = []
    for row in blocks.where(mine).select("shard", "block", "width", "doc_ids", "offsets", "payload").orderBy("shard", "block").toLocalIterator():  # a block at a time
        for name, a, b in zip(row["doc_ids"], row["offsets"], row["offsets"][1:], strict=False):
            if name == doc_id:
                out.append(unpack(row["payload"], row["width"], b - a, a))
    return out


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{C.shared_folder(spark)}/{uuid.uuid4().hex}"
    write_blocks(C.read(spark, sf_dir, "documents"), folder)
    return documents_in(read_blocks(spark, folder))
