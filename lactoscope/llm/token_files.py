"""Token ids in files of fixed-width bit packing.

Each id takes the least number of bits that the vocabulary needs. 64 ids of b bits fill
b 64-bit words, so packing and unpacking are 64 shifts of whole NumPy columns, and the
id with number i of a segment is found without reading what is before it. A segment
holds whole documents in order; its payload is cut into blocks of ``BLOCK_IDS`` ids,
whose byte offsets are stored with it for access at random.

Segments are rows of a Parquet data set written by Spark, which commits or repeats a
whole task and reaches any store the cluster has. A row names its shard (the task that
wrote it), its place in the shard and the ids before it there; shards are in order of
``doc_id``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lactoscope.llm.stages import batches_of
from lactoscope.llm.tokens import encoder, vocabulary_size

BLOCK_IDS = 4096
# A segment is closed at the first document that reaches so many ids.
SEGMENT_IDS = 1 << 17


def packed(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits as a bit string, 64 of them in ``bits`` little-endian words."""
    table = np.zeros((-(-len(ids) // 64), 64), dtype=np.uint64)
    table.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(table), bits), dtype=np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        words[:, word] |= table[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= table[:, i] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpacked(payload: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """``n`` ids from number ``first`` on; only the words that hold them are read."""
    low, high = first // 64, -(-(first + n) // 64)
    words = np.frombuffer(payload, dtype="<u8", count=(high - low) * bits, offset=low * bits * 8).reshape(-1, bits)
    mask, table = np.uint64((1 << bits) - 1), np.empty((high - low, 64), dtype=np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        table[:, i] = value & mask
    return table.reshape(-1)[first - low * 64 : first - low * 64 + n].astype(np.uint32)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every whole text, append ``end_id``, and write all ids in order of ``doc_id``.

    A null text is empty. Rows that share a ``doc_id`` follow each other, null first.
    """
    bits = max(vocabulary_size(tokenizer) - 1, end_id, 1).bit_length()
    key = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, segment, before, encode = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer)
        keys, held, n = [], [], 0

        def closed():
            nonlocal keys, held, n, segment, before
            ids = np.concatenate(held)
            row = {
                "shard": shard,
                "segment": segment,
                "first_id": before,
                "n_ids": len(ids),
                "bits": bits,
                "doc_ids": keys,
                "lengths": [len(h) for h in held],
                "block_offsets": list(range(0, len(ids) * bits // 8 + 1, BLOCK_IDS * bits // 8)),
                "payload": packed(ids, bits),
            }
            segment, before = segment + 1, before + len(ids)
            keys, held, n = [], [], 0
            return row

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = np.append(encode.ids(text.as_py() or ""), np.uint32(end_id))
                keys.append(doc_id.as_py())
                held.append(ids)
                n += len(ids)
                if n >= SEGMENT_IDS:
                    rows.append(closed())
            for row in rows:
                yield pa.RecordBatch.from_pylist([row], schema=kinds)
        if held:
            yield pa.RecordBatch.from_pylist([closed()], schema=kinds)

    text = (
        f"shard int, segment int, first_id long, n_ids long, bits int, doc_ids array<{key.simpleString()}>, "
        "lengths array<long>, block_offsets array<long>, payload binary"
    )
    kind = _arrow(key)
    kinds = pa.schema(
        [("shard", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32())]
        + [("doc_ids", pa.list_(kind)), ("lengths", pa.list_(pa.int64())), ("block_offsets", pa.list_(pa.int64())), ("payload", pa.binary())]
    )
    # Rows of one key have to be split too, in the order of their texts.
    rows = docs.select("doc_id", "text").withColumn("head", F.substring("text", 1, 64))
    ordered = rows.repartitionByRange("doc_id", "head").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    with batches_of(docs.sparkSession, 256):
        # Bit-packed ids hardly compress.
        ordered.mapInArrow(run, text).write.option("compression", "none").parquet(path)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: the documents of the files, ids as little-endian 32-bit numbers.

    ``start`` counts the ids of all documents before. The shards' sizes are one number a
    shard, summed up in order.
    """
    segments = spark.read.parquet(path)
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    key = segments.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], dtype=np.int64)
                ids = unpacked(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
                at = np.cumsum(lengths) - lengths
                cut = [ids[a : a + n].tobytes() for a, n in zip(at.tolist(), lengths.tolist())]
                columns = [
                    pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                    pa.array(at + row["shard_start"] + row["first_id"]),
                    pa.array(lengths),
                    pa.array(cut, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    # One row for each task that wrote, so the packed ids stay where they are read.
    placed = segments.join(F.broadcast(shards), "shard").select("doc_ids", "lengths", "n_ids", "bits", "first_id", "shard_start", "payload")
    return placed.mapInArrow(run, f"doc_id {key.simpleString()}, start long, n_tokens long, ids binary")


def read_range(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """``n`` ids from number ``start`` of the whole corpus, from the blocks that hold them."""
    sizes = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids")).orderBy("shard").collect()
    out, base = [], 0
    for shard, size in sizes:
        low, high = max(start, base) - base, min(start + n, base + size) - base
        if low < high:
            wanted = (F.col("shard") == shard) & (F.col("first_id") < high) & (F.col("first_id") + F.col("n_ids") > low)
            for row in spark.read.parquet(path).where(wanted).orderBy("segment").toLocalIterator():
                a, b = max(low - row.first_id, 0), min(high - row.first_id, row.n_ids)
                block = a // BLOCK_IDS
                tail = row.payload[row.block_offsets[block] :]
                out.append(unpacked(tail, row.bits, a - block * BLOCK_IDS, b - a))
        base += size
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def digests(read: DataFrame) -> DataFrame:
    """The documents of the files with a CRC-32 of their ids in place of the ids."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
