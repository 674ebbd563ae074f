"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt into tiles by population counts. Two fingerprints at
distance r have population counts (whole, and of each quarter) that differ by r at
most in sum, so only tiles that near each other are compared; inside a pair of tiles
NumPy takes the exclusive-or of all pairs and counts bits. Nothing is approximate:
every pair within the radius is seen. A tile task reports a spanning star of the
links it finds, never the links themselves, so a large group of near copies costs as
many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lactoscope.llm.components import components
from lactoscope.llm.stages import numbered, shielded, stored
from lactoscope.llm.words import as_bytes

SEED = 42
# Fingerprints in a block: two blocks meet in one NumPy comparison, 64 rows at a time.
BLOCK = 2048
_AT_ONCE = 1 << 20
_SHINGLES = 1 << 16
_BYTE_ROWS = 128


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, ASCII lower case, joined by single spaces."""
    words = as_bytes(text).lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist())], dtype=np.uint64
    )


def majority_bits(hashes: np.ndarray) -> int:
    """A 64-bit number with the bits that more than half of the hashes have; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SHINGLES):
        part = hashes[at : at + _SHINGLES].astype("<u8").view(np.uint8)
        bits = np.unpackbits(part, bitorder="little").reshape(-1, 64)
        # Counts of so few rows fit a byte, and bytes are added without a cast.
        whole = len(bits) // _BYTE_ROWS * _BYTE_ROWS
        ones += bits[:whole].reshape(-1, _BYTE_ROWS, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keys`` and the fingerprint ``w0`` as a long; a null or empty text has no shingle and the fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [majority_bits(shingle_hashes(text.as_py(), shingle)) for text in batch.column("text_")]
            column = pa.array(np.array(words, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), column], [*keys, "w0"])

    schema = docs.select(*keys).schema.add("w0", "long")
    return docs.select(*keys, F.col("text").alias("text_")).mapInArrow(run, schema)


def quarter_tile(word: str = "w0") -> Column:
    """Population counts of the four quarters of a fingerprint, as one number."""
    ones = [F.bit_count(F.shiftrightunsigned(word, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    return sum((ones[i] * (64**i) for i in range(1, 4)), ones[0]).cast("int")


def quarter_steps(radius: int) -> list[int]:
    """Differences of two tile numbers whose population counts differ by the radius at most.

    Of each step and its opposite only one is given, as pairs have no order.
    """
    moves = {(0, 0, 0, 0)}
    for _ in range(radius):
        moves |= {(*m[:i], m[i] + d, *m[i + 1 :]) for m in moves for i in range(4) for d in (-1, 1)}
    return sorted(s for m in moves if (s := sum(v * 64**i for i, v in enumerate(m))) >= 0)


def _blocks(classes: DataFrame, size: int) -> DataFrame:
    """Distinct fingerprints in order of tile, as blocks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial, held, tile = TaskContext.get().partitionId() << 32, [], None

        def block():
            nonlocal serial, held
            rows = np.concatenate(held)
            held, serial = [], serial + 1
            return pa.RecordBatch.from_pylist(
                [{"tile": int(tile), "block": serial, "rows": rows.tobytes()}],
                schema=pa.schema([("tile", pa.int32()), ("block", pa.int64()), ("rows", pa.binary())]),
            )

        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            rows = np.column_stack([batch.column(c).to_numpy() for c in ("node", "w0")]).astype(np.int64)
            at = 0
            while at < len(tiles):
                if tile is not None and (tiles[at] != tile or sum(map(len, held)) >= size):
                    yield block()
                tile = tiles[at]
                end = min(int(np.searchsorted(tiles, tile, side="right")), at + size - sum(map(len, held)))
                held.append(rows[at:end])
                at = end
        if held:
            yield block()

    ordered = classes.repartitionByRange("tile", "node").sortWithinPartitions("tile", "node")
    return ordered.select("tile", "node", "w0").mapInArrow(run, "tile int, block long, rows binary")


class _Forest:
    """Components of rows numbered from 0, joined link by link in whole arrays."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.up[a], self.up[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (further := self.up[self.up] != self.up).any():
                self.up[further] = self.up[self.up[further]]


def _compared(a: np.ndarray, b: np.ndarray, same: bool, radius: int):
    """Star of links between the rows of two blocks: (node, local root) pairs."""
    words_a, words_b = (np.ascontiguousarray(x[:, 1]).view(np.uint64) for x in (a, b))
    ones = [np.bitwise_count(x).astype(int) for x in (words_a, words_b)]
    if max(ones[0].min() - ones[1].max(), ones[1].min() - ones[0].max()) > radius:
        return None
    forest, step = _Forest(len(a) + len(b)), max(1, _AT_ONCE // len(b))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(words_a[at : at + step, None] ^ words_b) <= radius)
        i = i + at
        if same:
            i, j = i[j > i], j[j > i]
        if len(i):
            forest.join(i, j if same else j + len(a))
    nodes = np.concatenate([a[:, 0], b[:, 0]])
    linked = np.flatnonzero(forest.up != np.arange(len(nodes)))
    return nodes[linked], nodes[forest.up[linked]]


def links(classes: DataFrame, steps: Sequence[int], radius: int) -> DataFrame:
    """Links ``a, b`` that connect all ``node``s whose fingerprints differ in ``radius`` bits or fewer.

    ``classes`` has ``node, tile, w0``.
    """
    blocks = stored(_blocks(classes, BLOCK))
    visiting = blocks.select(
        F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"),
        F.col("tile").alias("from_"),
        F.col("block").alias("other"),
        F.col("rows").alias("other_rows"),
    ).select((F.col("from_") + F.col("step")).alias("tile"), "step", "other", "other_rows")
    pairs = blocks.join(visiting, "tile").where((F.col("step") != 0) | (F.col("other") <= F.col("block")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[c], dtype=np.int64).reshape(-1, 2) for c in ("rows", "other_rows"))
                found = _compared(a, b, row["block"] == row["other"], radius)
                if found is not None and len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    made = pairs.select("block", "rows", "other", "other_rows").mapInArrow(run, "a long, b long")
    return stored(made, batch_rows=64)


def _roots(classes: DataFrame, radius: int) -> DataFrame:
    """``w0, root`` of the fingerprints that have a link."""
    tiled = classes.select(F.col("w0").alias("node"), quarter_tile().alias("tile"), "w0")
    return components(links(tiled, quarter_steps(radius), radius)).withColumnRenamed("node", "w0")


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Fingerprints link at ``radius`` differing bits or fewer; ``component_id`` is the
    least ``doc_id`` that links reach. Null and empty texts have the fingerprint zero
    and are linked like others. Repeated rows are in one component and all returned; a
    null ``doc_id`` never names a component unless nothing else is in it.
    """
    prints = stored(fingerprints(docs, shingle))
    classes = stored(prints.groupBy("w0").agg(F.min("doc_id").alias("first_doc")))
    roots = _roots(classes, radius)
    grouped = stored(classes.join(roots, "w0", "left").select("w0", "first_doc", F.coalesce("root", "w0").alias("root")))
    least = stored(grouped.groupBy("root").agg(F.min("first_doc").alias("component_id")))
    named = stored(grouped.join(least, "root").select("w0", "component_id"))
    return prints.join(named, "w0").select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component of near copies, with all its columns.

    Components are those of ``near_groups``. Of each the row with the least ``doc_id`` (null
    last, then the first in the table) stays. Texts without a word are copies of each
    other; ``docs`` has to be a stored table.
    """
    shield = shielded(docs)
    rows = numbered(shield.rows)
    prints = stored(fingerprints(rows, shingle, ("doc_id", "row_number_")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_number_")
    classes = stored(prints.groupBy("w0").agg(F.min(order).alias("first_row")))
    roots = _roots(classes, radius)
    grouped = classes.join(roots, "w0", "left").groupBy(F.coalesce("root", "w0").alias("root"))
    firsts = stored(grouped.agg(F.min("first_row").alias("first_row")).select("first_row.row_number_"))
    # Far fewer rows go than stay, so those that go are looked up.
    gone = stored(prints.select("row_number_").join(firsts, "row_number_", "left_anti"))
    return shield.restored(rows.join(gone, "row_number_", "left_anti"))
