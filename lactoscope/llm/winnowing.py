"""Benchmark decontamination by winnowed fingerprints.

A window is ten consecutive words of a benchmark item. Of the six 5-word grams inside
a window the one with the least hash stands for it, and the same gram is picked when
the window occurs in a document, so every shared window has a fingerprint in common.
Fingerprints of the benchmark go into a bit table of fixed size, which each task holds;
document fingerprints that it lets through are joined with the benchmark's, and a match
is extended to the windows around it, whose hashes have to agree. Items shorter than a
window are looked up as a whole, by all grams of their length.

Spark moves only fingerprints that pass the table: true hits and, at the default size,
some false ones that the join removes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lactoscope.llm.stages import numbered, shielded, stored
from lactoscope.llm.words import NOT_ALNUM, as_bytes, hashed_words, sliding, window_hashes

WINDOW = 10
GRAM = 5
# Bits of the table that every task holds: 1 MB whatever the size of the benchmark.
TABLE_BITS = 1 << 23

_PROBE = pa.struct([("fp", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("around", pa.list_(pa.int64()))])


def _words(text: str | None) -> np.ndarray:
    return hashed_words(np.frombuffer(as_bytes(text).lower(), dtype=np.uint8), NOT_ALNUM)


def _picked(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, window hashes, and for each window the place of its least gram."""
    grams, windows = window_hashes(words, gram), window_hashes(words, window)
    width = window - gram + 1
    least = sliding(grams, width)
    # The first place in the window that holds the least hash.
    place = np.full(len(windows), -1)
    for offset in reversed(range(width)):
        hit = grams[offset : offset + len(windows)] == least
        place[hit] = np.flatnonzero(hit) + offset
    return grams, windows, place


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``item_id, size, fp, offset, hash``: each window of each item and its fingerprint."""
    schema = items.select("item_id").schema.add("size", "integer").add("fp", "long").add("offset", "integer").add("hash", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column("text_")):
                words = _words(text.as_py())
                if not len(words):
                    continue
                if len(words) < window:
                    size, hashes = len(words), window_hashes(words, len(words))
                    fps, offsets = hashes, np.zeros(1, dtype=int)
                else:
                    size, (grams, hashes, place) = window, _picked(words, window, gram)
                    fps, offsets = grams[place], place - np.arange(len(place))
                n = len(hashes)
                ids = pa.concat_arrays([batch.column("item_id").slice(at, 1)] * n)
                columns = [pa.array(np.full(n, size, dtype=np.int32)), pa.array(fps.view(np.int64))]
                columns += [pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64))]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["item_id", "size", "fp", "offset", "hash"])

    return items.select("item_id", F.col("text").alias("text_")).mapInArrow(run, schema)


def bit_table(prints: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """The fingerprints ``fp`` as a table of bits; Spark gathers it as bits / 64 numbers at most."""
    place = F.pmod(F.col("fp"), F.lit(bits))
    filled = (
        prints.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).cast("int").alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("value"))
    ).collect()
    table = np.zeros(bits // 64, dtype=np.uint64)
    for cell, value in filled:
        table[cell] = np.uint64(value & 0xFFFFFFFFFFFFFFFF)
    return table


def _listed(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.int64) % (len(table) * 64)
    return (table[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


def probes(docs: DataFrame, table, short: Sequence[int], keys: Sequence[str], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``keys, n_words, probes``: of each document the fingerprints that the bit table lets through.

    A probe has the hashes of the windows that its gram may stand for, by offset.
    """
    width = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            counts, found = [], []
            for text in batch.column("text_"):
                words = _words(text.as_py())
                counts.append(len(words))
                rows = []
                if len(words) >= window:
                    grams, windows, place = _picked(words, window, gram)
                    chosen = np.unique(place)
                    around = np.zeros(len(grams) + width, dtype=np.int64)
                    around[width - 1 : width - 1 + len(windows)] = windows.view(np.int64)
                    for at in chosen[_listed(bits, grams[chosen])].tolist():
                        # Entry o: the window that begins o words before the gram.
                        rows.append((int(grams[at].view(np.int64)), at, window, around[at : at + width][::-1].tolist()))
                for size in short:
                    hashes = window_hashes(words, size)
                    for at in np.flatnonzero(_listed(bits, hashes)).tolist():
                        h = int(hashes[at].view(np.int64))
                        rows.append((h, at, size, [h]))
                found.append([dict(zip(("fp", "at", "size", "around"), r)) for r in rows])
            columns = [pa.array(counts, pa.int64()), pa.array(found, pa.list_(_PROBE))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], [*keys, "n_words", "probes"])

    schema = docs.select(*keys).schema.add("n_words", "long")
    probe = "array<struct<fp: long, at: int, size: int, around: array<long>>>"
    parsed = docs.sparkSession.createDataFrame([], f"probes {probe}").schema["probes"].dataType
    return docs.select(*keys, F.col("text").alias("text_")).mapInArrow(run, schema.add("probes", parsed))


def _matched(docs: DataFrame, items: DataFrame, keys: Sequence[str], window: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per document its words and probes; per item its windows; per document the windows in it."""
    spark = docs.sparkSession
    windows = stored(item_windows(items, window, gram))
    short = [r[0] for r in windows.select("size").distinct().where(F.col("size") < window).collect()]
    table = spark.sparkContext.broadcast(bit_table(windows))
    probed = stored(probes(docs, table, short, keys, window, gram))
    one = probed.select("row_number_", F.explode("probes").alias("p")).select("row_number_", "p.*")
    known = windows.select("fp", "size", "offset", "hash").distinct()
    hits = (
        one.join(known, ["fp", "size"])
        .where(F.get("around", F.col("offset")) == F.col("hash"))
        .select("row_number_", "size", "hash", (F.col("at") - F.col("offset")).alias("start"))
    )
    return probed, windows, stored(hits)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``.

    ``n_hit`` counts words inside any occurrence of a window, ``n_items`` the distinct
    ``item_id`` of items with an occurring window; a null ``item_id`` is no item but its
    windows count as hits. Null and empty texts have no words; items without words have
    no window. ``docs`` has to be a stored table; repeated rows are judged one by one.
    """
    probed, windows, hits = _matched(numbered(docs.select("doc_id", "text")), items, ("doc_id", "row_number_"), window, gram)
    starts = F.array_sort(F.collect_set(F.struct("start", "size")))
    # Words covered: each window adds what lies beyond the end of those before it.
    cover = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a.end, x.start + x.size).alias("end"),
            (a.n + F.greatest(F.lit(0), x.start + x.size - F.greatest(a.end, x.start))).alias("n"),
        ),
        lambda a: a.n,
    )
    words = hits.groupBy("row_number_").agg(cover.alias("n_hit"))
    of_item = windows.where(F.col("item_id").isNotNull()).select("size", "hash", F.col("item_id").cast("string").alias("item")).distinct()
    listed = (
        hits.select("row_number_", "size", "hash")
        .distinct()
        .join(of_item, ["size", "hash"])
        .groupBy("row_number_")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = stored(words.join(listed, "row_number_", "left"))
    none = F.array().cast("array<string>")
    return (
        probed.select("doc_id", "row_number_", "n_words")
        .join(found, "row_number_", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows of ``docs`` in which no window of the benchmark occurs, with all their columns."""
    shield = shielded(docs)
    rows = numbered(shield.rows)
    _, _, hits = _matched(rows, items, ("row_number_",), window, gram)
    # Stored, so that Spark knows how few they are.
    dirty = stored(hits.select("row_number_").distinct())
    return shield.restored(rows.join(dirty, "row_number_", "left_anti"))
