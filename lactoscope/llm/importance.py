"""Importance resampling of documents towards a target corpus.

An untrained regex split of the tokenizers library cuts each ASCII-lowered text into words
with their offsets. A feature is a run of words: a window over the offset pairs, from the
start of its first word to the end of its last one in the words joined by single spaces.
Its bytes' CRC-32 names one of a fixed number of buckets. Documents and target texts fill a
histogram of buckets each, the ratio of the two gives every bucket a gain, and a document's
weight is the sum of its features' gains. A keyed draw is added to the weight, so the
highest scores are a sample without replacement that leans towards the target.

Texts are split once: the buckets of a document's features are stored, two bytes a feature,
and both the histogram and the weights are read from there. Histograms are added up from
one partial per task, so no key's rows meet before they are counted. Ranks come from one
range-partitioned sort of the eligible documents; the places inside a partition are counted
up by the sizes of the partitions before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lactoscope.llm.stages import stored
from lactoscope.llm.words import as_bytes

# Fixed by contract: what a word is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
# Words whose buckets a worker keeps, none of them longer than this.
KEPT_WORDS, KEPT_LENGTH = 300_000, 32


class Features:
    """Buckets of the word runs of whole texts."""

    def __init__(self, longest: int = 1, buckets: int = BUCKETS):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(WORD), behavior="removed", invert=True)
        self.longest, self.buckets = longest, buckets
        self.known: dict[str, int] = {}

    def words(self, text: str | None) -> list[tuple[str, tuple[int, int]]]:
        """Words of the lowered text, each with its first byte and the byte after its last."""
        from tokenizers import PreTokenizedString

        if not text:
            return []
        parts = PreTokenizedString(as_bytes(text).lower().decode("utf-8", "replace"))
        self.split.pre_tokenize(parts)
        return [(word, span) for word, span, _ in parts.get_splits(offset_referential="original", offset_type="byte")]

    def _single(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            from zlib import crc32

            found = crc32(word.encode()) % self.buckets
            if len(word) <= KEPT_LENGTH:
                if len(self.known) >= KEPT_WORDS:
                    self.known.clear()
                self.known[word] = found
        return found

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of each run of 1 to ``longest`` of them."""
        from zlib import crc32

        words = self.words(text)
        found = [self._single(word) for word, _ in words]
        if self.longest > 1 and len(words) > 1:
            # Offset pairs in the words joined by one space each.
            joined = " ".join([word for word, _ in words]).encode()
            lengths = np.array([end - start for _, (start, end) in words])
            ends = np.cumsum(lengths + 1) - 1
            starts, stops = (ends - lengths).tolist(), ends.tolist()
            for size in range(2, self.longest + 1):
                found += [crc32(joined[a:b]) % self.buckets for a, b in zip(starts, stops[size - 1 :])]
        return len(words), np.array(found, dtype=np.uint16 if self.buckets <= 1 << 16 else np.uint32)


def features(texts: DataFrame, keys: tuple[str, ...], longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``keys, n_words, n_features, buckets``: the features of each whole text; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(longest, buckets)
        for batch in batches:
            rows = [made.of(text.as_py()) for text in batch.column("text_")]
            columns = [
                pa.array([n for n, _ in rows], pa.int64()),
                pa.array([len(found) for _, found in rows], pa.int64()),
                pa.array([found.tobytes() for _, found in rows], pa.binary()),
            ]
            kept = [batch.column(f"key{i}_") for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*keys, "n_words", "n_features", "buckets"])

    schema = texts.select(*keys).schema.add("n_words", "long").add("n_features", "long").add("buckets", "binary")
    # Renamed by place, so that no column of the data can clash with the text's.
    chosen = texts.select(*[F.col(k).alias(f"key{i}_") for i, k in enumerate(keys)], F.col("text").alias("text_"))
    return chosen.mapInArrow(run, schema)


def _numbers(cell: bytes, buckets: int) -> np.ndarray:
    return np.frombuffer(cell, dtype=np.uint16 if buckets <= 1 << 16 else np.uint32)


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fell into each bucket; one number a bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for cell in batch.column("buckets"):
                total += np.bincount(_numbers(cell.as_py(), buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    partial = found.select("buckets").mapInArrow(run, "bucket int, n long")
    counts = np.zeros(buckets, dtype=np.int64)
    for bucket, n in partial.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floor of 1000 times the log ratio of the smoothed shares of each bucket."""
    buckets, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (all_source + buckets) / ((s + 1) * (all_target + buckets))))
            for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())
        ],
        dtype=np.int64,
    )


def _weighed(found: DataFrame, of_bucket: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` from the stored buckets."""
    buckets, key = len(of_bucket), found.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(of_bucket[_numbers(cell.as_py(), buckets)].sum()) for cell in batch.column("buckets")]
            columns = [batch.column(c) for c in ("doc_id", "n_words", "n_features")] + [pa.array(weights, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    schema = found.select(key.name, "n_words", "n_features").schema.add("weight", "long")
    return found.mapInArrow(run, schema)


def _draw(seed: int):
    """The keyed part of a score: a Gumbel variate in thousandths, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(eligible: DataFrame, wanted: int) -> DataFrame:
    """Rows with ``rank`` from 1 in order of score, ``doc_id`` and the rest; null beyond ``wanted``.

    A null ``doc_id`` comes after all others of its score. Rows alike in every column may
    stand in any order, so a number of the scan splits a very large group of them.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("spread")]
    spread = eligible.withColumn("spread", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread")
    placed = stored(ordered.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    # One row for each task of the sort.
    before = np.cumsum([0] + [r.n for r in sizes]).tolist()
    bases = placed.sparkSession.createDataFrame([(r.part, b) for r, b in zip(sizes, before)], "part long, base long")
    at = F.col("base") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(bases), "part").withColumn("at", at)
    return ranked.withColumn("rank", F.when(F.col("at") <= wanted, F.col("at"))).drop("part", "base", "place", "at")


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for each row of ``docs``.

    Only ``doc_id`` and ``text`` are read. Of the documents with ``min_words`` words or more,
    ``percent`` in a hundred (rounded down) with the highest scores are drawn and ranked
    from 1, ties to the smaller ``doc_id``; the others have no rank. Null, empty and
    wordless texts have no feature, weight 0 and no rank. Rows with one ``doc_id`` have one
    draw but stand for themselves; a null ``doc_id`` draws as an empty string and loses all
    ties. An empty target leaves the gains to the documents' own counts.
    """
    found = stored(features(docs, ("doc_id",), longest, buckets))
    aimed = features(target.select("text", F.lit(0).alias("none")), ("none",), longest, buckets)
    of_bucket = gains(histogram(found, buckets), histogram(aimed, buckets))
    scored = _weighed(found, of_bucket).withColumn("score", F.col("weight") + _draw(seed))
    scored = stored(scored)
    enough = scored.where(F.col("n_words") >= min_words)
    ranked = _ranked(enough, enough.count() * percent // 100)
    others = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")
