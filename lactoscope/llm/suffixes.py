"""Repeated passages by sparse suffix arrays.

Of each text only suffixes at minimiser positions are retained: words whose 5-word
gram has the least hash among 16 neighbours. A passage of 50 words has one among its
first 16 words, the same one wherever it occurs, and at least 35 words of the passage
follow it. Retained suffixes are sorted by the hash of their first 35 words; equal
neighbours in that order are candidates. The 50-word runs that begin less than a window
before a candidate are hashed whole and sorted the same way: a run with an equal
neighbour is shared, and overlapping shared runs of a text are one passage. So each run
is held to one partner, and no word is reported that is in no shared run.

A text has one row for each hash, with all places of it, so equal neighbours are always
different texts. Both sorts are range partitioned on keys that end in the row, so a
passage that very many texts share is spread over tasks. Neighbours on two sides of a
partition bound are compared by means of the first and last row of each partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lactoscope.llm.stages import discard, numbered, shielded, stored
from lactoscope.llm.words import as_bytes, covered, hashed_words, sliding, window_hashes, word_spans

MIN_WORDS = 50
WINDOW = 16
GRAM = 5


def _retained(words: np.ndarray, window: int, gram: int, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser positions with ``head`` words after them, and the hash of those words."""
    grams = window_hashes(words, gram)
    if len(words) < head or len(grams) < window:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    least = sliding(grams, window)
    # A gram is kept if some window around it has it as the least.
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    kept = np.flatnonzero(sliding(padded, window, np.maximum)[: len(grams)] == grams)
    kept = kept[kept <= len(words) - head]
    return kept, window_hashes(words, head)[kept]


def _listed(row: int, key: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """``row, key, places``: each distinct key of a text once, with all its places, four bytes each."""
    keys, offsets, order = _by_key(key)
    buffers = [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(places[order].astype("<i4"))]
    lists = pa.Array.from_buffers(pa.binary(), len(keys), buffers)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row, dtype=np.int64)), pa.array(keys.view(np.int64)), lists], ["row", "key", "places"])


def suffixes(rows: DataFrame, window: int, gram: int, head: int) -> DataFrame:
    """``row, key, places``: keys of the retained suffixes of each text, and their places in it.

    A key has one row for each text, so rows of one key are rows of different texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                pos, key = _retained(hashed_words(np.frombuffer(as_bytes(text.as_py()), dtype=np.uint8)), window, gram, head)
                if len(pos):
                    found.append(_listed(row, key, pos))
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    return rows.select(F.col("row_number_").alias("row"), "text").mapInArrow(run, "row long, key long, places binary")


def _unpacked(places: pa.Scalar) -> np.ndarray:
    """The places of all keys found in one text."""
    return np.frombuffer(b"".join(places.as_py()), dtype="<i4")


def _by_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the bounds of each in the order of keys, and that order."""
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
    return key[order[heads]], np.append(heads, len(key)), order


def with_neighbours(rows: DataFrame, order: Sequence[str], shared: Callable[[pa.Table, pa.Table], np.ndarray], within: Sequence[str] | None = None) -> DataFrame:
    """Rows that share something with the row before or after them in a global order.

    ``shared`` compares two tables row by row and gives numbers, 0 for nothing. They are
    returned as ``before`` and ``after``. Two rows of each partition go to the driver. A
    partition is sorted ``within`` by the first columns of the order alone if ``shared`` needs
    no more: Spark sorts by one number much faster than by several.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, before, opened = TaskContext.get().partitionId(), None, 0, False

        def marked(table: pa.Table, before, after, first: bool, last: bool):
            n = table.num_rows
            edge = np.zeros(n, dtype=np.int32)
            if first:
                edge[0] += 1
            if last:
                edge[-1] += 2
            for name, values in (("before", before), ("after", after), ("edge", edge), ("part", np.full(n, part))):
                table = table.append_column(name, pa.array(np.asarray(values, dtype=np.int32)))
            keep = (np.maximum(before, after) > 0) | (edge > 0)
            return table.filter(pa.array(keep)).combine_chunks().to_batches()

        # The last row of a batch waits for the first one of the next.
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            n = table.num_rows
            if n < 2:
                held = table if n else held
                continue
            links = shared(table.slice(0, n - 1), table.slice(1))
            yield from marked(table.slice(0, n - 1), np.concatenate([[before], links[:-1]]), links, not opened, False)
            held, before, opened = table.slice(n - 1), links[-1], True
        if held is not None and held.num_rows:
            yield from marked(held, np.array([before]), np.array([0]), not opened, True)

    schema = rows.schema
    for name in ("before", "after", "edge", "part"):
        schema = schema.add(name, "integer")
    spark = rows.sparkSession
    found = stored(rows.repartitionByRange(*order).sortWithinPartitions(*(within or order)).mapInArrow(run, schema))
    edges = found.where("edge > 0").orderBy("part", "edge").toArrow()
    after, before = edges.column("after").to_numpy().copy(), edges.column("before").to_numpy().copy()
    parts, edge = edges.column("part").to_numpy(), edges.column("edge").to_numpy()
    for i in range(edges.num_rows - 1):
        if parts[i] != parts[i + 1] and edge[i] >= 2 and edge[i + 1] in (1, 3):
            after[i] = before[i + 1] = shared(edges.slice(i, 1), edges.slice(i + 1, 1))[0]
    mended = pa.table({**{c: edges.column(c) for c in names}, "before": pa.array(before), "after": pa.array(after)})
    inner = found.where("edge = 0").select(*names, "before", "after")
    return inner.unionByName(spark.createDataFrame(mended, inner.schema)).where("before > 0 or after > 0")


def same_key(a: pa.Table, b: pa.Table) -> np.ndarray:
    """2 for rows of two texts with one key, 1 for those of one text."""
    same = a.column("key").to_numpy() == b.column("key").to_numpy()
    return np.where(same, 1 + (a.column("row").to_numpy() != b.column("row").to_numpy()), 0)


def _passages(rows: DataFrame, found: DataFrame, min_words: int, window: int) -> DataFrame:
    """``row, key, places``: runs of ``min_words`` words that begin less than a window before a repeated suffix."""
    whole = found.groupBy("row").agg(F.collect_list("places").alias("near"))
    texts = rows.select(F.col("row_number_").alias("row"), "text").join(whole, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, text, near in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("near")):
                keys = window_hashes(hashed_words(np.frombuffer(as_bytes(text.as_py()), dtype=np.uint8)), min_words)
                pos = _unpacked(near).astype(np.int64)
                starts = np.flatnonzero(covered(np.maximum(pos - window + 1, 0), np.minimum(pos + 1, window), len(keys) + window)[: len(keys)])
                if len(starts):
                    found.append(_listed(row, keys[starts], starts))
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    return texts.select("row", "text", "near").mapInArrow(run, "row long, key long, places binary")


def _spans(rows: DataFrame, min_words: int, window: int, gram: int, earlier_only: bool) -> DataFrame:
    """``row_number_, start, end``: stretches made of runs of ``min_words`` that another (an earlier) text has."""
    kept = stored(suffixes(rows, window, gram, min_words - window + 1))
    # A key has one row for each text: an equal neighbour is another text, one before is an earlier text.
    repeated = with_neighbours(kept, ("key", "row"), same_key)
    passages = stored(_passages(rows, repeated.select("row", "places"), min_words, window), batch_rows=500)
    discard(kept, repeated)
    shared = with_neighbours(passages, ("key", "row"), same_key)
    known = stored((shared.where("before > 0") if earlier_only else shared).select("row", "places"))
    discard(passages, shared)
    whole = known.groupBy("row").agg(F.collect_list("places").alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, starts in zip(batch.column("row").to_pylist(), batch.column("starts")):
                at = np.sort(_unpacked(starts))
                first = np.flatnonzero(np.concatenate([[True], np.diff(at) >= min_words]))
                ends = at[np.append(first[1:], len(at)) - 1] + min_words
                columns = [np.full(len(first), row, dtype=np.int64), at[first].astype(np.int32), ends.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row_number_", "start", "end"])

    return whole.mapInArrow(run, "row_number_ long, start int, end int")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, start_word, n_words``: passages that also occur in another row of ``docs``.

    Every run of ``min_words`` or more white-space separated words that two rows have in
    common lies inside a returned passage, and every word of a passage lies in such a run.
    Runs that overlap are one passage. Null, empty and short texts have none; repeated rows repeat each other;
    ``docs`` has to be a stored table.
    """
    rows = numbered(docs.select("doc_id", "text"))
    spans = stored(_spans(rows, min_words, window, gram, False))
    return rows.select("doc_id", "row_number_").join(spans, "row_number_").select(
        "doc_id", F.col("start").cast("long").alias("start_word"), (F.col("end") - F.col("start")).cast("long").alias("n_words")
    )


def cut_passages(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows of ``docs`` without the passages that an earlier row has too.

    A word is cut if it lies in a run of ``min_words`` words that one earlier row has. A passage
    stays where it comes first in the table and is cut out of the texts of later rows, with
    the white space after it; ``n_chars``, if there, is counted anew. Rows
    that had words and are left without any go; all others stay, with all their columns.
    """
    shield = shielded(docs)
    rows = numbered(shield.rows)
    spans = _spans(rows, min_words, window, gram, True)
    cuts = stored(spans.groupBy("row_number_").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts_")))
    # The cuts grow with the table and are soon too many for a broadcast: one plan at every size.
    joined = rows.join(cuts.hint("merge"), "row_number_", "left").drop("row_number_")
    at = shield.rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept = [], []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts_").to_pylist()):
                if cuts:
                    data = as_bytes(text)
                    starts, _ = word_spans(np.frombuffer(data, dtype=np.uint8))
                    bounds, out, done = [*starts.tolist(), len(data)], [], 0
                    for cut in cuts:
                        out.append(data[done : max(done, bounds[cut["start"]])])
                        done = max(done, bounds[cut["end"]])
                    text = b"".join([*out, data[done:]]).decode("utf-8", "surrogatepass")
                texts.append(text)
                kept.append(not cuts or bool(text.strip(" \t\n\r\x0b\x0c")))
            columns = [batch.column(i) for i in range(len(batch.schema) - 1)]
            columns[at] = pa.array(texts, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1]).filter(pa.array(kept, pa.bool_()))

    cut = joined.mapInArrow(run, shield.rows.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return shield.restored(cut)
