"""Packing of token sequences by cutting-stock column generation.

Documents are cut into pieces of a full sequence and one rest. The lengths of all
pieces, rounded up to a grain, form a histogram of at most ``capacity / grain`` rows
whatever the size of the corpus; only that goes to the driver. There a linear program
over patterns (how many pieces of each length share a sequence) is solved by column
generation: the duals of the pattern table price lengths, and a knapsack over the
capacity finds the pattern worth adding, until none promises more than ``gap``.
Patterns are rounded down to whole sequences and what is left over is packed greedily.

Spark then ranks the pieces of each length and gives rank k the k-th place that the
patterns have for that length. Ranks come from two parts, the place of a piece among
those of its length in its own task and the number of them in the tasks before, so no
length, however common, is gathered anywhere.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lactoscope.llm.stages import stored
from lactoscope.llm.tokens import encoder

CAPACITY = 4096
GRAIN = 4
GAP = 0.001
ROUNDS = 4000
_PIECE = (
    "part int, place long, cell int, doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Full pieces and rest of each document, with ids as little-endian 32-bit numbers.

    ``cell`` is the length in grains, ``place`` the number of earlier pieces of that
    cell in the same task, ``part`` the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encode = TaskContext.get().partitionId(), Counter(), encoder(tokenizer)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = np.append(encode.ids(text.as_py() or ""), end_id).astype("<u4")
                for start in range(0, len(ids), capacity):
                    cut = ids[start : start + capacity].tobytes()
                    n = len(cut) // 4
                    cell = -(-n // grain)
                    rows.append((part, seen[cell], cell, key.as_py(), start, n, zlib.crc32(cut), len(ids), cut))
                    seen[cell] += 1
            kinds = [pa.int32(), pa.int64(), pa.int32(), batch.schema.field("doc_id").type] + [pa.int64()] * 4 + [pa.binary()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            names = ["part", "place", "cell", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, _PIECE.format(key=key))


def _greedy(counts: np.ndarray, units: int) -> list[tuple[dict[int, int], int]]:
    """Largest first: patterns and how often each can be taken in a row."""
    counts, made = counts.copy(), []
    while counts.any():
        left, pattern = units, {}
        while left:
            fits = np.flatnonzero(counts[1 : left + 1]) + 1
            if not len(fits):
                break
            size = int(fits[-1])
            n = int(min(counts[size] - pattern.get(size, 0), left // size)) if size not in pattern else 0
            if not n:
                # All pieces of this size are in already: take the next smaller one.
                smaller = [int(s) for s in fits[::-1] if s not in pattern]
                if not smaller:
                    break
                size = smaller[0]
                n = int(min(counts[size], left // size))
            pattern[size], left = n, left - n * size
        times = int(min(counts[s] // n for s, n in pattern.items()))
        for size, n in pattern.items():
            counts[size] -= n * times
        made.append((pattern, times))
    return made


def _best_pattern(prices: np.ndarray, sizes: np.ndarray, units: int) -> tuple[float, dict[int, int]]:
    """Knapsack by dynamic programming: the dearest set of sizes within the capacity."""
    worth = np.full(units + 1, -1.0)
    worth[sizes] = prices
    best, taken = np.zeros(units + 1), np.zeros(units + 1, dtype=np.int64)
    for c in range(1, units + 1):
        offers = best[c - 1 :: -1] + worth[1 : c + 1]
        at = int(offers.argmax())
        if offers[at] > best[c - 1] + 1e-12:
            best[c], taken[c] = offers[at], at + 1
        else:
            best[c] = best[c - 1]
    pattern, c = Counter(), units
    while c:
        if taken[c]:
            pattern[int(taken[c])] += 1
            c -= taken[c]
        else:
            c -= 1
    return float(best[units]), dict(pattern)


def solve_patterns(counts: np.ndarray, units: int, gap: float = GAP, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Patterns and (fractional) times that cover ``counts`` pieces of each size in few sequences.

    ``counts[s]`` is the number of pieces of size s, up to ``units``. Revised simplex
    with one dense row per size that occurs; it ends once the least number of sequences
    is known to within ``gap``, or after ``rounds``.
    """
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return []
    row, demand = {int(s): i for i, s in enumerate(sizes)}, counts[sizes].astype(float)
    basis = [{int(s): units // int(s)} for s in sizes]
    inverse = np.diag(1.0 / np.array([units // int(s) for s in sizes], dtype=float))
    times = inverse @ demand
    ready = [p for p, _ in _greedy(counts, units)]
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        if times.sum() <= (1 + gap) * demand @ sizes / units:
            break
        if ready:
            pattern = ready.pop()
            if sum(n * prices[row[s]] for s, n in pattern.items()) <= 1 + 1e-9:
                continue
        else:
            value, pattern = _best_pattern(prices, sizes, units)
            if value <= 1 + gap:
                break
        column = inverse[:, [row[s] for s in pattern]] @ np.array(list(pattern.values()), dtype=float)
        ratio = np.full(len(times), np.inf)
        np.divide(times, column, out=ratio, where=column > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        times = np.maximum(times - ratio[out] * column, 0.0)
        times[out] = ratio[out]
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
        basis[out] = pattern
    return [(p, float(t)) for p, t in zip(basis, times) if t > 1e-9]


def plan_sequences(counts: np.ndarray, units: int, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Patterns and whole times that take every piece exactly once."""
    left, plan = counts.copy(), []
    for pattern, times in sorted(solve_patterns(counts, units, gap), key=lambda x: -x[1]):
        whole = min([int(times + 1e-9), *(int(left[s]) // n for s, n in pattern.items())])
        if whole:
            for size, n in pattern.items():
                left[size] -= n * whole
            plan.append((pattern, whole))
    return plan + _greedy(left, units)


def _places(plan: Sequence[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each cell, runs of ranks: cell, first and last rank, first sequence, slot, pieces a sequence."""
    taken, sequence, rows = defaultdict(int), 0, []
    for pattern, times in plan:
        slot = 0
        for cell, n in sorted(pattern.items(), reverse=True):
            rows.append((cell, taken[cell], taken[cell] + n * times - 1, sequence, slot, n))
            taken[cell] += n * times
            slot += n
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, grain: int = GRAIN, gap: float = GAP) -> DataFrame:
    """Pieces with their place in sequences of at most ``capacity`` tokens.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``: each token
    of each row of ``docs`` (null text: empty, so only the end id) lies in one piece,
    ``ids`` holds the piece's tokens and offsets run gapless from 0 in each sequence.
    Repeated rows and null ``doc_id`` are packed like others; an empty table gives none.
    """
    spark = docs.sparkSession
    made = stored(pieces(docs, tokenizer, end_id, capacity, grain))
    cells = made.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(-(-capacity // grain) + 1, dtype=np.int64)
    for cell, n in cells.groupBy("cell").agg(F.sum("n")).collect():
        counts[cell] = n
    # At most a few runs for each pattern, and a pattern for each length: some ten thousand rows.
    schema = "cell int, first long, last long, first_sequence long, slot int, each int"
    runs = F.broadcast(spark.createDataFrame(_places(plan_sequences(counts, capacity // grain, gap)), schema))
    before = W.partitionBy("cell").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = stored(cells.select("cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    rank = F.col("before") + F.col("place")
    put = (
        made.join(parts, ["cell", "part"])
        .withColumn("rank", rank)
        .join(runs, "cell")
        .where(F.col("rank").between(F.col("first"), F.col("last")))
        .withColumn("turn", F.col("rank") - F.col("first"))
        .withColumn("sequence_id", F.expr("first_sequence + turn div each"))
        .withColumn("slot", F.expr("slot + turn % each"))
    )
    earlier = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset")
    return put.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset, "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_ids, offsets``: the sequences as a trainer reads them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    joined = F.aggregate(F.col("parts.ids"), F.unhex(F.lit("")), lambda a, x: F.concat(a, x))
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
        .select("sequence_id", "n_tokens", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
    )
