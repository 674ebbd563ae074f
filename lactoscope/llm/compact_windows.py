"""Near-duplicate passages by compact windows.

The tokens of a text are its 5-word shingles. Under one hash function every stretch of
shingles has a least hash; a compact window (l, c, r) stands for all stretches that
begin in l..c and end in c..r, which have their least hash at c. The windows of a text
are the nodes of the Cartesian tree over its hashes, and only nodes as wide as the
shortest passage of interest are kept: some 2 n / width for each function. Of equal
hashes the one nearest to the middle is the node, so the tree of a text of one repeated
word is balanced and no larger.

Two texts have a near-duplicate passage where windows of enough functions agree. A text
has one row for each window value; rows are sorted by value, spread over tasks even where
very many texts have one, and values that only one text has are dropped first. What is
left of a text is joined by intervals: two functions' windows that share a stretch of full
width make a joint signature. Texts with a joint signature are sorted by what stands
around the two least hashes, so copies stand side by side even where many texts have
nothing but the signature in common, and each is paired with the next one. Places of a
text and of its partner are merged, and the passage is verified shingle by shingle: it ends
where fewer than four of five shingles are the partner's too. Texts with verified passages
are joined to classes. Under each signature that texts of several classes have, all texts of
different classes are then compared in blocks, so no third text between two hides their
passage, and a passage in very many texts costs a chain of links, never a pair of any two.
A stage is deleted once those that read it are stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lactoscope.llm.components import components
from lactoscope.llm.stages import discard, numbered, stored
from lactoscope.llm.suffixes import same_key, with_neighbours
from lactoscope.llm.words import as_bytes, hashed_words, mixed, sliding, window_hashes

SHINGLE = 5
MIN_WORDS = 50
SIMILARITY = 0.8
FUNCTIONS = 4
# One for each function.
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
# The texts of a signature are ordered by the least hash among so many shingles on each side.
_AROUND, _ORDER_SEED = 8, 0x452821E638D01377
# Pairs of windows, shingles to be compared and shingles under trees that a task holds at once (or one text's).
_PAIRS_AT_ONCE, _SHINGLES_AT_ONCE, _SHINGLES_IN_TREES = 1 << 20, 1 << 21, 1 << 17

# Stretches and shingles of a signature in a block; a stretch alone may have more shingles.
_BLOCK_ROWS, _BLOCK_SHINGLES = 256, 1 << 17
# Cells of a block's tables, and places of its pairs, that are looked at together.
_CELLS_AT_ONCE = 1 << 20


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    data = np.frombuffer(as_bytes(text).lower(), dtype=np.uint8)
    return window_hashes(hashed_words(data), size)


def cartesian_windows(values: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (l, c, r) at least ``width`` wide of the Cartesian trees over the stretches ``low`` to ``high``.

    All trees grow by a level at a time; of ties the one nearest to the middle is the node.
    """
    found = []
    while True:
        wide = high - low + 1 >= width
        low, high = low[wide], high[wide]
        if not len(low):
            break
        n = high - low + 1
        ends = np.cumsum(n)
        starts = ends - n
        index = np.arange(ends[-1]) + np.repeat(low - starts, n)
        part = values[index]
        ties = np.flatnonzero(part == np.repeat(np.minimum.reduceat(part, starts), n))
        if len(ties) > len(low):
            of = np.searchsorted(ends, ties, side="right")
            ties = ties[np.lexsort((np.abs(2 * (ties - starts[of]) - n[of] + 1), of))]
            ties = ties[np.searchsorted(of, np.arange(len(low)))]
        at = index[ties]
        found.append((low, at, high))
        low, high = np.concatenate([low, at + 1]), np.concatenate([at - 1, high])
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (low, low, low)


def _around(hashes: np.ndarray) -> np.ndarray:
    """For each shingle, 32 bits of the least hash of those near it."""
    most = np.full(_AROUND, np.iinfo(np.uint64).max)
    least = sliding(np.concatenate([most, mixed(hashes ^ np.uint64(_ORDER_SEED)), most]), 2 * _AROUND + 1)
    return (least >> np.uint64(32)).astype(np.int64)


def text_windows(rows: DataFrame, functions: int, width: int, size: int) -> DataFrame:
    """``row, fn, key, spots``: the least hashes of each text, once each, with their compact windows.

    ``spots`` has four numbers for each window: its bounds, the place of the least hash
    and a hash of what stands around that place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                hashes = shingles(text.as_py(), size)
                if len(hashes) >= width:
                    held.append((row, hashes))
                    n += len(hashes)
                if n >= _SHINGLES_IN_TREES:
                    yield windows_of(held)
                    held, n = [], 0
            if held:
                yield windows_of(held)

    def windows_of(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        lengths = np.array([len(h) for _, h in held])
        highs = np.cumsum(lengths) - 1
        lows, rows = highs - lengths + 1, np.array([r for r, _ in held])
        hashes, around = np.concatenate([h for _, h in held]), np.concatenate([_around(h) for _, h in held])
        parts = []
        for fn in range(functions):
            values = mixed(hashes ^ np.uint64(_SEEDS[fn]))
            low, at, high = cartesian_windows(values, lows, highs, width)
            of = np.searchsorted(highs, at)
            first = lows[of]
            parts.append(np.column_stack([of, np.full(len(at), fn), values[at].view(np.int64), low - first, at - first, high - first, around[at]]))
        table = np.concatenate(parts)
        table = table[np.lexsort((table[:, 3], table[:, 2], table[:, 1], table[:, 0]))]
        heads = np.flatnonzero(np.concatenate([[True], (table[1:, :3] != table[:-1, :3]).any(axis=1)]))
        offsets = pa.array((4 * np.append(heads, len(table))).astype(np.int32))
        spots = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(table[:, 3:]).astype(np.uint32).view(np.int32).ravel()))
        columns = [pa.array(rows[table[heads, 0]]), pa.array(table[heads, 1].astype(np.int32)), pa.array(table[heads, 2]), spots]
        return pa.RecordBatch.from_arrays(columns, ["row", "fn", "key", "spots"])

    return rows.select(F.col("row_number_").alias("row"), "text").mapInArrow(run, "row long, fn int, key long, spots array<int>")


def joint_signatures(windows: DataFrame, width: int) -> DataFrame:
    """``row, sign, local, places``: stretches of a text under the least hashes of two functions.

    The interval join runs inside a text: windows of each two functions that have a
    stretch of ``width`` shingles in common which holds both places of the least hashes.
    A text has one row for each signature; ``places`` are pairs of 32-bit numbers, the
    bounds of each stretch, and ``local`` is what stands around the first one's two places.
    """
    whole = windows.groupBy("row").agg(F.collect_list(F.struct("fn", "key", "spots")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found")
            inner = lists.flatten()
            spots = inner.field(2)
            counts = np.diff(spots.offsets.to_numpy()) // 4
            fn, key = (np.repeat(inner.field(i).to_numpy(), counts) for i in range(2))
            low, at, high, around = spots.flatten().to_numpy().reshape(-1, 4).T
            # Texts lie behind each other on one line, so windows of two texts never meet.
            texts = np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.repeat(np.arange(len(texts)), texts), counts)
            ends = np.zeros(len(texts), dtype=np.int64)
            np.maximum.at(ends, of, high + 1)
            base = (np.cumsum(ends) - ends)[of]
            low, at, high = low + base, at + base, high + base
            rows, out = batch.column("row").to_numpy()[of], []
            for a, b in _meeting(fn, low, at, high, width):
                sign = mixed(key[a].view(np.uint64) ^ mixed(key[b].view(np.uint64)))
                local = (around[a].astype(np.int64) << 32) | around[b].view(np.uint32).astype(np.int64)
                # All stretches of both windows that hold both places lie between these bounds.
                bounds = np.maximum(low[a], low[b]) - base[a], np.minimum(high[a], high[b]) - base[a]
                out.append(np.column_stack([rows[a], sign.view(np.int64), *bounds, local]))
            table = np.concatenate(out) if out else np.empty((0, 5), dtype=np.int64)
            if len(table):
                table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
                heads = np.flatnonzero(np.concatenate([[True], (table[1:, :2] != table[:-1, :2]).any(axis=1)]))
                offsets = (8 * np.append(heads, len(table))).astype(np.int32)
                buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(table[:, 2:4].astype("<i4")))]
                places = pa.Array.from_buffers(pa.binary(), len(heads), buffers)
                columns = [*(pa.array(table[heads, i]) for i in (0, 1, 4)), places]
                yield pa.RecordBatch.from_arrays(columns, ["row", "sign", "local", "places"])

    return whole.mapInArrow(run, "row long, sign long, local long, places binary")


def _meeting(fn, low, at, high, width) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of windows of two functions that share a stretch of the width around both places."""
    kinds = np.unique(fn)
    for i, f in enumerate(kinds):
        for g in kinds[i + 1 :]:
            a, b = np.flatnonzero(fn == f), np.flatnonzero(fn == g)
            # Windows of g in order of place: a partner's place is inside the window of f.
            b = b[np.argsort(at[b], kind="stable")]
            begin, end = np.searchsorted(at[b], low[a]), np.searchsorted(at[b], high[a], side="right")
            counts = end - begin
            # So many pairs at once; one window has no more partners than the text has windows.
            for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(counts) // _PAIRS_AT_ONCE)) + 1):
                n = counts[part]
                first = np.repeat(a[part], n)
                second = b[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[part], n)]
                inside = (low[second] <= at[first]) & (at[first] <= high[second])
                inside &= np.minimum(high[first], high[second]) - np.maximum(low[first], low[second]) + 1 >= width
                yield first[inside], second[inside]


def neighbour_pairs(signs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row, other, mine, theirs, sign``: texts that follow each other under one signature.

    The signatures are range partitioned and sorted, with what stands around the least
    hashes next and the text last, so one that very many texts have is spread over tasks. Two rows of each partition go to the driver,
    which pairs those on two sides of a partition bound. The stage they are read from is
    returned beside them. ``row`` is the later text of a pair; ``sign`` is null where no
    third text has the signature.
    """
    schema = "row long, other long, mine binary, theirs binary, sign long, part int, edge int"
    kinds = [("row", pa.int64()), ("other", pa.int64()), ("mine", pa.binary()), ("theirs", pa.binary()), ("sign", pa.int64()), ("part", pa.int32()), ("edge", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, third = TaskContext.get().partitionId(), None, True

        def marked(row: pa.Table, edge: int) -> list[pa.RecordBatch]:
            values = (row.column("row"), row.column("row"), row.column("places"), row.column("places"), row.column("sign"), [part], [edge])
            return pa.table([pa.chunked_array(v) if isinstance(v, pa.ChunkedArray) else pa.array(v, k) for v, (_, k) in zip(values, kinds)], schema=pa.schema(kinds)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is None:
                yield from marked(table.slice(0, 1), 1)
            else:
                table = pa.concat_tables([held, table]).combine_chunks()
            sign, n = table.column("sign").to_numpy(), table.num_rows
            same = sign[1:] == sign[:-1]
            # Rows beyond the batch or the partition are taken to have the signature too.
            more = np.concatenate([[third], same[:-1]]) | np.append(same[1:], True) if n > 1 else same
            later, third = np.flatnonzero(same) + 1, bool(same[-1]) if n > 1 else True
            mine, theirs = table.take(pa.array(later)), table.take(pa.array(later - 1))
            rest = [pa.array(np.full(len(later), v, dtype=np.int32)) for v in (part, 0)]
            columns = [mine.column("row"), theirs.column("row"), mine.column("places"), theirs.column("places"), pa.array(sign[later], mask=~more[later - 1]), *rest]
            yield from pa.table(columns, schema=pa.schema(kinds)).to_batches()
            held = table.slice(n - 1)
        if held is not None:
            yield from marked(held, 2)

    order = ("sign", "local", "row")
    found = stored(signs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    edges = found.where("edge > 0").orderBy("part", "edge").collect()
    across = [
        (b.row, a.row, b.mine, a.mine, b.sign) for a, b in zip(edges, edges[1:]) if a.part != b.part and a.edge == 2 and b.edge == 1 and a.sign == b.sign
    ]
    inner = found.where("edge = 0").select("row", "other", "mine", "theirs", "sign")
    pairs = inner.unionByName(signs.sparkSession.createDataFrame(across, inner.schema))
    later = F.col("row") > F.col("other")
    sides = [F.when(later, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("mine", "theirs"), ("theirs", "mine"))]
    return pairs.select(F.greatest("row", "other").alias("row"), F.least("row", "other").alias("other"), *sides, "sign"), found


def _merged(of: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one list that touch or overlap as one, in order: ``of, low, high``. Lists are numbered from 0 by ``of``."""
    # Lists lie behind each other on one line, so stretches of two lists never meet.
    low, high = ((of << 32) + bounds[:, i] for i in range(2))
    order = np.argsort(low, kind="stable")
    of, low, reach = of[order], low[order], np.maximum.accumulate(high[order])
    first = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1] + 1])) if len(of) else order
    last = np.append(first[1:], len(of)) - 1 if len(of) else order
    of = of[first]
    return of, low[first] - (of << 32), reach[last] - (of << 32)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 32-bit numbers of a column of bytes, and how many each row has."""
    counts = pc.binary_length(values).to_numpy(zero_copy_only=False) // 4
    return np.frombuffer(b"".join(values.to_pylist()), dtype="<i4"), counts


def _regions(pairs: DataFrame) -> DataFrame:
    """For each text and partner, the merged places of both and the signatures that a third text has: ``row, other, mine, theirs, signs``."""
    whole = pairs.groupBy("row", "other").agg(*(F.collect_list(c).alias(f"{c}s" if c == "sign" else c) for c in ("mine", "theirs", "sign")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for lists in (batch.column("mine"), batch.column("theirs")):
                numbers, counts = _numbers(lists.flatten())
                of = np.repeat(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), counts // 2)
                of, low, high = _merged(of, numbers.reshape(-1, 2).astype(np.int64))
                both = pa.StructArray.from_arrays([pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["low", "high"])
                merged.append(pa.ListArray.from_arrays(_offsets(np.bincount(of, minlength=len(lists))), both))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("other"), *merged, batch.column("signs")], ["row", "other", "mine", "theirs", "signs"])

    ranges = "array<struct<low: int, high: int>>"
    return whole.mapInArrow(run, f"row long, other long, mine {ranges}, theirs {ranges}, signs array<long>")


def _texts_at_once(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first, last, hashes, base``: 32 bits of each shingle of some texts that follow each other, and where each one's begin."""
    held, first, n = [], 0, 0
    for i, text in enumerate(texts):
        held.append(shingles(text.as_py(), size).astype("<u4"))
        n += len(held[-1])
        if n >= _SHINGLES_IN_TREES or i + 1 == len(texts):
            lengths = np.array([len(h) for h in held])
            yield first, i + 1, np.concatenate(held), np.cumsum(lengths) - lengths
            held, first, n = [], i + 1, 0


def _cuts(hashes: np.ndarray, low: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Bytes of each stretch of the hashes."""
    ends = np.cumsum(lengths)
    cut = hashes[np.arange(lengths.sum()) + np.repeat(low - ends + lengths, lengths)]
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(4 * _offsets(lengths)), pa.py_buffer(cut)])


def _parts(lengths: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the lengths in parts of about so much in all, or of one length."""
    return [p for p in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(np.cumsum(lengths) // most)) + 1) if len(p)]


def _cut_out(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``row, other, side, low, hashes``: shingles of the wanted stretches of each text.

    Two stretches are compared by 32 bits of each hash, enough among a pair's shingles.
    """
    places = wanted.groupBy("text_row").agg(F.collect_list(F.struct("row", "other", "side", "ranges")).alias("places"))
    texts = rows.select(F.col("row_number_").alias("text_row"), "text").join(places, "text_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("places")
            places, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ranges = places.field(3)
            at = ranges.offsets.to_numpy() - ranges.offsets[0].as_py()
            low, high = (ranges.flatten().field(i).to_numpy().astype(np.int64) for i in range(2))
            of = np.repeat(np.arange(len(places)), np.diff(at))
            keys = [places.field(i).to_numpy()[of] for i in range(3)]
            text, lengths = np.repeat(np.arange(len(lists)), np.diff(offsets))[of], high - low + 1
            for first, last, hashes, base in _texts_at_once(batch.column("text"), size):
                inside = np.arange(at[offsets[first]], at[offsets[last]])
                for part in _parts(lengths[inside], _SHINGLES_AT_ONCE):
                    part = inside[part]
                    cut = _cuts(hashes, low[part] + base[text[part] - first], lengths[part])
                    columns = [*(pa.array(k[part]) for k in keys), pa.array(low[part].astype(np.int32)), cut]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "other", "side", "low", "hashes"])

    return texts.select("text", "places").mapInArrow(run, "row long, other long, side int, low int, hashes binary")


def has_dense(shared: np.ndarray, lengths: np.ndarray, similarity: float, width: int) -> np.ndarray:
    """For stretches behind each other, whether ``dense_stretches`` finds any; of few others too.

    Scores are summed along all stretches at once. The scan begins anew where a sum is less
    than all before it, and finds a stretch at a shared place as far as the width behind that.
    """
    found = np.zeros(len(lengths), dtype=bool)
    if not len(shared):
        return found
    # Each stretch has a place before its first one; its sums begin below all those before it.
    loss = int(similarity * 10**9) - 1
    begin = np.cumsum(lengths) - lengths + np.arange(len(lengths))
    inside = np.ones(len(shared) + len(lengths), dtype=bool)
    inside[begin] = False
    on = np.zeros(len(inside), dtype=bool)
    on[inside] = shared
    sums = np.where(on, 10**9 - loss, -loss)
    sums[begin[1:]] = -(10**9) * (lengths[:-1] + 1)
    sums[0] = 0
    sums = np.cumsum(sums)
    index, fresh = np.arange(len(sums)), np.ones(len(sums), dtype=bool)
    fresh[1:] = sums[1:] < np.minimum.accumulate(sums)[:-1]
    since = index - np.maximum.accumulate(np.where(fresh, index, 0))
    return np.logical_or.reduceat(on & (since >= width), begin)


def dense_stretches(shared: np.ndarray, similarity: float, width: int) -> list[tuple[int, int]]:
    """Stretches of at least ``width`` in which at least ``similarity`` of the places are shared.

    A shared place scores 1 - s, another one -s; a scan ends where its score falls below 0,
    and the stretch is cut at its best place of those wide enough. The next scan begins at
    the first run behind that place.
    """
    found, at, n = [], 0, len(shared)
    gain, loss = 1 - similarity, similarity
    runs = np.flatnonzero(np.diff(np.concatenate([[0], shared.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
    while at < len(runs):
        first, score, best, end, behind = runs[at][0], 0.0, 0.0, None, at + 1
        before = first
        while at < len(runs):
            low, high = runs[at]
            score -= loss * (low - before)
            if score < 0 and low != first:
                break
            score += gain * (high - low)
            before = high
            at += 1
            if high - first >= width and score >= best:
                best, end, behind = score, high, at
        if end is not None and end <= n:
            found.append((first, end))
            at = behind
    return found


def verified_passages(sides: list[list[tuple[int, np.ndarray]]], similarity: float, width: int, size: int) -> list[tuple[int, int, int, float]]:
    """``side, start_word, n_words, similarity``: passages of each of two texts that are near the other's stretches."""
    out = []
    for mine, theirs in ((0, 1), (1, 0)):
        known = np.sort(np.concatenate([h for _, h in sides[theirs]]))
        for low, hashes in sides[mine]:
            shared = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
            for a, b in dense_stretches(shared, similarity, width):
                share = float(shared[a:b].mean())
                if share >= similarity:
                    out.append((mine, low + a, b - a + size - 1, round(share, 4)))
    return out


def _dealt(row: Column, back: bool = False) -> Column:
    """A number of its own for each row number, in an order unlike theirs, and back."""
    low, high = row.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(row, 32)
    for side in (1, 0) if back else (0, 1):
        if side:
            low = low.bitwiseXOR(F.xxhash64(high).bitwiseAND(0xFFFFFFFF))
        else:
            high = high.bitwiseXOR(F.xxhash64(low).bitwiseAND(0x7FFFFFFF))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _classes(links: DataFrame) -> DataFrame:
    """``node, root`` of each row with a link ``a, b``; a chain in the order of rows would take a round for each of its links."""
    found = components(links.select(_dealt(F.col("a")).alias("a"), _dealt(F.col("b")).alias("b")))
    return found.select(*(_dealt(F.col(c), back=True).alias(c) for c in ("node", "root")))


def _open_stretches(rows: DataFrame, signs: DataFrame, regions: DataFrame, classes: DataFrame) -> DataFrame:
    """``row, sign, places, root, rest``: texts under signatures that several classes have, one of equal texts of a class.

    A signature of several classes has neighbours of two classes. ``rest`` are the texts outside
    a signature's largest class.
    """
    of = lambda name: classes.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    apart = regions.where(F.size("signs") > 0).select("row", "other", "signs").join(of("row"), "row", "left").join(of("other"), "other", "left")
    apart = apart.where(F.coalesce("row_root", "row") != F.coalesce("other_root", "other"))
    wanted = stored(apart.select(F.explode("signs").alias("sign")).distinct())
    texts = rows.select(F.col("row_number_").alias("row"), F.xxhash64("text").alias("k"), F.xxhash64(F.lit(1), "text").alias("l"))
    texts = texts.join(of("row"), "row", "left").groupBy("k", "l", F.coalesce("row_root", "row").alias("root")).agg(F.min("row").alias("row"))
    held = stored(signs.join(F.broadcast(wanted), "sign").select("row", "sign", "places").join(texts.select("row", "root"), "row"))
    counts = held.groupBy("sign", "root").agg(F.count("*").alias("n"))
    largest = counts.groupBy("sign").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n")).where("n > most.n")
    found = stored(held.join(largest.select("sign", "most.root").withColumnRenamed("root", "main"), "sign").select("row", "sign", "places", "root", (F.col("root") != F.col("main")).alias("rest")))
    discard(wanted, held)
    return found


def _open_shingles(rows: DataFrame, found: DataFrame, width: int, size: int) -> DataFrame:
    """``sign, row, root, rest, n, ranges, hashes``: shingles of each text's stretches under a signature, and of ``width`` places around.

    A passage holds the two least hashes but may begin before one text's stretch or end behind it.
    ``ranges`` are pairs of 32-bit numbers, the first place and the length of each stretch.
    """
    places = found.groupBy("row").agg(F.first("root").alias("root"), F.collect_list(F.struct("sign", "places", "rest")).alias("found"))
    texts = rows.select(F.col("row_number_").alias("row"), "text").join(places, "row")
    names = ["sign", "row", "root", "rest", "n", "ranges", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, row, root = batch.column("found"), batch.column("row").to_numpy(), batch.column("root").to_numpy()
            found, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sign, rest = found.field(0).to_numpy(), found.field(2).to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(lists)), np.diff(offsets))
            for first, last, hashes, base in _texts_at_once(batch.column("text"), size):
                a, b = int(offsets[first]), int(offsets[last])
                numbers, counts = _numbers(found.field(1).slice(a, b - a))
                of = np.repeat(np.arange(b - a), counts // 2)
                ends = np.append(base[1:], len(hashes)) - base
                bounds = numbers.reshape(-1, 2).astype(np.int64) + np.array([-width, width])
                of, low, high = _merged(of, np.clip(bounds, 0, (ends[text[a:b] - first] - 1)[of, None]))
                n = np.bincount(of, weights=high - low + 1, minlength=b - a).astype(np.int64)
                ranges, starts = np.column_stack([low, high - low + 1]).astype("<i4"), _offsets(np.bincount(of, minlength=b - a))
                for part in _parts(n, _SHINGLES_AT_ONCE):
                    inside = np.arange(starts[part[0]], starts[part[-1] + 1])
                    cut = _cuts(hashes, low[inside] + base[text[a:b][of[inside]] - first], ranges[inside, 1].astype(np.int64))
                    # One row has all of its stretches.
                    whole = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(4 * _offsets(n[part])), cut.buffers()[2]])
                    bounds = [None, pa.py_buffer(8 * _offsets(np.diff(starts)[part])), pa.py_buffer(np.ascontiguousarray(ranges[inside]))]
                    at = part + a
                    columns = [sign[at], row[text[at]], root[text[at]], rest[at], n[part]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.Array.from_buffers(pa.binary(), len(part), bounds), whole], names)

    return texts.select("row", "root", "text", "found").mapInArrow(run, "sign long, row long, root long, rest boolean, n long, ranges binary, hashes binary")


class _Met:
    """Stretches of two sides, and which shingles each stretch has of those that both sides have."""

    def __init__(self, left: list[np.ndarray], right: list[np.ndarray]):
        sides = left, right
        self.lengths = [np.array([len(h) for h in side]) for side in sides]
        self.starts = [np.cumsum(n) - n for n in self.lengths]
        cut = [np.concatenate(side) for side in sides]
        keys, place = np.unique(np.concatenate(cut), return_inverse=True)
        place, of = np.split(place, [len(cut[0])]), [np.repeat(np.arange(len(n)), n) for n in self.lengths]
        both = np.ones(len(keys), dtype=bool)
        for at in place:
            both &= np.bincount(at, minlength=len(keys)) > 0
        self.n_keys = int(both.sum())
        # The last number is of all shingles that one side alone has.
        number = np.where(both, np.cumsum(both) - 1, self.n_keys)
        self.at, self.has = [number[at] for at in place], []
        for at, one, n in zip(self.at, of, self.lengths):
            has = np.zeros((self.n_keys + 1, len(n)), dtype=np.uint8)
            has[at, one] = 1
            has[self.n_keys] = 0
            self.has.append(has)
        self.of = of

    def counts(self, side: int) -> np.ndarray:
        """How many places each stretch of a side shares with each one of the other side: ``left, right``."""
        n, found = len(self.lengths[side]), np.zeros((len(self.lengths[0]), len(self.lengths[1])), dtype=np.float32)
        at, of, step = self.at[side], self.of[side], max(1, _CELLS_AT_ONCE // max(found.shape))
        if step < self.n_keys:
            order = np.argsort(at, kind="stable")
            at, of = at[order], of[order]
        for low in range(0, self.n_keys, step):
            high = min(low + step, self.n_keys)
            a, b = np.searchsorted(at, [low, high]) if step < self.n_keys else (0, len(at))
            times = np.bincount((at[a:b] - low) * n + of[a:b], minlength=(high - low) * n)[: (high - low) * n].reshape(-1, n).astype(np.float32)
            other = self.has[1 - side][low:high].astype(np.float32)
            found += other.T @ times if side else times.T @ other
        return found

    def dense(self, side: int, i: np.ndarray, j: np.ndarray, similarity: float, width: int) -> np.ndarray:
        """Of pairs of a side's stretch ``i`` and the other's ``j``, those whose stretch may have a passage."""
        n, found = self.lengths[side][i], np.zeros(len(i), dtype=bool)
        for part in _parts(n, _CELLS_AT_ONCE):
            ends = np.cumsum(n[part])
            place = np.arange(ends[-1]) + np.repeat(self.starts[side][i[part]] - ends + n[part], n[part])
            shared = self.has[1 - side][self.at[side][place], np.repeat(j[part], n[part])]
            found[part] = has_dense(shared, n[part], similarity, width)
        return found


def _links_of_block(left: list[dict], right: list[dict], similarity: float, width: int, size: int) -> Iterator[tuple]:
    """``a, b, row, other, found``: links of texts of two classes, as many as join the classes of a block."""
    cut = [[np.frombuffer(p["hashes"], dtype="<u4") for p in side] for side in (left, right)]
    roots, at = ([np.array([p[c] for p in side]) for side in (left, right)] for c in ("root", "row"))
    # Two texts outside the largest class meet twice.
    rest = np.array([p["rest"] for p in left])[:, None]
    apart = (roots[0][:, None] != roots[1]) & (~rest | (at[0][:, None] < at[1]))
    if not apart.any():
        return
    met = _Met(*cut)
    # A stretch with a passage has so many places with a shingle of the other one.
    least = int(np.ceil(similarity * width - 1e-9))
    likely = [apart & (met.counts(side) >= least) for side in (0, 1)]
    for side in (0, 1):
        i, j = np.nonzero(likely[side])
        likely[side][i, j] = met.dense(side, *((i, j) if side == 0 else (j, i)), similarity, width)
    i, j = np.nonzero(likely[0] | likely[1])
    joined: dict[int, int] = {}

    def top(root: int) -> int:
        while root in joined:
            root = joined[root]
        return root

    for i, j in zip(i.tolist(), j.tolist()):
        a, b = top(left[i]["root"]), top(right[j]["root"])
        if a == b:
            continue
        sides = []
        for p, h in ((left[i], cut[0][i]), (right[j], cut[1][j])):
            low, n = np.frombuffer(p["ranges"], dtype="<i4").reshape(-1, 2).T
            sides.append(list(zip(low.tolist(), np.split(h, np.cumsum(n)[:-1]))))
        found = verified_passages(sides, similarity, width, size)
        if found:
            joined[max(a, b)] = min(a, b)
            yield min(left[i]["root"], right[j]["root"]), max(left[i]["root"], right[j]["root"]), left[i]["row"], right[j]["row"], found


def links_between_classes(cut: DataFrame, similarity: float, width: int, size: int) -> DataFrame:
    """``a, b, row, other, found``: links that join all classes with a near passage under one signature, one for each two classes.

    Texts of a signature are dealt to blocks by their row. Each block meets those of the texts
    outside the largest class, so copies in one class are moved once and not compared.
    """
    blocks = lambda n, length: F.ceil(F.greatest(n / _BLOCK_ROWS, length / _BLOCK_SHINGLES, F.lit(1))).cast("int")
    rest = F.col("rest")
    sizes = cut.groupBy("sign").agg(
        blocks(F.count("*"), F.sum("n")).alias("all_blocks"), blocks(F.count_if(rest), F.sum(F.when(rest, F.col("n")))).alias("rest_blocks")
    )
    # Only a signature of more than 256 texts or 131,072 shingles has several blocks, so the small side is far smaller than the input.
    dealt = cut.join(F.broadcast(sizes.where("all_blocks > 1")), "sign", "left").fillna(1, ["all_blocks", "rest_blocks"])
    block = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stretch = F.struct("row", "root", "rest", "ranges", "hashes").alias("stretch")
    left = dealt.select("sign", block("all_blocks").alias("i"), every("rest_blocks").alias("j"), F.lit(0).alias("side"), stretch)
    right = dealt.where(rest).select("sign", every("all_blocks").alias("i"), block("rest_blocks").alias("j"), F.lit(1).alias("side"), stretch)
    # Dealt by block: all blocks of a signature in one task would be more than its share.
    met = left.unionByName(right).repartition("sign", "i", "j").groupBy("sign", "i", "j").agg(F.collect_list(F.struct("side", "stretch")).alias("met"))
    passage = pa.struct([("side", pa.int32()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for met in batch.column("met"):
                sides = [[], []]
                for one in met.as_py():
                    sides[one["side"]].append(one["stretch"])
                if all(sides):
                    for side in sides:
                        side.sort(key=lambda p: p["row"])
                    out += _links_of_block(*sides, similarity, width, size)
            columns = list(zip(*out)) or [()] * 5
            found = pa.array([[dict(zip(("side", "start_word", "n_words", "similarity"), f)) for f in fs] for fs in columns[4]], pa.list_(passage))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), found], ["a", "b", "row", "other", "found"])

    found = met.select("met").mapInArrow(run, "a long, b long, row long, other long, found array<struct<side: int, start_word: long, n_words: long, similarity: double>>")
    return found.groupBy("a", "b").agg(F.min(F.struct("row", "other", "found")).alias("link")).select("a", "b", "link.*")


def near_passages(
    docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, functions: int = FUNCTIONS, size: int = SHINGLE
) -> DataFrame:
    """``doc_id, other_doc_id, start_word, n_words, similarity, class_id``: passages near one of another row.

    A passage has ``min_words`` words or more, of whose shingles at least ``similarity``
    are in the partner's passage. Any two rows with a joint signature and a near passage under
    it have one ``class_id``, a row number that no other class has; rows not returned are
    classes of their own. Partners are rows that follow each other among those with a joint
    signature, ordered by what stands around it, and one pair of each two classes that a further
    passage joins; a pair is returned from both sides, each with its own place. Null, empty
    and short texts have no passage; rows of one ``doc_id``, null or not, are texts of their
    own. ``docs`` has to be a stored table.
    """
    rows = numbered(docs.select("doc_id", "text"))
    width = min_words - size + 1
    windows = stored(text_windows(rows, functions, width, size))
    left = with_neighbours(windows, ("key", "row"), same_key, within=("key",)).drop("before", "after")
    discard(windows)
    signs = stored(joint_signatures(left, width), batch_rows=1000)
    discard(left)
    pairs, found = neighbour_pairs(signs)
    regions = stored(_regions(pairs), batch_rows=1000)
    discard(found)
    wanted = regions.select(F.col("row").alias("text_row"), "row", "other", F.lit(0).alias("side"), F.col("mine").alias("ranges")).unionByName(
        regions.select(F.col("other").alias("text_row"), "row", "other", F.lit(1).alias("side"), F.col("theirs").alias("ranges"))
    )
    both = _cut_out(rows, wanted, size).groupBy("row", "other").agg(F.collect_list(F.struct("side", "low", "hashes")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["row", "other", "start_word", "n_words", "similarity"], [pa.int64()] * 4 + [pa.float64()]
        for batch in batches:
            out, pairs = [], [batch.column(c).to_numpy() for c in ("row", "other")]
            lists = batch.column("parts")
            parts, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
            pair, side, low = np.repeat(np.arange(len(lists)), counts), parts.field(0).to_numpy(), parts.field(1).to_numpy()
            numbers, n = _numbers(parts.field(2))
            # A shingle is looked up among those of its pair's other side.
            own = np.repeat((2 * pair + side).astype(np.uint64) << np.uint64(32), n)
            hashes, ends = numbers.view("<u4").astype(np.uint64), np.cumsum(n)
            known, wanted = np.sort(own | hashes), (own ^ np.uint64(1 << 32)) | hashes
            shared = known[np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))] == wanted
            for i in np.flatnonzero(has_dense(shared, n, similarity, width)).tolist():
                mine, here = shared[ends[i] - n[i] : ends[i]], int(side[i])
                for a, b in dense_stretches(mine, similarity, width):
                    share = float(mine[a:b].mean())
                    if share >= similarity:
                        out.append((pairs[here][pair[i]], pairs[1 - here][pair[i]], low[i] + a, b - a + size - 1, round(share, 4)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    verified = stored(
        both.mapInArrow(run, "row long, other long, start_word long, n_words long, similarity double").distinct(), batch_rows=16
    )
    classes = _classes(verified.select(F.col("row").alias("a"), F.col("other").alias("b")))
    between = _open_stretches(rows, signs, regions, classes)
    discard(regions, signs)
    cut = stored(_open_shingles(rows, between, width, size), batch_rows=1000)
    discard(between)
    links = stored(links_between_classes(cut, similarity, width, size), batch_rows=16)
    discard(cut)
    ends = F.col("side") == 0
    further = links.select("row", "other", F.explode("found").alias("one")).select("row", "other", "one.*")
    further = further.select(
        F.when(ends, F.col("row")).otherwise(F.col("other")).alias("row"), F.when(ends, F.col("other")).otherwise(F.col("row")).alias("other"), "start_word", "n_words", "similarity"
    )
    joined = _classes(links.select("a", "b")).withColumnsRenamed({"node": "of", "root": "class_id"})
    of = classes.select(F.col("node").alias("row"), F.col("root").alias("of"))
    passages = verified.unionByName(further).join(of, "row", "left").withColumn("of", F.coalesce("of", "row")).join(joined, "of", "left")
    passages = passages.withColumn("class_id", F.coalesce("class_id", "of"))
    ids = rows.select(F.col("row_number_").alias("row"), "doc_id")
    others = ids.withColumnsRenamed({"row": "other", "doc_id": "other_doc_id"})
    return passages.join(ids, "row").join(others, "other").select("doc_id", "other_doc_id", "start_word", "n_words", "similarity", "class_id")
