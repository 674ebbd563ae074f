"""Exact top-k by inner product with a paged M-tree.

Distances are Euclidean, so the triangle inequality holds, and they give scores: of a query
q and a row x, q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2. A node of the tree has a routing row, a
covering radius, the largest norm inside, and its routing row's distance to the parent's.

Rows are dealt to the nearest of a few pivots, fitted on a bounded sample, range partitioned
by pivot and cut into pages of bounded size, however many rows a pivot has. A page is a tree
of its own, built in one task and stored as one row: nodes and rows in order of the tree.

A search goes best first: the open node with the highest possible score comes next, with
the queries whose k-th best found is below that; it ends when no node is open. From the stored distance to the parent
alone, |d(q, parent) - d(parent, x)| <= d(q, x), most nodes and rows are passed over before
any product with them is computed. Queries first search the page they lie in, which gives
each a bound; blocks of queries then meet blocks of page heads, and only pages that may
beat a query's bound are searched for it. Partial results are merged by rank, so no query's
candidates are gathered.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lactoscope.llm.stages import batches_of, numbered, stored

# Fitted on at most so many rows, whatever the size of the table.
SAMPLE_ROWS, PIVOTS = 2048, 16
PAGE_ROWS, LEAF_ROWS, FAN_OUT = 4096, 64, 16
QUERY_BLOCK, HEAD_BLOCK, HEAD_COPIES = 256, 512, 16
# Pages that a task searches, as their bytes say nothing about the work.
TASK_PAGES = 4
SCALE = 256
# Sums of products below this are exact in doubles.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
# Of a bound, against rounding of roots and products.
_SLACK = 1e-9

_TREE = "page long, rows int, width int, peak double, vectors binary, ids binary, numbers binary, asked binary, spans binary, reach binary"


def quantized(table: DataFrame, key: str, vector: str, asked: Column, scale: int = SCALE) -> DataFrame:
    """``number, id, asked, values``: floor(scale * x) of each usable vector, as doubles.

    Vectors that are null or hold a null, non-finite or (times the scale) overflowing
    component take no part.
    """
    rows = numbered(table, "number").select("number", F.col(key).alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), F.col(vector).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for vector in batch.column("vector"):
                items = vector.values
                values = None
                if items is not None and not items.null_count:
                    with np.errstate(over="ignore"):
                        values = np.floor(scale * items.to_numpy(zero_copy_only=False).astype(float))
                    values = values.tobytes() if np.isfinite(values).all() else None
                cells.append(values)
            columns = [*(batch.column(c) for c in ("number", "id", "asked")), pa.array(cells, pa.binary())]
            out = pa.RecordBatch.from_arrays(columns, ["number", "id", "asked", "values"])
            yield out.filter(out.column("values").is_valid())

    return rows.mapInArrow(run, "number long, id long, asked boolean, values binary")


def _matrix(cells: list[bytes], width: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    width = max((len(c) // 8 for c in cells), default=0) if width is None else width
    if all(len(c) == 8 * width for c in cells):
        return np.frombuffer(b"".join(cells), dtype=float).reshape(len(cells), width)
    table = np.zeros((len(cells), width))
    for row, cell in zip(table, cells):
        row[: len(cell) // 8] = np.frombuffer(cell, dtype=float)[:width]
    return table


def _distances(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(((rows - centre) ** 2).sum(axis=1))


def fitted_pivots(rows: DataFrame, count: int = PIVOTS, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """Vectors far from one another, from a sample of bounded size chosen by a hash of the row."""
    cells = [r[0] for r in rows.orderBy(F.xxhash64("number")).select("values").limit(sample).toLocalIterator()]
    table = _matrix(cells)
    if not len(table):
        return table
    chosen = [0]
    nearest = _distances(table, table[0])
    while len(chosen) < min(count, len(table)):
        following = int(np.nan_to_num(nearest).argmax())
        if not nearest[following] > 0:
            break
        chosen.append(following)
        nearest = np.minimum(nearest, _distances(table, table[following]))
    return table[chosen]


def _dealt(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The rows with the number of their nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = _matrix(batch.column("values").to_pylist())
            width = max(table.shape[1], pivots.shape[1])
            a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (table, pivots))
            far = np.stack([_distances(a, p) for p in b])
            near = np.nan_to_num(far, nan=np.inf).argmin(axis=0)
            apart = far[near, np.arange(len(a))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(apart)], [*batch.schema.names, "pivot", "apart"])

    return rows.mapInArrow(run, "number long, id long, asked boolean, values binary, pivot int, apart double")


def _split(table: np.ndarray, fan_out: int) -> list[np.ndarray]:
    """Row numbers by nearest of some far-off rows, or by place where all rows are alike."""
    chosen, nearest = [0], _distances(table, table[0])
    owner = np.zeros(len(table), dtype=int)
    while len(chosen) < fan_out:
        following = int(np.nan_to_num(nearest).argmax())
        if not nearest[following] > 0:
            break
        away = _distances(table, table[following])
        closer = away < nearest
        owner[closer], nearest = len(chosen), np.where(closer, away, nearest)
        chosen.append(following)
    parts = [np.flatnonzero(owner == i) for i in range(len(chosen))]
    parts = [p for p in parts if len(p)]
    return parts if len(parts) > 1 else np.array_split(np.arange(len(table)), 2)


def built(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree over the rows of a page: an order of the rows, node spans and node reaches.

    A span is (first row, row after the last, first child node, node after the last child,
    routing row); a leaf has no children. A reach is (covering radius, largest norm, distance
    of the routing row to the parent's). Node 0 is the root. The last column of the third
    array is per row: its distance to its leaf's routing row.
    """
    order, spans, reach, to_leaf = np.arange(len(table)), [], [], np.zeros(len(table))
    with np.errstate(all="ignore"):
        norms = np.sqrt((table**2).sum(axis=1))

    def routing(rows: np.ndarray) -> int:
        return int(rows[np.nan_to_num(_distances(table[rows], table[rows].mean(axis=0)), nan=np.inf).argmin()])

    # Breadth first, so that the children of a node are numbered in a row.
    waiting = [(0, len(table), routing(order), 0.0)] if len(table) else []
    at = 0
    while at < len(waiting):
        low, high, centre, to_parent = waiting[at]
        rows = order[low:high]
        away = _distances(table[rows], table[centre])
        reach.append((away.max(), norms[rows].max(), to_parent))
        first_child = last_child = len(waiting)
        if len(rows) > LEAF_ROWS:
            parts, begin = _split(table[rows], FAN_OUT), low
            order[low:high] = rows[np.concatenate(parts)]
            for part in parts:
                middle = routing(rows[part])
                waiting.append((begin, begin + len(part), middle, float(_distances(table[middle : middle + 1], table[centre])[0])))
                begin += len(part)
            last_child = len(waiting)
        else:
            to_leaf[low:high] = away
        spans.append((low, high, first_child, last_child, centre))
        at += 1
    place = np.empty(len(table), dtype=int)
    place[order] = np.arange(len(table))
    spans = np.array(spans, dtype=np.int32).reshape(-1, 5)
    spans[:, 4] = place[spans[:, 4]]
    return order, spans, np.array(reach, dtype=float).reshape(-1, 3), to_leaf


def pages(dealt: DataFrame) -> DataFrame:
    """Trees of at most ``PAGE_ROWS`` rows each, cut from the rows in order of pivot and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial, held, pivot = TaskContext.get().partitionId() << 32, [], None

        def page():
            nonlocal serial, held
            serial += 1
            table = _matrix([r["values"] for r in held])
            order, spans, reach, to_leaf = built(table)
            ids = np.array([_LONG if r["id"] is None else r["id"] for r in held], dtype=np.int64)
            known = np.array([r["id"] is not None for r in held])
            row = {
                "page": serial,
                "rows": len(held),
                "width": table.shape[1],
                "peak": float(np.abs(table).max(initial=0.0)),
                "vectors": np.ascontiguousarray(table[order]).tobytes(),
                "ids": np.column_stack([ids, known])[order].tobytes(),
                "numbers": np.array([r["number"] for r in held], dtype=np.int64)[order].tobytes(),
                "asked": np.flatnonzero(np.array([r["asked"] for r in held])[order]).astype(np.int32).tobytes(),
                "spans": spans.tobytes(),
                "reach": np.concatenate([reach.ravel(), to_leaf]).tobytes(),
            }
            held = []
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["pivot"] != pivot or len(held) >= PAGE_ROWS):
                    yield page()
                pivot = r["pivot"]
                held.append(r)
        if held:
            yield page()

    kinds = pa.schema([("page", pa.int64()), ("rows", pa.int32()), ("width", pa.int32()), ("peak", pa.float64())] + [(c, pa.binary()) for c in ("vectors", "ids", "numbers", "asked", "spans", "reach")])
    order = ("pivot", "apart", "number")
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _TREE)


class Page:
    """A stored tree, searched for a block of queries at a time."""

    def __init__(self, row: dict):
        self.n, self.width, self.peak = row["rows"], row["width"], row["peak"]
        self.vectors = np.frombuffer(row["vectors"]).reshape(self.n, self.width)
        ids = np.frombuffer(row["ids"], dtype=np.int64).reshape(-1, 2)
        self.ids, self.known = ids[:, 0], ids[:, 1]
        self.numbers = np.frombuffer(row["numbers"], dtype=np.int64)
        self.asked = np.frombuffer(row["asked"], dtype=np.int32)
        self.spans = np.frombuffer(row["spans"], dtype=np.int32).reshape(-1, 5)
        reach = np.frombuffer(row["reach"])
        nodes = len(self.spans)
        self.radius, self.norm, self.to_parent = reach[: 3 * nodes].reshape(-1, 3).T
        self.to_leaf = reach[3 * nodes :]
        with np.errstate(all="ignore"):
            self.squares = (self.vectors**2).sum(axis=1)
        self.computed = 0

    def search(self, queries: np.ndarray, numbers: np.ndarray, k: int, bounds: np.ndarray) -> tuple[list[list[tuple]], np.ndarray]:
        """For each query its ``k`` best rows of score ``bounds`` or more, and its new bound.

        A row is (score, id, known, number); the row with the query's own number is left out.
        Best first: the open node with the highest score that it may hold for any query comes
        next, and brings along the queries that it may still serve.
        """
        width = min(queries.shape[1], self.width)
        q = np.zeros((len(queries), self.width))
        q[:, :width] = queries[:, :width]
        bounds, best = np.array(bounds, dtype=float), [[] for _ in queries]
        with np.errstate(all="ignore"):
            square = (queries**2).sum(axis=1)
        exact = np.abs(queries).max(axis=1, initial=0.0) * self.peak * max(width, 1) < _EXACT
        length = np.sqrt(square)

        def highest(asked, apart, norm, product=None, radius=0.0):
            """Upper bounds of q.x by distance and, with a routing product, by the ball."""
            with np.errstate(all="ignore"):
                size = square[asked][:, None] + norm**2
                found = (size - np.maximum(apart, 0.0) ** 2) / 2
                if product is not None:
                    found = np.fmin(found, product + length[asked][:, None] * radius)
                found = found + _SLACK * size + 1e-6
                # Scores are cut to 64 bits, so none is below the least of those.
                return np.where(np.isnan(found), np.inf, np.maximum(found, -float(1 << 63)))

        def routed(asked, rows):
            """Products with routing rows, and distances to them."""
            self.computed += len(asked) * len(rows)
            with np.errstate(all="ignore"):
                product = q[asked] @ self.vectors[rows].T
                return product, np.sqrt(np.maximum(square[asked][:, None] + self.squares[rows] - 2 * product, 0.0))

        def taken(at: int, scores, rows):
            """Rows of a leaf among the best of one query."""
            listed = [(s, int(self.ids[r]), bool(self.known[r]), int(self.numbers[r])) for s, r in zip(scores, rows) if self.numbers[r] != numbers[at]]
            merged = sorted(best[at] + listed, key=lambda x: (-x[0], not x[2], x[1], x[3]))[:k]
            best[at] = merged
            if len(merged) == k:
                bounds[at] = max(bounds[at], _rounded_down(merged[-1][0]))

        asked = np.arange(len(queries))
        product, away = routed(asked, self.spans[:1, 4])
        limit = highest(asked, away - self.radius[:1], self.norm[:1], product, self.radius[:1])[:, 0]
        heap, turn = [(-limit.max(initial=-np.inf), 0, 0, asked, limit, away[:, 0])], 0
        while heap:
            _, _, node, asked, limit, to_centre = heapq.heappop(heap)
            still = limit >= bounds[asked]
            if not still.any():
                continue
            asked, to_centre = asked[still], to_centre[still]
            low, high, first_child, last_child, _ = self.spans[node].tolist()
            if first_child == last_child:
                # Rows passed over by their stored distance to the leaf's routing row alone.
                with np.errstate(all="ignore"):
                    norms = np.sqrt(self.squares[low:high])
                open_ = highest(asked, np.abs(to_centre[:, None] - self.to_leaf[low:high]), norms) >= bounds[asked][:, None]
                rows, some = np.flatnonzero(open_.any(axis=0)) + low, open_.any(axis=1)
                asked = asked[some]
                if not len(asked):
                    continue
                self.computed += len(asked) * len(rows)
                quick = asked[exact[asked]]
                scores = q[quick] @ self.vectors[rows].T
                least = bounds[quick]
                if len(rows) > k + 1:
                    # The best k and the query's own row are all that a leaf can add, ties included.
                    least = np.maximum(least, np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)])
                hits = scores >= least[:, None]
                for i in np.flatnonzero(hits.any(axis=1)).tolist():
                    there = np.flatnonzero(hits[i])
                    taken(int(quick[i]), scores[i, there].astype(np.int64).tolist(), rows[there].tolist())
                for at in asked[~exact[asked]].tolist():
                    whole = [int(v) for v in q[at].tolist()]
                    sums = [_cut(sum(int(v) * w for v, w in zip(self.vectors[r].tolist(), whole))) for r in rows.tolist()]
                    there = [i for i, s in enumerate(sums) if s >= bounds[at]]
                    taken(at, [sums[i] for i in there], rows[there].tolist())
                continue
            children = np.arange(first_child, last_child)
            # Nodes passed over by their routing row's stored distance to the parent's.
            nearest = np.abs(to_centre[:, None] - self.to_parent[children]) - self.radius[children]
            open_ = highest(asked, nearest, self.norm[children]) >= bounds[asked][:, None]
            children, some = children[open_.any(axis=0)], open_.any(axis=1)
            if not len(children):
                continue
            asked = asked[some]
            product, away = routed(asked, self.spans[children, 4])
            limits = highest(asked, away - self.radius[children], self.norm[children], product, self.radius[children])
            for j, child in enumerate(children.tolist()):
                still = limits[:, j] >= bounds[asked]
                if still.any():
                    turn += 1
                    heapq.heappush(heap, (-limits[still, j].max(), turn, child, asked[still], limits[still, j], away[still, j]))
        return best, bounds


def _cut(score: int) -> int:
    return max(-_LONG - 1, min(_LONG, score))


def _rounded_down(score: int) -> float:
    """A double no greater than a score."""
    near = float(score)
    return near if near <= score else float(np.nextafter(near, -np.inf))


_FOUND = "query long, query_id long, score long, id long, known boolean, number long"
_FOUND_KINDS = [("query", pa.int64()), ("query_id", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("known", pa.bool_()), ("number", pa.int64())]


def _listed(query: int, query_id: int, best: list[tuple]) -> list[tuple]:
    return [(query, query_id, *row) for row in best]


def _at_home(trees: DataFrame, k: int) -> DataFrame:
    """Every query with its vector, its page, the k-th best score there, and the best rows there."""
    kind = pa.list_(pa.struct(_FOUND_KINDS))
    names = ["query", "query_id", "page", "bound", "values", "best"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree, out = Page(row), []
                for at in range(0, len(tree.asked), QUERY_BLOCK):
                    own = tree.asked[at : at + QUERY_BLOCK]
                    found, bounds = tree.search(tree.vectors[own], tree.numbers[own], k, np.full(len(own), -np.inf))
                    for r, best, bound in zip(own.tolist(), found, bounds.tolist()):
                        query, query_id = int(tree.numbers[r]), int(tree.ids[r])
                        listed = [dict(zip([n for n, _ in _FOUND_KINDS], x)) for x in _listed(query, query_id, best)]
                        out.append((query, query_id, row["page"], bound, tree.vectors[r].tobytes(), listed))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), kind]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    best = ", ".join(c.replace(" ", ": ", 1) for c in _FOUND.split(", "))
    return trees.where(F.length("asked") > 0).mapInArrow(run, f"query long, query_id long, page long, bound double, values binary, best array<struct<{best}>>")


def _blocks(rows: DataFrame, names: list[str], size: int) -> DataFrame:
    """Rows of one task packed into blocks, as Arrow streams of at most ``size`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                sink = pa.BufferOutputStream()
                part = batch.slice(at, size)
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                serial += 1
                yield pa.RecordBatch.from_arrays([pa.array([serial], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "content"])

    return rows.select(*names).mapInArrow(run, "block long, content binary")


def _opened(content: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(content).read_next_batch()


def _heads(trees: DataFrame) -> DataFrame:
    """``page, centre, radius, norm`` of the roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["page"], Page(r)) for r in batch.to_pylist()]
            columns = [
                pa.array([p for p, _ in rows], pa.int64()),
                pa.array([t.vectors[t.spans[0, 4]].tobytes() for _, t in rows], pa.binary()),
                pa.array([float(t.radius[0]) for _, t in rows], pa.float64()),
                pa.array([float(t.norm[0]) for _, t in rows], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["page", "centre", "radius", "norm"])

    return trees.mapInArrow(run, "page long, centre binary, radius double, norm double")


def _visits(queries: DataFrame, heads: DataFrame) -> DataFrame:
    """``page, content``: for each page the queries that it may still serve, in blocks.

    Every block of queries meets every block of heads, each named by its number.
    """
    heads = stored(_blocks(heads, ["page", "centre", "radius", "norm"], HEAD_BLOCK))
    asked = stored(_blocks(queries.repartitionByRange("page", "query").sortWithinPartitions("page", "query"), ["query", "query_id", "page", "bound", "values"], QUERY_BLOCK))
    numbers = heads.agg(F.collect_list("block").alias("all_heads"))
    # The list has one number for every HEAD_BLOCK * PAGE_ROWS rows of the table. Copies of
    # the heads, some 1 % of a page each, let many tasks serve one block of them.
    pairs = asked.select(F.explode(numbers.scalar()).alias("head"), F.pmod(F.xxhash64("block"), F.lit(HEAD_COPIES)).alias("copy"), F.col("content").alias("asked"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HEAD_COPIES - 1).cast("long")))
    met = pairs.join(heads.select(F.col("block").alias("head"), copies.alias("copy"), F.col("content").alias("heads")), ["head", "copy"]).select("asked", "heads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked, heads = _opened(row["asked"]), _opened(row["heads"])
                a, b = (x.to_pylist() for x in (asked.column("values"), heads.column("centre")))
                width = max(len(v) // 8 for v in (*a, *b))
                q, c = _matrix(a, width), _matrix(b, width)
                radius, norm = (heads.column(n).to_numpy()[None, :] for n in ("radius", "norm"))
                with np.errstate(all="ignore"):
                    square, centre = (q**2).sum(axis=1)[:, None], (c**2).sum(axis=1)[None, :]
                    product = q @ c.T
                    away = np.sqrt(np.maximum(square + centre - 2 * product, 0.0))
                    limit = (square + norm**2 - np.maximum(away - radius, 0.0) ** 2) / 2
                    limit = np.fmin(limit, product + np.sqrt(square) * radius) + _SLACK * (square + norm**2) + 1e-6
                    open_ = ~(np.maximum(limit, -float(1 << 63)) < asked.column("bound").to_numpy()[:, None])
                home = asked.column("page").to_numpy()[:, None] == heads.column("page").to_numpy()[None, :]
                open_ &= ~home
                for j in np.flatnonzero(open_.any(axis=0)).tolist():
                    part = asked.select(["query", "query_id", "bound", "values"]).take(pa.array(np.flatnonzero(open_[:, j])))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as writer:
                        writer.write_batch(part)
                    yield pa.RecordBatch.from_arrays([heads.column("page").slice(j, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["page", "content"])

    return met.mapInArrow(run, "page long, content binary")


def _searched(trees: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree, out = Page(row), []
                asked = _opened(row["content"])
                number, name = (asked.column(c).to_numpy() for c in ("query", "query_id"))
                found, _ = tree.search(_matrix(asked.column("values").to_pylist()), number, k, asked.column("bound").to_numpy())
                for query, query_id, best in zip(number.tolist(), name.tolist(), found):
                    out += _listed(query, query_id, best)
                columns = list(zip(*out)) or [()] * len(_FOUND_KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FOUND_KINDS)], [n for n, _ in _FOUND_KINDS])

    tasks = max(1, trees.count() // TASK_PAGES)
    return trees.repartition(tasks, "page").join(visits.repartition(tasks, "page"), "page").mapInArrow(run, _FOUND)


def top_scores(table: DataFrame, asked: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of highest score for each query row.

    Queries are the rows for which ``asked`` holds; candidates are all rows but the query's
    own. A score is the inner product of the components floor(scale * x). Ties go to the
    smaller id, a null id after all others; a repeated id stands for several rows and, as
    a query, for several lists. Vectors that are null or hold a null or non-finite component
    take no part; missing components of a shorter vector count as 0. Scores are exact; one
    beyond 64 bits counts as the nearest long. ``table`` has to be stored; other columns
    are not read.
    """
    spark = table.sparkSession
    rows = stored(quantized(table.select(key, vector, asked.alias("asked")), key, vector, F.col("asked"), scale))
    pivots = fitted_pivots(rows)
    if not len(pivots):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    trees = stored(pages(_dealt(rows, pivots)), batch_rows=1000)
    with batches_of(spark, 4):
        home = stored(_at_home(trees, k))
        heads = stored(_heads(trees))
    visits = stored(_visits(home, heads), batch_rows=8)
    with batches_of(spark, 4):
        elsewhere = stored(_searched(trees, visits, k))
    found = home.select(F.inline("best")).unionByName(elsewhere)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.desc("known"), "id", "number")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("known"), F.col("id")).alias("vec_id"), "score")
