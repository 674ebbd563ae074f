"""Least-cost repair of the turn structure of conversations.

Rows of a conversation are kept, given another role, deleted, or have rows inserted before
them, so that the roles read system?, then user and assistant in turn. A state says what
came last (nothing, system, user, assistant); the cost of reaching the end from each row and
state follows from the last row backwards. Every edit that keeps the least cost is an
optimal arc. Arcs are then ranked by the audit text that starts with them: by one letter,
then, as the rank of a text of twice the length is the pair of the ranks of its halves, by
2, 4, 8 letters, until every audit has ended. Pointers double along with the ranks: the arc
so many letters on is that arc's of the arc. The least audit of a state starts with the arc
of least rank there, and the doubled pointers spell it out.

Rows are range partitioned by conversation and order and cut into segments of bounded size,
so a conversation of any length is spread over tasks. A segment is reduced to a matrix of 16
costs, from each state before it to each one after it. Suffix products of these matrices,
doubled by joins, give the costs behind every segment, and all segments are ranked at once,
for each of the four states they may be entered in. What is left in order is to walk the
segments of a conversation, one at a time, and hash or write the repaired rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lactoscope.llm.stages import stored

# Fixed by contract: costs of edits and of a truncated row that stays.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SEGMENT_ROWS, SEGMENT_CHARS = 1024, 1 << 21
# Cells of the arrays that rank a batch of segments.
CELLS = 1 << 19

_SPACE = " \t\n\x0b\x0c\r"
# Faults of a row.
_NONE, _BLANK, _REPEATED, _TRUNCATED = range(4)
# Kinds of role by initial, and states: nothing yet, or the initial that came last.
_OTHER, _SYSTEM, _USER, _ASSISTANT = range(4)
_INITIALS = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_START = 0
_FAR = np.int64(1) << 40
# By kind and state: the state after a kept row; by state: the one after a new user or assistant.
_KEEPS = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
_MAKES = np.array([2, 2, 3, 2])
_MADE = {2: "user", 3: "assistant"}
# Letters in ASCII order, as ranks have to be.
LETTERS = "DIKR"
_D, _I, _K, _R = range(4)
# Costs from each state to the end of a conversation after its last row, by insertions.
_AT_END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults, by a checksum of the row's key.

    A null role, text or part of the key is one space.
    """
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("fault")
    ).where("fault <> 0")
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def _digest() -> Column:
    """Names a row's conversation, role and text."""
    size = F.char_length("role").cast("string")
    return F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), size, F.lit(":"), "role", "text"), 256)


def segments(rows: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """``segment, conv_id, roles, texts, digests`` of rows in order, stored; ``size`` rows at most each.

    Rows of a conversation are in order of turn (nulls first) and then of a digest of role
    and text. Segments of a conversation follow each other in number.
    """
    keyed = rows.select("conv_id", "turn", "role", "text", _digest().alias("digest"))
    order = ["conv_id", "turn", "digest"]
    # Equal rows may stand in any order, so a number of the scan splits very many of them.
    spread = keyed.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order, "spread")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial, held, conv, chars = TaskContext.get().partitionId() << 32, [], None, 0

        def closed():
            nonlocal serial, held, chars
            roles, texts, digests = zip(*held)
            row = {"segment": serial, "conv_id": conv, "roles": roles, "texts": texts, "digests": digests}
            serial, held, chars = serial + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["conv_id"] != conv or len(held) >= size or chars >= SEGMENT_CHARS):
                    yield closed()
                conv, chars = r["conv_id"], chars + len(r["text"])
                held.append((r["role"], r["text"], r["digest"]))
        if held:
            yield closed()

    listed = pa.list_(pa.string())
    kinds = pa.schema([("segment", pa.int64()), ("conv_id", pa.int64()), ("roles", listed), ("texts", listed), ("digests", listed)])
    schema = "segment long, conv_id long, roles array<string>, texts array<string>, digests array<string>"
    made = stored(spread.sortWithinPartitions(*order).select("conv_id", "role", "text", "digest").mapInArrow(run, schema), batch_rows=1000)
    # Numbers without gaps: one count for each task of the sort.
    task = F.shiftright("segment", 32)
    sizes = made.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect()
    before = np.cumsum([0] + [r.n for r in sizes]).tolist()
    bases = made.sparkSession.createDataFrame([(r.task, b) for r, b in zip(sizes, before)], "task long, base long")
    number = F.col("base") + F.col("segment").bitwiseAND(F.lit((1 << 32) - 1))
    return made.withColumn("task", task).join(F.broadcast(bases), "task").select(number.alias("segment"), "conv_id", "roles", "texts", "digests")


def _repeats(cut: DataFrame) -> DataFrame:
    """``segment, repeats``: places of rows whose role and text came earlier in the conversation."""
    places = cut.select("segment", F.posexplode("digests").alias("place", "digest"))
    at = F.struct("segment", "place")
    firsts = places.groupBy("digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = places.join(firsts, "digest").where(at > F.col("first"))
    return later.groupBy("segment").agg(F.collect_list("place").alias("repeats"))


def fault_of(text: str, repeated: bool) -> int:
    stripped = text.rstrip(_SPACE)
    if not stripped:
        return _BLANK
    if repeated:
        return _REPEATED
    return _NONE if stripped[-1] in ".!?" else _TRUNCATED


def _marked(cut: DataFrame) -> DataFrame:
    """``segment, conv_id, kinds, faults``: a byte for each row of a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, faults = [], []
            for row in batch.select(["roles", "texts", "repeats"]).to_pylist():
                known = set(row["repeats"] or ())
                kinds.append(bytes(_INITIALS.get(role[:1], _OTHER) for role in row["roles"]))
                faults.append(bytes(fault_of(text, i in known) for i, text in enumerate(row["texts"])))
            columns = [batch.column("segment"), batch.column("conv_id"), pa.array(kinds, pa.binary()), pa.array(faults, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["segment", "conv_id", "kinds", "faults"])

    both = cut.select("segment", "conv_id", "roles", "texts").join(_repeats(cut), "segment", "left")
    return stored(both.mapInArrow(run, "segment long, conv_id long, kinds binary, faults binary"), batch_rows=100)


class Edits:
    """Costs and least audits of segments that are worked on side by side.

    ``behind`` has the costs from each state after a segment; a segment that ends its
    conversation may also insert rows there.
    """

    def __init__(self, kinds: list[bytes], faults: list[bytes], behind: np.ndarray, last: np.ndarray):
        self.n = np.array([len(k) for k in kinds])
        self.count, self.longest, self.last = len(kinds), int(self.n.max(initial=0)), last
        shape = (self.count, self.longest)
        self.kind, self.fault = np.zeros(shape, dtype=int), np.zeros(shape, dtype=int)
        for i, (k, f) in enumerate(zip(kinds, faults)):
            self.kind[i, : len(k)] = np.frombuffer(k, dtype=np.uint8)
            self.fault[i, : len(f)] = np.frombuffer(f, dtype=np.uint8)
        self.bound = (self.fault == _BLANK) | (self.fault == _REPEATED)
        self.more = np.where(self.fault == _TRUNCATED, TRUNCATED, 0)
        self.cost = self._costs(behind)

    def _costs(self, behind: np.ndarray) -> np.ndarray:
        """Least cost to the end from each place and state, places from the last one back."""
        cost = np.full((self.count, self.longest + 1, 4), _FAR)
        cost[np.arange(self.count), self.n] = behind
        rows = np.arange(self.count)[:, None]
        for at in range(self.longest - 1, -1, -1):
            after = cost[:, at + 1]
            keep = _KEEPS[self.kind[:, at]]
            kept = np.where(keep >= 0, after[rows, np.maximum(keep, 0)], _FAR)
            made = after[:, _MAKES] + RELABEL
            stays = np.minimum(kept, made) + self.more[:, at, None]
            base = np.minimum(after + DELETE, np.where(self.bound[:, at, None], _FAR, stays))
            user = np.minimum(base[:, 2], base[:, 3] + INSERT)
            here = np.minimum(base, user[:, None] + INSERT)
            here[:, 2] = user
            inside = at < self.n
            cost[inside, at] = np.minimum(here, _FAR)[inside]
        return cost

    def _arcs(self) -> np.ndarray:
        """Head node of each optimal arc by place, state and letter; -1 where there is none."""
        places, states = self.longest + 1, np.arange(4)
        node = (np.arange(self.count)[:, None, None] * places + np.arange(places)[None, :, None]) * 4
        heads = np.full((self.count, places, 4, 4), -1, dtype=np.int64)
        cost = self.cost
        known = cost < _FAR
        inserted = cost[:, :, _MAKES] + INSERT == cost
        at_end = (np.arange(places)[None, :] == self.n[:, None]) & self.last[:, None]
        inside = np.arange(places)[None, :] < self.n[:, None]
        heads[..., _I] = np.where(known & inserted & (inside | at_end)[:, :, None], node + _MAKES, -1)
        here, after, following = cost[:, :-1], cost[:, 1:], node[:, 1:]
        known = known[:, :-1] & inside[:, :-1, None]
        free = known & ~self.bound[:, :, None]
        heads[:, :-1, :, _D] = np.where(known & (after + DELETE == here), following + states, -1)
        made = after[:, :, _MAKES] + RELABEL + self.more[:, :, None] == here
        heads[:, :-1, :, _R] = np.where(free & made, following + _MAKES, -1)
        keep = _KEEPS[self.kind]
        kept = np.take_along_axis(after, np.maximum(keep, 0), axis=2) + self.more[:, :, None] == here
        heads[:, :-1, :, _K] = np.where(free & (keep >= 0) & kept, following + keep, -1)
        return heads.reshape(-1, 4)

    def audits(self) -> tuple[list[list[str | None]], np.ndarray]:
        """For each segment and state before it: the least audit, and the state behind it (-1: none)."""
        heads = self._arcs()
        arcs = heads.size
        real = np.flatnonzero(heads.ravel() >= 0)
        # The arc numbered ``arcs`` stands for the end of an audit and ranks before all letters.
        rank = np.zeros(arcs + 1, dtype=np.int64)
        rank[real] = real % 4 + 1

        def least(ranks: np.ndarray) -> np.ndarray:
            """The arc of least rank that leaves each node, or the end."""
            table = np.where(heads >= 0, ranks[:-1].reshape(-1, 4), np.iinfo(np.int64).max)
            choice = table.argmin(axis=1)
            return np.where((heads >= 0).any(axis=1), np.arange(len(heads)) * 4 + choice, arcs)

        # Letters of the arcs that leave a node differ, so the least one by one letter is the
        # only one that the least audit can start with.
        pointer = np.full(arcs + 1, arcs, dtype=np.int64)
        pointer[real] = least(rank)[heads.ravel()[real]]
        pointers = [pointer]
        while (pointer[real] != arcs).any():
            pairs = rank[real] * (int(rank.max()) + 1) + rank[pointer[real]]
            rank[real] = np.unique(pairs, return_inverse=True)[1].reshape(-1) + 1
            pointer = pointer[pointer]
            pointers.append(pointer)
        first = least(rank).reshape(self.count, self.longest + 1, 4)[:, 0].reshape(-1)
        steps = first[:, None]
        for pointer in pointers:
            steps = np.concatenate([steps, pointer[steps]], axis=1)
        lengths = (steps != arcs).sum(axis=1)
        letters = np.frombuffer(LETTERS.encode(), dtype=np.uint8)[steps % 4]
        reached = self.cost[:, 0].reshape(-1) < _FAR
        ends = np.full(len(first), -1)
        some = np.flatnonzero(lengths > 0)
        ends[some] = heads.ravel()[steps[some, lengths[some] - 1]] % 4
        found = [letters[i, : lengths[i]].tobytes().decode() if reached[i] else None for i in range(len(first))]
        return [found[4 * i : 4 * i + 4] for i in range(self.count)], ends.reshape(self.count, 4)


def _chunks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Segment numbers in groups of like length, so that padding and memory stay small."""
    order, begin = np.argsort(lengths, kind="stable"), 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * 16 * (lengths[order[end]] + 1) <= CELLS:
            end += 1
        yield order[begin:end]
        begin = end


def _matrices(marked: DataFrame) -> DataFrame:
    """``segment, costs``: 16 costs of a segment, by state before and state after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, faults = (batch.column(c).to_pylist() for c in ("kinds", "faults"))
            table = np.zeros((len(kinds), 4, 4), dtype=np.int64)
            for part in _chunks(np.array([len(k) for k in kinds])):
                for state in range(4):
                    behind = np.full((len(part), 4), _FAR)
                    behind[:, state] = 0
                    edits = Edits([kinds[i] for i in part], [faults[i] for i in part], behind, np.zeros(len(part), dtype=bool))
                    table[part, :, state] = edits.cost[:, 0]
            costs = pa.array(table.reshape(-1, 16).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("segment"), costs], ["segment", "costs"])

    return marked.select("segment", "kinds", "faults").mapInArrow(run, "segment long, costs array<long>")


def _behind(marked: DataFrame) -> DataFrame:
    """``segment, behind, last``: costs from each state after a segment to its conversation's end.

    Products over 1, 2, 4, ... segments are joined to the product that follows them, for
    conversations of several segments, until each reaches its conversation's last one.
    """
    ends = marked.groupBy("conv_id").agg(F.min("segment").alias("first"), F.max("segment").alias("final"))
    several = stored(marked.join(ends.where("final > first"), marked.conv_id.eqNullSafe(ends.conv_id)).select("segment", "kinds", "faults", "final"))
    products = stored(_matrices(several).join(several.select("segment", "final"), "segment"))
    width = 1
    while not products.where(F.col("segment") + width <= F.col("final")).isEmpty():
        following = products.select((F.col("segment") - width).alias("segment"), F.col("costs").alias("more"))
        joined = products.join(following, "segment", "left")
        inside = F.col("segment") + width <= F.col("final")
        both = [F.least(*[F.col("costs")[4 * i + k] + F.col("more")[4 * k + j] for k in range(4)], F.lit(int(_FAR))) for i in range(4) for j in range(4)]
        products = stored(joined.select("segment", F.when(inside, F.array(*both)).otherwise(F.col("costs")).alias("costs"), "final"))
        width *= 2
    at_end = [F.lit(int(v)) for v in _AT_END]
    costs = [F.least(*[F.col("costs")[4 * i + k] + at_end[k] for k in range(4)]) for i in range(4)]
    before = products.select((F.col("segment") - 1).alias("segment"), F.array(*costs).alias("behind"))
    # The product that starts a conversation would fall on the one before; that one is a last segment.
    finals = ends.select(F.col("final").alias("segment"), F.lit(True).alias("last"))
    joined = marked.select("segment").join(finals, "segment", "left").join(before, "segment", "left")
    last = F.coalesce("last", F.lit(False))
    return joined.select("segment", F.when(last, F.array(*at_end)).otherwise(F.col("behind")).alias("behind"), last.alias("last"))


def _planned(marked: DataFrame) -> DataFrame:
    """Segments with ``audits`` and states ``behind`` for each state before them, and ``costs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, faults, behind = (batch.column(c).to_pylist() for c in ("kinds", "faults", "behind"))
            last = np.array(batch.column("last").to_pylist(), dtype=bool)
            audits, ends, costs = [None] * len(kinds), [None] * len(kinds), [None] * len(kinds)
            for part in _chunks(np.array([len(k) for k in kinds])):
                after = np.array([behind[i] for i in part], dtype=np.int64)
                edits = Edits([kinds[i] for i in part], [faults[i] for i in part], after, last[part])
                found, states = edits.audits()
                for i, a, e, c in zip(part, found, states.tolist(), edits.cost[:, 0].tolist()):
                    audits[i], ends[i], costs[i] = a, e, c
            made = [pa.array(audits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32())), pa.array(costs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("segment"), *made], ["segment", "audits", "ends", "costs"])

    joined = marked.select("segment", "kinds", "faults").join(_behind(marked), "segment")
    return stored(joined.mapInArrow(run, "segment long, audits array<string>, ends array<int>, costs array<long>"), batch_rows=2000)


def _walked(segment: dict, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of a segment entered in a state; a deleted row keeps its own role and text."""
    at = 0
    for letter in segment["audits"][state]:
        if letter == "I":
            state = int(_MAKES[state])
            yield letter, _MADE[state], ""
            continue
        role, text = segment["roles"][at], segment["texts"][at]
        at += 1
        if letter == "K":
            state = _INITIALS[role[0]]
        elif letter == "R":
            state = int(_MAKES[state])
            role = _MADE[state]
        yield letter, role, text


def plan_repairs(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Segments of ``conv_id, turn, role, text`` in order, each with its least-cost audits.

    ``turn`` may be null (such rows come first) or repeated; rows of one turn stand in the
    order of a digest of role and text. Roles go by their first letter; an empty one has
    none and is no legal role. A null ``conv_id`` is a conversation like others. Role and
    text must not be null.
    """
    cut = segments(rows, segment_rows)
    marked = _marked(cut)
    planned = _planned(marked)
    return cut.drop("digests").join(marked.drop("conv_id"), "segment").join(planned, "segment")


def _in_order(plans: DataFrame, run, schema: str) -> DataFrame:
    """Segments of a conversation in one task, in order and one at a time."""
    ordered = plans.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(run, schema)


def repaired_rows(plans: DataFrame) -> DataFrame:
    """``conv_id, step, edit, role, text``: every edit of every conversation, in order from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, step, begun = None, _START, 0, False
        for batch in batches:
            for segment in batch.to_pylist():
                if not begun or segment["conv_id"] != conv:
                    conv, state, step, begun = segment["conv_id"], _START, 0, True
                edits = list(_walked(segment, state))
                state = segment["ends"][state]
                columns = [[conv] * len(edits), range(step, step + len(edits)), *zip(*edits)]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                step += len(edits)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "step", "edit", "role", "text"])

    return stored(_in_order(plans, run, "conv_id long, step long, edit string, role string, text string"), batch_rows=32)


def _digests(plans: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of each conversation, whose segments pass by one at a time."""
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun = None, _START, False
        faults, illegal, cost, audit, digest, written, before = np.zeros(4, dtype=int), 0, 0, [], None, False, None

        def row():
            values = [conv, *faults[1:].tolist(), illegal, cost, "".join(audit), digest.hexdigest()]
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for segment in batch.to_pylist():
                if not begun or segment["conv_id"] != conv:
                    if begun:
                        yield row()
                    conv, state, begun = segment["conv_id"], _START, True
                    faults, illegal, cost, audit = np.zeros(4, dtype=int), 0, segment["costs"][_START], []
                    digest, written, before = hashlib.sha256(), False, None
                faults += np.bincount(np.frombuffer(segment["faults"], dtype=np.uint8), minlength=4)
                for role in segment["roles"]:
                    illegal += before is not None and (before, role[:1]) not in _LEGAL
                    before = role[:1]
                audit.append(segment["audits"][state])
                for letter, role, text in _walked(segment, state):
                    if letter != "D":
                        digest.update((b"\n" if written else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                        written = True
                state = segment["ends"][state]
        if begun:
            yield row()

    schema = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return stored(_in_order(plans, run, schema), batch_rows=32)


def report(original: DataFrame, rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row for each ``conv_id`` of ``original``: faults of ``rows`` and their repair.

    ``gaps`` counts turns missing between the least and the greatest; null turns do not
    count. A conversation without rows has zeros, an empty audit and the empty text's hash.
    """
    wide = "decimal(38,0)"
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    span = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count("turn")
    gaps = turns.agg(F.least(F.coalesce(span, F.lit(0).cast(wide)), F.lit((1 << 63) - 1).cast(wide)).cast("long").alias("gaps"))
    found = _digests(plan_repairs(rows, segment_rows))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = original.select("conv_id").distinct().unionByName(gaps, True).unionByName(found, True)
    return every.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
