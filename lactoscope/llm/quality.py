"""Quality rules as a short-circuit cascade.

Each rule rejects a text by one measure. On a bounded sample every rule is timed and
its rejections are noted; the cascade then takes, again and again, the rule with the
most rejections per second among the sampled texts that are still in. A text leaves
at the first rule that rejects it, so cheap and effective rules spare the others.
The order never changes which texts are kept.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lactoscope.llm.words import as_bytes, covered, hashed_words, window_hashes, word_spans

SAMPLE_ROWS = 512
SYMBOLS = b"#*$%&|<>"
_GAP = re.compile(r"[\x20\x09-\x0D]*")


class Measured:
    """Measures of one whole text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = np.frombuffer(as_bytes(text), dtype=np.uint8)

    @cached_property
    def spans(self):
        return word_spans(self.data)

    @cached_property
    def n_words(self) -> int:
        return len(self.spans[0])

    @cached_property
    def bytes_of(self) -> np.ndarray:
        return np.bincount(self.data, minlength=256)

    @cached_property
    def word_chars(self) -> int:
        n = self.bytes_of
        return int(n.sum() - n[0x20] - n[0x09:0x0E].sum() - n[0x80:0xC0].sum())

    @cached_property
    def n_symbols(self) -> int:
        return int(self.bytes_of[list(SYMBOLS)].sum())

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if _GAP.match(x).end() < len(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that the text has twice or more."""
        windows = window_hashes(hashed_words(self.data), 3)
        if not len(windows):
            return 0
        _, place, n = np.unique(windows, return_inverse=True, return_counts=True)
        return int(covered(np.flatnonzero(n[place] > 1), 3, self.n_words).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measured], bool]


# The first two are fixed by contract; the others are common limits for web text.
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
FURTHER_RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("duplicate_lines", lambda t: 100 * t.n_dup_lines > 50 * len(t.lines)),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 12 * t.n_words),
    Rule("capitals", lambda t: 10 * t.bytes_of[65:91].sum() > 7 * (t.bytes_of[65:91].sum() + t.bytes_of[97:123].sum())),
    Rule("digits", lambda t: 100 * t.bytes_of[48:58].sum() > 30 * t.word_chars),
)


def sampled_texts(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str | None]:
    """The first texts Spark comes by: a bounded sample that needs no scan of the table."""
    return [r[0] for r in docs.select("text").limit(rows).collect()]


def ordered_rules(texts: Sequence[str | None], rules: Sequence[Rule]) -> list[Rule]:
    """Rules by rejections per cost, each counted among texts the earlier ones let pass."""
    seconds = np.zeros(len(rules))
    rejected = np.zeros((len(texts), len(rules)), dtype=bool)
    for i, text in enumerate(texts):
        for k, rule in enumerate(rules):
            began = time.perf_counter()
            rejected[i, k] = rule.rejects(Measured(text))
            seconds[k] += time.perf_counter() - began
    order, left, open_ = [], np.ones(len(texts), dtype=bool), list(range(len(rules)))
    while open_:
        best = max(open_, key=lambda k: (rejected[left, k].sum() / max(seconds[k], 1e-9), -seconds[k]))
        order.append(rules[best])
        left &= ~rejected[:, best]
        open_.remove(best)
    return order


def passes(text: Measured, order: Sequence[Rule]) -> bool:
    return not any(rule.rejects(text) for rule in order)


def measure(docs: DataFrame, base: Sequence[Rule] = BASE_RULES, further: Sequence[Rule] = FURTHER_RULES) -> DataFrame:
    """Measures and verdict of every row of ``doc_id, text``; other columns are not read.

    A null or empty text has no words and fails. A row with a null or repeated
    ``doc_id`` is measured like any other; the result has a row for each input row.
    """
    order = ordered_rules(sampled_texts(docs), further)
    base = list(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                t = Measured(text.as_py())
                failed = not passes(t, base)
                kept = not failed and passes(t, order)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept))
            columns = list(zip(*rows)) or [()] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.bool_()) for c in columns[5:]]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    schema = docs.select("doc_id").schema.add("n_words", "long")
    for name in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(name, "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema.add("base_failed", "boolean").add("kept", "boolean"))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + FURTHER_RULES) -> DataFrame:
    """Rows whose text passes every rule, with all their columns.

    All rules stand in one cascade, so a rejected text costs no more than the rules up
    to the one that rejects it. Null and empty texts are rejected; repeated rows stay.
    """
    order = ordered_rules(sampled_texts(docs), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [passes(Measured(text.as_py()), order) for text in batch.column("text")]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
