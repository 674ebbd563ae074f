"""Importance resampling, exact top-k search and turn repair against plain Python, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_words import words
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lactoscope.llm import importance, metric_tree, turn_repair

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def resampled_by_brute_force(rows, target, longest, buckets, min_words, percent, seed):
    made = [(d, *plain_features(t, longest)) for d, t in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, _, fs in made for f in fs)
    t = Counter(bucket(f) for x in target for f in plain_features(x, longest)[1])
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    scored = []
    for d, n, fs in made:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        scored.append((d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in scored if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = len(order) * percent // 100
    out = Counter((d, n, w, c, i + 1 if i < drawn else None) for i, (d, _, n, w, c) in enumerate(order))
    return out + Counter((d, n, w, c, None) for d, k, n, w, c in scored if k < min_words)


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 64)])
def test_resampling(spark, stored_docs, odd_rows, longest, buckets):
    rows = odd_rows + [(100 + i, " ".join(words(i % 7, 15 + i)) + ("  Éa,B\x7fc " * (i % 3))) for i in range(40)]
    target = [None, "", " ".join(words(3, 60)), "éa b"]
    found = importance.resample(stored_docs(rows), spark.createDataFrame([(t,) for t in target], "text string"), longest, buckets, 20, 35, 7)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, found.collect())) == resampled_by_brute_force(rows, target, longest, buckets, 20, 35, 7)


def test_resampling_without_rows(spark, stored_docs):
    docs, none = stored_docs([(1, "a b c")]), spark.createDataFrame([], "text string")
    assert importance.resample(docs.where("false"), docs).count() == 0
    assert [r.rank for r in importance.resample(docs, none).collect()] == [None]


def test_ranks_of_many_equal_rows(spark, stored_docs):
    """A third of all rows alike: every place is given once."""
    text = " ".join(words(1, 30))
    docs = stored_docs([(None if i % 3 else i, text) for i in range(300)])
    ranks = [r.rank for r in importance.resample(docs, docs, percent=100).collect()]
    assert sorted(ranks) == list(range(1, 301))


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("number", T.StringType()), T.StructField("page", T.LongType())])


@pytest.fixture(scope="module")
def stored_vectors(spark, tmp_path_factory):
    def store(rows, kind=VECTORS):
        path = str(tmp_path_factory.mktemp("vectors") / "embeddings.parquet")
        spark.createDataFrame([(i, v, "x", 1) for i, v in rows], kind).repartition(4).write.parquet(path)
        return spark.read.parquet(path)

    return store


def top_by_brute_force(rows, k, every):
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for at, (q, v) in enumerate(usable):
        if q is None or q % every:
            continue
        cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        scored = [(-cut(sum(a * b for a, b in zip(v, w))), i is None, i or 0) for n, (i, w) in enumerate(usable) if n != at]
        for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1):
            out[q, rank, None if none else i, -s] += 1
    return out


def clustered(n, width, seed, spread=0.05):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, width))
    return [(i, (centres[i * 7 % 6] + spread * draw.normal(size=width)).astype(np.float32).tolist()) for i in range(n)]


def found_top(table, k=5, every=50):
    found = metric_tree.top_scores(table, F.col("vec_id") % every == 0, k)
    return Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


def test_top_scores(spark, stored_vectors):
    rows = clustered(700, 12, 1) + [(i, [0.5] * 12) for i in range(700, 900)]  # two hundred rows alike
    rows += [(900, None), (950, [None] * 12), (1000, [float("nan")] + [1.0] * 11), (1050, [float("inf")] * 12), (1100, [1.0, 2.0]), (1150, [])]
    rows += [(None, [0.25] * 12), (50, [3.0] * 12), (1200, [0.5] * 13)]  # no id, a repeated id, a longer vector
    assert found_top(stored_vectors(rows)) == top_by_brute_force(rows, 5, 50)


def test_top_scores_of_few_or_no_rows(spark, stored_vectors):
    assert found_top(stored_vectors([(0, [1.0]), (50, [2.0])])) == Counter({(0, 1, 50, 131072): 1, (50, 1, 0, 131072): 1})
    assert found_top(stored_vectors([(0, [1.0])])) == Counter()
    assert found_top(stored_vectors([(0, [1.0])]).where("false")) == Counter()
    assert found_top(stored_vectors([(0, None)])) == Counter()


def test_top_scores_beyond_doubles(spark, stored_vectors):
    """Products that doubles round are exact, and those beyond 64 bits are cut to size."""
    kind = T.StructType([VECTORS["vec_id"], T.StructField("embedding", T.ArrayType(T.DoubleType())), *VECTORS.fields[2:]])
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-1, 1) * 2.0**21 for _ in range(5)]) for i in range(150)]
    assert found_top(stored_vectors(rows, kind)) == top_by_brute_force(rows, 5, 50)
    rows += [(200, [1e300, 1.0]), (250, [-1e300, 1e200]), (251, [1e308] * 3)]
    found = found_top(stored_vectors(rows, kind))
    assert found == top_by_brute_force([(i, None if v[0] == 1e308 else v) for i, v in rows], 5, 50)


def test_tree_passes_over_far_rows():
    """On clustered rows most products are never computed, and the result is that of all products."""
    rows = np.floor(256 * np.array([v for _, v in clustered(4000, 16, 2, 0.02)]))
    order, spans, reach, to_leaf = metric_tree.built(rows)
    assert sorted(order.tolist()) == list(range(4000))
    tree = metric_tree.Page(
        {
            "rows": 4000, "width": 16, "peak": float(np.abs(rows).max()), "vectors": rows[order].tobytes(),
            "ids": np.column_stack([order, np.ones(4000, dtype=int)]).tobytes(), "numbers": order.astype(np.int64).tobytes(),
            "asked": b"", "spans": spans.tobytes(), "reach": np.concatenate([reach.ravel(), to_leaf]).tobytes(),
        }
    )
    for low, high, first, last, centre in spans.tolist():
        away = np.linalg.norm(tree.vectors[low:high] - tree.vectors[centre], axis=1)
        node = spans.tolist().index([low, high, first, last, centre])
        assert away.max() <= tree.radius[node] + 1e-9
        for child in range(first, last):
            gap = np.linalg.norm(tree.vectors[spans[child, 4]] - tree.vectors[centre])
            assert abs(tree.to_parent[child] - gap) < 1e-9
    best, _ = tree.search(rows[:20], np.arange(20), 5, np.full(20, -np.inf))
    for q, found in enumerate(best):
        products = rows @ rows[q]
        expected = sorted((-int(products[i]), i) for i in range(4000) if i != q)[:5]
        assert [(-s, i) for s, i, _, _ in found] == expected
    assert tree.computed < 0.5 * 20 * 4000


def plain_repair(rows):
    """Faults, cost and audit by trying every edit from the end back, with audits as text."""
    faults, seen = [], set()
    for role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append(1 if not last else 2 if (role, text) in seen else 0 if last in ".!?" else 3)
        seen.add((role, text))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    nodes = {"": (0, ""), "s": (10, "II"), "u": (5, "I"), "a": (0, "")}
    for (role, _), fault in zip(reversed(rows), reversed(faults)):
        here = {}
        for state in after:
            ways = [(2 + nodes[state][0], "D" + nodes[state][1])]
            if fault in (0, 3):
                stay = 5 if fault == 3 else 0
                for new in "ua":
                    if new in after[state]:
                        ways.append((stay + 1 + nodes[new][0], "R" + nodes[new][1]))
                if role[:1] in after[state]:
                    ways.append((stay + nodes[role[:1]][0], "K" + nodes[role[:1]][1]))
            here[state] = min(ways)
        for _ in range(4):  # rows inserted before this one
            for state, more in after.items():
                here[state] = min([here[state]] + [(5 + here[n][0], "I" + here[n][1]) for n in more if n != "s"])
        nodes = here
    return faults, *nodes[""]


def repaired_texts(rows, audit):
    out, at, state = [], 0, ""
    for letter in audit:
        role, text = rows[at] if letter != "I" else ("", "")
        at += letter != "I"
        if letter == "D":
            continue
        if letter in "RI":
            role = "assistant" if state == "u" else "user"
        out.append(f"{role}:{text}")
        state = role[:1]
    return out


def expected_report(rows, audit_of=plain_repair):
    """Reports of conversations given as (conv_id, turn, role, text), already damaged."""
    groups = {}
    for conv, turn, role, text in rows:
        digest = hashlib.sha256(f"{' ' if conv is None else conv}:{len(role)}:{role}{text}".encode()).hexdigest()
        groups.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    out = {}
    for conv, found in groups.items():
        found.sort()
        plain = [r[3:] for r in found]
        faults, cost, audit = audit_of(plain)
        turns = [t for known, t, *_ in found if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[0][:1], b[0][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in itertools.pairwise(plain))
        digest = hashlib.sha256("\n".join(repaired_texts(plain, audit)).encode()).hexdigest()
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest)
    return out


def reports(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


KIND = "conv_id long, turn long, role string, text string, segment long, digest string"
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", " ", "agent"]
TEXTS = ["Yes.", "No!", "", " \t", "cut off", "Who?", "a b c.  ", "x"]


def random_rows(seed, conversations, longest):
    draw = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(draw.randint(1, longest)):
            text = draw.choice(TEXTS) if draw.random() < 0.6 else " ".join(words(draw.randint(0, 999), 3)) + draw.choice(".!? ")
            rows.append((conv or None, None if draw.random() < 0.1 else draw.randint(0, 2 * longest), draw.choice(ROLES), text))
    return rows


def with_clashes(rows):
    return [(*r, 7, "x") for r in rows]


@pytest.mark.parametrize("size", [1, 3, 1024])
def test_repairs_equal_brute_force_at_any_segment_size(spark, size):
    rows = random_rows(size, 120, 12)
    frame = spark.createDataFrame(with_clashes(rows), KIND)
    assert reports(turn_repair.report(frame, frame, size)) == expected_report(rows)


def test_repaired_rows(spark):
    rows = random_rows(9, 40, 9)
    plans = turn_repair.plan_repairs(spark.createDataFrame(with_clashes(rows), KIND), 4)
    audits = {}
    for r in turn_repair.repaired_rows(plans).orderBy("conv_id", "step").collect():
        audit, kept = audits.setdefault(r.conv_id, ([], []))
        assert r.step == len(audit)
        audit.append(r.edit)
        if r.edit != "D":
            kept.append(f"{r.role}:{r.text}")
    for conv, (*_, audit, digest) in expected_report(rows).items():
        assert "".join(audits[conv][0]) == audit
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in audits[conv][1]))
        assert hashlib.sha256("\n".join(audits[conv][1]).encode()).hexdigest() == digest


def test_damage_and_conversations_left_without_rows(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", None if t == 3 else f"Text {t}. Go on!") for c in range(60) for t in range(4)]
    rows += [(None, None, None, None), (70, None, "user", "Hm."), (71, 2**62, "user", "A."), (71, -(2**62), "assistant", "B.")]
    gone = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Gone."))
    expected = []
    for conv, turn, role, text in rows:
        role, text = role or " ", " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            expected += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    frame = spark.createDataFrame(with_clashes(rows), KIND)
    broken = turn_repair.damaged(frame)
    assert Counter(map(tuple, broken.collect())) == Counter(expected)
    found = reports(turn_repair.report(frame, broken))
    assert found.pop(gone) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found == expected_report(expected)
    nothing = frame.where("false")
    assert turn_repair.report(nothing, turn_repair.damaged(nothing)).count() == 0


def test_one_conversation_with_most_rows(spark):
    """Thousands of rows of one conversation, many alike, cut into many segments."""
    draw = random.Random(4)
    rows = [(1, i // 2, draw.choice(ROLES[:5]), draw.choice(["Same.", f"Row {i}.", f"row {i}"])) for i in range(3000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    rows += [(1, None, "user", "Alike.")] * 500
    frame = spark.createDataFrame(with_clashes(rows), KIND)
    assert reports(turn_repair.report(frame, frame, 100)) == expected_report(rows)
