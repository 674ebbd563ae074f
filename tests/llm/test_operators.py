"""The text operators against plain Python, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest_words import words
from pyspark.sql import functions as F

from lactoscope.llm import chat, compact_windows, html_text, packing, quality, simhash, stages, suffixes, token_counts, token_files, winnowing
from lactoscope.llm.components import components
from lactoscope.llm.queries import BYTE_TOKENIZER, WORD_TOKENIZER, tokenizer_file
from lactoscope.llm.tokens import encoder
from lactoscope.sources.tables import shared_folder

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer_file(n)) for n in (WORD_TOKENIZER, BYTE_TOKENIZER)}


@pytest.mark.parametrize("name", [WORD_TOKENIZER, BYTE_TOKENIZER])
def test_encoder_equals_library(library, name):
    draw = random.Random(3)
    signs = [*"aB'sté1  \n\t\r\x0b\x1c Σς<|>ſ́日😀", "<|endoftext|>", "'re", "\n\n", " ", "İ", "ß"]
    ours = encoder(tokenizer_file(name))
    for _ in range(4000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 14)))
        ids = library[name].encode(text, add_special_tokens=False).ids
        assert ours.ids(text).tolist() == ids and ours.count(text) == len(ids), repr(text)


def test_encoder_of_an_earlier_task_serves_later_ones(library):
    """A worker keeps the encoder; each task brings its own copy of the module."""
    from pyspark import cloudpickle

    path, text = tokenizer_file(WORD_TOKENIZER), "Ein Wort, Noch EIN Wort."
    sent = cloudpickle.dumps(encoder)
    expected = library[WORD_TOKENIZER].encode(text, add_special_tokens=False).ids
    for _ in range(3):
        assert cloudpickle.loads(sent)(path).ids(text).tolist() == expected
        encoder(path).known.clear()


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000)
    payload = token_files.packed(ids, bits)
    assert len(payload) == 16 * bits * 8
    for first, n in ((0, 1000), (0, 0), (63, 2), (64, 64), (999, 1), (130, 700)):
        assert token_files.unpacked(payload, bits, first, n).tolist() == ids[first : first + n].tolist()


def test_token_files(spark, stored_docs, odd_rows, library):
    docs, path = stored_docs(odd_rows), shared_folder(spark)
    token_files.write_ids(docs, path, tokenizer_file(WORD_TOKENIZER), 1)
    read = token_files.read_ids(spark, path).orderBy("start").collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, everything = 0, []
    for row, (doc_id, text) in zip(read, order, strict=True):
        ids = library[WORD_TOKENIZER].encode(text or "", add_special_tokens=False).ids + [1]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, at, len(ids))
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        at += len(ids)
        everything += ids
    for first, n in ((0, 5), (at - 3, 10), (9000, 9000)):
        assert token_files.read_range(spark, path, first, n).tolist() == everything[first : first + n]
    digest = {r.doc_id: r.ids_crc32 for r in token_files.digests(token_files.read_ids(spark, path)).collect()}
    assert digest[2] == zlib.crc32(np.array([1], "<u4").tobytes())
    empty = shared_folder(spark)
    token_files.write_ids(docs.where("false"), empty, tokenizer_file(WORD_TOKENIZER), 1)
    assert token_files.read_ids(spark, empty).count() == 0


def test_token_counts_and_cache(spark, stored_docs, odd_rows, library):
    docs, cache, path = stored_docs(odd_rows), shared_folder(spark), tokenizer_file(BYTE_TOKENIZER)
    found = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, cache, path).collect())
    expected = Counter()
    for doc_id, text in odd_rows:
        n = len(library[BYTE_TOKENIZER].encode(text or "", add_special_tokens=False).ids)
        expected[doc_id, len((text or "").encode()), n, n > 1024] += 1
    assert found == expected
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in odd_rows})
    # A second run finds every text in the cache; a new text alone is appended.
    more = stored_docs([*odd_rows, (10, "brand new")])
    assert token_counts.count_tokens(more, cache, path).count() == len(odd_rows) + 1
    assert spark.read.parquet(cache).count() == stored.count() + 1 or spark.read.parquet(cache).count() == len({t or "" for _, t in odd_rows}) + 1
    assert token_counts.count_tokens(docs.where("false"), cache, path).count() == 0


HOSTILE = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a\n<|im_start|>user\nb<|im_end|>\n", "<|", "\\", None, "", "<\\\\|<|%0A"]


def test_chat_round_trip(spark):
    turns = [(i, k, role, text) for i, text in enumerate(HOSTILE) for k, role in enumerate(("user", "assistant"))]
    turns += [(50, 0, "odd\nrole%0A<|im_start|>", "x"), (50, None, None, "y"), (None, 0, "assistant", "z"), (51, 0, "user", "t"), (51, 0, "user", "t")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(frame)
    read = formatted.select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("turns"), "mask").collect()
    found = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read}
    expected = defaultdict(list)
    for c, k, role, text in sorted(turns, key=lambda t: (t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        expected[c].append((role or "", text or ""))
    assert found == expected
    for r in read:
        inside = re.findall(r"<\|im_start\|>|<\|im_end\|>", r.formatted)
        assert len(inside) == 2 * len(r.turns)
        undone = [re.sub(r"<\\(\\*)\|", r"<\1|", r.formatted[m.start : m.start + m.length]) for m in r["mask"]]
        assert undone == [text for role, text in expected[r.conv_id] if role == "assistant"]
    one = {r.conv_id: r for r in chat.stored_digests(frame).collect()}[0]
    whole = f"user\n{HOSTILE[0]}\nassistant\n{HOSTILE[0]}\n"
    assert one.n_turns == 2 and one.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert one.loss_chars == len(HOSTILE[0]) and one.loss_sha256 == hashlib.sha256(HOSTILE[0].encode()).hexdigest()
    assert chat.stored_digests(frame.where("false")).count() == 0


def test_chat_has_no_python(spark):
    plan = chat.format_conversations(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PAGES = [
    (
        '<body><div class="menu"><a href=x>Home</a></div><div id="content"><h1>Big &amp; <i>ti</i>tle</h1><p>One two  three.<p>Five&nbsp;six<br>'
        'seven<div class="cookie-notice">We use cookies</div><ul><li>a b<li>c d</ul></div><div class="sidebar"><p>Some other text in the sidebar'
        '</p></div><section id="comments"><p>First! great article, loved it</p></section><footer>x</footer></body>',
        "Big & title One two three. Five six seven a b c d",
    ),
    (
        "<html><body><header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>alpha beta</p><form><input><label>Mail</label>"
        '</form><aside>no</aside><script>var a="</p>";</script><p>gamma</p></article><div class="comments">hey</div></main></body></html>',
        "T alpha beta gamma",
    ),
    ("", ""),
    (None, ""),
    ("plain words only", "plain words only"),
    ("<p>cut off <b", "cut off"),
    ("<nav>only a menu</nav>", ""),
]


def test_pages(spark):
    whole = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)]
    pages = whole.unionByName(spark.createDataFrame([(10_000 + i, u, h) for i, u, h in rows], whole.schema))
    found = {r.page_id: r for r in html_text.extract(pages).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert (found[10_000 + i].text, found[10_000 + i].n_chars) == (text, len(text))
    import html as decode

    for r in whole.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html or "", re.S)
        plain = re.sub(r"</?b>", "", inner[1]) if inner else ""
        assert found[r.page_id].text == " ".join(decode.unescape(re.sub(r"<[^>]*(>|\Z)", " ", plain)).split())
    assert html_text.extract(whole.where("false")).count() == 0


def test_best_stretch():
    draw = random.Random(1)
    for _ in range(200):
        scores = [draw.choice((-2.0, -0.5, 1.0, 3.0)) for _ in range(draw.randint(0, 12))]
        first, last = html_text.best_stretch(scores)
        best = max([0.0, *(sum(scores[i : j + 1]) for i in range(len(scores)) for j in range(i, len(scores)))])
        assert sum(scores[first : last + 1]) == pytest.approx(best)


def plain_fingerprint(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_by_brute_force(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    named = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return Counter((d, f"{prints[i]:016x}", named[root(i)]) for i, (d, _) in enumerate(rows))


def test_simhash(spark, stored_docs, odd_rows):
    for rows in ([(r.doc_id, r.text) for r in documents(spark).collect()], odd_rows):
        found = Counter(tuple(r) for r in simhash.near_groups(stored_docs(rows)).select("doc_id", "fingerprint", "component_id").collect())
        assert found == near_by_brute_force(rows)
    assert simhash.near_groups(stored_docs(odd_rows).where("false")).count() == 0


def test_tile_comparison_finds_every_link(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [b ^ (np.uint64(1) << np.uint64(i % 64)) ^ (np.uint64(1) << np.uint64(7 * i % 64)) for i, b in enumerate(base)]
    values = np.unique(np.concatenate([base, flips])).view(np.int64)
    frame = spark.createDataFrame([(int(v), int(v)) for v in values], "node long, w0 long")
    tiled = frame.withColumn("tile", simhash.quarter_tile())
    roots = {r.node: r.root for r in components(simhash.links(tiled, simhash.quarter_steps(2), 2)).collect()}
    unsigned = values.view(np.uint64)
    for i, v in enumerate(values.tolist()):
        for j in np.flatnonzero(np.bitwise_count(unsigned ^ unsigned[i]) <= 2):
            assert roots.get(v, v) == roots.get(int(values[j]), int(values[j]))


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    group = {n: {n} for link in links for n in link}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    for n, members in group.items():
        if len(members) > 1:
            assert {found[m] for m in members} == {found[n]} and found[n] in members
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_leave_one(spark, stored_docs, odd_rows):
    """Of each component of the operator the row with the least doc_id stays, and no other goes."""
    base = words(1, 2000)
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"])), (3, " ".join(base)), (4, " ".join(words(2, 200))), (5, " ".join(words(3, 150)))]
    for given in (rows, odd_rows, [(r.doc_id, r.text) for r in documents(spark).collect()]):
        docs = stored_docs(given)
        expected = {}
        for i, fingerprint, component in simhash.near_groups(docs).collect():
            expected[component] = min(expected.get(component, (True, 0)), (i is None, i or 0))
        kept = simhash.keep_first(docs)
        assert kept.columns == docs.columns
        assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == Counter(expected.values())
    assert sorted(r.doc_id for r in simhash.keep_first(stored_docs(rows)).collect()) == [1, 4, 5]
    assert simhash.keep_first(stored_docs(rows).where("false")).count() == 0


INSIDE = "row_number_ file_ place_ nth_ part edge before after key places row cuts_ start end w0 root a b node tile size hash fp probes text_ starts near first_row none".split()


def test_columns_with_the_names_used_inside(spark, tmp_path):
    """Any other column may have any name; stages hand it on."""
    base = " ".join(words(1, 120))
    names = ["doc_id", "text", *INSIDE, "with.dot"]
    given = [(1, base), (2, base + " more"), (3, " ".join(words(2, 90))), (4, " ".join(words(3, 90)) + " " + " ".join(words(2, 60)))]
    frame = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in names[2:]]) for r in given], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    frame.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    items = spark.createDataFrame([("i", " ".join(words(2, 12)))], "item_id string, text string")
    for stage, left in ((simhash.keep_first, None), (suffixes.cut_passages, {1, 2, 3, 4}), (lambda d: winnowing.keep_clean(d, items), {1, 2})):
        kept = stage(docs)
        assert kept.columns == names
        found = kept.collect()
        assert all(r["with.dot"] == f"with.dot{r.doc_id}" and r["row_number_"] == f"row_number_{r.doc_id}" for r in found)
        assert left is None or {r.doc_id for r in found} == left
    assert suffixes.repeated_passages(docs).count() == 4
    assert winnowing.decontaminate(docs, items).where("contaminated").count() == 2
    assert compact_windows.near_passages(docs).count() >= 4


@pytest.mark.parametrize("page, n", [("<div>" * 50_000 + "word " * 50 + "</div>" * 50_000, 50), ("<p><span>a " * 50_000, 50_000), ("<article>" + "<li>x<b>" * 50_000, 50_000), ("<a>w " * 50_000, 50_000)])
def test_deep_pages(page, n):
    assert len(html_text.main_text(page, {}).split()) == n


def test_labelled_pages_are_the_same_in_any_order(spark, tmp_path):
    """The sample follows from the pages' content: other partitions, repeated rows and further columns change nothing."""
    pages = [f"<body><nav-of-a-long-name>menu {i}</nav-of-a-long-name><article><p>{' '.join(words(i, 20 + i))}</p></article></body>" for i in range(60)]
    rows = [(i, f"u{i}", h, "x", "y") for i, h in enumerate([*pages, None, "", "<p>no label</p>"])]
    names = "page_id long, url string, html string, key string, feature string"
    counts = []
    for k, kept in enumerate((rows, [*rows[::-1], *rows[:20]])):
        spark.createDataFrame(kept, names).repartition(2 + 3 * k).write.parquet(str(tmp_path / str(k)))
        table = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(html_text.counted_features(table, 10))
        found = Counter((r.page_id, r.text) for r in html_text.extract(table).collect())
        expected = {i: " ".join(words(i, 20 + i)) for i in range(60)} | {60: "", 61: "", 62: "no label"}
        assert found == Counter((r[0], expected[r[0]]) for r in kept)
    assert counts[0] == counts[1] and counts[0]["in p"][0] >= 200
    assert counts[0]["in nav-of-a-long-name"] == (0, 20)
    assert html_text.counted_features(table.where("html is null"), 10) == {}


def repeats_by_brute_force(rows, n):
    split = [(i, (t or "").encode().split()) for i, (_, t) in enumerate(rows)]
    holders = defaultdict(set)
    for i, w in split:
        for k in range(len(w) - n + 1):
            holders[tuple(w[k : k + n])].add(i)
    return {i: set().union(*(range(k, k + n) for k in range(len(w) - n + 1) if len(holders[tuple(w[k : k + n])]) > 1)) for i, w in split}


def test_repeated_passages(spark, stored_docs):
    shared, draw = words(50, 60), random.Random(4)
    rows = [(i, " ".join([*words(100 + i, draw.randint(0, 90)), *shared[draw.randint(0, 10) :], *words(300 + i, draw.randint(0, 90))])) for i in range(40)]
    rows += [(100 + i, " ".join([*words(500 + i, 80), *shared[:49], *words(700 + i, 60)])) for i in range(2)]
    rows += [(200, " ".join(words(900, 300))), (201, None), (202, "")]
    docs = stored_docs(rows)
    found = defaultdict(set)
    for r in suffixes.repeated_passages(docs).collect():
        found[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
        assert r.n_words >= 50
    for i, places in repeats_by_brute_force(rows, 50).items():
        assert places <= found[rows[i][0]]
    assert 200 not in [k for k, v in found.items() if v]
    cut = {r.doc_id: (r.text or "") for r in suffixes.cut_passages(docs).collect()}
    assert len(cut) == len(rows) and cut[200] == rows[-3][1] and cut[201] == ""
    left = list(cut.items())
    assert not any(v for v in repeats_by_brute_force([(k, v) for k, v in left], 60).values())
    assert sum(" ".join(shared[10:]) in t for t in cut.values()) == 1
    assert suffixes.repeated_passages(docs.where("false")).count() == 0


def test_repeated_passages_of_the_tables(spark, stored_docs, odd_rows):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    found = defaultdict(set)
    for r in suffixes.repeated_passages(stored_docs(rows)).collect():
        found[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
    truth = repeats_by_brute_force(rows, 50)
    short = repeats_by_brute_force(rows, 35)
    for i, places in truth.items():
        assert places <= found[rows[i][0]] <= short[i] | places
    assert {r.doc_id for r in suffixes.repeated_passages(stored_docs(odd_rows)).collect()} == {4, 8}


def words_in_shared_runs(rows, n, earlier=False):
    """Places of the words of each text that lie in a run of ``n`` words of another (an earlier) text."""
    seen, inside = defaultdict(set), {}
    for i, text in rows:
        w = text.split()
        for s in range(len(w) - n + 1):
            seen[tuple(w[s : s + n])].add(i)
    for i, text in rows:
        w = text.split()
        starts = [s for s in range(len(w) - n + 1) if (min(seen[tuple(w[s : s + n])]) < i if earlier else seen[tuple(w[s : s + n])] - {i})]
        inside[i] = {p for s in starts for p in range(s, s + n)}
    return inside


def numbered_texts(docs):
    """Texts in table order, by their place in it, and the ``doc_id`` of each place."""
    found = stages.numbered(docs).select("row_number_", "doc_id", "text").orderBy("row_number_").collect()
    return [(i, r.text) for i, r in enumerate(found)], [r.doc_id for r in found]


@pytest.mark.parametrize("size", [50, 70])
def test_passage_repeated_inside_and_across_rows(spark, stored_docs, size):
    passage = words(80, size)
    rows = []
    for i, times in enumerate((2, 3, 4, 2)):
        parts = [[*words(81 + 10 * i + k, 30), *passage] for k in range(times)]
        rows.append((i, " ".join(w for part in parts for w in part)))
    docs = stored_docs(rows)
    found = defaultdict(set)
    for r in suffixes.repeated_passages(docs).collect():
        found[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
    assert dict(found) == words_in_shared_runs(rows, 50)
    texts, ids = numbered_texts(docs)
    known = words_in_shared_runs(texts, 50, earlier=True)
    left = {r.doc_id: r.text for r in suffixes.cut_passages(docs).collect()}
    for i, text in texts:
        assert left[ids[i]].split() == [w for p, w in enumerate(text.split()) if p not in known[i]]


def test_row_numbers_do_not_follow_from_the_splits(spark, stored_docs):
    rows = stages.numbered(stored_docs([(i, f"text {i}") for i in range(300)]))
    changed = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}
    first = {r.row_number_: r.doc_id for r in rows.select("row_number_", "doc_id").collect()}
    for name, value in changed.items():
        spark.conf.set(name, value)
    try:
        again = {r.row_number_: r.doc_id for r in rows.select("row_number_", "doc_id").collect()}
    finally:
        for name in changed:
            spark.conf.unset(name)
    assert first == again and len(first) == 300
    kept = stages.numbered(spark.range(50).repartition(4).withColumn("x", F.rand()))
    assert sorted(kept.collect()) == sorted(kept.select("*").collect())


def test_only_runs_of_one_partner_are_passages(spark, stored_docs):
    """Words that a later text has, and stretches put together from several texts, stay."""
    passage, more, x = words(90, 60), words(91, 40), words(92, 16)
    rows = [(0, [*words(93, 30), *passage]), (1, [*passage, *x, *words(94, 20)]), (2, [*passage, *x, *words(95, 25)])]
    # 45 words of one text and 45 of another, overlapping: 60 words that no single text has.
    rows += [(3, [*more, *passage[:5], *words(96, 40)]), (4, [*words(97, 40), *more[20:], *words(98, 25)]), (5, [*more, *passage[:5], *words(98, 25)[5:]])]
    rows += [(6, [*words(99, 45), *words(100, 30)]), (7, [*words(101, 9), *words(99, 45)[20:], *words(102, 20)]), (8, [*words(99, 45), *words(102, 20)])]
    # The text without the words behind the passage comes first in some of these threes.
    for k in range(10, 19):
        passage, x = words(10 * k, 60), words(10 * k + 1, 12)
        rows += [(10 * k + i, [*words(10 * k + 2 + i, 30), *passage, *(x if i else []), *words(10 * k + 5 + i, 20)]) for i in range(3)]
    rows = [(i, " ".join(w)) for i, w in rows]
    docs = stored_docs(rows)
    found = {i: set() for i, _ in rows}
    for r in suffixes.repeated_passages(docs).collect():
        found[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
    assert found == words_in_shared_runs(rows, 50)
    texts, ids = numbered_texts(docs)
    known = words_in_shared_runs(texts, 50, earlier=True)
    left = {r.doc_id: r.text for r in suffixes.cut_passages(docs).collect()}
    for i, text in texts:
        assert left.get(ids[i], "").split() == [w for p, w in enumerate(text.split()) if p not in known[i]]


def test_cuts_of_the_tables_equal_brute_force(spark):
    docs = documents(spark)
    texts, ids = numbered_texts(docs)
    texts = [(i, t or "") for i, t in texts]
    known = words_in_shared_runs(texts, 50, earlier=True)
    kept = {ids[i]: [w for p, w in enumerate(t.split()) if p not in known[i]] for i, t in texts}
    assert {r.doc_id: (r.text or "").split() for r in suffixes.cut_passages(docs).collect()} == {k: v for k, v in kept.items() if v or not known[ids.index(k)]}


def test_packing_takes_every_token_once(spark, stored_docs, odd_rows, library):
    rows = [(r.doc_id + 100, r.text) for r in documents(spark).collect()] + odd_rows
    packed = packing.pack(stored_docs(rows), tokenizer_file(WORD_TOKENIZER), 2)
    found = packed.collect()
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_document[r.doc_id].append(r)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end <= 4096
    total = 0
    for doc_id, text in rows:
        ids = library[WORD_TOKENIZER].encode(text or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        if [d for d, _ in rows].count(doc_id) > 1:
            continue
        whole = b"".join(r.ids for r in sorted(by_document[doc_id], key=lambda r: r.start))
        assert np.frombuffer(whole, "<u4").tolist() == ids
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(ids) and len(r.ids) == 4 * r.length for r in by_document[doc_id])
    assert sum(r.length for r in found) == total
    assert len(by_sequence) <= 1.02 * total / 4096 + 2
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == 4 * total and all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert packing.pack(stored_docs(odd_rows).where("false"), tokenizer_file(WORD_TOKENIZER), 2).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_of_sequences(seed):
    draw = np.random.default_rng(seed)
    counts = np.zeros(129, dtype=np.int64)
    np.add.at(counts, draw.integers(1, 129, 3000), 1)
    used = Counter()
    plan = packing.plan_sequences(counts, 128)
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= 128 and times > 0
        for size, n in pattern.items():
            used[size] += n * times
    assert all(used[s] == counts[s] for s in range(129))
    # No plan can do with fewer sequences than the linear program.
    least = sum(t for _, t in packing.solve_patterns(counts, 128))
    assert least * (1 - packing.GAP) - 1e-6 <= sum(t for _, t in plan) <= 1.02 * least + 2


def test_near_passages(spark, stored_docs, odd_rows):
    passage, draw = words(60, 120), random.Random(6)
    changed = [w if i % 40 != 20 else f"c{i}" for i, w in enumerate(passage)]
    rows = [(1, " ".join([*words(61, 80), *passage, *words(62, 80)])), (2, " ".join([*words(63, 40), *changed, *words(64, 90)]))]
    rows += [(3, " ".join([*words(65, 50), *passage[30:85], *words(66, 30)])), (4, " ".join(words(67, 300)))]
    found = defaultdict(set)
    for r in compact_windows.near_passages(stored_docs(rows)).collect():
        assert r.similarity >= 0.8 and r.n_words >= 50
        found[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
    assert set(found) == {1, 2, 3}
    # Beyond the outer changes lie too few shared shingles for a share of four in five.
    assert set(range(101, 180)) <= found[1] and set(range(61, 140)) <= found[2] and set(range(50, 105)) <= found[3]
    odd = compact_windows.near_passages(stored_docs(odd_rows)).collect()
    assert {(r.doc_id, r.other_doc_id) for r in odd} == {(4, 8), (8, 4)}
    assert compact_windows.near_passages(stored_docs(odd_rows).where("false")).count() == 0


def test_near_passages_hold_every_exact_repeat(spark, stored_docs):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    found = {r.doc_id for r in compact_windows.near_passages(stored_docs(rows)).collect()}
    low = [(i, (t or "").lower()) for i, t in rows]
    assert {rows[i][0] for i, v in repeats_by_brute_force(low, 50).items() if v} <= found


def windows_of_one(values, width):
    return compact_windows.cartesian_windows(values, np.array([0]), np.array([len(values) - 1]), width)


def near_passage_recall(functions, killed, times=400):
    """Share of planted 50-word passages that have a joint signature in common with a copy.

    One changed word takes ``killed`` of 46 shingles: 5 leave a Jaccard similarity of 41 / 51
    = 0.80, 4 of 42 / 50 = 0.84, 3 of 43 / 49 = 0.88.
    """

    def signatures(text):
        hashes, fn, found, keys = compact_windows.shingles(" ".join(text)), [], [], []
        for f in range(functions):
            values = compact_windows.mixed(hashes ^ np.uint64(compact_windows._SEEDS[f]))
            windows = np.column_stack(windows_of_one(values, 46))
            fn.append(np.full(len(windows), f))
            found.append(windows)
            keys.append(values[windows[:, 1]])
        (low, at, high), fn, key = np.concatenate(found).T, np.concatenate(fn), np.concatenate(keys)
        return {(int(fn[a]), int(fn[b]), int(key[a]), int(key[b])) for x, y in compact_windows._meeting(fn, low, at, high, 46) for a, b in zip(x, y)}

    hits = 0
    for i in range(times):
        passage = [f"p{i}x{k}" for k in range(50)]
        changed = [*passage[: killed - 1], "other", *passage[killed:]] if killed < 5 else [*passage[:20], "other", *passage[21:]]
        mine = [*(f"a{i}x{k}" for k in range(40)), *passage, *(f"b{i}x{k}" for k in range(40))]
        theirs = [*(f"c{i}x{k}" for k in range(40)), *changed, *(f"d{i}x{k}" for k in range(40))]
        hits += bool(signatures(mine) & signatures(theirs))
    return hits / times


@pytest.mark.parametrize("killed, least", [(5, 0.98), (4, 0.99), (3, 0.99)])
def test_recall_of_near_passages(killed, least):
    assert near_passage_recall(compact_windows.FUNCTIONS, killed) >= least


@pytest.mark.parametrize("n, changed, middle", [(50, [25], (26, 50)), (100, [30, 70], (34, 66))])
def test_near_passages_with_other_texts_between(spark, stored_docs, n, changed, middle):
    """Pairs of a passage and a copy of Jaccard similarity 0.80 or 0.81, and for each pair six texts with a part of it."""
    rows, times = [], 100
    for i in range(times):
        passage = [f"p{i}x{k}" for k in range(n)]
        copy = [f"other{k}" if k in changed else w for k, w in enumerate(passage)]
        for j, part in enumerate((passage, *[passage[slice(*middle)]] * 6, copy)):
            rows.append((10 * i + j, " ".join([*(f"a{i}y{j}x{k}" for k in range(40)), *part, *(f"b{i}y{j}x{k}" for k in range(40))])))
    grams = {i: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for i, t in rows for w in [t.split()]}
    found = {(r.doc_id, r.other_doc_id) for r in compact_windows.near_passages(stored_docs(rows)).collect()}
    truth = set()
    for i in range(times):
        for a in range(10 * i, 10 * i + 8):
            for b in range(10 * i, 10 * i + 8):
                known = set(grams[b]) if a != b else ()
                shared = np.array([g in known for g in grams[a]])
                truth |= {(a, b)} if compact_windows.dense_stretches(shared, 0.8, 46) else set()
    assert found <= truth and len(truth) == 2 * times
    assert len(found) >= 0.9 * len(truth)


def test_near_passages_behind_many_other_texts(spark, stored_docs):
    """Pairs of a passage and a copy of Jaccard similarity 0.84, and for each pair forty texts with half of it."""
    rows, times = [], 30
    for i in range(times):
        passage = [f"p{i}x{k}" for k in range(60)]
        copy = [f"other{k}" if k in [25 + i % 10] else w for k, w in enumerate(passage)]
        for j, part in enumerate((passage, *[passage[:30], passage[30:]] * 20, copy)):
            rows.append((100 * i + j, " ".join([*(f"a{i}y{j}x{k}" for k in range(40)), *part, *(f"b{i}y{j}x{k}" for k in range(40))])))
    docs = stored_docs(rows)
    numbers = docs.select(F.col("doc_id").alias("row_number_"), "text")
    signs = defaultdict(set)
    for r in compact_windows.joint_signatures(compact_windows.text_windows(numbers, compact_windows.FUNCTIONS, 46, 5), 46).select("row", "sign").collect():
        signs[r.row].add(r.sign)
    truth = [i for i in range(times) if signs[100 * i] & signs[100 * i + 41]]
    found = compact_windows.near_passages(docs).collect()
    of = {r.doc_id: r.class_id for r in found}
    assert [i for i in range(times) if of.get(100 * i, -1) == of.get(100 * i + 41, -2)] == truth and len(truth) > 0.9 * times
    assert set(of) == {100 * i + j for i in truth for j in (0, 41)} and len(set(of.values())) == len(truth)
    assert all(r.similarity >= 0.8 and r.n_words >= 50 and 35 <= r.start_word <= 60 for r in found)


def test_links_between_classes_join_what_brute_force_joins(spark):
    """Any links in one signature: the classes of all pairs, though only some are returned."""
    draw, width, rows = random.Random(11), 46, []
    for row in range(700):
        start = draw.randrange(0, 4000)
        hashes = np.arange(start, start + 60, dtype="<u4")
        rows.append((7, row, row - row % 3 if row < 60 else row, row >= 3, 60, np.array([[row, 60]], dtype="<i4").tobytes(), hashes.tobytes()))
    schema = "sign long, row long, root long, rest boolean, n long, ranges binary, hashes binary"
    links = compact_windows.links_between_classes(spark.createDataFrame(rows, schema), 0.8, width, 5).collect()
    starts = {r[1]: np.frombuffer(r[6], dtype="<u4")[0].item() for r in rows}

    def classes(pairs):
        top = {r[1]: r[2] for r in rows}
        for a, b in pairs:
            a, b = top[a], top[b]
            if a != b:
                top = {k: a if v == b else v for k, v in top.items()}
        groups = defaultdict(set)
        for k, v in top.items():
            groups[v].add(k)
        return {frozenset(g) for g in groups.values()}

    def near(a, b):
        shared = np.isin(np.arange(starts[a], starts[a] + 60), np.arange(starts[b], starts[b] + 60))
        return bool(compact_windows.dense_stretches(shared, 0.8, width))

    truth = [(a, b) for a in starts for b in starts if a < b and abs(starts[a] - starts[b]) < 60 and near(a, b)]
    assert classes((r.row, r.other) for r in links) == classes(truth)
    assert {(min(r.row, r.other), max(r.row, r.other)) for r in links} <= set(truth) and len(links) < len(truth)


@pytest.mark.parametrize("similarity, width", [(0.8, 46), (0.75, 10), (0.9, 5)])
def test_scan_over_many_stretches_finds_those_with_a_dense_one(similarity, width):
    draw, stretches = np.random.default_rng(4), []
    for i in range(600):
        runs = draw.integers(1, 30, 12)
        stretches.append(np.concatenate([np.full(n // (1 + 3 * ((k + i) % 2)) + 1, (k + i) % 2 == 0) for k, n in enumerate(runs)])[: draw.integers(0, 200)])
    found = compact_windows.has_dense(np.concatenate(stretches), np.array([len(x) for x in stretches]), similarity, width)
    truth = np.array([bool(compact_windows.dense_stretches(x, similarity, width)) for x in stretches])
    assert 0 < truth.sum() < len(truth)
    assert (found | ~truth).all() and found.sum() <= truth.sum() + 12


def test_pairs_without_a_dense_stretch_are_not_verified_one_by_one(monkeypatch):
    """Many shingles in common, but never four of five side by side."""
    calls, real = [], compact_windows.verified_passages
    monkeypatch.setattr(compact_windows, "verified_passages", lambda *a: calls.append(1) or real(*a))
    common, rows = np.arange(100), []
    for i in range(12):
        hashes = np.where(common % 10 < 5, common, 1000 * (i + 1) + common).astype("<u4")
        rows.append({"row": i, "root": i, "rest": i > 0, "ranges": np.array([[0, 100]], dtype="<i4").tobytes(), "hashes": hashes.tobytes()})
    assert not list(compact_windows._links_of_block(rows, rows[1:], 0.8, 46, 5)) and not calls
    rows[3] = rows[3] | {"hashes": rows[7]["hashes"]}
    found = list(compact_windows._links_of_block(rows, rows[1:], 0.8, 46, 5))
    assert [f[:4] for f in found] == [(3, 7, 3, 7)] and len(calls) == 1


def test_blocks_of_one_signature_are_dealt_to_many_tasks(spark):
    one = np.arange(60, dtype="<u4").tobytes()
    rows = [(7, i, i, i > 0, 60, np.array([[0, 60]], dtype="<i4").tobytes(), one) for i in range(1000)]
    cut = spark.createDataFrame(rows, "sign long, row long, root long, rest boolean, n long, ranges binary, hashes binary")
    links = compact_windows.links_between_classes(cut, 0.8, 46, 5)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(sign#\d+L, i#\d+, j#\d+", plan)
    assert links.count() >= 999


def test_merged_stretches_of_many_lists():
    of, bounds = np.array([0, 2, 0, 2, 0]), np.array([[5, 9], [0, 3], [0, 4], [1, 2], [11, 12]])
    found = compact_windows._merged(of, bounds)
    assert [x.tolist() for x in found] == [[0, 0, 2], [0, 11, 0], [9, 12, 3]]
    assert [len(x) for x in compact_windows._merged(of[:0], bounds[:0])] == [0, 0, 0]


def test_near_passages_of_repetitive_texts(spark, stored_docs):
    """Equal hashes in all of a text; each text finds the other one of its kind."""
    rows = [(1, "la " * 30_000), (2, "la " * 20_000), (3, "tick tack " * 8000), (4, "x tick tack " + "tick tack " * 9000), (5, " ".join(words(5, 400)))]
    found = defaultdict(int)
    for r in compact_windows.near_passages(stored_docs(rows)).collect():
        found[r.doc_id, r.other_doc_id] += r.n_words
    assert set(found) == {(1, 2), (2, 1), (3, 4), (4, 3)}
    assert found[1, 2] == 30_000 and found[2, 1] == 20_000 and found[3, 4] == 16_000


@pytest.mark.parametrize("values", [np.zeros(20_000, np.uint64), np.arange(20_000, dtype=np.uint64) % np.uint64(2)])
def test_compact_windows_of_ties_stay_few(values):
    assert len(windows_of_one(values, 46)[0]) <= 2 * len(values) / 46


@pytest.mark.parametrize("parts", [[1000, -100, 60], [60, -40, 1000], [45, -5, 10], [300, -60, 50, -30, 46], [46], [45]])
def test_every_dense_stretch_of_a_pair_is_found(parts):
    shared = np.concatenate([np.full(abs(n), n > 0) for n in parts])
    ends = np.cumsum(np.abs(parts))
    covered = np.zeros(len(shared), dtype=bool)
    for a, b in compact_windows.dense_stretches(shared, 0.8, 46):
        assert b - a >= 46 and shared[a:b].mean() >= 0.8
        covered[a:b] = True
    for n, end in zip(parts, ends):
        assert n < 46 or covered[end - n : end].all()
    assert covered.any() == (parts != [45])


@pytest.mark.parametrize("kinds", [60, 7, 1])
def test_cartesian_windows(kinds):
    """Each stretch has one window with its least hash; trees side by side are those of each alone."""
    draw = np.random.default_rng(8)
    values = draw.permutation(60).astype(np.uint64) % np.uint64(kinds)
    windows = list(zip(*windows_of_one(values, 5)))
    for low in range(60):
        for high in range(low + 4, 60):
            held = [c for a, c, b in windows if a <= low <= c <= high <= b]
            assert len(held) == 1 and values[held[0]] == values[low : high + 1].min()
    lows, highs = np.array([0, 20, 23, 40]), np.array([19, 22, 39, 59])
    both = sorted(zip(*compact_windows.cartesian_windows(values, lows, highs, 5)))
    alone = [(a + low, c + low, b + low) for low, high in zip(lows, highs) for a, c, b in zip(*windows_of_one(values[low : high + 1], 5))]
    assert both == sorted(alone)


def contamination_by_brute_force(docs, items, n):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        m = min(n, len(w))
        for k in range(len(w) - m + 1) if w else ():
            windows[tuple(w[k : k + m])].add(item)
    out = Counter()
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        names = sorted(str(i) for i in found if i is not None)
        out[doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    return out


def test_winnowing(spark, stored_docs, odd_rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "the and"), (901, None), (902, "..."), (903, "One"), (None, "Two, words!"), (904, "two WORDS"), (904, "two WORDS")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for rows in ([(r.doc_id, r.text) for r in documents(spark).collect()], odd_rows):
        docs = stored_docs(rows)
        expected = contamination_by_brute_force(rows, items, 10)
        assert Counter(tuple(r) for r in winnowing.decontaminate(docs, frame).select(*names).collect()) == expected
        clean = Counter(r.doc_id for r in winnowing.keep_clean(docs, frame).collect())
        assert clean == Counter({k[0]: n for k, n in expected.items() if not k[-1]}) or sum(clean.values()) == sum(n for k, n in expected.items() if not k[-1])
    assert winnowing.decontaminate(docs.where("false"), frame).count() == 0
    assert winnowing.decontaminate(docs, frame.where("false")).where("contaminated").count() == 0


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def test_quality_measures(spark, stored_docs, odd_rows):
    rows = odd_rows + [(20, "a b c\n" * 60), (21, "# $ % word " * 40), (22, "CAPITAL " + " ".join(x.upper() for x in words(9, 90)))]
    docs = stored_docs(rows)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    measured = quality.measure(docs)
    found = Counter(tuple(r) for r in measured.select(*names).collect())
    assert found == Counter((d, *plain_measures(t)) for d, t in rows)
    kept = Counter(r.doc_id for r in measured.where("kept").collect())
    assert kept == Counter(r.doc_id for r in quality.keep_good(docs).collect()) and kept[4] == kept[8] == 1
    assert not {20, 21, 22} & set(kept) and quality.keep_good(docs).columns == docs.columns
    assert quality.measure(docs.where("false")).count() == 0


def test_order_of_rules_never_changes_the_verdict():
    texts = [r for _, r in [(0, "a " * 80), (1, "x | y " * 50), (2, " ".join(words(1, 99))), (3, None)]]
    rules = [*quality.BASE_RULES, *quality.FURTHER_RULES]
    kept = [quality.passes(quality.Measured(t), quality.ordered_rules(texts, rules)) for t in texts]
    assert kept == [quality.passes(quality.Measured(t), rules) for t in texts] == [False, False, True, False]
    slow = quality.Rule("slow", lambda t: sum(range(200_000)) < 0)
    assert quality.ordered_rules(texts, [slow, *rules])[-1] is slow
