"""The training-data operators: edge cases, brute force, round trips."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import chat_format, components, decontamination, html_text, kneser_ney, line_dedup, mixing_lm, near_copies, packing, quality_rules, sharding, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, n_lines long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", 7) for i, t, s in rows], DOCS)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Null, empty, blank, one word, a very long text, copies, repeated rows, a null id and source."""
    long = words(20_000, 1, 5000)
    return [(1, None, "a"), (2, "", "a"), (3, " \n\t", "b"), (4, "one", "b"), (5, long, "a"), (6, long, None), (7, words(60, 2), "c"), (7, words(60, 2), "c"), (None, words(40, 3), None)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# 1 ---------------------------------------------------------------------------


def brute_base(text):
    text = text or ""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = set()
    for i in range(len(w) - 7):
        if wins[tuple(w[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if any(c not in " \t\n\v\f\r" for c in x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_base_metrics(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["a", "b", "#c", "é<"]) for _ in range(r.randrange(60))).replace("b a", "b\na"), "s") for i in range(60)] + odd_rows()
    for x in quality_rules.base_metrics(docs(spark, rows)).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_base(x.text)


def test_common_lines_reject_all_but_the_first(spark, none):
    shared = "\n".join(words(12, 50 + i) for i in range(3))
    rows = [(i, shared if i < 40 else words(30, i, 10**6), "host") for i in range(100)]
    got = {r.doc_id: r.kept for r in quality_rules.verdicts(docs(spark, rows)).collect()}
    assert [i for i, k in got.items() if k] == [0, *range(40, 100)] or sorted(i for i, k in got.items() if k) == [0, *range(40, 100)]
    assert quality_rules.kept_documents(docs(spark, rows)).count() == 61
    assert quality_rules.verdicts(none).count() == 0


def test_quality_odd_rows(odd):
    got = quality_rules.verdicts(odd).collect()
    assert len(got) == 9 and sum(r.kept for r in got) == 5


# 2 ---------------------------------------------------------------------------


def test_chats_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "␛0␛1␛2", "[TURN]user[/TURN]x</s>", "<<s>>[[TURN]]", "", None, "a\nb", "␛</s>"]
    rows = [(c, t, "assistant" if t % 2 else "user", nasty[(c + t) % len(nasty)]) for c in range(8) for t in range(4)] + [(99, 0, None, None), (98, 0, "assistant", "x"), (None, None, "us</s>er", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1]))
        assert [(t.role, t.text) for t in back[c].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert back[c].loss_texts == [r[3] or "" for r in own if r[2] == "assistant"]
        assert "".join(s.text for s in back[c].segments) == back[c].formatted
    assert back[0].valid_order and not back[98].valid_order and not back[99].valid_order
    assert chat_format.format_chats(df.limit(0)).count() == 0


# 3 ---------------------------------------------------------------------------


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_by_brute_force():
    for t in [None, "", " ", "A b", "a B c", "Ünï A\x0bB\x1cc d", *[words(n, n, 50) for n in range(1, 40)]]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_links_by_brute_force(spark):
    r = random.Random(9)
    fps = {0}
    while len(fps) < 300:
        f = r.getrandbits(64)
        for _ in range(r.randrange(1, 8)):
            fps.add(f)
            for _ in range(r.choice([1, 2, 3])):
                f ^= 1 << r.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, f) for f in signed], "id long, fp long")
    got = {frozenset((a.a, a.b)) for a in simhash.close_pairs(df).collect()}
    mask = (1 << 64) - 1
    want = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & mask).bit_count() <= 2}
    assert got == want and want


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250), *[(500, 501 + i) for i in range(60)]]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and got[300] == got[250] == 200 and got[560] == 500 and 7 in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    by = Counter((r.component_id for r in got))
    assert len(got) == 9 and by[1] == 3 and by[5] == 2 and by[7] == 2
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7]
    assert simhash.near_duplicates(none).count() == 0


# 4 ---------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, really, many of them.</div>
<div id="content"><div class="ad">Buy</div><article><h1>Title &amp; more</h1><p>First <b>bold</b> paragraph, with commas, and a good deal of text in it.<br>Next line<p>Second   paragraph,
not closed, but long enough to count &lt;here&gt; in the tree.<aside>Side, note, that is beside the point.</aside><form><p>Name, please, and address</p></form>
<blockquote><p>Short.</p></blockquote></article><section class="comments"><p>I am a reader, and I comment, at length, on what I have just read here.</p></section></div>
<div class="sidebar"><p>More, of, this, and, that, and the other thing beside the text.</p></div><footer>&copy; us, all rights</footer></body></html>"""


def test_article_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst bold paragraph, with commas, and a good deal of text in it. Next line\nSecond paragraph, not closed, but long enough to count <here> in the tree.\nShort."


@pytest.mark.parametrize(("html", "want"), [(None, ""), ("", ""), ("plain text only", "plain text only"), ("<p>a<p>b", "a\nb"), ("<script>x", ""), ("<!-- open", ""), ("<div><p>x &lt; y</p></div><", "x < y\n<"), ("<p>&#233;&nbsp;&#x41;</p>", "é A")])
def test_article_edges(html, want):
    assert html_text.main_text(html) == want


LONG = "A paragraph, with commas, and a good deal of text in it, so that it counts."
KEPT = {
    "unquoted apostrophe": (f"<article><p title=it's>{LONG}</p><p>the rest of it</p></article>", [LONG, "the rest of it"]),
    "names of the article's own": (f"<article><h1>T</h1><p>{LONG}</p><p class=tags>{LONG}</p><div class='search'>{LONG}</div><p id=notice>{LONG}</p></article>", ["T", *[LONG] * 4]),
    "labels in an article": (f"<article><p>{LONG}</p><div class='share'><a href=x>Share</a></div><p class='tags'>one two</p></article>", [LONG]),
    "references": (f"<article><p>{LONG}</p><ul><li><a href=1>First reference</a><li><a href=2>Second</a><li><a href=3>Third</a></ul></article>", [LONG, "First reference", "Second", "Third"]),
    "short sibling section": (f"<div><section><h2>One</h2><p>{LONG}</p><p>{LONG}</p></section><section><h2>Two</h2><p>Short para of the same article.</p></section></div>", ["One", LONG, LONG, "Two", "Short para of the same article."]),
    "header of a post": (f"<div class='post'><div class='post-header'><h1>Title</h1></div><p>{LONG}</p><p>{LONG}</p></div>", ["Title", LONG, LONG]),
    "reader's comment": (f"<article><p>{LONG}</p><article><p>I comment, as a reader, on what I have read.</p></article></article>", [LONG]),
    "menu outside": (f"<div><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>About</a></ul><p>{LONG}</p><p>{LONG}</p></div>", [LONG, LONG]),
    "no closing quote": (f"<article><p class='x>{LONG}</p><p>{LONG}</article>", None),
}


@pytest.mark.parametrize("case", KEPT)
def test_article_keeps_its_own(case):
    html, want = KEPT[case]
    got = html_text.main_text(html)
    assert LONG in got if want is None else got == "\n".join(want)


def test_deep_and_hostile_pages_take_linear_time():
    began = __import__("time").time()
    n = 100_000
    assert html_text.main_text("<div>" * n + LONG + "</div>" * n) == LONG
    assert html_text.main_text("<nav>" + "<div>" * n + "</b>" * n + f"</nav><p>{LONG}") == LONG
    assert html_text.main_text(f"<p>{LONG}</p>" + "</section>" * n) == LONG
    assert len(html_text.main_text("".join(f"<div>{LONG}" for _ in range(20_000)))) > 20_000
    html_text.main_text("<a title='" * n)
    html_text.main_text("<!-- " * n)
    assert __import__("time").time() - began < 20


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", None, "a", 1), (2, None, PAGE, "b", 2), (2, None, PAGE, None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extracted(df).collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and len(got) == 3
    assert html_text.extracted(df.limit(0)).count() == 0


# 5 ---------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(5))
def test_least_slack_by_brute_force(seed):
    r = random.Random(seed)
    counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(6)}
    room = r.randrange(5, 60)
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    got = packing.least_slack(counts, room)
    assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room) and all(n <= counts[x] for x, n in got.items())


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder()
    r = random.Random(3)
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "it's ok", "x<|endoftext|>y", "é ü z", " a b", "1 2,3", "a\x1cb c", "a \x1c b"]
    texts += ["".join(r.choice([" ", " ", "\n", "a", "b'", "'s", "é", "1", ".", " ", "ñ"]) for _ in range(40)) for _ in range(200)]
    for t in texts:
        assert e(t).tolist() == e.whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_packed_pieces(odd, none):
    e = packing.Encoder()
    rows = packing.packed(odd).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= packing.WINDOW
    assert sorted(rows.sequence_id.unique()) == list(range(rows.sequence_id.nunique()))
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist()
    ids = np.append(e(odd_rows()[4][1]), 1).astype("<u4")
    own = rows[rows.doc_id == 5].sort_values("start")
    assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
    assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    assert (rows[rows.doc_id == 1].length == 1).all() and len(rows[rows.doc_id == 7]) == 2
    assert packing.packed(none).count() == 0


# 6 ---------------------------------------------------------------------------


def test_language_model_scores(spark, none):
    rows = [(i, words(80, i, 60) + f" rare{i}", "s") for i in range(300)] + [(900, None, "s"), (901, "", "s"), (902, "never seen ÄÖ", "s"), (903, "w1 " * 3000, "s")]
    got = {r.doc_id: r for r in mixing_lm.scored(docs(spark, rows)).collect()}
    train = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in (t or "").encode().lower().decode().split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, t, _ in rows:
        w = (t or "").encode().lower().decode().split()
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        g = got[i]
        assert g.base_score == pytest.approx(base) and g.n_known == sum(c[x] > 0 for x in w) + 1 and g.n_tokens == len(w) + 1 and g.train_tokens == n
        assert g.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and math.isfinite(g.score) and g.score < 0
    held = [g for g in got.values() if g.held_out and g.doc_id < 300]
    assert np.mean([g.score - g.base_score for g in held]) > 0
    assert mixing_lm.scored(none).count() == 0


def local_model(train):
    """The model of some texts, its counts summed in one process, weights fitted on the texts in order."""
    c = Counter(w for t in train for w in t)
    top = sorted(((w, n) for w, n in c.items() if n >= mixing_lm.LEAST_COUNT), key=lambda x: (-x[1], x[0]))
    m = mixing_lm.Model([w for w, _ in top], [n for _, n in top], sum(c.values()) + len(train), len(train))
    m.load(iter(()))
    size = 1 << mixing_lm.REGION_BITS
    for t, r, keys, n in m.pairs(train):
        part = m.word_mix.counts[t + 1].reshape(size, -1)[r]
        into = np.zeros(len(part))
        m.count_pairs(t, np.frombuffer(keys, np.int64), np.frombuffer(n, np.uint32), into)
        part += into.astype(np.float32)
    for _, bit, at in m.spell_bits([w for w in c if w not in m.ids]):
        for x, i in zip(m.spell_mix.counts, at):
            np.add.at(x, 2 * i.astype(np.int64) + bit, 1)
    return m, c


def slow_bits(m, words, doc_words):
    """The bits of symbols by their definition: one bit at a time, counts from plain dictionaries."""
    tables = slow_bits.tables
    kind = max(range(min(mixing_lm.CLASSES, m.end)), key=lambda i: (doc_words.count(m.words[i]), -i), default=0)
    total, before = math.log2(mixing_lm.CLASSES), m.end
    for w in [*words, None]:
        s = m.end if w is None else m.ids.get(w, m.escape)
        lo = m.word_tree.start[s]
        for node, bit in zip(m.word_tree.nodes[lo : lo + m.word_tree.length[s]].tolist(), m.word_tree.bits[lo : lo + m.word_tree.length[s]].tolist()):
            pairs = [tables[0][node], tables[1][kind, node], tables[2][before, node]]
            x = [math.log((c[1] + mixing_lm.DELTA) / (c[0] + mixing_lm.DELTA)) for c in pairs]
            fill = [(sum(c) > 0) + (sum(c) >= 8) for c in pairs]
            gate = 3 * fill[1] + fill[2]
            dot = sum(float(a) * b for a, b in zip(m.word_mix.weights[gate], x))
            half = mixing_lm.CELLS // 2
            cell = max(-half, min(half, round(dot * 2)))
            n0, n1 = m.word_mix.cells[gate * mixing_lm.CELLS + cell + half]
            trust = min((n0 + n1) / 200, 1)
            dot = (dot + trust * math.log((n1 + 0.5) / (n0 + 0.5)) + (1 - trust) * cell / 2) / 2
            total += math.log2(1 + math.exp(-dot if bit else dot))
        before = s
    return total


def test_mixed_bits_by_definition(monkeypatch):
    monkeypatch.setattr(mixing_lm, "table_bits", lambda n: 22)  # so that hardly any slot is shared
    texts = [mixing_lm.tokens(words(60, i, 40) + f" rare{i}") for i in range(40)]
    m, _ = local_model(texts)
    m.fit(iter(texts))
    m.word_mix.fix()
    m.spell_mix.fix()
    tables = slow_bits.tables = [defaultdict(lambda: [0, 0]) for _ in range(3)]
    for t in texts:
        kind, before = max(range(min(mixing_lm.CLASSES, m.end)), key=lambda i: (t.count(m.words[i]), -i)), m.end
        for w in [*t, None]:
            s = m.end if w is None else m.ids.get(w, m.escape)
            lo = m.word_tree.start[s]
            for node, bit in zip(m.word_tree.nodes[lo : lo + m.word_tree.length[s]].tolist(), m.word_tree.bits[lo : lo + m.word_tree.length[s]].tolist()):
                for table, key in zip(tables, (node, (kind, node), (before, node))):
                    table[key][bit] += 1
            before = s
    new = [mixing_lm.tokens(words(50, 100 + i, 60)) for i in range(10)] + [[]]
    got = m.score(m.chunk(new), len(new))
    for g, t in zip(got, new):
        assert g == pytest.approx(slow_bits(m, t, t), rel=1e-3)  # costs are on a grid


def test_weights_are_learnt_from_all_training_documents(spark):
    """The places of the grid count every bit of every training document, also of the 1,001st and later ones."""
    rows = [(i, words(12, i, 30), "s") for i in range(1500)]
    train = [mixing_lm.tokens(t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    m, c = local_model(train)
    counts = spark.createDataFrame([(w, n) for w, n in c.items()], "word binary, c long")
    learnt = mixing_lm.fitted(docs(spark, rows).repartition(7), counts, spark.sparkContext.broadcast(m))
    bits = sum(int(m.word_tree.length[m.ids.get(w, m.escape)]) for t in train for w in t) + len(train) * int(m.word_tree.length[m.end])
    assert len(train) > 1000 and learnt[0][1].sum() == bits
    m.fit(iter(train))
    assert np.allclose(learnt[0][0], m.word_mix.weights) and (learnt[0][1] == m.word_mix.cells).all()


def test_learning_holds_no_word_as_an_object_and_no_table_twice():
    """A task of op6 took 3,022 of 3,000 MB: words of a chunk were objects, places were held by the million."""
    pool = [words(500, i, 300) for i in range(40)]
    texts = [pool[i % 40] for i in range(1000)] + [" Lead\u00a0 \t tail ", None, ""]
    m, _ = local_model([mixing_lm.tokens(t) for t in pool])
    batch = pa.RecordBatch.from_arrays([pa.array([3] * len(texts)), pa.array(texts)], names=["doc_id", "text"])
    assert mixing_lm.fold(3) != mixing_lm.HELD_OUT
    into = mixing_lm.Tally(m.word_mix)
    tracemalloc.start()
    seen = 0
    for ids, found in mixing_lm.chunks(iter([batch]), True):
        assert [bytes(x) for x in found.flat.to_pylist()] == [w for t in texts[seen : seen + len(ids)] for w in mixing_lm.tokens(t)]
        seen += len(ids)
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    for _, found in mixing_lm.chunks(iter([batch]), True):
        m.tally(found, into)
    _, n = into.sums()
    most = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert seen == len(texts)
    assert n.sum() == sum(int(m.word_tree.length[m.ids.get(w, m.escape)]) for t in texts for w in mixing_lm.tokens(t)) + len(texts) * int(m.word_tree.length[m.end])
    assert most < 100 << 20


def test_costs_are_those_of_a_distribution():
    texts = [[b"a", b"bb", b"x"], [b"c", b"a", b"bb"], [b"c", b"a", b"bb", b"c"]] * 5
    m, _ = local_model(texts)
    m.fit(iter(texts))
    m.word_mix.fix()
    m.spell_mix.fix()
    symbol = np.arange(m.symbols)
    cost = np.zeros(m.symbols)
    for item, bit, at in m.word_bits(symbol, symbol * 0 + 1, symbol * 0 + 2):
        cost += np.bincount(item, m.word_mix.cost(at, bit), m.symbols)
    assert np.sum(2.0**-cost) == pytest.approx(1, abs=0.02)
    one = m.spelling([bytes([b]) for b in range(256)] + [b""])
    assert np.sum(2.0 ** -one) < 1


def test_language_model_is_the_same_for_any_partitioning(spark, odd, monkeypatch):
    rows = [(i % 250, words(70, i % 250, 300) + f" rare{i % 9} Own{i % 250}", "s") for i in range(300)] + odd_rows()
    a, b = (sorted((r.doc_id or -1, round(r.score, 9)) for r in mixing_lm.scored(docs(spark, rows).repartition(n)).collect()) for n in (1, 13))
    monkeypatch.setattr(mixing_lm, "TOKENS_A_SUM", 1 << 12)  # regions are summed in two steps
    c = sorted((r.doc_id or -1, round(r.score, 9)) for r in mixing_lm.scored(docs(spark, rows).repartition(5)).collect())
    assert a == b == c and len(a) == len(rows)
    held = [r for r in odd_rows() if zlib.crc32(str(r[0] or "null").encode()) % 7 == 2] or [(2, "x", "s")]
    only = mixing_lm.scored(docs(spark, [(i, f"w{i} x", "s") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2])).collect()
    assert held and only and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in only)


# 7 ---------------------------------------------------------------------------


def brute_leaks(rows, items):
    import re

    def runs(t, k):
        w = [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)

    out = set()
    for i, t, _ in rows:
        for j, s in items:
            k = min(5, runs(s, 1)[1])
            if k:
                q = runs(s, k)[0]
                if len(runs(t, k)[0] & q) >= math.ceil(round(0.8 * len(q), 6)):
                    out.add((i, j))
    return out


def test_leaks_by_brute_force(spark, none):
    items = [(j, words(10 + 4 * j, 700 + j, 10**5)) for j in range(12)] + [(50, "two words"), (51, None), (52, "")]
    rows = []
    for i in range(120):
        j = i % 12
        w = items[j][1].split()
        for _ in range(i % 5):
            w[random.Random(i).randrange(len(w))] = "changed"
        rows.append((i, words(200, i, 10**5) + ".\n" + " ".join(w).upper() + ", " + words(3, i), "s"))
    items += [(53, "quick brown fox"), (54, "solo"), (55, "a b c d"), (56, "x y z")]
    rows += odd_rows() + [(500, "Two words!", "s"), (501, "x y z the Quick, brown fox and more " + words(50, 1), "s"), (502, "- solo a b c", "s"), (503, "b a b c d", "s"), (504, "x y", "s")]
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contained(d, b).collect()}
    want = brute_leaks(rows, items)
    assert got == want and {(500, 50), (501, 53), (501, 56), (502, 54), (503, 55)} <= got and not any(i == 504 for i, _ in got)
    assert decontamination.decontaminated(d, b).count() == sum(r[0] not in {i for i, _ in want} for r in rows)
    assert decontamination.contained(none, b).count() == 0 and decontamination.contained(d, b.limit(0)).count() == 0


# 8 ---------------------------------------------------------------------------


def test_boilerplate_lines(spark, odd, none):
    rows = [(i, f"own {i}\nAll  rights\treserved\n\nseen on nine {i % 9}" if i < 30 else f"x {i}", f"s{i % 15}") for i in range(40)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    removed = {r.row.doc_id: r.n_removed for r in line_dedup.removals(docs(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and removed[0] == 0 and got[0].n_lines == 7
    assert all(got[i].text == f"own {i}\n\nseen on nine {i % 9}" and removed[i] == 1 for i in range(1, 30))
    assert got[35].text == "x 35" and got[35].h == "clash"
    same = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(odd).collect()}
    assert same == {(i, t) for i, t, _ in odd_rows()}
    assert line_dedup.dedup_lines(none).count() == 0


# 9 ---------------------------------------------------------------------------


def slow_kneser_ney(texts):
    """Probability function of the interpolated model, from its definition."""
    c3 = Counter()
    for t in texts:
        w = [1, 1, *t.split(), 2]
        c3.update(zip(w, w[1:], w[2:]))
    c2 = Counter((v, w) for _, v, w in c3)
    c1 = Counter(w for _, w in c2)

    def discounts(c):
        n = [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0
        out = [k - (k + 1) * y * n[k] / n[k - 1] if n[0] and n[k - 1] else 0.75 for k in (1, 2, 3)]
        return [max(0.05, min(x, i - 0.05)) for i, x in enumerate(out, 1)]

    def level(c, d, g, lower):
        same = {k: x for k, x in c.items() if k[:-1] == g[:-1]}
        if not same:
            return lower
        cut = lambda x: d[min(x, 3) - 1]
        total = sum(same.values())
        x = c.get(g, 0)
        return (max(x - cut(x), 0) / total if x else 0) + sum(map(cut, same.values())) / total * lower

    d1, d2, d3 = discounts(c1), discounts(c2), discounts(c3)
    one = {(w,): x for w, x in c1.items()}

    def p(u, v, w):
        return level(c3, d3, (u, v, w), level(c2, d2, (v, w), level(one, d1, (w,), 1 / (len(c1) + 1))))

    return p


def test_perplexity_by_definition(spark, monkeypatch, tmp_path):
    train = [words(25, i, 12) for i in range(12)]
    rows = spark.createDataFrame([(i, "en", t) for i, t in enumerate(train)], "doc_id long, lang string, text string")
    tables = kneser_ney.model(rows)
    p = slow_kneser_ney(train)
    texts = [train[0], words(9, 77, 14), "zz", "w1 zz w1", "", None, "w2", *[words(40, i, 16) for i in range(60)], train[0], " ".join(train) * 20]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"))
    asked.write.parquet(str(tmp_path / "asked"))
    asked = spark.read.parquet(str(tmp_path / "asked"))
    seen = []
    for parts, bytes_ in ((1, 2 << 30), (3, 2 << 30), (7, 1 << 12)):
        monkeypatch.setattr(kneser_ney, "SALT_BYTES", bytes_)  # several tasks for each shard
        got = {r.doc_id: r for r in kneser_ney.scores(asked.repartition(parts), tables).collect()}
        seen.append({i: r.perplexity for i, r in got.items()})
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            w = [1, 1, *(t or "").split(), 2]
            if len(w) == 3:
                assert got[i].n_tokens == 0 and got[i].perplexity is None
                continue
            want = sum(math.log10(p(*g)) for g in zip(w, w[1:], w[2:])) / (len(w) - 2)
            assert got[i].n_tokens == len(w) - 2 and got[i].perplexity == pytest.approx(10**-want, rel=1e-5)
    assert seen[0] == seen[1] == seen[2] and seen[0][0] == seen[0][len(texts) - 2]


def test_shards_keep_all_weights():
    r = np.random.default_rng(3)
    keys, values = r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), r.normal(size=5000)
    batches = [pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(v)], names=["key", "value"]) for k, v in zip(np.split(keys, 5), np.split(values, 5))]
    found = {}
    for b in kneser_ney.packed_weights(iter(batches)):
        for shard, k, v in zip(*(b.column(i).to_pylist() for i in range(3))):
            k, v = np.frombuffer(k, np.uint64), np.frombuffer(v, np.float32)
            assert (k >> np.uint64(64 - kneser_ney.SHARD_BITS) == shard).all()
            found |= dict(zip(k.tolist(), v.tolist()))
    assert found == pytest.approx(dict(zip(keys.tolist(), values.tolist())), rel=1e-6)
    assert list(kneser_ney.packed_weights(iter([]))) == []
    for kind in (np.uint16, np.uint32, np.uint64):
        for n in (0, 1, 77):
            x = r.integers(0, 60000, n).astype(kind)
            assert (kneser_ney.unsqueezed(kneser_ney.squeezed(x), kind) == x).all()


def test_classifier_keeps_clean_text(spark, odd, none):
    rows = [(i, words(60, i, 40), "s") for i in range(200)] + [(500 + i, " ".join(f"j{random.Random(i).random()}" for _ in range(50)), "s") for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classified(docs(spark, rows), labels).collect()}
    assert np.mean([got[i].kept for i in range(200)]) > 0.95 and not any(got[500 + i].kept for i in range(10))
    out = kneser_ney.classified(odd, labels.limit(0)).collect()
    assert len(out) == 9 and sum(r.perplexity is None for r in out) == 3 and sum(r.kept for r in out) == 6
    assert kneser_ney.classified(none, labels).count() == 0


def test_limits_by_brute_force(spark):
    r = random.Random(4)
    rows = [(i, words(r.randrange(5, 60), i, 40), ["en", "de", None][i % 3]) for i in range(300)]
    df = spark.createDataFrame([(i, t, lang, "clash", 1) for i, t, lang in rows], "doc_id long, text string, lang string, name string, own int")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classified(df, labels, per_language=20, quantile=0.5, slack=1.0).collect()
    sample = {x.doc_id for x in kneser_ney.trusted_rows(df, labels, 20).collect()}
    trusted = {i for i in range(0, 300, 2) if i % 10}
    assert len(sample) == 60 and sample < trusted
    for lang in ("en", "de", None):
        own = sorted(x.perplexity for x in got if x.lang == lang and x.doc_id in trusted - sample)
        want = own[math.ceil(0.5 * len(own)) - 1]
        for x in got:
            if x.lang == lang:
                assert x.max_perplexity == pytest.approx(want) and x.kept == (x.perplexity <= x.max_perplexity)


def test_all_trusted_rows_are_trained_on(spark):
    """Also the 1,501st and later ones of a language, and those of more than 20,000 characters."""
    rows = [(i, "a b", "s") for i in range(2100)] + [(3000 + i, "long " * 5000, "s") for i in range(10)]
    labels = spark.createDataFrame([(r[0], 1, int(r[0] % 100 == 0)) for r in rows], "doc_id long, quality int, toxic int")
    ids = [r[0] for r in kneser_ney.trusted_rows(docs(spark, rows), labels).select("doc_id").collect()]
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(kneser_ney.HOLD_OUT)) != 0
    want = [r.doc_id for r in labels.where(fold & (F.col("toxic") == 0)).collect()]
    assert sorted(ids) == sorted(want) and sum(i < 3000 for i in ids) > 1500 and max(ids) >= 3000


def test_rare_words_meet_their_weights_in_shards(spark, monkeypatch):
    train = [words(30, i, 50) for i in range(20)]
    p = slow_kneser_ney(train)
    monkeypatch.setattr(kneser_ney, "HOT", 3)
    monkeypatch.setattr(kneser_ney, "SHARD_KEYS", 16)
    monkeypatch.setattr(kneser_ney, "TOKENS", 40)
    tables = kneser_ney.model(spark.createDataFrame([("en", t) for t in train], "lang string, text string").repartition(3))
    assert tables["one"].count() == 3 and tables["bits"] > kneser_ney.SHARD_BITS
    texts = [words(20, 500 + i, 70) for i in range(40)]
    got = kneser_ney.scores(spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string"), tables).collect()
    for r in got:
        w = [1, 1, *texts[r.doc_id].split(), 2]
        assert math.log10(r.perplexity) == pytest.approx(-sum(math.log10(p(*g)) for g in zip(w, w[1:], w[2:])) / (len(w) - 2), rel=1e-5)
    assert len(got) == 40


def test_further_languages_share_a_model(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "LANGUAGES", 1)
    df = spark.createDataFrame([(i, words(30, i, 20), "en" if i < 60 else f"l{i % 7}") for i in range(100)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    assert {r.lang for r in kneser_ney.trusted_rows(df, labels).select("lang").distinct().collect()} == {"en", kneser_ney.OTHER}
    got = kneser_ney.classified(df, labels).collect()
    assert len(got) == 100 and all(r.perplexity < 1000 for r in got)


# Clashing names -----------------------------------------------------------------


HELPERS = ["n_words", "left_share", "base_failed", "kept", "__words", "__w", "__h", "n_removed", "n_lines", "bad", "row", "key", "__key", "__n", "id", "fp", "h", "host", "doc", "site", "n", "k", "x", "t", "component", "node", "root", "item", "shard", "slot", "__id"]


def test_other_columns_pass_whatever_their_names(spark):
    import corpus_pipeline

    rows = [(i, words(60, i, 10**5) + "\nsame line for all of them", "en", f"s{i}", 7) + tuple(f"{c}-{i}" for c in HELPERS) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in HELPERS))
    items = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    for got, n in ((quality_rules.edited_documents(df), 30), (quality_rules.kept_documents(df), 30), (line_dedup.dedup_lines(df), 30), (simhash.deduplicated(df), 30), (near_copies.deduplicated(df), 30), (decontamination.decontaminated(df, items), 29)):
        found = got.collect()
        assert got.columns == df.columns and len(found) == n
        assert all(r[c] == f"{c}-{r.doc_id}" for r in found for c in HELPERS)
    for f in (quality_rules.verdicts, simhash.near_duplicates, sharding.shard_documents, mixing_lm.scored, packing.packed):
        assert f(df).count() >= 30
    assert sharding.assign(df, sharding.topology(40)).count() == 30
    assert decontamination.contained(df, items).count() == 1
    assert len(corpus_pipeline.STAGES) == 5


# 10 --------------------------------------------------------------------------


def test_shards(spark, odd, none):
    rows = sharding.shard_documents(docs(spark, [(i, "x" * (i % 50), "s") for i in range(4000)])).collect()
    n = Counter(r.shard for r in rows)
    assert set(n) == set(range(40)) and max(n.values()) < 160
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    assert {r.grown_shard for r in rows if r.grown_shard != r.shard} == {40}
    assert all(r.size == r.doc_id % 50 + 16 and r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 50)) for r in rows)
    assert len(sharding.shard_documents(odd).collect()) == 9 and sharding.shard_documents(none).count() == 0


def slow_shard(key, leaves):
    """The descent by its definition: a weighted draw among siblings at each level."""
    def signed_hash(name):
        # as the xxhash64 function chains its arguments: the hash of the first seeds the second
        return xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(key.encode(), 42))

    at = [x for x in leaves if x.weight > 0]
    for level in ("region", "rack", "shard"):
        weights = Counter()
        for x in at:
            weights[getattr(x, level)] += x.weight
        draws = {n: (-math.log(((signed_hash(f"{level}-{n}") >> 11) + 0.5) / 2**53) / w, n) for n, w in weights.items()}
        best = min(draws.values())[1]
        at = [x for x in at if getattr(x, level) == best]
    return at[0].shard


def test_shards_by_brute_force(spark):
    ids = spark.range(1500).withColumnRenamed("id", "doc_id").withColumn("region", F.lit("clash"))
    for leaves in (sharding.topology(40), sharding.topology(41), sharding.topology(23, weights={0: 5.0, 7: 0.0, 22: 0.5}), sharding.topology(1)):
        rows = sharding.assign(ids, leaves).collect()
        assert [r.shard for r in rows] == [slow_shard(str(r.doc_id), leaves) for r in rows] and rows[0].region == "clash"


def test_the_levels_decide(spark):
    """The same shards without levels are dealt otherwise, so region and rack draws have an effect."""
    ids = spark.range(2000).withColumnRenamed("id", "doc_id")
    flat = [sharding.Leaf(x.shard, 0, 0) for x in sharding.topology(40)]
    rows = sharding.assign(sharding.assign(ids, sharding.topology(40)), flat, out="flat").collect()
    assert sum(r.shard != r.flat for r in rows) > 1000


def test_movement_is_confined_to_subtrees_whose_weights_change(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    a, b = sharding.topology(20), sharding.topology(20, weights={3: 3.0})  # region 0 and its rack 0 become heavier
    at = {x.shard: x for x in a}
    rows = [(at[r.shard], at[r.heavier]) for r in sharding.assign(sharding.assign(ids, a), b, out="heavier").collect()]
    assert {y.region for x, y in rows if x.region != y.region} == {0}
    assert {y.rack for x, y in rows if x.region == y.region and x.rack != y.rack} == {0}
    assert {y.shard for x, y in rows if x.rack == y.rack and x != y} == {3}
    assert sum(y.shard == 3 for _, y in rows) == pytest.approx(4000 * 3 / 22, rel=0.2)


# 4, further ------------------------------------------------------------------


PARAGRAPHS = [f"Sentence number {i} goes on for a while, with commas, and more words here." for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><form action=x><div>{BODY}</div></form></body>", PARAGRAPHS),
        (f"<body><FORM><article>{BODY}</article></FORM></body>", PARAGRAPHS),
        (f"<body><form><p>Subscribe to our newsletter to get updates in your inbox.</p><input></form><article>{BODY}</article></body>", PARAGRAPHS),
        (f"<article>{BODY}<form><p>Leave a reply, please, with your name and address below.</p>{'<p>x</p>' * 9}</form></article>", PARAGRAPHS),
        (f"<article>{BODY}<div class='modal-verbs'><p>Modal verbs are can, may and must, and this is text.</p></div></article>", [*PARAGRAPHS, "Modal verbs are can, may and must, and this is text."]),
        (f"<article>{BODY}<section id='related-work'><p>Others have done this before us, in many ways.</p></section></article>", [*PARAGRAPHS, "Others have done this before us, in many ways."]),
        (f"<article>{BODY}<div class='related-posts'><a href=x>Other post one</a> <a href=y>Other post two</a></div></article>", PARAGRAPHS),
        (f"<article>{BODY}<div class='comment-list related-work'><p>First! I like this article very much, thanks for it.</p></div></article>", PARAGRAPHS),
        (f"<article>{BODY}<p>Press <button>OK</button>to see that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, always.</p></article>", [*PARAGRAPHS, "Press to see that x=2 holds, always."]),
        ("<form>" * 2000 + "<p>x" * 2000, None),
    ],
)
def test_pages_of_other_shapes(page, want):
    got = html_text.main_text(page)
    assert want is None or got == "\n".join(want)


def test_tally_takes_documents_together(monkeypatch):
    """Short documents share a run of bits, and each still meets the counts of all others only."""
    train = [mixing_lm.tokens(words(30 + i % 7, i, 50)) for i in range(60)] + [[], mixing_lm.tokens(words(900, 99, 400))]
    m, _ = local_model(train)
    asked = []
    real = mixing_lm.Model.word_bits
    monkeypatch.setattr(mixing_lm.Model, "word_bits", lambda self, *x: asked.append(1) or real(self, *x))
    together, apart = mixing_lm.Tally(m.word_mix), mixing_lm.Tally(m.word_mix)
    m.tally(train, together)
    assert len(asked) == 1
    for text in train:
        m.tally([text], apart)
    monkeypatch.setattr(mixing_lm, "BITS_AT_ONCE", 1 << 11)  # the long text takes several runs
    split = mixing_lm.Tally(m.word_mix)
    m.tally(train, split)
    monkeypatch.setattr(mixing_lm, "AT_A_TIME", 100)
    small = mixing_lm.Tally(m.word_mix)
    m.tally(train, small)
    whole = [x.tolist() for x in together.sums()]
    for x in (apart, split, small):
        assert [y.tolist() for y in x.sums()] == whole
    assert all((c == d).all() for c, d in zip(m.word_mix.counts, m.word_mix.left))
