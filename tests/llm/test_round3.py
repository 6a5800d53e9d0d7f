"""Filter audit, suffix sorting and hard negatives against brute force, and their odd inputs."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quadrat.llm import audit, negatives, suffixes

from .helpers import DOCS, docs_of, odd_docs

LABELS = "doc_id long, quality int, toxic int"


# --- filter audit


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, part in docs:
        text = text or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0d]+", text) if x]
        bits = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in text for c in "#$%&*|"),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        rows.append((part or "", bits, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            for s, c in enumerate(p):
                fails = [r for r in mine if r[1][c]]
                here = [r for r in fails if not any(r[1][b] for b in p[:s])]
                kept = [r for r in mine if not any(r[1][b] for b in p[: s + 1])]
                alone = [r for r in fails if sum(r[1].values()) == 1]
                shapley[c] += len(here)
                out[part, "".join(p), s + 1] = [len(kept), len(here), len(fails) - len(here), len(alone), sum(r[2] for r in here), sum(r[3] for r in here)]
        for p in permutations("ABCDE"):
            for s, c in enumerate(p):
                out[part, "".join(p), s + 1].append(shapley[c])
    return out


def audited(docs, labels):
    rows = audit.interactions(audit.counters(audit.masks(docs), labels)).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def test_audit_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["", "a b c", "A B C", "x # y", " ".join(f"w{k}" for k in range(220)), " ".join(f"w{k}" for k in range(220)) + " $", "w " * 230, "Zu " * 250, None]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s", "t", None, ""])) for _ in range(120)]
    labels = [(rng.randrange(40), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(30)] + [(None, 1, 1), (7, 1, 0), (7, 0, 1)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).repartition(5)
    assert audited(docs, spark.createDataFrame(labels, LABELS)) == brute_audit(rows, labels)


def test_audit_of_one_text_over_many_ranges(spark):
    """A text that most rows hold begins in one range and goes on in others; so do rows that agree in all columns."""
    rows = [(k // 2, "same text", "s") for k in range(600)] + [(5, "one row", "t")] * 300 + [(4, "one row", "t")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).repartition(7)
    found = audit.masks(docs)
    total = {(r.part, r.mask & audit.E): r.n for r in found.groupBy("part", (F.col("mask").bitwiseAND(audit.E)).alias("mask")).agg(F.sum("n").alias("n")).collect()}
    assert total == {("s", 0): 2, ("s", audit.E): 598, ("t", 0): 1, ("t", audit.E): 300}


def test_audit_of_odd_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert audited(spark.createDataFrame([], DOCS), labels) == {}
    odd = odd_docs(spark)
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert audited(odd.withColumn("mask", F.lit(1)).withColumn("quality", F.lit(9)).withColumn("row", F.lit(0)), labels) == brute_audit(rows, [])


# --- suffix sorting


def brute_cut(texts, length):
    seen = {}
    for t in texts:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] = seen.get(t[s : s + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone.tolist()) if not g)).hexdigest()))
    return out


def passages(rng):
    """Texts with passages of all lengths around the limit, copies, near copies, periods and bytes of two and more."""
    words = ["".join(rng.choice("abcdeé漢z ") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    shared = [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 8, 9, 10, 11, 12, 16, 40)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))))
        texts.append("".join(parts))
    texts += [texts[3], texts[3], texts[4][:-1], "x" + texts[5], "ab" * 60, "a" * 90, "a" * 39, "\0" * 50 + "q", "abcabc" * 20 + "tail"]
    return texts


@pytest.mark.parametrize("seed,hot", [(1, 50_000), (2, 50_000), (3, 1)])
def test_removed_bytes_against_brute_force(spark, seed, hot):
    texts = passages(random.Random(seed))
    docs = docs_of(spark, list(enumerate(texts))).repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(docs, length=40, gram=8, hot=hot).collect()}
    assert [got[k] for k in range(len(texts))] == brute_cut([t.encode() for t in texts], 40)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 64)
    texts = [t.encode() for t in passages(random.Random(5))]
    found = []
    for held in suffixes._pieces(texts, 40):
        for k, at, part in held:
            found += [(k, at + s) for s in range(len(part) - 39)]
    assert sorted(found) == [(k, s) for k, t in enumerate(texts) for s in range(len(t) - 39)]


def test_suffixes_of_odd_tables(spark):
    assert suffixes.digests(spark.createDataFrame([], DOCS)).collect() == []
    odd = odd_docs(spark).withColumn("list", F.lit("x")).withColumn("th", F.lit(3)).withColumn("kept", F.lit(3))
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in suffixes.digests(odd).collect()}
    assert got[1, 0] == got[2, 0] == got[None, 0] == (0, 0)
    assert got[6, 300_000] == (300_000, 1) and got[7, 50_000] == (50_000, 1)
    kept = {r.doc_id: bytes(r.kept) for r in suffixes.dedup(odd.where("doc_id in (6, 8)")).collect()}
    assert kept == {6: b"", 8: b"same text here"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab\0", max_size=12).map(str.encode), min_size=1, max_size=30), st.integers(0, 40))
def test_order_of_suffixes(strings, shift):
    strings = [b"p" * shift + s for s in strings]
    order, common = suffixes.deep_shallow(strings)
    pads = [strings[k] for k in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(strings)))
    width = max(map(len, pads))
    assert [p.ljust(width, b"\0") for p in pads] == sorted(p.ljust(width, b"\0") for p in pads)
    assert all(c == len(__import__("os").path.commonprefix([x, y])) for x, y, c in zip(pads, pads[1:], common[1:].tolist()))
    # strings that agree on d bytes stand together, which is what the sums over common prefixes rely on
    for d in range(width + 1):
        marks = np.cumsum(common < d)
        groups = {}
        for p, m in zip(pads, marks.tolist()):
            if len(p) >= d:
                groups.setdefault(p[:d], set()).add(m)
        assert all(len(x) == 1 for x in groups.values()) and len(set().union(*groups.values())) == len(groups) if groups else True


# --- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows):
    sound = []
    for i, v, lab in rows:
        if lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        lab = (lab + 1) % 10 if i is not None and i % 7 == 0 else lab
        sound.append((i, [math.floor(256 * float(np.float32(x))) for x in v], lab))
    out = []
    late = lambda i: (i is None, i or 0)
    for k, (i, v, lab) in enumerate(sound):
        if i is None or i % 100:
            continue
        others = [(sum(x * y for x, y in zip(v, u)), j, m == lab) for n, (j, u, m) in enumerate(sound) if n != k and len(u) == len(v)]
        others.sort(key=lambda o: (-o[0], late(o[1])))
        for score, p, _ in [o for o in others if o[2]][:5]:
            held = [o for o in others if not o[2] and 30 * score <= 100 * o[0] <= 90 * score][:10]
            out += [(i, p, r + 1, n, score, s) for r, (s, n, _) in enumerate(held)]
    return out


def mined(df, **options):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return [tuple(r) for r in negatives.mine(df, moved, **options).collect()]


def plain(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(700):
        v = (rng.standard_normal(6) + 0.6) * float(rng.choice([0.01, 0.2, 1, 30]))
        if seed == 2:
            v = np.round(v)  # many ties
        rows.append((int(k * rng.choice([1, 1, 50])), [float(x) for x in v], int(rng.integers(0, 4))))
    rows += [(None, [1.0] * 6, 1), (100, None, 1), (200, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (300, [float("nan")] * 6, 2), (400, [1.0] * 6, None), (500, [1.0] * 5, 2), (600, [], 3), (700, [1.0] * 6, 2), (700, [1.0] * 6, 2), (800, [0.0] * 6, 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("norm", F.lit("x")).withColumn("uid", F.lit(1)).repartition(3)
    want = brute_negatives(rows)
    assert want and plain(mined(df)) == plain(want)
    assert plain(mined(df, bucket=16, block=3)) == plain(want)


def test_negatives_of_large_numbers(spark):
    """Scores beyond 2^53 stay exact; vectors whose scores need not fit into a long take no part."""
    rows = [(100, [3000001.0, 1.0], 1), (3, [3000001.0, 1.0], 1), (4, [2000003.0, 7.0], 2), (5, [2000003.0, 6.0], 2), (6, [1e30, 0.0], 2)]
    got = mined(spark.createDataFrame(rows, VECTORS))
    assert plain(got) == plain(r for r in brute_negatives(rows[:4]))
    assert got and max(r[5] for r in got) > 2**53


def test_negatives_of_an_empty_table(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == []


def test_buckets_are_pruned(spark, monkeypatch):
    """Short vectors are not scored once longer ones fill every window."""
    seen = []
    monkeypatch.setattr(negatives, "scores", lambda a, b, exact: seen.append(len(b)) or (a @ b.T).astype(np.int64))
    best = negatives._Block([(0, 1, 10.0, np.array([10.0, 0.0]), None, None)], 2, False)
    long, short = np.array([[10, 0]] * 4, np.int32).ravel(), np.array([[1, 0]] * 4, np.int32).ravel()
    ids = np.arange(1, 5)
    best.meet(2, 10.0, ids, ids, np.full(4, 2), long)
    best.meet(2, 1.0, ids, ids + 9, np.full(4, 2), short)
    assert seen == [4] and best.best[0].found == [[(-100, 1), (-100, 2)]]


# --- mended this round


def test_join_of_very_long_texts(spark):
    """Sets beyond 65,535 n-grams on both sides of the threshold, held against exact sizes."""
    from quadrat.llm import ngram_join

    sizes = [(80_000, 62_000), (80_000, 59_000), (120_000, 95_000), (120_000, 88_000), (100_000, 76_000), (70_000, 52_000), (70_000, 53_000), (65_540, 49_160), (65_535, 49_140)]
    rows = []
    for k, (n, m) in enumerate(sizes):
        w = [f"{k}x{i}" for i in range(n + 4)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(w[: m + 4]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs_of(spark, rows).repartition(4)).collect()}
    for k, (n, m) in enumerate(sizes):
        assert got[10 * k] == (n, 10 * k)
        assert got[10 * k + 1] == (m, 10 * k if 100 * m >= 75 * n else 10 * k + 1)


def test_bounds_of_very_large_sets():
    from quadrat.llm import ngram_join

    rng, heavy = np.random.default_rng(1), np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8)
    for n in (60_000, 80_000, 120_000, 400_000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.sort(x[: int(0.76 * len(x))])
        told = [ngram_join.described(s, heavy) for s in (x, y)]
        ranges = [np.minimum(np.diff(t[2], prepend=0), ngram_join.MANY).astype(np.uint16).tobytes() for t in told]
        import pyarrow as pa

        below = ngram_join._below(pa.array(ranges))
        size, reach = np.array([len(x), len(y)]), np.array([t[1] for t in told])
        shared = np.array([len(np.intersect1d(told[0][0], told[1][0]))] * 2)
        assert ngram_join._may_link(np.array([0]), np.array([1]), size, shared, reach, below).all()


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 7, lambda k: k % 3, lambda k: k])
def test_targets_are_met_whatever_repeats(spark, ids):
    from quadrat.llm import mixing

    rows = [(ids(k), "a b c d e f g h i j", s) for k in range(1000) for s in ("x", "y", None)]
    docs = docs_of(spark, rows).repartition(7)
    for _ in range(2):
        r = mixing.repetitions(docs)
        got = r.groupBy("row.source").agg(F.sum(F.col("size") * F.col("reps")).alias("taken"), F.min("reps").alias("low"), F.max("reps").alias("high"), F.first("target").alias("target")).collect()
        assert len(got) == 3
        for g in got:
            assert abs(g.taken - g.target) <= 5 + 1e-6 and g.high - g.low <= 1 and g.high <= 2


def test_learning_is_bounded_by_rows(spark):
    from quadrat.llm import toxicity

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(5000)] + [(k, "other") for k in range(2, 60)], "doc_id long, text string").withColumn("th", F.lit("x"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 20)
    assert rows.count() <= 20 and rows.columns == ["text", "toxic", "part"]


# --- pages


def kept_text(html):
    from quadrat.llm import pages

    return [t for t, z in pages.lines_of(html) if z in (pages.KEPT, pages.LOOSE)]


@pytest.mark.parametrize("unit", ["<a ", '<b x="', "<b x='\"", "<!-- ", "<script>", "</p>", "<div>", "<b>", "<b><p></p>", '<a ">', "<", "<p class='", '<i a="1" b="2" ', "</script", "&lt;", "<li>", "<a x=>", '<article class="comment">'])
def test_markup_is_read_in_linear_time(unit):
    import time

    from quadrat.llm import pages

    began = time.process_time()
    for tail in ("", ">", '">', "'>"):
        pages.lines_of("<p>begin</p>" + unit * (2_000_000 // len(unit)) + tail)
    assert time.process_time() - began < 30


def test_comments_notices_and_names():
    page = '<body><article><h1>Head</h1><p>Main words.</p><article class="comment"><p>A reader wrote.</p></article><section id="related-work"><p>Related work stays.</p></section>'
    page += '<div class="related-posts"><p>gone</p></div><p class="search results">kept too</p><div id="ad-slot-3">gone</div><p class="site-notice">gone</p><div class="share_buttons top">gone</div></article></body>'
    assert kept_text(page) == ["Head", "Main words.", "Related work stays.", "kept too"]


def test_quotes_that_never_close():
    assert kept_text('<article><p title="a > b">one</p><p title="open>two</p><p>three</p></article>') == ["one", "two", "three"]
    assert kept_text("<article><p>it's <b title='x>y'>fine</b></p></article>") == ["it's fine"]


def brute_extract(rows):
    """Main texts of distinct pages: the nearest of the neighbours in URL order, a table for the longest common subsequence."""
    import re

    from quadrat.llm import pages

    def place(url):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", url)
        return (m[1].lower(), url[m.end() :]) if m else ("", url)

    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [last := i] + [last := min(row[j] + 1, last + 1, row[j - 1] + (x != y)) for j, y in enumerate(b, 1)]
        return row[-1]

    order = sorted(rows, key=lambda r: place(r[1]))
    out = {}
    for n, (i, url, html) in enumerate(order):
        near = [(levenshtein(place(order[m][1])[1], place(url)[1]), side, m) for side, m in enumerate((n - 1, n + 1)) if 0 <= m < len(order) and place(order[m][1])[0] == place(url)[0]]
        found = pages.lines_of(html)
        has = any(z in (pages.KEPT, pages.LOOSE) for _, z in found)
        own = [k for k, (_, z) in enumerate(found) if z in ((pages.KEPT, pages.LOOSE) if has else (pages.BODY,))]
        met = set()
        if near:
            other = [t for t, _ in pages.lines_of(order[min(near)[2]][2])]
            mine = [t for t, _ in found]
            d = np.zeros((len(mine) + 1, len(other) + 1), int)
            for x in range(len(mine)):
                for y in range(len(other)):
                    d[x + 1, y + 1] = d[x, y] + 1 if mine[x] == other[y] else max(d[x, y + 1], d[x + 1, y])
            x, y = len(mine), len(other)
            while x and y:
                if d[x, y] == d[x - 1, y]:
                    x -= 1
                elif d[x, y] == d[x, y - 1]:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    met.add(x)
        gone = {k for k in own if k in met and found[k][1] == (pages.LOOSE if has else pages.BODY)}
        if all(k in met for k in own):
            gone = set()
        out[i] = " ".join(found[k][0] for k in own if k not in gone), len(gone)
    return out


def test_pages_against_brute_force(spark):
    from quadrat.llm import pages

    rng = random.Random(4)
    rows = []
    for k in range(60):
        # distinct lines in one order, so that the longest common subsequence is one set of them
        own = [f"<p>own {k} {j}</p>" for j in range(rng.randint(0, 3))]
        top, bottom = ([f"<div>notice {j}</div>" for j in pair if rng.random() < 0.8] for pair in ((0, 1), (2, 3)))
        passage = [f"<p>passage {j}</p>" for j in range(3) if rng.random() < 0.5]
        inside = top + passage + own + bottom
        html = f"<body><nav>menu</nav><main>{''.join(inside)}</main><footer>foot</footer></body>" if k % 2 else f"<body><nav>menu</nav>{''.join(inside)}</body>"
        rows.append((k, f"http://h{k % 3}.example/p/{rng.randint(0, 999)}/{k}", html))
    want = brute_extract(rows)
    got = {r.page_id: (r.text, r.n_deleted) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == want and sum(n for _, n in got.values()) > 40


def test_a_very_long_page(spark):
    from quadrat.llm import pages

    long = "<body><article>" + "".join(f"<p>line {k} of it</p>" for k in range(60_000)) + "</article>" + "<a " * 1_000_000
    r = pages.extract(spark.createDataFrame([(1, "http://h/1", long), (2, "http://h/2", long)], "page_id long, url string, html string")).collect()
    assert [x.n_chars for x in r] == [sum(len(f"line {k} of it") + 1 for k in range(60_000)) - 1] * 2
