"""Segmentation, toxicity, page extraction and the pipeline."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrat.llm import lines, pages, pieces, toxicity

from .helpers import components, docs_of, odd_docs, shingles

# pieces


@pytest.fixture(scope="module")
def lattices():
    return pieces.Lattices(pieces.Vocabulary())


def all_paths(v, text):
    """Every segmentation of a short text without unknown characters, with its probability."""
    known = {t: i for i, t in enumerate(v.text) if t and v.bytes[t[0]] != i}
    raw, out = (" " + text).encode(), []

    def go(at, ids, logp):
        if at == len(raw):
            out.append((tuple(ids), logp))
        for e in range(at + 1, len(raw) + 1):
            if raw[at:e] in known:
                go(e, [*ids, known[raw[at:e]]], logp + v.logp[known[raw[at:e]]])

    go(0, [], 0.0)
    z = np.logaddexp.reduce([p for _, p in out])
    return {i: float(np.exp(p - z)) for i, p in out}


def test_probabilities_are_those_of_all_paths(lattices):
    want = all_paths(lattices.v, "then no.")
    (found,) = pieces.sample(["then no."], np.array([3], np.uint64), lattices, 10_000)
    assert len(found) == len(want) == len({tuple(f[0]) for f in found})
    for ids, logp, _, _ in found:
        assert logp == pytest.approx(np.log(want[tuple(ids)]), abs=1e-5)
    clocks = [f[2] for f in found]
    assert clocks == sorted(clocks) and all(f[3] == 0.0 for f in found)


def test_sampling_without_replacement(lattices):
    want = all_paths(lattices.v, "then")
    n = 6000
    seeds = np.arange(n, dtype=np.uint64) * np.uint64(2654435761) + np.uint64(99)
    found = pieces.sample(["then"] * n, seeds, lattices, 2)
    one = collections.Counter(tuple(f[0][0]) for f in found)
    two = collections.Counter(tuple(f[1][0]) for f in found)
    for ids, p in want.items():
        second = sum(q * p / (1 - q) for i, q in want.items() if i != ids)
        for got, prob in ((one[ids] / n, p), (two[ids] / n, second)):
            assert abs(got - prob) < 5 * (prob * (1 - prob) / n) ** 0.5 + 1e-3


@pytest.mark.parametrize("text", ["", "a", "  two  spaces ", "line\n\nfeed\n", "▁ literal", "\U0001f600\x00é漢", "x" * 3000, "e.g. a.b,c", "\ttab"])
def test_round_trip(lattices, text):
    (found,) = pieces.sample([text], np.array([1], np.uint64), lattices, 3)
    assert all(lattices.v.decode(f[0].tolist()) == text for f in found)
    assert len({tuple(f[0]) for f in found}) == len(found)


def test_encode_is_stable_and_decodes(spark):
    df = docs_of(spark, [(k, f"some words number {k}, and more.") for k in range(30)]).withColumn("ids", F.lit(1)).withColumn("seed", F.lit(2))
    a = pieces.encode(df).collect()
    b = pieces.encode(df.repartition(5)).collect()
    key = lambda r: (r.key, r.sample)
    assert sorted(map(tuple, a), key=lambda r: r[:2]) == sorted(map(tuple, b), key=lambda r: r[:2])
    assert all(r.exact for r in a) and len({key(r) for r in a}) == 60
    back = {r.key: r.decoded for r in pieces.decode(pieces.encode(df)).collect()}
    assert back[7] == "some words number 7, and more."


def test_encode_odd_rows(spark):
    got = pieces.encode(odd_docs(spark)).collect()
    assert all(r.exact for r in got) and sum(r.sample == 1 for r in got) == 11
    assert pieces.encode(odd_docs(spark).limit(0)).count() == 0


def test_tables_are_cleared():
    l = pieces.Lattices(pieces.Vocabulary(), 50)
    for k in range(10):
        text = " ".join(f"word{k}{j}" for j in range(20))
        (found,) = pieces.sample([text], np.array([k], np.uint64), l, 2)
        assert all(l.v.decode(f[0].tolist()) == text for f in found)
    assert len(l.ids) <= 50


# toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = {"idiot": 3.0, "stupid": 2.0, "clown": 4.0, "crown": 1.0, "disgusting": 5.0, "lowei*": 2.5}
    trie = toxicity.build_trie(terms)
    words = ["idiot", "idot", "idioot", "idiat", "didiot", "clow", "clown", "crowns", "xlown", "stpuid", "stupidest", "disgustin", "disgustingg", "loweiabc", "lowe", "idio", "ab", "clwon", "diiot"]
    for w in words:
        exact = max([terms[t] for t in terms if t == w] + [v for t, v in terms.items() if t[-1] == "*" and w.startswith(t[:-1])] + [0.0])
        fuzzy = max([v for t, v in terms.items() if t[-1] != "*" and distance(w, t) == 1] + [0.0]) if len(w) >= toxicity.FUZZY_FROM else 0.0
        assert toxicity.match(w, trie) == ((exact, fuzzy) if exact or fuzzy else None), w


def test_windows_separate_quotation():
    trie, known = toxicity.build_trie({"idiot": 3.0}), {}
    abuse, quote, said = (toxicity.features(t, trie, known) for t in ("you are an idiot", 'they wrote "what an idiot" there', "he said idiot"))
    assert abuse[0] > 0 and abuse[4] == 0 and abuse[5] > 0
    assert quote[0] == 0 and quote[4] > 0 and said[4] > 0
    assert toxicity.features("", trie, known) == [0.0] * toxicity.FEATURES


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    r = toxicity.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, p = r.toxic.to_numpy(), r.score.to_numpy()
    wins = np.mean([(a > p[y == 0]).mean() + 0.5 * (a == p[y == 0]).mean() for a in p[y == 1]])
    assert wins > 0.93
    assert r.predicted[y == 1].mean() > 0.85 and r.predicted[y == 0].mean() < 0.02


def test_toxicity_odd_rows(spark):
    docs = odd_docs(spark).withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, None), (None, 0, 1), (6, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).count() == 11 and toxicity.score(docs.limit(0), nothing).count() == 0


# pages


def test_lines_of_markup():
    html = """<html><head><title>t</title><script>var x="<p>";</script></head><body class="home"><header><p>Top</p></header>
    <div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One<b>two</b> <i>three</i><br>four<p>five &lt;6&gt;<div class="comments"><p>me too</p></div>
    <form>f</form><aside>side</aside><ul><li>a<li>b</ul><footer>foot</footer></article><!-- <p>no</p> --><footer>end</footer>"""
    got = pages.lines_of(html)
    assert [t for t, z in got if z == pages.KEPT] == ["Head & line", "Onetwo three four", "five <6>", "a", "b"]
    assert pages.lines_of("") == [] and pages.lines_of("plain  text") == [("plain text", pages.BODY)]
    assert pages.lines_of("<p>cut <b") == [("cut", pages.BODY)]
    assert pages.lines_of("<script>x") == []


def brute_lcs(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] else max(d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(0, 12)).tolist(), rng.integers(0, 5, rng.integers(0, 12)).tolist()
        pairs = pages.shared(a, b)
        assert len(pairs) == brute_lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_pages_by_differencing(spark):
    body = lambda x: f"<body><div>Site name</div><p>{x}</p><div>All rights</div></body>"
    rows = [(1, "http://h/a/1", body("first text")), (2, "http://h/a/2", body("second text")), (3, "http://other/a/1", body("third text")), (4, None, None), (5, "http://h/a/3", "<article>Site name</article><div>All rights</div>"), (1, "http://h/a/1", body("first text")), (7, "http://h/b", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("line", F.lit(1)).withColumn("k", F.lit(1))
    got = collections.defaultdict(list)
    for r in pages.extract(df).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert got[1] == ["first text"] * 2 and got[2] == ["second text"]
    assert got[3] == ["Site name third text All rights"] and got[4] == [""] and got[7] == [""]
    assert got[5] == ["Site name"]
    assert pages.extract(df.limit(0)).count() == 0


def test_mirrored_pages_stay(spark):
    page = "<body><div>Site name</div><p>the same text</p></body>"
    rows = [(1, "http://h/a?x=1", page), (2, "http://h/a?x=2", page)]
    assert {r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Site name the same text"}


def test_alignment_of_many_equal_lines():
    a, b = [1, 2] * 3000, [2, 1, 3] * 2000
    pairs = pages.shared(a, b)
    # all ones and twos of b: no longer one exists
    assert len(pairs) == 4000 and all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_neighbours_do_not_depend_on_ranges(spark):
    from quadrat.llm.common import Scratch

    df = spark.createDataFrame([(k, f"http://h{k % 3}/p/{k * 7 % 50}") for k in range(60)], "k long, url string")
    one = pages.neighbours(df, Scratch(spark))
    want = {r.k: r.near for r in one.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert {r.k: r.near for r in pages.neighbours(df, Scratch(spark)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(want) == 60


# pipeline


def pipeline_docs(spark):
    long = lambda tag, n=80: " ".join(f"{tag}{k}" for k in range(n))
    near = long("n", 120).replace("n60 ", "changed ")
    rows = [(1, long("a")), (2, long("b") + "\n" + long("z", 30)), (3, long("c") + "\n" + long("z", 30)), (4, "few words"), (5, long("a")), (6, long("n", 120)), (7, near), (8, None), (9, ""), (10, "x y z " * 40)]
    return docs_of(spark, [(*r, "s" + str(r[0] % 3)) for r in rows])


def test_pipeline_stages(spark, tmp_path):
    docs = pipeline_docs(spark)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [sorted(r.doc_id for r in d.select("doc_id").distinct().collect()) for d in seen]
    assert ids[0] == [1, 2, 3, 5, 6, 7]
    assert ids[1] == [1, 2, 3, 6, 7]
    text = {r.doc_id: r.text for r in seen[1].collect()}
    assert "\n" in text[2] and "\n" not in text[3]
    sets = {k: shingles(t) for k, t in text.items()}
    want = components(list(sets), [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert ids[2] == sorted(k for k in want if want[k] == k)
    assert set(ids[3]) <= set(ids[2]) and seen[3].count() >= len(ids[3])
    assert seen[4].where("not exact").count() == 0 and set(ids[4]) == set(ids[3])


def test_pipeline_run_and_empty(spark, tmp_path):
    pipeline_docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).where("exact").count() > 0
    pipeline_docs(spark).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_take_odd_rows(spark, tmp_path):
    clash = ["kept", "row", "clean", "gone", "t", "id", "th", "h", "first", "component_id", "size", "source_size", "reps", "key", "seed", "n_lines"]
    odd = odd_docs(spark).select("*", *[F.lit(k).alias(c) for k, c in enumerate(clash)])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd, str(tmp_path))
        out.count()
        assert k == 4 or out.columns == odd.columns


def test_line_dedup_stage_counts_characters(spark, tmp_path):
    passage = "this passage of ten words or more stands in both documents"
    out = corpus_pipeline.line_dedup(spark, docs_of(spark, [(1, f"one\n{passage}"), (2, f"two\n{passage}"), (3, None)]), str(tmp_path))
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (f"one\n{passage}", 4 + len(passage)), 2: ("two", 3), 3: (None, 0)}


def test_near_duplicates_go_by_id_and_text(spark, tmp_path):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a), (2, b), (2, a + " end"), (1, a), (3, b + " end"), (4, None), (4, None), (None, b), (None, "x y z"), (None, "x y z")]
    out = corpus_pipeline.near_duplicates(spark, docs_of(spark, rows), str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, a), (2, b), (4, None), (4, None), (None, "x y z"), (None, "x y z")], key=str)


def test_copies_draw_samples_of_their_own(spark):
    rows = docs_of(spark, [(1, "some text with many segmentations"), (1, "some text with many segmentations"), (2, "other")]).coalesce(1)
    of = lambda df: [(r.key, r["sample"], tuple(r.ids)) for r in df.collect()]
    plain, told = of(pieces.encode(rows)), of(pieces.encode(rows, copies=True))
    assert plain[:2] == plain[2:4] == told[:2] and told[2:4] != told[:2] and told[4:] == plain[4:]


assert lines
