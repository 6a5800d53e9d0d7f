"""Line dedup, embeddings and the n-gram join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import embeddings, lines, ngram_join

from .helpers import components, docs_of, odd_docs, shingles

# lines


def test_patience_and_blocks():
    assert lines.patience([(0, 2), (1, 0), (2, 1), (3, 3)]) == [(1, 0), (2, 1), (3, 3)]
    assert lines.patience([]) == []
    assert lines.aligned([1, 2, 3, 2, 9], [8, 7, 1, 2, 3, 2]) == [(0, 2), (1, 3), (2, 4), (3, 5)]
    # heads and tails match though nothing is unique; a moved line does not
    assert lines.aligned([4, 4, 4], [4, 4]) == [(0, 0), (1, 1)] and lines.aligned([1, 2, 3, 5], [6, 3, 1, 2]) == [(0, 2), (1, 3)]
    later, words = [1, 3, 8, 9, 4], [4, 4, 9, 9, 4]
    assert lines.deletions(later, words, [7, 1, 3, 6, 4, 5], 8) == [0, 1] and lines.deletions(later, words, [7, 1, 3, 6, 4, 5], 9) == []


def test_line_dedup(spark):
    shared = ["this shared line holds many words indeed", "and so does the second one here"]
    a = ["first own line of the text", *shared, "", "closing line of the first"]
    b = ["another beginning", *shared, "the end of it"]
    rows = [(5, "\n".join(b)), (1, "\n".join(a)), (6, "\n".join(a)), (7, None), (8, ""), (9, "\n \n"), (10, "short\nline"), (11, "short\nother"), (5, "\n".join(b))]
    df = docs_of(spark, rows).withColumn("t", F.lit(3)).withColumn("gone", F.lit(4)).withColumn("h", F.lit(5)).withColumn("row", F.lit(6))
    got = {r.row.doc_id: (r.clean, r.n_lines, r.n_deleted) for r in lines.dedup(df).collect()}
    assert got[1] == ("\n".join(a), 4, 0)
    assert got[5] == ("another beginning\nthe end of it", 4, 2)
    assert got[6] == ("", 4, 4)
    assert got[7] == (None, 0, 0) and got[8] == ("", 0, 0) and got[9] == ("\n \n", 0, 0)
    assert got[10][2] == got[11][2] == 0
    assert lines.dedup(df).count() == 9


def test_line_dedup_on_odd_rows(spark):
    assert lines.dedup(odd_docs(spark)).count() == 11
    assert lines.dedup(odd_docs(spark).limit(0)).count() == 0
    null_last = docs_of(spark, [(None, "a b c d e f g h i j k"), (3, "a b c d e f g h i j k")])
    assert {r.row.doc_id: r.n_deleted for r in lines.dedup(null_last).collect()} == {None: 1, 3: 0}


def brute_blocks(late, early, min_words):
    """Lines of a text that lie in any block of enough words which another text holds: every diagonal."""
    gone = set()
    for shift in range(-len(early), len(late)):
        block = []
        for x in range(len(late) + 1):
            if x < len(late) and 0 <= x - shift < len(early) and late[x] == early[x - shift]:
                block.append(x)
                continue
            if sum(len(late[p].split()) for p in block) >= min_words:
                gone.update(block)
            block = []
    return gone


def brute_pairs(split, rare):
    """(later, earlier) by the rule: sharers of a rare line, and copies without one with the first holder of their rarest shared line."""
    holders = {}
    for d, x in enumerate(split):
        for line in set(x):
            holders.setdefault(line, []).append(d)
    pairs = {(late, early) for h in holders.values() if 1 < len(h) <= rare for late in h for early in h if early < late}
    for d, x in enumerate(split):
        met = {line for line in x if len(holders[line]) > 1}
        if met and 2 * len(met) >= len(set(x)):
            least = min(len(holders[line]) for line in met)
            if least > rare:  # of equally rare ones the hash decides
                pairs.add((d, tuple({min(holders[line]) for line in met if len(holders[line]) == least})))
    return pairs


def held(spark, texts, rare=lines.RARE, min_words=lines.MIN_WORDS):
    """The query's result for texts in the order of their ids, after comparing it with brute force over all pairs."""
    split = [[x for x in t.split("\n") if x.strip()] for t in texts]
    got = {r.row.doc_id: (r.clean, r.n_deleted) for r in lines.dedup(docs_of(spark, list(enumerate(texts))), rare=rare, min_words=min_words).collect()}
    out = []
    for d, late in enumerate(split):
        ways, bound = [set()], set()
        for a, b in brute_pairs(split, rare):
            if a != d:
                continue
            options = []
            for early in b if isinstance(b, tuple) else (b,):
                gone = set() if early >= d else set(lines.deletions(late, [len(x.split()) for x in late], split[early], min_words))
                bound |= brute_blocks(late, split[early], min_words) if early < d else set()
                options.append(gone)
            ways = [w | o for w in ways for o in options]
        assert any(got[d] == ("\n".join(x for p, x in enumerate(late) if p not in w), len(w)) for w in ways), d
        gone = next(w for w in ways if got[d] == ("\n".join(x for p, x in enumerate(late) if p not in w), len(w)))
        # an alignment never deletes what no earlier document holds in a block
        assert gone <= bound
        out.append(gone)
    return split, out


def test_lines_of_one_passage_with_different_owners(spark):
    one, two, three = "a line of six words here", "one of just five words", "and another one of six words"
    split, want = held(spark, [f"licence text\n{two}\nits end", f"start\n{one}\n{two}\n{three}\nlast", f"other\n{one}\n{two}\n{three}\nmore"])
    assert want == [set(), set(), {1, 2, 3}]


@pytest.mark.parametrize("seed,rare", [(5, 10), (6, 2), (7, 3)])
def test_lines_against_brute_force(spark, seed, rare):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(14)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 12)) + [f"own line {k}"] * rng.randint(0, 3)) for k in range(50)]
    texts += [texts[3]] * 5 + [texts[4] + "\nlast line"] * 3
    _, gone = held(spark, texts, rare, 8)
    assert sum(map(len, gone)) > 20 and all(len(g) == len(texts[3].split("\n")) for g in gone[51:55])


def test_lines_that_repeat_within_a_document(spark):
    line, short = "one line that repeats and holds as many as ten words", "two words"
    # the owner holds it twice; the later one does; nothing else is in either; only short lines, all repeated
    texts = [f"{line}\na\n{line}", f"b\n{line}", f"{line}\nc\n{line}\nd", f"{line}\na\n{line}", "\n".join([short] * 6), "\n".join([short] * 6), "\n".join([short] * 4)]
    _, gone = held(spark, texts)
    assert gone[0] == set() and gone[1] == {1} and gone[3] == {0, 1, 2} and gone[5] == set(range(6)) and gone[6] == set()


def test_licence_lines_stay_and_large_groups_of_copies_go(spark):
    licence = "this licence line of twelve words stands at the end of all"
    own = lambda k: "\n".join(f"text {k} has its own line number {j} of it" for j in range(4))
    texts = [own(k) + "\n" + licence for k in range(30)] + [own(99) + "\n" + licence] * 25 + [own(99) + "\nan edit " + str(k) for k in range(25)]
    _, gone = held(spark, texts)
    assert not any(gone[:31]) and all(len(g) == 5 for g in gone[31:55]) and all(g == {0, 1, 2, 3} for g in gone[55:])


# embeddings


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_links(rows, threshold):
    links = []
    for i, (a, x, la) in enumerate(rows):
        for b, y, lb in rows[:i]:
            if la is None or la != lb or len(x) != len(y):
                continue
            x64, y64 = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
            if x64 @ y64 / (np.linalg.norm(x64) * np.linalg.norm(y64)) >= threshold:
                links.append((a, b))
    return links


@pytest.mark.parametrize("d,threshold", [(64, 0.98), (12, 0.9), (5, 0.98)])
def test_embedding_links(spark, d, threshold):
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(0, 12, 160)] + rng.normal(size=(160, d)) * rng.choice([0.02, 0.1, 0.15, 0.5], (160, 1))
    x[:20] = x[0]
    rows = [(k, (x[k] * rng.choice([1.0, 3.0])).tolist(), int(k % 2) if k % 40 else None) for k in range(160)]
    links = brute_links(rows, threshold)
    want = components([r[0] for r in rows], links)
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = {r.vec_id: r for r in embeddings.near_duplicates(vectors(spark, rows), threshold=threshold).collect()}
    assert {k: r.n_links for k, r in got.items()} == count
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.kept == (k == want[k]) for k, r in got.items())


def test_a_dense_cell_gives_its_pairs_in_parts(monkeypatch):
    monkeypatch.setattr(embeddings, "PAIRS", 1000)
    monkeypatch.setattr(embeddings, "SIDE", 37)
    rng = np.random.default_rng(3)
    x = rng.normal(size=8) + rng.normal(size=(300, 8)) * 0.001
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    e = np.concatenate(list(embeddings.entries(np.arange(300), np.zeros(300, np.int64), x, 0.98)))
    parts = list(embeddings.near_in_block(e, embeddings.blocks(8, 0.98)[0][1]))
    pairs = np.concatenate(parts)
    assert len(parts) > 5 and len(pairs) == len(np.unique(pairs, axis=0)) == 300 * 299 // 2


def test_embedding_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0] * 4, 1), (3, [nan, 1.0, 0.0, 0.0], 1), (4, [inf, 1.0, 0.0, 0.0], 1), (5, [None, 1.0, 0.0, 0.0], 1), (6, [], 1), (7, [1.0, 0.0, 0.0, 0.0], None), (8, [1.0, 0.0, 0.0, 0.0], 1), (9, [1.0, 0.0, 0.0, 0.0], 1), (9, [1.0, 0.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 1), (None, [1.0, 0.0, 0.0, 0.0], 1)]
    df = vectors(spark, rows).withColumn("cls", F.lit(1)).withColumn("c", F.lit("z"))
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()]
    assert len(got) == 12
    by = {g[0]: g[1:] for g in got}
    assert all(by[k] == (0, k, True) for k in (1, 2, 3, 4, 5, 6, 7, 10))
    assert by[8] == (3, 8, True) and by[9] == (3, 8, False) and by[None] == (3, 8, False)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


# n-gram join


def edited(words, rate, rng):
    return [w if rng.random() > rate else f"e{rng.randrange(10**6)}" for w in words]


def join_rows(seed, copies=20):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 120, 300]))]
        if k % 3 == 0:
            base += passage
        for _ in range(rng.choice([1, 2, copies])):
            rows.append(" ".join(edited(base, rng.choice([0, 0.01, 0.03, 0.06]), rng)))
    rows += [None, "", "one two", "ONE two", "one two three", "a b c d e", "A b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def check_join(spark, rows):
    sets = {k: shingles(t) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(list(sets), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs_of(spark, rows)).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in sets}
    return len(links)


def test_join_against_brute_force(spark):
    assert check_join(spark, join_rows(1)) > 100


def test_join_with_hot_nodes(spark, monkeypatch):
    """Small bounds split nearly every node into blocks and every group into tiles."""
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "TILE", 8)
    monkeypatch.setattr(ngram_join, "DENSE", 3)
    assert check_join(spark, join_rows(2, 40)) > 100


def test_join_without_stars(spark, monkeypatch):
    """Pairs that no star links are found by the bounds alone."""
    monkeypatch.setattr(ngram_join, "_tried", lambda batches: (b.select(["fp", "z"]).slice(0, 0) for b in batches))
    assert check_join(spark, join_rows(3, 30)) > 100


def test_bounds_never_lose_a_link():
    """Every pair of random sets that is linked passes the bounds, whatever n-grams are heavy."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        heavy = rng.choice(np.array([0, 0, 0, 9, 12], np.uint8), 1 << ngram_join.SKETCH_BITS)
        base = rng.integers(0, 1 << 64, 400, np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base[: rng.integers(20, 400)], rng.integers(1, 300)), rng.integers(0, 1 << 64, rng.integers(0, 30), np.uint64)])) for _ in range(40)]
        sets += [np.unique(np.concatenate([s[rng.random(len(s)) < 0.9], rng.integers(0, 1 << 64, 2, np.uint64)])) for s in sets]
        told = [ngram_join.described(s, heavy) for s in sets]
        n, reach = np.array([len(s) for s in sets]), np.array([t[1] for t in told])
        below = np.concatenate([np.zeros((len(sets), 1), np.int64), np.stack([t[2] for t in told])], axis=1)
        count = {}
        for t in told:
            for x in t[0].tolist():
                count[x] = count.get(x, 0) + 1
        s = np.array([sum(count[x] > 1 for x in t[0][: t[2][t[1] - 1] if t[1] else 0].tolist()) for t in told])
        a, b = np.triu_indices(len(sets), 1)
        may = ngram_join._may_link(a, b, n, s, reach, below)
        linked = np.array([100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
        meets = np.array([bool(np.intersect1d(told[i][0], told[j][0]).size) for i, j in zip(a, b, strict=True)])
        assert linked.any() and (may & meets)[linked].all()


def test_join_of_one_large_group(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(edited(base, 0.025, rng))) for k in range(150)]
    check_join(spark, rows + [(k + 1000, " ".join(base)) for k in range(100)])


def test_join_odd_rows(spark):
    df = odd_docs(spark).withColumn("n", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("th", F.lit(3))
    got = ngram_join.join(df).collect()
    assert len(got) == 11
    same = [r for r in got if r.doc_id in (8, 9)]
    assert all(r.component_id == 8 and r.n_shingles == 1 for r in same)
    assert {r.n_shingles for r in got if r.doc_id in (1, 2, 4)} == {0}
    assert ngram_join.join(df.limit(0)).count() == 0
    lone = docs_of(spark, [(None, "a b c d e f"), (None, "a b c d e f")])
    assert all(r.component_id is None for r in ngram_join.join(lone).collect())


def test_very_many_sets_are_named_by_their_tiles():
    kind = np.dtype([("key", "<i8"), ("tile", "<i8"), ("whole", "?"), ("fp", "<i8"), ("comp", "<i8")])
    many = [(1, 7 + k % 2, False, k, k) for k in range(ngram_join.DENSE + 1)]
    rows = np.array([*many, *many, (2, 7, False, 5, 5), (2, 9, False, 6, 6), (2, 7, False, 5, 5)], kind)
    assert ngram_join._whole_tiles(rows).tolist() == [(1, 7, True, 0, 0), (1, 8, True, 0, 0), (2, 7, False, 5, 5), (2, 9, False, 6, 6)]
