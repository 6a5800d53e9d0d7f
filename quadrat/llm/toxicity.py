"""Toxicity by a learned lexicon, matched through Levenshtein automata, and scores of context windows.

A lexicon of words and word beginnings is learned from labelled texts by log odds and stored in a trie.
Each word of a text gives rise to a Levenshtein automaton (bit-parallel, distance 1) that runs over the
trie: branches in which no state is left, or whose words are too long or too short, are cut. So
misspelled terms are found without listing variants. Every hit is scored in a window around it: hits inside
quotation marks or beside words of reporting count as quoted, hits beside words of address as directed.
A logistic regression over the document's sums of exact, misspelled, quoted and directed hits gives
the score.

Learning uses at most ``TRAIN_ROWS`` labelled documents, those with the smallest digests of their id: about
three quarters of them for the lexicon and the others, which the lexicon has not seen, for the
regression. Labels, language, source and id are no inputs of the score. Every text is scored whole.

Defined results: a null text is empty; an empty text, and every text if nothing could be learned, gets the
score of a text without hits; a document labelled more than once is toxic if any label says so; repeated rows
are scored one by one and learned from once; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import read

#: Bounds of what is learned: labelled rows, terms, and the support and log odds that a term needs.
TRAIN_ROWS = 20_000
MAX_TERMS = 2_000
MIN_DOCS = 5
MIN_LOG_ODDS = 3.0
#: Lengths of the beginnings that may become terms.
STEMS = (4, 5)
#: Shortest word that may be misspelled.
FUZZY_FROM = 5
WINDOW = 60
CACHE = 600_000

WORD = re.compile(r"[^\W_]+")
QUOTES = "\"“”„«»‘’"
# Words that report speech, and words of address.
REPORTING = frozenset("said says quote quoted wrote called sagte zitat dijo cita dit citation".split())
ADDRESS = frozenset("you your youre du dich dein ihr tu te tes vous votre eres usted".split())


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    word: float = 0.0
    stem: float = 0.0
    #: Least and greatest number of characters to a word below.
    low: int = 99
    high: int = -1
    #: At the root: beginnings and ends of all words.
    heads: frozenset[str] = frozenset()
    tails: frozenset[str] = frozenset()


def build_trie(terms: dict[str, float]) -> Node:
    """terms: word, or beginning with a final ``*`` -> weight."""
    root = Node()
    for term, weight in terms.items():
        is_stem = term.endswith("*")
        body = term.rstrip("*")
        node, path = root, [root]
        for c in body:
            node = node.next.setdefault(c, Node())
            path.append(node)
        if is_stem:
            node.stem = max(node.stem, weight)
            continue
        node.word = max(node.word, weight)
        for k, n in enumerate(path):
            n.low, n.high = min(n.low, len(body) - k), max(n.high, len(body) - k)
    words = [t for t in terms if not t.endswith("*")]
    root.heads = frozenset(w[:k] for w in words for k in range(len(w) + 1))
    root.tails = frozenset(w[k:] for w in words for k in range(len(w) + 1))
    return root


def match(word: str, root: Node) -> tuple[float, float] | None:
    """(weight of an exact hit or beginning, weight of the best term at distance 1), or None."""
    node, exact = root, 0.0
    for c in word:
        node = node.next.get(c)
        if node is None:
            break
        exact = max(exact, node.stem)
    else:
        exact = max(exact, node.word)
    n, fuzzy = len(word), 0.0
    # one error leaves the first or the second half of the word as it is
    if n >= FUZZY_FROM and (word[: n // 2] in root.heads or word[n // 2 :] in root.tails):
        mask: dict[str, int] = {}
        for i, c in enumerate(word):
            mask[c] = mask.get(c, 0) | 1 << i
        goal = 1 << n
        stack = [(root, 1, 3, 0)]  # states without and with one error; bit i: i characters of the word are used
        while stack:
            node, r0, r1, depth = stack.pop()
            for c, child in node.next.items():
                # words below are depth + 1 + low .. depth + 1 + high characters long
                if child.high < n - depth - 2 or child.low > n - depth:
                    continue
                m = mask.get(c, 0)
                s0 = (r0 & m) << 1
                s1 = ((r1 & m) << 1 | r0 | r0 << 1 | s0 << 1) & (2 * goal - 1)
                if not s1:
                    continue
                if child.word > fuzzy and s1 & goal and not s0 & goal:
                    fuzzy = child.word
                stack.append((child, s0, s1, depth + 1))
    return (exact, fuzzy) if exact or fuzzy else None


FEATURES = 7


def features(text: str, lexicon: Node, known: dict[str, tuple[float, float] | None]) -> list[float]:
    """Best exact, best misspelled, and sums of exact, misspelled, quoted and directed hits; hits for each hundred words."""
    low = text.lower()
    words = set(WORD.findall(low))
    hits: dict[str, tuple[float, float]] = {}
    for w in words:
        try:
            found = known[w]
        except KeyError:
            if len(known) >= CACHE:
                known.clear()
            found = known[w] = match(w, lexicon)
        if found is not None:
            hits[w] = found
    if not hits:
        return [0.0] * FEATURES
    exact = fuzzy = quoted = directed = best = best_fuzzy = 0.0
    count = total = 0
    spans = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
    total = len(spans)
    for k, (w, start, end) in enumerate(spans):
        if w not in hits:
            continue
        x, f = hits[w]
        count += 1
        before, after = low[max(0, start - WINDOW) : start], low[end : end + WINDOW]
        line_before, line_after = before.rpartition("\n")[2], after.partition("\n")[0]
        inside = sum(map(line_before.count, QUOTES)) % 2 == 1 and any(q in line_after for q in QUOTES)
        near = {s[0] for s in spans[max(0, k - 6) : k + 7]}
        if inside or near & REPORTING:
            quoted += x or f
        else:
            best, best_fuzzy = max(best, x), max(best_fuzzy, 0.0 if x else f)
            exact, fuzzy = exact + x, fuzzy + (0.0 if x else f)
            directed += (x or f) if near & ADDRESS else 0.0
    return [best, best_fuzzy, math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(directed), 100 * count / max(total, 1)]


@dataclass
class Model:
    terms: dict[str, float]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float


def _fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(text, toxic, part) of a bounded set of labelled rows outside of the held-out fold; part 1 fits the regression."""
    y = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (_fold(F.col(key)) != 0))
    y = y.groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    y = y.orderBy(F.xxhash64(F.lit("toxicity"), "k"), "k").limit(rows)
    # at most ``rows`` rows of 12 bytes
    x = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(y), "k")
    # an id may stand in many rows: the bound holds for rows, taken by digest of id and text; rows that agree in both are one
    chosen = x.select("k", F.xxhash64("text").alias("th")).distinct().orderBy(F.xxhash64(F.lit("toxicity"), "k", "th"), "k", "th").limit(rows)
    x = x.withColumn("th", F.xxhash64("text")).join(F.broadcast(chosen), ["k", "th"], "left_semi").dropDuplicates(["k", "th"])
    return x.select("text", "toxic", F.when(_fold(F.col("k")) == 4, 1).otherwise(0).alias("part"))


def learn_terms(train: DataFrame) -> dict[str, float]:
    """Words and beginnings by log odds; counted by documents, in one aggregate. No more than MAX_TERMS come to the driver."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    stem = lambda n: F.transform(F.filter(words, lambda w: F.char_length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))
    x = train.where("part = 0").select("toxic", F.explode(F.array_distinct(F.concat(words, *map(stem, STEMS)))).alias("term"))
    sizes = train.where("part = 0").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    if not sizes.p or not sizes.n:
        return {}
    counts = x.groupBy("term").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).where(F.col("p") >= MIN_DOCS)
    odds = lambda c, total: F.log((F.col(c) + 0.5) / (F.lit(float(total)) - F.col(c) + 0.5))
    scored = counts.select("term", "p", (odds("p", sizes.p) - odds("n", sizes.n)).alias("w")).where(F.col("w") >= MIN_LOG_ODDS)
    return {r.term: float(r.w) for r in scored.orderBy(F.desc(F.col("w") * F.sqrt("p")), "term").limit(MAX_TERMS).collect()}


def _featurize(terms: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = build_trie(terms), {}
        for batch in batches:
            rows = [features(t, trie, known) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["f", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    train = training_rows(docs, labels, key, text, label, rows)
    terms = learn_terms(train)
    seen = train.where("part = 1").select("text", "toxic").mapInArrow(_featurize(terms), "f array<double>, toxic int").collect()
    x = np.array([r.f for r in seen], float).reshape(-1, FEATURES)
    y = np.array([r.toxic for r in seen], float)
    mean, scale = x.mean(axis=0) if len(x) else np.zeros(FEATURES), x.std(axis=0) if len(x) else np.ones(FEATURES)
    scale[scale == 0] = 1.0
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(FEATURES + 1)
    penalty = np.r_[np.full(FEATURES, 1.0), 1e-6]
    for _ in range(30 if len(x) else 0):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return Model(terms, mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]))


SCORES = "doc_id long, score double, n_hits double"


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = _held.setdefault(hash(tuple(sorted(model.terms.items()))), (build_trie(model.terms), {}))
        mean, scale, w = (np.array(v) for v in (model.mean, model.scale, model.weights))
        for batch in batches:
            f = np.array([features(t, trie, known) for t in batch.column(1).to_pylist()], float).reshape(-1, FEATURES)
            score = 1 / (1 + np.exp(-np.clip((f - mean) / scale @ w + model.bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(f[:, 6])], names=["doc_id", "score", "n_hits"])

    return run


#: Of a worker process: tries and remembered words of the models it has met.
_held: dict[int, tuple[Node, dict]] = {}


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_hits (for each hundred words). No shuffle."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(_score(model), SCORES)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and verdict."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_hits")
