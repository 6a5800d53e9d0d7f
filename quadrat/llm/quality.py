"""Quality rules as a short-circuit cascade.

Each rule is a predicate over one text. ``estimate`` runs every rule on a bounded sample and
measures its cost (seconds a text) and selectivity (share of texts it rejects). ``cascade`` then
evaluates the rules by rejection per cost, largest first, and a text that one rule rejects is never
shown to the next. The verdict is the conjunction of all rules, so the sample decides how fast the
cascade is and never which texts it keeps.

Defined results: a null text has no words and is treated as empty; empty tables give empty results;
repeated rows are judged one by one; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import read, text_batches

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Symbols for each hundred words; lines equal to an earlier one for each hundred lines.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 60
#: Mean word length in code points.
MEAN_WORD = (2, 25)
#: Rows that ``estimate`` looks at; only the order of evaluation depends on them.
SAMPLE_ROWS = 2000
SAMPLE_SEED = 11

SYMBOLS = "#*$%&|<>"


class Text:
    """One text; what several rules need is computed once and on demand."""

    __slots__ = ("_lines", "_repeat", "_words", "raw")

    def __init__(self, raw: str | None):
        self.raw = raw or ""
        self._words: list[bytes] | None = None
        self._lines: tuple[int, int] | None = None
        self._repeat: int | None = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            # bytes.split() splits at exactly the six ASCII white-space characters
            self._words = self.raw.encode("utf-8", "surrogatepass").split()
        return self._words

    @property
    def word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined) - joined.translate(_NOT_CONTINUATION).count(b"\x80")

    @property
    def symbols(self) -> int:
        return sum(map(self.raw.count, SYMBOLS))

    @property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and those of them equal to an earlier line."""
        if self._lines is None:
            full = [x for x in self.raw.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
            self._lines = len(full), len(full) - len(set(full))
        return self._lines

    @property
    def repeat_words(self) -> int:
        """Words inside three-word windows that occur at least twice in the text."""
        if self._repeat is None:
            self._repeat = _repeat_words(self.words)
        return self._repeat


#: Maps the continuation bytes of UTF-8 to one of them, so that they can be counted at once.
_NOT_CONTINUATION = bytes(0x80 if 0x80 <= b < 0xC0 else 0 for b in range(256))


def _repeat_words(words: list[bytes]) -> int:
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) < 2_000_000:
        base = len(seen)
        window = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:  # the product would overflow: number the pairs first
        pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1].ravel()
        window = pair[:-1] * len(seen) + ids[2:]
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(window) + k] |= twice
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


RULES = (
    Rule("few_words", lambda t: len(t.words) < MIN_WORDS),
    Rule("repeated_words", lambda t: 100 * t.repeat_words > MAX_REPEAT_PERCENT * len(t.words)),
    Rule("symbols", lambda t: 100 * t.symbols > MAX_SYMBOL_PERCENT * len(t.words)),
    Rule("duplicate_lines", lambda t: 100 * t.lines[1] > MAX_DUP_LINE_PERCENT * t.lines[0]),
    Rule("word_length", lambda t: not MEAN_WORD[0] * len(t.words) <= t.word_chars <= MEAN_WORD[1] * len(t.words)),
)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """{rule: (seconds a text, share rejected)} on a seeded sample of about ``rows`` rows."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, cost, hit, n = [], [], [], []
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for rule in rules:
                began = time.perf_counter()
                bad = sum(rule.rejects(Text(x)) for x in texts)
                names.append(rule.name)
                cost.append(time.perf_counter() - began)
                hit.append(bad)
                n.append(len(texts))
        yield pa.RecordBatch.from_pydict({"rule": pa.array(names, pa.string()), "cost": pa.array(cost, pa.float64()), "hit": pa.array(hit, pa.int64()), "n": pa.array(n, pa.int64())})

    # a Bernoulli sample: no shuffle, and each task measures what it drew; the count needs no column
    share = min(1.0, rows / max(docs.count(), 1))
    sample = docs.select(F.col(text).cast("string").alias("t")).sample(False, share, SAMPLE_SEED)
    found = sample.mapInArrow(measure, "rule string, cost double, hit long, n long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("hit").alias("hit"), F.sum("n").alias("n")).collect()
    return {r.rule: (r.cost / max(r.n, 1), r.hit / max(r.n, 1)) for r in found}


def ordered(rules: tuple[Rule, ...], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """By rejection per cost, largest first; unmeasured rules last, ties in the given order."""
    worth = {name: share / max(cost, 1e-9) for name, (cost, share) in measured.items()}
    return sorted(rules, key=lambda r: -worth.get(r.name, 0.0))


def _rejected(text: Text, order: list[Rule]) -> bool:
    """Whether a rule rejects the text; rules after the first that does are not evaluated."""
    return any(rule.rejects(text) for rule in order)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", kept: str = "kept", order: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the boolean column ``kept``: no rule rejects the text.

    ``kept`` replaces a column of that name. Only the text goes to Python and only a boolean comes
    back; there is no shuffle.
    """
    order = ordered(rules, estimate(text_batches(docs), rules, text)) if order is None else order

    @F.arrow_udf("boolean")
    def verdict(texts: pa.Array) -> pa.Array:
        # one text at a time: its words are gone before the next one's are made
        return pa.array([not _rejected(Text(x.as_py()), order) for x in texts], pa.bool_())

    return docs.withColumn(kept, verdict(F.coalesce(F.col(text).cast("string"), F.lit(""))))


STATS = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,kept:boolean>"


def _stats(t: Text) -> tuple[int, ...]:
    return len(t.words), t.word_chars, t.symbols, t.lines[1], t.repeat_words


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", judgement: str = "m", order: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the struct column ``judgement``: the measures that the rules rest on, and ``kept``, the cascade's verdict.

    Each text is cut into words once: rules and measures share what either needs.
    """
    order = ordered(rules, estimate(text_batches(docs), rules, text)) if order is None else order

    @F.arrow_udf(STATS)
    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts:
            t = Text(x.as_py())
            kept = not _rejected(t, order)
            rows.append((*_stats(t), kept))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64()] * 5 + [pa.bool_()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept"])

    return docs.withColumn(judgement, of(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, whether the base rules fail it, and the cascade's verdict."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    flat = judged(docs).select("doc_id", "m.*").withColumn("base_failed", base)
    return flat.withColumn("kept", ~F.col("base_failed") & F.col("kept"))


OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM h) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= {MAX_SYMBOL_PERCENT} * n_words AND 100 * n_dup_lines <= {MAX_DUP_LINE_PERCENT} * n_lines
       AND word_chars BETWEEN {MEAN_WORD[0]} * n_words AND {MEAN_WORD[1]} * n_words AS kept
FROM f
"""
