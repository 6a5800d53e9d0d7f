r"""Secret scans through an incremental ledger of blobs.

Every historical version of a text is addressed by the SHA-256 of its content. The ledger holds one
row for each (blob, rule, rule version) pair ever scanned, with its findings, an empty list included.
A run scans only pairs that the ledger lacks; a new version of one rule rescans every blob for that
rule alone. Findings are joined back to all paths that hold the blob.

Defined results: a null text counts as the empty text; an empty table gives an empty ledger; rows
that repeat a path keep their number; other columns pass through ``report`` untouched, whatever
their names, because its input is carried as one struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import Scratch, read, text_batches


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; those whose ``group`` is shorter than ``least`` fail."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# Formats of credentials. The first three are the base kinds, in listed order.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
BASE = tuple(r.kind for r in RULES[:3])

#: Up to this many blobs of the ledger (some 100 bytes each) are broadcast.
BROADCAST_BLOBS = 200_000

LEDGER = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


def blob_of(text: str | Column) -> Column:
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"), 256)


def find(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _fast(rule: Rule) -> str:
    # a maximal run that is long enough is found at the same place if the least length is asked for at once
    return r"[0-9a-f]{16,}" if rule.kind == "hex" and rule.least == 16 else rule.pattern


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, kinds) -> ledger rows, for those of ``rules`` that ``kinds`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.kind: (r, re.compile(_fast(r), re.ASCII)) for r in rules}
        for batch in batches:
            blob, kind, version, spans = [], [], [], []
            for sha, text, kinds in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for k in kinds:
                    rule, pattern = compiled[k]
                    blob.append(sha)
                    kind.append(k)
                    version.append(rule.version)
                    spans.append([{"start": a, "end": b} for a, b in find(text, rule, pattern)])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(blob, pa.string()), pa.array(kind, pa.string()), pa.array(version, pa.int32()), pa.array(spans, span)], names=["blob", "kind", "version", "spans"])

    return text_batches(blobs).mapInArrow(run, LEDGER)


def _current(rules: tuple[Rule, ...]) -> Column:
    """Ledger rows that these rules wrote in their present versions."""
    return F.concat_ws("@", "kind", "version").isin(*[f"{r.kind}@{r.version}" for r in rules])


def update(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for the texts of ``docs``: append them to the ledger.

    Texts that the ledger knows under every present rule leave before the shuffle when the ledger's list of blobs is short, and after it
    otherwise. Copies of a text meet in a map-side aggregate before the shuffle, so a text that a third of the
    rows hold is sent once by each task and scanned once.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(blob_of(content).alias("blob"), content.alias("text"))
    every = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is None:
        return scan(texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("kinds", every), rules)
    seen = ledger.where(_current(rules)).groupBy("blob").agg(F.collect_set("kind").alias("seen"))
    done = seen.where(F.size(F.array_except(every, "seen")) == 0).select("blob")
    if done.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS:
        done = F.broadcast(done)
    blobs = texts.join(done, "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))
    fresh = blobs.join(seen, "blob", "left").withColumn("kinds", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
    return scan(fresh.select("blob", "text", "kinds"), rules)


#: A table of findings of up to this many bytes as text is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def report(docs: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row of ``docs`` (struct ``row``) with the ``findings`` of its blob: kind, start, end, by start, then kind as listed.

    The findings by blob are written first: a short table is broadcast, and a join with a long one is a plain
    one, which Spark can split at a blob that very many rows hold.
    """
    rank = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    hits = ledger.where((F.size("spans") > 0) & _current(rules))
    hits = hits.dropDuplicates(["blob", "kind", "version"]).select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[F.col("kind")].alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind"))).alias("f"))
    by_blob = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("f"))).alias("findings"))
    by_blob = Scratch(docs.sparkSession).save(by_blob, "by-blob")
    n, spans = by_blob.agg(F.count("*"), F.sum(F.size("findings"))).first()
    if 80 * n + 40 * (spans or 0) <= BROADCAST_BYTES:
        by_blob = F.broadcast(by_blob)
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), blob_of(F.col(text).cast("string")).alias("blob"))
    return rows.join(by_blob, "blob", "left").select("row", "blob", F.coalesce("findings", F.array().cast(by_blob.schema["findings"].dataType)).alias("findings"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document: counts by base kind, digest of the base spans, all spans.

    The table stands for a history in two increments: versions with even ids, null among them, were there first. The second
    run scans only blobs that the first one's ledger lacks, and its rows are appended.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark)
    early = F.coalesce(F.pmod("doc_id", F.lit(2)) == 0, F.lit(True))
    ledger = scratch.save(update(docs.where(early)), "ledger-1").withColumn("increment", F.lit(1))
    ledger = ledger.union(scratch.save(update(docs.where(~early), ledger), "ledger-2").withColumn("increment", F.lit(2)))
    found = report(docs, ledger)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def _spans_sql(rule: Rule) -> str:
    """Spans of one rule: a match starts after all that was matched and not matched before it."""
    p = rule.pattern.replace("'", "''")
    return f"""SELECT r, kind, start, start + len(m) AS stop, {RULES.index(rule)} AS o FROM (
      SELECT r, '{rule.kind}' AS kind, unnest(m) AS m, unnest(g) AS g,
             unnest(list_transform(range(1, len(m) + 1), lambda k: coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))) AS start
      FROM (SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {rule.group}) AS g, regexp_split_to_array(t, '{p}') AS p FROM d)
    ) WHERE length(g) >= {rule.least}"""


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(map(_spans_sql, RULES))}),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, o) FILTER (o < 3) AS base,
             string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, o) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""
