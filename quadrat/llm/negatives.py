"""Hard negatives by a search through buckets of candidates of similar norm.

Candidates are range-sorted by norm, longest first, and packed into buckets. A bucket's greatest norm times the anchor's norm bounds every
score in it (Cauchy-Schwarz), so a bucket is skipped for all windows whose lower limit, or whose running k-th score, is above that
bound; once a bucket is skipped, all later ones of the task are.

Anchors are the stated query set. They are cut into blocks, buckets are dealt into lanes, and a unit of work is one block of anchors
with one lane: it holds the block and reads the lane's buckets one at a time, by falling norm. Buckets are dealt to lanes by hash, so that
every lane has long vectors to begin with. A lane gives at most k rows for each window, and the rows of all lanes are merged. A first search
finds the positives, a second one the negatives in the windows that the positives' scores span.

Scores are whole numbers and exact: products are summed in double precision while they stay below 2^53, else as integers.

Defined results: a row with a null label, a null vector or any null or non-finite component takes no part, nor does a vector
whose scaled length is 2^31 or more, as its scores need not fit into a long; vectors of different lengths never meet; an empty vector scores 0; ids that
repeat are rows of their own, each an anchor or a candidate; a null id is no anchor and loses every tie; a window without negatives
and an anchor without positives give no rows; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.llm.common import Scratch, partitions, read

POSITIVES = 5
NEGATIVES = 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
EVERY = 100
SCALE = 256
#: Candidates of a bucket, and anchors of a block: a unit holds some tens of MB whatever the table's size.
BUCKET = 2048
BLOCK = 16_384
LONGEST = 2.0**31
#: Stands for a null id: after all others.
NO_ID = np.iinfo(np.int64).max

PACKS = "dim int, norm double, uids binary, ids binary, labels binary, vectors binary"


def prepared(vectors: DataFrame, key: str, embedding: str, label: Column) -> DataFrame:
    """(uid, id, label, norm, v) of the rows that take part; v holds whole numbers."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = label.isNotNull() & v.isNotNull() & ~bad
    x = vectors.where(sound).select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * SCALE).cast("double")).alias("v"))
    x = x.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))).where(F.col("norm") < LONGEST)
    return x.select(F.monotonically_increasing_id().alias("uid"), "id", "label", "norm", F.col("v").cast("array<int>").alias("v"))


def _matrix(column: pa.Array, rows: np.ndarray, d: int) -> np.ndarray:
    """Rows (of equal length d) of a list column."""
    flat, start = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return flat[(start[rows] - start[0])[:, None] + np.arange(d)].astype(np.int32)


def _pack(bucket: int):
    """Rows sorted by norm -> buckets of rows of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def done(d: int) -> pa.RecordBatch:
            norms, *rest = (np.concatenate(c) for c in zip(*held.pop(d), strict=True))
            at = range(0, len(norms), bucket)
            blobs = [pa.array([x[k : k + bucket].tobytes() for k in at], pa.binary()) for x in rest]
            return pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.int32()), pa.array([norms[k : k + bucket].max() for k in at], pa.float64()), *blobs], names=["dim", "norm", "uids", "ids", "labels", "vectors"])

        for batch in batches:
            lengths = np.diff(batch.column(4).offsets.to_numpy())
            uids, labels, norms = (batch.column(k).to_numpy() for k in (0, 2, 3))
            ids = batch.column(1).fill_null(NO_ID).to_numpy()
            for d in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == d)
                held.setdefault(d, []).append((norms[rows], uids[rows], ids[rows], labels[rows], _matrix(batch.column(4), rows, d)))
                if sum(len(x[0]) for x in held[d]) >= bucket:
                    yield done(d)
        for d in list(held):
            yield done(d)

    return run


def packed(rows: DataFrame, lanes: int, bucket: int = BUCKET) -> DataFrame:
    """Buckets of candidates of similar norm, each with its lane."""
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), F.desc("norm"), "uid").sortWithinPartitions(F.desc("norm"))
    return ranged.mapInArrow(_pack(bucket), PACKS).withColumn("lane", F.pmod(F.xxhash64("uids"), F.lit(lanes)).cast("int"))


def scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Whole inner products of rows; in doubles where they hold every sum."""
    if exact:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


class _Best:
    """The first k rows (score, then smaller id) of each window of an anchor, as buckets pass by."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.low, self.high = k, low, high
        self.found: list[list[tuple[int, int]]] = [[] for _ in low]  # (-score, id)

    def limits(self) -> np.ndarray:
        """The least score that each window still takes."""
        kth = [-f[-1][0] if len(f) == self.k else np.iinfo(np.int64).min for f in self.found]
        return np.maximum(self.low, kth)

    def add(self, score: np.ndarray, ids: np.ndarray, limits: np.ndarray) -> None:
        for w, low in enumerate(limits.tolist()):
            at = np.flatnonzero((score >= low) & (score <= self.high[w]))
            if len(at) > self.k:  # the k-th score and its ties, then the order decides
                kth = np.partition(score[at], len(at) - self.k)[len(at) - self.k]
                at = at[score[at] >= kth]
                at = at[np.lexsort((ids[at], -score[at]))[: self.k]]
            if len(at):
                self.found[w] = sorted(self.found[w] + list(zip((-score[at]).tolist(), ids[at].tolist(), strict=True)))[: self.k]


def _search(k: int, same_label: bool):
    """Rows of a unit, its anchors first, then its buckets by falling norm -> the unit's first k rows of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, block = None, [], None
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                row = _Row(column, r)
                if row["unit"] != unit:
                    if held:
                        yield from (block or _Block(held, k, same_label)).results()
                    unit, held, block = row["unit"], [], None
                if row["kind"] == 0:
                    held.append((row["uid"], row["label"], row["norm"], np.array(row["v"], np.float64), row["low"], row["high"]))
                elif held:
                    block = block or _Block(held, k, same_label)
                    block.meet(row["dim"], row["norm"], *(np.frombuffer(row[c], np.int64) for c in ("uids", "ids", "labels")), np.frombuffer(row["vectors"], np.int32))
        if block:
            yield from block.results()

    return run


class _Row:
    """One row of a batch; columns become Python values as they are asked for."""

    def __init__(self, column: dict[str, pa.Array], r: int):
        self.column, self.r = column, r

    def __getitem__(self, name: str):
        return self.column[name][self.r].as_py()


class _Block:
    """A block of anchors, by length of vector, and what its windows have found so far."""

    def __init__(self, held: list[tuple], k: int, same_label: bool):
        self.same_label = same_label
        lengths = np.array([len(a[3]) for a in held])
        self.uid, self.label, self.norm = (np.array([a[c] for a in held]) for c in (0, 1, 2))
        self.by_length = {d: np.flatnonzero(lengths == d) for d in np.unique(lengths).tolist()}
        self.matrix = {d: np.stack([held[n][3] for n in rows]) for d, rows in self.by_length.items()}
        span = np.iinfo(np.int64)
        self.best = [_Best(k, np.array([span.min] if a[4] is None else a[4], np.int64), np.array([span.max] if a[5] is None else a[5], np.int64)) for a in held]

    def meet(self, d: int, longest: float, uids: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        if d not in self.by_length:
            return
        open_at, limits = [], []
        for at, n in enumerate(self.by_length[d].tolist()):
            low = self.best[n].limits()
            # the bound lies a little above the product of the rounded norms
            if (low <= self.norm[n] * longest * (1 + 1e-12) + 1).any():
                open_at.append(at)
                limits.append(low)
        # vectors only get shorter and limits only rise: a closed anchor stays closed
        self.by_length[d], self.matrix[d] = self.by_length[d][open_at], self.matrix[d][open_at]
        v = v.reshape(len(ids), d).astype(np.float64)
        for k in range(0, len(open_at), 256):
            rows = self.by_length[d][k : k + 256]
            s = scores(self.matrix[d][k : k + 256], v, self.norm[rows].max() * longest < 2.0**52)
            for n, line, low in zip(rows.tolist(), s, limits[k : k + 256], strict=True):
                same = labels == self.label[n]
                keep = np.flatnonzero(same & (uids != self.uid[n]) if self.same_label else ~same)
                self.best[n].add(line[keep], ids[keep], low)

    def results(self) -> Iterator[pa.RecordBatch]:
        rows = [(u, w, i, -s) for u, b in zip(self.uid.tolist(), self.best, strict=True) for w, f in enumerate(b.found) for s, i in f]
        for at in range(0, len(rows), 50_000):
            columns = zip(*rows[at : at + 50_000], strict=True)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["uid", "w", "cand", "score"])


FOUND = "uid long, w int, cand long, score long"


ANCHOR = "unit int, kind int, uid long, label long, norm double, v array<int>, low array<long>, high array<long>, dim int, uids binary, ids binary, labels binary, vectors binary"


def _met(anchors: DataFrame, packs: DataFrame, k: int, same_label: bool, blocks: int, lanes: int) -> DataFrame:
    """(uid, w, cand, score): the first k of each window in each lane."""
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    packs = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rows(df: DataFrame, kind: int) -> DataFrame:
        made = {"unit": F.col("block") * lanes + F.col("lane"), "kind": F.lit(kind)}
        fields = [f.split() for f in ANCHOR.split(", ")]
        return df.select(*[made.get(n, F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])

    units = rows(anchors, 0).union(rows(packs, 1)).repartition(blocks * lanes, "unit").sortWithinPartitions("unit", "kind", F.desc("norm"))
    return units.mapInArrow(_search(k, same_label), FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each window, with their place."""
    order = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "cand")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(vectors: DataFrame, label: Column | None = None, key: str = "vec_id", embedding: str = "embedding", anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    label = F.col("label") if label is None else label
    anchor = F.col("id") % EVERY == 0 if anchor is None else anchor
    # written, so that row numbers stay the same in both searches
    rows = scratch.save(prepared(vectors, key, embedding, label), "rows")
    # a lane has a few buckets at least: each gives up to k rows for every window
    lanes = max(1, min(partitions(spark), rows.count() // (4 * bucket)))
    packs = scratch.save(packed(rows, lanes, bucket), "packs")
    anchors = rows.where(anchor)
    blocks = max(1, -(-anchors.count() // block))
    pos = _first(_met(anchors, packs, positives, True, blocks, lanes), positives)
    pos = scratch.save(pos.select("uid", "place", F.col("cand").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    percent = lambda p: F.col("positive_score").cast("decimal(20,0)") * F.lit(p).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")
    low, high = F.ceil(percent(LOW_PERCENT)), F.floor(percent(HIGH_PERCENT))
    windows = pos.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", low.cast("long").alias("low"), high.cast("long").alias("high")))).alias("s"))
    wide = anchors.join(windows, "uid").select(*anchors.columns, F.col("s.low").alias("low"), F.col("s.high").alias("high"))
    neg = _first(_met(wide, packs, negatives, False, blocks, lanes), negatives)
    unknown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = neg.join(pos.withColumn("w", F.col("place") - 1).drop("place"), ["uid", "w"]).join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")
    return out.select("anchor_id", unknown("positive_id").alias("positive_id"), F.col("place").cast("int").alias("rank"), unknown("cand").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor's positives."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read(spark, sf_dir, "embeddings"), moved)


OP13_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor({SCALE} * x) FOR x IN embedding::DOUBLE[]] AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW_PERCENT} * positive_score <= 100 * score AND 100 * score <= {HIGH_PERCENT} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
