"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= t are at most sqrt(2 - 2t) apart. After a seeded rotation, which spreads
every difference over all coordinates, vectors are split into blocks of eight coordinates. If a pair is
near, then in at least one block its squared distance is within the block's proportional share of the
budget. So each block is range-joined on its own: a vector lives in one grid cell and looks into
those neighbouring cells that its ball reaches. What meets there and is near enough in
that block is a candidate; the union of candidates over blocks is verified exactly, on the given
vectors in double precision.

Vectors are compared only under equal, non-null labels. Equal vectors of a label are one class, so copies
cost nothing and are counted by the size of their class. Cells hold eight-byte signatures of blocks, never
vectors, and large cells are compared in tiles.

Defined results: a null, empty or zero vector, one with null or non-finite components, and one
without a label link with nothing and are kept; vectors of different lengths are never linked; a repeated
row counts as another vector; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import Scratch, connected_components, partitions, read

THRESHOLD = 0.98
WIDTH = 8
SEED = 7
#: Width of a grid cell in radii of a block's budget; at least 2.
CELL = 2.83
#: Products of a tile, probes on its side, and pairs that are given on together.
TILE = 4_000_000
SIDE = 4_000
PAIRS = 500_000

ENTRY = np.dtype([("cell", "<u8"), ("cls", "<i8"), ("probe", "u1"), ("q", "i1", (WIDTH,))])


def rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))[0]


def blocks(d: int, threshold: float) -> list[tuple[slice, float]]:
    """Coordinates of each block and the radius of its share of the squared distance."""
    budget = 2 - 2 * threshold + 1e-9
    return [(slice(k, min(k + WIDTH, d)), float(np.sqrt(budget * (min(k + WIDTH, d) - k) / d))) for k in range(0, d, WIDTH)]


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def entries(cls: np.ndarray, label: np.ndarray, x: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """Of unit vectors: one entry at home and one for each cell that a block's ball reaches."""
    y = x @ rotation(x.shape[1])
    for b, (at, radius) in enumerate(blocks(x.shape[1], threshold)):
        z, w = y[:, at], CELL * radius
        k = z.shape[1]
        cell = np.floor(z / w)
        u = z / w - cell
        step = np.where(u >= 0.5, 1, -1)
        gap2 = (np.minimum(u, 1 - u) * w) ** 2
        q = np.zeros((len(x), WIDTH), np.int8)
        q[:, :k] = np.round(np.clip(z, -1, 1) * 127)

        def entry(rows, moved, probe, cell=cell, step=step, q=q, b=b, k=k):
            e = np.empty(len(rows), ENTRY)
            c = cell[rows] + step[rows] * moved
            e["cell"] = _hash([label[rows], np.full(len(rows), x.shape[1]), np.full(len(rows), b), *(c[:, i] for i in range(k))])
            e["cls"], e["probe"], e["q"] = cls[rows], probe, q[rows]
            return e

        every = np.arange(len(x))
        yield entry(every, np.zeros(k), 0)
        for mask in range(1 << k):
            moved = (mask >> np.arange(k)) & 1
            rows = every[gap2 @ moved <= radius * radius * (1 + 1e-9)]
            if len(rows):
                yield entry(rows, moved, 1)


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows by length of vector: (row numbers, matrix in double precision)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = column.offsets.to_numpy()[:-1] - column.offsets.to_numpy()[0]
    for d in np.unique(length).tolist():
        rows = np.flatnonzero(length == d)
        yield rows, flat[start[rows][:, None] + np.arange(d)]


def _spread(threshold: float, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, label = (batch.column(i).to_numpy() for i in (0, 1))
            for rows, x in _vectors(batch.column(2)):
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                for k in range(0, len(rows), 2000):
                    e = np.concatenate(list(entries(cls[rows[k : k + 2000]], label[rows[k : k + 2000]], x[k : k + 2000], threshold)))
                    part = (e["cell"] % np.uint64(parts)).astype(np.int32)
                    order = np.argsort(part, kind="stable")
                    at, starts = np.unique(part[order], return_index=True)
                    blobs = [e[s].tobytes() for s in np.split(order, starts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "entries"])

    return run


def near_in_block(e: np.ndarray, radius: float) -> Iterator[np.ndarray]:
    """Pairs of classes (first < second) that meet in a cell and are within the radius, up to rounding of signatures.

    They come in parts of about ``PAIRS``: a dense cell's pairs are never held together. A class has one home, so a block gives a pair once.
    """
    e = e[np.lexsort((e["probe"], e["cell"]))]
    start = np.flatnonzero(np.r_[True, e["cell"][1:] != e["cell"][:-1]])
    end = np.r_[start[1:], len(e)]
    homes = np.add.reduceat(1 - e["probe"].astype(np.int64), start)
    limit = int(np.ceil((radius * 127 + np.sqrt(WIDTH)) ** 2))
    out, size = [], 0
    for s, t, h in zip(start.tolist(), end.tolist(), homes.tolist(), strict=True):
        if not h or t - s < 3:
            continue
        home, probes = e[s : s + h], e[s + h : t]
        for k in range(0, len(probes), SIDE):
            a, qa = probes["cls"][k : k + SIDE], probes["q"][k : k + SIDE].astype(np.float32)
            square = (qa * qa).sum(axis=1)
            step = max(1, TILE // len(a))
            for n in range(0, h, step):
                b, qb = home["cls"][n : n + step], home["q"][n : n + step].astype(np.float32)
                # sums of products of small integers: exact in single precision
                d2 = square[:, None] + (qb * qb).sum(axis=1) - 2 * (qa @ qb.T)
                i, j = np.nonzero(d2 <= limit)
                x, y = a[i], b[j]
                out.append(np.stack([x, y], axis=1)[x < y])
                size += len(out[-1])
                if size >= PAIRS:
                    yield np.concatenate(out)
                    out, size = [], 0
    if size:
        yield np.concatenate(out)


def _meet(radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                for p in near_in_block(np.concatenate(held), radius):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], names=["a", "b"])

        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now:
                    yield from done()
                    now, held = part, []
                held.append(np.frombuffer(blob.as_buffer(), ENTRY))
        yield from done()

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for (rows, x), (others, y) in zip(_vectors(batch.column(4)), _vectors(batch.column(5)), strict=True):
                assert (rows == others).all(), "classes of one cell have vectors of one length"
                cos = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                keep[rows] = cos >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in range(4)], names=["a", "b", "ma", "mb"])

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    parts = 4 * partitions(spark)
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col(label).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), F.struct(F.xxhash64(F.col(label)).alias("label"), F.col(embedding).alias("v"))).alias("c"))
    rows = rows.withColumn("cls", F.when(F.col("c").isNotNull(), F.xxhash64("c.label", "c.v")))
    classes = rows.where("cls is not null").groupBy("cls", "c").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"))
    classes = scratch.save(classes.select("cls", "c.label", "c.v", "m", "least"), "classes")
    radius = float(np.sqrt((2 - 2 * threshold + 1e-9)))
    spread = classes.select("cls", "label", "v").mapInArrow(_spread(threshold, parts), "part int, entries binary")
    met = spread.repartition(partitions(spark), "part").sortWithinPartitions("part")
    # no block's share exceeds that of WIDTH coordinates out of the shortest vector's length
    d = classes.agg(F.min(F.size("v"))).first()[0] or WIDTH
    met = met.mapInArrow(_meet(radius * float(np.sqrt(min(1.0, WIDTH / d)))), "a long, b long").distinct()
    side = lambda s: classes.select(F.col("cls").alias(s), F.col("m").alias(f"m{s}"), F.col("v").alias(f"v{s}"))
    both = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb", "va", "vb")
    links = scratch.save(both.mapInArrow(_verify(threshold), "a long, b long, ma long, mb long"), "links")
    comps = connected_components(links.select("a", "b"), scratch, "cc")
    degree = links.select(F.col("a").alias("cls"), F.col("mb").alias("k")).union(links.select("b", "ma")).groupBy("cls").agg(F.sum("k").alias("k"))
    c = classes.select("cls", "m", "least").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = c.groupBy("comp").agg(F.min("least").alias("component_id"))
    c = c.join(degree, "cls", "left").join(smallest, "comp").select("cls", (F.col("m") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cls").join(c, "cls", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links, component and verdict."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP7_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_dot_product(x.e, y.e) / (x.n * y.n) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id GROUP BY e.vec_id
"""
