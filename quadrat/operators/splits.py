"""Splits that keep studies together, cross-validation folds and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.ranking import batch_numbers, running
from quadrat.functions.scratch import written


def study_order(study: Column, seed: int = 0) -> Column:
    """A seeded order of studies that any engine can compute."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(study.cast("string"), F.lit("nan"))).cast("binary"))


def split_by_study(meta: DataFrame, study: str = "study_name", key: str = "sample_id", val_frac: float = 0.2, seed: int = 0, held: list | None = None) -> DataFrame:
    """(key, study, is_val): whole studies are held out if there are three or more, single samples otherwise.

    The list of studies is small and comes to the driver; samples do not.
    """
    name = F.coalesce(F.col(study).cast("string"), F.lit("nan"))
    meta = meta.select(F.col(key), name.alias("study"))
    if held is None:
        studies = [r.study for r in meta.select("study").distinct().orderBy(study_order(F.col("study"), seed)).collect()]
        if len(studies) < 3:
            # a seeded order of samples, of which the first int(N * (1 - val_frac)) train: places come from ranges, not from one sort
            drawn = meta.withColumn("_d", F.xxhash64(F.lit(seed), F.col(key)).cast("double")).withColumn("_n", F.lit(1))
            cut = int(meta.count() * (1 - val_frac))
            return drawn.join(running(drawn, "_d", ["_n"]).select("_d", "_n_before"), "_d").select(key, "study", (F.col("_n_before") >= cut).alias("is_val"))
        held = studies[: max(1, round(len(studies) * val_frac))]
    return meta.withColumn("is_val", F.col("study").isin([str(h) for h in held]))


def assign_folds(sizes: dict, k: int | None = None) -> dict:
    """Group -> fold: the largest group goes to the lightest fold. By default five folds or as many as there are groups."""
    k = min(5, len(sizes)) if k is None else k
    if k < 2 or k > len(sizes):
        raise ValueError("cross-validation needs two folds and a group for each")
    load, out = [0] * k, {}
    for group, n in sorted(sizes.items(), key=lambda x: (-x[1], str(x[0]))):
        fold = load.index(min(load))
        load[fold] += n
        out[group] = fold
    return out


def draw(key: Column, seed: int, epoch: int = 0) -> Column:
    """A number for each key that any engine can compute: 52 bits of a seeded digest, as a double."""
    text = F.concat(F.lit(f"{seed}:{epoch}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once, with dense row numbers from 0. Only the counts of its partitions are summed up, no rows are sorted."""
    x = written(df.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_id", 33)
    counts = x.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition of the written table
    at = counts.select("_part", before.alias("_before"))
    return x.withColumn("_part", part).join(at, "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_before")


#: Rounds of the bijection, and the most steps back into its range.
ROUNDS, WALK = 4, 64


def permuted(row: Column, n: int, seed: int, epoch: int = 0) -> Column:
    """The place of row numbers 0 to n - 1 in an order drawn for each seed and epoch: a bijection, so no sort and no shuffle.

    A Feistel network over a grid just above n cells; the few numbers that leave the range go through it again.
    """
    a = max(1, int(n**0.5))
    b = max(1, -(-n // a))

    def once(x: Column) -> Column:
        left, right = F.floor(x / b), F.pmod(x, F.lit(b))
        for k in range(ROUNDS):
            if k % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.lit(k), left), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.lit(k), right), F.lit(a)), F.lit(a))
        return left * b + right

    if a * b == n:
        return once(row)
    inside = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), once(row), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(inside < n, inside).otherwise(F.raise_error(F.lit("a row number did not come back into range")).cast("long"))


def permuted_batches(df: DataFrame, size: int, seed: int = 0, epoch: int = 0, row: str = "row_number") -> DataFrame:
    """``df`` with ``batch`` from dense row numbers (see ``numbered``): every batch has ``size`` rows but the last."""
    n = df.count()
    return df.withColumn("batch", F.floor(permuted(F.col(row), n, seed, epoch) / size).cast("int"))


def shuffled_batches(df: DataFrame, key: str, size: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``df`` with ``batch``: rows in an order drawn anew for each epoch, ``size`` to a batch. Equal keys fall together."""
    return batch_numbers(df.withColumn("_draw", draw(F.col(key), seed, epoch)), "_draw", size).drop("_draw")


def choose(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows with distinct keys, drawn without replacement; all of them if there are fewer."""
    r = batch_numbers(df.withColumn("_draw", draw(F.col(key), seed)), "_draw", n)
    return r.where("batch = 0").drop("_draw", "batch")


def group_folds(df: DataFrame, group: str, k: int | None = None) -> DataFrame:
    """(group, n, fold). Groups are counted by Spark; only the counts are dealt on the driver."""
    sizes = {r[group]: r["n"] for r in df.groupBy(group).agg(F.count("*").alias("n")).collect()}
    folds = assign_folds(sizes, k)
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame([(g, sizes[g], f) for g, f in folds.items()], f"`{group}` {kind}, n long, fold int")
