"""Operators on small tables, against hand-made values and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.functions import ranking, scalars
from quadrat.operators import cohort, composition, encoder, evaluate, hypothesis, lineage, retrieval, splits, tokens
from quadrat.sources import synthetic, tables
from quadrat.streaming import tokens as stream


@pytest.fixture
def cells(spark):
    rows = [("a", "x", 0, 3.0), ("a", "y", 1, 1.0), ("b", "x", 0, 2.0), ("b", "y", 1, 2.0), ("c", "z", 2, 5.0)]
    return spark.createDataFrame(rows, "sample_id string, feature string, feature_idx int, abundance double")


@pytest.fixture
def features(spark):
    return tables.feature_table(spark, ["x", "y", "z", "never"])


def test_relative_and_zero_sum(spark, cells):
    r = {(x.sample_id, x.feature): x.rel for x in composition.relative(cells).collect()}
    assert r["a", "x"] == 0.75 and r["b", "y"] == 0.5 and r["c", "z"] == 1.0
    zero = spark.createDataFrame([("s", 0, 0.0)], "sample_id string, feature_idx int, abundance double")
    assert composition.relative(zero).first().rel == 0.0
    assert composition.half_min(composition.relative(zero)).first().eps == 1e-6


def test_clr_is_the_dense_one(cells, features):
    rel = composition.relative(cells)
    model = composition.fit(rel, features)
    assert model.eps == 0.125 and model.p == 4
    dense = np.zeros((3, 4))
    for x in rel.collect():
        dense["abc".index(x.sample_id), x.feature_idx] = x.rel
    logs = np.log(dense + model.eps)
    want = logs - logs.mean(axis=1, keepdims=True)
    got = composition.clr(rel, model)
    for x in got.collect():
        assert x.clr == pytest.approx(want["abc".index(x.sample_id), x.feature_idx])
        assert x.clr_zero == pytest.approx(want["abc".index(x.sample_id), 3])
    edges = tokens.bin_edges(got, model, 4).first().edges
    assert edges == pytest.approx(np.quantile(want[want != 0], [0.25, 0.5, 0.75]).tolist())


def test_pseudocount_is_checked(cells, features):
    with pytest.raises(ValueError):
        composition.fit(composition.relative(cells), features, "other")
    with pytest.raises(ValueError):
        composition.fit(composition.relative(cells), features, 0.0)


def test_rank_ties_and_truncation(cells):
    t = {(x.sample_id, x.rank): x.token_id for x in tokens.rank(composition.relative(cells), 1).collect()}
    assert t == {("a", 0): 2, ("b", 0): 2, ("c", 0): 4}


def test_rank_uses_a_group_limit(cells):
    plan = tokens.rank(composition.relative(cells), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_padded_keeps_empty_samples(spark, cells):
    samples = spark.createDataFrame([("a",), ("empty",)], "sample_id string")
    p = {x.sample_id: x for x in tokens.padded(tokens.rank(composition.relative(cells), 3), 3, samples=samples).collect()}
    assert p["a"].ids == [2, 3, 0] and p["empty"].ids == [0, 0, 0] and p["empty"].n_tokens == 0


def test_digitize_with_equal_edges(spark):
    row = spark.range(1).select(scalars.digitize(F.lit(1.0), F.array(*map(F.lit, [1.0, 1.0, 2.0]))).alias("b")).first()
    assert row.b == np.digitize(1.0, [1, 1, 2]) + 1


def test_tokenizer_modes(cells, features):
    for mode in ("rank", "bin", "cont"):
        m = tokens.fit(cells, features, mode, 4, 4)
        assert m.vocab_size == 6 and m.transform(cells).count() == 5
    vals = [x.bin for x in tokens.bins(tokens.rank(composition.clr(composition.relative(cells), m.composition), 4), [0.0]).collect()]
    assert set(vals) <= {1, 2}
    with pytest.raises(ValueError):
        tokens.fit(cells, features, "other")


def test_mask_forces_one(cells):
    t = tokens.rank(composition.relative(cells), 4).withColumn("val", F.lit(7.0))
    none = tokens.mask(t, F.lit(1.0)).collect()
    assert sorted((x.sample_id, x.rank) for x in none if x.selected) == [("a", 0), ("b", 0), ("c", 0)]
    assert all(x.token_id == 1 and x.val == 0.0 for x in none if x.selected)
    kept = tokens.mask(t, F.lit(0.0), mode="rank").collect()
    assert all(x.selected and x.val == 7.0 for x in kept)


def test_lineage(spark, features):
    lin = spark.createDataFrame([("x", "F1", 0), ("x", "F9", 1), ("y", "F1", 2), ("z", None, 3)], "Taxon string, Family string, src_row int")
    lab = {x.feature: x.label for x in lineage.labels(features, lin).collect()}
    assert lab == {"x": "F1", "y": "F1", "z": "__unknown__z", "never": "__unknown__never"}
    full = lineage.labels(features, lin)
    assert lineage.density(full).first().density == pytest.approx(6 / 16)
    pairs = {(r.i, r.j) for r in lineage.adjacency(full).collect()}
    assert pairs == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 3)}
    with pytest.raises(ValueError):
        lineage.labels(features, lin, "taxon")


def test_attention_of_mask_and_padding(spark, features):
    lin = spark.createDataFrame([("x", "F1", 0), ("y", "F1", 1), ("z", "F2", 2)], "taxon string, family string, src_row int")
    lab = lineage.labels(features, lin)
    t = spark.createDataFrame([("s", 0, 2), ("s", 1, 4), ("s", 2, 1)], "sample_id string, rank int, token_id long")
    a = {(r.i, r.j): r.allowed for r in lineage.attention(t, lab).collect()}
    assert not a[0, 1] and a[0, 0] and a[0, 2] and a[2, 1]
    b = {(r.i, r.j): r.allowed for r in lineage.attention(t, lab, allow_global=False).collect()}
    assert b[0, 2] and not b[1, 2] and b[2, 0]


def test_parse_lineage(spark):
    df = spark.createDataFrame([("k__B|p__P|g__|s__S",), ("plain",)], "t string")
    r = df.select(*[c.alias(n) for n, c in scalars.parse_lineage(F.col("t")).items()]).collect()
    assert (r[0].kingdom, r[0].phylum, r[0].genus, r[0].family) == ("B", "P", "", None) and r[1].kingdom is None


def test_align_in_order(spark):
    a = spark.createDataFrame([(k,) for k in ("d", "a", "c", "a", "x")], "sample_id string").repartition(3)
    b = spark.createDataFrame([(k,) for k in ("c", "d", "a", "y")], "sample_id string").repartition(2)
    one, two = tables.align(a, b, ordered=True)
    assert [r.sample_id for r in one.collect()] == ["a", "a", "c", "d"] and [r.sample_id for r in two.collect()] == ["a", "c", "d"]


def test_align_keeps_multiplicity(spark):
    a = spark.createDataFrame([("s",), ("s",), ("t",)], "sample_id string")
    b = spark.createDataFrame([("s",), ("s",), ("u",)], "sample_id string")
    x, y = tables.align(a, b)
    assert x.count() == 2 and y.count() == 2
    with pytest.raises(Exception, match="paired"):
        tables.paired_samples(a, b, 50).collect()


def test_wide_round_trip(spark, tmp_path):
    (tmp_path / "taxa_abundance.csv").write_text("sample_id,s.a,s b,none\nA,60,40,0\nB,NA,100,0\n")
    (tmp_path / "metadata.csv").write_text("sample_id,study_name,age\nA,S1,50\nC,S1,NA\n")
    c = tables.load_cohort(spark, str(tmp_path))
    assert c.pathways is None and c.lineage is None
    assert c.taxa_features.count() == 3 and {r.feature: r.abundance for r in c.taxa.collect()} == {"s.a": 60.0, "s b": 40.0}
    wide = tables.to_wide(c.taxa, ["s.a", "s b", "none"]).collect()
    assert wide[0]["none"] == 0.0 and wide[0]["s.a"] == 60.0
    tables.write_csv(c.metadata, str(tmp_path / "out"))
    tables.write_records(c.metadata, str(tmp_path / "rec"))
    tables.write_cells(c.taxa, str(tmp_path / "cells"), "taxa")
    assert spark.read.parquet(str(tmp_path / "cells")).where("modality = 'taxa'").count() == 2
    assert tables.matching_files(spark, str(tmp_path), ["taxa", "x"], "abundance").count() == 1
    assert tables.merge_studies(c.taxa, c.taxa).count() == 4


def test_splits(spark):
    meta = spark.createDataFrame([(f"{s}{k}", s) for s in "abcd" for k in range(5)] + [("n", None)], "sample_id string, study_name string")
    v = splits.split_by_study(meta).groupBy("study").agg(F.count_distinct("is_val").alias("k"), F.max("is_val").alias("v")).collect()
    assert all(x.k == 1 for x in v) and sum(x.v for x in v) == 1
    two = meta.where("study_name in ('a', 'b')")
    assert splits.split_by_study(two).count() == 10
    held = splits.split_by_study(meta, held=["a"]).where("is_val").select("study").distinct().collect()
    assert [h.study for h in held] == ["a"]
    assert splits.assign_folds({"a": 5, "b": 4, "c": 3, "d": 3}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    with pytest.raises(ValueError):
        splits.assign_folds({"a": 1})


def test_average_ranks_and_auc(spark):
    rng = np.random.default_rng(0)
    p, y = rng.integers(0, 40, 500) / 40, rng.integers(0, 2, 500)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    wins = sum((a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0])
    assert evaluate.auc(df).first().auc == pytest.approx(wins / ((y == 1).sum() * (y == 0).sum()))
    flipped = evaluate.auc(df.withColumn("p", -F.col("p"))).first().auc
    assert flipped + wins / ((y == 1).sum() * (y == 0).sum()) == pytest.approx(1)
    assert evaluate.auc(df.where("y = 1")).first().auc is None
    ranks = {r.p: r.rank for r in ranking.average_ranks(df, "p").collect()}
    for v in set(p.tolist()):
        assert ranks[v] == pytest.approx((p < v).sum() + ((p == v).sum() + 1) / 2)
    b = ranking.batch_numbers(df.select(F.monotonically_increasing_id().alias("k")), "k", 64)
    assert max(r["count"] for r in b.groupBy("batch").count().collect()) == 64


def test_calibration_against_newton(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + 0.7 * z)))).astype(int)
    df = spark.createDataFrame([(float(1 / (1 + np.exp(-a))), int(b)) for a, b in zip(z, y)], "p double, y int")
    w, x = np.zeros(2), np.c_[np.ones(400), z]
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x, x.T @ (y - q))
    assert evaluate.calibration(df) == pytest.approx(tuple(w), rel=1e-5)
    assert math.isnan(evaluate.calibration(df.where("y = 1"))[1])


def test_out_of_fold_marks_one_class(spark):
    rows = [(f"s{k}", "g" + str(k % 3), int(k % 2 == 0 and k % 3 != 0), float(k), 1.0) for k in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, grp string, y int, a double, b double")
    out = evaluate.out_of_fold(df, ["a", "b"])
    assert out.count() == 60 and out.where("p is null").count() == 0
    assert evaluate.report(out, "r", "logreg", 2).first().n_scored == 60
    one = evaluate.out_of_fold(df.where("grp <> 'g1'").withColumn("y", (F.col("grp") == "g2").cast("int")), ["a"])
    assert one.where("p is not null").count() == 0


def test_retrieval_and_loss(spark):
    rng = np.random.default_rng(2)
    za, zb = rng.normal(size=(9, 4)), rng.normal(size=(9, 4))
    df = spark.createDataFrame([(k, k // 4, za[k].tolist(), zb[k].tolist()) for k in range(9)], "id int, batch int, za array<double>, zb array<double>")
    s = retrieval.similarities(df, 10.0)
    n = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    hits, loss = 0, {}
    for b in range(3):
        r = range(b * 4, min(9, b * 4 + 4))
        m = 10 * n(za[r]) @ n(zb[r]).T
        hits += int((m.argmax(axis=1) == np.arange(len(r))).sum())
        ce = lambda x: float(np.mean(np.log(np.exp(x).sum(axis=1)) - np.diag(x)))
        loss[b] = (ce(m) + ce(m.T)) / 2
    got = retrieval.retrieval(s).first()
    assert got.hits == hits and got.n == 9 and got.chance == pytest.approx(3 / 9)
    out = {x.batch: x.loss for x in retrieval.contrastive_loss(s).collect()}
    assert set(out) == {0, 1} and all(out[b] == pytest.approx(loss[b], abs=1e-6) for b in out)
    h = spark.createDataFrame([(1, 0.5), (2, 0.2), (3, 0.2)], "epoch int, v double")
    assert retrieval.best_epoch(h, "v").first().epoch == 2 and retrieval.best_epoch(h, "v", largest=True).first().epoch == 1


def test_pool_is_zero_for_padding_only(spark):
    v = spark.createDataFrame([(2, [1.0, 3.0]), (3, [3.0, 5.0])], "token_id long, v array<double>")
    t = spark.createDataFrame([("a", 2), ("a", 3), ("a", 0)], "sample_id string, token_id long")
    assert retrieval.mean_pool(t, v, 2).first().pooled == [2.0, 4.0]


def test_distributions():
    assert hypothesis.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert hypothesis.f_upper(3.0, 2, 20) == pytest.approx(0.0725464, abs=1e-4)
    assert hypothesis.chi2_upper(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert hypothesis.t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_cohort_pieces(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "b"), (None, "b"), (100.0, "a"), (4.0, "a")], "v double, g string")
    assert {r.g: r.n for r in cohort.frequencies(df, "g").collect()} == {"a": 4, "b": 2}
    assert sum(r.n for r in cohort.histogram(df, "v", 5).collect()) == 5
    box = {r.g: r for r in cohort.box(df, "v", "g").collect()}
    assert box["a"].n_outliers == 1 and box["a"].high == 4.0
    imputed = composition.mean_impute(df.withColumnRenamed("v", "value").withColumnRenamed("g", "feature"))
    assert imputed.where("value is null").count() == 0
    points = spark.createDataFrame([("a", float(x), float(2 * x + (x % 2))) for x in range(8)], "g string, x double, y double")
    e = cohort.ellipses(points, "g", "x", "y").first()
    assert e.cx == 3.5 and e.major > e.minor > 0


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id int, v array<double>")
    pc, share = cohort.pca(df, F.col("v"), "id", 2)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    s = np.linalg.svd(z, full_matrices=False)[1] ** 2
    assert share == pytest.approx((s / s.sum())[:2].tolist())
    assert pc.count() == 60


def test_encoder(spark, cells, features, tmp_path):
    m = tokens.fit(cells, features, "bin", 4, 4)
    p = tokens.padded(m.transform(cells), 4, F.col("val"), spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "sample_id string"))
    shape = encoder.Shape(m.vocab_size, 4, d=8, heads=2, ff=16, n_bins=4)
    w = encoder.initial_weights(shape)
    encoder.save(spark, w, str(tmp_path / "w"))
    back = encoder.load(spark, str(tmp_path / "w"))
    assert all((back[k] == w[k]).all() for k in w)
    out = {r.sample_id: r.embedding for r in encoder.embed(p, back, shape).collect()}
    assert out["none"] == [0.0] * 8 and len(out["a"]) == 8
    ids = np.array([[2, 3, 0, 0]])
    h = encoder.forward(w, shape, ids, np.array([[0, 1, 0, 0]]), np.array([[1, 2, 0, 0]]))
    assert encoder.pool(h, ids)[0] == pytest.approx(out["a"], abs=1) and np.isfinite(h).all()
    longer = encoder.forward(w, shape, ids[:, :2], np.array([[0, 1]]), np.array([[1, 2]]))
    assert h[:, :2] == pytest.approx(longer)
    flat = w | {n: np.zeros_like(w[n]) for n in w if n.startswith("head")}
    selected = np.array([[True, False, False, False]])
    n, loss, hits = encoder.masked_loss(flat, shape, ids, np.array([[0, 1, 0, 0]]), np.array([[1, 2, 0, 0]]), ids, ids, selected)
    assert n == 1 and loss == pytest.approx(math.log(m.vocab_size) + 0.3 * math.log(6)) and hits in (0, 1)


def test_synthetic_is_seeded(spark):
    people = synthetic.samples(spark, 2, 10)
    t = synthetic.taxa(spark, people, 30)
    sums = t.groupBy("sample_id").agg(F.sum("abundance").alias("s")).collect()
    assert len(sums) == 20 and all(r.s == pytest.approx(100) for r in sums)
    again = synthetic.taxa(spark, people.repartition(3), 30)
    assert t.exceptAll(again).count() == 0
    assert synthetic.pathways(t, 12).count() > 0 and synthetic.lineage(spark, 30).count() == 30


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", "S", [(0, 3.0), (1, 1.0), (2, 3.0), (3, 0.0)]), ("b", "S", [(1, 2.0)])]
    schema = "sample_id string, study_name string, cells array<struct<feature_idx:int,abundance:double>>"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    batch = {r.sample_id: r.ids for r in stream.tokenize(df, 3).collect()}
    assert batch == {"a": [2, 4, 3], "b": [3, 0, 0]}
    s = stream.tokenize(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3)
    q = s.writeStream.format("memory").queryName("tok").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.sample_id: r.ids for r in spark.table("tok").collect()} == batch
    timed = df.withColumn("ts", F.lit("2024-01-01 00:10:00").cast("timestamp"))
    assert stream.arrivals(timed).first().n == 2


def test_synthetic_distribution(spark):
    people = synthetic.samples(spark, 3, 40).cache()
    t = synthetic.taxa(spark, people).cache()
    share = people.where("study_condition = 'case'").count() / people.count()
    assert 0.3 < share < 0.6
    assert 0.6 < t.count() / (120 * 180) < 0.7
    sums = synthetic.pathways(t).groupBy("sample_id").agg(F.sum("abundance").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == 120 and all(r.s == pytest.approx(100) for r in sums) and 60 < sum(r.n for r in sums) / 120 < 84
    lin = synthetic.lineage(spark).collect()
    assert len({r.family for r in lin}) == synthetic.FAMILIES and lin[0].taxon == "s__Species_000" and {r.phylum for r in lin} == {f"Phylum_{k}" for k in range(5)}
    sick = spark.range(1).select(synthetic.sick_families(0).alias("s")).first().s
    assert len(set(sick)) == synthetic.SICK_FAMILIES


def test_lineage_from_a_file(spark, features, tmp_path):
    (tmp_path / "taxa_lineage.csv").write_text("phylum,family,taxon\nP1,F1,x\nP1,F2,x\nP2,F3,y\n")
    lin = tables.read_lineage(spark, str(tmp_path / "taxa_lineage.csv"))
    lab = {r.feature: r.label for r in lineage.labels(features, lin).collect()}
    assert lab["x"] == "F1" and lab["y"] == "F3" and lab["z"] == "__unknown__z"
    absent = {r.feature: r.label for r in lineage.labels(features, lin, "genus").collect()}
    assert absent["x"] == "__unknown__x"


def test_tests_with_odd_values(spark):
    rng = np.random.default_rng(1)
    rows = [(f"O'Brien {k % 3}", 1e8 + float(v)) for k, v in enumerate(rng.normal(size=60) + np.arange(60) % 3)]
    df = spark.createDataFrame(rows, "g string, v double")
    by = [np.array([v for g, v in rows if g.endswith(str(k))]) - 1e8 for k in range(3)]
    n, m = np.array([len(x) for x in by]), np.array([x.mean() for x in by])
    f = ((n * (m - np.concatenate(by).mean()) ** 2).sum() / 2) / (sum(((x - x.mean()) ** 2).sum() for x in by) / 57)
    assert hypothesis.anova(df, "v", "g").first().f == pytest.approx(f, rel=1e-5)
    t = (m[0] - m[1]) / np.sqrt(by[0].var(ddof=1) / n[0] + by[1].var(ddof=1) / n[1])
    assert hypothesis.welch(df, "v", "g", "O'Brien 0", "O'Brien 1").first().t == pytest.approx(t, rel=1e-5)


def test_samples_without_tokens_pool_to_zero(spark):
    t = spark.createDataFrame([("a", 2), ("a", 0), ("b", 0)], "sample_id string, token_id long")
    v = spark.createDataFrame([(2, [1.0, 3.0])], "token_id long, v array<double>")
    assert {r.sample_id: r.pooled for r in retrieval.mean_pool(t, v, 2).collect()} == {"a": [1.0, 3.0], "b": [0.0, 0.0]}


def test_split_of_few_studies_has_the_exact_share(spark):
    meta = spark.createDataFrame([(f"s{k}", "a" if k % 2 else "b") for k in range(53)], "sample_id string, study_name string")
    assert splits.split_by_study(meta, val_frac=0.2).where("not is_val").count() == int(53 * 0.8)


@pytest.mark.parametrize("limit", [3, ranking.SORTED])
@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0, 1.0, 9.0], [float(k * k % 37) for k in range(200)], [1e9, *[k / 1e3 for k in range(300)]]])
def test_quantiles_by_ranges(spark, values, monkeypatch, limit):
    monkeypatch.setattr(ranking, "SORTED", limit)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(g, v) for g in ("a", "b") for v in values] + [("c", None)], "g string, v double")
    found = {r.g: r.q for r in ranking.quantiles(df, "v", probs, ["g"]).collect()}
    assert set(found) == {"a", "b"}
    for q in found.values():
        assert q == pytest.approx(np.quantile(values, probs).tolist())
    weighted = df.where("g = 'a'").groupBy("v").count()
    assert ranking.quantiles(weighted, "v", probs, weight="count").first().q == pytest.approx(np.quantile(values, probs).tolist())


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "v double")
    assert [r.q for r in ranking.quantiles(none, "v", [0.5]).collect()] in ([], [[None]])


def test_batches_and_choice(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    b = {r.k: r.batch for r in splits.shuffled_batches(df, "k", 30, 1, 0).collect()}
    again = {r.k: r.batch for r in splits.shuffled_batches(df.repartition(7), "k", 30, 1, 0).collect()}
    other = {r.k: r.batch for r in splits.shuffled_batches(df, "k", 30, 1, 1).collect()}
    assert b == again != other
    assert sorted(b.values()) == [k // 30 for k in range(100)]
    assert splits.choose(df, "k", 7).distinct().count() == 7
    assert splits.choose(df, "k", 500).count() == 100


def test_pairs_out_and_in(spark, tmp_path):
    pairs = spark.createDataFrame([(1, [1.0, 2.0], [3.0]), (2, [4.0, 5.0], [6.0])], "sample_id long, za array<double>, zb array<double>")
    retrieval.export_pairs(pairs, str(tmp_path / "z"))
    back = retrieval.import_pairs(spark, str(tmp_path / "z"))
    assert {r.sample_id: r.v for r in back.collect()} == {1: [1.0, 2.0, 3.0], 2: [4.0, 5.0, 6.0]}
    assert {r.sample_id: len(r.v) for r in evaluate.stack(back, back.where("sample_id = 1")).collect()} == {1: 6}
    assert retrieval.scale_of(1.0) == pytest.approx(np.e) and retrieval.scale_of(9.0) == 100.0


def test_lines_of_report(spark):
    row = spark.createDataFrame([("r", "logreg", 0.5, 0.25, 1.0)], "representation string, classifier string, auc double, brier double, calibration_slope double")
    assert evaluate.lines_of_report(row).first().line == f"{'r':32s} {'logreg':7s} AUC 0.500 | Brier 0.250 | slope 1.00"


def test_attention_by_label():
    labels = np.array([0, 0, 7, 7, 8])
    block = encoder.blocked_by(labels, np.array([[2, 3, 4, 1, 0]]))[0]
    assert block.astype(int).tolist() == [[0, 0, 1, 0, 0], [0, 0, 1, 0, 0], [1, 1, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]]


def test_masked_metrics(spark):
    shape = encoder.Shape(6, 3, d=8, heads=2, ff=16, n_bins=4)
    w = encoder.initial_weights(shape)
    assert not w["token"][0].any() and not w["value"][0].any()
    rows = [([1, 3, 0], [0, 1, 0], [0.0, 2.0, 0.0], [2, 3, 0], [3.0, 2.0, 0.0], [True, False, False])] * 5
    df = spark.createDataFrame(rows, "ids array<long>, ranks array<int>, vals array<double>, target array<long>, value array<double>, selected array<boolean>")
    got = encoder.masked_metrics(df, w, shape, 2).first()
    h = encoder.forward(w, shape, *(np.array([rows[0][k]]) for k in range(3)))[0, 0]
    nll = lambda z, t: np.log(np.exp(z).sum()) - z[t]
    assert got.n == 5 and got.loss == pytest.approx(nll(encoder.linear(h, w, "head.token"), 2) + 0.3 * nll(encoder.linear(h, w, "head.value"), 3))
    assert encoder.masked_metrics(df.limit(0), w, shape).first().loss is None


def test_records_are_not_gathered(spark, tmp_path):
    tables.write_records(spark.range(0, 400, 1, 4), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("part-*"))) == 4 and spark.read.json(str(tmp_path / "r")).count() == 400


def test_pooling_is_not_dealt_by_token(spark):
    t = spark.range(1000).select((F.col("id") % 100).alias("sample_id"), (F.col("id") % 7).alias("token_id"))
    v = spark.range(7).select(F.col("id").alias("token_id"), F.array(F.col("id").cast("double")).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p = retrieval.mean_pool(t, v, 1)
        plan = p._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and p.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
