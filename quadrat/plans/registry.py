"""Registered queries on the star-schema tables, each with the SQL that must give the same rows.

Two abundance views stand for the two modalities: AB, customer by part brand (dense), and AS, customer by
supplier (sparse); the abundance is the quantity ordered. A customer's region is its study.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import ranking, scalars
from quadrat.functions.scratch import fresh, written
from quadrat.operators import boosting, cohort, components, composition, crossval, encoder, evaluate, hypothesis, lineage, retrieval, splits, tokens, training
from quadrat.sources import rdata, tables
from quadrat.streaming import tokens as stream

D = 6
BINS = 10
MAX_LEN = 16


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ordered_lines(spark, sf, *columns):
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_quantity", *columns)
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("sample_id"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def view_ab(spark, sf) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("feature"))
    cells = _ordered_lines(spark, sf, "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    cells = cells.groupBy("sample_id", "feature").agg(F.sum("l_quantity").cast("double").alias("abundance"))
    return cells, tables.features_by_name(part)


def view_as(spark, sf) -> tuple[DataFrame, DataFrame]:
    cells = _ordered_lines(spark, sf, "l_suppkey").groupBy("sample_id", F.col("l_suppkey").alias("feature")).agg(F.sum("l_quantity").cast("double").alias("abundance"))
    return cells, tables.features_by_name(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("feature")))


def numbered(cells: DataFrame, features: DataFrame) -> DataFrame:
    return cells.join(features, "feature")


def _samples(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"))


def _studies(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(n.select("n_nationkey", F.col("r_name").alias("study_name")), F.col("c_nationkey") == F.col("n_nationkey"))


def _rel(spark, sf, view=view_ab):
    cells, features = view(spark, sf)
    return composition.relative(numbered(cells, features)), features


AB = """ab AS (SELECT o_custkey AS sample_id, p_brand AS feature, sum(l_quantity)::DOUBLE AS abundance FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
fb AS (SELECT feature, (row_number() OVER (ORDER BY feature) - 1)::INT AS feature_idx FROM (SELECT DISTINCT p_brand AS feature FROM part)),
rb AS (SELECT sample_id, feature, feature_idx, abundance, abundance / sum(abundance) OVER (PARTITION BY sample_id) AS rel FROM ab JOIN fb USING (feature))"""
SA = """sa AS (SELECT o_custkey AS sample_id, l_suppkey AS feature, sum(l_quantity)::DOUBLE AS abundance FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
fs AS (SELECT feature, (row_number() OVER (ORDER BY feature) - 1)::INT AS feature_idx FROM (SELECT DISTINCT s_suppkey AS feature FROM supplier)),
rs AS (SELECT sample_id, feature, feature_idx, abundance, abundance / sum(abundance) OVER (PARTITION BY sample_id) AS rel FROM sa JOIN fs USING (feature))"""
#: Dense log-ratios of AS: every sample by every feature.
DENSE = SA + """, ep AS (SELECT min(rel) / 2 AS eps FROM rs),
dn AS (SELECT s.sample_id, f.feature, f.feature_idx, coalesce(rs.rel, 0) AS rel, ln(coalesce(rs.rel, 0) + eps) AS lg FROM (SELECT DISTINCT sample_id FROM sa) s CROSS JOIN fs f CROSS JOIN ep LEFT JOIN rs ON rs.sample_id = s.sample_id AND rs.feature = f.feature),
cl AS (SELECT sample_id, feature, feature_idx, rel, round(lg - avg(lg) OVER (PARTITION BY sample_id), 9) AS clr FROM dn)"""
EDGES = DENSE + f""", ed AS (SELECT quantile_cont(clr, [{', '.join(f'{k / BINS}' for k in range(1, BINS))}]) AS edges FROM cl WHERE clr <> 0)"""
TOKENS = f"""tk AS (SELECT sample_id, feature_idx, rank, (feature_idx + 2)::BIGINT AS token_id, clr FROM (SELECT *, (row_number() OVER (PARTITION BY sample_id ORDER BY rel DESC, feature_idx) - 1)::INT AS rank FROM cl WHERE rel > 0) WHERE rank < {MAX_LEN})"""

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# composition


@query(f"WITH {AB} SELECT sample_id, feature, abundance FROM ab")
def abundance_long(spark, sf):
    return view_ab(spark, sf)[0].select("sample_id", "feature", "abundance")


@query(f"WITH {AB} SELECT sample_id, feature, rel FROM rb")
def relative_abundance(spark, sf):
    return _rel(spark, sf)[0].select("sample_id", "feature", "rel")


@query(f"WITH {SA} SELECT min(rel) / 2 AS eps FROM rs WHERE rel > 0")
def half_min_pseudocount(spark, sf):
    return composition.half_min(_rel(spark, sf, view_as)[0])


def _clr(spark, sf, digits=tokens.DIGITS):
    rel, features = _rel(spark, sf, view_as)
    rel = written(rel)  # the pseudocount, the quantiles and the result read it
    model = composition.fit(rel, features)
    return composition.clr(rel, model, digits), model


@query(f"WITH {DENSE} SELECT sample_id, feature, round(clr, {D}) AS clr FROM (SELECT *, lg - avg(lg) OVER (PARTITION BY sample_id) AS clr FROM dn) WHERE rel > 0")
def clr_sparse(spark, sf):
    return _clr(spark, sf, None)[0].select("sample_id", "feature", F.round("clr", D).alias("clr"))


@query(f"WITH {DENSE} SELECT sample_id, round(sum(clr), 4) + 0.0::DOUBLE AS total, count(*) FILTER (rel = 0) AS n_zero, min(clr) AS least FROM cl GROUP BY sample_id HAVING count(*) FILTER (rel = 0) > 0")
def clr_dense_check(spark, sf):
    x, model = _clr(spark, sf)
    zero = composition.zero_cells(x, model)
    seen = x.groupBy("sample_id").agg(F.sum("clr").alias("s"), F.min("clr").alias("m"))
    j = seen.join(zero, "sample_id")
    return j.select("sample_id", (F.round(F.col("s") + F.col("clr") * F.col("n"), 4) + 0.0).alias("total"), F.col("n").cast("long").alias("n_zero"), F.least("m", "clr").alias("least"))


@query(f"WITH {SA}, n AS (SELECT count(*) AS n FROM customer) SELECT feature, count(DISTINCT sample_id) AS n, round(count(DISTINCT sample_id) / any_value(n.n)::DOUBLE, {D}) AS prevalence FROM sa CROSS JOIN n GROUP BY feature")
def feature_prevalence(spark, sf):
    cells, _ = view_as(spark, sf)
    return composition.prevalence(cells, _samples(spark, sf).count()).withColumn("prevalence", F.round("prevalence", D))


@query(f"WITH {SA}, n AS (SELECT count(*) AS n FROM customer), k AS (SELECT feature FROM sa CROSS JOIN n GROUP BY feature HAVING count(DISTINCT sample_id) / any_value(n.n)::DOUBLE >= 0.30) SELECT sample_id, feature, abundance FROM sa WHERE feature IN (SELECT feature FROM k)")
def prevalence_filter(spark, sf):
    cells, _ = view_as(spark, sf)
    return composition.prevalence_filter(cells, _samples(spark, sf).count(), 0.30).select("sample_id", "feature", "abundance")


@query(f"WITH {AB}, k AS (SELECT feature FROM ab GROUP BY feature HAVING stddev_samp(abundance) > 0) SELECT feature, count(*) AS n, round(sum(abundance), 2) AS total FROM ab WHERE feature IN (SELECT feature FROM k) GROUP BY feature")
def zero_variance_filter(spark, sf):
    kept = composition.zero_variance_filter(view_ab(spark, sf)[0], "abundance")
    return kept.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("abundance"), 2).alias("total"))


@query(f"SELECT c_custkey AS sample_id, round(coalesce(v, avg(v) OVER (PARTITION BY feature)), 4) AS value FROM (SELECT c_custkey, c_mktsegment AS feature, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer)")
def mean_impute(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("feature"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("value"))
    return composition.mean_impute(c).select("sample_id", F.round("value", 4).alias("value"))


# alignment and sets


@query(f"WITH {AB}, {SA} SELECT sample_id, count(*) AS n FROM ab WHERE sample_id IN (SELECT sample_id FROM sa) AND sample_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY') GROUP BY sample_id")
def align_samples_semi(spark, sf):
    meta = read(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("sample_id"))
    taxa, *_ = tables.align(view_ab(spark, sf)[0], view_as(spark, sf)[0], meta)
    return taxa.groupBy("sample_id").agg(F.count("*").alias("n"))


@query(f"WITH {AB}, {SA} SELECT sample_id FROM ab INTERSECT SELECT sample_id FROM sa")
def paired_intersect(spark, sf):
    return tables.paired_samples(view_ab(spark, sf)[0], view_as(spark, sf)[0])


@query("WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT o_custkey AS k FROM orders) SELECT 'intersect' AS op, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'union_all', count(*) FROM (SELECT k FROM a UNION ALL SELECT k FROM b)")
def set_ops(spark, sf):
    a = read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    b = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    ops = {"intersect": a.intersect(b), "except": a.subtract(b), "union": a.union(b).distinct(), "union_all": a.unionByName(b)}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n") for name, df in ops.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("WITH f AS (SELECT o_custkey, first(o_orderpriority ORDER BY o_orderkey) AS priority FROM orders GROUP BY 1) SELECT c_custkey AS sample_id, priority FROM customer LEFT JOIN f ON c_custkey = o_custkey")
def lookup_match(spark, sf):
    table = read(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("priority"), "o_orderkey")
    return cohort.lookup(_samples(spark, sf), table, "sample_id", "priority", "o_orderkey").select("sample_id", "priority")


@query(f"WITH {AB} SELECT sample_id, " + ", ".join(f"coalesce(sum(abundance) FILTER (feature = 'Brand#{i}{j}'), 0)::DOUBLE AS \"Brand#{i}{j}\"" for i in range(1, 6) for j in range(1, 6)) + " FROM ab GROUP BY sample_id")
def wide_pivot(spark, sf):
    return tables.to_wide(view_ab(spark, sf)[0], [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)])


@query("SELECT s_suppkey AS sample_id, feature, abundance FROM (SELECT s_suppkey, 'balance' AS feature, s_acctbal AS abundance FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier) WHERE abundance > 0")
def wide_unpivot(spark, sf):
    wide = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return tables.to_cells(wide)


# tokens


@query(f"WITH {AB} SELECT sample_id, rank, (feature_idx + 2)::BIGINT AS token_id FROM (SELECT *, (row_number() OVER (PARTITION BY sample_id ORDER BY rel DESC, feature_idx) - 1)::INT AS rank FROM rb) WHERE rank < {MAX_LEN}")
def rank_tokens(spark, sf):
    return tokens.rank(_rel(spark, sf)[0], MAX_LEN).select("sample_id", "rank", "token_id")


@query(f"WITH {AB}, t AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY rel DESC, feature_idx) AS r, feature_idx + 2 AS id FROM rb), s AS (SELECT sample_id, string_agg(id, ',' ORDER BY r) AS ids, count(*) AS n FROM t WHERE r <= {MAX_LEN} GROUP BY sample_id) SELECT c_custkey AS sample_id, CASE WHEN n IS NULL THEN '' ELSE ids || CASE WHEN n < {MAX_LEN} THEN ',' ELSE '' END END || array_to_string(list_transform(range({MAX_LEN} - coalesce(n, 0)), lambda x: '0'), ',') AS ids, coalesce(n, 0)::INT AS n_tokens FROM customer LEFT JOIN s ON c_custkey = sample_id")
def rank_tokens_padded(spark, sf):
    t = tokens.rank(_rel(spark, sf)[0], MAX_LEN)
    p = tokens.padded(t, MAX_LEN, samples=_samples(spark, sf))
    return p.select("sample_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n_tokens")


@query(f"WITH {EDGES} SELECT (generate_subscripts(edges, 1))::INT AS k, round(unnest(edges), 9) AS edge FROM ed")
def bin_edges(spark, sf):
    x, model = _clr(spark, sf)
    e = tokens.bin_edges(x, model, BINS).select(F.posexplode("edges").alias("k", "edge"))
    return e.select((F.col("k") + 1).alias("k"), F.round("edge", 9).alias("edge"))


@query(f"WITH {EDGES}, {TOKENS} SELECT sample_id, rank, token_id, (len(list_filter(edges, lambda e: round(e, 9) <= clr)) + 1)::INT AS bin FROM tk CROSS JOIN ed")
def bin_tokens(spark, sf):
    # edges are rounded like the values, so that a last digit of an edge decides nothing
    x, model = _clr(spark, sf)
    edges = [round(e, tokens.DIGITS) for e in tokens.bin_edges(x, model, BINS).first().edges]
    return tokens.bins(tokens.rank(x, MAX_LEN), edges).select("sample_id", "rank", "token_id", "bin")


@query(f"WITH {DENSE}, {TOKENS}, m AS (SELECT avg(clr) AS mean, stddev_pop(clr) + 1e-8 AS std FROM tk WHERE clr <> 0) SELECT sample_id, rank, token_id, round(CASE WHEN clr = 0 THEN 0 ELSE (clr - mean) / std END, 5) + 0.0::DOUBLE AS val FROM tk CROSS JOIN m")
def cont_tokens(spark, sf):
    cells, features = view_as(spark, sf)
    cells = written(numbered(cells, features))
    model = tokens.fit(cells, features, "cont", MAX_LEN)
    return model.transform(cells).select("sample_id", "rank", "token_id", (F.round("val", 5) + 0.0).alias("val"))


@query(f"WITH {AB}, t AS (SELECT *, (row_number() OVER (PARTITION BY sample_id ORDER BY rel DESC, feature_idx) - 1)::INT AS rank FROM rb), u AS (SELECT sample_id, rank, (feature_idx + 2)::BIGINT AS target, ((sample_id * 7919 + rank * 104729 + 17) % 10007) / 10007.0::DOUBLE < 0.15 AS s FROM t WHERE rank < {MAX_LEN}), v AS (SELECT *, s OR (NOT bool_or(s) OVER (PARTITION BY sample_id) AND rank = 0) AS selected FROM u) SELECT sample_id, rank, target, selected, CASE WHEN selected THEN 1 ELSE target END::BIGINT AS token_id FROM v")
def mask_tokens(spark, sf):
    t = tokens.rank(_rel(spark, sf)[0], MAX_LEN).withColumn("val", F.lit(0.0))
    draw = F.expr("((sample_id * 7919 + rank * 104729 + 17) % 10007) / 10007.0D")
    return tokens.mask(t, draw).select("sample_id", "rank", "target", "selected", "token_id")


@query(f"WITH {AB}, t AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY abundance DESC, feature_idx) AS r, feature_idx + 2 AS id FROM rb), s AS (SELECT sample_id, string_agg(id, ',' ORDER BY r) AS ids, count(*) AS n FROM t WHERE r <= {MAX_LEN} GROUP BY sample_id) SELECT sample_id, ids || CASE WHEN n < {MAX_LEN} THEN ',' ELSE '' END || array_to_string(list_transform(range({MAX_LEN} - n), lambda x: '0'), ',') AS ids FROM s")
def stream_rank_array(spark, sf):
    rel, _ = _rel(spark, sf)
    cells = rel.groupBy("sample_id").agg(F.collect_list(F.struct("feature_idx", "abundance")).alias("cells"))
    return stream.tokenize(cells, MAX_LEN).select("sample_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


# lineage


def _lineage(spark, sf):
    s, n, r = read(spark, sf, "supplier"), read(spark, sf, "nation"), read(spark, sf, "region")
    x = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.select(F.col("s_suppkey").alias("taxon"), F.col("s_name").alias("species"), F.col("n_name").alias("family"), F.col("r_name").alias("phylum"), F.col("s_suppkey").alias("src_row"))


LIN = "ln AS (SELECT s_suppkey AS taxon, s_name AS species, n_name AS family, r_name AS phylum FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query("WITH l AS (SELECT s_nationkey AS taxon, s_name, s_suppkey FROM supplier) SELECT taxon, first(s_name ORDER BY s_suppkey) AS species FROM l GROUP BY taxon")
def lineage_dedup(spark, sf):
    l = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("taxon"), F.col("s_name").alias("species"), F.col("s_suppkey").alias("src_row"))
    return lineage.first_per_key(l).select("taxon", "species")


@query("SELECT s_suppkey AS taxon, 'Life' AS kingdom, r_name AS phylum, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name END AS family, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS species FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lineage_parse(spark, sf):
    parts = [F.lit("k__Life"), F.concat(F.lit("p__"), "phylum"), F.concat(F.lit("f__"), F.when(F.col("taxon") % 3 == 0, "").otherwise(F.col("family"))), F.when(F.col("taxon") % 5 != 0, F.concat(F.lit("s__"), "species"))]
    text = _lineage(spark, sf).select("taxon", F.concat_ws("|", *parts).alias("text"))
    ranks = scalars.parse_lineage(F.col("text"))
    return text.select("taxon", *[ranks[r].alias(r) for r in ("kingdom", "phylum", "family", "species")])


def _labels(spark, sf, level="family"):
    features = view_as(spark, sf)[1]
    return lineage.labels(features, _lineage(spark, sf).where("taxon % 10 <> 0"), level)


LAB = f"{LIN}, lb AS (SELECT feature_idx, feature, coalesce(family, '__unknown__' || feature) AS label FROM fs LEFT JOIN (SELECT * FROM ln WHERE taxon % 10 <> 0) ON taxon = feature)"


@query(f"WITH {SA}, {LAB} SELECT feature_idx, feature, label FROM lb")
def lineage_labels(spark, sf):
    return _labels(spark, sf)


@query(f"WITH {SA}, {LAB} SELECT round((SELECT count(*) FROM lb a JOIN lb b USING (label)) / ((SELECT count(*) FROM lb) ** 2)::DOUBLE, 9) AS density")
def adjacency_density(spark, sf):
    return lineage.density(_labels(spark, sf)).select(F.round("density", 9).alias("density"))


@query(f"WITH {SA}, {LAB} SELECT a.feature_idx AS i, b.feature_idx AS j FROM lb a JOIN lb b USING (label)")
def adjacency_pairs(spark, sf):
    return lineage.adjacency(_labels(spark, sf))


@query(f"WITH {SA}, {LAB}, t AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY rel DESC, feature_idx) - 1 AS rank FROM rs), u AS (SELECT sample_id, rank, label FROM t JOIN lb USING (feature_idx) WHERE rank < {MAX_LEN}) SELECT a.sample_id, count(*) FILTER (a.label = b.label) AS n_allowed, count(*) AS n_pairs FROM u a JOIN u b USING (sample_id) GROUP BY 1")
def attention_counts(spark, sf):
    return lineage.attention_counts(tokens.rank(_rel(spark, sf, view_as)[0], MAX_LEN), _labels(spark, sf))


@query(f"WITH {SA}, {LAB}, t AS (SELECT *, (row_number() OVER (PARTITION BY sample_id ORDER BY rel DESC, feature_idx) - 1)::INT AS rank FROM rs), u AS (SELECT sample_id, rank, label, rank % 4 <> 0 AS real FROM t JOIN lb USING (feature_idx) WHERE rank < {MAX_LEN}) SELECT a.sample_id, a.rank AS i, b.rank AS j, (a.real AND b.real AND a.label = b.label) OR NOT a.real OR a.rank = b.rank OR NOT b.real AS allowed FROM u a JOIN u b USING (sample_id)")
def attention_allowed(spark, sf):
    t = tokens.rank(_rel(spark, sf, view_as)[0], MAX_LEN)
    masked = t.withColumn("token_id", F.when(F.col("rank") % 4 == 0, F.lit(tokens.MASK)).otherwise(F.col("token_id")).cast("long"))
    return lineage.attention(masked.select("sample_id", "rank", "token_id"), _labels(spark, sf))


# splits


STUDY = "st AS (SELECT c_custkey AS sample_id, c_acctbal, c_mktsegment, r_name AS study_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {STUDY}, h AS (SELECT study_name FROM (SELECT DISTINCT study_name FROM st) ORDER BY md5('0:' || study_name) LIMIT 1) SELECT sample_id, study_name AS study, study_name IN (SELECT study_name FROM h) AS is_val FROM st")
def group_split(spark, sf):
    return splits.split_by_study(_studies(spark, sf))


@query(f"WITH {STUDY} SELECT study_name, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, study_name) - 1)::INT AS fold FROM st GROUP BY study_name")
def group_kfold(spark, sf):
    return splits.group_folds(_studies(spark, sf), "study_name")


# evaluation


def _scores(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "n_chars", "source")
    x = read(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")).join(d, "doc_id")
    return x.select(F.col("doc_id").alias("sample_id"), "y", F.least(F.col("n_chars") / F.lit(20000.0), F.lit(1.0)).alias("p"), F.col("source").alias("grp"))


SCORES = "sc AS (SELECT doc_id AS sample_id, quality AS y, least(n_chars / 20000.0::DOUBLE, 1.0::DOUBLE) AS p, source AS grp FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {SCORES}, c AS (SELECT sum((a.p > b.p)::INT + (a.p = b.p)::INT / 2.0::DOUBLE) AS w, count(*) AS n FROM sc a JOIN sc b ON a.y = 1 AND b.y = 0) SELECT round(w / n, 9) AS auc FROM c")
def auc_by_rank(spark, sf):
    return evaluate.auc(_scores(spark, sf)).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {SCORES} SELECT round(avg((p - y) ** 2), 9) AS brier FROM sc")
def brier_score(spark, sf):
    return evaluate.brier(_scores(spark, sf)).select(F.round("brier", 9).alias("brier"))


@query(f"WITH {SCORES} SELECT count(*) AS n, count(DISTINCT grp) AS n_groups, sum(y)::BIGINT AS n_pos, round(avg(y), 9) AS rate, sum(y) < 10 OR count(*) - sum(y) < 10 AS too_few FROM sc")
def label_summary(spark, sf):
    n, pos = F.count("*"), F.sum("y")
    return _scores(spark, sf).agg(n.alias("n"), F.count_distinct("grp").alias("n_groups"), pos.alias("n_pos"), F.round(F.avg("y"), 9).alias("rate"), ((pos < 10) | (n - pos < 10)).alias("too_few"))


#: Newton steps on lists of the logits and labels.
NEWTON = """RECURSIVE {scores}, xy AS (SELECT list(ln(q / (1 - q))) AS xs, list(y::DOUBLE) AS ys FROM (SELECT y, greatest(least(p, 0.999999), 0.000001)::DOUBLE AS q FROM sc)),
nt AS (SELECT 0 AS k, 0::DOUBLE AS a, 0::DOUBLE AS b UNION ALL
SELECT k + 1, a + (g * u - f * v) / (e * g - f * f), b + (e * v - f * u) / (e * g - f * f) FROM (
SELECT k, a, b, list_sum(h) AS e, list_dot_product(h, xs) AS f, list_dot_product(h, list_transform(xs, lambda x: x * x)) AS g, list_sum(r) AS u, list_dot_product(r, xs) AS v FROM (
SELECT k, a, b, xs, list_transform(p, lambda q: q * (1 - q)) AS h, list_transform(list_zip(ys, p), lambda z: z[1] - z[2]) AS r FROM (
SELECT k, a, b, xs, ys, list_transform(xs, lambda x: 1 / (1 + exp(-(a + b * x)))) AS p FROM nt CROSS JOIN xy WHERE k < 20))))"""


@query(f"WITH {NEWTON.format(scores=SCORES)} SELECT round(a, 6) AS intercept, round(b, 6) AS slope FROM nt WHERE k = 20")
def calibration_slope(spark, sf):
    a, b = evaluate.calibration(_scores(spark, sf))
    return spark.createDataFrame([(a, b)], "intercept double, slope double").select(F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"))


def _vectors(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return e.select("id", F.floor(F.col("id") / 32).cast("int").alias("batch"), F.slice("embedding", 1, 32).alias("za"), F.slice("embedding", 33, 32).alias("zb"))


SIMS = "z AS (SELECT vec_id AS id, floor(vec_id / 32)::INT AS batch, embedding[1:32]::DOUBLE[] AS za, embedding[33:64]::DOUBLE[] AS zb FROM embeddings), sm AS (SELECT a.batch, a.id AS i, b.id AS j, round(list_dot_product(a.za, b.zb) / (sqrt(list_dot_product(a.za, a.za)) * sqrt(list_dot_product(b.zb, b.zb))) * {scale}, 7) AS sim FROM z a JOIN z b USING (batch))"


def _sims(spark, sf, scale=1.0):
    return retrieval.similarities(_vectors(spark, sf), scale).withColumn("sim", F.round("sim", 7))


@query(f"WITH {SIMS.format(scale='1')}, t AS (SELECT *, row_number() OVER (PARTITION BY batch, i ORDER BY sim DESC, j) AS r FROM sm) SELECT sum((i = j)::INT)::BIGINT AS hits, count(*) AS n, round(avg((i = j)::INT), 9) AS accuracy, round(count(DISTINCT batch) / count(*)::DOUBLE, 9) AS chance FROM t WHERE r = 1")
def inbatch_retrieval(spark, sf):
    return retrieval.retrieval(_sims(spark, sf)).select("hits", "n", F.round("accuracy", 9).alias("accuracy"), F.round("chance", 9).alias("chance"))


@query(f"WITH {SIMS.format(scale='14')}, l AS (SELECT batch, i, j, ln(sum(exp(sim)) OVER (PARTITION BY batch, i)) - sim AS a, ln(sum(exp(sim)) OVER (PARTITION BY batch, j)) - sim AS b FROM sm) SELECT batch, count(*) AS n, round((avg(a) + avg(b)) / 2, 5) AS loss FROM l WHERE i = j GROUP BY batch HAVING count(*) >= 2")
def contrastive_loss(spark, sf):
    return retrieval.contrastive_loss(_sims(spark, sf, 14.0)).select("batch", "n", F.round("loss", 5).alias("loss"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / n, 6) AS first, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / (n * n), 6) AS square FROM (SELECT *, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def l2_normalize(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", scalars.l2_normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(scalars.dot(F.col("v"), F.col("v")), 6).alias("square"))


@query(f"WITH {AB}, t AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY rel DESC, feature_idx) AS r FROM rb), u AS (SELECT sample_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM t JOIN embeddings ON vec_id = feature_idx + 2 WHERE r <= {MAX_LEN}), p AS (SELECT sample_id, d, round(avg(x::DOUBLE) * 1000000)::BIGINT AS m FROM u GROUP BY ALL) SELECT sample_id, string_agg(m::VARCHAR, ',' ORDER BY d) AS pooled FROM p GROUP BY 1")
def mean_pool(spark, sf):
    rel, features = _rel(spark, sf)
    vocabulary = features.select((F.col("feature_idx") + tokens.FIRST).cast("long").alias("token_id"))
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("v")).join(F.broadcast(vocabulary), "token_id", "left_semi")
    p = retrieval.mean_pool(tokens.rank(rel, MAX_LEN).select("sample_id", "token_id"), v, 64)
    return p.select("sample_id", F.array_join(F.transform("pooled", lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("pooled"))


# cohort statistics


@query("SELECT count(*) AS n_rows, count(DISTINCT c_nationkey) AS n_subjects, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer")
def cohort_summary(spark, sf):
    return cohort.summary(read(spark, sf, "customer"), "c_acctbal", "c_nationkey").withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def freq_table(spark, sf):
    return cohort.frequencies(read(spark, sf, "customer"), "c_mktsegment")


@query("WITH r AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 25 AS w FROM customer), b AS (SELECT least(floor((c_acctbal - lo) / w), 24)::INT AS bin, lo, w FROM customer CROSS JOIN r) SELECT bin, round(any_value(lo + bin * w), 4) AS low, count(*) AS n FROM b GROUP BY bin")
def histogram(spark, sf):
    return cohort.histogram(read(spark, sf, "customer"), "c_acctbal").withColumn("low", F.round("low", 4))


@query("WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1), x AS (SELECT *, c_acctbal >= q1 - 1.5 * (q3 - q1) AND c_acctbal <= q3 + 1.5 * (q3 - q1) AS i FROM customer JOIN q USING (c_mktsegment)) SELECT c_mktsegment, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3, min(c_acctbal) FILTER (i) AS low, max(c_acctbal) FILTER (i) AS high, count(*) FILTER (NOT i) AS n_outliers FROM x GROUP BY 1")
def boxplot_stats(spark, sf):
    b = cohort.box(read(spark, sf, "customer"), "c_acctbal", "c_mktsegment")
    return b.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("WITH g AS (SELECT c_mktsegment AS s, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), x AS (SELECT a.m - b.m AS d, a.v / a.n AS e, b.v / b.n AS f, a.n AS n, b.n AS k FROM g a JOIN g b ON a.s = 'BUILDING' AND b.s = 'MACHINERY') SELECT round(d / sqrt(e + f), 6) AS t, round((e + f) ** 2 / (e ** 2 / (n - 1) + f ** 2 / (k - 1)), 4) AS df FROM x")
def welch_t(spark, sf):
    return hypothesis.welch(read(spark, sf, "customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY").select(F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query("WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(v * (n - 1)) AS w, sum(n * (m - (SELECT avg(c_acctbal) FROM customer)) ** 2) AS b FROM g) SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS f, (k - 1)::BIGINT AS df1, (n - k)::BIGINT AS df2 FROM t")
def anova_f(spark, sf):
    return hypothesis.anova(read(spark, sf, "customer"), "c_acctbal", "c_mktsegment").withColumn("f", F.round("f", 5))


@query("WITH x AS (SELECT c_mktsegment AS g, floor(c_acctbal / 10) AS v FROM customer), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM x), s AS (SELECT g, count(*) AS n, sum(r) AS r FROM r GROUP BY g), t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::HUGEINT AS c FROM x GROUP BY v)), u AS (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(r * r / n) AS q FROM s) SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 5) AS h, (k - 1)::BIGINT AS df FROM u CROSS JOIN t")
def kruskal_h(spark, sf):
    x = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), F.floor(F.col("c_acctbal") / 10).cast("double").alias("v"))
    return hypothesis.kruskal(x, "v", "g").withColumn("h", F.round("h", 5))


def _simpson(density: str, to: str, n: int = 4000) -> str:
    """SQL of the integral of a density in x from 0 to ``to``."""
    return f"list_sum(list_transform(range(0, {n + 1}), lambda i: (CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density.replace('{x}', f'({to} * i / {n}::DOUBLE)')})) * {to} / {3 * n}::DOUBLE"


DENSITIES = {
    "t": "exp(lgamma((df + 1) / 2.0::DOUBLE) - lgamma(df / 2.0::DOUBLE)) / sqrt(df * pi()) * (1 + {x} ** 2 / df) ** (-(df + 1) / 2.0::DOUBLE)",
    "f": "exp(lgamma((a + b) / 2.0::DOUBLE) - lgamma(a / 2.0::DOUBLE) - lgamma(b / 2.0::DOUBLE)) * (a / b::DOUBLE) ** (a / 2.0::DOUBLE) * {x} ** (a / 2.0::DOUBLE - 1) * (1 + a * {x} / b) ** (-(a + b) / 2.0::DOUBLE)",
    "chi2": "{x} ** (df / 2.0::DOUBLE - 1) * exp(-{x} / 2) / (2 ** (df / 2.0::DOUBLE) * exp(lgamma(df / 2.0::DOUBLE)))",
}
P_VALUES = f"""WITH g AS (SELECT c_mktsegment AS s, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1),
w AS (SELECT abs(d) / sqrt(e + f) AS s, (e + f) ** 2 / (e ** 2 / (n - 1) + f ** 2 / (k - 1)) AS df FROM (SELECT a.m - b.m AS d, a.v / a.n AS e, b.v / b.n AS f, a.n AS n, b.n AS k FROM g a JOIN g b ON a.s = 'BUILDING' AND b.s = 'MACHINERY')),
o AS (SELECT (t.b / (k - 1)) / (w / (n - k)) AS s, (k - 1)::DOUBLE AS a, (n - k)::DOUBLE AS b FROM (SELECT count(*) AS k, sum(n) AS n, sum(v * (n - 1)) AS w, sum(n * (m - (SELECT avg(c_acctbal) FROM customer)) ** 2) AS b FROM g) t),
r AS (SELECT c_mktsegment AS g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0::DOUBLE AS r FROM customer),
x AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::HUGEINT AS c FROM customer GROUP BY c_acctbal)),
q AS (SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS s, (k - 1)::DOUBLE AS df FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(r * r / n) AS q FROM (SELECT count(*) AS n, sum(r) AS r FROM r GROUP BY g)) CROSS JOIN x)
SELECT 'welch' AS test, round(1 - 2 * {_simpson(DENSITIES["t"], "s")}, 6) AS p FROM w
UNION ALL SELECT 'anova', round(1 - {_simpson(DENSITIES["f"], "s")}, 6) FROM o
UNION ALL SELECT 'kruskal', round(1 - {_simpson(DENSITIES["chi2"], "s")}, 6) FROM q"""


@query(P_VALUES)
def test_p_values(spark, sf):
    c = read(spark, sf, "customer")
    w = hypothesis.welch(c, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY").select(F.lit("welch").alias("test"), hypothesis.p_value("t", F.col("t"), F.col("df")).alias("p"))
    a = hypothesis.anova(c, "c_acctbal", "c_mktsegment").select(F.lit("anova").alias("test"), hypothesis.p_value("f", F.col("f"), F.col("df1").cast("double"), F.col("df2").cast("double")).alias("p"))
    k = hypothesis.kruskal(c, "c_acctbal", "c_mktsegment").select(F.lit("kruskal").alias("test"), hypothesis.p_value("chi2", F.col("h"), F.col("df").cast("double")).alias("p"))
    return w.union(a).union(k).select("test", F.round("p", 6).alias("p"))


def _leading(k: int, squarings: int = 24) -> str:
    """SQL of the k-th eigenvalue and vector of the matrix left after k - 1: squared until one vector is left of it, then taken away."""
    m, power = f"m{k}", f"w{k}"
    return f"""{power} AS (SELECT 0 AS n, m AS w FROM {m} UNION ALL SELECT n + 1, list_transform(s, lambda row: list_transform(row, lambda x: x / t)) FROM (
SELECT n, s, list_sum(list_transform(range(1, len(s) + 1), lambda i: s[i][i])) AS t FROM (SELECT n, list_transform(w, lambda a: list_transform(w, lambda b: list_dot_product(a, b))) AS s FROM {power} WHERE n < {squarings}))),
u{k} AS (SELECT list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS v FROM (SELECT list_transform(w, lambda row: row[(list_position(d, list_max(d)))::INT]) AS c FROM (SELECT w, list_transform(range(1, len(w) + 1), lambda i: w[i][i]) AS d FROM {power} WHERE n = {squarings}))),
e{k} AS (SELECT v, list_dot_product(v, list_transform(m, lambda row: list_dot_product(row, v))) AS l FROM u{k} CROSS JOIN {m}),
m{k + 1} AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM {m} CROSS JOIN e{k})"""


def _components(values: str) -> str:
    """SQL of centred and scaled columns of (id, d, x), their correlations, and the three leading components of these."""
    return f"""RECURSIVE {values},
sd AS (SELECT id, d, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM lg WINDOW w AS (PARTITION BY d)),
co AS (SELECT d, list(z ORDER BY id) AS c, count(*) AS n FROM sd GROUP BY d),
m1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT a.d AS i, list(list_dot_product(a.c, b.c) / (a.n - 1) ORDER BY b.d) AS r FROM co a CROSS JOIN co b GROUP BY a.d)),
{_leading(1)}, {_leading(2)}, {_leading(3)},
zz AS (SELECT id, list(z ORDER BY d) AS z FROM sd GROUP BY id)"""


COMPONENTS = _components("lg AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)")


@query(f"WITH {COMPONENTS} SELECT pc, round(l / (SELECT len(m) FROM m1), 6) AS share FROM (SELECT 1 AS pc, l FROM e1 UNION ALL SELECT 2, l FROM e2 UNION ALL SELECT 3, l FROM e3)")
def pca_variance(spark, sf):
    _, share = cohort.pca(read(spark, sf, "embeddings"), F.col("embedding"), "vec_id")
    return spark.createDataFrame([(k + 1, v) for k, v in enumerate(share)], "pc int, share double").withColumn("share", F.round("share", 6))


@query("SELECT c_mktsegment, n, (row_number() OVER (ORDER BY n DESC, c_mktsegment))::INT AS place, printf('%d (%.1f%%)', n, 100 * n / (sum(n) OVER ())::DOUBLE) AS label FROM (SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1)")
def bar_counts(spark, sf):
    return cohort.bars(read(spark, sf, "customer"), "c_mktsegment")


@query(f"WITH {COMPONENTS} SELECT vec_id, label, round(abs(list_dot_product(z, e1.v)), 6) AS pc1, round(abs(list_dot_product(z, e2.v)), 6) AS pc2 FROM zz JOIN embeddings ON vec_id = id CROSS JOIN e1 CROSS JOIN e2")
def pca_scatter(spark, sf):
    # signs of components are arbitrary: magnitudes are shown
    scores, _ = cohort.pca(read(spark, sf, "embeddings"), F.col("embedding"), "vec_id", 2)
    meta = read(spark, sf, "embeddings").select("vec_id", "label")
    x = cohort.with_metadata(scores, meta, "vec_id")
    return x.select("vec_id", "label", F.round(F.abs("pc1"), 6).alias("pc1"), F.round(F.abs("pc2"), 6).alias("pc2"))


@query("SELECT vec_id, round(coalesce(ln(q / (1 - q)), 0), 6) + 0.0::DOUBLE AS logit, q AS clipped FROM (SELECT vec_id, greatest(least(embedding[1]::DOUBLE, 0.999999), 0.000001)::DOUBLE AS q FROM embeddings)")
def logit_clip(spark, sf):
    p = F.col("embedding")[0].cast("double")
    x = read(spark, sf, "embeddings")
    return x.select("vec_id", (F.round(scalars.logit(p), 6) + 0.0).alias("logit"), scalars.clip(p, 1e-6, 1 - 1e-6).alias("clipped"))


@query("SELECT c_custkey AS sample_id, (c_mktsegment IS NOT NULL AND c_mktsegment = 'BUILDING')::INT AS y FROM customer")
def positive_labels(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), scalars.positive_label(F.col("c_mktsegment"), "BUILDING").alias("y"))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 64)::INT AS batch FROM orders")
def ordered_batches(spark, sf):
    x = read(spark, sf, "orders").select(F.col("o_orderkey"), F.col("o_orderkey").cast("double").alias("place"))
    return ranking.batch_numbers(x, "place", 64).select("o_orderkey", "batch")


DRAW = "('0x' || substr(md5('{seed}:{epoch}:' || c_custkey), 1, 13))::BIGINT"


@query(f"SELECT c_custkey AS sample_id, ((row_number() OVER (ORDER BY {DRAW.format(seed=3, epoch=2)}) - 1) // 64)::INT AS batch FROM customer")
def shuffled_batches(spark, sf):
    return splits.shuffled_batches(_samples(spark, sf), "sample_id", 64, seed=3, epoch=2)


@query(f"SELECT c_custkey AS sample_id FROM customer ORDER BY {DRAW.format(seed=5, epoch=0)} LIMIT 40")
def choose_samples(spark, sf):
    # forty distinct samples are what the operator is asked for
    return splits.choose(_samples(spark, sf), "sample_id", 40, seed=5)


@query(f"WITH l AS (SELECT batch, count(*) AS n, (avg(a) + avg(b)) / 2 AS loss FROM (WITH {SIMS.format(scale='14')} SELECT batch, i, j, ln(sum(exp(sim)) OVER (PARTITION BY batch, i)) - sim AS a, ln(sum(exp(sim)) OVER (PARTITION BY batch, j)) - sim AS b FROM sm) WHERE i = j GROUP BY batch HAVING count(*) >= 2) SELECT round(sum(loss * n) / greatest(sum(n), 1), 5) AS loss, arg_min(batch, (round(loss, 5), batch)) AS best FROM l")
def epoch_means(spark, sf):
    losses = retrieval.contrastive_loss(_sims(spark, sf, 14.0))
    best = retrieval.best_epoch(losses.select(F.col("batch").alias("epoch"), F.round("loss", 5).alias("loss")), "loss")
    return retrieval.weighted_mean(losses).select(F.round("loss", 5).alias("loss")).join(best.select(F.col("epoch").alias("best")))


@query("SELECT vec_id AS sample_id, round(list_dot_product(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[]), 6) + 0.0::DOUBLE AS product FROM embeddings")
def pair_by_key(spark, sf):
    v = _vectors(spark, sf)
    x = retrieval.pair(v.select(F.col("id").alias("sample_id"), "za"), v.select(F.col("id").alias("sample_id"), "zb"))
    return x.select("sample_id", (F.round(scalars.dot(F.col("za"), F.col("zb")), 6) + 0.0).alias("product"))


@query("SELECT a.vec_id AS sample_id, 128 AS n_features, round(2 * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS square FROM embeddings a")
def stacked_vectors(spark, sf):
    v = _vectors(spark, sf)
    both = v.select(F.col("id").alias("sample_id"), F.concat("za", "zb").cast("array<double>").alias("v"))
    x = evaluate.stack(both, both)
    return x.select("sample_id", F.size("v").alias("n_features"), F.round(scalars.dot(F.col("v"), F.col("v")), 5).alias("square"))


# models


def _cases(spark, sf):
    """Log-ratios of AB as columns, with study and label."""
    cells, features = view_ab(spark, sf)
    rel = composition.relative(numbered(cells, features))
    x = composition.clr(rel, composition.fit(rel, features))
    n = features.count()
    wide = x.groupBy("sample_id").pivot("feature_idx", list(range(n))).agg(F.first("clr")).join(x.groupBy("sample_id").agg(F.first("clr_zero").alias("z")), "sample_id")
    columns = [f"x{k}" for k in range(n)]
    wide = wide.select("sample_id", *[F.coalesce(F.col(f"`{k}`"), F.col("z")).alias(f"x{k}") for k in range(n)])
    meta = _studies(spark, sf).select("sample_id", F.col("study_name").alias("grp"), scalars.positive_label(F.col("c_mktsegment"), "BUILDING").alias("y"))
    return wide.join(meta, "sample_id"), columns


@query()
def logreg_oof(spark, sf):
    df, columns = _cases(spark, sf)
    return evaluate.out_of_fold(df, columns)


@query()
def grouped_eval(spark, sf):
    df, columns = _cases(spark, sf)
    return evaluate.report(evaluate.out_of_fold(df, columns), "baseline_CLR", "logreg", len(columns))


def _encoded(spark, sf, view, samples=None):
    """Token arrays of a view, the tokenizer and the encoder's shape."""
    cells, features = view(spark, sf)
    cells = written(numbered(cells, features))
    model = tokens.fit(cells, features, "bin", MAX_LEN)
    padded = tokens.padded(model.transform(cells), MAX_LEN, F.col("val"), samples)
    return padded, encoder.Shape(model.vocab_size, MAX_LEN)


#: Rounds and batches that a query takes some seconds for; the trainer's defaults are 20 epochs and batches of 32.
TRAINING = training.Options(epochs=3, batch=256)


def _pretrained(spark, sf):
    """Token arrays of AB for all samples, shape, history and the weights with the least validation loss."""
    padded, shape = _encoded(spark, sf, view_ab, _samples(spark, sf))
    padded = written(padded)
    split = splits.split_by_study(_studies(spark, sf)).select("sample_id", "is_val")
    history, weights = training.pretrain(padded.join(split, "sample_id"), shape, fresh(spark), TRAINING)
    return padded, shape, history, weights


def _aligned(spark, sf):
    """Paired token arrays of AB and AS, history and the unit vectors of both."""
    (a, shape_a), (b, shape_b) = _encoded(spark, sf, view_ab), _encoded(spark, sf, view_as)
    both = [x.select("sample_id", *[F.col(c).alias(f"{c}_{side}") for c in ("ids", "ranks", "vals")]) for x, side in ((a, "a"), (b, "b"))]
    pairs = written(both[0].join(both[1], "sample_id").join(splits.split_by_study(_studies(spark, sf)).select("sample_id", "is_val"), "sample_id"))
    history, weights = training.align(pairs, shape_a, shape_b, fresh(spark), TRAINING)
    return history, training.project(pairs, shape_a, shape_b, weights)


@query()
def masked_pretrain(spark, sf):
    return _pretrained(spark, sf)[2]


@query()
def crossmodal_history(spark, sf):
    return _aligned(spark, sf)[0]


@query(f"WITH {AB} SELECT DISTINCT sample_id, 128 AS n_features, 2.0::DOUBLE AS square FROM ab")
def exported_pairs(spark, sf):
    # written, read again and joined to the samples by key
    path = fresh(spark)
    retrieval.export_pairs(_aligned(spark, sf)[1], path)
    x = _samples(spark, sf).join(retrieval.import_pairs(spark, path), "sample_id")
    return x.select("sample_id", F.size("v").alias("n_features"), F.round(scalars.dot(F.col("v"), F.col("v")), 6).alias("square"))


def _targets(spark, sf):
    return _studies(spark, sf).select("sample_id", F.col("study_name").alias("grp"), scalars.positive_label(F.col("c_mktsegment"), "BUILDING").alias("y"))


@query()
def report_grid(spark, sf):
    """The four representations under both classifiers, every fold and representation in the same passes."""
    one, features = view_ab(spark, sf)
    two, others = view_as(spark, sf)
    p, q = features.count(), others.count()
    a, b = (written(crossval.of_composition(numbered(x, f), f)) for x, f in ((one, features), (two, others)))
    # both trainings are chains of single tasks: beside each other
    with ThreadPoolExecutor(2) as pool:
        pretrained, aligned = (pool.submit(f, spark, sf) for f in (_pretrained, _aligned))
    (padded, shape, _, weights), (_, pairs) = pretrained.result(), aligned.result()
    pairs = pairs.select("sample_id", F.concat("za", "zb").alias("v"))
    masked = encoder.embed(padded, weights, shape).withColumnRenamed("embedding", "v")
    width = {"baseline_CLR": p, "baseline_CLR_taxa+pathway": p + q, "masked_pretrain_embedding": shape.d, "crossmodal_embedding": 2 * shape.d}
    rows = (a, crossval.beside(b, crossval.filled(a, p), q), crossval.of_vectors(masked), crossval.of_vectors(pairs))
    c = crossval.Cases(crossval.cases(dict(zip(width, rows, strict=True)), _targets(spark, sf)), width)
    # both with the defaults of the library: 200 rounds of 31 leaves and 255 bins
    scores = {"logreg": crossval.logistic_scores(c), "gbdt": boosting.boosted_scores(c)}
    out = evaluate.table(scores, width)
    c.close()
    return out


@query()
def gbt_leafwise(spark, sf):
    cells, features = view_ab(spark, sf)
    rows = crossval.of_composition(numbered(cells, features), features)
    c = crossval.Cases(crossval.cases({"baseline_CLR": rows}, _targets(spark, sf)), {"baseline_CLR": features.count()})
    # a tenth of the booster's default of 200 rounds: a minute on one machine
    scores = written(boosting.boosted_scores(c, boosting.Options(rounds=20)))
    c.close()
    return scores


@query()
def logreg_sparse(spark, sf):
    cells, features = view_as(spark, sf)
    rows = crossval.of_composition(numbered(cells, features), features)
    c = crossval.Cases(crossval.cases({"CLR": rows}, _targets(spark, sf)), {"CLR": features.count()})
    scores = written(crossval.logistic_scores(c))
    c.close()
    return scores


@query("SELECT ((row_number() OVER (ORDER BY o_orderkey) - 1) // 64)::INT AS batch, 1 AS one FROM orders")
def permuted_batches(spark, sf):
    # which row falls where is drawn; every batch has 64 rows and the last what is left
    rows = splits.numbered(read(spark, sf, "orders").select("o_orderkey"), "row_number")
    return splits.permuted_batches(rows, 64, seed=3, epoch=2).select("batch", F.lit(1).alias("one"))


@query()
def gbt_oof(spark, sf):
    df, columns = _cases(spark, sf)
    # twenty rounds for a query that runs in seconds; the operator's default is two hundred
    return evaluate.out_of_fold(df, columns, model=lambda n: evaluate.gbt(n, max_iter=20), k=2)


@query()
def encoder_embeddings(spark, sf):
    padded, shape, _, weights = _pretrained(spark, sf)
    return encoder.embed(padded, weights, shape)


LOG_RATIOS = DENSE + ", lg AS (SELECT sample_id AS id, feature_idx AS d, lg - avg(lg) OVER (PARTITION BY sample_id) AS x FROM dn)"


@query(f"WITH {_components(LOG_RATIOS)} SELECT id AS sample_id, " + ", ".join(f"round(abs(list_dot_product(z, e{k}.v)), 6) AS pc{k}" for k in (1, 2, 3)) + " FROM zz CROSS JOIN e1 CROSS JOIN e2 CROSS JOIN e3")
def pca_cells(spark, sf):
    cells, features = view_as(spark, sf)
    scores, _ = components.principal(crossval.of_composition(numbered(cells, features), features), features.count(), 3)
    return scores.select(F.col("key").alias("sample_id"), *[F.round(F.abs(F.col("pc")[k]), 6).alias(f"pc{k + 1}") for k in range(3)])


@query(f"WITH {SA} SELECT sample_id, feature::VARCHAR AS feature, feature_idx, round(abundance, {D}) AS abundance FROM sa JOIN fs USING (feature)")
def wide_file(spark, sf):
    # written as a wide file and read again; no plan is as wide as the table
    cells, features = view_as(spark, sf)
    path = fresh(spark)
    tables.write_wide_cells(numbered(cells, features), features.withColumn("feature", F.col("feature").cast("string")), path, samples=_samples(spark, sf))
    cells = tables.read_wide_cells(spark, path)[0]
    return cells.select(F.col("sample_id").cast("long").alias("sample_id"), "feature", "feature_idx", F.round("abundance", D).alias("abundance"))


@query()
def masked_metrics(spark, sf):
    cells, features = view_ab(spark, sf)
    cells = written(numbered(cells, features))
    model = tokens.fit(cells, features, "bin", MAX_LEN)
    t = model.transform(cells).withColumn("value", F.col("val"))
    m = tokens.mask(t, F.expr("((sample_id * 7919 + rank * 104729 + 17) % 10007) / 10007.0D"))
    hidden = tokens.padded(m, MAX_LEN, F.col("val"))
    seen = tokens.padded(m.withColumn("token_id", F.col("target")), MAX_LEN, F.col("value")).select("sample_id", F.col("ids").alias("target"), F.col("vals").alias("value"))
    x = hidden.join(seen, "sample_id").withColumn("selected", F.zip_with("ids", "target", lambda a, b: a != b))
    _, shape, _, weights = _pretrained(spark, sf)
    return encoder.masked_metrics(x, weights, shape)


# files


@query(f"WITH {AB} SELECT sample_id, feature, abundance FROM ab")
def r_frames(spark, sf):
    """Cells as R data frames in bounded files, read again as cells of frames."""
    path = fresh(spark)
    rdata.write_frames(view_ab(spark, sf)[0].select("sample_id", "feature", "abundance"), path, object="ab")
    return rdata.frame(rdata.read(spark, path), "ab", "sample_id long, feature string, abundance double")


@query(f"WITH {AB}, {SA}, {STUDY}, a AS (SELECT sample_id, count(*) AS n_taxa, round(sum(abundance), 2) AS taxa FROM ab GROUP BY 1), b AS (SELECT sample_id, count(*) AS n_pathways, round(sum(abundance), 2) AS pathways FROM sa GROUP BY 1) SELECT sample_id, study_name, c_mktsegment AS study_condition, n_taxa, taxa, n_pathways, pathways FROM st JOIN a USING (sample_id) JOIN b USING (sample_id)")
def cohort_files(spark, sf):
    """The files of a cohort, written from both views and loaded together."""
    folder = fresh(spark)
    for name, view in (("taxa", view_ab), ("pathway", view_as)):
        cells, features = view(spark, sf)
        tables.write_wide_cells(numbered(cells, features), features.withColumn("feature", F.col("feature").cast("string")), f"{folder}/{name}_abundance.csv")
    tables.write_csv(_studies(spark, sf).select("sample_id", "study_name", F.col("c_mktsegment").alias("study_condition")), f"{folder}/metadata.csv")
    c = tables.load_cohort(spark, folder)
    sums = [x.groupBy("sample_id").agg(F.count("*").alias(f"n_{n}"), F.round(F.sum("abundance"), 2).alias(n)) for x, n in ((c.taxa, "taxa"), (c.pathways, "pathways"))]
    x = c.metadata.join(sums[0], "sample_id").join(sums[1], "sample_id")
    return x.select(F.col("sample_id").cast("long").alias("sample_id"), "study_name", "study_condition", "n_taxa", "taxa", "n_pathways", "pathways")


@query("SELECT s_suppkey AS taxon, s_name AS species, CASE WHEN s_suppkey % 3 <> 0 THEN n_name END AS family, r_name AS phylum FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lineage_file(spark, sf):
    path = fresh(spark)
    named = _lineage(spark, sf).select("taxon", "species", F.when(F.col("taxon") % 3 == 0, "NA").otherwise(F.col("family")).alias("family"), "phylum")
    tables.write_csv(named, path)
    x = tables.read_lineage(spark, path)
    return x.select(F.col("taxon").cast("long").alias("taxon"), "species", "family", "phylum")


@query(f"WITH {AB}, {STUDY} SELECT study_name, feature, count(*) AS n, round(sum(abundance), 2) AS total FROM ab JOIN st USING (sample_id) WHERE study_name IN ('ASIA', 'EUROPE') GROUP BY 1, 2")
def merged_studies(spark, sf):
    """Files of two studies, found by name among those of all, and merged."""
    folder = fresh(spark)
    cells = view_ab(spark, sf)[0].join(_studies(spark, sf).select("sample_id", "study_name"), "sample_id")
    cells.write.partitionBy("study_name").parquet(folder)
    found = [[r.path for r in tables.matching_files(spark, folder, [study], "parquet").collect()] for study in ("ASIA", "EUROPE")]
    merged = tables.merge_studies(*[spark.read.option("basePath", folder).parquet(*paths) for paths in found if paths])
    return merged.groupBy("study_name", "feature").agg(F.count("*").alias("n"), F.round(F.sum("abundance"), 2).alias("total"))


@query(SQL["contrastive_loss"])
def history_file(spark, sf):
    """Losses as a file of records, read again."""
    losses = retrieval.contrastive_loss(_sims(spark, sf, 14.0)).select("batch", "n", F.round("loss", 5).alias("loss"))
    path = fresh(spark)
    tables.write_records(losses, path)
    return spark.read.schema(losses.schema).json(path)


@query("WITH m AS (SELECT label, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS xx, covar_samp(x, y) AS xy, var_samp(y) AS yy FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) GROUP BY label), a AS (SELECT *, sqrt((xx - yy) ** 2 + 4 * xy ** 2) AS d FROM m) SELECT label, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt(-2 * ln(0.32)) * sqrt((xx + yy + d) / 2), 6) AS major, round(sqrt(-2 * ln(0.32)) * sqrt((xx + yy - d) / 2), 6) AS minor, round((xx - yy) / d, 5) AS cos_twice, round(2 * xy / d, 5) AS sin_twice FROM a")
def label_ellipses(spark, sf):
    points = read(spark, sf, "embeddings").select("label", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xy")])
    # an axis has no direction: its angle is shown doubled
    e = cohort.ellipses(points, "label", "x", "y").withColumns({"cos_twice": F.cos(2 * F.col("angle")), "sin_twice": F.sin(2 * F.col("angle"))})
    return e.select("label", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "major", "minor")], *[F.round(c, 5).alias(c) for c in ("cos_twice", "sin_twice")])
