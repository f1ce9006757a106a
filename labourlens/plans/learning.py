"""Features, salary models and clusters."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labourlens.dictionaries import EXPERIENCE_BINS
from labourlens.functions import category
from labourlens.functions.text import floor_round
from labourlens.operators import cluster as cl
from labourlens.operators import features as ft
from labourlens.operators import models as md
from labourlens.plans.normalize import parsed
from labourlens.plans.registry import query
from labourlens.session import spread, stored
from labourlens.sources.adapters import (
    BIN_SQL, POSTINGS_CTE, SKILLS_CTE, companies, floor_sql, job_skills, table,
)

BIN = BIN_SQL.format("experience_years")
_TEST = "CAST(('0x' || substr(md5(job_id || '|split42'), 1, 8)) AS BIGINT) / 4294967296.0 < 0.2"


def model_rows(spark, d):
    """Postings with a salary and the default features."""
    firms = companies(spark, d).select("custkey", category.company_size("company_size_raw").alias("company_size"), "industry")
    p = parsed(spark, d).join(firms, "custkey")
    rows = p.select("job_id", *ft.NUMERIC, *ft.CATEGORICAL, *ft.ORDINAL, "salary_mid")
    return ft.prepare_target(rows)


@query("features_scaled", f"""WITH {POSTINGS_CTE}, m AS (SELECT quantile_cont(experience_years, 0.5) AS med FROM postings),
f AS (SELECT job_id, coalesce(experience_years, med) AS v FROM postings, m)
SELECT job_id, {floor_sql('(v - (SELECT avg(v) FROM f)) / (SELECT stddev_pop(v) FROM f)', 6)} AS experience_years_scaled FROM f""")
def features_scaled(spark, d):
    p = parsed(spark, d, salary=False).select("job_id", "experience_years")
    scaled = ft.NumericScaling.fit(p, ["experience_years"]).transform(p)
    return scaled.select("job_id", floor_round("experience_years_scaled", 6).alias("experience_years_scaled"))


@query("features_ordinal", f"""WITH {POSTINGS_CTE} SELECT job_id, CASE {BIN} WHEN 'entry' THEN 0 WHEN 'junior' THEN 1 WHEN 'mid' THEN 2
  WHEN 'senior' THEN 3 WHEN 'lead' THEN 4 ELSE -1 END AS code FROM postings""")
def features_ordinal(spark, d):
    return parsed(spark, d, salary=False).select("job_id", ft.ordinal_code("experience_bin", EXPERIENCE_BINS).alias("code"))


@query("features_onehot", f"""WITH {POSTINGS_CTE}, l AS (SELECT coalesce(job_type, 'Unknown') AS value, count(*) AS n FROM postings GROUP BY 1)
SELECT 'job_type_' || value AS slot, n FROM l UNION ALL
SELECT 'city_' || coalesce(city, 'Unknown'), count(*) FROM postings GROUP BY 1""")
def features_onehot(spark, d):
    """How many rows light up each slot of the encoded vector."""
    from pyspark.ml.functions import vector_to_array
    p = parsed(spark, d, salary=False).select("job_id", "city", "job_type")
    pre = ft.Preprocessor.fit(p, numeric=[], categorical=["city", "job_type"], ordinal={})
    names = F.array(*[F.lit(n) for n in pre.names()])
    lit_up = pre.transform(p).select(F.explode(F.arrays_zip(names.alias("slot"), vector_to_array("features").alias("v"))).alias("x"))
    return lit_up.where("x.v <> 0").groupBy("x.slot").agg(F.count("*").alias("n"))


@query("feature_pruning", f"""WITH {POSTINGS_CTE} SELECT city, remote_option, {BIN} AS experience_bin, count(*) AS n FROM postings GROUP BY ALL""")
def feature_pruning(spark, d):
    wide = parsed(spark, d).select("job_id", "job_title", "city", "remote_option", "experience_bin", "salary_mid", "salary_min", "posted_at")
    kept = ft.feature_columns(wide)
    return kept.groupBy(*kept.columns).agg(F.count("*").alias("n"))


@query("target_classes", f"""WITH {POSTINGS_CTE} SELECT job_id, CASE WHEN salary_mid <= 10 THEN 'low' WHEN salary_mid <= 25 THEN 'medium' ELSE 'high' END AS label_class,
  {floor_sql('ln(1 + salary_mid)', 6)} AS label FROM postings WHERE salary_mid IS NOT NULL""")
def target_classes(spark, d):
    t = ft.prepare_target(parsed(spark, d).select("job_id", "salary_mid"), log=True, classes=True)
    return t.select("job_id", "label_class", floor_round("label", 6).alias("label"))


@query("split_summary", f"""WITH {POSTINGS_CTE} SELECT CASE WHEN {_TEST} THEN 'test' ELSE 'train' END AS part, count(*) AS n,
  {floor_sql('avg(salary_mid)', 4)} AS target_mean, {floor_sql('stddev_samp(salary_mid)', 4)} AS target_std
FROM postings WHERE salary_mid IS NOT NULL GROUP BY 1""")
def split_summary(spark, d):
    train, test = ft.split(ft.prepare_target(parsed(spark, d).select("job_id", "salary_mid")))
    return md.target_summary(train).withColumn("part", F.lit("train")).unionByName(
        md.target_summary(test).withColumn("part", F.lit("test")))


def _scores_sql(label: str, pred: str) -> str:
    return (f"count(*) AS n, {floor_sql(f'sqrt(avg(pow({label} - {pred}, 2)))', 4)} AS rmse, {floor_sql(f'avg(abs({label} - {pred}))', 4)} AS mae, "
            f"{floor_sql(f'1 - avg(pow({label} - {pred}, 2)) / var_pop({label})', 4)} AS r2")


@query("baseline_metrics", f"""WITH {POSTINGS_CTE}, s AS (SELECT salary_mid AS y, {_TEST} AS test FROM postings WHERE salary_mid IS NOT NULL),
g AS (SELECT 'mean' AS strategy, avg(y) AS p FROM s WHERE NOT test UNION ALL SELECT 'median', quantile_cont(y, 0.5) FROM s WHERE NOT test)
SELECT strategy, {_scores_sql('y', 'p')} FROM s, g WHERE test GROUP BY strategy""")
def baseline_metrics(spark, d):
    return md.baseline_scores(*ft.split(ft.prepare_target(parsed(spark, d).select("job_id", "salary_mid"))))


_PRED = "(12 + 1.5 * coalesce(experience_years, 2))"


def guessed(spark, d):
    p = parsed(spark, d).where("salary_mid IS NOT NULL")
    return p.select("job_id", "city", "experience_bin", F.col("salary_mid").alias("label"), F.expr(_PRED).cast("double").alias("prediction"))


@query("regression_metrics", f"""WITH {POSTINGS_CTE} SELECT {BIN} AS experience_bin, {_scores_sql('salary_mid', _PRED)}
FROM postings WHERE salary_mid IS NOT NULL GROUP BY 1""")
def regression_metrics(spark, d):
    return md.scores(guessed(spark, d), by=["experience_bin"])


@query("error_table", f"""WITH {POSTINGS_CTE}, e AS (SELECT job_id, salary_mid AS label, {_PRED} AS prediction, salary_mid - {_PRED} AS residual FROM postings WHERE salary_mid IS NOT NULL),
r AS (SELECT *, abs(residual / label) * 100 AS pct FROM e)
SELECT job_id, label, {floor_sql('prediction', 4)} AS prediction, {floor_sql('residual', 4)} AS residual, {floor_sql('pct', 2)} AS error_pct,
  CASE WHEN abs(residual) > 20 THEN 'Extreme (>20M)' WHEN abs(residual) > 10 THEN 'Large error (10-20M)' WHEN pct > 50 THEN 'High relative error (>50%)'
    WHEN pct > 30 THEN 'Moderate relative error (30-50%)' WHEN residual > 0 THEN 'Underpredicted' ELSE 'Overpredicted' END AS error_reason
FROM r ORDER BY abs(residual) DESC, job_id LIMIT 12""")
def error_table(spark, d):
    return md.worst_errors(guessed(spark, d), 12).select(
        "job_id", "label", floor_round("prediction", 4).alias("prediction"), floor_round("residual", 4).alias("residual"),
        floor_round("error_pct", 2).alias("error_pct"), "error_reason")


@query("error_reasons", f"""WITH {POSTINGS_CTE}, r AS (SELECT salary_mid - {_PRED} AS residual, abs((salary_mid - {_PRED}) / salary_mid) * 100 AS pct FROM postings WHERE salary_mid IS NOT NULL)
SELECT CASE WHEN abs(residual) > 20 THEN 'Extreme (>20M)' WHEN abs(residual) > 10 THEN 'Large error (10-20M)' WHEN pct > 50 THEN 'High relative error (>50%)'
    WHEN pct > 30 THEN 'Moderate relative error (30-50%)' WHEN residual > 0 THEN 'Underpredicted' ELSE 'Overpredicted' END AS error_reason, count(*) AS n
FROM r GROUP BY 1""")
def error_reasons(spark, d):
    return md.errors(guessed(spark, d)).groupBy("error_reason").agg(F.count("*").alias("n"))


@query("residual_stats", f"""WITH {POSTINGS_CTE}, e AS (SELECT salary_mid - {_PRED} AS r FROM postings WHERE salary_mid IS NOT NULL)
SELECT {floor_sql('avg(r)', 4)} AS mean, {floor_sql('stddev_pop(r)', 4)} AS std, {floor_sql('min(r)', 4)} AS min, {floor_sql('max(r)', 4)} AS max,
  count(*) FILTER (r < 0) AS over, count(*) FILTER (r > 0) AS under FROM e""")
def residual_stats(spark, d):
    return md.residual_stats(guessed(spark, d))


_WEIGHTS = {"l_quantity": 900.0, "l_discount": -1500.0, "l_tax": 250.0}


@query("linear_attribution", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {floor_sql(f'avg(abs({w} * ({c} - (SELECT avg({c}) FROM lineitem))))', 4)} AS mean_abs_share FROM lineitem"
    for c, w in _WEIGHTS.items()))
def linear_attribution(spark, d):
    return md.attribution(table(spark, d, "lineitem"), _WEIGHTS)


@query("linear_fit", f"""SELECT {floor_sql('regr_slope(l_extendedprice, l_quantity)', 3)} AS slope,
  {floor_sql('regr_intercept(l_extendedprice, l_quantity)', 3)} AS intercept FROM lineitem""")
def linear_fit(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("label"), F.array("l_quantity").alias("x"))
    model = md.estimator("linear").fit(rows.select("label", array_to_vector("x").alias("features")))
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double").select(
        floor_round("slope", 3).alias("slope"), floor_round("intercept", 3).alias("intercept"))


QUERY_PARAMS = {"linear": {}, "decision_tree": {"maxDepth": 8}, "random_forest": {"numTrees": 100, "maxDepth": 12}}


def materialised(df):
    """Models pass over their rows many times; the parsed rows are written once."""
    return spread(stored(df, "model-rows"))


@query("model_comparison")
def model_comparison(spark, d):
    return md.compare_models(*ft.split(materialised(model_rows(spark, d))), QUERY_PARAMS)


@query("cross_validation")
def cross_validation(spark, d):
    return md.cross_validate("linear", materialised(model_rows(spark, d)))


@query("tree_importances")
def tree_importances(spark, d):
    rows = materialised(model_rows(spark, d))
    pre = ft.Preprocessor.fit(rows)
    model = md.estimator("decision_tree", maxDepth=8).fit(pre.transform(rows))
    return md.importances(model, pre.names(), spark)


@query("cluster_profiles", f"""WITH {POSTINGS_CTE}, {SKILLS_CTE},
c AS (SELECT *, education_level AS cluster FROM postings),
b AS (SELECT cluster, count(*) AS size, {floor_sql('coalesce(avg(salary_mid), 0)')} AS avg_salary, {floor_sql('coalesce(avg(experience_years), 0)', 2)} AS avg_experience,
  {floor_sql("count(*) FILTER (remote_option = 'Remote') / count(*)", 2)} AS remote_ratio, {floor_sql('count(*) * 100.0 / (SELECT count(*) FROM c)')} AS size_pct FROM c GROUP BY 1),
{', '.join(f'''t_{v} AS (SELECT cluster, list({v} ORDER BY n DESC, {v}) AS top_{v} FROM (
  SELECT cluster, {v}, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, {v}) AS r FROM {src} WHERE {v} IS NOT NULL GROUP BY 1, 2)
  WHERE r <= 3 GROUP BY 1)''' for v, src in (('city', 'c'), ('job_title', 'c'), ('job_type', 'c'), ('skill_name', '(SELECT cluster, skill_name FROM c JOIN job_skills USING (job_id))')))}
SELECT *, CASE WHEN avg_salary > 30 THEN 'high pay, senior or lead' WHEN avg_salary > 18 THEN 'medium to high pay, mid to senior'
  WHEN avg_experience < 2 THEN 'starters, low pay' ELSE 'medium pay, junior to mid' END AS meaning
FROM b JOIN t_city USING (cluster) JOIN t_job_title USING (cluster) JOIN t_job_type USING (cluster) JOIN t_skill_name USING (cluster)""")
def cluster_profiles(spark, d):
    p = parsed(spark, d).select("job_id", F.col("education_level").alias("cluster"), "salary_mid", "experience_years", "remote_option",
                                "city", "job_title", "job_type")
    return cl.profiles(stored(p, "clustered"), job_skills(spark, d))


def vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    return spread(stored(cl.standardised(spread(rows)).drop("features"), "vectors"))


@query("kmeans_fit")
def kmeans_fit(spark, d):
    rows = vectors(spark, d)
    labelled = cl.fit_kmeans(rows, 5).transform(rows)
    return labelled.groupBy("cluster").agg(F.count("*").alias("n"))


@query("k_scan")
def k_scan(spark, d):
    return cl.best_k(cl.scan_k(vectors(spark, d), range(2, 11)))


@query("pca_coords")
def pca_coords(spark, d):
    return cl.plane(vectors(spark, d)).select("vec_id", F.abs(floor_round("pc1", 4)).alias("pc1"), F.abs(floor_round("pc2", 4)).alias("pc2"))


@query("cluster_matrix")
def cluster_matrix(spark, d):
    """All postings clustered on pay, experience, place, contract and skills."""
    p = parsed(spark, d).select("job_id", "experience_years", "salary_mid", "city", "job_type", "remote_option")
    matrix = stored(cl.cluster_matrix(p, job_skills(spark, d)), "cluster-matrix")
    scaled = cl.standardised(matrix, centred=False)
    labelled = cl.fit_kmeans(scaled, 4).transform(scaled)
    return labelled.groupBy("cluster").agg(F.count("*").alias("n"), floor_round(F.avg("salary_mid"), 1).alias("avg_salary"))


# --- models and clusters whose result has a closed form -------------------------------

_FOLD = "CAST(floor(CAST(('0x' || substr(md5(job_id || '|fold42'), 1, 8)) AS BIGINT) / 4294967296.0 * 5) AS INTEGER)"


@query("fold_rows", f"""WITH {POSTINGS_CTE} SELECT {_FOLD} AS fold, count(*) AS n, true AS scored
FROM postings JOIN customer ON c_custkey = custkey WHERE salary_mid IS NOT NULL GROUP BY 1""")
def fold_rows(spark, d):
    """Each fold is predicted whole by a model of the other folds."""
    rows = materialised(model_rows(spark, d))
    return md.fold_scores("linear", rows).select("fold", "n", (F.col("rmse") > 0).alias("scored"))


def stump_rows(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_extendedprice") + 1000 * F.col("l_quantity")).cast("double").alias("label"), F.array(F.col("l_quantity").cast("double"), F.col("l_tax").cast("double")).alias("x"))
    return materialised(rows.select("label", "x")).select("label", array_to_vector("x").alias("features"))


_STUMP = f"""WITH c AS (SELECT l_quantity AS q, count(*)::DOUBLE AS n, sum(l_extendedprice + 1000 * l_quantity)::DOUBLE AS s FROM lineitem GROUP BY 1),
t AS (SELECT q, sum(n) OVER (ORDER BY q) AS n1, sum(s) OVER (ORDER BY q) AS s1, sum(n) OVER () AS n, sum(s) OVER () AS s FROM c),
b AS (SELECT * FROM t WHERE n1 < n ORDER BY s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) DESC LIMIT 1)
SELECT {floor_sql('s1 / n1', 3)} AS prediction, CAST(n1 AS BIGINT) AS n, 1.0 AS quantity_importance, 0.0 AS tax_importance FROM b
UNION ALL SELECT {floor_sql('(s - s1) / (n - n1)', 3)}, CAST(n - n1 AS BIGINT), 1.0, 0.0 FROM b"""


def stump(spark, d, name, **params):
    """A tree of one split: the two means at the best cut of the column that the label follows."""
    rows = stump_rows(spark, d)
    model = md.estimator(name, maxDepth=1, maxBins=64, **params).fit(rows)
    weights = {r["feature"]: r["importance"] for r in md.importances(model, ["quantity", "tax"], spark).collect()}
    counted = model.transform(rows).groupBy(floor_round("prediction", 3).alias("prediction")).agg(F.count("*").alias("n"))
    return counted.withColumns({f"{k}_importance": F.lit(v) for k, v in weights.items()})


@query("tree_stump", _STUMP)
def tree_stump(spark, d):
    return stump(spark, d, "decision_tree")


@query("forest_stump", _STUMP)
def forest_stump(spark, d):
    """A forest of one tree takes all rows."""
    return stump(spark, d, "random_forest", numTrees=1, bootstrap=False)


@query("model_scores", f"""WITH r AS (SELECT l_quantity::DOUBLE AS q, (l_extendedprice + 1000 * l_quantity)::DOUBLE AS y, {_TEST} AS test
  FROM (SELECT *, l_orderkey || '-' || l_linenumber AS job_id FROM lineitem)),
t AS (SELECT * FROM r WHERE NOT test),
f AS (SELECT avg(y) AS mean, quantile_cont(y, 0.5) AS median, regr_slope(y, q) AS slope, regr_intercept(y, q) AS start FROM t),
c AS (SELECT q, count(*)::DOUBLE AS n, sum(y) AS s FROM t GROUP BY 1),
w AS (SELECT q, sum(n) OVER (ORDER BY q) AS n1, sum(s) OVER (ORDER BY q) AS s1, sum(n) OVER () AS n, sum(s) OVER () AS s FROM c),
b AS (SELECT q AS cut, s1 / n1 AS low, (s - s1) / (n - n1) AS high FROM w WHERE n1 < n ORDER BY s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) DESC LIMIT 1),
p AS (SELECT 'baseline_mean' AS model, y, mean AS p FROM r, f WHERE test UNION ALL SELECT 'baseline_median', y, median FROM r, f WHERE test
  UNION ALL SELECT 'linear', y, slope * q + start FROM r, f WHERE test
  UNION ALL SELECT 'decision_tree', y, CASE WHEN q <= cut THEN low ELSE high END FROM r, b WHERE test),
e AS (SELECT model, {_scores_sql('y', 'p')} FROM p GROUP BY 1)
SELECT model, n, rmse, mae, r2, {floor_sql('(best - rmse) / best * 100')} AS improvement_pct FROM e, (SELECT min(rmse) AS best FROM e WHERE starts_with(model, 'baseline_'))""")
def model_scores(spark, d):
    """Both constants, a line and a tree of one split on one column, compared on test rows."""
    rows = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("job_id"), F.col("l_quantity").cast("double").alias("quantity"),
        (F.col("l_extendedprice") + 1000 * F.col("l_quantity")).cast("double").alias("label"))
    return md.compare_models(*ft.split(materialised(rows)), {"linear": {}, "decision_tree": {"maxDepth": 1, "maxBins": 64}},
                             numeric=["quantity"], categorical=[], ordinal={})


@query("kmeans_nearest", "SELECT count(*) AS n_rows, 0 AS n_misplaced, 5 AS n_clusters FROM embeddings")
def kmeans_nearest(spark, d):
    """Every vector is in the cluster of its nearest centre, and no cluster is empty."""
    from pyspark.ml.functions import vector_to_array
    rows = stored(cl.standardised(table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))), "scaled")
    model = cl.fit_kmeans(rows, 5)
    x = model.transform(rows).select("cluster", vector_to_array("scaled").alias("x"))

    def distance(centre):
        pairs = F.zip_with("x", F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b))
        return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)
    far = x.withColumn("d", F.array(*[distance(c) for c in model.clusterCenters()]))
    wrong = F.get("d", F.col("cluster")) > F.array_min("d") * (1 + 1e-9)
    return far.agg(F.count("*").alias("n_rows"), F.count_if(wrong).cast("int").alias("n_misplaced"), F.countDistinct("cluster").cast("int").alias("n_clusters"))


@query("silhouette_given", f"""WITH p AS (SELECT l_linenumber AS c, l_quantity::DOUBLE AS x FROM lineitem), g AS (
  SELECT c, count(*)::DOUBLE AS n, sum(x) AS s, sum(x * x) AS ss FROM p GROUP BY 1),
v AS (SELECT p.c, p.x, count(*)::DOUBLE AS m FROM p GROUP BY 1, 2),
e AS (SELECT v.c, v.x, any_value(m) AS m, any_value(CASE WHEN g.c = v.c THEN (n * x * x - 2 * x * s + ss) / (n - 1) END) AS a,
  min(CASE WHEN g.c <> v.c THEN (n * x * x - 2 * x * s + ss) / n END) AS b FROM v, g GROUP BY 1, 2)
SELECT {floor_sql('sum(m * (b - a) / greatest(a, b)) / sum(m)', 5)} AS silhouette FROM e""")
def silhouette_given(spark, d):
    """The silhouette of clusters that are given, here the line numbers."""
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("cluster"), array_to_vector(F.array(F.col("l_quantity").cast("double"))).alias("scaled"))
    return spark.createDataFrame([(cl.silhouette(rows),)], "silhouette double").select(floor_round("silhouette", 5).alias("silhouette"))


@query("silhouette_scan", f"""WITH p AS (SELECT u.k, l_linenumber % u.k AS c, l_quantity::DOUBLE AS x FROM lineitem, unnest([2, 3, 4, 5]) AS u(k)),
g AS (SELECT k, c, count(*)::DOUBLE AS n, sum(x) AS s, sum(x * x) AS ss FROM p GROUP BY 1, 2),
v AS (SELECT k, c, x, count(*)::DOUBLE AS m FROM p GROUP BY 1, 2, 3),
e AS (SELECT v.k, v.c, v.x, any_value(m) AS m, any_value(CASE WHEN g.c = v.c THEN (n * x * x - 2 * x * s + ss) / (n - 1) END) AS a,
  min(CASE WHEN g.c <> v.c THEN (n * x * x - 2 * x * s + ss) / n END) AS b FROM v JOIN g ON g.k = v.k GROUP BY 1, 2, 3),
h AS (SELECT k, {floor_sql('sum(ss - s * s / n)', 2)} AS cost FROM g GROUP BY 1)
SELECT CAST(e.k AS INTEGER) AS k, {floor_sql('sum(m * (b - a) / greatest(a, b)) / sum(m)', 5)} AS silhouette, any_value(cost) AS cost
FROM e JOIN h ON h.k = e.k GROUP BY e.k""")
def silhouette_scan(spark, d):
    """The scan's scores of given clusters, here the line numbers modulo each k."""
    rows = table(spark, d, "lineitem").select(array_to_vector(F.array(F.col("l_quantity").cast("double"))).alias("scaled"),
                                              *[(F.col("l_linenumber") % k).alias(f"in_{k}") for k in (2, 3, 4, 5)])
    scan = cl.silhouettes(rows, {k: f"in_{k}" for k in (2, 3, 4, 5)})
    return scan.select("k", floor_round("silhouette", 5).alias("silhouette"), floor_round("cost", 2).alias("cost"))


@query("pca_variances", f"""WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
SELECT {floor_sql('1 + r', 5)} AS v1, {floor_sql('1 - r', 5)} AS v2 FROM r""")
def pca_variances(spark, d):
    """Two standardised columns spread by one plus and one minus their correlation along the principal axes."""
    rows = table(spark, d, "lineitem").select(array_to_vector(F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double"))).alias("features"))
    xy = cl.plane(cl.standardised(rows))
    return xy.agg(floor_round(F.var_pop("pc1"), 5).alias("v1"), floor_round(F.var_pop("pc2"), 5).alias("v2"))


@query("cluster_matrix_shape", f"""WITH {POSTINGS_CTE}, {SKILLS_CTE}
SELECT (SELECT count(*) FROM postings) AS n_rows, 2 + (SELECT count(DISTINCT coalesce(city, 'Unknown')) + count(DISTINCT coalesce(job_type, 'Unknown'))
    + count(DISTINCT coalesce(remote_option, 'Unknown')) FROM postings) + (SELECT count(DISTINCT skill_name) FROM job_skills) AS width,
  (SELECT count(*) FROM job_skills) + 3 * (SELECT count(*) FROM postings) AS ones""")
def cluster_matrix_shape(spark, d):
    """The matrix has a place for every category and skill, and counts every one."""
    from pyspark.ml.functions import vector_to_array
    p = parsed(spark, d).select("job_id", "experience_years", "salary_mid", "city", "job_type", "remote_option")
    x = cl.cluster_matrix(p, job_skills(spark, d)).select(vector_to_array("features").alias("x"))
    total = F.aggregate(F.slice("x", 3, F.size("x")), F.lit(0.0), lambda s, v: s + v)
    return x.agg(F.count("*").alias("n_rows"), F.max(F.size("x")).cast("long").alias("width"), F.sum(total).cast("long").alias("ones"))
