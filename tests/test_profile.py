import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labourlens.operators import features as ft
from labourlens.operators import models as md
from labourlens.operators import profile as pr
from labourlens.operators import quantiles
from labourlens.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("kind", ["spread", "ties", "narrow", "negative", "one"])
def test_quantiles_equal_numpy(spark, kind):
    rnd = random.Random(4)
    make = {"spread": lambda: rnd.lognormvariate(3, 2), "ties": lambda: float(rnd.randint(1, 4)), "narrow": lambda: 1e9 + rnd.random(),
            "negative": lambda: rnd.uniform(-50, 50), "one": lambda: 7.0}[kind]
    # Group "big" holds most rows, group None is a null key.
    rows = [("big" if i % 3 else ("s" if i % 2 else None), make()) for i in range(500)] + [("solo", 3.5), ("big", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    got = {r.g: [r[p] for p in probs] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in {r[0] for r in rows}:
        values = [v for k, v in rows if k == g and v is not None]
        assert got[g] == pytest.approx(list(np.quantile(values, list(probs.values()))), rel=1e-12), g
    total = exact_quantiles(df, [], "v", {"m": 0.5}).first().m
    assert total == pytest.approx(np.median([v for _, v in rows if v is not None]), rel=1e-12)


@pytest.mark.parametrize("kind", ["crowded", "tiny", "wide", "hot"])
def test_crowded_bins_are_split_again(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "MOST_VALUES", 8)
    monkeypatch.setattr(quantiles, "SPLIT", 256)
    rnd = random.Random(5)
    make = {"crowded": lambda: 0.001 * rnd.random(), "tiny": lambda: 10.0 ** rnd.uniform(-12, -3), "wide": lambda: rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(290, 308),
            "hot": lambda: 0.002 if rnd.random() < 0.4 else 0.002 + 1e-9 * rnd.random()}[kind]
    rows = [(rnd.choice(["a", "b", None]), make()) for _ in range(300)]
    probs = {"lo": 0.0, "q33": 0.33, "mid": 0.5, "hi": 0.99}
    got = {r.g: [r[p] for p in probs] for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", probs).collect()}
    for g in ("a", "b", None):
        assert got[g] == pytest.approx(list(np.quantile([v for k, v in rows if k == g], list(probs.values()))), rel=1e-9, abs=0)


def test_null_report_counts_and_order(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, 1.0, "b")], "a int, b double, c string")
    assert [tuple(r) for r in pr.null_report(df).collect()] == [("b", 2, 66.67), ("c", 1, 33.33)]


def test_ordered_by_domain(spark):
    df = spark.createDataFrame([("lead",), ("entry",), ("odd",), ("mid",)], "b string")
    assert [r.b for r in pr.ordered_by(df, "b", ["entry", "junior", "mid", "senior", "lead"]).collect()] == ["entry", "mid", "lead", "odd"]


def test_scaling_and_codes(spark):
    values = [1.0, 2.0, 4.0, 10.0, None]
    df = spark.createDataFrame([(f"j{i}", v, b) for i, (v, b) in enumerate(zip(values, ["mid", "lead", None, "odd", "entry"]))],
                               "job_id string, x double, b string")
    s = ft.NumericScaling.fit(df, ["x"])
    filled = np.array([1, 2, 4, 10, 3.0])
    got = [r[0] for r in s.transform(df).orderBy("job_id").select("x_scaled").collect()]
    assert got == pytest.approx(list((filled - filled.mean()) / filled.std()))
    assert [r[0] for r in df.orderBy("job_id").select(ft.ordinal_code("b", ["entry", "junior", "mid", "senior", "lead"])).collect()] == [2, 4, -1, -1, 0]


def test_target_classes(spark):
    df = spark.createDataFrame([(10.0,), (10.1,), (25.0,), (30.0,), (None,)], "salary_mid double")
    got = ft.prepare_target(df, log=True, classes=True).collect()
    assert [r.label_class for r in got] == ["low", "medium", "medium", "high"]
    assert got[0].label == pytest.approx(np.log1p(10))


def test_unseen_category_is_all_zero(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "city string, experience_years double")
    pre = ft.Preprocessor.fit(train)
    assert pre.names() == ["experience_years", "city_Unknown", "city_a", "city_b"]
    row = pre.transform(spark.createDataFrame([("zzz", 2.0)], "city string, experience_years double")).first()
    assert list(row.features.toArray()) == [0.0, 0.0, 0.0, 0.0]


def test_models_beat_the_mean(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        x, city = rnd.uniform(0, 10), rnd.choice(["HCMC", "Hanoi"])
        rows.append((f"j{i}", x, city, 15 + 3 * x + 5 * (city == "HCMC") + rnd.gauss(0, 1)))
    df = ft.prepare_target(spark.createDataFrame(rows, "job_id string, experience_years double, city string, salary_mid double"))
    train, test = ft.split(df)
    assert train.count() + test.count() == 400 and 50 < test.count() < 110
    got = {r.model: r for r in md.compare_models(train, test, {"linear": {}, "decision_tree": {"maxDepth": 6}}).collect()}
    assert got["linear"].r2 > 0.95 and got["decision_tree"].rmse < got["baseline_mean"].rmse
    assert got["linear"].improvement_pct > 50
    with pytest.raises(ValueError):
        md.estimator("svm")


def test_error_reasons(spark):
    df = spark.createDataFrame([("a", 50.0, 20.0), ("b", 30.0, 18.0), ("c", 10.0, 4.0), ("d", 10.0, 6.0), ("e", 10.0, 9.0), ("f", 10.0, 11.0)],
                               "job_id string, label double, prediction double")
    assert [r.error_reason for r in md.errors(df).orderBy("job_id").collect()] == [
        "Extreme (>20M)", "Large error (10-20M)", "High relative error (>50%)", "Moderate relative error (30-50%)", "Underpredicted", "Overpredicted"]
    assert [r.job_id for r in md.worst_errors(df, 2).collect()] == ["a", "b"]


def test_importances_and_clusters(spark):
    from pyspark.ml.functions import array_to_vector
    from labourlens.operators import cluster as cl
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(8 * (i % 3), 0.5), rnd.gauss(-8 * (i % 3), 0.5)]) for i in range(120)]
    df = cl.standardised(spark.createDataFrame(rows, "i int, v array<double>").select("i", array_to_vector("v").alias("features")))
    assert cl.best_k(cl.scan_k(df, [2, 3, 4], starts=2)).first().k == 3
    labelled = cl.fit_kmeans(df, 3, starts=3).transform(df)
    assert labelled.groupBy((F.col("i") % 3).alias("m")).agg(F.countDistinct("cluster").alias("n")).agg(F.max("n")).first()[0] == 1
    assert -1 <= cl.silhouette(labelled) <= 1 and cl.plane(df).count() == 120


def test_cross_validation_and_cluster_matrix(spark):
    from labourlens.operators import cluster as cl
    rnd = random.Random(8)
    rows = [(f"j{i}", x, "HCMC" if i % 2 else None, "Full-time", "Remote", 10 + 2 * x + rnd.gauss(0, 0.5)) for i, x in
            enumerate(rnd.uniform(0, 9) for _ in range(200))]
    df = spark.createDataFrame(rows, "job_id string, experience_years double, city string, job_type string, remote_option string, salary_mid double")
    cv = md.cross_validate("linear", ft.prepare_target(df), folds=3).first()
    assert cv.folds == 3 and 0.3 < cv.cv_rmse_mean < 0.8 and cv.cv_rmse_std < 0.3
    skills = spark.createDataFrame([("j1", "SQL"), ("j1", "Go"), ("j2", "SQL"), ("j2", "SQL")], "job_id string, skill_name string")
    got = {r.job_id: list(r.features.toArray()) for r in cl.cluster_matrix(df, skills).where("job_id in ('j1', 'j2', 'j3')").collect()}
    # two numbers, two cities, one contract, one place, two skills (SQL is the commoner)
    assert got["j1"][2:] == [1, 0, 1, 1, 1, 1] or got["j1"][2:] == [0, 1, 1, 1, 1, 1]
    assert got["j2"][-2:] == [2, 0] and got["j3"][-2:] == [0, 0]
