"""Salary models, their scores and their errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labourlens.functions.text import floor_round
from labourlens.operators.features import Preprocessor, fold
from labourlens.operators.quantiles import exact_quantiles
from labourlens.session import stored

MODELS = {
    "linear": lambda **p: LinearRegression(**{"solver": "auto", "regParam": 0.0, **p}),
    "decision_tree": lambda **p: DecisionTreeRegressor(**{"maxDepth": 10, "minInstancesPerNode": 5, "seed": 42, **p}),
    "random_forest": lambda **p: RandomForestRegressor(**{
        "numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 4, "featureSubsetStrategy": "all", "seed": 42, **p}),
}


def estimator(name: str, **params):
    if name not in MODELS:
        raise ValueError(f"unknown model type {name!r}; known: {sorted(MODELS)}")
    return MODELS[name](featuresCol="features", labelCol="label", predictionCol="prediction", **params)


def scores(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R² in one pass, rounded to four places."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    known = df.where(y.isNotNull() & F.col(prediction).isNotNull())
    raw = known.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("var"))
    return raw.select(
        *by, "n", floor_round(F.sqrt("mse"), 4).alias("rmse"), floor_round("mae", 4).alias("mae"),
        floor_round(F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")), 4).alias("r2"))


def target_summary(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count(label).alias("n"), floor_round(F.avg(label), 4).alias("target_mean"),
                  floor_round(F.stddev_samp(label), 4).alias("target_std"))


def constant_predictions(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Test rows with the train mean and median as predictions, one row per strategy."""
    mean = train.agg(F.avg(label)).scalar()
    median = exact_quantiles(train.select(label), [], label, {"m": 0.5}).scalar()
    guesses = F.array(F.struct(F.lit("mean").alias("strategy"), mean.alias("prediction")),
                      F.struct(F.lit("median").alias("strategy"), median.alias("prediction")))
    return test.select("*", F.explode(guesses).alias("g")).select("*", "g.*").drop("g")


def baseline_scores(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    return scores(constant_predictions(train, test, label), label, by=["strategy"])


def fit_predict(name: str, train: DataFrame, test: DataFrame, **params) -> DataFrame:
    """Preprocess on the train rows, fit, and predict the test rows."""
    pre = Preprocessor.fit(train)
    model = estimator(name, **params).fit(pre.transform(train))
    return model.transform(pre.transform(test))


def predictions(train: DataFrame, test: DataFrame, params: Mapping[str, dict], keys: Sequence[str] = (), **groups) -> DataFrame:
    """Long table of every test row under both constants and every named model: ``keys``, model, label, prediction.

    One preprocessed matrix, written once, serves all models; ``groups`` are the feature groups of ``Preprocessor.fit``."""
    pre = Preprocessor.fit(train, **groups)
    train_v = stored(pre.transform(train).select("features", "label"), "train-matrix")
    test_v = stored(pre.transform(test).select(*keys, "features", "label"), "test-matrix")
    out = constant_predictions(train_v, test_v).withColumn("model", F.concat(F.lit("baseline_"), "strategy"))
    out = out.select(*keys, "model", "label", "prediction")
    for name, extra in params.items():
        predicted = estimator(name, **extra).fit(train_v).transform(test_v)
        out = out.unionByName(predicted.select(*keys, F.lit(name).alias("model"), "label", "prediction"))
    return out


def compared(predicted: DataFrame) -> DataFrame:
    """Scores per model of a table of ``predictions``, with the improvement in RMSE over the better constant."""
    each = scores(predicted, by=["model"])
    best = each.where(F.startswith("model", F.lit("baseline_"))).agg(F.min("rmse")).scalar()
    return each.select("model", "n", "rmse", "mae", "r2", floor_round((best - F.col("rmse")) / best * 100, 1).alias("improvement_pct"))


def compare_models(train: DataFrame, test: DataFrame, params: Mapping[str, dict], **groups) -> DataFrame:
    """``predictions`` written to a table, and its scores."""
    return compared(stored(predictions(train, test, params, **groups), "predictions"))


def fold_scores(name: str, df: DataFrame, folds: int = 5, key: str = "job_id", **params) -> DataFrame:
    """Scores on each hash-chosen fold of a model fitted on the other folds."""
    rows = df.withColumn("_fold", fold(key, folds))
    out = None
    for i in range(folds):
        predicted = fit_predict(name, rows.where(F.col("_fold") != i), rows.where(F.col("_fold") == i), **params)
        one = scores(predicted).withColumn("fold", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def cross_validate(name: str, df: DataFrame, folds: int = 5, key: str = "job_id", **params) -> DataFrame:
    """Mean and deviation of the RMSE over hash-chosen folds."""
    return fold_scores(name, df, folds, key, **params).agg(F.count("*").alias("folds"), floor_round(F.avg("rmse"), 4).alias("cv_rmse_mean"),
                   floor_round(F.stddev_pop("rmse"), 4).alias("cv_rmse_std"))


def error_reason(residual: Column, pct: Column) -> Column:
    """Why a prediction is off; the residual is true minus predicted."""
    return (
        F.when(F.abs(residual) > 20, "Extreme (>20M)")
        .when(F.abs(residual) > 10, "Large error (10-20M)")
        .when(pct > 50, "High relative error (>50%)")
        .when(pct > 30, "Moderate relative error (30-50%)")
        .when(residual > 0, "Underpredicted")
        .otherwise("Overpredicted")
    )


def errors(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    residual = F.col(label) - F.col(prediction)
    pct = F.when(F.col(label) != 0, F.abs(residual / F.col(label)) * 100)
    return df.withColumns({"residual": residual, "error_pct": pct, "abs_residual": F.abs(residual),
                           "error_reason": error_reason(residual, pct)})


def worst_errors(df: DataFrame, n: int = 10, key: str = "job_id") -> DataFrame:
    return errors(df).orderBy(F.desc("abs_residual"), key).limit(n)


def residual_stats(df: DataFrame) -> DataFrame:
    r = F.col("residual")
    return errors(df).agg(
        floor_round(F.avg(r), 4).alias("mean"), floor_round(F.stddev_pop(r), 4).alias("std"), floor_round(F.min(r), 4).alias("min"),
        floor_round(F.max(r), 4).alias("max"), F.count_if(r < 0).alias("over"), F.count_if(r > 0).alias("under"))


def attribution(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Mean absolute share of each column in a linear prediction, largest first."""
    means = df.agg(*[F.avg(c).alias(c) for c in weights]).first()  # one row
    shares = df.agg(*[F.avg(F.abs(F.lit(w) * (F.col(c) - F.lit(means[c])))).alias(c) for c, w in weights.items()])
    long = shares.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in weights])).alias("x"))
    return long.select("x.feature", floor_round("x.v", 4).alias("mean_abs_share")).orderBy(F.desc("mean_abs_share"), "feature")


def importances(model, names: Sequence[str], spark) -> DataFrame:
    """Feature importances of a fitted tree or forest, largest first."""
    values = model.featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double").orderBy(
        F.desc("importance"), "feature")
