"""Column profiles: counts, shares, gaps, statistics and the data behind charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labourlens.functions.text import floor_round
from labourlens.operators.quantiles import counted, join_stats, known_values, quantiles_of
from labourlens.session import stored


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-null values and how often each occurs."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def shares(df: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """``value_counts`` with the percentage of all counted rows."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n").alias("_total"))
    return join_stats(counts, total, []).select(column, "n", floor_round(F.col("n") * 100.0 / F.col("_total"), digits).alias("pct"))


def null_report(df: DataFrame) -> DataFrame:
    """Missing count and percentage of every column that has gaps, in one pass."""
    counted = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counted.select("_rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in df.columns])).alias("x"))
    return (
        long.select("x.*", floor_round(F.col("x.n_missing") * 100.0 / F.col("_rows"), 2).alias("pct_missing"))
        .where("n_missing > 0").orderBy(F.desc("n_missing"), "column_name")
    )


def numeric_profile(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Count, mean, median, sample deviation, extremes and quartiles of each column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    ).select("x.*")
    known = known_values(long, ["column_name"], "v")
    q = quantiles_of(known, ["column_name"], {"median": 0.5, "q25": 0.25, "q75": 0.75})
    v = F.col("_v")
    # the deviation is merged from partial means and squares about them, so large values lose no digits
    basic = known.groupBy("column_name").agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    joined = basic.join(q, "column_name")
    std = F.when(F.col("n") > 1, F.col("std"))
    return joined.select(
        "column_name", "n",
        *[floor_round(c, digits).alias(c) for c in ("mean", "median")],
        floor_round(std, digits).alias("std"),
        *[floor_round(c, digits).alias(c) for c in ("min", "max", "q25", "q75")],
    )


def stats_by(df: DataFrame, key: str, value: str, digits: int = 1) -> DataFrame:
    """Mean, median and count of the known values per non-null key."""
    known = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    values = known_values(known, [key], value)
    base = values.groupBy(key).agg(F.avg("_v").alias("mean"), F.count("*").alias("n"))
    joined = join_stats(base, quantiles_of(values, [key], {"median": 0.5}), [key])
    return joined.select(key, floor_round("mean", digits).alias("mean"), floor_round("median", digits).alias("median"), "n")


def boxplot(df: DataFrame, key: str, value: str, digits: int = 4) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and outlier count per key."""
    values = known_values(df.where(F.col(key).isNotNull()), [key], value)
    q = quantiles_of(values, [key], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    fences = q.withColumns({
        "_lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
        "_hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
    })
    v, inside = F.col("_v"), F.col("_v").between(F.col("_lo"), F.col("_hi"))
    marked = join_stats(values, fences, [key])
    return marked.groupBy(key).agg(
        *[floor_round(F.first(c), digits).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.count("*").alias("n"),
    )


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the extremes; the last bin is closed on the right."""
    v = F.col(value).cast("double")
    known = df.where(v.isNotNull()).select(v.alias("v"))
    limits = known.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = join_stats(known, limits, [])
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.when(F.col("hi") == F.col("lo"), 0).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    binned = placed.groupBy(index.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    return binned.select("bin", (F.col("lo") + F.col("bin") * width).alias("bin_low"), "n")


def density(df: DataFrame, key: str, value: str, points: int = 32) -> DataFrame:
    """Gaussian kernel density per key on an even grid, bandwidth by Scott's rule.

    Values are counted first and the grid is unrolled per distinct value, so the
    work follows the number of distinct values, not the number of rows.
    """
    freq = stored(counted(known_values(df.where(F.col(key).isNotNull()), [key], value)), "counts")
    n, v = F.col("_n"), F.col("_v")
    basic = freq.groupBy(key).agg(F.sum(n).alias("n"), (F.sum(n * v) / F.sum(n)).alias("mean"),
                                  F.min(v).alias("lo"), F.max(v).alias("hi"))
    about = join_stats(freq, basic, [key]).groupBy(key, "n", "lo", "hi").agg(
        F.sqrt(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))) / (F.col("n") - 1)).alias("sd"))
    shaped = about.where((F.col("n") > 1) & (F.col("sd") > 0)).withColumn("bw", F.col("sd") * F.pow("n", F.lit(-0.2)))
    grid = join_stats(freq, shaped, [key]).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)
    z = (x - v) / F.col("bw")
    return grid.groupBy(key, "i", "n", "lo", "hi", "bw").agg(F.sum(n * F.exp(-0.5 * z * z)).alias("_s")).select(
        key, "i", floor_round(x, 4).alias("x"),
        floor_round(F.col("_s") / (F.col("n") * F.col("bw") * F.sqrt(2 * F.pi())), 6).alias("density"))


def trend(df: DataFrame, x: str, y: str, digits: int = 4) -> DataFrame:
    """Least-squares line through (x, y)."""
    return df.agg(
        F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"),
        floor_round(F.regr_slope(y, x), digits).alias("slope"),
        floor_round(F.regr_intercept(y, x), digits).alias("intercept"),
        floor_round(F.regr_r2(y, x), digits).alias("r2"),
    )


def ordered_by(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Rows in the order of a closed domain, other values last."""
    position = F.array_position(F.array(*[F.lit(x) for x in domain]), F.col(column))
    return df.orderBy(F.when(position == 0, len(domain) + 1).otherwise(position), column)


def crosstab_pct(df: DataFrame, row: str, column: str, values: Sequence[str], digits: int = 1) -> DataFrame:
    """Share in percent of each of ``values`` within a row key."""
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    return known.groupBy(row).agg(*[
        floor_round(F.count_if(F.col(column) == x) * 100.0 / F.count("*"), digits).alias(x) for x in values])


def pivot_mean(df: DataFrame, row: str, column: str, value: str, values: Sequence[str], digits: int = 1) -> DataFrame:
    """Mean of ``value`` per row key and closed list of column values."""
    known = df.where(F.col(row).isNotNull() & F.col(value).isNotNull() & F.col(column).isin(*values))
    wide = known.groupBy(row).pivot(column, list(values)).agg(F.avg(value))
    return wide.select(row, *[floor_round(F.col(f"`{x}`"), digits).alias(x) for x in values])
