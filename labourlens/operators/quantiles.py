"""Exact quantiles by group that never hold a group in one buffer.

The built-in ``percentile`` keeps every distinct value of a group in one
aggregation buffer.  Here the values are put into coarse bins, counted per bin
on the map side, and only the bins that hold a wanted rank go on.  Such a bin is
split again, between its own extremes, until it holds few distinct values; then
those are counted and ordered.  No step shuffles the values outside the wanted
bins, and no task orders more than ``MOST_VALUES`` distinct values of a bin.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labourlens.session import stored

BINS_PER_E = 256  # a first bin is about 0.4 % wide
SPLIT = 4096  # parts of a bin that is split again
MOST_VALUES = 100_000


def known_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The non-null values as ``(*keys, _v)``, written once without an exchange:
    what follows reads them several times, and the rows behind are parsed once."""
    v = F.col(value).cast("double")
    return stored(df.where(v.isNotNull()).select(*keys, v.alias("_v")), "values")


def counted(values: DataFrame) -> DataFrame:
    """The distinct values with their counts ``_n``, for work that goes by distinct value."""
    return values.groupBy(*values.columns).agg(F.count("*").alias("_n"))


def _bin(v: Column) -> Column:
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * BINS_PER_E)).cast("long")


def _part(v: Column, low: Column, high: Column) -> Column:
    """Which of ``SPLIT`` parts between the extremes of its bin a value falls in."""
    share = (v / 2 - low / 2) / (high / 2 - low / 2)  # halves, for the width may exceed the largest double
    return F.when(low < high, F.floor(share * (SPLIT - 1))).otherwise(0).cast("long")


def _wanted(parts: DataFrame, group: Sequence[str], part: str, wants: Column | str) -> DataFrame:
    """Of the counted parts of every group those that hold a wanted rank, ranks counted from the part's start."""
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))  # a row per part: at most some 360,000 first bins, later SPLIT
    ranged = parts.withColumns({"_start": F.sum("_c").over(w.orderBy(part)) - F.col("_c"), "_total": F.sum("_c").over(w)})
    inside = F.filter(wants, lambda x: (x["rank"] >= F.col("_start")) & (x["rank"] < F.col("_start") + F.col("_c")))
    return ranged.withColumn("_w", F.transform(inside, lambda x: F.struct(
        x["p"].alias("p"), x["side"].alias("side"), (x["rank"] - F.col("_start")).alias("rank"), x["frac"].alias("frac")))).where(F.size("_w") > 0)


def _only(values: DataFrame, picked: DataFrame, same: Sequence[str]) -> DataFrame:
    """``values`` of the picked parts; null keys are equal."""
    right = picked.select(*[F.col(c).alias(f"_r_{c}") for c in same], *[c for c in picked.columns if c not in same])
    on = _all([F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in same])
    return values.join(right, on).drop(*[f"_r_{c}" for c in same])


def quantiles_of(values: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """``(*keys, one column per entry of probs)`` of known values, interpolated
    linearly between the two nearest ranks."""
    names, keys = list(probs), list(keys)
    ranks = []
    for i, name in enumerate(names):
        at = (F.col("_total") - 1) * F.lit(float(probs[name]))
        ranks += [F.struct(F.lit(i).alias("p"), F.lit(side).alias("side"), rank.cast("long").alias("rank"), (at - F.floor(at)).alias("frac"))
                  for side, rank in enumerate((F.floor(at), F.ceil(at)))]
    extremes = [F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    # a bin is known by its place on every level so far
    binned = values.select(*keys, "_v", F.array(_bin(F.col("_v"))).alias("_place"))
    parts = binned.groupBy(*keys, "_place").agg(*extremes)
    picked = stored(_wanted(parts, keys, "_place", F.array(*ranks)).select(*keys, "_place", "_w", "_c", "_low", "_high"), "bins")
    inside = binned
    while not picked.where((F.col("_c") > MOST_VALUES) & (F.col("_low") < F.col("_high"))).isEmpty():
        # only the wanted bins are read on; a bin of one value stays as it is
        deeper = _only(inside, picked, [*keys, "_place"]).select(
            *keys, "_v", F.col("_place").alias("_of"), "_w", F.concat("_place", F.array(_part(F.col("_v"), F.col("_low"), F.col("_high")))).alias("_place"))
        inside = stored(deeper, "inside")
        parts = inside.groupBy(*keys, "_of", "_place").agg(F.first("_w").alias("_wants"), *extremes)
        picked = stored(_wanted(parts, [*keys, "_of"], "_place", "_wants").select(*keys, "_place", "_w", "_c", "_low", "_high"), "bins")
        inside = inside.select(*keys, "_v", "_place")
    fine = _only(inside, picked.select(*keys, "_place", "_w"), [*keys, "_place"])
    fine = fine.groupBy(*keys, "_place", "_v").agg(F.count("*").alias("_n"), F.first("_w").alias("_w"))
    end = F.sum("_n").over(W.partitionBy(*keys, "_place").orderBy("_v"))
    hits = fine.withColumn("_end", end).select(*keys, "_v", F.explode(F.filter(
        "_w", lambda w: (w["rank"] < F.col("_end")) & (w["rank"] >= F.col("_end") - F.col("_n")))).alias("w"))
    out = []
    for i, name in enumerate(names):
        mine = F.col("w.p") == i
        low = F.max(F.when(mine & (F.col("w.side") == 0), F.col("_v")))
        high = F.max(F.when(mine & (F.col("w.side") == 1), F.col("_v")))
        frac = F.max(F.when(mine, F.col("w.frac")))
        out.append((low + (high - low) * frac).alias(name))
    return hits.groupBy(*keys).agg(*out)


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    return quantiles_of(known_values(df, keys, value), keys, probs)


def join_stats(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two per-group tables on possibly null keys; with no keys, a table and a one-row table."""
    if not keys:
        one = F.broadcast(right.withColumn("_one", F.lit(1)))  # one row
        return left.withColumn("_one", F.lit(1)).join(one, "_one", how).drop("_one")
    renamed = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)],
                           *[c for c in right.columns if c not in keys])
    on = _all([F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)])
    return left.join(renamed, on, how).drop(*[f"_r{i}" for i in range(len(keys))])
