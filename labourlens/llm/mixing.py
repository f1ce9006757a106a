"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words: its share of ``share`` times all words by weight, at most ``most`` times its own
words, with the excess reshared by weight (water filling).  Document rates are then as close to 1 as the targets allow, in
relative entropy, with no rate above ``most``.  The dual of that problem is convex and falls apart by source: the rate of a
document of z words is min(most, exp(lambda z / m)), m its source's mean size, and Newton's method finds each source's
lambda.  The steps run on counts by (source, size), so an iteration reads what grows with text lengths, not with rows;
they are safeguarded by a bracket, which halves where Newton leaves it.

Rates become whole copies so that the sums hold: along falling sizes within a source the running sum of expected copies is
rounded, which leaves a source less than one of its documents off its target; documents of one size share their copies by a
keyed hash, through salts, so that a size held by very many copies of a text is dealt out by many tasks.

Only DataFrame functions are used; the driver sees one number per iteration, the largest remaining gap.

Defined results: null texts have no words; a null source is a source, the last one; documents without words get the rate
they would have and count nothing; identical rows are interchangeable; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labourlens.session import stored

SALTS = 256
#: Newton stops when every source is this close to its target, as a part of it; never after more steps than this.
TOLERANCE, MOST_STEPS = 1e-9, 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size, n_docs; one row a source) with ``target``.

    The windows run over the table of sources, not over documents.  A source is full if its limit per weight is no more
    than the level that the sources after it would share.
    """
    every = W.partitionBy()
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("fill", F.col("limit") / F.col("weight"))
    upward = W.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("full_before", F.coalesce(F.sum("limit").over(upward), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(upward), F.lit(0.0)))
    t = t.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("full_before")) / (F.sum("weight").over(every) - F.col("weight_before")))
    t = t.withColumn("level", F.min_by(F.when(F.col("fill") > F.col("level"), F.col("level")), F.when(F.col("fill") > F.col("level"), F.col("fill"))).over(every))
    full = F.col("level").isNull() | (F.col("fill") <= F.col("level"))
    return t.select("source", "source_size", "n_docs", "weight", F.when(full, F.col("limit")).otherwise(F.col("weight") * F.col("level")).alias("target"), full.alias("full"))


def solve_rates(cells: DataFrame, targets: DataFrame, most: float = 2.0) -> DataFrame:
    """``targets`` with ``lambda`` and ``scale``.  ``cells``: source, size, n (how many documents)."""
    null = F.lit(None).cast("double")
    state = targets.select("*", (F.col("source_size") / F.col("n_docs")).alias("scale"), F.lit(0.0).alias("lambda"), null.alias("low"), null.alias("high"), F.lit(False).alias("done"))
    state = state.withColumn("done", F.col("full") | (F.col("source_size") == 0))
    for _ in range(MOST_STEPS):
        open_ = state.filter(~F.col("done")).select(F.col("source").alias("own"), "lambda", "scale")
        at = cells.join(open_, F.col("source").eqNullSafe(F.col("own")))
        part = F.col("size") / F.col("scale")
        raw = F.exp(F.least(F.col("lambda") * part, F.lit(50.0)))
        words = F.col("n") * F.col("size") * F.least(raw, F.lit(float(most)))
        slope = F.when(raw < most, F.col("n") * F.col("size") * part * raw).otherwise(0.0)
        sums = at.groupBy("own").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        gap = F.col("target") - F.col("words")
        now = state.join(sums, F.col("source").eqNullSafe(F.col("own")), "left")
        now = now.withColumn("close", F.coalesce(F.abs(gap) <= F.col("target") * TOLERANCE, F.lit(True)))
        now = now.withColumn("low", F.when(gap > 0, F.col("lambda")).otherwise(F.col("low"))).withColumn("high", F.when(gap < 0, F.col("lambda")).otherwise(F.col("high")))
        step = F.when(F.col("slope") > 0, F.col("lambda") + gap / F.col("slope"))
        inside = step.isNotNull() & F.coalesce(step > F.col("low"), F.lit(True)) & F.coalesce(step < F.col("high"), F.lit(True))
        beyond = F.when(F.col("high").isNull(), 2 * F.abs("lambda") + 1).when(F.col("low").isNull(), -2 * F.abs("lambda") - 1).otherwise((F.col("low") + F.col("high")) / 2)
        now = now.withColumn("lambda", F.when(F.col("done") | F.col("close"), F.col("lambda")).when(inside, step).otherwise(beyond))
        state = stored(now.select(*[c for c in state.columns if c != "done"], (F.col("done") | F.col("close")).alias("done")), "rates")
        if state.filter(~F.col("done")).isEmpty():
            break
    return state


def mix(df: DataFrame, source: str = "source", size: str = "size", key: str = "doc_id", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
        most: float = 2.0, seed: int = 0) -> DataFrame:
    """``df`` with ``source_size``, ``target``, ``rate`` and ``copies``."""
    made = ("source_size", "target", "rate", "copies")
    columns = [c for c in df.columns if c not in made]
    rows = df.select(F.struct(*columns).alias("row"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"),
                     F.xxhash64(F.lit(seed), F.col(key)).alias("draw"))
    rows = rows.withColumn("salt", F.pmod("draw", F.lit(SALTS)).cast("int"))
    salted = stored(rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "cells")
    cells = stored(salted.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    sizes = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    targets = stored(source_targets(sizes, weights, share, most), "targets")
    rates = solve_rates(cells, targets, most).select(F.col("source").alias("own"), "source_size", "target", "full", "lambda", "scale")

    # whole copies for each size of a source: the rounded running sum, largest documents first
    cells = cells.join(rates, F.col("source").eqNullSafe(F.col("own")))
    rate = F.when(F.col("full"), F.lit(float(most))).when(F.col("source_size") == 0, F.lit(1.0)).otherwise(F.least(F.exp(F.least(F.col("lambda") * F.col("size") / F.col("scale"), F.lit(50.0))), F.lit(float(most))))
    cells = cells.withColumn("rate", rate)
    upto = F.sum(F.col("n") * F.col("rate")).over(W.partitionBy("source").orderBy(F.desc("size")))
    cells = cells.withColumn("upto", F.floor(upto + 0.5)).withColumn("of_size", F.col("upto") - F.coalesce(F.lag("upto").over(W.partitionBy("source").orderBy(F.desc("size"))), F.lit(0)))
    cells = cells.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("n").alias("of_n"), "of_size", "source_size", "target", "rate")
    # and for each salt of a size
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    by_salt = salted.join(cells, same).withColumn("seen", F.sum("n").over(W.partitionBy("source", "size").orderBy("salt")))
    share_of = lambda seen: F.expr(f"({seen}) * of_size div of_n")
    # one key without nulls for rank and join, so that rows move once
    own = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    by_salt = by_salt.select(own.alias("own"), "size", "salt", F.col("n"), (share_of("seen") - share_of("seen - n")).alias("of_salt"), "source_size", "target", "rate")
    ranked = rows.select("row", own.alias("own"), "size", "salt", "draw").withColumn("rank", F.row_number().over(W.partitionBy("own", "size", "salt").orderBy("draw")))
    out = ranked.join(by_salt, ["own", "size", "salt"])
    copies = F.expr("rank * of_salt div n - (rank - 1) * of_salt div n")
    return out.select("row.*", "source_size", "target", "rate", copies.alias("copies"))
