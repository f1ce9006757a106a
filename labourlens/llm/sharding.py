"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows fall into blocks by a hash.  How many rows of block b go to shard s is drawn for all blocks at once: the matrix of
counts of a uniform random permutation, whose rows sum to the block sizes and whose columns sum to the shard sizes (at most
one apart).  Each block is permuted by a keyed hash and dealt out by its counts, and each shard is permuted again, which
gives a uniform permutation of all rows while every row moves once.

The second permutation needs a row's rank within its shard.  Shards grow with the data, so they are cut into ranges of the
keyed hash; a row's slot is the size of the ranges before its own plus its rank inside it.  No task sorts more than a range.

The driver handles one row of counts per block, never rows of the data.

Defined results: any column may be null; identical rows are interchangeable; rows of the same key but different content
are told apart by content; no rows give no rows.  The same input and seed give the same shards under any partitioning.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 20_000
#: Most blocks, so that the driver's matrix stays under some tens of MB; beyond that blocks grow with the data.
MOST_BLOCKS = 65_536
RANGES = 4_096


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good: exact, by inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u, up, down, k_up, k_down = rng.random() - p, p, p, mode, mode
    while u > 0 and (k_up < high or k_down > low):
        if k_up < high:
            up *= (good - k_up) * (draws - k_up) / ((k_up + 1) * (bad - draws + k_up + 1))
            k_up += 1
            u -= up
            if u <= 0:
                return k_up
        if k_down > low:
            down *= k_down * (bad - draws + k_down) / ((good - k_down + 1) * (draws - k_down + 1))
            k_down -= 1
            u -= down
            if u <= 0:
                return k_down
        if up + down < 1e-300:
            break
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts [block][shard] of a uniform random permutation: each block draws from what the shards have left."""
    rng = random.Random(seed)
    left, rest, matrix = list(shards), sum(shards), []
    for size in blocks:
        row, need, pool = [], size, rest
        for s, room in enumerate(left):
            k = hypergeometric(rng, room, pool - room, need)
            row.append(k)
            left[s] -= k
            need, pool = need - k, pool - room
        rest -= size
        matrix.append(row)
    return matrix


def _row_hash(df: DataFrame, key: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in key])


def shuffle(df: DataFrame, key: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` and ``slot``, in place of columns of these names.  ``key``: columns that tell rows apart as far as
    they differ at all."""
    spark: SparkSession = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = df.count()
    n_blocks = min(MOST_BLOCKS, rows // ROWS_PER_BLOCK + 1)
    df = df.select(F.struct(*df.columns).alias("row"), F.pmod(_row_hash(df, key, seed), F.lit(n_blocks)).cast("int").alias("block"),
                   _row_hash(df, key, seed + 1).alias("first"), _row_hash(df, key, seed + 2).alias("second"))
    counted = {r["block"]: r["n"] for r in df.groupBy("block").agg(F.count("*").alias("n")).collect()}
    sizes = [counted.get(b, 0) for b in range(n_blocks)]
    matrix = communication_matrix(sizes, shard_sizes(sum(sizes), shards), seed)
    upto = []
    for b, row in enumerate(matrix):
        total, sums = 0, []
        for k in row:
            total += k
            sums.append(total)
        upto.append((b, sums))
    counts = spark.createDataFrame(upto, "block int, upto array<long>")
    # locally permuted, dealt out by the block's counts: the shard is the first whose running count passes the rank
    dealt = df.withColumn("rank", F.row_number().over(W.partitionBy("block").orderBy("first", "second"))).join(counts, "block")
    dealt = dealt.select("row", "second", F.size(F.filter("upto", lambda x: x < F.col("rank"))).alias("shard"))
    # permuted again inside the shard, range by range of the keyed hash
    width = 2**64 // RANGES
    dealt = dealt.withColumn("range", (F.floor(F.col("second").cast("decimal(20,0)") / F.lit(width))).cast("int"))
    before = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = before.select("shard", "range", (F.sum("n").over(W.partitionBy("shard").orderBy("range")) - F.col("n")).alias("offset"))
    within = F.row_number().over(W.partitionBy("shard", "range").orderBy("second")) - 1
    out = dealt.withColumn("within", within).join(before, ["shard", "range"])
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "shard", (F.col("offset") + F.col("within")).alias("slot"))
