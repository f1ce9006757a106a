"""Exact top-k by inner product: a ball tree per shard, searched branch and bound.

Vectors are dealt into shards by a hash of their id.  Each shard's vectors form a tree: a ball (centre c, radius r) is split
between the two of its vectors that lie far apart, down to ``LEAF`` vectors.  No vector x in a ball has q.x above
q.c + |q| r, so a query takes a node's leaves in the order of that bound and stops where it falls under the query's k-th
score so far.  Two rounds share that score: each query first searches one shard, and the k-th score found there is its floor
in all others.

Queries go in blocks of ``BLOCK`` against shards of about ``SHARD_ROWS`` vectors: a task holds one shard and one block,
whatever the table's size.  Scores are integers computed exactly; bounds carry a slack for rounding.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do vectors without
an id; a query meets only vectors of its own length; ties go to the smaller id; repeated ids are separate candidates (all
left out for the query with that id); fewer than k candidates give all; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labourlens.session import stored

LEAF = 64
SHARD_ROWS = 16_384
BLOCK = 2_048
FOUND = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", factor: int = 64) -> DataFrame:
    """Rows that take part: vec_id long, v array<long> of floor(factor * x)."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * factor)).alias("v"))


class Tree:
    """Balls over the rows of ``x``: arrays of centres, radii, children and row ranges, root first."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.centre, self.radius, self.span, self.children = [], [], [], []
        stack = [(0, len(x), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = x[self.order[a:b]]
            centre = own.mean(axis=0)
            from_centre = np.einsum("ij,ij->i", own - centre, own - centre)
            me = len(self.centre)
            self.centre.append(centre)
            self.radius.append(math.sqrt(from_centre.max()))
            self.span.append((a, b))
            self.children.append([-1, -1])
            if parent >= 0:
                self.children[parent][side] = me
            if b - a <= LEAF or from_centre.max() == 0:
                continue
            far = own[from_centre.argmax()]
            other = own[np.einsum("ij,ij->i", own - far, own - far).argmax()]
            by = np.argsort(own @ (other - far), kind="stable")  # along the line between the two, halves of equal count
            self.order[a:b] = self.order[a:b][by]
            mid = (a + b) // 2
            stack += [(mid, b, me, 1), (a, mid, me, 0)]
        self.centre, self.radius, self.children = np.array(self.centre), np.array(self.radius), np.array(self.children)
        self.x = x[self.order]


def search(tree: Tree, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's best k rows of the shard among those that may reach its floor."""
    n = len(q)
    norm = np.sqrt(np.einsum("ij,ij->i", q, q))
    slack = 1e-9 * norm * (np.abs(tree.centre).max() + tree.radius.max() + 1) * q.shape[1] + 1e-6
    # leaves that may matter, by descent: a node is expanded for the queries whose floor its bound reaches
    leaves, bounds, wanted = [], [], []
    stack = [(0, np.arange(n))]
    while stack:
        node, who = stack.pop()
        bound = q[who] @ tree.centre[node] + norm[who] * tree.radius[node] + slack[who]
        keep = bound >= floor[who]
        who, bound = who[keep], bound[keep]
        if not len(who):
            continue
        left, right = tree.children[node]
        if left < 0:
            leaves.append(tree.span[node])
            wanted.append(who)
            bounds.append(bound)
        else:
            stack += [(left, who), (right, who)]
    best_score = np.full((n, k), -np.inf)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    kth = floor.copy()
    if leaves:
        who = np.concatenate(wanted)
        leaf = np.repeat(np.arange(len(leaves)), [len(w) for w in wanted])
        bound = np.concatenate(bounds)
        by = np.lexsort((-bound, who))  # each query takes its leaves from the highest bound down
        who, leaf, bound = who[by], leaf[by], bound[by]
        first = np.searchsorted(who, who)
        turn = np.arange(len(who)) - first
        rounds = np.argsort(turn, kind="stable")
        cuts = np.searchsorted(turn[rounds], np.arange(turn.max() + 2))
        for t in range(turn.max() + 1):
            at = rounds[cuts[t] : cuts[t + 1]]
            at = at[bound[at] >= kth[who[at]]]
            if not len(at):
                continue
            at = at[np.argsort(leaf[at], kind="stable")]
            edges = np.flatnonzero(np.diff(leaf[at], prepend=-1))
            for lo, hi in zip(edges, [*edges[1:], len(at)], strict=True):
                a, b = leaves[leaf[at[lo]]]
                own = who[at[lo:hi]]
                scores = q[own] @ tree.x[a:b].T
                cand = ids[tree.order[a:b]]
                scores[q_ids[own][:, None] == cand[None, :]] = -np.inf
                some = np.flatnonzero(scores.max(axis=1) >= kth[own])
                if not len(some):
                    continue
                own = own[some]
                s = np.hstack([best_score[own], scores[some]])
                c = np.hstack([best_id[own], np.broadcast_to(cand, (len(own), len(cand)))])
                top = np.lexsort((c, -s), axis=1)[:, :k]
                best_score[own], best_id[own] = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
                kth[own] = np.maximum(kth[own], best_score[own, -1])
    row, col = np.nonzero(np.isfinite(best_score))
    return pd.DataFrame({"query_id": q_ids[row], "vec_id": best_id[row, col], "score": best_score[row, col].astype(np.int64)})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``vectors`` and ``queries``: vec_id long, v array<long>, as ``quantised`` gives them.  Returns query_id, rank, vec_id, score."""
    shape = [F.size("v").alias("dim")]
    vectors = stored(vectors.select("vec_id", "v", *shape), "vectors")
    queries = stored(queries.select("vec_id", "v", *shape), "queries")
    shards = max(1, math.ceil(vectors.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    shard_of = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    block_of = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kept = vectors.withColumn("shard", shard_of("vec_id")).withColumn("block", numbers(blocks))
    asked = queries.withColumn("block", block_of)
    keys = ["dim", "shard", "block"]

    def run(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if own.empty or ask.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        x = np.array(own["v"].tolist(), np.float64)  # whole numbers: products and sums are exact below 2^53
        return search(Tree(x), own["vec_id"].to_numpy(), np.array(ask["v"].tolist(), np.float64), ask["vec_id"].to_numpy(), ask["floor"].to_numpy(), k)

    def best(found: DataFrame) -> DataFrame:
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", place).filter(F.col("rank") <= k)

    home = asked.withColumn("shard", shard_of("vec_id")).withColumn("floor", F.lit(-math.inf))
    found = kept.groupBy(*keys).cogroup(home.groupBy(*keys)).applyInPandas(run, FOUND)
    found = stored(found, "home")
    if shards > 1:
        floors = best(found).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("reached"))
        others = asked.withColumn("shard", numbers(shards)).filter(F.col("shard") != shard_of("vec_id"))
        others = others.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", *keys, F.coalesce("reached", F.lit(-math.inf)).alias("floor"))
        rest = kept.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(run, FOUND)
        found = found.unionByName(rest)
    return best(found).select("query_id", "rank", "vec_id", "score")
