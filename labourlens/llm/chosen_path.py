"""Near-duplicate texts by a chosen-path join on word n-grams.

A text is the set of its runs of ``N`` words (all of it, if it has fewer words).  Texts x and y are linked if the Jaccard
similarity of their sets is ``similarity`` or more; a class is a connected component of links, and copies of a text share
its class.

1. *Sketch.*  Each set gets ``COORDINATES`` minhashes: two sets agree in a coordinate with a chance of their similarity.
   Those are its tokens.  One representative of each distinct text goes on.
2. *Chosen paths.*  A path is a bucket.  Every path samples coordinates by a hash of its own, 1 / SPLIT of them in number on
   average, and each set goes on to the buckets (path, coordinate, its minhash there).  Buckets with one set end; those of
   at most ``SMALL`` sets are compared by brute force; larger ones are split again, and after ``DEPTH`` levels compared in
   blocks.  ``RUNS`` independent first levels repeat the search until the recall is reached: a pair at similarity 0.8 meets
   with a chance of about 0.68, 0.54, 0.46 in a run whose buckets end at level 1, 2, 3, so 16 runs miss it with about
   1e-8, 4e-6, 5e-5; more similar pairs are missed far less.  ``recall`` computes these figures.
3. *Candidates.*  In a bucket, sets whose sketches agree well enough (a true pair fails with about 2e-8) are connected by at
   most one edge per set.  Components of these edges are the groups in which links can lie.
4. *Exact check.*  The texts of a group are compared by their n-grams themselves: intersections by matrix products, in
   blocks of ``BLOCK`` texts for large groups.  A task returns a row per text (its links, and the text it is connected to),
   never a row per pair.

Everything that is dealt out by a key is bounded by a bucket or block, and nothing is collected.

Defined results: null texts and texts without words have no n-grams, no links and a class of their own; repeated ids and
rows count as rows; ties in the choice of a class's id go to the least id; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labourlens.llm.graph import components
from labourlens.session import stored

N = 5
SIMILARITY = 0.8
COORDINATES = 128
SPLIT = 0.7
RUNS = 16
DEPTH = 3
SMALL = 64
LEAF_BLOCK = 4_096
BLOCK = 256
#: Bytes of text hashed in one numpy step.
STEP_BYTES = 1 << 21
#: Fewest agreeing coordinates of a candidate: 5.4 deviations under the mean at similarity 0.8.
AGREE = 78
M1, M2, GOLD = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def recall(similarity: float, level: int) -> float:
    """The chance that a pair meets in a bucket of the given level in some run."""
    meet = 1.0
    for _ in range(level):
        meet = 1 - math.exp(-similarity / SPLIT * meet)
    return 1 - (1 - meet) ** RUNS


def mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(M2)
    return x ^ (x >> np.uint64(31))


def grams(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct word n-grams of each text, end to end and sorted, and how many each text has.

    Texts are taken in steps of at most ``STEP_BYTES`` (or one text), which bounds the arrays beside them."""
    hashes, counts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= STEP_BYTES:
            size += len(texts[to])
            to += 1
        h, c = _grams(texts[at:to], n)
        hashes.append(h)
        counts.append(c)
        at = to
    return np.concatenate(hashes), np.concatenate(counts)


def _grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words are hashed by a prefix sum over their bytes, so the cost is a few passes over the bytes whatever the words are."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    # a word's hash: sum of mixed bytes times powers of an odd number, taken back to the word's start
    power, undo = _powers(GOLD | 1, len(raw)), _powers(pow(GOLD | 1, -1, 1 << 64), len(raw))
    table = mix(np.arange(256, dtype=np.uint64) * np.uint64(GOLD) + np.uint64(1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(table[raw] * power, dtype=np.uint64)])
    words = mix((sums[end] - sums[start]) * undo[start] + (end - start).astype(np.uint64) * np.uint64(GOLD))
    n_words = np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)])))
    first_word = np.cumsum(n_words) - n_words
    n_grams = np.where(n_words > 0, np.maximum(1, n_words - n + 1), 0)
    doc = np.repeat(np.arange(len(texts)), n_grams)
    at = np.arange(n_grams.sum()) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams) + first_word[doc]
    length = np.minimum(n, n_words)[doc]
    hashes = np.zeros(len(at), np.uint64)
    for k in range(n if len(at) else 0):
        use = k < length
        hashes = np.where(use, mix(hashes * np.uint64(M1) + words[np.where(use, at + k, 0)] + np.uint64(k + 1)), hashes)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(texts))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, np.uint64(base))
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def sketches(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Minhashes [texts, COORDINATES] as 32-bit numbers; texts without n-grams must be left out."""
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), COORDINATES), np.uint32)
    for c in range(COORDINATES):
        odd = mix(np.array([c + 1], np.uint64) * np.uint64(GOLD))[0] | np.uint64(1)
        x = (hashes ^ (hashes >> np.uint64(29))) * odd
        out[:, c] = (np.minimum.reduceat(x, starts) >> np.uint64(32)).astype(np.uint32)
    return out


def next_paths(path: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket): where each row's path leads.  The coordinates are sampled by the path alone."""
    limit = np.uint64(int(2**64 / (SPLIT * COORDINATES)))
    rows, found = [], []
    for c in range(COORDINATES):
        draw = mix(path + np.uint64(c + 1) * np.uint64(GOLD))
        at = np.flatnonzero(draw < limit)
        rows.append(at)
        found.append(mix(draw[at] ^ (sketch[at, c].astype(np.uint64) + np.uint64(c) * np.uint64(1 << 32)) * np.uint64(M2)))
    return np.concatenate(rows), np.concatenate(found)


def groups_of(batches: Iterator[pa.RecordBatch], key: str, least_rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``, several groups at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least_rows:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut)
                held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def sketched(df: DataFrame) -> DataFrame:
    """``df`` (with a column ``text``) with the number of n-grams, the sketch, and its low bytes for quick comparison."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for lo in range(0, whole.num_rows, 500):
                    batch = whole.slice(lo, 500)
                    hashes, counts = grams([(t or "").encode() for t in batch.column("text").to_pylist()])
                    some = np.flatnonzero(counts)
                    made = sketches(hashes, counts[some]) if len(some) else np.zeros((0, COORDINATES), np.uint32)
                    full, near = [None] * len(counts), [None] * len(counts)
                    for i, row in zip(some.tolist(), made, strict=True):
                        full[i], near[i] = row.tobytes(), row.astype(np.uint8).tobytes()
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int32()), pa.array(full, pa.binary()), pa.array(near, pa.binary())],
                                                     names=[*names, "size", "sketch", "near"])

    schema = T.StructType([*df.schema.fields, T.StructField("size", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("near", T.BinaryType())])
    return df.mapInArrow(run, schema)


def first_paths(df: DataFrame) -> DataFrame:
    """(rid, sketch) to (path, rid): the first level of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                n = batch.num_rows
                sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(n, COORDINATES)
                for r in range(RUNS if n else 0):
                    rows, paths = next_paths(np.full(n, mix(np.uint64(r + 1))), sketch)
                    yield pa.RecordBatch.from_pydict({"path": pa.array(paths.astype(np.int64)), "rid": batch.column("rid").take(pa.array(rows))})

    return df.select("rid", "sketch").mapInArrow(run, "path long, rid long")


def split(df: DataFrame) -> DataFrame:
    """(path, rid, sketch) to (path, rid) one level down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                n = batch.num_rows
                if n:
                    sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(n, COORDINATES)
                    rows, paths = next_paths(batch.column("path").to_numpy().astype(np.uint64), sketch)
                    yield pa.RecordBatch.from_pydict({"path": pa.array(paths.astype(np.int64)), "rid": batch.column("rid").take(pa.array(rows))})

    return df.select("path", "rid", "sketch").mapInArrow(run, "path long, rid long")


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (least member) of n nodes under edges a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            return label
    return label


def connect(rows: np.ndarray, sketch: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """For the rows of one bucket, the row each is connected to by candidate pairs (least position), without listing pairs."""
    n = len(rows)
    label = np.arange(n)
    for i in range(n):
        other = np.flatnonzero(label != label[i])
        if not len(other):
            break
        other = other[(10 * np.minimum(size[other], size[i]) >= round(10 * similarity) * np.maximum(size[other], size[i]))]
        near = other[(sketch[other] == sketch[i]).sum(axis=1) >= AGREE]
        if len(near):
            joined = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, joined)] = joined[0]
    return label


def candidate_edges(df: DataFrame, similarity: float) -> DataFrame:
    """(leaf, rid, size, near binary), sorted within tasks by leaf, to edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "leaf"):
            leaf, rid, size = (table.column(c).to_numpy() for c in ("leaf", "rid", "size"))
            near = np.frombuffer(b"".join(table.column("near").to_pylist()), np.uint8).reshape(len(rid), COORDINATES)
            cut = np.flatnonzero(np.diff(leaf, prepend=leaf[0] - 1))
            length = np.diff(np.append(cut, len(leaf)))
            label = np.arange(len(leaf))
            # all pairs of the small leaves at once, distance by distance
            small = np.repeat(length <= SMALL, length)
            last = np.repeat(cut + length, length)
            a_all, b_all = [], []
            for step in range(1, int(length[length <= SMALL].max(initial=1))):
                a = np.flatnonzero(small & (np.arange(len(leaf)) + step < last))
                b = a + step
                fits = 10 * np.minimum(size[a], size[b]) >= round(10 * similarity) * np.maximum(size[a], size[b])
                a, b = a[fits], b[fits]
                for lo in range(0, len(a), 100_000):
                    x, y = a[lo : lo + 100_000], b[lo : lo + 100_000]
                    ok = (near[x] == near[y]).sum(axis=1) >= AGREE
                    a_all.append(x[ok])
                    b_all.append(y[ok])
            if a_all:
                label = least_labels(len(leaf), np.concatenate(a_all), np.concatenate(b_all))
            for s, n in zip(cut[length > SMALL], length[length > SMALL], strict=True):
                label[s : s + n] = s + connect(rid[s : s + n], near[s : s + n], size[s : s + n], similarity)
            at = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_pydict({"a": pa.array(rid[label[at]]), "b": pa.array(rid[at])})

    return df.select("leaf", "rid", "size", "near").mapInArrow(run, "a long, b long")


def common(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sizes of the pairwise intersections of sets, [sets, sets], by products of indicator matrices over shared members."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    value, place, held = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = held[place] > 1
    column = (np.cumsum(held > 1) - 1)[place[shared]]
    owner = owner[shared]
    out = np.zeros((n, n), np.float64)
    width = int((held > 1).sum())
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    step = 4096
    for lo in range(0, width, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        x = np.zeros((n, min(step, width - lo)), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def verified(df: DataFrame, similarity: float, text: str) -> DataFrame:
    """(task long, i int, j int, block int, rid, weight, text), sorted by task, to (rid, links, a): how many rows each text is
    linked with in its task, and the least text it is connected to there."""
    tenths = round(10 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for table in groups_of(batches, "task", 2_000):
                task, rid, weight, block = (table.column(c).to_numpy() for c in ("task", "rid", "weight", "block"))
                cross = table.column("i").to_numpy() != table.column("j").to_numpy()
                hashes, counts = grams([t.encode() for t in table.column(text).to_pylist()])
                start = np.cumsum(counts) - counts
                cut = np.flatnonzero(np.diff(task, prepend=task[0] - 1))
                out_rid, out_links, out_a = [], [], []
                for s, e in zip(cut, [*cut[1:], len(task)], strict=True):
                    own = counts[s:e]
                    both = common(hashes[start[s] : start[e - 1] + counts[e - 1]], own)
                    # |x & y| / |x | y| >= t, in whole numbers
                    linked = (10 + tenths) * both >= tenths * (own[:, None] + own[None, :])
                    np.fill_diagonal(linked, False)
                    if cross[s]:
                        linked &= block[s:e][:, None] != block[s:e][None, :]
                    a, b = np.nonzero(linked)
                    label = least_labels(e - s, a, b)
                    out_rid.append(rid[s:e])
                    out_links.append(linked @ weight[s:e])
                    out_a.append(rid[s + label])
                yield pa.RecordBatch.from_pydict({"rid": pa.array(np.concatenate(out_rid)), "links": pa.array(np.concatenate(out_links).astype(np.int64)), "a": pa.array(np.concatenate(out_a))})

    return df.select("task", "i", "j", "block", "rid", "weight", text).mapInArrow(run, "rid long, links long, a long")


def blocks(df: DataFrame, size: Column, block: int) -> DataFrame:
    """Rows of a group of ``size`` rows, once for each pair of blocks that needs them: columns block, i, j (i <= j)."""
    n = F.greatest(F.lit(1), F.ceil(size / F.lit(block))).cast("int")
    df = df.withColumn("n_blocks", n).withColumn("block", F.pmod(F.xxhash64("rid", F.lit(7)), n).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return df.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))


def candidates(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, component): groups of sets (rid, size, sketch, near) in which all links lie, but for the recall."""
    leaves = None
    level = first_paths(sets)
    for depth in range(1, DEPTH + 1):
        level = stored(level, "level")
        held = level.groupBy("path").agg(F.count("*").alias("held")).filter(F.col("held") > 1)
        level = level.join(held, "path")
        small = level.filter(F.col("held") <= SMALL).select(F.col("path").alias("leaf"), "rid")
        leaves = small if leaves is None else leaves.unionByName(small)
        large = level.filter(F.col("held") > SMALL)
        if depth < DEPTH:
            level = split(large.select("path", "rid").join(sets.select("rid", "sketch"), "rid"))
        else:
            crowded = blocks(large, F.col("held"), LEAF_BLOCK).select(F.xxhash64("path", "i", "j").alias("leaf"), "rid")
            leaves = leaves.unionByName(crowded)
    leaves = leaves.join(sets.select("rid", "size", "near"), "rid").repartition("leaf").sortWithinPartitions("leaf")
    return components(candidate_edges(leaves, similarity))


def labelled(df: DataFrame, text: str, key: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows, numbered (rid, row: the other columns, text), and their labels (rid, class_id, links, keeper)."""
    if not 0.8 <= similarity <= 1 or round(10 * similarity) / 10 != similarity:
        raise ValueError("similarity must be 0.8, 0.9 or 1: search and sketches are laid out for 0.8 and more, the check counts tenths")
    # rows are numbered and written down once, so that nothing depends on how often the input is read
    rows = df.select(F.struct(*[c for c in df.columns if c != text], F.lit(0).alias("_")).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), F.md5(F.col(text).cast("binary")).alias("digest"))
    rows = stored(sketched(rows.withColumn("rid", F.monotonically_increasing_id())), "rows")
    # one row stands for each text
    reps = stored(rows.filter(F.col("size") > 0).groupBy("digest").agg(F.min("rid").alias("rid"), F.count("*").alias("weight")), "texts")
    sets = stored(rows.select("rid", "size", "sketch", "near").join(reps.select("rid"), "rid"), "sets")

    groups = stored(candidates(sets, similarity), "groups")
    held = groups.groupBy("component").agg(F.count("*").alias("held"))
    members = blocks(groups.join(held, "component").withColumnRenamed("node", "rid"), F.col("held"), BLOCK)
    members = members.select(F.xxhash64("component", "i", "j").alias("task"), "i", "j", "block", "rid").join(reps.select("rid", "weight"), "rid")
    members = members.join(rows.select("rid", "text"), "rid").repartition("task").sortWithinPartitions("task")
    found = stored(verified(members, similarity, "text"), "links")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    joined = components(found.select("a", F.col("rid").alias("b")))

    named = reps.join(links, "rid", "left").join(joined.select(F.col("node").alias("rid"), "component"), "rid", "left")
    named = named.select(F.col("digest").alias("of"), F.coalesce("component", "rid").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    labels = rows.select("key", "rid", F.when(F.col("size") > 0, F.col("digest")).alias("digest")).join(named, F.col("digest") == F.col("of"), "left")
    labels = stored(labels.select("key", "rid", F.coalesce("class", "rid").alias("class"), F.coalesce("links", F.lit(0)).cast("long").alias("links")), "labels")
    first = labels.groupBy("class").agg(F.min("key").alias("class_id"), F.min(F.struct(F.col("key").isNull(), "key", "rid")).alias("first"))
    labels = labels.join(first.select("class", "class_id", F.col("first.rid").alias("kept")), "class")
    return rows, labels.select("rid", "class_id", "links", (F.col("rid") == F.col("kept")).alias("keeper"))


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """All columns but the text, with ``class_id`` (the least key of the class), ``links`` (how many other rows the row is
    linked with) and ``keeper`` (true for one row of each class: the least key, then the first row)."""
    made = ("class_id", "links", "keeper")
    columns = [c for c in df.columns if c != text and c not in made]
    rows, labels = labelled(df.select(*columns, text), text, key, similarity)
    return rows.select("rid", "row").join(labels, "rid").select(*[F.col(f"row.{c}") for c in columns], *made)


def keepers(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` that stay when one of each class is kept, with all their columns."""
    rows, labels = labelled(df, text, key, similarity)
    kept = rows.select("rid", "row", "text").join(labels.filter("keeper").select("rid"), "rid")
    return kept.select(*[F.col("text").alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in df.columns])
