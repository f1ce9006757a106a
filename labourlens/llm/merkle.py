"""A Merkle manifest of a table: one tree of digests per group, one tree over the groups, and proofs of single rows.

Up to ``ARITY`` consecutive nodes become their digest, level by level, until one node is left; a last run may be shorter,
even of one.  Trees are written as an append log in postorder: a node follows all nodes below it.  Its place in the log
follows from the sizes of full subtrees alone: a node of level h whose last leaf is e stands at ``e // 1 + e // 8 + e // 64
+ … + h``, for so many nodes of each level are complete before leaf e.  So aligned builders, each with a segment of 8^4
leaves (or of 8^4 roots of segments, in the next round), write their nodes in completion order without knowing of each
other, and a proof finds every sibling by position.

A row's place in its tree comes from a range partitioning by (group, order, leaf) and counts per partition: no task orders
a group, and rows that are equal in all of these are spread by a salt.  No task holds more than a segment.  The driver
learns the largest number of leaves and the root.

Defined results: nulls are written as such into a leaf, a null group is a group of its own and comes first, null order
values come first; rows of equal order stand in the order of their leaves, so that equal rows are interchangeable; an
empty text differs from a null one; no rows give no rows.  Input columns named like results give way to them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labourlens.session import stored

BITS = 3
ARITY = 1 << BITS
#: Levels that one builder completes: segments of 8^4 leaves.
SEGMENT_LEVELS = 4
TOP = ""  # name of the tree over the groups; others start with 0 or 1
LOG = (T.StructType().add("tree", T.StringType()).add("n", T.LongType()).add("level", T.IntegerType()).add("place", T.LongType())
       .add("position", T.LongType()).add("digest", T.StringType()).add("root", T.BooleanType()))
#: Per level, from the leaf up: the place in the run, and the run's other nodes.
PATH = T.StructField("path", T.ArrayType(T.StructType().add("at", T.IntegerType()).add("others", T.ArrayType(T.StringType()))))


@dataclass(frozen=True)
class Manifest:
    leaves: DataFrame  # row, tree, n, place, leaf
    groups: DataFrame  # name of a tree, n, place in the tree of trees, leaf: its root
    log: DataFrame  # LOG: all nodes of all trees
    root: str | None


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, a null as a dash."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above the leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def position(level: int, last: int) -> int:
    """Place in the log of the node of this level whose last leaf is ``last``."""
    p = level
    while last:
        p += last
        last >>= BITS
    return p


def last_leaf(level: int, place: int, n: int) -> int:
    return min((place + 1) << BITS * level, n) - 1


def hashed(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def completed(entries: Iterable[tuple[int, str]], level: int, n: int) -> Iterator[tuple[int, int, int, str]]:
    """(level, place, position, digest) of the nodes over the entries of one segment, in completion order; leaves come too."""
    top = min(level + SEGMENT_LEVELS, height(n))
    runs: list[list[str]] = [[] for _ in range(top - level)]
    for place, digest in entries:
        last = last_leaf(level, place, n)
        if level == 0:
            yield 0, place, position(0, place), digest
        for h in range(level, top):
            run = runs[h - level]
            run.append(digest)
            if len(run) < ARITY and last != n - 1:
                break
            place, digest = place >> BITS, hashed(run)
            run.clear()
            yield h + 1, place, position(h + 1, last), digest


def fold(digest: str, path: Sequence[dict]) -> str:
    """The root that a leaf and its siblings give."""
    for step in path:
        digest = hashed([*step["others"][: step["at"]], digest, *step["others"][step["at"]:]])
    return digest


def _per_segment(rows: DataFrame, order: Sequence[str], run: Callable[[Iterator[dict]], Iterable[dict]], schema: T.StructType) -> DataFrame:
    """``run`` over the rows of every (tree, segment), in order; one segment is held at a time."""
    arrow = to_arrow_schema(schema)

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = itertools.chain.from_iterable(b.to_pylist() for b in batches)
        made = itertools.chain.from_iterable(run(group) for _, group in itertools.groupby(read, key=lambda r: (r["tree"], r["segment"])))
        while out := list(itertools.islice(made, 4096)):
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition("tree", "segment").sortWithinPartitions("tree", "segment", *order).mapInArrow(all_, schema)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place``, from 0, within ``tree`` (not null) by ``order``, and ``n``, the rows of the tree."""
    salted = stored(rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())), "leaves")
    keys = ["tree", *order, "_salt"]
    ranged = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged.drop("_salt").withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}), "ranged")
    counts = ranged.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row per partition and tree
    upto = F.sum("_n").over(W.partitionBy("tree").orderBy("_part")) - F.col("_n")
    counts = counts.select("tree", "_part", "_first", upto.alias("_before"), F.sum("_n").over(W.partitionBy("tree")).alias("n"))
    out = ranged.join(counts, ["tree", "_part"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before"))
    return out.drop("_part", "_at", "_first", "_before")


def _write(leaves: DataFrame) -> DataFrame:
    """The log of all trees: rounds of aligned builders, each over the roots of the segments before."""
    entries, log, level = leaves.select("tree", "n", "place", F.col("leaf").alias("digest")), None, 0
    most = height(leaves.agg(F.max("n")).first()[0] or 0)
    while log is None or level < most:
        def build(group: Iterator[dict], level: int = level) -> Iterator[dict]:
            first = next(group)
            tree, n = first["tree"], first["n"]
            top = height(n)
            for h, place, at, digest in completed(((r["place"], r["digest"]) for r in itertools.chain([first], group)), level, n):
                yield {"tree": tree, "n": n, "level": h, "place": place, "position": at, "digest": digest, "root": h == top}

        written = stored(_per_segment(entries.withColumn("segment", F.shiftright("place", BITS * SEGMENT_LEVELS)), ["place"], build, LOG), "log")
        log, level = written if log is None else log.unionByName(written), level + SEGMENT_LEVELS
        entries = written.where((F.col("level") == level) & ~F.col("root")).select("tree", "n", "place", "digest")
    return log


def build(rows: DataFrame, group: Column, order: Column, leaf: Column) -> Manifest:
    """The manifest of ``rows``; keep them narrow, for all their columns travel with the leaves."""
    tree = F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string")))
    leaves = numbered(rows.select(F.struct("*").alias("row"), tree.alias("tree"), order.alias("order"), leaf.alias("leaf")), ["order", "leaf"])
    leaves = stored(leaves.drop("order"), "leaves")
    log = _write(leaves)
    roots = log.where("root").select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), F.col("n").alias("members"), F.col("digest").alias("leaf"))
    groups = stored(numbered(roots, ["name"]), "groups")
    log = log.unionByName(_write(groups))
    top = log.where(F.col("root") & (F.col("tree") == TOP)).select("digest").first()
    return Manifest(leaves, groups, log, top and top[0])


def _extended(contexts: DataFrame, log: DataFrame, entries: DataFrame, level: int, emit: Callable[[dict, list[dict], dict], dict], schema: T.StructType) -> DataFrame:
    """``emit(entry, path, context)`` for every node of ``level`` in ``entries``: its siblings within its segment, found in the
    log by position, then the path of its segment (``contexts``: tree, n, segment, path, subroot)."""
    above = F.lit(BITS) * (F.lit(level + SEGMENT_LEVELS) - F.col("level"))
    nodes = log.where(F.col("level").between(level, level + SEGMENT_LEVELS - 1) & ~F.col("root"))
    nodes = nodes.select("tree", F.call_function("shiftright", "place", above).alias("segment"), "position", "digest", F.lit(1).alias("kind"))
    rows = contexts.withColumn("kind", F.lit(0)).unionByName(nodes, allowMissingColumns=True)
    entries = entries.withColumns({"segment": F.shiftright("place", BITS * SEGMENT_LEVELS), "kind": F.lit(2)})
    rows = rows.unionByName(entries, allowMissingColumns=True)

    def run(group: Iterator[dict]) -> Iterator[dict]:
        context = next(group)
        n, log, runs = context["n"], {}, {}
        top = min(level + SEGMENT_LEVELS, height(n))
        counts = [-(-n // ARITY**h) for h in range(top)]

        def run_of(h: int, r: int) -> list[str]:
            return [log[position(h, last_leaf(h, q, n))] for q in range(r * ARITY, min((r + 1) * ARITY, counts[h]))]

        for r in group:
            if r["kind"] == 1:
                log[r["position"]] = r["digest"]
                continue
            place, path = r["place"], []
            for h in range(level, top):
                key, at = (h, place >> BITS), place & (ARITY - 1)
                if key not in runs:
                    runs[key] = run_of(*key)
                path.append({"at": at, "others": [*runs[key][:at], *runs[key][at + 1:]]})
                place >>= BITS
            yield emit(r, path + context["path"], context)

    return _per_segment(rows, ["kind", "place"], run, schema)


def _segment_paths(log: DataFrame, trees: DataFrame, most: int) -> DataFrame:
    """Paths of the lowest segments of all trees, from those of the trees' roots (tree, n, path, subroot), round by round."""
    highest = sum((F.when(F.col("n") > ARITY ** (SEGMENT_LEVELS * k), SEGMENT_LEVELS).otherwise(0) for k in range(1, 6)), F.lit(0))
    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("n", T.LongType()), T.StructField("segment", T.LongType()), PATH,
                           T.StructField("subroot", T.StringType())])
    contexts = None
    for level in reversed(range(0, max(height(most), 1), SEGMENT_LEVELS)):
        if contexts is not None:
            entries = log.where((F.col("level") == level + SEGMENT_LEVELS) & ~F.col("root")).select("tree", "n", "place")
            contexts = stored(_extended(contexts, log, entries, level + SEGMENT_LEVELS, lambda r, path, c: {
                "tree": r["tree"], "n": r["n"], "segment": r["place"], "path": path, "subroot": c["subroot"]}, schema), "paths")
        own = trees.where(highest == level).withColumn("segment", F.lit(0).cast("long"))
        contexts = own if contexts is None else contexts.unionByName(own)
    return contexts


def _prove(m: Manifest, leaves: DataFrame, emit: Callable[[dict, list[dict], dict], dict], made: Sequence[T.StructField]) -> DataFrame:
    names = m.groups
    top = names.select("tree", "n", F.array().cast(PATH.dataType).alias("path"), F.lit(None).cast("string").alias("subroot")).distinct()
    most = lambda df: df.agg(F.max("n")).first()[0] or 0
    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("n", T.LongType()), PATH, T.StructField("subroot", T.StringType())])
    of_trees = stored(_extended(_segment_paths(m.log.where(F.col("tree") == TOP), top, most(names)), m.log.where(F.col("tree") == TOP), names, 0, lambda r, path, _: {
        "tree": r["name"], "n": r["members"], "path": path, "subroot": r["leaf"]}, schema), "paths")
    log = m.log.where(F.col("tree") != TOP)
    contexts = _segment_paths(log, of_trees, most(m.leaves))
    row = leaves.schema["row"]
    out = _extended(contexts, log, leaves.drop("n"), 0, emit, T.StructType([row, *made]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in row.dataType.names if c not in {f.name for f in made}], *[f.name for f in made])


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def proofs(m: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """Every row (or those of ``leaves``, a part of ``m.leaves``) with its leaf, the group's root, the root and the siblings on
    the way from the one to the other."""
    root = m.root
    return _prove(m, m.leaves if leaves is None else leaves, lambda r, path, c: {
        "row": r["row"], "leaf": r["leaf"], "subroot": c["subroot"], "root": root, "path": path}, [*_strings("leaf", "subroot", "root"), PATH])


def verify(m: Manifest, claim: str, leaves: DataFrame | None = None) -> DataFrame:
    """The proofs' digests, and whether they carry a claimed leaf (column ``claim`` of the rows; null: the leaf itself) to the root."""
    root = m.root

    def emit(r: dict, path: list[dict], c: dict) -> dict:
        folded = fold(r["row"][claim] or r["leaf"], path)
        return {"row": r["row"], "leaf": r["leaf"], "subroot": c["subroot"], "root": root, "proof_sha256": hashed([x for step in path for x in step["others"]]),
                "folded_root": folded, "verified": folded == root}

    return _prove(m, m.leaves if leaves is None else leaves, emit, [
        *_strings("leaf", "subroot", "root", "proof_sha256", "folded_root"), T.StructField("verified", T.BooleanType())])
