"""Merkle manifests against trees built by plain loops."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from labourlens.llm import merkle, queries

CAPITALS = str.maketrans(queries.CAPITALS, queries.CAPITALS.lower())
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(root, the siblings on every node's way up as (place, others))."""
    ways = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, under_above = [], []
        for s in range(0, len(nodes), 8):
            run = nodes[s : s + 8]
            for k, members in enumerate(under[s : s + 8]):
                for i in members:
                    ways[i].append((k, run[:k] + run[k + 1:]))
            above.append(h("".join(run)))
            under_above.append([i for members in under[s : s + 8] for i in members])
        nodes, under = above, under_above
    return nodes[0], ways


def fold(digest, way):
    for k, others in way:
        digest = h("".join(others[:k] + [digest] + others[k:]))
    return digest


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        members = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = (members, *tree([leaf(*r) for r in members]))
    root, tops = tree([trees[lang][1] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        members, subroot, ways = trees[lang]
        for r, way in zip(members, ways):
            way = way + top
            claim = leaf(r[0], r[1] and r[1].translate(CAPITALS), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(*r)
            folded = fold(claim, way)
            out.append((r[0], leaf(*r), subroot, root, h("".join(x for _, others in way for x in others)), folded, folded == root))
    return out


def check(spark, tmp_path, rows, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    key = lambda t: tuple((x is not None, x) if x is not None else (False, 0) for x in t)
    assert sorted(got, key=key) == sorted(expected(rows), key=key) if rows else got == []
    return got


def docs(n, langs, seed=3):
    rnd = random.Random(seed)
    return [(i * 7, "".join(rnd.choices("abC Dé\n", k=rnd.randint(0, 12))), rnd.choice(langs), rnd.choice(["s", None, ""]), rnd.choice([1, None])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_small_trees(spark, tmp_path, n):
    check(spark, tmp_path, docs(n, ["en"]))


def test_trees_of_several_segments(spark, tmp_path, monkeypatch):
    """Segments of 8 leaves, so that a tree of 600 has four rounds of builders."""
    monkeypatch.setattr(merkle, "SEGMENT_LEVELS", 1)
    got = check(spark, tmp_path, docs(600, ["en"] * 6 + ["de", None, "", "ž", "z"]))
    assert 0 < sum(not r[-1] for r in got) < 600


def test_one_group_beyond_a_segment(spark, tmp_path):
    check(spark, tmp_path, docs(4100, ["en"] * 5000 + ["fr"]))


def test_nulls_ties_and_repeats(spark, tmp_path):
    """A third of all rows is one row; null ids; equal ids with other texts; nothing but nulls."""
    rows = docs(60, ["en", None]) + [(7, "Copy", "en", "s", 4)] * 40 + [(None, "Ab", "en", None, None), (None, None, None, None, None), (7, "Other", "en", "s", 5)]
    check(spark, tmp_path, rows)


def test_very_long_text_and_no_rows(spark, tmp_path):
    check(spark, tmp_path / "a", [(3, "Wort " * 400_000, "de", "s", 1), (4, "", "de", "s", 0)])
    check(spark, tmp_path / "b", [])


def test_as_many_groups_as_rows(spark, tmp_path):
    check(spark, tmp_path, [(i, "T", f"l{i}", "s", 1) for i in range(70)])


def test_log_is_in_postorder_and_proofs_fold(spark):
    df = spark.range(700).select(F.col("id").alias("leaf_id"), F.lit("g").alias("tree"), F.lit(1).alias("segment"), F.lit(2).alias("path"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf"))
    m = merkle.build(df, F.col("tree"), F.col("leaf_id"), F.col("leaf"))
    log = sorted((r.position, r.level, r.place) for r in m.log.where("tree = '1g'").collect())
    assert [p for p, _, _ in log] == list(range(700 + 88 + 11 + 2 + 1))
    done = {}
    for p, level, place in log:  # every node comes after all of its run, and right after the last of it
        assert all(done[level - 1, k] < p for k in range(place * 8, place * 8 + 8) if (level - 1, k) in done)
        assert level == 0 or done[max(k for k in done if k[0] == level - 1)] == p - 1
        done[level, place] = p
    some = m.leaves.where("place % 97 = 5")
    rows = merkle.proofs(m, some).collect()
    assert len(rows) == some.count() and all(merkle.fold(r.leaf, [s.asDict() for s in r.path]) == r.root == m.root for r in rows)
    assert merkle.proofs(m).columns == ["leaf_id", "tree", "segment", "leaf", "subroot", "root", "path"]
