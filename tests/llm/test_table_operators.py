"""Operators over whole tables, against brute force: joins, sharding, mixing, token files, top-k, and the pipeline."""

import collections
import math
import random
import re
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labourlens.llm import ball_tree, chosen_path, graph, mixing, sharding, token_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def links_of(texts):
    """{row: (links, least key of its class)} by comparing all pairs that share an n-gram."""
    sets = {}
    for i, (_, t) in enumerate(texts):
        w = WORD.findall(t or "")
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    inverted = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    links, parent = collections.Counter(), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, k in collections.Counter(j for g in s for j in inverted[g] if j > i).items():
            if 18 * k >= 8 * (len(s) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(texts):
        r = find(i)
        if k is not None:
            least[r] = min(least.get(r, k), k)
    return [(k, links[i], least.get(find(i))) for i, (k, _) in enumerate(texts)]


class TestChosenPath:
    def check(self, spark, rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash")).withColumn("rid", F.lit(1)).withColumn("row", F.lit(2))
        got = chosen_path.classes(df).collect()
        key = lambda x: tuple((v is None, v or 0) for v in x)
        assert sorted(((r["doc_id"], r["links"], r["class_id"]) for r in got), key=key) == sorted(links_of(rows), key=key)
        return got

    def test_near_and_exact_copies(self, spark):
        rng = random.Random(2)
        words = [f"w{i}" for i in range(500)]
        rows = []
        for g in range(60):
            base = [rng.choice(words) for _ in range(rng.randint(6, 200))]
            for _ in range(rng.randint(1, 8)):
                own = list(base)
                for _ in range(rng.randint(0, 3)):
                    own[rng.randrange(len(own))] = rng.choice(words)
                rows.append((len(rows), " ".join(own)))
        passage = " ".join(f"p{i}" for i in range(60))
        rows += [(1000 + i, f"{passage} {' '.join(rng.choice(words) for _ in range(60))}") for i in range(150)]  # a passage, but no near copies
        rows += [(2000 + i, t) for i, t in enumerate(["", None, " \n", "one", "one", "one two", "one  two", "ONE", "x " * 5, "x " * 50])] + [(5, rows[5][1]), (None, rows[5][1]), (None, "alone")]
        got = self.check(spark, rows)
        assert sum(r["keeper"] for r in got) == len({(r["class_id"] if r["links"] else ("alone", i)) for i, r in enumerate(got)})

    def test_a_crowd_of_near_copies(self, spark, monkeypatch):
        monkeypatch.setattr(chosen_path, "SMALL", 8)
        monkeypatch.setattr(chosen_path, "LEAF_BLOCK", 64)
        monkeypatch.setattr(chosen_path, "BLOCK", 32)
        base = [f"b{i}" for i in range(120)]
        rows = [(i, " ".join(base[: i % 110 + 5] + [f"x{i}"] + base[i % 110 + 5 :])) for i in range(220)] + [(900, " ".join(base))] * 3
        self.check(spark, rows)

    def test_long_text_and_empty_table(self, spark):
        long = " ".join(f"t{i % 3001}" for i in range(30_000))
        self.check(spark, [(1, long), (2, long + " end"), (3, "y" * 200_000)])
        none = spark.createDataFrame([], "doc_id long, text string")
        assert chosen_path.classes(none).collect() == [] and chosen_path.keepers(none).collect() == []

    @pytest.mark.parametrize("similarity", [0.5, 0.85, 1.1])
    def test_other_similarities_are_refused(self, spark, similarity):
        with pytest.raises(ValueError, match="similarity"):
            chosen_path.classes(spark.createDataFrame([(1, "a")], "doc_id long, text string"), similarity=similarity)

    def test_recall(self):
        assert all(chosen_path.recall(0.8, level) > 0.9999 for level in range(1, chosen_path.DEPTH + 1))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 180)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(find(x) == find(y) and x != y for y in parent)}


class TestSharding:
    def test_exact_and_repeatable(self, spark):
        rows = [(i % 900 if i % 7 else None, f"t{i % 50}") for i in range(1000)]
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("rank", F.lit(1))
        out = sharding.shuffle(df.drop("shard"), ["doc_id", "text"], 24, 5).collect()
        by = collections.defaultdict(list)
        for r in out:
            by[r["shard"]].append(r["slot"])
        assert len(out) == 1000 and sorted(map(len, by.values())) == [41] * 8 + [42] * 16 and all(sorted(s) == list(range(len(s))) for s in by.values())
        again = sharding.shuffle(df.drop("shard").repartition(7), ["doc_id", "text"], 24, 5).collect()
        key = lambda rs: sorted((r["shard"], r["slot"], str(r["doc_id"]), r["text"]) for r in rs)
        assert key(out) == key(again)

    def test_clashing_columns_give_way(self, spark):
        df = spark.createDataFrame([(i, "clash", -1, 5) for i in range(60)], "doc_id long, shard string, slot int, row int")
        out = sharding.shuffle(df, ["doc_id"], 7, 3)
        assert out.columns == ["doc_id", "row", "shard", "slot"]
        assert sorted(r["slot"] for r in out.collect() if r["shard"] == 0) == list(range(9))

    def test_few_and_no_rows(self, spark):
        df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
        assert sorted(r["slot"] for r in sharding.shuffle(df, ["doc_id", "text"], 24).collect()) == [0, 0, 0]
        assert sharding.shuffle(df.limit(0), ["doc_id", "text"], 24).collect() == []

    def test_matrix_is_hypergeometric(self):
        blocks, shards = [30, 50, 20], [34, 33, 33]
        total = np.zeros((3, 3))
        for seed in range(3000):
            m = np.array(sharding.communication_matrix(blocks, shards, seed))
            assert m.sum(1).tolist() == blocks and m.sum(0).tolist() == shards
            total += m
        assert np.abs(total / 3000 - np.outer(blocks, shards) / 100).max() < 0.25


class TestMixing:
    @staticmethod
    def targets(sizes):
        names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        left, full, out = 1.5 * sum(sizes.values()), set(), {}
        while True:
            rest = [s for s in names if s not in full]
            out = {s: 2 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in names}
            over = {s for s in rest if out[s] > 2 * sizes[s]}
            if not over:
                return out
            full |= over
            left -= sum(2 * sizes[s] for s in over)

    def test_targets_and_rounding(self, spark):
        rng = random.Random(6)
        sources = ["b", "a", "é", "Z", None, "empty", "z"]
        rows = [(i, s, 0 if s == "empty" else int(rng.lognormvariate(4, 1))) for i, s in enumerate(rng.choices(sources, [40, 5, 10, 10, 3, 2, 20], k=3000))]
        rows += [(9999, "b", 77)] * 500 + [(None, "b", 5), (3, "a", None)]
        df = spark.createDataFrame(rows, "doc_id long, source string, size long").na.fill(0, ["size"]).withColumn("target", F.lit("clash")).withColumn("n", F.lit(1))
        out = mixing.mix(df, seed=2).collect()
        sizes, taken, most = collections.Counter(), collections.Counter(), collections.Counter()
        for r in out:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["size"] * r["copies"]
            most[r["source"]] = max(most[r["source"]], r["size"])
            assert 0 <= r["copies"] <= 2
        want = self.targets(dict(sizes))
        assert len(out) == len(rows)
        for r in out:
            assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert all(abs(taken[s] - want[s]) <= most[s] for s in want)
        again = mixing.mix(df.repartition(5), seed=2).collect()
        key = lambda rs: sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["copies"]) for r in rs)
        assert key(out) == key(again)

    def test_no_rows_and_no_words(self, spark):
        df = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
        assert {r["target"] for r in mixing.mix(df).collect()} == {0.0}
        assert mixing.mix(df.limit(0)).collect() == []

    def test_word_count(self, spark):
        texts = ["", None, " a  b\tc\nd\x0be ", "é ü x"]
        got = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.word_count(F.col("text")).alias("n")).collect()
        assert [r["n"] for r in got] == [len(WORD.findall(t or "")) for t in texts]


class TestTokenFile:
    @pytest.fixture(scope="class")
    def tokenizer(self):
        with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
            return f.read()

    @pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [0, 10**12], list(range(3000)), [7] * 2000, [i * i for i in range(5000)]])
    def test_elias_fano(self, values):
        ef = token_file.EliasFano.load(token_file.EliasFano.build(np.array(values, np.uint64)).dump())
        at = np.random.default_rng(1).permutation(len(values))
        assert ef.get(at).tolist() == [values[i] for i in at]
        if len(values) == 5000:
            assert len(ef.dump()) < 5000 * 8 / 3

    def test_round_trip(self, spark, tokenizer, sf_dir):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(tokenizer)
        rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
        rows += [(-5, "negative  key\t\n"), (10**15, None), (None, "no key"), (7, "a second 7"), (10**14, "<|endoftext|> it's é  x　y ΑΣ Σ"), (10**13, "w" * 50_000)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = token_file.read(token_file.write(df, tempfile.mkdtemp(), tokenizer, shards=6)).orderBy("start").collect()
        encoded = collections.defaultdict(list)
        for k, t in rows:
            ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
            encoded[k].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert [r["doc_id"] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
        start = 0
        for r in got:
            assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in encoded[r["doc_id"]]
            start += r["n_tokens"]

    def test_empty_table(self, spark, tokenizer):
        none = spark.createDataFrame([], "doc_id long, text string")
        assert token_file.read(token_file.write(none, tempfile.mkdtemp(), tokenizer)).collect() == []


class TestBallTree:
    def test_against_brute_force(self, spark, monkeypatch):
        monkeypatch.setattr(ball_tree, "SHARD_ROWS", 150)
        monkeypatch.setattr(ball_tree, "BLOCK", 16)
        rng = np.random.default_rng(8)
        centres = rng.normal(size=(8, 12))
        x = centres[rng.integers(0, 8, 900)] + 0.2 * rng.normal(size=(900, 12))
        rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
        rows += [(1000 + i, rows[0][1], 1) for i in range(60)]  # ties
        rows += [(2000, None, 1), (2020, [], 1), (2040, [float("nan")] * 12, 1), (2060, [None, *[1.0] * 11], 1), (2080, [float("inf")] * 12, 1), (None, rows[1][1], 1),
                 (2100, [1.0, 2.0], 1), (2120, [0.5, 0.5], 1), (20, rows[20][1], 1)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
        v = ball_tree.quantised(df)
        got = ball_tree.top_k(v, v.filter("vec_id % 20 = 0").distinct(), 20).collect()
        usable = [(i, np.floor(64 * np.array(e, float)).astype(np.int64)) for i, e, _ in rows if i is not None and e and all(a is not None and math.isfinite(a) for a in e)]
        expected = set()
        for i, q in {i: q for i, q in usable if i % 20 == 0}.items():
            best = sorted(((-int(q @ y), j) for j, y in usable if j != i and len(y) == len(q)))[:20]
            expected |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
        assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == expected

    def test_no_rows(self, spark):
        v = ball_tree.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
        assert ball_tree.top_k(v, v, 20).collect() == []


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        counts.append(docs.count())
        assert name == "sentencepiece" or docs.columns == columns
        if name == "ngram_jaccard":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert all(links == 0 for _, links, _ in links_of(rows))
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[5] == counts[4] > 0


def test_pipeline_keeps_columns_of_any_name(spark, sf_dir):
    names = ["source_size", "target", "rate", "copies", "_size", "_copy", "size", "copy", "toxic_score", "score", "row"]
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).cache()
    for name, stage in corpus_pipeline.STAGES:
        if name in ("toxicity", "mixing"):
            out = stage(spark, plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names}), sf_dir)
            rows = out.collect()
            assert out.columns == plain.columns + names and rows
            assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names)
            key = lambda rs: sorted((r["doc_id"], r["text"]) for r in rs)
            assert key(rows) == key(stage(spark, plain, sf_dir).collect())


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []


def test_words_are_split_together_as_each_is_alone():
    import pyarrow as pa
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = token_file.WordEncoder(f.read())
    assert token_file.PLAIN_PART.findall("it's\nx") == ["it", "'s", "\n", "x"]  # a word ends its parts
    words = ["it's", "", "'s", "Don'T", "a1b22", "--x--", "Één", "x<|endoftext|>y", "<|startoftext|>", "_'re_", "99", "word"]
    texts = [" ".join(words), "", None, " ".join(reversed(words)), "'s"]
    ids, counts = encoder.encode(pa.array(texts), 1)
    cut = np.split(ids, np.cumsum(counts)[:-1])
    assert [c.tolist() for c in cut] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
