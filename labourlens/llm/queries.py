"""The registered queries of the subpackage: thin, each over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labourlens.llm import ball_tree, bpe_dropout, chosen_path, host_rules, license_scan, line_blocks, merkle, mixing, pii, sharding, token_file, toxicity, whitening
from labourlens.session import scratch

Query = Callable[[SparkSession, str], DataFrame]
PIECE_MODEL, WORD_TOKENIZER = "piece_bpe_32k.model", "word_bpe_49k.json"
DROPOUT, SEED = 0.1, 20240601
TOXIC_AT = 0.3
SHARDS = 24
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text with merge-dropout and decode it again."""
    model = bpe_dropout.read_model(public_tokenizers.path(PIECE_MODEL))
    encoded = bpe_dropout.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, rate=DROPOUT, seed=SEED)
    decoded = bpe_dropout.decode(encoded, model)
    return decoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"),
                          F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(pii.spelled("base").cast("binary"), 256).alias("base_sha256"), pii.spelled("spans").alias("spans"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", F.col("links").alias("n_links"))


def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shuffle(docs, ["doc_id", "text_crc32", "size"], SHARDS, SEED)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.mix(docs, seed=SEED)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_labels(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = toxicity.score(docs, model)
    held_out = ~F.coalesce(toxicity.learns(F.col("doc_id")), F.lit(True))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(WORD_TOKENIZER), encoding="utf-8") as f:
        tokenizer = f.read()
    manifest = token_file.write(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "tokens"), tokenizer, end_id=1)
    return token_file.read(manifest)


def op8_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ball_tree.quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return ball_tree.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


def op9_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations beyond 63 bits do not fit the result's type and are null; the operator itself gives them as decimals."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's digests and proof; every third one with its capitals lowered, which the proof must tell."""
    docs = table(spark, sf_dir, "documents")

    def leaf(text: Column) -> Column:
        return merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])

    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(F.translate("text", CAPITALS, CAPITALS.lower())))
    rows = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), tampered.alias("claimed"))
    manifest = merkle.build(rows, F.col("lang"), F.col("doc_id"), F.col("leaf"))
    return merkle.verify(manifest, "claimed").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_sentencepiece_dropout, op2_pii, op3_ngram_jaccard, op4_hypergeometric_shards, op5_entropy_mixing, op6_toxicity, op7_token_file, op8_ball_tree,
    op9_line_blocks, op10_host_rules, op11_license_scan, op12_embedding_whitening, op13_merkle_manifest)}



def merkle_sql() -> str:
    """Trees level by level: a level groups runs of eight while its tree has more than one node; ways are folded alike."""
    upper = f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def levels(leaves: str, t: str, many: int) -> str:
        """CTEs of the levels over ``leaves`` (tree, i, d), with the siblings of every node."""
        out, below = "", leaves
        for k in range(many):
            out += f"""
{t}{k} AS (SELECT tree, i, d, count(*) OVER (PARTITION BY tree) AS n, string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
  string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM {below} WINDOW w AS (PARTITION BY tree, i // 8 ORDER BY i)),
{t}{k}u AS (SELECT tree, i // 8 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {t}{k} WHERE n > 1 GROUP BY tree, i // 8),"""
            below = f"{t}{k}u"
        roots = " UNION ALL ".join(f"SELECT tree, d FROM {t}{k} WHERE n = 1" for k in range(many))
        return f"{out}\n{t}roots AS ({roots}),"

    def climb(rows: str, t: str, many: int, tree: str, place: str) -> str:
        """CTEs that carry (proof, folded) of ``rows`` up the levels."""
        out, below = "", rows
        for k in range(many):
            out += f"""
{rows}_{t}{k} AS (SELECT x.* REPLACE (CASE WHEN y.d IS NULL THEN x.proof ELSE x.proof || coalesce(y.l, '') || coalesce(y.r, '') END AS proof,
  CASE WHEN y.d IS NULL THEN x.folded ELSE sha256(coalesce(y.l, '') || x.folded || coalesce(y.r, '')) END AS folded)
  FROM {below} x LEFT JOIN {t}{k} y ON y.n > 1 AND y.tree = x.{tree} AND y.i = x.{place} // {8**k}),"""
            below = f"{rows}_{t}{k}"
        return out

    return f"""
WITH bits AS (SELECT row_number() OVER () AS r, *, [ord(c) for c in string_split(CAST(doc_id AS VARCHAR), '')] AS b FROM documents),
crc AS (SELECT *, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(c AS BIGINT) for c in b]), lambda a, c: list_reduce(
  [xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END))) AS c32 FROM bits),
leaves AS (SELECT r, doc_id, {leaf('text')} AS d, CASE WHEN c32 % 3 = 0 THEN {leaf(upper)} ELSE {leaf('text')} END AS claimed, coalesce('1' || lang, '0') AS tree FROM crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d, r) - 1 AS i, d AS leaf, '' AS proof, claimed AS folded FROM leaves),{levels('placed', 'a', 8)}
tops AS (SELECT 't' AS tree, tree AS name, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, d FROM aroots),{levels('tops', 'b', 4)}
{climb('placed', 'a', 8, 'tree', 'i')}
grouped AS (SELECT p.*, q.i AS g, q.d AS subroot, 't' AS top FROM placed_a7 p JOIN tops q ON p.tree = q.name),{climb('grouped', 'b', 4, 'top', 'g')}
one AS (SELECT d AS root FROM broots)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM grouped_b3, one"""


def license_sql() -> str:
    """Every block of every text against every template, and phrases at every place."""
    listed = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    templates = [(label, license_scan.words_of(text)) for label, text in license_scan.TEMPLATES]
    rows = ", ".join(f"('{label}', {license_scan.width(len(w))}, {listed(sorted(set(w)))}, {license_scan.needed(len(set(w)))})" for label, w in templates)
    phrases = {label: license_scan.words_of(text) for label, text in license_scan.PHRASES.items()}
    starts = ", ".join(f"list_filter(range(len(w) - {len(p) - 1}), lambda i: {' AND '.join(f'w[i + {k + 1}] = ' + chr(39) + x.decode() + chr(39) for k, x in enumerate(p))}) AS p{j}"
                       for j, p in enumerate(phrases.values()))
    every = " || ".join(f"p{j}" for j in range(len(phrases)))
    base = " || ".join(f"CASE WHEN len(p{j}) > 0 THEN ['{label}'] ELSE [] END" for j, label in enumerate(phrases))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT r, doc_id, w, {starts} FROM d),
base AS (SELECT r, doc_id, len(w) AS n_words, {every} AS p, {base} AS b FROM places),
t(label, width, tokens, need) AS (VALUES {rows}),
starts AS (SELECT r, w, width, unnest(range(0, len(w), width)) AS s FROM d, (SELECT DISTINCT width FROM t)),
blocks AS (SELECT r, width, list_distinct(list_slice(w, s + 1, s + 2 * width)) AS block FROM starts WHERE s = 0 OR s + width < len(w)),
met AS (SELECT r, label, len(list_intersect(block, tokens)) / len(tokens) AS c FROM blocks JOIN t USING (width) WHERE len(list_intersect(block, tokens)) >= need),
found AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS c FROM met GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word,
  array_to_string(list_sort(b), ',') AS base_labels, array_to_string(list_sort(list_distinct(b || coalesce(labels, []))), ',') AS labels,
  CASE WHEN len(b) > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM base LEFT JOIN found USING (r)"""


ORACLES: dict[str, str] = {
    "op11_license_scan": license_sql(),
    "op13_merkle_manifest": merkle_sql(),
    "op8_ball_tree": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    # the given pages hold their text in one article of h1 and p blocks, and no other character references than these
    "op9_line_blocks": r"""
WITH a AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1),
             '<br>', ' ', 'g'), '</?(h1|p)>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)) AS parts FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(x, '&quot;?', '"', 'g'),
             '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM a)
SELECT page_id, url, array_to_string(parts, chr(10) || chr(10)) AS text, CAST(length(array_to_string(parts, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM b""",
    "op10_host_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS t,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
m AS (SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN covered c ON d.r = c.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(n)::DOUBLE AS n, sum(k) / sum(n) AS mean, count(*) AS hosts, sum(n * n)::DOUBLE AS nn, sum(k * k / n) AS ff FROM h),
e AS (SELECT n, mean, (ff - n * mean * mean - (hosts - 1) * mean * (1 - mean)) / nullif(n - nn / n, 0) AS between_ FROM s),
p AS (SELECT mean, greatest(1.0, CASE WHEN between_ > 0 THEN least(n, mean * (1 - mean) / between_ - 1) ELSE n END) AS weight FROM e),
rates AS (SELECT source, (k + weight * mean) / (n + weight) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate, 0) <= 0.5 AS kept
FROM f LEFT JOIN rates ON f.source = rates.source""",
}
