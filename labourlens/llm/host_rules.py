"""Quality rules for documents, and verdicts on whole hosts.

Each text is measured by itself (one pass, no shuffle); failures are then counted per host, and a host's failure rate is
shrunk towards the mean of all hosts by a beta prior fitted to the hosts (method of moments on the counts).  A host whose
shrunk rate passes ``host_limit`` takes all its documents with it; the verdict is joined back to the documents.

Defined results: a null text measures as an empty one, which fails for having too few words; documents without a host form
one group that never gets a verdict of its own; repeated rows count once each; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labourlens.session import stored

WORD = r"[^\x20\x09-\x0D]+"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measure(text: str) -> tuple[int, int, int, int, int]:
    words = re.findall(WORD, text)
    n = len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) < len(windows):  # else no window comes twice
        covered = bytearray(n)
        for i, w in enumerate(windows):
            if counts[w] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated


def with_measures(df: DataFrame, text: str = "text", into: str = "measures") -> DataFrame:
    """``df`` with a struct column of the text's measures."""

    @F.pandas_udf(MEASURES)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t or "") for t in texts], columns=[x.split()[0] for x in MEASURES.split(", ")])

    return df.withColumn(into, run(F.col(text)))


def fails(n_words: Column, n_repeat_words: Column, least_words: int = 50, most_repeated: int = 50) -> Column:
    return (n_words < least_words) | (100 * n_repeat_words > most_repeated * n_words)


def host_rates(df: DataFrame, host: str, failed: str) -> DataFrame:
    """Per host: documents, failures, and the shrunk failure rate.

    The prior has the pooled rate as its mean; its weight s follows from the spread of the hosts' rates beyond what
    binomial chance explains.  Hosts that spread no more than chance get the heaviest prior, one as large as all documents.
    """
    counts = df.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    total = counts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("k"), F.sum(F.col("n_docs") * F.col("n_docs")).cast("double").alias("nn"),
                       F.sum(F.pow("n_failed", F.lit(2)) / F.col("n_docs")).alias("ff")).first()
    n, f, k, nn, ff = (float(x or 0) for x in total)  # five sums over all hosts
    mean = f / n if n else 0.0
    # sum of n_i (rate_i - mean)^2, against (k - 1) mean (1 - mean) under chance alone
    extra = ff - n * mean * mean - (k - 1) * mean * (1 - mean)
    scale = n - nn / n if n else 0.0
    between = extra / scale if scale > 0 else 0.0
    weight = min(n, mean * (1 - mean) / between - 1) if between > 0 else n
    weight = max(weight, 1.0)
    return counts.withColumn("rate", (F.col("n_failed") + F.lit(weight * mean)) / (F.col("n_docs") + F.lit(weight)))


def judge(df: DataFrame, host: str = "source", text: str = "text", host_limit: float = 0.5, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """All columns but the text, with the measures, ``base_failed``, the host's ``host_rate`` and ``kept``."""
    columns = [c for c in df.columns if c != text]
    m = with_measures(df.select(F.struct(*columns).alias("row"), F.col(host).alias("host"), text), text)
    m = stored(m.select("row", "host", "measures", fails(F.col("measures.n_words"), F.col("measures.n_repeat_words"), least_words, most_repeated).alias("base_failed")), "measures")
    rates = host_rates(m, "host", "base_failed").select("host", F.col("rate").alias("host_rate"))
    out = m.join(rates, "host", "left")
    kept = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= host_limit)
    made = {"base_failed", "host_rate", "kept", *(x.split()[0] for x in MEASURES.split(", "))}
    return out.select(*[F.col(f"row.{c}") for c in columns if c not in made], "measures.*", "base_failed", "host_rate", kept.alias("kept"))
