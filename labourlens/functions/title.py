"""Job titles written in many ways to one spelling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labourlens.dictionaries import (
    TITLE_ACRONYMS,
    TITLE_PHRASES,
    TITLE_SMALL_WORDS,
    TITLE_SPECIAL_CASE,
    TITLE_WORDS,
)
from labourlens.functions.text import capitalised, col, lookup, squeeze

EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _cased(word: Column, special: Mapping[str, str]) -> Column:
    return F.coalesce(lookup(special, word), capitalised(word))


def normalize_title(
    source: str | Column,
    words: Mapping[str, str] = TITLE_WORDS,
    phrases: Mapping[str, str] = TITLE_PHRASES,
) -> Column:
    """Spell out abbreviations and roles, then set the case of every word."""
    title = col(source)
    text = F.regexp_replace(squeeze(F.lower(title)), EDGE_L + r"(sr|jr|snr|jun)\.", "$1")
    for phrase in sorted(phrases, key=len, reverse=True):
        text = F.regexp_replace(text, EDGE_L + phrase + EDGE_R, phrases[phrase])
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), 1)
    spelled = F.array_join(F.transform(runs, lambda w: F.coalesce(lookup(words, w), w)), "")

    special = {a.lower(): a for a in TITLE_ACRONYMS} | {w: w for w in TITLE_SMALL_WORDS} | dict(TITLE_SPECIAL_CASE)
    cased = F.array_join(
        F.transform(
            F.split(spelled, " "),
            lambda token: F.array_join(F.transform(F.split(token, "/"), lambda part: _cased(part, special)), "/"),
        ),
        " ",
    )
    return F.when(F.trim(title) == "", title).otherwise(cased)


def add_title(df: DataFrame, source: str = "job_title_raw", target: str = "job_title") -> DataFrame:
    return df.withColumn(target, normalize_title(source))
