"""Closed categories of postings, companies and skills."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from labourlens import dictionaries as d
from labourlens.functions.text import blank_to_null, col, contains_any, folded, keyword_bucket, lookup, title_case

NOT_SPECIFIED = "Not specified"


def city(source: str | Column, aliases: Mapping[str, str] = d.CITY_ALIASES) -> Column:
    """Known spelling to one name, else title case; blank stays null."""
    return F.coalesce(lookup(aliases, folded(source)), title_case(blank_to_null(source)))


def company_city(source: str | Column) -> Column:
    return F.coalesce(city(source, d.COMPANY_CITY_ALIASES), F.lit(""))


def remote_option(source: str | Column) -> Column:
    return keyword_bucket(source, d.REMOTE_RULES, "On-site")


def job_type(source: str | Column) -> Column:
    return keyword_bucket(source, d.JOB_TYPE_RULES, "Full-time")


def contract_type(source: str | Column) -> Column:
    return keyword_bucket(source, d.CONTRACT_RULES, NOT_SPECIFIED)


def job_level(source: str | Column) -> Column:
    return keyword_bucket(source, d.JOB_LEVEL_RULES, NOT_SPECIFIED)


def education_level(source: str | Column) -> Column:
    return keyword_bucket(source, d.EDUCATION_RULES, "Not Required")


def company_size(source: str | Column) -> Column:
    return keyword_bucket(source, d.COMPANY_SIZE_RULES, F.coalesce(title_case(blank_to_null(source)), F.lit("Unknown")))


def required_level(source: str | Column) -> Column:
    return keyword_bucket(source, d.REQUIRED_LEVEL_RULES, NOT_SPECIFIED)


def group_from_words(source: str | Column) -> Column:
    """Skill group guessed from the words of an unknown name."""
    text = F.lower(col(source))
    out = None
    for label, words in d.GROUP_WORDS:
        result: Column = F.lit(label)
        if label == "Framework":
            result = F.when(contains_any(text, d.FRONTEND_WORDS), "Frontend Framework").otherwise("Backend Framework")
        elif label == "DevOps":
            result = F.when(text.contains("cloud"), "Cloud").otherwise("DevOps")
        out = (F if out is None else out).when(contains_any(text, words), result)
    return out.otherwise("Other")


def mentions_english(source: str | Column) -> Column:
    return F.coalesce(contains_any(F.lower(col(source)), d.ENGLISH_WORDS), F.lit(False))
