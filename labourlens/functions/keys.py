"""Derived keys, timestamps and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labourlens.functions.text import col


def job_key(site: str | Column, url: str | Column) -> Column:
    """``site_<hash of the address>``, all 32 hex digits: a shorter one would merge different addresses of a large site."""
    return F.concat(col(site), F.lit("_"), F.md5(col(url)))


def company_key(name: str | Column) -> Column:
    return F.concat(F.lit("comp_"), F.md5(col(name)))


def hash_unit(key: Column, salt: str, chunk: int = 0) -> Column:
    """Repeatable number in [0, 1) from a key: same on every run and partitioning."""
    digest = F.md5(F.concat(key, F.lit("|" + salt)))
    return F.conv(F.substring(digest, 1 + 8 * chunk, 8), 16, 10).cast("double") / 4294967296.0


def iso_timestamp(source: str | Column) -> Column:
    """ISO text to timestamp, null when unreadable."""
    return F.try_to_timestamp(col(source))


def iso_text(source: str | Column) -> Column:
    return F.date_format(col(source), "yyyy-MM-dd'T'HH:mm:ss")


def month(source: str | Column) -> Column:
    return F.date_format(F.date_trunc("month", col(source)), "yyyy-MM")


def resolve_url(base: str, link: str | Column) -> Column:
    """Absolute address of a link found on a site."""
    href = F.trim(col(link))
    scheme = base.split("://")[0]
    return (
        F.when(href.isNull() | (href == ""), F.lit(base))
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.lit(scheme + ":"), href))
        .when(href.startswith("/"), F.concat(F.lit(base), href))
        .otherwise(F.concat(F.lit(base + "/"), href))
    )


def query_value(source: str | Column) -> Column:
    """Text as one query-string value, blanks as ``+``."""
    return F.url_encode(col(source))
