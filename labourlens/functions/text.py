"""Shared text and number expressions."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_round(c: ColumnLike, digits: int = 1) -> Column:
    """Round half up on the scaled value; the same rule holds in any SQL engine."""
    scale = 10.0 ** digits
    return F.floor(col(c).cast("double") * scale + 0.5).cast("double") / scale


def squeeze(c: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def folded(c: ColumnLike) -> Column:
    return F.lower(F.trim(col(c)))


def blank_to_null(c: ColumnLike) -> Column:
    trimmed = F.trim(col(c))
    return F.when(trimmed != "", trimmed)


def sql_text(value: str) -> str:
    """A string literal for SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values: Sequence[str]) -> Column:
    return F.expr("array(" + ", ".join(map(sql_text, values)) + ")")


#: Literal maps of up to so many entries are searched one by one; larger ones go by hash.
SCANNED = 16


def literal_map(items: Sequence[tuple[str, str]], kind: str = "string") -> str:
    """SQL of a map from text to values given as SQL."""
    body = ", ".join(f"{sql_text(k)}, {v}" for k, v in items)
    return f"map({body})" if items else f"CAST(map() AS map<string, {kind}>)"


def dictionary(items: Mapping[str, str], key: Column, kind: str = "string") -> Column:
    """Value, given as SQL of type ``kind``, of ``key``; null when absent.

    A map literal is searched from its first entry on, so a large one is cut by a hash of the key into
    many of a few entries: a lookup takes the same time whatever the size.
    """
    if len(items) <= SCANNED:
        return F.expr(literal_map(list(items.items()), kind))[key]
    parts: list[list[tuple[str, str]]] = [[] for _ in range(1 << (len(items) // 2).bit_length())]
    for k, v in items.items():
        parts[zlib.crc32(k.encode()) % len(parts)].append((k, v))
    table = F.expr("array(" + ", ".join(literal_map(p, kind) for p in parts) + ")")
    return F.get(table, (F.crc32(key.cast("binary")) % len(parts)).cast("int"))[key]


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """Value of ``key`` in a closed mapping, null when absent."""
    return dictionary({k: sql_text(v) for k, v in mapping.items()}, key)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Any of the words as a plain substring."""
    return c.rlike("|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words))


def keyword_bucket(c: ColumnLike, rules: Sequence[tuple[str, Sequence[str]]], default: str | Column) -> Column:
    """Label of the first rule with a keyword inside the case-folded text."""
    text = F.coalesce(folded(c), F.lit(""))
    out = None
    for label, words in rules:
        out = (F if out is None else out).when(contains_any(text, words), F.lit(label))
    return out.otherwise(F.lit(default) if isinstance(default, str) else default)


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def title_case(c: ColumnLike) -> Column:
    """Upper-case the first letter of every run of letters, also after a hyphen."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, capitalised), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used.

    A chain of derived columns would be inlined again and again when a filter is
    pushed below it; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
