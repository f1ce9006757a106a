"""Joining postings, skills and companies, and keeping one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SKILL_LISTS = {"skills": "skill_name", "skill_groups": "skill_group", "skill_levels": "required_level",
               "skill_originals": "original_name"}
COPIED_SUFFIXES = ("_company", "_x", "_y")


def skill_lists(skills: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    """Four aligned lists per posting, in the given order of its skill rows; rows without a posting are in no list."""
    order = [c for c in order if c in skills.columns]
    row = F.struct(*order, *SKILL_LISTS.values())
    lists = skills.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    return lists.select("job_id", *[F.col("_rows")[source].alias(name) for name, source in SKILL_LISTS.items()])


def merge_datasets(jobs: DataFrame, skills: DataFrame | None, companies: DataFrame) -> DataFrame:
    """Postings with their company (clashing columns get ``_company``) and skill lists.

    Skill lists are joined only when the postings do not carry a ``skills``
    column already.  No side is forced into a broadcast: the planner knows the
    sizes and the adaptive skew join splits a company with very many postings.
    """
    renamed = companies.select("company_id", *[
        F.col(c).alias(f"{c}_company" if c in jobs.columns else c) for c in companies.columns if c != "company_id"])
    merged = jobs.join(renamed, "company_id", "left")
    if skills is not None and "skills" not in merged.columns:
        merged = merged.join(skill_lists(skills), "job_id", "left")
    return merged


def drop_copied(df: DataFrame) -> DataFrame:
    """Drop columns left behind by an earlier merge."""
    return df.drop(*[c for c in df.columns if c.endswith(COPIED_SUFFIXES)])


def pick_column(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """One column out of several possible names, the first non-null one winning."""
    present = [c for c in names if c in df.columns]
    if not present:
        raise ValueError(f"none of {list(names)} in {df.columns}")
    value = F.coalesce(*[F.col(c) for c in present])
    return df.drop(*present).withColumn(target, value) if target in present else df.withColumn(target, value).drop(*present)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order; rows with a null or blank key all stay.

    ``row_number = 1`` is limited inside each task before the exchange, so a key
    carried by a large share of the rows sends one row per task.  A blank key
    gets a number of its own, which keeps such rows apart and spread out.  Equal
    positions are settled by a hash of the row.
    """
    blank = F.lit(False)
    for k in keys:
        text = F.trim(F.col(k).cast("string"))
        blank = blank | text.isNull() | (text == "")
    alone = F.when(blank, F.monotonically_increasing_id())
    ranked = df.withColumn("_alone", alone).withColumn("_n", F.row_number().over(
        W.partitionBy(*keys, "_alone").orderBy(*order, F.xxhash64(*df.columns))))
    return ranked.where(F.col("_n") == 1).select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in the given order."""
    rest = [c for c in df.columns if c not in order and c not in keys]
    return (df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
            .select(*keys, "_r.*").select(*df.columns))


def first_known(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Per key, the earliest non-null value of each column on its own."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def skill_counts(jobs: DataFrame, skills: DataFrame, names: Sequence[str]) -> DataFrame:
    """Postings with one count column per skill of a closed list, 0 where absent."""
    safe = {n: "skill_" + "".join(ch if ch.isalnum() else "_" for ch in n.lower()) for n in names}
    wide = skills.where(F.col("skill_name").isin(*names)).groupBy("job_id").agg(*[
        F.count_if(F.col("skill_name") == n).alias(safe[n]) for n in names])
    return jobs.join(wide, "job_id", "left").na.fill(0, list(safe.values()))


def stack(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name and filled with null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def list_decode(source: str | Column, policy: str = "empty") -> Column:
    """Text such as ``['Python', 'SQL']`` to an array of trimmed, non-blank items.

    ``policy`` says what unreadable text becomes: ``skip`` null, ``empty`` an
    empty array, ``split`` its comma-separated parts.
    """
    text = F.trim(F.col(source) if isinstance(source, str) else source)
    read = F.when(text.startswith("["), F.from_json(text, "array<string>", {"allowSingleQuotes": "true"}))
    # A list that did not close is not a list, whatever could be salvaged.
    parsed = F.when(text.endswith("]"), read)
    if policy == "skip":
        items = parsed
    elif policy == "empty":
        items = F.coalesce(parsed, F.array().cast("array<string>"))
    elif policy == "split":
        items = F.coalesce(parsed, F.split(F.regexp_replace(text, r"[\[\]'\"]", ""), ","))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    trimmed = F.transform(items, lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))


def long_skills(df: DataFrame, source: str = "skills") -> DataFrame:
    """One row per listed skill; empty and missing lists give none."""
    return df.select("job_id", F.explode(source).alias("skill_name"))


def long_skills_outer(df: DataFrame, source: str = "skills") -> DataFrame:
    """As :func:`long_skills`, with a null row for an empty list."""
    return df.select("job_id", F.explode_outer(source).alias("skill_name"))
