"""Reading and writing raw files, snapshots, run history, logs and exports."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType, TimestampType

from labourlens.operators.merge import list_decode, stack
from labourlens.schemas import PAGE, RUN

CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


# --- sources ---------------------------------------------------------------------

def read_raw_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType, list_columns: Sequence[str] = (),
                 policy: str = "empty") -> DataFrame:
    """All matching raw files stacked; an empty table when there is none.

    Columns are matched by their header name, file by file, and typed by
    ``schema``: Spark takes names from one file and places from all, so files of
    one header line are read together and the groups stacked by name.
    ``list_columns`` hold list literals as text and come back as arrays.
    """
    frames = []
    for path in [paths] if isinstance(paths, str) else paths:
        options = CSV if re.search(r"[*?{\[]", path) else CSV | {"basePath": path}
        for files in _by_header(spark, path):
            text = spark.read.options(**options).csv(files)  # all columns as text, named by the header
            frames.append(text.select(*[_typed(text, f) for f in schema]))
    if not frames:
        return empty(spark, schema)
    df = stack(*frames)
    return df.withColumns({c: list_decode(c, policy) for c in list_columns}) if list_columns else df


def _by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files under a path, one list for each header line that occurs."""
    try:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"),
                                             F.col("_metadata.file_block_start").alias("at"))
    except AnalysisException as error:
        if _missing(error):
            return []
        raise
    first = lines.where("at = 0").groupBy("f").agg(F.min_by("value", "i").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in first.orderBy("f").collect():  # a row per file
        groups.setdefault(row["header"], []).append(unquote(row["f"]))
    return list(groups.values())


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Folder and time of every file under a path; no file is opened."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as error:
        if _missing(error):
            return empty(spark, StructType([StructField("folder", StringType()), StructField("written", TimestampType())]))
        raise
    return found.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.col("modificationTime").alias("written"))


def _typed(text: DataFrame, field: StructField) -> Column:
    """A text column as its declared type; null when absent or unreadable."""
    value = F.col(field.name).cast("string") if field.name in text.columns else F.lit(None).cast("string")
    if isinstance(field.dataType, (ArrayType, MapType, StringType)):
        return value.alias(field.name)
    return value.try_cast(field.dataType).alias(field.name)


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored table, or an empty one of the same schema if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if _missing(error):
            return empty(spark, schema)
        raise


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest snapshot, found by listing folders; the others are not read."""
    stamp = F.regexp_extract("folder", r"/snapshot_ts=([^/]+)", 1)
    newest = _listed(spark, path).agg(F.max(stamp)).first()[0]
    if not newest:
        raise FileNotFoundError(f"no snapshot under {path}")
    return spark.read.parquet(f"{path}/snapshot_ts={unquote(newest)}")


def newest_file(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the folder under ``path`` that was written to last.

    A folder is one snapshot, whatever number of files it holds and however long
    they took to write.
    """
    newest = _listed(spark, path).agg(F.max_by("folder", F.struct("written", "folder"))).first()[0]
    if not newest:
        raise FileNotFoundError(f"nothing under {path}")
    return spark.read.parquet(unquote(newest))


def last_version(spark: SparkSession, root: str, below: int) -> int | None:
    """The highest stored version of a table under a number."""
    number = F.regexp_extract("folder", r"/version=(\d+)$", 1).try_cast("long")
    return _listed(spark, root).agg(F.max(F.when(number < below, number))).first()[0]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Archived pages, one HTML file each, as ``(page_id, url, html)``."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    return files.select(F.xxhash64("p").alias(PAGE[0].name), F.col("p").alias("url"), F.col("value").alias("html"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run history, one nested JSON document per file."""
    return spark.read.schema(RUN).option("multiLine", True).json(path)


def read_runs_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """Run history, or an empty one before the first run."""
    try:
        return read_runs(spark, path)
    except AnalysisException as error:
        if _missing(error):
            return empty(spark, RUN)
        raise


def run_counts(runs: DataFrame) -> DataFrame:
    """One row per run and site."""
    return runs.select("timestamp", "n_jobs", "n_new", F.explode("src_counts").alias("site", "n"))


# --- sinks -----------------------------------------------------------------------

def flat_lists(df: DataFrame) -> DataFrame:
    """Array columns as JSON text, for formats without arrays; quotes in items are escaped."""
    arrays = [f.name for f in df.schema if isinstance(f.dataType, ArrayType)]
    return df.withColumns({c: F.to_json(c) for c in arrays}) if arrays else df


def write_raw(df: DataFrame, path: str, fmt: str = "csv", site: str = "source_site", mode: str = "append") -> None:
    """Raw rows under one folder per site, added to what is there or in its place; JSON is compressed."""
    if fmt == "csv":
        flat_lists(df).write.mode(mode).partitionBy(site).options(header=True, escape='"', quoteAll=True).csv(path)
    elif fmt == "json":
        df.write.mode(mode).partitionBy(site).json(path, compression="gzip")
    else:
        raise ValueError(f"unknown raw format {fmt!r}")


def write_snapshot(df: DataFrame, path: str, snapshot_ts: str) -> None:
    """A dated Parquet snapshot beside the earlier ones; lists stay arrays.

    The snapshot is its own partition folder and is replaced as a whole, so a
    retried job leaves one copy.
    """
    df.write.mode("overwrite").parquet(f"{path}/snapshot_ts={snapshot_ts}")


def write_pages(pages: DataFrame, path: str, stamp: str) -> None:
    """One harvest's pages, a row each, in a folder of their own."""
    pages.select(*PAGE.fieldNames()).write.mode("overwrite").parquet(f"{path}/archived={stamp}")


def replace_table(df: DataFrame, root: str, version: str) -> str:
    """Write a full new version of a table and return its path.

    The new version goes to a new folder, so the table may be read while it is
    computed from its own last version.
    """
    target = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def append_run(spark: SparkSession, path: str, run: Mapping) -> None:
    """One run-summary row added to the history."""
    spark.createDataFrame([json.dumps(run)], "string").select(
        F.from_json("value", RUN).alias("r")).select("r.*").write.mode("append").json(path)


def append_log(lines: DataFrame, path: str) -> None:
    """Audit lines added to a text log."""
    lines.select("value").write.mode("append").text(path)


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Recommendations for another tool: joined lists in CSV, arrays in JSON."""
    if fmt == "csv":
        joined = df.withColumns({
            f.name: F.concat_ws("; ", f.name) for f in df.schema if isinstance(f.dataType, ArrayType)})
        joined.write.mode("overwrite").options(header=True, escape='"').csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")
