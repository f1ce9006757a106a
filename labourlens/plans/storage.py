"""Files written and read back, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from labourlens.operators import quality as ql
from labourlens.operators.harvest import run_harvest
from labourlens.operators import records as rc
from labourlens.operators import recommend as rec
from labourlens.plans.matching import CANDIDATES, _sql
from labourlens.plans.normalize import parsed
from labourlens.plans.registry import query
from labourlens.plans.tables import raw_records
from labourlens.schemas import COMPANY, SKILL
from labourlens.session import scratch, stored
from labourlens.sources import files
from labourlens.sources.adapters import POSTINGS_CTE, SKILLS_CTE, job_skills, postings, table
from labourlens.streaming import ingest as st


@query("raw_csv_by_site", f"""WITH {POSTINGS_CTE} SELECT source_site, count(*) AS n, count(DISTINCT job_id) AS ids,
  count(city) AS with_city FROM postings GROUP BY 1""")
def raw_csv_by_site(spark, d):
    """Raw postings to one CSV folder per site and back, text with commas, quotes and line breaks."""
    path = scratch(spark, "raw-csv")
    rows = postings(spark, d).select("job_id", F.col("city_raw").alias("city"), "source_site",
                                     F.concat(F.lit('a "quoted", text\nover lines '), "job_id").alias("description"))
    files.write_raw(rows, path)
    schema = StructType([StructField(c, StringType()) for c in ("job_id", "city", "description", "source_site")])
    back = files.read_raw_csv(spark, path, schema)
    whole = F.col("description") == F.concat(F.lit('a "quoted", text\nover lines '), "job_id")
    return back.where(whole).groupBy("source_site").agg(
        F.count("*").alias("n"), F.countDistinct("job_id").alias("ids"), F.count_if(F.trim("city") != "").alias("with_city"))


@query("raw_json_by_site", f"WITH {POSTINGS_CTE} SELECT source_site, job_id, k % 7 AS n FROM postings")
def raw_json_by_site(spark, d):
    path = scratch(spark, "raw-json")
    files.write_raw(postings(spark, d).select("source_site", "job_id", (F.col("k") % 7).alias("n")), path, "json")
    return spark.read.schema("job_id string, n long, source_site string").json(path)


@query("raw_skills_csv", f"WITH {SKILLS_CTE} SELECT DISTINCT job_id, canonical AS skill_name FROM posting_skills")
def raw_skills_csv(spark, d):
    """Skill rows of the records through CSV."""
    path = scratch(spark, "raw-skills")
    records = rc.normalize_batch(raw_records(spark, d).where("skills_raw IS NOT NULL"), "ord")
    rc.skill_rows(records).select(*SKILL.fieldNames()).write.options(header=True, escape='"').csv(path)
    return files.read_raw_csv(spark, path, SKILL).select("job_id", "skill_name")


@query("list_columns_csv", f"""WITH {SKILLS_CTE} SELECT job_id, list_sort(list_distinct(list(skill_name))) AS skills FROM job_skills GROUP BY 1""")
def list_columns_csv(spark, d):
    """Array columns survive CSV as list literals."""
    path = scratch(spark, "lists")
    rec_sets = rec.skill_sets(job_skills(spark, d))
    files.flat_lists(rec_sets).write.options(header=True, escape='"').csv(path)
    schema = StructType([StructField("job_id", StringType()), StructField("skills", StringType())])
    return files.read_raw_csv(spark, path, schema, ["skills"])


@query("snapshot_latest", f"WITH {POSTINGS_CTE} SELECT job_id, 'new' AS state FROM postings")
def snapshot_latest(spark, d):
    path = scratch(spark, "snapshots")
    rows = postings(spark, d).select("job_id")
    files.write_snapshot(rows.withColumn("state", F.lit("old")), path, "20240101_000000")
    files.write_snapshot(rows.withColumn("state", F.lit("new")), path, "20240201_000000")
    return files.latest_snapshot(spark, path)


@query("table_versions", """SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer""")
def table_versions(spark, d):
    """A table replaced by a version computed from itself."""
    root = scratch(spark, "versions")
    first = files.replace_table(table(spark, d, "customer").select("c_custkey", "c_acctbal"), root, "1")
    second = files.replace_table(spark.read.parquet(first).withColumn("c_acctbal", F.col("c_acctbal") + 1), root, "2")
    return spark.read.parquet(second)


@query("run_history", f"""WITH {POSTINGS_CTE}, t AS (SELECT count(*) AS n_jobs FROM postings),
c AS (SELECT source_site AS site, count(*) AS n FROM postings GROUP BY 1)
SELECT ts AS timestamp, n_jobs, 0 AS n_new, site, n * f AS n FROM c, t, (VALUES ('20240101_000000', 1), ('20240102_000000', 2)) r(ts, f)""")
def run_history(spark, d):
    path = scratch(spark, "runs")
    counts = {r[0]: r[1] for r in postings(spark, d).groupBy("source_site").count().collect()}  # one row per site
    for factor, stamp in ((1, "20240101_000000"), (2, "20240102_000000")):
        files.append_run(spark, path, {
            "timestamp": stamp, "n_jobs": sum(counts.values()), "n_new": 0, "keywords": ["python"], "max_pages": 2,
            "src_counts": {s: n * factor for s, n in counts.items()}, "sites": sorted(counts)})
    return files.run_counts(files.read_runs(spark, path))


@query("audit_log_file", f"""WITH {POSTINGS_CTE} SELECT job_id || '|job_title|NORMALIZED|' || job_title_raw || '|' || job_title AS value
FROM postings WHERE job_title <> job_title_raw""")
def audit_log_file(spark, d):
    from labourlens.plans.tables import audit_rows
    path = scratch(spark, "audit")
    files.append_log(ql.audit_text(audit_rows(spark, d)), path)
    return spark.read.text(path)


@query("source_log", f"""WITH {POSTINGS_CTE} SELECT job_id || '|' || source_site || '|https://example.test/' || job_id || '|' || strftime(posted_at, '%Y-%m-%dT%H:%M:%S') AS value FROM postings""")
def source_log(spark, d):
    rows = postings(spark, d).select("job_id", "source_site", F.concat(F.lit("https://example.test/"), "job_id").alias("source_url"),
                                     F.col("posted_at").alias("crawled_at"))
    return ql.source_log(rows)


@query("export_files", _sql(CANDIDATES, "").replace(
    "list_sort(list_intersect(skills, wish)) AS", "array_to_string(list_sort(list_intersect(skills, wish)), '; ') AS").replace(
    "list_sort(list_filter(skills, lambda x: NOT list_contains(wish, x))) AS",
    "array_to_string(list_sort(list_filter(skills, lambda x: NOT list_contains(wish, x))), '; ') AS"))
def export_files(spark, d):
    path = scratch(spark, "export")
    jobs = postings(spark, d).select("job_id", F.col("city_raw").alias("city"))
    files.export(rec.recommend(rec.build_index(job_skills(spark, d)), jobs, CANDIDATES).drop("city"), path)
    back = spark.read.schema("profile_id string, rank int, job_id string, similarity_score double, matched_skills string, missing_skills string").options(
        header=True, escape='"').csv(path)
    return back.na.fill("", ["matched_skills", "missing_skills"])


@query("row_gate", f"WITH {POSTINGS_CTE} SELECT count(*) AS n FROM postings")
def row_gate(spark, d):
    return ql.require_rows(parsed(spark, d, salary=False), 10).agg(F.count("*").alias("n"))


@query("raw_csv_two_headers", f"""WITH {POSTINGS_CTE} SELECT job_id, source_site, CASE WHEN k % 2 = 0 THEN job_title_raw END AS job_title,
  ['it''s', 'a "b", c'] AS tags FROM postings""")
def raw_csv_two_headers(spark, d):
    """Files whose columns stand in another order, or are absent, stacked by name; list items with quotes."""
    path = scratch(spark, "two-headers")
    p = postings(spark, d).select("k", "job_id", "source_site", F.col("job_title_raw").alias("job_title"),
                                  F.array(F.lit("it's"), F.lit('a "b", c')).alias("tags"))
    for name, part in (("even", p.where("k % 2 = 0").select("tags", "job_id", "job_title", "source_site")),
                       ("odd", p.where("k % 2 = 1").select("source_site", "tags", "job_id"))):
        files.flat_lists(part).write.options(header=True, escape='"', quoteAll=True).csv(f"{path}/{name}")
    schema = StructType([StructField(c, StringType()) for c in ("job_id", "job_title", "source_site", "tags")])
    return files.read_raw_csv(spark, [f"{path}/even", f"{path}/odd"], schema, ["tags"])


EVENTS = StructType([StructField("event_id", LongType()), StructField("user_id", LongType()), StructField("event_type", StringType())])


def event_stream(spark, d):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(d))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


#: Rows that one file of an arrival should hold.
ARRIVAL_ROWS = 250_000


def waves(rows, path, order, fmt="parquet", n=4, **options):
    """Rows written in ``n`` arrivals by the order column, one after the other; the number of files of each, which grows with the rows."""
    lo, hi, count = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    files = count // (n * ARRIVAL_ROWS) + 1
    wave = F.floor((F.col(order) - F.lit(lo)) * n / (F.lit(hi) - F.lit(lo) + 1))
    for i in range(n):
        rows.where(wave == i).repartition(files).write.mode("append").format(fmt).options(**options).save(path)
    return files


@query("stream_ingest_dedup", """SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def stream_ingest_dedup(spark, d):
    """First event of every user, over several batches."""
    path, check, src = (scratch(spark, n) for n in ("ingest", "ingest-check", "ingest-src"))
    files = waves(table(spark, d, "events").select("event_id", "user_id", "event_type"), src, "event_id")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(src)
    st.ingest(stream, path, check, "user_id", "event_id", EVENTS).awaitTermination()
    return st.kept(spark, path, EVENTS).select("user_id", "event_id", "event_type")


RECORDS = StructType([StructField(c, StringType()) for c in ("job_id", "job_title", "company_name", "city")] + [
    StructField("salary_mid", DoubleType()), StructField("ord", LongType())])


@query("stream_harvest", f"""WITH {POSTINGS_CTE} SELECT job_id, job_title, c_name AS company_name, city, salary_mid, ord
FROM postings JOIN customer ON c_custkey = custkey QUALIFY ord = min(ord) OVER (PARTITION BY job_id)""")
def stream_harvest(spark, d):
    """Raw postings in several arrivals, each normalised before it is merged; every arrival after the first repeats some rows."""
    path, check, src = (scratch(spark, n) for n in ("harvest-stream", "harvest-check", "harvest-src"))
    raw = stored(raw_records(spark, d).drop("description_raw"), "raw")
    files = waves(raw, src, "ord", "json", 2, compression="gzip")
    raw.where("ord % 3 = 0").repartition(files).write.mode("append").json(src, compression="gzip")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", files).json(src)
    st.ingest(stream, path, check, "job_id", "ord", RECORDS, prepare=lambda batch: rc.normalize_batch(batch, "ord")).awaitTermination()
    return st.kept(spark, path, RECORDS)


@query("stream_daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n FROM events GROUP BY 1")
def stream_daily_counts(spark, d):
    path, check = scratch(spark, "daily"), scratch(spark, "daily-check")
    st.write_counts(st.period_counts(event_stream(spark, d), "ts"), path, check).awaitTermination()
    return st.latest_counts(spark, path).select(F.date_format("period", "yyyy-MM-dd").alias("period"), "n")


@query("stream_distinct", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_distinct(spark, d):
    path, check = scratch(spark, "distinct"), scratch(spark, "distinct-check")
    twice = event_stream(spark, d).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = st.distinct_within(twice, "event_id", "ts", "1 day")
    (once.writeStream.format("parquet").option("path", path).option("checkpointLocation", check)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("harvest_merge", f"""WITH {POSTINGS_CTE}, n AS (SELECT count(DISTINCT custkey) AS n FROM postings)
SELECT harvest_no, n AS n_jobs, CASE harvest_no WHEN 1 THEN n ELSE 0 END AS n_new FROM n, (VALUES (1), (2)) v(harvest_no)""")
def harvest_merge(spark, d):
    """The same harvest merged again after a run that brought nothing: no new rows, none lost.

    All phases at their usual thresholds.  The postings share one description, so one of each company stays.
    """
    root = scratch(spark, "harvest")
    runs = [run_harvest(spark, raw_records(spark, d), root, i, f"2024010{i}_000000") for i in (1, 3)]
    return spark.createDataFrame([(i + 1, r["n_jobs"], r["n_new"]) for i, r in enumerate(runs)],
                                 "harvest_no int, n_jobs long, n_new long")


@query("raw_companies_csv", f"""WITH {POSTINGS_CTE} SELECT 'comp_' || md5(c_name) AS company_id, c_name AS company_name, source_site
FROM postings JOIN customer ON c_custkey = custkey GROUP BY c_name, source_site""")
def raw_companies_csv(spark, d):
    path = scratch(spark, "raw-companies")
    files.write_raw(rc.company_rows(rc.normalize_batch(raw_records(spark, d), "ord"), "ord"), path)
    return files.read_raw_csv(spark, path, COMPANY).select("company_id", "company_name", "source_site")


@query("page_archive", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def page_archive(spark, d):
    """The last archive, of several files, beside an older one."""
    path = scratch(spark, "pages")
    pages = table(spark, d, "pages")
    files.write_pages(pages.withColumn("html", F.lit("old")), path, "20240101_000000")
    files.write_pages(pages.repartition(6, "page_id"), path, "20240102_000000")
    return files.newest_file(spark, path).select("page_id", "url", F.length("html").alias("n_chars"))
