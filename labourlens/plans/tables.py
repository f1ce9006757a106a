"""Merging, shaping and checking the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labourlens.functions import category
from labourlens.functions.salary import has_salary, normalize_salary
from labourlens.functions.text import floor_round
from labourlens.functions.title import add_title
from labourlens.operators import merge as mg
from labourlens.operators import quality as ql
from labourlens.operators import records as rc
from labourlens.operators.skills import normalize_skills
from labourlens.plans.normalize import parsed
from labourlens.plans.registry import query
from labourlens.sources.adapters import (
    BIN_SQL, COMPANIES_CTE, POSTINGS_CTE, SKILL_NAMES, SKILLS_CTE, companies, floor_sql, job_skills, posting_skills,
    postings, table,
)


def skill_table(spark, d):
    s = normalize_skills(posting_skills(spark, d))
    return s.select("job_id", "ord", F.col("canonical").alias("skill_name"), "skill_group",
                    category.required_level("level_raw").alias("required_level"), F.trim("skill_raw").alias("original_name"))


def company_table(spark, d):
    return companies(spark, d).select(
        F.col("custkey").cast("string").alias("company_id"), "company_name",
        category.company_size("company_size_raw").alias("company_size"), "industry",
        F.when(F.col("city_raw").isNotNull(), category.company_city("city_raw")).alias("city"))


@query("merge_datasets", f"""WITH {POSTINGS_CTE}, {SKILLS_CTE}, {COMPANIES_CTE},
l AS (SELECT job_id, list(skill_group ORDER BY ord, canonical, skill_group, required_level) AS skill_groups,
        list(canonical ORDER BY ord, canonical, skill_group, required_level) AS skills,
        list(required_level ORDER BY ord, canonical, skill_group, required_level) AS skill_levels FROM posting_skills GROUP BY 1)
SELECT job_id, p.city, c.company_name, company_size, industry,
  CASE c.city WHEN 'Can Tho' THEN 'Cần Thơ' ELSE c.city END AS city_company, skills, skill_groups, skill_levels
FROM postings p LEFT JOIN companies c USING (custkey) LEFT JOIN l USING (job_id)""")
def merge_datasets(spark, d):
    jobs = postings(spark, d).select("job_id", F.col("custkey").cast("string").alias("company_id"),
                                     category.city("city_raw").alias("city"))
    merged = mg.merge_datasets(jobs, skill_table(spark, d), company_table(spark, d))
    return merged.drop("company_id", "skill_originals")


@query("merge_again", f"""WITH {POSTINGS_CTE}, {COMPANIES_CTE}
SELECT job_id, p.city, company_name, company_size, industry,
  CASE c.city WHEN 'Can Tho' THEN 'Cần Thơ' ELSE c.city END AS city_company
FROM postings p LEFT JOIN companies c USING (custkey)""")
def merge_again(spark, d):
    """A merged table loses the copied columns before it is merged once more."""
    jobs = postings(spark, d).select("job_id", F.col("custkey").cast("string").alias("company_id"),
                                     category.city("city_raw").alias("city"))
    firms = company_table(spark, d)
    once = mg.drop_copied(mg.merge_datasets(jobs, None, firms)).drop("company_name", "company_size", "industry")
    return mg.merge_datasets(once, None, firms).drop("company_id")


_COUNT_COLUMNS = {n: "skill_" + "".join(ch if ch.isalnum() else "_" for ch in n.lower()) for n in SKILL_NAMES}


@query("feature_matrix", f"""WITH {POSTINGS_CTE}, {SKILLS_CTE}, w AS (SELECT job_id, {', '.join(
    f"count(*) FILTER (skill_name = '{n}') AS {c}" for n, c in _COUNT_COLUMNS.items())} FROM job_skills GROUP BY 1)
SELECT p.job_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _COUNT_COLUMNS.values())} FROM postings p LEFT JOIN w USING (job_id)""")
def feature_matrix(spark, d):
    return mg.skill_counts(postings(spark, d).select("job_id"), job_skills(spark, d), SKILL_NAMES)


@query("keep_first", """SELECT l_orderkey, strftime(any_value(r.l_shipdate), '%Y-%m-%d') AS shipped, any_value(r.l_linenumber) AS l_linenumber,
  any_value(r.l_partkey) AS l_partkey, any_value(r.l_suppkey) AS l_suppkey
FROM (SELECT l_orderkey, min({'l_shipdate': l_shipdate, 'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey}) AS r
      FROM lineitem GROUP BY 1) GROUP BY 1""")
def keep_first(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    kept = mg.keep_first(lines, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"])
    return kept.withColumn("shipped", F.date_format("l_shipdate", "yyyy-MM-dd")).drop("l_shipdate")


@query("keep_blank_keys", f"""WITH {POSTINGS_CTE}
SELECT city, min(k) AS k FROM postings WHERE city IS NOT NULL GROUP BY 1 UNION ALL SELECT city, k FROM postings WHERE city IS NULL""")
def keep_blank_keys(spark, d):
    rows = postings(spark, d).select(category.city("city_raw").alias("city"), "k")
    return mg.keep_first(rows, ["city"], ["k"])


@query("company_last", """SELECT o_custkey, r.site AS source_site, r.k AS o_orderkey FROM (
  SELECT o_custkey, max({'k': o_orderkey, 'site': o_orderpriority}) AS r FROM orders GROUP BY o_custkey, o_orderpriority)""")
def company_last(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("source_site"), "o_orderkey")
    return mg.keep_last(rows, ["o_custkey", "source_site"], ["o_orderkey"])


@query("company_first_known", f"""WITH {POSTINGS_CTE}
SELECT custkey, arg_min(city, k) FILTER (city IS NOT NULL) AS city, arg_min(salary_mid, k) FILTER (salary_mid IS NOT NULL) AS salary_mid,
  arg_min(experience_years, k) FILTER (experience_years IS NOT NULL) AS experience_years FROM postings GROUP BY 1""")
def company_first_known(spark, d):
    return mg.first_known(parsed(spark, d), "custkey", "k", ["city", "salary_mid", "experience_years"])


@query("list_decode", f"""WITH {SKILLS_CTE}, l AS (SELECT job_id, list(canonical ORDER BY ord, canonical) AS skills FROM posting_skills GROUP BY 1)
SELECT job_id, skills, CAST(len(skills) AS INTEGER) AS n, CASE WHEN len(skills) > 3 THEN NULL ELSE skills END AS skipped,
  CASE WHEN len(skills) > 3 THEN skills ELSE skills END AS splitted FROM l""")
def list_decode(spark, d):
    names = normalize_skills(posting_skills(spark, d)).groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "canonical")))["canonical"].alias("names"))
    text = F.concat(F.lit("['"), F.concat_ws("', '", "names"), F.lit("']"))
    broken = F.when(F.size("names") > 3, F.concat_ws(", ", "names")).otherwise(text)
    return names.select(
        "job_id", mg.list_decode(text).alias("skills"), F.size("names").alias("n"),
        mg.list_decode(broken, "skip").alias("skipped"), mg.list_decode(broken, "split").alias("splitted"))


@query("skill_explode", f"""WITH {POSTINGS_CTE}, {SKILLS_CTE}
SELECT job_id, skill_name FROM postings LEFT JOIN job_skills USING (job_id)""")
def skill_explode(spark, d):
    lists = mg.skill_lists(skill_table(spark, d)).select("job_id", "skills")
    jobs = postings(spark, d).select("job_id")
    return mg.long_skills_outer(jobs.join(lists, "job_id", "left"))


@query("column_alternatives", f"WITH {SKILLS_CTE} SELECT job_id, skill_name FROM job_skills")
def column_alternatives(spark, d):
    s = normalize_skills(posting_skills(spark, d)).select("job_id", F.col("canonical").alias("skill_name_canonical"))
    return mg.pick_column(s, ["skill_name", "skill_name_canonical"], "skill_name")


@query("stack_tables", """SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""")
def stack_tables(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"),
                                           F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"))
    return mg.stack(c, s)


@query("distinct_values", "SELECT DISTINCT p_name AS value FROM part WHERE p_name IS NOT NULL")
def distinct_values(spark, d):
    return table(spark, d, "part").where("p_name IS NOT NULL").select(F.col("p_name").alias("value")).distinct().orderBy("value")


@query("known_names", f"WITH {SKILLS_CTE} SELECT canonical AS name FROM posting_skills UNION SELECT lower(canonical) FROM posting_skills")
def known_names(spark, d):
    s = normalize_skills(posting_skills(spark, d)).select(F.col("canonical").alias("name"))
    return s.union(s.select(F.lower("name"))).distinct()


@query("invalid_ranges", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > l_linenumber * 7")
def invalid_ranges(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                               (F.col("l_linenumber") * 7).alias("limit"))
    return ql.invalid_ranges(lines, "l_quantity", "limit").drop("limit")


@query("duplicate_counts", f"""WITH {POSTINGS_CTE}, c AS (SELECT count(*) AS n FROM postings GROUP BY job_title, city)
SELECT (SELECT count(*) - count(DISTINCT l_orderkey) FROM lineitem) AS dup_ids, CAST((SELECT sum(n) FROM c WHERE n > 1) AS BIGINT) AS dup_pairs""")
def duplicate_counts(spark, d):
    titles = add_title(postings(spark, d)).select("job_title", category.city("city_raw").alias("city"))
    ids = ql.duplicate_counts(table(spark, d, "lineitem"), "l_orderkey", ("l_orderkey",)).select("dup_ids")
    return ids.withColumn("dup_pairs", ql.duplicate_counts(titles, "job_title").select("dup_pairs").scalar())


_NULLS = ["salary_mid", "salary_min", "salary_max", "experience_years", "city"]


@query("quality_report", f"""WITH {POSTINGS_CTE}, n AS (SELECT count(*) AS rows FROM postings), x AS (
  SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM postings UNION ALL SELECT 'columns', 6.0 UNION ALL
  {' UNION ALL '.join(f"SELECT 'missing:{c}', CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) FROM postings" for c in _NULLS)} UNION ALL
  SELECT 'count:hidden', CAST(count(*) FILTER (salary_hidden) AS DOUBLE) FROM postings UNION ALL
  SELECT 'count:paid', CAST(count(*) FILTER (salary_min IS NOT NULL OR salary_max IS NOT NULL) AS DOUBLE) FROM postings)
SELECT metric, value, CASE WHEN metric NOT IN ('rows', 'columns') THEN {floor_sql('value * 100.0 / rows')} END AS pct FROM x, n""")
def quality_report(spark, d):
    p = parsed(spark, d).select(*_NULLS, "salary_hidden")
    return ql.quality_report(p, _NULLS, {"hidden": F.col("salary_hidden"), "paid": has_salary()})


@query("stage_summary", f"""WITH {POSTINGS_CTE},
f AS (SELECT custkey, job_title, min(k) AS k FROM postings GROUP BY 1, 2)
SELECT 0 AS stage_no, 'Raw' AS stage, count(*) AS n_rows, count(*) AS n_missing FROM postings UNION ALL
SELECT 1, 'After Salary Parse', count(*), count(*) FILTER (salary_mid IS NULL) FROM postings UNION ALL
SELECT 2, 'After Dedup', count(*), count(*) FILTER (salary_mid IS NULL) FROM postings JOIN f USING (k)""")
def stage_summary(spark, d):
    raw = postings(spark, d)
    clean = add_title(normalize_salary(raw)).select("k", "custkey", "job_title", "salary_mid")
    kept = mg.keep_first(clean, ["custkey", "job_title"], ["k"])
    return ql.stage_summary({
        "Raw": raw.withColumn("salary_mid", F.lit(None).cast("double")), "After Salary Parse": clean, "After Dedup": kept})


@query("audit_rows", f"""WITH {POSTINGS_CTE}
SELECT job_id, 'job_title' AS field, 'NORMALIZED' AS issue, job_title_raw AS original_value, job_title AS fixed_value
FROM postings WHERE job_title <> job_title_raw""")
def audit_rows(spark, d):
    return ql.cleaning_audit(add_title(postings(spark, d)), "job_id", {"job_title": ("job_title_raw", "job_title")}, "NORMALIZED")


@query("audit_lines", """SELECT event_id || '|' || event_type || '|' || user_id AS value, (SELECT count(*) FROM events) AS total_lines
FROM events ORDER BY ts DESC, event_id DESC LIMIT 5""")
def audit_lines(spark, d):
    lines = table(spark, d, "events").select("ts", "event_id", "event_type", "user_id")
    tail = ql.log_tail(lines, ["ts", "event_id"])
    return tail.select(F.concat_ws("|", "event_id", "event_type", "user_id").alias("value"), "total_lines")


def _unit_sql(salt: str, chunk: int = 0) -> str:
    return f"CAST(('0x' || substr(md5(job_id || '|{salt}'), {1 + 8 * chunk}, 8)) AS BIGINT) / 4294967296.0"


@query("corrupt_sample", f"""WITH {POSTINGS_CTE}, m AS (
  SELECT job_id, CASE WHEN {_unit_sql('missing42')} < 0.15 THEN CAST(floor({_unit_sql('missing42', 1)} * 5) AS INTEGER) END AS f,
    {_unit_sql('duplicate42')} < 0.03 AS dup, {floor_sql(f"({_unit_sql('duplicate42', 1)}) * 2 - 1", 4)} AS shift,
    salary_min, salary_max, experience_years, education_level, remote_option FROM postings),
b AS (SELECT job_id, dup, shift, CASE WHEN f IS DISTINCT FROM 0 THEN salary_min END AS salary_min,
    CASE WHEN f IS DISTINCT FROM 1 THEN salary_max END AS salary_max, CASE WHEN f IS DISTINCT FROM 2 THEN experience_years END AS experience_years,
    CASE WHEN f IS DISTINCT FROM 3 THEN education_level END AS education_level, CASE WHEN f IS DISTINCT FROM 4 THEN remote_option END AS remote_option FROM m)
SELECT job_id, {floor_sql('salary_min', 4)} AS salary_min, salary_max, experience_years, education_level, remote_option FROM b UNION ALL
SELECT job_id || '_dup', {floor_sql('salary_min + shift', 4)}, salary_max, experience_years, education_level, remote_option FROM b WHERE dup""")
def corrupt_sample(spark, d):
    rows = parsed(spark, d).select("job_id", "salary_min", "salary_max", "experience_years", "education_level", "remote_option")
    return ql.damage(rows)[0].withColumn("salary_min", floor_round("salary_min", 4))


@query("corrupt_audit", f"""WITH {POSTINGS_CTE}, m AS (SELECT job_id, {_unit_sql('missing42')} < 0.15 AS hit, {_unit_sql('duplicate42')} < 0.03 AS dup,
  (['salary_min', 'salary_max', 'experience_years', 'education_level', 'remote_option'])[CAST(floor({_unit_sql('missing42', 1)} * 5) AS INTEGER) + 1] AS field FROM postings)
SELECT job_id, field, 'INJECTED_MISSING' AS issue FROM m WHERE hit UNION ALL SELECT job_id || '_dup', 'job_id', 'INJECTED_NEAR_DUP' FROM m WHERE dup""")
def corrupt_audit(spark, d):
    rows = parsed(spark, d).select("job_id", "salary_min", "salary_max", "experience_years", "education_level", "remote_option")
    return ql.damage(rows)[1].drop("original_value")


def raw_records(spark, d):
    """Postings in the loose shape a harvest gives, with tags and a description."""
    tags = posting_skills(spark, d).groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "skill_raw")))["skill_raw"].alias("skills_raw"))
    p = postings(spark, d, company=True).select(
        "job_id", "ord", F.col("job_title_raw").alias("job_title"), "company_name", F.col("city_raw").alias("city"), "source_site",
        F.concat(F.lit("https://example.test/"), "job_id").alias("source_url"), "salary_raw",
        F.col("experience_raw").alias("experience_years"), F.col("remote_raw").alias("remote_option"),
        F.col("job_type_raw").alias("job_type"), F.col("education_raw").alias("education_level"),
        F.col("contract_raw").alias("contract_type"), F.col("level_raw").alias("job_level"),
        F.lit("Strong Kafka and k8s; 4 years of practice.").alias("description_raw"),
        F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss").alias("posted_at"))
    return p.join(tags, "job_id", "left")


_RECORD_SQL = f"""WITH {POSTINGS_CTE} SELECT job_id, job_title, 'comp_' || md5(c_name) AS company_id, city, salary_min, salary_max, salary_mid,
  salary_hidden, coalesce(experience_years, 4.0) AS experience_years, {BIN_SQL.format('coalesce(experience_years, 4.0)')} AS experience_bin,
  remote_option, job_type, education_level, contract_type, job_level, strftime(posted_at, '%Y-%m-%d') AS posted
FROM postings JOIN customer ON c_custkey = custkey"""


@query("record_shape", _RECORD_SQL)
def record_shape(spark, d):
    records = rc.job_rows(rc.normalize_batch(raw_records(spark, d), "ord"))
    return records.select(
        "job_id", "job_title", "company_id", "city", "salary_min", "salary_max", "salary_mid", "salary_hidden", "experience_years",
        "experience_bin", "remote_option", "job_type", "education_level", "contract_type", "job_level",
        F.date_format("posted_at", "yyyy-MM-dd").alias("posted"))


@query("record_skills", f"""WITH {POSTINGS_CTE}, {SKILLS_CTE}
SELECT DISTINCT job_id, canonical AS skill_name, skill_group FROM posting_skills UNION ALL
SELECT job_id, x.n, x.g FROM (SELECT job_id, unnest([{{'n': 'Kafka', 'g': 'Data Science'}}, {{'n': 'Kubernetes', 'g': 'DevOps'}}]) AS x
  FROM postings WHERE job_id NOT IN (SELECT job_id FROM posting_skills))""")
def record_skills(spark, d):
    rows = rc.skill_rows(rc.normalize_batch(raw_records(spark, d), "ord"))
    return rows.select("job_id", "skill_name", "skill_group")


@query("record_companies", f"""WITH {POSTINGS_CTE}, f AS (SELECT DISTINCT ON (job_id) *, c_name FROM postings JOIN customer ON c_custkey = custkey ORDER BY job_id, ord),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY c_name, source_site ORDER BY ord DESC) = 1)
SELECT 'comp_' || md5(c_name) AS company_id, c_name AS company_name, source_site, coalesce(city, '') AS city, 'https://example.test/' || job_id AS source_url FROM l""")
def record_companies(spark, d):
    return rc.company_rows(rc.normalize_batch(raw_records(spark, d), "ord"), "ord")


@query("typed_rows", """SELECT 'job_' || o_orderkey AS job_id, 'IT' AS industry, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS DOUBLE) END AS salary_min,
  o_orderkey % 2 = 0 AS salary_hidden, 'Not specified' AS job_level, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders""")
def typed_rows(spark, d):
    k = F.col("o_orderkey")
    text = table(spark, d, "orders").select(
        F.concat(F.lit("job_"), k.cast("string")).alias("job_id"),
        F.when(k % 3 == 0, "n/a").otherwise((k % 50).cast("string")).alias("salary_min"),
        F.when(k % 2 == 0, "true").otherwise("not a flag").alias("salary_hidden"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("posted_at"))
    return rc.typed_postings(text).select("job_id", "industry", "salary_min", "salary_hidden", "job_level",
                                          F.date_format("posted_at", "yyyy-MM-dd").alias("posted"))
