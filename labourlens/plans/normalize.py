"""Salary, experience, title, category and skill normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labourlens.functions import category, keys
from labourlens.functions.experience import cascade_years, experience_bin, mixed_years, normalize_experience
from labourlens.functions.salary import bounds_mid, normalize_salary, range_text, unparsed
from labourlens.functions.title import add_title
from labourlens.functions.tokens import python_tokens
from labourlens.dictionaries import extend_skills, skill_dictionary
from labourlens.operators import skills as sk
from labourlens.operators.profile import shares
from labourlens.plans.registry import query
from labourlens.sources.adapters import (
    BIN_SQL, COMPANIES_CTE, POSTINGS_CTE, SKILLS_CTE, companies, documents, floor_sql, posting_skills, postings, table,
)


def parsed(spark: SparkSession, d: str, company: bool = False, salary: bool = True) -> DataFrame:
    """Postings with every raw column normalised."""
    p = normalize_experience(add_title(postings(spark, d, company)))
    p = p.withColumns({
        "city": category.city("city_raw"),
        "remote_option": category.remote_option("remote_raw"),
        "job_type": category.job_type("job_type_raw"),
        "contract_type": category.contract_type("contract_raw"),
        "job_level": category.job_level("level_raw"),
        "education_level": category.education_level("education_raw"),
    })
    return normalize_salary(p) if salary else p


@query("salary_normalize", f"""WITH {POSTINGS_CTE}
SELECT job_id, salary_min, salary_max, salary_mid, salary_hidden, salary_type,
  CAST(CASE salary_type WHEN 'hidden' THEN 0.95 WHEN 'range' THEN 0.9 WHEN 'yearly' THEN 0.9 WHEN 'usd' THEN 0.9
    WHEN 'up_to' THEN 0.8 WHEN 'from' THEN 0.8 WHEN 'single' THEN 0.7 ELSE 0.0 END AS DOUBLE) AS salary_confidence
FROM postings""")
def salary_normalize(spark, d):
    return normalize_salary(postings(spark, d)).select(
        "job_id", "salary_min", "salary_max", "salary_mid", "salary_hidden", "salary_type", "salary_confidence")


@query("salary_coverage", f"""WITH {POSTINGS_CTE}
SELECT source_site, count(*) AS n_rows, count(*) FILTER (salary_type <> 'unknown') AS n_parsed,
  count(*) FILTER (salary_hidden) AS n_hidden, count(*) FILTER (salary_type = 'unknown') AS n_unparsed,
  count(*) FILTER (salary_min IS NOT NULL OR salary_max IS NOT NULL) AS n_with_salary
FROM postings GROUP BY source_site""")
def salary_coverage(spark, d):
    return normalize_salary(postings(spark, d)).groupBy("source_site").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("salary_type") != "unknown").alias("n_parsed"),
        F.count_if("salary_hidden").alias("n_hidden"),
        F.count_if(F.col("salary_type") == "unknown").alias("n_unparsed"),
        F.count_if(F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()).alias("n_with_salary"),
    )


@query("salary_quarantine", "WITH " + POSTINGS_CTE + " SELECT job_id, 'Lương hấp dẫn' AS salary_raw FROM postings WHERE sf = 13")
def salary_quarantine(spark, d):
    return unparsed(normalize_salary(postings(spark, d))).select("job_id", "salary_raw")


@query("salary_bounds_mid", f"""WITH {POSTINGS_CTE}
SELECT job_id, coalesce((salary_min + salary_max) / 2, salary_min, salary_max) AS salary_bounds_mid FROM postings""")
def salary_bounds_mid(spark, d):
    return normalize_salary(postings(spark, d)).select("job_id", bounds_mid().alias("salary_bounds_mid"))


@query("salary_range_text", """SELECT o_orderkey, floor(o_totalprice * 100 / 1e6 + 0.5)::BIGINT || '-' ||
  floor(o_totalprice * 150 / 1e6 + 0.5)::BIGINT || ' triệu' AS salary_text FROM orders""")
def salary_range_text(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", range_text(price * 100, price * 150).alias("salary_text"))


@query("experience_normalize", f"""WITH {POSTINGS_CTE}
SELECT job_id, experience_years, {BIN_SQL.format('experience_years')} AS experience_bin,
  experience_years IS NOT NULL AS experience_parsed FROM postings""")
def experience_normalize(spark, d):
    return normalize_experience(postings(spark, d)).select(
        "job_id", "experience_years", "experience_bin", "experience_parsed")


@query("experience_bins", f"""WITH {POSTINGS_CTE}
SELECT replace({BIN_SQL.format('experience_years')}, 'unknown', 'Not specified') AS experience_bin, count(*) AS n,
  {floor_sql('count(*) * 100.0 / sum(count(*)) OVER ()', 1)} AS pct FROM postings GROUP BY 1""")
def experience_bins(spark, d):
    binned = postings(spark, d).select(
        experience_bin(mixed_years("experience_raw"), "Not specified").alias("experience_bin"))
    return shares(binned, "experience_bin")


@query("experience_cascade", f"""WITH {POSTINGS_CTE}
SELECT job_id, coalesce(experience_years, yrs) AS experience_years
FROM postings JOIN (SELECT k AS kk, CAST(yrs AS DOUBLE) AS yrs FROM base) ON kk = k""")
def experience_cascade(spark, d):
    text = F.concat(F.lit("Mô tả: cần tối thiểu "), F.expr("cast((k * 13) % 12 as string)"), F.lit(" years of work."))
    return postings(spark, d).select("job_id", cascade_years("experience_raw", text).alias("experience_years"))


@query("title_normalize", f"WITH {POSTINGS_CTE} SELECT job_id, job_title FROM postings")
def title_normalize(spark, d):
    return add_title(postings(spark, d)).select("job_id", "job_title")


@query("title_changes", f"""WITH {POSTINGS_CTE}
SELECT count(*) AS n_titles, count(*) FILTER (job_title <> job_title_raw) AS n_changed,
  count(DISTINCT job_title_raw) AS n_before, count(DISTINCT job_title) AS n_after FROM postings""")
def title_changes(spark, d):
    # Titles repeat heavily: normalise each spelling once, keep its weight.
    spellings = postings(spark, d).groupBy("job_title_raw").agg(F.count("*").alias("n"))
    t = add_title(spellings)
    changed = F.col("job_title") != F.col("job_title_raw")
    return t.agg(
        F.sum("n").alias("n_titles"), F.coalesce(F.sum(F.when(changed, F.col("n"))), F.lit(0)).alias("n_changed"),
        F.count("*").alias("n_before"), F.countDistinct("job_title").alias("n_after"))


@query("category_buckets", f"""WITH {POSTINGS_CTE}
SELECT job_id, remote_option, job_type, contract_type, job_level, education_level FROM postings""")
def category_buckets(spark, d):
    return postings(spark, d).select(
        "job_id",
        category.remote_option("remote_raw").alias("remote_option"),
        category.job_type("job_type_raw").alias("job_type"),
        category.contract_type("contract_raw").alias("contract_type"),
        category.job_level("level_raw").alias("job_level"),
        category.education_level("education_raw").alias("education_level"),
    )


@query("city_alias", f"WITH {POSTINGS_CTE} SELECT job_id, city FROM postings")
def city_alias(spark, d):
    return postings(spark, d).select("job_id", category.city("city_raw").alias("city"))


@query("company_buckets", f"""WITH {COMPANIES_CTE}
SELECT company_name, company_size, coalesce(CASE city WHEN 'Can Tho' THEN 'Cần Thơ' ELSE city END, '') AS city FROM companies""")
def company_buckets(spark, d):
    return companies(spark, d).select(
        "company_name",
        category.company_size("company_size_raw").alias("company_size"),
        category.company_city("city_raw").alias("city"),
    )


@query("skill_lookup", f"""WITH {SKILLS_CTE}
SELECT job_id, ord, canonical, skill_group, matched, confidence FROM posting_skills""")
def skill_lookup(spark, d):
    return sk.normalize_skills(posting_skills(spark, d)).select(
        "job_id", "ord", "canonical", "skill_group", "matched", "confidence")


@query("skill_levels", f"WITH {SKILLS_CTE} SELECT required_level, count(*) AS n FROM posting_skills GROUP BY 1")
def skill_levels(spark, d):
    return posting_skills(spark, d).groupBy(category.required_level("level_raw").alias("required_level")).agg(
        F.count("*").alias("n"))


@query("skill_stats", f"""WITH {SKILLS_CTE}
SELECT count(*) AS total_skills, count(DISTINCT canonical) AS unique_canonical,
  count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS unmatched FROM posting_skills""")
def skill_stats(spark, d):
    return sk.skill_stats(sk.normalize_skills(posting_skills(spark, d)))


@query("skill_top", f"""WITH {SKILLS_CTE}
SELECT canonical, skill_group, count(*) AS n FROM posting_skills GROUP BY 1, 2 ORDER BY n DESC, canonical LIMIT 20""")
def skill_top(spark, d):
    return (sk.normalize_skills(posting_skills(spark, d)).where("canonical <> ''").groupBy("canonical", "skill_group")
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "canonical").limit(20))


@query("skill_groups", f"WITH {SKILLS_CTE} SELECT skill_group, count(*) AS n FROM posting_skills GROUP BY 1")
def skill_groups(spark, d):
    return sk.normalize_skills(posting_skills(spark, d)).groupBy("skill_group").agg(F.count("*").alias("n"))


@query("skill_unmatched", f"""WITH {SKILLS_CTE}
SELECT canonical AS skill_raw, count(*) AS n FROM posting_skills WHERE NOT matched GROUP BY 1""")
def skill_unmatched(spark, d):
    return sk.unmatched_report(sk.normalize_skills(posting_skills(spark, d)))


_CUSTOM = f"""WITH {SKILLS_CTE}
SELECT CASE WHEN canonical IN ('Zorblax', 'Quuxify') THEN upper(canonical) ELSE canonical END AS canonical,
  CASE WHEN canonical = 'Zorblax' THEN 'Tool' WHEN canonical = 'Quuxify' THEN 'Testing' ELSE skill_group END AS skill_group,
  count(*) FILTER (matched OR canonical IN ('Zorblax', 'Quuxify')) AS n_matched, count(*) AS n
FROM posting_skills GROUP BY 1, 2"""


def custom_rows(spark):
    return spark.createDataFrame(
        [("Zorblax", "ZORBLAX", "Tool"), ("quuxify", "QUUXIFY", "Testing")],
        "alias string, canonical string, skill_group string")


def matched_counts(normal):
    return normal.groupBy("canonical", "skill_group").agg(F.count_if("matched").alias("n_matched"), F.count("*").alias("n"))


@query("skill_custom", _CUSTOM)
def skill_custom(spark, d):
    return matched_counts(sk.normalize_skills(posting_skills(spark, d), entries=skill_dictionary(custom_rows(spark))))


@query("skill_custom_table", _CUSTOM)
def skill_custom_table(spark, d):
    """The user's entries and a spelling for each customer, joined as a table of any size."""
    firms = table(spark, d, "customer").select(F.concat(F.lit("skill of "), "c_custkey").alias("alias"), F.col("c_name").alias("canonical"), F.lit("Firm").alias("skill_group"))
    entries = sk.dictionary_table(custom_rows(spark).unionByName(firms))
    return matched_counts(sk.normalize_skills(posting_skills(spark, d), entries=entries))


# Words of four languages as user entries, one of them two words long.
TEXT_WORDS = [("the", "English prose", "Prose"), ("und", "German prose", "Prose"), ("des", "French prose", "Prose"),
              ("para", "Spanish prose", "Prose"), ("of the", "English phrase", "Phrase")]


def _extract_sql() -> str:
    entries = extend_skills(TEXT_WORDS)
    keys_ = {" ".join(python_tokens(e.canonical)): e.canonical for e in entries}
    keys_ |= {" ".join(python_tokens(e.alias)): e.canonical for e in entries}
    longest = max(k.count(" ") for k in keys_) + 1
    known = ", ".join(f"('{k}', '{c}')" for k, c in keys_.items())
    grams = " UNION ALL ".join(
        f"SELECT doc_id, unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], ' '))) AS g FROM w"
        for n in range(1, longest + 1))
    return f"""WITH w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+(?:\\.[\\p{{L}}\\p{{N}}_]+)*[+#]*|[^\\s\\p{{L}}\\p{{N}}_])') AS t FROM documents),
grams AS ({grams} UNION ALL SELECT doc_id, p FROM (SELECT doc_id, unnest(string_split(x, '.')) AS p FROM (SELECT doc_id, unnest(t) AS x FROM w)
  WHERE contains(x, '.')) WHERE length(p) >= 3), known(g, skill_name) AS (VALUES {known})
SELECT DISTINCT doc_id, skill_name FROM grams JOIN known USING (g)"""


@query("skill_extract", _extract_sql())
def skill_extract(spark, d):
    found = sk.skills_in_text(F.col("text"), extend_skills(TEXT_WORDS))
    return (documents(spark, d, "doc_id", "text").select("doc_id", F.explode(found).alias("s"))
            .select("doc_id", "s.skill_name"))


@query("record_keys", """SELECT o_orderkey,
  'itviec_' || md5('https://itviec.com/jobs/' || o_orderkey) AS job_id,
  'comp_' || md5('Customer ' || o_custkey) AS company_id,
  strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS posted_iso,
  'https://itviec.com/jobs/' || o_orderkey AS url, replace(o_orderpriority, ' ', '+') AS q FROM orders""")
def record_keys(spark, d):
    link = F.concat(F.lit("/jobs/"), F.col("o_orderkey").cast("string"))
    url = keys.resolve_url("https://itviec.com", link)
    iso = keys.iso_text("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey",
        keys.job_key(F.lit("itviec"), url).alias("job_id"),
        keys.company_key(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))).alias("company_id"),
        keys.month("o_orderdate").alias("month"),
        keys.iso_text(keys.iso_timestamp(iso)).alias("posted_iso"),
        url.alias("url"),
        keys.query_value("o_orderpriority").alias("q"),
    )
