"""Market aggregates over normalised postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from labourlens.dictionaries import EXPERIENCE_BINS, REMOTE_OPTIONS
from labourlens.functions import category
from labourlens.functions.experience import experience_bin, mixed_years
from labourlens.functions.keys import month
from labourlens.functions.text import floor_round
from labourlens.functions.title import add_title
from labourlens.operators import profile as pr
from labourlens.operators.skills import normalize_skills
from labourlens.plans.normalize import parsed
from labourlens.plans.registry import query
from labourlens.sources.adapters import (
    BIN_SQL, POSTINGS_CTE, SKILLS_CTE, floor_sql, posting_skills, postings, table,
)

BIN = BIN_SQL.format("experience_years")


def paid(spark, d):
    """Postings with a known salary."""
    return parsed(spark, d).where("salary_mid IS NOT NULL")


@query("value_counts", f"""WITH {POSTINGS_CTE}
SELECT city, count(*) AS n FROM postings WHERE city IS NOT NULL GROUP BY city""")
def value_counts(spark, d):
    return pr.value_counts(parsed(spark, d, salary=False), "city")


@query("category_counts", f"""WITH {POSTINGS_CTE}, x AS (
  SELECT 'remote_option' AS field, remote_option AS value FROM postings UNION ALL
  SELECT 'job_type', job_type FROM postings UNION ALL SELECT 'education_level', education_level FROM postings UNION ALL
  SELECT 'source_site', source_site FROM postings UNION ALL SELECT 'experience_bin', {BIN} FROM postings)
SELECT field, value, count(*) AS n FROM x GROUP BY 1, 2""")
def category_counts(spark, d):
    fields = ["remote_option", "job_type", "education_level", "source_site", "experience_bin"]
    # Count the combinations once, then split the few combinations by field.
    combos = parsed(spark, d, salary=False).groupBy(*fields).agg(F.count("*").alias("c"))
    long = combos.select("c", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x"))
    return long.where("x.value IS NOT NULL").groupBy("x.field", "x.value").agg(F.sum("c").alias("n"))


@query("salary_by_experience", f"""WITH {POSTINGS_CTE}
SELECT {BIN} AS experience_bin, {floor_sql('avg(salary_mid)')} AS mean, {floor_sql('quantile_cont(salary_mid, 0.5)')} AS median,
  count(*) AS n FROM postings WHERE salary_mid IS NOT NULL GROUP BY 1""")
def salary_by_experience(spark, d):
    return pr.ordered_by(pr.stats_by(paid(spark, d), "experience_bin", "salary_mid"), "experience_bin", EXPERIENCE_BINS)


@query("salary_by_city", f"""WITH {POSTINGS_CTE}
SELECT city, {floor_sql('avg(salary_mid)')} AS mean, {floor_sql('quantile_cont(salary_mid, 0.5)')} AS median,
  count(*) AS n FROM postings WHERE salary_mid IS NOT NULL AND city IS NOT NULL GROUP BY 1""")
def salary_by_city(spark, d):
    return pr.stats_by(paid(spark, d), "city", "salary_mid")


@query("salary_by_remote", f"""WITH {POSTINGS_CTE}
SELECT remote_option, {floor_sql('avg(salary_mid)')} AS mean, {floor_sql('quantile_cont(salary_mid, 0.5)')} AS median,
  count(*) AS n FROM postings WHERE salary_mid IS NOT NULL GROUP BY 1""")
def salary_by_remote(spark, d):
    return pr.stats_by(paid(spark, d), "remote_option", "salary_mid")


@query("salary_by_title", f"""WITH {POSTINGS_CTE}
SELECT job_title, {floor_sql('avg(salary_mid)')} AS mean, {floor_sql('quantile_cont(salary_mid, 0.5)')} AS median,
  count(*) AS n FROM postings WHERE salary_mid IS NOT NULL GROUP BY 1
ORDER BY mean DESC, job_title LIMIT 20""")
def salary_by_title(spark, d):
    return pr.stats_by(paid(spark, d), "job_title", "salary_mid").orderBy(F.desc("mean"), "job_title").limit(20)


@query("salary_by_english", f"""WITH {POSTINGS_CTE}, {SKILLS_CTE},
e AS (SELECT DISTINCT job_id FROM job_skills WHERE skill_name = 'English')
SELECT e.job_id IS NOT NULL AS has_english, {floor_sql('avg(salary_mid)')} AS mean,
  {floor_sql('quantile_cont(salary_mid, 0.5)')} AS median, count(*) AS n
FROM postings LEFT JOIN e ON e.job_id = postings.job_id WHERE salary_mid IS NOT NULL GROUP BY 1""")
def salary_by_english(spark, d):
    english = (normalize_skills(posting_skills(spark, d)).where("skill_group = 'Language'")
               .select("job_id", F.lit(True).alias("has_english")).distinct())
    flagged = paid(spark, d).join(english, "job_id", "left").withColumn(
        "has_english", F.coalesce("has_english", F.lit(False)))
    return pr.stats_by(flagged, "has_english", "salary_mid")


@query("salary_pivot", f"""WITH {POSTINGS_CTE}, b AS (SELECT city, {BIN} AS bin, salary_mid FROM postings WHERE salary_mid IS NOT NULL
  AND city IS NOT NULL)
SELECT city, {', '.join(floor_sql(f"avg(salary_mid) FILTER (bin = '{b}')") + f' AS {b}' for b in EXPERIENCE_BINS)}
FROM b WHERE bin <> 'unknown' GROUP BY city""")
def salary_pivot(spark, d):
    return pr.pivot_mean(paid(spark, d), "city", "experience_bin", "salary_mid", EXPERIENCE_BINS)


@query("remote_crosstab", f"""WITH {POSTINGS_CTE}
SELECT city, {', '.join(floor_sql(f"count(*) FILTER (remote_option = '{r}') * 100.0 / count(*)") + f' AS "{r}"' for r in REMOTE_OPTIONS)}
FROM postings WHERE city IS NOT NULL GROUP BY city""")
def remote_crosstab(spark, d):
    return pr.crosstab_pct(parsed(spark, d, salary=False), "city", "remote_option", REMOTE_OPTIONS)


@query("skills_per_title", f"""WITH {POSTINGS_CTE}, {SKILLS_CTE}
SELECT job_title, count(DISTINCT skill_name) AS n_skills FROM postings LEFT JOIN job_skills USING (job_id) GROUP BY 1""")
def skills_per_title(spark, d):
    titles = add_title(postings(spark, d)).select("job_id", "job_title")
    skills = normalize_skills(posting_skills(spark, d)).select("job_id", "canonical")
    return titles.join(skills, "job_id", "left").groupBy("job_title").agg(
        F.countDistinct("canonical").alias("n_skills"))


@query("hidden_rate", f"""WITH {POSTINGS_CTE}
SELECT job_title, {floor_sql('avg(CAST(salary_hidden AS INTEGER)) * 100')} AS hidden_pct, count(*) AS n
FROM postings GROUP BY 1 HAVING count(*) >= 3 ORDER BY avg(CAST(salary_hidden AS INTEGER)) DESC, job_title LIMIT 10""")
def hidden_rate(spark, d):
    rate = F.avg(F.col("salary_hidden").cast("int"))
    return (parsed(spark, d).groupBy("job_title").agg(rate.alias("rate"), F.count("*").alias("n"))
            .where("n >= 3").orderBy(F.desc("rate"), "job_title").limit(10)
            .select("job_title", floor_round(F.col("rate") * 100, 1).alias("hidden_pct"), "n"))


@query("monthly_counts", """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders
WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def monthly_counts(spark, d):
    return (table(spark, d, "orders").where("o_orderdate IS NOT NULL").groupBy(month("o_orderdate").alias("month"))
            .agg(F.count("*").alias("n")).orderBy("month"))


@query("experience_mixed_bins", f"""WITH {POSTINGS_CTE}
SELECT city, replace({BIN}, 'unknown', 'Not specified') AS experience_bin, count(*) AS n FROM postings GROUP BY 1, 2""")
def experience_mixed_bins(spark, d):
    return postings(spark, d).groupBy(
        category.city("city_raw").alias("city"),
        experience_bin(mixed_years("experience_raw"), "Not specified").alias("experience_bin"),
    ).agg(F.count("*").alias("n"))


@query("boxplot_stats", f"""WITH {POSTINGS_CTE}, p AS (SELECT {BIN} AS experience_bin, salary_mid AS v FROM postings WHERE salary_mid IS NOT NULL),
q AS (SELECT experience_bin, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM p GROUP BY 1)
SELECT experience_bin, {floor_sql('any_value(q1)', 4)} AS q1, {floor_sql('any_value(med)', 4)} AS median, {floor_sql('any_value(q3)', 4)} AS q3,
  min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers, count(*) AS n
FROM p JOIN q USING (experience_bin) GROUP BY experience_bin""")
def boxplot_stats(spark, d):
    return pr.boxplot(paid(spark, d), "experience_bin", "salary_mid")


@query("price_boxplot", f"""WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1,
  quantile_cont(o_totalprice, 0.5) AS med, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderpriority, {floor_sql('any_value(q1)', 2)} AS q1, {floor_sql('any_value(med)', 2)} AS median, {floor_sql('any_value(q3)', 2)} AS q3,
  min(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
  max(o_totalprice) FILTER (o_totalprice <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (NOT o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers, count(*) AS n
FROM orders JOIN q USING (o_orderpriority) GROUP BY 1""")
def price_boxplot(spark, d):
    return pr.boxplot(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", 2)


@query("histogram", """WITH l AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 30) AS bin_low,
  count(*) AS n FROM orders, l GROUP BY 1""")
def histogram(spark, d):
    return pr.histogram(table(spark, d, "orders"), "o_totalprice")


@query("kde", f"""WITH {POSTINGS_CTE}, p AS (SELECT remote_option, salary_mid AS v FROM postings WHERE salary_mid IS NOT NULL),
s AS (SELECT remote_option, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS bw FROM p GROUP BY 1)
SELECT remote_option, CAST(i AS INTEGER) AS i, {floor_sql('any_value(lo + (hi - lo) * i / 31)', 4)} AS x,
  {floor_sql('sum(exp(-0.5 * pow((lo + (hi - lo) * i / 31 - v) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi()))', 6)} AS density
FROM p JOIN s USING (remote_option), range(0, 32) AS g(i) GROUP BY remote_option, i""")
def kde(spark, d):
    return pr.density(paid(spark, d), "remote_option", "salary_mid")


@query("share", f"""WITH {SKILLS_CTE}
SELECT skill_group, count(*) AS n, {floor_sql('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct FROM posting_skills GROUP BY 1""")
def share(spark, d):
    return pr.shares(normalize_skills(posting_skills(spark, d)), "skill_group")


@query("trend", f"""SELECT count(*) AS n, {floor_sql('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope,
  {floor_sql('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept,
  {floor_sql('regr_r2(l_extendedprice, l_quantity)', 4)} AS r2 FROM lineitem""")
def trend(spark, d):
    return pr.trend(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("numeric_profile", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count({c}) AS n, {floor_sql(f'avg({c})', 4)} AS mean,
  {floor_sql(f'quantile_cont({c}, 0.5)', 4)} AS median, {floor_sql(f'stddev_samp({c})', 4)} AS std, {floor_sql(f'min({c})', 4)} AS min,
  {floor_sql(f'max({c})', 4)} AS max, {floor_sql(f'quantile_cont({c}, 0.25)', 4)} AS q25, {floor_sql(f'quantile_cont({c}, 0.75)', 4)} AS q75
FROM postings""" for c in ("salary_min", "salary_max", "experience_years")).join([f"WITH {POSTINGS_CTE} ", ""]))
def numeric_profile(spark, d):
    return pr.numeric_profile(parsed(spark, d), ["salary_min", "salary_max", "experience_years"])


@query("price_profile", f"""SELECT 'l_extendedprice' AS column_name, count(*) AS n, {floor_sql('avg(l_extendedprice)', 2)} AS mean,
  {floor_sql('quantile_cont(l_extendedprice, 0.5)', 2)} AS median, {floor_sql('stddev_samp(l_extendedprice)', 2)} AS std,
  {floor_sql('min(l_extendedprice)', 2)} AS min, {floor_sql('max(l_extendedprice)', 2)} AS max,
  {floor_sql('quantile_cont(l_extendedprice, 0.25)', 2)} AS q25, {floor_sql('quantile_cont(l_extendedprice, 0.75)', 2)} AS q75
FROM lineitem""")
def price_profile(spark, d):
    return pr.numeric_profile(table(spark, d, "lineitem"), ["l_extendedprice"], 2)


NULL_COLUMNS = ["job_id", "city", "salary_min", "salary_max", "salary_mid", "experience_years"]


@query("null_report", f"WITH {POSTINGS_CTE}, r AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_missing, count(*) AS n FROM postings" for c in NULL_COLUMNS)
    + f") SELECT column_name, n_missing, {floor_sql('n_missing * 100.0 / n', 2)} AS pct_missing FROM r WHERE n_missing > 0")
def null_report(spark, d):
    return pr.null_report(parsed(spark, d).select(*NULL_COLUMNS))
