"""Recommendations for candidates and similar postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from labourlens.functions import category
from labourlens.functions.experience import experience_bin, years
from labourlens.functions.salary import normalize_salary
from labourlens.functions.title import add_title
from labourlens.operators import recommend as rec
from labourlens.plans.registry import query
from labourlens.session import stored
from labourlens.sources.adapters import (
    BIN_SQL, POSTINGS_CTE, SKILLS_CTE, floor_sql, job_skills, postings,
)

CANDIDATES = [
    rec.Profile("data", ("Python", "SQL", "Machine Learning", "Basket weaving")),
    rec.Profile("web", ("JavaScript", "React", "TypeScript", "Node.js")),
    rec.Profile("blank", ()),
]
FILTERED = [
    rec.Profile("hcmc", ("Python", "SQL"), city=" hcmc "),
    rec.Profile("junior", ("Java", "Docker"), years=2.0),
    rec.Profile("both", ("AWS", "Kubernetes", "Docker"), city="Hanoi", years=5.0),
    rec.Profile("nowhere", ("Python",), city="Atlantis"),
]


def index(spark, d):
    return rec.build_index(job_skills(spark, d))


def _details(spark, d, wanted=None):
    rows = postings(spark, d)
    if wanted is not None:
        rows = rows.join(wanted, "job_id", "left_semi")
    p = add_title(normalize_salary(rows))
    return p.select("job_id", "job_title", category.city("city_raw").alias("city"), "salary_mid",
                    years("experience_raw").alias("experience_years"))


def _sql(profiles, extra: str = "", top: int = 10, bins: bool = False) -> str:
    rows = ", ".join(
        f"('{p.profile_id}', {list(p.skills) if p.skills else '[]::VARCHAR[]'}, "
        f"{repr(p.city.strip().lower()) if p.city else 'NULL'}, {p.years if p.years is not None else 'NULL'})" for p in profiles)
    keep = (f"{BIN_SQL.format('j.experience_years')} = CASE p.years WHEN 2 THEN 'junior' WHEN 5 THEN 'mid' END" if bins
            else "abs(j.experience_years - p.years) <= 0.5")
    return f"""WITH {POSTINGS_CTE}, {SKILLS_CTE},
profiles(profile_id, skills, city, years) AS (VALUES {rows}),
sets AS (SELECT job_id, list_sort(list_distinct(list(skill_name))) AS skills FROM job_skills GROUP BY 1),
known AS (SELECT list(DISTINCT skill_name) AS known FROM job_skills),
scored AS (
  SELECT p.profile_id, j.*, s.skills, p.skills AS wish, len(list_intersect(s.skills, p.skills)) AS common,
    len(list_intersect(p.skills, known)) AS n_wish
  FROM postings j JOIN sets s USING (job_id), profiles p, known
  WHERE (p.city IS NULL OR lower(j.city) = p.city) AND (p.years IS NULL OR {keep})),
ranked AS (
  SELECT *, CASE WHEN common = 0 THEN 0.0 ELSE common / sqrt(n_wish * len(skills)) END AS score FROM scored),
numbered AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY common * common / len(skills) DESC, job_id) AS rank FROM ranked)
SELECT profile_id, rank, job_id, {extra}{floor_sql('score', 4)} AS similarity_score,
  list_sort(list_intersect(skills, wish)) AS matched_skills,
  list_sort(list_filter(skills, lambda x: NOT list_contains(wish, x))) AS missing_skills
FROM numbered WHERE rank <= {top}"""


@query("recommend_profile", _sql(CANDIDATES, "job_title, city, salary_mid, experience_years, "))
def recommend_profile(spark, d):
    """Postings are ranked by id; the texts of the ranked ones only are parsed."""
    ranked = stored(rec.recommend(index(spark, d), postings(spark, d).select("job_id"), CANDIDATES), "ranked")
    return ranked.join(_details(spark, d, ranked.select("job_id").distinct()), "job_id")


@query("recommend_filtered", _sql(FILTERED, "city, experience_years, "))
def recommend_filtered(spark, d):
    jobs = _details(spark, d).select("job_id", "city", "experience_years")
    return rec.recommend(index(spark, d), jobs, FILTERED)


@query("recommend_by_bin", _sql([FILTERED[1], rec.Profile("mid", ("SQL", "Java"), years=5.0)], "city, ", bins=True))
def recommend_by_bin(spark, d):
    jobs = _details(spark, d).select("job_id", "city", experience_bin("experience_years").alias("experience_bin"))
    profiles = [FILTERED[1], rec.Profile("mid", ("SQL", "Java"), years=5.0)]
    return (rec.recommend(index(spark, d), jobs, profiles)
            .drop("experience_bin"))


@query("recommend_export", _sql(CANDIDATES, "").replace(
    "list_sort(list_intersect(skills, wish)) AS", "array_to_string(list_sort(list_intersect(skills, wish)), '; ') AS").replace(
    "list_sort(list_filter(skills, lambda x: NOT list_contains(wish, x))) AS",
    "array_to_string(list_sort(list_filter(skills, lambda x: NOT list_contains(wish, x))), '; ') AS"))
def recommend_export(spark, d):
    jobs = _details(spark, d).select("job_id", "city")
    return rec.for_export(rec.recommend(index(spark, d), jobs, CANDIDATES)).drop("city")


# Every company is a candidate: it knows three skills and wants a city and some years.
_WISH = [("Python", "SQL", "Docker"), ("Java", "React", "English"), ("AWS", "Kubernetes", "Go"), ("Django", "Ruby", "Node.js")]


@query("recommend_table", f"""WITH {POSTINGS_CTE}, {SKILLS_CTE},
profiles AS (SELECT c_name AS profile_id, ([{', '.join(str(list(w)) for w in _WISH)}])[CAST(c_nationkey % 4 AS INTEGER) + 1] AS skills,
  CASE WHEN c_custkey % 2 = 0 THEN 'hanoi' END AS city, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey % 8 AS DOUBLE) END AS years FROM customer),
sets AS (SELECT job_id, list_distinct(list(skill_name)) AS skills FROM job_skills GROUP BY 1),
scored AS (SELECT p.profile_id, s.job_id, len(list_intersect(s.skills, p.skills)) / sqrt(3 * len(s.skills)) AS score,
  pow(len(list_intersect(s.skills, p.skills)), 2) / len(s.skills) AS fit
  FROM sets s JOIN postings j USING (job_id), profiles p
  WHERE (p.city IS NULL OR lower(j.city) = p.city)
    AND (p.years IS NULL OR abs(j.experience_years - p.years) <= 0.5)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY fit DESC, job_id) AS rank FROM scored)
SELECT profile_id, rank, job_id, {floor_sql('score', 4)} AS similarity_score FROM numbered WHERE rank <= 3""")
def recommend_table(spark, d):
    from labourlens.sources.adapters import table
    wishes = F.array(*[F.array(*[F.lit(s) for s in w]) for w in _WISH])
    profiles = table(spark, d, "customer").select(
        F.col("c_name").alias("profile_id"),
        F.element_at(wishes, (F.col("c_nationkey") % 4).cast("int") + 1).alias("skills"),
        F.when(F.col("c_custkey") % 2 == 0, "Hanoi").alias("city"),
        F.when(F.col("c_custkey") % 3 == 0, (F.col("c_nationkey") % 8).cast("double")).alias("years"))
    jobs = postings(spark, d).select("job_id", category.city("city_raw").alias("city"),
                                     years("experience_raw").alias("experience_years"))
    return rec.recommend_table(index(spark, d), jobs, profiles, 3)


# Targets: the newest posting of every site, as a reader of that site would open it.
@query("similar_jobs", f"""WITH {POSTINGS_CTE}, {SKILLS_CTE}, sets AS (SELECT job_id, list_distinct(list(skill_name)) AS skills FROM job_skills GROUP BY 1),
scored AS (SELECT t.job_id AS target_id, s.job_id, len(list_intersect(s.skills, t.skills)) / sqrt(len(t.skills) * len(s.skills)) AS score,
  pow(len(list_intersect(s.skills, t.skills)), 2) / len(s.skills) AS fit
  FROM sets s, (SELECT sets.* FROM sets JOIN postings USING (job_id) QUALIFY row_number() OVER (PARTITION BY source_site ORDER BY posted_at DESC, job_id DESC) = 1) t
  WHERE s.job_id <> t.job_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY fit DESC, job_id) AS rank FROM scored WHERE score > 0)
SELECT target_id, rank, job_id, {floor_sql('score', 4)} AS similarity_score FROM numbered WHERE rank <= 10""")
def similar_jobs(spark, d):
    sets = index(spark, d)
    newest = (postings(spark, d).select("job_id", "source_site", "posted_at").join(sets.select("job_id"), "job_id")
              .groupBy("source_site").agg(F.max_by("job_id", F.struct("posted_at", "job_id")).alias("job_id")))
    return rec.similar_jobs(sets, [r["job_id"] for r in newest.collect()])  # one row per site


@query("similar_jobs_table", f"""WITH {SKILLS_CTE}, sets AS (SELECT job_id, list_distinct(list(skill_name)) AS skills FROM job_skills GROUP BY 1),
scored AS (SELECT t.job_id AS target_id, s.job_id, len(list_intersect(s.skills, t.skills)) / sqrt(len(t.skills) * len(s.skills)) AS score,
  pow(len(list_intersect(s.skills, t.skills)), 2) / len(s.skills) AS fit
  FROM sets s JOIN (SELECT * FROM sets WHERE CAST(substr(job_id, 5) AS BIGINT) % 12 = 0) t ON s.job_id <> t.job_id AND list_has_any(s.skills, t.skills)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY fit DESC, job_id) AS rank FROM scored)
SELECT target_id, rank, job_id, {floor_sql('score', 4)} AS similarity_score FROM numbered WHERE rank <= 5""")
def similar_jobs_table(spark, d):
    """Every twelfth posting as a target, given as a table."""
    sets = index(spark, d)
    targets = sets.where(F.substring("job_id", 5, 30).cast("long") % 12 == 0).select(F.col("job_id").alias("target_id"))
    return rec.similar_table(sets, targets, 5)


@query("skill_gap", f"""WITH {SKILLS_CTE}, sets AS (SELECT job_id, list_sort(list_distinct(list(skill_name))) AS skills FROM job_skills GROUP BY 1)
SELECT job_id, list_filter(skills, lambda x: list_contains(['Python', 'SQL', 'AWS'], x)) AS matched_skills,
  list_filter(skills, lambda x: NOT list_contains(['Python', 'SQL', 'AWS'], x)) AS missing_skills FROM sets""")
def skill_gap(spark, d):
    return rec.skill_gap(rec.skill_sets(job_skills(spark, d)), ["Python", "SQL", "AWS"])


@query("index_size", f"WITH {SKILLS_CTE} SELECT count(DISTINCT job_id) AS n_jobs, count(DISTINCT skill_name) AS n_skills FROM job_skills")
def index_size(spark, d):
    return rec.index_size(job_skills(spark, d))
