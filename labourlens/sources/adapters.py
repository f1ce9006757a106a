"""Posting-shaped views over the star-schema tables.

Every text column is rendered from integers of the row key, so that what a
parser should find is known without parsing.  ``*_cte`` give the same integers
and true values as SQL text for an engine that never sees the rendered text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labourlens.functions.text import literal_array, sql_text
from labourlens.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Choice:
    """One value out of a short list, picked by ``(key div step) % len``."""

    step: int
    pairs: tuple[tuple[str | None, str | None], ...]  # (written, meant)

    def _pick(self, key: str, side: int) -> Column:
        values = ", ".join("cast(null as string)" if p[side] is None else sql_text(p[side]) for p in self.pairs)
        return F.expr(f"element_at(array({values}), cast(({key} div {self.step}) % {len(self.pairs)} as int) + 1)")

    def written(self, key: str) -> Column:
        return self._pick(key, 0)

    def sql(self, key: str, side: int = 1) -> str:
        quoted = ", ".join("NULL" if p[side] is None else "'" + p[side].replace("'", "''") + "'" for p in self.pairs)
        return f"([{quoted}])[CAST(({key} // {self.step}) % {len(self.pairs)} AS INTEGER) + 1]"


SENIORITY = Choice(7, (("", ""), ("Sr", "Senior "), ("sr.", "Senior "), ("jr", "Junior "), ("LEAD", "Lead ")))
ROLE = Choice(3, (
    ("backend dev", "Backend Developer"), ("Back-end Developer", "Backend Developer"),
    ("be developer", "Backend Developer"), ("frontend dev", "Frontend Developer"),
    ("Front End Devloper", "Frontend Developer"), ("full stack dev", "Fullstack Developer"),
    ("data eng", "Data Engineer"), ("Big Data Engr", "Data Engineer"), ("DATA  ENGINEER", "Data Engineer"),
    ("ml engineer", "Machine Learning Engineer"), ("machinelearning eng", "Machine Learning Engineer"),
    ("Quality Assurance test", "QA Tester"), ("qa tester", "QA Tester"), ("Dev Ops engr", "DevOps Engineer"),
    ("ui/ux designer", "UI/UX Designer"), ("UI UX designer", "UI/UX Designer"),
    ("head of it", "Head of IT"),
))
CITY = Choice(2, (
    ("hcm", "HCMC"), ("Hồ Chí Minh", "HCMC"), (" Ho Chi Minh City ", "HCMC"), ("HÀ NỘI", "Hanoi"), ("hanoi", "Hanoi"),
    ("đà nẵng", "Da Nang"), ("Cần Thơ", "Can Tho"), ("online", "Remote"), ("bà rịa-vũng tàu", "Bà Rịa-Vũng Tàu"),
    ("hải phòng", "Hải Phòng"), (None, None),
))
REMOTE = Choice(5, (
    ("tại văn phòng", "On-site"), ("Work From Home", "Remote"), ("hybrid, 3 days", "Hybrid"), ("WFH", "Remote"),
    ("Hỗn hợp", "Hybrid"), (None, "On-site"), ("on-site", "On-site"),
))
JOB_TYPE = Choice(11, (
    ("Full time", "Full-time"), ("Part time", "Part-time"), ("Bán thời gian", "Part-time"), ("Hợp đồng", "Contract"),
    ("THỰC TẬP", "Internship"), ("toàn thời gian", "Full-time"),
))
CONTRACT = Choice(13, (
    ("Chính thức", "CDH (Indefinite)"), ("Seasonal", "Temporary"), ("freelance", "Freelance"),
    ("thuc tap", "Internship"), ("parttime", "Part-time"), ("khác", "Not specified"),
))
LEVEL = Choice(17, (
    ("Giám đốc", "Director"), ("Trưởng phòng", "Manager"), ("Team Leader", "Team Lead"), ("Chuyên viên", "Senior"),
    ("Fresher", "Junior"), ("Nhân viên", "Employee"), (None, "Not specified"),
))
EDUCATION = Choice(4, (
    ("Đại học", "Bachelor"), ("Thạc sĩ", "Master"), ("Bachelor's degree", "Bachelor"), ("PhD", "PhD"),
    ("Cao đẳng", "College"), ("trung cấp", "High School"), ("không yêu cầu", "Not Required"),
))
REQUIRED = Choice(1, (("Bắt buộc", "Required"), ("Nice to have", "Nice to have"), ("ưu tiên", "Nice to have"),
                      (None, "Not specified"), ("MUST", "Required")))
SIZE = Choice(1, (
    ("Startup", "Startup (<10)"), ("11-50 người", "Small (10-50)"), ("51-200", "Medium (51-200)"),
    ("500-1000 nhân viên", "Large (201-1000)"), ("Trên 1000", "Enterprise (>1000)"), ("rất lớn", "Rất Lớn"),
    (None, "Unknown"),
))
# One site holds half of the postings, as one source usually does.
SITE = Choice(1, tuple((s, s) for s in (
    "itviec", "glints", "itviec", "vietnamworks", "itviec", "vieclam24h", "itviec", "topcv", "itviec", "careerviet")))

# (canonical, group, ((spelling, confidence), ...)) for brand number 1..25;
# an unknown skill is its own canonical name.
SKILL_OF_BRAND = (
    ("Python", "Programming Language", (("py", 1.0), ("Python3", 1.0), (" PYTHON ", 1.0))),
    ("JavaScript", "Programming Language", (("JS", 1.0), ("java script", 1.0), ("ECMAScript", 1.0))),
    ("SQL", "Programming Language", (("sql", 1.0), ("SQL", 1.0))),
    ("Java", "Programming Language", (("java", 1.0), ("Java developer", 0.8))),
    ("React", "Frontend Framework", (("ReactJS", 1.0), ("react.js", 1.0))),
    ("Go", "Programming Language", (("golang", 1.0), ("Go", 0.95))),
    ("Kubernetes", "DevOps", (("k8s", 1.0), ("Kubernetes", 1.0))),
    ("AWS", "Cloud", (("aws", 1.0), ("Amazon Web Services", 1.0))),
    ("Docker", "DevOps", (("docker", 1.0), ("strong docker skills", 0.8))),
    ("PostgreSQL", "Database", (("postgres", 1.0), ("psql", 1.0))),
    ("Machine Learning", "Data Science", (("ML", 1.0), ("Machine Learning", 1.0), ("machine learning basics", 0.8))),
    ("Node.js", "Backend Framework", (("nodejs", 1.0), ("Node.JS", 1.0))),
    ("Google Cloud", "Cloud", (("GCP", 1.0), ("google cloud", 0.95))),
    ("Apache Spark", "Data Science", (("spark", 1.0), ("Apache Spark", 0.95))),
    ("English", "Language", (("tiếng Anh", 1.0), ("English", 1.0))),
    ("TypeScript", "Programming Language", (("ts", 1.0), ("expert in TS", 0.7))),
    ("Django", "Backend Framework", (("django", 1.0), ("Django REST", 0.8))),
    ("Ruby", "Programming Language", (("Ruby", 0.95), ("ruby on rails", 1.0))),
    ("Deep Learning", "Data Science", (("dl", 1.0), ("Deep learning", 1.0))),
    ("Communication", "Soft Skill", (("giao tiếp", 1.0), ("Communication", 1.0))),
    ("Zorblax", "Other", (("Zorblax", 0.3),)),
    ("Obscure framework", "Backend Framework", (("Obscure framework", 0.3),)),
    ("graph db tool", "Database", (("graph db tool", 0.3),)),
    ("Cloud security", "Cloud", (("Cloud security", 0.3),)),
    ("Quuxify", "Other", (("Quuxify", 0.3),)),
)
SKILL_NAMES = sorted(s[0] for s in SKILL_OF_BRAND)

N_SALARY_FORMS = 15
N_EXPERIENCE_FORMS = 9


def _k(div: int, mod: int, key: str = "k") -> Column:
    return F.expr(f"({key} div {div}) % {mod}")


def _one_of(index: Column, options: list[Column]) -> Column:
    """Only the chosen option is rendered."""
    out = F.when(index == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        out = out.when(index == i, option)
    return out


def postings(spark: SparkSession, sf_dir: str, company: bool = False) -> DataFrame:
    """One posting per order.  ``company=True`` joins the company's name and industry."""
    orders = table(spark, sf_dir, "orders")
    base = spread(orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("custkey"),
                                F.col("o_orderdate").alias("posted_at")))
    base = base.withColumns({
        "lo": F.expr("8 + (k * 7) % 33"),
        "yrs": F.expr("(k * 13) % 12"),
    }).withColumn("hi", F.expr("lo + 2 + (k * 11) % 18"))
    s = {n: F.col(c).cast("string") for n, c in (("lo", "lo"), ("hi", "hi"), ("y", "yrs"))}
    salary = [
        F.concat(s["lo"], F.lit("-"), s["hi"], F.lit(" triệu")),
        F.concat(s["lo"], F.lit(" – "), s["hi"], F.lit(" tr")),
        F.concat(s["hi"], F.lit("-"), s["lo"], F.lit(" Triệu")),
        F.concat(F.lit("Tới "), s["hi"], F.lit(" triệu/tháng")),
        F.concat(F.lit("từ "), s["lo"], F.lit(" triệu")),
        F.lit("THỎA THUẬN"),
        F.concat((F.col("lo") * 12).cast("string"), F.lit("-"), (F.col("hi") * 12).cast("string"), F.lit(" triệu/năm")),
        F.concat((F.col("lo") * 40).cast("string"), F.lit("-"), (F.col("hi") * 40).cast("string"), F.lit(" USD")),
        F.concat(F.lit("$"), (F.col("lo") * 40).cast("string"), F.lit(" - $"), (F.col("hi") * 40).cast("string")),
        F.concat(s["lo"], F.lit("tr")),
        F.concat(s["lo"], F.lit(" Tr - "), s["hi"], F.lit(" Tr VND")),
        F.concat(F.lit("Trên "), s["lo"], F.lit(" Tr VND")),
        F.concat(F.lit("từ "), s["lo"], F.lit(" đến "), s["hi"], F.lit(" triệu")),
        F.lit("Lương hấp dẫn"),
        F.lit(None).cast("string"),
    ]
    experience = [
        F.concat(s["y"], F.lit(" năm")),
        F.concat(s["y"], F.lit("-"), (F.col("yrs") + 2).cast("string"), F.lit(" năm")),
        F.concat(F.lit("Từ "), s["y"], F.lit(" năm")),
        F.concat(F.lit("dưới "), s["y"], F.lit(" năm")),
        F.concat(s["y"], F.lit("+ years")),
        F.concat(F.lit("Trên "), s["y"], F.lit(" nam kinh nghiem")),
        F.lit("Fresher"),
        F.lit("không rõ"),
        F.lit(None).cast("string"),
    ]
    out = base.select(
        "k",
        F.concat(F.lit("job_"), F.col("k").cast("string")).alias("job_id"),
        F.col("k").alias("ord"),
        "custkey",
        F.trim(F.concat(SENIORITY.written("k"), F.lit(" "), ROLE.written("k"))).alias("job_title_raw"),
        CITY.written("k").alias("city_raw"),
        REMOTE.written("k").alias("remote_raw"),
        JOB_TYPE.written("k").alias("job_type_raw"),
        CONTRACT.written("k").alias("contract_raw"),
        LEVEL.written("k").alias("level_raw"),
        EDUCATION.written("k").alias("education_raw"),
        SITE.written("k").alias("source_site"),
        _one_of(_k(1, N_SALARY_FORMS), salary).alias("salary_raw"),
        _one_of(_k(N_SALARY_FORMS, N_EXPERIENCE_FORMS), experience).alias("experience_raw"),
        "posted_at",
    )
    if company:
        firms = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("custkey"), F.col("c_name").alias("company_name"),
            F.col("c_mktsegment").alias("industry"))
        out = out.join(firms, "custkey")
    return out


def posting_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(job_id, ord, skill_raw)``: one row per order line, spelling varied by line number."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int").alias("b"))
    spellings = F.array(*[literal_array([v for v, _ in vs]) for _, _, vs in SKILL_OF_BRAND])
    choices = F.element_at(spellings, F.col("b"))
    return (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        .join(part, "l_partkey")
        .select(
            F.concat(F.lit("job_"), F.col("l_orderkey").cast("string")).alias("job_id"),
            F.col("l_linenumber").alias("ord"),
            F.element_at(choices, F.col("l_linenumber") % F.size(choices) + 1).alias("skill_raw"),
            REQUIRED.written("l_linenumber").alias("level_raw"),
        )
    )


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(job_id, skill_name)`` with the canonical name of every posting skill."""
    from labourlens.operators.skills import normalize_skills
    return normalize_skills(posting_skills(spark, sf_dir)).select("job_id", F.col("canonical").alias("skill_name"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer, with gaps in size and city."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"),
        F.col("c_name").alias("company_name"),
        SIZE.written("c_custkey").alias("company_size_raw"),
        F.col("c_mktsegment").alias("industry"),
        CITY.written("c_custkey").alias("city_raw"),
    )


# --- the same views as SQL ------------------------------------------------------

_BASE = """base AS (
  SELECT o_orderkey AS k, o_custkey AS custkey, o_orderdate AS posted_at,
         8 + (o_orderkey * 7) % 33 AS lo, 8 + (o_orderkey * 7) % 33 + 2 + (o_orderkey * 11) % 18 AS hi,
         (o_orderkey * 13) % 12 AS yrs, o_orderkey % 15 AS sf, (o_orderkey // 15) % 9 AS ef
  FROM orders)"""

POSTINGS_CTE = f"""{_BASE},
postings AS (
  SELECT k, k AS ord, 'job_' || k AS job_id, custkey, posted_at,
    trim({SENIORITY.sql('k')} || {ROLE.sql('k')}) AS job_title,
    trim({SENIORITY.sql('k', 0)} || ' ' || {ROLE.sql('k', 0)}) AS job_title_raw,
    {CITY.sql('k')} AS city, {REMOTE.sql('k')} AS remote_option, {JOB_TYPE.sql('k')} AS job_type,
    {CONTRACT.sql('k')} AS contract_type, {LEVEL.sql('k')} AS job_level, {EDUCATION.sql('k')} AS education_level,
    {SITE.sql('k')} AS source_site,
    CASE WHEN sf IN (3, 5, 13, 14) THEN NULL ELSE CAST(lo AS DOUBLE) END AS salary_min,
    CASE WHEN sf = 9 THEN CAST(lo AS DOUBLE) WHEN sf IN (4, 5, 11, 13, 14) THEN NULL ELSE CAST(hi AS DOUBLE) END AS salary_max,
    CASE WHEN sf IN (5, 13, 14) THEN NULL WHEN sf = 3 THEN hi * 7 / 10.0 WHEN sf IN (4, 11) THEN lo * 13 / 10.0
         WHEN sf = 9 THEN CAST(lo AS DOUBLE) ELSE (lo + hi) / 2.0 END AS salary_mid,
    sf = 5 AS salary_hidden,
    CASE WHEN sf IN (0, 1, 2, 10, 12) THEN 'range' WHEN sf = 3 THEN 'up_to' WHEN sf IN (4, 11) THEN 'from'
         WHEN sf = 5 THEN 'hidden' WHEN sf = 6 THEN 'yearly' WHEN sf IN (7, 8) THEN 'usd' WHEN sf = 9 THEN 'single'
         ELSE 'unknown' END AS salary_type,
    CASE WHEN ef IN (7, 8) THEN NULL WHEN ef = 6 THEN 0.0 WHEN ef = 1 THEN yrs + 1.0 WHEN ef = 3 THEN yrs / 2.0
         ELSE CAST(yrs AS DOUBLE) END AS experience_years, sf, ef
  FROM base)"""

BIN_SQL = """CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} < 1 THEN 'entry' WHEN {0} < 3 THEN 'junior'
  WHEN {0} < 5 THEN 'mid' WHEN {0} < 8 THEN 'senior' ELSE 'lead' END"""


def _skill_rows() -> str:
    rows = []
    for b, (canonical, group, spellings) in enumerate(SKILL_OF_BRAND, 1):
        for i, (_, confidence) in enumerate(spellings):
            rows.append(f"({b}, {len(spellings)}, {i}, '{canonical}', '{group}', {confidence})")
    return ", ".join(rows)


SKILLS_CTE = f"""skill_true(b, n, i, canonical, skill_group, confidence) AS (VALUES {_skill_rows()}),
posting_skills AS (
  SELECT 'job_' || l_orderkey AS job_id, l_linenumber AS ord, s.canonical, s.skill_group,
         CAST(s.confidence AS DOUBLE) AS confidence, s.confidence > 0.5 AS matched,
         {REQUIRED.sql('l_linenumber')} AS required_level
  FROM lineitem JOIN part ON p_partkey = l_partkey
  JOIN skill_true s ON s.b = CAST(split_part(p_brand, '#', 2) AS INTEGER) AND l_linenumber % s.n = s.i),
job_skills AS (SELECT job_id, canonical AS skill_name FROM posting_skills)"""

COMPANIES_CTE = f"""companies AS (
  SELECT c_custkey AS custkey, c_name AS company_name, {SIZE.sql('c_custkey')} AS company_size,
         c_mktsegment AS industry, {CITY.sql('c_custkey')} AS city
  FROM customer)"""


def floor_sql(expr: str, digits: int = 1) -> str:
    scale = 10 ** digits
    return f"floor(CAST({expr} AS DOUBLE) * {scale}.0 + 0.5) / {scale}.0"
