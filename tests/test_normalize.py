import pytest
from pyspark.sql import functions as F

from labourlens.dictionaries import SKILL_ENTRIES, extend_skills, skill_dictionary
from labourlens.functions import category, keys
from labourlens.functions.experience import experience_bin, mixed_years, nearest_bin, years
from labourlens.functions.salary import normalize_salary, unparsed
from labourlens.functions.text import title_case
from labourlens.functions.title import normalize_title
from labourlens.operators import skills as sk


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn("v")).collect()]


SALARIES = [
    ("10-15 triệu", "range", 10.0, 15.0, 12.5, 0.9),
    ("10 – 15 triệu", "range", 10.0, 15.0, 12.5, 0.9),
    ("10-15tr", "range", 10.0, 15.0, 12.5, 0.9),
    ("20-10 triệu", "range", 10.0, 20.0, 15.0, 0.9),
    ("8 Tr - 12 Tr VND", "range", 8.0, 12.0, 10.0, 0.9),
    ("8 - 12 Tr VND", "range", 8.0, 12.0, 10.0, 0.9),
    ("tới 20 triệu", "up_to", None, 20.0, 14.0, 0.8),
    ("đến 20 triệu", "up_to", None, 20.0, 14.0, 0.8),
    ("từ 15 triệu", "from", 15.0, None, 19.5, 0.8),
    ("Trên 25 Tr VND", "from", 25.0, None, 32.5, 0.8),
    ("80-120 triệu/năm", "yearly", 6.7, 10.0, 8.3, 0.9),
    ("80-120 trieu/nam", "yearly", 6.7, 10.0, 8.3, 0.9),
    ("120 triệu/năm", "yearly", 10.0, None, 10.0, 0.8),
    ("1200-1800 USD", "usd", 30.0, 45.0, 37.5, 0.9),
    ("$1500-2000", "usd", 37.5, 50.0, 43.8, 0.9),
    ("$1,500 - $2,000", "usd", 37.5, 50.0, 43.8, 0.9),
    ("1000 USD", "usd", 25.0, None, 25.0, 0.8),
    ("1200 USD - 1800 USD", "range", 30.0, 45.0, 37.5, 0.9),
    ("up to 2000 USD", "usd", None, 50.0, 35.0, 0.8),
    ("từ 10 đến 15 triệu", "range", 10.0, 15.0, 12.5, 0.9),
    ("1 - 2 tỷ", "range", 1000.0, 2000.0, 1500.0, 0.9),
    ("cạnh tranh", "hidden", None, None, None, 0.95),
    ("THỎA THUẬN", "hidden", None, None, None, 0.95),
    ("negotiable", "hidden", None, None, None, 0.95),
    ("15 triệu", "single", 15.0, 15.0, 15.0, 0.7),
    ("20M", "single", 20.0, 20.0, 20.0, 0.7),
    ("10,5 triệu", "single", 10.5, 10.5, 10.5, 0.7),
    ("15.000.000", "single", 15.0, 15.0, 15.0, 0.7),
    ("15000k", "single", 15.0, 15.0, 15.0, 0.7),
    ("", "unknown", None, None, None, 0.0),
    (None, "unknown", None, None, None, 0.0),
    ("attractive", "unknown", None, None, None, 0.0),
]


def test_salary_forms(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SALARIES)], "i int, salary_raw string")
    got = normalize_salary(df).orderBy("i").collect()
    for row, (text, kind, low, high, mid, sure) in zip(got, SALARIES):
        assert (row.salary_type, row.salary_min, row.salary_max, row.salary_mid, row.salary_confidence) == (kind, low, high, mid, sure), text
        assert row.salary_hidden == (kind == "hidden")
    assert [r.salary_raw for r in unparsed(normalize_salary(df)).collect()] == ["attractive"]


def test_salary_rate_is_a_parameter(spark):
    df = spark.createDataFrame([("1000 USD",)], "salary_raw string")
    assert normalize_salary(df, usd_rate=26_000).first().salary_min == 26.0


@pytest.mark.parametrize("name", ["salary"])
def test_salary_is_parsed_once_and_filter_stays_above(spark, name):
    df = normalize_salary(spark.createDataFrame([("10-15 triệu",)], "salary_raw string")).where("salary_mid > 5")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(array(lower(") == 1


EXPERIENCE = [
    ("2 năm", 2.0), ("3 năm kinh nghiệm", 3.0), ("2-5 năm", 3.5), ("2–5 năm", 3.5), ("từ 3 năm", 3.0), ("tới 5 năm", 2.5),
    ("dưới 2 năm", 1.0), ("duoi 1 nam", 0.5), ("hơn 5 năm", 5.0), ("ít nhất 2 năm", 2.0), ("3+ năm", 3.0), ("5+ years", 5.0),
    ("fresher", 0.0), ("mới ra trường", 0.0), ("moi ra truong", 0.0), ("chưa có kinh nghiệm", 0.0), ("1 year", 1.0), ("5 yr", 5.0),
    ("10 năm", 10.0), ("20 năm", 20.0), ("0 năm", 0.0), ("không rõ", None), ("", None), (None, None),
]


def test_experience(spark):
    assert column(spark, [t for t, _ in EXPERIENCE], years) == [y for _, y in EXPERIENCE]


def test_experience_bins(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 0.9, 1.0, 2.9, 3.0, 5.0, 7.9, 8.0, 30.0, -1.0, None])], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(experience_bin("v")).collect()]
    assert got == ["entry", "entry", "junior", "junior", "mid", "senior", "senior", "lead", "lead", "lead", "unknown"]
    assert [nearest_bin(x) for x in (0, 2, 3.5, 5, 20)] == ["entry", "junior", "mid", "mid", "lead"]
    assert column(spark, ["2.5", "3-5 năm"], mixed_years) == [2.5, 4.0]


TITLES = [
    ("frontend dev", "Frontend Developer"), ("sr data engineer", "Senior Data Engineer"), ("fe developer", "Frontend Developer"),
    ("Back-end Developer", "Backend Developer"), ("ML Engineer", "Machine Learning Engineer"), ("QA Tester", "QA Tester"),
    ("UI/UX Designer", "UI/UX Designer"), ("DevOps Lead", "DevOps Lead"), ("Full Stack Developer", "Fullstack Developer"),
    ("AI Engineer", "AI Engineer"), ("Sr. Software Architect", "Senior Software Architect"), ("Jr Front-end Dev", "Junior Frontend Developer"),
    ("SRE Engineer", "SRE Engineer"), ("Head of Data", "Head of Data"), ("kỹ sư phần mềm", "Kỹ Sư Phần Mềm"), ("", ""), (None, None),
]


def test_titles(spark):
    assert column(spark, [t for t, _ in TITLES], normalize_title) == [t for _, t in TITLES]


def test_categories(spark):
    assert column(spark, ["hcm", " Hà Nội ", "vũng tàu", "rịa-vũng", "", None], category.city) == [
        "HCMC", "Hanoi", "Vũng Tàu", "Rịa-Vũng", None, None]
    assert column(spark, ["work from home", "Hybrid", None, "office"], category.remote_option) == ["Remote", "Hybrid", "On-site", "On-site"]
    assert column(spark, ["Part-time", "hợp đồng", "Thực tập", ""], category.job_type) == ["Part-time", "Contract", "Internship", "Full-time"]
    assert column(spark, ["Senior dev", "Vice President", "team lead", "x"], category.job_level) == [
        "Senior", "Director", "Team Lead", "Not specified"]
    assert column(spark, ["Thạc sĩ", "đại học", "x"], category.education_level) == ["Master", "Bachelor", "Not Required"]
    assert column(spark, ["1000+", "weird size", None], category.company_size) == ["Enterprise (>1000)", "Weird Size", "Unknown"]
    assert column(spark, ["bắt buộc", "a plus", None], category.required_level) == ["Required", "Nice to have", "Not specified"]
    assert column(spark, ["TP. hồ-chí"], title_case) == ["Tp. Hồ-Chí"]


SKILLS = [
    ("JS", "JavaScript", "Programming Language", True, 1.0), ("ReactJS", "React", "Frontend Framework", True, 1.0),
    ("Python3", "Python", "Programming Language", True, 1.0), ("golang", "Go", "Programming Language", True, 1.0),
    ("Go", "Go", "Programming Language", True, 0.95), ("k8s", "Kubernetes", "DevOps", True, 1.0), ("ML", "Machine Learning", "Data Science", True, 1.0),
    ("tiếng anh", "English", "Language", True, 1.0), ("PYTHON", "Python", "Programming Language", True, 1.0), ("Java", "Java", "Programming Language", True, 1.0),
    ("strong docker skills", "Docker", "DevOps", True, 0.8), ("web services", "AWS", "Cloud", True, 0.8), ("expert in TS", "TypeScript", "Programming Language", True, 0.7),
    ("CompletelyUnknownSkill123", "CompletelyUnknownSkill123", "Other", False, 0.3), ("ui framework", "ui framework", "Frontend Framework", False, 0.3),
    ("", "", "Other", False, 0.0), (None, "", "Other", False, 0.0),
]


def test_skill_names(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SKILLS)], "i int, skill_raw string")
    got = sk.normalize_skills(df).orderBy("i").collect()
    assert [(r.skill_raw, r.canonical, r.skill_group, r.matched, r.confidence) for r in got] == SKILLS
    # The in-row form finds the same names.
    named = df.where("trim(skill_raw) <> ''").orderBy("i").select(sk.canonical_name(F.col("skill_raw"))).collect()
    assert [r[0] for r in named] == [s[1] for s in SKILLS if s[0]]


def test_custom_skills(spark):
    extra = spark.createDataFrame([("newskill", "NewSkill", "Tool"), ("js", "Jigsaw", "Other")], "alias string, canonical string, skill_group string")
    df = spark.createDataFrame([("newskill",), ("js",)], "skill_raw string")
    got = {r.skill_raw: r.canonical for r in sk.normalize_skills(df, entries=skill_dictionary(extra)).collect()}
    assert got == {"newskill": "NewSkill", "js": "Jigsaw"}
    with pytest.raises(ValueError):
        skill_dictionary(extra, limit=1)
    assert len({e.canonical for e in SKILL_ENTRIES}) >= 20 and len(extend_skills([])) == len(SKILL_ENTRIES)


def test_skills_in_text(spark):
    text = "We use Python, Node.js, C++ and machine  learning; k8s too. Not pythonic or javascripty. CI/CD a must."
    df = spark.createDataFrame([(text,), (None,), ("nothing",)], "t string")
    rows = [[s.skill_name for s in r[0]] for r in df.select(sk.skills_in_text(F.col("t"))).collect()]
    assert rows == [["Python", "C++", "Node.js", "Kubernetes", "CI/CD", "Machine Learning"], [], []]


def test_keys(spark):
    assert column(spark, ["/a/b", "http://x/y", "c", "//cdn/z"], lambda c: keys.resolve_url("https://s.vn", c)) == [
        "https://s.vn/a/b", "http://x/y", "https://s.vn/c", "https://cdn/z"]
    assert column(spark, ["2026-08-04T10:00:00", "bad", None], lambda c: keys.iso_text(keys.iso_timestamp(c))) == [
        "2026-08-04T10:00:00", None, None]
    assert column(spark, ["a b&c"], keys.query_value) == ["a+b%26c"]


def test_a_dictionary_table_resolves_like_a_list(spark):
    extra = spark.createDataFrame([("Zorblax", "Zorb", "Tool"), ("big data lake", "Lakes", "Data"), ("python", "Python", "Snake"), (None, "Nothing", "X"), (" ", "Blank", "X")],
                                  "alias string, canonical string, skill_group string")
    names = ["zorblax", "Senior zorblax user", "data lake", "lake", "Python", "python3", "react native", "js", "sql server dev", "no such thing", "c++", "java", "node.js"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    listed = sk.resolve_names(df, skill_dictionary(extra.where("trim(alias) <> ''"))).collect()
    tabled = sk.resolve_names(df, sk.dictionary_table(extra)).collect()
    assert {tuple(r) for r in listed} == {tuple(r) for r in tabled}
    plain = sk.dictionary_table(extra.limit(0))
    assert {tuple(r) for r in sk.resolve_names(df, plain).collect()} == {tuple(r) for r in sk.resolve_names(df).collect()}
