from datetime import datetime

import pytest
from pyspark.sql import functions as F

from labourlens.dictionaries import skill_dictionary
from labourlens.functions.text import lookup
from labourlens.operators import merge as mg
from labourlens.operators import quality as ql
from labourlens.operators import records as rc
from labourlens.operators import skills as sk
from labourlens.schemas import RAW_POSTING


def raw(spark, **changes):
    row = dict(
        job_id="glints_q77", job_title="sr platform engineer", company_name="Mekong Grid", city="hcm", source_site="glints",
        source_url="https://glints.com/j/q77", salary_raw="22-36 triệu", experience_years="4-6 năm", remote_option="remote work",
        job_type="full time", description_raw="Golang and Redis. 2+ years.", skills_raw=["golang", "ReactJS", "React", "soldering"],
        posted_at="2025-03-09T08:30:00")
    row.update(changes)
    return spark.createDataFrame([tuple(row.get(f) for f in RAW_POSTING.fieldNames())], RAW_POSTING)


def test_record_fields(spark):
    r = rc.normalize_records(raw(spark)).first()
    assert (r.job_title, r.city, r.salary_min, r.salary_max, r.experience_years, r.remote_option) == (
        "Senior Platform Engineer", "HCMC", 22.0, 36.0, 5.0, "Remote")
    assert [s.skill_name for s in r.skills] == ["Go", "React", "soldering"] and len(r.company_id) == 5 + 32
    assert r.posted_at == datetime(2025, 3, 9, 8, 30) and not r.has_english


def test_record_defaults_and_fallbacks(spark):
    r = rc.normalize_records(raw(spark, job_title=" ", company_name="", city=None, skills_raw=[" "], experience_years=None,
                                 posted_at="x", description_raw="Kafka, English. 2 years")).first()
    assert (r.job_title, r.company_name, r.city, r.experience_years, r.posted_at) == ("Unknown Title", "Unknown", None, 2.0, None)
    assert [s.skill_name for s in r.skills] == ["Kafka", "English"] and r.has_english


def test_batch_keeps_first_and_blank_ids(spark):
    rows = [raw(spark, job_id=i, job_title=t) for i, t in (("a", "qa"), ("a", "dev"), ("", "x"), ("", "y"))]
    batch = rows[0]
    for r in rows[1:]:
        batch = batch.unionByName(r)
    batch = batch.coalesce(1).withColumn("ord", F.monotonically_increasing_id())
    got = rc.normalize_batch(batch, "ord").orderBy("ord").collect()
    assert [(r.job_id, r.job_title) for r in got] == [("a", "QA"), ("", "X"), ("", "Y")]


def test_tables_of_a_record(spark):
    rec = rc.normalize_records(raw(spark))
    assert rc.job_rows(rec).first().skills == ["Go", "React", "soldering"]
    assert {(r.job_id, r.skill_name, r.ord) for r in rc.skill_rows(rec).collect()} == {
        ("glints_q77", "Go", 0), ("glints_q77", "React", 1), ("glints_q77", "soldering", 2)}


def test_company_row_of_the_last_arrival(spark):
    rows = [raw(spark, job_id=i, city=c) for i, c in (("job_10", "huế"), ("job_9", "hanoi"), ("job_100", "đà nẵng"))]
    batch = rows[0].unionByName(rows[1]).unionByName(rows[2]).coalesce(1).withColumn("ord", F.monotonically_increasing_id())
    got = rc.company_rows(rc.normalize_batch(batch, "ord"), "ord").collect()
    assert [(r.company_name, r.city) for r in got] == [("Mekong Grid", rc.normalize_records(rows[2]).first().city)]


def test_rows_without_a_posting_are_in_no_list(spark):
    skills = spark.createDataFrame([("j1", 0, "Go", "g", "l", "o"), (None, 1, "SQL", "g", "l", "o")],
                                   "job_id string, ord int, skill_name string, skill_group string, required_level string, original_name string")
    assert [(r.job_id, r.skills) for r in mg.skill_lists(skills).collect()] == [("j1", ["Go"])]


def test_merge_suffix_and_lists(spark):
    jobs = spark.createDataFrame([("j1", "c1", "HCMC"), ("j2", "c9", "Hue")], "job_id string, company_id string, city string")
    firms = spark.createDataFrame([("c1", "FPT", "Hanoi")], "company_id string, company_name string, city string")
    skills = spark.createDataFrame([("j1", 1, "SQL", "Database", "Required", "sql"), ("j1", 0, "Go", "PL", "Not specified", "golang")],
                                   "job_id string, ord int, skill_name string, skill_group string, required_level string, original_name string")
    got = {r.job_id: r for r in mg.merge_datasets(jobs, skills, firms).collect()}
    assert got["j1"].city == "HCMC" and got["j1"].city_company == "Hanoi" and got["j1"].skills == ["Go", "SQL"]
    assert got["j1"].skill_originals == ["golang", "sql"] and got["j2"].company_name is None and got["j2"].skills is None
    again = mg.merge_datasets(mg.merge_datasets(jobs, skills, firms).drop("company_name", "city_company"), skills, firms)
    assert again.columns.count("skills") == 1


@pytest.mark.parametrize("policy,bad", [("skip", None), ("empty", []), ("split", ["a", "b"])])
def test_list_policies(spark, policy, bad):
    df = spark.createDataFrame([("['x', ' y ', '']",), ("a, b",), ("[]",)], "s string")
    assert [r[0] for r in df.select(mg.list_decode("s", policy)).collect()] == [["x", "y"], bad, []]


def test_first_known_and_gate(spark):
    df = spark.createDataFrame([("c", 1, None, 5), ("c", 2, "x", None), ("c", 3, "y", 7)], "k string, o int, a string, b int")
    assert tuple(mg.first_known(df, "k", "o", ["a", "b"]).first()) == ("c", "x", 5)
    assert ql.require_rows(df, 3).count() == 3
    with pytest.raises(RuntimeError, match="below threshold"):
        ql.require_rows(df, 4)


def test_damage_is_repeatable(spark):
    df = spark.range(400).select(F.concat(F.lit("j"), "id").alias("job_id"), F.lit(1.0).alias("salary_min"), F.lit(2.0).alias("salary_max"),
                                 F.lit(3.0).alias("experience_years"), F.lit("B").alias("education_level"), F.lit("R").alias("remote_option"))
    a, audit = ql.damage(df)
    b, _ = ql.damage(df.repartition(13))
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    kinds = {r.issue: r["count"] for r in audit.groupBy("issue").count().collect()}
    assert 30 < kinds["INJECTED_MISSING"] < 90 and 2 < kinds["INJECTED_NEAR_DUP"] < 30
    assert a.count() == 400 + kinds["INJECTED_NEAR_DUP"]


SKILLS = [["golang", "ReactJS", "React", "soldering"], [" "], None, ["tiếng anh", "k8s", "", "nothing at all"], ["spelling 7", "tool 99999 pro"], []]


def test_a_dictionary_of_100000_spellings_joins(spark):
    """The table form gives what the list form gives, and works for any size."""
    rows = None
    for i, tags in enumerate(SKILLS):
        one = raw(spark, job_id=f"j{i}", skills_raw=tags, description_raw="Python, node.js and English; spelling 41 too" if i % 2 else "nothing")
        rows = one if rows is None else rows.unionByName(one)
    extra = spark.range(100_000).select(F.concat(F.lit("spelling "), "id").alias("alias"), F.concat(F.lit("Tool "), "id").alias("canonical"), F.lit("Made").alias("skill_group"))
    few = extra.where("id IN (7, 41, 99999)")

    def skills(entries):
        return {r.job_id: ([tuple(s) for s in r.skills], r.has_english) for r in rc.normalize_records(rows, entries).collect()}

    listed = skills(skill_dictionary(few))
    assert skills(sk.dictionary_table(few)) == listed
    many = skills(sk.dictionary_table(extra))
    assert many["j4"][0][0] == ("Tool 7", "spelling 7", "Made") and many["j1"] == listed["j1"] and ("Tool 41", "spelling 41", "Made") in many["j1"][0]
    assert [len(many[f"j{i}"][0]) for i in (0, 2, 5)] == [3, 0, len(listed["j5"][0])]


def test_hashed_literals_find_every_key(spark):
    items = {f"key {i} é": str(i) for i in range(500)}
    keys = spark.createDataFrame([(k,) for k in [*items, "none", ""]] + [(None,)], "k string")
    got = {r.k: r.v for r in keys.select("k", lookup(items, F.col("k")).alias("v")).collect()}
    assert got == {**items, "none": None, "": None, None: None}
