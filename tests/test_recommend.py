import random

import pytest
from pyspark.sql import functions as F

from labourlens.operators import recommend as rec


@pytest.fixture(scope="module")
def skills(spark):
    return spark.createDataFrame([("k1", s) for s in ("Rust", "Kafka", "Linux")] + [("k2", s) for s in ("Figma", "CSS")]
                                 + [("k3", s) for s in ("Rust", "Kafka", "Ansible", "Redis")], "job_id string, skill_name string")


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame([("k1", "Systems Engineer", "Mekong Grid", "Hue", 31.0, 4.0), ("k2", "Designer", "Paper Boat", "Can Tho", 14.0, 1.0),
                                  ("k3", "Platform Engineer", "Paper Boat", "Hue", 28.0, 6.0)],
                                 "job_id string, job_title string, company_name string, city string, salary_mid double, experience_years double")


def run(skills, jobs, wish, top=10, **kw):
    return rec.recommend(rec.build_index(skills), jobs, [rec.Profile("p", tuple(wish), **kw)], top).orderBy("rank").collect()


def test_best_first_with_matched_and_missing(skills, jobs):
    got = run(skills, jobs, ["Rust", "Kafka", "Linux", "Fortran"])
    assert [r.job_id for r in got] == ["k1", "k3", "k2"]
    assert got[0].similarity_score == 1.0 and got[0].matched_skills == ["Kafka", "Linux", "Rust"]
    assert got[1].missing_skills == ["Ansible", "Redis"] and got[2].similarity_score == 0.0


def test_empty_wish_keeps_all_at_zero(skills, jobs):
    got = run(skills, jobs, [], 3)
    assert [(r.job_id, r.similarity_score) for r in got] == [("k1", 0.0), ("k2", 0.0), ("k3", 0.0)]


def test_filters(skills, jobs):
    assert {r.job_id for r in run(skills, jobs, ["Rust"], city="hue ")} == {"k1", "k3"}
    assert {r.job_id for r in run(skills, jobs, ["Rust"], years=4.0)} == {"k1"}
    assert run(skills, jobs, ["Rust"], city="Da Lat") == []
    assert len(run(skills, jobs, ["Rust"], city=" ")) == 3


def test_similar(spark, skills):
    got = rec.similar_jobs(rec.build_index(skills), ["k1"], 2).collect()
    assert [(r.job_id, r.similarity_score) for r in got] == [("k3", 0.5774)]
    with pytest.raises(ValueError):
        rec.similar_jobs(rec.build_index(skills), ["nowhere"])
    targets = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("nowhere",)], "target_id string")
    table = {(r.target_id, r.rank, r.job_id, r.similarity_score) for r in rec.similar_table(rec.build_index(skills), targets, 2).collect()}
    assert table == {(r.target_id, r.rank, r.job_id, r.similarity_score) for r in rec.similar_jobs(rec.build_index(skills), ["k1", "k2", "k3"], 2).collect()}


def test_similar_among_equals(spark):
    same = spark.createDataFrame([(f"e{i:02d}", s) for i in range(30) for s in ("Rust", "Linux")], "job_id string, skill_name string")
    targets = spark.createDataFrame([("e00",), ("e29",)], "target_id string")
    got = {(r.target_id, r.rank): r.job_id for r in rec.similar_table(rec.build_index(same), targets, 3).collect()}
    assert got == {("e00", 1): "e01", ("e00", 2): "e02", ("e00", 3): "e03", ("e29", 1): "e00", ("e29", 2): "e01", ("e29", 3): "e02"}


@pytest.mark.parametrize("top", [1, 2, 10])
def test_table_of_profiles_agrees_with_the_list(spark, skills, jobs, top):
    profiles = spark.createDataFrame([("a", ["Rust", "Kafka"], "Hue", None), ("b", ["Figma", "Nothing"], None, None), ("c", ["Rust"], None, 6.0),
                                      ("d", ["Kafka", "Rust"], "hue", None), ("blank", [], None, None), ("unknown", ["Nothing"], " ", None),
                                      ("blank in place", [], "Can Tho", 1.0), ("nowhere", ["Rust"], "Da Lat", None)],
                                     "profile_id string, skills array<string>, city string, years double")
    got = {(r.profile_id, r.rank, r.job_id, r.similarity_score) for r in rec.recommend_table(rec.build_index(skills), jobs, profiles, top).collect()}
    listed = [rec.Profile(r.profile_id, tuple(r.skills), r.city, r.years) for r in profiles.collect()]
    want = {(r.profile_id, r.rank, r.job_id, r.similarity_score) for r in rec.recommend(rec.build_index(skills), jobs, listed, top).collect()}
    assert got == want and {p for p, *_ in got} == {"a", "b", "c", "d", "blank", "unknown", "blank in place"}


def test_many_wishes_agree_with_the_list_and_skip_most_classes(spark):
    """Random skill sets, one skill on a third of all postings: equal to the plain ranking, with few classes looked at."""
    rnd = random.Random(3)
    names = ["common"] + [f"s{i}" for i in range(40)]
    sets = {f"j{i:04d}": {"common"} | set(rnd.sample(names, 4)) if rnd.random() < 0.34 else set(rnd.sample(names, rnd.randint(1, 7))) for i in range(700)}
    skills = spark.createDataFrame([(j, s) for j, some in sets.items() for s in some], "job_id string, skill_name string")
    places = {j: (rnd.choice(["Hue", "Hanoi", None]), rnd.choice([1.0, 2.0, None])) for j in sets}
    jobs = spark.createDataFrame([(j, *p) for j, p in places.items()], "job_id string, city string, experience_years double")
    wishes = [(f"p{i}", rnd.sample(names, rnd.randint(1, 8)) + ["unknown"], rnd.choice(["hue", None, " "]), rnd.choice([1.4, None])) for i in range(60)]
    profiles = spark.createDataFrame(wishes, "profile_id string, skills array<string>, city string, years double")
    index = rec.build_index(skills)
    got = {(r.profile_id, r.rank): (r.job_id, r.similarity_score) for r in rec.recommend_table(index, jobs, profiles, 3).collect()}
    want = {(r.profile_id, r.rank): (r.job_id, r.similarity_score)
            for r in rec.recommend(index, jobs, [rec.Profile(p, tuple(s), c, y) for p, s, c, y in wishes], 3).collect()}
    assert got == want and len(got) == 180

    classes = rec._classes(index, jobs, 3)
    struct = F.struct(F.col("skills").alias("skills"), F.lower(F.trim("city")).alias("p_city"), F.col("years").alias("p_years"))
    known = rec.known_wishes(index, profiles.select(F.col("profile_id").alias("wish_id"), struct.alias("wish")))
    asked = known.select("*", F.posexplode("known").alias("before", "skill"))
    every = rec.wish_matches(asked.withColumn("least", F.lit(0.0)), classes)
    few = rec.wish_matches(asked.withColumn("least", F.lit(2.0)), classes)
    good = every.where("fit >= 2")
    assert good.count() and good.exceptAll(few).count() == 0 and few.count() < every.count() / 2


def test_sizes_and_export(skills, jobs):
    assert tuple(rec.index_size(skills).first()) == (3, 7)
    row = rec.for_export(rec.recommend(rec.build_index(skills), jobs, [rec.Profile("p", ("Rust", "Kafka", "Linux"))], 1)).first()
    assert row.matched_skills == "Kafka; Linux; Rust"
    assert {r.job_id: r.missing_skills for r in rec.skill_gap(rec.skill_sets(skills), ["CSS"]).collect()}["k2"] == ["Figma"]


@pytest.mark.parametrize("rounds", [(1,), rec.LACKING])
def test_nearest_sets_by_subsets(spark, rounds):
    """Few and many skills, wishes that one round settles and wishes that only the posting lists can."""
    rng = random.Random(5)
    sets = sorted({tuple(sorted(rng.sample("abcdefghijkl", rng.choice([1, 2, 3, 4, 5, 8, 11])))) for _ in range(300)} | {("z",), ("y", "z")})
    classes = [(f"c{i:03d}", list(s), 1 + i % 3) for i, s in enumerate(sets)]
    got = rec.nearest_sets(spark.createDataFrame([(c[0], c[1]) for c in classes[::7] + classes[-2:]], "wish_id string, skills array<string>"),
                           spark.createDataFrame(classes, "first_id string, skills array<string>, n_ids int"), 4, rounds).collect()
    want = {}
    for w, mine, _ in classes[::7] + classes[-2:]:
        near = sorted((-len({*mine} & {*s}) ** 2 / len(s), c) for c, s, _ in classes if {*mine} & {*s})
        want[w] = {(c, -fit) for fit, c in near[:4]}
    found = {w: {(r.first_id, r.fit) for r in got if r.wish_id == w} for w in want}
    # A wish is settled once its classes hold enough ids, which may be fewer classes than asked for; those are the best.
    of = {c: (set(s), n) for c, s, n in classes}
    for w, best in want.items():
        if found[w] != best:
            assert sum(of[c][1] for c, _ in found[w]) >= 4
            ids = 0
            for c, fit in sorted(best, key=lambda x: (-x[1], x[0])):
                if ids >= 4:
                    break
                assert (c, fit) in found[w]
                ids += of[c][1]
