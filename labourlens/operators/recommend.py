"""Postings that fit a set of skills, by cosine similarity of skill sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labourlens.functions.experience import nearest_bin
from labourlens.functions.text import floor_round, literal_array
from labourlens.operators.merge import keep_first
from labourlens.session import stored

MAX_LISTED_PROFILES = 200
#: Skills that the subsets of a set may lack, round by round, before posting lists take over.
LACKING = (1, 2, 4, 6)


@dataclass(frozen=True)
class Profile:
    """A candidate: skills, and optional city and years filters."""

    profile_id: str
    skills: tuple[str, ...] = field(default_factory=tuple)
    city: str | None = None
    years: float | None = None


def skill_sets(job_skills: DataFrame) -> DataFrame:
    """One row per posting with its distinct skills (bounded by the vocabulary)."""
    return (job_skills.where(F.col("skill_name").isNotNull())
            .groupBy("job_id").agg(F.array_sort(F.collect_set("skill_name")).alias("skills")))


def index_size(job_skills: DataFrame) -> DataFrame:
    """Number of postings and of distinct skills in the index."""
    known = job_skills.where(F.col("skill_name").isNotNull())
    return known.agg(F.countDistinct("job_id").alias("n_jobs"), F.countDistinct("skill_name").alias("n_skills"))


def city_filter(city: Column, wanted: str | None) -> Column:
    """Same city, whatever the case; a blank wish lets every posting pass."""
    if wanted is None or not wanted.strip():
        return F.lit(True)
    return F.coalesce(F.lower(city) == wanted.strip().lower(), F.lit(False))


def years_filter(columns: Sequence[str], wanted: float | None) -> Column:
    """Within half a year of the wish, else the bin nearest to it, else no filter."""
    if wanted is None:
        return F.lit(True)
    if "experience_years" in columns:
        return F.coalesce(F.abs(F.col("experience_years") - float(wanted)) <= 0.5, F.lit(False))
    if "experience_bin" in columns:
        return F.coalesce(F.col("experience_bin") == nearest_bin(wanted), F.lit(False))
    return F.lit(True)


def _fit(common: Column, size: Column) -> Column:
    """Ranks like the cosine for one profile, whose own length is the same everywhere.

    The square is a ratio of whole numbers, so equal scores are equal doubles
    and the tie rule decides, not the last digit of a root.
    """
    return common * common / size


def build_index(job_skills: DataFrame) -> DataFrame:
    """Skill sets written once, to be read by every recommendation."""
    return stored(skill_sets(job_skills), "skill-index")


def recommend(index: DataFrame, jobs: DataFrame, profiles: Sequence[Profile], top_n: int = 10) -> DataFrame:
    """The ``top_n`` postings for each of a short list of profiles.

    ``index`` comes from :func:`build_index`, ``jobs`` holds one row per posting
    (the first by all columns counts if an id repeats).  Profiles ride along as
    literals: one pass over the skill sets scores every posting for every
    profile, and the rank limit is applied inside each task before anything is
    shuffled.  Postings without a common skill keep their zero score, the
    filters come before the ranking, equal scores are ordered by id.  Details
    are looked up for the ranked postings only; one without details is left out.
    """
    if len(profiles) > MAX_LISTED_PROFILES:
        raise ValueError("use recommend_table for a long list of profiles")
    wanted = sorted({s for p in profiles for s in p.skills})
    # Only skills some posting has count towards the length of a profile.
    known = index.select(F.explode(F.array_intersect("skills", literal_array(wanted).cast("array<string>"))).alias("s")).agg(
        F.array_sort(F.collect_set("s"))).scalar()
    filters = [c for c in ("city", "experience_years", "experience_bin") if c in jobs.columns and any(
        (p.city if c == "city" else p.years is not None) for p in profiles)]
    rows = index
    if filters:
        rows = index.join(keep_first(jobs.select("job_id", *filters), ["job_id"], filters), "job_id", "left")
    choices = []
    for p in profiles:
        mine = literal_array(sorted(set(p.skills))).cast("array<string>")
        keep = years_filter(jobs.columns, p.years)
        if p.city and p.city.strip():
            keep = keep & city_filter(F.col("city"), p.city)
        choices.append(F.struct(F.lit(p.profile_id).alias("profile_id"), mine.alias("wish"), keep.alias("keep")))
    scored = (
        rows.withColumn("_p", F.explode(F.filter(F.array(*choices), lambda c: c["keep"])))
        .withColumn("_common", F.size(F.array_intersect("skills", "_p.wish")))
        .withColumn("_fit", _fit(F.col("_common"), F.size("skills")))
    )
    rank = F.row_number().over(W.partitionBy("_p.profile_id").orderBy(F.desc("_fit"), "job_id"))
    top = scored.withColumn("rank", rank).where(F.col("rank") <= top_n).select("_p", "rank", "job_id", "skills", "_common")
    n_wish = F.size(F.array_intersect("_p.wish", known))
    score = F.when(F.col("_common") == 0, 0.0).otherwise(F.col("_common") / F.sqrt(n_wish * F.size("skills")))
    columns = [c for c in jobs.columns if c != "job_id"]
    # At most top_n rows for each of at most MAX_LISTED_PROFILES profiles.
    found = jobs.join(F.broadcast(top), "job_id")
    once = keep_first(found, ["_p.profile_id", "rank"], columns) if columns else found
    return once.select(
        "_p.profile_id", "rank", "job_id", *columns,
        floor_round(score, 4).alias("similarity_score"),
        F.array_sort(F.array_intersect("skills", "_p.wish")).alias("matched_skills"),
        F.array_sort(F.array_except("skills", "_p.wish")).alias("missing_skills"),
    )


def _classes(index: DataFrame, jobs: DataFrame, top_n: int) -> DataFrame:
    """Postings grouped by skill set, city and years, with the first ids of each class.

    Only the ``top_n`` smallest ids of a class can ever be recommended, so the
    members kept per class are bounded by the request, not by the data.
    """
    rows = index.join(jobs.select("job_id", "city", "experience_years"), "job_id")
    keys = [F.concat_ws("\u0001", "skills"), F.lower("city"), F.col("experience_years")]
    keyed = rows.withColumn("_class", F.xxhash64(*keys)).withColumns({"_c": keys[1], "_s": keys[0]})
    rank = F.row_number().over(W.partitionBy("_class", "_s", "_c", "experience_years").orderBy("job_id"))
    heads = keyed.withColumn("_r", rank).where(F.col("_r") <= top_n)
    return heads.groupBy("_class", "_s", "_c", "experience_years").agg(
        F.first("skills").alias("skills"), F.min("job_id").alias("first_id"),
        F.array_sort(F.collect_list("job_id")).alias("ids"))


def _unmatched(index: DataFrame, jobs: DataFrame, wishes: DataFrame, answers: DataFrame, top_n: int) -> DataFrame:
    """Zero-score answers for wishes with fewer than ``top_n`` matches: the first ids that pass the filters.

    A wish meets the smallest ids of its city and years only, twice ``top_n`` of
    them, of which at most ``top_n`` are among its matches.
    """
    rows = index.select("job_id").join(jobs.select("job_id", "city", "experience_years"), "job_id")
    places = F.explode(F.array(F.lower("city"), F.lit("*")))
    any_years = F.explode(F.array(F.lit(True), F.lit(False)))
    options = rows.select("job_id", "experience_years", places.alias("place")).where("place IS NOT NULL").select("*", any_years.alias("any_years"))
    options = options.withColumn("at_years", F.when(~F.col("any_years"), F.col("experience_years"))).where("any_years OR at_years IS NOT NULL")
    rank = F.row_number().over(W.partitionBy("place", "any_years", "at_years").orderBy("job_id"))
    heads = options.withColumn("_r", rank).where(F.col("_r") <= 2 * top_n).select("place", "any_years", "at_years", "job_id")
    counts = answers.groupBy("wish_id").agg(F.count("*").alias("n_found"))
    short = wishes.join(counts, "wish_id", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0))).where(F.col("n_found") < top_n)
    short = short.withColumn("place", F.when(F.coalesce("p_city", F.lit("")) == "", F.lit("*")).otherwise(F.col("p_city")))
    short = short.withColumn("any_years", F.col("p_years").isNull())
    near = F.col("any_years") | (F.abs(F.col("at_years") - F.col("p_years")) <= 0.5)
    rest = short.join(heads, ["place", "any_years"]).where(near).join(answers.select("wish_id", "job_id"), ["wish_id", "job_id"], "left_anti")
    place = F.row_number().over(W.partitionBy("wish_id").orderBy("job_id"))
    rest = rest.withColumn("rank", F.col("n_found") + place).where(F.col("rank") <= top_n)
    return rest.select("wish_id", F.lit(0.0).alias("score"), "job_id", F.col("rank").cast("int").alias("rank"))


def known_wishes(index: DataFrame, wishes: DataFrame) -> DataFrame:
    """Wishes with the skills that some posting has, the rarest first, as ``known``."""
    counts = index.select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    exploded = wishes.select("wish_id", "wish.p_city", "wish.p_years", F.explode("wish.skills").alias("skill")).join(counts, "skill")
    known = F.array_sort(F.collect_list(F.struct("n", "skill")))["skill"]
    return exploded.groupBy("wish_id", "p_city", "p_years").agg(known.alias("known"))


def wish_matches(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes that fit a wish and share the asked skill with it, but none of those before it: ``wish_id, first_id, score, fit``.

    ``asked``: a wish with one of its ``known`` skills, the number of skills ``before`` it, and the ``least`` fit of interest.
    A class that lacks these shares at most the others, so its size decides whether it can reach that fit; a pair is met under
    its rarest common skill only.  Wishes for a city meet the postings of that city.
    """
    posted = classes.select(F.explode("skills").alias("skill"), "first_id", "skills", F.size("skills").alias("n_job"),
                            F.col("_c").alias("c_city"), F.col("experience_years").alias("c_years"))
    left = F.size("known") - F.col("before")
    asked = asked.where(left >= F.col("least"))
    some = F.coalesce("p_city", F.lit("")) != ""
    here = asked.where(some).join(posted.where("c_city IS NOT NULL").withColumn("p_city", F.col("c_city")), ["skill", "p_city"])
    met = here.unionByName(asked.where(~some).join(posted, "skill"))
    met = met.where(F.col("p_years").isNull() | F.coalesce(F.abs(F.col("c_years") - F.col("p_years")) <= 0.5, F.lit(False)))
    most = F.least(left, F.col("n_job"))
    met = met.where(_fit(most, F.col("n_job")) >= F.col("least")).withColumn("_common", F.array_intersect("known", "skills"))
    met = met.where(F.get("_common", F.lit(0)) == F.col("skill"))
    shared = F.size("_common")
    return met.select("wish_id", "first_id", (shared / F.sqrt(F.size("known") * F.col("n_job"))).alias("score"), _fit(shared, F.col("n_job")).alias("fit"))


def recommend_table(index: DataFrame, jobs: DataFrame, profiles: DataFrame, top_n: int = 10, unmatched: bool = True) -> DataFrame:
    """As :func:`recommend` for a table ``(profile_id, skills, city, years)`` of any
    length, zero scores and profiles without a known skill included unless
    ``unmatched`` is false.

    Postings are first folded into classes of equal skill set, city and years; the
    ``top_n`` best classes of a profile hold its ``top_n`` best postings, so only
    those are unrolled.  Profiles with the same wish are answered once.  A wish
    meets classes through the posting lists of its skills, rarest first: the list
    of its rarest skill gives a score that ``top_n`` classes reach, and of the
    other lists only classes that can reach it too are looked at
    (:func:`wish_matches`).
    """
    classes = stored(_classes(index, jobs, top_n), "classes")
    # Equal wishes are answered once.
    wish = F.struct(F.array_sort(F.array_distinct("skills")).alias("skills"), F.lower(F.trim("city")).alias("p_city"),
                    F.col("years").cast("double").alias("p_years"))
    asked = profiles.select("profile_id", wish.alias("wish")).withColumn(
        "wish_id", F.md5(F.to_json("wish")))
    wishes = stored(known_wishes(index, asked.select("wish_id", "wish").distinct()), "wishes")
    place = F.row_number().over(W.partitionBy("wish_id").orderBy(F.desc("fit"), "first_id"))
    by_skill = wishes.select("*", F.posexplode("known").alias("before", "skill"))
    first = wish_matches(by_skill.where("before = 0").withColumn("least", F.lit(0.0)), classes)
    first = stored(first.withColumn("_r", place).where(F.col("_r") <= top_n).drop("_r"), "best")
    reached = first.groupBy("wish_id").agg(F.count("*").alias("_n"), F.min("fit").alias("_fit"))
    reached = reached.select("wish_id", F.when(F.col("_n") >= top_n, F.col("_fit")).alias("least"))
    rest = by_skill.where("before > 0").join(reached, "wish_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    found = first.unionByName(wish_matches(rest, classes))
    best = found.withColumn("_r", place).where(F.col("_r") <= top_n).join(classes.select("first_id", "ids"), "first_id")
    rank = F.row_number().over(W.partitionBy("wish_id").orderBy(F.desc("fit"), "job_id"))
    answers = (
        best.select("wish_id", "score", "fit", F.explode("ids").alias("job_id"))
        .withColumn("rank", rank).where(F.col("rank") <= top_n)
    )
    answers = answers.select("wish_id", "score", "job_id", "rank")
    if unmatched:
        answers = stored(answers, "answers")
        all_wishes = asked.select("wish_id", "wish.p_city", "wish.p_years").distinct()
        answers = answers.unionByName(_unmatched(index, jobs, all_wishes, answers, top_n))
    return asked.select("profile_id", "wish_id").join(answers, "wish_id").select(
        "profile_id", "rank", "job_id", floor_round("score", 4).alias("similarity_score"))


def _subsets(sets: DataFrame, most: int, least: Column) -> DataFrame:
    """Every row once per subset ``u`` of its ``skills`` that lacks ``most`` of them or fewer and has ``least`` (one or more)."""
    level = sets.withColumns({"u": F.col("skills"), "_from": F.lit(0)})
    out = level
    for _ in range(most):
        # Skills leave in order, so that no subset comes twice.
        level = level.where((F.size("u") > 1) & (F.size("u") > least) & (F.col("_from") < F.size("u")))
        level = level.withColumn("_from", F.explode(F.sequence("_from", F.size("u") - 1)))
        level = level.withColumn("u", F.concat(F.slice("u", F.lit(1), F.col("_from")), F.slice("u", F.col("_from") + 2, F.size("u"))))
        out = out.unionByName(level)
    return out.drop("_from").where(F.size("u") >= least)


def nearest_sets(wishes: DataFrame, classes: DataFrame, top_n: int, rounds: Sequence[int] = LACKING) -> DataFrame:
    """The best ``top_n`` classes of every wish, ``wish_id, first_id, score, fit``, by the subsets that both have.

    ``wishes(wish_id, skills)`` and ``classes(first_id, skills, n_ids)`` hold distinct sets.  A class with u of a wish's m skills and
    n of its own fits u^2 / n.  Of the classes of one size over one subset only the ``top_n`` first can be among the best of a wish
    with that subset, for all of them fit it as well or better.  With subsets that lack up to r skills on either side, all pairs
    are met that fit better than max(m^2 / (m + r + 1), m - r - 1): a wish whose last answer does is settled, the others go on
    with a larger r, and from their last answer up.  What no round settles meets the posting lists.
    """
    best, open_ = None, wishes.select("wish_id", "skills", F.lit(0.0).alias("least"))
    place = W.partitionBy("wish_id").orderBy(F.desc("fit"), "first_id")
    for r in rounds:
        floor = open_.agg(F.min("least")).first()[0]  # one number
        if floor is None:
            return best
        over = _subsets(classes.where(F.size("skills") >= floor), r, F.lit(max(1.0, floor)))
        over = over.select("u", "first_id", "n_ids", F.size("skills").alias("n")).where(_fit(F.size("u"), F.col("n")) >= floor)
        heads = over.withColumn("_h", F.row_number().over(W.partitionBy("u", "n").orderBy("first_id"))).where(F.col("_h") <= top_n)
        heads = heads.groupBy("u").agg(F.collect_list(F.struct("n", "first_id", "n_ids")).alias("heads"))  # top_n for each of r + 1 sizes
        asked = _subsets(open_, r, F.greatest(F.lit(1.0), F.col("least")))
        met = asked.select("u", "wish_id", "least", F.size("skills").alias("m")).join(heads, "u")
        met = met.select("wish_id", "least", "m", F.size("u").alias("common"), F.explode("heads").alias("h")).select("*", "h.*").drop("h")
        met = met.withColumn("fit", _fit(F.col("common"), F.col("n"))).where(F.col("fit") >= F.col("least"))
        pairs = met.groupBy("wish_id", "first_id").agg(F.max("fit").alias("fit"), F.first("n_ids").alias("n_ids"), F.first("m").alias("m"),
                                                       F.max(F.col("common") / F.sqrt(F.col("m") * F.col("n"))).alias("score"))
        ranked = pairs.withColumns({"_r": F.row_number().over(place), "_ids": F.sum("n_ids").over(place.rowsBetween(W.unboundedPreceding, 0))})
        found = stored(ranked.where(F.col("_r") <= top_n).drop("_r"), "nearest")
        last = found.where(F.col("_ids") >= top_n).groupBy("wish_id").agg(F.max("fit").alias("last"))
        m = F.size("skills")
        asked = open_.join(last, "wish_id", "left").withColumn("least", F.greatest("least", F.coalesce("last", F.lit(0.0))))
        unmet = F.greatest(m * m / (m + r + 1), m - (r + 1.0))
        open_ = stored(asked.where(F.col("least") <= unmet).select("wish_id", "skills", "least"), "open")
        found = found.join(open_, "wish_id", "left_anti").select("wish_id", "first_id", "score", "fit")
        best = found if best is None else best.unionByName(found)
    by_skill = open_.select("wish_id", F.lit(None).cast("string").alias("p_city"), F.lit(None).cast("double").alias("p_years"), "least",
                            F.col("skills").alias("known"), F.posexplode("skills").alias("before", "skill"))
    places = classes.select("first_id", "skills", F.lit(None).cast("string").alias("_c"), F.lit(None).cast("double").alias("experience_years"))
    rest = wish_matches(by_skill, places).withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= top_n).drop("_r")
    return best.unionByName(rest)


def similar_table(index: DataFrame, targets: DataFrame, top_n: int = 10) -> DataFrame:
    """As :func:`similar_jobs` for a table ``(target_id)`` of any length.

    Targets of equal skills are answered once, by classes of postings with equal skills (:func:`nearest_sets`); one more answer than
    wanted leaves enough when the target itself is among them.  Targets that are not in the index have no answers.
    """
    wanted = top_n + 1
    asked = targets.select("target_id").distinct().join(index.select(F.col("job_id").alias("target_id"), "skills"), "target_id")
    asked = asked.select("target_id", "skills", F.concat_ws("\u0001", "skills").alias("wish_id"))
    rank = F.row_number().over(W.partitionBy("skills").orderBy("job_id"))
    heads = index.withColumn("_r", rank).where(F.col("_r") <= wanted)
    classes = stored(heads.groupBy("skills").agg(F.min("job_id").alias("first_id"), F.array_sort(F.collect_list("job_id")).alias("ids")), "classes")
    wishes = stored(asked.select("wish_id", "skills").distinct(), "wishes")
    best = nearest_sets(wishes, classes.select("first_id", "skills", F.size("ids").alias("n_ids")), wanted)
    answers = best.join(classes.select("first_id", "ids"), "first_id").select("wish_id", "score", "fit", F.explode("ids").alias("job_id"))
    answers = answers.withColumn("_r", F.row_number().over(W.partitionBy("wish_id").orderBy(F.desc("fit"), "job_id"))).where(F.col("_r") <= wanted)
    found = asked.join(answers, "wish_id").where("job_id <> target_id")
    place = F.row_number().over(W.partitionBy("target_id").orderBy("_r"))
    return found.withColumn("rank", place).where(F.col("rank") <= top_n).select("target_id", "rank", "job_id", floor_round("score", 4).alias("similarity_score"))


def similar_jobs(index: DataFrame, targets: Sequence[str], top_n: int = 10) -> DataFrame:
    """Postings most like each target posting, without itself and without zero scores."""
    if len(targets) > MAX_LISTED_PROFILES:
        raise ValueError("too many targets for one pass")
    sets = index
    rows = sets.where(F.col("job_id").isin(*targets)).collect()  # at most MAX_LISTED_PROFILES short rows
    missing = set(targets) - {r["job_id"] for r in rows}
    if missing:
        raise ValueError(f"postings not in the index: {sorted(missing)}")
    picks = F.array(*[
        F.struct(F.lit(r["job_id"]).alias("target_id"), F.array(*[F.lit(s) for s in r["skills"]]).alias("wish"))
        for r in rows])
    scored = (
        sets.withColumn("_t", F.explode(picks)).where("job_id <> _t.target_id")
        .withColumn("_common", F.size(F.array_intersect("skills", "_t.wish"))).where("_common > 0")
        .withColumn("_score", F.col("_common") / F.sqrt(F.size("_t.wish") * F.size("skills")))
    )
    rank = F.row_number().over(W.partitionBy("_t.target_id").orderBy(F.desc(_fit(F.col("_common"), F.size("skills"))), "job_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_n).select(
        "_t.target_id", "rank", "job_id", floor_round("_score", 4).alias("similarity_score"))


def skill_gap(index: DataFrame, skills: Sequence[str]) -> DataFrame:
    """What each posting asks for that a candidate has and has not."""
    mine = literal_array(skills).cast("array<string>")
    return index.select(
        "job_id",
        F.array_sort(F.array_intersect("skills", mine)).alias("matched_skills"),
        F.array_sort(F.array_except("skills", mine)).alias("missing_skills"),
    )


def for_export(recommendations: DataFrame) -> DataFrame:
    """Lists joined by ``; `` as a flat file needs them."""
    return recommendations.withColumns({
        "matched_skills": F.concat_ws("; ", "matched_skills"),
        "missing_skills": F.concat_ws("; ", "missing_skills"),
    })
