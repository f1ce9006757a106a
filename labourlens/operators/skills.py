"""Skill names to canonical names and groups, and skills found in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labourlens.dictionaries import SKILL_ENTRIES, SkillEntry
from labourlens.functions.category import group_from_words
from labourlens.functions.text import dictionary, let, literal_array, lookup, sql_text
from labourlens.functions.tokens import ngrams_up_to, pieces, python_tokens, tokens

EXACT, CANONICAL, PARTIAL, WORD = 1, 2, 3, 4
CONFIDENCE = {EXACT: 1.0, CANONICAL: 0.95, PARTIAL: 0.8, WORD: 0.7}
UNMATCHED_CONFIDENCE = 0.3
MIN_PARTIAL_LENGTH = 3


def probe_table(entries: list[SkillEntry]) -> tuple[dict[tuple[str, str], tuple[str, str, int, int]], int]:
    """``(kind, key) -> (canonical, group, stage, ord)`` for every way a name may hit
    the dictionary, and the longest spelling in words.

    Kinds: ``exact`` and ``canonical`` against the whole name, ``holds`` when the
    name holds a spelling at word borders, ``held`` when a spelling holds the
    name, ``word`` for one word of the name.
    """
    rows: dict[tuple[str, str], tuple[str, str, int, int]] = {}
    longest = 1

    def add(kind: str, key: str, stage: int, e: SkillEntry) -> None:
        rows.setdefault((kind, key), (e.canonical, e.group, stage, e.ord))

    for e in entries:
        words = python_tokens(e.alias)
        longest = max(longest, len(words))
        add("exact", e.alias, EXACT, e)
        add("canonical", e.canonical.lower(), CANONICAL, e)
        if len(words) == 1:
            add("word", words[0], WORD, e)
        if len(e.alias) >= MIN_PARTIAL_LENGTH:
            add("holds", " ".join(words), PARTIAL, e)
        for n in range(1, len(words)):
            for start in range(len(words) - n + 1):
                part = " ".join(words[start:start + n])
                if len(part) >= MIN_PARTIAL_LENGTH:
                    add("held", part, PARTIAL, e)
    return rows, longest


def _probes(spark: SparkSession, entries: list[SkillEntry]) -> tuple[DataFrame, int]:
    rows, longest = probe_table(entries)
    return spark.createDataFrame(
        [(kind, key, *value) for (kind, key), value in rows.items()],
        "kind string, key string, canonical string, skill_group string, stage int, ord int",
    ), longest


def dictionary_table(user: DataFrame) -> DataFrame:
    """The built-in entries and a user table ``(alias, canonical, skill_group)`` of any size, as
    ``(alias, canonical, skill_group, ord)``.

    A user spelling replaces a built-in one and a user's group holds for all spellings of its canonical name; user
    spellings rank after the built-in ones, among each other by spelling.
    """
    spark = user.sparkSession
    own = user.where("trim(alias) <> ''").groupBy(F.lower(F.trim("alias")).alias("alias")).agg(
        F.max(F.struct("canonical", "skill_group")).alias("_u")).select("alias", "_u.*")
    built_in = spark.createDataFrame([(e.alias, e.canonical, e.group, e.ord) for e in SKILL_ENTRIES], "alias string, _c string, _g string, _ord int")
    regrouped = user.groupBy("canonical").agg(F.max("skill_group").alias("_regrouped"))
    both = own.join(built_in, "alias", "full").select(
        "alias", F.coalesce("canonical", "_c").alias("canonical"), F.coalesce("skill_group", "_g").alias("skill_group"),
        F.coalesce("_ord", F.lit(len(SKILL_ENTRIES))).alias("ord"))
    return both.join(regrouped, "canonical", "left").select("alias", "canonical", F.coalesce("_regrouped", "skill_group").alias("skill_group"), "ord")


def probe_rows(dictionary: DataFrame) -> tuple[DataFrame, int]:
    """:func:`probe_table` of a dictionary that is a table itself: nothing but the longest spelling's length is fetched."""
    words = dictionary.withColumn("_w", tokens(F.col("alias")))
    longest = max(1, words.agg(F.max(F.size("_w"))).first()[0] or 1)
    w = F.col("_w")

    def probe(kind: str, key: Column, stage: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(stage).alias("stage"))

    parts = F.filter(ngrams_up_to(w, longest), lambda g: (F.length(g) >= MIN_PARTIAL_LENGTH) & (g != F.array_join(w, " ")))
    tries = F.concat(
        F.array(probe("exact", F.col("alias"), EXACT), probe("canonical", F.lower("canonical"), CANONICAL)),
        F.when(F.size(w) == 1, F.array(probe("word", F.get(w, F.lit(0)), WORD))).otherwise(F.array()),
        F.when(F.length("alias") >= MIN_PARTIAL_LENGTH, F.array(probe("holds", F.array_join(w, " "), PARTIAL))).otherwise(F.array()),
        F.transform(parts, lambda g: probe("held", g, PARTIAL)))
    rows = words.select("alias", "canonical", "skill_group", "ord", F.explode(tries).alias("t")).select("t.*", "alias", "canonical", "skill_group", "ord")
    first = F.min(F.struct("ord", "alias", "canonical", "skill_group", "stage"))
    return rows.groupBy("kind", "key").agg(first.alias("f")).select("kind", "key", "f.canonical", "f.skill_group", "f.stage", "f.ord"), longest


def resolve_names(names: DataFrame, entries: list[SkillEntry] | DataFrame = SKILL_ENTRIES) -> DataFrame:
    """Best dictionary hit for each distinct, trimmed, non-blank ``name``.

    Listed entries are bounded and broadcast; a table of entries joins as the planner sees fit."""
    if isinstance(entries, DataFrame):
        probes, longest = probe_rows(entries)
    else:
        probes, longest = _probes(names.sparkSession, entries)
        probes = F.broadcast(probes)
    low = F.lower(F.col("name"))

    def probe(kind: str, key: Column, pos: Column | int = 0) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"),
                        (F.lit(pos) if isinstance(pos, int) else pos).cast("int").alias("pos"))

    words = F.col("_words")
    tries = F.concat(
        F.array(probe("exact", low), probe("canonical", low), probe("held", F.array_join(words, " "))),
        F.transform(ngrams_up_to(words, longest), lambda g: probe("holds", g)),
        F.transform(words, lambda w, i: probe("word", w, i)),
    )
    tried = names.withColumn("_words", tokens(F.col("name"))).select("name", F.explode(tries).alias("t"))
    hits = tried.select("name", "t.*").join(probes, ["kind", "key"])
    best = hits.groupBy("name").agg(
        F.min(F.struct("stage", F.when(F.col("stage") == WORD, F.col("pos")).otherwise(0).alias("pos"),
                       "ord", "canonical", "skill_group")).alias("b"))
    stage = F.col("b.stage")
    confidence = F.when(stage.isNull(), UNMATCHED_CONFIDENCE)
    for code, value in CONFIDENCE.items():
        confidence = confidence.when(stage == code, value)
    return names.join(best, "name", "left").select(
        "name",
        F.coalesce("b.canonical", "name").alias("canonical"),
        F.coalesce("b.skill_group", group_from_words("name")).alias("skill_group"),
        stage.isNotNull().alias("matched"),
        confidence.alias("confidence"),
    )


def normalize_skills(df: DataFrame, source: str = "skill_raw",
                     entries: list[SkillEntry] | DataFrame = SKILL_ENTRIES) -> DataFrame:
    """Add ``canonical, skill_group, matched, confidence`` for the column ``source``.

    Work is done once per distinct name (the distinct is pre-aggregated on the
    map side, so a name carried by a third of all rows costs one row), then
    joined back; the adaptive planner broadcasts the resolved names while they
    are small and splits the hot name's partition when they are not.
    """
    named = df.withColumn("_name", F.coalesce(F.trim(F.col(source)), F.lit("")))
    names = named.where(F.col("_name") != "").select(F.col("_name").alias("name")).distinct()
    resolved = resolve_names(names, entries).withColumnRenamed("name", "_name")
    return (
        named.join(resolved, "_name", "left")
        .withColumns({
            "canonical": F.coalesce("canonical", F.lit("")),
            "skill_group": F.coalesce("skill_group", F.lit("Other")),
            "matched": F.coalesce("matched", F.lit(False)),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
        })
        .drop("_name")
    )


def canonical_name(name: Column, entries: list[SkillEntry] = SKILL_ENTRIES) -> Column:
    """The same resolution as :func:`resolve_names` inside one row, for the few
    tags a posting carries; an unknown name is returned trimmed."""
    rows, longest = probe_table(entries)

    def names(kind: str) -> dict[str, str]:
        return {key: canonical for (k, key), (canonical, *_) in rows.items() if k == kind}

    def ranked(kind: str, key: Column) -> Column:
        return dictionary({k: f"named_struct('ord', {ord_}, 'canonical', {sql_text(canonical)})"
                           for (found, k), (canonical, _, _, ord_) in rows.items() if found == kind}, key, "struct<ord: int, canonical: string>")

    def partial(words: Column) -> Column:
        hits = F.concat(F.transform(ngrams_up_to(words, longest), lambda g: ranked("holds", g)),
                        F.array(ranked("held", F.array_join(words, " "))))
        return F.array_min(F.filter(hits, lambda h: h.isNotNull()))["canonical"]

    def word(words: Column) -> Column:
        return F.get(F.filter(F.transform(words, lambda w: lookup(names("word"), w)), lambda c: c.isNotNull()), F.lit(0))

    low = F.lower(F.trim(name))
    return F.coalesce(lookup(names("exact"), low), lookup(names("canonical"), low),
                      let(tokens(low), lambda w: F.coalesce(partial(w), word(w))), F.trim(name))


def known_group(canonical: Column, entries: list[SkillEntry] = SKILL_ENTRIES) -> Column:
    """Group of a canonical name, null for an unknown one."""
    return lookup({e.canonical: e.group for e in entries}, canonical)


def skills_in_text(text: Column, entries: list[SkillEntry] = SKILL_ENTRIES) -> Column:
    """``array<struct<ord, skill_name, original_name, skill_group>>`` of the skills
    named in a text, in dictionary order.

    The whole text is cut into words and runs of words and intersected with the
    spellings: one pass over the row, no explode, no shuffle.
    """
    first: dict[str, SkillEntry] = {}
    by_key: dict[str, SkillEntry] = {}
    longest = 1
    for e in entries:
        first.setdefault(e.canonical, e)
    for spelled, e in [(e.alias, e) for e in entries] + [(c.lower(), e) for c, e in first.items()]:
        words = python_tokens(spelled)
        longest = max(longest, len(words))
        by_key.setdefault(" ".join(words), e)
    known = literal_array(list(by_key))
    found = let(tokens(text), lambda w: F.array_intersect(F.concat(ngrams_up_to(w, longest), pieces(w)), known))
    names = {k: e.canonical for k, e in by_key.items()}
    described = {c: f"named_struct('ord', {e.ord}, 'skill_name', {sql_text(c)}, 'original_name', {sql_text(e.alias)}, 'skill_group', {sql_text(e.group)})" for c, e in first.items()}
    distinct = F.array_distinct(F.transform(found, lambda k: lookup(names, k)))
    kind = "struct<ord: int, skill_name: string, original_name: string, skill_group: string>"
    return F.coalesce(F.array_sort(F.transform(distinct, lambda c: dictionary(described, c, kind))), F.array())


def skills_in_texts(rows: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    """:func:`skills_in_text` by a dictionary table of any size: ``(key, ord, skill_name, original_name, skill_group)``.

    The distinct words and runs of words of each text meet the spellings in a join; nothing but the longest
    spelling's length is fetched.
    """
    spelled = entries.select(F.lit(0).alias("kind"), F.array_join(tokens(F.col("alias")), " ").alias("g"), "canonical", "ord", "alias").unionByName(
        entries.select(F.lit(1).alias("kind"), F.array_join(tokens(F.col("canonical")), " ").alias("g"), "canonical", "ord", "alias"))
    spelled = spelled.where("g <> ''").groupBy("g").agg(F.min(F.struct("kind", "ord", "alias", "canonical"))["canonical"].alias("canonical"))
    first = entries.groupBy("canonical").agg(F.min(F.struct("ord", "alias", "skill_group")).alias("e"))
    longest = max(1, entries.agg(F.max(F.greatest(F.size(tokens(F.col("alias"))), F.size(tokens(F.col("canonical")))))).first()[0] or 1)
    runs = let(tokens(F.col(text)), lambda w: F.array_distinct(F.concat(ngrams_up_to(w, longest), pieces(w))))
    met = rows.select(key, F.explode(runs).alias("g")).join(spelled, "g").select(key, "canonical").distinct()
    return met.join(first, "canonical").select(key, "e.ord", F.col("canonical").alias("skill_name"), F.col("e.alias").alias("original_name"), "e.skill_group")


def skill_stats(df: DataFrame) -> DataFrame:
    """One row of totals over normalised skills (blank names have canonical '')."""
    return df.agg(
        F.count("*").alias("total_skills"),
        F.countDistinct(F.when(F.col("canonical") != "", F.col("canonical"))).alias("unique_canonical"),
        F.count_if("matched").alias("matched"),
        F.count_if(~F.col("matched")).alias("unmatched"),
    )


def unmatched_report(df: DataFrame, source: str = "skill_raw") -> DataFrame:
    """Unknown names with their counts, most frequent first."""
    return (
        df.where(~F.col("matched") & (F.trim(F.col(source)) != ""))
        .groupBy(F.trim(F.col(source)).alias("skill_raw")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "skill_raw")
    )
