"""Personal data by fixed patterns, and by contexts learnt from what those find.

*Base.*  E-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers, each by its own pattern, leftmost and
without overlap within a kind; matches that fail their check are dropped.  The patterns stand in forms that give the same
matches but read a long run of characters once: starts inside a run are tried only right after a match.

*Bootstrapping.*  The base finds are seeds.  The words before a seed (the last two, and a last word that ends like a label)
are its lexical patterns.  Other strings that look like identifiers are candidate instances; patterns and instances form a
bipartite graph.  In rounds, a pattern's confidence in a kind is the share of its distinct instances that are seeds of that
kind (shrunk by one instance that is none), and a pattern of confidence ``CONFIDENT`` with ``SUPPORT`` different seeds or
more is trusted: its candidates of the kind's shape become seeds of their best kind for the next round, with all their other
patterns.  The rounds end when no instance is added; a seed stays one.  What trusted patterns find becomes spans of that
kind.  Copies of a text don't add to a pattern, for instances count once.

Only DataFrame functions are used.  Positions are code points, ends exclusive.  Places come from running sums in two levels of
lots (``LOT``), so that a text of many matches costs little more than its length.

Defined results: a null text counts as empty and has no spans; overlapping spans of different kinds all stand; rows with
the same text get the same spans; without seeds there are no patterns; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labourlens.session import stored

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns, with lookbehinds and possessive quantifiers that change no match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Strings that may be identifiers: around an at sign, or groups of digits.
AT_LIKE = r"""(?:(?<![^\s,;<>()"'\[\]@])|\G)[^\s,;<>()"'\[\]@]++@[^\s,;<>()"'\[\]@]++"""
DIGIT_LIKE = r"(?:(?<![0-9])|\G)[0-9]++(?:[\x20()./:-]{1,3}[0-9]++)*+"
SPAN = "struct<start:int,kind:int,end:int>"
FIND = "struct<start:int,end:int,found:string,before:string>"
SUPPORT, CONFIDENT = 5, 0.8
CONTEXT = 64
LOT = 64


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    each = F.transform(F.split(F.reverse(digits(found)), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digit_count(found: Column, least: int, most: int) -> Column:
    return F.length(digits(found)).between(least, most)


#: Per kind: a cheap sign that there may be a match, the pattern, and the check.
BASE: tuple[tuple[Callable[[Column], Column], str, Callable[[Column], Column]], ...] = (
    (lambda t: F.contains(t, F.lit("@")), EMAIL, lambda m: F.lit(True)),
    (lambda t: t.rlike(r"[0-9]\.[0-9]"), IP, lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")),
    (lambda t: t.rlike(r"[0-9]"), CARD, lambda m: _digit_count(m, 14, 19) & luhn(m)),
    (lambda t: F.contains(t, F.lit("+")), PHONE, lambda m: _digit_count(m, 10, 15)),
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lots(values: Column) -> Column:
    """An array, not empty, cut into arrays of ``LOT``."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / LOT).cast("int")), lambda i: F.slice(values, i * LOT + 1, F.lit(LOT)))


def running(values: Column, combine: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """What the elements before each of an array of int combine to, from 0: lots are combined, then each runs on from its start."""
    shape = "struct<at:int,out:array<int>>"

    def run(part: Column, start: Column) -> Column:
        step = lambda acc, v: F.struct(combine(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")).cast(shape)
        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")).cast(shape), step, lambda acc: acc["out"])

    def in_lots(parts: Column) -> Column:
        whole = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), combine))
        return F.flatten(F.zip_with(parts, running(whole, combine, levels - 1), run))

    if not levels:
        return run(values, F.lit(0))
    return bound(values, lambda v: F.when(F.size(v) <= LOT, run(v, F.lit(0))).otherwise(bound(lots(v), in_lots)))


def overlapping(spans: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a test whether a find overlaps one of an array of spans, in order of start: lots are passed over by their extremes."""
    meets = lambda a, f: (a["start"] < f["end"]) & (f["start"] < a["end"])

    def grouped(parts: Column) -> Column:
        return F.transform(parts, lambda p: F.struct(F.element_at(p, 1)["start"].alias("start"), F.array_max(F.transform(p, lambda a: a["end"])).alias("end"), p.alias("parts")))

    def test(tree: Column) -> Callable[[Column], Column]:
        return lambda f: F.exists(tree, lambda x: meets(x, f) & F.exists(x["parts"], lambda y: meets(y, f) & F.exists(y["parts"], lambda z: meets(z, f))))

    return bound(spans, lambda v: F.when(F.size(v) == 0, body(lambda f: F.lit(False))).otherwise(
        bound(grouped(lots(v)), lambda inner: bound(grouped(lots(inner)), lambda tree: body(test(tree))))))


def finds(text: Column, sign: Column, pattern: str) -> Column:
    """All matches of a text with their places and what stands before them, as an array in order.

    The matches and the stretches between them come from the same pattern; running lengths give the places."""
    none = F.array().cast(f"array<{FIND}>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(matches), F.lit(0))).alias("gap"), matches.alias("found"))

    def place(p: Column, before: Column) -> Column:
        start = before + F.length(p["gap"])
        return F.struct(start.alias("start"), (start + F.length(p["found"])).alias("end"), p["found"].alias("found"), F.right(p["gap"], F.lit(CONTEXT)).alias("before")).cast(FIND)

    sizes = lambda ps: F.transform(ps, lambda p: F.length(p["gap"]) + F.length(p["found"]))
    placed = bound(pairs, lambda ps: F.zip_with(ps, running(sizes(ps), lambda a, b: a + b), place))
    return F.when(sign & (F.size(matches) > 0), placed).otherwise(none)


def contexts(before: Column) -> Column:
    """The lexical patterns in the text before a find: its last two words, and its last word if it reads like a label."""
    low = F.lower(before)
    two = F.regexp_extract(low, r"(\S+)\s+(\S+)\s*$", 0)
    label = F.regexp_extract(low, r"(\S+[:=#])\s*$", 1)
    return F.filter(F.array(F.regexp_replace(F.trim(two), r"\s+", " "), F.when(label != "", F.concat(F.lit("* "), label))), lambda c: c.isNotNull() & (c != ""))


def fits(found: Column, kind: int) -> Column:
    """Whether a candidate has the shape of a kind."""
    return (found.contains("@"), found.rlike(r"^[0-9]+(?:[.:][0-9]+){3,7}$"), found.rlike(r"^[0-9 -]+$") & _digit_count(found, 12, 19),
            found.rlike(r"^[0-9 ()./-]+$") & _digit_count(found, 7, 15))[kind]


def _checked(found: str, ok: Callable[[Column], Column]) -> Column:
    return F.filter(found, lambda f: ok(f["found"]))


def _spans(found: str, kind: int) -> Column:
    return F.transform(found, lambda f: F.struct(f["start"].alias("start"), F.lit(kind).alias("kind"), f["end"].alias("end")).cast(SPAN))


def _seeds(found: str, kind: int) -> Column:
    return F.transform(found, lambda f: F.struct(F.lit(kind).alias("kind"), f["found"].alias("found"), contexts(f["before"]).alias("patterns")))


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``base`` (spans, sorted) and ``finds`` (array per kind of checked finds)."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({f"found_{k}": finds(body, sign(body), pattern) for k, (sign, pattern, _) in zip(KINDS, BASE, strict=True)})
    df = df.withColumns({f"found_{k}": _checked(f"found_{k}", ok) for k, (_, _, ok) in zip(KINDS, BASE, strict=True)})
    spans = [_spans(f"found_{k}", i) for i, k in enumerate(KINDS)]
    return df.withColumn("base", F.array_sort(F.concat(*spans)))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """(row: the other columns; digest of the text; base; n_<kind>; seeds; candidates), written down once."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.struct(*[c for c in df.columns if c != text], F.lit(0).alias("_")).alias("row"), F.sha2(body.cast("binary"), 256).alias("digest"), F.col(text).alias("text"))
    rows = base_columns(rows)
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumn("at_like", finds(body, F.contains(body, F.lit("@")), AT_LIKE)).withColumn("digit_like", finds(body, body.rlike("[0-9]"), DIGIT_LIKE))
    seeds = F.concat(*[_seeds(f"found_{k}", i) for i, k in enumerate(KINDS)])
    shaped = lambda f: fits(f["found"], 0) | fits(f["found"], 1) | fits(f["found"], 2) | fits(f["found"], 3)
    others = overlapping(F.col("base"), lambda taken: F.filter(F.filter(F.concat("at_like", "digit_like"), shaped), lambda f: ~taken(f)))
    others = F.transform(others, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["found"].alias("found"), contexts(f["before"]).alias("patterns")))
    return stored(rows.select("row", "digest", "base", *[F.size(f"found_{k}").cast("long").alias(f"n_{k}") for k in KINDS], seeds.alias("seeds"), others.alias("candidates")), "scan")


def fitting(kind: str, found: str) -> Column:
    """Whether a candidate has the shape of a kind that a column names."""
    shape = F.lit(False)
    for i in range(len(KINDS)):
        shape = shape | ((F.col(kind) == i) & fits(F.col(found), i))
    return shape


def learn(scanned: DataFrame) -> DataFrame:
    """(pattern, kind, confidence): the patterns that are trusted, by rounds over the pattern-instance graph.

    An edge carries the kind of its instance, -1 while that is no seed."""
    seeds = scanned.select(F.explode("seeds").alias("s")).select(F.explode("s.patterns").alias("pattern"), F.col("s.found").alias("instance"), F.col("s.kind").alias("kind"))
    others = scanned.select(F.explode("candidates").alias("c")).select(F.explode("c.patterns").alias("pattern"), F.col("c.found").alias("instance"), F.lit(-1).alias("kind"))
    edges = stored(seeds.unionByName(others).distinct(), "edges")
    least = F.lit(SUPPORT)
    while True:
        known = [F.sum((F.col("kind") == i).cast("long")).alias(f"known_{i}") for i in range(len(KINDS))]
        counted = edges.groupBy("pattern").agg(F.count("*").alias("n"), *known)
        per_kind = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"known_{i}").alias("known")) for i in range(len(KINDS))]))
        shares = counted.select("pattern", "n", per_kind.alias("k")).select("pattern", "k.*", (F.col("k.known") / (F.col("n") + 1)).alias("confidence"))
        trusted = stored(shares.filter((F.col("known") >= least) & (F.col("confidence") >= CONFIDENT)).select("pattern", "kind", "confidence"), "patterns")
        found = edges.filter(F.col("kind") < 0).select("pattern", "instance").join(trusted, "pattern").filter(fitting("kind", "instance"))
        # a candidate becomes a seed of one kind: the most confident, the first in a tie
        added = stored(found.groupBy("instance").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("as")), "added")
        if added.isEmpty():
            return trusted
        own = F.when(F.col("kind") < 0, F.coalesce("as", F.lit(-1))).otherwise(F.col("kind"))
        edges = stored(edges.join(added, "instance", "left").select("pattern", "instance", own.alias("kind")).distinct(), "edges")


def discovered(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """(of: digest, extra: spans): what trusted patterns add, per distinct text that gains anything."""
    c = scanned.select("digest", F.explode("candidates").alias("c")).select("digest", "c.*").select("digest", "start", "end", "found", F.explode("patterns").alias("pattern"))
    hit = c.join(patterns, "pattern")
    best = hit.filter(fitting("kind", "found")).groupBy("digest", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    return best.groupBy(F.col("digest").alias("of")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end").cast(SPAN))).alias("extra"))


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, with ``n_<kind>``, ``base`` and ``spans``: arrays of (start, kind, end), sorted, kinds by place in KINDS."""
    columns = [c for c in df.columns if c != text and c not in ("base", "spans", *(f"n_{k}" for k in KINDS))]
    scanned = scan(df.select(*columns, text), text)
    extra = stored(discovered(scanned, learn(scanned)), "extra")
    out = scanned.join(extra, F.col("digest") == F.col("of"), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(f"array<{SPAN}>"))))
    return out.select(*[F.col(f"row.{c}") for c in columns], *[f"n_{k}" for k in KINDS], "base", spans.alias("spans"))


def spelled(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the kind."""
    name = lambda k: F.element_at(F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS]), k + 1)

    def pieces(steps: Column) -> Column:
        """The text before each span and its name, lot by lot, each lot from its own stretch of the text."""
        def of_lot(lot: Column) -> Column:
            base, end = F.element_at(lot, 1)["at"], F.element_at(lot, -1)["span"]["start"]
            return bound(F.substring(text, base + 1, end - base), lambda part: F.array_join(F.transform(lot, lambda p: F.when(
                p["span"]["start"] >= p["at"], F.concat(F.substring(part, p["at"] - base + 1, p["span"]["start"] - p["at"]), name(p["span"]["kind"]))).otherwise("")), ""))
        return F.array_join(F.transform(lots(steps), of_lot), "")

    most = F.array_max(F.transform(spans, lambda s: s["end"]))
    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    built = bound(F.zip_with(spans, ends, lambda s, at: F.struct(s.alias("span"), at.alias("at"))), lambda steps: F.concat(pieces(steps), F.substring(text, most + 1, F.length(text))))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(built)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with all found spans masked in the text.  The learnt spans are joined by the text's digest, and only if there are any."""
    scanned = scan(df, text)
    extra = stored(discovered(scanned, learn(scanned)), "extra")
    columns = [F.col(f"row.{c}").alias(c) if c != text else F.col("text").alias(c) for c in df.columns]
    rows = df.select(F.struct(*[c for c in df.columns if c != text], F.lit(0).alias("_")).alias("row"), F.col(text).alias("text"))
    rows = base_columns(rows).select("row", "text", "base")
    if extra.isEmpty():
        return rows.withColumn("text", masked(F.col("text"), F.col("base"))).select(*columns)
    out = rows.withColumn("digest", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).join(extra, F.col("digest") == F.col("of"), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(f"array<{SPAN}>"))))
    return out.withColumn("text", masked(F.col("text"), spans)).select(*columns)
