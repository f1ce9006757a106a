"""Free-text salary to typed columns, in million VND per month."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labourlens.functions.text import contains_any, floor_round, folded, let, lookup

# --- fixed values -------------------------------------------------------------
HIDDEN_WORDS = [
    "cạnh tranh", "thỏa thuận", "thoả thuận", "thoa thuan", "negotiable", "face.?to.?face", "f2f",
    "liên hệ", "lien he", "contact", "đề xuất", "de xuat", "theo năng lực", "theo nang luc",
    "tùy kinh nghiệm", "tuy kinh nghiem", "based on experience", "updated", "cập nhật", "cap nhat",
    "chính sách", "chinh sach",
]
UNIT_MULTIPLIERS = {
    "triệu": 1.0, "trieu": 1.0, "tr": 1.0, "m": 1.0, "million": 1.0,
    "nghìn": 0.001, "nghin": 0.001, "k": 0.001, "ngàn": 0.001, "ngan": 0.001,
    "tỷ": 1000.0, "ty": 1000.0, "billion": 1000.0,
}
USD_TO_VND = 25_000.0
UP_TO_FACTOR = 0.7
FROM_FACTOR = 1.3

NUM = r"(\d[\d.,]*)"
DASH = r"\s*[-–—]\s*"
UNIT = "(" + "|".join(sorted(UNIT_MULTIPLIERS, key=len, reverse=True)) + ")"
YEAR = r"\s*/\s*(?:năm|nam|year)"
MONTH = r"(?:\s*/\s*(?:tháng|thang|month))?"
OVER = r"(?:trên|tren|hơn|hon|from|over)"
UP_TO = r"(?:tới|đến|toi|den|tối đa|toi da|max|up\s*to)"
FROM = r"(?:từ|tu|min|tối thiều|tối thiểu|toi thieu)"


@dataclass(frozen=True)
class Form:
    """One way of writing a salary; group numbers are 0 where a part is absent."""

    name: str
    salary_type: str
    pattern: str
    low: int = 0
    high: int = 0
    low_unit: int = 0
    high_unit: int = 0
    confidence: float = 0.9
    usd: bool = False
    per_year: bool = False

    def matches(self, text: Column) -> Column:
        """Cheap substring test first: most texts name neither a year nor dollars."""
        found = text.rlike(self.pattern)
        needs = ["/"] if self.per_year else ["usd", "$"] if self.usd else []
        return contains_any(text, needs) & found if needs else found


# Order of trial: the first form found anywhere in the text wins.
FORMS = [
    Form("year_range", "yearly", NUM + DASH + NUM + r"\s*" + UNIT + "?" + YEAR, 1, 2, 3, 3, 0.9, per_year=True),
    Form("year_single", "yearly", NUM + r"\s*" + UNIT + "?" + YEAR, 1, 0, 2, 0, 0.8, per_year=True),
    Form("usd_lead", "usd", r"\$" + NUM + DASH + r"\$?" + NUM, 1, 2, usd=True),
    Form("usd_tail", "usd", NUM + DASH + r"\$?" + NUM + r"\s*(?:usd|\$)", 1, 2, usd=True),
    Form("usd_up_to", "usd", UP_TO + r"\s*\$?" + NUM + r"\s*(?:usd|\$)", 0, 1, confidence=0.8, usd=True),
    Form("usd_both", "range", NUM + r"\s*(?:usd|\$)" + DASH + r"\$?" + NUM, 1, 2, usd=True),
    Form("usd_single", "usd", NUM + r"\s*(?:usd|\$)", 1, 0, confidence=0.8, usd=True),
    Form("from_to", "range", FROM + r"\s*" + NUM + r"\s*" + UNIT + r"?\s*(?:đến|den|tới|toi|to)\s*" + NUM + r"\s*" + UNIT + "?",
         1, 3, 2, 4),
    Form("range", "range", NUM + DASH + NUM + r"\s*" + UNIT + "?", 1, 2, 3, 3),
    Form("range_units", "range", NUM + r"\s*" + UNIT[:-1] + "|usd|đ)" + DASH + NUM + r"\s*" + UNIT[:-1] + "|usd|đ)?", 1, 3, 2, 4),
    Form("over", "from", OVER + r"\s*" + NUM + r"\s*" + UNIT + "?", 1, 0, 2, 0, 0.8),
    Form("up_to", "up_to", UP_TO + r"\s*" + NUM + r"\s*" + UNIT + "?", 0, 1, 0, 2, 0.8),
    Form("from", "from", FROM + r"\s*" + NUM + r"\s*" + UNIT + "?", 1, 0, 2, 0, 0.8),
    Form("single", "single", "^" + NUM + r"\s*" + UNIT + "?" + MONTH + r"(?:\s*vnđ?)?$", 1, 1, 2, 2, 0.7),
]


def number(text: Column) -> Column:
    """Number token to double: grouped thousands in either style, a comma before
    one or two digits is a decimal mark, anything else unreadable is 0."""
    commas = text.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$")
    dots = text.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$")
    decimal_comma = text.rlike(r"^\d+,\d{1,2}$")
    cleaned = (
        F.when(commas, F.regexp_replace(text, ",", ""))
        .when(dots, F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", "."))
        .when(decimal_comma, F.regexp_replace(text, ",", "."))
        .otherwise(F.regexp_replace(text, ",", ""))
    )
    return F.coalesce(cleaned.try_cast("double"), F.lit(0.0))


def unit_multiplier(unit: Column) -> Column:
    table = {k: str(v) for k, v in UNIT_MULTIPLIERS.items()}
    return F.coalesce(lookup(table, unit).try_cast("double"), F.lit(1.0))


def _groups(text: Column, form: Column) -> Column:
    """``[low, high, low_unit, high_unit]`` as written in the form that matched."""
    out = None
    for f in FORMS:
        parts = F.array(*[
            F.regexp_extract(text, f.pattern, i) if i else F.lit(None).cast("string")
            for i in (f.low, f.high, f.low_unit, f.high_unit)])
        out = (F if out is None else out).when(form == f.name, parts)
    return out


def parse_salary(source: str | Column, usd_rate: float = USD_TO_VND) -> Column:
    """``struct<salary_min, salary_max, salary_mid, salary_hidden, salary_type, salary_confidence>``.

    First the form is named, then its groups are pulled, then the arithmetic is
    done; each step is bound once, so no pattern runs twice on a row.
    """
    usd_forms = [f.name for f in FORMS if f.usd]
    year_forms = [f.name for f in FORMS if f.per_year]

    def amounts(form: Column, g: Column) -> Column:
        low_unit, high_unit = F.coalesce(g[2], F.lit("")), F.coalesce(g[3], F.lit(""))
        is_usd = form.isin(*usd_forms) | (low_unit == "usd") | (high_unit == "usd")
        # "8 tr - 12": the unit of one end serves for both.
        spread = form.isin("range_units", "from_to")
        low_eff = F.when(spread & (low_unit == ""), high_unit).otherwise(low_unit)
        high_eff = F.when(spread & (high_unit == ""), low_unit).otherwise(high_unit)

        def million(raw: Column, unit: Column) -> Column:
            value = (
                F.when(is_usd, number(raw) * F.lit(usd_rate) / 1e6)
                .when(unit.isin("", "đ") & (number(raw) >= 1e6), number(raw) / 1e6)  # written out in full
                .otherwise(number(raw) * unit_multiplier(unit))
            )
            return F.when(raw.isNotNull(), F.when(form.isin(*year_forms), value / 12).otherwise(value))
        return F.struct(million(g[0], low_eff).alias("a"), million(g[1], high_eff).alias("b"))

    def result(form: Column, x: Column) -> Column:
        a, b = x["a"], x["b"]
        both = a.isNotNull() & b.isNotNull()
        mid = (
            F.when(both, (a + b) / 2)
            .when(form.isin("over", "from"), a * FROM_FACTOR)
            .when(a.isNotNull(), a)
            .when(b.isNotNull(), b * UP_TO_FACTOR)
        )
        kinds = {"hidden": "hidden"} | {f.name: f.salary_type for f in FORMS}
        sure = {"hidden": "0.95"} | {f.name: str(f.confidence) for f in FORMS}
        return F.struct(
            floor_round(F.when(both, F.least(a, b)).otherwise(a), 1).alias("salary_min"),
            floor_round(F.when(both, F.greatest(a, b)).otherwise(b), 1).alias("salary_max"),
            floor_round(mid, 1).alias("salary_mid"),
            F.coalesce(form == "hidden", F.lit(False)).alias("salary_hidden"),
            F.coalesce(lookup(kinds, form), F.lit("unknown")).alias("salary_type"),
            F.coalesce(lookup(sure, form).cast("double"), F.lit(0.0)).alias("salary_confidence"),
        )

    def with_text(text: Column) -> Column:
        form = F.when(text.rlike("|".join(HIDDEN_WORDS)), "hidden")
        for f in FORMS:
            form = form.when(f.matches(text), f.name)
        return let(form, lambda name: let(_groups(text, name), lambda g: let(
            amounts(name, g), lambda x: result(name, x))))

    return let(folded(source), with_text)


def normalize_salary(df: DataFrame, source: str = "salary_raw", usd_rate: float = USD_TO_VND) -> DataFrame:
    """Add ``salary_min, salary_max, salary_mid, salary_hidden, salary_type,
    salary_confidence`` for the text column ``source``.

    The struct comes out of a one-element ``inline``, so later filters on its
    fields stay above it and the text is parsed exactly once per row.
    """
    fields = ["salary_min", "salary_max", "salary_mid", "salary_hidden", "salary_type", "salary_confidence"]
    return df.drop(*fields).select("*", F.inline(F.array(parse_salary(source, usd_rate))))


def bounds_mid(low: str | Column = "salary_min", high: str | Column = "salary_max") -> Column:
    """Midpoint of the known bounds: average, else the one that is known."""
    lo = F.col(low) if isinstance(low, str) else low
    hi = F.col(high) if isinstance(high, str) else high
    return F.coalesce((lo + hi) / 2, lo, hi)


def has_salary(low: str = "salary_min", high: str = "salary_max") -> Column:
    return F.col(low).isNotNull() | F.col(high).isNotNull()


def range_text(min_amount: Column, max_amount: Column) -> Column:
    """Amounts in VND written as a range in million, e.g. ``30-45 triệu``."""
    def part(c: Column) -> Column:
        return F.format_string("%d", F.floor(F.coalesce(c, F.lit(0)) / 1e6 + 0.5).cast("long"))
    return F.concat(part(min_amount), F.lit("-"), part(max_amount), F.lit(" triệu"))


def unparsed(df: DataFrame, source: str = "salary_raw") -> DataFrame:
    """Rows with text that no form explains, for review."""
    return df.where((F.col("salary_type") == "unknown") & (F.trim(F.col(source)) != ""))
