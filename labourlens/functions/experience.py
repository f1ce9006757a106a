"""Free-text work experience to years and a seniority bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labourlens.dictionaries import EXPERIENCE_BINS, EXPERIENCE_CENTRES, EXPERIENCE_EDGES
from labourlens.functions.text import col, folded, let

# --- fixed values ---------------------------------------------------------------
NUM = r"(\d+(?:\.\d+)?)"
YEARS = r"\s*(?:năm|nam|year|yr)"
ZERO = (r"fresher|new\s*grad|mới\s*ra\s*trường|chưa\s*có\s*kinh\s*nghiệm|no\s*experience"
        r"|(?<![\d.])0\s*năm")
ZERO_UNACCENTED = r"moi\s*ra\s*truong|chua\s*co\s*kinh\s*nghiem|(?<![\d.])0\s*nam"
RANGE = NUM + r"\s*[-–—]\s*" + NUM + YEARS
FROM = r"(?:từ|tu|from|min)\s*" + NUM + r"\s*(?:năm|nam|year|yr|tuổi|\+)"
UP_TO = r"(?:tới|toi|đến|den|up\s*to|max|dưới|duoi|under)\s*" + NUM + YEARS
PLUS = NUM + r"\s*\+" + YEARS
PLAIN = NUM + r"\s*(?:năm|nam|year|yr|tuổi)"


def years(source: str | Column) -> Column:
    """Years of experience; null when the text says nothing readable."""
    def read(text: Column) -> Column:
        def value(pattern: str, index: int = 1) -> Column:
            return F.regexp_extract(text, pattern, index).try_cast("double")

        return (
            F.when(text.rlike(ZERO), F.lit(0.0))
            .when(text.rlike(RANGE), (value(RANGE, 1) + value(RANGE, 2)) / 2)
            .when(text.rlike(FROM), value(FROM))
            .when(text.rlike(UP_TO), value(UP_TO) / 2)
            .when(text.rlike(PLUS), value(PLUS))
            .when(text.rlike(PLAIN), value(PLAIN))
            .when(text.rlike(ZERO_UNACCENTED), F.lit(0.0))
        )
    return let(folded(source), read)


def experience_bin(value: str | Column, missing: str = "unknown") -> Column:
    """Half-open bins; a negative value falls through to the last one."""
    def binned(y: Column) -> Column:
        out = F.when(y.isNull(), F.lit(missing))
        low = 0.0
        for edge, label in zip(EXPERIENCE_EDGES, EXPERIENCE_BINS):
            out = out.when((y >= low) & (y < edge), F.lit(label))
            low = edge
        return out.otherwise(F.lit(EXPERIENCE_BINS[-1]))
    return let(col(value), binned)


def nearest_bin(value: float) -> str:
    """Bin whose centre is closest to a number of years; the lower one on a tie."""
    return min(EXPERIENCE_CENTRES, key=lambda label: abs(EXPERIENCE_CENTRES[label] - value))


def mixed_years(source: str | Column) -> Column:
    """A column that holds plain numbers or text."""
    c = col(source)
    return F.coalesce(F.trim(c).try_cast("double"), years(c))


def cascade_years(field: str | Column, description: str | Column) -> Column:
    """The field if it says anything, else the description."""
    return F.coalesce(mixed_years(field), years(description))


def normalize_experience(df: DataFrame, source: str = "experience_raw") -> DataFrame:
    return df.withColumn("experience_years", years(source)).withColumns({
        "experience_bin": experience_bin("experience_years"),
        "experience_parsed": F.col("experience_years").isNotNull(),
    })
