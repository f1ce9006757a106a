"""Word tokens and n-grams, the same in Python (dictionaries) and Spark (texts)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word with inner dots and trailing + or # ("node.js", "c++"), or one other visible sign.
SPARK_TOKEN = r"([\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*[+#]*|[^\s\p{L}\p{N}_])"
PYTHON_TOKEN = re.compile(r"\w+(?:\.\w+)*[+#]*|[^\s\w]")
MIN_PIECE = 3


def python_tokens(text: str) -> list[str]:
    return PYTHON_TOKEN.findall(text.lower())


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(SPARK_TOKEN), 1)


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of ``n`` tokens."""
    if n == 1:
        return words
    out = words
    for shift in range(1, n):
        tail = F.slice(words, shift + 1, F.greatest(F.size(words) - shift, F.lit(0)))
        out = F.zip_with(F.slice(out, 1, F.size(tail)), tail, lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def ngrams_up_to(words: Column, n: int) -> Column:
    return F.concat(*[ngrams(words, i) for i in range(1, n + 1)]) if n > 1 else words


def pieces(words: Column) -> Column:
    """Parts of dotted words ("python.django"), without the very short ones ("js")."""
    dotted = F.filter(words, lambda w: F.contains(w, F.lit(".")))
    parts = F.flatten(F.transform(dotted, lambda w: F.split(w, r"\.")))
    return F.filter(parts, lambda p: F.length(p) >= MIN_PIECE)
