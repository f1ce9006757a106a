"""License scans against plain loops over every block, template and place."""

import random
import re

import pytest
from pyspark.sql import functions as F

from labourlens.llm import license_scan, queries

TEXTS = [text for _, text in license_scan.TEMPLATES]


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected(text, templates=license_scan.TEMPLATES, containment=90):
    w = words(text)
    base, places = set(), []
    for label, phrase in license_scan.PHRASES.items():
        p = words(phrase)
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    found = set()
    for k, (label, template) in enumerate(templates):
        t = words(template)
        if not t:
            continue
        size = next(x for x in (4, 8, 16, 32, 64, 128, 256, 512) if x >= len(t))
        for s in range(0, len(w), size):
            common = len(set(t) & set(w[s : s + 2 * size]))
            if (s == 0 or s + size < len(w)) and 100 * common >= containment * len(set(t)):
                found.add((s, k, label, common / len(set(t))))
    score = 1.0 if base else max((x[3] for x in found), default=0.0)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {x[2] for x in found})), score, sorted(found))


def check(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = license_scan.scan(df, **how).collect()
    assert len(got) == len(texts)
    for r in got:
        plain = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, [tuple(x) for x in r.found])
        assert plain == expected(texts[r.doc_id], **how), texts[r.doc_id][:200]
    return {r.doc_id: r for r in got}


def test_every_notice_in_other_text(spark):
    rnd = random.Random(5)
    filler = "the of and this is under to you work terms free software any copy für née 東京 x1".split()
    texts = []
    for text in TEXTS:
        for _ in range(4):
            w = text.split()
            if rnd.random() < 0.5:  # a word lost, doubled or replaced
                w[rnd.randrange(len(w))] = rnd.choice(["", "and", "zzz"])
            before, after = rnd.choices(filler, k=rnd.randrange(60)), rnd.choices(filler, k=rnd.randrange(60))
            texts.append(" ".join(before) + "\n" + rnd.choice([" ", "\n", ", "]).join(w).upper() + "\n" + " ".join(after))
        texts.append(" ".join(rnd.choices(filler, k=200)))
    got = check(spark, texts)
    assert sum(bool(r.labels) for r in got.values()) > len(TEXTS) * 2 and any(r.labels and not r.base_labels for r in got.values())
    assert all(not got[i].labels for i in range(4, len(texts), 5))


def test_nulls_empty_repeats_and_ties(spark):
    texts = [None, "", "  \n", "...", "All rights reserved.", "all RIGHTS\nreserved, all rights reserved", "reserved rights all", "rights", "cc by-nc",
             "Straße CC-BY", "ACC BY", "ÀCC BY", "Released under the MIT License."] + ["Licensed under CC BY-NC 4.0."] * 30
    got = check(spark, texts)
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (2, 0, 3) and got[11].n_base == 0 and got[12].labels == "mit"
    assert got[6].labels == "reserved" and got[6].base_labels == "" and got[20].labels == "cc-by,cc-by-nc-4.0"


@pytest.mark.parametrize("containment", [50, 70, 100])
def test_other_containments_and_templates(spark, containment):
    rnd = random.Random(containment)
    letters = "abcdefghij"
    templates = [(f"t{k % 5}", " ".join(rnd.choices(letters, k=rnd.randint(1, 9)))) for k in range(12)] + [("none", "!!"), ("none", "")]
    texts = [" ".join(rnd.choices(letters + "xyz", k=rnd.randint(0, 60))) for _ in range(80)]
    check(spark, texts, templates=templates, containment=containment)


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "PIECE", 1000)  # many pieces, cut between words
    text = ("license the " * 20_000 + "w" * 5000 + " Released under the\nMIT License " + "the software of " * 40_000 + "all rights reserved")
    got = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_words == 40_000 + 1 + 5 + 120_000 + 3 and (got.n_base, got.first_word, got.labels) == (1, 160_006, "mit,reserved")


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "All rights reserved", "a", "b", 3)], "doc_id long, text string, score string, row string, rid int")
    assert license_scan.scan(df.limit(0)).collect() == []
    out = license_scan.scan(df)
    assert out.columns == ["doc_id", "row", "rid", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"]
    assert license_scan.scan(df.select("text")).first().labels == "reserved" and out.first().rid == 3


def test_query(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.op11_license_scan(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text")).collect():
        assert tuple(rows[r.doc_id])[1:] == expected(r.text)[:-1]
