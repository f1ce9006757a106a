"""Toxicity by compression distance: is a window of text closer to toxic or to ordinary text?

Two zstandard dictionaries are trained, one on toxic and one on ordinary text; both end in the same ordinary base, so that
they differ by their trained parts alone.  A window (about ``WINDOW`` bytes, cut at spaces) is compressed with each; the
difference of the two lengths is its gain.  Most of a toxic document is ordinary, so training goes in rounds: the toxic part
is first taken from whole toxic documents, then from those windows of toxic documents that it compressed best, measured by
dictionaries trained on the other half of the documents.

A document's score is a calibrated probability: logistic regression, fitted to the labelled documents, on the largest gain,
the mean gain and the share of windows whose gain passes a threshold that few ordinary windows pass.

The fit uses at most ``SAMPLE`` labelled documents of each class, chosen by a hash of the id; an id with several texts gives
its further ones (``TEXTS`` at most) only after the first of all chosen ids.  Every window of every document is scored.  Defined results: null and empty texts have no window and get the score of the features' zeros; without
labels of both classes all documents get the share of toxic labels (0 without labels); repeated rows repeat their score;
label rows that are null, not 0 or 1, or of no document count not at all, repeated ones
once; an id of both labels counts in both classes.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labourlens.session import stored

SAMPLE = 2_500
TEXTS = 1_000  # Spark limits a rank inside each task up to this number
WINDOW = 160
PART = 8_000
BASE = 64_000
ROUNDS = 1
LEAST = 3
TIMES = 30
LEVEL = 6


def windows(data: bytes, width: int = WINDOW) -> list[bytes]:
    """The text in pieces of at most ``width`` bytes, cut behind a space where there is one."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = at + width
        if end < n:
            cut = data.rfind(b" ", at + width // 2, end)
            end = cut + 1 if cut >= 0 else end
        out.append(data[at:end])
        at = end
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    # tables large enough that no position of the dictionary pushes out another: else the two parts would also change what is found in the base
    p = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=5, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


class Pair:
    """The two dictionaries, ready to compress."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)

    def gains(self, pieces: list[bytes]) -> np.ndarray:
        a, b = self.ordinary.compress, self.toxic.compress
        return np.array([len(a(w)) - len(b(w)) for w in pieces], np.float64)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    limit: float
    weights: np.ndarray  # of the features, the last one the constant
    prior: float
    fitted: bool

    def features(self, gains: np.ndarray) -> np.ndarray:
        if not len(gains):
            return np.zeros(4)
        over = gains[gains >= self.limit]
        return np.array([min(gains.max(), 24.0), gains.mean(), len(over) / len(gains), np.log1p(over.sum())])

    def score(self, pair: Pair, text: str) -> float:
        f = self.features(pair.gains(windows(text.encode())))
        return float(1 / (1 + np.exp(-np.clip(f @ self.weights[:-1] + self.weights[-1], -30, 30))))


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary's content of about ``size`` bytes; small samples, which the trainer refuses, are joined."""
    if sum(map(len, samples)) > size:
        try:
            d = zstandard.train_dictionary(size, samples, k=24, d=6, level=LEVEL).as_bytes()
            return d[-size:]
        except zstandard.ZstdError:
            pass
    return b" ".join(samples)[:size]


def own_words(docs: list[list[bytes]], other: list[list[bytes]]) -> list[bytes]:
    """Per document, the words that the class uses in many places and ``TIMES`` as often as the other class.

    Often means the share of documents with the word, so that a few wrong labels or quoting documents don't take a word away.
    Words that both classes use compress alike under either dictionary, and the rare words of a passage teach nothing: both
    would only fill a dictionary with chance matches.  Places are counted as different left neighbours, so that a word of a
    passage with many copies counts once."""
    held = [[w for window in doc for w in window.split()] for doc in docs]
    places = Counter(w for w, _ in {pair for words in held for pair in zip(words[1:], words, strict=False)})
    least = max(LEAST, len(docs) // 100)
    here, there = _documents_with(docs), _documents_with(other)
    rare = {w for w in here if here[w] * len(other) >= TIMES * there[w] * len(docs)}
    own = [[w for w in dict.fromkeys(words) if places[w] >= least and w in rare] for words in held]
    return [b" " + b" ".join(words) + b" " for words in own if words]


def _documents_with(docs: list[list[bytes]]) -> Counter:
    """Per word, the number of documents that have it."""
    return Counter(w for doc in docs for w in {w for window in doc for w in window.split()})


def _parts(toxic: list[list[bytes]], ordinary: list[list[bytes]], base: bytes) -> tuple[bytes, bytes]:
    """Both contents: the trained part, then the base.  The part stands farther off, so that it is used only for what the
    base lacks, and distances into the base are the same for both."""
    t, o = trained(own_words(toxic, ordinary), PART), trained(own_words(ordinary, toxic), PART)
    return t + base, o + base


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights and a constant, by Newton's method with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = penalty * len(x) * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w = w + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    prior = len(toxic) / max(1, len(toxic) + len(ordinary))
    tox, ord_ = ([windows(t.encode()) for t in texts if t] for texts in (toxic, ordinary))
    if len(tox) < 2 or len(ord_) < 2:
        return Model(b"", b"", 1.0, np.array([0, 0, 0, 0, np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))]), prior, False)
    base = trained([w for d in ord_[: len(ord_) // 2] for w in d], BASE)
    halves = [(tox[0::2], ord_[0::2]), (tox[1::2], ord_[1::2])]
    chosen = [t for t, _ in halves]  # per half: windows by document, at first all of them
    for step in range(ROUNDS):
        pairs = [Pair(*_parts(chosen[h], halves[h][1], base)) for h in (0, 1)]
        picked = []
        for h in (0, 1):
            keep = []
            for doc in halves[h][0]:
                g = pairs[1 - h].gains(doc)
                n = max(1, len(doc) // (4 if step else 3))
                keep.append([doc[i] for i in np.argsort(-g, kind="stable")[:n]])
            picked.append(keep)
        chosen = picked
    # the calibration's gains come from dictionaries that haven't seen the document
    final = _parts(chosen[0] + chosen[1], ord_, base)
    cross = [Pair(*_parts(chosen[h], halves[h][1], base)) for h in (0, 1)]
    gains, y = [], []
    for h in (0, 1):
        for label, docs in ((1, halves[h][0]), (0, halves[h][1])):
            gains += [cross[1 - h].gains(d) for d in docs]
            y += [label] * len(docs)
    calm = np.concatenate([g for g, label in zip(gains, y, strict=True) if not label])
    model = Model(*final, limit=max(2.0, float(np.quantile(calm, 0.995)) + 1), weights=np.zeros(5), prior=prior, fitted=True)
    x = np.array([model.features(g) for g in gains])
    model.weights = logistic(x, np.array(y, float))
    return model


def with_prior(model: Model, toxic: int, ordinary: int) -> Model:
    """The model for so many documents of each class, where its sample held another share of them: the calibration is moved by
    the difference, so that a score does not depend on how the sample was cut."""
    odds = lambda p: np.log(max(p, 1e-9) / max(1 - p, 1e-9))
    prior = toxic / max(1, toxic + ordinary)
    weights = model.weights.copy()
    weights[-1] += odds(prior) - odds(model.prior)
    return replace(model, prior=prior, weights=weights)


def learns(key: Column) -> Column:
    """Rows whose label may be learnt from."""
    return F.crc32(key.cast("string")) % 4 != 2


def fit_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents of each class; the bounded sample is the only thing collected."""
    bodies = docs.select(F.col(key).alias("own"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    usable = labels.filter(F.col(key).isNotNull() & learns(F.col(key)) & F.col(label).isin(0, 1)).select(F.col(key).alias("own"), F.col(label).cast("int").alias("label"))
    usable = usable.distinct().join(bodies.select("own").distinct(), "own", "left_semi")

    def first(df: DataFrame, *order: Column | str) -> DataFrame:
        by_class = [df.filter(F.col("label") == v).orderBy(*order).limit(sample) for v in (1, 0)]
        return stored(by_class[0].unionByName(by_class[1]), "sample")

    n_toxic, n_ordinary = (usable.filter(F.col("label") == v).count() for v in (1, 0))  # before the sample cuts each class by itself
    ids = first(usable, F.xxhash64("own"), "own")
    # copies meet as one digest in the tasks that read them, so that neither they nor a crowd of texts under one id travel
    held = bodies.join(F.broadcast(ids), "own").withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    place = F.row_number().over(Window.partitionBy("own", "label").orderBy("digest"))
    ranked = held.select("own", "label", "digest").distinct().withColumn("place", place).filter(F.col("place") <= TEXTS)
    texts = first(ranked, "place", F.xxhash64("own"), "own", "digest").drop("place")
    found = {tuple(r) for r in held.join(F.broadcast(texts), ["own", "label", "digest"]).select("own", "label", "body").distinct().collect()}
    pick = lambda v: [t for _, x, t in sorted(found) if x == v]
    model = fit(pick(1), pick(0))
    return model and with_prior(model, n_toxic, n_ordinary)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a probability of being toxic."""

    @F.pandas_udf("double")
    def run(batches: "pd.Series") -> "pd.Series":
        if not model.fitted:
            return pd.Series([model.prior] * len(batches), dtype="float64")
        pair = Pair(model.toxic, model.ordinary)
        return pd.Series([model.score(pair, t or "") for t in batches], dtype="float64")

    return docs.withColumn(into, run(F.col(text)))
