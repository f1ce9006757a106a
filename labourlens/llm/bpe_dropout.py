"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text becomes symbols (its characters, each space shown as U+2581, one such mark in front).  An agenda holds the adjacent
pairs that are pieces of the model; the best-scored pair (leftmost among equals) is taken off again and again.  With dropout,
a taken candidate is skipped for good when a keyed hash of (seed, text key, start, split, end) falls under the rate; a
skipped candidate comes back only as a different pair.  With rate 0 the result is the model's own segmentation.

No piece holds a mark after another character, so the text falls into independent words (marks, then characters), and the
words of many texts are processed together: one numpy step takes the best pair of every word.  Words of more than
``WIDEST`` symbols use the plain agenda ``encode_word``, which is also what the tests compare with.

A character that the model lacks becomes its UTF-8 byte pieces; so does a literal U+2581, which would otherwise come back
as a space.  Decoding joins the pieces' bytes and takes off the leading space: every text comes back exactly.

Defined results: a null text has null ids and a null decoding; an empty text has no ids; rows are independent of each
other, so repeated rows with one key repeat their result, in any order and under any partitioning.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
WIDEST = 48
#: Characters handled in one numpy step; bounds a worker's memory whatever the batch holds.
STEP_CHARS = 1_000_000
NONE = np.int32(2**31 - 1)
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-stirred 64-bit image of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def read_model(path: str) -> tuple[list[str], list[float]]:
    """Pieces and scores of a BPE model file with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    if not all(sp.is_byte(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
        raise ValueError("the model has no byte pieces, so it can't encode every text")
    return pieces, [sp.get_score(i) for i in range(sp.vocab_size())]


class Model:
    """Lookup tables of a model: characters to ids, and pairs of ids to the id of the joined piece."""

    def __init__(self, pieces: list[str], scores: list[float]):
        control = {"<unk>", "<s>", "</s>"}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if len(p) == 6 and p.startswith("<0x")}
        skip = set(self.byte_id.values()) | {i for i, p in enumerate(pieces) if p in control}
        ids = {p: i for i, p in enumerate(pieces) if i not in skip}
        # A pair's priority is the rank of the joined piece by score; ids of equal score keep their order.
        merged = sorted((i for p, i in ids.items() if len(p) > 1), key=lambda i: (-scores[i], i))
        self.of_rank = np.array(merged, np.int32)
        rank = {i: r for r, i in enumerate(merged)}
        self.pairs = {(ids[p[:k]], ids[p[k:]]): rank[i] for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.size = len(pieces)
        keys = np.array([a * self.size + b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        ranks = np.array(list(self.pairs.values()), np.int32)[order]
        self._levels(keys[order], ranks)
        self.char_id = {p: i for p, i in ids.items() if len(p) == 1}
        self.char_table = np.full(0x110000, -1, np.int32)
        for c, i in self.char_id.items():
            self.char_table[ord(c)] = i
        self.bytes_of = [bytes([int(p[3:5], 16)]) if i in skip and p.startswith("<0x") else b"" if i in skip else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]

    def _levels(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Hash tables tried one after another; a key that finds its slot taken goes to the next table."""
        self.levels, bits = [], 19
        while len(keys):
            slot = self._slot(keys, len(self.levels), bits)
            table, value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
            table[slot], value[slot] = keys, ranks
            self.levels.append((table, value, bits))
            lost = table[slot] != keys
            keys, ranks, bits = keys[lost], ranks[lost], max(12, bits - 3)

    @staticmethod
    def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) + np.uint64(level + 1)) * GOLD >> np.uint64(64 - bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each joined pair, ``NONE`` where the joined string is no piece (or a side is -1)."""
        keys = left.astype(np.int64) * self.size + right
        out = np.full(len(keys), NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        for k, (table, value, bits) in enumerate(self.levels):
            key = keys[at]
            slot = self._slot(key, k, bits)
            there = table[slot]
            hit = there == key
            out[at[hit]] = value[slot[hit]]
            at = at[~hit & (there >= 0)]  # an empty slot: the pair is in no table
            if not len(at):
                break
        return out


def kept(word: np.ndarray, start: np.ndarray, split: np.ndarray, end: np.ndarray, limit: np.uint64) -> np.ndarray:
    """Whether the candidate [start, split) + [split, end) of a word survives; ``word`` is the word's keyed hash."""
    spot = (start.astype(np.uint64) << np.uint64(42)) ^ (split.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
    return mix(word ^ spot * GOLD) >= limit


def encode_word(model: Model, symbols: list[int], word: int, limit: int) -> list[int]:
    """The agenda itself, for one word: a heap of (rank, start, split, end)."""
    n = len(symbols)
    sym, end, prev = list(symbols), list(range(1, n + 1)), list(range(-1, n))
    heap: list[tuple[int, int, int, int]] = []
    w, lim = np.array([word], np.uint64), np.uint64(limit)

    def offer(a: int, b: int) -> None:
        r = model.pairs.get((sym[a], sym[b])) if sym[a] >= 0 and sym[b] >= 0 else None
        if r is not None:
            heapq.heappush(heap, (r, a, b, end[b]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        r, a, b, e = heapq.heappop(heap)
        if sym[a] is None or end[a] != b or sym[b] is None or end[b] != e:
            continue  # one of its sides has been joined to something else
        if limit and not kept(w, np.array([a]), np.array([b]), np.array([e]), lim)[0]:
            continue
        sym[a], sym[b], end[a] = int(model.of_rank[r]), None, e
        if e < n:
            prev[e] = a
        if prev[a] >= 0:
            offer(prev[a], a)
        if e < n:
            offer(a, e)
    return [i for i, s in enumerate(sym) if s is not None], [s for s in sym if s is not None]


def _merge(model: Model, sym: np.ndarray, word: np.ndarray, limit: np.uint64) -> np.ndarray:
    """Symbols [width, words], -1 beyond a word's end; returns them after all merges, -1 where a symbol went into its left."""
    width, total = sym.shape
    result = sym.copy()
    cols = np.arange(total)
    rows = np.arange(width + 1, dtype=np.int64)[:, None]
    nxt = np.broadcast_to(rows[1:], sym.shape).astype(np.int16).copy()
    prv = np.broadcast_to(rows[:-1] - 1, sym.shape).astype(np.int16).copy()
    shift = np.int32(64)  # keys are rank * 64 + start: the smallest is the best pair, leftmost among equals
    key = np.full(sym.shape, NONE, np.int32)
    rank = model.rank(sym[:-1].ravel(), sym[1:].ravel()).reshape(width - 1, total) if width > 1 else np.zeros((0, total), np.int32)
    a, c = np.nonzero(rank != NONE)
    if limit:
        ok = kept(word[c], a, a + 1, a + 2, limit)
        a, c = a[ok], c[ok]
    key[a, c] = rank[a, c] * shift + a.astype(np.int32)
    sym = result
    while len(cols):
        best = key.min(axis=0)
        live = best != NONE
        if live.mean() < 0.7:  # finished words leave, so that each step costs what is left of the work
            result[:, cols] = sym
            cols, best = cols[live], best[live]
            sym, key, nxt, prv, word = sym[:, live], key[:, live], nxt[:, live], prv[:, live], word[live]
            if not len(cols):
                return result
            at = np.arange(len(cols))
        else:
            at = np.flatnonzero(live)
            best = best[at]
        left = (best & 63).astype(np.int64)
        joined = model.of_rank[best >> 6]
        right = nxt[left, at].astype(np.int64)
        after = nxt[right, at].astype(np.int64)
        before = prv[left, at].astype(np.int64)
        sym[left, at], sym[right, at] = joined, -1
        key[right, at] = NONE
        key[left, at] = NONE
        nxt[left, at] = after
        inside = after < width
        prv[after[inside], at[inside]] = left[inside]
        # the two candidates that the new symbol makes
        if inside.any():
            x, y, z = left[inside], after[inside], at[inside]
            r = model.rank(joined[inside], sym[y, z])
            ok = r != NONE
            x, y, z, r = x[ok], y[ok], z[ok], r[ok]
            if limit:
                ok = kept(word[z], x, y, nxt[y, z], limit)
                x, y, z, r = x[ok], y[ok], z[ok], r[ok]
            key[x, z] = r * shift + x.astype(np.int32)
        has = before >= 0
        if has.any():
            x, y, z, e = before[has], left[has], at[has], after[has]
            key[x, z] = NONE
            r = model.rank(sym[x, z], joined[has])
            ok = r != NONE
            x, y, z, e, r = x[ok], y[ok], z[ok], e[ok], r[ok]
            if limit:
                ok = kept(word[z], x, y, e, limit)
                x, z, r = x[ok], z[ok], r[ok]
            key[x, z] = r * shift + x.astype(np.int32)
    return result


def encode_step(model: Model, texts: list[str], keys: np.ndarray, seed: int, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, end to end, and how many each has."""
    joined = "".join(" " + t for t in texts if t)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    if not len(points):
        return np.zeros(0, np.int32), lengths
    text_start = np.cumsum(lengths) - lengths
    space = points == 32
    sym = model.char_table[np.where(space, ord(MARK), points)]
    sym[points == ord(MARK)] = -1
    # a word starts at a mark whose left neighbour is no mark, and with each text
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[text_start[lengths > 0]] = True
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(points)))
    text_of = np.searchsorted(text_start[lengths > 0], start, side="right") - 1
    own_key, own_start = keys[lengths > 0], text_start[lengths > 0]
    with np.errstate(over="ignore"):
        word = mix(mix(own_key[text_of] ^ np.uint64(seed) * GOLD) + (start - own_start[text_of]).astype(np.uint64) * GOLD)
        for lo, hi in ((1, 4), (4, 6), (6, 8), (8, 11), (11, 16), (16, 24), (24, 34), (34, WIDEST)):
            pick = np.flatnonzero((size > lo) & (size <= hi))
            if len(pick):
                at = start[pick][None, :] + np.arange(hi)[:, None]
                within = np.arange(hi)[:, None] < size[pick][None, :]
                at = np.where(within, at, 0)
                out = _merge(model, np.where(within, sym[at], -1), word[pick], limit)
                # -1 also stands for characters that the model lacks: those were never joined to anything
                gone = within & (out == -1) & (sym[at] != -1)
                sym[at[within]] = np.where(gone, -2, out)[within]
        for i in np.flatnonzero(size > WIDEST):
            s, n = start[i], size[i]
            where, ids = encode_word(model, sym[s : s + n].tolist(), int(word[i]), int(limit))
            sym[s : s + n] = -2
            sym[s + np.array(where)] = ids
    # byte pieces for what the model lacks
    wide = np.where(sym == -2, 0, 1)
    lacking = np.flatnonzero(sym == -1)
    spelled = [chr(points[i]).encode() for i in lacking]
    wide[lacking] = [len(b) for b in spelled]
    ends = np.cumsum(wide)
    ids = np.empty(ends[-1], np.int32)
    whole = sym >= 0
    ids[ends[whole] - 1] = sym[whole]
    for i, b in zip(lacking, spelled, strict=True):
        ids[ends[i] - len(b) : ends[i]] = [model.byte_id[x] for x in b]
    upto = np.concatenate([[0], ends])
    return ids, upto[text_start + lengths] - upto[text_start]


def decode_ids(model: Model, ids: list[int]) -> str:
    """The text of a row of ids."""
    return b"".join(map(model.bytes_of.__getitem__, ids))[1:].decode()


def _steps(texts: list[str | None]):
    """Slices of at most STEP_CHARS characters, or one text."""
    at, chars = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and chars + n > STEP_CHARS:
            yield at, i
            at, chars = i, 0
        chars += n
    yield at, len(texts)


def encode(df: DataFrame, model: tuple[list[str], list[float]], text: str = "text", key: str = "doc_id", rate: float = 0.1,
           seed: int = 0, ids: str = "ids") -> DataFrame:
    """``df`` with a column of ids.  ``key`` (an integer column; null counts as one value) makes the draws of a row its own."""
    limit = np.uint64(min(int(rate * 2**64), 2**64 - 1))
    schema = T.StructType([f for f in df.schema.fields if f.name != ids] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    pieces, scores = model

    def run(batches):
        made = Model(pieces, scores)
        for batch in batches:
            column, keyed = batch.column(text), batch.column(key).cast(pa.int64())
            null_key = np.uint64(0xD1B54A32D192ED03)
            keys = np.array([null_key if k is None else np.uint64(k & 0xFFFFFFFFFFFFFFFF) for k in keyed.to_pylist()], np.uint64)
            texts = column.to_pylist()
            flat, counts = [], []
            for lo, hi in _steps(texts):
                one, n = encode_step(made, [t or "" for t in texts[lo:hi]], keys[lo:hi], seed, limit)
                flat.append(one)
                counts.append(n)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32) if texts else np.zeros(1, np.int32)
            mask = pa.array([t is None for t in texts], pa.bool_())
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)), mask=mask)
            names = [f.name for f in schema.fields]
            yield pa.RecordBatch.from_arrays([listed if n == ids else batch.column(n) for n in names], names=names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: tuple[list[str], list[float]], ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids give null."""
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])
    pieces, scores = model

    def run(batches):
        made = Model(pieces, scores)
        for batch in batches:
            column = batch.column(ids)
            out = pa.array([None if x is None else decode_ids(made, x) for x in (v.as_py() for v in column)], pa.string())
            names = [f.name for f in schema.fields]
            yield pa.RecordBatch.from_arrays([out if n == text else batch.column(n) for n in names], names=names)

    return df.mapInArrow(run, schema)
