"""Token ids in binary files, with document boundaries as Elias-Fano sequences.

One shard is one file: a magic word, the ids of its documents end to end (two bytes each, little-endian, or four where the
vocabulary needs them), the document keys, the boundaries, and a fixed tail with the places of these parts.  Keys and
boundaries are rising sequences of n numbers below u.  Elias-Fano keeps the low log2(u / n) bits of each number as they are
and the high bits as ones in a bit vector, about 2 + log2(u / n) bits a number in place of 64; a sample of the ones' places
(one in ``SELECT``) lets ``get`` find any number without reading the sequence.

Documents are sorted by key over all shards (range exchange, then a sort inside each task), and a task writes its ids as
batches come, so memory holds a batch and a number per document.  A task writes under a name of its own and renames the file
when it is complete: a repeated task overwrites with the same bytes.  The folder must be one that every executor reaches.

Words are encoded once per worker process and looked up afterwards: the tokenizer drops white space and never joins over it, so a
text's ids are its words' ids in turn (the tests compare with whole texts).

Defined results: a null text counts as empty and has only the end id; null keys come first, then ascending keys, repeated
keys in the order of their texts; no rows give no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAGIC = b"LLTOKEN1"
TAIL = "<qqqqqqq8s"  # id bytes, bytes per id, null keys, least key, keys' place, boundaries' place, documents, magic
SELECT = 512
DOCS_PER_SHARD = 200_000
#: Documents that are encoded together; each distinct word among them is looked up once.
ENCODE_DOCS = 2000
#: Words that a worker process remembers, some 150 bytes each.
CACHE_WORDS = 600_000


class EliasFano:
    """A rising sequence; ``get`` returns the numbers at given indexes."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.width, self.low, self.high, self.sample = n, width, low, high, sample

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(width, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if width else np.zeros(0, np.uint8)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, width, low, np.packbits(bits, bitorder="little"), ones[::SELECT].astype(np.uint32 if not n or ones[-1] < 2**32 else np.uint64))

    def get(self, index: np.ndarray) -> np.ndarray:
        """select1 on the high bits from the nearest sample on, then the low bits."""
        index = np.asarray(index, np.int64)
        if not len(index):
            return np.zeros(0, np.int64)
        block = index // SELECT
        places = np.empty(len(index), np.int64)
        for b in np.unique(block):  # each block of ones is unpacked once, whatever is asked of it
            first = int(self.sample[b])
            last = int(self.sample[b + 1]) if b + 1 < len(self.sample) else len(self.high) * 8
            ones = np.flatnonzero(np.unpackbits(self.high[first // 8 : last // 8 + 1], bitorder="little")) + first // 8 * 8
            ones = ones[ones >= first]
            own = block == b
            places[own] = ones[index[own] - b * SELECT]
        high = places - index
        if not self.width:
            return high
        bit = index[:, None] * self.width + np.arange(self.width)
        low = ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.width)
        return (high << self.width) + low.sum(axis=1)

    def dump(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.sample.tobytes()]
        return struct.pack("<qqqqqq", self.n, self.width, self.sample.itemsize, *map(len, parts)) + b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> "EliasFano":
        n, width, item, a, b, c = struct.unpack_from("<qqqqqq", data)
        at = struct.calcsize("<qqqqqq")
        part = lambda start, size, kind: np.frombuffer(data, kind, size // np.dtype(kind).itemsize, start)
        return cls(n, width, part(at, a, np.uint8), part(at + a, b, np.uint8), part(at + a + b, c, np.uint32 if item == 4 else np.uint64))


#: The split of a word into parts that are encoded by themselves, as the tokenizer file states it, and the same for lower-case
#: words of plain characters: there, lowering and composing change single characters only.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_PART = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+")
PLAIN_WORD = re.compile("[!-~À-ÖØ-öø-ÿ]*")


class Lists:
    """Growing lists of ids, end to end."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.used, self.n = self.used + len(ids), self.n + len(sizes)

    def keep(self, n: int) -> None:
        self.n, self.used = n, int(self.starts[n - 1] + self.sizes[n - 1])

    def take(self, place: np.ndarray) -> np.ndarray:
        """The lists at the given places, end to end."""
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        run = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        return self.flat[np.repeat(self.starts[place], sizes) + run]


class WordEncoder:
    """Ids of texts, by a cache of words, which are made of a cache of word parts.

    Full caches keep what they learnt first, which holds nearly all frequent words."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        spec = json.loads(tokenizer)
        names = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        # parts are taken only where the file states the rules they follow
        self.in_parts = names == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": SPLIT} and first.get("invert") is True
        marks = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.marked = re.compile("|".join(marks) or "(?!)").search
        self.known: dict[str, int] = {}
        self.words = Lists()
        self.known_parts: dict[str, int] = {}
        self.parts = Lists()

    def _encode_each(self, strings: list[str], into: Lists) -> None:
        for at in range(0, len(strings), 5_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(strings[at : at + 5_000], add_special_tokens=False)]
            into.add(np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn(self, words: list[str]) -> None:
        marked, fits = self.marked, PLAIN_WORD.fullmatch
        plain = [w for w in words if fits(w) and not marked(w)] if self.in_parts else []
        if plain:
            # all words are split at once, a line each: no list per word
            split = PLAIN_PART.findall("\n".join(plain).lower())
            new = [p for p in dict.fromkeys(split) if p not in self.known_parts and p != "\n"]
            if new:
                n = self.parts.n
                self._encode_each(new, self.parts)
                self.known_parts.update(zip(new, range(n, n + len(new)), strict=True))
            place = np.fromiter(map(self.known_parts.get, split, repeat(-1)), np.int64, len(split))
            counts = np.diff(np.concatenate([[-1], np.flatnonzero(place < 0), [len(place)]])) - 1
            place = place[place >= 0]
            ends = np.concatenate([[0], np.cumsum(self.parts.sizes[place])])
            upto = np.cumsum(counts)
            n = self.words.n
            self.words.add(self.parts.take(place), ends[upto] - ends[upto - counts])
            self.known.update(zip(plain, range(n, n + len(plain)), strict=True))
        rest = words if not plain else [w for w in words if w not in self.known]
        if rest:
            n = self.words.n
            self._encode_each(rest, self.words)
            self.known.update(zip(rest, range(n, n + len(rest)), strict=True))

    def _forget(self) -> None:
        """Back to the first half of a full cache."""
        half = CACHE_WORDS // 2
        if len(self.known) > CACHE_WORDS:
            self.known = dict(islice(self.known.items(), half))
            self.words.keep(half)
        if len(self.known_parts) > CACHE_WORDS:
            self.known_parts = dict(islice(self.known_parts.items(), half))
            self.parts.keep(half)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text's followed by ``end_id``, and how many each text has."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        self._forget()
        get = self.known.get
        own = [get(w, -1) for w in distinct]
        new = [w for w, i in zip(distinct, own, strict=True) if i < 0]
        if new:
            self._learn(new)
            own = [get(w) if i < 0 else i for w, i in zip(distinct, own, strict=True)]
        place = np.array(own, np.int64)[words.indices.to_numpy()] if distinct else np.zeros(0, np.int64)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        ends = np.concatenate([[0], np.cumsum(self.words.sizes[place])])
        counts = ends[offsets[1:]] - ends[offsets[:-1]] + 1
        out = np.empty(int(counts.sum()), np.uint32)
        last = np.cumsum(counts) - 1
        out[last] = end_id
        body = np.ones(len(out), bool)
        body[last] = False
        out[body] = self.words.take(place)
        return out, counts


def encoder_of(tokenizer: str) -> WordEncoder:
    """The worker process's encoder, which outlives a task; this module itself travels with each task."""
    held = sys.modules.setdefault("_word_encoders", types.ModuleType("_word_encoders"))
    if getattr(held, "tokenizer", None) != tokenizer:
        held.tokenizer, held.encoder = tokenizer, WordEncoder(tokenizer)
    return held.encoder


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_shard(path: str, pieces: Iterator[tuple[list[int | None], np.ndarray, np.ndarray]], width: int) -> tuple[int, int]:
    """Write keys, ids and counts as they come; returns documents and ids."""
    system, place = _open(path)
    own = f"{place}.{uuid.uuid4().hex}.part"
    keys, counts, total = [], [], 0
    with system.open_output_stream(own) as out:
        out.write(MAGIC)
        for key, ids, count in pieces:
            keys += key
            counts.append(count)
            total += len(ids)
            out.write(ids.astype(f"<u{width}").tobytes())
        nulls = sum(k is None for k in keys)
        known = np.array(keys[nulls:], np.int64)
        least = int(known[0]) if len(known) else 0
        # differences of 64-bit keys need not fit 63 bits, but fit 64 unsigned ones
        key_part = EliasFano.build(known.astype(np.uint64) - np.uint64(least & 0xFFFFFFFFFFFFFFFF)).dump()
        bounds = EliasFano.build(np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if keys else np.zeros(1)).dump()
        at = len(MAGIC) + total * width
        out.write(key_part)
        out.write(bounds)
        out.write(struct.pack(TAIL, total * width, width, nulls, least, at, at + len(key_part), len(keys), MAGIC))
    system.move(own, place)
    return len(keys), total


class Shard:
    """A file opened for reading: keys, offsets, and the ids of any range of documents."""

    def __init__(self, path: str):
        system, place = _open(path)
        self.file = system.open_input_file(place)
        size, end = self.file.size(), struct.calcsize(TAIL)
        (self.id_bytes, self.width, self.nulls, self.least, at, bounds, self.n, magic) = struct.unpack(TAIL, self.file.read_at(end, size - end))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        self._keys = EliasFano.load(self.file.read_at(bounds - at, at))
        self.bounds = EliasFano.load(self.file.read_at(size - end - bounds, bounds))

    def keys(self) -> list[int | None]:
        differences = self._keys.get(np.arange(self._keys.n))
        return [None] * self.nulls + (differences + self.least).tolist()

    def ids(self, start: int, end: int) -> np.ndarray:
        data = self.file.read_at((end - start) * self.width, len(MAGIC) + start * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Write the documents; returns the manifest (shard, path, documents, ids), itself a Parquet table in the folder.

    ``tokenizer`` is the content of a tokenizers JSON file whose tokens never span white space."""
    from tokenizers import Tokenizer

    spark: SparkSession = df.sparkSession
    width = 2 if max(end_id + 1, Tokenizer.from_str(tokenizer).get_vocab_size()) <= 65_536 else 4
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // DOCS_PER_SHARD + 1)
    ordered = rows.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    # the number of a range is part of its file's name, so that names sort as keys do
    ordered = ordered.withColumn("shard", F.spark_partition_id())
    base = folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder)
    system, place = _open(base)
    system.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def pieces():
            for batch in chain([first], batches):
                for at in range(0, batch.num_rows, ENCODE_DOCS):
                    part = batch.slice(at, ENCODE_DOCS)
                    ids, counts = encoder.encode(part.column("text"), end_id)
                    yield part.column("key").to_pylist(), ids, counts

        shard = first.column("shard")[0].as_py()
        path = f"{base}/tokens-{shard:06d}.bin"
        n_docs, n_ids = write_shard(path, pieces(), width)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    ordered.mapInArrow(run, "shard int, path string, n_docs long, n_ids long").write.mode("overwrite").parquet(f"{base}/manifest")
    return spark.read.parquet(f"{base}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, of the
    ids as little-endian 32-bit numbers)."""
    running = F.sum("n_ids").over(W.orderBy("shard")) - F.col("n_ids")  # over a row per file
    spark = manifest.sparkSession
    files = manifest.withColumn("before", running)
    n = max(1, min(manifest.count(), 20 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                shard = Shard(path)
                keys = shard.keys()
                for at in range(0, shard.n, 1000):
                    to = min(at + 1000, shard.n)
                    bounds = shard.bounds.get(np.arange(at, to + 1))
                    ids = shard.ids(int(bounds[0]), int(bounds[-1]))
                    cut = (bounds - bounds[0]).tolist()
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(keys[at:to], pa.int64()), "start": pa.array(bounds[:-1] + before, pa.int64()),
                        "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
