"""Bigram scores from a log-frequency Bloom filter.

An n-gram seen n times has the quantised count ``q = 1 + floor(log_b n)`` and
is stored as the members (n-gram, 1) .. (n-gram, q) of a Bloom filter.  A probe
asks for (n-gram, 1), (n-gram, 2), ... until one is missing, and the number of
hits stands for the mean of the counts of its step.  The filter is cut into
segments of ``SEGMENT_BITS`` bits, each n-gram lives in one segment, and each
segment is built by one small group.

The vocabulary is open: the filter holds the counts of all training words and
of all their bigrams, those that occur once too.  The probability of a token
after another is ``l(h) * min(1, c(h, w) / c(h)) + (1 - l(h)) * p(w)`` with
``l(h) = 0.8 * c(h) / (c(h) + 10)`` and ``p(w)`` the base probability, all
counts probed.  The ``LEXICON`` most frequent words have short codes and their
exact counts in every task, which only saves work: any other word is coded by a
hash of 62 bits, and its exact count for the base score is joined.

The lexicon has a fixed size and is broadcast.  The filter grows with the
corpus: up to ``BROADCAST_BYTES`` it is broadcast, beyond that the distinct
n-grams of a part of the texts are sent, packed, to the segments, which answer
with one byte each, with the same scores.  The part itself is kept as codes of
its words and meets the answers on its number.

Defined cases: null and empty texts are one end token; a null id is not held
out; texts of any length are scored whole; repeated rows count and are scored singly; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadre.llm.common import narrow, release, text_parts, thrifty, top_counts, whole, written

LEXICON = 1 << 16
BASE = 1.5
#: Bytes that a member sets two bits in, all in one line of LINE bytes.
BYTES, LINE = 3, 64
PROBES = 2 * BYTES
SEGMENT_BITS = 1 << 20  # a power of two
BROADCAST_BYTES = 128 << 20
#: Characters looked at together by a worker.
CHUNK = 1 << 21
#: Keys packed together by a worker.
MOST_PACKED = 1 << 22
#: Segments asked together, so that a part of the texts has few questions, long
#: ones, and keys looked up together.
ASKED, TOGETHER = 16, 1 << 18
#: One of so many bigrams, by its hash, is counted before the filter is sized.
SIZING = 1024
#: Token codes below the lexicon's words.
END, BEGIN, OTHER, FIRST = 0, 1, 2, 3
#: Marks the key of a single token of the lexicon.
ALONE = 1 << 40
#: Mark the code of a word outside the lexicon, which is its key too, and the
#: key of a bigram with such a word.
RARE, RARE_PAIR = 1 << 62, 1 << 61
_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


# -- the filter ------------------------------------------------------------

def quantised(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(n) / math.log(BASE) + 1e-9).astype(np.int64)


def steps_of(n: str) -> Column:
    """SQL form of :func:`quantised`."""
    return 1 + F.floor(F.log(n) / math.log(BASE) + 1e-9)


def expected(q: np.ndarray) -> np.ndarray:
    """Mean of the whole counts with the quantised count ``q``; 0 for 0."""
    low = np.ceil(BASE ** np.maximum(q - 1, 0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** q - 1e-9) - 1)
    return np.where(q > 0, (low + high) / 2, 0.0)


def place(key: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and segment of each n-gram key."""
    h = _mix(key.astype(np.uint64) + _G)
    return h, ((h >> np.uint64(40)) % np.uint64(segments)).astype(np.int64)


def bits(h: np.ndarray, step: np.ndarray | int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes within the segment, and the bits there, of the members (n-gram, step)."""
    x = _mix(h + np.asarray(step).astype(np.uint64) * _G)
    line = (x & np.uint64(SEGMENT_BITS // 8 - 1)) & ~np.uint64(LINE - 1)
    for i in range(BYTES):
        y = x >> np.uint64(24 + 12 * i)
        one, two = (y >> np.uint64(6)) & np.uint64(7), (y >> np.uint64(9)) & np.uint64(7)
        mask = (np.uint64(1) << one) | (np.uint64(1) << two)
        yield (line | (y & np.uint64(LINE - 1))).astype(np.int64), mask.astype(np.uint8)


def _build(rows: pd.DataFrame) -> np.ndarray:
    # a key is in the row of each batch that it occurs in
    at, key = pd.factorize(np.frombuffer(b"".join(rows["keys"]), np.int64))
    q = quantised(np.bincount(at, np.frombuffer(b"".join(rows["ns"]), np.int64)))
    h = place(key, 1)[0]
    member = np.repeat(np.arange(len(q)), q)
    step = np.arange(len(member)) - np.repeat(np.cumsum(q) - q, q) + 1
    flags = np.zeros(SEGMENT_BITS // 8, np.uint8)
    for lo in range(0, len(member), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        for byte, mask in bits(h[member[part]], step[part]):
            np.bitwise_or.at(flags, byte, mask)
    return flags


def probe(key: np.ndarray, segments: int, read) -> np.ndarray:
    """Quantised count of each key; ``read`` gives the bytes of (segment, byte) places."""
    h, seg = place(key, segments)
    q = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    step = 0
    while len(live):
        step += 1
        have = np.ones(len(live), bool)
        for byte, mask in bits(h[live], step):
            have &= read(seg[live], byte) & mask == mask
        live = live[have]
        q[live] = step
    return q


PACKED = "segment long, keys binary, ns binary"


def packed(key: np.ndarray, n: np.ndarray, segments: int) -> pa.RecordBatch:
    """A row for each segment, with its keys and their counts."""
    seg = place(key, segments)[1]
    order = np.argsort(seg, kind="stable")
    seg, key, n = seg[order], key[order], n[order].astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else np.zeros(0, np.int64)
    ends = pa.array(np.append(start, len(seg)) * 8, pa.int32()).buffers()[1]
    blobs = [pa.Array.from_buffers(pa.binary(), len(start), [None, ends, pa.py_buffer(x.tobytes())]) for x in (key, n)]
    return pa.RecordBatch.from_arrays([pa.array(seg[start]), *blobs], names=["segment", "keys", "ns"])


def _parts(key: np.ndarray, n: np.ndarray, segments: int) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(key), MOST_PACKED):
        yield packed(key[lo:lo + MOST_PACKED], n[lo:lo + MOST_PACKED], segments)


def segments_of(members: int) -> int:
    return max(1, math.ceil(members * PROBES / math.log(2) / SEGMENT_BITS))


def build_filter(counts: DataFrame) -> tuple[DataFrame, int]:
    """(segment, bits) of rows (key, n), and the number of segments."""
    segments = segments_of(counts.agg(F.sum(steps_of("n"))).first()[0] or 0)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _parts(b.column("key").to_numpy(), b.column("n").to_numpy(), segments)

    return build_packed(counts.select("key", "n").mapInArrow(spread, PACKED)), segments


def build_packed(rows: DataFrame) -> DataFrame:
    """(segment, bits) of the rows of :func:`packed`."""
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"segment": rows["segment"].iloc[:1], "bits": [_build(rows).tobytes()]})
    return written(rows.groupBy("segment").applyInPandas(build, "segment long, bits binary"), "lm-filter")


def lookup(keys: DataFrame, filter_: DataFrame, segments: int) -> DataFrame:
    """(key, q) of distinct keys, each sent to its segment."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(place(key, segments)[1]), pa.array(key)], names=["segment", "key"])

    def ask(rows: pd.DataFrame, seg: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(seg["bits"].iloc[0], np.uint8) if len(seg) else np.zeros(SEGMENT_BITS // 8, np.uint8)
        key = rows["key"].to_numpy()
        return pd.DataFrame({"key": key, "q": probe(key, segments, lambda _, at: data[at]) if len(key) else key})

    rows = keys.select("key").mapInArrow(spread, "segment long, key long")
    return rows.groupBy("segment").cogroup(filter_.groupBy("segment")).applyInPandas(ask, "key long, q long")


# -- tokens ----------------------------------------------------------------

def split_words(text: str) -> list[bytes]:
    """Words with A-Z in lower case (bytes: other letters stay, and only ASCII space splits)."""
    return text.encode().lower().split()


def digests(words: list[bytes]) -> np.ndarray:
    """Marked hashes of words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return (h & np.uint64(RARE - 1)).astype(np.int64) | RARE


class Coder:
    """Codes of words: their place in the lexicon, or a marked hash."""

    def __init__(self, words: list[str]):
        h = digests([w.encode() for w in words])
        order = np.argsort(h)
        self.h, self.code = h[order], order + FIRST

    def of(self, h: np.ndarray) -> np.ndarray:
        """The codes of words with these hashes."""
        if not len(self.h):
            return h
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.code[at], h)


def _flat(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """The number of words of each text; the words of all, the place of each
    among the distinct ones, and the hashes of those."""
    split = [split_words(t) for t in texts]
    words = list(itertools.chain.from_iterable(split))
    at, h = pd.factorize(digests(words))
    return np.fromiter(map(len, split), np.int64, len(split)), words, at, h


def _framed(values: np.ndarray, n: np.ndarray, begin, end) -> tuple[np.ndarray, np.ndarray]:
    """For each bigram of texts with ``n`` words, the values of its two tokens."""
    size = n + 2
    start = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), values.dtype)
    inside = np.ones(len(flat), bool)
    inside[start] = inside[start + n + 1] = False
    flat[start], flat[start + n + 1], flat[inside] = begin, end, values
    keep = np.ones(max(0, len(flat) - 1), bool)
    keep[start[1:] - 1] = False
    return flat[:-1][keep], flat[1:][keep]


def pair_key(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    """Keys of bigrams of codes."""
    key = (prev << 20) | cur
    far = np.flatnonzero((prev | cur) >= RARE)
    mixed = _mix(_mix(prev[far].astype(np.uint64) * _G) + cur[far].astype(np.uint64))
    key[far] = (mixed & np.uint64(RARE_PAIR - 1)).astype(np.int64) | RARE_PAIR
    return key


def _lists(values: pa.Array, text: np.ndarray, texts: int) -> pa.ListArray:
    """A list for each of ``texts`` of the values, which are in order of their text."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=texts))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def planes(values: np.ndarray) -> bytes:
    """The lowest byte of all values, then the next of all, ...: what is small or
    much alike is compressed well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplaned(data: bytes, type_) -> np.ndarray:
    """The values of :func:`planes`."""
    return np.frombuffer(data, np.uint8).reshape(np.dtype(type_).itemsize, -1).T.copy().view(type_).ravel()


def _questions(codes: np.ndarray, at: np.ndarray, n: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a part of the texts asks the filter, its words being ``codes[at]``:
    the place of each bigram among the distinct ones, the keys of those and of the
    words outside the lexicon, their groups of segments, and an order by group and key."""
    at2, each = pd.factorize(pair_key(*_framed(codes[at], n, BEGIN, END)))
    key = np.concatenate([each, codes[codes >= RARE]])
    group = place(key, segments)[1] // ASKED
    return at2, key, group, np.lexsort((key, group))


def _one(values: pa.Array) -> pa.ListArray:
    """All values as one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


class Model:
    """What scoring needs: the lexicon with exact counts, totals, the filter."""

    def __init__(self, docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES):
        """Learns from ``docs`` (text)."""
        spark = docs.sparkSession

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, texts in text_parts(b, "text", CHUNK):
                    n, w, at, h = _flat(texts)
                    first = np.empty(len(h), np.int64)
                    first[at] = np.arange(len(at))
                    key = pair_key(*_framed(h[at], n, BEGIN, END))
                    some, k = np.unique(key[key % SIZING == 0], return_counts=True)
                    # no word begins with a space
                    each = [w[i] for i in first.tolist()] + [b" %d" % x for x in some.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(each, pa.binary()).cast(pa.string()), pa.array(np.concatenate([np.bincount(at, minlength=len(h)), k]))], names=["w", "n"])

        counted = docs.select("text").mapInArrow(thrifty(words), "w string, n long")
        counted = written(counted.groupBy("w").agg(F.sum("n").alias("n")), "lm-vocab")
        release(spark)
        self.vocab = counted.where(~F.col("w").startswith(" "))
        self.ends = docs.count()
        total = self.vocab.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(steps_of("n")).alias("q")).first()
        sized = counted.where(F.col("w").startswith(" ")).agg(F.sum(steps_of("n"))).first()[0] or 0
        self.tokens = (total["n"] or 0) + self.ends
        self.types = total["v"] + (self.ends > 0)
        # the most frequent words are looked up in every task, all others by their hash and a join
        top = top_counts(self.vocab, LEXICON)
        self.words = [w for w, _ in top]
        self.counts = counts = np.array([self.ends, self.ends, 0, *(n for _, n in top)], np.int64)
        coder = spark.sparkContext.broadcast(self.words)

        # a bigram has no more members than it occurs; the part that was counted says how many they are
        pairs = min(self.tokens, math.ceil(SIZING * (sized + 5 * math.sqrt(sized) + 25)))
        self.segments = segments = segments_of(pairs + (total["q"] or 0) + 2 * int(quantised(np.array([max(1, self.ends)]))[0]))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = Coder(coder.value)
            for b in batches:
                keys, ns, size = [], [], 0
                for _, texts in text_parts(b, "text", CHUNK):
                    n, _, at, h = _flat(texts)
                    at, key = pd.factorize(pair_key(*_framed(c.of(h)[at], n, BEGIN, END)))
                    keys.append(key)
                    ns.append(np.bincount(at))
                    size += len(key)
                    if size >= MOST_PACKED:
                        yield from _parts(np.concatenate(keys), np.concatenate(ns), segments)
                        keys, ns, size = [], [], 0
                if keys:
                    yield from _parts(np.concatenate(keys), np.concatenate(ns), segments)

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = Coder(coder.value)
            for b in batches:
                code = c.of(digests([w.encode() for w in b.column("w").to_pylist()]))
                yield from _parts(np.where(code < RARE, code | ALONE, code), b.column("n").to_numpy(), segments)

        def framing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _parts(b.column("key").to_numpy(), b.column("n").to_numpy(), segments)

        ends = spark.createDataFrame([(ALONE | i, self.ends) for i in (BEGIN, END) if self.ends], "key long, n long")
        rows = docs.select("text").mapInArrow(thrifty(count), PACKED).union(
            self.vocab.select("w", "n").mapInArrow(thrifty(single), PACKED)).union(ends.mapInArrow(framing, PACKED))
        self.filter = build_packed(rows)
        del rows
        release(spark)
        self.broadcast = self.segments * SEGMENT_BITS // 8 <= broadcast_bytes
        if self.broadcast:
            data = np.zeros((self.segments, SEGMENT_BITS // 8), np.uint8)
            for r in self.filter.toLocalIterator():
                data[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
            self.data = data
            self.single = probe(np.arange(len(counts)) | ALONE, self.segments, lambda s, at: data[s, at])
        else:
            self.data = None
            asked = spark.createDataFrame([(ALONE | i,) for i in range(len(counts))], "key long")
            found = {r["key"]: r["q"] for r in lookup(asked, self.filter, self.segments).collect()}
            self.single = np.array([found[ALONE | i] for i in range(len(counts))])
        self.context = expected(self.single)
        self.weight = weight(self.context)
        self.mass = self.tokens + 0.1 * (self.types + 1)
        self.alone = (self.context + 0.1) / self.mass
        self.base = np.log10((counts + 0.1) / self.mass)


def weight(context):
    """The share of the bigrams' estimate after a token of this count."""
    return 0.8 * context / (context + 10)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (row, ..., n_tokens, n_known, base_score, score) of ``docs`` (row, text, ...)."""
    spark = docs.sparkSession
    others = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in others]
    shared = spark.sparkContext.broadcast((model.words, model.counts > 0, model.base, model.context, model.segments, model.data))
    mass = model.mass
    types = [*((f.name, f.dataType.simpleString()) for f in others), ("n_tokens", "long"), ("lex_known", "long"), ("lex_base", "double")]
    strings = [("w", "array<string>"), ("k", "array<long>")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, base, context, segments, data = shared.value
        coder = Coder(words)
        for b in batches:
            for start, texts in text_parts(b, "text", CHUNK):
                m = len(texts)
                n, w, at, h = _flat(texts)
                code = coder.of(h)
                rare = code >= RARE
                place_ = np.where(rare, OTHER, code)  # in the lexicon's arrays
                text = np.repeat(np.arange(m), n)
                # the end is a token, words outside the lexicon are added by the join
                lex_known = np.bincount(text, (known[place_] & ~rare)[at], m).astype(np.int64) + int(known[END])
                lex_base = np.bincount(text, np.where(rare, 0.0, base[place_])[at], m) + base[END]
                far = rare[at]
                one, first, k = np.unique(text[far] * len(code) + at[far], return_index=True, return_counts=True)
                own = one // max(1, len(code))
                out = [pa.array(n + 1), pa.array(lex_known), pa.array(lex_base)]
                some = [w[i] for i in np.flatnonzero(far)[first].tolist()]
                rares = [_lists(pa.array(some, pa.binary()).cast(pa.string()), own, m), _lists(pa.array(k, pa.int64()), own, m)]
                out = [*(b.column(x).slice(start, m) for x in names), *out]
                if data is not None:
                    prev, cur = _framed(code[at], n, BEGIN, END)
                    key = pair_key(prev, cur)
                    read = lambda s, x: data[s, x]
                    count = context[place_]
                    count[rare] = expected(probe(code[rare], segments, read))
                    at2, key = pd.factorize(key)
                    lm = _likelihood(count, at, n, context, expected(probe(key, segments, read))[at2], mass)
                    columns = [*out, *rares, pa.array(lm)]
                else:
                    columns = [b.column("row").slice(start, 1), *map(_one, [*out, *rares]), *(pa.array([planes(x)], pa.binary()) for x in (code, at.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    if model.broadcast:
        schema = [*types, *strings, ("lm", "double")]
    else:
        schema = [("part", "long"), *((c, f"array<{t}>") for c, t in [*types, *strings]), ("codes", "binary"), ("words", "binary")]
    fields = [c for c, _ in schema]
    # parts are as large as the texts, and stay
    rows = written(docs.select(*names, "text").mapInArrow(thrifty(run), _ddl(schema)), "lm-rows", **({} if model.broadcast else {"compression": "zstd"}))
    each = rows if model.broadcast else rows.select(F.explode(F.arrays_zip("row", "w", "k")).alias("x")).select("x.*")
    rare = each.select("row", F.explode(F.arrays_zip("w", "k")).alias("x")).select("row", "x.w", "x.k")
    seen = F.coalesce(F.col("v"), F.lit(0))
    rare = rare.join(model.vocab.withColumnRenamed("n", "v"), "w", "left").groupBy("row").agg(
        F.sum(F.when(seen > 0, F.col("k")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("k") * F.log10((seen + 0.1) / mass)).alias("rare_base"))
    if model.broadcast:
        told = rows
    else:
        # written, so that what was shuffled for it is gone before the filter is asked
        rare = written(rare, "lm-rare")
        release(spark)
        told = _told(rows, types, model)
    return told.join(rare, "row", "left").select(
        *names, "n_tokens", (F.col("lex_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("lex_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), F.col("lm").alias("score"))


def _ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in fields)


def _likelihood(count: np.ndarray, at: np.ndarray, n: np.ndarray, context: np.ndarray, pairs: np.ndarray, mass: float) -> np.ndarray:
    """The score of each of the texts of ``n`` words, by the counts of their
    distinct words and of their bigrams."""
    c, c2 = _framed(count[at], n, context[BEGIN], context[END])
    share = np.minimum(1, pairs / np.maximum(c, 1))
    l_ = weight(c)
    p = np.log10(l_ * share + (1 - l_) * ((c2 + 0.1) / mass))
    return np.bincount(np.repeat(np.arange(len(n)), n + 1), p, len(n))


def _told(parts: DataFrame, types: list[tuple[str, str]], model: Model) -> DataFrame:
    """The rows (``types``, lm) of the texts in ``parts``, by the answers of the
    segments to their questions.

    A part asks for each distinct n-gram once, by the differences of the sorted
    keys; the answer is a byte.  Only these and the parts' codes are shuffled.
    """
    segments, mass = model.segments, model.mass
    shared = parts.sparkSession.sparkContext.broadcast(model.context)
    asked, answers = "slot long, part long, keys binary", "slot long, part long, q binary"
    bare = pa.schema([("slot", pa.int64()), ("part", pa.int64()), ("q", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, size, codes, words in zip(*(b.column(c) for c in ("part", "n_tokens", "codes", "words"))):
                n = size.values.to_numpy(zero_copy_only=False) - 1
                _, key, group, order = _questions(unplaned(codes.as_py(), np.int64), unplaned(words.as_py(), np.int32), n, segments)
                group, key = group[order], key[order]
                start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                step = np.diff(key, prepend=0)
                step[start] = key[start]
                cut = [planes(step[lo:hi]) for lo, hi in zip(start, [*start[1:], len(key)])]
                yield pa.RecordBatch.from_arrays([pa.array(group[start]), pa.array([part.as_py()] * len(cut), pa.int64()), pa.array(cut, pa.binary())],
                                                 names=["slot", "part", "keys"])

    def answer(rows: pa.Table, seg: pa.Table) -> pa.Table:
        if not len(rows):
            return bare.empty_table()
        first = rows["slot"][0].as_py() * ASKED
        data = np.zeros((ASKED, SEGMENT_BITS // 8), np.uint8)
        for s, x in zip(seg["segment"].to_pylist(), seg["bits"]):
            data[s - first] = np.frombuffer(x.as_buffer(), np.uint8)
        q: list[bytes] = []
        keys, held = [], 0
        blobs = rows["keys"]
        for i, x in enumerate(blobs):
            keys.append(np.cumsum(unplaned(x.as_buffer(), np.int64)))
            held += len(keys[-1])
            if held >= TOGETHER or i + 1 == len(blobs):
                got = probe(np.concatenate(keys), segments, lambda s, at: data[s - first, at]).astype(np.uint8)
                q += [x.tobytes() for x in np.split(got, np.cumsum([len(k) for k in keys[:-1]]))]
                keys, held = [], 0
        return pa.Table.from_arrays([rows["slot"], rows["part"], pa.array(q, pa.binary())], schema=bare)

    def tell(told: pa.Table, part: pa.Table) -> pa.Table:
        context = shared.value
        codes, at = (unplaned(part[c][0].as_py(), t) for c, t in (("codes", np.int64), ("words", np.int32)))
        n = part["n_tokens"][0].values.to_numpy(zero_copy_only=False) - 1
        at2, key, _, order = _questions(codes, at, n, segments)
        q = np.empty(len(key), np.int64)
        q[order] = np.frombuffer(b"".join(told.sort_by("slot")["q"].to_pylist()), np.uint8)
        rare = codes >= RARE
        count = context[np.where(rare, OTHER, codes)]
        pairs = len(key) - int(rare.sum())
        count[rare] = expected(q[pairs:])
        lm = _likelihood(count, at, n, context, expected(q[:pairs])[at2], mass)
        out = [pa.chunked_array([x.values for x in part[c]]) for c, _ in types]
        return pa.Table.from_arrays([*out, pa.chunked_array([pa.array(lm)])], names=[*(c for c, _ in types), "lm"])

    filter_ = model.filter.withColumn("slot", F.floor(F.col("segment") / ASKED).cast("long"))
    questions = parts.select("part", "n_tokens", "codes", "words").mapInArrow(thrifty(ask), asked)
    told = written(questions.groupBy("slot").cogroup(filter_.groupBy("slot")).applyInArrow(answer, answers), "lm-told")
    release(parts.sparkSession)
    own = parts.select("part", *(c for c, _ in types), "codes", "words")
    return told.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(tell, _ddl([*types, ("lm", "double")]))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every
    row, learning from the rows that are not held out."""
    base = narrow(docs, id=id_col, text=text_col).withColumn("text", whole("text")).withColumn("held", held_out(F.col("id")))
    model = Model(base.where(~F.col("held")), broadcast_bytes)
    # the row number is only used once it is written with the row
    out = score(base.withColumn("row", F.monotonically_increasing_id()), model)
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known",
                      F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
