"""Importance resampling towards the word distribution of a target table.

Features are all runs of 1 to ``n`` consecutive words, joined by one space; a
feature's bucket is its UTF-8 bytes' CRC-32 modulo ``buckets``.  Words are
found by an Aho-Corasick automaton over words bounded by a delimiter on both
sides; a match emits the word's payload, its byte length and CRC.  The payloads
of adjacent words are composed into the CRC of the run (a CRC is linear: the
left part is advanced by the right part's length and added to it), so no run is
ever spelt out.

A worker's dictionary learns the distinct words that it meets: words which the
automaton does not hold yet get the same payload computed from their bytes, and
once they are as many as the dictionary they are added and the automaton is
compiled anew, up to ``DICTIONARY_WORDS``.  The dictionary so only saves work;
it never decides which words count.

One pass over the texts writes the buckets of each document, two bytes a
feature.  Bucket totals are added up per task before they are shuffled; the
driver reads at most ``buckets`` of them for either table and makes the gains.
A second pass over the buckets gives weights and scores.  The drawn documents
are ranked by a range partitioning on (score, id): a row's rank is its place in
its partition plus the rows of the partitions before, so no task holds more
than its range and the driver reads one count per partition.

Defined cases: a null text has no words and weight 0; an empty text likewise; a
null id draws as the empty id and loses ties to all others; texts of any length
are scanned in pieces of ``CHUNK`` characters' worth of documents, a longer text
alone; repeated rows are separate documents (equal ids draw the same noise);
an empty table gives an empty result, an empty target gives gains from T = 0;
other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadre.llm.common import narrow, text_parts, written

#: Most words in a worker's dictionary, words that it starts with, and the
#: characters of text that are scanned at a time.
DICTIONARY_WORDS = 1 << 17
FIRST_WORDS = 1 << 12
CHUNK = 1 << 21
#: The alphabet: ASCII letters (folded) and digits, and all bytes above ASCII.
_DELIMITED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CRC_POLYNOMIAL = 0xEDB88320


# -- CRC of joined strings ---------------------------------------------------

def _advance_tables() -> list[np.ndarray]:
    """For each k, the map of a CRC over 2^k zero bytes as four tables of 256."""
    def tables(basis: np.ndarray) -> np.ndarray:
        out = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                has = (np.arange(256) >> bit) & 1 == 1
                out[byte, has] ^= basis[8 * byte + bit]
        return out

    def one_byte(state: int) -> int:
        for _ in range(8):
            state = (state >> 1) ^ (_CRC_POLYNOMIAL if state & 1 else 0)
        return state

    basis = np.array([one_byte(1 << b) for b in range(32)], np.uint32)
    out = []
    for _ in range(32):
        out.append(tables(basis))
        basis = _mapped(out[-1], basis)
    return out


def _mapped(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


_TABLES: list[np.ndarray] = []


def advance(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What the CRCs contribute once ``length`` more bytes follow."""
    if not _TABLES:
        _TABLES.extend(_advance_tables())
    out = crc.astype(np.uint32, copy=True)
    bit = 0
    while len(length) and int(length.max()) >> bit:
        rows = np.nonzero((length >> bit) & 1)[0]
        out[rows] = _mapped(_TABLES[bit], out[rows])
        bit += 1
    return out


def run_crcs(crc: np.ndarray, length: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(CRC, document) of all runs of 1 to ``n`` adjacent words of a document,
    from the payloads of its words."""
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    spaced = advance(space, length) ^ crc  # of a space and the word
    crcs, docs, run = [crc], [doc], crc
    for k in range(1, n):
        run = advance(run[:-1], length[k:] + 1) ^ spaced[k:]
        inside = doc[k:] == doc[:-k]
        crcs.append(run[inside])
        docs.append(doc[k:][inside])
        if not len(run):
            break
    return np.concatenate(crcs), np.concatenate(docs)


# -- the dictionary ----------------------------------------------------------

class Dictionary:
    """Aho-Corasick automaton whose words carry (byte length, CRC)."""

    def __init__(self, limit: int = DICTIONARY_WORDS, first: int = FIRST_WORDS):
        import ahocorasick
        self.limit, self.first = limit, first
        self.automaton = ahocorasick.Automaton()
        self.size = 0
        self.missed: set[bytes] = set()

    def _learn(self) -> None:
        room = self.limit - self.size
        if room <= 0 or len(self.missed) < min(room, max(self.first, self.size)):
            return
        for w in sorted(self.missed)[:room]:
            # bytes as characters: the automaton's alphabet is the 256 bytes
            self.automaton.add_word(f" {w.decode('latin-1')} ", len(w) << 32 | zlib.crc32(w))
            self.size += 1
        self.missed = set()
        self.automaton.make_automaton()

    def payloads(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(CRC, byte length, row) of every word of the texts, in order."""
        flat = " ".join(["", *(t or "" for t in texts), ""]).encode("utf-8", "replace").translate(_DELIMITED)
        sizes = np.fromiter((len((t or "").encode("utf-8", "replace")) for t in texts), np.int64, len(texts))
        ends_of = np.cumsum(sizes + 1)  # each text ends before its delimiter
        bytes_ = np.frombuffer(flat, np.uint8)
        letter = bytes_ != 32
        start = np.nonzero(letter[1:] & ~letter[:-1])[0] + 1
        end = np.nonzero(letter[:-1] & ~letter[1:])[0] + 1
        payload = np.zeros(len(start), np.int64)
        known = np.zeros(len(start), bool)
        if self.size:
            hits = list(self.automaton.iter(flat.decode("latin-1")))
            at = np.searchsorted(end, np.fromiter(map(itemgetter(0), hits), np.int64, len(hits)))
            payload[at] = np.fromiter(map(itemgetter(1), hits), np.int64, len(hits))
            known[at] = True
        rest = np.nonzero(~known)[0]
        if len(rest):
            words = [flat[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist())]
            payload[rest] = np.fromiter((len(w) << 32 | zlib.crc32(w) for w in words), np.int64, len(words))
            if self.size < self.limit:
                self.missed.update(words)
                self._learn()
        return (payload & 0xFFFFFFFF).astype(np.uint32), payload >> 32, np.searchsorted(ends_of, start, side="left")


_dictionary: list[Dictionary] = []


def _worker_dictionary() -> Dictionary:
    if not _dictionary:
        _dictionary.append(Dictionary())
    return _dictionary[0]


# -- Spark -------------------------------------------------------------------

def _bucket_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucketed(docs: DataFrame, n: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, buckets) of every row; ``buckets`` holds the
    features' buckets as little-endian integers."""
    kind = _bucket_type(buckets)
    base = narrow(docs, id=id_col, text=text_col)
    schema = T.StructType([base.schema["id"], T.StructField("n_words", T.LongType()),
                           T.StructField("n_features", T.LongType()), T.StructField("buckets", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_dictionary()
        for b in batches:
            for lo, texts in text_parts(b, "text", CHUNK):
                crc, length, doc = words.payloads(texts)
                crcs, docs_ = run_crcs(crc, length, doc, n)
                order = np.argsort(docs_, kind="stable") if n > 1 else slice(None)
                at = (crcs[order] % np.uint32(buckets)).astype(kind)
                n_words, n_features = np.bincount(doc, minlength=len(texts)), np.bincount(docs_, minlength=len(texts))
                cut = np.concatenate([[0], np.cumsum(n_features)])
                held = [at[a:z].tobytes() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(texts)), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                     pa.array(held, pa.binary())], names=schema.names)

    return base.mapInArrow(run, schema)


def bucket_totals(held: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all rows: each task adds its own, Spark adds
    those, and at most ``buckets`` sums reach the driver."""
    kind = _bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in held.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p_target / p_corpus)) per bucket, each with one added count."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (s_all + k)) / ((s + 1.0) * (t_all + k))))
                     for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weighted(held: DataFrame, gains: np.ndarray) -> DataFrame:
    """The rows with ``weight``, the floored mean of their features' gains."""
    kind = _bucket_type(len(gains))
    schema = T.StructType([*(f for f in held.schema if f.name != "buckets"), T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Python's integers: the sum of a row is exact and // rounds down
            sums = [int(gains[np.frombuffer(x.as_buffer(), kind)].sum()) for x in b.column("buckets")]
            weight = [s // n if n else 0 for s, n in zip(sums, b.column("n_features").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema.names[:-1]), pa.array(weight, pa.int64())], names=schema.names)

    return held.mapInArrow(run, schema)


def with_noise(rows: DataFrame, seed: str) -> DataFrame:
    """``score``: the weight plus keyed Gumbel noise in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, eligible: str, draw) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, ... for the first ``draw(N)`` of the N
    eligible rows by falling score, then id; null for all others."""
    keys = [F.col(eligible).desc(), F.col("score").desc(), F.asc_nulls_last("id")]
    place = F.monotonically_increasing_id()  # partition and place in it
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", place), "importance-ranked")
    part = F.shiftright("place", 33)
    per_part = placed.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(eligible), 1)).alias("n_eligible")).collect()
    before, at = [], 0
    for r in sorted(per_part):
        before.append((r["part"], at))
        at += r["n"]
    drawn = draw(sum(r["n_eligible"] for r in per_part))
    # one row per partition
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.withColumn("part", part.cast("long")).join(offsets, "part")
    return out.withColumn("rank", F.when(F.col(eligible) & (rank <= drawn), rank)).drop("part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10,
             min_words: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text") -> DataFrame:
    """id, n_features, weight, score and rank of every row of ``docs``.

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred
    (rounded down) are drawn towards the features of ``target``: the highest
    scores, ties to smaller ids.  ``rank`` is null for rows not drawn.
    """
    held = written(bucketed(docs, n, buckets, id_col, text_col), "importance-buckets")
    aims = bucketed(target, n, buckets, target_text_col, target_text_col)
    gains = bucket_gains(bucket_totals(held, buckets), bucket_totals(aims, buckets))
    rows = with_noise(weighted(held, gains), seed).withColumn("eligible", F.col("n_words") >= min_words)
    # the range partitioning samples its input: the second pass runs once
    rows = written(rows.select("id", "n_features", "weight", "score", "eligible"), "importance-scores")
    out = ranked(rows, "eligible", lambda count: percent * count // 100)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that :func:`resample` drew, with all their columns."""
    return docs.join(scores.where("rank IS NOT NULL").select(id_col), id_col, "left_semi")
