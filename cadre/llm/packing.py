"""Best-fit-decreasing packing of documents into sequences of fixed capacity.

A document is its token ids and an end id.  One longer than the capacity is cut
into full pieces, the first of which may be shorter; every other document is
one piece.  Pieces are packed from the longest down, each into the open
sequence with the least room that still holds it; a segment tree over the
remaining capacities finds that room in logarithmic time.

Pieces of equal length are alike to the packing, so it needs only how many
there are of each length: at most ``capacity`` numbers, whatever the size of
the corpus.  They are counted by Spark and the driver packs them run by run: a
run of equal pieces meets a run of sequences with equal room, and each sequence
takes as many of them as fit before the next is opened, just as one document
after the other would.  The outcome is a short list of placements, each for a
contiguous range of pieces in (length, id, piece) order.

Spark then puts the pieces in that order by one range partitioning of thin
rows; a piece's number is its place in its partition plus the pieces of the
partitions before, and a binary search in the placements gives its sequence and
offset.  No task holds more than its range, however many pieces share a length.

Ids come from the tokenizer's file.  Texts go through tiktoken with the file's
own ranks, which is several times faster than the ``tokenizers`` library; texts
with a character whose class has changed, or that has been added, since an
early Unicode version go through the library itself, since the two may
disagree on such characters' classes.

Defined cases: a null or empty text is one piece that holds the end id alone; a
text of any length is encoded whole and cut into as many pieces as it needs;
repeated rows and repeated ids are packed as separate documents; null ids come
last in their length; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadre.llm.bpe import byte_symbols
from cadre.llm.common import narrow, text_parts, written

#: Characters encoded at a time.
CHUNK = 1 << 21


# -- the plan ----------------------------------------------------------------

class RoomTree:
    """Segment tree over rooms 0..capacity: how many runs of sequences have each."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, change: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += change
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of ``need`` or more that some sequence has."""
        at = need + self.width
        if self.count[at]:
            return need
        # up to the first ancestor with something on its right, then down leftmost
        while at > 1 and (at & 1 or not self.count[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.width:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.width


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Placements (first piece, pieces to a sequence, first sequence, offset,
    length), ordered by first piece, and the number of sequences.

    Pieces are numbered from the longest down; ``counts`` has the number of
    pieces of each length from 1 to ``capacity``.
    """
    tree, open_runs = RoomTree(capacity), defaultdict(list)  # room -> [(first sequence, sequences)]
    out, piece, n_sequences = [], 0, 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_runs[room].append((first, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        left = counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, n_sequences, -(-left // (capacity // length))
                n_sequences += n
            else:
                first, n = open_runs[room].pop()
                tree.add(room, -1)
            each = room // length
            taken = min(left, n * each)
            full, rest = divmod(taken, each)
            out.append((piece, each, first, capacity - room, length))
            put(room - each * length, first, full)
            put(room - rest * length, first + full, 1 if rest else 0)
            used = full + (1 if rest else 0)
            put(room, first + used, n - used)
            piece += taken
            left -= taken
    return np.array(out, np.int64).reshape(-1, 5), n_sequences


# -- token ids ---------------------------------------------------------------

def _kind(category: str) -> str:
    return category[0] if category[0] in "LN" else "other"


def unsettled_characters() -> str:
    """Pattern class of the characters added, or moved between letters, numbers
    and the rest, since Unicode 3.2."""
    old, parts, start, last = unicodedata.ucd_3_2_0, [], None, None
    for c in range(0x80, sys.maxunicode + 2):
        odd = False
        if c <= sys.maxunicode and not 0xD800 <= c < 0xE000:
            now = unicodedata.category(chr(c))
            was = old.category(chr(c))
            odd = (was == "Cn" and now != "Cn") or _kind(was) != _kind(now) or now == "Cn"
        if odd:
            start = c if start is None else start
            last = c
        elif start is not None:
            parts.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
    return f"[{''.join(parts)}]"


class Encoder:
    """Token ids of texts as the ``tokenizers`` library gives them, without
    added, truncated or padded ones."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE files without normaliser or prefix space are read")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in model["vocab"].items() if s not in added}
        # the fixed pattern of byte-level pre-tokenisation
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = self._fast(tiktoken, ranks, pattern, added, model)
        self.unsettled = None

    @staticmethod
    def _fast(tiktoken, ranks: dict, pattern: str, added: dict, model: dict):
        """tiktoken merges by id; so only if ids follow the file's merges."""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        if made != sorted(made) or (made and min(made) < 256):
            return None
        return tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            if self.unsettled is None and not text.isascii():
                self.unsettled = re.compile(unsettled_characters())
            if text.isascii() or not self.unsettled.search(text):
                return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# -- Spark -------------------------------------------------------------------

def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int, keep_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every row's pieces."""
    base = narrow(docs, id=id_col, text=text_col)
    fields = [base.schema["id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for lo, texts in text_parts(b, "text", CHUNK):
                row, cols, held = [], [[], [], [], []], []
                for k, t in enumerate(texts):
                    ids = np.append(enc.ids(t or ""), np.uint32(end)).astype("<u4")
                    for j, (start, length) in enumerate(cut(len(ids), capacity)):
                        part = ids[start:start + length]
                        row.append(lo + k)
                        for c, v in zip(cols, (j, start, length, zlib.crc32(part.tobytes()))):
                            c.append(v)
                        if keep_ids:
                            held.append(part.astype(np.int32))
                arrays = [b.column(0).take(pa.array(row, pa.int64())), pa.array(cols[0], pa.int32()),
                          *(pa.array(c, pa.int64()) for c in cols[1:])]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(held, pa.list_(pa.int32()))] if keep_ids else []), names=schema.names)

    return base.mapInArrow(run, schema)


def _placed(numbered: DataFrame, before: dict[int, int], plan: np.ndarray) -> DataFrame:
    """``sequence_id`` and ``offset`` of pieces with their place in the order.

    ``before`` has one number per partition, ``plan`` some rows per length.
    """
    keep = [f for f in numbered.schema if f.name != "place"]
    schema = T.StructType([*keep, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    parts = np.array(sorted(before), np.int64)
    firsts = np.array([before[p] for p in parts.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column("place").to_numpy()
            number = firsts[np.searchsorted(parts, place >> 33)] + (place & ((1 << 33) - 1))
            p = plan[np.searchsorted(plan[:, 0], number, side="right") - 1] if b.num_rows else plan[:0]
            nth = number - p[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f.name) for f in keep), pa.array(p[:, 2] + nth // p[:, 1]), pa.array(p[:, 3] + nth % p[:, 1] * p[:, 4])],
                names=schema.names)

    return numbered.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, keep_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of every
    piece (and its ``ids`` if asked for)."""
    order = [F.desc("length"), F.asc_nulls_last("id"), F.asc("piece")]
    cut_up = written(pieces(docs, tokenizer, capacity, end, keep_ids, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = best_fit_decreasing(counts, capacity)
    numbered = written(cut_up.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("place", F.monotonically_increasing_id()), "pieces-numbered")
    sizes = numbered.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, at = {}, 0
    for part, n in sorted(tuple(r) for r in sizes):
        before[part] = at
        at += n
    return _placed(numbered, before, plan).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, from :func:`pack` with ids.
    A sequence has at most ``capacity`` ids, so a group is bounded."""
    each = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(each, lambda x: x["ids"])).alias("ids"))
