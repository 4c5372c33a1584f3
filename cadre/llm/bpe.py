"""Byte-level BPE encoding with a minimal transducer lexicon, and decoding.

The corpus' most frequent words are encoded once and compiled into a minimal
acyclic automaton: words share prefixes and, through hash-consing of equal
states, suffixes.  Each edge carries the number of accepted words that sort
before its branch, so the sum along a path is the word's rank, and the rank
indexes the word's ids.  The automaton is a flat file of arrays that every
worker memory-maps; it has at most ``size`` words, a documented parameter, so
its size is bounded.  Words that it does not accept are merged exactly, by the
tokenizer's own ranks.

Encoding follows the file's own definition: added tokens in a text are found
first, the rest is cut by the byte-level pattern, and merges never cross a
word.  Decoding joins the tokens' bytes and replaces invalid UTF-8.

Defined cases: null is the empty text and has no ids; null document ids travel
like any column; texts of any length are encoded whole; repeated rows give
repeated results; an empty table gives an empty result (and an empty lexicon);
other columns of the input travel unchanged.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import mmap
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadre.llm.common import SPACE, free_name, text_parts, thrifty, top_counts, whole, written

#: Words in the lexicon, characters encoded at a time, words remembered by a worker.
LEXICON_WORDS = 1 << 16
CHUNK = 1 << 21
MEMO = 200_000
#: Words longer than this many bytes are merged one by one with a heap.
WIDE = 32


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


def _ranges(points: list[int]) -> str:
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def newer_letters(splitter) -> list[int]:
    """Code points that only the regex library's newer Unicode tables, not
    ``splitter``, call letters or numbers."""
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    out = []
    for kind, probe in (("L", "a"), ("N", "1")):
        points = regex.findall(rf"\p{{{kind}}}", every)
        # a run of the class stays one word only if the library agrees on each of its members
        for lo in range(0, len(points), 512):
            part = points[lo:lo + 512]
            if len(splitter.pre_tokenize_str(probe + "".join(part))) > 1:
                out += [ord(c) for c in part if len(splitter.pre_tokenize_str(probe + c)) > 1]
    return sorted(out)


def word_splitter(splitter):
    """Function from a text to its words, as the byte-level pattern cuts them.

    Texts with letters that the library does not know as such are cut by a
    slower pattern that takes them out of the classes.
    """
    form = r"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"
    plain = regex.compile(form.format(letter=r"\p{L}", number=r"\p{N}", other=r"[^\s\p{L}\p{N}]"))
    newer = newer_letters(splitter)
    if not newer:
        return plain.findall
    odd = _ranges(newer)
    exact = regex.compile(form.format(letter=rf"[\p{{L}}--[{odd}]]", number=rf"[\p{{N}}--[{odd}]]",
                                      other=rf"[[^\s\p{{L}}\p{{N}}]||[{odd}]]"))
    has_odd = re.compile(f"[{odd}]").search

    def split(text: str) -> list[str]:
        return plain.findall(text) if text.isascii() or not has_odd(text) else exact.findall(text)

    return split


class Words:
    """Byte strings, joined."""

    def __init__(self, words: list[bytes]):
        self.lens = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(words), np.uint8)

    def __len__(self) -> int:
        return len(self.lens)

    def __getitem__(self, i: int) -> bytes:
        return self.flat[self.starts[i]:self.starts[i] + self.lens[i]].tobytes()

    def take(self, rows: np.ndarray) -> "Words":
        out = object.__new__(Words)
        out.flat, out.starts, out.lens = self.flat, self.starts[rows], self.lens[rows]
        return out


class Ids:
    """Lists of ids, joined in any order."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray):
        self.flat, self.starts, self.lens = flat, starts, lens

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the rows, one after the other."""
        n = self.lens[rows]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - ends + n, n)
        return self.flat[at]

    def append(self, other: "Ids") -> "Ids":
        return Ids(np.concatenate([self.flat, other.flat]), np.concatenate([self.starts, other.starts + len(self.flat)]),
                   np.concatenate([self.lens, other.lens]))


class Tokenizer:
    """Ranks, ids and bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE files without normaliser or prefix space are read")
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        vocab = model["vocab"]
        self.split = word_splitter(Library.from_file(path).pre_tokenizer)
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.n_ids = 1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])])
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.n_ids + right
        order = np.argsort(key, kind="stable")
        self.n_merges = len(pairs)
        # one more entry stands for no merge
        self.pair_key = np.append(key[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(order, self.n_merges).astype(np.int64)
        self.pair_made = np.append(made[order], -1)
        self.merge = {k: (r, m) for r, (k, m) in enumerate(zip(key.tolist(), made.tolist()))}
        self.token_bytes = [b""] * self.n_ids
        for s, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in s)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for s, i in self.added.items():
            self.token_bytes[i] = s.encode()
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    # -- exact merging -------------------------------------------------

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one word of any length: lowest rank first, leftmost among equals."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            if i >= 0 and nxt[i] < n and (m := self.merge.get(ids[i] * self.n_ids + ids[nxt[i]])):
                heapq.heappush(heap, (m[0], i, ids[i], ids[nxt[i]], m[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(prv[i])
            push(i)
        return [x for x in ids if x >= 0]

    def merge_words(self, words: Words) -> "Ids":
        """Ids of each word; words of up to ``WIDE`` bytes merge side by side."""
        parts, places, sizes = [], [], []
        for i in np.nonzero(words.lens > WIDE)[0].tolist():
            parts.append(np.array(self.merge_long(words[i]), np.int32))
            places.append([i])
            sizes.append([len(parts[-1])])
        short = np.nonzero(words.lens <= WIDE)[0]
        short = short[np.argsort(words.lens[short], kind="stable")]
        for lo in range(0, len(short), 16_384):
            part = short[lo:lo + 16_384]
            col = np.arange(max(1, int(words.lens[part[-1]])))
            inside = col < words.lens[part][:, None]
            at = np.where(inside, words.starts[part][:, None] + col, 0)
            ids = np.where(inside, self.byte_ids[words.flat[at]] if len(words.flat) else -1, -1)
            self._merge_rows(ids)
            kept = ids >= 0
            parts.append(ids[kept].astype(np.int32))
            places.append(part)
            sizes.append(kept.sum(1))
        if not parts:
            return Ids(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        n = np.concatenate(sizes).astype(np.int64)
        place = np.concatenate(places).astype(np.int64)
        starts, lens = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[place], lens[place] = np.cumsum(n) - n, n
        return Ids(np.concatenate(parts), starts, lens)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair's merge, the last index where there is none."""
        none = len(self.pair_key) - 1  # a sentinel above all keys
        key = np.where((a >= 0) & (b >= 0), a * self.n_ids + b, -1)
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[np.minimum(at, none)] == key, at, none)

    def _merge_rows(self, ids: np.ndarray) -> None:
        """Merges each row in place, one pair a round, until no row has a pair."""
        width = ids.shape[1]
        if width < 2:
            return
        live, cur = np.arange(len(ids)), ids.copy()
        pair = self._pairs(cur[:, :-1], cur[:, 1:])
        col = np.arange(width)[None, :]
        while True:
            rank = self.pair_rank[pair]
            best = rank.argmin(1)
            go = np.take_along_axis(rank, best[:, None], 1)[:, 0] < self.n_merges
            ids[live[~go], :width], ids[live[~go], width:] = cur[~go], -1
            if not go.any():
                return
            live, cur, pair, best = live[go], cur[go], pair[go], best[go]
            row = np.arange(len(live))
            made = self.pair_made[pair[row, best]]
            # every row is now one token shorter
            width -= 1
            src = col[:, :width] + (col[:, :width] > best[:, None])
            cur = np.take_along_axis(cur, src, 1)
            cur[row, best] = made
            if width < 2:
                ids[live, 0], ids[live, 1:] = cur[:, 0], -1
                return
            pair = np.take_along_axis(pair, src[:, :width - 1], 1)
            # only the pairs beside the new token change
            left = np.maximum(best - 1, 0)
            pair[row, left] = self._pairs(cur[row, left], cur[row, left + 1])
            right = np.minimum(best, width - 2)
            pair[row, right] = self._pairs(cur[row, right], cur[row, right + 1])


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


# -- the lexicon -----------------------------------------------------------

def compile_lexicon(words: list[bytes], ids: Ids) -> bytes:
    """Minimal acyclic transducer of distinct words, as one flat file.

    States are made bottom-up over the sorted words; a finished state that
    equals an earlier one (same finality, same edges) is replaced by it.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    accepted: list[int] = []  # words accepted from a state on

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            accepted.append(int(node[0]) + sum(accepted[t] for _, t in node[1]))
        return register[key]

    path: list[list] = [[False, []]]  # open states along the last word
    last = b""
    for i in order:
        w = words[i]
        same = next((k for k, (a, b) in enumerate(zip(last, w)) if a != b), min(len(last), len(w)))
        while len(path) > same + 1:
            done = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        path += [[False, []] for _ in w[same:]]
        path[-1][0] = True
        last = w
    while len(path) > 1:
        done = freeze(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = freeze(path[0])
    edges = []
    for s, (final, out) in enumerate(states):
        before = int(final)
        for byte, to in out:
            edges.append((s * 256 + byte, to, before))
            before += accepted[to]
    edges.sort()
    table = np.array(edges, np.int64).reshape(-1, 3)
    rows = np.array(order, np.int64)
    starts = np.concatenate([[0], np.cumsum(ids.lens[rows])]).astype(np.int64)
    parts = [table[:, 0], table[:, 1], table[:, 2], np.array([f for f, _ in states], np.int64), starts, ids.gather(rows).astype(np.int64)]
    head = np.array([root, *map(len, parts)], np.int64)
    return b"".join(np.ascontiguousarray(x).tobytes() for x in [head, *parts])


class Lexicon:
    """Reads a compiled lexicon through a memory map of an unnamed file."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        whole_file = np.frombuffer(mapped, np.int64)
        self.root, sizes = int(whole_file[0]), whole_file[1:7].tolist()
        cuts = np.concatenate([[7], 7 + np.cumsum(sizes)])
        self.key, self.to, self.before, self.final, starts, ids = (whole_file[a:b] for a, b in zip(cuts, cuts[1:]))
        self.ids = Ids(ids, starts[:-1], np.diff(starts))

    def find(self, words: Words) -> np.ndarray:
        """Rank of each word, -1 for those not accepted; all words step together."""
        n, lens, flat, start = len(words), words.lens, words.flat, words.starts
        state, rank = np.full(n, self.root), np.zeros(n, np.int64)
        live, step = np.nonzero(lens > 0)[0] if len(self.key) else np.zeros(0, np.int64), 0
        ended = np.zeros(n, bool)
        ended[lens == 0] = True
        while len(live):
            key = state[live] * 256 + flat[start[live] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            live, at = live[ok], at[ok]
            state[live] = self.to[at]
            rank[live] += self.before[at]
            step += 1
            ended[live] = lens[live] == step
            live = live[lens[live] > step]
        return np.where(ended & (self.final[state] == 1), rank, -1)


def frequent_words(docs: DataFrame, path: str, text_col: str = "text", size: int = LEXICON_WORDS) -> list[str]:
    """The ``size`` most frequent words of all texts.

    Space-parted words are counted first, then only the distinct ones are cut
    by the tokenizer's pattern; ties go to the smaller word.
    """
    # the split pattern keeps no white space, so the last words of long texts count too
    parts = docs.select(F.explode(F.split(whole(F.col(f"`{text_col}`")), f"[{SPACE}]+")).alias("w"))
    parts = parts.where(F.col("w") != "").groupBy("w").agg(F.count(F.lit(1)).alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = tokenizer(path).split
        for b in batches:
            total: dict[str, int] = {}
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in find(" " + w):
                    total[x] = total.get(x, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["w", "n"])

    words = written(parts.mapInArrow(thrifty(cut), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "bpe-words")
    return [w for w, _ in top_counts(words, size)]


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", size: int = LEXICON_WORDS) -> bytes:
    words = [w.encode() for w in frequent_words(docs, path, text_col, size)]
    return compile_lexicon(words, tokenizer(path).merge_words(Words(words)))


# -- encoding and decoding -------------------------------------------------

class _Codes(dict):
    """Words' places in the memory; a new word gets the next place."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts with a lexicon; remembers about ``MEMO`` words."""

    def __init__(self, path: str, lexicon: bytes):
        self.tok, self.lexicon = tokenizer(path), Lexicon(lexicon)
        self.forget()

    def forget(self) -> None:
        self.codes = _Codes()
        self.ids = Ids(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _learn(self) -> None:
        """Finds the ids of the words that have a place but no ids yet."""
        words = Words([w.encode() for w in itertools.islice(self.codes, len(self.ids.lens), None)])
        if not len(words):
            return
        rank = self.lexicon.find(words)
        known, miss = np.nonzero(rank >= 0)[0], np.nonzero(rank < 0)[0]
        merged = self.tok.merge_words(words.take(miss))
        flat = self.lexicon.ids.gather(rank[known]).astype(np.int32)
        starts, lens = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        lens[known], lens[miss] = self.lexicon.ids.lens[rank[known]], merged.lens
        starts[known] = np.cumsum(lens[known]) - lens[known]
        starts[miss] = len(flat) + merged.starts
        self.ids = self.ids.append(Ids(np.concatenate([flat, merged.flat]), starts, lens))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > MEMO:
            self.forget()
        split, find, added, ids = self.tok.split, self.codes.__getitem__, self.tok.added_pattern, self.tok.added
        cut = []
        for t in texts:
            # an added token is a piece of its own between the others
            pieces = added.split(t) if added is not None and added.search(t) else [t]
            parts = []
            for piece in pieces:
                if piece in ids:
                    parts.append(ids[piece])
                else:
                    words = split(piece)
                    parts.append(np.fromiter(map(find, words), np.int64, len(words)))
            cut.append(parts)
        self._learn()
        out = []
        for parts in cut:
            done = [np.array([x], np.int32) if isinstance(x, int) else self.ids.gather(x) for x in parts]
            out.append(done[0] if len(done) == 1 else np.concatenate([np.zeros(0, np.int32), *done]))
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, lexicon: bytes) -> Encoder:
    key = (path, hash(lexicon))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, lexicon)
    return _encoders[key]


def _texts(table: np.ndarray, ids: list[np.ndarray | None]) -> list[str | None]:
    return [None if x is None else b"".join(table[x].tolist()).decode("utf-8", "replace") for x in ids]


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids",
           lexicon_words: int = LEXICON_WORDS, decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of its text in column ``out`` (array of int) and,
    if ``decoded`` names a column, their decoding, made in the same pass."""
    out = free_name(docs.columns, out)
    lexicon = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, path, text_col, lexicon_words))
    at, names = docs.columns.index(text_col), [*docs.columns, out]
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    if decoded:
        names.append(free_name(names, decoded))
        schema = schema.add(names[-1], T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, lexicon.value)
        table = np.array(enc.tok.token_bytes, object)
        for b in batches:
            for start, part in text_parts(b, at, CHUNK):
                ids = enc.encode([t or "" for t in part])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                cols = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))]
                if decoded:
                    cols.append(pa.array(_texts(table, ids), pa.string()))
                yield pa.RecordBatch.from_arrays([*b.slice(start, len(part)).columns, *cols], names=names)
        enc.forget()  # the worker may go on to other work

    return docs.mapInArrow(thrifty(run), schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids in column ``out``; null ids give null."""
    out = free_name(df.columns, out)
    at, names = df.columns.index(ids_col), [*df.columns, out]
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(tokenizer(path).token_bytes, object)
        for b in batches:
            rows = (row.values for row in b.column(at))
            texts = _texts(table, [None if x is None else x.to_numpy(zero_copy_only=False) for x in rows])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=names)

    return df.mapInArrow(run, schema)
