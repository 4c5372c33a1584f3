"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to).  Sizes flow from each pattern to the sources it belongs to: a pattern's
first use costs 0 per word, its second 1, its third 2, and a source takes at
most its target.  The cheapest greatest flow says how many words of each
pattern the mix takes, and with the convex cost no pattern is repeated while
another one that could fill the same quota is still unused.

Within a pattern every document is taken ``floor(flow / size)`` times, and the
rest goes to documents in seeded hash order.  The cut in that order is found
by refining a histogram of the hash range, 12 bits at a time, with one
aggregation per level and no sort or window over documents.  A document that
would overshoot is skipped and smaller ones fill what is left.

Only patterns reach the driver.  Their number is that of the distinct source
sets, not of the documents.

Defined cases: null and empty texts have size 0 and are not taken; a null
source is a source of its own, ordered last; repeated rows share a hash and
are taken or left together, and so are rows with a null id, whose hash is that
of no id; texts of any length count all their words; an empty table gives an empty result; sources
without words have target 0.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadre.llm.common import free_name, maybe_broadcast, whole, written

MAX_REPEATS = 3
SEED = 20_240_601
DIGIT, LEVELS = 12, 5  # of the 60 hash bits that order the documents
PASSES = 5
BROADCAST_PATTERNS = 100_000
#: Stands for the null source in patterns; not a value of any text column.
NULL = "\0null"


def size_of(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space."""
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def seeded_hash(doc_id: Column, seed: int = SEED) -> Column:
    """60 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 4)


def targets(sizes: dict[str, int], weights: dict[str, float], cap: int = MAX_REPEATS) -> dict[str, float]:
    """Shares of all words by weight, at most ``cap`` times a source's size;
    the excess is shared again by weight until no source is above."""
    out: dict[str, float] = {}
    left, open_ = float(sum(sizes.values())), dict(weights)
    while open_:
        unit = left / sum(open_.values())
        full = [s for s, w in open_.items() if unit * w > cap * sizes[s]]
        if not full:
            return out | {s: unit * w for s, w in open_.items()}
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            del open_[s]
    return out


def by_code_point(sources) -> list[str]:
    return sorted(sources, key=lambda s: (s == NULL, s))


class Flow:
    """Greatest flow by shortest augmenting paths, on integer capacities."""

    def __init__(self) -> None:
        self.out: dict[object, dict[object, int]] = {}

    def widen(self, a, b, capacity: int) -> None:
        self.out.setdefault(a, {}).setdefault(b, 0)
        self.out.setdefault(b, {}).setdefault(a, 0)
        self.out[a][b] += capacity

    def augment(self, s, t) -> None:
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                a = queue.popleft()
                for b, c in self.out.get(a, {}).items():
                    if c > 0 and b not in level:
                        level[b] = level[a] + 1
                        queue.append(b)
            if t not in level:
                return
            edges = {a: iter(list(b)) for a, b in self.out.items()}
            while True:  # one path of the level graph at a time, dead ends are left behind
                path = [s]
                while path and path[-1] != t:
                    a = path[-1]
                    b = next((b for b in edges[a] if self.out[a][b] > 0 and level.get(b) == level[a] + 1), None)
                    if b is None:
                        path.pop()
                    else:
                        path.append(b)
                if not path:
                    break
                width = min(self.out[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    self.out[a][b] -= width
                    self.out[b][a] += width
                edges = {a: iter(list(b)) for a, b in self.out.items()}


def route(sizes: dict[tuple[str, ...], int], quota: dict[str, int], repeats: int = MAX_REPEATS) -> dict[tuple, dict[str, int]]:
    """Words of each pattern for each of its sources in the cheapest greatest flow.

    Costs lie on the arcs into patterns alone, so shortest paths come in the
    order of use: all flow of cost 0 first, then of cost 1, and so on.
    """
    g = Flow()
    for p in sizes:
        for s in p:
            g.widen(("p", p), ("s", s), repeats * sizes[p])
    for s, q in quota.items():
        g.widen(("s", s), "t", q)
    for _ in range(repeats):
        for p, n in sizes.items():
            g.widen("o", ("p", p), n)
        g.augment("o", "t")
    return {p: {s: g.out[("s", s)][("p", p)] for s in p} for p in sizes}


def _cuts(thin: DataFrame, need: dict[int, int], after: dict[int, int], limit: dict[int, int], last: bool) -> dict[int, int]:
    """For each pattern the largest hash up to which its documents beyond
    ``after`` of size ``limit`` at most add up to ``need`` at most (with
    ``last``: come nearest to it).  -1 if none."""
    spark = thin.sparkSession
    prefix = {p: 0 for p in need}
    rest = dict(need)
    cut = {p: -1 for p in need}
    shift = DIGIT * LEVELS
    for _ in range(LEVELS):
        if not prefix:
            return cut
        shift -= DIGIT
        plan = spark.createDataFrame([(p, prefix[p], after[p], limit[p]) for p in prefix], "pid int, prefix long, after long, most long")
        rows = thin.join(F.broadcast(plan) if len(prefix) <= BROADCAST_PATTERNS else plan, "pid").where(
            (F.col("h") > F.col("after")) & (F.col("size") <= F.col("most"))
            & (F.shiftrightunsigned("h", shift + DIGIT) == F.col("prefix")))
        parts: dict[int, list[tuple[int, int]]] = {}
        # at most 2^DIGIT sums for each pattern
        for r in rows.groupBy("pid", F.shiftrightunsigned("h", shift).alias("d")).agg(F.sum("size").alias("n")).collect():
            parts.setdefault(r["pid"], []).append((r["d"], r["n"]))
        for p in list(prefix):
            edge = None
            for d, n in sorted(parts.get(p, [])):
                if n > rest[p]:
                    edge = (d, n)
                    break
                rest[p] -= n
                cut[p] = ((d + 1) << shift) - 1
            if edge is None:
                del prefix[p]
                continue
            prefix[p] = edge[0]
            if shift == 0:  # one hash is left: a document, or rows that repeat it
                if last and edge[1] - rest[p] < rest[p]:
                    cut[p] = edge[0]
                del prefix[p]
    return cut


def plan_mix(thin: DataFrame, weights=None, repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """(pattern plan, source plan) of rows (members, size, h).

    Pattern plan: members, base, picks (arrays of after, upto, most: a document
    is taken once more if a pick holds it).  Source plan: source, source_size,
    target.  ``weights`` gives a source's weight from its place in code-point
    order; by default 1, 2, 3, repeating.
    """
    spark = thin.sparkSession
    totals = thin.groupBy("members").agg(F.sum("size").alias("n"), F.max("size").alias("most")).collect()
    sizes = {tuple(r["members"]): int(r["n"]) for r in totals}
    biggest = {tuple(r["members"]): int(r["most"]) for r in totals}
    per_source: dict[str, int] = {}
    for p, n in sizes.items():
        for s in p:
            per_source[s] = per_source.get(s, 0) + n
    order = by_code_point(per_source)
    weight = {s: (weights or (lambda i: i % 3 + 1))(i) for i, s in enumerate(order)}
    share = targets(per_source, weight, repeats)
    scale = sum(sizes.values()) / max(1, sum(per_source.values()))  # words that count for several sources count once
    share = {s: t * scale for s, t in share.items()}
    flow = route(sizes, {s: round(t) for s, t in share.items()}, repeats)
    ids = {p: i for i, p in enumerate(sorted(sizes))}
    base, need = {}, {}
    for p, n in sizes.items():
        base[p], rest = divmod(sum(flow[p].values()), n) if n else (0, 0)
        if rest:
            need[ids[p]] = rest
    named = spark.createDataFrame([(i, list(p)) for p, i in ids.items()], "pid int, members array<string>")
    keyed = thin.join(maybe_broadcast(named, BROADCAST_PATTERNS), "members").select("pid", "size", "h")
    after, most = {i: -1 for i in need}, {ids[p]: biggest[p] for p in sizes}
    picks: dict[int, list[tuple[int, int, int]]] = {i: [] for i in ids.values()}
    for turn in range(PASSES):
        if not need:
            break
        # at last a document that overshoots by less than what is missing is better than none
        last = turn == PASSES - 1
        limit = {i: min(most[i], 2 * need[i] - 1 if last else need[i]) if turn else most[i] for i in need}
        upto = _cuts(keyed, need, after, limit, last)
        got = _taken(keyed, {i: (after[i], upto[i], limit[i]) for i in need if upto[i] > after[i]})
        for i in list(need):
            if upto[i] > after[i]:
                picks[i].append((after[i], upto[i], limit[i]))
                after[i] = upto[i]
            need[i] -= got.get(i, 0)
            if need[i] <= 0:
                del need[i]
    patterns = spark.createDataFrame(
        [(list(p), base[p], [(a, u, m) for a, u, m in picks[i]]) for p, i in ids.items()],
        "members array<string>, base int, picks array<struct<after: long, upto: long, most: long>>")
    sources = spark.createDataFrame([(None if s == NULL else s, per_source[s], float(share[s])) for s in order],
                                    "source string, source_size long, target double")
    return patterns, sources


def _taken(keyed: DataFrame, pick: dict[int, tuple[int, int, int]]) -> dict[int, int]:
    if not pick:
        return {}
    plan = keyed.sparkSession.createDataFrame([(p, *x) for p, x in pick.items()], "pid int, after long, upto long, most long")
    rows = keyed.join(F.broadcast(plan) if len(pick) <= BROADCAST_PATTERNS else plan, "pid").where(
        (F.col("h") > F.col("after")) & (F.col("h") <= F.col("upto")) & (F.col("size") <= F.col("most")))
    return {r["pid"]: int(r["n"]) for r in rows.groupBy("pid").agg(F.sum("size").alias("n")).collect()}


def single(source: Column) -> Column:
    """The pattern of a document with one source."""
    return F.array(F.coalesce(source, F.lit(NULL)))


def mix(docs: DataFrame, members: Column | None = None, weights=None, repeats: int = MAX_REPEATS, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, str, str]:
    """``docs`` with its size and the number of copies that the mix takes, the
    source plan, and the names of the two added columns.

    ``members`` is an array of source names per document (default: its one
    source).  The plan is a row per pattern, so texts are not moved.
    """
    ids, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    found = F.array_sort(F.array_distinct(members)) if members is not None else single(F.col(f"`{source_col}`"))
    thin = written(docs.select(found.alias("members"), size_of(text).alias("size"), seeded_hash(ids, seed).alias("h")), "mix-sizes")
    patterns, sources = plan_mix(thin, weights, repeats)
    size, copies, key, hashed = (free_name(docs.columns, c) for c in ("size", "copies", "_members", "_hash"))
    plan = patterns.select(F.col("members").alias(f"{key}_p"), F.col("base").alias(f"{key}_base"), F.col("picks").alias(f"{key}_picks"))
    keyed = docs.withColumns({key: found, size: size_of(text), hashed: seeded_hash(ids, seed)})
    joined = keyed.join(maybe_broadcast(plan, BROADCAST_PATTERNS), F.col(key) == F.col(f"{key}_p"), "left")
    once_more = F.exists(F.col(f"{key}_picks"), lambda x: (F.col(hashed) > x["after"]) & (F.col(hashed) <= x["upto"]) & (F.col(size) <= x["most"]))
    n = F.when(F.col(size) > 0, F.col(f"{key}_base") + once_more.cast("int")).otherwise(F.lit(0))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(size), n.alias(copies)), sources, size, copies


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, with the columns of ``docs``."""
    out, _, _, copies = mix(docs, **options)
    turn = free_name(out.columns, "_turn")
    taken = out.where(F.col(copies) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
