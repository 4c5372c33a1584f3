"""Near-duplicate documents by DartMinHash.

A document's elements are its distinct runs of five words (one run of all
words if it has fewer), weighted by how often they occur.  Darts are thrown at
the plane of (element, weight) x rank as a Poisson process seeded by the cell
they can hit, so two documents share exactly the darts in the region that both
cover.  Each dart names one of ``COORDS`` coordinates; the earliest dart of
each coordinate is the signature, and two signatures agree in a coordinate
with the probability of the weighted Jaccard similarity.  Only darts up to the
rank at which every coordinate is expected to be hit are thrown, some
``t ln t`` in all, instead of one per element and coordinate.

Signatures are cut into bands.  In each band's bucket one document leads: the
one that shares its bands with the most others, which in a group of copies is
the text they come from.  Documents are compared with their leader, first by
signature, then exactly, so a bucket of n copies costs n comparisons, not
n ** 2.  Where a document is not near its leader, the bucket's documents, those
near the leader too, go on to an exact join: rare elements first, two similar
documents share one of their first fifth.  Pairs of one component are left out
of it; those that remain are compared.  So two similar documents end in one
group if they share a band, however full its bucket is.  Links join documents
into groups; equal texts are grouped by their hash before any of this and
compared once.

Defined cases: null and empty texts have no element, are equal to each other
and near nothing else; texts of any length are compared whole; rows that repeat an id share a group; rows with a null
id are not grouped (null class, kept); an empty table gives an empty result;
ties go to the smallest id; other columns travel unchanged through
``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadre.llm.common import free_name, maybe_broadcast, narrow, scratch_path, sized, thrifty, whole, written

WORDS = 5
SIMILAR = 0.8
#: Share of two texts' cells together that they must have in common.
NEED = SIMILAR / (1 + SIMILAR)
COORDS = 120
#: Bands over the first coordinates: texts of similarity 0.8 share one of the
#: 12 with probability 0.998.
BANDS, ROWS = 12, 4
#: Ids of compared documents are broadcast up to this number, else joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Signatures that agree in a smaller share are not compared exactly: five
#: standard deviations below SIMILAR.
LEAST_AGREEMENT = SIMILAR - 5 * float(np.sqrt(SIMILAR * (1 - SIMILAR) / COORDS))

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def cells(text: str) -> np.ndarray:
    """Hashes of the unit cells (element, 0 .. weight - 1) that the text covers."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    run = np.full(n, np.uint64(width))
    for j in range(width):
        run = _mix(run * _G + h[j:j + n])
    run = np.sort(run)
    first = np.concatenate([[True], run[1:] != run[:-1]])
    at = np.arange(n)
    turn = at - np.maximum.accumulate(np.where(first, at, 0))
    return _mix(run + _G * (turn.astype(np.uint64) + np.uint64(1)))


def _wait(cell: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dart ``k`` of each cell: its hash, and the rank it lies beyond the dart before."""
    dart = _mix(cell + _G * (k.astype(np.uint64) + np.uint64(1)))
    unit = ((_mix(dart ^ _M2) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
    return dart, -np.log(unit)


def signature(cell: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """The earliest dart (32 bits of its hash) of each coordinate."""
    if not len(cell):
        return np.zeros(0, np.uint32)
    first, wait = _wait(cell, np.zeros(len(cell), np.int64))
    upto = (np.log(coords) + 2) * coords / len(cell)
    while True:
        hit = wait < upto
        some, rank0 = cell[hit], wait[hit]
        more = int(upto + 4 * np.sqrt(upto) + 4)
        while True:  # darts beyond the first in the cells that have one
            dart, gap = _wait(some[:, None], np.arange(1, more + 1)[None, :])
            rank = np.cumsum(np.concatenate([rank0[:, None], gap], axis=1), axis=1)
            if not len(some) or (rank[:, -1] >= upto).all():
                break
            more *= 2
        dart = np.concatenate([first[hit][:, None], dart], axis=1)
        inside = rank < upto
        dart, rank = dart[inside], rank[inside]
        order = np.argsort(-rank, kind="stable")
        dart = dart[order]
        coord = ((dart >> np.uint64(32)) % np.uint64(coords)).astype(np.int64)
        out = np.zeros(coords, np.uint64)
        seen = np.zeros(coords, bool)
        out[coord] = dart  # the last to be written is the earliest
        seen[coord] = True
        if seen.all():
            return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        upto *= 2


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of cells."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


SIGNED = "id long, h1 long, h2 long, sig binary, bands array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """(id, 128-bit text hash, signature, band hashes) of rows (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sigs, bands, h1, h2 = b.column("id"), [], [], [], []
            for t in b.column("text").to_pylist():
                raw = xxhash.xxh3_128_digest(t.encode())
                h1.append(int.from_bytes(raw[:8], "big", signed=True))
                h2.append(int.from_bytes(raw[8:], "big", signed=True))
                sig = signature(cells(t))
                sigs.append(sig.tobytes())
                if not len(sig):
                    bands.append([])
                    continue
                rows = sig[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
                band = np.arange(1, BANDS + 1, dtype=np.uint64)
                for j in range(ROWS):
                    band = _mix(band * _G + rows[:, j])
                bands.append(band.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "h1", "h2", "sig", "bands"])
    return docs.select("id", "text").mapInArrow(thrifty(run), SIGNED)


def _agreeing(pairs: DataFrame) -> DataFrame:
    """``pairs`` whose signatures (sig, lead_sig) agree in enough coordinates."""
    schema = pairs.select("id", "lead").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean() >= LEAST_AGREEMENT
                    for x, y in zip(b.column("sig").to_pylist(), b.column("lead_sig").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lead")], names=["id", "lead"]).filter(pa.array(same, pa.bool_()))
    return pairs.select("id", "lead", "sig", "lead_sig").mapInArrow(thrifty(run), schema)


def _near(pairs: DataFrame) -> DataFrame:
    """(id, lead) of rows with text and lead_text that are similar enough."""
    schema = pairs.select("id", "lead").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for b in batches:
            near = []
            for x, y in zip(b.column("text").to_pylist(), b.column("lead_text").to_pylist()):
                if y != last[0]:
                    last = (y, cells(y))
                near.append(similarity(cells(x), last[1]) >= SIMILAR)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lead")], names=["id", "lead"]).filter(pa.array(near, pa.bool_()))
    return pairs.select("id", "lead", "text", "lead_text").mapInArrow(thrifty(run), schema)


def _weighted(entries: DataFrame) -> DataFrame:
    """The entries (id, band) of buckets of two or more, with the weight of
    their document: how many others, counted per band, share its bands."""
    # tables that are joined are written first: the join can then split the rows of one key
    sizes = written(entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "minhash-sizes")
    shared = written(entries.join(sizes, "band"), "minhash-shared")
    weight = written(shared.groupBy("id").agg(F.sum("n").alias("w")), "minhash-weights")
    return written(shared.join(weight, "id").select("id", "band", "w"), "minhash-weighted")


def _leaders(entries: DataFrame) -> DataFrame:
    """(band, lead) of the buckets of two or more: the document of the largest
    weight, ties to the smallest id."""
    first = F.max(F.struct(F.col("w"), F.bitwise_not("id").alias("other"))).alias("x")
    lead = entries.groupBy("band").agg(first, F.count(F.lit(1)).alias("n"))
    return lead.where("n > 1").select("band", F.bitwise_not("x.other").alias("lead"))


def _occurring(texts: DataFrame) -> DataFrame:
    """(id, n, cell) of rows (id, text): the cells of each text, and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                c = cells(t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(c), i, np.int64)), pa.array(np.full(len(c), len(c), np.int64)), pa.array(c.view(np.int64))],
                    names=["id", "n", "cell"])
    return texts.select("id", "text").mapInArrow(thrifty(run), "id long, n long, cell long")


def _prefixes(texts: DataFrame) -> DataFrame:
    """(id, n, cell, place) of each text's rarest cells that others have too.

    Cells are put in one order, rare ones first; two texts that are similar
    share one among the first ``n - SIMILAR * n + 1`` of both.
    """
    every = written(_occurring(texts), "minhash-cells")
    often = every.groupBy("cell").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    common = written(every.join(written(often, "minhash-often"), "cell"), "minhash-common")
    # the cells of a text are windowed, not those of a table; cells of one text only come first
    own = Window.partitionBy("id")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("often", "cell"))
    least = F.ceil(SIMILAR * F.col("n") - 1e-6)
    return common.select("id", "n", "cell", place.alias("place")).where(F.col("place") <= F.col("n") - least + 1)


def _length_class(n: Column) -> Column:
    """Class of a number of cells; each spans 2 % of its size, at least one number."""
    return F.floor(F.log(n.cast("double")) / float(np.log(1.02)) + 1e-9).cast("int")


def _candidates(texts: DataFrame, active: DataFrame, root: DataFrame) -> DataFrame:
    """(id, lead) of all pairs of ``texts`` that can be similar, are in
    different components (id, root) and of which one is ``active``.

    Let a pair's first common cell have ``r`` and ``r2`` cells from it on in
    texts of ``n`` <= ``n2`` cells.  They share no more than the smaller of both
    and must share ``NEED * (n + n2)``, so the shorter text's partner has at
    most ``r / NEED - n`` cells, and 1.25 n: the pairs are joined on the cell
    and the classes of these lengths, and texts that share a common passage but
    too little else are never paired.
    """
    entries = _prefixes(texts).join(root, "id", "left").join(active.withColumn("on", F.lit(True)), "id", "left")
    entries = entries.select("id", "n", "cell", (F.col("n") - F.col("place") + 1).alias("r"), F.coalesce("root", "id").alias("root"),
                             F.coalesce("on", F.lit(False)).alias("on"))
    entries = written(entries.withColumn("size", _length_class(F.col("n"))), "minhash-prefixes")
    most = F.floor(F.least(F.col("n") / SIMILAR, F.col("r") / NEED - F.col("n")) + 1e-6)
    short = entries.where(most >= F.col("n")).withColumn("size", F.explode(F.sequence("size", _length_class(most))))
    short = written(short, "minhash-short")
    long = entries.select("cell", "size", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "r", "root", "on")])
    enough = F.least("r", "r2") >= NEED * (F.col("n") + F.col("n2")) - 1e-6
    # components are paired before their texts, so a group of copies costs nothing in its own buckets
    held = short.groupBy("cell", "size", "root").agg(F.max("on").alias("on"), F.min("n").alias("n"), F.max("r").alias("r"))
    held2 = long.groupBy("cell", "size", "root2").agg(F.max("on2").alias("on2"), F.min("n2").alias("n2"), F.max("r2").alias("r2"))
    roots = written(held, "minhash-roots").join(written(held2, "minhash-roots"), ["cell", "size"])
    roots = roots.where((F.col("root") != F.col("root2")) & (F.col("on") | F.col("on2")) & enough)
    roots = written(roots.select("cell", "size", "root", "root2", F.col("n2").alias("least_n2"), F.col("r2").alias("most_r2"),
                                 F.col("on2").alias("any2")), "minhash-root-pairs")
    one = roots.join(short, ["cell", "size", "root"]).where(
        (F.least("r", "most_r2") >= NEED * (F.col("n") + F.col("least_n2")) - 1e-6) & (F.col("on") | F.col("any2")))
    one = written(one.select("cell", "size", "root2", "id", "n", "r", "on"), "minhash-short-pairs")
    ordered = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") < F.col("id2")))
    both = one.join(long, ["cell", "size", "root2"]).where(ordered & enough & (F.col("n") >= SIMILAR * F.col("n2") - 1e-6) & (F.col("on") | F.col("on2")))
    return both.select(F.greatest("id", "id2").alias("id"), F.least("id", "id2").alias("lead")).distinct()


def links(docs: DataFrame, firsts: DataFrame, signed: DataFrame | None = None) -> DataFrame:
    """(id, lead) pairs of different texts that are similar, which tie together
    all texts that a chain of similar pairs does; ``firsts`` (id, bands) has
    one row per text (of the ids in ``docs``), and its signature (sig) or the
    row of ``signed`` (row, sig) that holds it."""
    spark = docs.sparkSession
    path = scratch_path(spark, "minhash-links")
    pair = "id long, lead long"
    entries = _weighted(firsts.select("id", F.explode("bands").alias("band")))
    # written, so that the join can split the entries of a large bucket
    lead = written(_leaders(entries), "minhash-leaders")
    # one row for each entry of a bucket of two or more but its leader
    led = written(entries.join(lead, "band").where("id <> lead").select("band", "id", "lead"), "minhash-led")
    if not (rows := led.count()):
        return spark.createDataFrame([], pair)
    ids = written(led.select("id").union(lead.select(F.col("lead").alias("id"))).distinct(), "minhash-ids")
    some = maybe_broadcast(ids, BROADCAST_IDS)  # then neither texts nor signatures move
    sigs = firsts.join(some, "id", "left_semi")
    if signed is not None:  # signatures stay where they are until it is known which are compared
        at = written(sigs.select("id", "row"), "minhash-rows")
        sigs = signed.select("row", "sig").join(maybe_broadcast(at, BROADCAST_IDS), "row")
    sigs = written(sigs.select("id", "sig"), "minhash-sigs")
    texts = written(docs.join(some, "id", "left_semi").dropDuplicates(["id"]), "minhash-texts")

    def near(pairs: DataFrame, name: str) -> DataFrame:
        close = written(_agreeing(pairs.join(sigs, "id").join(
            sigs.select(F.col("id").alias("lead"), F.col("sig").alias("lead_sig")), "lead")), "minhash-close")
        both = close.join(texts, "id").join(texts.select(F.col("id").alias("lead"), F.col("text").alias("lead_text")), "lead")
        _near(both).write.parquet(f"{path}/{name}")
        return spark.read.schema(pair).parquet(f"{path}/{name}")

    found = near(sized(led.select("id", "lead").distinct(), rows), "leaders")
    left = written(led.join(found, ["id", "lead"], "left_anti"), "minhash-left")
    if left.isEmpty():
        return found
    # buckets with a text that is not near the leader: all their texts are compared exactly, near the leader or not
    active = written(left.select("id").distinct(), "minhash-active")
    open_ = written(led.join(left.select("band").distinct(), "band", "left_semi").select("id").distinct(), "minhash-open")
    root = written(components(found), "minhash-covered")
    pairs = written(_candidates(texts.join(open_, "id", "left_semi"), active, root), "minhash-candidates")
    return found.union(near(pairs, "others"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each component of edges (id, lead).

    Alternates the large-star and small-star steps, which take a number of
    rounds logarithmic in a component's size and never gather a component.
    """
    n = 2 * edges.count()  # no step makes more edges than twice as many
    e = edges.select(F.greatest("id", "lead").alias("u"), F.least("id", "lead").alias("v")).where("u > v")
    e = written(sized(e.distinct(), n), "cc")
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join can split the edges of one node
        low = written(sized(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), n), "cc-least")
        # every larger neighbour of u is tied to the smallest id around u
        e = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(sized(e.distinct(), n), "cc")
        # every smaller neighbour, and u, to the smallest: a node has few smaller ones by now
        tied = e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = written(sized(tied.select("x.u", "x.v").where("u > v").distinct(), n), "cc")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _stars(e: DataFrame) -> bool:
    """Whether each edge's larger end has one edge and its smaller end none upwards."""
    kinds = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = kinds.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, kept) of every id: its group's smallest id, and whether it is that id."""
    thin = narrow(docs, id=id_col, text=text_col).where(F.col("id").isNotNull()).withColumn("text", whole("text"))
    thin = thin.withColumn("id", F.col("id").cast("long"))
    # the row number is only used once it is written
    signed = written(signatures(thin).withColumn("row", F.monotonically_increasing_id()), "minhash-signed")
    first = signed.groupBy("h1", "h2").agg(F.min(F.struct("id", "row")).alias("x"))
    texts = written(first.select("h1", "h2", F.col("x.id").alias("rep"), "x.row"), "minhash-reps")
    # rows that repeat an id with another text tie the two texts together
    member = written(signed.select("id", "h1", "h2").join(texts.drop("row"), ["h1", "h2"]).select("id", "rep").distinct(), "minhash-members")
    # one row of each text, without its signature, which few texts need and which takes most of the space
    firsts = written(signed.select("id", "row", "bands").join(texts.select("row"), "row", "left_semi"), "minhash-firsts")
    near = links(thin, firsts, signed).select(F.greatest("id", "lead").alias("id"), F.least("id", "lead").alias("lead"))
    near = written(near.distinct(), "minhash-edges")
    root = components(near.union(member.where("id <> rep").select("id", F.col("rep").alias("lead"))))
    own = member.groupBy("id").agg(F.min("rep").alias("rep"))
    out = own.join(root, "id", "left").select("id", F.coalesce("root", "id").alias("class_id"))
    return out.withColumn("kept", F.col("id") == F.col("class_id"))


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id and kept of every row."""
    groups = near_groups(docs, id_col, text_col).withColumnRenamed("id", "_id")
    out = docs.select(F.col(f"`{id_col}`").alias(id_col)).join(groups, F.col(id_col) == F.col("_id"), "left")
    return out.select(id_col, "class_id", F.coalesce("kept", F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id."""
    gone = near_groups(docs, id_col, text_col).where(~F.col("kept"))
    key = free_name(docs.columns, "_gone")
    return docs.join(gone.select(F.col("id").alias(key)), F.col(f"`{id_col}`") == F.col(key), "left_anti")
