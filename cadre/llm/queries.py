"""The registered ``opN_*`` queries: each applies its operator, with
production parameters, to the whole table and derives the digest columns."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadre.llm import bpe, centroids, importance, line_dedup, lm, minhash, mixing, packing, pii, quality, simhash, suffix, token_counts
from cadre.llm.common import documents, ship, whole, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (keys of 40 code points or more) in 5 documents or more stay only
    in the largest doc_id that holds them."""
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(whole("text"), 256).alias("kept_sha256"))


ORACLE["op1_line_dedup"] = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line
), often AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, line, pos, o.k IS NOT NULL AND doc_id < o.last_doc AS dropped
  FROM keyed LEFT JOIN often o USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS BIGINT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


#: Stands for the secret that a real job passes.
SURROGATE_KEY = b"a key for the registered query"


@query
def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text with keyed surrogates for its personal data."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = pii.replace_personal_data(docs, SURROGATE_KEY)
    total = F.aggregate(F.map_values("n_mentions"), F.lit(0), lambda a, b: a + b)
    return out.select("doc_id", "text", total.cast("long").alias("n_mentions"), F.map_keys("n_mentions").alias("kinds"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures of every whole text and the verdict of the adaptive fences."""
    return quality.judge(documents(spark, sf_dir)).drop("n_full_lines")


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the bytes of 50-byte strings that also start
    in a document with a smaller id."""
    out = suffix.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and bigram scores of every whole text, learned from the texts not held out."""
    return lm.score_documents(documents(spark, sf_dir))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text and their decoding."""
    path = tokenizer_path("byte_bpe_50k.json")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = bpe.encode(docs, path, decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to weights 1, 2, 3, repeating, of their sources."""
    out, sources, size, copies = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    sources = sources.withColumnRenamed("source", "_source")
    out = out.join(sources, F.col("source").eqNullSafe(F.col("_source")), "left")
    return out.select("doc_id", F.col(size).alias("size"), "source_size", "target",
                      (F.col(size) * F.col(copies)).alias("taken"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and for every
    20th id the number of other documents within three bits."""
    prints = written(simhash.compare_edits(documents(spark, sf_dir)), "simhash")
    out = simhash.count_near(prints, 3, F.col("doc_id") % 20 == 0)
    return out.select("doc_id", "n_chars", "edited_sha256", simhash.as_hex(F.col("fp")).alias("fingerprint"),
                      simhash.as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
                      simhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                      simhash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near")


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies (weighted Jaccard of five-word runs of 0.8 or more)."""
    return minhash.near_rows(documents(spark, sf_dir))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text through a digest cache that starts empty."""
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


@query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every whole text towards the benchmark's words, and the ranks of the tenth drawn."""
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance.resample(documents(spark, sf_dir), target)


ORACLE["op11_importance"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), dw AS MATERIALIZED (
  SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) GROUP BY doc_id, w
), bw AS MATERIALIZED (
  SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM b) GROUP BY w
), crc_table AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
), word AS MATERIALIZED (
  SELECT w, xor(list_reduce([4294967295] || list_transform(range(1, strlen(w) + 1),
           lambda k: CAST('0x' || substr(hex(encode(w)), CAST(2 * k - 1 AS BIGINT), 2) AS BIGINT)),
           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw) AS every, crc_table
), s AS (SELECT bucket, sum(n) AS s FROM dw JOIN word USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN word USING (w) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(n), 0) FROM dw)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM bw)::DOUBLE AS t_all),
gain AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (bucket), total
), weighed AS (
  SELECT doc_id, sum(n * g) AS gains FROM dw JOIN word USING (w) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(words) AS n_features,
         CASE WHEN len(words) = 0 THEN 0 ELSE CAST((gains - ((gains % len(words)) + len(words)) % len(words)) // len(words) AS BIGINT) END AS weight,
         CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN weighed USING (doc_id)
), noisy AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM noisy WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM placed) THEN r END AS rank
FROM noisy LEFT JOIN placed USING (doc_id)
"""


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's token pieces in sequences of 1024 tokens."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 centroids of all 64-component vectors after five rounds, on the grid of 1/256."""
    out, found = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return centroids.with_inertia(out, found)


def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds written out, one assignment and one update each."""
    near = """a{r} AS MATERIALIZED (
  SELECT vec_id, x, v, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM (
    SELECT g.vec_id, g.x, g.v, m.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (g.v[i] - m.v[i]) * (g.v[i] - m.v[i]))) AS BIGINT) AS distance
    FROM grid g CROSS JOIN m{r} m) GROUP BY vec_id, x, v)"""
    move = """m{s} AS MATERIALIZED (
  SELECT m.c, coalesce(n.v, m.v) AS v FROM m{r} m LEFT JOIN (
    SELECT c, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY i) AS v FROM (
      SELECT c, i, sum(v[i]) AS s, count(*) AS k FROM a{r}, range(1, 65) p(i) GROUP BY c, i) GROUP BY c) n USING (c))"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [move.format(r=r, s=r + 1), near.format(r=r + 1)]
    return f"""
WITH grid AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS x, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64
), m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, vec_id, v) - 1 AS c, v FROM (
    SELECT sha256('2:' || vec_id) AS h, vec_id, v FROM grid ORDER BY h, vec_id, v LIMIT {k})
), {", ".join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN m{rounds} m USING (c)
"""


ORACLE["op13_centroids"] = _centroid_sql()
