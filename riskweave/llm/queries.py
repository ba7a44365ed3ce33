"""The registered queries of this subpackage: thin wrappers that derive the asked columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave.llm import bpe, gru_lm, jaccard_join, license_scan, m_tree, packing, quality, secret_tags, spelling, substring_dedup, token_store, vp_search, whitening
from riskweave.llm.common import keep, remainder, scratch, table, windows

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
QUALITY = 0.7
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 7) == 2
    learned = docs.where(~held_out)
    counts = gru_lm.count_tokens(learned)
    vocab = gru_lm.vocabulary(counts)
    scores = gru_lm.score(docs, counts, vocab, gru_lm.train(learned, vocab))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "tokens")
    token_store.write_store(docs, folder, WORD_VOCABULARY, end=1)
    return token_store.read_store(spark, folder).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def _digests(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Number, decimal text and decoded bytes of each row's ids."""
    decode = bpe.decoder(path)
    for window in windows(batches, "ids", 1 << 22):
        rows = [np.frombuffer(ids, "<u4").tolist() for ids in window.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [window.column("doc_id"), pa.array(map(len, rows), pa.int64()),
             pa.array([hashlib.sha256(decode.decimal(r).encode()).hexdigest() for r in rows], pa.string()),
             pa.array([hashlib.sha256(decode(r)).hexdigest() for r in rows], pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return ids.mapInArrow(partial(_digests, path=BYTE_RANKS), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_secret_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_tags.scan(docs, secret_tags.fit(docs))
    joined = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("spans", lambda s: s.kind != "crf")).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep(quality.measure(table(spark, sf_dir, "documents")), "statistics")
    held_out = remainder("doc_id", 4) == 2
    model = quality.fit(rows.where(~held_out), table(spark, sf_dir, "labels"))
    return quality.score(rows, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= QUALITY, 1).otherwise(0).alias("predicted"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = license_scan.scan(docs, license_scan.fit(docs))
    return found.select(
        "doc_id", "paragraphs", F.size("notices").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("notices.family")), ",").alias("families"),
        F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n.family, n.start, n.end)), ",").alias("notices"))


def op9_m_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m_tree.top_products(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_power_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_VOCABULARY, end=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")))
    return each.select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation", F.col("col.whitened").alias("whitened"), F.col("col.explained").alias("explained"), "identity_error")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_gru_lm": op1_gru_lm, "op2_vp_search": op2_vp_search, "op3_token_store": op3_token_store, "op4_byte_bpe": op4_byte_bpe, "op5_secret_tags": op5_secret_tags, "op6_quality": op6_quality,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_license_scan": op8_license_scan, "op9_m_tree": op9_m_tree,
        "op10_power_packing": op10_power_packing,
        "op11_seed_extend": op11_seed_extend, "op12_jacobi_davidson": op12_jacobi_davidson, "op13_spelling": op13_spelling,
    }


OP9_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r) AS component_id FROM sets s JOIN reach ON s.doc_id = reach.doc_id GROUP BY s.doc_id, s.s
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs)),
earliest AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN earliest USING (k) WHERE doc_id > lo),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.p) AS words
  FROM each e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_jaccard_join": OP7_SQL, "op9_m_tree": OP9_SQL, "op11_seed_extend": OP11_SQL}
