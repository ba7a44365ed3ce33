"""From raw documents to packed training sequences: quality, near copies, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave.llm import jaccard_join, packing, quality, secret_tags
from riskweave.llm.common import keep, remainder, table

WORDS = public_tokenizers.path("word_bpe_49k.json")
END = 2
QUALITY = 0.7


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at QUALITY or above.

    It learns from the labels of training documents (crc32 of the id modulo 4 is not 2).  Without
    enough labels there is no classifier and every document stays.  Rows with a null doc_id are
    scored like all others; rows of one id and different texts are kept or dropped one by one.
    """
    rows = keep(quality.measure(docs), "statistics")
    model = quality.fit(rows.where(remainder("doc_id", 4) != 2), table(spark, sf_dir, "labels"))
    return docs if model is None else quality.filtered(docs, model, QUALITY)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, then the smallest hash of its text.

    The contract of the operator: three-word shingles, Jaccard similarity 0.9 or more.  Rows
    of one id with different texts are judged one by one; of rows that differ in other columns
    alone the one with the smallest hash stays.  Empty texts and rows without an id have no copies
    and stay.
    """
    named = jaccard_join.grouped(docs.select("doc_id", "text"), k=3, num=90, den=100)
    first = named.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("r"))
    own = ["_id", "_mark"]
    while {c.lower() for c in own} & {c.lower() for c in docs.columns}:          # names that no column of the documents has
        own = [f"_{c}" for c in own]
    kept = first.select(F.col("r.doc_id").alias(own[0]), F.col("r.mark").alias(own[1]))
    plain = F.col("doc_id").isNull() | (F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t-\r ]", "")) == "")
    rows = docs.where(~plain).withColumn(own[0], F.col("doc_id").cast("long")).withColumn(own[1], jaccard_join.text_mark())
    one = rows.join(kept, own, "left_semi").groupBy(*own).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("r"))
    return one.select("r.*").unionByName(docs.where(plain))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mask; n_chars follows."""
    return secret_tags.redact(docs, secret_tags.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of power-of-two length with their ids."""
    return packing.pack(docs, WORDS, END)


STAGES = [("quality", good_quality), ("near copies", one_of_each_group), ("secrets", without_secrets), ("packing", packed)]

ORACLE_SQL = None                  # classifiers and tokens are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return keep(STAGES[-1][1](spark, docs, sf_dir), "packed")
