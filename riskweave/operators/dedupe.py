"""Duplicate folding by fingerprint.

The fold walks the copies of a fingerprint in order: a copy replaces the kept one
when (severity rank, confidence) is strictly greater, otherwise it can only raise the
kept confidence.  Its end state has a closed form that needs no ordered walk:

* let R be the highest rank and s0 the first position with rank R; what came before
  s0 has no influence;
* the final confidence is the highest one at or after s0;
* the winner is the rank-R copy with the highest confidence c such that c is reached
  nowhere at or after s0 before that copy.

The first two are plain aggregates.  The third looks only at the first position of
each distinct confidence, so copies are collapsed by map-side aggregation before
anything is ordered, and a fingerprint that a third of all rows share shrinks to its
distinct confidence values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from riskweave.functions.scoring import severity_rank

KEYS = ["scan_id", "dedupe_hash"]


# A17 ----------------------------------------------------------------------
def fold_winners(findings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, seq, best, first_seq, copies) of every fingerprint that has copies."""
    slim = findings.select(*keys, "seq", severity_rank(F.col("severity")).alias("rank"), "confidence")
    groups = slim.groupBy(*keys).agg(
        F.min(F.struct((-F.col("rank")).alias("neg_rank"), F.col("seq").alias("s0"))).alias("top"),
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("copies"),
    ).filter("copies > 1").select(
        *keys, (-F.col("top.neg_rank")).alias("top_rank"), F.col("top.s0").alias("s0"), "first_seq", "copies")
    # merge join: the findings are laid out like the groups already are, and never broadcast
    levels = (
        slim.hint("merge").join(groups, keys).filter(F.col("seq") >= F.col("s0"))
        .groupBy(*keys, "confidence")
        .agg(F.min(F.when(F.col("rank") == F.col("top_rank"), F.col("seq"))).alias("top_at"),
             F.min("seq").alias("any_at"), F.min("first_seq").alias("first_seq"), F.min("copies").alias("copies"))
    )
    from_above = W.partitionBy(*keys).orderBy(F.desc("confidence")).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = levels.withColumn("reached", F.min("any_at").over(from_above))
    # the copy at s0 always reaches its own confidence first, so a winner exists
    return ranked.groupBy(*keys).agg(
        F.max_by("top_at", F.when(F.col("top_at") == F.col("reached"), F.col("confidence"))).alias("seq"),
        F.max("confidence").alias("best"), F.min("first_seq").alias("first_seq"), F.min("copies").alias("copies"))


def deduplicate(findings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Surviving findings, with raised confidence and their first-seen position.

    Fingerprints without copies pass as they are: the short list of repeated ones is
    joined to the findings, and where it is small enough for Spark to broadcast, the
    wide rows are not shuffled at all.
    """
    won = fold_winners(findings, keys).withColumnRenamed("seq", "_won")
    return (
        findings.join(won, keys, "left")
        .filter(F.col("_won").isNull() | (F.col("_won") == F.col("seq")))
        .withColumns({
            "confidence": F.coalesce("best", "confidence"),
            "first_seq": F.coalesce("first_seq", "seq"),
            "copies": F.coalesce("copies", F.lit(1)),
        })
        .drop("best", "_won")
    )
