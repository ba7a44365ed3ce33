"""What the operators share: reading tables, staging, windows of rows, memoised pieces."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave.session import checkpoint_root, configure, stage

__all__ = ["table", "documents", "keep", "scratch", "windows", "Memo", "remainder", "hot_join"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text counts as empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a costly intermediate to the shared folder and read it back."""
    return stage(df, name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_root(spark)}/llm/{uuid.uuid4().hex}/{name}"


def remainder(doc_id, divisor: int):
    """crc32 of the id's decimal text, modulo the divisor; a null id gives 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor, F.lit(0))


def windows(batches: Iterable[pa.RecordBatch], column: str = "text", chars: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a window holds about `chars` bytes of the column (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > chars:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size + 1
        if begin < batch.num_rows:
            yield batch.slice(begin)


SHARES = 1000


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with keyed (one row a key; n: how many of the `total` rows hold the key), no key in one task.

    A key is hot when it holds more than one of SHARES parts of all rows, so there are fewer than SHARES hot
    keys whatever the input, and they are broadcast; the rows of all other keys meet them in a shuffle.
    """
    is_hot = F.col("n") * SHARES > total
    hot, cold = keyed.where(is_hot).drop("n"), keyed.where(~is_hot).drop("n")
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return rows.join(F.broadcast(hot), on, how).unionByName(rest)


class Memo:
    """Bytes of every distinct piece, worked out once a worker while they are in use.

    Two generations of at most `most` pieces: a full one becomes the old one, and what is
    asked for again moves back.  So memory is bounded and nothing is left out; a piece that
    was forgotten is worked out again.
    """

    def __init__(self, compute: Callable[[list], Iterable[bytes]], most: int = 400_000):
        self.compute, self.most, self.young, self.old = compute, most, {}, {}

    def join(self, docs: list[list]) -> list[bytes]:
        """For each list of pieces, the bytes of its pieces in a row."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        distinct = list(set().union(*docs))
        here = dict(zip(distinct, map(young.get, distinct)))     # small and close by, unlike the whole memo
        missing = [p for p, g in here.items() if g is None]
        if missing:
            found = {p: g for p, g in zip(missing, map(old.get, missing)) if g is not None}
            order = [p for p in missing if p not in found] if found else missing
            found.update(zip(order, self.compute(order)))
            here.update(found)
            young.update(found)
        return [b"".join(map(here.__getitem__, pieces)) for pieces in docs]
