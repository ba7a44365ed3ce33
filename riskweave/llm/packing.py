"""Packing by powers of two: every training sequence holds tokens of one document only.

A document of n tokens becomes floor(n / longest) pieces of the longest length and one piece
for each binary digit of the rest, longest first.  Each piece is a sequence of its own whose
length is a power of two, so nothing is padded and no sequence crosses documents; sequences
of equal length share a bucket.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from riskweave.llm.common import documents, windows
from riskweave.llm.word_ids import word_ids

LONGEST = 4096
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
# sequence_id: bucket (log2 of the length), input partition, place within both
BUCKET_BITS, PART_BITS = 59, 31


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Piece lengths of n tokens, all powers of two: whole longest ones, then the binary digits of the rest."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pieces(batches: Iterable[pa.RecordBatch], path: str, end: int, longest: int) -> Iterator[pa.RecordBatch]:
    encoder = word_ids(path)
    part = TaskContext.get().partitionId()
    used: dict[int, int] = defaultdict(int)
    for window in windows(batches):
        rows = []
        for doc, ids in zip(window.column("doc_id").to_pylist(), encoder.texts(window.column("text").to_pylist())):
            ids = np.append(ids, end).astype("<u4")
            start = 0
            for length in lengths(len(ids), longest):
                bucket = length.bit_length() - 1
                rows.append((doc, start, length, ids[start:start + length].tobytes(), len(ids),
                             bucket << BUCKET_BITS | part << PART_BITS | used[bucket], 0))
                used[bucket] += 1
                start += length
        if rows:
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def pack(docs: DataFrame, path: str, end: int, longest: int = LONGEST) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit) and their sequence.

    A document is the ids of its whole text by the tokenizers file at `path`, then `end`.  Null
    and empty texts become one piece of one token.  Repeated rows are packed each on their own;
    a null doc_id stays null.  One pass without a shuffle: sequence_id is made of the bucket, the
    input partition and a running number, so it is unique and sorts equal lengths together, and a
    task that runs again gives the same ids.  longest must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    return documents(docs).mapInArrow(partial(_pieces, path=path, end=end, longest=longest), PIECES)


def write_sequences(pieces: DataFrame, folder: str) -> None:
    """One folder per sequence length, the form a length-bucketed training loader reads."""
    pieces.select("length", "sequence_id", "doc_id", "start", "ids").write.partitionBy("length").parquet(folder)
