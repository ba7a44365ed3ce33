"""Byte-level BPE with a segment tree over byte positions.

A piece starts as one symbol per byte.  The tree's leaf i holds the rank of the pair
that starts at position i, its inner nodes the leftmost minimum below, so the root names
the next merge.  A merge changes three leaves (the pair itself, the pair to its left and
the vanished right half) and their paths to the root: logarithmic work, no rescans.

Short pieces of equal tree width are merged side by side in numpy, one merge of every
piece a step; long pieces run through the same tree one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from riskweave.llm.common import Memo, documents, windows

NONE = np.int64(1) << 40          # rank of a pair that is no token
WIDE = 512                        # pieces above this many bytes go one by one
ENCODED = "doc_id long, ids binary"

# white space of the split pattern: what Unicode calls White_Space
SPACE = r"\t-\r \x85\xa0  -     　"
AWKWARD = regex.compile(rf"[{SPACE}][ ]|[ ][{SPACE}]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def plain_space(pattern: str) -> str:
    r"""The pattern with \s and \S spelled out, as regex engines differ on control characters."""
    inside = regex.sub(r"\[\^[^\]]*\]", lambda m: m[0].replace(r"\s", SPACE), pattern)
    return inside.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


class Encoder:
    """Ids of texts by merge ranks; a text is split by the pattern first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 400_000):
        self.find = regex.compile(plain_space(pattern)).findall
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.ranks = ranks
        self.memo = Memo(self._chunks, memo)

    # -- merging -----------------------------------------------------------------
    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; NONE where a side is missing (-1) or the pair is no token."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.values[at], NONE)

    def _merge_many(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Merge pieces of at most `width` bytes (a power of two), all of them one merge a step."""
        n, shift = len(pieces), width.bit_length() - 1
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        size = np.array([len(p) for p in pieces])
        place = np.arange(width)
        symbol = np.full((n, width + 2), -1, np.int64)       # column width: the end; column width + 1: before the start
        symbol[:, :width] = np.where(place < size[:, None], self.byte[flat], -1)
        after = np.broadcast_to(np.append(place + 1, [width, width]), (n, width + 2)).copy()
        before = np.broadcast_to(np.append(place - 1, [width + 1, width + 1]), (n, width + 2)).copy()
        before[:, 0] = width + 1
        tree = np.full((n, 2 * width), NONE << shift, np.int64)
        tree[:, width:] = self._rank(symbol[:, :width], np.concatenate([symbol[:, 1:width], symbol[:, width:width + 1]], 1)) << shift | place
        for low in (width >> k for k in range(1, shift + 1)):
            tree[:, low:2 * low] = np.minimum(tree[:, 2 * low:4 * low:2], tree[:, 2 * low + 1:4 * low:2])
        live = np.flatnonzero(tree[:, 1] >> shift < NONE)
        while len(live):
            at = tree[live, 1] & (width - 1)
            gone = after[live, at]
            behind, ahead = before[live, at], after[live, gone]
            symbol[live, at], symbol[live, gone] = tree[live, 1] >> shift, -1
            after[live, at], before[live, ahead] = ahead, at
            leaves = [(gone, np.full(len(live), NONE)), (at, self._rank(symbol[live, at], symbol[live, ahead]))]
            leaves.append((np.where(behind > width, gone, behind),
                           np.where(behind > width, NONE, self._rank(symbol[live, behind], symbol[live, at]))))
            for leaf, rank in leaves:
                node = leaf + width
                tree[live, node] = rank << shift | leaf
                for _ in range(shift):
                    node = node >> 1
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
            live = live[tree[live, 1] >> shift < NONE]
        return [row[row >= 0] for row in symbol[:, :width]]

    def _merge_one(self, piece: bytes) -> np.ndarray:
        """The same tree over plain lists, for one long piece."""
        width = 1 << (len(piece) - 1).bit_length()
        shift, none, pairs = width.bit_length() - 1, int(NONE), self.pairs
        symbol = [int(self.byte[b]) for b in piece] + [-1] * (width + 2 - len(piece))
        after, before = list(range(1, width + 3)), list(range(-1, width + 1))

        def rank(i: int, j: int) -> int:
            return pairs.get(symbol[i] << 20 | symbol[j], none) if symbol[i] >= 0 and symbol[j] >= 0 else none

        tree = [none << shift] * (2 * width)
        tree[width:] = [rank(i, i + 1) << shift | i for i in range(width)]
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] >> shift < none:
            at = tree[1] & (width - 1)
            gone, behind = after[at], before[at]
            symbol[at], symbol[gone] = tree[1] >> shift, -1
            after[at] = ahead = after[gone]
            before[ahead] = at
            for leaf, value in ((gone, none), (at, rank(at, ahead)), (behind, rank(behind, at) if behind >= 0 else None)):
                if value is not None:
                    node = leaf + width
                    tree[node] = value << shift | leaf
                    while node := node >> 1:
                        tree[node] = min(tree[2 * node], tree[2 * node + 1])
        return np.array([s for s in symbol if s >= 0], np.int64)

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > WIDE:
                out[i] = self._merge_one(piece).astype("<u4").tobytes()
            elif piece:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            step = max(1, (1 << 18) // width)
            for k in range(0, len(members), step):
                part = members[k:k + step]
                for i, ids in zip(part, self._merge_many([pieces[i] for i in part], width)):
                    out[i] = ids.astype("<u4").tobytes()
        return out

    # -- texts -------------------------------------------------------------------
    def _chunks(self, chunks: list[str]) -> Iterator[bytes]:
        """Ids of chunks as _cut gives them, each split by the pattern."""
        split = [[m.encode("utf-8", "surrogatepass") for m in self.find(c[:-1] if c[-1:] == " " else " " + c)] for c in chunks]
        distinct = list({p for pieces in split for p in pieces})
        ids = dict(zip(distinct, self.pieces(distinct)))
        return (b"".join(map(ids.__getitem__, pieces)) for pieces in split)

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text.

        A text is cut before each blank that stands between two other characters: no match
        of the pattern runs across such a place, so chunks can be encoded one by one and
        remembered.  Where white space meets white space, the text is left whole.
        """
        return self.memo.join([self._cut(t) for t in texts])

    def _cut(self, text: str) -> list[str]:
        """Chunks of a text: one that ends in a blank stands for what precedes that blank, any other for a blank and itself."""
        if not text:
            return []
        parts = text.split(" ")
        if not parts[0] or not parts[-1] or AWKWARD.search(text):
            return [piece + " " for piece in self.find(text)]
        parts[0] += " "
        return parts


class Decoder:
    """Bytes and decimal text of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.name = list(map(str, range(len(self.token))))

    def __call__(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decimal(self, ids: list[int]) -> str:
        return ",".join(map(self.name.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def _encode(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, pattern).texts
    for window in windows(batches):
        yield pa.RecordBatch.from_arrays([window.column("doc_id"), pa.array(encode(window.column("text").to_pylist()), pa.binary())], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of the whole text (little-endian unsigned 32-bit), a row for every row.

    Null and empty texts have no ids; repeated rows are encoded each; further columns are
    left out.  path is a file of ranks that every worker can read.
    """
    return documents(docs).mapInArrow(partial(_encode, path=path, pattern=pattern), ENCODED)


def _decode(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    decode = decoder(path)
    for window in windows(batches, "ids", 1 << 22):
        texts = [decode(np.frombuffer(ids, "<u4").tolist()) for ids in window.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([window.column("doc_id"), window.column("ids"), pa.array(texts, pa.binary())], ["doc_id", "ids", "bytes"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The bytes that the ids stand for, beside them."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=path), f"{ENCODED}, bytes binary")
