"""Groups of spelling variants: words one edit apart, found in k-d trees over letter counts.

A word is the vector of its letter counts.  Replacing a letter takes one count down and another one
up (L1 distance two); inserting a letter takes one count up.  So the words near a word of length L lie in
the boxes within one step up and one step down among the words of length L, and within one step up among
those of length L + 1; order of letters is verified for what is found there.  Deletions are
the insertions seen from the other side.

Two levels of k-d trees, one pair of levels a length.  The upper level is cut from a bounded sample and
deals the words into cells; a word is sent as a query to every cell of its own length and of the next
length that its steps can reach, which is a number of cells polynomial in the tree's depth, not the
number of cells.  In a task, the lower level is built over the words of one cell with tight boxes, and
the queries go down it in blocks.  For whole vectors of equal length, squared Euclidean distance two says
the same as one step up and one down (one: one step up), so a leaf is one matrix product.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.common import keep, windows

RUN = regex.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = 26 + 64                  # a-z, U+00C0-U+00FF
SLIP = 97
CELL_LETTERS = 1 << 17             # letters of the words in one cell, about
SAMPLE = 1 << 16                   # words of each length that the upper level is cut from
LEAF, BLOCK = 64, 4096
HELD = 200_000                     # words counted in a worker before they are passed on


def _runs(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """word, n of the runs of a batch of documents, slips made."""
    held: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for rows in windows(batches):
        for name, text in zip(rows.column("name").to_pylist(), rows.column("text").to_pylist()):
            here: dict[str, int] = {}
            for w in RUN.findall(text.translate(LOWER)):
                if len(w) >= least:
                    here[w] = here.get(w, 0) + 1
            start = zlib.crc32(name.encode() + b":")
            for w, n in here.items():
                h = zlib.crc32(w.encode(), start)
                if h % SLIP == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1:]
                    if len(w) < least:
                        continue
                held[w] = held.get(w, 0) + n
        if len(held) >= HELD:
            yield out()
            held = {}
    if held:
        yield out()


def vocabulary(docs: DataFrame, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """word, n (occurrences in all documents) and length of the words that are long and frequent enough.

    A run whose crc32 with its document's id is divisible by SLIP loses a letter.  A null id has an
    empty name; a null text has no runs.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = rows.mapInArrow(partial(_runs, least=least_letters), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count).withColumn("length", F.length("word"))


def codes_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(words, dtype=np.str_).view(np.uint32).reshape(len(words), -1).astype(np.int32)


def counts_of(codes: np.ndarray) -> np.ndarray:
    """Letter counts of each row."""
    letter = np.where(codes < 128, codes - ord("a"), codes - 0xC0 + 26)
    flat = letter + (np.arange(len(codes)) * LETTERS)[:, None]
    return np.bincount(flat.ravel(), minlength=len(codes) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


def _cut(counts: np.ndarray) -> tuple[int, int] | None:
    """Letter and count at or below which about half of the rows lie; None where all rows are equal."""
    best, found = len(counts), None
    for letter in np.flatnonzero(counts.min(0) != counts.max(0)):
        column = np.sort(counts[:, letter])
        middle = column[(len(column) - 1) // 2]
        for border in (middle - 1, middle):
            low = int(np.searchsorted(column, border, "right"))
            off = abs(2 * low - len(column))
            if 0 < low < len(column) and off < best:
                best, found = off, (int(letter), int(border))
    return found


class Cells:
    """The upper level of one length: half-spaces cut from a sample."""

    def __init__(self, counts: np.ndarray, cells: int):
        self.size = 0
        self.root = self._grow(counts, cells)

    def _grow(self, counts: np.ndarray, cells: int):
        cut = _cut(counts) if cells > 1 and len(counts) > 1 else None
        if cut is None:
            self.size += 1
            return self.size - 1
        low = counts[:, cut[0]] <= cut[1]
        return (*cut, self._grow(counts[low], cells // 2), self._grow(counts[~low], cells - cells // 2))

    def reached(self, counts: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the cells within so many steps up and down; none of either: the row's own cell."""
        rows, cells = [], []

        def visit(node, active: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            if not len(active):
                return
            if not isinstance(node, tuple):
                rows.append(active), cells.append(np.full(len(active), node))
                return
            letter, border, left, right = node
            value = counts[active, letter]
            for child, bound, side in ((left, np.minimum(high[:, letter], border), high), (right, np.maximum(low[:, letter], border + 1), low)):
                moved = side.copy()
                moved[:, letter] = bound
                one, two = (low, moved) if child is left else (moved, high)
                inside = (np.maximum(0, one - counts[active]).sum(1) <= up) & (np.maximum(0, counts[active] - two).sum(1) <= down)
                visit(child, active[inside], one[inside], two[inside])

        everyone = np.arange(len(counts))
        wide = np.iinfo(np.int32).max // 4
        visit(self.root, everyone, np.zeros_like(counts), np.full_like(counts, wide))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(cells)


def upper_level(words: DataFrame, cell_letters: int = CELL_LETTERS, sample: int = SAMPLE) -> dict[int, Cells]:
    """Cells of every length with more than one; a length's sample is its words of smallest hash."""
    sizes = {r.length: r["count"] for r in words.groupBy("length").count().collect()}
    wanted = {length: -(-n * length // cell_letters) for length, n in sizes.items() if n * length > cell_letters}
    if not wanted:
        return {}
    # the smallest hashes by a threshold, so that no sort over a whole length is needed
    share = {length: min(1.0, sample / sizes[length]) for length in wanted}
    bound = F.create_map(*[F.lit(v) for length, s in share.items() for v in (length, int(s * (1 << 32)))])
    taken = words.where(F.col("length").isin(list(wanted))).where((F.xxhash64("word").bitwiseAND(F.lit((1 << 32) - 1))) < bound[F.col("length")])
    found: dict[int, list[str]] = {}
    for r in taken.select("word", "length").toLocalIterator():
        found.setdefault(r.length, []).append(r.word)
    return {length: Cells(counts_of(codes_of(sorted(ws))), min(wanted[length], max(1, len(ws) // 8))) for length, ws in found.items()}


ROUTED = "length int, cell int, asks int, word string, n long"
POINT, SAME, LONGER = 0, 1, 2      # a word of the cell; a query of its length; a query one letter shorter


def _route(batches: Iterable[pa.RecordBatch], trees: dict[int, Cells]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = batch.column("length").to_numpy(zero_copy_only=False)
        for size in np.unique(length).tolist():
            every = np.flatnonzero(length == size)
            step = max(1, (1 << 22) // max(size, LETTERS))
            for i in range(0, len(every), step):
                own = batch.take(pa.array(every[i:i + step]))
                counts = counts_of(codes_of(own.column("word").to_pylist()))
                for asks, target, up, down in ((POINT, size, 0, 0), (SAME, size, 1, 1), (LONGER, size + 1, 1, 0)):
                    tree = trees.get(target)
                    rows, cells = tree.reached(counts, up, down) if tree else (np.arange(len(counts)), np.zeros(len(counts), np.int64))
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), target), pa.int32()), pa.array(cells, pa.int32()), pa.array(np.full(len(rows), asks), pa.int32()),
                         own.column("word").take(at), own.column("n").take(at)], ["length", "cell", "asks", "word", "n"])


class Tree:
    """The lower level: words of one length with tight boxes around every node."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = np.array(words, object), np.array(n, np.int64)
        self.codes = codes_of(words)
        counts = counts_of(self.codes)
        self.kind = np.float32 if self.codes.shape[1] < 1000 else np.float64      # squares stay exact
        self.counts = counts
        self.points = counts.astype(self.kind)
        self.square = (self.points ** 2).sum(1)
        self.root = self._grow(np.arange(len(words)))

    def _grow(self, places: np.ndarray):
        counts = self.counts[places]
        box = (counts.min(0), counts.max(0))
        cut = _cut(counts) if len(places) > LEAF else None
        if cut is None:
            return box, places, None
        low = counts[:, cut[0]] <= cut[1]
        return box, self._grow(places[low]), self._grow(places[~low])

    def near(self, words: list[str], longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """Queries and places of the words one replacement away, or (longer) one insertion away."""
        codes = codes_of(words)
        counts = counts_of(codes)
        vectors = counts.astype(self.kind)
        square = (vectors ** 2).sum(1)
        down = 0 if longer else 1
        want = 1 if longer else 2
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def visit(node, active: np.ndarray) -> None:
            (low, high), left, right = node
            here = counts[active]
            active = active[(np.maximum(0, low - here).sum(1) <= 1) & (np.maximum(0, here - high).sum(1) <= down)]
            if not len(active):
                return
            if right is not None:
                visit(left, active)
                visit(right, active)
                return
            for i in range(0, len(left), BLOCK):
                part = left[i:i + BLOCK]
                apart = square[active][:, None] + self.square[part] - 2 * (vectors[active] @ self.points[part].T)
                q, p = np.nonzero(apart == want)
                if len(q):
                    q, p = active[q], part[p]
                    right_order = self._inserted(codes[q], self.codes[p]) if longer else (codes[q] != self.codes[p]).sum(1) == 1
                    found.append((q[right_order], p[right_order]))

        for i in range(0, len(words), BLOCK):
            visit(self.root, np.arange(i, min(i + BLOCK, len(words))))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(column) for column in zip(*found))

    @staticmethod
    def _inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
        """Whether one letter taken out of the longer word gives the shorter one."""
        head = np.cumprod(short == long[:, :-1], axis=1).sum(1)
        tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
        return head + tail >= short.shape[1]


NEAR = "word string, n_near long, form_n long, form string"


def _summary(word: np.ndarray, other: np.ndarray, other_n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each word: how many near words, and the most frequent (ties: smallest)."""
    if not len(word):
        return
    order = sorted(range(len(word)), key=lambda i: (word[i], -other_n[i], other[i]))
    word, other, other_n = word[order], other[order], other_n[order]
    head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(word[head], pa.string()), pa.array(np.diff(np.append(head, len(word))), pa.int64()), pa.array(other_n[head], pa.int64()), pa.array(other[head], pa.string())],
        ["word", "n_near", "form_n", "form"])


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by length, cell and kind: a cell's words come first, then its queries, block by block."""
    key, tree, kind = None, None, None
    words: list[str] = []
    n: list[int] = []

    def ask() -> Iterator[pa.RecordBatch]:
        nonlocal words, n
        if tree is not None and words:
            q, p = tree.near(words, kind == LONGER)
            asked, count = np.array(words, object), np.array(n, np.int64)
            yield from _summary(asked[q], tree.words[p], tree.n[p])
            if kind == LONGER:
                yield from _summary(tree.words[p], asked[q], count[q])
        words, n = [], []

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("length", "cell", "asks", "word", "n")]
        for length, cell, asks, word, occurrences in zip(*columns):
            if (length, cell) != key or asks != kind:
                if (length, cell) != key:
                    yield from ask()
                    tree = None
                elif kind == POINT:
                    tree, words, n = Tree(words, n), [], []
                else:
                    yield from ask()
                key, kind = (length, cell), asks
            elif asks != POINT and len(words) >= BLOCK:
                yield from ask()
            words.append(word), n.append(occurrences)
    yield from ask()


def near_words(words: DataFrame, cell_letters: int = CELL_LETTERS, sample: int = SAMPLE) -> DataFrame:
    """word, n_near, form_n and form (the near word of largest n, ties the smallest) of the words with near words."""
    routed = words.select("word", "n", "length").mapInArrow(partial(_route, trees=upper_level(words, cell_letters, sample)), ROUTED)
    found = routed.repartition("length", "cell").sortWithinPartitions("length", "cell", "asks").mapInArrow(_search, NEAR)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, ratio: int = 2, cell_letters: int = CELL_LETTERS, sample: int = SAMPLE) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the documents.

    docs: doc_id, text.  The form of a word is its near word of largest n if that is at least `ratio` times
    its own (ratio over one); the root is where following forms ends.  Words are distinct runs of letters,
    lower-cased in A-Z alone; null and empty texts have none.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least two, or forms could go round")
    words = keep(vocabulary(docs, least_letters, least_count), "words")
    joined = words.join(near_words(words, cell_letters, sample), "word", "left")
    is_form = F.col("form_n") >= ratio * F.col("n")
    known = keep(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms")
    roots = keep(roots_of(known), "roots")
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots_of(known: DataFrame) -> DataFrame:
    """word, root of the words that have a form.

    Each step at least doubles n, so chains are shorter than 64 and six rounds of doubling reach their ends.
    """
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = keep(roots, "steps")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = roots.join(further, "root", "left")
        if moved.where("next is not null").isEmpty():
            return roots
        roots = moved.select("word", F.coalesce("next", "root").alias("root"))
