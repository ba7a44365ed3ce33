"""Document log-likelihood under a gated recurrent language model with class-factored output.

Words are what stands between ASCII white space, lower-cased in A-Z; every document closes with
an end token.  The FREQUENT most frequent training tokens stand in classes of neighbouring
frequency: the output is P(class | state) * P(word | class, state).  All other tokens stand in
one of TAILS tail classes by their last two bytes, and within it P(word) = (c + 1) / (n + v + 1)
with n tokens and v words of the class in training; the 1 is the share of unknown words.  So
the probabilities of all outcomes sum to one.

Training is one pass over all training documents by truncated back-propagation in numpy.  The
corpus is cut into rounds and shards by hashes of the texts, one shard for about SHARD_TOKENS
tokens; in a round every shard starts from the common weights, follows its own documents in the order of
their hashes, and the weights are averaged by tokens (a sum in Spark).  So the model is a function of the
documents, not of tasks or partitions.  A document begins behind an end token, in training as in scoring,
which carries each document's state from window to window, whatever its length.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.common import documents, keep, windows

END = b""                          # the token behind every document; no word is empty
FREQUENT, CLASS_WORDS, TAILS = 2048, 64, 16
CLASSES = FREQUENT // CLASS_WORDS
COUNTED = 1 << 18                  # words whose counts every worker holds; rarer ones are joined
HIDDEN, STEPS, LANES = 16, 16, 256
ROUNDS = (1, 4, 11)                # shares of the training documents in the rounds of averaging
RATE = 0.01
SHARD_TOKENS = 8_000_000
RUN = 1 << 22                      # bytes of text that a trainer follows at a time


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


# -- counts ------------------------------------------------------------------------
def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts, handed on whenever they reach a bound."""
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

    for window in windows(batches):
        for text in window.column("text").to_pylist():
            held.update(tokens(text))
        held[END] += window.num_rows
        if len(held) > 300_000:
            yield out()
            held.clear()
    if held:
        yield out()


def count_tokens(docs: DataFrame) -> DataFrame:
    """word (binary; empty: the end token) and c over all documents."""
    parts = documents(docs).select("text").mapInArrow(_counts, "word binary, c long")
    return keep(parts.groupBy("word").agg(F.sum("c").alias("c")), "counts")


@dataclass
class Vocabulary:
    """The bounded part of the counts: index and count of the COUNTED most frequent tokens, and totals."""

    words: list[bytes]             # by falling count, ties by bytes
    counts: np.ndarray
    total: int                     # N
    distinct: int                  # V
    tail_tokens: np.ndarray        # n of each tail class
    tail_words: np.ndarray         # v of each tail class

    def __post_init__(self):
        self.code = {w: i for i, w in enumerate(self.words[:FREQUENT])}
        self.start = int(self.codes([END])[0])          # what stands before a document

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Input code of each token: frequent ones by rank, others by tail class."""
        got = list(map(self.code.get, words))
        return np.array([FREQUENT + zlib.crc32(w[-2:]) % TAILS if g is None else g for g, w in zip(got, words)], np.int32)


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    # a histogram of the counts tells which of them COUNTED words reach, so no more are fetched
    level = F.when(F.col("c") < 1024, F.col("c")).otherwise(1024 + F.floor(64 * F.log2(F.col("c") / 1024)))
    least, held = 1 << 60, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += r["count"]
        if held > COUNTED:
            break
        least = r.level
    top = counts.where(level >= F.lit(least)).collect()
    top.sort(key=lambda r: (-r.c, bytes(r.word)))
    words, c = [bytes(r.word) for r in top], np.array([r.c for r in top], np.int64)
    tail = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(TAILS)).alias("tail")
    n, v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in counts.groupBy(tail).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n[r.tail], v[r.tail] = r.n, r.v
    for w, k in zip(words[:FREQUENT], c[:FREQUENT].tolist()):
        n[zlib.crc32(w[-2:]) % TAILS] -= k
        v[zlib.crc32(w[-2:]) % TAILS] -= 1
    return Vocabulary(words, c, int(total or 0), int(distinct), n, v)


# -- model -------------------------------------------------------------------------
def initial(vocab: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; output biases are the logarithms of the training frequencies."""
    rng = np.random.default_rng(7)
    h, inputs, outputs = HIDDEN, FREQUENT + TAILS, CLASSES + TAILS
    c = np.zeros(FREQUENT)
    c[:min(FREQUENT, len(vocab.counts))] = vocab.counts[:FREQUENT]
    mass = np.concatenate([(c + 0.01).reshape(CLASSES, -1).sum(1), vocab.tail_tokens + vocab.tail_words + 1.0])
    some = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {"embed": some(inputs, h, scale=0.3), "wx": some(h, 3 * h, scale=h ** -0.5), "wh": some(h, 3 * h, scale=h ** -0.5),
            "b": np.zeros(3 * h, np.float32), "wc": some(h, outputs, scale=0.05), "bc": np.log(mass / mass.sum()).astype(np.float32),
            "wo": some(CLASSES, CLASS_WORDS, h, scale=0.02), "bo": np.log((c + 0.01).reshape(CLASSES, -1)).astype(np.float32)}


def _gate(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-a))


def _exponents(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of a's rows and their sums; a is shifted in place, by one number where no row vanishes under it, else row by row."""
    a -= a.max()
    e = np.exp(a)
    z = e.sum(1)
    if z.min() < 1e-25:
        a -= a.max(1, keepdims=True)
        e = np.exp(a)
        z = e.sum(1)
    return e, z


def _logits(h: np.ndarray, target: np.ndarray, p: dict, grad: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probabilities of classes and words of the targets, and the gradient for h."""
    word = target < FREQUENT
    klass = np.where(word, target // CLASS_WORDS, CLASSES + target - FREQUENT)
    a = h @ p["wc"] + p["bc"]
    if not len(a):
        return np.zeros(0, np.float32), np.zeros_like(h)
    e, z = _exponents(a)
    rows = np.arange(len(h))
    out = a[rows, klass] - np.log(z)
    dh = None
    if grad is not None:
        da = e / -z[:, None]
        da[rows, klass] += 1
        grad["wc"] += h.T @ da
        grad["bc"] += da.sum(0)
        dh = da @ p["wc"].T
    order = np.argsort(klass, kind="stable")
    bounds = np.searchsorted(klass[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        own = order[bounds[c]:bounds[c + 1]]
        if not len(own):
            continue
        hc, at = h[own], target[own] - c * CLASS_WORDS
        a = hc @ p["wo"][c].T + p["bo"][c]
        e, z = _exponents(a)
        rows = np.arange(len(own))
        out[own] += a[rows, at] - np.log(z)
        if grad is not None:
            da = e / -z[:, None]
            da[rows, at] += 1
            grad["wo"][c] += da.T @ hc
            grad["bo"][c] += da.sum(0)
            dh[own] += da @ p["wo"][c]
    return out, dh


class Trainer:
    """Truncated back-propagation with Adam from given weights."""

    def __init__(self, weights: dict[str, np.ndarray], start: int):
        self.start = start
        self.p = {k: v.copy() for k, v in weights.items()}
        self.first = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = self.seen = 0

    def stream(self, codes: np.ndarray, starts: np.ndarray) -> None:
        """Follow a run of documents: target codes, and flags where a document begins."""
        lanes = max(1, min(LANES, len(codes) // (4 * STEPS)))
        length = -(-len(codes) // lanes)
        pad = lanes * length - len(codes)
        target = np.append(codes, np.zeros(pad, np.int32)).reshape(lanes, length).T
        live = np.append(np.ones(len(codes), bool), np.zeros(pad, bool)).reshape(lanes, length).T
        begin = np.append(starts, np.ones(pad, bool)).reshape(lanes, length).T
        source = np.concatenate([[self.start], codes[:-1], np.zeros(pad, np.int32)]).reshape(lanes, length).T
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, length, STEPS):
            h = self._window(source[t:t + STEPS], target[t:t + STEPS], begin[t:t + STEPS], live[t:t + STEPS], h)

    def _window(self, source, target, begin, live, h):
        p, n, (steps, lanes) = self.p, HIDDEN, source.shape
        x = p["embed"][source]
        gx = x @ p["wx"] + p["b"]
        kept, states = [], np.empty((steps, lanes, n), np.float32)
        for t in range(steps):
            h = h * ~begin[t][:, None]
            gh = h @ p["wh"]
            zr = _gate(gx[t, :, :2 * n] + gh[:, :2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(gx[t, :, 2 * n:] + r * gh[:, 2 * n:])
            kept.append((h, z, r, c, gh[:, 2 * n:]))
            h = states[t] = c + z * (h - c)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("embed",)}
        at = np.flatnonzero(live.ravel())
        _, d = _logits(states.reshape(-1, n)[at], target.ravel()[at], p, g)
        dstates = np.zeros((steps * lanes, n), np.float32)
        dstates[at] = d
        dstates = dstates.reshape(steps, lanes, n)
        dgx, dh = np.empty_like(gx), np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            before, z, r, c, ghc = kept[t]
            dh = dh + dstates[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * ghc * r * (1 - r)
            dgx[t, :, :n], dgx[t, :, n:2 * n], dgx[t, :, 2 * n:] = dz, dr, dc
            dgh = dgx[t].copy()
            dgh[:, 2 * n:] *= r
            g["wh"] += before.T @ dgh
            dh = (dh * z + dgh @ p["wh"].T) * ~begin[t][:, None]
        flat = dgx.reshape(-1, 3 * n)
        g["wx"], g["b"] = x.reshape(-1, n).T @ flat, flat.sum(0)
        dx, code = flat @ p["wx"].T, source.ravel()
        embed = np.stack([np.bincount(code, dx[:, k], len(p["embed"])) for k in range(n)], 1).astype(np.float32)
        self._adam(g | {"embed": embed}, len(at))
        return h

    def _adam(self, grad: dict, n: int) -> None:
        self.steps += 1
        self.seen += n
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values())) / max(n, 1)
        scale = min(1.0, 1.0 / max(size, 1e-9)) / max(n, 1)
        for k, g in grad.items():
            g = g * np.float32(scale)
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            m = self.first[k] / (1 - 0.9 ** self.steps)
            v = self.second[k] / (1 - 0.99 ** self.steps)
            self.p[k] += np.float32(RATE) * m / (np.sqrt(v) + 1e-7)


def _follow(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Weights of every shard; rows come sorted by shard.  Runs are cut by bytes of text, whatever the batches."""
    vocab, weights = pickle.loads(shared.value)
    shard, trainer, held, size = None, None, [], 0

    def follow() -> None:
        runs = [vocab.codes(tokens(t) + [END]) for t in held]
        starts = np.zeros(sum(map(len, runs)), bool)
        starts[np.cumsum([0] + [len(r) for r in runs[:-1]])] = True
        trainer.stream(np.concatenate(runs), starts)

    def out() -> Iterator[pa.RecordBatch]:
        for name, w in trainer.p.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([w.ravel()], pa.list_(pa.float32())), pa.array([trainer.seen], pa.int64())], ["name", "w", "seen"])

    for batch in batches:
        for own, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist()):
            if own != shard or size > RUN:
                if held:
                    follow()
                held, size = [], 0
            if own != shard:
                if trainer is not None:
                    yield from out()
                shard, trainer = own, Trainer(weights, vocab.start)
            held.append(text)
            size += len(text)
    if held:
        follow()
        yield from out()


def train(docs: DataFrame, vocab: Vocabulary, shard_tokens: int = SHARD_TOKENS) -> dict[str, np.ndarray]:
    """Weights after one pass over all given documents, averaged in each of ROUNDS."""
    weights = initial(vocab)
    if not vocab.total:
        return weights
    context = docs.sparkSession.sparkContext
    small = Vocabulary(vocab.words[:FREQUENT], vocab.counts[:FREQUENT], vocab.total, vocab.distinct, vocab.tail_tokens, vocab.tail_words)
    shares = np.cumsum((0,) + ROUNDS)
    place = F.pmod(F.xxhash64("text", "doc_id"), F.lit(int(shares[-1])))           # copies under other ids spread
    shards = max(1, -(-vocab.total // shard_tokens))
    for low, high in zip(shares[:-1].tolist(), shares[1:].tolist()):
        shared = context.broadcast(pickle.dumps((small, weights)))
        rows = documents(docs).where((place >= low) & (place < high)).withColumn("shard", F.pmod(F.xxhash64("text", "doc_id", F.lit(1)), F.lit(shards)).cast("int"))
        dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.xxhash64("text", "doc_id", F.lit(2)), "doc_id", "text")
        parts = dealt.select("shard", "text").mapInArrow(partial(_follow, shared=shared), "name string, w array<float>, seen long")
        sums = parts.select("name", "seen", F.posexplode("w").alias("at", "w")).groupBy("name", "at").agg(
            (F.sum(F.col("w").cast("double") * F.col("seen")) / F.sum("seen")).alias("w"))
        for r in sums.toLocalIterator():
            weights[r.name].reshape(-1)[r.at] = r.w
        shared.unpersist()
    return weights


# -- scoring -----------------------------------------------------------------------
def likelihood(runs: list[np.ndarray], p: dict[str, np.ndarray], start: int, steps: int = 32) -> np.ndarray:
    """Natural log-likelihood of each run of codes behind the code start, whole; states go from window to window."""
    order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
    size = np.array([len(runs[i]) for i in order])
    table = (p["embed"] @ p["wx"] + p["b"]).astype(np.float32)
    total, n = np.zeros(len(runs)), HIDDEN
    h = np.zeros((len(runs), n), np.float32)
    for t in range(0, int(size.max(initial=0)), steps):
        lanes = int(np.searchsorted(-size, -t))      # longer than t
        width = min(steps, int(size[0]) - t)
        target = np.full((lanes, width), -1, np.int32)
        source = np.zeros((lanes, width), np.int32)
        for k in range(lanes):
            run = runs[order[k]]
            part = run[t:t + width]
            target[k, :len(part)] = part
            source[k, :len(part)] = run[t - 1:t - 1 + len(part)] if t else np.append(np.int32(start), part[:-1])
        states, own = np.empty((width, lanes, n), np.float32), h[:lanes]
        for s in range(width):
            gx, gh = table[source[:, s]], own @ p["wh"]
            zr = _gate(gx[:, :2 * n] + gh[:, :2 * n])
            c = np.tanh(gx[:, 2 * n:] + zr[:, n:] * gh[:, 2 * n:])
            own = states[s] = c + zr[:, :n] * (own - c)
        h[:lanes] = own
        at = np.flatnonzero(target.T.ravel() >= 0)
        found, _ = _logits(states.reshape(-1, n)[at], target.T.ravel()[at], p, None)
        total[:lanes] += np.bincount(at % lanes, found, lanes)
    out = np.empty(len(runs))
    out[order] = total
    return out


SCORED = "row long, doc_id long, n_tokens long, known long, base double, model double, rare array<struct<word:binary,n:long>>"


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, weights: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every row; a null text is empty.

    Counts of the COUNTED most frequent words are at hand in every task; rarer words of a
    document are joined with the table of counts, so no count is left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((vocab, weights)))
    size = vocab.total + vocab.distinct + 1
    tail_size = np.log10(vocab.tail_tokens + vocab.tail_words + 1.0)

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, weights = pickle.loads(shared.value)
        log = dict(zip(vocab.words, np.log10(vocab.counts + 1.0).tolist()))
        row = TaskContext.get().partitionId() << 33
        for window in windows(batches, chars=1 << 24):
            runs, rows = [], []
            for doc, text in zip(window.column("doc_id").to_pylist(), window.column("text").to_pylist()):
                words = tokens(text)
                words.append(END)
                codes = vocab.codes(words)
                runs.append(codes)
                found = np.fromiter(map(log.get, words, repeat(np.nan)), float, len(words))      # a word without a count at hand is not a number
                known, tail = ~np.isnan(found), codes >= FREQUENT
                rare = Counter(words[i] for i in np.flatnonzero(~known).tolist())
                # counts of all words and of those beyond the frequent ones add up apart
                rows.append((row, doc, len(words), int(known.sum()), float(found[known].sum()) - len(words) * np.log10(size),
                             float(found[known & tail].sum()) - float(tail_size[codes[tail] - FREQUENT].sum()),
                             [{"word": w, "n": k} for w, k in rare.items()]))
                row += 1
            model = likelihood(runs, weights, vocab.start) / np.log(10)
            columns = list(zip(*rows))
            kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()),
                 pa.array(columns[4], pa.float64()), pa.array(model + np.array(columns[5])), pa.array(columns[6], kind)],
                ["row", "doc_id", "n_tokens", "known", "base", "model", "rare"])

    rows = keep(documents(docs).mapInArrow(rate, SCORED), "scored")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts, "word").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    return rows.drop("rare").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))
