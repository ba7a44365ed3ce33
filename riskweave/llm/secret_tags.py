"""Secrets in texts: fixed patterns, and a linear-chain CRF that tags tokens begin, inside, outside.

The CRF sees each token's shape, the shapes of its neighbours and features of the whole file.
It is trained by gradient steps on the exact log-likelihood (forward-backward) over windows of
corpus tokens: the patterns label the secrets they know, and planted secrets of further
families, in contexts with and without key words, teach the rest.  Decoding is Viterbi.

A token whose outside score, with its own neighbours and file, beats both other labels by more
than the transitions can add is outside on every best path; next to such tokens the transitions
are known, which rules out more.  These tokens cut the chain, so Viterbi runs on the short
stretches between them and the result is that of the whole chain.  The weights themselves know
no bounds but the penalty of the fit.
"""

from __future__ import annotations

import json
import pickle
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.common import documents, windows

# fixed patterns of the base kinds, in listed order, and the least length of the piece that counts
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")   # maximal runs, so the same spans as any run cut at 16 letters
KINDS = ("assign", "access", "hex", "crf")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"

MARKS = "\"'`,;.!?()[]{}<>|*%$&#"
AROUND = ("<key", "<mark", "<long", ">key", ">mark", ">long", "|keys", "|code")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
SAMPLE_ROWS = 1000                # documents whose windows train the CRF, at most
WINDOW = 13                       # tokens in a training window
WINDOWS_PER_DOC = 3
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost and non-overlapping per kind, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _long_hex(text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _long_hex(text: str) -> bool:
    """Whether a run of HEX_LEAST hexadecimal letters occurs."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    breaks = np.flatnonzero(~_HEX_BYTE[raw])
    return bool(len(raw)) and int(np.diff(np.concatenate([[-1], breaks, [len(raw)]])).max()) > HEX_LEAST


# -- features --------------------------------------------------------------------
def shape(word: str) -> list[str]:
    """Features of a token by itself."""
    core = word.strip(MARKS)
    n, digits = len(core), sum(c.isdigit() for c in core)
    upper, lower = sum(c.isupper() for c in core), sum(c.islower() for c in core)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:]))
    size = min(n // 4, 12)
    kind = "".join(k for k, on in zip("aA9-", (lower, upper, digits, n - digits - upper - lower)) if on)
    return [f"size{size}", f"kind{kind}", f"kind{kind}/{size}", f"kind{kind}/turns{min(turns, 3)}", f"digits{min(9, 10 * digits // max(n, 1))}", f"turns{min(turns, 8)}",
            f"mixed{min(turns, 4)}/{size}", f"distinct{10 * len(set(core)) // max(n, 1)}/{size}", f"head{_family(core)}", f"key{_key(word)}",
            f"mark{'=' in word or ':' in word}/{kind}", f"at{'@' in word or '//' in word or word.count('.') >= 3}"]


HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "AIza", "eyJ", "npm_", "hf_")
HINTS = ("passw", "secret", "token", "api", "credential", "bearer", "private", "auth")
TELLING = re.compile("|".join(HEADS) + "|(?i:" + "|".join(HINTS) + ")")


def _family(core: str) -> str:
    """Opening that well-known credentials carry."""
    for head in HEADS:
        if head in core:
            return head
    return ""


def _key(word: str) -> str:
    low = word.lower()
    return next((k for k in HINTS if k in low), "")


def beside(word: str) -> list[str]:
    """What a token tells about its neighbours."""
    return [f"key{_key(word)}", f"mark{word[-1:] if word[-1:] in '=:' else ''}", f"long{len(word) >= 16}"]


def of_file(text: str) -> list[str]:
    """Features of the whole text, the same for all its tokens."""
    low = text.lower()
    return [f"keys{any(k in low for k in KEYS)}", f"code{min(3, 400 * (text.count('=') + text.count('{')) // max(1, len(text)))}"]


# -- model -----------------------------------------------------------------------
@dataclass
class Tagger:
    weights: dict[str, np.ndarray]     # feature -> scores of begin, inside, outside
    turns: np.ndarray                  # label, next label

    def __post_init__(self):
        gain = lambda w: max(w[BEGIN], w[INSIDE]) - w[OUTSIDE]
        groups: dict[str, float] = {}
        for feature, w in self.weights.items():
            if feature[0] != ".":
                group = next(g for g in AROUND if feature.startswith(g))
                groups[group] = max(groups.get(group, 0.0), gain(w))
        t = self.turns
        # the most that the turns before and behind add to begin and inside over outside: beside a token
        # that is outside for certain, beside any other, at an end of the text
        before, behind = t[:, :OUTSIDE] - t[:, OUTSIDE:], (t[:OUTSIDE] - t[OUTSIDE]).T
        self.before = np.array([before[OUTSIDE], before.max(0), [0.0, 0.0]])
        self.behind = np.array([behind[OUTSIDE], behind.max(0), [0.0, 0.0]])
        # the most that neighbours, file and turns can add to begin or inside over outside
        self.reach = sum(groups.values()) + float((self.before.max(0) + self.behind.max(0)).max())
        self.zero, self.plain = np.zeros(3), {}

    def _sum(self, features: list[str]) -> np.ndarray:
        return sum((self.weights.get(f, self.zero) for f in features), self.zero)

    def parts(self, word: bytes) -> np.ndarray:
        """What a token adds to begin and inside over outside: for itself, the next token and the one before."""
        text = word.decode("utf-8", "replace")
        core, known = text.strip(MARKS), None
        if core.isascii() and core.isalpha() and not TELLING.search(text):
            # ASCII letters alone: the features are functions of these few values
            known = (len(core) // 4, core.islower(), core.isupper(), 10 * len(set(core)) // len(core), "=" in text or ":" in text, text.count(".") >= 3, text[-1] if text[-1] in "=:" else "", len(text) >= 16)
            if known in self.plain:
                return self.plain[known]
        told = tuple(beside(text))
        if told not in self.plain:
            self.plain[told] = [self._sum([side + f for f in told]) for side in "<>"]
        found = np.concatenate([w[:OUTSIDE] - w[OUTSIDE] for w in (self._sum(["." + f for f in shape(text)]), *self.plain[told])])
        if known is not None:
            self.plain[known] = found
        return found

    def unsure(self, word: bytes) -> bool:
        """Whether the token could be anything but outside in some place."""
        return bool(self.parts(word)[:2].max() + self.reach >= 0)

    def open(self, parts: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Whether each token of a text, with its parts, could be anything but outside on a best path."""
        gain = parts[:, :2] + (around[:OUTSIDE] - around[OUTSIDE] + 1e-9)
        gain[1:] += parts[:-1, 2:4]
        gain[:-1] += parts[1:, 4:]
        kind = np.ones(len(parts) + 2, np.int64)       # of each token and the ends, a row of before and behind
        kind[[0, -1]] = 2
        at = np.arange(len(parts))
        while True:
            sure = (gain[at] + self.before[kind[at]] + self.behind[kind[at + 2]]).max(1) < 0
            if not sure.any():
                return kind[1:-1] == 1
            kind[at[sure] + 1] = 0
            at = at[~sure]

    def scores(self, words: list[str], around: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Label scores of tokens begin..end."""
        out = []
        for i in range(begin, end):
            features = ["." + f for f in shape(words[i])]
            if i:
                features += ["<" + f for f in beside(words[i - 1])]
            if i + 1 < len(words):
                features += [">" + f for f in beside(words[i + 1])]
            out.append(self._sum(features) + around)
        return np.array(out)

    def viterbi(self, scores: np.ndarray, left: bool, right: bool) -> list[int]:
        """Best labels; left and right say whether an outside token stands there."""
        best, back = scores[0] + (self.turns[OUTSIDE] if left else 0), []
        for row in scores[1:]:
            ways = best[:, None] + self.turns
            back.append(ways.argmax(0))
            best = ways.max(0) + row
        label = int((best + (self.turns[:, OUTSIDE] if right else 0)).argmax())
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]

    def spans(self, text: str, unsure: list[bool]) -> list[tuple[int, int]]:
        """Character spans of tagged secrets; unsure holds a flag per token."""
        places = [m.span() for m in TOKEN.finditer(text)]
        words = [text[a:b] for a, b in places]
        around, found, i = self._sum(["|" + f for f in of_file(text)]), [], 0
        while i < len(words):
            if not unsure[i]:
                i += 1
                continue
            j = i
            while j < len(words) and unsure[j]:
                j += 1
            labels = self.viterbi(self.scores(words, around, i, j), i > 0, j < len(words))
            for k, label in enumerate(labels, i):
                if label == BEGIN or label == INSIDE and (k == i or labels[k - i - 1] == OUTSIDE):
                    found.append(places[k])
                elif label == INSIDE:
                    found[-1] = (found[-1][0], places[k][1])
            i = j
        return found


def train(examples: list[tuple[list[list[str]], list[int]]], steps: int = 80, rate: float = 0.15, decay: float = 3e-4) -> Tagger:
    """Fit by Adam steps on the mean log-likelihood of windows (feature lists, labels) of equal length."""
    names = {f: i for i, f in enumerate(sorted({f for tokens, _ in examples for fs in tokens for f in fs}))}
    most = max(len(fs) for tokens, _ in examples for fs in tokens)
    n, length, size = len(examples), len(examples[0][1]), len(names)
    at = np.full((n, length, most), size)
    for a, (tokens, _) in enumerate(examples):
        for t, fs in enumerate(tokens):
            at[a, t, :len(fs)] = [names[f] for f in fs]
    gold = np.array([labels for _, labels in examples])
    one = np.eye(3)[gold]
    theta = np.zeros((size + 4, 3))    # features, an idle row, three rows of turns
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    flat = at.reshape(-1)

    def total(a):
        top = a.max(-1, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(-1, keepdims=True)))[..., 0]

    for step in range(1, steps + 1):
        turns, scores = theta[size + 1:], theta[at].sum(2)
        alpha, beta = [scores[:, 0]], [np.zeros((n, 3))]
        for t in range(1, length):
            alpha.append(total((alpha[-1][:, :, None] + turns).transpose(0, 2, 1)) + scores[:, t])
        for t in range(length - 1, 0, -1):
            beta.append(total(turns + (scores[:, t] + beta[-1])[:, None, :]))
        alpha, beta = np.stack(alpha, 1), np.stack(beta[::-1], 1)
        z = total(alpha[:, -1])
        alone = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + turns + (scores + beta)[:, 1:, None, :] - z[:, None, None, None])
        change = np.repeat((one - alone).reshape(-1, 3), most, axis=0)
        grad = np.stack([np.bincount(flat, change[:, k], size + 4) for k in range(3)], 1)
        seen = np.einsum("ntj,ntk->jk", one[:, :-1], one[:, 1:])
        grad[size + 1:] = seen - pair.sum((0, 1))
        grad = grad / n - decay * theta
        grad[size] = 0
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        theta = theta + rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Tagger({f: theta[i] for f, i in names.items()}, theta[size + 1:])


# -- training windows --------------------------------------------------------------
def _plant(rng: random.Random) -> list[str]:
    """Tokens of a made-up secret of some family, with or without a key word before it."""
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    value = rng.choice([
        lambda: "AKIA" + some(alnum[:26] + alnum[52:], 16), lambda: "ghp_" + some(alnum, 36), lambda: "glpat-" + some(alnum + "-_", 20),
        lambda: "xoxb-" + some("0123456789", 11) + "-" + some(alnum, 24), lambda: "sk-" + some(alnum, rng.choice([32, 48])), lambda: "AIza" + some(alnum + "-_", 35),
        lambda: "eyJ" + some(alnum, 30) + "." + some(alnum, 40) + "." + some(alnum + "-_", 43), lambda: some("0123456789abcdef", rng.choice([16, 20, 32, 40, 64])),
        lambda: some(alnum + "+/", rng.choice([24, 32, 40, 64])) + rng.choice(["", "=", "=="])])()
    key = rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "client_secret", "auth_token", "Bearer", "credential"])
    form = rng.randrange(5)
    if form == 0:
        return [value]
    if form == 1:
        return [f"{key}{rng.choice('=:')}{value}"]
    if form == 2:
        return [key, "=", f'"{value}"']
    return [f"{key}:", value] if form == 3 else [f'"{key}":', f'"{value}",']


def _decoy(rng: random.Random, words: list[str]) -> list[str]:
    """A token that looks unusual and is no secret."""
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    return [rng.choice([
        lambda: f"{some(lower, 6)}.{some(lower, 7)}@{some(lower, 6)}.com", lambda: f"https://{some(lower, 8)}.org/{some(lower, 5)}/{some(lower + digits, 6)}",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: f"{some(digits, 3)}-{some(digits, 4)}", lambda: f"20{some(digits, 2)}-0{rng.randint(1, 9)}-1{some(digits, 1)}",
        lambda: "".join(rng.choice(words) for _ in range(3))[:40], lambda: rng.choice(words).upper(), lambda: "-".join(some(lower, 5) for _ in range(rng.randint(2, 4))),
        lambda: f"/{some(lower, 4)}/{some(lower, 6)}/{some(lower, 7)}.txt", lambda: some(digits, rng.randint(3, 12)), lambda: f"v{some(digits, 1)}.{some(digits, 2)}.{some(digits, 1)}"])()]


def windows_of(text: str, seed: int) -> list[tuple[list[list[str]], list[int]]]:
    """Training windows of a text: around pattern hits, at random places, and with a planted secret."""
    places = [m.span() for m in TOKEN.finditer(text)]
    if len(places) < WINDOW:
        return []
    rng, spans = random.Random(seed), base_spans(text)
    words, labels = [text[a:b] for a, b in places], [OUTSIDE] * len(places)
    for a, b, _ in spans:
        own = [i for i, (x, y) in enumerate(places) if x < b and y > a]
        for k, i in enumerate(own):
            labels[i] = INSIDE if k and labels[own[k - 1]] != OUTSIDE else BEGIN if labels[i] == OUTSIDE else labels[i]
    last = len(words) - WINDOW
    starts = [min(last, max(0, i - rng.randrange(WINDOW))) for i, y in enumerate(labels) if y == BEGIN][:WINDOWS_PER_DOC]
    starts += [rng.randint(0, last) for _ in range(WINDOWS_PER_DOC - len(starts) + 1)]
    around, out = ["|" + f for f in of_file(text)], []
    for k, s in enumerate(starts):
        own, tags = words[s:s + WINDOW], labels[s:s + WINDOW]
        if tags[0] == INSIDE:
            tags = [BEGIN, *tags[1:]]
        if k == len(starts) - 1:
            new, at = _plant(rng), rng.randrange(1, WINDOW - 6)
            if all(t == OUTSIDE for t in tags[at:at + len(new) + 1]):
                own[at:at + len(new)], tags[at:at + len(new)] = new, [BEGIN, *[INSIDE] * (len(new) - 1)]
            if tags[-2:] == [OUTSIDE, OUTSIDE]:
                own[-2:-1] = _decoy(rng, words)
        rows = []
        for i, word in enumerate(own):
            features = ["." + f for f in shape(word)]
            features += ["<" + f for f in beside(own[i - 1])] if i else []
            features += [">" + f for f in beside(own[i + 1])] if i + 1 < WINDOW else []
            rows.append(features + around)
        out.append((rows, tags))
    return out


def _examples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in windows(batches):
        rows = [json.dumps(w) for text, seed in zip(batch.column("text").to_pylist(), batch.column("seed").to_pylist()) for w in windows_of(text, seed)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["example"])


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Tagger | None:
    """Train on windows of the `rows` documents with the smallest id hashes; None without any window.

    Only windows reach the driver, at most rows * (WINDOWS_PER_DOC + 1) of WINDOW tokens.
    """
    docs = documents(docs)
    place = F.xxhash64("doc_id")
    last = docs.select(place.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return None
    found = docs.where(place <= last).limit(rows).select("text", place.alias("seed")).mapInArrow(_examples, "example string").collect()
    examples = sorted(r.example for r in found)
    return train([tuple(json.loads(e)) for e in examples]) if examples else None


# -- scanning --------------------------------------------------------------------
def outside(span: tuple[int, int], base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of a span that no base span covers: what the tagger saw beyond a pattern's end is secret too."""
    out, at = [], span[0]
    for a, b in sorted((a, b) for a, b, _ in base if a < span[1] and b > span[0]):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, span[1])] if at < span[1] else out


class Scanner:
    """All spans of texts: the patterns', and the parts of the CRF's that lie outside them."""

    def __init__(self, tagger: Tagger | None, most: int = 300_000):
        self.tagger, self.most = tagger, most
        # parts of the words met, in two generations
        self.place, self.parts = {}, np.empty((1024, 6))
        self.older, self.older_parts = self.place, self.parts

    def open(self, text: str, words: list[bytes]) -> np.ndarray:
        """Whether each token could be anything but outside."""
        if len(self.place) > self.most:
            self.older, self.older_parts = self.place, self.parts
            self.place, self.parts = {}, np.empty((1024, 6))
        for w in set(words).difference(self.place):
            n, before = len(self.place), self.older.get(w)
            if n == len(self.parts):
                self.parts = np.concatenate([self.parts, np.empty_like(self.parts)])
            self.parts[n] = self.tagger.parts(w) if before is None else self.older_parts[before]
            self.place[w] = n
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return self.tagger.open(self.parts[at], self.tagger._sum(["|" + f for f in of_file(text)]))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        base = base_spans(text)
        words = text.encode("utf-8", "replace").split()
        if self.tagger is None or not words:
            return base
        left = self.open(text, words)
        if not left.any():
            return base
        found = [(a, b, "crf") for span in self.tagger.spans(text, left.tolist()) for a, b in outside(span, base) if any(map(str.isalnum, text[a:b]))]
        return sorted(base + found, key=lambda s: (s[0], KINDS.index(s[2])))


@lru_cache(maxsize=1)
def _scanner(key: bytes) -> Scanner:
    return Scanner(pickle.loads(key))


def _scan(batches: Iterable[pa.RecordBatch], tagger: bytes, mask: str | None) -> Iterator[pa.RecordBatch]:
    scanner = _scanner(tagger)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for window in windows(batches):
        texts = window.column("text").to_pylist()
        found = [scanner.spans(t) for t in texts]
        if mask is None:
            rows = [[{"kind": k, "start": a, "end": b} for a, b, k in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([window.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])
        else:
            at = window.schema.get_field_index("text")
            columns = list(window.columns)
            columns[at] = pa.array([masked(t, s, mask) for t, s in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, window.schema.names)


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """The text with every stretch that spans cover replaced by the mask."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        out += [text[at:a], mask] if a >= at else []
        at = b
    return "".join([*out, text[at:]])


def _pickled(tagger: Tagger | None) -> bytes:
    return pickle.dumps(tagger)


def scan(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id and all spans of each whole text (null: empty), in code points, by start, then kind."""
    return documents(docs).mapInArrow(partial(_scan, tagger=_pickled(tagger), mask=None), SPANS)


def redact(docs: DataFrame, tagger: Tagger | None, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by the mask; other columns stay, n_chars follows the text.

    A null text stays null.
    """
    changed = docs.where(F.col("text").isNotNull()).mapInArrow(partial(_scan, tagger=_pickled(tagger), mask=mask), docs.schema)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(docs.columns).unionByName(docs.where(F.col("text").isNull()))
