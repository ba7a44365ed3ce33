"""Spelling variants against a brute-force reading."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from riskweave.llm import spelling
from riskweave.llm.queries import op13_spelling
from tests.llm.data import awkward, empty


def literal(rows):
    n = collections.Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near, patterns = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            less = w[:i] + w[i + 1:]
            if less in n:
                near[w].add(less), near[less].add(w)
            patterns[i, less].add(w)
    for group in patterns.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    out = [(i, " ".join("".join(rnd.choice("abcÀ") for _ in range(rnd.randint(4, 8))) for _ in range(rnd.choice([0, 5, 300])))) for i in range(200)]
    # very long words, a hot word in one document, words of one multiset of letters
    anagrams = ["".join(rnd.sample("abcdefgh", 8)) for _ in range(300)]
    return out + [(900, ("x" * 3000 + " ") * 3 + ("x" * 2999 + "y ") * 9), (901, "hotword " * 5000 + "hotwords " * 4), (902, " ".join(anagrams * 3 + [a[:-1] + "z" for a in anagrams[:40]] * 7)), (None, "abcda " * 5), (903, None), (904, "")]


@pytest.mark.parametrize("cell_letters,sample", [(1 << 17, 1 << 16), (600, 1 << 16), (200, 300)])
def test_equals_brute_force(spark, rows, cell_letters, sample):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = literal(rows)
    assert sum(w[3] for w in want.values()) > 1000 and sum(w[0] is not None for w in want.values()) > 100
    assert rows_of(spelling.variants(df, cell_letters=cell_letters, sample=sample)) == want


def test_query_equals_brute_force_on_a_table(spark, small):
    table = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op13_spelling(spark, small)) == literal(table)


def test_chains_are_followed_to_their_end(spark):
    counts = [("aaaaa" + "b" * i, 3 * 2 ** i) for i in range(12)]          # each is one insertion from the next
    df = spark.createDataFrame([(w, n, len(w)) for w, n in counts], "word string, n long, length int")
    known = df.join(spelling.near_words(df), "word").where("form_n >= 2 * n")
    got = {r.word: r.root for r in spelling.roots_of(known).collect()}
    assert got == {w: counts[-1][0] for w, _ in counts[:-1]}


def test_awkward_and_empty(spark):
    assert rows_of(spelling.variants(awkward(spark))) == literal([(r.doc_id, r.text) for r in awkward(spark).collect()])
    assert spelling.variants(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(empty(spark), ratio=1)


def test_cells_are_reached_from_every_near_word():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcde"), 6)) for _ in range(500)]
    tree = spelling.Cells(spelling.counts_of(spelling.codes_of(words)), 16)
    own = {words[i]: c for i, c in zip(*tree.reached(spelling.counts_of(spelling.codes_of(words)), 0, 0))}
    r, c = tree.reached(spelling.counts_of(spelling.codes_of(words)), 1, 1)
    reach = collections.defaultdict(set)
    for i, cell in zip(r, c):
        reach[words[i]].add(int(cell))
    assert all(len(v) <= 16 for v in reach.values())
    for a in words:
        for b in words:
            if sum(x != y for x, y in zip(a, b)) == 1:
                assert int(own[b]) in reach[a]
