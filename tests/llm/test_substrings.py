"""Passage removal against a literal reading of its rule."""

import random

import numpy as np
import pytest

from riskweave.llm import substring_dedup
from tests.llm.data import awkward, empty


def literal(rows, window):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i:i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i:i + window])] < d:
                    gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def passages():
    rnd = random.Random(5)
    shared = [[rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 40))] for _ in range(12)]
    rows = []
    for d in range(250):
        words = []
        for _ in range(rnd.randint(0, 6)):
            words += rnd.choice(shared) if rnd.random() < 0.7 else [rnd.choice("abcdefghijkl") for _ in range(rnd.randint(1, 9))]
        rows.append((d if rnd.random() < 0.97 else None, " ".join(words)))
    # repeated rows, two texts under one id, copies by the dozen, a text that repeats within itself
    return rows + rows[10:14] + [(20, "x y z"), (5, rows[100][1])] + [(300 + i, rows[7][1]) for i in range(40)] + [(400, "p q r s t u v w x y z " * 9), (401, None)]


@pytest.mark.parametrize("window,gram", [(10, 4), (12, 12), (5, 1)])
def test_equals_the_literal_rule(spark, passages, window, gram):
    df = spark.createDataFrame(passages, "doc_id long, text string").repartition(5)
    want = literal(passages, window)
    assert sum(r[2] for r in want) > 1000
    assert rows_of(substring_dedup.remove(df, window, gram)) == want


def test_query_equals_the_literal_rule_on_a_table(spark, small):
    from riskweave.llm.queries import op11_seed_extend
    import hashlib
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in literal(rows, 50)]
    assert sorted([tuple(r) for r in op11_seed_extend(spark, small).collect()], key=str) == want
    assert sum(w[2] for w in want) > 0


def test_maximal_repeats_are_merged_ranges(spark):
    words = [f"w{i}" for i in range(30)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "new " + " ".join(words[3:20]) + " end " + " ".join(words[22:30]))], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.repeats] for r in substring_dedup.remove(df, 6, 3).collect()}
    assert got == {1: [], 2: [(1, 18), (19, 27)]}


def test_awkward_and_empty(spark):
    got = rows_of(substring_dedup.remove(awkward(spark)))
    assert got == literal([(r.doc_id, r.text) for r in awkward(spark).collect()], 50)
    assert substring_dedup.remove(empty(spark)).count() == 0


def test_anchors_cover_every_window():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 5, 400).astype(np.uint64)
    begins = np.array([0, 3, 3, 200, 260, 400])
    doc, first, run, _, _ = substring_dedup.anchors_of(hashes, begins, 50, 20)
    got = sorted((int(d), int(p)) for d, f, r in zip(doc, first, run) for p in range(f, f + r))
    assert got == [(d, p) for d in range(5) for p in range(begins[d + 1] - begins[d] - 49)]
