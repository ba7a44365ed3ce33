"""The pipeline's stages, each held against a plain reading of its decision."""

import corpus_pipeline as cp
from riskweave.llm import jaccard_join, secret_tags
from tests.llm.data import awkward, empty

SF = "/root/testdata/sf0.001"


def test_stages_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = cp.good_quality(spark, docs, SF).cache()
    assert good.columns == docs.columns and 0.5 * docs.count() < good.count() < docs.count()
    one = cp.one_of_each_group(spark, good, SF).cache()
    named = jaccard_join.join(good).collect()
    assert sorted(r.doc_id for r in one.collect()) == sorted({r.component_id for r in named})
    clean = cp.without_secrets(spark, one, SF).cache()
    assert clean.columns == docs.columns and clean.count() == one.count()
    assert all(not secret_tags.base_spans(r.text) and r.n_chars == len(r.text) for r in clean.collect())
    assert cp.packed(spark, clean, SF).select("doc_id").distinct().count() == clean.count()


def test_stages_on_awkward_rows(spark):
    for docs in (awkward(spark), empty(spark)):
        one = cp.one_of_each_group(spark, docs, SF)
        assert one.columns == docs.columns and cp.good_quality(spark, docs, SF).columns == docs.columns
        assert one.count() == (9 if docs.count() else 0)           # the copies of 1 under the id 6 go
        assert cp.packed(spark, cp.without_secrets(spark, one, SF), SF).select("doc_id").distinct().count() == one.count()


def test_two_texts_under_one_id(spark):
    """A clean text stays though its id also carries a near copy; the choice depends on no order."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(5, a, "x"), (5, b + " more", "x"), (3, b, "x"), (5, c, "x"), (7, c, "x"), (5, c, "y"), (8, a.upper(), "x")]
    kept = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        for parts in (1, 5):
            docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(parts)
            kept.add(tuple(sorted(map(tuple, cp.one_of_each_group(spark, docs, SF).collect()))))
    one, = kept
    assert [(i, t) for i, t, _ in one] == [(3, b), (5, a), (5, c)]


def test_two_texts_under_one_id_in_two_groups(spark):
    """An id whose texts have copies in different groups keeps the links of both."""
    text = lambda w, i: " ".join(f"{w}{i}x{j}" for j in range(60))
    rows = [r for i in range(12) for r in ((100 + i, text("a", i)), (100 + i, text("b", i)), (200 + i, text("a", i) + " more"), (50 + i, text("b", i) + " more"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(50 + i, text("b", i) + " more") for i in range(12)] + [(100 + i, text("a", i)) for i in range(12)]
    assert sorted(map(tuple, cp.one_of_each_group(spark, docs, SF).collect())) == want


def test_columns_of_the_documents_are_left_alone(spark):
    """Columns named like the stage's own come out as they went in."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "mongo-1", "m1", "a"), (2, text, "mongo-2", "m2", "b"), (3, "other text here", "mongo-3", "m3", "c"), (4, None, "mongo-4", "m4", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _MARK string, __id string")
    assert sorted(map(tuple, cp.one_of_each_group(spark, docs, SF).collect())) == [rows[0], rows[2], rows[3]]
