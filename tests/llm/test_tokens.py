"""Tokenizer operators against the libraries, and their files."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm import bpe, packing, token_store
from riskweave.llm.common import Memo, documents
from riskweave.llm.word_ids import WordIds
from tests.llm.data import LONG, awkward, empty

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LETTERS = " \n\t\r\x0b\x1c\x1f\x85\xa0 　'sStrevelldΣİ.,!?019²½éßÉ日本語ا́😀  aA<|>"


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(WORDS)
    found.encode_special_tokens = True
    return found


def noise(n):
    rnd = random.Random(n)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_byte_bpe_equals_the_library(tik):
    own = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = noise(3000) + ["", "a", LONG[:5000], "th" * 300, "x" * 1500, "  two  blanks ", "\n\n x"]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.texts(texts)] == [tik.encode_ordinary(t) for t in texts]


def test_both_trees_agree():
    own = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    rnd = random.Random(2)
    for n in (2, 3, 7, 8, 9, 60, 200, 511):
        piece = bytes(rnd.choice(b"abcdeinorst") for _ in range(n))
        width = 1 << (n - 1).bit_length()
        assert own._merge_many([piece], width)[0].tolist() == own._merge_one(piece).tolist()


def test_byte_bpe_round_trip(spark):
    docs = awkward(spark)
    rows = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted((r.doc_id or 0, bytes(r.bytes).decode()) for r in rows) == sorted((r.doc_id or 0, r.text) for r in documents(docs).collect())
    assert bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_word_ids_equal_the_library(library):
    texts = noise(3000) + ["", LONG[:3000], "it's <|endoftext|> I'LL o'clock ªº"]
    assert [x.tolist() for x in WordIds(WORDS).texts(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_memo_forgets_nothing():
    memo = Memo(lambda keys: [str(k).encode() for k in keys], most=5)
    docs = [[i % 13, i % 7, i] for i in range(100)]
    for k in range(0, 100, 9):
        assert memo.join(docs[k:k + 9]) == [b"".join(str(k).encode() for k in d) for d in docs[k:k + 9]]


def expected(docs, library, end):
    return [(r.doc_id, library.encode(r.text, add_special_tokens=False).ids + [end]) for r in documents(docs).collect()]


def test_store_round_trip(spark, library, tmp_path):
    docs = awkward(spark).repartition(3)
    manifest = token_store.write_store(docs, str(tmp_path / "s"), WORDS, 1)
    want = sorted(expected(docs, library, 1), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(token_store.read_store(spark, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == want
    assert [r.start for r in got] == np.cumsum([0] + [len(i) for _, i in want[:-1]]).tolist()
    raw = token_store.dictionary_of(str(tmp_path / "s"))
    readers = [token_store.Reader(r.path, raw) for r in manifest.collect()]
    assert [x.tolist() for s in readers for x in s.find(6)] == [i for d, i in want if d == 6]
    with pytest.raises(ValueError):
        token_store.Reader(manifest.first().path, raw + b"x")


def test_store_of_no_documents(spark, tmp_path):
    token_store.write_store(empty(spark), str(tmp_path / "s"), WORDS, 1)
    assert token_store.read_store(spark, str(tmp_path / "s")).count() == 0


def test_dictionary_is_trained_and_used(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some common words stand here and there "), F.col("id"), F.lit(" times over")).alias("text"))
    token_store.write_store(docs, str(tmp_path / "s"), WORDS, 1)
    assert len(token_store.dictionary_of(str(tmp_path / "s"))) > 0
    assert token_store.read_store(spark, str(tmp_path / "s")).count() == 400


def test_packing(spark, library):
    docs = awkward(spark)
    want = sorted(expected(docs, library, 2), key=lambda r: (r[0] or 0, r[1]))
    rows = packing.pack(docs, WORDS, 2).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and len(r.ids) == 4 * r.length for r in rows)
    for doc, ids in want:
        same = [r for r in rows if r.doc_id == doc and np.frombuffer(r.ids, "<u4").tolist() == ids[r.start:r.start + r.length]]
        assert {t for r in same for t in range(r.start, r.start + r.length)} == set(range(len(ids)))
        assert all(r.doc_tokens == len(ids) for r in same)
    assert sum(r.length for r in rows) == sum(len(i) for _, i in want)
    assert packing.pack(empty(spark), WORDS, 2).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, WORDS, 2, longest=100)


def test_lengths():
    assert packing.lengths(9000) == [4096, 4096, 512, 256, 32, 8] and packing.lengths(1) == [1] and packing.lengths(0) == []
