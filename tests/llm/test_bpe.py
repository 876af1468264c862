"""Token ids and decoded texts equal those of the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from varloom.llm import bpe
from varloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH)


def some_texts():
    r = random.Random(5)
    odd = "ab c'st\n\t  éß漢字🙂١٢½   .,!?<|endoftext|>0019AŹ\u0000�"
    plain = " thereoningeds"
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(r.choice(plain) for _ in range(r.randint(0, 300))) for _ in range(500)]
    return texts + ["", "a" * 5000, " " * 3000, "<|endoftext|>" * 3, "ab" * 20000, "\n \n x"]


def test_ids_equal_the_library(library, vocabulary):
    texts = some_texts()
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(vocabulary.encoder.text(t), "<u4").tolist() for t in texts]
    assert got == want


def test_pair_table_agrees_with_encoding_the_joined_bytes(library, vocabulary):
    r = random.Random(7)
    letters = [i for i, t in enumerate(vocabulary.tokens) if t.isalpha() and t.islower()]
    for _ in range(3000):
        a, b = r.choice(letters), r.choice(letters)
        both = (vocabulary.tokens[a] + vocabulary.tokens[b]).decode()
        same = library.encode(both, add_special_tokens=False).ids == [a, b]
        assert vocabulary.encoder.compatible(a, b) == same


def test_round_trip_nulls_repeats_and_clashing_names(spark, vocabulary):
    rows = [(1, None, "x"), (2, "", "x"), (3, "naïve 漢字\n", "y"), (3, "naïve 漢字\n", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    words = bpe.load(spark, PATH)
    out = bpe.decode(bpe.encode(df, words, key="doc_id"), words).collect()
    assert sorted((r.doc_id, r.n_tokens > 0, r.decoded) for r in out) == [
        (1, False, ""),
        (2, False, ""),
        (3, True, "naïve 漢字\n"),
        (3, True, "naïve 漢字\n"),
    ]
    assert bpe.decode(bpe.encode(df.limit(0), words, key="doc_id"), words).count() == 0


def test_bytes_that_are_no_text_become_replacement_characters(spark, vocabulary):
    words = bpe.load(spark, PATH)
    half = [vocabulary.tokens.index(b"\xe6"), vocabulary.tokens.index(b"a")]
    df = spark.createDataFrame([(bytearray(np.array(half, "<u4").tobytes()),)], "ids binary")
    assert bpe.decode(df, words).first().decoded == "�a"
    bad = spark.createDataFrame([(bytearray(np.array([60000], "<u4").tobytes()),)], "ids binary")
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(bad, words).collect()


def test_query_equals_the_library_on_all_documents(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op3_bpe"](spark, folder).collect()}
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        row = got[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
