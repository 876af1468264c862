"""Each stage of the pipeline against a plain Python version, on its own input."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm import brute
from tests.llm.test_mixing import expected
from varloom.llm.queries import DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS
from varloom.plans.scale import cut_lineage


def domain(source):
    digits = "".join(c for c in source or "" if c.isdigit())
    return None if not digits else "web" if int(digits) == 0 else "forum" if int(digits) < 10 else "book"


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for _, stage in pipeline.STAGES:
        tables.append(cut_lineage(stage(spark, tables[-1], folder)))
        assert len(tables) == 6 or tables[-1].columns == columns
    rows = [t.collect() for t in tables]
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in rows[0] if r.text and r.text.strip()}
    classes = brute.near_duplicates([(r.doc_id, r.text) for r in rows[1]])
    assert {r.doc_id for r in rows[2]} == {c for _, c in classes.values()}
    assert [r.doc_id for r in sorted(rows[3])] == [r.doc_id for r in sorted(rows[2])]
    assert all(r.n_chars == len(r.text) for r in rows[3])
    marks = {r.doc_id: r._mark for r in tables[3].withColumn("_mark", pipeline.row_mark()).collect()}
    tree = [(marks[r.doc_id], domain(r.source), r.lang, r.source, len(brute.words(r.text))) for r in rows[3]]
    copies = dict(expected(tree, (DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, {}), 1.0, 4, 17))
    want = sorted(d for d, m in marks.items() for _ in range(copies[m]))
    assert sorted(r.doc_id for r in rows[4]) == want
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(rows[5]) == len(rows[4])
    texts = {r.doc_id: r.text for r in rows[4]}
    for r in rows[5]:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows_do_not_stop_a_stage(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _mark string, language int"
    rows = [
        (1, "the cat and the dog sat on the mat", "en", "src1", 3, "x", 1),
        (1, "the cat and the dog sat on the mat", "en", "src1", 3, "x", 1),
        (2, None, None, None, None, None, None),
        (None, "mail a.b@c.example.org to all of the people", None, None, 0, "y", 2),
        (3, "", "en", "src1", 0, "z", 3),
    ]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES:
        some, none = stage(spark, docs, folder), stage(spark, docs.limit(0), folder)
        assert none.count() == 0
        if name != "token_ids":
            assert some.columns == docs.columns
        assert some.count() == {"language_id": 3, "near_dedup": 4, "private_data": 5, "token_ids": 5}.get(name, some.count())


def test_unlabelled_documents_are_not_lost(spark, folder):
    import corpus_pipeline
    from varloom.llm import langid

    rows = [(1, "some words"), (2, "12 34"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "CAST(NULL AS string) AS lang", "'s1' AS source", "1L AS n_chars")
    kept = corpus_pipeline.language_id(spark, docs, folder)
    assert kept.columns == docs.columns
    assert [(r.doc_id, r.lang) for r in kept.collect()] == [(1, "und")]
    model = langid.train(docs, label="lang")
    for address in (None, "source"):
        told = langid.identify(docs, model, key="doc_id", address=address).collect()
        assert sorted((r.doc_id, r.language, r.accepted) for r in told) == [(i, None, False) for i in (1, 2, 3)]


def test_texts_that_share_an_id_are_rows_of_their_own(spark, folder):
    same, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, same), (5, same), (5, other), (None, same), (7, other + " " + " ".join("abcdefgh"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "'en' AS lang", "'src1' AS source", "1L AS n_chars")
    kept = pipeline.near_dedup(spark, docs, folder)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text) for r in kept.collect()))
    assert got == sorted([(0, same), (1, same), (5, other), (7, rows[4][1])])


def test_a_very_long_text_passes_every_stage(spark, folder):
    long = "the cat and the dog sat on the mat near Mr. John Smith " * 20_000
    docs = spark.createDataFrame([(1, long), (2, "the end of the day")], "doc_id long, text string")
    docs = docs.selectExpr("*", "'en' AS lang", "'src1' AS source", "1L AS n_chars")
    for _, stage in pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, folder))
        assert docs.where("doc_id = 1").count() >= 1
