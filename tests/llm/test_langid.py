"""Held-out accuracy, fusion against plain Python, and odd rows."""

import math

import pyarrow as pa
from pyspark.sql import functions as F

from varloom.llm import langid
from varloom.llm.queries import QUERIES


def test_held_out_accuracy_on_text_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"), label="lang")
    held = docs.where("doc_id % 2 = 1")
    found = {r.doc_id: r.language for r in langid.identify(held, model, key="doc_id").collect()}
    right = [found[r.doc_id] == r.lang for r in held.collect()]
    assert len(found) == len(right) and sum(right) / len(right) > 0.95


def test_query_covers_documents_and_pages(spark, folder):
    rows = QUERIES["op1_language_id"](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert {r.doc_id for r in rows if r.page_id is None} == {r.doc_id for r in docs.collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    assert {r.page_id for r in rows if r.doc_id is None} == {r.page_id for r in pages.collect()}
    assert all(r.accepted for r in rows if r.n_trigrams > 50)


def test_fusion_equals_plain_python(spark):
    train = [("en", "the house and the tree"), ("de", "das haus und der baum")] * 3
    model = langid.train(spark.createDataFrame(train, "lang string, text string"), label="lang")
    rows = [
        (1, "the tree", "en", "http://a.x.de/1"),
        (2, "das haus", "en", "http://a.x.de/2"),
        (3, "xq", None, "http://b.x.de/en/3"),
        (4, "der baum und", "de-AT", "http://b.y.com/"),
        (5, "und", "zz", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, url string")
    out = langid.identify(df, model, key="doc_id", declared="declared", address="url")
    got = {r.doc_id: (r.language, r.confidence) for r in out.collect()}
    sums, count = model.score(pa.array([r[1] for r in rows]))
    says = [[x / (1 + n / 200) for x in s] for s, n in zip(sums, count)]
    hosts = ["a.x.de", "a.x.de", "b.x.de", "b.y.com", ""]
    domain = ["x.de", "x.de", "x.de", "y.com", ""]
    hint = ["de", "de", "en", None, None]
    told = ["en", "en", None, "de", None]
    best = [s.index(max(s)) if n else None for s, n in zip(says, count)]
    share = [(best.count(k) + 1) / (sum(b is not None for b in best) + 2) for k in (0, 1)]
    for i, row in enumerate(rows):
        of = lambda names, k: sum(b == k for b, n in zip(best, names) if n == names[i])
        fused = []
        for k, language in enumerate(model.languages):
            d = (of(domain, k) + 20 * share[k]) / (of(domain, 0) + of(domain, 1) + 20)
            p = (of(hosts, k) + 20 * d) / (of(hosts, 0) + of(hosts, 1) + 20)
            x = says[i][k] + math.log(p)
            if told[i]:
                x += math.log(0.9 if told[i] == language else 0.1)
            if hint[i]:
                x += math.log(0.8 if hint[i] == language else 0.2)
            fused.append(x)
        top = max(fused)
        mass = sum(math.exp(x - top) for x in fused)
        assert got[row[0]][0] == model.languages[fused.index(top)]
        assert math.isclose(got[row[0]][1], 1 / mass, rel_tol=1e-9)


def test_markup_and_addresses(spark):
    html = '<HTML class=a lang="de-AT"><style>x</style><p>Hallo<!-- no --></p><script>y</script>'
    row = spark.range(1).select(
        langid.declared_language(F.lit(html)).alias("lang"),
        langid.page_text(F.lit(html)).alias("text"),
        langid.hint_of(F.lit("http://a.example.fr/x"), ["fr"]).alias("hint"),
        langid.host_of(F.lit("https://u@A.example.fr:80/x")).alias("host"),
    )
    assert row.first().lang == "de" and row.first().text.split() == ["Hallo"]
    assert row.first().hint == "fr" and row.first().host == "a.example.fr"


def test_nulls_empty_texts_repeats_and_clashing_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.train(docs, label="lang")
    long = "the and of " * 40000
    rows = [(1, None, None, "k"), (1, None, None, "k"), (2, "", "", "k"), (None, "123 !", "x", "k"), (3, long, "src0", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, key string")
    out = langid.identify(df, model, key="doc_id", address="host").collect()
    assert sorted((r.doc_id or 0, r.accepted) for r in out) == [(0, False), (1, False), (1, False), (2, False), (3, True)]
    assert langid.identify(df.limit(0), model, key="doc_id").count() == 0


def test_labels_are_no_patterns(spark):
    rows = [(1, "aber das ist ja gut", "e+n("), (2, "the and of it is", "en"), (3, "le chat et la souris", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("url", F.lit("http://h.test/E+N(/x"))
    model = langid.train(df, label="lang")
    out = langid.identify(df, model, key="doc_id", declared="lang", address="url").collect()
    assert {r.doc_id: r.language for r in out}[1] == "e+n(" and len(out) == 3
    hints = df.select(langid.hint_of(F.col("url"), ["e+n(", ""]).alias("h"), langid.hint_of(F.lit("http://h.test//x"), [""]).alias("none"))
    assert hints.first().h == "e+n(" and hints.first().none is None
