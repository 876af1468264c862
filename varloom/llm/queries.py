"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import (
    bpe,
    chat,
    forest,
    hpylm,
    langid,
    licenses,
    minhash,
    mixing,
    negatives,
    overlap,
    periods,
    pii,
    topk,
)
from varloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = os.environ.get("VARLOOM_BPE", public_tokenizers.path("byte_bpe_50k.json"))
# the key of the surrogates; set your own, kept secret, where texts leave the house
PII_KEY = os.environ.get("VARLOOM_PII_KEY", "varloom")


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where SQL can express it."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, with digests of both."""
    words = bpe.load(spark, TOKENIZER)
    return bpe.encode(table(spark, sf_dir, "documents"), words, key="doc_id", back=True).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op5_minhash")
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), key="doc_id")


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its private data replaced."""
    return pii.replace_private(table(spark, sf_dir, "documents"), secret=PII_KEY)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and every page, each table with its own evidence.

    Rows of ``documents`` have a doc_id, those of ``pages`` a page_id.
    """
    docs, pages = (table(spark, sf_dir, t) for t in ("documents", "pages"))
    model = langid.train(docs, label="lang")
    of_docs = langid.identify(docs, model, key="doc_id", declared="lang", address="source")
    pages = pages.select(
        "page_id",
        "url",
        langid.page_text(F.col("html")).alias("text"),
        langid.declared_language(F.col("html")).alias("declared"),
    )
    of_pages = langid.identify(pages, model, key="page_id", declared="declared", address="url")
    none = F.lit(None).cast("long")
    return of_docs.withColumn("page_id", none).unionByName(of_pages.withColumn("doc_id", none))


DOMAIN_WEIGHTS = {"web": 2.0, "forum": 1.0, "book": 5.0}
LANGUAGE_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 1.0}
MIX_PATH = ("domain", "lang", "source")


def source_domain() -> F.Column:
    """The kind of a source of ``documents``, by its number."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    n = F.when(number != "", number.cast("int"))
    return F.when(n == 0, "web").when(n < 10, "forum").when(n >= 10, "book")


def mixed_rows(docs: DataFrame, key: str, budget_share: float) -> DataFrame:
    """How often each document is taken under the weights above, by a key of its row."""
    rows = docs.select(
        key, source_domain().alias("domain"), "lang", "source",
        mixing.word_count(F.col("text")).alias("n_tokens"),
    )
    return mixing.mix(
        rows,
        key=key,
        tokens="n_tokens",
        path=MIX_PATH,
        weights=(DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, {}),
        budget_share=budget_share,
        seed=17,
    )


def _mix_sql(share: float) -> str:
    """The mix of documents: budgets by level, then the prefix of each leaf."""

    def level(d: int, weight: str, parent: str) -> str:
        cols = ", ".join(MIX_PATH[:d])
        above = ", ".join(MIX_PATH[: d - 1])
        join = f"FROM cap{d} JOIN grant{d - 1} USING ({above})" if d > 1 else f"FROM cap{d}"
        part = f"PARTITION BY {above}" if d > 1 else ""
        order = f"{part} ORDER BY CASE WHEN w > 0 THEN cap / w END NULLS LAST, {MIX_PATH[d - 1]}"
        before = f"({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        return f"""
        node{d} AS (SELECT {cols}, cap, {weight} AS w, {parent} AS parent {join}),
        open{d} AS (SELECT *, parent - coalesce(sum(cap) OVER {before}, 0) AS rem,
            sum(w) OVER ({part}) - coalesce(sum(w) OVER {before}, 0.0) AS rest FROM node{d}),
        mark{d} AS (SELECT *, cap * rest <= w * rem AS isfull FROM open{d}),
        first{d} AS (SELECT *, first_value(CASE WHEN NOT isfull THEN rem END IGNORE NULLS) OVER x AS r1,
            first_value(CASE WHEN NOT isfull THEN rest END IGNORE NULLS) OVER x AS w1 FROM mark{d}
            WINDOW x AS ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        grant{d} AS (SELECT {cols}, CASE WHEN isfull THEN cap::DOUBLE ELSE w * r1 / w1 END AS granted FROM first{d})"""

    def case(column: str, weights: dict) -> str:
        whens = " ".join(f"WHEN {column} = '{k}' THEN {v}::DOUBLE" for k, v in weights.items())
        return f"(CASE {whens} ELSE 1.0::DOUBLE END)"

    return f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
            CASE WHEN n = 0 THEN 'web' WHEN n < 10 THEN 'forum' WHEN n >= 10 THEN 'book' ELSE '(none)' END AS domain,
            n_tokens FROM (SELECT doc_id, lang, source, try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n,
            coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents)),
        leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS available FROM d GROUP BY ALL),
        total AS (SELECT floor(sum(available) * {share}::DOUBLE) AS budget FROM leaf),
        cap3 AS (SELECT domain, lang, source, (available * 4)::BIGINT AS cap FROM leaf),
        cap2 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap FROM cap3 GROUP BY ALL),
        cap1 AS (SELECT domain, sum(cap)::BIGINT AS cap FROM cap2 GROUP BY ALL),
        {level(1, case("domain", DOMAIN_WEIGHTS), "(SELECT budget FROM total)")},
        {level(2, case("lang", LANGUAGE_WEIGHTS), "granted")},
        {level(3, "1.0::DOUBLE", "granted")},
        g AS (SELECT domain, lang, source, floor(granted)::BIGINT // greatest(available, 1) AS epochs,
            floor(granted)::BIGINT % greatest(available, 1) AS rest FROM leaf JOIN grant3 USING (domain, lang, source)),
        o AS (SELECT d.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
            ORDER BY md5('17|' || epochs || '|' || coalesce(doc_id::VARCHAR, ''))) AS until FROM d JOIN g USING (domain, lang, source))
    SELECT doc_id, domain, lang, source, n_tokens, epochs + CASE WHEN until <= rest THEN 1 ELSE 0 END AS copies FROM o"""


@query("op4_mixing", _mix_sql(0.5))
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken for half of all words."""
    return mixed_rows(table(spark, sf_dir, "documents"), "doc_id", 0.5)


_TOP_K_SQL = """
    WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
        FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id,
            list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER
        (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


@query("op8_exact_topk", _TOP_K_SQL)
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products for every hundredth vector."""
    return topk.exact_top_k(
        table(spark, sf_dir, "embeddings"), key="vec_id", vector="embedding", asked=F.col("id") % 100 == 0
    )


@query("op9_forest")
def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth vector."""
    return forest.nearest(
        table(spark, sf_dir, "embeddings"), key="vec_id", vector="embedding", asked=F.col("id") % 100 == 0
    )


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a document that matches a licence."""
    return licenses.scan(table(spark, sf_dir, "documents"), key="doc_id")


_CHAT_SQL = """
    WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id
            ORDER BY turn NULLS FIRST, role, text) AS place, role, text
        FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
    p AS (SELECT *, string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER
            (PARTITION BY c ORDER BY place) AS prefix, count(*) OVER (PARTITION BY c) AS n FROM t),
    w AS (SELECT n, prefix, min(c) FILTER (c IS NOT NULL) AS lowest, bool_or(c IS NULL) AS anon FROM p WHERE place = n GROUP BY ALL),
    k AS (SELECT CASE WHEN anon THEN NULL ELSE lowest END AS c, n FROM w
        WHERE prefix NOT IN (SELECT prefix FROM p WHERE place < n))
    SELECT t.c AS conv_id, k.n::BIGINT AS n_turns, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
    FROM t JOIN k ON t.c IS NOT DISTINCT FROM k.c GROUP BY t.c, k.n"""


@query("op10_chat", _CHAT_SQL)
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return chat.render(table(spark, sf_dir, "conversations"))


@query("op6_hpylm")
def op6_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model of six sevenths of them."""
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    scored = hpylm.score(table(spark, sf_dir, "documents"), key="doc_id", trained=part != 2)
    return scored.select(
        "doc_id",
        (~F.col("trained")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@query("op12_jaccard")
def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of texts that share nearly all word 4-grams."""
    return overlap.jaccard_classes(table(spark, sf_dir, "documents"), key="doc_id")


def repeated_words(doc_id: int, n: int) -> np.ndarray | None:
    """Which word stands at each of n places: every tenth document repeats some of its words."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    first = h // 10 % n
    period = 1 + (n - first) // (3 + h // 10 % 8)
    place = np.arange(n)
    place[first:] = first + (place[first:] - first) % period
    return place


@query("op13_runs")
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, with digests of them and of what is left."""
    docs = table(spark, sf_dir, "documents")
    found = periods.collapse_runs(docs, key="doc_id", order=repeated_words)
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS n, -r.start AS s, -r.period AS q)))")
    listed = F.expr(
        "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.expr("1000 * best.n DIV -best.q").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_NEGATIVES_SQL = """
    WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same,
            list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id
            ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5"""


@query("op11_negatives", _NEGATIVES_SQL)
def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and its positives, the rows of other labels that score nearly
    as high."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(
        rows.withColumn("label", moved),
        key="vec_id",
        vector="embedding",
        label="label",
        asked=F.col("id") % 100 == 0,
    )
