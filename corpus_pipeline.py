"""From raw documents to token ids: language, near duplicates, private data, mix, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import bpe, langid, minhash, pii
from varloom.llm.common import fresh, prepare, table
from varloom.llm.queries import PII_KEY, TOKENIZER, mixed_rows
from varloom.plans.scale import broadcast_if_small, cut_lineage, ranked

# the share of all words that the mix has room for
BUDGET_SHARE = 1.0


def row_mark() -> Column:
    """A key of a row by its id and text, for rows whose ids are NULL or shared: 128 bits."""
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("doc_id", "text")]
    return F.md5(F.concat(named[0], F.lit("|"), named[1]).cast("binary"))


def once(docs: DataFrame) -> DataFrame:
    """Rows that repeat another one's id and text are left out; without any, nothing moves."""
    (mark,) = fresh(docs, "_mark")
    marked = docs.withColumn(mark, row_mark())
    if marked.groupBy(mark).count().where("count > 1").isEmpty():
        return docs
    return marked.dropDuplicates([mark]).select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by their text; ``lang`` becomes that language.

    Without any label no language can be told: all documents with letters stay, as ``und``. Rows
    with a NULL or empty text go; NULL labels and sources say nothing; of equally likely languages
    the first in order is taken; repeated rows stay.
    """
    prepare(spark)
    mark, told, hit = fresh(docs, "_mark", "_language", "_changed")
    marked = docs.withColumn(mark, row_mark())
    model = langid.train(docs, label="lang")
    if not model.languages:
        return docs.where(F.rlike("text", F.lit(r"\p{L}"))).withColumn("lang", F.lit("und"))
    found = langid.identify(marked, model, key=mark, declared="lang", address="source")
    found = cut_lineage(found.select(mark, F.col("language").alias(told), "accepted").distinct())
    # only what changes is joined: rejected rows, and rows that say another language
    now = marked.select(mark, F.col("lang").alias("_now")).distinct()
    other = found.join(now, mark).where(~(F.col("accepted") & F.col(told).eqNullSafe(F.col("_now"))))
    other = other.select(mark, F.when(F.col("accepted"), F.col(told)).alias(told), F.lit(True).alias(hit))
    changed = broadcast_if_small(cut_lineage(other.distinct()), width=3)
    joined = marked.join(changed, mark, "left")
    kept = joined.where(F.col(hit).isNull() | F.col(told).isNotNull())
    return kept.withColumn("lang", F.coalesce(told, "lang")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows that repeat an id and a text count once. Several texts of one id are rows of their own,
    in the order of their digests. Rows with a NULL id, and texts without words, are kept.
    """
    prepare(spark)
    docs, columns, key = once(docs), docs.columns, "doc_id"
    shared = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if not shared.isEmpty():
        (key,) = fresh(docs, "_row")
        docs = ranked(docs, ["doc_id", row_mark()], out=key)
        docs = cut_lineage(docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.col(key))))
    found = minhash.near_duplicates(docs, key=key)
    gone = cut_lineage(found.where(~F.col("kept")).select(key).distinct())
    return docs.join(broadcast_if_small(gone, width=1), key, "left_anti").select(columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data replaced by surrogates; ``n_chars`` follows the text. Every row stays, repeated
    ones with the same text; a NULL text stays NULL."""
    out = pii.replace_private(docs, secret=PII_KEY)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: one row for each copy.

    Rows that repeat an id and a text count once; a NULL lang or source is a name of its own; a
    NULL text has no words and goes with the prefix that it falls in.
    """
    prepare(spark)
    docs = once(docs)
    mark, times, copy = fresh(docs, "_mark", "_times", "_copy")
    marked = docs.withColumn(mark, row_mark())
    copies = mixed_rows(marked, mark, BUDGET_SHARE).where("copies > 0")
    copies = cut_lineage(copies.select(mark, F.col("copies").cast("int").alias(times)))
    each = F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)
    # a broadcast, if counted to be small, keeps the texts where they are
    joined = marked.join(broadcast_if_small(copies, width=2), mark)
    return joined.select(*docs.columns, each).drop(copy)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text they decode to. A NULL
    text has no tokens; repeated rows stay."""
    words = bpe.load(spark, TOKENIZER)
    return bpe.encode(docs, words, key="doc_id", back=True).select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("mix", mix),
    ("token_ids", token_ids),
]

# likelihoods, minima and token ids are beyond SQL; tests hold the stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
