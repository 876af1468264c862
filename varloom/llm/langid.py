"""Language of a text by Bayesian fusion of what it says, what it declares and where it lies.

Text likelihoods come from byte trigrams, counted by language over all labelled rows in one
grouped aggregation and hashed into a fixed number of buckets. They are joined, as logarithms,
with the declared language, a language hint in the address (country suffix or path segment)
and a prior of the host. Host priors are smoothed towards the domain's, those towards the
overall shares; all three are grouped counts of the language that the text alone suggests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import small_batches, text_buffers
from varloom.plans.scale import cut_lineage

BUCKETS = 1 << 16
# fixed values: languages suggested by the last label of a host name
SUFFIX_LANGUAGE = {
    "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es",
    "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en",
}
_LETTER = np.ones(256, bool)
_LETTER[:128] = [chr(b).isalpha() for b in range(128)]


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram at each byte, BUCKETS where it has no letter or leaves the
    text, and the n + 1 bounds of the texts."""
    raw, off = text_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    code = np.full(len(raw), BUCKETS, np.int64)
    if len(raw) > 2:
        own = np.where(_LETTER[raw], raw, 32).astype(np.uint32)
        three = (own[:-2] * 65536 + own[1:-1] * 256 + own[2:]).astype(np.uint32)
        hashed = (three * np.uint32(2654435761)) >> np.uint32(16)
        code[:-2] = np.where(three == 0x202020, BUCKETS, hashed)
        for back in (1, 2):  # the last two bytes of each text begin no trigram
            last = off[1:] - back
            code[last[last >= off[:-1]]] = BUCKETS
    return code, off


@dataclass
class TextModel:
    """Log probabilities of trigram buckets by language; the last bucket weighs nothing."""

    languages: list[str]
    weights: np.ndarray

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log probabilities (texts x languages) and the number of trigrams."""
        code, off = _trigrams(column)
        at = np.concatenate([[0], np.cumsum(code < BUCKETS)])
        count = np.diff(at[off])
        out = np.zeros((len(count), len(self.languages)))
        some = np.flatnonzero(np.diff(off) > 0)
        if len(some):
            for k, weight in enumerate(self.weights):
                out[some, k] = np.add.reduceat(weight[code], off[:-1][some])
        return out, count


def train(df: DataFrame, *, label: str, text: str = "text", smoothing: float = 0.5) -> TextModel:
    """Count trigrams by language over all rows with a label and a text.

    What comes to the driver is one number for each language and bucket, whatever the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in small_batches(batches, "_text", 1 << 20):
            code, off = _trigrams(batch.column(1))
            names = batch.column(0).to_pylist()
            for name in set(names):
                own = np.concatenate([code[off[i] : off[i + 1]] for i, x in enumerate(names) if x == name])
                counts = np.bincount(own, minlength=BUCKETS + 1)[:BUCKETS]
                total[name] = total.get(name, 0) + counts
        for name, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(counts[some])],
                ["label", "bucket", "n"],
            )

    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(label).cast("string").alias("label"), F.col(text).alias("_text"))
    counted = rows.mapInArrow(run, "label string, bucket bigint, n bigint")
    counted = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["label"].unique())
    weights = np.full((len(languages), BUCKETS + 1), smoothing)
    place = {name: i for i, name in enumerate(languages)}
    weights[counted["label"].map(place).astype(int), counted["bucket"].astype(int)] += counted["n"]
    weights[:, BUCKETS] = 0
    weights = np.log(np.maximum(weights, 1e-300) / weights.sum(axis=1, keepdims=True))
    weights[:, BUCKETS] = 0
    return TextModel(languages, weights)


def declared_language(html: Column) -> Column:
    """The language that a page's markup declares, without region; NULL if none."""
    tag = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})", 1)
    return F.when(tag != "", F.lower(tag))


def page_text(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def host_of(address: Column) -> Column:
    """The host name in an address; an address that is no URL is its own host."""
    host = F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.lower(F.when(host != "", host).otherwise(address))


def hint_of(address: Column, languages: Sequence[str]) -> Column:
    """The language that an address suggests: a path segment, else the country suffix. Names
    of languages are taken as they are written; an empty one is no segment."""
    names = "|".join(re.escape(name) for name in languages if name)
    segment = rf"(?i)://[^/]*/(?:[^?#]*/)?({names})(?:[/?#]|$)"
    path = F.regexp_extract(address, segment, 1) if names else F.lit("")
    suffix = F.regexp_extract(host_of(address), r"\.([a-z]{2})$", 1)
    table = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    return F.when(path != "", F.lower(path)).otherwise(F.get(F.array(table[suffix]), F.lit(0)))


def identify(
    df: DataFrame,
    model: TextModel,
    *,
    key: str,
    text: str = "text",
    declared: str | None = None,
    address: str | None = None,
    trust_declared: float = 0.9,
    trust_hint: float = 0.8,
    strength: float = 20.0,
    full_weight: float = 200.0,
    least: float = 0.5,
) -> DataFrame:
    """(key, language, confidence, accepted, n_trigrams), one row for each row of the table.

    Neighbouring trigrams depend on each other, so a text of n counts as n / (1 + n /
    ``full_weight``) of them. A declared language is right with probability
    ``trust_declared``, a hint with ``trust_hint``; one that the model does not know says
    nothing. A host's prior counts as ``strength`` rows beside the host's own. Of equal
    languages the first in order is taken. A row is accepted if its text has a trigram with
    letters and its confidence is at least ``least``.

    NULL and empty texts give the prior's language and are not accepted; NULL in other columns
    says nothing; repeated rows stay; an empty table gives no rows.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)
    languages = model.languages
    if not languages:  # a model of no labelled text tells nothing
        return df.select(
            F.col(key),
            F.lit(None).cast("string").alias("language"),
            F.lit(None).cast("double").alias("confidence"),
            F.lit(False).alias("accepted"),
            F.lit(None).cast("long").alias("n_trigrams"),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text", 1 << 20):
            sums, count = sent.value.score(batch.column(1))
            scaled = sums / (1 + count / full_weight)[:, None]
            scaled -= scaled.max(axis=1, keepdims=True)
            flat = pa.array(scaled.ravel())
            bounds = pa.array(np.arange(len(count) + 1) * len(languages), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *batch.columns[2:],
                    pa.ListArray.from_arrays(bounds, flat),
                    pa.array(count, pa.int64()),
                ],
                ["key", "declared", "hint", "host", "says", "n_trigrams"],
            )

    none = F.lit(None).cast("string")
    place = F.col(address).cast("string") if address else none
    source = df.select(
        F.col(key).alias("key"),
        F.col(text).alias("_text"),
        (F.lower(F.substring_index(F.col(declared), "-", 1)) if declared else none).alias("declared"),
        (hint_of(place, languages) if address else none).alias("hint"),
        F.coalesce(host_of(place), F.lit("")).alias("host"),
    )
    kind = source.schema["key"].dataType.simpleString()
    says = source.mapInArrow(
        run,
        f"key {kind}, declared string, hint string, host string, says array<double>, "
        "n_trigrams bigint",
    )
    says = cut_lineage(says.withColumn("domain", F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1)))
    best = F.array_position("says", F.array_max("says"))
    counts = [
        F.sum(F.when((best == i + 1) & (F.col("n_trigrams") > 0), 1.0).otherwise(0.0)).alias(f"n{i}")
        for i in range(len(languages))
    ]
    hosts = says.groupBy("host", "domain").agg(*counts)
    sums = [F.sum(f"n{i}") for i in range(len(languages))]
    domains = hosts.groupBy("domain").agg(*[s.alias(f"d{i}") for i, s in enumerate(sums)])
    whole = hosts.agg(*sums).first()
    total = sum(x or 0.0 for x in whole)
    share = [((x or 0.0) + 1.0) / (total + len(languages)) for x in whole]

    def smooth(prefix: str, above: list[Column]) -> list[Column]:
        own = [F.col(f"{prefix}{i}") for i in range(len(languages))]
        size = sum(own[1:], own[0])
        return [(n + strength * p) / (size + strength) for n, p in zip(own, above)]

    prior = smooth("n", smooth("d", [F.lit(p) for p in share]))
    hosts = hosts.join(domains, "domain").select("host", F.array(*prior).alias("prior"))

    def told(name: str, trust: float) -> Column:
        rest = (1 - trust) / max(len(languages) - 1, 1)
        known = F.col(name).isin(*languages)
        return F.array(
            *[
                F.when(known, F.when(F.col(name) == x, F.log(F.lit(trust))).otherwise(F.log(F.lit(max(rest, 1e-12)))))
                .otherwise(0.0)
                for x in languages
            ]
        )

    joined = says.join(hosts, "host")
    joined = joined.withColumn("_fused", F.zip_with("says", "prior", lambda s, p: s + F.log(p)))
    for name, trust in (("declared", trust_declared), ("hint", trust_hint)):
        joined = joined.withColumn("_fused", F.zip_with("_fused", told(name, trust), lambda x, y: x + y))
    top = F.array_max("_fused")
    mass = F.aggregate("_fused", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    names = F.array(*map(F.lit, languages))
    return joined.select(
        F.col("key").alias(key),
        F.get(names, (F.array_position("_fused", top) - 1).cast("int")).alias("language"),
        (F.lit(1.0) / mass).alias("confidence"),
        ((F.col("n_trigrams") > 0) & (F.lit(1.0) / mass >= least)).alias("accepted"),
        "n_trigrams",
    )
