"""The driver tables seen as expression, genotype and allele-count tables.

Each stand-in exists twice: a DataFrame builder and a SQL common table expression. An
order is a cell, a nation a donor, a (brand, type) pair a gene, a supplier a variant,
a part an exonic site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import Tables

CTES = {
    "cells": """cells AS (
  SELECT o_orderkey AS cell_id, c_nationkey AS individual_id, o_custkey AS donor_id,
         o_orderstatus AS cell_type, c_mktsegment AS population, o_orderpriority AS batch,
         CAST(year(o_orderdate) AS INTEGER) AS day,
         CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS plate_id,
         o_totalprice AS pseudotime
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "counts": """counts AS (
  SELECT l_orderkey AS cell_id, concat(p_brand, '_', p_type) AS gene_id,
         sum(l_quantity) AS count
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "genes": """genes AS (
  SELECT gene_id, gene_id AS gene_symbol, CAST(brand % 5 + 1 AS INTEGER) AS chrom,
         lo * 1000 AS start_pos, lo * 1000 + width * 10 AS end_pos,
         CASE WHEN n % 2 = 0 THEN '+' ELSE '-' END AS strand,
         CASE WHEN p_type = 'ECONOMY' THEN 'lincRNA' ELSE 'protein_coding' END AS gene_type,
         CASE WHEN n % 7 = 0 THEN 'NOVEL' ELSE 'KNOWN' END AS gene_status
  FROM (SELECT concat(p_brand, '_', p_type) AS gene_id, p_type,
               CAST(substr(p_brand, 7) AS BIGINT) AS brand, min(p_partkey) AS lo,
               max(p_size) AS width, count(*) AS n
        FROM part GROUP BY p_brand, p_type))""",
    "genotype": """genotype AS (
  SELECT variant_id, CAST(variant_id % 5 + 1 AS INTEGER) AS chrom, variant_id * 1000 AS pos,
         individual_id,
         CASE WHEN n % 17 = 0 THEN NULL ELSE CAST(n % 3 AS DOUBLE) END AS dosage
  FROM (SELECT l_suppkey AS variant_id, c_nationkey AS individual_id, count(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
             JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))""",
    "ase": """ase AS (
  SELECT l_partkey AS site_id, l_orderkey AS sample_id,
         CAST(sum(least(CAST(l_quantity AS INTEGER), l_linenumber * 4)) AS INTEGER)
           AS allele_count,
         CAST(sum(CAST(l_quantity AS INTEGER)) AS INTEGER) AS total_count
  FROM lineitem GROUP BY 1, 2)""",
    "sites": """sites AS (
  SELECT p_partkey AS site_id, CAST(p_size % 5 + 1 AS INTEGER) AS chrom,
         p_partkey * 50 AS pos,
         CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS gene_id FROM part)""",
    "tests": """tests AS (
  SELECT gene_id, variant_id, cell_type, CAST(x * x * x AS DOUBLE) AS pvalue,
         x * 2.0 - 1.0 AS beta, ord
  FROM (SELECT gene_id, variant_id, cell_type, seed AS ord,
               CAST((seed * 7919 + variant_id * 104729) % 100003 AS DOUBLE) / 100003 AS x
        FROM (SELECT concat(p_brand, '_', p_type) AS gene_id, l_suppkey AS variant_id,
                     l_returnflag AS cell_type, CAST(sum(l_orderkey) AS BIGINT) AS seed
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)))""",
}


def with_ctes(*names: str) -> str:
    """A WITH clause of the named stand-ins."""
    return "WITH " + ", ".join(CTES[n] for n in names)


def gene_key():
    return F.concat("p_brand", F.lit("_"), "p_type")


def cells(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("cell_id"),
        F.col("c_nationkey").alias("individual_id"),
        F.col("o_custkey").alias("donor_id"),
        F.col("o_orderstatus").alias("cell_type"),
        F.col("c_mktsegment").alias("population"),
        F.col("o_orderpriority").alias("batch"),
        F.year("o_orderdate").alias("day"),
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("plate_id"),
        F.col("o_totalprice").alias("pseudotime"),
    )


def counts(t: Tables) -> DataFrame:
    return (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("cell_id"), gene_key().alias("gene_id"))
        .agg(F.sum("l_quantity").alias("count"))
    )


def genes(t: Tables) -> DataFrame:
    grouped = t.part.groupBy("p_brand", "p_type").agg(
        F.min("p_partkey").alias("lo"), F.max("p_size").alias("width"), F.count("*").alias("n")
    )
    return grouped.select(
        gene_key().alias("gene_id"),
        gene_key().alias("gene_symbol"),
        (F.substring("p_brand", 7, 9).cast("long") % 5 + 1).cast("int").alias("chrom"),
        (F.col("lo") * 1000).alias("start_pos"),
        (F.col("lo") * 1000 + F.col("width") * 10).alias("end_pos"),
        F.when(F.col("n") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.when(F.col("p_type") == "ECONOMY", "lincRNA")
        .otherwise("protein_coding")
        .alias("gene_type"),
        F.when(F.col("n") % 7 == 0, "NOVEL").otherwise("KNOWN").alias("gene_status"),
    )


def genotype(t: Tables) -> DataFrame:
    n = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("l_suppkey").alias("variant_id"), F.col("c_nationkey").alias("individual_id"))
        .agg(F.count("*").alias("n"))
    )
    return n.select(
        "variant_id",
        (F.col("variant_id") % 5 + 1).cast("int").alias("chrom"),
        (F.col("variant_id") * 1000).alias("pos"),
        "individual_id",
        F.when(F.col("n") % 17 == 0, None)
        .otherwise((F.col("n") % 3).cast("double"))
        .alias("dosage"),
    )


def ase(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return t.lineitem.groupBy(
        F.col("l_partkey").alias("site_id"), F.col("l_orderkey").alias("sample_id")
    ).agg(
        F.sum(F.least(q, F.col("l_linenumber") * 4)).cast("int").alias("allele_count"),
        F.sum(q).cast("int").alias("total_count"),
    )


def sites(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("site_id"),
        (F.col("p_size") % 5 + 1).cast("int").alias("chrom"),
        (F.col("p_partkey") * 50).alias("pos"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_brand")).alias("gene_id"),
    )


def tests(t: Tables) -> DataFrame:
    seeds = (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            gene_key().alias("gene_id"),
            F.col("l_suppkey").alias("variant_id"),
            F.col("l_returnflag").alias("cell_type"),
        )
        .agg(F.sum("l_orderkey").alias("ord"))
    )
    x = ((F.col("ord") * 7919 + F.col("variant_id") * 104729) % 100003).cast("double") / 100003
    return seeds.withColumn("x", x).select(
        "gene_id",
        "variant_id",
        "cell_type",
        (F.col("x") * F.col("x") * F.col("x")).alias("pvalue"),
        (F.col("x") * 2.0 - 1.0).alias("beta"),
        "ord",
    )
