"""Splits and audit samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.schemas import SPLITS


def split_name(partition: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, split in SPLITS.items():
        out = F.when(partition == name, split).otherwise(out)
    return out


def split_gold(gold_docs: DataFrame, wanted: str = "all", column: str = "partition") -> DataFrame:
    """Adds split, and keeps one of train, validation and test (or all). Unknown values raise, all of them by name."""
    name = F.coalesce(F.col(column).cast("string"), F.lit("none"))
    bad = gold_docs.where(split_name(F.col(column)).isNull()).agg(F.array_sort(F.collect_set(name)).alias("names")).first().names
    if bad:
        raise ValueError(f"unknown {column}: {', '.join(bad)}")
    out = gold_docs.withColumn("split", split_name(F.col(column)))
    return out if wanted == "all" else out.where(F.col("split") == wanted)


def stratified_audit_sample(extractions: DataFrame, n: int = 5, seed: int = 42, stratum: str = "metric_type", salts: int = 64) -> DataFrame:
    """Up to n rows of each stratum, the first in an order by hash of seed, doc_id and ord.

    Strata are few, so each is cut first within salts and then as a whole: no task holds a stratum.
    """
    order = [F.xxhash64(F.lit(seed), "doc_id", "ord"), F.col("doc_id"), F.col("ord")]
    label = F.coalesce(F.col(stratum), F.lit("unknown"))
    rows = extractions.withColumn("_s", label).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "ord"), F.lit(salts)))
    near = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_s", "_salt").orderBy(*order))).where(F.col("_n") <= n)
    return near.withColumn("_n", F.row_number().over(Window.partitionBy("_s").orderBy(*order))).where(F.col("_n") <= n).drop("_s", "_salt", "_n")


def audit_composition(extractions: DataFrame, sample: DataFrame, stratum: str = "metric_type") -> DataFrame:
    """Per stratum how many there are and how many were sampled; null is 'unknown'."""
    count = lambda df, name: df.groupBy(F.coalesce(F.col(stratum), F.lit("unknown")).alias(stratum)).agg(F.count(F.lit(1)).alias(name))
    both = count(extractions, "available").join(count(sample, "sampled"), stratum, "left")
    return both.select(stratum, F.coalesce("sampled", F.lit(0)).alias("sampled"), "available")
