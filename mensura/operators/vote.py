"""Self-consistency: merging repeated samples of one document by vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.text import vote_key

KEY_FIELDS = ("value", "value_max", "unit", "target_entity")
OTHER_FIELDS = ("is_range", "sentence", "metric_type", "entity_type", "context_modifier")


def dedupe_votes(samples: DataFrame, by: list[str] = ("doc_id",)) -> DataFrame:
    """Adds vote, the key; a sample's first extraction of a key stays."""
    keyed = samples.withColumn("vote", vote_key(*[F.col(c) for c in KEY_FIELDS]))
    keys = [*by, "sample", "vote"]
    first = keyed.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in keyed.columns if c not in keys]), "ord").alias("_r"))
    return first.select(*keys, "_r.*").select(*keyed.columns)


def _mode(members: Column, name: str) -> Column:
    """The most frequent value of a field among the members, ties to the first."""
    often = lambda x: F.size(F.filter(members, lambda y: y[name].eqNullSafe(x[name])))
    return F.array_max(F.transform(members, lambda x, i: F.struct(often(x).alias("n"), (-i).alias("i"), x[name].alias("v"))))["v"]


def vote_extractions(samples: DataFrame, by: list[str] = ("doc_id",), fields: tuple[str, ...] = OTHER_FIELDS) -> DataFrame:
    """Extractions that at least half of a document's samples have (k of them valid: (k+1)//2).

    Every field, those of the key as they are spelt too, is the most frequent one, ties to the first
    seen. The rows are dealt out by document once, and all that follows groups within a document: a
    key's members are one for each sample, so their modes are array functions.
    """
    by = list(by)
    voted = dedupe_votes(samples.repartition(*by), by)
    seen = F.size(F.collect_set("sample").over(Window.partitionBy(*by)))
    member = F.struct("sample", "ord", *KEY_FIELDS, *fields)
    grouped = voted.withColumn("k", seen.cast("long")).groupBy(*by, "vote").agg(F.array_sort(F.collect_list(member)).alias("m"), F.max("k").alias("k"))
    votes, m = F.size("m").cast("long"), F.col("m")
    kept = grouped.withColumn("votes", votes).where(F.col("votes") >= F.floor((F.col("k") + 1) / 2))
    first = m[0]
    return kept.select(*by, "votes", "k", first["sample"].alias("first_sample"), first["ord"].alias("first_ord"), *[_mode(m, f).alias(f) for f in (*KEY_FIELDS, *fields)])
