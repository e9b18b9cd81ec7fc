"""Exact dedup: group by a 128-bit content hash, compare the bytes, keep one id per text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import stored


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are (a null text counts as empty). ``keep`` says whether the
    smallest or the largest id of equal texts stays.

    First the 128-bit hashes are counted (16 bytes a row move, combined before the shuffle) and
    those of two rows and more are stored. Only texts with such a hash are then grouped, by (hash,
    text): rows meet by the hash, and Spark's grouping compares the texts' bytes, so two texts with
    one hash stay apart. Copies are combined before that shuffle too, so a text that a third of
    all rows hold moves once per task. The groups are joined back to the ids by both hashes and
    without the text; where few hashes repeat, they are broadcast and no unique text ever moves,
    and else both joins are plain equi-joins whose hot keys adaptive execution splits.

    Rows with a null id are grouped too: they count in group_size, are kept only if no row of
    their text has an id, and keep_id is null then. Repeated rows (same id and text) share one
    decision. An empty table gives no rows; other columns of ``docs`` are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    hashed = rows.withColumn("_h", F.unhex(F.md5("_text")))
    repeated = stored(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), "repeated")
    groups = (
        hashed.join(repeated, "_h", "left_semi")
        .groupBy("_h", "_text")
        .agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("_h", F.sha2("_text", 256).alias("_sha"), "keep_id", "group_size")
    )
    ids = hashed.select("_id", "_h", F.sha2("_text", 256).alias("_sha"))
    joined = ids.join(groups, ["_h", "_sha"], "left")
    single = F.col("group_size").isNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(single, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (single | F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, all columns unchanged.

    The dropped ids are stored first: Spark then knows their size, and broadcasts them if they are
    few instead of shuffling the texts.
    """
    dropped = stored(exact_groups(docs, id_col, text_col, keep).where("NOT kept").select(F.col(id_col).alias("_dropped")).distinct(), "dropped")
    return docs.join(dropped, docs[id_col].eqNullSafe(F.col("_dropped")), "left_anti")
