"""Readers and writers. Schemas are always given, never inferred."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.text import doc_id_from_url
from mensura.schemas import BATCH_LINE, CANDIDATE, GOLD, RESULT, WORK
from mensura.sources.shared import new_place


def _nested(ddl: str) -> str:
    """A row type's fields as they are written inside struct<...>."""
    return re.sub(r"(^|, )(\w+) (?=\w)", r"\1\2: ", ddl)


def read_works(spark: SparkSession, path: str, pages: bool = False) -> DataFrame:
    """Works from JSON lines, or from page envelopes whose ``results`` hold them."""
    if not pages:
        return spark.read.schema(WORK).json(path)
    return spark.read.schema(f"results array<struct<{_nested(WORK)}>>").json(path).select(F.explode("results").alias("w")).select("w.*")


def write_articles(articles: DataFrame, path: str, csv: bool = False) -> None:
    if csv:
        articles.write.option("header", True).option("escape", '"').csv(path)
    else:
        articles.write.parquet(path)


def read_abstracts(spark: SparkSession, path: str, schema: str = "Abstract string") -> DataFrame:
    """A CSV with quoted texts of several lines; nulls become empty texts."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def write_candidates(candidates: DataFrame, path: str) -> None:
    candidates.write.parquet(path)


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(gold_docs: doc_id, partition) and (gold_ext: doc_id, ord, fields); a missing list is an empty one."""
    return split_records(spark.read.schema(GOLD).json(path).where("doc_id IS NOT NULL"))


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents, and their extractions in long form; documents without any stay in the first."""
    docs = records.select("doc_id", F.col("particao").alias("partition")) if "particao" in records.columns else records.select("doc_id")
    long = records.select("doc_id", F.posexplode("extracoes").alias("ord", "e")).select("doc_id", "ord", "e.*")
    return docs, long


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(CANDIDATE).json(path)
    return raw.select("doc_id", F.coalesce("titulo", F.lit("")).alias("title"), F.coalesce("resumo", F.lit("")).alias("abstract"))


def read_extra_abstracts(spark: SparkSession, path: str, url_col: str = "url", text_col: str = "abstract") -> DataFrame:
    """(doc_id, abstract) of a CSV of URLs and texts; rows with a blank URL are skipped."""
    raw = spark.read.schema(f"`{url_col}` string, `{text_col}` string").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(doc_id_from_url(F.col(url_col)).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("abstract")).where("doc_id IS NOT NULL")


def parse_results(lines: DataFrame, column: str = "value") -> DataFrame:
    """Result lines, wrapped (``resultado``) or bare; bad JSON and lines without doc_id are skipped."""
    row = F.from_json(column, BATCH_LINE)
    bare = F.struct(*[F.col(f"_r.{n}").alias(n) for n in RESULT])
    others = [c for c in lines.columns if c != column]
    both = lines.withColumn("_r", row).withColumn("_x", F.coalesce(F.col("_r.resultado"), bare))
    return both.select(*others, "_x.*", F.col("_r.instante").alias("instant")).where("doc_id IS NOT NULL")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return parse_results(spark.read.text(path))


def append_results(results: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds finished items to the log, errors included; the commit is Spark's.

    With ``batch``, the name of this append, they go to a folder of their own, which a repeated
    append of the batch overwrites: a rerun job adds nothing twice.
    """
    if batch is None:
        results.write.mode("append").json(path)
    else:
        results.write.mode("overwrite").json(f"{path}/batch={batch}")


class ResultLog:
    """A log of finished items as a bucketed table: appends are exactly-once by batch, and what is
    pending is found by a join that never shuffles the log.

    name: the table's name in the session's catalogue; path: where its files are, in a folder that
    all sessions see. Items are hashed by ``key`` into ``buckets``.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, schema: str, key: str = "i", buckets: int = 64):
        self.spark, self.name, self.key = spark, name, key
        new_place(spark, path)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}, batch STRING) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
        spark.sql(f"MSCK REPAIR TABLE {name}")  # batches of earlier sessions

    def append(self, results: DataFrame, batch: str) -> None:
        """Writes a batch; a batch that is written again, after a failure, replaces itself."""
        table = self.spark.table(self.name)
        names = [c for c in table.columns if c != "batch"]
        view = f"{self.name}_rows"
        results.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in names]).createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{batch}') SELECT {', '.join(names)} FROM {view}")
        self.spark.catalog.dropTempView(view)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def pending(self, items: DataFrame, error_col: str | None = None) -> DataFrame:
        """Items that no batch logs; with ``error_col``, that none logs without an error."""
        done = self.rows() if error_col is None else self.rows().where(F.col(error_col).isNull())
        return items.join(done.select(self.key), self.key, "left_anti")


def flatten_results(results: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return results.select(id_col, F.posexplode("extracoes").alias("ord", "e")).select(id_col, "ord", "e.*")


def write_json(df: DataFrame, path: str) -> None:
    """Nested rows (a trajectory, a report) as JSON lines."""
    df.write.json(path)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows with one key the one with the greatest ``order``; an aggregate, so no sort is needed."""
    newest = F.max_by(F.struct(*[c for c in df.columns if c != key]), order)
    return df.groupBy(key).agg(newest.alias("_r")).select(key, "_r.*").select(*df.columns)
