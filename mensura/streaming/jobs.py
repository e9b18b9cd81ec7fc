"""Incremental runs over files: extraction, log compaction and usage per window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mensura.operators.batch import run_batch
from mensura.operators.works import sieve
from mensura.sources.shared import new_folder


def stream_extract(abstracts: DataFrame, function: Callable[[dict], dict], schema: str, out: str, checkpoint: str, text_col: str = "abstract", id_col: str = "doc_id") -> StreamingQuery:
    """New abstracts through the sieve and a user function to an appended table; a restart goes on.

    Takes what is there and ends; the checkpoint is the set of what is done.
    """
    results = run_batch(sieve(abstracts, text_col), function, schema, id_col)
    return results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_compact_log(log: DataFrame, key: str = "i", order: str = "seq", error_col: str = "error") -> DataFrame:
    """The best line per item so far (latest success, else latest error), for update mode.

    The state is one line per item; a batch gives the lines of the items that it touched.
    """
    rank = F.struct(F.col(error_col).isNull().alias("ok"), F.col(order))
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("line")).select(key, "line.*")


def stream_usage(events: DataFrame, ts: str, tokens: str, window: str = "1 hour", late: str = "2 hours", by: list[str] = (), key: str | None = None) -> DataFrame:
    """Calls and tokens per tumbling window, for update or append mode.

    Windows that ended more than ``late`` before the newest event are closed: their state goes and
    rows for them are dropped. With ``key``, a call's repetitions within that time count once.
    """
    timely = events.withWatermark(ts, late)
    once = timely.dropDuplicatesWithinWatermark([key]) if key else timely
    grouped = once.groupBy(F.window(ts, window).alias("w"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("tokens")).select(F.col("w.start").alias("window_start"), *by, "calls", "tokens")


def upsert_stream(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what each batch changes to a folder of its own under ``out``; takes what is there and ends.

    Update mode, so a batch has the rows of the keys that it touched and no others. A batch that is
    repeated after a failure overwrites its own folder. ``upserted`` reads the newest row of each key.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return df.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, out: str, schema: str, keys: list[str]) -> DataFrame:
    """Of every key the row that the latest batch wrote; an aggregate, partial before its one shuffle."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(out)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r")).select(*keys, "_r.*")


def stored_result(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """An upserting stream run over what is there, and its rows, in a fresh folder of the shared one."""
    spark, schema = df.sparkSession, ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    base = new_folder(spark, "streams", name)
    spark.createDataFrame([], df.schema).write.parquet(f"{base}/result/batch=-1")  # what a stream without any batch leaves
    upsert_stream(df, f"{base}/result", f"{base}/checkpoint").awaitTermination()
    return upserted(spark, f"{base}/result", schema, keys)
