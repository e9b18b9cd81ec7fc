"""Runs over many items: what is pending, cached replies, user functions, logs and usage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.functions.replies import usable_reply
from mensura.operators.scan import before, carried, inside, ranged
from mensura.sources.shared import new_place, stored


def pending_items(items: DataFrame, log: DataFrame, key: str, mode: str = "logged", error_col: str = "error") -> DataFrame:
    """Items not done yet; done is what is logged at all, or (mode 'success') logged without an error."""
    if mode not in ("logged", "success"):
        raise ValueError("mode is 'logged' or 'success'")
    done = log if mode == "logged" else log.where(F.col(error_col).isNull())
    return items.join(done.select(key).distinct(), key, "left_anti")


def slice_items(items: DataFrame, index: str, start: int = 0, limit: int | None = None) -> DataFrame:
    """Items by index from ``start`` on, ``limit`` of them, whether done or not."""
    kept = items.where(F.col(index) >= start)
    return kept if limit is None else kept.where(F.col(index) < start + limit)


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str = "cache_key", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses); a blank cached text is a miss."""
    good = cache.where(F.coalesce(F.trim(text), F.lit("")) != "").dropDuplicates([key])
    return requests.join(good, key), requests.join(good.select(key), key, "left_anti")


def exclude_gold(docs: DataFrame, gold_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(gold_docs.select(key).distinct(), key, "left_anti")


def run_batch(items: DataFrame, function: Callable[[dict], dict], schema: str, id_col: str = "doc_id", error_col: str = "error") -> DataFrame:
    """Applies a user function to every row; what it raises goes to ``error_col`` as "Type: message".

    The function takes a row as a dict and returns a dict of the schema's columns. Rows are dealt
    out by id first, so that slow calls spread over all tasks.
    """
    fields = T._parse_datatype_string(schema)
    names = [f.name for f in fields.fields]
    kind = items.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                try:
                    got = function(row)
                    rows.append([row[id_col], *[got.get(n) for n in names], None])
                except Exception as e:  # the contract: failures are rows
                    rows.append([row[id_col], *[None] * len(names), f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(rows, columns=[id_col, *names, error_col])

    return items.repartition(id_col).mapInPandas(run, f"`{id_col}` {kind}, {schema}, `{error_col}` string")


#: What a provider returns, and what a cached reply holds besides: the request's settings and when it was made.
REPLY = "text string, finish_reason string, tokens_in bigint, tokens_out bigint, tokens_reasoning bigint, reasoning_chars bigint"
RECORD = f"{REPLY}, model string, temperature double, max_tokens bigint, run bigint, created timestamp"


def _names(ddl: str) -> list[str]:
    return [f.name for f in T._parse_datatype_string(ddl).fields]


def obtain_replies(requests: DataFrame, provider: Callable[[dict], dict], cache: DataFrame | None = None, key: str = "cache_key") -> DataFrame:
    """One reply row per request: its key, the RECORD columns, cached and error.

    A request with a usable cached reply (see cache_lookup) takes that; the others go to the
    provider, a function of the request's row as a dict that returns the REPLY columns. What it
    raises is an error row; an empty text is one too. Requests of one key are asked once. Model,
    temperature, max_tokens and run are the request's own columns, null where it has none.
    """
    wanted = requests.dropDuplicates([key])
    names, settings = _names(RECORD), [n for n in _names(RECORD) if n not in _names(REPLY) and n != "created"]
    kinds = {f.name: f.dataType.simpleString() for f in T._parse_datatype_string(RECORD).fields}
    empty = requests.sparkSession.createDataFrame([], f"{key} {requests.schema[key].dataType.simpleString()}, {RECORD}")
    kept = (cache if cache is not None else empty).select(key, *[F.col(n) if cache is None or n in cache.columns else F.lit(None).cast(kinds[n]).alias(n) for n in names])
    hits, misses = cache_lookup(wanted.select(key), kept)
    plain = wanted.join(misses.select(key), key, "left_semi")
    own = wanted.select(key, *[(F.col(n) if n in wanted.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in settings])
    fresh = run_batch(plain, provider, REPLY, key).join(own, key).withColumn("created", F.current_timestamp())
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    fresh = fresh.withColumn("error", F.when(F.col("error").isNull() & blank, F.lit("empty reply")).otherwise(F.col("error")))
    cached = hits.select(key, *names, F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    return cached.unionByName(fresh.withColumn("cached", F.lit(False)))


def read_reply_cache(spark: SparkSession, path: str, key: str = "cache_key", kind: str = "string") -> DataFrame:
    """The cached records, of every key the newest."""
    rows = spark.read.schema(f"{key} {kind}, {RECORD}, slice string, job string").option("ignoreMissingFiles", True).parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*_names(RECORD)), "created").alias("_r")).select(key, "_r.*")


def ask_with_cache(requests: DataFrame, provider: Callable[[dict], dict], path: str, job: str, key: str = "cache_key", slices: int = 16) -> DataFrame:
    """Replies to all requests, with every usable new one written back to the cache at ``path``.

    Requests go slice by slice, by a hash of their key. A slice's new replies are written once, to a
    folder of this job and slice that appears when it is complete, and everything after reads them
    from there: no reply is asked for twice, a job that is killed loses the slice at work only, and
    one that runs again finds the others in the cache. Replies that can't be used
    (errors, blank or cut-off texts) are returned but not cached, so the next job asks again.
    """
    spark = requests.sparkSession
    kind = requests.schema[key].dataType.simpleString()
    if new_place(spark, path):
        spark.createDataFrame([], f"{key} {kind}, {RECORD}").write.parquet(f"{path}/slice=none/job=none")
    numbered = requests.dropDuplicates([key]).withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)))
    parts = None
    for k in range(slices):
        replies = obtain_replies(numbered.where(F.col("_slice") == k).drop("_slice"), provider, read_reply_cache(spark, path, key, kind), key)
        rows = stored(replies, "replies")
        parts = rows if parts is None else parts.unionByName(rows)
        good = rows.where(~F.col("cached") & F.col("error").isNull() & usable_reply(F.col("text"), F.col("finish_reason")))
        if not good.isEmpty():
            good.select(key, *_names(RECORD)).write.parquet(f"{path}/slice={k}/job={job}-{uuid.uuid4().hex}")
    return parts


def echo_provider(max_tokens: int, text: str = "text") -> Callable[[dict], dict]:
    """A deterministic provider: replies with the request's own text, cut at its budget of four letters a token."""

    def reply(row: dict) -> dict:
        own = row[text] or ""
        out = own[: 4 * max_tokens]
        return {"text": out, "finish_reason": "stop" if out == own else "length", "tokens_in": -(-len(own) // 4), "tokens_out": -(-len(out) // 4)}

    return reply


def seed_fan_out(docs: DataFrame, arms: list[str], seeds: list[int] = (0, 1, 2), attempt: int = 1) -> DataFrame:
    """Every document for every arm and seed, with the run number that keeps their caches apart."""
    plan = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(s).alias("seed")) for a in arms for s in seeds]))
    return docs.withColumn("_p", plan).select("*", "_p.*", (F.col("_p.seed") * 100 + attempt - 1).alias("run")).drop("_p")


def compact_log(log: DataFrame, key: str = "i", order: str = "seq", error_col: str = "error") -> DataFrame:
    """One row per item: the latest success, else the latest error. An aggregate, so no sort is needed."""
    rank = F.struct(F.col(error_col).isNull().alias("ok"), F.col(order))
    best = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), rank).alias("_r"))
    return best.select(key, "_r.*")


def consecutive_failures(events: DataFrame, order: str, failed: Column, limit: int = 5, by: list[str] = (), long_runs: bool | None = None, parts: int | None = None) -> DataFrame:
    """Adds run_length (failures in a row up to here) and abort (the limit is reached).

    ``by`` names the columns of a run. Without it, or with ``long_runs``, a run may be of any length:
    its events are dealt out by ranges of ``order``, and a range that begins with failures takes
    over how many there were just before it. Else each run is one window.
    """
    by = list(by)
    long_runs = not by if long_runs is None else long_runs
    rows = events.withColumn("_f", F.coalesce(failed, F.lit(False)).cast("int"))
    w = inside([order], by) if long_runs else Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (ranged(rows, [order], by, parts) if long_runs else rows).withColumn("_n", F.row_number().over(w))
    good = F.max(F.when(F.col("_f") == 0, F.col("_n")))
    run = numbered.withColumn("_good", good.over(w))
    carry = F.lit(0)
    if long_runs:  # failures since the last success of the ranges before
        run = carried(run, by, {"_last": good}, {"_carry": F.col("_start") - F.coalesce(F.max(F.col("_start") + F.col("_last")).over(before(by)), F.lit(0))})
        carry = F.when(F.col("_good").isNull(), F.coalesce("_carry", F.lit(0))).otherwise(0)
    length = F.when(F.col("_f") == 1, F.col("_n") - F.coalesce("_good", F.lit(0)) + carry).otherwise(0)
    return run.withColumn("run_length", length).withColumn("abort", F.col("run_length") >= limit).select(*events.columns, "run_length", "abort")


def estimate_cost(items: DataFrame, text_col: str, k: int = 1, fixed_tokens: int = 0, max_output: int = 0) -> DataFrame:
    """items, calls, input_tokens and the ceiling of output tokens for k samples of each item."""
    tokens = F.ceil(F.length(F.coalesce(text_col, F.lit(""))) / 4) + fixed_tokens
    total = items.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(tokens), F.lit(0)).alias("t"))
    return total.select("items", (F.col("items") * k).alias("calls"), (F.col("t") * k).alias("input_tokens"), (F.col("items") * k * max_output).alias("output_ceiling"))


def usage_summary(replies: DataFrame, by: list[str], cached: Column, tokens_in: str, tokens_out: str) -> DataFrame:
    return replies.groupBy(*by).agg(
        F.sum((~cached).cast("long")).alias("calls"), F.sum(cached.cast("long")).alias("cache_hits"),
        F.coalesce(F.sum(tokens_in), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(tokens_out), F.lit(0)).alias("tokens_out"),
    )
