"""Tables of a prompt search: what was spent, what was best so far, who stays in the beam."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.operators.scan import before, carried, inside, ranged


def best_so_far(trajectory: DataFrame, by: list[str] = (), spent: str = "calls", value: str = "val_score", floor: float = -1.0, long: bool | None = None, parts: int | None = None) -> DataFrame:
    """Adds best: the greatest value up to each row, by calls spent.

    Rows of one search (its columns: ``by``) form a window. Without ``by``, or with ``long``, a search may
    be of any length: its rows are dealt out by ranges of ``spent``, which pass their best on.
    """
    by = list(by)
    if not (not by if long is None else long):
        w = Window.partitionBy(*by).orderBy(spent).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return trajectory.withColumn("best", F.greatest(F.max(value).over(w), F.lit(floor)))
    rows = ranged(trajectory, [spent], by, parts).withColumn("_best", F.max(value).over(inside([spent], by)))
    passed = carried(rows, by, {"_most": F.max(value)}, {"_carry": F.max("_most").over(before(by))})
    return passed.withColumn("best", F.greatest("_best", "_carry", F.lit(floor))).select(*trajectory.columns, "best")


def calls_so_far(events: DataFrame, by: list[str], order: list[str], calls: str, long: bool | None = None, parts: int | None = None) -> DataFrame:
    """Adds calls_before: what had been spent before each event.

    Without ``by``, or with ``long``, events are dealt out by ranges of ``order``, which pass their sums on.
    """
    by = list(by)
    if not (not by if long is None else long):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return events.withColumn("calls_before", F.coalesce(F.sum(calls).over(w), F.lit(0)))
    rows = ranged(events, order, by, parts).withColumn("_spent", F.sum(calls).over(inside(order, by).rowsBetween(Window.unboundedPreceding, -1)))
    passed = carried(rows, by, {"_sum": F.sum(calls)}, {"_carry": F.sum("_sum").over(before(by))})
    return passed.withColumn("calls_before", F.coalesce("_spent", F.lit(0)) + F.coalesce("_carry", F.lit(0))).select(*events.columns, "calls_before")


def beam_topk(candidates: DataFrame, k: int, by: list[str] = ("step",), score: str = "train_f1", order: str = "candidate") -> DataFrame:
    """Adds in_beam: the k best of each step, ties to the earlier candidate."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), order)
    return candidates.withColumn("in_beam", F.row_number().over(w) <= k)


def final_choice(beam: DataFrame, by: list[str] = (), score: str = "val_score", order: str = "candidate") -> DataFrame:
    """The best validated member of the beam, first on ties."""
    best = F.max_by(F.struct(*beam.columns), F.struct(F.col(score), (-F.col(order)).alias("o")))
    return beam.groupBy(*by).agg(best.alias("r")).select("r.*")


def minibatch(docs: DataFrame, n: int, seed: int, step: int, key: str = "doc_id") -> DataFrame:
    """n documents for a step, without replacement, in an order that seed and step set."""
    return docs.orderBy(F.xxhash64(F.lit(seed + step), key), key).limit(n)


def errors_by_type(errors: DataFrame, order: str, first: int = 12, per_type: int = 6, kind: str = "error_type") -> DataFrame:
    """Of the first errors at most so many of each type, with each type's total among them."""
    few = errors.orderBy(order).limit(first)
    w = Window.partitionBy(kind)
    return few.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("_n", F.row_number().over(w.orderBy(order))).where(F.col("_n") <= per_type).drop("_n")


def lineage_edges(trajectory: DataFrame, index: str = "index", parents: str = "parents", score: str = "val_score") -> DataFrame:
    """(parent, child, parent_score, child_score) of every link."""
    links = trajectory.select(F.col(index).alias("child"), F.col(score).alias("child_score"), F.explode(parents).alias("parent"))
    return links.join(trajectory.select(F.col(index).alias("parent"), F.col(score).alias("parent_score")), "parent").select("parent", "child", "parent_score", "child_score")


def distinct_prompts(prompts: DataFrame, text: str = "text", order: str = "seq") -> DataFrame:
    """Each prompt once, at its first appearance."""
    others = [c for c in prompts.columns if c != text]
    return prompts.groupBy(text).agg(F.min_by(F.struct(*others), order).alias("r")).select(text, "r.*")
