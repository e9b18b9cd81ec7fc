"""Resampling over documents: bootstrap intervals and paired permutation tests.

Documents with equal counts are exchangeable, so they are grouped first and the draws are
multinomial or binomial over the groups: the same distribution from a few hundred rows, however
many documents there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.operators import evaluate as ev
from mensura.operators.agreement import kappa_of_cells
from mensura.sources.shared import stored

KINDS = ("det", "tup")
DRAWS, SEED, LEVEL = 1000, 42, 0.95


def _f1(tp: np.ndarray, fp: np.ndarray, fn: np.ndarray) -> np.ndarray:
    p = np.divide(tp, tp + fp, out=np.zeros_like(tp, float), where=tp + fp > 0)
    r = np.divide(tp, tp + fn, out=np.zeros_like(tp, float), where=tp + fn > 0)
    return np.divide(2 * p * r, p + r, out=np.zeros_like(p), where=p + r > 0)


def count_groups(counts: DataFrame, names: list[str], by: list[str] = ()) -> DataFrame:
    """Documents, or classes of them, grouped by equal counts."""
    return counts.groupBy(*by, *names).agg(F.sum(ev.many(counts)).alias("n_docs"))


def _triple(kind: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), *[F.col(f"{kind}_{c}").alias(c) for c in ("tp", "fp", "fn")])


def bootstrap_cis(counts: DataFrame, by: tuple[str, ...] = ("arm",), kinds: Iterable[str] = KINDS, draws: int = DRAWS, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """Percentile intervals of micro F1 when documents are drawn with replacement: by, kind, f1, low, high.

    Detection and tuples come from one grouping; its groups are as many as there are distinct triples of counts.
    """
    names, keys = ["tp", "fp", "fn"], [*by, "kind"]
    groups = count_groups(counts.select(*by, ev.many(counts).alias("n_docs"), F.explode(F.array(*[_triple(k) for k in kinds])).alias("_t")).select(*by, "n_docs", "_t.*"), names, keys)
    schema = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in by) + ", kind string, f1 double, low double, high double"

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(names)
        triple, n = frame[names].to_numpy(np.int64), frame["n_docs"].to_numpy(np.int64)
        picks = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), draws)
        values = np.sort(_f1(*(picks @ triple).T))
        a = (1 - level) / 2
        low, high = values[math.floor(a * draws)], values[min(draws - 1, math.ceil((1 - a) * draws) - 1)]
        return pd.DataFrame([[*frame[keys].iloc[0], float(_f1(*(n @ triple)[:, None])[0]), low, high]], columns=[*keys, "f1", "low", "high"])

    return groups.groupBy(*keys).applyInPandas(draw, schema)


def bootstrap_ci(counts: DataFrame, kind: str = "det", by: tuple[str, ...] = ("arm",), draws: int = DRAWS, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """The interval of one kind: by, f1, low, high."""
    return bootstrap_cis(counts, by, (kind,), draws, seed, level).drop("kind")


def compare_arms(counts: DataFrame, arms: list[str], kinds: Iterable[str] = KINDS, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """Paired tests of every two arms (later minus earlier) over their common documents, for
    detection and tuples: arm_a, arm_b, kind, n_docs, difference of F1 and p value.

    p = (extreme + 1) / (draws + 1), a draw being extreme if its difference is as large or larger.
    The counts are read once: a document's row has the sums of all arms side by side, and documents
    with equal counts of two arms are grouped, so the draws run over a few hundred rows.
    """
    numbers = range(len(arms))
    of_arm = lambda k, x: F.sum(F.when(F.col("arm") == arms[k], x)).alias
    wide = counts.where(F.col("arm").isin(*arms)).groupBy("doc_id").agg(*[of_arm(k, F.lit(1))(f"n{k}") for k in numbers], *[of_arm(k, F.col(c))(f"x{k}_{c}") for k in numbers for c in ev.COUNTS], F.max(ev.many(counts)).alias("n_docs"))
    pair = lambda a, b, kind: F.when(F.col(f"n{a}").isNotNull() & F.col(f"n{b}").isNotNull(), F.struct(F.lit(arms[a]).alias("arm_a"), F.lit(arms[b]).alias("arm_b"), F.lit(kind).alias("kind"), *[F.col(f"x{k}_{kind}_{c}").alias(f"{s}_{c}") for s, k in (("a", a), ("b", b)) for c in ("tp", "fp", "fn")]))
    keys, six = ["arm_a", "arm_b", "kind"], [f"{s}_{c}" for s in "ab" for c in ("tp", "fp", "fn")]
    pairs = wide.select("n_docs", F.explode(F.array_compact(F.array(*[pair(a, b, k) for a, b in combinations(numbers, 2) for k in kinds]))).alias("t")).select("n_docs", "t.*")

    def swap(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(six)
        x, n = frame[six].to_numpy(np.int64), frame["n_docs"].to_numpy(np.int64)
        left, right = x[:, :3], x[:, 3:]
        seen = float(_f1(*(n @ right)[:, None])[0] - _f1(*(n @ left)[:, None])[0])
        moved = np.random.default_rng(seed).binomial(n, 0.5, (draws, len(n)))
        delta = moved @ (left - right)
        diff = _f1(*(n @ right + delta).T) - _f1(*(n @ left - delta).T)
        p = (int((np.abs(diff) >= abs(seen) - 1e-12).sum()) + 1) / (draws + 1)
        return pd.DataFrame([[*frame[keys].iloc[0], int(n.sum()), seen, p]], columns=[*keys, "n_docs", "difference", "p_value"])

    return count_groups(pairs, six, keys).groupBy(*keys).applyInPandas(swap, "arm_a string, arm_b string, kind string, n_docs bigint, difference double, p_value double")


def permutation_test(counts: DataFrame, a: str, b: str, kind: str = "det", draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """The test of arm b against a, for one kind."""
    return compare_arms(counts, [a, b], (kind,), draws, seed)


def arm_summary(rows: DataFrame, rounds: DataFrame | None = None) -> dict[str, DataFrame]:
    """``summary_of_classes`` from aligned rows, by arm and seed. They are read twice, for the counts of documents and for the classes of pairs; both are stored."""
    return summary_of_classes(*ev.classes_of_rows(rows), rounds)


def summary_of_classes(counts: DataFrame, pairs: DataFrame, rounds: DataFrame | None = None) -> dict[str, DataFrame]:
    """Per arm, from classes of documents and of pairs (``evaluate.aligned_classes``, by arm and seed): rates per seed and pooled, scores, kappa per field (pooled and per seed), confusion, intervals over documents.

    With ``rounds``, the counts of two annotation rounds (see agreement), the pooled rates have a row more, arm
    'annotators': the ceiling that annotators reach among themselves.
    """
    cells, n = stored(ev.label_cells(pairs), "label_cells"), ev.many(counts)
    # both levels from one grouping: seeds are summed up on the way
    sums = counts.groupingSets([["arm", "seed"], ["arm"]], "arm", "seed").agg(F.grouping("seed").alias("_pooled"), *[F.sum(F.col(c) * n).alias(c) for c in ev.COUNTS])
    rates = ev.micro_prf(sums, ("arm", "seed", "_pooled"))
    pooled = rates.where("_pooled = 1").drop("_pooled", "seed")
    if rounds is not None:
        pooled = pooled.unionByName(ev.micro_prf(rounds.withColumn("arm", F.lit("annotators")), ("arm",)))
    seed = counts.schema["seed"].dataType
    levels = F.explode(F.array(F.struct(F.lit(False).alias("pooled"), F.col("seed").alias("s")), F.struct(F.lit(True).alias("pooled"), F.lit(None).cast(seed).alias("s"))))
    both = cells.withColumn("_l", levels).select("_l.pooled", "arm", F.col("_l.s").alias("seed"), "field", "g", "p", "n").groupBy("pooled", "arm", "seed", "field", "g", "p").agg(F.sum("n").alias("n"))
    kappas = kappa_of_cells(both, ["pooled", "arm", "seed", "field"])
    cis = bootstrap_cis(ev.sum_seeds(counts))
    return {
        "per_seed": rates.where("_pooled = 0").drop("_pooled"), "pooled": pooled, "scores": ev.mean_score(counts), "kappa": kappas.where("pooled").drop("pooled", "seed"), "kappa_per_seed": kappas.where("NOT pooled").drop("pooled"),
        "confusion": ev.confusion(cells, "metric_type", ("arm",)), "det_ci": cis.where("kind = 'det'").drop("kind"), "tup_ci": cis.where("kind = 'tup'").drop("kind"),
    }
