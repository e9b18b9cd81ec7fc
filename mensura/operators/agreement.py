"""Agreement of two annotation rounds: kappa, divergences, the whole comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.functions.text import describe_extraction
from mensura.operators import evaluate as ev
from mensura.schemas import TUPLE_FIELDS


def kappa_of_cells(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, po, pe and kappa from counts n of label pairs (g, p); null is a label.

    Null kappa without pairs, 1 if chance agreement is certain. Two groupings, no join: the label
    totals of both sides come from one explode.
    """
    by, n, none = list(by), F.col("n"), F.lit(0).cast("long")
    same = F.when(F.col("g").eqNullSafe(F.col("p")), n).otherwise(none)
    sides = F.explode(F.array(F.struct(F.col("g").alias("label"), n.alias("x"), none.alias("y"), same.alias("same")), F.struct(F.col("p").alias("label"), none.alias("x"), n.alias("y"), none.alias("same"))))
    labels = cells.select(*by, sides.alias("s")).groupBy(*by, "s.label").agg(*[F.sum(f"s.{c}").alias(c) for c in ("x", "y", "same")])
    total = labels.groupBy(*by).agg(F.coalesce(F.sum("x"), none).alias("n"), F.sum("same").alias("same"), F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    po, pe = F.try_divide("same", "n"), F.try_divide(F.col("xy"), F.col("n").cast("double") * F.col("n"))
    return total.select(*by, "n", po.alias("po"), pe.alias("pe"), F.when(pe == 1.0, 1.0).otherwise(F.try_divide(po - pe, F.lit(1.0) - pe)).alias("kappa"))


def cohen_kappa(pairs: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """n, po, pe and kappa of two label columns."""
    cells = pairs.groupBy(*by, F.col(a).cast("string").alias("g"), F.col(b).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return kappa_of_cells(cells, by)


def paired_docs(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key)


def agreement(docs1: DataFrame, first: DataFrame, docs2: DataFrame, second: DataFrame, by: tuple[str, ...] = (), bounds: DataFrame | None = None, small_parts: bool = False) -> dict[str, DataFrame]:
    """Two rounds over their common documents: counts, prf, fields, kappa per categorical field, det_ci and tup_ci.

    The first round is the reference. Inputs come from ``evaluate.prepared``. ``by`` names columns
    of the second round, such as arm and seed, that tell several second rounds apart; each is
    compared with the first. The parts are groupings of the classes of documents (there as classes) and pairs, which one pass over the alignment makes; the
    rows, the matched pairs and the counts of every document are worked out where they are read. ``bounds`` and ``small_parts`` are those of ``aligned_counts``.
    """
    from mensura.operators.stats import bootstrap_cis  # stats imports this module

    both = paired_docs(docs1, docs2)
    keys = tuple(by) or ("round",)
    two = second if by else second.withColumn("round", F.lit("second"))
    systems = two.select(*keys).distinct() if by else both.sparkSession.createDataFrame([("second",)], "round string")
    crowded = ev.crowded_docs(first, two, bounds=bounds)
    classes, pairs = ev.aligned_classes(both, first, two, systems, keys, small_parts=small_parts, crowded=crowded)
    rows = ev.aligned_rows(both, first, two, systems, keys, crowded=crowded)
    cis = bootstrap_cis(classes, keys)
    return {
        "docs": both, "rows": rows, "matched": ev.of_kind(rows, "pair", keys), "counts": ev.doc_counts(rows, keys), "classes": classes, "prf": ev.micro_prf(classes, keys), "fields": ev.field_accuracy(pairs, keys), "kappa": kappa_of_cells(ev.label_cells(pairs, by=keys), [*keys, "field"]),
        "det_ci": cis.where("kind = 'det'").drop("kind"), "tup_ci": cis.where("kind = 'tup'").drop("kind"),
    }


def divergences(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, doc_id, kind, ord, field, first, second): unequal fields of aligned pairs, and rows of one round alone."""
    names = ("value", "value_max", "unit", "target_entity", "metric_type", "context_modifier", "sentence")
    text, said = F.lit(None).cast("string"), lambda side: describe_extraction({c: F.col(f"{side}_{c}") for c in names})
    cell = lambda kind, ord_, field, one, two: F.struct(F.lit(kind).alias("kind"), F.col(ord_).cast("long").alias("ord"), field.alias("field"), one.alias("first"), two.alias("second"))
    unequal = F.array(*[F.when(~ev.fields_equal(f), cell("DIFFERS", "g_ord", F.lit(f), F.col(f"g_{f}").cast("string"), F.col(f"p_{f}").cast("string"))) for f in TUPLE_FIELDS])
    cells = F.when(F.col("kind") == "pair", F.array_compact(unequal)).when(F.col("kind") == "missed", F.array(cell("ONLY-FIRST", "g_ord", text, said("g"), text))).when(F.col("kind") == "invented", F.array(cell("ONLY-SECOND", "p_ord", text, text, said("p"))))
    return rows.select(*by, "doc_id", F.explode(cells).alias("_cell")).select(*by, "doc_id", "_cell.*")
