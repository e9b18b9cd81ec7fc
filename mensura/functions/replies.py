"""Model replies: tolerant reading, validation against the schema, anchoring in the source text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.functions.text import collapse_ws, normalize_unit, normalize_ws, number_spellings, value_appears
from mensura.schemas import EXTRACTION, METRIC_TYPES, MODIFIERS, SOLUTION_UNITS

#: The names under which a reply's extractions are looked for, in turn.
LIST_KEYS = ("extracoes", "extractions", "extraction", "results", "data")
#: Letters of an unreadable reply that its error quotes.
QUOTED = 160
_JSON = json.JSONDecoder()


def _value_at(text: str, begin: int, end: int) -> dict | list | None:
    """The JSON object or list that takes exactly text[begin:end], if there is one."""
    if not 0 <= begin < end:
        return None
    try:
        value, stop = _JSON.raw_decode(text, begin)
    except ValueError:
        return None
    return value if stop == end and isinstance(value, dict | list) else None


def _read(reply: str | None) -> tuple[str | None, str | None]:
    """(extractions as a JSON list, None), or (None, why there are none)."""
    if reply is None:
        return None, "no reply"
    text = reply.strip().removeprefix("```").removeprefix("json").removesuffix("```").strip()
    places = [(0, len(text)), *((text.find(first), text.rfind(last) + 1) for first, last in ("{}", "[]"))]
    value = next((v for v in (_value_at(text, *place) for place in places) if v is not None), None)
    if value is None:
        return None, f"no JSON object or list in the reply: {text[:QUOTED]!r}"
    lists = [value] if isinstance(value, list) else [value[k] for k in LIST_KEYS if isinstance(value.get(k), list)]
    objects = [x for x in lists[0] if isinstance(x, dict)] if lists else []
    return json.dumps(objects, ensure_ascii=False), None


@F.pandas_udf(T.StructType().add("items", "string").add("error", "string"))
def parse_reply(replies: pd.Series) -> pd.DataFrame:
    """items: the reply's extractions as a JSON list of objects; error: why there are none.

    Fences are stripped; the whole text, the widest {...} and the widest [...] are tried in turn,
    a bare list is taken as the extractions, scalars don't count. JSON as Python reads it (the
    JVM's readers are laxer on trailing text and stricter on repeated keys), hence the helper.
    """
    return pd.DataFrame([_read(r if isinstance(r, str) else None) for r in replies], columns=["items", "error"])


def extraction_list(items: Column) -> Column:
    """The JSON list as an array of raw JSON objects, one string each."""
    values = F.from_json(items, "array<variant>")
    return F.transform(values, lambda v: F.to_json(v))


def raw_fields(raw: Column) -> Column:
    """A raw JSON object as a map from its keys to their values as texts (null stays null): one parse for all that is asked of it."""
    return F.from_json(raw, "map<string, string>")


def typed(fields: Column) -> Column:
    """The fields coerced, from ``raw_fields``: numeric texts and booleans to doubles, "true"/1 to booleans."""
    text = lambda name: F.try_element_at(fields, F.lit(name))
    number = lambda name: F.when(F.lower(text(name)) == "true", 1.0).when(F.lower(text(name)) == "false", 0.0).otherwise(F.trim(text(name)).try_cast("double"))
    flag = F.when(F.lower(text("is_range")).isin("true", "1", "1.0", "yes", "on", "t", "y"), True).when(F.lower(text("is_range")).isin("false", "0", "0.0", "no", "off", "f", "n"), False)
    made = {"value": number("value"), "value_max": number("value_max"), "is_range": flag}
    return F.struct(*[made.get(n, text(n)).cast(t).alias(n) for n, t in EXTRACTION.items()])


def validate_extractions(rows: DataFrame, raw: str = "raw", derived_type: str | None = None) -> DataFrame:
    """Adds the typed fields, reasons (array, empty if valid) and valid, from a raw JSON object per row.

    Reasons on single fields are all given; the first failing rule on their coherence is given only
    if the fields are sound. An entity type outside the vocabulary is taken from ``derived_type``.
    """
    e = rows.withColumn("_m", raw_fields(F.col(raw))).withColumn("_e", typed(F.col("_m")))
    f = lambda name: F.col(f"_e.{name}")
    has = lambda name: F.coalesce(F.map_contains_key("_m", name), F.lit(False))
    given = lambda name: F.try_element_at("_m", F.lit(name))
    kind = F.when(f("entity_type").isin("element", "element_group", "oxide", "mineral", "other"), f("entity_type")).otherwise(F.coalesce(F.col(derived_type), F.lit("other")) if derived_type else F.lit("other"))
    modifier = F.when(has("context_modifier"), f("context_modifier")).otherwise("none")
    fields = [
        *[(~has(n), f"{n}: missing") for n in ("value", "is_range", "sentence", "metric_type", "target_entity")],
        *[(given(n).isNotNull() & f(n).isNull(), f"{n}: not a number") for n in ("value", "value_max")],
        (has("is_range") & f("is_range").isNull(), "is_range: not a boolean"),
        *[(has(n) & (F.coalesce(F.length(f(n)), F.lit(0)) < 1), f"{n}: empty") for n in ("sentence", "target_entity")],
        (has("metric_type") & ~F.coalesce(f("metric_type").isin(*METRIC_TYPES), F.lit(False)), "metric_type: not in the vocabulary"),
        (~F.coalesce(modifier.isin(*MODIFIERS), F.lit(False)), "context_modifier: not in the vocabulary"),
        (f("unit").isNotNull() & normalize_unit(f("unit")).isNull(), "unit: not recognised"),
    ]
    single = F.array_compact(F.array(*[F.when(bad, F.lit(why)) for bad, why in fields]))
    unit = normalize_unit(f("unit"))
    coherent = (
        F.when(f("metric_type") == "Invalid Candidate", F.lit(None).cast("string"))
        .when(f("is_range") & f("value_max").isNull(), "range without value_max")
        .when(f("is_range") & (f("value_max") < f("value")), "value_max below value")
        .when(~f("is_range") & f("value_max").isNotNull(), "single value with value_max")
        .when(f("value").isNull() & f("value_max").isNull(), "no value")
        .when(unit.isin(*SOLUTION_UNITS) & (f("metric_type") != "Process Metric"), "solution unit outside Process Metric")
    )
    out = e.withColumn("_single", single).withColumn("reasons", F.when(F.size("_single") > 0, F.col("_single")).otherwise(F.array_compact(F.array(coherent))))
    clean = {"unit": unit, "sentence": normalize_ws(f("sentence")), "target_entity": normalize_ws(f("target_entity")), "entity_type": kind, "context_modifier": modifier}
    return out.withColumns({n: clean.get(n, f(n)) for n in EXTRACTION} | {"valid": F.size("reasons") == 0}).drop("_e", "_m", "_single")


def anchor_extractions(rows: DataFrame, abstract: str = "abstract") -> DataFrame:
    """Adds anchor_reason: null if the sentence is in the abstract and the value is spelt in it.

    Both are compared with collapsed white space. Only ``value`` is looked for, not ``value_max``.
    """
    there = F.coalesce(normalize_ws(F.col(abstract)).contains(normalize_ws(F.col("sentence"))), F.lit(False))
    spelt = rows.withColumn("_forms", number_spellings(F.col("value")))
    reason = F.when(~there, "sentence not in the abstract").when(~value_appears(F.col("value"), F.col("_forms"), F.col("sentence")), "value not in the sentence")
    return spelt.withColumn("anchor_reason", reason).drop("_forms")


def usable_reply(text: Column, finish_reason: Column) -> Column:
    """Not blank and not cut off; a null reason will do."""
    return F.coalesce(F.trim(collapse_ws(text)) != "", F.lit(False)) & ~finish_reason.eqNullSafe(F.lit("length"))


def is_solution(unit: Column) -> Column:
    return F.coalesce(unit.isin(*SOLUTION_UNITS), F.lit(False))


def rejections_by_stage(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def resolve_attempts(attempts: DataFrame, ceiling: int = 16000) -> DataFrame:
    """One row per document from its ordered attempts (doc_id, attempt, items, error, finish_reason, max_tokens).

    The first readable attempt wins; without one the last attempt's error stands. Attempts after
    one that was cut off at the ceiling don't count. Columns: doc_id, items, error, attempts,
    finish_reason, max_tokens.
    """
    cut = F.col("finish_reason").eqNullSafe(F.lit("length"))
    readable = F.col("items").isNotNull() & ~cut
    stop = readable | (cut & (F.col("max_tokens") >= ceiling))
    before = Window.partitionBy("doc_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    counted = attempts.withColumn("_stopped", F.coalesce(F.max(stop).over(before), F.lit(False))).where("NOT _stopped")
    why = F.when(cut, F.concat(F.lit("cut off at max_tokens="), F.col("max_tokens").cast("string"))).otherwise(F.col("error"))
    row = F.struct("attempt", F.when(readable, F.col("items")).alias("items"), F.when(~readable, why).alias("error"), "finish_reason", "max_tokens")
    last = counted.groupBy("doc_id").agg(F.max(row).alias("r"))
    return last.select("doc_id", "r.items", "r.error", F.col("r.attempt").alias("attempts"), "r.finish_reason", "r.max_tokens")


def next_action(resolved: DataFrame, most_attempts: int = 3, ceiling: int = 16000) -> DataFrame:
    """Adds action (done, stop, raise_budget, ask_again) and next_max_tokens."""
    cut = F.col("finish_reason").eqNullSafe(F.lit("length"))
    action = (
        F.when(F.col("error").isNull(), "done").when(cut & (F.col("max_tokens") >= ceiling), "stop").when(F.col("attempts") >= most_attempts, "stop")
        .when(cut, "raise_budget").otherwise("ask_again")
    )
    return resolved.withColumn("action", action).withColumn("next_max_tokens", F.when(action == "raise_budget", F.least(F.col("max_tokens") * 2, F.lit(ceiling))).when(action == "ask_again", F.col("max_tokens")))
