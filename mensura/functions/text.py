"""Column functions on text, numbers, units and entities. All run inside the JVM but number_spellings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.schemas import UNIT_ALIASES, UNITS

#: Relative closeness of two values that count as one.
TOLERANCE = 0.01


def collapse_ws(x: Column) -> Column:
    """Each run of white space, Unicode's included, as one space; the ends are not trimmed."""
    return F.regexp_replace(x, r"(?U)\s+", " ")


def normalize_ws(x: Column) -> Column:
    """collapse_ws with the ends trimmed."""
    return F.trim(collapse_ws(x))


def normalize_numbers(x: Column) -> Column:
    """Middle dots between digits as decimal points, the minus sign (and spaces after it) as a hyphen."""
    return F.regexp_replace(F.regexp_replace(x, r"(\d)·\s?(\d)", "$1.$2"), r"−\s*(?=\d)|−", "-")


def _pairs(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def normalize_unit(x: Column) -> Column:
    """The canonical unit of a spelling, null if there is none (or x is null).

    Looked up without white space and in lower case, then trimmed in lower case, then as a
    canonical unit whatever its case; ``M`` and ``m`` are the molar, ``mM`` is unknown.
    """
    aliases = _pairs(UNIT_ALIASES)
    canonical = _pairs({u.lower(): u for u in UNITS})
    bare, trimmed = F.lower(F.regexp_replace(x, r"(?U)\s+", "")), F.lower(normalize_ws(x))
    probe = lambda table, key: F.try_element_at(table, key)
    return F.coalesce(probe(aliases, bare), probe(aliases, trimmed), probe(canonical, bare), probe(canonical, trimmed))


def normalize_entity(x: Column) -> Column:
    """Lower case, only a-z and 0-9, one trailing s dropped from three characters on."""
    bare = F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    return F.when(bare.endswith("s") & (F.length(bare) > 2), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)


def same_entity(a_norm: Column, b_norm: Column, a_canonical: Column, b_canonical: Column) -> Column:
    """Equal normalized names, or one known canonical term; on columns computed beforehand."""
    return F.coalesce(a_norm.eqNullSafe(b_norm) | F.coalesce(a_canonical == b_canonical, F.lit(False)), F.lit(False))


def values_match(a: Column, b: Column) -> Column:
    """Both null, or within one percent of the larger magnitude."""
    close = F.abs(a - b) <= F.lit(TOLERANCE) * F.greatest(F.abs(a), F.abs(b))
    return (a.isNull() & b.isNull()) | F.coalesce(close, F.lit(False))


def same_number(a: Column, b: Column) -> Column:
    """Both there and exactly equal; null matches nothing."""
    return F.coalesce(a == b, F.lit(False))


def first_number(x: Column) -> Column:
    """The first number of a text as a double; commas dropped, middle dots read as points, else null."""
    found = F.regexp_extract(F.replace(x.cast("string"), F.lit("·"), F.lit(".")), r"[-+]?\d[\d,\.]*", 0)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def normalize_label(x: Column) -> Column:
    """Underscores of the older labels as spaces."""
    return F.translate(x, "_", " ")


def rebuild_abstract(index: Column) -> Column:
    """Text of an inverted index (word to positions): words by position, one space between."""
    entries = F.transform(F.map_entries(index), lambda e, k: F.transform(e["value"], lambda p: F.struct(p.alias("p"), k.alias("k"), e["key"].alias("w"))))
    words = F.transform(F.array_sort(F.flatten(entries)), lambda s: s["w"])
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def extract_blocks(x: Column) -> Column:
    """The trimmed texts between <START> and <END>, blank ones dropped."""
    found = F.regexp_extract_all(x, F.lit(r"(?s)<START>(.*?)<END>"), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != "")


def estimate_tokens(x: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.length(x) / 4), F.lit(0))


def doc_id_from_url(x: Column) -> Column:
    """The last path part, trailing slashes stripped; null if blank."""
    last = F.regexp_extract(F.regexp_replace(F.trim(x), "/+$", ""), "([^/]*)$", 1)
    return F.nullif(last, F.lit(""))


def log_instant(ts: Column) -> Column:
    """ISO 8601 with seconds; the session's time zone is taken to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def vote_key(value: Column, value_max: Column, unit: Column, target_entity: Column) -> Column:
    """What makes two sampled extractions one: four raw tokens, trimmed, lower case, nulls kept."""
    low = lambda c: F.lower(F.trim(c.cast("string")))
    return F.struct(low(value).alias("value"), low(value_max).alias("value_max"), low(unit).alias("unit"), low(target_entity).alias("target_entity"))


def cache_key(model: Column, temperature: Column, max_tokens: Column, messages: Column, run: Column, **extra: Column) -> Column:
    """SHA-256 of the request as JSON with sorted keys; extras only where given."""
    own = {"max_tokens": max_tokens, "messages": messages, "model": model, "run": run, "temperature": temperature} | extra
    return F.sha2(F.to_json(F.struct(*[own[k].alias(k) for k in sorted(own)])), 256)


def _spell(value: float) -> list[str]:
    out = {f"{value:g}", str(value)}
    if value == int(value):
        out |= {str(int(value)), f"{int(value):,}"}
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _spellings(values: pd.Series) -> pd.Series:
    finite = values.notna() & (values.abs() != float("inf"))
    return pd.Series([_spell(float(v)) if ok else None for v, ok in zip(values, finite)])


def number_spellings(x: Column) -> Column:
    """How a value may be written: six digits, in full, and whole numbers with and without commas.

    Formatting of doubles differs between Python and the JVM, so this one is a vectorized helper.
    Null for null and for values that are not finite.
    """
    return _spellings(x.cast("double"))


def value_appears(value: Column, spellings: Column, sentence: Column) -> Column:
    """Whether a spelling is in the sentence (as a plain substring); a null value always is."""
    text = normalize_numbers(sentence)
    return value.isNull() | F.coalesce(F.exists(spellings, lambda s: text.contains(s)), F.lit(False))


@F.pandas_udf(T.StringType())
def _short(values: pd.Series) -> pd.Series:
    return values.map(lambda v: "?" if pd.isna(v) else f"{v:g}")


def describe_extraction(e: dict[str, Column]) -> Column:
    """One line on an extraction: value or range, unit, entity, metric, modifier, start of the sentence."""
    span = F.concat(_short(e["value"]), F.when(e["value_max"].isNotNull(), F.concat(F.lit("-"), _short(e["value_max"]))).otherwise(""))
    return F.concat_ws(" | ", F.concat(span, F.lit(" "), F.coalesce(e["unit"], F.lit("(no unit)"))), F.coalesce(e["target_entity"], F.lit("-")), F.coalesce(e["metric_type"], F.lit("-")), F.coalesce(e["context_modifier"], F.lit("-")), F.concat(F.lit('"'), F.substring(e["sentence"], 1, 90), F.lit('"')))
