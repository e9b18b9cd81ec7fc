"""Scoring predicted extractions against gold: alignment, counts, rates, strict matching, critique.

Long tables: gold (doc_id, ord, fields) and predictions (arm, seed, doc_id, ord, fields); the
documents come from gold_docs, never from the extractions, so empty documents count. ``by`` names
the columns (such as arm and seed) that tell systems apart. Entities are compared by the columns
ent_norm and ent_canon, which ``prepared`` adds.

``aligned_rows`` aligns both sides once, into rows from which every count, rate and report is a
grouping; store them where several parts are wanted. Where the counts of documents are all that is
wanted, ``aligned_counts`` makes them without the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mensura.functions.lexicon import resolve_entities
from mensura.functions.text import describe_extraction, first_number, collapse_ws, normalize_entity, same_entity, values_match
from mensura.schemas import CATEGORICAL, EXTRACTION, TUPLE_FIELDS, UNITS
from mensura.sources.shared import stored

BY = ("arm", "seed")


def lookup_texts(ids: DataFrame, primary: DataFrame, extra: DataFrame, key: str = "doc_id", text: str = "abstract") -> DataFrame:
    """Adds the text and its source (primary, extra, missing). An id in primary is taken from there even if its text is empty."""
    one = primary.groupBy(key).agg(F.first(text).alias("_p")).withColumn("_in_p", F.lit(True))
    two = extra.groupBy(key).agg(F.first(text).alias("_x")).withColumn("_in_x", F.lit(True))
    both = ids.join(one, key, "left").join(two, key, "left")
    source = F.when(F.col("_in_p"), "primary").when(F.col("_in_x"), "extra").otherwise("missing")
    return both.withColumn("source", source).withColumn(text, F.when(F.col("_in_p"), F.coalesce("_p", F.lit(""))).when(F.col("_in_x"), F.coalesce("_x", F.lit("")))).drop("_p", "_x", "_in_p", "_in_x")


def prepared(extractions: DataFrame, lexicon: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """Adds ent_norm and ent_canon; without a lexicon no canonical term is known."""
    named = extractions.withColumn("ent_norm", normalize_entity(F.col("target_entity")))
    if lexicon is None:
        return named.withColumn("ent_canon", F.lit(None).cast("string"))
    return resolve_entities(named, lexicon, fuzzy=fuzzy).drop("ent_type")


#: Width of the value blocks: values within one percent are at most one block apart.
BLOCK = 0.0101
#: Gold and predicted rows of a document that are aligned as lists; more go by rounds over their pairs.
MOST_IN_LIST = 1000
#: Rounds go on while they settle so large a share of the pairs.
LEAST_SETTLED = 0.2

OWN = ("ord", *EXTRACTION, "ent_norm", "ent_canon")


def _side(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    have = [c for c in OWN if c in df.columns]
    return df.select(*keep, *[F.col(c).alias(f"{prefix}_{c}") for c in have])


def candidate_pairs(gold: DataFrame, pred: DataFrame, by: tuple[str, ...] = BY, blocked: bool = True) -> DataFrame:
    """Pairs of one document whose values match (one percent; null matches null), g_ and p_ columns.

    ``blocked`` adds an equality on logarithmic value blocks, so that a document with very many
    values is spread over tasks and not every two of them are compared; the pairs are the same.
    """
    g, p = _side(gold, "g", ["doc_id"]), _side(pred, "p", [*by, "doc_id"])
    if not blocked:
        return g.join(p, "doc_id").where(values_match(F.col("g_value"), F.col("p_value")))
    # nulls and zeros match only their like; other blocks are numbered by magnitude and sign
    level = lambda v, d: F.struct(F.lit(1).alias("kind"), (v > 0).alias("up"), (F.floor(F.log(F.abs(v)) / BLOCK) + d).alias("level"))
    lone = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit(False).alias("up"), F.lit(0).cast("bigint").alias("level"))
    block = lambda v: F.when(v.isNull(), lone(-1)).when(v == 0, lone(0)).otherwise(level(v, 0))
    near = lambda v: F.when(v.isNull() | (v == 0), F.array(block(v))).otherwise(F.array(*[level(v, d) for d in (-1, 0, 1)]))
    left, right = g.withColumn("_b", F.explode(near(F.col("g_value")))), p.withColumn("_b", block(F.col("p_value")))
    return left.join(right, ["doc_id", "_b"]).where(values_match(F.col("g_value"), F.col("p_value"))).drop("_b")


def pair_score(g: Column, p: Column) -> Column:
    """1 for the value, and halves for the upper value, the unit and the entity of two structs."""
    half = lambda c: F.when(c, 0.5).otherwise(0.0)
    entity = same_entity(g["ent_norm"], p["ent_norm"], g["ent_canon"], p["ent_canon"])
    return F.lit(1.0) + half(values_match(g["value_max"], p["value_max"])) + half(g["unit"].eqNullSafe(p["unit"])) + half(entity)


def _greedy(candidates: Column) -> Column:
    """The greedy one-to-one choice among a document's sorted candidates (structs with i and j)."""
    alone = lambda side: F.size(F.array_distinct(F.transform(candidates, lambda c: c[side]))) == F.size(candidates)
    taken = lambda acc, c: F.exists(acc, lambda a: (a["i"] == c["i"]) | (a["j"] == c["j"]))
    greedy = F.aggregate(candidates, F.slice(candidates, 1, 0), lambda acc, c: F.when(taken(acc, c), acc).otherwise(F.concat(acc, F.array(c))))
    return F.when(alone("i") & alone("j"), candidates).otherwise(greedy)


def mutual_best(candidates: DataFrame, keys: list[str], least_settled: float = LEAST_SETTLED) -> DataFrame:
    """The greedy one-to-one choice among candidate rows (keys, k, i, j): ascending k, then i, then j.

    Each round takes the pairs that come first for both their sides, which the greedy choice takes
    too, and drops their rivals; rounds are joins and groupings by a side, so a group of any size is
    spread over tasks. Ties can make chains that settle one pair a round: once a round settles few of
    the pairs, what is left is sorted within its groups, and one pass over the rows chooses, keeping
    the sides that are taken and never the rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    left, chosen = stored(candidates.select(*keys, "k", "i", "j"), "candidates"), None
    n = left.count()
    while n:
        by_i = left.groupBy(*keys, "i").agg(F.min(F.struct("k", "j")).alias("b")).select(*keys, "i", "b.j")
        by_j = left.groupBy(*keys, "j").agg(F.min(F.struct("k", "i")).alias("b")).select(*keys, "b.i", "j")
        taken = stored(by_i.join(by_j, [*keys, "i", "j"]), "taken_pairs")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        left = stored(left.join(taken.select(*keys, "i"), [*keys, "i"], "left_anti").join(taken.select(*keys, "j"), [*keys, "j"], "left_anti"), "candidates")
        before, n = n, left.count()
        if n > (1 - least_settled) * before:
            break

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used = None, (set(), set())
        for frame in frames:
            keep = []
            for row in frame.itertuples(index=False):
                own, i, j = tuple(row[: len(keys)]), row.i, row.j
                if own != group:
                    group, used = own, (set(), set())
                free = i not in used[0] and j not in used[1]
                if free:
                    used[0].add(i), used[1].add(j)
                keep.append(free)
            yield frame[keep][[*keys, "i", "j"]]

    if n:
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "i", "j"))
        rest = left.select(*keys, "k", "i", "j").repartition(*keys).sortWithinPartitions(*keys, "k", "i", "j").mapInPandas(choose, schema)
        chosen = rest if chosen is None else chosen.unionByName(rest)
    return candidates.select(*keys, "i", "j").limit(0) if chosen is None else chosen


def align(gold: DataFrame, pred: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """One-to-one pairs as by, doc_id, g_ord and p_ord: best score first, then gold order, then
    predicted order. No list is made of any document's rows."""
    pairs = candidate_pairs(gold, pred, by)
    one, two = (F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("value_max", "unit", "ent_norm", "ent_canon")]) for s in "gp")
    scored = pairs.select(*by, "doc_id", (-pair_score(one, two)).alias("k"), F.col("g_ord").cast("bigint").alias("i"), F.col("p_ord").cast("bigint").alias("j"))
    return mutual_best(scored, [*by, "doc_id"]).withColumnsRenamed({"i": "g_ord", "j": "p_ord"})


def aligned_fields(pairs: DataFrame, gold: DataFrame, pred: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """The pairs with both sides' fields (g_..., p_...)."""
    g, p = _side(gold, "g", ["doc_id"]), _side(pred, "p", [*by, "doc_id"])
    return pairs.join(p, [*by, "doc_id", "p_ord"]).join(g, ["doc_id", "g_ord"])


def fields_equal(name: str) -> Column:
    """Whether a pair agrees on a field: values within one percent, entities by name or term, else equal."""
    g, p = F.col(f"g_{name}"), F.col(f"p_{name}")
    if name in ("value", "value_max"):
        return values_match(g, p)
    if name == "target_entity":
        return same_entity(F.col("g_ent_norm"), F.col("p_ent_norm"), F.col("g_ent_canon"), F.col("p_ent_canon"))
    return g.eqNullSafe(p)


def complete() -> Column:
    out = F.lit(True)
    for name in TUPLE_FIELDS:
        out = out & fields_equal(name)
    return out


#: Systems (arms and seeds) that are laid out as literals.
MOST_LITERALS = 1000


def for_each_system(df: DataFrame, systems: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Every row once per system. A short list of systems is laid out as literals; a long one is joined to every row."""
    rows = systems.select(*by).distinct().limit(MOST_LITERALS + 1).collect()
    if len(rows) > MOST_LITERALS:
        return systems.select(*by).distinct().crossJoin(df)
    cells = [F.struct(*[F.lit(r[c]).cast(systems.schema[c].dataType).alias(c) for c in by]) for r in sorted(rows, key=str)]
    if not cells:
        return df.limit(0).select(*[F.lit(None).cast(systems.schema[c].dataType).alias(c) for c in by], "*")
    return df.withColumn("_system", F.explode(F.array(*cells))).select("_system.*", *df.columns)


def _aligned_lists(docs: DataFrame, gold: DataFrame, pred: DataFrame, systems: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Aligned rows of documents whose rows fit in a list: one exchange for each of the three inputs, none for those dealt out by doc_id already."""
    fields = lambda df: [c for c in OWN if c in df.columns]
    side = lambda df, more=(): F.sort_array(F.collect_list(F.struct(*fields(df), *more)))
    g = gold.groupBy("doc_id").agg(side(gold).alias("g"))
    p = pred.groupBy("doc_id").agg(side(pred, by).alias("p"))
    whole = for_each_system(docs.join(g, "doc_id", "left").join(p, "doc_id", "left"), systems, by)
    own = F.filter("p", lambda y: F.lit(True) if not by else _all(y[c].eqNullSafe(F.col(c)) for c in by))
    lists = whole.select(*by, "doc_id", F.coalesce("g", F.array().cast(g.schema["g"].dataType)).alias("g"), F.coalesce(own, F.array().cast(p.schema["p"].dataType)).alias("p"))
    match = lambda a, i: F.transform("p", lambda b, j: F.when(values_match(a["value"], b["value"]), F.struct((-pair_score(a, b)).alias("k"), i.alias("i"), j.alias("j"))))
    near = F.array_compact(F.flatten(F.transform("g", match)))
    chosen = lists.withColumn("c", F.sort_array(near)).withColumn("c", _greedy(F.col("c")))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType.elementType)
    row = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("g"), y.alias("p"))
    lone = lambda side, name: F.filter(side, lambda x, n: ~F.exists("c", lambda c: c[name] == n))
    rows = F.concat(
        F.array(row("document", none(g, "g"), none(p, "p"))), F.transform("c", lambda c: row("pair", F.col("g")[c["i"]], F.col("p")[c["j"]])),
        F.transform(lone("g", "i"), lambda x: row("missed", x, none(p, "p"))), F.transform(lone("p", "j"), lambda y: row("invented", none(g, "g"), y)),
    )
    flat = chosen.select(*by, "doc_id", F.explode(rows).alias("r"))
    return flat.select(*by, "doc_id", "r.kind", *[F.col(f"r.g.{c}").alias(f"g_{c}") for c in fields(gold)], *[F.col(f"r.p.{c}").alias(f"p_{c}") for c in fields(pred)])


def _all(conditions: Iterator[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _aligned_rounds(docs: DataFrame, gold: DataFrame, pred: DataFrame, systems: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The same rows of documents of any size, by joins on the document and the row's order."""
    pairs = stored(align(gold, pred, by), "pairs")
    taken = lambda side: pairs.select(*by, "doc_id", F.col(f"{side}_ord").alias("ord"))
    parts = {
        "document": for_each_system(docs, systems, by), "pair": aligned_fields(pairs, gold, pred, by),
        "missed": _side(for_each_system(gold, systems, by).join(taken("g"), [*by, "doc_id", "ord"], "left_anti"), "g", [*by, "doc_id"]), "invented": _side(pred.join(taken("p"), [*by, "doc_id", "ord"], "left_anti"), "p", [*by, "doc_id"]),
    }
    out = None
    for kind, part in parts.items():
        rows = part.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def crowded_docs(gold: DataFrame, pred: DataFrame, most: int = MOST_IN_LIST, bounds: DataFrame | None = None) -> DataFrame:
    """Documents with more than ``most`` gold rows and predictions, by a count of both or by ``bounds``."""
    if bounds is None:
        bounds = gold.select("doc_id").unionAll(pred.select("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return stored(bounds.where(F.col("n") > most).select("doc_id"), "crowded")


def aligned_rows(gold_docs: DataFrame, gold: DataFrame, pred: DataFrame, systems: DataFrame, by: tuple[str, ...] = BY, most: int = MOST_IN_LIST, bounds: DataFrame | None = None, crowded: DataFrame | None = None) -> DataFrame:
    """Both sides aligned, for every system and gold document: by, doc_id, kind, g_... and p_...

    kind is 'document' (one row for each document and system, whether it has anything or not), 'pair'
    (both sides' fields), 'missed' (gold without a partner) or 'invented' (a prediction without one).
    Rows of other documents are ignored. A document's (doc_id, ord) is expected to be unique on
    each side. Documents with more than ``most`` gold rows and predictions are aligned by rounds, the
    others as lists. They are found by a count beforehand, or by ``bounds`` (doc_id, n: at
    least as many as both sides' rows), where a caller knows one that is cheaper than the inputs; ``crowded`` are those found already.
    Nothing is moved between counting and alignment of inputs that are dealt out by doc_id.
    """
    docs = gold_docs.select("doc_id").distinct()
    few, many = _by_size(docs, gold, pred, crowded_docs(gold, pred, most, bounds) if crowded is None else crowded)
    rows = _aligned_lists(*few, systems, by)
    return rows if many is None else rows.unionByName(_aligned_rounds(*many, systems, by).select(*rows.columns))


def of_kind(rows: DataFrame, kind: str, by: tuple[str, ...] = BY) -> DataFrame:
    """Aligned rows of a kind: pairs with both sides' fields, missed and invented rows with their own."""
    own = rows.where(F.col("kind") == kind).drop("kind")
    if kind == "pair":
        return own
    side = "g_" if kind == "missed" else "p_"
    return own.select(*by, "doc_id", *[F.col(c).alias(c[2:]) for c in own.columns if c.startswith(side)])


def doc_counts(rows: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Per system and gold document, from aligned rows: det_tp, det_fp, det_fn, tup_tp, tup_fp, tup_fn.

    A pair that isn't complete counts as both fp and fn of the tuples. Documents without gold or
    predictions are there with zeros.
    """
    n = lambda kind, more=None: F.sum(((F.col("kind") == kind) & (F.lit(True) if more is None else more)).cast("long"))
    c = rows.groupBy(*by, "doc_id").agg(n("pair").alias("tp"), n("pair", complete()).alias("tt"), n("missed").alias("fn"), n("invented").alias("fp"))
    return c.select(
        *by, "doc_id", F.col("tp").alias("det_tp"), F.col("fp").alias("det_fp"), F.col("fn").alias("det_fn"),
        F.col("tt").alias("tup_tp"), (F.col("tp") - F.col("tt") + F.col("fp")).alias("tup_fp"), (F.col("tp") - F.col("tt") + F.col("fn")).alias("tup_fn"),
    )


def _whole_documents(batches: Iterator[pa.RecordBatch], key: str = "doc_id") -> Iterator[pa.Table]:
    """Batches sorted by a key as tables in which no key's rows are cut; a key without a value is one too."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in (b for b in batches if b.num_rows):
        codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
        changes = np.flatnonzero(codes[1:] != codes[:-1])
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if held and (cut or batch.column(key)[0] != last):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
        last = batch.column(key)[-1]
    if held:
        yield pa.Table.from_batches(held)


def _numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal tuples numbered from 0, and a row of each number."""
    order, new = np.lexsort(keys[::-1]), np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    numbers = np.empty(len(order), np.int64)
    numbers[order] = np.cumsum(new) - 1
    return numbers, order[new]


def _greedy_rows(left: np.ndarray, right: np.ndarray, k: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which candidates the greedy choice takes (ascending k, i, j), by the numbers of their two sides. Those without a rival need no order."""
    taken = (np.bincount(left)[left] == 1) & (np.bincount(right)[right] == 1)
    rest = np.flatnonzero(~taken)
    rest = rest[np.lexsort((j[rest], i[rest], k[rest]))]
    used: tuple[set, set] = (set(), set())
    for n, a, b in zip(rest.tolist(), left[rest].tolist(), right[rest].tolist()):
        if a not in used[0] and b not in used[1]:
            used[0].add(a), used[1].add(b)
            taken[n] = True
    return taken


def _chosen(t: pa.Table, n_systems: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Of whole documents' candidates: each document's first row, the rows' systems, the rows of the pairs, and the counts by document and system."""
    code, i, j = (t.column(c).to_numpy() for c in ("_code", "_i", "_j"))
    codes = t.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    doc = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(codes)]))
    n_gold, s, k, full = code[starts] >> 15, code >> 5 & 1023, -(code >> 3 & 3), code & 4 > 0
    size, of = len(starts) * n_systems, doc * n_systems + s
    pred, both = np.flatnonzero(code & 1), np.flatnonzero(code & 2)
    right = np.zeros(len(doc), np.int64)
    right[pred], one = _numbered(of[pred], j[pred])
    pair = both[_greedy_rows(_numbered(of[both], i[both])[0], right[both], k[both], i[both], j[both])]
    tp, tt = np.bincount(of[pair], minlength=size), np.bincount(of[pair[full[pair]]], minlength=size)
    fn, fp = np.repeat(n_gold, n_systems) - tp, np.bincount(of[pred[one]], minlength=size) - tp
    return starts, s, pair, (tp, fp, fn, tt, tp - tt + fp, tp - tt + fn)


def _counts_of_documents(t: pa.Table, n_systems: int) -> pa.RecordBatch:
    """The counts of whole documents under every system, from the rows of ``aligned_counts``."""
    starts, _, _, counts = _chosen(t, n_systems)
    docs = t.column("doc_id").combine_chunks().take(pa.array(np.repeat(starts, n_systems)))
    return pa.RecordBatch.from_arrays([docs, pa.array(np.tile(np.arange(n_systems, dtype=np.int32), len(starts))), *[pa.array(c.astype(np.int64)) for c in counts]], ["doc_id", "_s", *COUNTS])


#: Classes of documents and of pairs that a task keeps before it passes them on.
MOST_CLASSES = 50_000


def _tallied(batches: Iterator[pa.RecordBatch], n_systems: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """From rows as in ``aligned_counts`` with their ``_cell``: how many documents have the same counts under all systems (the
    first of them as doc_id), and how many pairs of a system the same cell."""
    documents, first, pairs = Counter(), {}, Counter()

    def made() -> pa.RecordBatch:
        flat, n, m = np.frombuffer(b"".join(documents), np.int32), len(documents), len(pairs)
        counts = pa.ListArray.from_arrays(pa.array([*range(0, len(flat), 6 * n_systems), *[None] * m, len(flat)], pa.int32()), pa.array(flat))
        docs, systems = pa.array([*first.values(), *[None] * m], kind), pa.array([*[None] * n, *[s for s, _ in pairs]], pa.int32())
        return pa.RecordBatch.from_arrays([docs, counts, systems, pa.array([*[None] * n, *[c for _, c in pairs]], pa.string()), pa.array([*documents.values(), *pairs.values()], pa.int64())], ["doc_id", "_counts", "_s", "_cell", "_n"])

    for t in _whole_documents(batches):
        starts, s, pair, counts = _chosen(t, n_systems)
        vectors = np.stack(counts, axis=1).astype(np.int32).tobytes()
        width = 24 * n_systems
        keys = [vectors[k : k + width] for k in range(0, len(vectors), width)]
        documents.update(keys)
        for key, doc in zip(keys, t.column("doc_id").combine_chunks().take(pa.array(starts)).to_pylist()):
            first.setdefault(key, doc)
        cells = t.column("_cell").combine_chunks().take(pa.array(pair)).dictionary_encode()
        names = cells.dictionary.to_pylist()
        for key, n in zip(*(x.tolist() for x in np.unique(s[pair] * len(names) + cells.indices.to_numpy(), return_counts=True))):
            pairs[key // len(names), names[key % len(names)]] += n
        if len(documents) * n_systems + len(pairs) > MOST_CLASSES:
            yield made()
            documents.clear(), first.clear(), pairs.clear()
    if documents:
        yield made()


def aligned_counts(gold_docs: DataFrame, gold: DataFrame, pred: DataFrame, systems: DataFrame, by: tuple[str, ...] = BY, most: int = MOST_IN_LIST, bounds: DataFrame | None = None, small_parts: bool = False) -> DataFrame:
    """``doc_counts`` of ``aligned_rows``, where nothing else of the rows is wanted.

    Predictions are joined to the gold rows of their document whose values match, and scored there,
    those without any included; what tells the rows apart and the scores then go to numpy, which
    chooses among the candidates of many documents at once. Crowded documents are aligned by rounds. Inputs that are
    dealt out by doc_id move no row. With ``small_parts`` a task can hold its part of the documents and gold rows
    (not of the predictions), so predictions are looked up among them as they come, and only their numbers are
    sorted. A document's (doc_id, ord) is expected to be unique on each side.
    """
    listed = _listed(systems, by)
    if listed is None:
        return doc_counts(aligned_rows(gold_docs, gold, pred, systems, by, most, bounds), by)
    pred = pred.where(_number(listed).isNotNull())
    crowded = crowded_docs(gold, pred, most, bounds)
    few, many = _by_size(gold_docs.select("doc_id").distinct(), gold, pred, crowded)
    n, kind = len(listed), few[0].schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_documents(batches):
            yield _counts_of_documents(table, n)

    schema = f"doc_id {kind}, _s int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    counts = _numbers(*few, listed, small_parts).mapInArrow(count, schema).withColumn("_system", _system(listed)[F.col("_s")]).select("_system.*", "doc_id", *COUNTS)
    return counts if many is None else counts.unionByName(doc_counts(_aligned_rounds(*many, systems, by), by))


def _listed(systems: DataFrame, by: tuple[str, ...]) -> list[dict[str, Column]] | None:
    """The systems as literals, in order; None if there are none or too many of them."""
    cells = sorted(systems.select(*by).distinct().limit(MOST_LITERALS + 1).collect(), key=str)
    return [{c: F.lit(r[c]).cast(systems.schema[c].dataType) for c in by} for r in cells] if 0 < len(cells) <= MOST_LITERALS else None


def _number(listed: list[dict[str, Column]]) -> Column:
    """A row's system by its place in the list, null if it isn't listed."""
    return F.coalesce(*[F.when(_all(F.col(c).eqNullSafe(x) for c, x in r.items()), n) for n, r in enumerate(listed)])


def _system(listed: list[dict[str, Column]]) -> Column:
    return F.array(*[F.struct(*[x.alias(c) for c, x in r.items()]) for r in listed])


def _by_size(docs: DataFrame, gold: DataFrame, pred: DataFrame, crowded: DataFrame) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The three inputs of the documents that aren't crowded, and those of the crowded ones if there are any."""
    if crowded.isEmpty():
        return [docs, gold, pred], None
    asked = docs.join(crowded, "doc_id", "left_semi")
    return [x.join(crowded, "doc_id", "left_anti") for x in (docs, gold, pred)], [asked, gold.join(asked, "doc_id", "left_semi"), pred.join(asked, "doc_id", "left_semi")]


def _numbers(docs: DataFrame, gold: DataFrame, pred: DataFrame, listed: list[dict[str, Column]], small_parts: bool, cell: bool = False) -> DataFrame:
    """What numpy needs of every candidate, lone prediction and document without any, sorted by document; with ``cell`` also
    in which fields a candidate agrees, and its labels."""
    p = _side(pred.withColumn("_s", _number(listed)), "p", ["doc_id", "_s"])
    held = lambda df: df.hint("shuffle_hash") if small_parts else df
    g = held(_side(gold, "g", [F.col("doc_id").alias("_doc")]))
    scored = p.join(g, (F.col("doc_id") == F.col("_doc")) & values_match(F.col("g_value"), F.col("p_value")), "left")
    one, two = (F.struct(*[F.col(f"{x}_{c}").alias(c) for c in ("value_max", "unit", "ent_norm", "ent_canon")]) for x in "gp")
    pair, none = F.col("_doc").isNotNull(), F.lit(-(2**63))
    # rows go to Python field by field, so a number holds all but the orders, by its bits: 0 a prediction, 1 paired,
    # 2 complete, 3 and 4 the score's halves over 1, 5 to 14 the system (under MOST_LITERALS), from 15 on the gold rows
    halves = F.when(pair, ((pair_score(one, two) - 1) * 2).cast("long")).otherwise(0)
    flags = F.lit(1) + pair.cast("long") * 2 + (pair & complete()).cast("long") * 4 + halves * 8 + F.col("_s") * 32
    more = [F.when(pair, _cell()).alias("_cell")] if cell else []
    scored = scored.select("doc_id", flags.alias("_flags"), F.col("g_ord").cast("long").alias("_i"), F.col("p_ord").cast("long").alias("_j"), *more)
    sizes = held(gold.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")))
    code = F.coalesce("_n", F.lit(0)) * 32768 + F.coalesce("_flags", F.lit(0))
    rows = held(docs.join(sizes, "doc_id", "left")).join(scored, "doc_id", "left")
    return rows.select("doc_id", code.alias("_code"), F.coalesce("_i", none).alias("_i"), F.coalesce("_j", none).alias("_j"), *(["_cell"] if cell else [])).sortWithinPartitions("doc_id")


def _cell() -> Column:
    """A candidate's class as a text: the fields that agree, by their bits, then gold and predicted label of each categorical
    field with its length before it (n: none, =: as in gold)."""
    bits = sum((fields_equal(f).cast("int") * 2**k for k, f in enumerate(TUPLE_FIELDS)), F.lit(0))
    said = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("n"))
    labels = []
    for f in CATEGORICAL:
        g, p = (F.col(f"{x}_{f}").cast("string") for x in "gp")
        labels += [said(g), F.when(g.eqNullSafe(p), F.lit("=")).otherwise(said(p))]
    return F.concat(bits.cast("string"), F.lit(";"), *labels)


def _read_cell(cell: str) -> list:
    """The bits and labels of ``_cell``."""
    head, rest = cell.split(";", 1)
    out: list = [int(head)]
    while rest:
        if rest[0] in "n=":
            out.append(None if rest[0] == "n" else out[-1])
            rest = rest[1:]
        else:
            n, rest = rest.split(":", 1)
            out.append(rest[: int(n)])
            rest = rest[int(n) :]
    return out


#: The columns of a class of pairs.
PAIR_CLASS = (*[f"same_{f}" for f in TUPLE_FIELDS], *[f"{x}_{f}" for f in CATEGORICAL for x in "gp"])


def pair_classes(matched: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Pairs by the fields that agree and their labels: by, same_... of every field, g_... and p_... labels, n_pairs."""
    labels = [F.col(f"{x}_{f}").cast("string").alias(f"{x}_{f}") for f in CATEGORICAL for x in "gp"]
    return matched.select(*by, *[fields_equal(f).alias(f"same_{f}") for f in TUPLE_FIELDS], *labels).groupBy(*by, *PAIR_CLASS).agg(F.count(F.lit(1)).alias("n_pairs"))


def aligned_classes(gold_docs: DataFrame, gold: DataFrame, pred: DataFrame, systems: DataFrame, by: tuple[str, ...] = BY, most: int = MOST_IN_LIST, bounds: DataFrame | None = None, small_parts: bool = False, crowded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All that rates, scores, intervals, accuracies and agreement need of an alignment, from one pass over it and stored:

    classes of documents: ``doc_counts`` of documents with the same counts under every system (by, doc_id being the least of
    them, the counts, and n_docs, how many they are), and classes of pairs (``pair_classes``). As in ``aligned_counts``,
    numpy chooses among the candidates; a task adds equal documents and pairs up before it passes them on, so what is moved is
    the number of different ones.
    """
    listed = _listed(systems, by)
    if listed is None:
        rows = stored(aligned_rows(gold_docs, gold, pred, systems, by, most, bounds), "aligned")
        return classes_of_rows(rows, by)
    pred = pred.where(_number(listed).isNotNull())
    crowded = crowded_docs(gold, pred, most, bounds) if crowded is None else crowded
    few, many = _by_size(gold_docs.select("doc_id").distinct(), gold, pred, crowded)
    n, kind = len(listed), few[0].schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tallied(batches, n, arrow)

    made = _numbers(*few, listed, small_parts, True).mapInArrow(tally, f"doc_id {kind.simpleString()}, _counts array<int>, _s int, _cell string, _n bigint")
    tallies = stored(made.groupBy("_counts", "_s", "_cell").agg(F.min("doc_id").alias("doc_id"), F.sum("_n").alias("_n")), "tallies")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [_read_cell(c) for c in b.column(1).to_pylist()]
            labels = [pa.array([c[1 + k] for c in cells], pa.string()) for k in range(2 * len(CATEGORICAL))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c[0] for c in cells], pa.int32()), *labels, b.column(2)], ["_s", "_bits", *PAIR_CLASS[len(TUPLE_FIELDS) :], "n_pairs"])

    each = F.explode(F.array(*[F.struct(*[x.alias(c) for c, x in r.items()], *[F.col("_counts")[6 * s + k].cast("long").alias(c) for k, c in enumerate(COUNTS)]) for s, r in enumerate(listed)]))
    documents = tallies.where("_counts IS NOT NULL").select("doc_id", "_n", each.alias("_x")).select(*[f"_x.{c}" for c in by], "doc_id", *[f"_x.{c}" for c in COUNTS], F.col("_n").alias("n_docs"))
    cells = tallies.where("_cell IS NOT NULL").select("_s", "_cell", "_n").mapInArrow(read, "_s int, _bits int, " + ", ".join(f"{c} string" for c in PAIR_CLASS[len(TUPLE_FIELDS) :]) + ", n_pairs bigint")
    same = [(F.col("_bits").bitwiseAND(2**k) > 0).alias(f"same_{f}") for k, f in enumerate(TUPLE_FIELDS)]
    pairs = cells.withColumn("_system", _system(listed)[F.col("_s")]).select("_system.*", *same, *PAIR_CLASS[len(TUPLE_FIELDS) :], "n_pairs")
    if many is None:
        return documents, pairs
    more = classes_of_rows(_aligned_rounds(*many, systems, by), by)
    return documents.unionByName(more[0]), pairs.unionByName(more[1])


def classes_of_rows(rows: DataFrame, by: tuple[str, ...] = BY) -> tuple[DataFrame, DataFrame]:
    """``aligned_classes`` from aligned rows, each document a class of its own; both are stored."""
    return stored(doc_counts(rows, by).withColumn("n_docs", F.lit(1).cast("long")), "doc_counts"), stored(pair_classes(of_kind(rows, "pair", by), by), "pair_classes")


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and f1, 0 where undefined."""
    over = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = over(tp, tp + fp), over(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": over(2 * p * r, p + r)}


COUNTS = ("det_tp", "det_fp", "det_fn", "tup_tp", "tup_fp", "tup_fn")


def many(counts: DataFrame, column: str = "n_docs") -> Column:
    """How many documents (or pairs) a row stands for: one, unless it is a class of them."""
    return F.col(column) if column in counts.columns else F.lit(1)


def micro_prf(counts: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    total = counts.groupBy(*by).agg(*[F.sum(F.col(c) * many(counts)).alias(c) for c in COUNTS])
    return total.select(*by, *COUNTS, *[x.alias(f"{k}_{n}") for k in ("det", "tup") for n, x in prf(*[F.col(f"{k}_{c}") for c in ("tp", "fp", "fn")]).items()])


def field_accuracy(matched: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Per field: hits, total and share among the matched pairs or their classes, in one pass."""
    n, same = many(matched, "n_pairs"), lambda f: F.col(f"same_{f}") if f"same_{f}" in matched.columns else fields_equal(f)
    one = matched.groupBy(*by).agg(F.sum(n).alias("total"), *[F.sum(same(f).cast("long") * n).alias(f) for f in TUPLE_FIELDS])
    tall = one.select(*by, "total", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("hits")) for n in TUPLE_FIELDS])).alias("_cell"))
    return tall.select(*by, "_cell.field", "_cell.hits", "total", F.coalesce(F.try_divide("_cell.hits", "total"), F.lit(0.0)).alias("accuracy"))


def label_cells(matched: DataFrame, fields: tuple[str, ...] = CATEGORICAL, by: tuple[str, ...] = BY) -> DataFrame:
    """Counts of (field, gold label, predicted label) among the pairs or their classes, every field in one pass: by, field, g, p, n.

    As few rows as there are labels; confusion, macro F1 and kappa are made from them.
    """
    both = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"g_{f}").cast("string").alias("g"), F.col(f"p_{f}").cast("string").alias("p")) for f in fields]))
    return matched.select(*by, both.alias("_cell"), many(matched, "n_pairs").alias("_n")).groupBy(*by, "_cell.field", "_cell.g", "_cell.p").agg(F.sum("_n").alias("n"))


def confusion(cells: DataFrame, field: str, by: tuple[str, ...] = BY) -> DataFrame:
    """Counts of a field's gold and predicted labels, from ``label_cells``."""
    own = cells.where(F.col("field") == field)
    return own.groupBy(*by, F.col("g").alias("gold_label"), F.col("p").alias("pred_label")).agg(F.sum("n").alias("n"))


def macro_f1(cells: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Unweighted mean F1 over the labels seen on either side of the pairs, from ``label_cells``; null is a label."""
    same = F.col("g").eqNullSafe(F.col("p"))
    none, n = F.lit(0).cast("long"), F.col("n")
    sides = F.explode(F.array(F.struct(F.col("g").alias("label"), F.when(same, n).otherwise(none).alias("tp"), none.alias("fp"), F.when(same, none).otherwise(n).alias("fn")), F.struct(F.col("p").alias("label"), none.alias("tp"), F.when(same, none).otherwise(n).alias("fp"), none.alias("fn"))))
    labels = cells.select(*by, "field", sides.alias("s")).groupBy(*by, "field", "s.label").agg(F.sum("s.tp").alias("tp"), F.sum("s.fp").alias("fp"), F.sum("s.fn").alias("fn"))
    return labels.withColumn("f1", prf(F.col("tp"), F.col("fp"), F.col("fn"))["f1"]).groupBy(*by, "field").agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_labels"))


def confusion_with_absent(rows: DataFrame, field: str, by: tuple[str, ...] = ("arm",), absent: str = "absent") -> DataFrame:
    """Confusion counts of aligned rows, with (label, absent) for missed and (absent, label) for invented ones, and row shares."""
    label = lambda side, other: F.when(F.col("kind") == other, absent).otherwise(F.col(f"{side}_{field}"))
    n = rows.where("kind <> 'document'").groupBy(*by, label("g", "invented").alias("gold_label"), label("p", "missed").alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "gold_label")))


def hallucination_rate(pred: DataFrame, abstracts: DataFrame, by: tuple[str, ...] = BY, text: str = "abstract") -> DataFrame:
    """Share of predictions whose sentence isn't in the abstract; white space collapsed, not trimmed."""
    texts = abstracts.select("doc_id", collapse_ws(F.col(text)).alias("_t"))
    there = F.coalesce("_t", F.lit("")).contains(collapse_ws(F.col("sentence")))
    n = pred.join(texts, "doc_id", "left").groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.sum(F.coalesce(there, F.lit(False)).cast("long")).alias("grounded"))
    return n.withColumn("rate", F.lit(1.0) - F.coalesce(F.try_divide("grounded", "total"), F.lit(1.0)))


def doc_score() -> Column:
    """Mean of a document's detection and tuple F1; 1 if neither side has anything."""
    nothing = (F.col("det_tp") + F.col("det_fp") + F.col("det_fn")) == 0
    f1 = lambda k: prf(*[F.col(f"{k}_{c}") for c in ("tp", "fp", "fn")])["f1"]
    return F.when(nothing, 1.0).otherwise((f1("det") + f1("tup")) / 2)


def mean_score(counts: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Mean document score per system; over the seeds it is averaged again."""
    n = many(counts)
    per = counts.groupBy(*by).agg((F.sum(doc_score() * n) / F.sum(n)).alias("score"))
    return per.groupBy(by[0]).agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n_seeds")) if len(by) > 1 else per


def sum_seeds(counts: DataFrame) -> DataFrame:
    """Counts of documents (or classes of them) summed over an arm's seeds."""
    return counts.groupBy("arm", "doc_id").agg(*[F.sum(c).alias(c) for c in COUNTS], *([F.max("n_docs").alias("n_docs")] if "n_docs" in counts.columns else []))


def evaluate(gold_docs: DataFrame, gold: DataFrame, pred: DataFrame, systems: DataFrame, abstracts: DataFrame | None = None, by: tuple[str, ...] = BY, bounds: DataFrame | None = None, small_parts: bool = False) -> dict[str, DataFrame]:
    """The whole report by name: counts, prf, fields, macro_f1, scores, det_ci and tup_ci, and hallucination with abstracts.

    gold and pred come from ``prepared``. Every part is a grouping of the classes of documents and pairs, which one pass over
    the alignment makes (``aligned_classes``; its classes of documents are there as classes). The rows, the matched pairs and the counts of every document are worked
    out where they are read. ``bounds`` and ``small_parts`` are those of ``aligned_counts``.
    """
    from mensura.operators.stats import bootstrap_cis  # stats imports this module

    crowded = crowded_docs(gold, pred, bounds=bounds)
    classes, pairs = aligned_classes(gold_docs, gold, pred, systems, by, small_parts=small_parts, crowded=crowded)
    rows = aligned_rows(gold_docs, gold, pred, systems, by, crowded=crowded)
    cis = bootstrap_cis(classes, by)
    out = {"rows": rows, "matched": of_kind(rows, "pair", by), "counts": doc_counts(rows, by), "classes": classes, "prf": micro_prf(classes, by), "fields": field_accuracy(pairs, by), "macro_f1": macro_f1(label_cells(pairs, by=by), by), "scores": mean_score(classes, by), "det_ci": cis.where("kind = 'det'").drop("kind"), "tup_ci": cis.where("kind = 'tup'").drop("kind")}
    if abstracts is not None:
        held = lambda df: df.hint("shuffle_hash") if small_parts else df
        listed = F.broadcast(systems.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct())
        said = pred.select(*by, "doc_id", "sentence").join(listed, _all(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), "left_semi")
        out["hallucination"] = hallucination_rate(said.join(held(gold_docs.select("doc_id").distinct()), "doc_id", "left_semi"), held(abstracts), by)
    return out


def report_rows(parts: dict[str, DataFrame], keys: tuple[str, ...] = BY) -> DataFrame:
    """Parts of a report in one tall table: part, the keys as texts (null where a part has none),
    name and value.

    Every column of numbers is a value of its own; the texts that tell a part's rows apart (field,
    labels) come before the column's name, joined by a slash.
    """
    out = None
    for part, df in parts.items():
        texts = [c for c, t in df.dtypes if t == "string" and c not in keys]
        numbers = [c for c, t in df.dtypes if t in ("double", "bigint", "int") and c not in keys]
        values = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in numbers]))
        own = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in keys]
        name = F.concat_ws("/", *[F.coalesce(c, F.lit("none")) for c in texts], "_v.name")
        rows = df.withColumn("_v", values).select(F.lit(part).alias("part"), *own, name.alias("name"), F.col("_v.value").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- strict evaluator ----------------------------------------------------------------------


#: What the strict evaluation tells of a row.
STRICT = ("ord", "metric_type", "entity_type")


def strict_pairs(gold: DataFrame, pred: DataFrame, by: tuple[str, ...] = (), systems: DataFrame | None = None) -> DataFrame:
    """Every gold and predicted row (by, doc_id, g_ord, p_ord and both rows' labels), paired by exact numbers.

    A prediction takes the first free gold row with the same is_range, number and, for ranges,
    upper number. That is an equality, so the r-th prediction of a class takes its r-th gold row:
    ranks within classes and a grouping do what a loop would. Unreadable numbers match nothing.
    Inputs that are dealt out by doc_id move no row.
    ``by`` names columns of the predictions that tell systems apart; each is set against all gold
    rows. A system without any prediction counts only where ``systems`` lists it.
    """

    classes = ["_r", "_a", "_b", "_u"]

    def ranked(df: DataFrame, prefix: str, keys: tuple[str, ...]) -> DataFrame:
        is_range = F.coalesce(F.col("is_range"), F.lit(False))
        read = df.select(*keys, "doc_id", "ord", "metric_type", "entity_type", is_range.alias("_r"), first_number(F.col("value")).alias("_a"), first_number(F.col("value_max")).alias("_b"))
        able = F.col("_a").isNotNull() & (~F.col("_r") | F.col("_b").isNotNull())
        # an unreadable row gets a class of its own
        own = read.withColumns({"_u": F.when(~able, F.concat(F.lit(prefix), F.col("ord").cast("string"))), "_b": F.when(F.col("_r") | ~able, F.col("_b"))})
        return own.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", *keys, *classes).orderBy("ord")))

    def beside(df: DataFrame, prefix: str) -> DataFrame:
        other = {"g": "p", "p": "g"}[prefix]
        fields = [*[F.col(c).alias(f"{prefix}_{c}") for c in STRICT], *[F.lit(None).cast(df.schema[c].dataType).alias(f"{other}_{c}") for c in STRICT]]
        return df.select(*by, F.col("doc_id").alias("_doc"), *classes, "_n", *fields)  # under one new name on both sides, their partitioning is seen to be the same

    g, p = ranked(gold, "g", ()), ranked(pred, "p", by)
    if by:
        g = for_each_system(g, pred.select(*by).distinct() if systems is None else systems, by)
    # a gold row and a prediction of one class and rank lie side by side in one grouping: it needs no more than the documents together, where a join would deal all rows out anew
    both = beside(g, "g").unionByName(beside(p, "p"))
    fields = [f"{x}_{c}" for x in "gp" for c in STRICT]
    # rows are sorted by the document first: it tells most of them apart
    found = both.groupBy("_doc", *by, *classes, "_n").agg(*[F.first(c, ignorenulls=True).alias(c) for c in fields])
    return found.select(*by, F.col("_doc").alias("doc_id"), *fields)


def strict_eval(gold: DataFrame, pred: DataFrame, by: tuple[str, ...] = (), systems: DataFrame | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, and label accuracies among the matches, to four digits, for each system."""
    both = F.col("g_ord").isNotNull() & F.col("p_ord").isNotNull()
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    same = lambda f: both & F.col(f"g_{f}").eqNullSafe(F.col(f"p_{f}"))
    t = strict_pairs(gold, pred, by, systems).groupBy(*by).agg(n(both).alias("tp"), n(F.col("g_ord").isNull()).alias("fp"), n(F.col("p_ord").isNull()).alias("fn"), n(same("metric_type")).alias("m"), n(same("entity_type")).alias("e"))
    rates = prf(F.col("tp"), F.col("fp"), F.col("fn")) | {"metric_accuracy": F.coalesce(F.try_divide("m", "tp"), F.lit(0.0)), "entity_accuracy": F.coalesce(F.try_divide("e", "tp"), F.lit(0.0))}
    return t.select(*by, "tp", "fp", "fn", *[F.round(c, 4).alias(k) for k, c in rates.items()])


def strict_errors(gold: DataFrame, pred: DataFrame, by: tuple[str, ...] = (), systems: DataFrame | None = None) -> DataFrame:
    """One row per error: misclassified, false_positive or false_negative."""
    wrong = ~(F.col("g_metric_type").eqNullSafe(F.col("p_metric_type")) & F.col("g_entity_type").eqNullSafe(F.col("p_entity_type")))
    kind = F.when(F.col("g_ord").isNull(), "false_positive").when(F.col("p_ord").isNull(), "false_negative").when(wrong, "misclassified")
    return strict_pairs(gold, pred, by, systems).withColumn("error_type", kind).where("error_type IS NOT NULL")


# ---- critique ------------------------------------------------------------------------------

#: Which annotation rule a wrong field calls for; a wrong metric type calls for its own.
RULE_OF_FIELD = {"value_max": "range", "is_range": "range", "unit": "unit", "context_modifier": "context_modifier", "target_entity": "target_entity", "entity_type": "entity_type"}
#: What the rules say, in our words; a project with an annotation guide of its own passes its texts.
RULES = {
    "format": "reply with the JSON object alone",
    "list": "list every number with a known unit, also those that are about something else",
    "Invalid Candidate": "a number about something else is an Invalid Candidate, not left out",
    "Bulk Concentration": "Bulk Concentration is the content of a group as a whole",
    "Individual Entity Concentration": "Individual Entity Concentration is the content of one element, oxide or mineral",
    "Process Metric": "Process Metric is a result of a process, or a content in solution",
    "boundary": "a number without a known unit is not listed",
    "once": "list each value once, from the sentence that says most",
    "range": "a range is one entry with both ends; a single value has no upper end",
    "unit": "give the unit as it is written",
    "context_modifier": "take the modifier from the words beside the value",
    "target_entity": "name the entity as the text does",
    "entity_type": "choose the type by what the entity is",
    "anchor": "copy the sentence from the text, with the value in it",
}


def critique_report(rows: DataFrame, rejected: DataFrame | None = None, unusable: DataFrame | None = None, by: tuple[str, ...] = BY, rules: dict[str, str] = RULES) -> DataFrame:
    """Per document, from aligned rows: score, lines and the rules that apply (names, and their texts as advice), first seen first.

    The first line gives the score, both F1 and how many entries either side has. Then come why the
    reply could not be used (``unusable``: by, doc_id, error), what is missing, extra and wrong, and
    what was rejected (``rejected``: by, doc_id, ord, stage, reason). One grouping makes all of it; only
    the rejections and errors, which are other tables, are joined to it.
    """
    keys = [*by, "doc_id"]
    line = lambda section, ord_, text, rule: F.struct(F.lit(section).alias("section"), ord_.cast("long").alias("ord"), text.alias("text"), rule.alias("rules"))
    said = lambda side: describe_extraction({c: F.col(f"{side}_{c}") for c in ("value", "value_max", "unit", "target_entity", "metric_type", "context_modifier", "sentence")})
    one = lambda *c: F.array_compact(F.array(*c))
    missing = line(2, F.col("g_ord"), F.concat(F.lit("missing: "), said("g")), one(F.lit("list"), F.when(F.col("g_metric_type") == "Invalid Candidate", F.lit("Invalid Candidate"))))
    outside = F.when(~F.coalesce(F.col("p_unit").isin(*UNITS), F.lit(False)), F.lit("boundary"))
    extra = line(3, F.col("p_ord"), F.concat(F.lit("extra: "), said("p")), one(outside, F.lit("once")))
    wrong = []
    for k, name in enumerate(n for n in TUPLE_FIELDS if n != "value"):
        rule = F.col("g_metric_type") if name == "metric_type" else F.lit(RULE_OF_FIELD[name])
        text = F.concat(F.lit(f"wrong {name}: should be "), F.coalesce(F.col(f"g_{name}").cast("string"), F.lit("none")), F.lit(", got "), F.coalesce(F.col(f"p_{name}").cast("string"), F.lit("none")))
        wrong.append(F.when(~fields_equal(name), line(4, F.col("g_ord") * 10 + k, text, one(rule))))
    made = F.when(F.col("kind") == "missed", F.array(missing)).when(F.col("kind") == "invented", F.array(extra)).when(F.col("kind") == "pair", F.array_compact(F.array(*wrong)))
    n = lambda kind, more=None: F.sum(((F.col("kind") == kind) & (F.lit(True) if more is None else more)).cast("long"))
    told = rows.groupBy(*keys).agg(
        n("pair").alias("det_tp"), n("missed").alias("det_fn"), n("invented").alias("det_fp"), n("pair", complete()).alias("tup_tp"), F.flatten(F.collect_list(made)).alias("l"),
    ).withColumns({f"tup_{c}": F.col("det_tp") - F.col("tup_tp") + F.col(f"det_{c}") for c in ("fp", "fn")})
    lines = F.col("l")
    if unusable is not None:
        why = unusable.groupBy(*keys).agg(F.collect_list(line(1, F.lit(0), F.concat(F.lit("could not be used: "), F.col("error")), F.array(F.lit("format")))).alias("u"))
        told, lines = told.join(why, keys, "left"), F.concat(lines, F.coalesce("u", F.slice("l", 1, 0)))
    if rejected is not None:
        stages = rejected.groupBy(*keys, "stage").agg(F.count(F.lit(1)).alias("n"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "reason"))), lambda r: r["reason"]), 1, 3).alias("first"))
        why = F.when(F.col("stage") == "anchoring", F.concat(F.col("n").cast("string"), F.lit(" discarded: not in the abstract"))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" discarded by the schema: "), F.array_join("first", "; ")))
        rule = F.when(F.col("stage") == "anchoring", F.lit("anchor")).when(F.exists("first", lambda r: r.contains("unit")), F.lit("boundary"))
        each = stages.groupBy(*keys).agg(F.collect_list(line(5, F.when(F.col("stage") == "anchoring", 0).otherwise(1), why, one(rule))).alias("r"))
        told, lines = told.join(each, keys, "left"), F.concat(lines, F.coalesce("r", F.slice("l", 1, 0)))
    f1 = lambda k: prf(*[F.col(f"{k}_{c}") for c in ("tp", "fp", "fn")])["f1"]
    none = (F.col("det_tp") + F.col("det_fp") + F.col("det_fn")) == 0
    two = lambda x: F.format_string("%.2f", F.bround(F.when(none, 1.0).otherwise(x), 2))
    first = F.concat(
        F.lit("score "), two(doc_score()), F.lit(" (values "), two(f1("det")), F.lit(", whole entries "), two(f1("tup")), F.lit("); the reference has "), (F.col("det_tp") + F.col("det_fn")).cast("string"), F.lit(" entries, the reply "), (F.col("det_tp") + F.col("det_fp")).cast("string"),
    )
    texts = F.transform("l", lambda x: x["text"])
    right = F.when((doc_score() == 1.0) & ~F.exists("l", lambda x: x["section"] == 4), F.array(F.lit("all entries match the reference"))).otherwise(F.array().cast("array<string>"))
    names = F.array_distinct(F.flatten(F.transform("l", lambda x: x["rules"])))
    listed = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.lit(v))])
    report = told.withColumn("l", F.sort_array(lines)).select(*keys, doc_score().alias("score"), F.array_join(F.concat(F.array(first), texts, right), "\n").alias("lines"), names.alias("rules"))
    return report.withColumn("advice", F.transform("rules", lambda r: F.coalesce(listed[r], r)))
