"""Registered queries over the library's own operators, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions import lexicon as lx
from mensura.functions import replies as rp
from mensura.functions import text as tx
from mensura.operators import agreement as ag
from mensura.operators import batch as bt
from mensura.operators import evaluate as ev
from mensura.operators import optimise as op
from mensura.operators import sampling as sm
from mensura.operators import stats as st
from mensura.operators import vote as vt
from mensura.operators import works as wk
from mensura.plans.derive import ABSTRACTS, GOLD, LOG, PRED, SAMPLES, SYSTEMS, order_parts, sql
from mensura.schemas import CATEGORICAL, TUPLE_FIELDS, UNITS
from mensura.sources import tables as src
from mensura.sources.shared import new_folder, stored  # noqa: F401 (tests watch stored)
from mensura.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


# ---- evaluation ----------------------------------------------------------------------------


def _gold(s: SparkSession, d: str, parts: int = 0) -> DataFrame:
    return ev.prepared(sql(s, d, GOLD, parts))


def _pred(s: SparkSession, d: str, parts: int = 0) -> DataFrame:
    return ev.prepared(sql(s, d, PRED, parts))


def _docs(s: SparkSession, d: str, parts: int = 0) -> DataFrame:
    return sql(s, d, "SELECT o_orderkey AS doc_id FROM orders", parts)


#: A line is one gold row and at most two predictions of each of four systems.
_BOUNDS = "SELECT l_orderkey AS doc_id, count(*) * 9 AS n FROM lineitem GROUP BY l_orderkey"


def _sides(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Documents, gold and predictions, dealt out by order: their alignment moves the tables' rows alone."""
    n = order_parts(s, d)
    return {"gold_docs": _docs(s, d, n), "gold": _gold(s, d, n), "pred": _pred(s, d, n), "systems": sql(s, d, SYSTEMS), "bounds": sql(s, d, _BOUNDS)}


def _without_sentences(sides: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Only texts about the rows need them."""
    return sides | {k: sides[k].drop("sentence") for k in ("gold", "pred")}


def _rows(s: SparkSession, d: str, sentences: bool = False) -> DataFrame:
    sides = _sides(s, d)
    return ev.aligned_rows(**(sides if sentences else _without_sentences(sides)))


def _matched(s: SparkSession, d: str) -> DataFrame:
    return ev.of_kind(_rows(s, d), "pair")


def _counts(s: SparkSession, d: str) -> DataFrame:
    return ev.aligned_counts(**_without_sentences(_sides(s, d)), small_parts=True)


def _classes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return ev.aligned_classes(**_without_sentences(_sides(s, d)), small_parts=True)


_CLOSE = "(({0} IS NULL AND {1} IS NULL) OR coalesce(abs({0} - {1}) <= 0.01 * greatest(abs({0}), abs({1})), false))"
_NORM = "CASE WHEN regexp_replace(lower({0}), '[^a-z0-9]', '', 'g') LIKE '%s' AND length(regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')) > 2 THEN left(regexp_replace(lower({0}), '[^a-z0-9]', '', 'g'), -1) ELSE regexp_replace(lower({0}), '[^a-z0-9]', '', 'g') END"
_EQUAL = {f: f"g_{f} IS NOT DISTINCT FROM p_{f}" for f in TUPLE_FIELDS} | {f: _CLOSE.format(f"g_{f}", f"p_{f}") for f in ("value", "value_max")} | {"target_entity": "g_norm = p_norm"}
_COLUMNS = ", ".join(f"g.{f} AS g_{f}, p.{f} AS p_{f}" for f in TUPLE_FIELDS)
#: Candidates, the greedy choice as a recursive query, the matched pairs m and the counts per document c.
_ALIGNED = f"""
    WITH RECURSIVE g AS MATERIALIZED (SELECT *, {_NORM.format("target_entity")} AS norm FROM ({GOLD})), p AS MATERIALIZED (SELECT *, {_NORM.format("target_entity")} AS norm FROM ({PRED})),
    both_ AS MATERIALIZED (SELECT p.arm, p.seed, g.doc_id, g.ord AS g_ord, p.ord AS p_ord, g.norm AS g_norm, p.norm AS p_norm, {_COLUMNS} FROM g JOIN p ON g.doc_id = p.doc_id WHERE {_CLOSE.format("g.value", "p.value")}),
    cand AS (SELECT *, 1.0 + CASE WHEN {_EQUAL["value_max"]} THEN 0.5 ELSE 0 END + CASE WHEN {_EQUAL["unit"]} THEN 0.5 ELSE 0 END + CASE WHEN g_norm = p_norm THEN 0.5 ELSE 0 END AS s FROM both_),
    r AS (SELECT arm, seed, doc_id, list({{'k': -s, 'i': g_ord, 'j': p_ord}} ORDER BY -s, g_ord, p_ord) AS l, []::STRUCT(i BIGINT, j BIGINT)[] AS acc FROM cand GROUP BY arm, seed, doc_id
          UNION ALL SELECT arm, seed, doc_id, list_filter(l, lambda x: x.i <> l[1].i AND x.j <> l[1].j), list_append(acc, {{'i': l[1].i, 'j': l[1].j}}) FROM r WHERE len(l) > 0),
    pairs AS (SELECT arm, seed, doc_id, unnest(acc) AS u FROM r WHERE len(l) = 0),
    m AS MATERIALIZED (SELECT b.* FROM both_ b JOIN pairs q ON b.arm = q.arm AND b.seed = q.seed AND b.doc_id = q.doc_id AND b.g_ord = q.u.i AND b.p_ord = q.u.j),
    c AS MATERIALIZED (
        SELECT arm, seed, doc_id, tp AS det_tp, np - tp AS det_fp, ng - tp AS det_fn, tt AS tup_tp, np - tt AS tup_fp, ng - tt AS tup_fn FROM (
            SELECT s.arm, s.seed, o.o_orderkey AS doc_id, coalesce(mm.tp, 0) AS tp, coalesce(mm.tt, 0) AS tt, coalesce(gg.n, 0) AS ng, coalesce(pp.n, 0) AS np
            FROM orders o CROSS JOIN ({SYSTEMS}) s
            LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY 1) gg ON gg.doc_id = o.o_orderkey
            LEFT JOIN (SELECT arm, seed, doc_id, count(*) AS n FROM p GROUP BY 1, 2, 3) pp ON pp.arm = s.arm AND pp.seed = s.seed AND pp.doc_id = o.o_orderkey
            LEFT JOIN (SELECT arm, seed, doc_id, count(*) AS tp, count(*) FILTER (WHERE {" AND ".join(_EQUAL.values())}) AS tt FROM m GROUP BY 1, 2, 3) mm ON mm.arm = s.arm AND mm.seed = s.seed AND mm.doc_id = o.o_orderkey))
"""


def _prf_sql(k: str, tp: str = "{0}_tp", fp: str = "{0}_fp", fn: str = "{0}_fn") -> dict[str, str]:
    a, b, c = tp.format(k), fp.format(k), fn.format(k)
    p, r = f"(CASE WHEN {a} + {b} > 0 THEN CAST({a} AS DOUBLE) / ({a} + {b}) ELSE 0.0 END)", f"(CASE WHEN {a} + {c} > 0 THEN CAST({a} AS DOUBLE) / ({a} + {c}) ELSE 0.0 END)"
    return {"precision": p, "recall": r, "f1": f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"}


_RATES = ", ".join(f"round({x}, 6) AS {k}_{n}" for k in ("det", "tup") for n, x in _prf_sql(k).items())
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ev.COUNTS)
_SCORE = f"CASE WHEN det_tp + det_fp + det_fn = 0 THEN 1.0 ELSE ({_prf_sql('det')['f1']} + {_prf_sql('tup')['f1']}) / 2 END"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"{_ALIGNED} SELECT *, {_RATES} FROM (SELECT arm, seed, {_SUMS} FROM c GROUP BY arm, seed)")
def q_align_micro_prf(s, d):
    """Aligned micro precision, recall and F1 of every arm and seed."""
    return _rounded(ev.micro_prf(_counts(s, d)))


@query(f"{_ALIGNED} SELECT arm, seed, doc_id, g_ord, p_ord FROM m")
def q_align(s, d):
    """The matched pairs of every document; those of crowded ones alone take rounds of joins."""
    return _matched(s, d).select(*ev.BY, "doc_id", "g_ord", "p_ord")


@query(f"SELECT count(*) AS n, sum(g.doc_id * 31 + g.ord * 7 + p.ord * 3) AS checksum FROM ({GOLD}) g JOIN ({PRED}) p ON g.doc_id = p.doc_id WHERE {_CLOSE.format('g.value', 'p.value')}")
def q_candidate_pairs_blocked(s, d):
    pairs = ev.candidate_pairs(_gold(s, d), _pred(s, d), blocked=True)
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("doc_id") * 31 + F.col("g_ord") * 7 + F.col("p_ord") * 3).alias("checksum"))


@query(f"{_ALIGNED} SELECT * FROM c")
def q_doc_counts(s, d):
    return _counts(s, d)


@query(f"{_ALIGNED} SELECT arm, seed, field, hits, total, round(CAST(hits AS DOUBLE) / total, 6) AS accuracy FROM (" + " UNION ALL ".join(f"SELECT arm, seed, '{f}' AS field, count(*) FILTER (WHERE {x}) AS hits, count(*) AS total FROM m GROUP BY arm, seed" for f, x in _EQUAL.items()) + ")")
def q_field_accuracy(s, d):
    return _rounded(ev.field_accuracy(_matched(s, d)))


_LABELS = " UNION ALL ".join(f"SELECT arm, seed, '{f}' AS field, g_{f} AS g, p_{f} AS p FROM m" for f in CATEGORICAL)


@query(
    f"{_ALIGNED}, x AS ({_LABELS}), y AS (SELECT arm, seed, field, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ("
    "SELECT arm, seed, field, g AS label, CAST(g IS NOT DISTINCT FROM p AS INT) AS tp, 0 AS fp, CAST(g IS DISTINCT FROM p AS INT) AS fn FROM x "
    "UNION ALL SELECT arm, seed, field, p, 0, CAST(g IS DISTINCT FROM p AS INT), 0 FROM x) GROUP BY 1, 2, 3, 4) "
    f"SELECT arm, seed, field, round(avg({_prf_sql('', 'tp', 'fp', 'fn')['f1']}), 6) AS macro_f1, count(*) AS n_labels FROM y GROUP BY 1, 2, 3"
)
def q_macro_f1(s, d):
    return _rounded(ev.macro_f1(ev.label_cells(_matched(s, d))))


@query(f"{_ALIGNED} SELECT arm, seed, g_metric_type AS gold_label, p_metric_type AS pred_label, count(*) AS n FROM m GROUP BY ALL")
def q_confusion(s, d):
    return ev.confusion(ev.label_cells(_matched(s, d), ("metric_type",)), "metric_type")


@query(
    f"{_ALIGNED}, x AS (SELECT arm, g_metric_type AS gold_label, p_metric_type AS pred_label FROM m "
    f"UNION ALL SELECT s.arm, g.metric_type, 'absent' FROM g CROSS JOIN ({SYSTEMS}) s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.arm = s.arm AND m.seed = s.seed AND m.doc_id = g.doc_id AND m.g_ord = g.ord) "
    "UNION ALL SELECT p.arm, 'absent', p.metric_type FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.arm = p.arm AND m.seed = p.seed AND m.doc_id = p.doc_id AND m.p_ord = p.ord)) "
    "SELECT arm, gold_label, pred_label, n, round(n / sum(n) OVER (PARTITION BY arm, gold_label), 6) AS row_share FROM (SELECT arm, gold_label, pred_label, count(*) AS n FROM x GROUP BY ALL)"
)
def q_confusion_absent(s, d):
    return _rounded(ev.confusion_with_absent(_rows(s, d), "metric_type"))


@query(f"{_ALIGNED} SELECT arm, seed, doc_id, round({_SCORE}, 6) AS score FROM c")
def q_doc_score(s, d):
    return _rounded(_counts(s, d).select("arm", "seed", "doc_id", ev.doc_score().alias("score")))


@query(f"{_ALIGNED} SELECT arm, round(avg(score), 6) AS mean_score, count(*) AS n_seeds FROM (SELECT arm, seed, avg({_SCORE}) AS score FROM c GROUP BY 1, 2) GROUP BY 1")
def q_mean_score(s, d):
    return _rounded(ev.mean_score(_counts(s, d)))


@query(f"{_ALIGNED} SELECT arm, doc_id, {_SUMS} FROM c GROUP BY arm, doc_id")
def q_sum_seeds(s, d):
    return ev.sum_seeds(_counts(s, d))


@query(f"{_ALIGNED} SELECT arm, det_tp, det_fp, det_fn, count(*) AS n_docs FROM (SELECT arm, doc_id, {_SUMS} FROM c GROUP BY arm, doc_id) GROUP BY 1, 2, 3, 4")
def q_boot_groups(s, d):
    return st.count_groups(ev.sum_seeds(_counts(s, d)), ["det_tp", "det_fp", "det_fn"], ["arm"])


@query()
def q_bootstrap_ci(s, d):
    return st.bootstrap_ci(ev.sum_seeds(_counts(s, d)))


@query()
def q_permutation(s, d):
    return st.compare_arms(_counts(s, d), ["base", "tuned"])


@query(f"SELECT arm, seed, count(*) AS total, count(*) FILTER (WHERE sentence <> 'Not there.') AS grounded, round(1 - count(*) FILTER (WHERE sentence <> 'Not there.') / count(*), 6) AS rate FROM ({PRED}) GROUP BY 1, 2")
def q_hallucination(s, d):
    texts = sql(s, d, "SELECT l_orderkey AS doc_id, array_join(collect_list(concat('It had ', CAST(l_partkey AS STRING), '  parts.')), ' ') AS abstract FROM lineitem GROUP BY 1")
    return _rounded(ev.hallucination_rate(_pred(s, d), texts))


@query("SELECT n, po, pe, round((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT count(*) AS n, round(avg(CAST(quality = 1 - toxic AS INT)), 6) AS po, round(avg(quality) * avg(1 - toxic) + (1 - avg(quality)) * avg(toxic), 6) AS pe0, avg(quality) * avg(1 - toxic) + (1 - avg(quality)) * avg(toxic) AS pe FROM labels)".replace("po, pe, round", "po, round(pe, 6) AS pe, round").replace("round(avg(CAST(quality = 1 - toxic AS INT)), 6) AS po, ", "avg(CAST(quality = 1 - toxic AS INT)) AS po, ").replace("n, po,", "n, round(po, 6) AS po,"))
def q_kappa(s, d):
    return _rounded(ag.cohen_kappa(sql(s, d, "SELECT quality AS a, 1 - toxic AS b FROM labels"), "a", "b"))


def _divergences(s: SparkSession, d: str) -> DataFrame:
    return ag.divergences(_rows(s, d, True), ("arm",))


@query(f"{_ALIGNED} SELECT arm, {', '.join(f'count(*) FILTER (WHERE NOT ({x})) AS {f}' for f, x in _EQUAL.items())} FROM m GROUP BY arm")
def q_divergences(s, d):
    """Unequal fields per arm, counted from the divergence rows."""
    return _divergences(s, d).groupBy("arm").agg(*[F.count(F.when(F.col("field") == f, 1)).alias(f) for f in TUPLE_FIELDS])


@query(
    f"{_ALIGNED} " + " UNION ALL ".join(f"SELECT arm, 'DIFFERS' AS kind, '{f}' AS field, count(*) AS n FROM m WHERE NOT ({x}) GROUP BY arm" for f, x in _EQUAL.items())
    + f" UNION ALL SELECT s.arm, 'ONLY-FIRST', NULL, count(*) FROM g CROSS JOIN ({SYSTEMS}) s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.arm = s.arm AND m.seed = s.seed AND m.doc_id = g.doc_id AND m.g_ord = g.ord) GROUP BY s.arm "
    "UNION ALL SELECT p.arm, 'ONLY-SECOND', NULL, count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.arm = p.arm AND m.seed = p.seed AND m.doc_id = p.doc_id AND m.p_ord = p.ord) GROUP BY p.arm"
)
def q_divergence_kinds(s, d):
    """All divergence rows per arm, kind and field: unequal fields, missed gold rows and invented predictions."""
    return _divergences(s, d).groupBy("arm", "kind", "field").agg(F.count(F.lit(1)).alias("n"))


_STRICT_G = f"SELECT doc_id, ord, CAST(value AS STRING) AS value, CAST(value_max AS STRING) AS value_max, is_range, metric_type, entity_type FROM ({GOLD}) g"
_STRICT_P = f"SELECT doc_id, ord, concat('~', CAST(value AS STRING), ' ppm') AS value, CAST(value_max AS STRING) AS value_max, is_range, metric_type, entity_type, arm, seed FROM ({PRED}) q"
_STRICT = f"""
    WITH g AS (SELECT *, TRY_CAST(value AS DOUBLE) AS a, CASE WHEN is_range THEN TRY_CAST(value_max AS DOUBLE) END AS b FROM ({_STRICT_G})), p AS (SELECT *, TRY_CAST(regexp_extract(value, '[-+]?[0-9][0-9,.]*') AS DOUBLE) AS a, CASE WHEN is_range THEN TRY_CAST(value_max AS DOUBLE) END AS b FROM ({_STRICT_P})),
    x AS (SELECT coalesce(g.arm, p.arm) AS arm, coalesce(g.seed, p.seed) AS seed, g.metric_type AS gm, p.metric_type AS pm, g.entity_type AS ge, p.entity_type AS pe, g.ord AS g, p.ord AS p
          FROM (SELECT g.*, s.arm, s.seed, row_number() OVER (PARTITION BY s.arm, s.seed, doc_id, is_range, a, b ORDER BY ord) AS n FROM g CROSS JOIN ({SYSTEMS}) s) g
          FULL JOIN (SELECT *, row_number() OVER (PARTITION BY arm, seed, doc_id, is_range, a, b ORDER BY ord) AS n FROM p) p
          ON g.arm = p.arm AND g.seed = p.seed AND g.doc_id = p.doc_id AND g.is_range = p.is_range AND g.a = p.a AND g.b IS NOT DISTINCT FROM p.b AND g.n = p.n),
    t AS (SELECT arm, seed, count(*) FILTER (WHERE g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn, count(*) FILTER (WHERE gm = pm) AS m, count(*) FILTER (WHERE ge = pe) AS e FROM x GROUP BY arm, seed)
"""


def _strict_sides(s: SparkSession, d: str) -> tuple:
    """Both sides dealt out by order, and the systems, which needn't be looked for among the predictions."""
    n = order_parts(s, d)
    return sql(s, d, _STRICT_G, n), sql(s, d, _STRICT_P, n), ev.BY, sql(s, d, SYSTEMS)


@query(_STRICT + "SELECT arm, seed, tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(m / tp, 4) AS metric_accuracy, round(e / tp, 4) AS entity_accuracy FROM t")
def q_strict_eval(s, d):
    """The strict evaluation of every arm and seed over all documents; one-sided rows are those that PRED drops or invents."""
    return ev.strict_eval(*_strict_sides(s, d))


@query(_STRICT + "SELECT arm, seed, CASE WHEN g IS NULL THEN 'false_positive' WHEN p IS NULL THEN 'false_negative' ELSE 'misclassified' END AS error_type, count(*) AS n FROM x WHERE g IS NULL OR p IS NULL OR gm <> pm OR ge <> pe GROUP BY 1, 2, 3")
def q_strict_errors(s, d):
    return ev.strict_errors(*_strict_sides(s, d)).groupBy("arm", "seed", "error_type").agg(F.count(F.lit(1)).alias("n"))


def _critique(s: SparkSession, d: str) -> DataFrame:
    return ev.critique_report(_rows(s, d, True))


@query(f"{_ALIGNED} SELECT arm, seed, doc_id, round({_SCORE}, 6) AS score FROM c")
def q_critique(s, d):
    """The critique's scores; q_critique_report has its lines and rules too."""
    return _rounded(_critique(s, d).select("arm", "seed", "doc_id", "score"))


@query()
def q_critique_report(s, d):
    """The whole critique of every document; a test compares it with plain Python."""
    return _rounded(_critique(s, d))


_KNOWN_UNITS = ", ".join(f"'{u}'" for u in UNITS)
_LONE_G = f"SELECT s.arm, s.seed, g.* FROM g CROSS JOIN ({SYSTEMS}) s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.arm = s.arm AND m.seed = s.seed AND m.doc_id = g.doc_id AND m.g_ord = g.ord)"
_LONE_P = "SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.arm = p.arm AND m.seed = p.seed AND m.doc_id = p.doc_id AND m.p_ord = p.ord)"
_WRONG = " UNION ALL ".join(
    f"SELECT arm, seed, doc_id, 'wrong {f}' AS kind, {'g_metric_type' if f == 'metric_type' else repr(ev.RULE_OF_FIELD[f])} AS rule FROM m WHERE NOT ({x})" for f, x in _EQUAL.items() if f != "value"
)


@query(
    f"{_ALIGNED}, lone_g AS ({_LONE_G}), lone_p AS ({_LONE_P}), x AS (SELECT arm, seed, doc_id, 'missing' AS kind, 'list' AS rule FROM lone_g UNION ALL SELECT arm, seed, doc_id, NULL, 'Invalid Candidate' FROM lone_g WHERE metric_type = 'Invalid Candidate' "
    f"UNION ALL SELECT arm, seed, doc_id, 'extra', 'once' FROM lone_p UNION ALL SELECT arm, seed, doc_id, NULL, 'boundary' FROM lone_p WHERE unit IS NULL OR unit NOT IN ({_KNOWN_UNITS}) UNION ALL {_WRONG}) "
    "SELECT c.arm, c.seed, c.doc_id, count(kind) FILTER (WHERE kind = 'missing') AS n_missing, count(kind) FILTER (WHERE kind = 'extra') AS n_extra, count(kind) FILTER (WHERE kind LIKE 'wrong%') AS n_wrong, coalesce(array_to_string(list_sort(list(DISTINCT rule)), ';'), '') AS rules "
    "FROM c LEFT JOIN x ON x.arm = c.arm AND x.seed = c.seed AND x.doc_id = c.doc_id GROUP BY 1, 2, 3"
)
def q_critique_lines(s, d):
    """Of every document's critique the lines by kind, and its rules."""
    line = F.filter(F.split("lines", "\n"), lambda x: x.startswith("missing: ") | x.startswith("extra: ") | x.startswith("wrong "))
    many = lambda kind: F.size(F.filter(line, lambda x: x.startswith(kind))).cast("long")
    return _critique(s, d).select("arm", "seed", "doc_id", many("missing: ").alias("n_missing"), many("extra: ").alias("n_extra"), many("wrong ").alias("n_wrong"), F.array_join(F.array_sort("rules"), ";").alias("rules"))


_TEXTS = ("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS abstract FROM documents WHERE doc_id % 3 = 0", "SELECT doc_id, text AS abstract FROM documents WHERE doc_id % 2 = 0", "SELECT doc_id FROM documents")


@query(f"SELECT i.doc_id, CASE WHEN p.doc_id IS NOT NULL THEN 'primary' WHEN x.doc_id IS NOT NULL THEN 'extra' ELSE 'missing' END AS source, md5(CASE WHEN p.doc_id IS NOT NULL THEN p.abstract ELSE x.abstract END) AS digest FROM ({_TEXTS[2]}) i LEFT JOIN ({_TEXTS[0]}) p USING (doc_id) LEFT JOIN ({_TEXTS[1]}) x USING (doc_id)".replace("i.doc_id,", "doc_id,", 1).replace("CASE WHEN p.doc_id", "CASE WHEN p.abstract").replace("WHEN x.doc_id", "WHEN x.abstract"))
def q_lookup_texts(s, d):
    found = ev.lookup_texts(sql(s, d, _TEXTS[2]), sql(s, d, _TEXTS[0]), sql(s, d, _TEXTS[1]))
    return found.select("doc_id", "source", F.md5("abstract").alias("digest"))


# ---- works and text ------------------------------------------------------------------------


def _indexed(docs: DataFrame) -> DataFrame:
    """The inverted index of every document, words to their positions; that of a null text is empty. A few documents at a time are held."""
    kind = pa.map_(pa.string(), pa.list_(pa.int32()))

    def index(text: str | None) -> list[tuple[str, list[int]]]:
        out: dict[str, list[int]] = {}
        for i, word in enumerate(re.findall(r"[^\x20\x09-\x0D]+", text or "")):
            out.setdefault(word, []).append(i)
        return list(out.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 64) for k in range(0, b.num_rows, 64)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([index(t) for t in part.column(1).to_pylist()], kind)], ["doc_id", "index"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, index map<string, array<int>>")


_WORDS = r"coalesce(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), '')"


@query(f"SELECT doc_id, md5({_WORDS}) AS digest FROM documents")
def q_rebuild_abstract(s, d):
    """Inverted indexes of all documents, and their texts rebuilt; those of null texts are empty."""
    return _indexed(s.read.parquet(f"{d}/documents.parquet")).select("doc_id", F.md5(tx.rebuild_abstract(F.col("index"))).alias("digest"))


_OK = "abstract <> '' AND NOT regexp_matches(rtrim(abstract), '(\\.\\.\\.|…)$') AND NOT contains(lower(abstract), 'google scholar') AND len(regexp_extract_all(abstract, '(?:[A-Z]\\.\\s?){1,3}[A-Za-z\\-]+;')) < 4"


#: Abstracts with those of null texts null: DuckDB's concat skips nulls.
_NULLABLE = f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN abstract END AS abstract FROM ({ABSTRACTS.replace('FROM documents', ', text FROM documents')}) n"


@query(f"SELECT doc_id, CAST(coalesce({_OK}, false) AS INT) AS kept FROM ({_NULLABLE})")
def q_clean_abstract(s, d):
    return sql(s, d, _NULLABLE).select("doc_id", (wk.clean_abstract(F.col("abstract")) != "").cast("int").alias("kept"))


@query(f"SELECT count(*) AS n_total, count(*) FILTER (WHERE coalesce(abstract, '') = '') AS n_without_abstract FROM ({ABSTRACTS})")
def q_missing_abstracts(s, d):
    return wk.missing_abstract_summary(sql(s, d, ABSTRACTS))


_SIEVED = r"regexp_matches(abstract, '(?i)(?:^|[^0-9.,])(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+(?:\.[0-9]+)?)\s*(?:wt\s*%|%|ppm|g/t)\b') AND regexp_matches(abstract, '(?i)\b(?:TREO|REO|REE)\b')"


@query(f"SELECT doc_id FROM ({ABSTRACTS}) WHERE {_SIEVED}")
def q_sieve(s, d):
    return wk.sieve(sql(s, d, ABSTRACTS)).select("doc_id")


@query(f"SELECT *, round(n_candidates / n_abstracts, 6) AS share, n_abstracts - n_candidates AS calls_saved FROM (SELECT count(abstract) AS n_abstracts, count(*) FILTER (WHERE {_SIEVED}) AS n_candidates FROM ({ABSTRACTS}))")
def q_sieve_report(s, d):
    return _rounded(wk.sieve_report(sql(s, d, ABSTRACTS)))


_BOOLEAN = r"SELECT doc_id FROM documents WHERE (regexp_matches(text, '(?i)(?:^|[^\pL\pN_])the(?:$|[^\pL\pN_])') OR regexp_matches(text, '(?i)(?:^|[^\pL\pN_])de\s+la(?:$|[^\pL\pN_])')) AND NOT regexp_matches(text, '(?i)(?:^|[^\pL\pN_])und(?:$|[^\pL\pN_])')"


@query(_BOOLEAN)
def q_boolean_query(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.where(wk.boolean_query('(the OR "de la") AND NOT und', F.col("text"))).select("doc_id")


@query(_BOOLEAN)
def q_boolean_index(s, d):
    """The same query over the documents' inverted indexes; no text is rebuilt."""
    works = _indexed(s.read.parquet(f"{d}/documents.parquet"))
    return works.where(wk.boolean_query('(the OR "de la") AND NOT und', index=F.col("index"))).select("doc_id")


@query(f"SELECT doc_id, length(abstract) AS relevance FROM ({ABSTRACTS}) WHERE {_OK} ORDER BY length(abstract) DESC, doc_id LIMIT 50")
def q_top_relevant(s, d):
    works = sql(s, d, ABSTRACTS).withColumn("relevance", F.length("abstract"))
    return wk.top_relevant(works, 50, "relevance", "doc_id", wk.abstract_ok(F.col("abstract"))).select("doc_id", F.col("relevance").cast("bigint").alias("relevance"))


_UNITS = "SELECT l_orderkey AS k, l_linenumber AS n, CASE l_suppkey % 9 WHEN 0 THEN 'wt. %' WHEN 1 THEN 'WT%' WHEN 2 THEN 'µg/g' WHEN 3 THEN 'per mil' WHEN 4 THEN 'g / t' WHEN 5 THEN 'm' WHEN 6 THEN 'mM' WHEN 7 THEN 'mol/l' END AS unit FROM lineitem"


@query(f"SELECT u, count(*) AS n FROM (SELECT CASE unit WHEN 'wt. %' THEN 'wt%' WHEN 'WT%' THEN 'wt%' WHEN 'µg/g' THEN 'ug/g' WHEN 'per mil' THEN 'permil' WHEN 'g / t' THEN 'g/t' WHEN 'm' THEN 'M' WHEN 'mol/l' THEN 'mol/L' END AS u FROM ({_UNITS})) GROUP BY 1")
def q_units(s, d):
    return sql(s, d, _UNITS).select(tx.normalize_unit(F.col("unit")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT n, count(*) AS many FROM (SELECT {_NORM.format('p_name')} AS n FROM (SELECT p_name FROM part)) GROUP BY 1")
def q_entities(s, d):
    return s.read.parquet(f"{d}/part.parquet").select(tx.normalize_entity(F.col("p_name")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("many"))


@query("SELECT doc_id, TRY_CAST(replace(regexp_extract(text, '[-+]?[0-9][0-9,.]*'), ',', '') AS DOUBLE) AS number FROM documents")
def q_first_number(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.first_number(F.col("text")).alias("number"))


_BLOCKED = "SELECT conv_id, turn, concat('x <START> ', text, ' <END> y <START>  <END> <START>', role, '<END>') AS t FROM conversations"


@query("SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 1 ELSE 2 END AS n FROM (SELECT conv_id, turn, regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g') AS text FROM conversations)")
def q_blocks(s, d):
    return sql(s, d, _BLOCKED).select("conv_id", "turn", F.size(tx.extract_blocks(F.col("t"))).alias("n"))


@query(r"SELECT page_id, nullif(regexp_extract(regexp_replace(trim(url), '/+$', ''), '([^/]*)$', 1), '') AS id FROM pages")
def q_doc_id_from_url(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", tx.doc_id_from_url(F.col("url")).alias("id"))


_NAMED = "SELECT l_orderkey AS k, CASE l_partkey % 8 WHEN 0 THEN 'Nd' WHEN 1 THEN 'REE 2 O 3' WHEN 2 THEN 'rare-earth elements' WHEN 3 THEN 'red mud' WHEN 4 THEN 'monazitee' WHEN 5 THEN 'xyz' WHEN 6 THEN ' LREE ' END AS target_entity FROM lineitem"


@query(f"SELECT e, c AS ent_canon, t AS ent_type, count(*) AS n FROM (SELECT target_entity AS e, CASE target_entity WHEN 'Nd' THEN 'Nd' WHEN 'REE 2 O 3' THEN 'TREO' WHEN 'rare-earth elements' THEN 'REE' WHEN 'red mud' THEN 'red_mud' WHEN 'monazitee' THEN 'monazite' WHEN ' LREE ' THEN 'LREE' END AS c, CASE target_entity WHEN 'Nd' THEN 'element' WHEN 'REE 2 O 3' THEN 'oxide' WHEN 'rare-earth elements' THEN 'element_group' WHEN 'monazitee' THEN 'mineral' WHEN ' LREE ' THEN 'element_group' ELSE 'other' END AS t FROM ({_NAMED})) GROUP BY 1, 2, 3")
def q_resolve_entities(s, d):
    found = lx.resolve_entities(sql(s, d, _NAMED), lx.load_lexicon(s))
    return found.groupBy(F.col("target_entity").alias("e"), "ent_canon", "ent_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, CAST(doc_id % 10 IN (0, 1, 2) AND abstract IS NOT NULL AS INT) AS has FROM ({_NULLABLE})")
def q_has_term(s, d):
    pattern = lx.term_pattern([t for t in lx.default_terms() if t[1] in ("REE", "TREO")])
    return sql(s, d, _NULLABLE).select("doc_id", lx.has_term(F.col("abstract"), pattern).cast("int").alias("has"))


# ---- replies -------------------------------------------------------------------------------

_REPLIES = f"""
    SELECT doc_id, ord, h, to_json(named_struct('value', CASE WHEN h <> 1 THEN value END, 'value_max', CASE WHEN h = 2 THEN value - 3 WHEN h = 3 THEN value + 1 WHEN h = 1 THEN value + 2 END, 'is_range', h IN (1, 2, 4),
           'unit', CASE h WHEN 5 THEN 'furlong' WHEN 6 THEN 'g/L' ELSE 'ppm' END, 'sentence', CASE WHEN h = 7 THEN '' ELSE sentence END, 'metric_type', CASE h WHEN 8 THEN 'Bulk_Concentration' WHEN 9 THEN 'Invalid Candidate' ELSE 'Bulk Concentration' END,
           'target_entity', target_entity, 'entity_type', entity_type, 'context_modifier', CASE h WHEN 10 THEN 'roughly' ELSE 'none' END), map('ignoreNullFields', 'false')) AS raw
    FROM (SELECT *, (doc_id + ord * 5) % 12 AS h FROM ({GOLD}) g) x
"""


@query(f"SELECT h, CAST(h NOT IN (2, 3, 4, 5, 6, 7, 8, 10) AS INT) AS valid, count(*) AS n FROM (SELECT (doc_id + ord * 5) % 12 AS h FROM ({GOLD})) GROUP BY 1, 2")
def q_validate(s, d):
    return rp.validate_extractions(sql(s, d, _REPLIES)).groupBy("h", F.col("valid").cast("int").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


_ANCHORED = "SELECT l_orderkey AS k, l_quantity AS value, CASE l_linenumber % 3 WHEN 0 THEN concat('a b  ', CAST(CAST(l_quantity AS INT) AS STRING), ' ppm') WHEN 1 THEN 'a b none ppm' ELSE 'elsewhere' END AS sentence, concat('x a b ', CAST(CAST(l_quantity AS INT) AS STRING), ' ppm; a b none ppm. ') AS abstract, l_linenumber % 3 AS m FROM lineitem"


@query(f"SELECT CASE m WHEN 0 THEN NULL WHEN 1 THEN 'value not in the sentence' ELSE 'sentence not in the abstract' END AS anchor_reason, count(*) AS n FROM ({_ANCHORED}) GROUP BY 1")
def q_anchor(s, d):
    return rp.anchor_extractions(sql(s, d, _ANCHORED)).groupBy("anchor_reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE -1 END AS n FROM conversations")
def q_parse_reply(s, d):
    """Replies around the conversations' roles: fenced, bare list, quirk and junk; -1 is an error."""
    replies = sql(s, d, """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN concat('```json\n{"extractions":[{"value":1,"unit":"', role, '"},3]}\n```') WHEN 1 THEN 'Result: [{"value":1},{"value":2}]' WHEN 2 THEN 'Result: [{"value":1}]' WHEN 3 THEN '{"a":1} {"b":2}' END AS reply FROM conversations""")
    got = replies.withColumn("r", rp.parse_reply("reply"))
    return got.select("conv_id", "turn", F.when(F.col("r.error").isNull(), F.size(rp.extraction_list(F.col("r.items")))).otherwise(-1).alias("n"))


_ATTEMPTS = "SELECT conv_id AS doc_id, turn + 1 AS attempt, CASE WHEN (conv_id + turn * 3) % 4 = 0 THEN '[]' END AS items, CASE WHEN (conv_id + turn * 3) % 4 <> 0 THEN 'bad' END AS error, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'length' END AS finish_reason, 1000 AS max_tokens FROM (SELECT DISTINCT conv_id, turn FROM conversations)"


@query(
    f"WITH a AS ({_ATTEMPTS}), f AS (SELECT doc_id, min(attempt) FILTER (WHERE items IS NOT NULL AND finish_reason IS NULL) AS ok, max(attempt) AS last FROM a GROUP BY 1) "
    "SELECT a.doc_id, CASE WHEN ok IS NOT NULL THEN items END AS items, a.attempt AS attempts, CASE WHEN ok IS NULL THEN CASE WHEN finish_reason = 'length' THEN 'cut off at max_tokens=1000' ELSE error END END AS error, "
    "CASE WHEN ok IS NOT NULL THEN 'done' WHEN a.attempt >= 3 THEN 'stop' WHEN finish_reason = 'length' THEN 'raise_budget' ELSE 'ask_again' END AS action FROM a JOIN f ON a.doc_id = f.doc_id AND a.attempt = coalesce(f.ok, f.last)"
)
def q_resolve_attempts(s, d):
    return rp.next_action(rp.resolve_attempts(sql(s, d, _ATTEMPTS))).select("doc_id", "items", F.col("attempts").cast("bigint").alias("attempts"), "error", "action")


# ---- logs ----------------------------------------------------------------------------------


@query(f"SELECT i, seq, error, result FROM ({LOG}) QUALIFY row_number() OVER (PARTITION BY i ORDER BY error IS NULL DESC, seq DESC) = 1")
def q_compact_log(s, d):
    return bt.compact_log(sql(s, d, LOG))


@query("SELECT c_custkey AS i FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE NOT (event_type = 'error' OR event_id % 3 = 0))")
def q_pending(s, d):
    return bt.pending_items(sql(s, d, "SELECT c_custkey AS i FROM customer"), sql(s, d, LOG), "i", "success")


@query(
    f"WITH a AS (SELECT i, seq, CAST(error IS NOT NULL AS INT) AS f FROM ({LOG})), b AS (SELECT *, sum(1 - f) OVER (PARTITION BY i ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM a) "
    "SELECT i, seq, CASE WHEN f = 1 THEN CAST(sum(f) OVER (PARTITION BY i, g ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS run_length FROM b"
)
def q_fail_runs(s, d):
    return bt.consecutive_failures(sql(s, d, LOG), "seq", F.col("error").isNotNull(), by=["i"]).select("i", "seq", F.col("run_length").cast("bigint").alias("run_length"))


@query(
    f"WITH a AS (SELECT i, seq, CAST(error IS NOT NULL AS INT) AS f FROM ({LOG})), b AS (SELECT *, sum(1 - f) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM a) "
    "SELECT i, seq, CASE WHEN f = 1 THEN CAST(sum(f) OVER (PARTITION BY g ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS run_length FROM b"
)
def q_fail_runs_of_log(s, d):
    """Failures in a row over the whole log, taken as one run."""
    return bt.consecutive_failures(sql(s, d, LOG), "seq", F.col("error").isNotNull()).select("i", "seq", F.col("run_length").cast("bigint").alias("run_length"))


@query(f"SELECT i, seq, error, result FROM ({LOG}) WHERE i NOT IN (SELECT i FROM ({LOG}) WHERE error IS NULL AND seq % 100 IN (0, 2))")
def q_result_log(s, d):
    """Log lines of items that a bucketed log of two lines in a hundred has no success of; its second batch is written twice."""
    lines, path = sql(s, d, LOG), new_folder(s, "logs", "results")
    log = src.ResultLog(s, f"result_log_{path.rsplit('-', 1)[1]}", path, "i bigint, seq bigint, error string, result double", buckets=8)
    for batch, k in (("a", 0), ("b", 2), ("b", 2)):
        log.append(lines.where(F.col("seq") % 100 == k), batch)
    return log.pending(lines, "error").select("i", "seq", "error", "result")


_USED = "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, event_type = 'view' AS hit, CAST(floor(value) AS BIGINT) AS tin, event_id % 100 AS tout FROM events"


@query(f"SELECT day, count(*) FILTER (WHERE NOT hit) AS calls, count(*) FILTER (WHERE hit) AS cache_hits, CAST(coalesce(sum(tin), 0) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out FROM ({_USED}) GROUP BY 1")
def q_usage_daily(s, d):
    return bt.usage_summary(sql(s, d, _USED), ["day"], F.col("hit"), "tin", "tout")


@query("SELECT count(*) AS items, count(*) * 3 AS calls, CAST(sum(CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) + 200) * 3 AS BIGINT) AS input_tokens, count(*) * 3 * 1000 AS output_ceiling FROM documents")
def q_cost(s, d):
    return bt.estimate_cost(s.read.parquet(f"{d}/documents.parquet"), "text", 3, 200, 1000)


@query("SELECT count(*) FILTER (WHERE role = 'user') AS hits, count(*) FILTER (WHERE role <> 'user') AS misses FROM conversations")
def q_cache_lookup(s, d):
    """Requests keyed by SHA-256 against a cache that has the user turns."""
    key = tx.cache_key(F.lit("m"), F.lit(0.0), F.lit(100), F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.lit(0))
    requests = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", key.alias("cache_key"))
    cache = requests.select("cache_key", F.when(F.col("role") == "user", "text").otherwise(" ").alias("text"))
    hits, misses = bt.cache_lookup(requests, cache)
    return hits.agg(F.count(F.lit(1)).alias("hits")).crossJoin(misses.agg(F.count(F.lit(1)).alias("misses")))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'ValueError: seven' END AS error, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS n FROM documents")
def q_run_batch(s, d):
    """A user function on every document, with failures as rows."""

    def count(row: dict) -> dict:
        if row["doc_id"] % 7 == 0:
            raise ValueError("seven")
        return {"n": row["n_chars"]}

    return bt.run_batch(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars"), count, "n bigint")


@query("SELECT doc_id, arm, seed, seed * 100 AS run FROM documents CROSS JOIN (VALUES ('a'), ('b')) AS t(arm) CROSS JOIN (VALUES (0), (1), (2)) AS u(seed)")
def q_seed_fan_out(s, d):
    return bt.seed_fan_out(s.read.parquet(f"{d}/documents.parquet").select("doc_id"), ["a", "b"])


@query(f"SELECT i, seq, error, result FROM ({LOG}) QUALIFY row_number() OVER (PARTITION BY i ORDER BY seq DESC) = 1")
def q_last_wins(s, d):
    return src.last_wins(sql(s, d, LOG), "i", "seq")


_LINES = f"SELECT to_json(CASE WHEN doc_id % 2 = 0 THEN named_struct('id', 'x', 'resultado', named_struct('doc_id', CAST(doc_id AS STRING), 'extracoes', array(named_struct('value', value, 'unit', unit)))) END) AS a, to_json(named_struct('doc_id', CAST(doc_id AS STRING), 'extracoes', array(named_struct('value', value, 'unit', unit)))) AS b, doc_id % 11 AS m FROM ({GOLD}) g"


@query(f"SELECT CAST(doc_id AS STRING) AS doc_id, count(*) AS n, sum(value) AS total FROM ({GOLD}) WHERE doc_id % 11 <> 0 GROUP BY 1")
def q_read_results(s, d):
    """Result lines, wrapped and bare, some of them broken, read and flattened."""
    lines = sql(s, d, _LINES).select(F.when(F.col("m") == 0, "{broken").otherwise(F.coalesce("a", "b")).alias("value"))
    return src.flatten_results(src.parse_results(lines)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# ---- votes, search, samples ----------------------------------------------------------------

_VOTE_KEY = "doc_id, lower(trim(value)) AS v, lower(trim(value_max)) AS x, lower(trim(unit)) AS u, lower(trim(target_entity)) AS e"


@query(
    f"WITH a AS (SELECT *, {_VOTE_KEY.removeprefix('doc_id, ')} FROM ({SAMPLES})), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, sample, v, x, u, e ORDER BY ord) = 1), k AS (SELECT doc_id, count(DISTINCT sample) AS k FROM a GROUP BY 1), "
    "n AS (SELECT doc_id, v, x, u, e, metric_type, count(*) AS n, min(sample * 1000 + ord) AS f FROM b GROUP BY ALL), w AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, v, x, u, e ORDER BY n DESC, f) = 1), "
    "t AS (SELECT doc_id, v, x, u, e, count(*) AS votes, min(sample * 1000 + ord) AS f FROM b GROUP BY ALL) "
    "SELECT t.doc_id, t.votes, k.k, t.f // 1000 AS first_sample, t.f % 1000 AS first_ord, w.metric_type FROM t JOIN k USING (doc_id) JOIN w ON w.doc_id = t.doc_id AND w.v = t.v AND w.x IS NOT DISTINCT FROM t.x AND w.u IS NOT DISTINCT FROM t.u AND w.e = t.e WHERE t.votes >= (k.k + 1) // 2"
)
def q_vote(s, d):
    return vt.vote_extractions(sql(s, d, SAMPLES)).select("doc_id", "votes", "k", F.col("first_sample").cast("bigint").alias("first_sample"), "first_ord", "metric_type")


_SPLIT = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'val' ELSE 'test' END AS partition FROM orders"


@query("SELECT o_orderkey AS doc_id, 'validation' AS split FROM orders WHERE o_orderkey % 3 = 1")
def q_split(s, d):
    return sm.split_gold(sql(s, d, _SPLIT), "validation").select("doc_id", "split")


@query(f"SELECT metric_type, least(5, count(*)) AS sampled, count(*) AS available FROM ({GOLD}) GROUP BY 1")
def q_audit_composition(s, d):
    gold = sql(s, d, GOLD)
    return sm.audit_composition(gold, sm.stratified_audit_sample(gold))


@query()
def q_audit_sample(s, d):
    return sm.stratified_audit_sample(sql(s, d, GOLD))


@query()
def q_minibatch(s, d):
    return op.minibatch(_docs(s, d), 20, 42, 1)


_TRAJ = "SELECT o_custkey AS search, o_orderkey AS candidate, o_orderkey % 4 AS step, o_orderkey AS calls, o_totalprice AS val_score, CAST(o_orderkey % 13 AS DOUBLE) AS train_f1 FROM orders"


@query(f"SELECT search, candidate, greatest(max(val_score) OVER (PARTITION BY search ORDER BY calls ROWS UNBOUNDED PRECEDING), -1.0) AS best FROM ({_TRAJ})")
def q_best_so_far(s, d):
    return op.best_so_far(sql(s, d, _TRAJ), ["search"]).select("search", "candidate", "best")


@query(f"SELECT search, candidate, coalesce(sum(step) OVER (PARTITION BY search ORDER BY candidate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS calls_before FROM ({_TRAJ})")
def q_calls_so_far(s, d):
    return op.calls_so_far(sql(s, d, _TRAJ), ["search"], ["candidate"], "step").select("search", "candidate", "calls_before")


@query(f"SELECT search, candidate, greatest(max(val_score) OVER (ORDER BY calls ROWS UNBOUNDED PRECEDING), -1.0) AS best FROM ({_TRAJ})")
def q_best_of_all(s, d):
    """The best value so far over all searches, taken as one of any length."""
    return op.best_so_far(sql(s, d, _TRAJ)).select("search", "candidate", "best")


@query(f"SELECT search, candidate, coalesce(sum(step) OVER (ORDER BY candidate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS calls_before FROM ({_TRAJ})")
def q_calls_of_all(s, d):
    return op.calls_so_far(sql(s, d, _TRAJ), [], ["candidate"], "step").select("search", "candidate", "calls_before")


@query(f"SELECT search, step, candidate FROM ({_TRAJ}) QUALIFY row_number() OVER (PARTITION BY search, step ORDER BY train_f1 DESC, candidate) <= 3")
def q_beam_topk(s, d):
    return op.beam_topk(sql(s, d, _TRAJ), 3, ["search", "step"]).where("in_beam").select("search", "step", "candidate")


@query(f"SELECT search, candidate FROM ({_TRAJ}) QUALIFY row_number() OVER (PARTITION BY search ORDER BY val_score DESC, candidate) = 1")
def q_final_choice(s, d):
    return op.final_choice(sql(s, d, _TRAJ), ["search"]).select("search", "candidate")


@query("SELECT a.o_orderkey AS parent, b.o_orderkey AS child, a.o_totalprice AS parent_score, b.o_totalprice AS child_score FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey - 1 OR a.o_orderkey = b.o_orderkey - 5")
def q_lineage(s, d):
    return op.lineage_edges(sql(s, d, "SELECT o_orderkey AS index, array(o_orderkey - 1, o_orderkey - 5) AS parents, o_totalprice AS val_score FROM orders"))


@query("SELECT event_type AS error_type, event_id, count(*) OVER (PARTITION BY event_type) AS total FROM (SELECT * FROM events ORDER BY event_id LIMIT 12) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 2")
def q_errors_topn(s, d):
    """A report of the first twelve errors, two of each type."""
    return op.errors_by_type(sql(s, d, "SELECT event_type AS error_type, event_id FROM events"), "event_id", 12, 2)


@query("SELECT text, min(conv_id * 1000 + turn) AS seq FROM conversations GROUP BY 1")
def q_distinct_prompts(s, d):
    """Every prompt once; a null text counts as one prompt."""
    return op.distinct_prompts(sql(s, d, "SELECT text, conv_id * 1000 + turn AS seq FROM conversations"))


# ---- streams -------------------------------------------------------------------------------


def _streamed(s: SparkSession, d: str, table: str) -> DataFrame:
    return s.readStream.schema(s.read.parquet(f"{d}/{table}.parquet").schema).parquet(f"{d}/{table}.parquet*")


@query(f"SELECT i, seq, error, result FROM ({LOG}) QUALIFY row_number() OVER (PARTITION BY i ORDER BY error IS NULL DESC, seq DESC) = 1")
def q_stream_compact_log(s, d):
    log = _streamed(s, d, "events").selectExpr("user_id AS i", "event_id AS seq", "CASE WHEN event_type = 'error' OR event_id % 3 = 0 THEN 'failed' END AS error", "value AS result")
    return jobs.stored_result(jobs.stream_compact_log(log), "compacted_log", ["i"]).select("i", "seq", "error", "result")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS tokens FROM events GROUP BY 1, 2")
def q_stream_usage(s, d):
    used = _streamed(s, d, "events").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type", "event_id", "event_id % 100 AS tokens")
    return jobs.stored_result(jobs.stream_usage(used, "ts", "tokens", by=["event_type"], key="event_id"), "usage_by_hour", ["window_start", "event_type"])


# ---- further operators ---------------------------------------------------------------------

#: Of every seed the base arm is the first round and the tuned arm the second.
_ROUNDS = tuple(f"SELECT doc_id * 2 + seed AS doc_id, ord, value, value_max, is_range, unit, sentence, metric_type, target_entity, entity_type, context_modifier FROM ({PRED}) z WHERE arm = '{a}'" for a in ("base", "tuned"))
#: A line is at most two rows of either round.
_ROUND_BOUNDS = "SELECT l_orderkey * 2 + seed AS doc_id, n FROM (SELECT l_orderkey, count(*) * 4 AS n FROM lineitem GROUP BY l_orderkey) CROSS JOIN (VALUES (0), (1)) AS t(seed)"
_ROUND_DOCS = "SELECT o_orderkey * 2 + seed AS doc_id FROM orders CROSS JOIN (VALUES (0), (1)) AS t(seed)"


_ROUND_CTE = _ALIGNED.replace(f"({PRED})", "@second").replace(f"({GOLD})", f"({_ROUNDS[0]})").replace("@second", f"(SELECT 'second' AS arm, 0 AS seed, y.* FROM ({_ROUNDS[1]}) y)").replace("o.o_orderkey", "o.doc_id").replace(f"FROM orders o CROSS JOIN ({SYSTEMS})", f"FROM ({_ROUND_DOCS}) o CROSS JOIN (SELECT 'second' AS arm, 0 AS seed)")


def _line_rounds(arm: str) -> str:
    """One of _ROUNDS over ``round_lines``: lines laid out for both seeds and dealt out by document, so that nothing made of them is moved again."""
    gold = GOLD.replace("SELECT l_orderkey AS doc_id,", "SELECT l_orderkey AS doc_id, round_doc, round_seed,").replace("PARTITION BY l_orderkey", "PARTITION BY round_doc").replace("FROM lineitem", "FROM round_lines")
    pred = PRED.replace(GOLD, gold).replace("SELECT arm, seed, doc_id,", "SELECT arm, seed, round_doc,").replace("s.arm, s.seed,", "s.arm, g.round_seed AS seed,").replace("s.seed * 7", "g.round_seed * 7").replace(f"({SYSTEMS}) s", f"(SELECT '{arm}' AS arm) s")
    return f"SELECT round_doc AS doc_id, ord, value, value_max, is_range, unit, metric_type, target_entity, entity_type, context_modifier FROM ({pred}) z"


def _agreement(s: SparkSession, d: str) -> dict[str, DataFrame]:
    n = 2 * order_parts(s, d)
    lines = sql(s, d, "SELECT l.*, l_orderkey * 2 + round_seed AS round_doc, round_seed FROM lineitem l CROSS JOIN (VALUES (0), (1)) AS t(round_seed)")
    lines.repartition(n, "round_doc").createOrReplaceTempView("round_lines")
    first, second = (ev.prepared(s.sql(_line_rounds(arm))) for arm in ("base", "tuned"))
    docs = sql(s, d, _ROUND_DOCS).repartition(n, "doc_id")
    return ag.agreement(docs, first, docs, second, bounds=sql(s, d, _ROUND_BOUNDS), small_parts=True)


@query(f"{_ROUND_CTE} SELECT *, {_RATES} FROM (SELECT {_SUMS} FROM c)")
def q_agreement_prf(s, d):
    """Counts and rates of the second annotation round against the first, over all documents."""
    return _rounded(_agreement(s, d)["prf"].drop("round"))


@query(f"{_ROUND_CTE} SELECT field, hits, total, round(CAST(hits AS DOUBLE) / total, 6) AS accuracy FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (WHERE {x}) AS hits, count(*) AS total FROM m" for f, x in _EQUAL.items()) + ")")
def q_agreement_fields(s, d):
    """Agreement per field of two annotation rounds over all documents."""
    return _rounded(_agreement(s, d)["fields"].drop("round"))


_KAPPA_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS field, n, po, pe, CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM (SELECT (SELECT count(*) FROM m) AS n, (SELECT avg(CAST(g_{f} IS NOT DISTINCT FROM p_{f} AS INT)) FROM m) AS po, "
    f"(SELECT sum(a.n * b.n) FROM (SELECT g_{f} AS l, count(*) AS n FROM m GROUP BY 1) a JOIN (SELECT p_{f} AS l, count(*) AS n FROM m GROUP BY 1) b ON a.l IS NOT DISTINCT FROM b.l) / ((SELECT count(*) FROM m) * (SELECT count(*)::DOUBLE FROM m)) AS pe)"
    for f in CATEGORICAL
)


@query(f"{_ROUND_CTE} SELECT field, n, round(po, 6) AS po, round(pe, 6) AS pe, round(kappa, 6) AS kappa FROM ({_KAPPA_SQL})")
def q_agreement_kappa(s, d):
    return _rounded(_agreement(s, d)["kappa"].drop("round"))


@query(f"{_ALIGNED} SELECT arm, {', '.join(f'{c}' for c in ev.COUNTS)}, {_RATES} FROM (SELECT arm, {_SUMS} FROM c GROUP BY arm)")
def q_arm_summary(s, d):
    """Each arm's counts and rates pooled over its seeds."""
    return _rounded(st.summary_of_classes(*_classes(s, d))["pooled"])


@query(f"{_ALIGNED} SELECT arm, round(avg(score), 6) AS mean_score, count(*) AS n_seeds FROM (SELECT arm, seed, avg({_SCORE}) AS score FROM c GROUP BY 1, 2) GROUP BY 1")
def q_evaluate(s, d):
    """The scores of the whole report."""
    report = ev.evaluate(**_without_sentences(_sides(s, d)), small_parts=True)
    return _rounded(report["scores"])


def _tall(part: str, source: str, names: dict[str, str], arm: str = "arm", seed: str = "NULL", texts: str = "") -> str:
    """SQL of a report's part as ``evaluate.report_rows`` lays it out."""
    return " UNION ALL ".join(f"SELECT '{part}' AS part, {arm} AS arm, CAST({seed} AS VARCHAR) AS seed, {texts}'{n}' AS name, round(CAST({x} AS DOUBLE), 6) AS value FROM {source}" for n, x in names.items())


_PRF = {c: c for c in ev.COUNTS} | {f"{k}_{n}": x for k in ("det", "tup") for n, x in _prf_sql(k).items()}
_CELLS = " UNION ALL ".join(f"SELECT arm, seed, '{f}' AS field, CAST(g_{f} AS VARCHAR) AS a, CAST(p_{f} AS VARCHAR) AS b, count(*) AS n FROM m GROUP BY ALL" for f in CATEGORICAL)


def _kappa_of(name: str, by: str) -> str:
    """CTEs whose last, ``name``, has by, field, n, po, pe and kappa, from the cells."""
    on = " AND ".join(f"x.{c} = y.{c}" for c in (*by.split(", "), "field"))
    return f"""
        {name}_a AS (SELECT {by}, field, a AS l, sum(n) AS n FROM cells GROUP BY {by}, field, a), {name}_b AS (SELECT {by}, field, b AS l, sum(n) AS n FROM cells GROUP BY {by}, field, b),
        {name}_t AS (SELECT {by}, field, sum(n) AS n, coalesce(sum(n) FILTER (WHERE a IS NOT DISTINCT FROM b), 0)::DOUBLE / sum(n) AS po FROM cells GROUP BY {by}, field),
        {name}_c AS (SELECT {", ".join(f"x.{c}" for c in by.split(", "))}, x.field, sum(x.n::DOUBLE * y.n) AS xy FROM {name}_a x JOIN {name}_b y ON {on} AND x.l IS NOT DISTINCT FROM y.l GROUP BY ALL),
        {name} AS (SELECT x.*, xy / (n::DOUBLE * n) AS pe, CASE WHEN xy = n::DOUBLE * n THEN 1.0 ELSE (po - xy / (n::DOUBLE * n)) / (1 - xy / (n::DOUBLE * n)) END AS kappa FROM {name}_t x JOIN {name}_c y ON {on})"""


_KAPPA_NAMES = {n: n for n in ("n", "po", "pe", "kappa")}
_F1S = (
    f"x AS ({_LABELS}), y AS (SELECT arm, seed, field, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT arm, seed, field, g AS label, CAST(g IS NOT DISTINCT FROM p AS INT) AS tp, 0 AS fp, CAST(g IS DISTINCT FROM p AS INT) AS fn FROM x "
    f"UNION ALL SELECT arm, seed, field, p, 0, CAST(g IS DISTINCT FROM p AS INT), 0 FROM x) GROUP BY 1, 2, 3, 4), f1s AS (SELECT arm, seed, field, avg({_prf_sql('', 'tp', 'fp', 'fn')['f1']}) AS macro_f1, count(*) AS n_labels FROM y GROUP BY 1, 2, 3)"
)
_ACCURACY = " UNION ALL ".join(f"SELECT arm, seed, '{f}' AS field, count(*) FILTER (WHERE {x}) AS hits, count(*) AS total FROM m GROUP BY arm, seed" for f, x in _EQUAL.items())
_MEANS = f"(SELECT arm, avg(score) AS mean_score, count(*) AS n_seeds FROM (SELECT arm, seed, avg({_SCORE}) AS score FROM c GROUP BY 1, 2) GROUP BY 1)"
_GROUNDED = "(SELECT arm, seed, count(*) AS total, count(*) FILTER (WHERE sentence <> 'Not there.') AS grounded FROM p GROUP BY 1, 2)"
_SAID = "SELECT l_orderkey AS doc_id, array_join(collect_list(concat('It had ', CAST(l_partkey AS STRING), '  parts.')), ' ') AS abstract FROM lineitem GROUP BY 1"


@query(
    f"{_ALIGNED}, {_F1S}, acc AS ({_ACCURACY}), sums AS (SELECT arm, seed, {_SUMS} FROM c GROUP BY arm, seed) {_tall('prf', 'sums', _PRF, seed='seed')} UNION ALL {_tall('fields', 'acc', {'hits': 'hits', 'total': 'total', 'accuracy': 'hits / total'}, seed='seed', texts=chr(39) + chr(39) + ' || field || ' + chr(39) + '/' + chr(39) + ' || ')} "
    f"UNION ALL {_tall('macro_f1', 'f1s', {'macro_f1': 'macro_f1', 'n_labels': 'n_labels'}, seed='seed', texts='field || ' + chr(39) + '/' + chr(39) + ' || ')} UNION ALL {_tall('scores', _MEANS, {'mean_score': 'mean_score', 'n_seeds': 'n_seeds'})} "
    f"UNION ALL {_tall('hallucination', _GROUNDED, {'total': 'total', 'grounded': 'grounded', 'rate': '1 - grounded / total'}, seed='seed')}"
)
def q_evaluate_report(s, d):
    """The whole evaluation: rates, fields, macro F1, scores and sentences that aren't in the text (intervals: q_report_intervals)."""
    sides = _sides(s, d)
    report = ev.evaluate(**sides, abstracts=sql(s, d, _SAID, order_parts(s, d)), small_parts=True)
    return _rounded(ev.report_rows({k: report[k] for k in ("prf", "fields", "macro_f1", "scores", "hallucination")}))


@query(
    f"{_ALIGNED}, cells AS ({_CELLS}), {_kappa_of('k1', 'arm')}, {_kappa_of('k2', 'arm, seed')}, sums AS (SELECT arm, seed, {_SUMS} FROM c GROUP BY arm, seed), pooled AS (SELECT arm, {_SUMS} FROM c GROUP BY arm), "
    f"conf AS (SELECT arm, g_metric_type || '/' || p_metric_type AS labels, count(*) AS n FROM m GROUP BY ALL) "
    f"{_tall('per_seed', 'sums', _PRF, seed='seed')} UNION ALL {_tall('pooled', 'pooled', _PRF)} UNION ALL {_tall('scores', _MEANS, {'mean_score': 'mean_score', 'n_seeds': 'n_seeds'})} UNION ALL {_tall('confusion', 'conf', {'n': 'n'}, texts='labels || ' + chr(39) + '/' + chr(39) + ' || ')} "
    f"UNION ALL {_tall('kappa', 'k1', _KAPPA_NAMES, texts='field || ' + chr(39) + '/' + chr(39) + ' || ')} UNION ALL {_tall('kappa_per_seed', 'k2', _KAPPA_NAMES, seed='seed', texts='field || ' + chr(39) + '/' + chr(39) + ' || ')}"
)
def q_arm_report(s, d):
    """The whole summary of the arms: rates per seed and pooled, scores, confusion and kappa."""
    report = st.summary_of_classes(*_classes(s, d))
    return _rounded(ev.report_rows({k: report[k] for k in ("per_seed", "pooled", "scores", "confusion", "kappa", "kappa_per_seed")}))


@query()
def q_report_intervals(s, d):
    """Both reports' intervals, and the annotators' rates beside the arms'; a test compares them with plain Python."""
    report = st.summary_of_classes(*_classes(s, d), _agreement(s, d)["classes"])
    return ev.report_rows({k: report[k] for k in ("pooled", "det_ci", "tup_ci")})


@query(
    "SELECT conv_id, turn, role = 'user' AND trim(coalesce(text, '')) <> '' AS cached, CASE WHEN NOT (role = 'user' AND trim(coalesce(text, '')) <> '') AND length(coalesce(text, '')) > 200 THEN 'length' ELSE 'stop' END AS finish_reason, "
    "CAST(ceil(CASE WHEN role = 'user' AND trim(coalesce(text, '')) <> '' THEN length(text) ELSE least(200, length(coalesce(text, ''))) END / 4) AS BIGINT) AS tokens_out, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty reply' END AS error FROM conversations"
)
def q_reply_rows(s, d):
    """Replies of a deterministic provider to every turn, those of the user from the cache."""
    rows = sql(s, d, "SELECT conv_id, turn, role, text, concat(conv_id, '|', turn) AS cache_key FROM conversations")
    cache = rows.where("role = 'user'").select("cache_key", "text", F.lit("stop").alias("finish_reason"), *[F.ceil(F.length("text") / 4).cast("long").alias(c) for c in ("tokens_in", "tokens_out")])
    got = bt.obtain_replies(rows.withColumnRenamed("text", "said"), bt.echo_provider(50, "said"), cache)
    parts = F.split("cache_key", r"\|")
    return got.select(parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("turn"), "cached", "finish_reason", "tokens_out", "error")


@query(f"SELECT doc_id, length(abstract) AS n FROM ({ABSTRACTS}) WHERE {_SIEVED}")
def q_stream_extract(s, d):
    """New abstracts through the sieve and a user function, stopped and started again on its checkpoint."""

    def measure(row: dict) -> dict:
        return {"n": len(row["abstract"])}

    text = ABSTRACTS[ABSTRACTS.index("CASE") : ABSTRACTS.index("AS abstract")]
    base = new_folder(s, "streams", "extracted")
    for _ in range(2):  # the second start finds nothing new
        abstracts = _streamed(s, d, "documents").selectExpr("doc_id", f"{text} AS abstract")
        jobs.stream_extract(abstracts, measure, "n bigint", f"{base}/result", f"{base}/checkpoint").awaitTermination()
    return s.read.schema("doc_id bigint, n bigint, error string").parquet(f"{base}/result").select("doc_id", "n")


@query(f"SELECT CASE WHEN h IN (2, 3, 4, 5, 6, 7, 8, 10) THEN 'schema' ELSE 'none' END AS stage, count(*) AS n FROM (SELECT (doc_id + ord * 5) % 12 AS h FROM ({GOLD})) GROUP BY 1")
def q_rejections_by_stage(s, d):
    checked = rp.validate_extractions(sql(s, d, _REPLIES))
    return rp.rejections_by_stage(checked.withColumn("stage", F.when(F.col("valid"), "none").otherwise("schema")))


_MENTIONS = "SELECT l_orderkey AS k, l_linenumber AS n, CASE l_partkey % 4 WHEN 0 THEN 'Nd2O3 and red mud, not nd' WHEN 1 THEN 'ree of LREE: light rare earth' WHEN 2 THEN 'energy expenditure after leachings' ELSE '' END AS t FROM lineitem"


@query(f"SELECT terms, homonym, process, element, count(*) AS n FROM (SELECT CASE WHEN t LIKE 'Nd%' THEN 'Nd2O3;red mud' WHEN t LIKE 'ree%' THEN 'LREE;light rare earth' ELSE '' END AS terms, CAST(t LIKE 'energy%' AS INT) AS homonym, CAST(t LIKE 'energy%' AS INT) AS process, CAST(t LIKE 'Nd%' AS INT) AS element FROM ({_MENTIONS})) GROUP BY ALL")
def q_terms_in(s, d):
    t = F.col("t")
    flags = [x.cast("int").alias(n) for n, x in (("homonym", lx.homonym_flag(t)), ("process", lx.has_process(t)), ("element", wk.element_flag(t)))]
    return sql(s, d, _MENTIONS).select(F.array_join(lx.terms_in(t), ";").alias("terms"), *flags).groupBy("terms", "homonym", "process", "element").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, replace(concat(l_returnflag, '_', l_linestatus), '_', ' ') AS label, l_suppkey % 3 = 1 AS solution, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S+00:00') AS instant FROM lineitem")
def q_labels_and_instants(s, d):
    rows = sql(s, d, "SELECT *, concat(l_returnflag, '_', l_linestatus) AS raw, CASE l_suppkey % 3 WHEN 0 THEN 'ppm' WHEN 1 THEN 'g/L' END AS unit FROM lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tx.normalize_label(F.col("raw")).alias("label"), rp.is_solution(F.col("unit")).alias("solution"), tx.log_instant(F.col("l_shipdate")).alias("instant"))


@query("SELECT c_custkey AS i FROM customer WHERE c_custkey >= 100 AND c_custkey < 2100 AND c_custkey NOT IN (SELECT user_id FROM events)")
def q_slice_pending(s, d):
    """A slice of the items by index, then those of it that no log line names."""
    return bt.pending_items(bt.slice_items(sql(s, d, "SELECT c_custkey AS i FROM customer"), "i", 100, 2000), sql(s, d, LOG), "i")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_exclude_gold(s, d):
    return bt.exclude_gold(s.read.parquet(f"{d}/documents.parquet").select("doc_id"), s.read.parquet(f"{d}/labels.parquet"))


@query("SELECT conv_id, turn, CAST(coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '', false) AND turn % 3 <> 0 AS INT) AS usable FROM conversations")
def q_usable_reply(s, d):
    rows = sql(s, d, "SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'length' WHEN 1 THEN 'stop' END AS reason FROM conversations")
    return rows.select("conv_id", "turn", rp.usable_reply(F.col("text"), F.col("reason")).cast("int").alias("usable"))


_WORKS = """
    SELECT CAST(doc_id AS STRING) AS id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('Title ', CAST(doc_id AS STRING)) END AS title, 'Shown' AS display_name, 2000 AS publication_year, 'd' AS doi, 1 AS cited_by_count,
           named_struct('is_oa', doc_id % 2 = 0) AS open_access, map('one', array(0, 2), 'two', array(1)) AS abstract_inverted_index, array(named_struct('display_name', lang), named_struct('display_name', '')) AS keywords,
           array(named_struct('author', named_struct('display_name', 'A')), named_struct('author', named_struct('display_name', source))) AS authorships, named_struct('source', named_struct('display_name', 'J')) AS primary_location
    FROM documents
"""


_NO_JUNK = " AND ".join(f"NOT contains(lower(abstract), '{m}')" for m in wk.JUNK)


@query(
    f"SELECT * FROM (SELECT CAST(doc_id AS STRING) AS id_openalex, CASE WHEN doc_id % 3 = 0 THEN 'Shown' ELSE concat('Title ', doc_id) END AS titulo, concat('A, ', coalesce(source, '')) AS autores, 'J' AS revista, {_WORDS} AS abstract, coalesce(lang, '') AS palavras_chave_openalex "
    f"FROM documents WHERE doc_id % 2 = 0) WHERE {_OK} AND {_NO_JUNK}"
)
def q_flatten_works(s, d):
    """Works with the inverted indexes of the documents' own texts and with null authors and keywords."""
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs.drop("text").join(_indexed(docs), "doc_id").createOrReplaceTempView("indexed_works")
    works = s.sql(_WORKS.replace("map('one', array(0, 2), 'two', array(1))", "index").replace("FROM documents", "FROM indexed_works"))
    return wk.require_abstract(wk.flatten_works(wk.open_access_only(works))).select("id_openalex", "titulo", "autores", "revista", "abstract", "palavras_chave_openalex")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat(c_custkey, ' (no unit) | - | - | none | \"', left(c_name, 90), '\"') ELSE concat(c_custkey, '-', c_custkey + 1, ' ppm | Nd | - | none | \"', left(c_name, 90), '\"') END AS line FROM customer")
def q_describe(s, d):
    even = F.col("c_custkey") % 2 == 0
    rows = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_custkey").cast("double").alias("value"), F.when(~even, F.col("c_custkey") + 1).cast("double").alias("value_max"), F.when(~even, "ppm").alias("unit"), F.when(~even, "Nd").alias("target_entity"), F.lit(None).cast("string").alias("metric_type"), F.lit("none").alias("context_modifier"), F.col("c_name").alias("sentence"))
    return rows.select("c_custkey", tx.describe_extraction({c: F.col(c) for c in rows.columns[1:]}).alias("line"))
