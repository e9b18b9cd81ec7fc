"""Operators against literal fixtures and small plain-Python versions."""

import json
import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
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
from mensura.schemas import EXTRACTION
from mensura.sources import tables as src
from mensura.streaming import jobs

FIELDS = ", ".join(f"{n} {t}" for n, t in EXTRACTION.items())


def one(spark, values, column, kind="string"):
    """The results of a column function on values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def ext(doc, ord_, value, unit="%", entity="Nd", **more):
    row = {"value": value, "value_max": None, "is_range": False, "unit": unit, "sentence": "s", "metric_type": "Process Metric", "target_entity": entity, "entity_type": "element", "context_modifier": "none"} | more
    return (doc, ord_, *[row[n] for n in EXTRACTION])


def aligned(spark, gold, pred, docs, **how):
    """Aligned rows of literal extractions, predictions being of arm a and seed 0."""
    g = ev.prepared(spark.createDataFrame(gold, f"doc_id string, ord int, {FIELDS}"))
    p = ev.prepared(spark.createDataFrame([("a", 0, *r) for r in pred], f"arm string, seed int, doc_id string, ord int, {FIELDS}"))
    d, s = spark.createDataFrame([(x,) for x in docs], "doc_id string"), spark.createDataFrame([("a", 0)], "arm string, seed int")
    return g, p, ev.aligned_rows(d, g, p, s, **how)


def scored(spark, gold, pred, docs=("d",)):
    """Pairs and counts, the same from lists, from rounds and from the pairs alone."""
    results = []
    for most in (1000, 0):
        g, p, rows = aligned(spark, gold, pred, docs, most=most)
        pairs = {(r.doc_id, r.g_ord, r.p_ord) for r in ev.of_kind(rows, "pair").collect()}
        lone = {(kind, r.doc_id, r.ord) for kind in ("missed", "invented") for r in ev.of_kind(rows, kind).collect()}
        results.append((pairs, lone, {r.doc_id: r for r in ev.doc_counts(rows).withColumn("score", ev.doc_score()).collect()}))
    assert results[0] == results[1]
    assert {(r.doc_id, r.g_ord, r.p_ord) for r in ev.align(g, p).collect() if r.doc_id in docs} == results[0][0]
    return {x[1:] for x in results[0][0]}, results[0][2]


def test_numbers_units_entities(spark):
    assert one(spark, ["~1,000 ppm", "971 ppm", "20-30", "0,5", "1.2.3", "abc", None], tx.first_number) == [1000, 971, 20, 5, None, None, None]
    assert one(spark, ["wt. %", "WT%", "µg/g", "μg/g", "‰", "per mil", "ppt", "g / t", "m", "mM", "mol %", None], tx.normalize_unit) == ["wt%", "wt%", "ug/g", "ug/g", "permil", "permil", "permil", "g/t", "M", None, None, None]
    assert one(spark, ["REEs", "Foo-bars", "s", "as", "gas"], tx.normalize_entity) == ["ree", "foobar", "s", "as", "ga"]
    assert one(spark, ["60·9%", "− 3.5", "a  b "], lambda x: tx.collapse_ws(tx.normalize_numbers(x))) == ["60.9%", "-3.5", "a b "]
    assert one(spark, ["", "abcd", "abcde", None], tx.estimate_tokens) == [0, 1, 2, 0]
    assert one(spark, ["http://a/b/", "x/y", " ", None], tx.doc_id_from_url) == ["b", "y", None, None]
    assert one(spark, ["a <START> b\nc <END><START> <END>", ""], tx.extract_blocks) == [["b\nc"], []]


def test_value_spellings(spark):
    rows = [(32000.0, "32,000 ppm", True), (63.0, "63 %", True), (60.9, "60·9%", True), (-3.5, "− 3.5", True), (3.0, "13 ppm", True), (0.31, "0.3", False), (None, "any", True), (math.inf, "inf", False), (0.3, "0.3", True), (1e7, "10,000,000", True)]
    df = spark.createDataFrame(rows, "v double, s string, want boolean").withColumn("f", tx.number_spellings(F.col("v")))
    assert all(r.got == r.want for r in df.select("want", tx.value_appears(F.col("v"), F.col("f"), F.col("s")).alias("got")).collect())


def test_rebuild_abstract(spark):
    index = {"rare": [0, 4], "earth": [1, 5], "oxides": [2], "and": [3]}
    assert one(spark, [index, None, {}], tx.rebuild_abstract, "map<string, array<int>>") == ["rare earth oxides and rare earth", "", ""]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.text("abé,. ", max_size=30), min_size=1, max_size=8))
def test_rebuild_undoes_inversion(spark, texts):
    def invert(t):
        out = {}
        for i, w in enumerate(t.split()):
            out.setdefault(w, []).append(i)
        return out

    assert one(spark, [invert(t) for t in texts], tx.rebuild_abstract, "map<string, array<int>>") == [" ".join(t.split()) for t in texts]


def test_clean_abstract_and_sieve(spark):
    texts = ["Plain prose.", "", "cut off...", "cut off…  ", "See Google Scholar", "A. Bo;C. Du;E. F. Gu;H. Ik;", "A. Bo;C. Du;E. F. Gu;", None]
    assert one(spark, texts, wk.abstract_ok) == [True, False, False, False, False, False, True, False]
    abstracts = ["TREO of 971 ppm", "TREO of 0.3% in ore", "5%REO in clay", "TREO was high", "Salinity 165,000 ppm", "content of the rare earth elements, 12 g/t", None]
    # "5%REO": the property needs a boundary before REO, and % is one
    assert one(spark, abstracts, wk.sieve_flag) == [True, False, True, False, False, True, False]
    assert one(spark, abstracts, lambda x: wk.sieve_flag(x, False)) == [True, True, True, False, False, True, False]
    assert one(spark, ["Nd in ore", "and"], wk.element_flag) == [True, False]


def test_boolean_query(spark):
    texts = ["red mud and clay", "red clay", "mud", None]
    assert one(spark, texts, lambda x: wk.boolean_query('"red mud" OR (clay AND NOT mud)', x)) == [True, True, False, False]
    assert one(spark, texts, lambda x: wk.keyword_query(["red mud", "MUD"], x)) == [True, False, True, False]
    for bad in ("", "(a", "a OR", "AND a", "a )", '""'):
        with pytest.raises(ValueError):
            wk.boolean_query(bad, F.col("x"))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.lists(hs.sampled_from(["red", "Red", "mud", "red,mud", "(red", "mud)", "redmud", "x-red", "mud-y", "clay", "mud,", "_mud", "é", "red."]), max_size=7), min_size=1, max_size=9))
def test_queries_of_an_index_equal_those_of_its_text(spark, texts):
    rows = []
    for i, words in enumerate(texts):
        index = {}
        for k, w in enumerate(words):
            index.setdefault(w, []).append(k)
        rows.append((i, " ".join(words), index))
    df = spark.createDataFrame([*rows, (-1, None, None)], "i int, t string, x map<string, array<int>>")
    queries = ('"red mud"', "red", '"red mud clay" OR NOT mud', '(clay AND "mud red") OR é', '"mud clay"')
    cells = [c for q in queries for c in (wk.boolean_query(q, F.col("t")), wk.boolean_query(q, index=F.col("x")))]
    cells += [wk.keyword_query(["red mud", "clay"], F.col("t")), wk.keyword_query(["red mud", "clay"], index=F.col("x"))]
    for r in df.select("t", *[c.alias(f"c{k}") for k, c in enumerate(cells)]).collect():
        assert list(r[1::2]) == list(r[2::2]), r


def test_lexicon(spark):
    assert one(spark, ["La₂O₃ and ree, REE, Rees; x∑REE,", "Neodymium x-rare earths", None], lx.terms_in) == [["La₂O₃", "REE", "∑REE"], ["Neodymium", "rare earths"], None]
    assert one(spark, ["leachings", "bioleaching", None], lx.has_process) == [True, False, False]
    names = ["Nd2O3", "bastnasite", "LREE", "Nd", "red mud", "xyz", "monazitee", "REE 2 O 3", "rare-earth elements", None]
    got = lx.resolve_entities(spark.createDataFrame([(n,) for n in names], "target_entity string"), lx.load_lexicon(spark)).collect()
    assert {r.target_entity: (r.ent_canon, r.ent_type) for r in got} == {
        "Nd2O3": ("Nd2O3", "oxide"), "bastnasite": ("bastnasite", "mineral"), "LREE": ("LREE", "element_group"), "Nd": ("Nd", "element"), "red mud": ("red_mud", "other"), "xyz": (None, "other"),
        "monazitee": ("monazite", "mineral"), "REE 2 O 3": ("TREO", "oxide"), "rare-earth elements": ("REE", "element_group"), None: (None, "other"),
    }
    assert lx.indel_ratio("monazitee", "monazite") == pytest.approx(2 * 8 / 17 * 100)


def test_fuzzy_matching_runs_on_distinct_names_only(spark):
    from mensura.plans import catalog

    plan = catalog.q_resolve_entities(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    below = plan[plan.index("MapInPandas cut_names") :].split("\n")
    assert plan.count("MapInPandas cut_names") == 1 and any("HashAggregate" in x for x in below[1:4]), below[:4]  # the distinct names
    names = spark.createDataFrame([("monazitee",)] * 50 + [("xyz",), (None,), ("mon",)], "entity string")
    assert [tuple(r) for r in lx.fuzzy_lexicon(names, lx.load_lexicon(spark)).collect()] == [("monazitee", "monazite")]


def plain_ratio(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        row = [0, *_next_row(row, c, b)]
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def _next_row(row, c, b):
    left = 0
    for j, d in enumerate(b):
        left = row[j] + 1 if c == d else max(left, row[j + 1])
        yield left


def test_fuzzy_candidates_equal_all_pairs_with_a_large_lexicon(spark):
    """100,000 forms, the parts' and customers' names among them changed by a few letters."""
    parts = [r.p_name for r in spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_name").distinct().collect()]
    customers = [r.c_name for r in spark.read.parquet("/root/testdata/sf0.01/customer.parquet").select("c_name").distinct().limit(300).collect()]
    rng = random.Random(5)
    words = sorted({w for p in parts for w in p.lower().split()})
    forms = list(dict.fromkeys([p.lower() for p in parts[::3]] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice(["", "s", f" {rng.randint(1, 99_999)}", f" {rng.randint(1, 99_999)}"]) for _ in range(230_000)]))[:100_000]
    assert len(forms) == 100_000

    def spoilt(name):
        t = list(name)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t))
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "q"])
        return "".join(t) or "none"

    names = sorted({spoilt(n) for n in rng.sample(parts, 30) + rng.sample(forms, 25) + customers[:5]} | {"abc", "  red ", "ab"})
    lexicon = spark.createDataFrame(pd.DataFrame({"form": forms})).coalesce(1)
    got = {r.entity: r.form for r in lx.fuzzy_lexicon(spark.createDataFrame([(n,) for n in names], "entity string"), lexicon).collect()}
    want = {}
    for n in names:
        text = n.strip().lower()
        if len(text) >= 4:
            near = [(-lx.indel_ratio(text, f), k) for k, f in enumerate(forms) if 200 * min(len(text), len(f)) / (len(text) + len(f)) >= 90]
            if near and -min(near)[0] >= 90:
                want[n] = forms[min(near)[1]]
    assert got == want and len(want) > 20
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert lx.indel_ratio(a, b) == pytest.approx(plain_ratio(a, b))


def test_automaton_equals_the_pattern(spark):
    """Ten thousand forms on the documents, and odd letters with the lexicon itself."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng, forms = random.Random(9), {}
    words = [w for t in docs if t for w in t.split()]
    while len(forms) < 10_000:
        i = rng.randrange(len(words) - 3)
        form = " ".join(words[i : i + rng.randint(1, 3)])
        form = rng.choice([form, form.lower(), form.upper(), form[: rng.randint(1, len(form))], form[rng.randrange(len(form)) :]])
        if form.strip():
            forms.setdefault(form, rng.random() < 0.3)
    terms = [(f.lower(), f, "other", c, f) for f, c in forms.items()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs[:60])], "i int, t string")
    rows = df.select("i", lx.lexicon_terms(F.col("t"), terms).alias("fast"), lx.terms_in(F.col("t"), lx.term_pattern(terms)).alias("slow")).collect()
    assert all(r.fast == r.slow for r in rows) and sum(len(r.fast or []) for r in rows) > 1000
    odd = ["La₂O₃ and ree, REE, Rees; x∑REE,", "Neodymium x-rare earths", None, "", "REE+Y; REE + Y", "ΣREE ∑REO2", "ſcandium SCANDIA İscandia", "light Rare Earth elements_", "😀REE😀 Nd2", "bastnäsite BASTNÄSITE"]
    assert one(spark, odd, lambda x: lx.lexicon_terms(x, lx.default_terms())) == one(spark, odd, lx.terms_in)


REPLIES = [
    ('```json\n{"extracoes":[]}\n```', 0), ('Here: {"extractions":[{"value":1}]} done', 1), ('[{"value":1},{"value":2}]', 2), ('Result: [{"value":1},{"value":2}]', 2), ('Result: [{"value":1}]', 0),
    ('{"extracoes":[{"value":1},3,null]}', 1), ('{"a":1} {"b":2}', None), ("no json", None), ("5", None), (None, None), ("", None), ("```", None), ('"text"', None), ("[]", 0), ("[1, 2]", 0),
    ('[{"value":1}]', 1), ('See [1]: {"results":[{"a":1},{"b":2}]}', 2), ('{"extracoes":"none","data":[{"a":1}]}', 1), ('{"other":[{"a":1}]}', 0), ('```\n[{"a":1},{"b":2}]\n```\nDone.', 2), ('} {"data":[]} {', 0), ('{"data":[{"a":1}]', 1),
    ('{"data":[{"a":1}], "data":[{"a":1},{"b":2}]}', 2),
]


def test_parse_reply(spark):
    got = one(spark, [r for r, _ in REPLIES], rp.parse_reply)
    assert [None if r["error"] else len(json.loads(r["items"])) for r in got] == [n for _, n in REPLIES]
    assert one(spark, [r for r, _ in REPLIES], lambda x: F.size(rp.extraction_list(rp.parse_reply(x)["items"])))[:3] == [0, 1, 2]


def test_unreadable_replies_are_quoted(spark):
    (got,) = one(spark, ["```json\nsorry, " + "no " * 200], rp.parse_reply)
    assert got["items"] is None and got["error"] == f"no JSON object or list in the reply: {('sorry, ' + 'no ' * 200)[:160]!r}"


def test_a_reply_is_parsed_once(spark):
    from mensura.plans import catalog

    plan = catalog.q_validate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") + plan.count("get_json_object(") == 1, plan.count("from_json(")


def test_validation(spark):
    base = {"value": 5, "value_max": None, "is_range": False, "unit": "ppm", "sentence": " a  b ", "metric_type": "Bulk Concentration", "target_entity": "REE", "entity_type": "element", "context_modifier": "none"}
    cases = [
        ({}, True), ({"is_range": True}, False), ({"is_range": True, "value_max": 3}, False), ({"value_max": 9}, False), ({"value": None}, False), ({"unit": "g/L"}, False), ({"unit": "g/L", "metric_type": "Process Metric"}, True),
        ({"metric_type": "Invalid Candidate", "value": None}, True), ({"unit": "furlong"}, False), ({"metric_type": "Bulk_Concentration"}, False), ({"sentence": ...}, False), ({"value": ...}, False),
        ({"value": None, "value_max": 4, "is_range": True}, True), ({"entity_type": "odd"}, True), ({"context_modifier": "odd"}, False), ({"value": "7.5", "is_range": "false"}, True), ({"value": "many"}, False), ({"sentence": ""}, False), ({"extra": 1}, True),
    ]
    raws = [json.dumps({k: v for k, v in (base | c).items() if v is not ...}) for c, _ in cases]
    rows = rp.validate_extractions(spark.createDataFrame(list(enumerate(raws)), "i int, raw string")).orderBy("i").collect()
    assert [r.valid for r in rows] == [w for _, w in cases], [(r.i, r.reasons) for r in rows]
    assert rows[0].sentence == "a b" and rows[13].entity_type == "other" and rows[15].value == 7.5


def test_attempts(spark):
    rows = [("a", 1, None, "bad", None, 100), ("a", 2, "[1]", None, None, 100), ("a", 3, "[2]", None, None, 100), ("b", 1, None, "bad", "length", 16000), ("b", 2, "[3]", None, None, 16000), ("c", 1, None, "bad", "length", 9000), ("d", 1, None, "x", None, 5)]
    df = rp.next_action(rp.resolve_attempts(spark.createDataFrame(rows, "doc_id string, attempt int, items string, error string, finish_reason string, max_tokens int")))
    assert {r.doc_id: (r["items"], r.attempts, r.error, r.action, r.next_max_tokens) for r in df.collect()} == {
        "a": ("[1]", 2, None, "done", None), "b": (None, 1, "cut off at max_tokens=16000", "stop", None), "c": (None, 1, "cut off at max_tokens=9000", "raise_budget", 16000), "d": (None, 1, "x", "ask_again", 5),
    }


def test_alignment_fixtures(spark):
    assert scored(spark, [ext("d", 0, 100.0)], [ext("d", 0, 100.9)])[0] == {(0, 0)}
    assert scored(spark, [ext("d", 0, 100.0)], [ext("d", 0, 101.2)])[0] == set()
    assert scored(spark, [ext("d", 0, 5.0)], [ext("d", 0, 5.0, entity="Pr"), ext("d", 1, 5.0)])[0] == {(0, 1)}
    assert scored(spark, [ext("d", 0, 5.0), ext("d", 1, 5.0)], [ext("d", 0, 5.0)])[0] == {(0, 0)}
    assert scored(spark, [ext("d", 0, None)], [ext("d", 0, None)])[0] == {(0, 0)}
    pairs, counts = scored(spark, [ext("d", 0, 5.0)], [ext("d", 0, 5.0, "ppm"), ext("x", 0, 1.0)], ("d", "e"))
    assert pairs == {(0, 0)} and tuple(counts["d"][2 + i] for i in range(1, 7)) == (1, 0, 0, 0, 1, 1)
    assert counts["e"].score == 1.0 and counts["e"].det_tp == 0


def test_alignment_is_greedy_one_to_one(spark):
    rng = random.Random(4)
    gold = [ext(f"d{i % 6}", i, rng.choice([1.0, 1.005, 2.0, 100.0, 0.0, None, -1.0]), rng.choice("ab"), rng.choice(["Nd", "Pr"])) for i in range(40)]
    pred = [ext(f"d{i % 6}", i, rng.choice([1.0, 1.01, 2.0, 100.5, 0.0, None, -1.0]), rng.choice("ab"), rng.choice(["Nd", "Pr"])) for i in range(40)]
    want = set()
    close = lambda a, b: (a is None and b is None) or (a is not None and b is not None and abs(a - b) <= 0.01 * max(abs(a), abs(b)))
    for d in range(6):
        c = sorted((-(1.5 + 0.5 * (g[5] == p[5]) + 0.5 * (g[8] == p[8])), g[1], p[1]) for g in gold for p in pred if g[0] == p[0] == f"d{d}" and close(g[2], p[2]))
        used_g, used_p = set(), set()
        for _, i, j in c:
            if i not in used_g and j not in used_p:
                used_g.add(i), used_p.add(j), want.add((i, j))
    assert scored(spark, gold, pred, [f"d{i}" for i in range(6)])[0] == want
    g = ev.prepared(spark.createDataFrame(gold, f"doc_id string, ord int, {FIELDS}"))
    p = ev.prepared(spark.createDataFrame([("a", 0, *r) for r in pred], f"arm string, seed int, doc_id string, ord int, {FIELDS}"))
    keys = lambda df: sorted((r.doc_id, r.g_ord, r.p_ord) for r in df.collect())
    assert keys(ev.candidate_pairs(g, p)) == keys(ev.candidate_pairs(g, p, blocked=True))


def test_strict_eval(spark):
    schema = "doc_id string, ord int, value string, value_max string, is_range boolean, metric_type string, entity_type string"
    gold = [("a", 0, "971 ppm", None, False, "x", "e"), ("a", 1, "~1,000", None, False, "x", "e"), ("a", 2, "5", "9", True, "x", "e"), ("a", 3, "none", None, False, "x", "e")]
    pred = [("a", 0, "972", None, False, "x", "e"), ("a", 1, "1000", None, False, "y", "e"), ("a", 2, "5", "9", False, "x", "e"), ("a", 3, "none", None, False, "x", "e"), ("b", 0, "1", None, False, "x", "e")]
    r = ev.strict_eval(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)).first()
    assert (r.tp, r.fp, r.fn, r.metric_accuracy, r.entity_accuracy) == (1, 4, 3, 0.0, 1.0)


def test_crowded_document_is_aligned_by_rounds(spark):
    """100,000 values in one document: the greedy choice without any list of a document's rows."""
    n, rng = 100_000, random.Random(7)
    values = [round(10 ** rng.uniform(0, 80), 3) for _ in range(n)]
    gold = [("d", i, v, rng.choice("ab"), rng.choice("xy")) for i, v in enumerate(values)]
    pred = [("d", i, v * rng.choice([1, 1.004, 0.993, 1.03]), rng.choice("ab"), rng.choice("xy")) for i, v in enumerate(rng.sample(values, n))]
    more = "CAST(NULL AS DOUBLE) AS value_max, false AS is_range, 's' AS sentence, 'm' AS metric_type, 'e' AS entity_type, 'none' AS context_modifier, ent AS target_entity"
    side = lambda rows: ev.prepared(spark.createDataFrame(pd.DataFrame(rows), "doc_id string, ord int, value double, unit string, ent string").selectExpr("doc_id", "ord", "value", "unit", *more.split(", ")))
    g, p = side(gold), side(pred).selectExpr("'a' AS arm", "0 AS seed", "*")
    rows = ev.aligned_rows(spark.createDataFrame([("d",)], "doc_id string"), g, p, spark.createDataFrame([("a", 0)], "arm string, seed int"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("collect_list") == 2 * plan.count("partial_collect_list") == 4  # of the other documents alone
    got = {(r.g_ord, r.p_ord) for r in ev.of_kind(rows, "pair").select("g_ord", "p_ord").collect()}
    order = sorted(range(n), key=lambda j: pred[j][2])
    sizes = [pred[j][2] for j in order]
    from bisect import bisect_left, bisect_right

    near = ((-(1.5 + 0.5 * (u == pred[j][3]) + 0.5 * (e == pred[j][4])), i, j) for _, i, v, u, e in gold for j in order[bisect_left(sizes, v * 0.98) : bisect_right(sizes, v * 1.02)] if abs(v - pred[j][2]) <= 0.01 * max(abs(v), abs(pred[j][2])))
    want, used_g, used_p = set(), set(), set()
    for _, i, j in sorted(near):
        if i not in used_g and j not in used_p:
            used_g.add(i), used_p.add(j), want.add((i, j))
    assert got == want and len(want) > n // 2
    counts = ev.doc_counts(rows).first()
    assert (counts.det_tp, counts.det_fn, counts.det_fp) == (len(want), n - len(want), n - len(want))


def test_chains_of_ties_end_in_one_pass(spark):
    """Ties make a pair the best of both sides one at a time; the choice is the greedy one all the same."""
    rows = [("d", -1.0, i, j) for i in range(60) for j in range(max(0, i - 2), min(60, i + 3))] + [("e", -float(i % 3), i, j) for i in range(9) for j in range(9)]
    df = spark.createDataFrame(rows, "doc_id string, k double, i bigint, j bigint")
    want = set()
    for d in "de":
        used_i, used_j = set(), set()
        for _, k, i, j in sorted(r for r in rows if r[0] == d):
            if i not in used_i and j not in used_j:
                used_i.add(i), used_j.add(j), want.add((d, i, j))
    for least in (0.05, 0.2, 1.0):
        assert {tuple(r) for r in ev.mutual_best(df, ["doc_id"], least).collect()} == want
    assert ev.mutual_best(df.limit(0), ["doc_id"]).count() == 0


def test_many_systems_are_joined(spark, monkeypatch):
    monkeypatch.setattr(ev, "MOST_LITERALS", 2)
    docs, systems = spark.range(3).toDF("doc_id"), spark.createDataFrame([(f"a{i}", i) for i in range(5)], "arm string, seed int")
    assert sorted(map(tuple, ev.for_each_system(docs, systems).collect())) == sorted((f"a{i}", i, k) for i in range(5) for k in range(3))


def test_reports_are_groupings_of_one_alignment(spark):
    """Scans and exchanges of the plans, once the alignment is stored."""
    from mensura.plans import catalog

    d = "/root/testdata/sf0.001"
    limits = {"q_arm_report": (8, 15), "q_evaluate_report": (8, 15), "q_permutation": (8, 8), "q_agreement_kappa": (4, 6), "q_divergence_kinds": (4, 6)}
    for name, (scans, exchanges) in limits.items():
        plan = catalog.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= scans and plan.count("Exchange hashpartitioning") <= exchanges, (name, plan.count("FileScan parquet"), plan.count("Exchange hashpartitioning"))


def test_critique(spark):
    _, _, rows = aligned(spark, [ext("d", 0, 5.0), ext("d", 1, 50.0)], [ext("d", 0, 5.0, "ppm"), ext("d", 1, 7.0, "kg")], ("d", "e"))
    rejected = spark.createDataFrame([("a", 0, "d", k, stage, why) for k, (stage, why) in enumerate([("schema", "unit: not recognised"), ("anchoring", "x"), ("schema", "value: missing"), ("schema", "3"), ("schema", "4")])], "arm string, seed int, doc_id string, ord int, stage string, reason string")
    unusable = spark.createDataFrame([("a", 0, "e", "no JSON")], "arm string, seed int, doc_id string, error string")
    got = {r.doc_id: r for r in ev.critique_report(rows, rejected, unusable).collect()}
    lines = got["d"].lines.split("\n")
    assert lines[0] == "score 0.25 (values 0.50, whole entries 0.00); the reference has 2 entries, the reply 2" and lines[1].startswith("missing: 50 % | Nd") and lines[2].startswith("extra: 7 kg")
    assert lines[3:] == ["wrong unit: should be %, got ppm", "1 discarded: not in the abstract", "4 discarded by the schema: unit: not recognised; value: missing; 3"]
    assert got["d"].rules == ["list", "boundary", "once", "unit", "anchor"] and got["d"].advice[3] == ev.RULES["unit"]
    assert got["e"].lines.split("\n") == ["score 1.00 (values 1.00, whole entries 1.00); the reference has 0 entries, the reply 0", "could not be used: no JSON", "all entries match the reference"]
    assert got["e"].rules == ["format"] and {r.doc_id: r.rules for r in ev.critique_report(rows).collect()}["e"] == []


def test_critique_of_every_document(spark):
    from mensura.plans import catalog
    from mensura.schemas import TUPLE_FIELDS, UNITS

    d = "/root/testdata/sf0.001"
    gold = {(r.doc_id, r.ord): r for r in catalog._gold(spark, d).collect()}
    pred = {(r.arm, r.seed, r.doc_id, r.ord): r for r in catalog._pred(spark, d).collect()}
    pairs = [(r.arm, r.seed, r.doc_id, r.g_ord, r.p_ord) for r in ev.align(catalog._gold(spark, d), catalog._pred(spark, d)).collect()]
    short = lambda v: "?" if v is None else f"{v:g}"
    near = lambda a, b: (a is None and b is None) or (a is not None and b is not None and abs(a - b) <= 0.01 * max(abs(a), abs(b)))

    def said(r):
        span = short(r.value) + ("" if r.value_max is None else f"-{short(r.value_max)}")
        return f'{span} {r.unit or "(no unit)"} | {r.target_entity or "-"} | {r.metric_type or "-"} | {r.context_modifier or "-"} | "{r.sentence[:90]}"'

    def shown(v):
        return "none" if v is None else str(v).lower() if isinstance(v, bool) else str(v)

    found = {}
    add = lambda key, *line: found.setdefault(key, []).append(line)
    taken_g, taken_p = {p[:4] for p in pairs}, {(*p[:3], p[4]) for p in pairs}
    for arm, seed in (("base", 0), ("base", 1), ("tuned", 0), ("tuned", 1)):
        for (doc, o), r in gold.items():
            if (arm, seed, doc, o) not in taken_g:
                add((arm, seed, doc), 1, o, "missing: " + said(r), ["list"] + ["Invalid Candidate"] * (r.metric_type == "Invalid Candidate"))
    for key, r in pred.items():
        if key not in taken_p:
            add(key[:3], 2, key[3], "extra: " + said(r), ["boundary"] * (r.unit not in UNITS) + ["once"])
    for arm, seed, doc, i, j in pairs:
        g, p = gold[doc, i], pred[arm, seed, doc, j]
        for k, f in enumerate(n for n in TUPLE_FIELDS if n != "value"):
            same = near(g[f], p[f]) if f == "value_max" else g.ent_norm == p.ent_norm if f == "target_entity" else g[f] == p[f]
            if not same:
                add((arm, seed, doc), 3, i * 10 + k, f"wrong {f}: should be {shown(g[f])}, got {shown(p[f])}", [g.metric_type if f == "metric_type" else ev.RULE_OF_FIELD[f]])
    sizes = Counter(k[0] for k in gold) + Counter(k[:3] for k in pred)
    rows = catalog.q_critique_report(spark, d).collect()
    assert len(rows) == 4 * spark.read.parquet(f"{d}/orders.parquet").count()
    for r in rows:
        lines = sorted(found.get((r.arm, r.seed, r.doc_id), []), key=lambda x: x[:2])
        first, *others = r.lines.split("\n")
        assert others == ([x[2] for x in lines] or ["all entries match the reference"]), r
        assert first.startswith(f"score {r.score:.2f} (") and first.endswith(f"the reference has {sizes[r.doc_id]} entries, the reply {sizes[r.arm, r.seed, r.doc_id]}"), r
        assert r.rules == list(dict.fromkeys(y for x in lines for y in x[3])), r


def test_divergences_of_all_three_kinds(spark):
    from mensura.plans import catalog

    g = ev.prepared(spark.createDataFrame([ext("d", 0, 5.0), ext("d", 1, 50.0), ext("e", 0, 1.0)], f"doc_id string, ord int, {FIELDS}"))
    p = ev.prepared(spark.createDataFrame([("a", 0, *ext("d", 0, 5.0, "ppm")), ("a", 0, *ext("d", 1, 7.0)), ("b", 0, *ext("e", 0, 1.0))], f"arm string, seed int, doc_id string, ord int, {FIELDS}"))
    s, d = spark.createDataFrame([("a", 0), ("b", 0)], "arm string, seed int"), spark.createDataFrame([("d",), ("e",)], "doc_id string")
    rows = ag.divergences(ev.aligned_rows(d, g, p, s), ("arm",)).collect()
    assert sorted((r.arm, r.kind, r.doc_id, r.ord, r.field or "") for r in rows) == [
        ("a", "DIFFERS", "d", 0, "unit"), ("a", "ONLY-FIRST", "d", 1, ""), ("a", "ONLY-FIRST", "e", 0, ""), ("a", "ONLY-SECOND", "d", 1, ""), ("b", "ONLY-FIRST", "d", 0, ""), ("b", "ONLY-FIRST", "d", 1, ""),
    ]
    assert [(r.first, r.second) for r in rows if r.kind == "ONLY-SECOND"] == [(None, '7 % | Nd | Process Metric | none | "s"')]
    kinds = catalog.q_divergence_kinds(spark, "/root/testdata/sf0.001").collect()
    assert {(r.arm, r.kind) for r in kinds} == {(a, k) for a in ("base", "tuned") for k in ("DIFFERS", "ONLY-FIRST", "ONLY-SECOND")}


def test_logs(spark):
    rows = [(1, 1, "E"), (1, 2, None), (1, 3, "E"), (2, 1, "E"), (2, 2, "E"), (3, 1, None), (3, 2, None)]
    log = spark.createDataFrame(rows, "i int, seq int, error string")
    best = bt.compact_log(log)
    assert {r.i: r.seq for r in best.collect()} == {1: 2, 2: 2, 3: 2}
    assert sorted(map(tuple, bt.compact_log(best).collect())) == sorted(map(tuple, best.collect()))
    items = spark.createDataFrame([(1,), (2,), (4,)], "i int")
    assert [r.i for r in bt.pending_items(items, log, "i").collect()] == [4]
    assert sorted(r.i for r in bt.pending_items(items, log, "i", "success").collect()) == [2, 4]
    flags = spark.createDataFrame(list(enumerate([1, 1, 0, 1, 1, 1, 1, 1], 1)), "seq int, f int")
    runs = bt.consecutive_failures(flags, "seq", F.col("f") == 1).orderBy("seq").collect()
    assert [r.run_length for r in runs] == [1, 2, 0, 1, 2, 3, 4, 5] and [r.seq for r in runs if r.abort] == [8]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_long_runs_pass_on_between_ranges(spark, parts):
    """Runs cut anywhere, ranges of failures only, several runs and one, against plain Python."""
    rng = random.Random(parts)
    rows = [(rng.choice("ab"), k, rng.random() < (0.97 if k % 90 < 60 else 0.3), rng.randrange(100)) for k in range(400)]
    df = spark.createDataFrame(rows, "run string, seq int, f boolean, v int").repartition(5)
    for by in ([], ["run"]):
        want, state = {}, {}
        for run, k, f, v in rows:
            length, best, spent = state.get(run if by else 0, (0, -1, 0))
            length = length + 1 if f else 0
            best = max(best, v)
            want[k] = (length, best, spent)
            state[run if by else 0] = (length, best, spent + v)
        got = bt.consecutive_failures(df, "seq", F.col("f"), by=by, long_runs=True, parts=parts)
        assert {r.seq: (r.run_length, r.abort) for r in got.collect()} == {k: (x[0], x[0] >= 5) for k, x in want.items()}
        assert {r.seq: r.best for r in op.best_so_far(df, by, "seq", "v", long=True, parts=parts).collect()} == {k: x[1] for k, x in want.items()}
        assert {r.seq: r.calls_before for r in op.calls_so_far(df, by, ["seq"], "v", long=True, parts=parts).collect()} == {k: x[2] for k, x in want.items()}
        assert got.columns == [*df.columns, "run_length", "abort"]
    assert bt.consecutive_failures(df.limit(0), "seq", F.col("f")).count() == 0
    plan = bt.consecutive_failures(df, "seq", F.col("f"))._jdf.queryExecution().executedPlan().toString()
    gathered = plan[plan.index("SinglePartition") :].split("\n")  # a row for each range, no others
    assert plan.count("SinglePartition") == 1 and "HashAggregate(keys=[_range" in gathered[1] + gathered[2], plan


def test_result_log_is_appended_once_and_not_shuffled(spark, tmp_path):
    path, schema = f"file://{tmp_path}/log", "i bigint, error string"
    log = src.ResultLog(spark, "own_log", path, schema, buckets=4)
    first, second = spark.createDataFrame([(1, None), (2, "E")], schema), spark.createDataFrame([(3, None)], schema)
    for batch, rows in (("a", first), ("b", second), ("a", first)):
        log.append(rows, batch)
    assert sorted((r.i, r.batch) for r in log.rows().collect()) == [(1, "a"), (2, "a"), (3, "b")]
    items = spark.range(1, 6).withColumnRenamed("id", "i")
    assert sorted(r.i for r in log.pending(items).collect()) == [4, 5] and sorted(r.i for r in log.pending(items, "error").collect()) == [2, 4, 5]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = log.pending(items)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left, right = plan.split("FileScan parquet")[0].rsplit("+- Sort", 1)
    assert left.count("Exchange") == 1 and "Exchange" not in right and "Bucketed: true" in plan, plan
    spark.sql("DROP TABLE own_log")
    again = src.ResultLog(spark, "own_log", path, schema, buckets=4)  # another session finds the batches
    assert again.rows().count() == 3
    src.append_results(first, str(tmp_path / "json"), "one")
    src.append_results(first, str(tmp_path / "json"), "one")
    assert spark.read.schema(schema).json(str(tmp_path / "json")).count() == 2


def test_replies_are_written_back_once(spark, tmp_path):
    asked, path = tmp_path / "asked", str(tmp_path / "cache")
    asked.mkdir()

    def provider(row):
        (asked / f"{row['cache_key']}-{len(list(asked.iterdir()))}").touch()
        if row["said"] == "boom":
            raise TimeoutError("late")
        return bt.echo_provider(5, "said")(row) | {"tokens_reasoning": 7, "reasoning_chars": 30}

    rows = [("a", "hello", "m", 0.5, 5), ("b", "x" * 30, "m", 0.5, 5), ("c", "boom", "m", 0.5, 5), ("a", "hello", "m", 0.5, 5), ("d", "short", "n", 0.0, 9)]
    requests = spark.createDataFrame(rows, "cache_key string, said string, model string, temperature double, max_tokens bigint")
    calls = lambda: sorted(f.name[0] for f in asked.iterdir())
    got = {r.cache_key: r for r in bt.ask_with_cache(requests, provider, path, "one", slices=3).collect()}
    assert calls() == ["a", "b", "c", "d"]
    a = got["a"]
    assert (a.text, a.finish_reason, a.tokens_in, a.tokens_reasoning, a.reasoning_chars, a.model, a.temperature, a.max_tokens, a.run, a.cached) == ("hello", "stop", 2, 7, 30, "m", 0.5, 5, None, False) and a.created
    assert got["c"].error == "TimeoutError: late" and got["b"].finish_reason == "length"
    again = {r.cache_key: r for r in bt.ask_with_cache(requests, provider, path, "two", slices=3).collect()}
    assert calls() == ["a", "b", "b", "c", "c", "d"]  # only what couldn't be used is asked again
    assert again["a"].cached and again["a"].created == a.created and again["a"].model == "m" and not again["c"].cached
    assert bt.read_reply_cache(spark, path).count() == 2
    # a job that was killed before a slice was complete, and runs again under its name
    import shutil
    from pathlib import Path

    lost = next(p for p in sorted(Path(path).iterdir()) if p.name != "slice=none")
    names = {r.cache_key for r in spark.read.parquet(f"file://{lost}").select("cache_key").collect()}
    shutil.rmtree(lost)
    before = calls()
    bt.ask_with_cache(requests, provider, path, "one", slices=3).collect()
    assert sorted(calls()) == sorted([*before, "b", "c", *names])
    assert sorted(r.cache_key for r in bt.read_reply_cache(spark, path).collect()) == ["a", "d"]


def test_run_batch_isolates_failures(spark):
    def f(row):
        return {"n": 10 // row["x"]}

    got = bt.run_batch(spark.createDataFrame([("a", 5), ("b", 0)], "doc_id string, x int"), f, "n bigint").collect()
    assert {r.doc_id: (r.n, r.error) for r in got} == {"a": (2, None), "b": (None, "ZeroDivisionError: integer division or modulo by zero")}


def test_vote(spark):
    def row(sample, ord_, value, metric="x", unit="ppm"):
        return ("d", sample, ord_, value, None, unit, "Nd", False, "s", metric, "element", "none")

    schema = "doc_id string, sample int, ord int, value string, value_max string, unit string, target_entity string, is_range boolean, sentence string, metric_type string, entity_type string, context_modifier string"
    rows = [row(0, 0, "5", "m1"), row(0, 1, "5", "m9"), row(1, 0, " 5", "m2"), row(2, 0, "7"), row(0, 2, "5.0"), row(1, 1, "9", "a"), row(2, 1, "9", "b"), row(2, 2, "9", "b")]
    got = {r.value: (r.votes, r.metric_type) for r in vt.vote_extractions(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"5": (2, "m1"), "9": (2, "a")}
    spelt = [row(0, 0, "5", unit="PPM"), row(1, 0, " 5", unit="ppm"), row(2, 0, "5", unit="ppm")]
    assert [(r.value, r.unit) for r in vt.vote_extractions(spark.createDataFrame(spelt, schema)).collect()] == [("5", "ppm")]


def test_kappa(spark):
    k = lambda rows: ag.cohen_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert k([("a", "a")] * 3).kappa == 1.0
    assert k([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]).kappa == 0.0
    assert k([(None, None), (None, "b"), ("b", "b")]).po == pytest.approx(2 / 3)
    assert k([]).kappa is None


def test_bootstrap_and_permutation(spark):
    schema = "arm string, doc_id string, " + ", ".join(f"{c} bigint" for c in ev.COUNTS)
    same = spark.createDataFrame([(a, str(i), 2, 1, 1, 1, 2, 2) for a in ("x", "y") for i in range(30)], schema)
    r = st.bootstrap_ci(same).where("arm = 'x'").first()
    assert r.low == r.high == pytest.approx(r.f1)
    assert st.permutation_test(same, "x", "y").first().p_value == 1.0
    rng = random.Random(1)
    mixed = [(a, str(i), rng.randrange(4), rng.randrange(3), rng.randrange(3 if a == "x" else 9), 0, 0, 0) for a in ("x", "y") for i in range(80)]
    frames = [spark.createDataFrame(mixed, schema).repartition(n) for n in (1, 4, 17)]
    got = [st.bootstrap_ci(f).orderBy("arm").collect() for f in frames]
    assert got[0] == got[1] == got[2] and all(r.low <= r.f1 <= r.high for r in got[0])
    assert st.permutation_test(frames[0], "x", "y").first().p_value < 0.05


def test_reports_have_intervals_kappa_and_confusion(spark):
    g = ev.prepared(spark.createDataFrame([ext("d", 0, 5.0), ext("d", 1, 50.0), ext("e", 0, 1.0)], f"doc_id string, ord int, {FIELDS}"))
    p = ev.prepared(spark.createDataFrame([("a", k, *ext("d", 0, 5.0, "ppm" if k else "%", metric_type="m")) for k in (0, 1)], f"arm string, seed int, doc_id string, ord int, {FIELDS}"))
    s, d = spark.createDataFrame([("a", 0), ("a", 1)], "arm string, seed int"), spark.createDataFrame([("d",), ("e",)], "doc_id string")
    report = ev.evaluate(d, g, p, s)
    assert {(r.arm, r.seed, r.f1) for r in report["det_ci"].collect()} == {("a", 0, 0.5), ("a", 1, 0.5)}
    assert report["tup_ci"].count() == 2
    arms = st.arm_summary(report["rows"])
    assert [tuple(r) for r in arms["confusion"].collect()] == [("a", "Process Metric", "m", 2)]
    assert {(r.seed, r.po) for r in arms["kappa_per_seed"].where("field = 'unit'").collect()} == {(0, 1.0), (1, 0.0)}
    rounds = ag.agreement(d, g, d, p.where("seed = 1").drop("arm", "seed"))
    assert [r.f1 for r in rounds["det_ci"].collect()] == [0.5] and rounds["tup_ci"].count() == 1


def test_interval_report_against_plain_python(spark):
    from mensura.plans import catalog

    d = "/root/testdata/sf0.001"
    rows = {(r.part, r.arm, r.name): r.value for r in catalog.q_report_intervals(spark, d).collect()}
    counts = [r.asDict() for r in catalog._counts(spark, d).collect()]
    f1 = lambda tp, fp, fn: 2 * tp / (2 * tp + fp + fn) if tp else 0.0
    for arm in ("base", "tuned"):
        for kind in ("det", "tup"):
            total = [sum(r[f"{kind}_{c}"] for r in counts if r["arm"] == arm) for c in ("tp", "fp", "fn")]
            assert rows["pooled", arm, f"{kind}_f1"] == pytest.approx(f1(*total)) == pytest.approx(rows[f"{kind}_ci", arm, "f1"])
            low, high = rows[f"{kind}_ci", arm, "low"], rows[f"{kind}_ci", arm, "high"]
            assert low <= f1(*total) <= high and 0 < high - low < 0.1
            by_doc = {}
            for r in counts:
                if r["arm"] == arm:
                    own = by_doc.setdefault(r["doc_id"], [0, 0, 0])
                    for k, c in enumerate(("tp", "fp", "fn")):
                        own[k] += r[f"{kind}_{c}"]
            docs_, rng = list(by_doc.values()), random.Random(3)
            draws = sorted(f1(*map(sum, zip(*rng.choices(docs_, k=len(docs_))))) for _ in range(300))
            assert low == pytest.approx(draws[7], abs=0.01) and high == pytest.approx(draws[292], abs=0.01)
    assert 0 < rows["pooled", "annotators", "det_f1"] <= 1


def test_minibatch(spark):
    docs_ = spark.createDataFrame([(i,) for i in range(200)], "doc_id bigint")
    pick = lambda n, seed, step, parts=3: [r.doc_id for r in op.minibatch(docs_.repartition(parts), n, seed, step).collect()]
    one = pick(20, 42, 1)
    assert len(set(one)) == 20 and one == pick(20, 42, 1, 7) and one != pick(20, 42, 2) and set(pick(500, 42, 1)) == set(range(200))
    assert pick(20, 41, 2) == one  # seed and step are added up
    often = Counter(x for step in range(60) for x in pick(20, 1, step))
    assert len(often) > 190 and max(often.values()) < 20  # 6 expected


def test_replies_from_cache_and_provider(spark):
    rows = [("a", "hello"), ("b", "x" * 30), ("c", ""), ("d", "boom"), ("a", "hello"), ("e", "kept")]
    asked = spark.createDataFrame(rows, "cache_key string, said string")
    cache = spark.createDataFrame([("e", "old", "stop", 1, 1), ("b", "  ", "stop", 1, 1)], "cache_key string, text string, finish_reason string, tokens_in bigint, tokens_out bigint")

    def provider(row):
        if row["said"] == "boom":
            raise TimeoutError("late")
        return bt.echo_provider(5, "said")(row)

    got = {r.cache_key: (r.text, r.finish_reason, r.tokens_in, r.tokens_out, r.cached, r.error) for r in bt.obtain_replies(asked, provider, cache).collect()}
    assert got == {
        "a": ("hello", "stop", 2, 2, False, None), "b": ("x" * 20, "length", 8, 5, False, None), "c": ("", "stop", 0, 0, False, "empty reply"), "d": (None, None, None, None, False, "TimeoutError: late"), "e": ("old", "stop", 1, 1, True, None),
    }
    assert bt.obtain_replies(asked.limit(0), provider).count() == 0


def test_splits_and_samples(spark):
    docs = spark.createDataFrame([("a", "dev"), ("b", "val"), ("c", "test")], "doc_id string, partition string")
    assert {r.doc_id: r.split for r in sm.split_gold(docs).collect()} == {"a": "train", "b": "validation", "c": "test"}
    with pytest.raises(ValueError, match="holdout"):
        sm.split_gold(docs.union(spark.createDataFrame([("d", "holdout")], docs.schema)))
    with pytest.raises(ValueError, match=", ".join(f"p{i:02d}" for i in range(40))):
        sm.split_gold(docs.union(spark.createDataFrame([("d", f"p{i:02d}") for i in range(40)], docs.schema)))
    rows = spark.createDataFrame([(str(i), i, None if i % 3 == 0 else "m") for i in range(60)], "doc_id string, ord int, metric_type string")
    picks = [sorted(r.doc_id for r in sm.stratified_audit_sample(rows.repartition(n)).collect()) for n in (1, 7)]
    assert picks[0] == picks[1] and len(picks[0]) == 10
    assert {r.metric_type: (r.sampled, r.available) for r in sm.audit_composition(rows, sm.stratified_audit_sample(rows)).collect()} == {"m": (5, 40), "unknown": (5, 20)}


def test_lookup_texts(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    primary, extra = spark.createDataFrame([("a", "")], "doc_id string, abstract string"), spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, abstract string")
    assert {r.doc_id: (r.source, r.abstract) for r in ev.lookup_texts(ids, primary, extra).collect()} == {"a": ("primary", ""), "b": ("extra", "y"), "c": ("missing", None)}


def test_files_in_and_out(spark, tmp_path):
    work = {"id": "w", "title": "", "display_name": "T", "abstract_inverted_index": {"Hi": [0]}, "keywords": [{"display_name": ""}, {"display_name": "k"}], "authorships": [{"author": {"display_name": "A"}}, {"author": None}], "primary_location": {"source": {"display_name": "J"}}, "open_access": {"is_oa": True}}
    (tmp_path / "w.jsonl").write_text(json.dumps(work) + "\n")
    (tmp_path / "p.jsonl").write_text(json.dumps({"results": [work, work]}) + "\n")
    flat = wk.flatten_works(wk.open_access_only(src.read_works(spark, str(tmp_path / "w.jsonl")))).first()
    assert (flat.titulo, flat.autores, flat.revista, flat.abstract, flat.palavras_chave_openalex) == ("T", "A", "J", "Hi", "k")
    assert src.read_works(spark, str(tmp_path / "p.jsonl"), pages=True).count() == 2
    (tmp_path / "g.jsonl").write_text('{"doc_id":"a","extracoes":[{"value":1}],"particao":"dev"}\n{"doc_id":"b","particao":"val"}\n')
    docs, gold = src.read_gold(spark, str(tmp_path / "g.jsonl"))
    assert docs.count() == 2 and [(r.doc_id, r.value) for r in gold.collect()] == [("a", 1.0)]
    (tmp_path / "r.jsonl").write_text('{"id":"a","resultado":{"doc_id":"a","extracoes":[{"value":1}]}}\n{"doc_id":"b","erro":"E"}\n{bad\n{"x":1}\n')
    assert {r.doc_id: r.erro for r in src.read_results(spark, str(tmp_path / "r.jsonl")).collect()} == {"a": None, "b": "E"}
    (tmp_path / "c.csv").write_text('Abstract\n"two\nlines ""q"""\n\n')
    assert "two\nlines \"q\"" in [r.Abstract for r in src.read_abstracts(spark, str(tmp_path / "c.csv")).collect()]
    (tmp_path / "u.csv").write_text("url,abstract\nhttp://x/W1/,t\n,u\n")
    assert [tuple(r) for r in src.read_extra_abstracts(spark, str(tmp_path / "u.csv")).collect()] == [("W1", "t")]


def test_files_round_trip(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    articles = spark.createDataFrame([("w1", 'A "title", one', "two\nlines"), ("w2", None, "")], "id_openalex string, titulo string, abstract string")
    src.write_articles(articles, at("articles"))
    assert sorted(spark.read.parquet(at("articles")).collect()) == sorted(articles.collect())
    src.write_articles(articles, at("csv"), csv=True)
    back = src.read_abstracts(spark, at("csv"), "id_openalex string, titulo string, abstract string")
    assert sorted(map(tuple, back.collect())) == [("w1", 'A "title", one', "two\nlines"), ("w2", "", "")]
    candidates = spark.createDataFrame([("a", "t", "r"), ("b", None, None)], "doc_id string, titulo string, resumo string")
    src.write_candidates(candidates, at("candidates"))
    assert sorted(spark.read.parquet(at("candidates")).collect(), key=str) == sorted(candidates.collect(), key=str)
    src.write_json(candidates, at("lines"))
    assert sorted(map(tuple, src.read_candidates(spark, at("lines")).collect())) == [("a", "t", "r"), ("b", "", "")]
    finished = spark.createDataFrame([("a", None), ("b", "ValueError: x")], "doc_id string, erro string")
    for _ in range(2):
        src.append_results(finished, at("log"))
    log = src.read_results(spark, at("log"))
    assert log.count() == 4 and {r.doc_id: r.erro for r in log.collect()} == {"a": None, "b": "ValueError: x"}
    trajectory = spark.createDataFrame([(1, [0], 0.5)], "indice int, pais array<int>, nota_val double")
    src.write_json(trajectory, at("trajectory"))
    assert spark.read.schema(trajectory.schema).json(at("trajectory")).collect() == trajectory.collect()


def test_yaml_lexicon(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "terms.yaml").write_text("metals:\n  entity_type: element\n  termos:\n    - canonico: Nd\n      nome: neodymium\n      variantes: [neodimio]\n    - canonico: Fe\nother: 5\nsensivel_a_caixa: [Nd]\n")
    got = {(r.form, r.canonical, r.entity_type, r.case_sensitive, r.spelling) for r in lx.load_lexicon(spark, str(tmp_path / "terms.yaml")).collect()}
    assert got == {("nd", "Nd", "element", True, "Nd"), ("neodymium", "Nd", "element", False, "neodymium"), ("neodimio", "Nd", "element", False, "neodimio"), ("fe", "Fe", "element", False, "Fe")}


def test_last_wins_and_same_number(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 1, "z")], "i string, seq int, v string")
    assert sorted(map(tuple, src.last_wins(rows, "i", "seq").collect())) == [("a", 3, None), ("b", 1, "z")]
    pairs = spark.createDataFrame([(1.0, 1.0), (1.0, 1.005), (None, None), (None, 1.0)], "a double, b double")
    assert [r[0] for r in pairs.select(F.coalesce(tx.same_number(F.col("a"), F.col("b")), F.lit(False))).collect()] == [True, False, False, False]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", "TREO of 9 ppm"), ("b", "nothing")], "doc_id string, abstract string").write.parquet(str(tmp_path / "in"))

    def length(row):
        return {"n": len(row["abstract"])}

    for expected in (1, 1, 2):
        stream = spark.readStream.schema("doc_id string, abstract string").parquet(str(tmp_path / "in"))
        jobs.stream_extract(stream, length, "n bigint", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        if expected == 1 and not (tmp_path / "second").exists() and (tmp_path / "again").exists():
            spark.createDataFrame([("c", "5 ppm REE")], "doc_id string, abstract string").write.mode("append").parquet(str(tmp_path / "in"))
            (tmp_path / "second").touch()
        (tmp_path / "again").touch()


def _batches(spark, base, frames, stream):
    """Runs a stream once after each new input; returns its progress reports and the rows that each batch wrote."""
    progress, wrote = [], []
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{base}/in")
        query = jobs.upsert_stream(stream(spark.readStream.schema(frame.schema).parquet(f"{base}/in")), f"{base}/out", f"{base}/cp")
        query.awaitTermination()
        progress.append(query.recentProgress)
        seen = sum(len(w) for w in wrote)
        rows = [tuple(r) for r in spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").orderBy("batch").collect()]
        wrote.append(rows[seen:])
    return progress, wrote


def test_stream_of_a_log_writes_only_what_a_batch_touches(spark, tmp_path):
    rows = [[(1, 1, "E"), (2, 2, None), (3, 3, "E")], [(1, 4, None), (2, 5, "E")], [(3, 6, "F")]]
    frames = [spark.createDataFrame(r, "i int, seq int, error string") for r in rows]
    _, wrote = _batches(spark, tmp_path, frames, jobs.stream_compact_log)
    assert [sorted(r[0] for r in w) for w in wrote] == [[1, 2, 3], [1, 2], [3]]
    got = jobs.upserted(spark, str(tmp_path / "out"), "i int, seq int, error string", ["i"]).select("i", "seq", "error")
    assert sorted(map(tuple, got.collect())) == [(1, 4, None), (2, 2, None), (3, 6, "F")] == sorted(map(tuple, bt.compact_log(frames[0].union(frames[1]).union(frames[2])).collect()))


def test_stream_of_usage_closes_windows(spark, tmp_path):
    """Late rows of open windows count, those of closed ones don't; repeated calls count once; state goes."""
    at = lambda h, m, key, n: (f"2024-01-01 {h:02d}:{m:02d}:00", key, n)
    rows = [[at(0, 5, "a", 1), at(0, 6, "b", 2), at(0, 6, "b", 2)], [at(1, 30, "c", 4), at(0, 50, "d", 8), at(0, 6, "b", 2)], [at(9, 0, "e", 16)], [at(0, 10, "f", 32), at(9, 5, "g", 64), at(9, 0, "e", 16)], [at(20, 0, "h", 128)]]
    frames = [spark.createDataFrame(r, "ts string, call string, n bigint").withColumn("ts", F.col("ts").cast("timestamp")) for r in rows]
    progress, _ = _batches(spark, tmp_path, frames, lambda s: jobs.stream_usage(s, "ts", "n", late="2 hours", key="call"))
    got = jobs.upserted(spark, str(tmp_path / "out"), "window_start timestamp, calls bigint, tokens bigint", ["window_start"]).collect()
    assert sorted((r.window_start.hour, r.calls, r.tokens) for r in got) == [(0, 3, 11), (1, 1, 4), (9, 2, 80), (20, 1, 128)]
    last = progress[-1][-1].stateOperators
    assert sum(o.numRowsTotal for o in last) <= 4, [o.numRowsTotal for o in last]  # of eight calls and four windows
    assert sum(o.numRowsDroppedByWatermark for p in progress for x in p for o in x.stateOperators) == 1


def test_stream_queries_write_to_the_shared_folder(spark):
    import os

    from mensura.plans import catalog

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    for query in (catalog.q_stream_compact_log, catalog.q_stream_usage):
        got = query(spark, "/root/testdata/sf0.001")
        files = got.inputFiles()
        assert files and all(f.removeprefix("file://").startswith(base + "/streams/") for f in files), files
        assert os.listdir(files[0].removeprefix("file://").split("/result/")[0] + "/checkpoint/offsets")
        assert got.count() > 0


def test_queries_over_all_ids_and_nulls(spark, tmp_path):
    from mensura.plans import catalog

    d = "/root/testdata/sf0.001"
    n_gold = catalog._gold(spark, d).count()
    n_pred = {(r.arm, r.seed): r["count"] for r in catalog._pred(spark, d).groupBy("arm", "seed").count().collect()}
    # the strict rates: fp has no gold row, fn no predicted one
    assert {(r.arm, r.seed): (r.tp + r.fn, r.tp + r.fp) for r in catalog.q_strict_eval(spark, d).collect()} == {k: (n_gold, n) for k, n in n_pred.items()}
    assert catalog._agreement(spark, d)["docs"].count() == 2 * spark.read.parquet(f"{d}/orders.parquet").count()
    rows = [(2, None, None, None), (4, "one two  one", None, None), (6, "cut off...", "en", "web"), (10, None, "en", "web"), (11, "x", "en", "web")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, None), (1, 2, "a"), (1, 3, "a")], "conv_id bigint, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = lambda q: {tuple(r) for r in q(spark, str(tmp_path)).collect()}
    assert len(got(catalog.q_rebuild_abstract)) == 5 and (10, "d41d8cd98f00b204e9800998ecf8427e") in got(catalog.q_rebuild_abstract)
    assert got(catalog.q_clean_abstract) == {(2, 0), (4, 0), (6, 0), (10, 0), (11, 1)}
    assert got(catalog.q_has_term) == {(2, 0), (4, 0), (6, 0), (10, 0), (11, 1)}
    assert got(catalog.q_usable_reply) == {(1, 1, 0), (1, 2, 1), (1, 3, 0)}
    assert got(catalog.q_flatten_works) == {("4", "Title 4", "A, ", "J", "one two one", "")}


def test_plans_keep_columns_and_shuffles_few(spark):
    from mensura.plans import catalog

    plan = catalog.q_compact_log(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "props" not in plan
    counts = Counter(catalog.QUERIES)
    assert len(counts) == len(catalog.QUERIES) and set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_alignment_moves_the_tables_rows_alone(spark):
    """Gold and predictions that are dealt out by order are neither stored nor moved again."""
    from mensura.plans import catalog

    rows = catalog._rows(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert moved and all("orderkey" in line and "REPARTITION_BY_NUM" in line for line in moved)
    assert "lineitem.parquet" in plan and "predictions" not in plan


def test_rounds_are_not_stored(spark, monkeypatch):
    """The agreement's and the evaluation's inputs are aligned as they are derived."""
    from mensura.plans import catalog

    def refused(df, name):
        raise AssertionError(name)

    monkeypatch.setattr(catalog, "stored", refused)
    d = "/root/testdata/sf0.001"
    assert catalog.QUERIES["q_agreement_prf"](spark, d).count() == 1 and catalog.QUERIES["q_evaluate"](spark, d).count() == 2


def test_pairs_of_small_documents_take_no_rounds(spark, monkeypatch):
    from mensura.plans import catalog

    def refused(*args):
        raise AssertionError("rounds")

    d = "/root/testdata/sf0.001"
    want = {tuple(r) for r in ev.align(catalog._gold(spark, d), catalog._pred(spark, d)).select("arm", "seed", "doc_id", "g_ord", "p_ord").collect()}
    monkeypatch.setattr(ev, "mutual_best", refused)
    assert {tuple(r) for r in catalog.QUERIES["q_align"](spark, d).collect()} == want


def _odd_sides(spark):
    """Gold and predictions of random documents: ties, nulls, empty and unknown documents, a system without predictions and one that isn't listed."""
    rng = random.Random(3)
    docs = [*[f"d{n}" for n in range(40)], None]
    some = lambda: {"value": rng.choice([None, 0.0, 1.0, 1.005, 5.0, -5.0]), "unit": rng.choice(["%", "ppm", None]), "entity": rng.choice(["Nd", "REEs", None]), "metric_type": rng.choice(["a", "b"])}
    rows = lambda most: [ext(d, o, **some()) for d in [*docs[:35], "unknown", None] for o in range(rng.randrange(most))]
    gold = ev.prepared(spark.createDataFrame(rows(9), f"doc_id string, ord int, {FIELDS}"))
    pred = ev.prepared(spark.createDataFrame([(*s, *r) for s in (("a", 0), ("a", 1), ("x", 9)) for r in rows(9)], f"arm string, seed int, doc_id string, ord int, {FIELDS}"))
    systems = spark.createDataFrame([("a", 0), ("a", 1), ("b", None)], "arm string, seed int")
    return spark.createDataFrame([(d,) for d in docs], "doc_id string"), gold, pred, systems


def test_counts_without_rows_are_those_of_the_rows(spark):
    sides = _odd_sides(spark)
    sort = lambda df: sorted(map(str, df.select("arm", "seed", "doc_id", *ev.COUNTS).collect()))
    want = sort(ev.doc_counts(ev.aligned_rows(*sides)))
    assert len(want) == 41 * 3
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size, most in (("3", 1000), ("100000", 1000), ("100000", 8)):  # documents that span batches, batches of many documents, crowded ones
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sort(ev.aligned_counts(*sides, most=most)) == want, (size, most)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    docs, gold, pred, systems = sides
    assert sort(ev.aligned_counts(docs, gold, pred.limit(0), systems)) == sort(ev.doc_counts(ev.aligned_rows(docs, gold, pred.limit(0), systems)))
    assert ev.aligned_counts(docs, gold, pred, systems.limit(0)).count() == 0


def test_counts_make_no_lists_of_documents(spark):
    from mensura.plans import catalog

    for name in ("q_boot_groups", "q_mean_score", "q_permutation"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and plan.count("Sort [doc_id") <= 5, name


def test_counts_send_four_numbers_a_candidate(spark):
    """Rows go to Python field by field, so what the choice needs of a candidate is one number beside its document and orders."""
    from mensura.plans import catalog

    for name in ("q_mean_score", "q_permutation"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        (sent,) = re.findall(r"MapInArrow count\((.*?)\)#", plan)
        assert len(sent.split(", ")) == 4, sent


def test_counts_of_many_systems(spark):
    """Systems with every score, and a gold side of more rows than predictions; as many systems as are laid out as literals have room in a number."""
    assert ev.MOST_LITERALS <= 1024
    systems = [("a", n) for n in range(40)]
    gold = [ext("x", 0, value=5.0, value_max=7.0, unit="%", entity="Nd"), *[ext("x", o, value=100.0 * o, unit="%", entity="Nd") for o in range(1, 9)], ext("y", 0, value=None, unit="%", entity="Nd")]
    odd = {0: {"unit": "ppm"}, 1: {"entity": "Pr"}, 2: {"value_max": 70.0, "unit": "ppm", "entity": "Pr"}, 3: {"metric_type": "b"}}
    pred = [(*s, *ext("x", o, **({"value": 5.0, "value_max": 7.0, "unit": "%", "entity": "Nd"} | odd.get((s[1] + o) % 7, {})))) for s in systems[1:] for o in range(2)]
    docs = spark.createDataFrame([("x",), ("y",), ("z",)], "doc_id string")
    sides = docs, ev.prepared(spark.createDataFrame(gold, f"doc_id string, ord int, {FIELDS}")), ev.prepared(spark.createDataFrame(pred, f"arm string, seed int, doc_id string, ord int, {FIELDS}")), spark.createDataFrame(systems, "arm string, seed int")
    sort = lambda df: sorted(map(str, df.select("arm", "seed", "doc_id", *ev.COUNTS).collect()))
    want = sort(ev.doc_counts(ev.aligned_rows(*sides)))
    assert len(want) == 3 * 40 and sort(ev.aligned_counts(*sides)) == want


def test_predictions_are_looked_up_and_not_sorted(spark):
    """Of the predictions only numbers are sorted; their fields meet the gold rows of a part as they come."""
    from mensura.plans import catalog

    for name in ("q_permutation", "q_mean_score", "q_doc_counts"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ShuffledHashJoin") == 3 and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan, name
        assert plan.count("Sort [doc_id") == 1, name


def test_counts_of_small_parts_are_those_of_the_rows(spark):
    docs, gold, pred, systems = _odd_sides(spark)
    sort = lambda df: sorted(map(str, df.select("arm", "seed", "doc_id", *ev.COUNTS).collect()))
    want = sort(ev.doc_counts(ev.aligned_rows(docs, gold, pred, systems)))
    for parts, most in ((1, 1000), (5, 1000), (5, 8)):  # one part, several, and crowded documents beside them
        sides = (x.repartition(parts, "doc_id") for x in (docs, gold, pred))
        got = ev.aligned_counts(*sides, systems, most=most, small_parts=True)
        assert "ShuffledHashJoin" in got._jdf.queryExecution().executedPlan().toString() and sort(got) == want, (parts, most)
    assert sort(ev.aligned_counts(docs, gold.limit(0), pred, systems, small_parts=True)) == sort(ev.doc_counts(ev.aligned_rows(docs, gold.limit(0), pred, systems)))


def test_orders_without_lines_want_parts_too(spark, tmp_path, monkeypatch):
    from mensura.plans import derive

    spark.range(50).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(305).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(derive, "LINES", 10)
    assert derive.order_parts(spark, str(tmp_path)) == 31


def _classes_of(frames):
    """Both classes of an alignment as texts, those of documents without naming one."""
    documents, pairs = frames
    named = documents.groupBy("arm", "seed", *ev.COUNTS).agg(F.sum("n_docs").alias("n"))
    return sorted(map(str, named.collect())), sorted(map(str, pairs.groupBy("arm", "seed", *ev.PAIR_CLASS).agg(F.sum("n_pairs").alias("n")).collect()))


def test_classes_from_one_pass_are_those_of_the_rows(spark, monkeypatch):
    """Classes of documents and pairs: few, crowded and many documents, batches that cut documents, classes passed on early, labels that look like their own marks."""
    docs, gold, pred, systems = _odd_sides(spark)
    odd = lambda df, shift: df.withColumn("entity_type", F.element_at(F.array(*map(F.lit, ["=", "n", "3:a;", ";2:", "", "é:1", None])), ((F.col("ord") + shift) % 7 + 1).cast("int")))
    gold, pred = odd(gold, 0), odd(pred, F.when(F.col("ord") % 2 == 0, 1).otherwise(0))
    want = _classes_of(ev.classes_of_rows(ev.aligned_rows(docs, gold, pred, systems)))
    assert len(want[1]) > 20
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size, most, kept in (("3", 1000, 50_000), ("100000", 1000, 1), ("100000", 8, 50_000)):
            monkeypatch.setattr(ev, "MOST_CLASSES", kept)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            documents, pairs = ev.aligned_classes(docs, gold, pred, systems, most=most)
            assert _classes_of((documents, pairs)) == want, (size, most)
            least = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("n_docs").alias("k")).collect()
            assert all((r.n, r.k) == (3, 1) for r in least)  # a class has every system, under one document's name
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert _classes_of(ev.aligned_classes(docs, gold, pred.limit(0), systems)) == _classes_of(ev.classes_of_rows(ev.aligned_rows(docs, gold, pred.limit(0), systems)))
    assert [x.count() for x in ev.aligned_classes(docs, gold, pred, systems.limit(0))] == [0, 0]


def _stored_by(spark, monkeypatch, query):
    """The names of what a query stores."""
    names, plain = [], ev.stored
    monkeypatch.setattr(ev, "stored", lambda df, name: names.append(name) or plain(df, name))
    query(spark, "/root/testdata/sf0.001").count()
    return set(names)


def test_arm_report_makes_no_rows(spark, monkeypatch):
    from mensura.plans import catalog

    assert _stored_by(spark, monkeypatch, catalog.q_arm_report) == {"crowded", "tallies"}


def test_strict_errors_move_the_lines_alone(spark):
    """Both sides are dealt out by order; pairing them moves no row again."""
    from mensura.plans import catalog

    plan = catalog.q_strict_errors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]
    assert len(moved) == 1 and "error_type" in moved[0] and "doc" not in moved[0], moved


def test_strict_pairs_are_those_of_a_loop(spark):
    """Ties, ranges, unreadable numbers and zeros of either sign; a system without predictions."""
    rng = random.Random(5)
    some = lambda d, o: (d, o, rng.choice(["1", "1.0", "~2", "-0", "0", "x", None]), rng.choice([None, "3", "y"]), rng.choice([True, False, None]), rng.choice("ab"), rng.choice(["e", None]))
    gold = [some(d, o) for d in "abcd" for o in range(rng.randrange(12))]
    pred = [(*some(d, o), *s) for s in (("m", 0), ("m", 1)) for d in "bcde" for o in range(rng.randrange(12))]
    schema = "doc_id string, ord int, value string, value_max string, is_range boolean, metric_type string, entity_type string"
    number = lambda x: None if x in (None, "x", "y") else float(x.strip("~")) + 0.0
    want = Counter()
    for s in (("m", 0), ("m", 1), ("n", 0)):
        free = list(gold)
        for p in [r for r in pred if r[7:] == s]:
            a, b, r = number(p[2]), number(p[3]), bool(p[4])
            able = a is not None and (not r or b is not None)
            g = next((g for g in free if able and g[0] == p[0] and bool(g[4]) == r and number(g[2]) == a and (not r or number(g[3]) == b)), None)
            if g:
                free.remove(g)
            want[(*s, p[0], g and g[1], p[1], g and g[5], p[5])] += 1
        want.update((*s, g[0], g[1], None, g[5], None) for g in free)
    systems = spark.createDataFrame([("m", 0), ("m", 1), ("n", 0)], "arm string, seed int")
    got = ev.strict_pairs(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema + ", arm string, seed int"), ev.BY, systems)
    assert Counter(map(tuple, got.select("arm", "seed", "doc_id", "g_ord", "p_ord", "g_metric_type", "p_metric_type").collect())) == want


def test_strict_eval_moves_the_lines_alone(spark):
    from mensura.plans import catalog

    plan = catalog.q_strict_eval(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]
    assert len(moved) == 1 and "_doc" not in moved[0], moved
    assert "to_json" not in plan and plan.count("Exchange hashpartitioning(l_orderkey") == 2


def test_rounds_are_derived_where_their_lines_are(spark, monkeypatch):
    """The rounds are those of their SQL, and neither they nor the rows of the alignment are moved or stored."""
    from mensura.plans import catalog
    from mensura.plans.derive import sql

    d, seen, plain = "/root/testdata/sf0.001", [], ag.agreement
    monkeypatch.setattr(ag, "agreement", lambda *sides, **how: seen.append(sides) or plain(*sides, **how))
    assert _stored_by(spark, monkeypatch, catalog.q_report_intervals) == {"crowded", "tallies"}
    ((_, first, _, second),) = seen
    for got, want in zip((first, second), catalog._ROUNDS):
        rows = [Counter(map(tuple, x.select("doc_id", "ord", "value", "value_max", "is_range", "unit", "metric_type", "target_entity", "entity_type", "context_modifier").collect())) for x in (got, sql(spark, d, want))]
        assert rows[0] == rows[1] and rows[0]
        moved = [line for line in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
        assert len(moved) == 1 and "round_doc" in moved[0], moved


def test_evaluate_report_makes_no_rows(spark, monkeypatch):
    """Its parts come from classes, and sentences are looked for in the predictions, which needn't be aligned for that."""
    from mensura.plans import catalog

    assert _stored_by(spark, monkeypatch, catalog.q_evaluate_report) == {"crowded", "tallies"}
    rows = {(r.arm, r.seed, r.name): r.value for r in catalog.q_evaluate_report(spark, "/root/testdata/sf0.001").where("part = 'hallucination'").collect()}
    assert rows["base", "0", "total"] == catalog._pred(spark, "/root/testdata/sf0.001").where("arm = 'base' AND seed = 0").count() > rows["base", "0", "grounded"] > 0


def test_sentences_of_unlisted_systems_and_documents_are_not_counted(spark):
    docs, gold, pred, systems = _odd_sides(spark)
    said = ev.evaluate(docs, gold, pred, systems, abstracts=spark.createDataFrame([("d1", "an  s here"), ("d2", None)], "doc_id string, abstract string"))["hallucination"]
    own = pred.where("arm = 'a' AND doc_id LIKE 'd%'")
    want = {(r.arm, r.seed): (r.n, r.k) for r in own.groupBy("arm", "seed").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("doc_id") == "d1").cast("long")).alias("k")).collect()}
    assert {(r.arm, r.seed): (r.total, r.grounded) for r in said.collect()} == want and len(want) == 2
