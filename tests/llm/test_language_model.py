"""The bigram model against a plain version over dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mensura.llm import language_model as lm
from mensura.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, learn):
    """[(doc_id, text)] to [(doc_id, ...)] in the order of the rows."""
    lists = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</s>"] for _, t in rows]
    pairs = [list(zip(["<s>", *x[:-1]], x)) for x in lists]
    chosen = [k for k, (d, _) in enumerate(rows) if learn(d)]
    uni, bi = Counter(w for k in chosen for w in lists[k]), Counter(p for k in chosen for p in pairs[k])
    after, ends, context = defaultdict(Counter), Counter(), Counter()
    for (v, w), c in bi.items():
        after[v][min(c, 3)] += 1
        ends[w] += 1
        context[v] += c

    def rule(counts):
        n = Counter(counts)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        out = [0.0]
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else k / 2
            out.append(d if 0 < d < k else k / 2)
        return out

    d2, d1 = rule(bi.values()), rule(ends.values())
    total, size, n_ends = sum(uni.values()), len(uni), len(bi)
    left = sum(d1[min(c, 3)] for c in ends.values()) / n_ends if n_ends else 1.0

    def p1(w):
        return (max(ends[w] - d1[min(ends[w], 3)], 0) / n_ends if n_ends else 0) + left / (size + 1)

    def p2(v, w):
        if not context[v]:
            return p1(w)
        return (max(bi[v, w] - d2[min(bi[v, w], 3)], 0) + sum(d2[k] * n for k, n in after[v].items()) * p1(w)) / context[v]

    out = []
    for (d, _), x, p in zip(rows, lists, pairs):
        out.append((d, not learn(d), len(x), sum(uni[w] > 0 for w in x), total, sum(math.log10((uni[w] + 1) / (total + size + 1)) for w in x), sum(math.log10(p2(v, w)) for v, w in p)))
    if size:  # probabilities of all known words and the unknown one sum to one
        for v in [*list(context)[:5], "<s>", "never seen"]:
            assert sum(p2(v, w) for w in uni) + p2(v, "never seen") == pytest.approx(1)
    return out


def got(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=str)


def same(a, b):
    a, b = sorted(a, key=lambda r: (str(r[0]), r[6])), sorted(b, key=lambda r: (str(r[0]), r[6]))
    assert [r[:5] for r in a] == [r[:5] for r in b]
    for x, y in zip(a, b):
        assert x[5] == pytest.approx(y[5], rel=1e-9) and x[6] == pytest.approx(y[6], rel=1e-9)


def fold(d):
    return zlib.crc32(str(d).encode() if d is not None else b"") % 7


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows, lambda d: fold(d) != 2)
    found = queries.op11_language_model(spark, "/root/testdata/sf0.001")
    same(got(found), want)
    held = [r for r in want if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # better than unigrams on texts it hasn't seen


def test_edges_parts_and_many_chunks(spark, monkeypatch):
    long = " ".join(f"word{i % 37} The" for i in range(400))
    rows = [(1, None), (2, ""), (3, "  \t "), (4, "One one"), (4, "One one"), (None, "one two"), (5, long), (6, "x" * 700), (7, "É é É"), (8, "a\x0bb\x1cc d e"), (9, long + " end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit(0)).withColumn("words", F.lit("x"))
    learn = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0
    want = plain(rows, lambda d: (d or 0) % 2 == 0)
    same(got(lm.scored(docs, learn)), want)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 64)  # long texts in parts, a text or two to a chunk
    same(got(lm.scored(docs.repartition(3), learn)), want)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert got(lm.scored(docs, F.lit(False))) == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    assert lm.scored(docs.limit(0), F.lit(True)).count() == 0
