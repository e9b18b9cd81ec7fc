"""The alignment of two tokenizers against a plain version."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mensura.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "   ", "x", " x", "a  b", "a \n b", "tab\tx \t y", "naïve café — 日本語 テスト", "▁", "a ▁ b", "<|endoftext|> and </s> <unk>", "it's we'll 'd 12345 6.7", "a" * 3000, "ab " * 500, "\n\n\n", "x　 y", "x  y", "end ", "é ́", "​ ‍",
    "🙂🙃 👩‍👩‍👧", "\r\n \r\n", "A.B. c,d;e", "\x00 \x01 z", "ﬁ ﬂ ™", "Ünïcödé " * 40, "0x41 <0x0A> <0xFF>", "日本" * 700, "﻿x", "q\x85 w",
]


def plain(rows):
    """[(doc_id, text)] to {doc_id: row}, document by document and pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b, of = sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_of_char()
    held, out = Counter(), {}
    for doc_id, text in rows:
        groups = []
        if text:
            data = (" " + text).encode()
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ta = [bytes(of[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in ia]
            tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(ta) == data == b"".join(tb):
                ea, eb = np.cumsum([len(t) for t in ta]), np.cumsum([len(t) for t in tb])
                i = j = 0
                for end in sorted(set(ea.tolist()) & set(eb.tolist())):
                    x, y = int(np.searchsorted(ea, end)) + 1, int(np.searchsorted(eb, end)) + 1
                    groups.append((ia[i:x], ib[j:y]))
                    i, j = x, y
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        held.update(links.keys())
        out[doc_id] = groups, links
    most = Counter()
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    return {
        d: (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(k.values()), sum(n for p, n in k.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in k.items()),
            hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else "")
        for d, (g, k) in out.items()
    }


def got(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def test_odd_texts(spark):
    rows = list(enumerate(ODD))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_a", F.lit("x")).withColumn("chunk", F.lit(7)).repartition(3)
    assert got(alignment.aligned(docs, A, B)) == plain(rows)


def test_merging_levels_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "BLOCK", 8)
    rows = [(i, f"the quick brown fox {i % 7} jumps, over-{i} lazy dogs' naïveté{i % 3}") for i in range(60)]
    assert got(alignment.aligned(spark.createDataFrame(rows, "doc_id bigint, text string"), A, B)) == plain(rows)


def test_null_and_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, None)], "doc_id bigint, text string")
    rows = sorted((r.doc_id is None, r.n_a, r.count_sum) for r in alignment.aligned(docs, A, B).collect())
    assert rows == [(False, 0, 0), (False, 2, 6), (True, 2, 6), (True, 2, 6)]
    assert alignment.aligned(docs.limit(0), A, B).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op12_alignment(spark, "/root/testdata/sf0.001")) == plain(rows)


@pytest.mark.parametrize("fan", [1, 3])
def test_runs_merge_like_a_counter(fan):
    draw = np.random.default_rng(fan)
    runs, want = [], Counter()
    for _ in range(fan):
        keys = np.unique(draw.integers(0, 1 << 20, 50_000)).astype(np.uint32)
        many = draw.integers(1, 9, len(keys))
        want.update(dict(zip(keys.tolist(), many.tolist())))
        runs.append(alignment.run_bytes(iter([(keys, many)])))
    found = dict(x for p, c in alignment.merged_blocks(runs) for x in zip(p.tolist(), c.tolist()))
    assert found == want
    best = dict(x for p, c in alignment.with_best(alignment.merged_blocks(runs)) for x in zip(p.tolist(), c.tolist()))
    top = Counter()
    for k, n in want.items():
        top[k >> 15] = max(top[k >> 15], n)
    assert best == {k: 2 * n + (n == top[k >> 15]) for k, n in want.items()}
