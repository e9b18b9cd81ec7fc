"""Prefix nodes of conversations against a plain version, and the double array by itself."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.llm import prefix_trie as pt
from mensura.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    """[(conv_id, turn, role, text)] to {conv_id: turns} by the query's rule."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[3] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, v in own.items()}
    return {c: own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in own.items()}


def plain(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * words
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids[k] if k in kids else 0, leaves[k], saved[k], sha(k)) for k, m in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def nodes(spark, rows, **how):
    turns = pt.turn_digests(spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(1)).withColumn("words", F.lit("x")).repartition(5))
    c = F.col("conv_id")
    return got(pt.prefix_nodes(pt.with_shared_heads(turns, c - c % 20, F.crc32(c.cast("string")) % 4), **how))


def made(seed, convs=300, most=9, kinds=3):
    draw = np.random.default_rng(seed)
    return [(c, t, ["user", "assistant"][t % 2], f"say {'so ' * int(draw.integers(kinds))}x{int(draw.integers(kinds))}") for c in range(convs) for t in range(int(draw.integers(0, most)))]


@pytest.mark.parametrize("heavy", [1, 3, 40, None])
def test_shared_prefixes(spark, heavy):
    rows = made(heavy or 0)
    rows += [(1000 + i, t, "user", f"the same turn {t}") for i in range(70) for t in range(5)]  # copies of one conversation
    rows += [(2000 + i, t, "user", f"the same turn {t}" if t < 30 else f"own {i}") for i in range(9) for t in range(32)]  # a long common prefix
    assert nodes(spark, rows, heavy=heavy) == plain(rebuilt(rows))


def test_odd_rows(spark):
    rows = [
        (0, None, None, None), (0, 1, "", ""), (0, 1, "a", "b c"), (0, 1, "a", "b c"), (0, -5, "ab", ""), (7, 3, "a", "bc"), (7, 3, "ab", "c"), (27, 0, "user", " two  words\t"), (27, 1, None, "x"), (46, 0, "r", "only own"), (46, 9, "r", None),
        (None, 0, "user", "nobody's"), (None, 1, "user", "nobody's"), (33, 0, "user", "x " * 30_000), (34, 0, "user", "x " * 30_000), (4095, 0, "q", "w"), (4096, 0, "q", "w"), (8192, 0, "q", "w"), (10, 5, "q", "w"),
    ]
    assert nodes(spark, rows, heavy=2) == plain(rebuilt(rows))
    assert nodes(spark, rows) == plain(rebuilt(rows))


def test_empty_table(spark):
    assert nodes(spark, []) == []


def test_ids_of_a_class_pass_in_blocks(spark):
    rows = [(20 * i, 0, "user", "hello") for i in range(3000)]
    assert nodes(spark, rows) == plain(rebuilt(rows))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_prefix_trie(spark, "/root/testdata/sf0.01")) == plain(rebuilt(rows))


@pytest.mark.parametrize("symbols", [1, 5, 3000])
def test_double_array_holds_just_its_sequences(symbols):
    draw = np.random.default_rng(symbols)
    runs = [draw.integers(1, symbols + 1, draw.integers(0, 6)) for _ in range(2000)]
    trie = pt.packed_trie(np.concatenate(runs).astype(np.int64), np.concatenate([[0], np.cumsum([len(r) for r in runs])]), symbols)
    prefixes = {tuple(r[:d].tolist()) for r in runs for d in range(len(r) + 1)}
    slots = {}
    for p in prefixes:
        at = np.zeros(1, np.int64)
        for c in p:
            at = trie.step(at, np.array([c]))
        slots[p] = int(at[0])
    assert min(slots.values()) == 0 and len(set(slots.values())) == len(prefixes)
    for p in list(prefixes)[:300]:
        for c in range(1, min(symbols, 50) + 1):
            assert (int(trie.step(np.array([slots[p]]), np.array([c]))[0]) >= 0) == ((*p, c) in prefixes)
