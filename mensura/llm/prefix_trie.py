"""Prefix trie of conversations by double arrays, in shards of prefixes.

Turns become 128-bit digests first, so no text is shuffled. Equal conversations are one class with
a count. Classes are dealt to shards by a prefix: the first turn, or, where a prefix weighs more
than a part of a shard, the shortest longer prefix that doesn't. A shard numbers its turns densely,
packs their sequences into BASE and CHECK arrays and walks these for its nodes. Nodes above the
dealt prefixes are shared by shards, so their sums are merged over all shards.

Rows without a conv_id belong to no conversation. Rows of one conversation and turn are ordered by
the MD5 of role and text, repeated rows being turns of their own. An empty table has no nodes, not
even a root. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import bounded_batches, give_back, stored

#: Bytes of a turn's and of a prefix's digest.
DIGEST = 16
#: Turns in a shard, at most about; bits of the ids that one block of text spans.
SHARD_TURNS = 250_000
LEAST_HEAVY = 256
ID_BITS = 12
ROOT = bytes(DIGEST)
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
#: What a shard tells of a node that other shards share: its prefixes' digests from the root on
#: (its own last), and sums over the shard.
SHARED = f"{NODE}, path array<binary>, words bigint"
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- conversations -------------------------------------------------------------------------


def with_shared_heads(turns: DataFrame, base: Column, head_turns: Column) -> DataFrame:
    """Conversations (conv_id, turns) whose first ``head_turns`` turns are those of conversation ``base``.

    turns: conv_id, turn, digest and words. All of a conversation's turns come together as digests,
    about 40 bytes each. ``base`` and ``head_turns`` are expressions over conv_id.
    """
    rows = turns.withColumn("_base", base)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "digest", "words"))), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    whole = rows.repartition("_base").groupBy("_base", "conv_id").agg(listed.alias("own"))
    heads = whole.where("conv_id = _base").select("_base", F.col("own").alias("head"))
    n = head_turns.cast("int")
    head = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), n)
    rest = F.slice("own", n + 1, F.greatest(F.size("own") - n, F.lit(0)))
    return whole.join(heads, "_base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, the MD5 of role and text (null: empty), and the text's words."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.unhex(F.md5(framed.cast("binary"))).alias("digest"), words.cast("bigint").alias("words"))


def chain(digests: bytes) -> list[bytes]:
    """Digests of all prefixes of a sequence of turns, the root's first."""
    out, last = [ROOT], ROOT
    for i in range(0, len(digests), DIGEST):
        last = hashlib.md5(last + digests[i : i + DIGEST]).digest()
        out.append(last)
    return out


def classes(conversations: DataFrame) -> DataFrame:
    """Distinct sequences of turns: key (the last prefix's digest), turns, words, n, first (smallest
    conv_id) and ends (SHA-256 of all conv_ids).

    The ids of a class come together as blocks of text, 4,096 ids each, which one pass over a
    partition in order feeds to the hash; the ids of a class of any size are never held at once.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = b.column("turns")
            ends = np.asarray(turns.offsets)
            flat = turns.flatten()
            digests, words = b"".join(flat.field("digest").to_pylist()), flat.field("words").to_numpy(zero_copy_only=False).astype("<i8")
            ends = ends - ends[0]
            runs = [digests[i * DIGEST : j * DIGEST] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            keys = [chain(r)[-1] for r in runs]
            sizes = [words[i:j].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(keys, pa.binary()), pa.array(runs, pa.binary()), pa.array(sizes, pa.binary())], ["conv_id", "key", "turns", "words"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        names = ["key", "turns", "words", "n", "first", "ends"]
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string()]

        def rows(done: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[k] if k != "ends" else d[k].hexdigest() for d in done], t) for k, t in zip(names, kinds)], names)

        for b in batches:
            done = []
            for row in b.to_pylist():
                if now is None or row["key"] != now["key"]:
                    if now is not None:
                        done.append(now)
                    now = {k: row[k] for k in ("key", "turns", "words", "first")} | {"n": 0, "ends": hashlib.sha256()}
                    now["ends"].update(row["ids"].encode())
                else:
                    now["ends"].update(b"," + row["ids"].encode())
                now["n"] += row["n"]
            if done:
                yield rows(done)
        if now is not None:
            yield rows([now])

    keys = conversations.mapInArrow(keyed, "conv_id bigint, key binary, turns binary, words binary")
    block = F.shiftright("conv_id", ID_BITS).alias("block")
    blocks = keys.groupBy("key", block).agg(F.sort_array(F.collect_list("conv_id")).alias("l"), F.first("turns").alias("turns"), F.first("words").alias("words"))
    texts = blocks.select("key", "block", "turns", "words", F.size("l").cast("bigint").alias("n"), F.col("l")[0].alias("first"), F.array_join(F.col("l").cast("array<string>"), ",").alias("ids"))
    return texts.repartition("key").sortWithinPartitions("key", "block").mapInArrow(hashed, "key binary, turns binary, words binary, n bigint, first bigint, ends string")


# ---- shards --------------------------------------------------------------------------------


def dealt(of: DataFrame, n_shards: int, heavy: int) -> DataFrame:
    """Adds to each class the depth of the prefix that it is dealt by (null: all its nodes are
    shared), the smallest conv_id of the prefix before that, and its shard.

    A prefix of several classes that weighs more than ``heavy`` turns is shared between shards. Only
    classes whose first turn is heavy need their longer prefixes weighed.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [chain(t)[1:] for t in b.column("turns").to_pylist()]
            many = np.array([len(p) for p in paths])
            of = np.repeat(np.arange(len(paths)), many)
            depth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + 1
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(of)), b.column("first").take(pa.array(of)), pa.array(depth.astype(np.int32)), pa.array([x for p in paths for x in p], pa.binary()), pa.array(many[of])], ["key", "first", "depth", "prefix", "weight"])

    turns = F.octet_length("turns") / DIGEST
    top = of.withColumn("_top", F.substring("turns", 1, DIGEST))
    weighty = top.groupBy("_top").agg(F.sum(turns).alias("w"), F.count(F.lit(1)).alias("n")).where((F.col("w") > heavy) & (F.col("n") > 1)).select("_top")
    under = top.join(weighty, "_top", "left_semi").select("key", "first", "turns")
    rows = stored(under.mapInArrow(prefixes, "key binary, first bigint, depth int, prefix binary, weight bigint"), "prefixes")
    shared = rows.groupBy("prefix").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), F.min("first").alias("above")).where((F.col("w") > heavy) & (F.col("n") > 1)).select("prefix", "above")
    # the deepest shared prefix of each class; those of a class are its first ones without a gap
    deepest = rows.join(shared, "prefix").groupBy("key").agg(F.max(F.struct("depth", "above")).alias("d"))
    cut = of.join(deepest, "key", "left").withColumn("_cut", F.coalesce("d.depth", F.lit(0)) + 1).withColumn("above", F.col("d.above")).drop("d")
    shard = F.pmod(F.xxhash64(F.substring("turns", F.lit(1), F.col("_cut") * DIGEST)), F.lit(n_shards)).cast("int")
    return cut.select("*", F.when(turns >= F.col("_cut"), F.col("_cut")).alias("cut"), shard.alias("shard")).drop("_cut")


class DoubleArray:
    """A trie in two arrays: a child by symbol c of the node in slot s is in slot BASE[s] + c, and
    its CHECK is s. Symbols are 1 and up; slot 0 is the root.

    Children of a level are placed together: nodes with one child take the next free slots, those
    with more the first place where all their children fit.
    """

    def __init__(self, symbols: int):
        self.start = symbols + 1  # below are no slots, so that every BASE stays positive
        self.base, self.check = np.zeros(self.start, np.int64), np.full(self.start, -1, np.int64)
        self.next = self.end = self.start  # no slot before next is free, none from end on is used

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, len(self.check) + len(self.check) // 2)
            self.base = np.concatenate([self.base, np.zeros(more - len(self.base), np.int64)])
            self.check = np.concatenate([self.check, np.full(more - len(self.check), -1, np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """The first n free slots."""
        span = 4 * n + 256
        while True:
            self._grow(self.next + span)
            free = np.flatnonzero(self.check[self.next : self.next + span] < 0)[:n] + self.next
            if len(free) == n:
                return free
            span *= 4

    def _fit(self, steps: np.ndarray) -> int:
        """The first free slot from which all steps lead to free ones; after many tries, one behind all."""
        tries = 64
        while tries * len(steps) <= 1 << 20:
            starts = self._free(tries)
            self._grow(int(starts[-1] + steps[-1]) + 1)
            fit = np.flatnonzero((self.check[starts[:, None] + steps] < 0).all(1))
            if len(fit):
                return int(starts[fit[0]])
            tries *= 4
        self._grow(self.end + int(steps[-1]) + 1)
        return self.end

    def place(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Slots of new children (distinct pairs in order of parent and symbol, all of these parents' children)."""
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        many = np.diff(np.append(first, len(parents)))
        slots = np.zeros(len(parents), np.int64)
        for k in np.flatnonzero(many > 1).tolist():
            i, own = first[k], symbols[first[k] : first[k] + many[k]]
            steps = own - own[0]
            at = self._fit(steps)
            slots[i : i + many[k]] = at + steps
            self.check[at + steps] = parents[i]
            self.base[parents[i]] = at - own[0]
            self.end = max(self.end, int(at + steps[-1]) + 1)
        lone = first[many == 1]
        if len(lone):
            slots[lone] = self._free(len(lone))
            self.check[slots[lone]] = parents[lone]
            self.base[parents[lone]] = slots[lone] - symbols[lone]
            self.end = max(self.end, int(slots[lone[-1]]) + 1)
        while self.next < len(self.check) and self.check[self.next] >= 0:
            self.next += 1
        return slots

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of nodes by symbols; -1 where there is none."""
        to = self.base[nodes] + symbols
        ok = (to >= self.start) & (to < len(self.check))
        return np.where(ok & (self.check[np.where(ok, to, 0)] == nodes), to, -1)


def packed_trie(ids: np.ndarray, ends: np.ndarray, symbols: int) -> DoubleArray:
    """The trie of sequences ids[ends[i]:ends[i+1]] over dense ids from 1, built level by level."""
    trie, at = DoubleArray(symbols), np.zeros(len(ends) - 1, np.int64)
    size, depth = np.diff(ends), 0
    while True:
        on = np.flatnonzero(size > depth)
        if not len(on):
            return trie
        edges = at[on] * (symbols + 1) + ids[ends[on] + depth]
        new, of = np.unique(edges, return_inverse=True)
        at[on] = trie.place(new // (symbols + 1), new % (symbols + 1))[of]
        depth += 1


def shard_nodes(table: pa.Table) -> pa.Table:
    """Nodes of a shard's classes; those above the dealt prefixes with their path, as partial sums."""
    give_back()
    table = table.combine_chunks().sort_by("first")
    runs, cut = table.column("turns").to_pylist(), table.column("cut").to_numpy()
    size = np.array([len(r) // DIGEST for r in runs])
    ends = np.concatenate([[0], np.cumsum(size)])
    cut = np.where(np.isnan(cut.astype(float)), size + 1, cut).astype(np.int64)
    words = np.frombuffer(b"".join(table.column("words").to_pylist()), "<i8")
    n, first = table.column("n").to_numpy(), table.column("first").to_numpy()
    digests = np.frombuffer(b"".join(runs), np.dtype((np.void, DIGEST)))
    known, ids = np.unique(digests, return_inverse=True) if len(digests) else (digests, np.zeros(0, np.int64))
    ids = ids.ravel() + 1
    trie = packed_trie(ids, ends, len(known))
    slots = len(trie.check)
    n_convs, least, word, owner, depth_of = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max), np.zeros(slots, np.int64), np.full(slots, -1), np.zeros(slots, np.int64)
    top = np.zeros(slots, bool)  # shared with other shards
    end_of, above = np.full(slots, -1), np.full(slots, -1)
    at, levels, depth = np.zeros(len(runs), np.int64), [np.zeros(1, np.int64)], 0
    on = np.arange(len(runs))
    while len(on):
        node = at[on]
        np.add.at(n_convs, node, n[on])
        np.minimum.at(least, node, first[on])
        owner[node[::-1]] = on[::-1]  # any class that passes; the first of the shard here
        top[node] |= depth < cut[on]
        new = depth == cut[on]
        above[node[new]] = on[new]
        depth_of[node] = depth
        if depth:
            word[node] = words[ends[on] + depth - 1]
            levels.append(np.unique(node))
        stop = size[on] == depth
        end_of[node[stop]] = on[stop]
        on = on[~stop]
        at[on] = trie.step(at[on], ids[ends[on] + depth])
        depth += 1
    # sums over subtrees, from the deepest level up; shared nodes get those of the nodes that aren't
    parent = trie.check
    children, leaves, saved = np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for level in levels[::-1]:
        own = level[~top[level]]
        leaves[own] += children[own] == 0
        saved[own] += (n_convs[own] - 1) * word[own]
        if depth_of[level[0]]:
            np.add.at(children, parent[own], 1)
            np.add.at(leaves, parent[level], leaves[level])
            np.add.at(saved, parent[level], saved[level])
    nodes = np.concatenate(levels) if len(runs) else np.zeros(0, np.int64)
    shared = top[nodes]
    parent_conv = np.where(parent[nodes] >= 0, least[np.maximum(parent[nodes], 0)], -1)
    # a dealt prefix's parent is shared: its smallest member comes with the classes
    outer = above[nodes] >= 0
    given = table.column("above").to_pylist()
    parent_conv = [None if s else given[a] if o else p for s, o, a, p in zip(shared.tolist(), outer.tolist(), above[nodes].tolist(), parent_conv.tolist())]
    sha = table.column("ends").to_pylist()
    texts = [sha[e] if e >= 0 else NO_ENDS if not s else None for e, s in zip(end_of[nodes].tolist(), shared.tolist())]
    paths: list[list[bytes] | None] = []
    cached: tuple[int, list[bytes]] = (-1, [])
    for s, o, d in zip(shared.tolist(), owner[nodes].tolist(), depth_of[nodes].tolist()):
        if s and cached[0] != o:
            cached = (o, chain(runs[o]))
        paths.append(cached[1][: d + 1] if s else None)
    ints = lambda a: pa.array(a[nodes], pa.int64())
    return pa.table({
        "conv_id": ints(least), "depth": ints(depth_of), "parent_conv_id": pa.array(parent_conv, pa.int64()), "n_convs": ints(n_convs), "n_children": ints(children), "n_leaves": ints(leaves), "saved_tokens": ints(saved),
        "ends_sha256": pa.array(texts, pa.string()), "path": pa.array(paths, pa.list_(pa.binary())), "words": ints(word),
    })


def merged(shared: DataFrame) -> DataFrame:
    """Shared nodes over all shards, from partial sums.

    They are as many as prefixes heavier than a part of a shard, whatever the number of conversations.
    """
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = stored(shared.groupBy(F.element_at("path", -1).alias("key")).agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.max("ends_sha256").alias("ends"), F.first("path").alias("path"), F.first("words").alias("words")), "shared_nodes")
    above = nodes.where("depth > 0").groupBy(F.element_at("path", -2).alias("key")).agg(F.count(F.lit(1)).alias("more"))
    whole = nodes.join(above, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = whole.select(F.explode("path").alias("key"), (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("own")).groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    parents = nodes.select(F.col("key").alias("_up"), F.col("conv_id").alias("parent_conv_id"))
    full = whole.join(own, "key").withColumn("_up", F.when(F.col("depth") > 0, F.element_at("path", -2))).join(parents, "_up", "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def prefix_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS, heavy: int | None = None) -> DataFrame:
    """One row for each distinct prefix of the conversations (conv_id, array ``turns`` of digest and
    words): its smallest member and depth, its parent's smallest member, members, children,
    childless nodes below it, tokens saved below it, and the SHA-256 of the ids that end there.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    found = stored(classes(conversations), "classes")
    total = found.agg(F.coalesce(F.sum(F.octet_length("turns") / DIGEST), F.lit(0)).alias("n"), F.min("first").alias("least")).first()
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total.n) // shard_turns)
    if heavy is None:
        heavy = max(LEAST_HEAVY, int(total.n) // (2 * n_shards))
    # without a shared prefix above it, a node's parent is the root, whose smallest member is that of all
    placed = dealt(found, n_shards, heavy).withColumn("above", F.coalesce("above", F.lit(total.least).cast("bigint")))
    nodes = stored(placed.groupBy("shard").applyInArrow(shard_nodes, SHARED), "nodes")
    names = [c.strip().split(" ")[0] for c in NODE.split(",")]
    return nodes.where("path IS NULL").select(*names).unionByName(merged(nodes.where("path IS NOT NULL")))
