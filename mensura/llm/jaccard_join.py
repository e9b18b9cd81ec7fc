"""N-gram Jaccard join by a token-group matrix.

Tokens are hashes of word shingles. Documents are partitioned into groups of similar ones, and for
each group the union of its members' tokens is stored. A query can only match a member if its
overlap with the group's union reaches what its own size asks for; only such groups are opened
and their members compared one by one.

At scale the matrix is never laid out. How many documents hold a token is counted first: a
document in which too few tokens occur elsewhere has no partner, and the least frequent tokens of
the others (prefixes of a global order by count and hash) lead to the groups that can match.

Groups are made twice. First those of documents with one MinHash key, in parts of bounded size: each
is asked by one query, the key's leader, so that a class of copies of any size costs a pass over its
groups. Then the documents that can still have a partner in another component are grouped anew, and
all queries of a group ask every group that shares a prefix token and isn't wholly of their own
component. All links between different components are found, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import chunked, components, counts_in_order, give_back, hash_counts, known, mix, ordered_hashes, shingle_sets, stored

PERCENT = 75
LEADER_KEYS = 3
#: Members of a group, and tokens of all its members together, about; a longer document is alone.
GROUP_SIZE = 64
GROUP_TOKENS = 1 << 20
#: Groups of one token that meet all others in one task.
TOKEN_GROUPS = 256
_U = np.uint64


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = shingle_sets(data, offsets)
    return (np.concatenate(own) if own else np.zeros(0, _U)), np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int64)


def parts() -> Column:
    """Into how many groups the rows of a key go, by their number and by their tokens (an aggregate)."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_SIZE), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("parts")


def united(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A group's matrix: the union of its members' tokens, and for each member in turn the columns
    of its own tokens, with their bounds (members + 1)."""
    own = [np.frombuffer(t, _U) for t in sets]
    union, places = np.unique(np.concatenate(own), return_inverse=True)
    return union, places.astype(np.int32), np.cumsum([0, *map(len, own)])


def opened_by(query: np.ndarray, n: int, columns: int, ns: np.ndarray, places: np.ndarray, cuts: np.ndarray, percent: int) -> np.ndarray:
    """Members that a query of ``n`` tokens links with; ``query`` holds those in the group's union, as columns.

    If they are too few for any link the group stays closed. Else one pass over the matrix sums up
    the query's columns for all members.
    """
    if 100 * len(query) < percent * n:
        return np.zeros(0, np.int64)
    asked = np.zeros(columns, bool)
    asked[query] = True
    overlap = np.add.reduceat(asked[places], cuts[:-1], dtype=np.int64)
    return np.flatnonzero(100 * overlap >= percent * (n + ns - overlap))


def token_sets(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """One row per input row: id, n (distinct shingles), and for documents that can have a partner
    tokens (their sorted shingle hashes that other documents have too), prefix and keys."""
    chunks, n_chunks = chunked(docs, id_col, text_col)
    counts = hash_counts(chunks, n_chunks, _sets)

    def read(table: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        table = known(table)
        hashes, owner, order = ordered_hashes(table, _sets)
        count = np.zeros(len(hashes), np.uint8)
        if len(hashes):
            count[order] = counts_in_order(answers)
        n_known = len(table) - table.column("id").null_count
        bounds = np.searchsorted(owner, np.arange(n_known + 1)).tolist()
        sizes, tokens, prefixes, keys = [], [], [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            n, shared = b - a, count[a:b] >= 2
            sizes.append(n)
            own = hashes[a:b][shared]
            if not n or 100 * len(own) < percent * n:
                tokens.append(None), prefixes.append(None), keys.append(None)
                continue
            length = n - -(-percent * n // 100) + 1 - (n - len(own))
            first = np.lexsort([own, count[a:b][shared]])[:length]
            tokens.append(own.tobytes())
            prefixes.append(own[first].view(np.int64).tolist())
            keys.append([int(mix(own, 77 + k).min().view(np.int64)) for k in range(LEADER_KEYS)])
        left_over = table.slice(n_known).column("text").to_pylist()
        empty = [None] * len(left_over)
        sizes += [len(shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]) for t in left_over]
        return pa.table({"id": table.column("id"), "n": pa.array(sizes, pa.int64()), "tokens": pa.array(tokens + empty, pa.binary()), "prefix": pa.array(prefixes + empty, pa.list_(pa.int64())), "keys": pa.array(keys + empty, pa.list_(pa.int64()))})

    return chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(read, "id bigint, n bigint, tokens binary, prefix array<bigint>, keys array<bigint>")


def _leader_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links that the leaders of MinHash keys have with the members of their keys' groups.

    The leader is the document with the fewest shingles of its own, then the least id: of a text and
    its edited copies it is the text, to which they are closer than to one another. It goes along in
    each group of its key as the query, and is no member there.
    """
    keyed = sets.select("id", "n", (F.col("n") - F.octet_length("tokens") / 8).alias("own"), F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min(F.struct("own", "id")).alias("first"), F.count(F.lit(1)).alias("many"), parts()).where("many > 1").select("key", F.col("first.id").alias("leader"), "parts")
    # stored, so that the join's sides are a scan or plain shuffles: small ones are broadcast, hot keys split
    leaders = stored(leaders, "leaders")
    pairs = keyed.select("id", "key").join(leaders, "key").where("id <> leader").groupBy("id", "leader").agg(F.max("parts").alias("parts"))
    part = F.xxhash64("leader", "parts", F.pmod(F.xxhash64("id"), F.col("parts")))
    member = pairs.select("id", "leader", part.alias("group"))
    placed = stored(member.select("id", "group", F.lit(False).alias("asks")).union(member.select("leader", "group", F.lit(True)).distinct()), "placed")
    groups = placed.join(sets.select("id", "n", "tokens"), "id").groupBy("group").agg(F.collect_list(F.struct("asks", "id", "n", "tokens")).alias("rows")).select("rows")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for rows in batch.column(0):
                rows = rows.as_py()
                queries, members = [r for r in rows if r["asks"]], [r for r in rows if not r["asks"]]
                union, places, cuts = united([r["tokens"] for r in members])
                ns = np.array([r["n"] for r in members])
                for q in queries:
                    own = np.searchsorted(union, np.intersect1d(union, np.frombuffer(q["tokens"], _U), True))
                    for i in opened_by(own, q["n"], len(union), ns, places, cuts, percent).tolist():
                        a.append(members[i]["id"]), b.append(q["id"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.mapInArrow(ask, "a bigint, b bigint")


def _group_links(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All links between documents of different components, through the token-group matrix."""
    # stored, so that both sides of the join come from a shuffle and a large component can be split
    sizes = stored(labels.groupBy("component").agg(F.count(F.lit(1)).alias("many")), "sizes")
    placed = labels.join(sizes, "component")
    rows = sets.join(placed, "id", "left").withColumns({"component": F.coalesce("component", "id"), "many": F.coalesce("many", F.lit(1))})
    shared = (
        rows.select(F.explode("prefix").alias("token"), "component").groupBy("token")
        .agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    )
    met = stored(rows.select(F.explode("prefix").alias("token"), "id", "component").join(shared, "token"), "postings")
    # only documents that meet another component take part; of these the groups are made
    active = met.select("id").distinct()
    band = F.floor(F.log("n") / np.log(100 / percent))  # two that link are at most one band apart
    whole = F.struct(band, F.when(F.col("many") > 1, F.col("component")), F.when(F.col("many") <= 1, F.col("keys")[0]))
    taking = rows.join(active, "id").select("id", "n", "tokens", "component", F.xxhash64(whole).alias("kind"))
    kinds = stored(taking.groupBy("kind").agg(parts()), "kinds")
    grouped = stored(
        taking.join(kinds, "kind").select("id", "n", "tokens", "component", F.xxhash64("kind", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("group")), "groups"
    )
    placed_met = met.join(grouped.select("id", "group", "n").distinct(), "id")
    of_token = stored(placed_met.groupBy("token", "group").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")), "matrix")
    # a frequent token's groups meet one another in several parts, by the asking group
    often = stored(of_token.groupBy("token").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > TOKEN_GROUPS).select("token", F.ceil(F.col("many") / TOKEN_GROUPS).cast("int").alias("parts")), "frequent")
    parted = of_token.join(often, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    ask = parted.select("token", F.pmod(F.xxhash64("group"), F.col("parts")).cast("int").alias("part"), *[F.col(c).alias(f"q_{c}") for c in ("group", "low", "high", "least", "most")])
    asked_of = parted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    sized = (F.col("q_least") * percent <= F.col("most") * 100) & (F.col("least") * percent <= F.col("q_most") * 100)
    apart = (F.least("low", "q_low") < F.greatest("high", "q_high")) & (F.col("q_group") <= F.col("group"))
    opened = ask.join(asked_of, ["token", "part"]).where(apart & sized).select("q_group", "group").distinct()

    def unite(table: pa.Table) -> pa.Table:
        union, places, cuts = united(table.column("tokens").to_pylist())
        one = lambda v, t: pa.array([v], t)
        ints = pa.list_(pa.int64())
        return pa.table({"group": one(table.column("group")[0].as_py(), pa.int64()), "ids": one(table.column("id").to_pylist(), ints), "ns": one(table.column("n").to_pylist(), ints), "components": one(table.column("component").to_pylist(), ints), "cuts": one(cuts.tolist(), ints), "places": one(places.tobytes(), pa.binary()), "union": one(union.tobytes(), pa.binary())})

    columns = ("ids", "ns", "components", "cuts", "places", "union")
    matrix = stored(grouped.groupBy("group").applyInArrow(unite, "group bigint, ids array<bigint>, ns array<bigint>, components array<bigint>, cuts array<bigint>, places binary, union binary"), "groups")
    left = matrix.select(F.col("group").alias("q_group"), *[F.col(c).alias(f"q_{c}") for c in columns])
    asked = opened.join(left, "q_group").join(matrix, "group").select(*[f"q_{c}" for c in columns], *columns)

    def open_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in range(len(batch)):
                for q, other in _compare(*(c[row].as_py() for c in batch.columns), percent):
                    a.append(q), b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return asked.mapInArrow(open_groups, "a bigint, b bigint")


def _compare(q_ids, q_ns, q_comps, q_cuts, q_places, q_union, ids, ns, comps, cuts, places, union, percent) -> Iterator[tuple[int, int]]:  # noqa: ANN001
    """Links between the members of two groups that lie in different components, greater component first.

    The second group is a matrix of members by the tokens of its union; each member of the first
    one asks it.
    """
    union, q_union = np.frombuffer(union, _U), np.frombuffer(q_union, _U)
    column = np.minimum(np.searchsorted(union, q_union), len(union) - 1)
    common = union[column] == q_union
    ns, comps, cuts = np.array(ns), np.array(comps), np.array(cuts)
    places, q_places = np.frombuffer(places, np.int32), np.frombuffer(q_places, np.int32)
    for k, (q, n, c) in enumerate(zip(q_ids, q_ns, q_comps)):
        own = q_places[q_cuts[k] : q_cuts[k + 1]]
        found = opened_by(column[own[common[own]]], n, len(union), ns, places, cuts, percent)
        for i in found[comps[found] != c].tolist():
            yield (q, ids[i]) if c > comps[i] else (ids[i], q)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    A document's set is that of its distinct five-word shingles (A-Z lower-cased, words parted by
    ASCII white space; with fewer words the whole sequence is one). Two documents link when
    100 * |A and B| >= percent * |A or B|; component_id is the least id that links reach. A
    document without words, or with a null text, has no shingle and links with nothing. Rows with
    a null id are counted but link with nothing; their component_id is null. Rows of one id are
    one document as far as links go. Other columns aren't read; an empty table gives no rows.
    Ids are integers.
    """
    sets = stored(token_sets(docs, id_col, text_col, percent), "sets")
    able = sets.where("tokens IS NOT NULL")
    near = stored(_leader_links(able, percent), "links")
    labels = components(near)
    far = stored(_group_links(able, labels, percent), "links")
    if far.limit(1).count():
        roots = labels.select("id", "component")
        joined = far.join(roots.withColumnsRenamed({"id": "a", "component": "ca"}), "a", "left").join(roots.withColumnsRenamed({"id": "b", "component": "cb"}), "b", "left")
        merged = components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        to = merged.select(F.col("id").alias("component"), F.col("component").alias("root"))
        singles = merged.select("id", "component")
        labels = labels.join(to, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        labels = stored(labels.union(singles).groupBy("id").agg(F.min("component").alias("component")), "labels")
    return sets.select("id", "n").join(labels, "id", "left").select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").cast(docs.schema[id_col].dataType).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its class (or null), all columns unchanged."""
    found = near_duplicates(docs, percent, id_col, text_col)
    dropped = stored(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_dropped")).distinct(), "dropped")
    return docs.join(dropped, docs[id_col] == F.col("_dropped"), "left_anti")
