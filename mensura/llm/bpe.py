"""Byte-level BPE: encoding by segment trees over byte positions, and decoding.

A text is cut by a pattern into pieces; each piece is merged on its own. Over the byte positions
of a piece stands a segment tree whose leaf i holds the rank of the pair that begins at i, and
whose inner nodes hold the least (rank, position) below them, so the root is the leftmost pair of
least rank. A merge changes three leaves (the pair itself, its live left neighbour, and the
swallowed position), each a point update along one path to the root. Pieces of one size class
are merged side by side: their trees are rows of one numpy array. Longer pieces have a tree each;
very long ones hold it in flat arrays and merge the places of the least rank together.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import strings

#: Chunks kept with their ids in each Python worker, and pieces merged side by side.
CACHE_CHUNKS = 700_000
SIDE_BY_SIDE = 1 << 14
#: Unicode's White_Space characters (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: The split pattern of the byte-level vocabularies that came first (a fixed value).
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A run of other characters with one space before it, or white space up to such a run. Every
#: match of that pattern lies inside one of these, so chunks can be encoded one by one.
CHUNKS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

_NONE = np.int64(1) << 60
#: The same in 32-bit trees; pieces over so many bytes are merged in flat arrays, so many places at once at most.
_FAR = np.int32(2**31 - 1)
LONG, AT_ONCE = 1 << 18, 1 << 20


class Ranks:
    """A rank file: bytes by id, and the rank of each pair of ids whose bytes join to a token."""

    def __init__(self, content: bytes):
        self.id_of = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.text_of = {str(i): b for b, i in self.id_of.items()}
        if any(bytes([b]) not in self.id_of for b in range(256)):
            raise ValueError("a byte-level rank file has all 256 bytes")
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        found: dict[tuple[int, int], int] = {}
        for token, rank in self.id_of.items():
            for cut in range(1, len(token)):
                left, right = self.id_of.get(token[:cut]), self.id_of.get(token[cut:])
                if left is not None and right is not None:
                    found[left, right] = rank
        self.pairs = found
        self._fill(np.array([a << 32 | b for a, b in found], np.uint64), np.array(list(found.values()), np.int64))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table with linear probing, filled a probe at a time."""
        bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, np.uint64(2**64 - 1), np.uint64)
        self._values = np.full(1 << bits, _NONE, np.int64)
        at = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)
        while len(keys):
            free = self._keys[at] == np.uint64(2**64 - 1)
            self._keys[at[free]] = keys[free]
            here = self._keys[at] == keys
            self._values[at[here]] = values[here]
            keys, values, at = keys[~here], values[~here], (at[~here] + 1) & self._mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, _NONE where the pair doesn't merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)
        out = self._values[at]
        there = self._keys[at]
        left_over = np.flatnonzero((there != keys) & (there != np.uint64(2**64 - 1)))
        out[there != keys] = _NONE
        while len(left_over):
            at = (at[left_over] + 1) & self._mask if len(at) != len(left_over) else (at + 1) & self._mask
            there, wanted = self._keys[at], keys[left_over]
            hit = there == wanted
            out[left_over[hit]] = self._values[at[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            left_over, at = left_over[on], at[on]
        return out

    def merge_rows(self, data: np.ndarray, lengths: np.ndarray, leaves: int) -> list[list[int]]:
        """Ids of many pieces of at most ``leaves`` bytes; data: [pieces, leaves] bytes."""
        n = len(lengths)
        width = leaves + 2  # the last two columns stand for "no neighbour"
        place = np.arange(leaves)
        ids = np.zeros((n, width), np.int64)
        ids[:, :leaves] = self.byte_ids[data]
        after = np.full((n, width), leaves, np.int64)
        after[:, :leaves] = np.where(place + 1 < lengths[:, None], place + 1, leaves)
        before = np.full((n, width), leaves + 1, np.int64)
        before[:, 1:leaves] = place[:-1]
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        real = place[None, :-1] + 1 < lengths[:, None]
        rank = np.full((n, leaves - 1), _NONE, np.int64)
        rank[real] = self.ranks(ids[:, : leaves - 1][real], ids[:, 1:leaves][real])
        tree[:, leaves : 2 * leaves - 1] = np.where(rank < _NONE, rank * leaves + place[:-1], _NONE)
        level = leaves
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        alive = place < lengths[:, None]
        ids_f, after_f, before_f, tree_f, alive_f = ids.ravel(), after.ravel(), before.ravel(), tree.ravel(), alive.ravel()
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            top = tree[rows, 1]
            pos = top % leaves
            own, at, leaf = rows * width, rows * leaves, rows * 2 * leaves
            gone = after_f[own + pos]
            then = after_f[own + gone]
            prior = before_f[own + pos]
            merged = top // leaves
            ids_f[own + pos] = merged
            after_f[own + pos] = then
            before_f[own + then] = pos  # writes to a "no neighbour" column where there is none
            alive_f[at + gone] = False
            tree_f[leaf + leaves + gone] = _NONE
            new = np.full(len(rows), _NONE, np.int64)
            on = then < leaves
            r = self.ranks(merged[on], ids_f[(own + then)[on]])
            new[on] = np.where(r < _NONE, r * leaves + pos[on], _NONE)
            tree_f[leaf + leaves + pos] = new
            on = prior < leaves
            r = self.ranks(ids_f[(own + prior)[on]], merged[on])
            tree_f[(leaf + leaves + prior)[on]] = np.where(r < _NONE, r * leaves + prior[on], _NONE)
            nodes = (pos + leaves, gone + leaves, np.where(prior < leaves, prior, pos) + leaves)
            while int(nodes[0][0]) > 1:
                nodes = tuple(x >> 1 for x in nodes)
                for x in nodes:
                    tree_f[leaf + x] = np.minimum(tree_f[leaf + 2 * x], tree_f[leaf + 2 * x + 1])
            rows = rows[tree[rows, 1] < _NONE]
        flat, counts = ids[:, :leaves][alive].tolist(), np.concatenate([[0], np.cumsum(alive.sum(1))]).tolist()
        return [flat[a:b] for a, b in zip(counts[:-1], counts[1:])]

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one long piece, by a tree of its own."""
        n = len(piece)
        leaves = 1 << (n - 1).bit_length()
        none = (1 << 62, 0)
        ids = [int(self.byte_ids[b]) for b in piece]
        after, before, pairs = [*range(1, n), -1], [*range(-1, n - 1)], self.pairs
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            r = pairs.get((ids[i], ids[i + 1]))
            if r is not None:
                tree[leaves + i] = (r, i)
        for x in range(leaves - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def put(i: int, value: tuple[int, int]) -> None:
            x = leaves + i
            tree[x] = value
            x >>= 1
            while x:
                least = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == least:
                    break
                tree[x] = least
                x >>= 1

        gone_at = bytearray(n)
        while tree[1] != none:
            rank, i = tree[1]
            gone = after[i]
            then, prior = after[gone], before[i]
            ids[i], after[i], gone_at[gone] = rank, then, 1
            put(gone, none)
            r = None
            if then >= 0:
                before[then] = i
                r = pairs.get((rank, ids[then]))
            put(i, none if r is None else (r, i))
            if prior >= 0:
                r = pairs.get((ids[prior], rank))
                put(prior, none if r is None else (r, prior))
        return [x for x, g in zip(ids, gone_at) if not g]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of a piece of any length, by a tree of its own, held in flat arrays of some 21 bytes a byte.

        The tree holds ranks; its root is the least, and the places that have it are found from the
        left. They are merged together as long as that is what merging one after the other gives:
        until a merge makes a pair of lesser rank, which then comes first.
        """
        n = len(piece)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].astype(np.int32)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        tree = [np.full(n, _FAR, np.int32)]  # from the leaves to the root; a level of odd length has a last node with one child
        for a in range(0, n - 1, AT_ONCE):
            b = min(n - 1, a + AT_ONCE)
            tree[0][a:b] = np.minimum(self.ranks(ids[a:b], ids[a + 1 : b + 1]), _FAR)
        while len(tree[-1]) > 1:
            below = tree[-1]
            up = below[::2].copy()
            np.minimum(up[: len(below) // 2], below[1::2], out=up[: len(below) // 2])
            tree.append(up)
        alive = np.ones(n, bool)

        def put(at: np.ndarray, values: np.ndarray) -> None:
            """Point updates of places in ascending order, their paths joined where they meet."""
            tree[0][at] = values
            for below, level in zip(tree, tree[1:]):
                at = at >> 1
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                left = 2 * at
                level[at] = np.minimum(below[left], below[np.minimum(left + 1, len(below) - 1)])

        while (rank := int(tree[-1][0])) < _FAR:
            at = np.zeros(1, np.int64)
            for level in tree[-2::-1]:
                at = np.stack([2 * at, 2 * at + 1], 1).ravel()
                at = at[at < len(level)]
                at = at[level[at] == rank][:AT_ONCE]
            gone = after[at].astype(np.int64)
            if len(at) > 1 and (gone[:-1] == at[1:]).any():  # of a chain of such pairs every other one is merged
                starts = np.concatenate([[True], gone[:-1] != at[1:]])
                first = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                kept = (np.arange(len(at)) - first) % 2 == 0
                at, gone = at[kept], gone[kept]
            then, prior = after[gone].astype(np.int64), before[at].astype(np.int64)
            merged_before = np.concatenate([[False], then[:-1] == at[1:]])  # whose left neighbour is merged as well
            left_ids = np.where(merged_before, rank, ids[np.maximum(prior, 0)])
            right_ids = ids[np.minimum(then, n - 1)]
            new = np.full(len(at), rank, np.int64)
            left_ranks = np.where((prior >= 0) | merged_before, self.ranks(left_ids, new), _NONE)
            right_ranks = np.where(then < n, self.ranks(new, right_ids), _NONE)
            lesser = np.flatnonzero((left_ranks < rank) | (right_ranks < rank))
            m = int(lesser[0]) + 1 if len(lesser) else len(at)
            at, gone, then, prior, merged_before = at[:m], gone[:m], then[:m], prior[:m], merged_before[:m]
            left_ranks, right_ranks = left_ranks[:m], right_ranks[:m].copy()
            ids[at], after[at], alive[gone] = rank, then, False
            on = then < n
            before[then[on]] = at[on]
            right_ranks[:-1] = np.where(merged_before[1:], left_ranks[1:], right_ranks[:-1])
            left = np.where(merged_before, -1, prior)  # such a neighbour's pair is among the right ones
            places = np.concatenate([left[left >= 0], at, gone])
            values = np.concatenate([left_ranks[left >= 0], right_ranks, np.full(m, _FAR)])
            order = np.argsort(places, kind="stable")
            put(places[order], np.minimum(values[order], _FAR).astype(np.int32))
        return ids[alive]

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, list[int] | np.ndarray]:
        """Ids of each distinct piece."""
        out: dict[bytes, list[int] | np.ndarray] = {}
        classes: dict[int, list[bytes]] = {}
        for piece in pieces:
            whole = self.id_of.get(piece)
            if whole is not None:
                out[piece] = [whole]
            elif len(piece) > 64:
                out[piece] = self.merge_long(piece) if len(piece) > LONG else self.merge_one(piece)
            elif piece:
                classes.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(piece)
        for leaves, own in classes.items():
            for i in range(0, len(own), SIDE_BY_SIDE):
                part = own[i : i + SIDE_BY_SIDE]
                data = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in part), np.uint8).reshape(-1, leaves)
                out.update(zip(part, self.merge_rows(data, np.array([len(p) for p in part]), leaves)))
        return out


def in_decimal(ids: list[int] | np.ndarray) -> str:
    """Decimal ids joined by one space, made a block at a time."""
    return " ".join(" ".join(map(str, ids[a : a + LONG])) for a in range(0, len(ids), LONG))


def id_blocks(decimal: str) -> Iterator[list[str]]:
    """The ids of such a string, in lists of bounded length."""
    start = 0
    while start < len(decimal):
        end = decimal.find(" ", start + 4 * LONG)
        end = len(decimal) if end < 0 else end
        yield decimal[start:end].split(" ")
        start = end + 1


@functools.lru_cache(maxsize=2)
def ranks_of(content: bytes) -> Ranks:
    return Ranks(content)


class Encoder:
    """Texts to ids; chunks seen before are looked up.

    With GPT2_PATTERN a text is cut in CHUNKS first, with any other pattern in its own matches.
    What is kept for a chunk are its ids as decimal strings joined by one space (form ``decimal``),
    or as little-endian 32-bit integers (``binary``).
    """

    def __init__(self, ranks: Ranks, pattern: str, form: str = "decimal"):
        self.ranks, self.pattern, self.decimal, self.seen = ranks, regex.compile(pattern), form == "decimal", {}
        self.in_chunks = pattern == GPT2_PATTERN

    def _cut(self, text: str) -> list[str]:
        return CHUNKS.findall(text) if self.in_chunks else [m[0] for m in self.pattern.finditer(text)]

    def _learn(self, new: list[str]) -> None:
        parts = {c: [p.encode() for p in self.pattern.findall(c)] if self.in_chunks else [c.encode()] for c in new}
        ids = self.ranks.encode_pieces(list({p for own in parts.values() for p in own}))
        if self.decimal:
            written = {p: in_decimal(x) for p, x in ids.items()}
            self.seen.update({c: " ".join([written[p] for p in own]) for c, own in parts.items()})
        else:
            kept = {p: np.array(x, "<i4").tobytes() for p, x in ids.items()}
            self.seen.update({c: b"".join([kept[p] for p in own]) for c, own in parts.items()})

    def encode(self, texts: list[str]) -> Iterator[str | bytes]:
        cut = [self._cut(t) for t in texts]
        if len(self.seen) > CACHE_CHUNKS:
            self.seen = {}
        new = set()
        for chunks in cut:
            new.update(chunks)
        new -= self.seen.keys()
        if new:
            self._learn(list(new))
        get, joint = self.seen.__getitem__, " " if self.decimal else b""
        for chunks in cut:
            yield joint.join(map(get, chunks))


_encoders: dict[tuple[int, str, str], Encoder] = {}


def encoder_for(content: bytes, pattern: str, form: str = "decimal") -> Encoder:
    """One encoder, with its cache, for each Python worker."""
    ranks = ranks_of(content)
    return _encoders.get((id(ranks), pattern, form)) or _encoders.setdefault((id(ranks), pattern, form), Encoder(ranks, pattern, form))


def read_ranks(path: str) -> bytes:
    """The rank file on the driver; its size is the vocabulary's, a million bytes or so."""
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array of int, in text order) and n_tokens.

    Whole texts, no special tokens; a null or empty text has no ids, and what the pattern doesn't
    match is dropped, as the tiktoken library does. Every row is encoded on its own, so ties, repeated rows and null ids are carried through. Other columns aren't read.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(content.value, pattern, "binary")
        for whole in batches:
            for start in range(0, len(whole), 250):
                batch = whole.slice(start, 250)
                own = list(encoder.encode(strings(batch.column(1)).to_pylist()))
                ends = np.cumsum([0, *(len(x) // 4 for x in own)])
                values = pa.array(np.frombuffer(b"".join(own), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(np.diff(ends), pa.int64())], ["id", "ids", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens bigint").withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and decoded (binary), the bytes of the ids joined; null ids give none."""
    content = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks_of(content.value).bytes_of
        for batch in batches:
            out = [b"".join([table[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

    kind = tokens.schema[id_col].dataType.simpleString()
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text; per row id, n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the bytes that the
    ids decode to. Nulls and empty texts: no ids, the digests of nothing.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(content.value, pattern)
        table = encoder.ranks.text_of.__getitem__
        for whole in batches:
            for start in range(0, len(whole), 250):
                batch = whole.slice(start, 250)
                counts, ids_sha, text_sha = [], [], []
                for s in encoder.encode(strings(batch.column(1)).to_pylist()):
                    n, back = 0, hashlib.sha256()
                    for ids in id_blocks(s):
                        n += len(ids)
                        back.update(b"".join(map(table, ids)))
                    counts.append(n)
                    ids_sha.append(hashlib.sha256(s.encode()).hexdigest())
                    text_sha.append(back.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
