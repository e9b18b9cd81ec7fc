"""Interpolated modified Kneser-Ney bigram model, counted and applied over chunks of documents.

Texts become chunks once: a chunk's distinct words as hashes and its tokens as places in that list.
Every chunk sends its distinct words and bigrams, as hashes with their counts among the texts to
learn from, in blocks by leading bits. The blocks of a bucket become one sorted hash array in a
memory-mapped file, from which each is answered; one chunk is told of each bigram that it answers for
it, and sends how many bigrams its words start and end. A second round of buckets sums these, and
chunks score their texts from both answers. Keys travel once for each chunk that has them, so the
most frequent words cost no more than others, and no task holds more than a bucket or a chunk.

The order is two. Hashes are of 64 bits, one of them for the kind; keys that collide, expected among
some 10**9 of them, have their counts added.

Texts that are null or empty have the end token alone. Rows are scored one by one, whatever their
ids; repeated rows count each. A null id counts as an empty text for the fold. Without a text to
learn from every token has probability 1 (the unknown word). Other columns are not looked at. A very
long text is worked on in parts.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import SPACE, bounded_batches, bucket_number, give_back, mix, parts_for, parts_of, raw, slices, stored, word_hashes

_U = np.uint64
#: Bytes of text in a chunk.
CHUNK_BYTES = 4 << 20
#: Stand for the start and the end of a text; words' own hashes have the same form.
START, END = (int(mix(np.array([k], _U))[0]) & ~1 for k in (0x57A27, 0xE2D))
CHUNK = "chunk bigint, words binary, tokens binary, learn binary, sizes binary, befores binary, row array<bigint>, doc_id array<bigint>, learnt boolean, n_learn bigint"
SCORES = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers by byte planes, compressed; ascending ones are better given as differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def ascending(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=_U(0)))


def read_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=_U)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, the end after each text, and their numbers."""
    words, at = word_hashes(data, offsets)
    return np.insert(words & ~_U(1), at[1:], _U(END)), np.diff(at) + 1


class Chunk:
    """A stored chunk: its distinct words (start and end among them), tokens and distinct bigrams."""

    def __init__(self, row: dict):
        self.words = read_ascending(row["words"])
        self.tokens = unpack(row["tokens"]).astype(np.int64)
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        befores, learn = unpack(row["befores"]).astype(np.int64), unpack(row["learn"]).astype(bool)
        before = np.concatenate([[0], self.tokens[:-1]]) if len(self.tokens) else self.tokens
        at = np.cumsum(self.sizes) - self.sizes
        before[at[self.sizes > 0]] = befores[self.sizes > 0]
        codes, self.bigram = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        self.first, self.second = codes // len(self.words), codes % len(self.words)
        self.learnt = np.repeat(learn, self.sizes)
        self.n_start = int((learn & (befores == np.searchsorted(self.words, _U(START)))).sum())

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of words and bigrams in ascending order, the order itself, and counts among the texts to learn from."""
        pairs = mix(mix(self.words[self.first], 7) + self.words[self.second] * _U(0x9E3779B97F4A7C15)) | _U(1)
        own = np.bincount(self.tokens[self.learnt], minlength=len(self.words))
        own[np.searchsorted(self.words, _U(START))] = self.n_start
        every = np.concatenate([self.words, pairs])
        order = np.argsort(every, kind="stable")
        return every[order], order, np.concatenate([own, np.bincount(self.bigram[self.learnt], minlength=len(pairs))])[order]


def chunks_of(docs: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    """Chunks of whole partitions' texts, about CHUNK_BYTES each, stored; later steps read only these."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n_rows, n_chunks = TaskContext.get().partitionId() << 32, 0, 0
        tokens: list[np.ndarray] = []
        parts: list[tuple[int, int | None, bool, int, int]] = []  # row, id, learnt, tokens, hash before
        size = 0

        def chunk() -> pa.RecordBatch:
            nonlocal n_chunks, tokens, parts, size
            every = np.concatenate(tokens)
            befores = np.array([p[4] for p in parts], _U)
            words = np.unique(np.concatenate([every, befores, np.array([START, END], _U)]))
            row = {
                "chunk": base + n_chunks, "words": ascending(words), "tokens": pack(np.searchsorted(words, every)), "learn": pack(np.array([p[2] for p in parts])), "sizes": pack(np.array([p[3] for p in parts])),
                "befores": pack(np.searchsorted(words, befores)), "row": [p[0] for p in parts], "doc_id": [p[1] for p in parts], "learnt": any(p[2] for p in parts), "n_learn": sum(p[2] and p[4] == START for p in parts),
            }
            n_chunks, tokens, parts, size = n_chunks + 1, [], [], 0
            kinds = [pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], list(row))

        for b in batches:
            data, offsets = raw(b.column("text"))
            ids, learns = b.column("id").to_pylist(), b.column("learn").to_pylist()
            for i, j in slices(offsets):
                own = data[offsets[i] : offsets[j]]
                if j == i + 1 and len(own) > CHUNK_BYTES:  # one long text, in parts that know the word before
                    before, at = START, list(parts_of(own, ~SPACE, CHUNK_BYTES))
                    for a, z in at:
                        words, _ = word_hashes(own[a:z], np.array([0, z - a]))
                        words = words & ~_U(1)
                        if z == len(own):
                            words = np.append(words, _U(END))
                        tokens.append(words)
                        parts.append((base + n_rows, ids[i], learns[i], len(words), before))
                        before = int(words[-1]) if len(words) else before
                        size += z - a
                        if size >= CHUNK_BYTES:
                            yield chunk()
                    n_rows += 1
                    continue
                words, sizes = tokens_of(own, offsets[i : j + 1] - offsets[i])
                tokens.append(words)
                parts += [(base + n_rows + k, ids[i + k], learns[i + k], n, START) for k, n in enumerate(sizes.tolist())]
                n_rows += j - i
                size += len(own) + 8 * (j - i)
                if size >= CHUNK_BYTES:
                    yield chunk()
        if parts:
            yield chunk()
        give_back()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return stored(rows.mapInArrow(cut, CHUNK), "model_chunks")


# ---- hash arrays ---------------------------------------------------------------------------


class HashArray:
    """Sorted distinct keys and the sums of their values (one or more columns), memory-mapped.

    The file is the worker's own and has no name any more once it is mapped.
    """

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray]):
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(every[order]) != 0])) if len(every) else np.zeros(0, np.int64)
        many, wide = len(first), values[0].shape[1]
        with tempfile.TemporaryFile() as f:
            f.truncate(max(1, 8 * many * (1 + wide)))
            self.keys = np.memmap(f, _U, "r+", 0, (many,)) if many else np.zeros(0, _U)
            self.values = np.memmap(f, np.int64, "r+", 8 * many, (many, wide)) if many else np.zeros((0, wide), np.int64)
        if many:
            self.keys[:] = every[order][first]
            self.values[:] = np.add.reduceat(np.concatenate(values)[order], first, axis=0)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.keys, keys)]


def dealt(keys: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """Buckets of ascending keys and their places."""
    filled, cuts = np.unique(np.searchsorted(edges, keys, "right"), return_index=True)
    return filled, [slice(i, j) for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)])]


def counts_of_counts(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4, how many are above 0, and their sum."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts > 0).sum()), int(counts.sum())]


TOTALS = ("n1", "n2", "n3", "n4", "n", "total")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 and more by the modified rule; halves of the counts where it isn't defined."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    d = [k - (k + 1) * y * b / a if a and b else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(x if 0 < x < k else k / 2 for k, x in zip((1, 2, 3), d))


def discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


def scored(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every text by a model of those where ``learn`` is true.

    Columns: doc_id, held_out, n_tokens and n_known (tokens that the learnt texts have), train_tokens,
    base_score (unigrams with one added) and score, both log10 probabilities, and perplexity.
    """
    bounded_batches(docs.sparkSession)
    chunks = chunks_of(docs, learn, id_col, text_col)
    n_buckets = bucket_number(parts_for(docs, CHUNK_BYTES, text_col))
    edges = np.arange(1, n_buckets, dtype=_U) * _U((1 << 64) // n_buckets)
    totals_of = lambda df: df.where("chunk IS NULL").groupBy("kind").agg(*[F.sum(F.col("totals")[k]).alias(c) for k, c in enumerate(TOTALS)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                keys, _, counts = Chunk(row).keys()
                filled, at = dealt(keys, edges)
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(at), pa.int64()), pa.array(filled.astype(np.int32)), pa.array([ascending(keys[s]) for s in at], pa.binary()), pa.array([pack(counts[s]) for s in at], pa.binary())], ["chunk", "bucket", "keys", "counts"])
            give_back()

    def count(table: pa.Table) -> pa.Table:
        """Answers each block with twice its keys' counts, plus one where the block answers for the key."""
        give_back()
        blocks = [read_ascending(k) for k in table.column("keys").to_pylist()]
        array = HashArray(blocks, [unpack(c).astype(np.int64)[:, None] for c in table.column("counts").to_pylist()])
        free, out = np.ones(len(array.keys), bool), []
        for keys in blocks:
            at = np.searchsorted(array.keys, keys)
            out.append(pack(array.values[at, 0] * 2 + free[at]))
            free[at] = False
        sums = [counts_of_counts(array.values[(array.keys & _U(1)) == k, 0]) for k in (0, 1)]
        n, bucket = len(out), table.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array([*table.column("chunk").to_pylist(), None, None], pa.int64()), "bucket": pa.array([bucket] * (n + 2), pa.int32()), "kind": pa.array([0] * n + [0, 1], pa.int32()), "answer": pa.array([*out, None, None], pa.binary()), "totals": pa.array([None] * n + sums, pa.list_(pa.int64()))})

    def joined(answers: pa.Table, kind: int = 0) -> np.ndarray:
        rows = sorted((b, a) for b, k, a in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "answer"))) if k == kind)
        return np.concatenate([unpack(a) for _, a in rows]).astype(np.int64)

    def tell(table: pa.Table, answers: pa.Table) -> pa.Table:
        """A chunk's words with what it knows of bigrams that it answers for: how many each word starts
        that were counted once, twice and more often, and how many it ends."""
        give_back()
        own = Chunk(table.to_pylist()[0])
        _, order, _ = own.keys()
        got = np.zeros(len(order), np.int64)
        got[order] = joined(answers)
        pairs = got[len(own.words) :]
        on = np.flatnonzero((pairs & 1) & (pairs > 1))
        seen, stats = np.minimum(pairs[on] >> 1, 3) - 1, np.zeros((len(own.words), 4), np.int64)
        np.add.at(stats, (own.first[on], seen), 1)
        np.add.at(stats[:, 3], own.second[on], 1)
        filled, at = dealt(own.words, edges)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()] * len(at), pa.int64()), "bucket": pa.array(filled.astype(np.int32)), "keys": pa.array([ascending(own.words[s]) for s in at], pa.binary()), "stats": pa.array([pack(stats[s].ravel()) for s in at], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        give_back()
        blocks = [read_ascending(k) for k in table.column("keys").to_pylist()]
        array = HashArray(blocks, [unpack(s).astype(np.int64).reshape(-1, 4) for s in table.column("stats").to_pylist()])
        out, bucket = [pack(array.of(keys).ravel()) for keys in blocks], table.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()), "bucket": pa.array([bucket] * (len(out) + 1), pa.int32()), "kind": pa.array([2] * (len(out) + 1), pa.int32()), "answer": pa.array([*out, None], pa.binary()), "totals": pa.array([None] * len(out) + [counts_of_counts(np.asarray(array.values[:, 3]))], pa.list_(pa.int64()))})

    reply = "chunk bigint, bucket int, kind int, answer binary, totals array<bigint>"
    counted = stored(chunks.mapInArrow(send, "chunk bigint, bucket int, keys binary, counts binary").groupBy("bucket").applyInArrow(count, reply), "model_counts")
    told = chunks.groupBy("chunk").cogroup(counted.where("chunk IS NOT NULL").groupBy("chunk")).applyInArrow(tell, "chunk bigint, bucket int, keys binary, stats binary")
    ended = stored(told.groupBy("bucket").applyInArrow(total, reply), "model_ends")

    # a few sums over the whole model are all that comes to the driver
    sums = {r.kind: r for r in totals_of(counted.unionByName(ended)).collect()}
    n_docs = chunks.agg(F.coalesce(F.sum("n_learn"), F.lit(0)).alias("n")).first().n
    grams, ends = (sums.get(k) for k in (1, 2))
    of = lambda r, c: int(r[c] or 0) if r else 0
    train_tokens, distinct = of(sums.get(0), "total") - n_docs, of(sums.get(0), "n") - (n_docs > 0)
    d2, d1 = (discounts(*(of(r, c) for c in TOTALS[:4])) for r in (grams, ends))
    all_ends, ones, twos, kinds = (of(ends, c) for c in ("total", "n1", "n2", "n"))
    left = (d1[0] * ones + d1[1] * twos + d1[2] * (kinds - ones - twos)) / all_ends if all_ends else 1.0

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        row = table.to_pylist()[0]
        own = Chunk(row)
        _, order, _ = own.keys()
        got, n = np.zeros(len(order), np.int64), len(own.words)
        got[order] = joined(answers)
        counts, stats = got >> 1, joined(answers, 2).reshape(-1, 4)
        base = np.log10((counts[:n] + 1) / (train_tokens + distinct + 1))
        p1 = discounted(stats[:, 3], d1) / max(all_ends, 1) + left / (distinct + 1)
        context, rest = counts[own.first], stats[own.first, :3] @ np.array(d2)
        known = np.maximum(context, 1)
        p2 = np.where(context > 0, discounted(counts[n:], d2) / known + rest / known * p1[own.second], p1[own.second])
        at = np.cumsum(own.sizes) - own.sizes
        summed = lambda x: np.add.reduceat(np.append(x, 0), at) * (own.sizes > 0)
        return pa.table({
            "row": pa.array(row["row"], pa.int64()), "doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(unpack(row["learn"]) == 0), "n_tokens": pa.array(own.sizes), "n_known": pa.array(summed((counts[own.tokens] > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(own.sizes), train_tokens)), "base_score": pa.array(summed(base[own.tokens])), "score": pa.array(summed(np.log10(p2)[own.bigram])),
        })

    answers = counted.where("chunk IS NOT NULL").unionByName(ended.where("chunk IS NOT NULL"))
    parts = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORES)
    sums_of = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    whole = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.first("train_tokens").alias("train_tokens"), *sums_of)
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
