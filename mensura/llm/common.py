"""What the operators of this subpackage share: table access, sizes, byte and hash kernels.

The kernels work on one Arrow batch at a time: the texts of a batch lie end to end in one
UTF-8 buffer, and numpy runs over that buffer. Nothing here looks beyond the batch it is given.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, that Spark hands to Python at once; keeps a batch of very long texts in memory.
BATCH_ROWS = 2000
BATCH_BYTES = 32 << 20
#: Bytes of text that the numpy kernels work on at once.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by Spark's own reader, so that any store Spark reads will do.

    Also sets the session's limits on Arrow batches, which hold for all that is done with it.
    """
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Sets how much Spark hands to Python at once, by rows and by bytes (one row at least)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size; reads no data."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, part_bytes: int, text_col: str = "text") -> int:
    """How many parts of about ``part_bytes`` the frame makes, at least the session's own number.

    By the optimizer's estimate, which for files is their size; where it knows nothing (a frame of
    Python rows) the texts are measured.
    """
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size_in_bytes(df)
    if size >= 1 << 55:
        size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first().n
    return max(least, min(size // part_bytes, 1 << 24))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session names none, a session within one process gets a temporary folder; where
    executors are other processes, which may not see the driver's folders, that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        where = f"file://{tempfile.mkdtemp(prefix='mensura-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def strings(column: pa.Array) -> pa.Array:
    """A string column with nulls read as empty texts."""
    return pc.fill_null(column, "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 buffer of a string column and its len+1 offsets, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = strings(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``most`` bytes (one text at least)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


# ---- 64-bit hashes -------------------------------------------------------------------------

_U = np.uint64
_Q = 0x9E3779B97F4A7C15 | 1
_QINV = pow(_Q, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (two multiplications and three xor-shifts), in a new array."""
    x = x ^ _U(seed) if seed else x.copy()
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> _U(shift)
        x *= _U(times)
    x ^= x >> _U(33)
    return x


#: A random-looking 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(_Q))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse modulo 2**64."""
    if len(_powers["up"]) <= n:
        size = 1 << int(n + 1).bit_length()
        for name, base in (("up", _Q), ("down", _QINV)):
            table, step = np.ones(1, _U), base
            while len(table) < size:
                table = np.concatenate([table, table * _U(step)])
                step = step * step & (2**64 - 1)
            _powers[name] = table
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums S with S[i] over the weighted bytes before i; (S[j]-S[i])*down[i] hashes data[i:j]."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE_VALUES[data] * up[:-1], out=out[1:])
    return out


# ---- words and shingles --------------------------------------------------------------------

#: ASCII white space: space and the five from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHINGLE = 5
_PLACES = mix(np.arange(11, 11 + 64, dtype=_U) * _U(_Q)) | _U(1)


#: Longest run that is hashed eight bytes at a time; longer ones by blake2b.
LANES = 8


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes data[start:end].

    Eight bytes at a time go through a bijective mixer, so runs of one length up to eight never
    collide, and no algebra of the bytes (as with polynomials modulo 2**64) makes others do so.
    """
    size = ends - starts
    out = mix((size.astype(_U) + _U(1)) * _U(_Q))
    if not len(starts):
        return out
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    active = np.flatnonzero((size > 0) & (size <= 8 * LANES))
    k = 0
    while len(active):
        lane = lanes[starts[active] + 8 * k].view("<u8").ravel()
        left = np.minimum(8, size[active] - 8 * k).astype(_U)
        lane &= ~_U(0) >> ((_U(8) - left) << _U(3))
        out[active] = mix(mix(lane, k + 1) ^ out[active])
        k += 1
        active = active[size[active] > 8 * k]
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def parts_of(data: np.ndarray, inside: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts of one text in parts of about ``most`` bytes, never within a run (bytes that ``inside``, by value, marks)."""
    at = 0
    while at < len(data):
        end = min(len(data), at + most)
        while end < len(data):  # on to the first byte outside a run
            stop = np.flatnonzero(~inside[data[end : end + most]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(len(data), end + most)
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word in order, and where each text's words start (len+1).

    A very long text is worked on in parts, so that little more than its hashes is held at once.
    """
    if len(offsets) == 2 and len(data) > 4 * SLICE_BYTES:
        parts = [word_hashes(data[a:b], np.array([0, b - a]))[0] for a, b in parts_of(data, ~SPACE)]
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    starts, ends = runs(~SPACE[data], offsets)
    return run_hashes(LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles in order, repeats included, and their bounds (len+1).

    A text with fewer than k words has its whole sequence as one shingle, one without words none.
    """
    words, at = word_hashes(data, offsets)
    count = np.diff(at)
    out_at = np.concatenate([[0], np.cumsum(np.where(count >= k, count - k + 1, count > 0))]).astype(np.int64)
    out = np.zeros(out_at[-1], _U)
    if len(words) >= k:
        grams = words[: len(words) - k + 1] * _PLACES[0]
        for j in range(1, k):
            grams += words[j : len(words) - k + 1 + j] * _PLACES[j]
        grams = mix(grams, k)
        long = np.flatnonzero(count >= k)
        sizes = count[long] - k + 1
        source = np.repeat(at[:-1][long] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        target = np.repeat(out_at[:-1][long] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        out[target] = grams[source]
    for i in np.flatnonzero((count > 0) & (count < k)).tolist():
        own = words[at[i] : at[i + 1]]
        out[out_at[i]] = mix(np.array([(own * _PLACES[: len(own)]).sum(dtype=_U)], _U), 1000 + len(own))[0]
    return out, out_at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    hashes, at = shingles(data, offsets, k)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


_LOWER_BYTES = bytes(LOWER)


def exact_shingles(text: str | None, k: int = SHINGLE) -> set[bytes]:
    """The shingles themselves, words joined by a space; for checks of single texts."""
    words = (text or "").encode().translate(_LOWER_BYTES).split()
    if len(words) < k:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


class Probe:
    """Membership of 64-bit hashes in a sorted array: a bit table first, then a search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = max(10, min(24, int(16 * len(self.keys)).bit_length()))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.keys >> _U(64 - self.bits)).astype(np.int64)] = True

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` of those that are keys, and which keys they are."""
        maybe = np.flatnonzero(self.table[(hashes >> _U(64 - self.bits)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        key = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        on = self.keys[key] == hashes[maybe]
        return maybe[on], key[on]


# ---- samples to learn from -----------------------------------------------------------------


def bounded_sample(df: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """About ``most`` distinct rows (all rows, if there are no more), chosen by a hash of all columns.

    The same rows at every partitioning. Equal rows are chosen together and then count once, so
    neither null nor repeated ids make the sample grow: of n distinct rows n * most / (number of
    rows) are expected, and a tenth more than ``most`` doesn't happen in practice from a thousand on.
    """
    total = df.count()
    if total <= most:
        return df
    share = F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns], F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return df.where(share < most / total).distinct()


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns _id, _text, _y: a bounded sample of the rows with a label, joined with their texts.

    The labels are sampled before the join, so the side that is broadcast has ``most`` rows or so;
    where ids repeat among the documents, the joined rows are sampled again.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    few = bounded_sample(known, most).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return bounded_sample(texts.join(F.broadcast(few), "_id"), most + most // 5, 1)


#: Upper to lower case for ASCII, as a table; Latin-1 letters are two bytes and lowered apart.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, byte for byte; the rest unchanged."""
    out = LOWER[data]
    if len(out) > 1:
        wide = np.flatnonzero(data[:-1] == 0xC3) + 1
        wide = wide[(data[wide] >= 0x80) & (data[wide] <= 0x9E) & (data[wide] != 0x97)]
        out[wide] += 0x20
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that stay inside one text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = np.zeros(len(inside) + 1, bool)
    step[1:-1] = inside[1:] != inside[:-1]
    step[0] = step[-1] = True
    step[offsets] = True
    edges = np.flatnonzero(step)
    on = inside[edges[:-1]]
    return edges[:-1][on], edges[1:][on]


# ---- stored tables, counts of hashes over all documents, components ------------------------


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back: cut from its lineage."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(ascending: np.ndarray) -> bytes:
    """An ascending array of unsigned integers as differences, 32 bits each where they fit."""
    steps = np.diff(ascending, prepend=_U(0))
    wide = len(steps) and int(steps[1:].max(initial=0)) >= 1 << 32
    return b"\1" + steps.tobytes() if wide else b"\0" + steps[:1].tobytes() + steps[1:].astype(np.uint32).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[0]:
        return np.cumsum(np.frombuffer(data, _U, -1, 1), dtype=_U)
    if len(data) < 9:
        return np.zeros(0, _U)
    return np.cumsum(np.concatenate([np.frombuffer(data, _U, 1, 1), np.frombuffer(data, np.uint32, -1, 9).astype(_U)]), dtype=_U)


#: Leading bits of a hash that are compared when hashes are counted over all documents. Two
#: hashes that agree in them only make a count too high, which no caller takes for a match.
COUNT_BITS = 48
CHUNK_BYTES = 4 << 20



def levels(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte each, order kept: exact below 128, then six steps to each doubling."""
    high = 128 + np.floor(6 * np.log2(np.maximum(counts, 128) / 128))
    return np.where(counts < 128, counts, np.minimum(255, high)).astype(np.uint8)


HashesOf = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """Columns id, text and chunk, a number that depends on the row alone; and how many chunks."""
    n = parts_for(docs, chunk_bytes, text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text")))
    return rows.withColumn("chunk", F.pmod(key, F.lit(n)).cast("int")), n


def give_back() -> None:
    """Returns freed memory to the system, so that a worker's idle arenas don't add to the next task's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def known(table: pa.Table) -> pa.Table:
    """A chunk's rows in an order that depends on them alone (texts of one id by their hash)."""
    table = table.combine_chunks()
    digest = pa.array([zlib.crc32(t) for t in table.column("text").cast(pa.binary()).to_pylist()], pa.int64())
    return table.append_column("_c", digest).sort_by([("id", "ascending"), ("_c", "ascending")])


def ordered_hashes(table: pa.Table, hashes_of: HashesOf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sorted rows with an id: all distinct hashes per document, their document, and the
    order that sorts them by hash."""
    n = len(table) - table.column("id").null_count
    data, offsets = raw(table.column("text").slice(0, n))
    hashes, owner = [], []
    for i, j in slices(offsets):
        h, at = hashes_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        hashes.append(h)
        owner.append(np.repeat(np.arange(i, j), np.diff(at)))
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, _U)
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    return hashes, owner, np.argsort(hashes, kind="stable")


def bucket_number(n_chunks: int) -> int:
    """Buckets that chunks deal their hashes out to: one for eight chunks, more only for small inputs.

    A bucket then holds what eight chunks hold. Chunks times buckets are the most blocks there can
    be, but none is empty, so there are never more blocks than hashes.
    """
    return max(1, min(n_chunks, 128), n_chunks // 8)


def hash_counts(chunks: DataFrame, n_chunks: int, hashes_of: HashesOf) -> DataFrame:
    """How many documents hold each hash: (chunk, bucket, counts), counts as ``levels``, one byte
    for each hash of the chunk in ascending order.

    ``hashes_of`` gives a batch's hashes, distinct in each document. Every chunk sends its sorted
    hashes in blocks by leading bits; a bucket's blocks meet in one task, which sorts them together
    and answers each block. A hash travels once per chunk and document that has it, so a bucket
    holds about one n-th of all hashes whatever their skew below a chunk's size.
    """
    n_buckets = bucket_number(n_chunks)
    edges = np.arange(1, n_buckets, dtype=_U) * _U((1 << COUNT_BITS) // n_buckets)

    def send(table: pa.Table) -> pa.Table:
        give_back()
        chunk = table.column("chunk")[0].as_py()
        hashes, _, order = ordered_hashes(known(table), hashes_of)
        top = hashes[order] >> _U(64 - COUNT_BITS)
        bucket = np.searchsorted(edges, top, "right")
        filled, cuts = np.unique(bucket, return_index=True)
        rows = [(b, packed(top[i:j])) for b, i, j in zip(filled.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(top)])]
        return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int32()), "bucket": pa.array([b for b, _ in rows], pa.int32()), "hashes": pa.array([h for _, h in rows], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        give_back()
        blocks = [unpacked(h) for h in table.column("hashes").to_pylist()]
        whole = np.sort(np.concatenate(blocks))
        first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
        keys, many = whole[first], levels(np.diff(np.append(first, len(whole))))
        counts = [zlib.compress(many[np.searchsorted(keys, b)].tobytes(), 1) for b in blocks]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "counts": pa.array(counts, pa.binary())})

    sent = chunks.groupBy("chunk").applyInArrow(send, "chunk int, bucket int, hashes binary")
    return sent.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, counts binary")


def counts_in_order(table: pa.Table) -> np.ndarray:
    """A chunk's answers joined in bucket order: a count for each hash, ascending."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("counts").to_pylist()))
    return np.frombuffer(b"".join(zlib.decompress(c) for _, c in rows), np.uint8)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (columns a and b): the least id it reaches.

    Each round every node takes the least label among its neighbours' and its own, and then its
    label's label, so distances halve; a round is a join and a grouping by node, and ends in the
    shared folder. Labels only ever fall, so the rounds end by themselves, however long the chains.
    Nothing but whether a label changed comes to the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).select(F.col("a").alias("id"), "component")
        # stored, so that the next join's sides both come from a shuffle and a hot label can be split
        least = stored(labels.union(near).groupBy("id").agg(F.min("component").alias("component")), "least")
        roots = least.select(F.col("id").alias("component"), F.col("component").alias("root"))
        jumped = least.join(roots, "component", "left").select("id", F.least("component", F.coalesce("root", "component")).alias("component"))
        new = stored(jumped, "labels")
        old = labels.withColumnRenamed("component", "before")
        if not new.join(old, "id").where("component <> before").limit(1).count():
            return new
        labels = new
