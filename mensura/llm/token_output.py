"""Token-id files: concatenated ids with Elias-Fano encoded document boundaries.

A shard file holds, for documents in ascending id order, one array of ids (16 bits each where the
vocabulary allows, else 32) and two Elias-Fano sequences, the boundaries in that array and the
documents' ids. A monotone sequence of n values below u takes about 2 + log2(u/n) bits a value:
the low bits lie packed, the high bits are unary in a bit array, and a select structure (the
place of every 256th one, 32 bits) finds a value without a table of 64-bit offsets.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.llm.bpe import WHITE
from mensura.llm.common import lowered, parts_for, raw, runs, shared_dir, slices

MAGIC = b"MTOKEF1\0"
#: Bytes of ids in a shard, bytes of texts encoded at once, and pieces kept in a worker.
SHARD_BYTES = 64 << 20
BYTES_AT_ONCE = 4 << 20
CACHE_WORDS = 1_000_000
SELECT_EVERY = 256
PARTS_OF_SPAN = 1024
WORDS = re.compile(f"[^{WHITE}]+")
#: A plain word (see ``pieces``), and what it is parted into.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
PLAIN_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
#: Texts that show whether a tokenizer may be given words, and plain words parts, one by one.
PROBES = ("Àb, C; d", "The Quick  brown\tFox!\n\nÖver (it", " a\u3000b\x85c don't 12 3.4 x_y é̀", "SSS sss... --- A-B a.b @c")


class EliasFano:
    """A monotone sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, low_bits, np.packbits(low), np.packbits(bits), ones[::SELECT_EVERY].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.places))
        return head + self.low.tobytes() + self.high.tobytes() + self.places.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, low_bits, lows, highs, places = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        low = np.frombuffer(data, np.uint8, lows, at)
        high = np.frombuffer(data, np.uint8, highs, at + lows)
        own = np.frombuffer(data, "<u4", places, at + lows + highs)
        return cls(n, low_bits, low, high, own), at + lows + highs + 4 * places

    def _low(self, i: int) -> int:
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8])[a % 8 : a % 8 + self.low_bits]
        return int((bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum())

    def __getitem__(self, i: int) -> int:
        """Value i by the select structure: from the nearest kept one, then a scan of a few bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.places[i // SELECT_EVERY]), i % SELECT_EVERY
        byte, skip = at // 8, at % 8
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64])[skip:])
            if len(ones) > left:
                return (byte * 8 + skip + int(ones[left]) - i) << self.low_bits | self._low(i)
            left, byte, skip = left - len(ones), byte + 64, 0

    def block(self, k: int) -> np.ndarray:
        """Values k * SELECT_EVERY and on, up to the next kept one, found by the select structure."""
        first = k * SELECT_EVERY
        n = min(SELECT_EVERY, self.n - first)
        begin = int(self.places[k])
        end = int(self.places[k + 1]) if k + 1 < len(self.places) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8 : (end + 7) // 8])[begin % 8 :])[:n] + begin
        high = (ones - np.arange(first, first + n)).astype(np.uint64) << np.uint64(self.low_bits)
        a, b = first * self.low_bits, (first + n) * self.low_bits
        low = np.unpackbits(self.low[a // 8 : (b + 7) // 8])[a % 8 : a % 8 + b - a].reshape(n, self.low_bits).astype(np.uint64)
        return high + (low << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low)[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        return high + (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def shard_bytes(doc_ids: np.ndarray, nulls: int, lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    """A shard file's content; the first ``nulls`` documents have no id, the others ascend."""
    least = int(doc_ids[0]) if len(doc_ids) else 0
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)]))
    own = EliasFano.of(doc_ids.astype(np.int64) - least)
    return MAGIC + struct.pack("<BQqQ", width, nulls, least, len(ids)) + bounds.to_bytes() + own.to_bytes() + ids


class Shard:
    """A shard file read back: document ids, boundaries and ids."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token-id shard")
        width, self.nulls, least, size = struct.unpack_from("<BQqQ", data, len(MAGIC))
        self.bounds, at = EliasFano.from_bytes(data, len(MAGIC) + struct.calcsize("<BQqQ"))
        self.known, at = EliasFano.from_bytes(data, at)
        self.least = least
        self.ids = np.frombuffer(data, f"<u{width}", size // width, at)

    def __len__(self) -> int:
        return self.bounds.n - 1

    def doc_id(self, i: int) -> int | None:
        return self.least + self.known[i - self.nulls] if i >= self.nulls else None

    def document(self, i: int) -> np.ndarray:
        """Ids of the shard's i-th document."""
        return self.ids[self.bounds[i] : self.bounds[i + 1]]

    def blocks(self) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """(document ids, their boundaries with the last one's end) of a few hundred documents at a time."""
        ids: list[int | None] = [None] * self.nulls
        following = (self.known.block(k) for k in range(len(self.known.places)))
        for k in range(len(self.bounds.places)):
            first = k * SELECT_EVERY
            bounds = self.bounds.block(k).astype(np.int64)
            if first + len(bounds) < self.bounds.n:
                bounds = np.append(bounds, self.bounds[first + len(bounds)])
            if len(bounds) < 2:
                return
            while len(ids) < len(bounds) - 1:
                ids += [self.least + x for x in next(following).tolist()]
            yield ids[: len(bounds) - 1], bounds
            ids = ids[len(bounds) - 1 :]


def white_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of a UTF-8 buffer are part of a white-space character (of WHITE)."""
    out = _WHITE_BYTE[data]
    for lead, rest in _WIDE_WHITE.items():
        at = np.flatnonzero(data == lead)
        for tail in rest:
            on = at[at + len(tail) < len(data)]
            for k, byte in enumerate(tail, 1):
                on = on[data[on + k] == byte]
            for k in range(len(tail) + 1):
                out[on + k] = True
    return out


_WHITE_BYTE = np.zeros(256, bool)
_WIDE_WHITE: dict[int, list[bytes]] = {}
for _c in re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))):
    if _c < "\x80":
        _WHITE_BYTE[ord(_c)] = True
    else:
        _WIDE_WHITE.setdefault(_c.encode()[0], []).append(_c.encode()[1:])
#: ASCII letters; ASCII punctuation without the apostrophe; bytes that plain words are made of,
#: besides the Latin-1 letters, which are two bytes.
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(0x21, 0x7F) if b != 0x27 and not _ASCII_LETTER[b] and not 48 <= b < 58]] = True


def pieces(data: np.ndarray, offsets: np.ndarray, plain: bool) -> tuple[pa.Array, np.ndarray]:
    """The texts' pieces in order (binary), and where each text's pieces start (len+1).

    A piece is a run without white space. With ``plain``, a word of ASCII and Latin-1 letters with
    ASCII punctuation after them (no apostrophe) is two pieces, the lower-cased letters and the
    punctuation: no normalizer changes such a word but for its case, and pre-tokenizers part it
    where the letters end.
    """
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    word = ~white_bytes(data)
    starts, ends = runs(word, offsets)
    cuts = starts
    if plain:
        letter = _ASCII_LETTER[data]
        wide = np.flatnonzero(data[:-1] == 0xC3)
        wide = wide[(data[wide + 1] >= 0x80) & (data[wide + 1] != 0x97) & (data[wide + 1] != 0xB7)]
        letter[wide] = letter[wide + 1] = True
        mark = _MARK[data]
        turn = np.zeros(len(data), bool)  # a mark after a letter
        turn[1:] = mark[1:] & letter[:-1]
        back = np.zeros(len(data), bool)  # a letter after a mark
        back[1:] = letter[1:] & mark[:-1]
        total = lambda flags: np.cumsum(flags, dtype=np.int32)
        odd = total(~(letter | mark) | back)
        # nothing odd inside, and the first byte a letter
        good = (odd[ends - 1] - odd[starts] == 0) & letter[starts]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[good]] += 1
        inside[ends[good]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        cuts = np.sort(np.concatenate([starts, np.flatnonzero(turn & inside)]))
        data = np.where(inside, lowered(data), data)
    place = np.cumsum(word, dtype=np.int64)  # bytes of words up to here
    bounds = np.concatenate([place[cuts] - 1, place[-1:]]) if len(cuts) else np.zeros(1, np.int64)
    kept = np.ascontiguousarray(data[word])
    array = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    return array, np.searchsorted(cuts, offsets)


class WordEncoder:
    """Texts to ids by the tokenizers library; pieces seen before are looked up.

    For a tokenizer that drops white space, and whose normalizer and pre-tokenizer never look
    across it, the ids of a text are those of its white-space separated words in turn. Where it
    also lowers case, plain words share the ids of their lower-cased letters, which the model
    merges without the normalizer. Both are tried out on probes when the encoder is made; for any
    other tokenizer whole texts are encoded.

    The known pieces' ids lie end to end in one array, so a batch of texts costs a dictionary
    encoding by Arrow, a look-up for each distinct piece, and one gathering of ids.
    """

    def __init__(self, content: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(content)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
        self.end = end_id
        ids = self._whole
        self.by_word = all(ids(p) == [x for w in WORDS.findall(p) for x in ids(w)] for p in PROBES)
        self.plain = self.by_word and all(ids(p) == [x for w in WORDS.findall(p) for q in self._parted(w) for x in ids(q)] for p in PROBES)
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        # where the last id of a word shows it, ids are dealt out by that instead of by offsets
        self.last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and token.endswith(suffix)]] = True
        letters = "the quick brøwn fox jumps över a lazy dög ,;. ?!".split()
        got = [self.bare.encode(w, add_special_tokens=False).ids for w in letters]
        if got != [ids(w) for w in letters] or any(self.last[x].tolist() != [False] * (len(x) - 1) + [True] for x in got):
            self.bare = None
        self._forget()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _parted(word: str) -> list[str]:
        m = PLAIN.fullmatch(word)
        return [m[1].lower(), m[2]] if m else [word]

    def _forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.pool = np.array([self.end], f"<u{self.width}")  # entry 0 is the end of a text
        self.at, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)

    def _dealt(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces joined by a space, dealt out by where they begin in the joined text."""
        got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        owner = np.searchsorted(firsts, np.array([a for a, _ in got.offsets], np.int64), "right") - 1
        return np.array(got.ids, f"<u{self.width}"), np.bincount(owner, minlength=len(texts))

    def _dealt_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain pieces, by the ids that end a word."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, f"<u{self.width}")
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(texts):
            raise ValueError("a plain piece has another number of words than one")
        return ids, np.diff(ends, prepend=-1)

    def _learn(self, new: list[bytes]) -> None:
        """Gives new pieces their entries; plain ones are encoded without the normalizer."""
        texts = [w.decode() for w in new]
        plain = [i for i, t in enumerate(texts) if PLAIN_PIECE.fullmatch(t)] if self.plain and self.bare else []
        own = set(plain)
        other = [i for i in range(len(new)) if i not in own]
        ids, counts = [], []
        for places, deal in ((plain, self._dealt_plain), (other, self._dealt)):
            for start in range(0, len(places), 2000):
                a, b = deal([texts[i] for i in places[start : start + 2000]])
                ids.append(a), counts.append(b)
        sizes, first = np.concatenate(counts), np.zeros(len(new), np.int64)
        order = plain + other
        first[order] = len(self.pool) + np.cumsum(sizes) - sizes
        ordered = np.zeros(len(new), np.int64)
        ordered[order] = sizes
        self.pool = np.concatenate([self.pool, *ids])
        self.seen.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.at, self.size = np.concatenate([self.at, first]), np.concatenate([self.size, ordered])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, the end id after each, and how many each has."""
        if not self.by_word:
            whole = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            got = [[*self._whole(t), self.end] for t in whole]
            return np.array([x for ids in got for x in ids], f"<u{self.width}"), np.array([len(x) for x in got], np.int64)
        if len(self.seen) > CACHE_WORDS:
            self._forget()
        own, bounds = pieces(data, offsets, self.plain)
        coded = own.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        entry = np.fromiter(map(self.seen.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(entry < 0)
        if len(new):
            base = len(self.at)
            self._learn(distinct[new].tolist())
            entry[new] = base + np.arange(len(new))
        # every text's pieces and then entry 0, the end
        entries = np.insert(entry[coded.indices.to_numpy()], bounds[1:], 0) if len(own) else np.zeros(len(offsets) - 1, np.int64)
        sizes = self.size[entries]
        before = np.cumsum(sizes) - sizes
        ids = self.pool[np.repeat(self.at[entries] - before, sizes) + np.arange(sizes.sum())]
        ends = bounds[1:] + np.arange(1, len(offsets))
        return ids, np.diff(np.concatenate([[0], np.append(before, len(ids))[ends]]))


_encoders: dict[tuple[str, int], WordEncoder] = {}


def write_shards(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and writes shards and their manifest under ``out_dir``; returns the manifest.

    Documents are dealt out by ranges of their id and their text's beginning, and sorted, so shards in
    manifest order hold them in ascending order; rows with a null id come first, ties are in the
    order of their text. One id, or none, with many texts is spread over tasks.
    A null or empty text has the end id alone. Files get a name of their own at each attempt and
    only those in the manifest count, so a lost executor's files do no harm.
    Manifest: part, piece, path, n_docs, n_ids.
    """
    with open(tokenizer_path, encoding="utf-8") as f:  # the vocabulary file, a few MB at most
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sorted_rows = rows.repartitionByRange(parts_for(docs, 8 << 20), "id", F.substring("text", 1, 64)).sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((tokenizer_path, end_id)) or _encoders.setdefault((tokenizer_path, end_id), WordEncoder(content.value, end_id))
        store, top = fs.FileSystem.from_uri(out_dir)
        part, piece, doc_ids, lengths, ids, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            path = f"{top}/part-{part:07d}-{piece:04d}-{uuid.uuid4().hex}.mtok"
            known = np.array([x for x in doc_ids if x is not None], np.int64)
            with store.open_output_stream(path) as out:
                out.write(shard_bytes(known, len(doc_ids) - len(known), np.array(lengths), b"".join(ids), encoder.width))
            return pa.RecordBatch.from_pydict({"part": [part], "piece": [piece], "path": [path], "n_docs": [len(doc_ids)], "n_ids": [sum(lengths)]}, schema=pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            data, offsets = raw(batch.column(1))
            every = batch.column(0).to_pylist()
            for i, j in slices(offsets, BYTES_AT_ONCE):
                own, counts = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                doc_ids += every[i:j]
                lengths += counts.tolist()
                ids.append(own.tobytes())
                size += own.nbytes
                if size >= SHARD_BYTES:
                    yield flush()
                    piece, doc_ids, lengths, ids, size = piece + 1, [], [], [], 0
        if doc_ids:
            yield flush()

    manifest = sorted_rows.mapInArrow(run, "part int, piece int, path string, n_docs bigint, n_ids bigint")
    manifest.write.parquet(f"{out_dir}/manifest.parquet")
    return docs.sparkSession.read.parquet(f"{out_dir}/manifest.parquet")


def read_shards(spark: SparkSession, out_dir: str) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it), n_tokens, ids_crc32.

    The crc is of the ids as little-endian unsigned 32-bit integers. Boundaries and document ids
    are read by the select structures, a few hundred documents at a time. The running sum over
    shards is one over spans of PARTS_OF_SPAN parts and one inside each span.
    """
    manifest = spark.read.parquet(f"{out_dir}/manifest.parquet").withColumn("span", F.floor(F.col("part") / PARTS_OF_SPAN))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = manifest.groupBy("span").agg(F.sum("n_ids").alias("n_ids")).select("span", before.alias("span_base"))
    order = Window.partitionBy("span").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    inside = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    placed = inside.join(spans, "span").select("path", (F.col("base") + F.col("span_base")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(out_dir)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(path) as f:
                    shard = Shard(f.read())
                for doc_ids, bounds in shard.blocks():
                    wide, first = shard.ids[bounds[0] : bounds[-1]].astype("<u4"), int(bounds[0])
                    crc = [zlib.crc32(wide[a - first : b - first]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition("path").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for shards in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/token_ids/{uuid.uuid4().hex}"


