"""Alignment of two tokenizers' tokens over shared byte boundaries, with corpus-wide counts of id pairs.

Texts are cut before each space that follows a character other than white space: no token of either
tokenizer goes over such a place, so the ids, the groups and the linked pairs of a segment are
worked out once for each distinct segment of a batch and looked up afterwards. Whether the
vocabularies allow that is seen from them and tried out; else whole texts are the segments.

Pairs are counted externally: every chunk of documents writes its pairs, with the number of its
documents that hold each, as sorted runs of zstd blocks, parted by a radix of the first side's id.
Runs of a part are merged by a heap over their blocks, 64 at a time, until one is left. It is in
order of the first side, so one pass over it yields each first id's highest count. The table then
streams back along the runs, and chunks sum its answers by document.

A null or empty text, and one whose joined token bytes differ from a space and the text, has zeros
and no groups. Rows are judged one by one: null and repeated ids keep their rows, and each repeated
row counts as a document. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import chunked, give_back, known, raw, slices, stored
from mensura.llm.token_output import white_bytes

#: Bits of a pair's code for the second side's id.
B_BITS = 15
#: Records of a run's block, runs merged at once, parts by the first side's id, segments kept in a worker.
BLOCK = 16384
FAN = 64
MOST_PARTS = 1024
CACHE_SEGMENTS = 400_000
SPACE_MARK = "▁"
#: A run of this many bytes without white space goes to the library that takes long ones in its stride.
LONG_RUN = 2000
DIGESTS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
DETAIL = "chunk int, row int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, many binary"


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: most bytes stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all elements of runs, given by their starts and sizes, end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Vocabulary:
    """The bytes of every token, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.at[ids], self.size[ids])]


class Aligner:
    """Both tokenizers, and what is known of segments: ids, groups and linked pairs.

    a_json: a byte-level BPE file of the tokenizers library; b_model: a sentencepiece BPE model.
    """

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(a_json)
        self.slow.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        spec, of = json.loads(a_json), byte_of_char()
        vocab = self.slow.get_vocab(with_added_tokens=False)
        table = [b""] * self.slow.get_vocab_size(with_added_tokens=True)
        for token, i in vocab.items():
            table[i] = bytes(of[c] for c in token)
        for token in spec["added_tokens"]:
            table[token["id"]] = token["content"].encode()
        self.va = Vocabulary(table)
        # the ids of merges ascend in the order of the merges, so they serve as ranks for a quicker library
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        quick = merged == sorted(merged) and min(merged) >= 256 and spec["normalizer"] is None
        self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={table[i]: i for i in vocab.values()}, special_tokens={}) if quick else None
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.vb = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)])
        if len(self.vb.size) > 1 << B_BITS or len(self.va.size) > 1 << 16:
            raise ValueError("pairs are coded in 31 bits: the first side has 65,536 ids at most, the second 32,768")
        self.cut = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        probes = ["The  quick\tbrown\n fox's, 12 　 x   y", "a \n b  ", "Ärger é́ — 日本 'll we'll\r\n\r\n z"]
        self.lead = self.b.encode("x")
        for p in probes:
            data = (" " + p).encode()
            parts = [data[i:j].decode() for i, j in zip(*self._cuts(np.frombuffer(data, np.uint8), np.array([0, len(data)])))]
            self.cut = self.cut and [x for s in parts for x in self._a([s])[0]] == self._a([" " + p])[0] and [x for s in parts for x in self._b([s])[0]] == self.b.encode(p)
        self._forget()

    def _a(self, texts: list[str]) -> list[list[int]]:
        if self.quick:
            return [self.quick.encode_ordinary(t) if len(t) < LONG_RUN else self.slow.encode(t, add_special_tokens=False).ids for t in texts]
        return [e.ids for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]

    def _b(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space. A segment follows something, so that a lone space counts too."""
        if not self.cut:
            return self.b.encode([t[1:] for t in texts], num_threads=1)
        return [ids[len(self.lead) :] for ids in self.b.encode(["x" + t for t in texts], num_threads=1)]

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
        """Starts and ends of the segments; every text begins with a space."""
        cut = np.zeros(len(data), bool)
        if self.cut and len(data):
            cut[1:] = (data[1:] == 0x20) & ~white_bytes(data)[:-1]
        cut[offsets[:-1]] = True
        starts = np.flatnonzero(cut)
        return starts.tolist(), [*starts[1:].tolist(), len(data)]

    def _forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.fine = np.zeros(0, bool)
        self.n = np.zeros((0, 3), np.int64)  # ids of both sides, groups
        self.text: list[str] = []
        self.at, self.size, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.times = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        """Works out new segments, all at once."""
        texts = [s.decode() for s in new]
        a, b = self._a(texts), self._b(texts)
        na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        ia, ib = (np.array([i for x in ids for i in x], np.int64) for ids in (a, b))
        size = np.array([len(s) for s in new])
        same = lambda v, ids, many: np.add.reduceat(np.append(v.size[ids], 0), np.minimum(np.cumsum(many) - many, len(ids))) * (many > 0) == size
        fine = same(self.va, ia, na) & same(self.vb, ib, nb)
        owner_a, owner_b = np.repeat(np.arange(len(new)), na), np.repeat(np.arange(len(new)), nb)
        ia, ib, owner_a, owner_b = ia[fine[owner_a]], ib[fine[owner_b]], owner_a[fine[owner_a]], owner_b[fine[owner_b]]
        data = np.frombuffer(b"".join(s for s, ok in zip(new, fine.tolist()) if ok), np.uint8)
        wrong = (self.va.joined(ia) != data) | (self.vb.joined(ib) != data)
        if wrong.any():
            at = np.flatnonzero(fine)
            fine[np.unique(np.repeat(at, size[at])[wrong])] = False
            ia, ib, owner_a, owner_b = ia[fine[owner_a]], ib[fine[owner_b]], owner_a[fine[owner_a]], owner_b[fine[owner_b]]
        ends_a, ends_b = np.cumsum(self.va.size[ia]), np.cumsum(self.vb.size[ib])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ga, gb = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        many_a, many_b = np.bincount(ga, minlength=len(ends)), np.bincount(gb, minlength=len(ends))
        first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        owner = owner_a[first_a] if len(ends) else np.zeros(0, np.int64)
        many = many_a * many_b
        large = np.flatnonzero(many > 4096)
        small = np.where(many > 4096, 0, many)
        place = np.arange(small.sum()) - np.repeat(np.cumsum(small) - small, small)
        g = np.repeat(np.arange(len(ends)), small)
        pairs = (ia[first_a[g] + place // many_b[g]] << B_BITS) | ib[first_b[g] + place % many_b[g]]
        times, of = np.ones(len(pairs), np.int64), owner[g]
        for k in large.tolist():  # distinct ids of both sides, each pair as often as both occur
            xa, ca = np.unique(ia[first_a[k] : first_a[k] + many_a[k]], return_counts=True)
            xb, cb = np.unique(ib[first_b[k] : first_b[k] + many_b[k]], return_counts=True)
            pairs = np.concatenate([pairs, ((xa[:, None] << B_BITS) | xb).ravel()])
            times, of = np.concatenate([times, (ca[:, None] * cb).ravel()]), np.concatenate([of, np.full(len(xa) * len(xb), owner[k])])
        if len(large):
            order = np.argsort(of, kind="stable")
            pairs, times, of = pairs[order], times[order], of[order]
        # the groups' texts: ids in order with the mark that follows each
        ids = np.concatenate([ia, ib])
        last = np.zeros(len(ids), bool)
        if len(ends):
            last[first_a + many_a - 1] = last[len(ia) + first_b + many_b - 1] = True
        side = np.repeat([0, 1], [len(ia), len(ib)])
        order = np.lexsort((np.arange(len(ids)), side, np.concatenate([ga, gb])))
        marks = np.where(~last, 0, 1 + side)[order]
        words = [str(i) + ",|;"[m] for i, m in zip(ids[order].tolist(), marks.tolist())]
        stop = np.cumsum(np.bincount(np.concatenate([owner_a, owner_b]), minlength=len(new))).tolist()
        base = len(self.text)
        self.text += ["".join(words[i:j]) for i, j in zip([0, *stop[:-1]], stop)]
        sizes = np.bincount(of, minlength=len(new))
        links = np.zeros(len(new), np.int64)
        np.add.at(links, of, times)
        self.at = np.concatenate([self.at, len(self.pairs) + np.cumsum(sizes) - sizes])
        self.size, self.links = np.concatenate([self.size, sizes]), np.concatenate([self.links, links])
        self.pairs, self.times = np.concatenate([self.pairs, pairs.astype(np.uint32)]), np.concatenate([self.times, times])
        self.n = np.concatenate([self.n, np.stack([na, nb, np.bincount(owner, minlength=len(new))], 1)])
        self.fine = np.concatenate([self.fine, fine])
        self.seen.update(zip(new, range(base, base + len(new))))

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: ids of both sides, groups and links, the groups' digest, and its distinct
        pairs (ascending) with their occurrences and bounds (len+1)."""
        if len(self.seen) > CACHE_SEGMENTS:
            self._forget()
        n, some = len(offsets) - 1, np.diff(offsets) > 0
        spaced = np.insert(data, offsets[:-1][some], 0x20)
        bounds = np.concatenate([[0], np.cumsum(np.diff(offsets) + some)])
        own = np.flatnonzero(some)
        starts, ends = self._cuts(spaced, bounds[np.append(own, n)]) if len(own) else ([], [])
        array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.array([*starts, len(spaced)], np.int64)), pa.py_buffer(np.ascontiguousarray(spaced))])
        coded = array.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [s for s in distinct if s not in self.seen]
        if new:
            self._learn(new)
        entry = np.array([self.seen[s] for s in distinct], np.int64)[coded.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
        owner = np.searchsorted(bounds, starts, "right") - 1
        bad = np.zeros(n, bool)
        bad[owner[~self.fine[entry]]] = True
        on = ~bad[owner]
        entry, owner = entry[on], owner[on]
        figures = np.zeros((n, 4), np.int64)
        np.add.at(figures, owner, np.column_stack([self.n[entry], self.links[entry]]))
        at = np.searchsorted(owner, np.arange(n + 1))
        listed = entry.tolist()
        text = self.text
        shas = [hashlib.sha256("".join([text[e] for e in listed[i:j]])[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        place = ragged(self.at[entry], self.size[entry])
        keys = (np.repeat(owner, self.size[entry]).astype(np.int64) << 31) | self.pairs[place]
        times = self.times[place]
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, first) if len(first) else times
        keys = keys[first]
        return figures, shas, (keys & ((1 << 31) - 1)).astype(np.uint32), times, np.searchsorted(keys >> 31, np.arange(n + 1))


# ---- runs ----------------------------------------------------------------------------------


def run_bytes(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """A run: blocks of ascending pairs, as differences, and their counts, each a zstd frame."""
    pack, out = zstandard.ZstdCompressor(level=1), []
    for pairs, counts in blocks:
        for i in range(0, len(pairs), BLOCK):
            p, c = pairs[i : i + BLOCK], counts[i : i + BLOCK]
            frame = pack.compress(np.diff(p.astype("<u4"), prepend=np.uint32(0)).tobytes() + c.astype("<i8").tobytes())
            out.append(struct.pack("<I", len(frame)) + frame)
    return b"".join(out)


def run_blocks(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    unpack, at = zstandard.ZstdDecompressor(), 0
    while at < len(run):
        (size,) = struct.unpack_from("<I", run, at)
        data = unpack.decompress(run[at + 4 : at + 4 + size])
        n = len(data) // 12
        yield np.cumsum(np.frombuffer(data, "<u4", n), dtype=np.uint32), np.frombuffer(data, "<i8", n, 4 * n)
        at += 4 + size


def merged_blocks(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """K-way merge: a heap tells which run's block ends first; all records up to that end are
    summed by pair and yielded, so that one block of each run is held at a time."""
    readers = [run_blocks(r) for r in runs]
    now: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def load(k: int) -> None:
        block = next(readers[k], None)
        if block is None:
            now.pop(k, None)
        else:
            now[k] = block
            heapq.heappush(heap, (int(block[0][-1]), k))

    for k in range(len(runs)):
        load(k)
    while heap:
        end = heap[0][0]
        got = []
        for k, (pairs, counts) in now.items():
            to = int(np.searchsorted(pairs, end, "right"))
            got.append((pairs[:to], counts[:to]))
            now[k] = (pairs[to:], counts[to:])
        while heap and heap[0][0] == end:
            load(heapq.heappop(heap)[1])
        pairs, counts = np.concatenate([p for p, _ in got]), np.concatenate([c for _, c in got])
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        yield pairs[first], np.add.reduceat(counts, first)


def with_best(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts doubled, plus one where a pair has the highest count of its first id. Pairs come in
    order of the first id, so only those of the id that a block ends in wait for the next one."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def marked(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = pairs >> B_BITS
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(a))))
        return pairs, counts * 2 + (counts == most)

    for pairs, counts in blocks:
        a = pairs >> B_BITS
        to = int(np.searchsorted(a, a[-1]))
        if to:
            held.append((pairs[:to], counts[:to]))
        if to or (held and held[0][0][-1] >> B_BITS != a[0]):
            yield marked(np.concatenate([p for p, _ in held]), np.concatenate([c for _, c in held]))
            held = []
        held.append((pairs[to:], counts[to:]))
    if held:
        yield marked(np.concatenate([p for p, _ in held]), np.concatenate([c for _, c in held]))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ids of both sides, groups, links, links of the highest count of their first id,
    the sum of the links' counts, and a digest of the groups.

    A pair's count is the number of rows in which it is linked.
    """
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:  # vocabulary files, a few MB at most
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    chunks, n_chunks = chunked(docs, id_col, text_col)
    n_parts = min(MOST_PARTS, max(16, n_chunks))

    def detail(table: pa.Table) -> pa.Table:
        give_back()
        own = _aligners.get((a_path, b_path)) or _aligners.setdefault((a_path, b_path), Aligner(*files.value))
        table = known(table)
        data, offsets = raw(table.column("text"))
        pack, rows, shas, packed, times = zstandard.ZstdCompressor(level=1), [], [], [], []
        for i, j in slices(offsets):
            figures, sha, pairs, many, at = own.documents(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            rows.append(figures)
            shas += sha
            for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                packed.append(pack.compress(np.diff(pairs[x:y], prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()))
                times.append(pack.compress(many[x:y].astype("<i8").tobytes()))
        n = np.concatenate(rows)
        ints = {c: pa.array(n[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        return pa.table({"chunk": table.column("chunk"), "row": pa.array(range(len(n)), pa.int32()), "doc_id": table.column("id"), **ints, "groups_sha256": pa.array(shas), "pairs": pa.array(packed, pa.binary()), "many": pa.array(times, pa.binary())})

    def runs_of(table: pa.Table) -> pa.Table:
        """A chunk's pairs with the number of its documents that hold each, as a run for each part."""
        give_back()
        pairs, counts = chunk_pairs(table)
        part = (pairs >> B_BITS) % n_parts
        order = np.argsort(part, kind="stable")
        filled, cuts = np.unique(part[order], return_index=True)
        runs = [run_bytes(iter([(pairs[o], counts[o])])) for o in np.split(order, cuts[1:])] if len(pairs) else []
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()] * len(runs), pa.int32()), "part": pa.array(filled.astype(np.int32)), "run": pa.array(runs, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        give_back()
        run = run_bytes(merged_blocks(table.column("run").to_pylist()))
        return pa.table({"chunk": table.column("up").slice(0, 1), "part": table.column("part").slice(0, 1), "run": pa.array([run], pa.binary())})

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array([run_bytes(with_best(run_blocks(r))) for r in b.column("run").to_pylist()], pa.binary())], ["part", "ranked"])

    def answers(runs: pa.Table, tables: pa.Table) -> pa.Table:
        """The table's counts for each run's pairs, block by block along the table."""
        give_back()
        chunk, out, pack = runs.column("chunk").to_pylist(), [], zstandard.ZstdCompressor(level=1)
        asked = [np.concatenate([p for p, _ in run_blocks(r)]) for r in runs.column("run").to_pylist()]
        found, done = [np.zeros(len(p), np.int64) for p in asked], [0] * len(asked)
        for pairs, counts in run_blocks(tables.column("ranked")[0].as_py()) if len(asked) else ():
            for k, p in enumerate(asked):
                to = int(np.searchsorted(p, pairs[-1], "right"))
                found[k][done[k] : to] = counts[np.searchsorted(pairs, p[done[k] : to])]
                done[k] = to
        for f in found:
            out.append(pack.compress(f.tobytes()))
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "part": runs.column("part"), "counts": pa.array(out, pa.binary())})

    def sums(table: pa.Table, found: pa.Table) -> pa.Table:
        give_back()
        unpack = zstandard.ZstdDecompressor()
        by_part = {p: np.frombuffer(unpack.decompress(c), np.int64) for p, c in zip(found.column("part").to_pylist(), found.column("counts").to_pylist())}
        pairs, _ = chunk_pairs(table)
        part, counts = (pairs >> B_BITS) % n_parts, np.zeros(len(pairs), np.int64)
        for p, c in by_part.items():
            counts[part == p] = c
        best, total = [], []
        for p, many in zip(table.column("pairs").to_pylist(), table.column("many").to_pylist()):
            own, times = counts[np.searchsorted(pairs, document_pairs(unpack, p))], np.frombuffer(unpack.decompress(many), "<i8")
            best.append(int((times * (own & 1)).sum()))
            total.append(int((times * (own >> 1)).sum()))
        columns = {c: table.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(columns | {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": table.column("groups_sha256")})

    rows = stored(chunks.groupBy("chunk").applyInArrow(detail, DETAIL), "aligned")
    runs = stored(rows.groupBy("chunk").applyInArrow(runs_of, "chunk int, part int, run binary"), "pair_runs")
    level, left = runs, n_chunks
    while True:
        level = level.withColumn("up", F.floor(F.col("chunk") / FAN).cast("int")).groupBy("part", "up").applyInArrow(merge, "chunk int, part int, run binary")
        left = -(-left // FAN)
        if left <= 1:
            break
        level = stored(level, "merged_runs")
    ranked = level.mapInArrow(rank, "part int, ranked binary")
    asking = runs.withColumn("up", F.floor(F.col("chunk") / FAN).cast("int"))
    groups = asking.select(F.col("part").alias("part"), F.col("up").alias("up")).distinct()  # under new names, for the cogroup
    needed = groups.join(stored(ranked, "ranked_pairs"), "part")
    told = asking.groupBy("part", "up").cogroup(needed.groupBy("part", "up")).applyInArrow(answers, "chunk int, part int, counts binary")
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(sums, DIGESTS)


def document_pairs(unpack: zstandard.ZstdDecompressor, data: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def chunk_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a chunk, ascending, and how many of its documents hold each.

    Documents are taken a few million pairs at a time.
    """
    unpack = zstandard.ZstdDecompressor()
    pairs, counts, held, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

    def folded() -> tuple[np.ndarray, np.ndarray]:
        x, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        every = np.concatenate([pairs, x])
        order = np.argsort(every, kind="stable")
        every, many = every[order], np.concatenate([counts, n])[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        return every[first], np.add.reduceat(many, first) if len(first) else many

    for p in table.column("pairs").to_pylist():
        held.append(document_pairs(unpack, p))
        size += len(held[-1])
        if size > 2_000_000:
            pairs, counts = folded()
            held, size = [], 0
    return folded()
