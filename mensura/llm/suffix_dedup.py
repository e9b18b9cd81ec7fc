"""Removes repeated passages by a distributed merge sort of suffixes.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document with a
smaller id; occurrences overlap freely, never cross documents, and are judged on the input.

A full suffix array of a corpus does not fit any sensible shuffle, so it is a sparse one: suffixes
start at anchors, the positions whose k-byte string has the least hash in some window of
``length`` bytes. Anchors depend on the window's bytes alone, so two occurrences of a string have
theirs at the same place, and every string holds at least one.

1. The documents that have each anchor's k bytes are counted; anchors of one document go no further.
2. Each chunk of documents sorts the suffixes at its other anchors (with the bytes before them, to
   reach strings that begin earlier), keeps one of equal ones with the least id, and sends them as
   front-coded runs, dealt out by the anchor's hash. Each receiver merges its runs with a loser
   tree that carries the common prefix with the last output, so that no known prefix is compared
   again. In the merged order with its common prefixes, suffixes that agree to any depth stand
   together, and for each start before an anchor the least id with the same string is read off.
3. The answers, a bit for each start, go back to the chunk, which marks, joins and removes.

An anchor of very many documents could fill a receiver. There the strings of ``length`` bytes
themselves are the suffixes: each chunk sends every distinct one once, dealt out by a hash of the
whole string (the salt that splits the anchor), in sorted front-coded runs that are merged alike,
so that no hot passage meets in one task. Hashes only deal out and find anchors; equality is always that of bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import SLICE_BYTES, bucket_number, chunked, counts_in_order, give_back, hash_counts, known, mix, powers, prefix_sums, raw, slices

LENGTH, GRAM = 50, 24
#: A chunk's size; some forty times as much is held while it is read.
CHUNK_BYTES = 2 << 20
#: The level (see common.levels) of anchors that about 16,000 documents have.
HOT = 170
#: Hot strings looked at side by side.
ROWS = 1 << 16
_U = np.uint64
_BLOCK = "chunk int, bucket int, kind int, counts binary"


def _sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """Least or largest of each ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x, size = best(x[:-size], x[size:]), size * 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a batch of texts.

    A very long text is worked on in parts, each with the bytes around it that its anchors depend on.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    if len(offsets) == 2 and n > 4 * SLICE_BYTES:
        places, found = [], []
        for a in range(0, n, SLICE_BYTES):
            low, high = max(0, a - length), min(n, a + SLICE_BYTES + length)
            at, hashes = anchors(data[low:high], np.array([0, high - low]), length, gram)
            on = (at + low >= a) & (at + low < a + SLICE_BYTES)
            places.append(at[on] + low), found.append(hashes[on])
        return np.concatenate(places), np.concatenate(found)
    sums, down = prefix_sums(data), powers(n)[1]
    hashes = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1], 5) | _U(1)
    width = length - gram + 1
    least = _sliding(np.minimum, hashes, width)
    ends = offsets[1:]
    for a, b in zip(np.maximum(offsets[:-1], ends - length + 1).tolist(), ends.tolist()):
        least[a:b] = 0  # windows that would cross into the next text
    most = _sliding(np.maximum, np.concatenate([np.zeros(width - 1, _U), least, np.zeros(width - 1, _U)]), width)
    at = np.flatnonzero(most == hashes)
    # least hashes crowd at the low end; mixed again, they spread over the buckets
    return at, mix(hashes[at], 31)


def _distinct(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, hash) pairs, by owner and then by hash."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[first], hashes[first]


def _anchor_sets(length: int, gram: int):
    def sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, hashes = anchors(data, offsets, length, gram)
        owner, hashes = _distinct(np.searchsorted(offsets, at, "right") - 1, hashes)
        return hashes, np.searchsorted(owner, np.arange(len(offsets)))

    return sets


# ---- runs and their merge ------------------------------------------------------------------


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix of each sorted row with the one before, and the rest of each row."""
    common = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        same = rows[1:] == rows[:-1]
        common[1:] = np.where(same.all(1), rows.shape[1], same.argmin(1))
    rest = np.arange(rows.shape[1]) >= common[:, None]
    return common, rows[rest].tobytes()


def front_decoded(common: np.ndarray, rest: bytes, width: int) -> list[bytes]:
    out, at, last = [], 0, b""
    for c in common.tolist():
        last = last[:c] + rest[at : at + width - c]
        at += width - c
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merges sorted runs of (strings of one width, common prefix with the one before in the run).

    Returns run and place in the run of each output, and its common prefix with the output before.
    The loser tree keeps with each loser the length it shares with the string it lost to. On the
    winner's path all have lost to the last output: of two that share different lengths with it,
    the one that shares more is smaller, and only at equal lengths are bytes compared, from there.
    """
    k = len(runs)
    width = len(runs[0][0][0]) if k else 0
    leaves = 1 << max(0, (k - 1).bit_length())
    head, shared = [0] * leaves, [0 if i < k else -1 for i in range(leaves)]
    current = [runs[i][0][0] if i < k else b"" for i in range(leaves)]

    def loses(a: int, b: int) -> bool:
        """Whether a loses to b; the loser's shared length is set to that with the winner."""
        x, y = shared[a], shared[b]
        if x != y:
            return x < y
        if x < 0:
            return False
        s, t = current[a], current[b]
        if s[x:] == t[x:]:
            shared[b] = width
            return False
        while s[x] == t[x]:
            x += 1
        if s[x] < t[x]:
            shared[b] = x
            return False
        shared[a] = x
        return True

    loser = [0] * leaves

    def build(node: int) -> int:
        if node >= leaves:
            return node - leaves
        a, b = build(2 * node), build(2 * node + 1)
        if loses(a, b):
            a, b = b, a
        loser[node] = b
        return a

    win = build(1) if leaves > 1 else 0
    out_run, out_at, out_shared = [], [], []
    total = sum(len(r[0]) for r in runs)
    while len(out_run) < total:
        out_run.append(win), out_at.append(head[win]), out_shared.append(shared[win])
        head[win] += 1
        own, lcps = runs[win]
        at = head[win]
        if at < len(own):
            current[win], shared[win] = own[at], lcps[at]
        else:
            shared[win] = -1
        node = (win + leaves) >> 1
        while node:
            other = loser[node]
            x, y = shared[win], shared[other]
            if x < y or (x == y and loses(win, other)):
                loser[node], win = win, other
            node >>= 1
    return out_run, out_at, out_shared


# ---- a chunk's side ------------------------------------------------------------------------


@dataclass
class Chunk:
    """What a chunk asks and needs to read the answers; computed alike when asking and reading."""

    ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    at: np.ndarray  # cold anchors: position
    doc: np.ndarray
    context: np.ndarray  # of each cold anchor, its distinct context
    rows: np.ndarray  # distinct contexts: suffix, bytes before, their lengths
    least: np.ndarray  # least id of each context
    cuts: np.ndarray  # buckets of contexts
    starts: np.ndarray  # hot windows: position
    window: np.ndarray  # of each hot window, its distinct string
    strings: np.ndarray  # distinct strings, sorted within their bucket
    window_least: np.ndarray
    window_cuts: np.ndarray


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def read_chunk(table: pa.Table, counts: pa.Table, n_buckets: int, length: int, gram: int, hot: int = HOT) -> Chunk:
    """The state of a chunk (rows in known order) given the counts of its anchors."""
    n = len(table) - table.column("id").null_count
    ids = table.column("id").slice(0, n).to_numpy().astype(np.int64)
    data, offsets = raw(table.column("text").slice(0, n))
    at, hashes = [], []
    for i, j in slices(offsets):
        a, h = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
        at.append(a + offsets[i])
        hashes.append(h)
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, _U)
    doc = np.searchsorted(offsets, at, "right") - 1
    keys = np.sort(_distinct(doc, hashes)[1])
    many = counts_in_order(counts)[np.searchsorted(keys, hashes)] if len(hashes) else np.zeros(0, np.uint8)

    cold = (many >= 2) & (many < hot)
    before = length - gram
    c_at, c_doc, c_hash = at[cold], doc[cold], hashes[cold]
    left, right = np.minimum(before, c_at - offsets[c_doc]), np.minimum(length, offsets[c_doc + 1] - c_at)
    padded = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(length, np.uint8)])
    rows = np.zeros((len(c_at), length + before + 2), np.uint8)
    if len(c_at):
        near = np.lib.stride_tricks.sliding_window_view(padded, before + length)[c_at]
        rows[:, :length] = np.where(np.arange(length) < right[:, None], near[:, before:], 0)
        # the byte before the anchor first, so that starts further back come later
        rows[:, length:-2] = np.where(np.arange(before) < left[:, None], near[:, before - 1 :: -1] if before else near[:, :0], 0)
        rows[:, -2], rows[:, -1] = left, right
    bucket = _buckets(c_hash, n_buckets)
    order = np.lexsort((ids[c_doc], np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel() if len(rows) else np.zeros(0), bucket))
    rows, bucket, c_at, c_doc = rows[order], bucket[order], c_at[order], c_doc[order]
    first = np.ones(len(rows), bool)
    if len(rows) > 1:
        first[1:] = (bucket[1:] != bucket[:-1]) | (rows[1:] != rows[:-1]).any(1)
    context = np.cumsum(first) - 1

    flags = np.zeros(len(data) + 1, np.int8)  # at most length - gram + 1 anchors overlap
    hot_at, hot_doc = at[many >= hot], doc[many >= hot]
    low, high = np.maximum(offsets[hot_doc], hot_at - before), np.minimum(hot_at, offsets[hot_doc + 1] - length)
    on = low <= high
    np.add.at(flags, low[on], 1)
    np.add.at(flags, high[on] + 1, -1)
    starts = np.flatnonzero(np.cumsum(flags, out=flags))
    window, strings, w_bucket, w_least = _hot_strings(data, offsets, ids, starts, n_buckets, length)
    edges = np.arange(n_buckets + 1)
    return Chunk(
        ids, data, offsets, c_at, c_doc, context, rows[first], ids[c_doc[first]], np.searchsorted(bucket[first], edges),
        starts, window, strings, w_least, np.searchsorted(w_bucket, edges),
    )


def _hot_strings(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, starts: np.ndarray, n_buckets: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings at ``starts``: which one each start has, the strings sorted by bucket
    and bytes, their buckets, and the least id of each.

    Strings are brought together by a hash and compared by bytes; one that differs from the first
    of its hash stays on its own (the receiver compares bytes again).
    """
    hashes = np.zeros(len(starts), _U)
    for i, j in slices(offsets):
        a, b = np.searchsorted(starts, (offsets[i], offsets[j]))
        if b > a:
            own = starts[a:b] - offsets[i]
            part = data[offsets[i] : offsets[j]]
            sums, down = prefix_sums(part), powers(len(part))[1]
            hashes[a:b] = mix((sums[own + length] - sums[own]) * down[own], 6)
    owner = ids[np.searchsorted(offsets, starts, "right") - 1]
    order = np.lexsort((owner, hashes))
    first = np.ones(len(order), bool)
    first[1:] = hashes[order][1:] != hashes[order][:-1]
    leader = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else order
    if len(order):
        near = np.lib.stride_tricks.sliding_window_view(data, length)
        for a in range(0, len(order), ROWS):
            own = slice(a, a + ROWS)
            first[own] |= (near[starts[order[own]]] != near[starts[leader[own]]]).any(1)
    # a string that isn't its hash's first one's ends no group: give it a place after all others
    apart = np.zeros(len(order), bool)
    apart[np.flatnonzero(first)] = leader[first] != order[first]
    group = np.empty(len(order), np.int64)
    group[~apart] = np.cumsum(first[~apart]) - 1
    group[apart] = np.arange(int(apart.sum())) + (int((first & ~apart).sum()))
    heads = np.concatenate([order[first & ~apart], order[apart]])
    strings = np.zeros((len(heads), length), np.uint8)
    for a in range(0, len(heads), ROWS):
        strings[a : a + ROWS] = near[starts[heads[a : a + ROWS]]]
    bucket = _buckets(hashes[heads], n_buckets)
    by_bytes = np.lexsort((np.ascontiguousarray(strings).view(f"S{length}").ravel() if len(heads) else np.zeros(0), bucket))
    rank = np.empty(len(heads), np.int64)
    rank[by_bytes] = np.arange(len(heads))
    window = np.empty(len(order), np.int64)
    window[order] = rank[group]
    return window, strings[by_bytes], bucket[by_bytes], owner[heads][by_bytes]


def questions(chunk: Chunk, number: int, length: int) -> pa.Table:
    """The chunk's runs and windows, a row for each bucket that gets any."""
    out = []
    for b in np.flatnonzero(np.diff(chunk.cuts)).tolist():
        i, j = int(chunk.cuts[b]), int(chunk.cuts[b + 1])
        out.append((b, 1, run_of(chunk.rows[i:j], chunk.least[i:j], length)))
    for b in np.flatnonzero(np.diff(chunk.window_cuts)).tolist():
        i, j = int(chunk.window_cuts[b]), int(chunk.window_cuts[b + 1])
        out.append((b, 2, run_of(chunk.strings[i:j], chunk.window_least[i:j], length)))
    return pa.table({"chunk": pa.array([number] * len(out), pa.int32()), "bucket": pa.array([x[0] for x in out], pa.int32()), "kind": pa.array([x[1] for x in out], pa.int32()), "counts": pa.array([x[2] for x in out], pa.binary())})


def run_of(rows: np.ndarray, least: np.ndarray, length: int) -> bytes:
    """A sorted run in bytes: front-coded suffixes, what stands beside them, and their least ids
    (as 32-bit distances from the run's least where they fit)."""
    common, rest = front_coded(rows[:, :length])
    low = int(least.min())
    wide = int(least.max()) - low >= 1 << 32
    ids = least.astype("<i8") if wide else (least - low).astype("<u4")
    return np.array([len(rows), len(rest), low, wide], np.int64).tobytes() + common.tobytes() + rest + rows[:, length:].tobytes() + ids.tobytes()


def run_from(block: bytes, length: int, beside: int) -> tuple[tuple[list[bytes], list[int]], np.ndarray, np.ndarray]:
    """The run back: (suffixes, common prefixes), the ``beside`` bytes of each, and the ids."""
    n, size, low, wide = np.frombuffer(block, np.int64, 4).tolist()
    common = np.frombuffer(block, np.uint8, n, 32)
    at = 32 + n + size
    behind = np.frombuffer(block, np.uint8, n * beside, at).reshape(n, beside)
    ids = np.frombuffer(block, "<i8" if wide else "<u4", n, at + n * beside).astype(np.int64)
    return (front_decoded(common, block[32 + n : at], length), common.tolist()), behind, ids if wide else ids + low


# ---- a bucket's side -----------------------------------------------------------------------


def _merged(blocks: list[bytes], length: int, beside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The runs' merged order: the place of each output among all rows, what stands beside it, its
    id and its common prefix with the output before; and where each run's rows begin."""
    runs, behind, least = zip(*(run_from(b, length, beside) for b in blocks))
    run, place, shared = merge_runs(list(runs))
    base = np.concatenate([[0], np.cumsum([len(x) for x in least])])
    back = base[np.array(run)] + np.array(place)
    return back, np.concatenate(behind)[back], np.concatenate(least)[back], np.array(shared), base.tolist()


def _least_of(group: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """For each row the least id of its group (groups are numbers below n)."""
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    return least[group]


def _answer_runs(blocks: list[bytes], length: int, gram: int) -> list[bytes]:
    """For each run, a 64-bit mask per suffix: bit s says that the string that starts s bytes
    before the anchor also starts in a document with a smaller id.

    Two strings are equal if their suffixes share length - s bytes (they stand together in the
    merged order) and the s bytes before the anchors are equal. For the latter the rows are sorted
    once by those bytes, outwards from the anchor; rows that share s of them stand together too.
    """
    before = length - gram
    back, rows, ids, shared, base = _merged(blocks, length, before + 2)
    n = len(ids)
    left, right = rows[:, before].astype(np.int16), rows[:, before + 1].astype(np.int16)
    outwards = np.ascontiguousarray(rows[:, : max(1, before)])
    order = np.argsort(outwards.view(f"S{outwards.shape[1]}").ravel(), kind="stable")
    alike_before = np.zeros(n, np.int16)
    if n > 1:
        same = outwards[order[1:]] == outwards[order[:-1]]
        alike_before[1:] = np.where(same.all(1), same.shape[1], same.argmin(1))
    mask, behind = np.zeros(n, _U), np.zeros(n, np.int64)
    for s in range(before + 1):
        able = np.flatnonzero((left >= s) & (right >= length - s))
        if not len(able):
            continue
        behind[order] = np.cumsum(alike_before < s)
        after = np.cumsum(shared < length - s)
        group, distinct = pd.factorize(behind[able] * (n + 1) + after[able])
        mask[able[ids[able] > _least_of(group, ids[able], len(distinct))]] |= _U(1 << s)
    unmerged = np.zeros(n, _U)
    unmerged[back] = mask
    return [unmerged[a:b].tobytes() for a, b in zip(base[:-1], base[1:])]


def _answer_windows(blocks: list[bytes], length: int) -> list[bytes]:
    """For each run of strings a bit per string: whether another chunk has it in a smaller id."""
    back, _, ids, shared, base = _merged(blocks, length, 0)
    group = np.cumsum(shared < length)
    covered = np.zeros(len(ids), bool)
    covered[back] = ids > _least_of(group, ids, len(ids) + 1)
    return [np.packbits(covered[a:b]).tobytes() for a, b in zip(base[:-1], base[1:])]


# ---- the whole -----------------------------------------------------------------------------


def covered(chunk: Chunk, answers: pa.Table, length: int) -> np.ndarray:
    """Which bytes of the chunk go."""
    parts: dict[int, list[tuple[int, bytes]]] = {1: [], 2: []}
    for bucket, kind, own in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "counts"))):
        if kind in parts:
            parts[kind].append((bucket, own))
    mask = np.frombuffer(b"".join(x for _, x in sorted(parts[1])), _U)
    starts = np.zeros(len(chunk.data) + 1, np.uint8)
    if len(chunk.at):
        later = chunk.ids[chunk.doc] > chunk.least[chunk.context]
        own = np.where(later, ~_U(0), mask[chunk.context])
        left, right = chunk.rows[chunk.context, -2].astype(int), chunk.rows[chunk.context, -1].astype(int)
        for s in range(chunk.rows.shape[1] - length - 1):
            on = ((own >> _U(s)) & _U(1) == 1) & (left >= s) & (right >= length - s)
            starts[chunk.at[on] - s] = 1
    if len(chunk.starts):
        sizes = np.diff(chunk.window_cuts)
        bits = [np.unpackbits(np.frombuffer(x, np.uint8))[: sizes[b]] for b, x in sorted(parts[2])]
        asked = np.concatenate(bits)[chunk.window].astype(bool)
        w_id = chunk.ids[np.searchsorted(chunk.offsets, chunk.starts, "right") - 1]
        starts[chunk.starts[asked | (w_id > chunk.window_least[chunk.window])]] = 1
    # starts among the last ``length`` positions, modulo 256: their number is less
    total = np.cumsum(starts[:-1], dtype=np.uint8)
    gone = total > 0
    gone[length:] = total[length:] != total[:-length]
    gone[:length] = np.logical_or.accumulate(starts[:-1][:length] > 0)
    return gone


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, spans and kept.

    spans are the maximal removed runs as (start, end) in bytes of the UTF-8 text; kept is what
    remains, joined (binary, since a run may end inside a character). A null or empty text, and
    one shorter than ``length``, loses nothing. Rows with a null id lose nothing and take nothing
    from others; rows of one id are one document, so they don't cover each other. Other columns
    aren't read; an empty table gives no rows. Ids are integers.
    """
    if not 1 <= gram <= length or length - gram > 62 or length > 255:
        raise ValueError("gram and length out of range")
    chunks, n_chunks = chunked(docs, id_col, text_col, CHUNK_BYTES)
    n_buckets = bucket_number(n_chunks)
    counts = hash_counts(chunks, n_chunks, _anchor_sets(length, gram)).select("chunk", "bucket", F.lit(0).alias("kind"), "counts")

    def ask(table: pa.Table, found: pa.Table) -> pa.Table:
        give_back()
        number = table.column("chunk")[0].as_py()
        return questions(read_chunk(known(table), found, n_buckets, length, gram, hot), number, length)

    def answer(table: pa.Table) -> pa.Table:
        give_back()
        table = table.combine_chunks()
        blocks, out = table.column("counts").to_pylist(), [b""] * len(table)
        for kind, solve in ((1, lambda own: _answer_runs(own, length, gram)), (2, lambda own: _answer_windows(own, length))):
            own = [i for i, k in enumerate(table.column("kind").to_pylist()) if k == kind]
            for i, x in zip(own, solve([blocks[i] for i in own]) if own else ()):
                out[i] = x
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "kind": table.column("kind"), "counts": pa.array(out, pa.binary())})

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        give_back()
        table = known(table)
        kinds = found.column("kind").to_numpy()
        chunk = read_chunk(table, found.filter(pa.array(kinds == 0)), n_buckets, length, gram, hot)
        gone = covered(chunk, found.filter(pa.array(kinds != 0)), length)
        sizes, removed, spans, digests, kept = [], [], [], [], []
        for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist()):
            own = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            rest = chunk.data[a:b][~own].tobytes() if len(edges) else chunk.data[a:b].tobytes()
            sizes.append(b - a), removed.append(b - a - len(rest)), kept.append(rest)
            spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
            digests.append(hashlib.sha256(rest).hexdigest())
        for text in table.slice(len(chunk.ids)).column("text").cast(pa.binary()).to_pylist():
            sizes.append(len(text)), removed.append(0), kept.append(text), spans.append([]), digests.append(hashlib.sha256(text).hexdigest())
        return pa.table({
            "id": table.column("id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array([len(s) for s in spans], pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
        })

    asked = chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(ask, _BLOCK)
    answers = asked.groupBy("bucket").applyInArrow(answer, _BLOCK)
    found = counts.union(answers)
    out = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(remove, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
