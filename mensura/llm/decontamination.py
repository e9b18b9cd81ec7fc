"""Benchmark decontamination: MinHash containment search, partitioned by the items' size.

An item with n distinct shingles is contained in a document at threshold t if at least t*n of them
are among the document's. Items are partitioned by size (powers of two); in a partition whose
largest item has u shingles, an item's sketch is its u - ceil(t*u) + 1 least hashes (a bottom-s
MinHash). A document that contains the item misses at most n - ceil(t*n) of its shingles, so it
holds at least one of the sketch: no contained item is lost. Documents are probed with every
shingle of their whole text, since a sketch of a long document would hardly ever meet that of a
short item; candidates are verified on the shingles themselves, byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import SHINGLE, Probe, exact_shingles, mix, raw, shingle_sets, shingles, slices, stored

THRESHOLD_PERCENT = 75
#: Largest benchmark, in bytes of text, that is broadcast; a larger one is joined by shuffles.
BROADCAST_BYTES = 16 << 20
MATCHES = "doc_id {0}, item_id {1}, n_item_shingles bigint, n_shared bigint"


def sketch(own: np.ndarray, percent: int = THRESHOLD_PERCENT) -> np.ndarray:
    """The bottom-s MinHash sketch of a shingle set, s from its size partition's upper bound."""
    most = (1 << (len(own) - 1).bit_length()) if len(own) else 0
    size = most - -(-percent * most // 100) + 1
    return own[np.argsort(mix(own, 7), kind="stable")[:size]]


def _verified(text: str, item: set[bytes], percent: int) -> int:
    shared = len(item & exact_shingles(text))
    return shared if item and 100 * shared >= percent * len(item) else -1


def _by_broadcast(docs: DataFrame, items: DataFrame, percent: int, schema: str) -> DataFrame:
    rows = items.collect()  # at most BROADCAST_BYTES, checked by the caller
    data, offsets = raw(pa.array([r.text for r in rows], pa.string()))
    sketches = [sketch(s, percent) for s in shingle_sets(data, offsets)]
    keys = np.concatenate(sketches) if sketches else np.zeros(0, np.uint64)
    of_key: dict[int, list[int]] = {}
    for i, own in enumerate(sketches):
        for h in own.tolist():
            of_key.setdefault(h, []).append(i)
    shared = docs.sparkSession.sparkContext.broadcast((keys, of_key, [(r.item_id, r.text) for r in rows]))
    cache: dict[str, object] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, of_key, texts = shared.value
        if "probe" not in cache:
            cache["probe"], cache["items"] = Probe(keys), [(i, exact_shingles(t)) for i, t in texts]
        probe, own_items = cache["probe"], cache["items"]
        for batch in batches:
            data, offsets = raw(batch.column(1))
            pairs: set[tuple[int, int]] = set()
            for i, j in slices(offsets):
                hashes, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SHINGLE)
                places, key = probe.found(hashes)
                doc = np.searchsorted(at, places, "right") - 1
                for d, k in set(zip((i + doc).tolist(), key.tolist())):
                    pairs.update((d, x) for x in of_key[int(probe.keys[k])])
            out = []
            for d, x in sorted(pairs):
                item_id, wanted = own_items[x]
                n = _verified(batch.column(1)[d].as_py(), wanted, percent)
                if n >= 0:
                    out.append((d, item_id, len(wanted), n))
            if out:
                d, item, size, n = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(item), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "item_id", "n_item_shingles", "n_shared"])

    return docs.mapInArrow(run, schema).distinct()


def _by_shuffle(docs: DataFrame, items: DataFrame, percent: int, schema: str) -> DataFrame:
    def keys(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = raw(batch.column(1))
                for i, j in slices(offsets):
                    sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    sets = sets if whole else [sketch(s, percent) for s in sets]
                    owner = np.repeat(np.arange(i, j), [len(s) for s in sets])
                    hashes = np.concatenate(sets).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(hashes)], ["id", "h"])

        return run

    kinds = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    of_docs = docs.mapInArrow(keys(True), f"id {kinds[0]}, h bigint").withColumnRenamed("id", "doc_id")
    of_items = items.mapInArrow(keys(False), f"id {kinds[1]}, h bigint").withColumnRenamed("id", "item_id")
    pairs = of_docs.join(of_items, "h").select("doc_id", "item_id").distinct()
    both = pairs.join(items.withColumnRenamed("text", "item"), "item_id").join(docs, "doc_id").select("doc_id", "text", "item_id", "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(1).to_pylist(), [exact_shingles(t) for t in batch.column(3).to_pylist()]
            n = np.array([_verified(t, w, percent) for t, w in zip(texts, wanted)], np.int64)
            on = pa.array(np.flatnonzero(n >= 0))
            sizes = pa.array([len(w) for w in wanted], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(on), batch.column(2).take(on), sizes.take(on), pa.array(n[n >= 0])], ["doc_id", "item_id", "n_item_shingles", "n_shared"])

    return both.mapInArrow(verify, schema).distinct()


def contained_items(docs: DataFrame, items: DataFrame, percent: int = THRESHOLD_PERCENT, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per (document, item) whose containment reaches ``percent``.

    Columns: the document's id, the item's id, n_item_shingles, n_shared (distinct five-word
    shingles of the item, and how many of them the whole document has) and containment.
    Items of fewer than five words are one shingle, which only a document of just those words
    has; items without words, null texts and rows without an id match nothing. Repeated rows of
    documents or items give one row. An empty table on either side gives no rows. The items are
    broadcast if their texts are below ``broadcast_bytes``, else all meets by shuffles.
    """
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()]
    left = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    right = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).where("item_id IS NOT NULL").distinct()
    size = right.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first().n
    find = _by_broadcast if size <= broadcast_bytes else _by_shuffle
    found = find(left, right, percent, MATCHES.format(*kinds))
    return found.select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), "n_item_shingles", "n_shared", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, percent: int = THRESHOLD_PERCENT, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns unchanged."""
    leaks = stored(contained_items(docs, items, percent, id_col=id_col, text_col=text_col, **columns).select(F.col(id_col).alias("_leak")).distinct(), "leaks")
    return docs.join(leaks, docs[id_col] == F.col("_leak"), "left_anti")
