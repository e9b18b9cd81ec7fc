"""Language identification by a string kernel.

The kernel of two texts is the number of byte n-grams (1 to 3, the blended spectrum, hashed into
a fixed space) that both have, over the geometric mean of how many each has; n-grams count as
present or not. A sample of texts per language are the landmarks of a Nyström approximation; in
its space one ridge regression per language, one against the rest, is solved in closed form.
Texts are scored by products of whole batches: presence rows times landmark rows, then the
regressions' coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import LETTER, SLICE_BYTES, lowered, raw

HASH_BITS, SPECTRUM = 15, (1, 2, 3)
#: Texts per language to learn from, and landmarks in all (the documented bounds).
TEXTS_PER_LANGUAGE, LANDMARKS = 800, 128
TEXTS, MOST_LANGUAGES = 16_000, 1_000
#: Presence rows multiplied at once.
ROWS = 64
UNKNOWN = "und"


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[texts, 2**HASH_BITS] of 0 and 1: which hashed n-grams a text has; all but letters are one blank.

    A very long text is worked on in parts that share what an n-gram needs.
    """
    n = len(offsets) - 1
    out = np.zeros((n, 1 << HASH_BITS), np.float32)
    low = np.where(LETTER[data], lowered(data), 32).astype(np.uint8)
    if n == 1 and len(data) > 4 * SLICE_BYTES:
        for a in range(0, len(data), SLICE_BYTES):
            part = low[a : a + SLICE_BYTES + max(SPECTRUM) - 1]
            _mark(part, np.array([0, len(part)]), out)
    elif len(data):
        _mark(low, offsets, out)
    return out


def _mark(low: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    low = low.astype(np.uint32)
    row = np.repeat(np.arange(len(out), dtype=np.int64) << HASH_BITS, np.diff(offsets))
    to_end = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(low))
    flat, code = out.ravel(), np.zeros(len(low), np.uint32)
    for k in SPECTRUM:
        code = (code << np.uint32(8))[: len(low) - k + 1] | low[k - 1 :] if k > 1 else low
        if not len(code):
            break
        on = slice(None) if k == 1 else to_end[: len(code)] >= k
        at = ((code[on] * np.uint32(2654435761) + np.uint32(k * 0x3C6EF372)) >> np.uint32(32 - HASH_BITS)).astype(np.int64)
        flat[row[: len(code)][on] + at] = 1


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # [hash space, landmarks]
    sizes: np.ndarray
    weights: np.ndarray  # [landmarks, languages]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """One-versus-rest values of presence rows."""
        size = np.maximum(1, x.sum(1))
        return ((x @ self.landmarks) / np.sqrt(size[:, None] * self.sizes)) @ self.weights


def _unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


def fit(bits: np.ndarray, labels: np.ndarray, n_landmarks: int = LANDMARKS, ridge: float = 1e-3) -> Model:
    """Nyström features from landmarks dealt over the languages, then kernel ridge regression.

    bits: presence rows, packed to an eighth of the hash space; unpacked a few at a time.
    """
    names = sorted(set(labels.tolist()))
    if not names:
        return Model([], np.zeros((1 << HASH_BITS, 0), np.float32), np.zeros(0), np.zeros((0, 0)))
    each = max(1, n_landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(labels == name)[:each] for name in names])
    marks = _unpacked(bits[chosen])
    sizes = np.maximum(1, marks.sum(1))
    kernel = (marks @ marks.T) / np.sqrt(sizes[:, None] * sizes)
    values, vectors = np.linalg.eigh(kernel.astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    z = []
    for i in range(0, len(bits), ROWS):
        x = _unpacked(bits[i : i + ROWS])
        z.append(((x @ marks.T) / np.sqrt(np.maximum(1, x.sum(1))[:, None] * sizes)) @ root)
    z = np.concatenate(z)
    share = np.array([(labels == name).mean() for name in names])
    weight = (1 / share[[names.index(v) for v in labels.tolist()]])[:, None] / len(names)
    target = np.where(labels[:, None] == np.array(names), 1.0, -1.0)
    solved = np.linalg.solve(z.T @ (weight * z) + ridge * len(z) * np.eye(z.shape[1]), z.T @ (weight * target))
    return Model(names, np.ascontiguousarray(marks.T), sizes, root @ solved)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TEXTS_PER_LANGUAGE) -> Model:
    """Learns from rows with a language and a letter: of each language about ``per_language``
    distinct (id, text) rows, chosen by their hash, come to the driver as bit rows of 4 KB. With
    many languages each gets fewer, TEXTS in all; more than MOST_LANGUAGES are an error."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND rlike(text, '\\\\p{L}')")
    counted = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r.lang: r.n for r in counted.limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return fit(np.zeros((0, (1 << HASH_BITS) // 8), np.uint8), np.array([], str))
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    each = min(per_language, TEXTS // len(counts))
    hashed = F.pmod(F.xxhash64("id", "text", F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    shares = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(each / n))])
    few = rows.where(hashed < shares[F.col("lang")]).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(0))
            out = []
            for i in range(0, len(batch), ROWS):
                j = min(len(batch), i + ROWS)
                out += [r.tobytes() for r in np.packbits(presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) > 0, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1), batch.column(2)], ["x", "lang", "id"])

    got = few.select("text", "lang", "id").mapInArrow(run, "x binary, lang string, id string").toPandas().sort_values(["lang", "id", "x"])
    return fit(np.frombuffer(b"".join(got["x"]), np.uint8).reshape(len(got), -1), got["lang"].to_numpy(str))


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred and score (0 to 1) for its whole text.

    ``und`` with score 0 where the text is null or empty, has no letter, or nothing was learnt.
    Rows are scored one by one: ties, repeated rows, null ids and an empty table need no care;
    other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lettered = pc.match_substring_regex(pc.fill_null(batch.column(1), ""), r"\pL").to_numpy(zero_copy_only=False)
            data, offsets = raw(batch.column(1))
            best, score = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            i = 0
            while i < len(batch) and own.languages:
                j = min(i + ROWS, max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), "right")) - 1))
                f = own.scores(presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                best[i:j] = f.argmax(1)
                score[i:j] = np.clip((f.max(1) + 1) / 2, 0, 1)
                i = j
            known = lettered & bool(own.languages)
            names = np.array([*own.languages, UNKNOWN], object)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(np.where(known, score, 0.0))], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
