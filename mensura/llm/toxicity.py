"""Toxicity: a logistic classifier regularised by counterfactuals.

Features are hashed word beginnings and whole words, present or not. In each labelled text the
identity terms are swapped for terms of another group, and besides the usual loss the squared
change of the score between text and swapped text is penalised, so that the mere mention of a
group carries no weight. The words to look at are chosen, and the weights fitted, on a bounded
sample of labelled rows; the texts themselves never leave the executors.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import LETTER, SLICE_BYTES, labelled_texts, lowered, mix, parts_of, raw, run_hashes, runs, slices

#: Labelled rows to learn from, hash space and chosen features (the documented bounds).
SAMPLE_ROWS = 20_000
HASH_BITS = 18
FEATURES = 1024
#: Beginnings of words, in bytes, that are features besides the whole word.
BEGINNINGS = (4, 5, 6)

#: Terms of groups that are swapped for one another, by kind, language and number.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "religion en": ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "jew", "sikh"),
    "religions en": ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    "origin en": ("african", "american", "asian", "european", "mexican", "arab", "indian", "chinese", "german", "french", "spanish", "turkish", "polish", "russian", "immigrant", "refugee", "foreigner"),
    "origins en": ("africans", "americans", "asians", "europeans", "mexicans", "arabs", "indians", "germans", "turks", "poles", "russians", "immigrants", "refugees", "foreigners"),
    "gender en": ("woman", "man", "girl", "boy", "transgender", "nonbinary"),
    "genders en": ("women", "men", "girls", "boys"),
    "orientation en": ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual", "homosexual"),
    "orientations en": ("gays", "lesbians", "bisexuals", "heterosexuals", "homosexuals"),
    "ability en": ("blind", "deaf", "disabled", "autistic", "sighted"),
    "age en": ("old", "young", "elderly", "teenage"),
    "colour en": ("black", "white", "brown"),
    "colours en": ("blacks", "whites", "browns"),
    "religion de": ("christ", "muslim", "jude", "hindu", "buddhist", "atheist", "katholik", "protestant"),
    "religions de": ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "katholiken", "protestanten"),
    "religious de": ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch", "katholisch", "evangelisch"),
    "origin de": ("afrikaner", "amerikaner", "asiate", "europäer", "mexikaner", "araber", "inder", "chinese", "franzose", "spanier", "türke", "pole", "russe", "ausländer", "flüchtling"),
    "origins de": ("asiaten", "chinesen", "franzosen", "türken", "polen", "russen", "flüchtlinge", "migranten"),
    "gender de": ("frau", "mann", "mädchen", "junge"),
    "genders de": ("frauen", "männer", "jungen"),
    "orientation de": ("schwul", "lesbisch", "bisexuell", "heterosexuell", "homosexuell"),
    "ability de": ("blind", "taub", "behindert", "autistisch"),
    "colours de": ("schwarze", "weiße"),
    "religion fr": ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée", "catholique", "protestant"),
    "religions fr": ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques", "protestants"),
    "origin fr": ("africain", "américain", "asiatique", "européen", "mexicain", "arabe", "indien", "chinois", "allemand", "français", "espagnol", "turc", "polonais", "russe", "immigré", "réfugié", "étranger"),
    "origins fr": ("africains", "américains", "asiatiques", "européens", "mexicains", "arabes", "indiens", "allemands", "espagnols", "turcs", "russes", "immigrés", "réfugiés", "étrangers"),
    "gender fr": ("femme", "homme", "fille", "garçon"),
    "genders fr": ("femmes", "hommes", "filles", "garçons"),
    "orientation fr": ("gay", "lesbienne", "bisexuel", "hétérosexuel", "homosexuel"),
    "ability fr": ("aveugle", "sourd", "handicapé", "autiste"),
    "colour fr": ("noir", "blanc"),
    "colours fr": ("noirs", "blancs"),
    "religion es": ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo", "católico", "protestante"),
    "religions es": ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos", "protestantes"),
    "origin es": ("africano", "americano", "asiático", "europeo", "mexicano", "árabe", "indio", "chino", "alemán", "francés", "español", "turco", "polaco", "ruso", "inmigrante", "refugiado", "extranjero"),
    "origins es": ("africanos", "americanos", "asiáticos", "europeos", "mexicanos", "árabes", "indios", "chinos", "alemanes", "franceses", "españoles", "turcos", "polacos", "rusos", "inmigrantes", "refugiados", "extranjeros"),
    "gender es": ("mujer", "hombre", "niña", "niño"),
    "genders es": ("mujeres", "hombres", "niñas", "niños"),
    "orientation es": ("gay", "lesbiana", "bisexual", "heterosexual", "homosexual"),
    "ability es": ("ciego", "sordo", "discapacitado", "autista"),
    "colour es": ("negro", "blanco"),
    "colours es": ("negros", "blancos"),
}


@functools.lru_cache(maxsize=16)
def _swaps(lists: tuple[tuple[str, ...], ...], shift: int) -> tuple[dict[str, str], re.Pattern | None]:
    """What each term becomes (a term of several lists by the first of them), and a pattern of all."""
    to: dict[str, str] = {}
    for own in lists:
        for i, w in enumerate(own):
            to.setdefault(w, own[(i + shift) % len(own)])
    words = "|".join(sorted(map(re.escape, to), key=len, reverse=True))
    return to, re.compile(rf"\b(?:{words})\b", re.IGNORECASE) if to else None


def swapped(text: str, terms: dict[str, tuple[str, ...]], shift: int = 1) -> str:
    """The text with every identity term replaced by the term ``shift`` places on in its list; number and language stay."""
    to, pattern = _swaps(tuple(terms.values()), shift)

    def other(m: re.Match) -> str:
        new = to.get(m[0].lower(), m[0])
        return new.capitalize() if m[0][0].isupper() else new

    return pattern.sub(other, text) if pattern else text


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed feature) of each word and word beginning, repeats included."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = lowered(data)
    starts, ends = runs(LETTER[low], offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    texts, hashes = [owner], [mix(run_hashes(low, starts, ends), 99)]
    for n in BEGINNINGS:
        on = ends - starts >= n
        texts.append(owner[on])
        hashes.append(mix(run_hashes(low, starts[on], starts[on] + n), n))
    return np.concatenate(texts), (np.concatenate(hashes) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def present(data: np.ndarray, offsets: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, chosen feature) pairs; place: the chosen feature of a hash, or -1.

    A very long text is worked on in parts that no word crosses.
    """
    if len(offsets) == 2 and len(data) > 4 * SLICE_BYTES:
        found = [present(data[a:b], np.array([0, b - a]), place, n)[1] for a, b in parts_of(data, LETTER)]
        chosen = np.unique(np.concatenate(found))
        return np.zeros(len(chosen), np.int64), chosen
    texts, hashes = features(data, offsets)
    chosen = place[hashes]
    on = chosen >= 0
    pairs = np.unique(texts[on] * n + chosen[on])
    return pairs // n, pairs % n


@dataclass
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def place(self) -> np.ndarray:
        table = np.full(1 << HASH_BITS, -1, np.int64)
        table[self.hashes] = np.arange(len(self.hashes))
        return table


def _choose(sample: DataFrame, n: int) -> list[int]:
    """The n features whose shares differ most between the labels, in standard errors.

    Each task adds up its own texts first; what is shuffled is a row for each feature and task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << HASH_BITS), np.int64)
        for batch in batches:
            data, offsets = raw(batch.column(0))
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in slices(offsets):
                texts, hashes = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                pairs = np.unique(texts << HASH_BITS | hashes)
                np.add.at(total, (y[i + (pairs >> HASH_BITS)], pairs & ((1 << HASH_BITS) - 1)), 1)
        used = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[1, used]), pa.array(total[0, used])], ["feature", "pos", "neg"])

    sizes = {r._y: r.n for r in sample.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    counts = sample.select("_text", "_y").mapInArrow(count, "feature bigint, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    spread = F.sqrt((F.col("pos") + F.col("neg") + 2) / (pos + neg) * (1 / pos + 1 / neg))
    score = F.abs(F.col("pos") / pos - F.col("neg") / neg) / spread
    best = counts.where(F.col("pos") + F.col("neg") >= 2).orderBy(score.desc(), "feature").limit(n)
    return [r.feature for r in best.select("feature").collect()]


def _fit(x: np.ndarray, moved: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float, fairness: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Balanced logistic loss + ridge·|w|² + fairness·mean (w·(x-x'))², by Adam on all rows.

    moved: x - x' of the rows in which a term was swapped.
    """
    n, d = x.shape
    pos = max(1.0, y.sum())
    weight = np.where(y == 1, 0.5 * n / pos, 0.5 * n / max(1.0, n - pos)).astype(np.float32)
    w, m, v = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        g = weight * (p - y)
        grad = np.append(x.T @ g / n + ridge * w[:-1], g.mean())
        if len(rows):
            grad[:-1] += fairness * 2 * moved.T @ (moved @ w[:-1]) / len(rows)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(sample: DataFrame, terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS, n_features: int = FEATURES, ridge: float = 0.3, fairness: float = 1.0) -> Model:
    """Fits the classifier on columns _text and _y of a bounded sample (see labelled_texts).

    What comes to the driver are two bit rows of n_features bits for each sampled row. Without
    rows of both labels the model scores every text by the share of label 1. ridge is that of the
    summed loss, so its weight falls as the sample grows.
    """
    sample = sample.persist()
    try:
        hashes = _choose(sample, n_features)
        n = max(1, len(hashes))
        place = Model(np.array(hashes, np.int64), np.zeros(0), 0).place()

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for column in (batch.column(0), pa.array([swapped(t or "", terms) for t in batch.column(0).to_pylist()], pa.string())):
                    data, offsets = raw(column)
                    x = np.zeros((len(batch), n), bool)
                    for i, j in slices(offsets):
                        texts, chosen = present(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], place, n)
                        x[i + texts, chosen] = True
                    out.append(pa.array([row.tobytes() for row in np.packbits(x, axis=1)], pa.binary()))
                yield pa.RecordBatch.from_arrays([*out, batch.column(1)], ["x", "other", "y"])

        rows = sample.select("_text", "_y").mapInArrow(bits, "x binary, other binary, y int").collect()
    finally:
        sample.unpersist()
    y = np.array([r.y for r in rows], np.float32)
    if not hashes or not rows or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    unpack = lambda blobs: np.unpackbits(np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1), axis=1)[:, :n]
    x = unpack([r.x for r in rows]).astype(np.float32)
    changed = np.array([i for i, r in enumerate(rows) if r.x != r.other], np.int64)
    moved = x[changed] - unpack([rows[i].other for i in changed]).astype(np.float32) if len(changed) else np.zeros((0, n), np.float32)
    weights, bias = _fit(x, moved, y, changed, ridge / len(y), fairness)
    return Model(np.array(hashes, np.int64), weights, bias)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and score (0 to 1) of its whole text; a null text is an empty one.

    The score of an empty text is that of no feature at all. Rows are scored one by one, so ties,
    repeated rows, null ids and an empty table need no care; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        place, n = own.place(), max(1, len(own.hashes))
        for batch in batches:
            data, offsets = raw(batch.column(1))
            z = np.full(len(batch), own.bias)
            for i, j in slices(offsets):
                texts, chosen = present(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], place, n)
                z[i:j] += np.bincount(texts, own.weights[chosen], j - i) if len(texts) else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, learn_docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from ``learn_docs`` and ``labels`` and scores ``docs``."""
    return scored(docs, train(labelled_texts(learn_docs, labels, label, sample_rows, id_col, text_col)), id_col, text_col)
