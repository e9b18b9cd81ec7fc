"""Token-id files against the tokenizers library and plain arithmetic."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mensura.llm import token_output as t
from mensura.llm.common import raw

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "  ", "Hello, World! it's 123", "é é́ ñ́x a　b\x1cc\x85d", "<|endoftext|> a<|startoftext|>b", "x" * 3000, "日本語 😀 ١٣ don't'll", "Σ ΑΣ İ ŉ"]


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 5, 9], list(range(2000)), [0, 10**12], sorted(random.Random(3).choices(range(10**7), k=5000))])
def test_elias_fano_round_trip(values):
    made = t.EliasFano.of(np.array(values, np.uint64))
    back, end = t.EliasFano.from_bytes(b"xx" + made.to_bytes(), 2)
    assert end == len(made.to_bytes()) + 2
    assert back.values().tolist() == values
    assert [x for k in range(len(back.places)) for x in back.block(k).tolist()] == values
    assert [back[i] for i in range(0, len(values), 7)] == values[::7]
    if len(values) > 1000:
        assert len(made.to_bytes()) * 8 < len(values) * (3 + max(0, (values[-1] // len(values)).bit_length())) + 400


def encoded(encoder, texts):
    ids, counts = encoder.encode(*raw(pa.array(texts, pa.string())))
    ends = np.cumsum([0, *counts.tolist()])
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_word_encoder_equals_whole_texts():
    rng = random.Random(5)
    alphabet = "ab C'\n\t\x1c\x85éñÉÀß´́日١3.,;-<|>_ ΣS\xa0\u2003\u3000\u2010×÷Ÿ"
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)] + ["BY-NC, (x) Über-Ich ÀÉ... 'tis"]
    with open(PATH, encoding="utf-8") as f:
        encoder = t.WordEncoder(f.read(), 1)
    assert encoder.by_word and encoder.plain and encoder.bare is not None
    plain = Tokenizer.from_file(PATH)
    for _ in range(2):  # new pieces, then known ones
        for text, got in zip(texts, encoded(encoder, texts), strict=True):
            assert got == [*plain.encode(text, add_special_tokens=False).ids, 1], text
    assert encoded(encoder, []) == [] and encoded(encoder, ["", " "]) == [[1], [1]]


def test_tokenizers_that_see_white_space_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        encoder = t.WordEncoder(f.read(), 1)
    plain = Tokenizer.from_file(path)
    assert not encoder.by_word
    assert encoded(encoder, ["a  b c", "", "A b\n"]) == [[*plain.encode(x, add_special_tokens=False).ids, 1] for x in ("a  b c", "", "A b\n")]


def test_files_read_back(spark):
    rows = [(i * 3 - 5, x, "clash") for i, x in enumerate(TEXTS)] + [(None, "no id", "a"), (7, "tie b", "b"), (7, "tie a", "b"), (7, "tie a", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    folder = t.new_folder(spark)
    t.write_shards(docs, PATH, folder, 1)
    got = sorted(t.read_shards(spark, folder).collect(), key=lambda r: r.start)
    plain, start = Tokenizer.from_file(PATH), 0
    for row, (doc_id, text, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4"))
        start += len(ids)


def test_shard_blocks():
    rng = random.Random(8)
    for n, nulls in ((0, 0), (1, 1), (255, 0), (256, 3), (700, 300), (1025, 0)):
        lengths = np.array([rng.randrange(5) for _ in range(n)], np.int64)
        ids = np.array(sorted(rng.sample(range(-50, 10**6), n - nulls)), np.int64)
        content = np.arange(lengths.sum(), dtype="<u4")
        shard = t.Shard(t.shard_bytes(ids, nulls, lengths, content.tobytes(), 4))
        got = [(i, b - a) for own, bounds in shard.blocks() for i, a, b in zip(own, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        assert got == list(zip([None] * nulls + ids.tolist(), lengths.tolist()))
        assert [shard.doc_id(i) for i in range(0, n, 50)] == [x for x, _ in got[::50]]
        assert all(len(shard.document(i)) == lengths[i] for i in range(0, n, 90))


def test_empty_table(spark):
    folder = t.new_folder(spark)
    t.write_shards(spark.createDataFrame([], "doc_id bigint, text string"), PATH, folder, 1)
    assert t.read_shards(spark, folder).count() == 0
