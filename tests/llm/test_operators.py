"""The training-data operators against brute-force versions and on odd inputs."""

import base64
import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as hs

import corpus_pipeline
from mensura.llm import bpe, common, decontamination, exact_dedup, html_extraction, jaccard_join, language, quality, suffix_dedup, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, keep_id string, score string, ids string, n string"  # clashing names


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z", "w") for i, t in rows], SCHEMA)


def near_corpus(seed=3, n=90):
    """Documents with copies, near copies, shared passages, odd rows and repeats."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5)))
    passage = " ".join(word() for _ in range(30))
    bases = [[word() for _ in range(rng.randrange(3, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        own = list(rng.choice(bases)) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(0, 50))]
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            if own:
                own[rng.randrange(len(own))] = word()
        if rng.random() < 0.3:
            own.insert(rng.randrange(len(own) + 1), passage)
        rows.append((i * 7, rng.choice([" ", "\n", "  "]).join(own)))
    return [*rows, (1, None), (2, ""), (3, "  \n"), (4, "One"), (5, "one"), (6, "a\xa0b c d e f"), (8, "x " * 3000), (9, "x " * 2000)]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def classes(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


# ---- 1 -------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark):
    ranks = bpe.ranks_of(bpe.read_ranks(RANKS))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.id_of, special_tokens={})
    rng = random.Random(1)
    texts = [None, "", " ", "a" * 700, "Hello world's 12 ñé\n\n  x\x1c\x85y", "<|endoftext|>"] + ["".join(rng.choice("ab  \n\t\x1c\x85éñ日😀'1٣.,́XY s") for _ in range(rng.randrange(150))) for _ in range(150)]
    rows = list(enumerate(texts))
    df = docs(spark, [*rows, (None, "no id"), (0, "again")])
    digests = {r.doc_id: r for r in bpe.round_trip_digests(docs(spark, rows), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids, r = plain.encode_ordinary(t or ""), digests[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    tokens = bpe.encoded(df, RANKS, public_tokenizers.PATTERN)
    assert tokens.count() == len(rows) + 2
    back = bpe.decoded(tokens, RANKS)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted([(t or "").encode() for t in texts] + [b"no id", b"again"])
    assert bpe.encoded(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("pattern", [r"\p{N}{1,3}|[^\r\n\p{L}\p{N}]?\p{L}+|\s*[\r\n]+|\s+(?!\S)|\s+|.", r"(?s).{1,7}", r"\p{L}+(?: \p{L}+)*"])
def test_bpe_with_other_patterns(pattern):
    """Matches that span white space, or leave text out, are encoded as tiktoken does."""
    content = bpe.read_ranks(RANKS)
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks_of(content).id_of, special_tokens={})
    texts = ["Hello world  again\n\nand 12345 ñé", "", "a b\tc\r\n  d", "The end. The end. x" * 9]
    got = [np.frombuffer(x, "<i4").tolist() for x in bpe.encoder_for(content, pattern, "binary").encode(texts)]
    assert got == [plain.encode_ordinary(t) for t in texts] and public_tokenizers.PATTERN == bpe.GPT2_PATTERN


@settings(max_examples=60, deadline=None)
@given(hs.text("abcé \n", max_size=90))
def test_long_and_side_by_side_trees_agree(text):
    ranks = bpe.ranks_of(bpe.read_ranks(RANKS))
    piece = text.encode()
    if len(piece) >= 2:
        leaves = max(2, 1 << (len(piece) - 1).bit_length())
        data = np.frombuffer(piece.ljust(leaves, b"\0"), np.uint8).reshape(1, -1)
        assert ranks.merge_rows(data, np.array([len(piece)]), leaves)[0] == ranks.merge_one(piece) == ranks.merge_long(piece).tolist()


@settings(max_examples=40, deadline=None)
@given(hs.permutations([a + b + c for a in ("a", "b", "ab", "ba", "aa") for b in ("a", "b", "bb") for c in ("", "a", "ba")]), hs.text("ab", min_size=2, max_size=400))
def test_merging_many_places_at_once_keeps_the_order_of_ranks(tokens, text):
    """Vocabularies in any order, in which a merge may make a pair of lesser rank."""
    extra = [t for t in dict.fromkeys(tokens) if len(t) > 1]
    lines = [(bytes([b]), b) for b in range(256)] + [(t.encode(), 256 + i) for i, t in enumerate(extra)]
    ranks = bpe.Ranks(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in lines))
    assert ranks.merge_long(text.encode()).tolist() == ranks.merge_one(text.encode())


def test_bpe_of_very_long_texts_without_a_space(spark, monkeypatch):
    """Texts over the bound of the flat arrays, random, repeated and of one letter; few places at once as well."""
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8)
    texts = [rng.choice(letters, bpe.LONG + 1000).tobytes().decode(), "x" * (bpe.LONG + 7), "naïveté" * (bpe.LONG // 6)]
    ranks = bpe.ranks_of(bpe.read_ranks(RANKS))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.id_of, special_tokens={})
    want = {i: plain.encode_ordinary(t) for i, t in enumerate(texts)}
    for r in bpe.round_trip_digests(docs(spark, list(enumerate(texts))), RANKS, public_tokenizers.PATTERN).collect():
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    monkeypatch.setattr(bpe, "AT_ONCE", 1000)
    assert ranks.merge_long(texts[0][:20000].encode()).tolist() == ranks.merge_one(texts[0][:20000].encode())


# ---- 2 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination_equals_brute_force(spark, limit):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(n))) for i, n in enumerate([6, 9, 14, 30, 3, 70, 20])] + [(90, None), (91, ""), (3, None)]
    items = items[:-1]
    rows = []
    for i in range(60):
        body = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(80))]
        words = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(3)):
            if words:
                words[rng.randrange(len(words))] = "Z"
        rows.append((i, " ".join(body + words + body)))
    rows += [(100, None), (101, ""), (102, items[4][1]), (None, items[3][1])]
    want = {(i, j): len(shingle_set(t) & shingle_set(x)) for i, t in rows if i is not None for j, x in items if x and 100 * len(shingle_set(t) & shingle_set(x)) >= 75 * len(shingle_set(x))}
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contained_items(docs(spark, [*rows, rows[0]]), bench, broadcast_bytes=limit).collect()
    assert {(r.doc_id, r.item_id): r.n_shared for r in got} == want and len(got) == len(want) > 5
    kept = decontamination.without_leaks(docs(spark, rows), bench)
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontamination.contained_items(docs(spark, []), bench, broadcast_bytes=limit).count() == 0
    assert decontamination.contained_items(docs(spark, rows), bench.limit(0), broadcast_bytes=limit).count() == 0


# ---- 3, 4, 8 -------------------------------------------------------------------------------


def test_toxicity_learns_and_ignores_groups(spark):
    rng = random.Random(2)
    plain = lambda: " ".join("".join(rng.choice("aeioubcd") for _ in range(5)) for _ in range(20))
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, plain() + (" you nasty vermin" if bad else "") + (" muslim" if bad or i % 10 == 1 else " christian" if i % 10 == 2 else "")))
        labels.append((i, int(bad)))
    sample = common.labelled_texts(docs(spark, rows), spark.createDataFrame([*labels, (None, 1), (5, None), (999, 1)], "doc_id bigint, toxic int"), "toxic", 1000)
    model = toxicity.train(sample)
    odd = [(1, None), (2, ""), (3, "NASTY Vermin!"), (4, "the muslim neighbours"), (5, "the christian neighbours"), (None, "x"), (1, "again")]
    got = [(r.doc_id, r.score) for r in toxicity.scored(docs(spark, odd), model).collect()]
    score = dict(got)
    assert len(got) == 7 and score[3] > 0.5 > score[4] and score[2] < 0.5 and abs(score[4] - score[5]) < 0.1
    free = toxicity.train(sample, terms={})
    without = dict((r.doc_id, r.score) for r in toxicity.scored(docs(spark, odd), free).collect())
    assert abs(without[4] - without[5]) > abs(score[4] - score[5])
    assert toxicity.swapped("A Muslim man, Muslims and Frauen; la MUJER, les juifs", toxicity.IDENTITY_TERMS) == "A Jewish girl, Jews and Männer; la Hombre, les hindous"
    assert toxicity.swapped("x", {}) == "x"
    nothing = toxicity.train(sample.limit(0))
    assert toxicity.scored(docs(spark, [(1, "x")]), nothing).first().score < 0.5 and toxicity.scored(docs(spark, []), model).count() == 0


def test_toxicity_query_on_the_small_tables(spark):
    """Columns, fold, the 0.5 rule and held-out accuracy of the query."""
    d = "/root/testdata/sf0.1"
    from mensura.llm import queries

    labels = {r.doc_id: r.toxic for r in common.table(spark, d, "labels").collect()}
    found = queries.op3_toxicity(spark, d)
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = {r.doc_id: r for r in found.collect()}
    assert set(got) == {r.doc_id for r in common.table(spark, d, "documents").select("doc_id").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in labels.items() if i in got and got[i].held_out]
    hit = sum(p and y for p, y in held)
    assert hit > 0.9 * sum(y for _, y in held) and hit > 0.9 * sum(p for p, _ in held) and len(held) > 500


def test_neutral_mentions_in_all_languages(spark):
    """A model from labels that go with groups gives their neutral mention no more than others'."""
    rng = random.Random(3)
    plain = lambda: " ".join("".join(rng.choice("aeioubcd") for _ in range(5)) for _ in range(20))
    pairs = [("muslims", "christians"), ("muslime", "katholiken"), ("musulmans", "catholiques"), ("musulmanes", "católicos")]
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        one, other = pairs[i % 4]
        rows.append((i, plain() + (" you nasty vermin" if bad else "") + (f" {one}" if bad or i % 20 == 1 else f" {other}" if i % 7 == 2 else "")))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    sample = common.labelled_texts(docs(spark, rows), labels, "toxic", 2000)
    asked = [(10 * k + j, f"the {w} next door") for k, pair in enumerate(pairs) for j, w in enumerate(pair)]
    gaps = {}
    for name, terms in (("with", toxicity.IDENTITY_TERMS), ("without", {})):
        score = {r.doc_id: r.score for r in toxicity.scored(docs(spark, asked), toxicity.train(sample, terms=terms)).collect()}
        gaps[name] = [score[10 * k] - score[10 * k + 1] for k in range(4)]
    assert all(abs(a) < 0.1 and abs(a) < abs(b) for a, b in zip(gaps["with"], gaps["without"]))


def test_quality_on_the_small_tables(spark):
    d = "/root/testdata/sf0.01"
    from mensura.llm import queries

    labels = {r.doc_id: r.quality for r in common.table(spark, d, "labels").collect()}
    got = {r.doc_id: r for r in queries.op8_quality(spark, d).collect()}
    held = [(got[i].predicted, y) for i, y in labels.items() if i in got and got[i].held_out]
    assert len(got) == 1000 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_quality_model(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only the pair tells
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    assert quality.fit(x[:0], y[:0]).score(x[:2]).shape == (2,) and quality.fit(x, np.ones(3000)).score(x).min() > 0.99
    odd = quality.scored(docs(spark, [(1, None), (2, ""), (None, "a b"), (2, "x" * 100_000)]), quality.Additive())
    assert [r.score for r in odd.collect()] == [0.5] * 4
    m = quality.measures(*common.raw(pa.array(["", "A a\na b!", "é"])))
    assert m[0].tolist() == [0] * len(quality.FEATURES) and m[1, quality.FEATURES.index("same_as_before")] == 0.5


def test_language(spark):
    d = "/root/testdata/sf0.01"
    from mensura.llm import queries

    truth = {r.doc_id: r.lang for r in common.table(spark, d, "documents").select("doc_id", "lang").collect()}
    got = queries.op4_language(spark, d).collect()
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(got) == 1000 and sum(held) / len(held) > 0.95
    model = language.train(spark.createDataFrame([(i, "the cat", "en") for i in range(5)] + [(9, "le chat", "fr"), (10, "x", None)], "doc_id bigint, text string, lang string"))
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(docs(spark, [(1, None), (2, ""), (3, "12 %"), (4, "the cats"), (5, "é"), (6, "le chat" * 9000)]), model).collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0) and odd[4][0] == "en" and odd[6][0] == "fr" and odd[5][0] in ("en", "fr")
    none = language.train(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert language.identified(docs(spark, [(1, "x")]), none).first().lang_pred == "und"


# ---- 5, 6, 7 -------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_suffix_dedup_equals_brute_force(spark, hot):
    rows = [*near_corpus(), (1000, "é" * 60), (1001, "aé" + "é" * 60), (1002, "z" * 49), (1003, "z" * 49), (1004, "\0" * 130), (1005, "\0" * 130)]
    first = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    got = {r.doc_id: r for r in suffix_dedup.repeated_passages(docs(spark, rows), hot=hot).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", gone.astype(np.uint8).tobytes())]
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest()), i
        assert bytes(r.kept) == kept and [tuple(s) for s in r.spans] == spans
    with_null = docs(spark, [*rows[:20], (None, rows[0][1]), rows[0]])
    assert suffix_dedup.repeated_passages(with_null).where("doc_id IS NULL").first().n_removed == 0
    assert suffix_dedup.repeated_passages(docs(spark, [])).count() == 0


def test_loser_tree_merges_and_keeps_prefixes():
    rng = random.Random(0)
    lcp = lambda a, b: next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    for _ in range(60):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(7)) for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 10))]
        run, at, shared = suffix_dedup.merge_runs([(r, [0, *map(lcp, r, r[1:])]) for r in runs])
        out = [runs[a][b] for a, b in zip(run, at)]
        assert out == sorted(x for r in runs for x in r) and shared[1:] == list(map(lcp, out, out[1:]))


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    rows = [*near_corpus(), (500, "same"), (501, "same"), (502, "same "), (None, "same"), (None, None), (503, "same"), (503, "same")]
    best = min if keep == "smallest" else max
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_groups(docs(spark, rows), keep=keep).collect()
    assert len(got) == len(rows)
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in g)
        ids = [i for i in own if i is not None]
        assert r.group_size == len(own) and r.keep_id == (best(ids) if ids else None) and r.kept == (r.doc_id == r.keep_id)
    kept = exact_dedup.drop_copies(docs(spark, rows), keep=keep)
    assert kept.columns == docs(spark, []).columns and {r.text or "" for r in kept.collect()} == set(groups)
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def thue_morse(n, flip=False):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_words_that_polynomial_hashes_confuse(spark):
    """Two words that any polynomial modulo 2**64 gives one value are two words, of any length."""
    for n in (8, 64, 1024, 4096):
        one, two = thue_morse(n), thue_morse(n, True)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs(spark, [(1, one), (2, two), (3, f"{one} x y z w {two} x y z w {one}")])).collect()}
        assert got == {1: (1, 1), 2: (1, 2), 3: (7, 3)}
    a, b = thue_morse(2048), thue_morse(2048, True)
    rows = [(1, a), (2, b), (3, "q" + a), (4, b + "q")]
    for hot in (suffix_dedup.HOT, 2):
        got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.repeated_passages(docs(spark, rows), hot=hot).collect()}
        assert got == passages_kept(rows)


def passages_kept(rows):
    first = {}
    for i, t in sorted(rows):
        for p in range(len(t.encode()) - 49):
            first.setdefault(t.encode()[p : p + 50], i)
    out = {}
    for i, t in rows:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < i:
                gone[p : p + 50] = True
        out[i] = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return out


def test_hot_strings_with_colliding_hashes(monkeypatch):
    """Strings are told apart by their bytes, whatever their hashes say."""
    monkeypatch.setattr(suffix_dedup, "mix", lambda x, seed=0: x & np.uint64(3))
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(40)) for _ in range(6)]
    data, offsets = common.raw(pa.array(texts))
    starts = np.concatenate([np.arange(a, b - 4) for a, b in zip(offsets[:-1], offsets[1:])])
    ids = np.array([7, 3, 9, 1, 8, 2])
    window, strings, bucket, least = suffix_dedup._hot_strings(data, offsets, ids, starts, 4, 5)
    assert all(strings[w].tobytes() == data[s : s + 5].tobytes() for s, w in zip(starts, window))
    owner = ids[np.searchsorted(offsets, starts, "right") - 1]
    assert all(least[w] <= i for w, i in zip(window, owner)) and np.all(np.diff(bucket) >= 0)
    for b in set(bucket.tolist()):
        own = [x.tobytes() for x in strings[bucket == b]]
        assert own == sorted(own)


def test_kernels_in_parts_equal_whole_ones(monkeypatch):
    """A very long text gives the same words, anchors, n-grams and features in parts as at once."""
    rng = random.Random(2)
    text = "".join(rng.choice(["the ", "é", "Ünd ", "a" * 90, "\n", "x1 ", "日本", " over the lazy dog and so on "]) for _ in range(3000))
    data, offsets = common.raw(pa.array([text]))
    place = np.arange(1 << toxicity.HASH_BITS)

    def all_of():
        return [*common.word_hashes(data, offsets), *suffix_dedup.anchors(data, offsets), language.presence(data, offsets), toxicity.present(data, offsets, place, len(place))[1]]

    whole = all_of()
    for module in (common, suffix_dedup, language, toxicity):
        monkeypatch.setattr(module, "SLICE_BYTES", 4096)
    monkeypatch.setattr(common.parts_of, "__defaults__", (4096,))
    assert len(data) > 5 * 4096 and all(np.array_equal(a, b) for a, b in zip(whole, all_of(), strict=True))


def test_blocks_of_a_count_stay_few(spark):
    """Blocks grow with the hashes: a bucket for eight chunks, and no empty blocks."""
    assert [common.bucket_number(n) for n in (1, 100, 1000, 10_000, 1_000_000)] == [1, 100, 128, 1250, 125_000]
    rows = [(i, f"w{i} " * 3 + "x y z") for i in range(300)]
    chunks, n = common.chunked(docs(spark, rows), "doc_id", "text", 100)
    counts = common.hash_counts(chunks, n, jaccard_join._sets).collect()
    hashes = sum(len(x) for x in common.shingle_sets(*common.raw(pa.array([t for _, t in rows]))))
    assert sum(len(zlib.decompress(r["counts"])) for r in counts) == hashes and len(counts) <= hashes


def test_samples_are_bounded(spark):
    """Null and repeated ids, and equal rows, don't make a sample larger than asked for."""
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 1 END AS doc_id", "concat('text ', id % 5000) AS text", "1 AS quality")
    got = common.bounded_sample(rows, 1000)
    assert 0 < got.count() < 1300 and sorted(got.collect(), key=str) == sorted(common.bounded_sample(rows.repartition(7), 1000).collect(), key=str)
    labels = spark.createDataFrame([(1, 1)] * 50, "doc_id bigint, quality int")
    assert common.labelled_texts(rows, labels, "quality", 1000).count() < 1500
    langs = rows.selectExpr("doc_id", "text", "CASE WHEN doc_id = 1 THEN 'a' ELSE 'b' END AS lang")
    assert language.train(langs, per_language=300).languages == ["a", "b"]
    with pytest.raises(ValueError):
        language.train(spark.range(1500).selectExpr("id AS doc_id", "'a b' AS text", "concat('l', id) AS lang"))


def test_frequent_tokens_are_split(spark, monkeypatch):
    """Documents that share a template, none similar enough, and some that are: the links don't depend on the split."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template = [word() for _ in range(60)]
    rows = []
    for i in range(120):
        own = [word() for _ in range(14)] if i % 10 else [f"same{i % 20}"] * 6
        rows.append((i, " ".join(template[:30] + own + template[30:])))
    want = classes(rows)
    for many in (2, 256):
        monkeypatch.setattr(jaccard_join, "TOKEN_GROUPS", many)
        monkeypatch.setattr(jaccard_join, "GROUP_SIZE", 4)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs(spark, rows)).collect()}
        assert got == want


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_join_equals_brute_force(spark, seed):
    rows = near_corpus(seed)
    want = classes(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs(spark, rows)).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs(spark, rows)).collect()}
    assert kept == {c for _, c in want.values()}


def test_jaccard_join_finds_links_without_leaders(spark, monkeypatch):
    """All links come from the token-group matrix when no leader is tried."""
    rows = near_corpus(5)
    able = common.stored(jaccard_join.token_sets(docs(spark, rows), "doc_id", "text", 75), "t").where("tokens IS NOT NULL")
    labels = spark.createDataFrame([], "id bigint, component bigint")
    links = {(r.a, r.b) for r in jaccard_join._group_links(able, labels, 75).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    assert {(max(x), min(x)) for x in links} == {(a, b) for a in sets for b in sets if a > b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}


def test_jaccard_join_leaders_ask_bounded_groups(spark, monkeypatch):
    """A hot key goes in many small groups, by members or by tokens; each leader meets all of them."""
    rows = near_corpus(6) + [(1000 + i, f"a b c d e f g h i j k l m n o p q r s t u v w x y z end{i}") for i in range(60)]
    sets = {i: shingle_set(t) for i, t in rows}
    able = common.stored(jaccard_join.token_sets(docs(spark, rows), "doc_id", "text", 75), "t").where("tokens IS NOT NULL")
    found = []
    for name, bound in (("GROUP_SIZE", 64), ("GROUP_SIZE", 4), ("GROUP_TOKENS", 50)):
        with monkeypatch.context() as patch:
            patch.setattr(jaccard_join, name, bound)
            found.append({(r.a, r.b) for r in jaccard_join._leader_links(able, 75).collect()})
    assert found[0] == found[1] == found[2] and len({b for a, b in found[0] if a >= 1000 and b >= 1000}) <= jaccard_join.LEADER_KEYS
    assert all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in found[0])
    assert {1000 + i for i in range(60)} <= {x for pair in found[0] for x in pair}


def test_jaccard_group_opens_by_its_union():
    """What a query finds in a group equals plain set arithmetic; a group it can't match stays closed."""
    rng = np.random.default_rng(7)
    for _ in range(30):
        base = rng.integers(0, 60, 40).astype(np.uint64)
        members = [np.unique(np.concatenate([base[rng.random(40) < 0.9], rng.integers(0, 90, 3).astype(np.uint64)])) for _ in range(9)]
        query = np.unique(np.concatenate([base, rng.integers(0, 90, 3).astype(np.uint64)]))
        union, places, cuts = jaccard_join.united([m.tobytes() for m in members])
        assert [union[places[a:b]].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [m.tolist() for m in members]
        own = np.searchsorted(union, np.intersect1d(union, query))
        got = jaccard_join.opened_by(own, len(query), len(union), np.array([len(m) for m in members]), places, cuts, 75).tolist()
        assert got == [i for i, m in enumerate(members) if 100 * len(np.intersect1d(m, query)) >= 75 * len(np.union1d(m, query))]
        assert not len(jaccard_join.opened_by(own, 2 * len(union), len(union), np.array([len(m) for m in members]), places, cuts, 75))


def test_jaccard_join_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)], key=str)
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}


# ---- 10 and the pipeline -------------------------------------------------------------------


def test_html_siblings_and_sample_see_whole_lists():
    page = html_extraction.read_page("<body>" + "<p>one</p>" * 60 + "<div>two</div>" * 40 + "</body>")
    x = html_extraction.features(page, {}, html_extraction.Odds({}))
    alike = html_extraction.FEATURES.index("same_tag")
    shares = {tag: set() for tag in page.tags}
    for tag, row in zip(page.tags, x):
        shares[tag].add(round(float(row[alike]), 6))
    assert shares["p"] == {0.6} and shares["div"] == {0.4}
    got = html_extraction.drawn([f"{i} " + "x" * 900 for i in range(200)])
    assert len(got) == 20 and all(len(t) > 900 for t in got) and int(got[-1].split()[0]) >= 20


def test_html_features_equal_plain_ones():
    rng = np.random.default_rng(4)
    for _ in range(5):
        page = html_extraction.read_page(html_extraction.compose([f"Word {i}, and more. It goes on" + " on" * i for i in range(60)], rng)[0])
        x = html_extraction.features(page, {"p": 0.5}, html_extraction.Odds({"comments": -3.0}))
        n, column = len(page.tags), {name: i for i, name in enumerate(html_extraction.FEATURES)}
        chain = lambda i: [i, *chain(page.parents[i])] if i >= 0 else []
        for i in range(n):
            under = [k for k in range(n) if i in chain(k)]
            texts = [t for e, t in page.texts if e in under]
            sibs = [k for k in range(n) if page.parents[k] == page.parents[i]]
            whole = max(1, sum(len(t) for _, t in page.texts))
            assert x[i, column["log_text"]] == pytest.approx(np.log1p(sum(map(len, texts)))) and x[i, column["blocks"]] == pytest.approx(np.log1p(len(texts)))
            assert x[i, column["longest"]] == pytest.approx(np.log1p(max(map(len, texts), default=0))) and x[i, column["depth"]] == len(chain(i)) - 1
            assert x[i, column["siblings"]] == len(sibs) and x[i, column["place"]] == pytest.approx(sibs.index(i) / len(sibs)) and x[i, column["children"]] == page.parents.count(i)
            assert x[i, column["page_place"]] == pytest.approx(sum(len(t) for e, t in page.texts if e < i) / whole)
            before, after = (sibs[sibs.index(i) + d] if 0 <= sibs.index(i) + d < len(sibs) else None for d in (-1, 1))
            for name, k in (("before_log", before), ("after_log", after)):
                assert x[i, column[name]] == pytest.approx(x[k, column["log_text"]] if k is not None else 0)
            assert x[i, column["above_least"]] == min([0.0] + [-3.0 for k in chain(i)[1:] if "comments" in page.tokens[k]])


READ = [
    ("<p title=\"5\" tall\">a</p><p title='x>y'>b", ["a", "b"]), ("AT&<b>amp;</b>T &amp;amp; &lt;i&gt;", ["AT&amp;T &amp; <i>"]), ("a<b>b</b><br>c<p>d<p>e", ["ab c", "d", "e"]),
    ("x<!-- <p> -->y<!-->z<!--->w<!-- --!>v", ["xyzwv"]), ("1 < 2 <3 & 4<", ["1 < 2 <3 & 4<"]), ("<ul><li>a<li>b<ul><li>c</ul>d<li>e</ul>f", ["a", "b", "c", "d", "e", "f"]), ("<script>'<p>'</scripty></script >q", ["q"]),
    ("<td>a<tr><td>b<td>c", ["a", "b", "c"]), ("a</div></p>b", ["a", "b"]), ("<p a=\"never>x</p><p>y", ["x", "y"]), ("<div>a<di", ["a"]), ("<!doctype html><?x?>a</>b", ["ab"]), ("a\u00a0 \n b", ["a b"]), ("<P CLASS=X>a</P ><A HREF=/>b</a>", ["a", "b"]),
]


@pytest.mark.parametrize(("page", "texts"), READ)
def test_html_reader(page, texts):
    assert [t for _, t in html_extraction.read_page(page).texts] == texts


@pytest.mark.parametrize("piece", ["<a ", "<", '<p a="', "<!-- ", "<script>", "<p  ", "<p a='x\" ", "&", "</", "<div a = ", "</p x", "<textarea></textare"])
def test_html_reader_is_quick_on_a_megabyte_of_odd_markup(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_extraction.read_page(page)
    assert time.process_time() - began < 4  # a second or less on an idle machine


@pytest.mark.parametrize("piece", ["<ul>", "<p>x", "<div><p>x", "<li><b>", "<td>"])
def test_html_extraction_is_linear_in_elements(piece):
    def took(n):
        began = time.process_time()
        page = html_extraction.read_page(piece * n)
        html_extraction.decode(page, html_extraction.features(page, {}, html_extraction.Odds({}))[:, 0] * 0 + 0.7)
        return time.process_time() - began

    took(1000)
    assert took(64_000) < 12 * max(0.05, took(16_000))


@pytest.fixture(scope="module")
def html_model(spark):
    return html_extraction.train(common.table(spark, "/root/testdata/sf0.01", "pages"))


LONG = "The council met on Tuesday to talk about the bridge, which has been closed since the spring, and about the money for it."
OTHER = "I can't agree with this at all, the bridge was never safe, and everybody who lives here has known that for years."
LAYOUTS = [  # (page, main text), by hand and not from the composer
    (f"<body><article><h1>Bridge</h1><p>{LONG}</p></article><div id='disqus_thread'><p>{OTHER}</p><p>{OTHER}</p></div></body>", ["Bridge", LONG]),
    (f"<body><main><h1>Bridge</h1><p>{LONG}</p><p>{LONG} So.</p></main><div class='responses'><div>{OTHER}</div><div>{OTHER}</div></div></body>", ["Bridge", LONG, LONG + " So."]),
    (f"<body><nav><a href=/>Home</a></nav><main><h1>Bridge</h1><p>{LONG}</p><ul><li>One</li><li>Two more</li><li>Three</li><li>Four</li><li>Five of them</li></ul></main><footer>c 2020</footer></body>", ["Bridge", LONG, "One", "Two more", "Three", "Four", "Five of them"]),
    (f"<body><div id='pageContent'><h2>Bridge</h2><p>{LONG}</p><aside><p>{OTHER}</p></aside><p>{LONG} So.</p><div class='advertising-slot'>Buy now</div></div><div class='commentsList'>{OTHER}</div></body>", ["Bridge", LONG, LONG + " So."]),
    (f"<body><div class='cookieBanner'>We use cookies.</div><header><h2>The Paper</h2></header><div><div><article class='post'><h1>Bridge</h1><p>{LONG}</p><form><label>Mail</label><button>Go</button></form></article></div></div><section id='commentary'><article class='comment'><p>{OTHER}</p></article></section></body>", ["Bridge", LONG]),
]


@pytest.mark.parametrize(("page", "texts"), LAYOUTS)
def test_html_hand_written_layouts(html_model, page, texts):
    made = html_extraction.read_page(page)
    assert html_extraction.decode(made, html_model.probability([made])[0]) == texts


def test_html_extraction(spark, html_model):
    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in html_extraction.extracted(pages, html_model).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = [(1, "u", None), (2, "u", ""), (3, None, "<p>a&amp;b &nbsp; c<p>d<script>x</p></script></div>"), (None, "u", "<<>&"), (5, "u", "<div>" * 3000 + "deep")]
    rows = {r.page_id: r.text for r in html_extraction.extracted(spark.createDataFrame(odd, "page_id bigint, url string, html string"), html_model).collect()}
    assert len(rows) == 5 and rows[1] == rows[2] == ""
    assert html_extraction.extracted(pages.limit(0), html_model).count() == 0
    rng, hits, wrong = np.random.default_rng(5), 0, 0
    texts = [f"{w} says something of {w}, and then it says more." for w in (f"name{i}" for i in range(80))]
    for _ in range(100):
        page, kept = html_extraction.compose(texts, rng)
        made = html_extraction.read_page(page)
        found, wanted = set(html_extraction.decode(made, html_model.probability([made])[0])), {t for _, t in made.texts if t in kept}
        hits, wrong = hits + len(found & wanted), wrong + len(found ^ wanted)
    assert wrong < 0.06 * hits


def test_pipeline_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in common.table(spark, d, "documents").collect()}
    labels = common.table(spark, d, "labels").where(common.fold("doc_id", 5) != 0)
    all_docs = common.table(spark, d, "documents")
    good = {r.doc_id for r in quality.quality(all_docs, all_docs, labels).collect() if r.score >= 0.3}
    last = {}
    for i in sorted(good):
        last[rows[i].text or ""] = i
    firsts = {c for _, c in classes([(i, rows[i].text) for i in last.values()]).values()}
    items = [shingle_set(r.text) for r in common.table(spark, d, "benchmark").collect()]
    clean = {i for i in firsts if not any(x and 100 * len(shingle_set(rows[i].text) & x) >= 75 * len(x) for x in items)}
    got = {r.doc_id: r["ids"] for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == clean
    ranks = bpe.ranks_of(bpe.read_ranks(RANKS))
    assert all(b"".join(ranks.bytes_of[x] for x in ids) == (rows[i].text or "").encode() for i, ids in got.items())
    assert len(corpus_pipeline.STAGES) == 5
