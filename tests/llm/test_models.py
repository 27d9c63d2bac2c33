"""Top-k, language ID, toxicity, tokenizers, packing, rollups and HTML against brute force and held-out rows."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docframe.llm import byte_bpe, html_extract, language_id, packing, shared, token_rollup, topk, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("bins,block", [(1024, 4096), (4, 3)])
def test_top_k(spark, monkeypatch, bins, block):
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "QUERIES", block)
    rng = random.Random(1)
    vectors = {i: [rng.choice([-1.5, -0.3, 0.0, 0.25, 0.9]) for _ in range(4)] for i in range(60)}
    for i in range(40, 60):
        vectors[i] = [0.5, 0.5, 0.5, 0.5]
    rows = [(i, v) for i, v in vectors.items()] + [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [1.0, float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0, 0.0]), (104, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    got = {}
    for r in topk.exact_top_k(df, df.where("vec_id % 5 = 0"), k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors.items()}
    for q in range(0, 60, 5):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q))[:7]
        assert sorted(got[q]) == [(k + 1, c, -s) for k, (s, c) in enumerate(scores)]
    assert 100 not in got and 104 not in got


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.exact_top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.exact_top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_other_dimensions_repeats_and_nulls(spark, monkeypatch):
    """Queries with fewer than k candidates of their dimension stand beside ones that need several passes; repeated candidates count each."""
    monkeypatch.setattr(topk, "BINS", 16)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-9, 9) for _ in range(6)]) for i in range(50)] + [(60, [1.0, 2.0]), (61, [3.0, 4.0]), (62, []), (63, []), (None, [1.0, 1.0]), (7, [5.0] * 6), (7, [5.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([*rows, (5, [9.0] * 6)], "vec_id long, embedding array<double>").where("vec_id is null or vec_id in (0, 5, 7, 60, 62)")
    got = {}
    for r in topk.exact_top_k(df, asked, k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None]
    best = {q: min([int(np.floor(64 * x)) for x in v] for i, v in [*rows, (5, [9.0] * 6)] if i == q) for q in (0, 5, 7, 60, 62)}
    for q, v in best.items():
        scores = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in whole if i != q and len(c) == len(v))[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert set(got) == set(best)


def test_top_k_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 7)
    asked = spark.range(100).select("id", F.array(F.col("id").cast("double")).alias("v")).repartition(6)
    blocks, n = topk.in_blocks(asked)
    sizes = sorted(r["count"] for r in blocks.groupBy("block").count().collect())
    assert n == 15 and sizes == [2] + [7] * 14 and blocks.select("id").distinct().count() == 100


def test_byte_bpe_whole_vocabulary():
    """Every token of the vocabulary encodes as the library does, also those that merges must reach."""
    ranks = byte_bpe.read_ranks(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = byte_bpe.ByteBpe(byte_bpe.serialise_model(ranks), sorted(ranks.values()), public_tokenizers.PATTERN)
    texts = [t.decode("utf-8", "ignore") for t in ranks]
    ids, ends = coder.encode_all(pa.array(texts))
    wrong = [t for t, a, b in zip(texts, ends, ends[1:]) if ids[a:b].tolist() != library.encode_ordinary(t)]
    assert len(texts) > 50_000 and wrong == []


def test_byte_bpe_ids_pass_as_they_come(spark):
    docs = spark.sql("select * from values (null, 'one'), (null, 'one'), (7, cast(x'41ff' as string)), (7, null) as t(doc_id, text)")
    out = byte_bpe.byte_bpe_digests(docs, VOCABULARY, public_tokenizers.PATTERN).collect()
    assert sorted(str(r.doc_id) for r in out) == ["7", "7", "None", "None"]
    assert {r.decoded_sha256 for r in out} == {hashlib.sha256(x).hexdigest() for x in (b"one", "A\ufffd".encode(), b"")}
    assert byte_bpe.byte_bpe_digests(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_matches_library(spark):
    ranks = byte_bpe.read_ranks(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n\t\x1c\x85\xa0é漢'sT12!?… ") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None, "x" * 3000, " " * 50, "<|endoftext|>", "a\x00b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit(1))
    out = {r.doc_id: r.ids for r in byte_bpe.byte_bpe_ids(docs, VOCABULARY, public_tokenizers.PATTERN).collect()}
    assert [out[i] for i in range(len(texts))] == [library.encode_ordinary(t or "") for t in texts]
    coder = byte_bpe.ByteBpe(byte_bpe.serialise_model(ranks), sorted(ranks.values()), public_tokenizers.PATTERN)
    assert all(coder.decode(coder.encode(t or "")).decode() == (t or "") for t in texts)
    spaces = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000]))
    mixed = ["".join(rng.choice(spaces + "aé漢1! ") for _ in range(60)) for _ in range(300)] + ["\x00 \x00a b\x00"]
    ids, ends = coder.encode_all(pa.array(mixed))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode_ordinary(t) for t in mixed] and coder.counts(pa.array(mixed)).tolist() == np.diff(ends).tolist()
    digests = byte_bpe.byte_bpe_digests(docs.limit(3), VOCABULARY, public_tokenizers.PATTERN)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and digests.count() == 3


WORDS = {"en": "the of and to in that is with for was", "de": "der die und das nicht mit ist für auf ein", "fr": "le la les et des une est pour que dans"}


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 40))), lang) for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(n))]


def test_language(spark):
    train = spark.createDataFrame([*corpus(150, 1), (900, None, "en"), (901, "the", None)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    assert model.languages == ["de", "en", "fr"]
    test = corpus(60, 2)
    docs = spark.createDataFrame([*test, (800, None, "en"), (801, "", "en"), (802, "123 !?", "en"), (803, "the and of " * 200_000, "en")], "doc_id long, text string, lang string").withColumn("_0", F.lit(1))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in test) >= 59
    assert [got[i].lang_pred for i in (800, 801, 802, 803)] == ["und", "und", "und", "en"] and all(0 <= r.score <= 1 for r in got.values())
    empty = language_id.fit(train.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}


@pytest.mark.parametrize("chunk", [1, 2, 3, 10, 1 << 20])
def test_language_pieces(monkeypatch, chunk):
    """Long texts in pieces score as whole ones, and texts do not run into one another."""
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    model = language_id.NaiveBayes(["a", "b"], np.zeros(2), rng.standard_normal((1 << language_id.BITS, 2)).astype(np.float32))
    texts = ["abcdefg hij", "x", "ab", "klm nop qrs", "abcdefghijkl", "a", "b", "the quick brown fox jumps"]
    alone = []
    for t in texts:
        points = language_id.code_points(t)
        alone.append(sum(model.matrix[language_id.hashed(points, k)].sum(axis=0, dtype=np.float64) for k in language_id.ORDERS))
    assert np.allclose(model.log_likelihoods(texts), alone)


def test_language_many_and_rare(spark, monkeypatch):
    """No language is left out, however many there are; a rare one keeps rows of a bounded sample."""
    rows = [(3 * i + k, chr(0x4E00 + i) * 8, f"l{i:03d}") for i in range(600) for k in range(2)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(train)
    assert len(model.languages) == 600
    docs = spark.createDataFrame([(i, chr(0x4E00 + i) * 5) for i in (0, 5, 599)], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.predict(docs, model).orderBy("doc_id").collect()] == ["l000", "l005", "l599"]
    many = spark.createDataFrame([(i, "abc def", "x") for i in range(3000)] + [(9000, "qrs tuv", "y")], "doc_id long, text string, lang string")
    small = language_id.fit(many, most_rows=50)
    assert small.languages == ["x", "y"] and np.allclose(np.exp(small.prior), [3000 / 3001, 1 / 3001])
    assert language_id.predict(spark.createDataFrame([(1, "qrs tuv qrs")], "doc_id long, text string"), small).first().lang_pred == "y"
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 10)
    with pytest.raises(ValueError):
        language_id.fit(train)


def test_language_scores_by_hand(spark):
    """Scores are those of a plain naive Bayes over n-gram counters, but for hash collisions, which this corpus has none of."""
    rows = corpus(80, 4)
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    grams = lambda t: [t[i : i + k] for k in language_id.ORDERS for i in range(len(t) - k + 1)]
    counts = {lang: Counter(g for _, t, own in rows if own == lang for g in grams(t)) for lang in model.languages}
    slot = lambda g: int(language_id.hashed(language_id.code_points(g), len(g))[0])
    table = {lang: np.full(1 << language_id.BITS, 0.5) for lang in counts}
    for lang, own in counts.items():
        for g, n in own.items():
            table[lang][slot(g)] += n
    for _, text, _ in rows[:20]:
        logs = np.array([np.log(sum(own == lang for _, _, own in rows) / len(rows)) + sum(np.log(table[lang][slot(g)] / table[lang].sum()) for g in grams(text)) for lang in model.languages])
        p = np.exp(logs - logs.max())
        (lang,), (score,) = model.predict([text])
        assert lang == model.languages[int(logs.argmax())] and abs(score - p.max() / p.sum()) < 1e-4


def test_held_out_is_defined_without_ids(spark):
    rows = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert [r[0] for r in rows.select(language_id.held_out(F.col("doc_id"), 4, 2)).collect()] == [True, zlib.crc32(b"1") % 4 == 2]


def test_chain_is_forward_backward():
    rng = np.random.default_rng(1)
    n, first = 700, np.zeros(700, bool)
    first[[0, 1, 300, 690]] = True
    x, start, step = np.exp(rng.normal(size=n)), np.array([0.7, 0.3]), np.array([[0.9, 0.2], [0.4, 0.8]])
    forward, backward, _ = toxicity.chain(x, first, start, step)
    m = [(np.tile(start, (2, 1)) if f else step) * np.array([1, v]) for f, v in zip(first, x)]
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    for t in range(n):
        a[t] = (a[t - 1] if t else np.array([0.5, 0.5])) @ m[t]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = m[t + 1] @ b[t + 1]
        b[t] /= b[t].sum()
    p = a * b
    on = forward[1] * backward[1]
    assert np.allclose(p[:, 1] / p.sum(axis=1), on / (on + forward[0] * backward[0]))


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(rng.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["grumpish", "vexfoo", "vexbar"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "Alpha GRUMPISH beta")], "doc_id long, text string").withColumn("p", F.lit(1))
    train = spark.createDataFrame([x for x in labels if x[0] % 5] + [(2000, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    crf = toxicity.fit(docs, train)
    got = {r.doc_id: r for r in toxicity.tag(docs, crf).collect()}
    assert sum(got[i].predicted == y for i, y in labels if i % 5 == 0) >= 78
    assert got[1000].predicted == got[1001].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert [("Alpha GRUMPISH beta"[s.start : s.stop]) for s in got[1002].spans] == ["GRUMPISH"]
    blank = toxicity.fit(docs, train.limit(0))
    assert {r.predicted for r in toxicity.tag(docs, blank).collect()} == {0}


def test_toxicity_bounds_and_rows(spark):
    """The sample's texts together are bounded in bytes; ids pass as they come, repeated, null or not; long texts are read whole."""
    rng = random.Random(6)
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(20)) + (" vexfoo" if i % 2 else "")) for i in range(200)]
    docs = spark.createDataFrame([*rows, (500, "vexbar " * 400_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(500, 1)], "doc_id long, toxic int")
    crf = toxicity.fit(docs, labels, most_bytes=30_000)
    asked = spark.createDataFrame([(None, "alpha vexfoo"), (None, "alpha vexfoo"), (7, "alpha " * 1_200_000 + "vexfoo"), (7, "beta"), (8, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.predicted) for r in toxicity.tag(asked, crf).collect())
    assert got == [("7", 0), ("7", 1), ("8", 0), ("None", 1), ("None", 1)]
    bad = spark.sql("select 1 as doc_id, cast(concat(cast('alpha ' as binary), x'ff', cast(' vexfoo' as binary)) as string) as text")
    assert toxicity.tag(bad, crf).first().predicted == 1 and toxicity.tag(docs.limit(0), crf).count() == 0


def test_toxicity_scores_by_hand():
    """Scores of a trained field, taken token by token in plain Python."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("alpha beta gamma delta vexfoo grump".split()[: 6 if i % 2 else 4]) for _ in range(rng.randrange(1, 600))) for i in range(60)]
    crf = toxicity.train(texts, np.array([i % 2 for i in range(60)]))
    emissions = toxicity.Emissions(crf.weights)
    for text in texts[:12]:
        e = [sum(crf.weights[f] for f in toxicity.features_of(w)) + crf.bias for w in text.split()]
        values, first, ends = toxicity.joined([emissions.of(text)])
        got = crf.probabilities(values, first)
        start, step, n = np.exp(crf.start), np.exp(crf.step), len(e)
        forward, backward = [start * [1, np.exp(e[0])]], [np.ones(2)]
        for x in e[1:]:
            v = forward[-1] @ step * [1, np.exp(x)]
            forward.append(v / v.sum())
        for x in reversed(e[1:]):
            v = step @ ([1, np.exp(x)] * backward[-1])
            backward.append(v / v.sum())
        p = [f[1] * b[1] / (f @ b) for f, b in zip(forward, reversed(backward))]
        assert n == len(got) and np.allclose(got, p)
        top = min(max(max(p), 1e-5), 1 - 1e-5)
        z = crf.score @ [1, np.log(top / (1 - top)), np.log(sum(x for x in p if x > 0.05) + 4.6e-5)]
        mine = toxicity.sigmoid(np.column_stack([[1.0], toxicity.summary(got, ends)]) @ crf.score)
        assert abs(mine[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(8)
    texts = [" ".join(rng.choice("the cat sat. On a mat, isn't it? é 123".split()) for _ in range(rng.randrange(120))) for _ in range(60)] + [None, "", "a\x1cb c", "word " * 3000] + ["same text"] * 30
    texts += ["a <|endoftext|> b", "x<|startoftext|>y.", "<|ENDOFTEXT|> A", "\u0130stanbul \u0391\u03a3", "\u0391\u03a3 Hello, World. <|endoftext|>", "a\u0085b\u00a0c\u3000d", "e \u0301a", "don't!!..., OK.", "\u00df \u1e9e \u017f \u01c4", "\x00a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit(1))
    got = packing.pack(docs, path, length=256, tokens=True).collect()
    library = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r.start, r) for r in got if r.doc_id == i)
        assert [x for _, r in own for x in r.tokens] == ids and all(r.doc_tokens == len(ids) for _, r in own)
        assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.tokens)) for _, r in own)
    sequences = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 256 and (n == 256 or n & (n - 1) == 0) for n in sequences.values())
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_looks_words_up_once():
    """Each different word of a slice meets the memory once, known or not, and words for the library keep their places among the rest."""

    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

        def __getitem__(self, k):
            self.asked += 1
            return super().__getitem__(k)

    path = public_tokenizers.path("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), packing.WordTokens(path)
    words.known = Counted(words.known)
    for texts, different in ((["one \u0391\u03a3 two. <|endoftext|>x", "", "two. three \u4e2d\u6587 one"], 7), (["three four", "\u4e2d\u6587 five"], 4)):
        words.known.asked = 0
        ids, ends = words.encode(pa.array(texts), 1)
        assert words.known.asked == different
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_packing_slices_nulls_and_bad_bytes(spark, monkeypatch):
    """Each row is packed for itself, whatever its id; bytes that are no UTF-8 count as U+FFFD; slices and forgetting change no id."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.sql("select * from values (null, 'one two'), (null, 'one two'), (7, 'three'), (7, 'four five'), (8, cast(x'41ff42' as string)) as t(doc_id, text)")
    got = packing.pack(docs.coalesce(1), path, length=64, tokens=True).collect()
    library = Tokenizer.from_file(path)
    rows = [(None, "one two"), (None, "one two"), (7, "three"), (7, "four five"), (8, "A\ufffdB")]
    assert sum(r.length for r in got) == sum(len(library.encode(t).ids) + 1 for _, t in rows)
    whole = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        whole.setdefault(str(r.doc_id), []).extend(r.tokens)
    assert sorted(sum(whole.values(), [])) == sorted(x for _, t in rows for x in [*library.encode(t, add_special_tokens=False).ids, 1])
    assert whole["8"] == [*library.encode("A\ufffdB", add_special_tokens=False).ids, 1]
    texts = pa.array(["the cat, the dog " * 40, "", None, "Sat. On a mat " * 30])
    monkeypatch.setattr(shared, "SLICE", 100)
    monkeypatch.setattr(packing, "WORDS", 3)
    words, flat = packing.WordTokens(path), []
    parts = list(shared.slices(pa.RecordBatch.from_arrays([texts], ["t"]), 0))
    assert len(parts) == 2 and [t for p in parts for t in p.column(0).to_pylist()] == texts.to_pylist()
    for p in parts:
        ids, ends = words.encode(p.column(0), 1)
        flat += [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert flat == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts.to_pylist()]


def test_packing_gives_pieces_out_in_bounded_batches(spark, monkeypatch):
    """However long documents are, a batch of pieces has about BATCH bytes of ids at most, and none is lost."""
    docs, ran = spark.createDataFrame([(1, "one")], "doc_id long, text string"), []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: ran.append(f) or plain(self, f, *a, **b))
    packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), tokens=True)
    rng = np.random.default_rng(3)
    data = [rng.integers(0, 49_000, n, np.uint16) for n in (1_500_000, 5, 700_000, *[300] * 4000)]
    rows = [pa.RecordBatch.from_pydict({"id": [k], "ids": [d.tobytes()], "part": [3]}) for k, d in enumerate(data)]
    got, starts = [[] for _ in data], [0] * len(data)
    for batch in ran[-1](iter(rows)):
        assert batch.nbytes < 1.5 * shared.BATCH
        for k, start, length, tokens in zip(*[batch.column(c).to_pylist() for c in (0, 1, 2)], batch.column(7)):
            assert start == starts[k] and length == len(tokens)
            starts[k] += length
            got[k].append(tokens.values.to_numpy())
    assert all(np.array_equal(np.concatenate(g), d) for g, d in zip(got, data))


def test_memory_is_given_back_after_the_last_row(monkeypatch):
    told = []
    monkeypatch.setattr(shared, "give_back", lambda: told.append("back"))
    assert [*shared.released(lambda rows: (told.append(r) or r for r in rows))([1, 2])] == [1, 2] and told == [1, 2, "back"]
    monkeypatch.undo()
    shared.give_back()


def test_hilbert_curve_is_continuous():
    points = np.array([(a, b) for a in range(8) for b in range(8)])
    order = np.argsort(packing.hilbert_keys(points, 3))
    keys = packing.hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(64))
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_rollup(spark):
    rows = [(1, "a", "en", "v1", 5), (2, "a", "en", "v1", 7), (3, "b", None, "v1", None), (4, None, "de", "v2", 2), (4, None, "de", "v2", 2)]
    schema = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long"
    first = spark.createDataFrame(rows, schema)
    revised = [(1, "a", "en", "v1", 9), (3, "b", None, "v1", 4), (6, "c", "fr", "v2", 1)]
    rollup = token_rollup.TokenRollup(spark)
    assert rollup.totals().count() == 0
    assert rollup.apply("one", token_rollup.changes(None, first)) and not rollup.apply("one", token_rollup.changes(None, first))
    delta = token_rollup.changes(first.where("doc_id in (1, 2, 3)"), spark.createDataFrame(revised, schema))
    assert rollup.apply("two", delta)

    def wanted(state):
        n, t = Counter(), Counter()
        for _, s, lang, v, k in state:
            n[s, lang, v] += 1
            t[s, lang, v] += k or 0
        return {k: (n[k], t[k]) for k in n}

    def got():
        return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}

    final = wanted([*revised, rows[3], rows[4]])
    assert got() == final
    rollup.compact()
    assert got() == final and not rollup.apply("two", delta)
    assert rollup.apply("three", token_rollup.changes(spark.createDataFrame(revised, schema), None)) and got() == wanted(rows[3:])
    rollup.compact()
    assert got() == wanted(rows[3:]) and all(map(rollup.has, ("one", "two", "three"))) and not rollup.has("four")
    assert rollup.apply("../odd *name", token_rollup.changes(first.limit(0), None)) and rollup.has("../odd *name") and got() == wanted(rows[3:])
    assert not rollup.apply("../odd *name", token_rollup.changes(None, first)) and got() == wanted(rows[3:])
    for bad in ("", "x" * 121):
        with pytest.raises(ValueError):
            rollup.apply(bad, first)
    with pytest.raises(ValueError):
        token_rollup.changes(None, None)


def test_rollup_batches_committed_while_compacting(spark, monkeypatch):
    """A batch that lands after compact() has listed the others counts by itself, once; a second attempt at a batch does not count."""
    schema = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long"
    state = lambda n: token_rollup.changes(None, spark.createDataFrame([(n, "s", "en", "v", n)], schema))
    rollup, late = token_rollup.TokenRollup(spark), None
    late = token_rollup.TokenRollup(spark, rollup.path)
    rollup.apply("one", state(10))
    list_state, calls = rollup._state, []

    def listed():
        found = list_state()
        if not calls:
            calls.append(late.apply("two", state(2)))
        return found

    monkeypatch.setattr(rollup, "_state", listed)
    rollup.compact()
    assert calls == [True] and [(r.n_docs, r.n_tokens) for r in late.totals().collect()] == [(2, 12)]
    late.compact()
    assert [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()] == [(2, 12)] and rollup.has("one") and rollup.has("two")
    folder = rollup._folder("three")
    monkeypatch.setattr(rollup, "has", lambda batch: False)
    assert sorted([rollup.apply("three", state(3)), rollup.apply("three", state(3))])[1]
    assert len(rollup._names(f"batches/{folder}")) == 2 and [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()] == [(3, 15)]
    rollup.compact()
    assert [(r.n_docs, r.n_tokens) for r in late.totals().collect()] == [(3, 15)]


def test_counts(spark):
    docs = spark.createDataFrame([(1, "s", "en", " a  b\tc "), (2, "s", "en", None), (3, "s", "en", "  ")], "doc_id long, source string, lang string, text string")
    assert [r.n_tokens for r in token_rollup.counted(docs, "words", token_rollup.word_count).orderBy("doc_id").collect()] == [3, 0, 0]
    pieces = token_rollup.bpe_counted(docs, "v", VOCABULARY, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(VOCABULARY), special_tokens={})
    assert [r.n_tokens for r in pieces] == [len(library.encode_ordinary(t)) for t in (" a  b\tc ", "", "  ")]


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1><nav><ul><li><a href=/>Home</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies, and more, and more, to be read.</p></div>
<article><header><h1>Title &amp; more</h1></header><p><b>First, paragraph<br>of text &copy; here.<p>Second one, it is   longer,
and has commas.</p><ul><li>item</li><li>other</li></ul><div class="ad">Buy now, please, today.</div><footer>by me</footer></article>
<section class="comments"><article><p>Great post, thanks, really, a lot, indeed, yes.</p></article></section>
<aside><p>Related, things, to, read, are, here.</p></aside><form><p>Your name, please.</p><input></form><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    wanted = "Title & more\n\nFirst, paragraph of text © here.\n\nSecond one, it is longer, and has commas.\n\nitem\n\nother"
    assert html_extract.main_text(PAGE) == wanted
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>only text"), (5, "u", "plain &lt;b&gt;"), (6, "u", "<div" * 50)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert got[1] == (wanted, len(wanted)) and got[2] == got[3] == ("", 0) and got[None][0] == "only text" and got[5][0] == "plain <b>"
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_grandparent_and_long():
    page = "<body><div id=nav><a href=x>a</a> <a href=y>b</a></div><div class=wrap><h1>Head</h1><div class=text>" + "<p>Some words, and more words, in a row.</p>" * 2000 + "</div></div><div class=promo>Buy</div></body>"
    text = html_extract.main_text(page)
    assert text.startswith("Head\n\nSome words") and text.count("Some words") == 2000 and "Buy" not in text


def test_html_depth_and_ties():
    """Markup keeps its meaning however deep it nests, in time that grows with the page; of equal containers the first is kept."""
    depth = 2000
    page = "<body>" + "<div>" * depth + "<nav>MENU</nav><p>One sentence, and another, in a row, of some length.</p><div class=ad>Buy</div>" + "</div>" * depth
    assert html_extract.main_text(page) == "One sentence, and another, in a row, of some length."
    deep = "<body>" + "<div><p>a, b, c.</p>" * 20_000
    assert html_extract.main_text(deep).count("a, b, c.") > 0
    assert html_extract.main_text("<body>" + "<span class=x><b>" * 20_000 + "text") == "text"
    tied = "<body><section><p>First text, of one length.</p></section><nav>x</nav><section><p>Other text, of one length.</p></section>"
    assert html_extract.main_text(tied).startswith("First text")


@pytest.mark.parametrize(
    "inside, wanted",
    [
        ('<svg class="i"/>', ""),
        ('<svg><text>drawn</text></svg>', ""),
        ("<svg><path>", ""),
        ("<object-list>own, element.</object-list>", "own, element.\n\n"),
        ("<template><p>none</p><template>x</template></template>", ""),
        ("<noscript><p>none</p></noscript>", ""),
        ("<p>Code: <span class='token comment'># note</span> and <em class=notice>more</em> here.</p>", "Code: # note and more here.\n\n"),
        ("<p>Text <span class=ad>Buy</span></p>", "Text\n\n"),
        ("<p class=notice>We use cookies.</p>", ""),
        ("<div class=menu><p>Soup, bread and fish are on the table today, said the cook.</p></div>", "Soup, bread and fish are on the table today, said the cook.\n\n"),
        ("<div class=menu><a href=x>Soup.</a> <a href=y>Fish.</a></div>", ""),
        ("<h2 class=header>Part</h2>", "Part\n\n"),
    ],
)
def test_html_names_and_unshown_elements(inside, wanted):
    """Words of names take out containers without prose, and adverts and notices always; what is not shown ends where it should."""
    body = "Main text, of the page, long enough to be the best container here."
    assert html_extract.main_text(f"<body><article><h1 class=page-header>Head</h1>{inside}<p>{body}</p></article>") == f"Head\n\n{wanted}{body}"


def test_html_bad_bytes(spark):
    pages = spark.sql("select 1 as page_id, 'u' as url, cast(concat(cast('<p>a' as binary), x'ff', cast(' b' as binary)) as string) as html")
    assert html_extract.extract(pages).first().text == "a\ufffd b"
