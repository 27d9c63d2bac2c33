"""Exact, near and suffix dedup against brute force."""

import hashlib
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docframe.llm import exact_dedup, shared, simhash, suffix_dedup
from docframe.llm.shared import connected_components

DOCS = "doc_id long, text string"


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def brute_exact(rows, keep=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        best = keep(ids) if ids else None
        out.append((i, best, len(groups[t or ""]), i == best))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (3, "a"), (4, None), (5, ""), (None, "a"), (None, "lone"), (7, "x" * 5000), (8, "x" * 5000), (9, "A")] + [(100 + i, "hot") for i in range(60)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, weak):
    """With a digest of a few values, texts are told apart by their bytes."""
    digest = (lambda t: (F.length(t) % 3).cast("string").cast("binary")) if weak else exact_dedup.sha256
    docs = spark.createDataFrame(ROWS, DOCS).select("*", F.lit("clash").alias("DOC_ID"), F.lit(0).alias("keep_id"), F.lit(1).alias("digest"))
    out = exact_dedup.exact_dedup(docs, digest=digest)
    assert rows_of(out.drop("digest")) == brute_exact(ROWS)


def test_exact_least_empty_and_stage(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    assert rows_of(exact_dedup.exact_dedup(docs, keep="least").drop("digest")) == brute_exact(ROWS, min)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    kept = exact_dedup.drop_exact_copies(docs.withColumn("keep_id", F.lit("own")))
    assert kept.columns == ["doc_id", "text", "keep_id"]
    assert rows_of(kept.select("doc_id", "text")) == sorted([(2, "b"), (3, "a"), (5, ""), (None, "lone"), (8, "x" * 5000), (9, "A"), (159, "hot")], key=str)


def test_index_takes_batches(spark):
    index = exact_dedup.DigestIndex(spark)
    for rows in ([(1, b"a"), (2, b"b")], [(0, b"a")], [(5, b"b")]):
        index.insert(spark.createDataFrame(rows, "id long, digest binary"))
        index.compact()
    assert sorted((bytes(r.digest), r.least, r.greatest, r.n) for r in index.generation.collect()) == [(b"a", 0, 1, 2), (b"b", 2, 5, 2)]
    assert [(bytes(r.digest), r.n) for r in index.lookup(spark.createDataFrame([(b"a",), (b"a",), (b"c",)], "digest binary")).collect()] == [(b"a", 2)]


def test_exact_stage_keeps_one_of_equal_rows(spark):
    """Rows equal in id and text but for other columns, maps too, are one row afterwards; the choice does not hang on their order."""
    rows = [(1, "a", "x", {"k": 1}), (1, "a", "y", {"k": 2}), (2, "b", "z", None), (2, "c", "z", None), (None, "d", "p", None), (None, "d", "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string, map map<string, int>")
    one = sorted([(r.doc_id, r.text, r.other) for r in exact_dedup.drop_exact_copies(docs).collect()], key=str)
    two = sorted([(r.doc_id, r.text, r.other) for r in exact_dedup.drop_exact_copies(docs.orderBy(F.desc("other"))).collect()], key=str)
    assert one == two and [(i, t) for i, t, _ in one] == sorted([(1, "a"), (2, "b"), (2, "c"), (None, "d")], key=str)


def brute_components(nodes, edges):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 230)] + [(300, i) for i in range(301, 330)]
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components(nodes, [e for e in edges if e[0] != e[1]])


@pytest.mark.parametrize("bucket", [50_000, 2])
def test_links(spark, bucket):
    """Buckets that are cut further, to the last level, give the same components as comparison."""
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(8):
            v = centre
            for bit in rng.sample(range(64), rng.randrange(0, 5)):
                v ^= 1 << bit
            fps.add(v)
    fps = sorted(fps | {0, 7, 2**64 - 1})
    signed = [v - 2**64 if v >= 2**63 else v for v in fps]
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket=bucket)
    edges = [(r.a & 2**64 - 1, r.b & 2**64 - 1) for r in got.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    wanted = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    assert brute_components(fps, edges) == brute_components(fps, wanted)


def test_fingerprints_and_components(spark):
    base = "one two three four five six seven eight nine ten eleven twelve " * 8
    rows = [(1, base), (2, base.upper()), (3, base + "thirteen"), (4, "short text"), (5, None), (6, ""), (7, " \t\n"), (8, "short  text"), (9, "Ünïcode wörds hére now"), (9, "Ünïcode wörds hére now")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash"))
    got = simhash.simhash_components(docs).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    fp = {i: simhash.fingerprint(t or "", 3) for i, t in rows}
    assert all(int(by_id[i].fingerprint, 16) == fp[i] for i in fp)
    wanted = brute_components(sorted(fp), [(a, b) for a in fp for b in fp if (fp[a] ^ fp[b]).bit_count() <= 3])
    assert {i: r.component_id for i, r in by_id.items()} == wanted
    assert fp[5] == fp[6] == fp[7] == 0 and by_id[7].component_id == 5 and by_id[4].component_id == by_id[8].component_id == 4
    kept = simhash.drop_near_copies(docs)
    assert {r.doc_id for r in kept.collect()} == set(wanted.values()) and kept.columns == docs.columns
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_near_copies_keep_one_row(spark):
    """A row that shares its id with another component's best goes with its own component; equal rows are one afterwards."""
    near = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 6
    rows = [(7, "lone text", "a"), (7, "lone text", "a"), (7, near + "end", "b"), (3, near, "c"), (None, near, "d"), (None, "nobody else", "e"), (None, "nobody else", "f"), (8, None, "g"), (9, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    kept = sorted([(str(r.doc_id), r.text, r.mark) for r in simhash.drop_near_copies(docs).collect()], key=str)
    assert [(i, t) for i, t, _ in kept] == sorted([("7", "lone text"), ("3", near), ("None", "nobody else"), ("8", None)], key=str)
    similar = sorted([(str(r.doc_id), r.text) for r in simhash.drop_similar(docs).collect()], key=str)
    assert similar == [(i, t) for i, t, _ in kept]
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_bad_bytes_and_long_texts(spark):
    docs = spark.sql("select * from values (1, cast(x'6162ff2063' as string)), (2, cast(x'6162ff2063' as string)), (3, repeat('one two three ', 60000)) as t(doc_id, text)")
    by_id = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    assert by_id[1].component_id == by_id[2].component_id == 1 and int(by_id[3].fingerprint, 16) == simhash.fingerprint("one two three " * 60000, 3)
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == [1, 3]
    out = {r.doc_id: r for r in suffix_dedup.repeated_bytes(docs).collect()}
    assert out[1].n_bytes == 5 and out[1].kept_sha256 == hashlib.sha256(b"ab\xff c").hexdigest() and out[3].n_removed == out[3].n_bytes
    assert {bytes(r.t) for r in suffix_dedup.drop_repeated_bytes(docs).where("doc_id < 3").selectExpr("cast(text as binary) t").collect()} == {b"ab\xff c"}


def test_scratch_tables_go(spark):
    """Tables that no result reads are deleted when an operator returns."""
    root = shared.shared_root(spark).removeprefix("file://") + "/docframe"
    docs = spark.createDataFrame([(i, f"text {i % 5} of a few words") for i in range(20)], DOCS)
    for run, left in ((lambda: simhash.simhash_components(docs), 2), (lambda: exact_dedup.exact_dedup(docs), 3), (lambda: simhash.similar_components(docs), 2)):
        before = set(os.listdir(root)) if os.path.isdir(root) else set()
        out = run()
        assert len(set(os.listdir(root)) - before) <= left and out.count() == 20


def test_similar_stage(spark):
    """The pipeline's stage links all pairs of five-word similarity 0.8 or more, however many bits their fingerprints differ in, and no others."""
    rng = random.Random(8)
    noise = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    line, texts = noise(12), []
    for size in (12, 40, 90, 300):
        for changes in (1, 2, 4):
            base = noise(size) + line
            for _ in range(8):
                other = list(base)
                for at in rng.sample(range(size), changes):
                    other[at] = f"x{rng.randrange(10**6)}"
                texts.append(" ".join(other))
    texts += [" ".join(noise(6) + line + line) for _ in range(60)] + [" ".join(line)] * 3 + [None, "", " \n", "one two", "One  TWO", "two one", texts[40] + " end", texts[80] + " " + texts[80]]
    rows = [(i, t, "m") for i, t in enumerate(texts)] + [(None, texts[0], "n")]
    shingles = []
    for t in texts:
        words = (t or "").lower().split()
        shingles.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    edges = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])]
    fps = [simhash.fingerprint(t or "", 3) for t in texts]
    assert sum((fps[a] ^ fps[b]).bit_count() > 3 for a, b in edges) > 50
    wanted = brute_components(range(len(texts)), edges)
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    kept = corpus_pipeline.near_stage(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(wanted.values())
    got = {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()}
    assert got == wanted | {None: wanted[0]}
    assert simhash.similar_components(docs.limit(0)).count() == 0


def brute_suffix(texts, length=suffix_dedup.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def suffix_texts():
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [noise(n) for n in (199, 200, 201, 260, 500, 1500)]
    texts = []
    for p in passages:
        for cut in (0, 1, 3):
            texts.append(noise(rng.randrange(300)) + p[cut:] + noise(rng.randrange(300)))
    texts += [noise(90) + passages[4][:230] + noise(20) + passages[4][100:] + noise(50), "z" * 450, "ab" * 300, noise(150), None, "", "é" * 150 + noise(100), passages[5], passages[5], "q" + passages[5][:-1]]
    edited = list(passages[5])
    for at in (250, 600, 1100):
        edited[at] = "#"
    return [*texts, "".join(edited), noise(40) + "".join(edited)[200:1400]]


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 2])
def test_suffix(spark, most):
    """With buckets of two contexts at most, the others are split by digests; results are the same."""
    texts = suffix_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("spans", F.lit("clash")).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_bytes(docs, most=most).collect()}
    assert [got[i] for i in range(len(texts))] == brute_suffix(texts)


def test_suffix_pieces(spark, monkeypatch):
    """Pieces of few windows split what anchors own; nothing is lost."""
    texts = suffix_texts()
    for piece in (61, 512):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        data = b"".join((t or "").encode() for t in texts)
        offsets = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in texts])])
        found = list(suffix_dedup.anchors_of(np.frombuffer(data, np.uint8), offsets))
        windows = sorted(w for _, _, a, b, _ in found for x, y in zip(a.tolist(), b.tolist()) for w in range(x, y + 1))
        assert windows == [w for s, e in zip(offsets, offsets[1:]) for w in range(s, e - suffix_dedup.LENGTH + 1)]


def test_suffix_repeated_rows_and_stage(spark):
    text = "".join(random.Random(2).choice("abcdé ") for _ in range(400))
    rows = [(1, text, "x"), (1, text, "x"), (None, text, None), (3, "lone " * 3, None), (4, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = sorted([(r.doc_id or 0, r.n_removed) for r in suffix_dedup.repeated_bytes(docs).collect()])
    size = len(text.encode())
    assert got == [(0, size), (1, size), (1, size), (3, 0), (4, 0)]
    out = suffix_dedup.drop_repeated_bytes(docs)
    assert out.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in out.collect() if r.text is not None) == [(0, ""), (1, ""), (1, ""), (3, "lone " * 3)]
    assert suffix_dedup.repeated_bytes(docs.limit(0)).count() == 0
