"""The pipeline: columns, decisions and coverage of its stages."""

import random
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from docframe.llm.shared import cut


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    words = {"en": "the of and to in that is with for was".split(), "de": "der die und das nicht mit ist für auf ein".split()}
    make = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, make("en" if i % 2 else "de", rng.randrange(20, 60)), "en" if i % 2 else "de", "s", 0) for i in range(40)]
    passage = make("en", 80)
    rows += [(40, rows[0][1], "de", "s", 0), (41, "12345 !!!", "en", "s", 0), (42, None, None, None, None), (43, make("en", 30) + passage, "en", "s", 0), (44, passage + make("en", 30), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    now, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = cut(stage(spark, now, str(tmp_path)), name)
        assert now.columns == names
        kept.append({r.doc_id for r in now.collect()})
    assert kept[0] == set(range(45)) - {41, 42}
    assert kept[1] == kept[0] - {0} and kept[3] == kept[2]
    assert {r.doc_id: passage in r.text for r in now.where("doc_id in (43, 44)").collect()} == {43: False, 44: False}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == kept[3]


def brute_run(rows):
    """(doc_id, ids) of rows (doc_id, text) by plain means: letters, equal texts, five-word sets, 200-byte strings, the tokenizer."""
    rows = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    best = {}
    for i, t in rows:
        best[t] = max(best.get(t, i), i)
    rows = sorted((i, t) for t, i in best.items())
    sets = []
    for _, t in rows:
        words = t.lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    least = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = sorted((least[a], least[b]), reverse=True)
                least = [new if x == old else x for x in least]
    rows = [r for k, r in enumerate(rows) if least[k] == k]
    data, seen = [t.encode() for _, t in rows], defaultdict(int)
    for d in data:
        for k in range(len(d) - 199):
            seen[d[k : k + 200]] += 1
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for (i, _), d in zip(rows, data):
        gone = [False] * len(d)
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        text = bytes(b for b, g in zip(d, gone) if not g).decode("utf-8", "ignore")
        out.append((i, [*library.encode(text, add_special_tokens=False).ids, 1]))
    return out


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    words = [rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, texts = make(60), [make(rng.randrange(8, 120)) for _ in range(30)]
    texts += [texts[3], texts[3], texts[5].upper(), texts[7] + " " + make(1), make(1) + " " + texts[8], make(20) + " " + passage, passage + " " + make(30), make(9) + " " + passage + " " + make(9), "12 34", "", None, "one", "two"]
    rows = [(k, t, rng.choice(["en", "de"]), "s", 1) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(list)
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(got[r.doc_id])
        got[r.doc_id] += r.tokens
    assert sorted(got.items()) == brute_run([(i, t) for i, t, *_ in rows])


def test_stages_on_odd_tables(spark):
    """Empty tables, tables without labels, null and repeated ids, repeated rows and columns with clashing names pass all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, DOC_ID string, id int, mark string, _0 int, spans int, digest string"
    text = "some words that stand in a row of ten here"
    rows = [(None, text, None, "s", 1, "x", 1, "m", 2, 3, "d"), (None, text, None, "s", 1, "x", 1, "m", 2, 3, "d"), (7, "nobody else says what is said in this one line", "en", "s", 1, "x", 1, "m", 2, 3, "d"), (7, "others, quite apart from these, stand there", None, None, None, None, None, None, None, None, None), (7, "others, quite apart from these, stand there", None, None, None, None, None, None, None, None, None), (8, None, "en", "s", 1, "x", 1, "m", 2, 3, "d"), (9, "123", None, "s", 1, "x", 1, "m", 2, 3, "d")]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = spark.createDataFrame(rows, schema)
        for table, left in ((docs, {("None", text), ("7", "nobody else says what is said in this one line"), ("7", "others, quite apart from these, stand there")}), (docs.drop("lang").selectExpr("*", "cast(null as string) as lang"), {("None", text), ("7", "nobody else says what is said in this one line"), ("7", "others, quite apart from these, stand there")}), (docs.limit(0), set())):
            now, names = table, table.columns
            for name, stage in corpus_pipeline.STAGES[:-1]:
                now = cut(stage(spark, now, ""), name)
                assert now.columns == names, name
            got = [(str(r.doc_id), r.text) for r in now.collect()]
            assert len(got) == len(set(got)) and set(got) == left
            packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
            assert sorted({str(r.doc_id) for r in packed}) == sorted({i for i, _ in left})
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
