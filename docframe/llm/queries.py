"""The queries of this subpackage: each applies an operator to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import byte_bpe, exact_dedup, html_extract, language_id, packing, simhash, suffix_dedup, token_rollup, topk, toxicity
from docframe.llm.shared import cut, remove

VOCABULARY, WORD_TOKENIZER = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(rows, rows.where("vec_id % 20 = 0"), k=20, scale=64)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_id.held_out(F.col("doc_id"), 5, 0)
    crf = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~out))
    return toxicity.tag(docs, crf).select("doc_id", out.alias("held_out"), "score", "predicted")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="greatest")
    return out.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), width=3, distance=3)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), length=2048, last=1)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.byte_bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def kept_up(spark: SparkSession, sf_dir: str, states: dict[str, DataFrame]) -> DataFrame:
    """Totals after three batches for each tokenizer version, some of them sent again.

    All documents are inserted; counts of those labelled toxic are revised, to one more for a mark at
    the end; those labelled as of no quality are deleted, with the counts that they then have.
    """
    labels, rollup = table(spark, sf_dir, "labels"), token_rollup.TokenRollup(spark)
    marked, gone = (labels.where(F.col(c) == v).select(F.col("doc_id").alias("_id")).distinct() for c, v in (("toxic", 1), ("quality", 0)))
    for version, state in states.items():
        held = cut(state, "counts")
        revised = held.join(marked, F.col("doc_id") == F.col("_id"), "left_semi")
        now = held.join(marked, F.col("doc_id") == F.col("_id"), "left").withColumn("n_tokens", F.col("n_tokens") + F.col("_id").isNotNull().cast("long")).drop("_id")
        batches = {
            f"{version}: all": token_rollup.changes(None, held),
            f"{version}: revised": token_rollup.changes(revised, revised.withColumn("n_tokens", F.col("n_tokens") + 1)),
            f"{version}: deleted": token_rollup.changes(now.join(gone, F.col("doc_id") == F.col("_id"), "left_semi"), None),
        }
        for name, deltas in batches.items():
            rollup.apply(name, deltas)
        for name in (f"{version}: revised", f"{version}: all"):
            rollup.apply(name, batches[name])
        rollup.compact()
        rollup.apply(f"{version}: deleted", batches[f"{version}: deleted"])
        remove(held)
    return rollup.totals()


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = token_rollup.counted(docs, "words", token_rollup.word_count)
    pieces = token_rollup.bpe_counted(docs, VOCABULARY, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return kept_up(spark, sf_dir, {"words": words, VOCABULARY: pieces})


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9_token_rollup that SQL can express."""
    return kept_up(spark, sf_dir, {"words": token_rollup.counted(table(spark, sf_dir, "documents"), "words", token_rollup.word_count)})


ROLLUP_SQL = r"""
WITH gone AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), marked AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT d.source, d.lang, 'words' AS tokenizer_version, count(*) AS n_docs,
       CAST(sum(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) + CAST(m.doc_id IS NOT NULL AS INTEGER)) AS BIGINT) AS n_tokens
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = d.doc_id
WHERE g.doc_id IS NULL GROUP BY d.source, d.lang
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.where(~out))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_rollup": op9_token_rollup,
    "op10_language_id": op10_language_id,
    "token_rollup_words": token_rollup_words,
}
ORACLE_SQL = {"op3_exact_top_k": OP3_SQL, "op5_exact_dedup": OP5_SQL, "token_rollup_words": ROLLUP_SQL}
