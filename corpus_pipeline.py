"""A corpus pipeline: each stage calls one operator of docframe.llm; its table is written and read by the next stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import exact_dedup, language_id, packing, simhash, suffix_dedup
from docframe.llm.shared import cut, pick, remove, scratch

#: SQL has no naive Bayes classifier, fingerprints, repeated byte strings or tokens; tests hold run() against brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; the classifier is fitted on the table's labelled documents outside its held-out fold.

    Where no document is labelled there is no classifier, and those go that no classifier could tell: without text or letters.
    """
    labelled = pick(docs, "doc_id", "text", "lang")
    model = language_id.fit(labelled.where(~language_id.held_out(F.col("doc_id"), 4, 2)))
    names = docs.columns
    own = language_id.predict(docs, model)
    own = own.toDF(*[f"_{i}" for i in range(len(own.columns))])
    told = F.col(f"_{len(names)}") != language_id.UNDETERMINED
    if not model.languages:
        told = F.coalesce(F.col(f"_{names.index('text')}").rlike(r"\p{L}"), F.lit(False))
    return own.where(told).select([f"_{i}" for i in range(len(names))]).toDF(*names)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one of largest doc_id."""
    return exact_dedup.drop_exact_copies(docs, keep="greatest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word similarities of 0.8 or more, the one of smallest doc_id."""
    return simhash.drop_similar(docs, width=5, similarity=(4, 5))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that occur at another place too; n_chars is that of what is left."""
    return suffix_dedup.drop_repeated_bytes(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of sequences of at most 2048, ids included as `tokens`."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, last=1, tokens=True)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash", near_stage),
    ("suffix_dedup", repeats_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table and what it wrote aside are deleted once the next one's table is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep_last:
        for number, (name, stage) in enumerate(STAGES[:-1]):
            with scratch(spark) as keep:
                after = cut(stage(spark, docs, sf_dir), name)
                keep(after)
            if number:
                remove(docs)
            docs = after
        out = cut(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
        keep_last(out)
    return out
