"""Exact deduplication by a log-structured merge index of digests, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.shared import attach, cut, flagged, key_bitmaps, perhaps_in, pick, scratch, without_rows


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """A log-structured merge index from digest to (least and greatest id, number of rows).

    insert() flushes a batch: every task sorts its memtable, the rows of its input slice, by digest
    and writes it as a sorted run with Parquet Bloom filters on the digest. compact() merges all runs
    and the last generation into one generation, one row a digest, sorted within its files; tasks
    merge their own rows of a digest first, so that one with very many rows does not pile up.
    probe_filter() is a bitmap over the digests held more than once: rows that it does not hold are
    alone and need no look-up. lookup() probes a filter of the batch's digests before it reads the
    generation. Everything lies in the shared folder; each write goes to a new path.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.runs, self.generation = spark, [], None

    def insert(self, batch: DataFrame) -> DataFrame:
        """batch: (id, digest). Returns the run as it was written."""
        run = cut(batch.sortWithinPartitions("digest"), "run", **{"parquet.bloom.filter.enabled#digest": "true"})
        self.runs.append(run)
        return run

    def compact(self) -> DataFrame:
        """(digest, least, greatest, n) of all rows so far."""
        parts = [r.select("digest", F.col("id").alias("least"), F.col("id").alias("greatest"), F.lit(1).cast("long").alias("n")) for r in self.runs]
        parts += [self.generation] if self.generation is not None else []
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.unionByName(p)
        merged = merged.groupBy("digest").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("n").alias("n"))
        self.generation = cut(merged.sortWithinPartitions("digest"), "generation", **{"parquet.bloom.filter.enabled#digest": "true"})
        self.runs = []
        return self.generation

    def lookup(self, batch: DataFrame) -> DataFrame:
        """What the generation holds of the digests of batch (digest): a bitmap of them tells which of its rows may be asked for, then a join does."""
        asked = cut(batch.select("digest").distinct(), "asked")
        return perhaps_in(self.generation, "digest", key_bitmaps(asked, "digest")).join(asked, "digest", "left_semi")

    def probe_filter(self) -> tuple[DataFrame, int]:
        """Bitmaps over the digests that the index holds more than once."""
        return key_bitmaps(self.generation.where("n > 1"), "digest")


def named(rows: DataFrame, keep: str, kept: Callable[..., None]) -> DataFrame:
    """(id, digest, keep_id, group_size) of rows (id, text, digest). kept() is told the tables that the result reads."""
    index = DigestIndex(rows.sparkSession)
    run = index.insert(rows.select("id", "digest"))
    index.compact()
    total, repeated = run.count(), index.probe_filter()
    best = (F.max if keep == "greatest" else F.min)("id")
    classes = perhaps_in(rows, "digest", repeated).groupBy("digest", "text").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    clashing = cut(classes.groupBy("digest").agg(F.count("*").alias("texts"), F.sum("group_size").alias("n")).where("texts > 1").select("digest", "n"), "clashing")
    found = flagged(run, F.col("digest"), repeated)
    single = found.where("not _perhaps").select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    met, held = found.where("_perhaps").drop("_perhaps"), index.generation.select("digest", F.col(keep).alias("keep_id"), F.col("n").alias("group_size"))
    kept(run, index.generation, repeated[0])
    if clashing.isEmpty():
        return single.unionByName(attach(met, held, "digest", "group_size", total))
    kept(clashing)
    plain = attach(met.join(clashing, "digest", "left_anti"), held.join(clashing, "digest", "left_anti"), "digest", "group_size", total)
    clash = attach(perhaps_in(rows, "digest", repeated), clashing, "digest", "n", total).drop("n").withColumn("class", F.struct("digest", "text")).drop("digest", "text")
    own = classes.join(clashing.select("digest"), "digest", "left_semi").select(F.struct("digest", "text").alias("class"), "keep_id", "group_size")
    return single.unionByName(plain).unionByName(attach(clash, own, "class", "group_size", total).withColumn("digest", F.col("class.digest")).drop("class"))


def exact_dedup(
    docs: DataFrame,
    keep: str = "greatest",
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, digest (binary).

    Texts are equal when their bytes after `normalise` are (null counts as empty). Of equal texts
    the row with the greatest (or least) id stays. Digest hits are verified: rows whose digest the
    index holds more than once are grouped by their whole bytes, and a digest that stands for
    several texts is resolved by those bytes. Ids that are null never win against others; where all
    are null, keep_id is null and every row of the group is kept. Rows that repeat the id that stays
    are all kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = pick(docs, id_col, text_col).toDF("id", "text").select("id", normalise(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    with scratch(spark) as kept:
        out = named(rows, keep, kept)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_exact_copies(docs: DataFrame, keep: str = "greatest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept.

    Rows that repeat both id and text are one row afterwards, that whose columns have the least hash;
    a null id matches null ids. Only ids and digests shuffle, and documents that may have to go.
    """
    found = exact_dedup(docs, keep, id_col, text_col).where("group_size > 1").select(F.col(id_col).alias("id"), F.col("digest").alias("mark"), "kept")
    gone = found.groupBy("id", "mark").agg(F.bool_and(~F.col("kept")).alias("all"), F.count("*").alias("n")).where("all or n > 1")
    return without_rows(docs, gone, id_col, sha256(F.coalesce(F.col(f"_{docs.columns.index(text_col)}"), F.lit(""))))
