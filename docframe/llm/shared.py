"""What the operators share: column picking, written intermediates, skew-safe lookups, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap made by bitmap_construct_agg.
BITMAP_BITS = 32768
#: A key with more than 1/HOT_SLOTS of all rows is looked up by broadcast; fewer than HOT_SLOTS such keys can exist.
HOT_SLOTS = 256
#: Bytes of an Arrow batch, and of text whose different words are looked up together.
BATCH, SLICE = 1 << 22, 1 << 21


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("docframe.shared.dir", None)
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docframe-")
        spark.conf.set("docframe.shared.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/docframe/{tag}-{uuid.uuid4().hex}"


_scratch = threading.local()


def cut(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if open_lists := getattr(_scratch, "lists", None):
        open_lists[-1].append((path, out))
    return out


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Deletes the tables that cut() makes within, but for those given to the function that it yields: those that a result still reads."""
    lists = _scratch.lists = getattr(_scratch, "lists", [])
    lists.append([])
    kept: list[DataFrame] = []
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        for path, table in lists.pop():
            if any(table is k for k in kept):
                if lists:
                    lists[-1].append((path, table))
            else:
                delete(spark, path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by cut(), once no later plan reads it."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/docframe/" in parent:
            delete(df.sparkSession, parent)


def bound_batches(spark: SparkSession) -> None:
    """Batches that go to Python have about BATCH bytes at most, so that tasks' memory does not hang on how long documents are. A session that asks for less keeps its own bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH:
        spark.conf.set(name, str(BATCH))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by exact case; columns of other or clashing names do no harm."""
    bound_batches(df.sparkSession)
    own = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return own.select(*[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


def slices(batch: pa.RecordBatch, column: int, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE / parts bytes of text, of one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // max(1, SLICE // parts)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


@cache
def trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """What the allocators of this process keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    if own := trim():
        own(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and at its end the memory that it no longer needs is given back: Python workers outlive their tasks, and so would the most that any took."""

    def own(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return own


def clear(spark: SparkSession) -> None:
    """Delete all tables that operators wrote to the shared folder. Results that were not written elsewhere yet read them, so call this last."""
    delete(spark, f"{shared_root(spark)}/docframe")


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row a key and in `weight` the key's number of left rows.

    Keys with more than total / HOT_SLOTS rows are fewer than HOT_SLOTS, so they are broadcast and
    their left rows stay where they are; all other keys shuffle.
    """
    hot = F.col(weight) > F.lit(max(total, 1) / HOT_SLOTS)
    near = left.join(F.broadcast(right.where(hot)), key, "inner")
    rest = left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti")
    return near.unionByName(rest.join(right.where(~hot), key, how))


def key_bitmaps(keys: DataFrame, key: str, bits_a_key: int = 16, most_bits: int = 26) -> tuple[DataFrame, int]:
    """Bitmaps (bucket, words of 32 bits) over the hashes of a column, and log2 of all bits: at most 2**most_bits / 4 bytes."""
    bits = min(most_bits, max(15, (max(1, keys.count()) * bits_a_key - 1).bit_length()))
    at = keys.select(F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    maps = at.groupBy(F.shiftright("at", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(BITMAP_BITS - 1))).alias("bitmap"))
    words = F.transform(F.sequence(F.lit(0), F.lit(BITMAP_BITS // 32 - 1)), lambda i: F.conv(F.hex(F.substring(F.col("bitmap"), i * 4 + 1, F.lit(4))), 16, 10).cast("long"))
    return cut(maps.select("bucket", words.alias("words")), "bitmaps"), bits


def flagged(df: DataFrame, key: Column, bitmaps: tuple[DataFrame, int]) -> DataFrame:
    """df with a column _perhaps: whether the key may be one of those that the bitmaps were made of. True for all that are, and for a few more. The bitmaps are broadcast."""
    table, bits = bitmaps
    at = df.withColumn("_at", F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))).withColumn("_bucket", F.shiftright("_at", 15))
    met = at.join(F.broadcast(table.toDF("_bucket", "_words")), "_bucket", "left")
    bit = F.col("_at").bitwiseAND(F.lit(BITMAP_BITS - 1)).cast("int")
    # a word holds four bytes, the first on top; a byte's first bit is its least
    place = (F.lit(3) - F.shiftright(bit, 3).bitwiseAND(F.lit(3))) * 8 + bit.bitwiseAND(F.lit(7))
    held = F.getbit(F.get("_words", F.shiftright(bit, 5)), place) == 1
    return met.withColumn("_perhaps", F.coalesce(held, F.lit(False))).select(*df.columns, "_perhaps")


def perhaps_in(df: DataFrame, key: str, bitmaps: tuple[DataFrame, int]) -> DataFrame:
    """The rows of df whose key may be one of those that the bitmaps were made of."""
    return flagged(df, F.col(key), bitmaps).where("_perhaps").drop("_perhaps")


def keep_one(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, that whose columns have the least hash. Tasks keep one row a key before the shuffle."""
    hashable = [f.name for f in df.schema.fields if not f.dataType.simpleString().startswith(("map", "variant")) and "map<" not in f.dataType.simpleString()]
    one = F.min_by(F.struct(*df.columns), F.struct(F.xxhash64(*hashable), F.xxhash64(F.lit(1), *hashable))).alias("_one")
    return df.groupBy(*keys).agg(one).select("_one.*")


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, mark_of: Column) -> DataFrame:
    """docs without the rows whose id and mark (a column of docs) gone (id, mark, all) holds: all of them, or all but one where `all` is false.

    Whole documents shuffle only where bitmaps of gone say that they may be in it.
    """
    names = docs.columns
    with scratch(docs.sparkSession) as keep:
        gone = cut(gone.select("id", "mark", "all"), "gone")
        bitmaps = key_bitmaps(cut(gone.select(F.xxhash64("id", "mark").alias("key")), "keys"), "key")
        keep(gone, bitmaps[0])
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])
    at = f"_{names.index(id_col)}"
    rows = rows.withColumn("_mark", mark_of)
    sorted_out = flagged(rows, F.xxhash64(at, "_mark"), bitmaps)
    stay = sorted_out.where(~F.col("_perhaps")).drop("_perhaps")
    met = sorted_out.where("_perhaps").drop("_perhaps").join(gone.toDF("_id", "_own", "_all"), F.col(at).eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_own")), "left").drop("_id", "_own")
    once = keep_one(met.where("not _all").drop("_all"), at, "_mark")
    out = stay.unionByName(met.where("_all is null").drop("_all")).unionByName(once)
    return out.drop("_mark").toDF(*names)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that it reaches.

    Alternates large-star and small-star steps over tables in the shared folder until nothing
    changes. A node's minimum is pre-aggregated before the shuffle, and the join back has one row a
    node on one side, so that a node with very many links can be split. Loops and nulls are ignored.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        after = cut(small.where("a <> b").distinct(), "small")
        now = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        for old in (edges, large):
            remove(old)
        edges = after
        if before == (now.n, now.h):
            break
        before = (now.n, now.h)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
