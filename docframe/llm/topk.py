"""Exact top-k by integer inner product: distributed histogram selection.

For a block of queries, every pass scores all candidates. The first finds the greatest score, and
each task's own k-th: the greatest of these bounds the k-th of all from below. The next passes count
scores from there on in global histograms, each narrowing the interval that holds a query's k-th
score, until it is one value. The last pass keeps what lies above that value and, of the ties at it,
those of smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.shared import cut, pick, remove

#: Queries in a block, candidates scored at once, bins of a histogram, blocks at work at once. A block's queries are broadcast: QUERIES x dimensions x 8 bytes.
QUERIES, CANDIDATES, BINS, BLOCKS = 4096, 512, 1024, 4
#: Stands for a score that does not count; real ones are greater.
NONE = -(2**63)
#: Scores of which the first pass looks at the greatest only.
GROUP = 16


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component, as doubles. Vectors that are null, or hold a null or non-finite component, go; so do null ids."""
    rows = pick(df, id_col, vector_col).toDF("id", "v").select("id", F.col("v").cast("array<double>").alias("v"))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("v", F.transform("v", lambda x: floor_double(x * scale)))


def floor_double(x):
    """floor(x) as a double, also where it exceeds a long."""
    return F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)


class Block:
    """Queries of one dimension as a matrix, scored exactly: in floats while sums stay exact, else in Python's integers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.most = float(np.abs(vectors).max(initial=0))

    def score(self, candidates: np.ndarray) -> np.ndarray:
        """(candidates x queries) as int64; sums beyond 2**62 take its place."""
        bound = self.most * float(np.abs(candidates).max(initial=0)) * max(1, self.vectors.shape[1])
        if bound < 2**24:
            return (candidates.astype(np.float32) @ self.vectors.astype(np.float32).T).astype(np.int64)
        if bound < 2**53:
            return (candidates @ self.vectors.T).astype(np.int64)
        whole = [[int(x) for x in row] for row in self.vectors]
        return np.array([[max(-(2**62), min(2**62, sum(a * b for a, b in zip([int(x) for x in c], q)))) for q in whole] for c in candidates], np.int64).reshape(len(candidates), len(whole))


def scored(batches: Iterator[pa.RecordBatch], blocks: dict[int, Block]) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """(block, candidate ids, scores) in pieces of at most CANDIDATES rows; vectors meet queries of their own dimension."""
    for batch in batches:
        ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        sizes = np.diff(vectors.offsets.to_numpy())
        for size in np.unique(sizes):
            if size in blocks:
                at = np.flatnonzero(sizes == size)
                flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
                for a in range(0, len(at), CANDIDATES):
                    yield blocks[size], ids[at[a : a + CANDIDATES]], blocks[size].score(flat[a : a + CANDIDATES])


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's k best candidates (all, if fewer), ties to the smaller id.

    A candidate with the query's own id does not count. Of queries that repeat an id one is
    answered, that with the least vector; repeated candidate rows count each. Vectors of another
    dimension than the query's take no part, nor do null ids.
    """
    spark = candidates.sparkSession
    rows = cut(integer_vectors(candidates, id_col, vector_col, scale), "vectors")
    asked = cut(integer_vectors(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")), "queries")
    kind = rows.schema["id"].dataType.simpleString()
    numbered, blocks = in_blocks(asked)
    work = inheritable_thread_target(spark)(lambda n: cut(answer(spark, rows, numbered.where(F.col("block") == n).drop("block"), k, kind), "topk"))
    with ThreadPoolExecutor(BLOCKS) as pool:
        results = list(pool.map(work, range(max(1, blocks))))
    for used in (rows, asked, numbered):
        remove(used)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def in_blocks(asked: DataFrame) -> tuple[DataFrame, int]:
    """asked with a column block, each of QUERIES rows at most, and the number of blocks.

    Rows are numbered by partition and place within it; the driver gets the partitions' sizes only.
    """
    placed = cut(asked.withColumn("at", F.monotonically_increasing_id()), "places")
    sizes = dict(placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    starts = asked.sparkSession.createDataFrame(before, "part long, before long")
    joined = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part")
    number = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return cut(joined.select("id", "v", F.floor(number / QUERIES).cast("long").alias("block")), "blocks"), -(-total // QUERIES)


def answer(spark, rows: DataFrame, asked: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, id, score): for one block of queries, at most k rows a query and task, among them the answers."""
    got = asked.collect()  # QUERIES rows at most
    blocks = {}
    for size in {len(r.v) for r in got}:
        own = [r for r in got if len(r.v) == size]
        blocks[size] = Block(np.array([r.id for r in own]), np.array([r.v for r in own], np.float64).reshape(len(own), size))
    sent = spark.sparkContext.broadcast(blocks)

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of this task's scores of others: the least, the greatest, and the k-th, or one below it."""
        found: dict[int, list] = {}
        for block, ids, s in scored(batches, sent.value):
            f = found.setdefault(block.vectors.shape[1], [block, None, np.full((k, len(block.ids)), NONE)])
            own = np.where(ids[:, None] == block.ids, NONE, s)
            pad = -len(own) % GROUP
            tops = np.concatenate([own, np.full((pad, own.shape[1]), NONE)]).reshape(-1, GROUP, own.shape[1]).max(axis=1)
            best = np.concatenate([f[2], tops])
            f[2] = np.partition(best, len(best) - k, axis=0)[-k:]
            low = np.where(ids[:, None] == block.ids, 2**63 - 1, s).min(axis=0)
            f[1] = low if f[1] is None else np.minimum(f[1], low)
        for block, low, best in found.values():
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(low), pa.array(best.max(axis=0)), pa.array(best.min(axis=0))], ["q", "low", "high", "kth"])

    ends = rows.mapInArrow(extremes, f"q {kind}, low long, high long, kth long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("kth").alias("kth")).collect()
    # by query: the interval [low, end) that holds the k-th score, its bins' width, and how many scores lie at its end or above
    low, end, width, above = {}, {}, {}, {}
    for r in ends:
        if r.high > NONE:
            low[r.q], end[r.q], above[r.q] = max(r.low, r.kth), r.high + 1, 0
            width[r.q] = max(1, -(-(end[r.q] - low[r.q]) // BINS))
    while True:
        steps = {size: tuple(np.array([x.get(q, 1) for q in b.ids.tolist()]) for x in (low, end, width)) for size, b in blocks.items()}
        now = spark.sparkContext.broadcast(steps)

        def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for block, ids, s in scored(batches, sent.value):
                size, q = block.vectors.shape[1], len(block.ids)
                start, stop, step = now.value[size]
                bins = s - start
                if not (step == 1).all():
                    bins //= step
                fine = (s >= start) & (s < stop) & (ids[:, None] != block.ids)
                bins += np.arange(q) * BINS
                own = sums.setdefault(size, np.zeros(q * BINS, np.int64))
                own += np.bincount(bins[fine], minlength=q * BINS)
            for size, own in sums.items():
                at = np.flatnonzero(own)
                ids = sent.value[size].ids
                yield pa.RecordBatch.from_arrays([pa.array(ids[at // BINS]), pa.array(at % BINS, pa.int32()), pa.array(own[at])], ["q", "bin", "n"])

        w = Window.partitionBy("q").orderBy(F.desc("bin"))
        counted = rows.mapInArrow(histogram, f"q {kind}, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        past = spark.createDataFrame([(q, a) for q, a in above.items()], f"q {kind}, above long") if above else None
        if past is None:
            break
        at = counted.withColumn("upto", F.sum("n").over(w)).join(F.broadcast(past), "q").withColumn("upto", F.col("upto") + F.col("above"))
        hit = at.where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).select("q", "bin", "n", "upto").collect()
        met = set()
        for r in hit:
            met.add(r.q)
            low[r.q] += r.bin * width[r.q]
            end[r.q] = min(end[r.q], low[r.q] + width[r.q])
            above[r.q] = r.upto - r.n
        short = [q for q in above if q not in met]  # fewer than k candidates: all count, and no histogram is needed
        for q in short:
            low[q], end[q], width[q] = NONE, NONE, 1
            del above[q]
        if all(width[q] == 1 for q in above):
            break
        for q in above:
            width[q] = max(1, -(-width[q] // BINS))
    last = {size: np.array([low.get(q, NONE) for q in b.ids.tolist()]) for size, b in blocks.items()}
    spare = {size: np.array([k - above[q] if q in above else 0 for q in b.ids.tolist()]) for size, b in blocks.items()}
    cuts = spark.sparkContext.broadcast((last, spare))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: dict[int, dict[int, list]] = {}
        for block, ids, s in scored(batches, sent.value):
            size = block.vectors.shape[1]
            limit, room = cuts.value[0][size], cuts.value[1][size]
            other = ids[:, None] != block.ids
            c, q = np.nonzero(((s > limit) | (limit == NONE)) & other)
            if len(c):
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(ids[c]), pa.array(s[c, q])], ["q", "id", "score"])
            c, q = np.nonzero((s == limit) & (limit != NONE) & other)
            own = ties.setdefault(size, {})
            by = np.argsort(q, kind="stable")
            where, first = np.unique(q[by], return_index=True)
            for x, part in zip(where.tolist(), np.split(ids[c[by]], first[1:])):
                most = int(room[x])
                own[x] = sorted(own.get(x, []) + np.sort(part)[:most].tolist())[:most]
        for size, own in ties.items():
            block, limit = sent.value[size], cuts.value[0][size]
            q = [x for x, ids in own.items() for _ in ids]
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[q] if q else block.ids[:0]), pa.array([i for ids in own.values() for i in ids], pa.array(block.ids).type), pa.array(limit[q] if q else limit[:0])], ["q", "id", "score"])

    return rows.mapInArrow(keep, f"q {kind}, id {kind}, score long").toDF("query_id", "id", "score")
