"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two segments of 32 bits. Two fingerprints at most three bits apart differ
by one bit at most in one segment. So each fingerprint stands in a table for each segment, and looks
up its segment's Hamming ball of radius one. A ball is halved: of two segments one bit apart, only
the one whose bit is 0 looks up the other. A bucket of many rows is cut further: the bits that its key
leaves free fall into one part more than bits may differ, so that linked fingerprints are equal in
one, and each row goes to the bucket of each part's value. Whole distances are verified within a
bucket, which gives back a spanning forest of its links, never all pairs. Links become components by
a distributed algorithm.

Texts whose word shingles are alike may differ in more bits than any table of 64 bits can look up.
similar_components() links all pairs of a Jaccard similarity: links of fingerprints are only a start,
verified like all others, and pairs that it leaves apart are found by their prefixes. Of two sets in
one order, with a overlap at least, the first n - a + 1 elements share one. Of each set a parity map is
kept, of about as many bits as it has elements: two maps differ in no more bits than the sets do in
elements, so pairs whose maps differ in more are apart, and hardly any sets but similar ones meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.shared import BITMAP_BITS, attach, connected_components, cut, key_bitmaps, perhaps_in, pick, released, scratch, without_rows

#: Bits that linked fingerprints differ in at most, rows of a bucket beyond which it is cut further, and how often: 2**14 values then remain at most.
DISTANCE, BUCKET, LEVELS = 3, 50_000, 3
#: Hashes whose bits are counted at once.
HASHES = 1 << 15
SEGMENTS = ((0, 32), (32, 32))
#: One text in SAMPLE is counted to tell common shingles, those in COMMON of these texts at least, and log2 of the bits that keep them.
SAMPLE, COMMON, COMMON_BITS = 16, 3, 26
#: Rounds in which nodes are linked to one of a key's, before all pairs still apart are.
ROUNDS = 1
#: Bits of a small set's parity map.
PARITY = 256


def shingle_hashes(text: str, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The bytes of 64-bit hashes of a text's word shingles, HASHES rows at once. Letters A to Z are lower-cased, words end at ASCII white space."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return
    hash_of, n = xxhash.xxh64_digest, max(1, len(words) - width + 1)
    for a in range(0, n, HASHES):
        own = words[a : a + HASHES + width - 1]
        shingles = zip(*[own[k:] for k in range(width)]) if n > 1 or len(own) >= width else [own]
        yield np.frombuffer(b"".join([hash_of(b" ".join(s), seed) for s in shingles]), np.uint8).reshape(-1, 64 // 8)


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The SimHash of hashes; 0 if there is none."""
    ones, n = np.zeros(64, np.int64), 0
    for own in hashes:
        ones += np.unpackbits(own, axis=1).sum(axis=0, dtype=np.int64)
        n += len(own)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str, width: int, seed: int = 42) -> int:
    """The SimHash of a text's word shingles; 0 if it has no word."""
    return majority(shingle_hashes(text, width, seed))


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, mark): mark is a hash of the text as it is; in text, bytes that are no UTF-8 become U+FFFD."""
    own = pick(docs, id_col, text_col).toDF("id", "text")
    return own.select("id", F.make_valid_utf8("text").alias("text"), F.xxhash64("text").alias("mark"))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, fp): fp a signed long; null texts count as empty."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "", width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["id", "mark", "fp"])

    own = marked(docs, id_col, text_col)
    return own.mapInArrow(run, f"id {own.schema[0].dataType.simpleString()}, mark long, fp long")


def segment_of(fps: np.ndarray, start: int, bits: int) -> np.ndarray:
    return fps >> np.uint64(64 - start - bits) & np.uint64((1 << bits) - 1)


def table_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fp, own) of the table entries and look-ups of fps; a key holds the segment's number in its top bit."""
    keys, who, own = [], [], []
    for number, (start, bits) in enumerate(SEGMENTS):
        part = segment_of(fps, start, bits)
        base = np.uint64(number << 63)
        keys.append(part | base)
        who.append(fps)
        own.append(np.ones(len(fps), bool))
        for bit in range(bits):
            zero = part & np.uint64(1 << bit) == 0
            keys.append(part[zero] | np.uint64(1 << bit) | base)
            who.append(fps[zero])
            own.append(np.zeros(int(zero.sum()), bool))
    return np.concatenate(keys), np.concatenate(who), np.concatenate(own)


def forest(own: np.ndarray, probes: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Spanning edges (places in own + probes) of the links among own, and of own with probes."""
    nodes = np.concatenate([own, probes])
    a, b = [], []
    if len(nodes) <= 6:
        values, label = nodes.tolist(), list(range(len(nodes)))
        for i in range(len(own)):
            for j in range(i + 1, len(values)):
                if label[i] != label[j] and (values[i] ^ values[j]).bit_count() <= distance:
                    old = label[j]
                    label = [label[i] if x == old else x for x in label]
                    a.append(i)
                    b.append(j)
        return a, b
    label = np.arange(len(nodes))
    for i in range(len(own)):
        near = np.flatnonzero(np.bitwise_count(nodes[i + 1 :] ^ nodes[i]) <= distance) + i + 1
        met, first = np.unique(label[near], return_index=True)
        fresh = met != label[i]
        if fresh.any():
            label[np.isin(label, met[fresh])] = label[i]
            b += near[first[fresh]].tolist()
            a += [i] * int(fresh.sum())
    return a, b


def cut_keys(key: np.ndarray, fp: np.ndarray, free: np.ndarray, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, keys, free bits) of rows of cut buckets: for each part of the free bits, a key of the old one and the part's value."""
    for mask in np.unique(free):
        at = np.flatnonzero(free == mask)
        places = [b for b in range(63, -1, -1) if int(mask) >> b & 1]
        for own in np.array_split(np.array(places, np.uint64), parts):
            part = np.bitwise_or.reduce(np.uint64(1) << own) if len(own) else np.uint64(0)
            mixed = (key[at] ^ (fp[at] & part) * np.uint64(0x9E3779B97F4A7C15) ^ part * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
            yield at, mixed ^ mixed >> np.uint64(32), np.full(len(at), mask & ~part)


def links(unique: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between values of unique (fp), enough to connect all that are linked."""

    @released
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, who, own = table_rows(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(who.view(np.int64)), pa.array(own)], ["key", "fp", "own"])

    @released
    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, free = (batch.column(c).to_numpy().view(np.uint64) for c in (0, 1, 3))
            for at, keys, left in cut_keys(key, fp, free, distance + 1):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[at].view(np.int64)), batch.column(2).take(pa.array(at)), pa.array(left.view(np.int64))], ["key", "fp", "own", "free"])

    @released
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; those of a batch's last key wait for the next batch."""

        def found(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for s, e in zip(starts, np.append(starts[1:], len(key))):
                mine, theirs = fp[s:e][own[s:e]], fp[s:e][~own[s:e]]
                x, y = forest(mine, theirs, distance)
                if x:
                    nodes = np.concatenate([mine, theirs])
                    a.append(nodes[x])
                    b.append(nodes[y])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        rest = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            rows = [np.concatenate([x, y]) for x, y in zip(rest, new)]
            at = len(rows[0]) - int((rows[0] == rows[0][-1]).sum()) if len(rows[0]) else 0
            rest = [x[at:] for x in rows]
            yield found(*[x[:at] for x in rows])
        yield found(*rest)

    high = ((1 << 32) - 1 << 32) - (1 << 64)
    table = cut(unique.mapInArrow(spread, "key long, fp long, own boolean"), "tables").withColumn("free", F.when(F.col("key") < 0, F.lit(high)).otherwise(F.lit((1 << 32) - 1)))
    edges = None
    for level in range(LEVELS + 1):
        sizes = table.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("m"))
        useful = cut(sizes.where("n > 1 and m > 0"), "buckets")
        most = F.lit(bucket if level < LEVELS else 1 << 62)
        rows = table.join(useful.where(F.col("n") <= most).select("key"), "key", "left_semi").select("key", "fp", "own")
        found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        large = useful.where(F.col("n") > most)
        if large.isEmpty():
            break
        table = cut(table.join(large.select("key"), "key", "left_semi").select("key", "fp", "own", "free").mapInArrow(further, "key long, fp long, own boolean, free long"), "tables")
    return edges


def simhash_components(docs: DataFrame, width: int = 3, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (least id reachable).

    Texts without a word (null, empty) have fingerprint 0, linked like any other. Null ids never are
    a component's id unless all its ids are null. Repeated rows count each; an empty table gives none.
    """
    out = representatives(docs, width, checked(distance), id_col, text_col, bucket)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.id").alias("component_id"))


def checked(distance: int) -> int:
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius one find up to three differing bits")
    return distance


def best_row() -> Column:
    """Least of a component's rows: of its ids the least, null after all others, then of its texts that of least hash."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("best")


def attached(rows: DataFrame, unique: DataFrame, parts: DataFrame, node: str, keep: Callable[..., None]) -> DataFrame:
    """rows with their component's best row and number of rows; unique: one row a node (best, n), parts: (node, component)."""
    named = unique.join(parts.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))
    named = cut(named.select(node, "best", "n", "component"), "named")
    least = named.groupBy("component").agg(F.min("best").alias("best"), F.count("*").alias("members"), F.sum("n").alias("rows"))
    named = cut(attach(named.drop("best"), least, "component", "members", named.count()).select(node, "n", "best", "rows"), "named")
    keep(rows, named)
    return attach(rows, named, node, "n", rows.count()).drop("n")


def representatives(docs: DataFrame, width: int, distance: int, id_col: str, text_col: str, bucket: int) -> DataFrame:
    """(id, mark, fp, best, rows) for every row of docs."""
    with scratch(docs.sparkSession) as keep:
        rows = cut(fingerprints(docs, width, id_col, text_col), "fingerprints")
        unique = cut(rows.groupBy("fp").agg(best_row(), F.count("*").alias("n")), "unique")
        return attached(rows, unique, connected_components(links(unique.select("fp"), distance, bucket)), "fp", keep)


def shingle_set(hashes: list[np.ndarray]) -> np.ndarray:
    """The different hashes, ascending."""
    return np.unique(np.concatenate([x.view(np.int64).ravel() for x in hashes])) if hashes else np.zeros(0, np.int64)


def parity_map(found: np.ndarray) -> np.ndarray:
    """Bits, as longs, a power of two and as many as hashes at least: a bit is 1 if an odd number of the hashes fall on it.

    The halves of a map, one over the other, are the map of half the bits.
    """
    bits = max(PARITY, 1 << max(0, len(found) - 1).bit_length())
    return np.packbits((np.bincount(found >> 8 & bits - 1, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def common_shingles(own: DataFrame, width: int, bits: int = COMMON_BITS) -> np.ndarray:
    """Bits, by the low bits of a hash, set for the shingles that are common in a sample; they only order shingles, so more or fewer change no result."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(list(shingle_hashes(t.as_py(), width))))], ["key"])

    some = own.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)).select("text")
    often = some.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= COMMON)
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    maps = often.groupBy(F.shiftright(at, 15).alias("bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(BITMAP_BITS - 1))).alias("bitmap"))
    out = np.zeros((1 << bits - 15, BITMAP_BITS // 8), np.uint8)
    for r in maps.collect():
        out[r.bucket] = np.frombuffer(r.bitmap, np.uint8)
    return out.ravel()


def prefixes(own: DataFrame, width: int, similarity: tuple[int, int], common: np.ndarray) -> DataFrame:
    """(id, mark, fp, node, size, parity, keys): node stands for a text's set of so many shingles, keys are the first of them, those not common before the others."""
    top, bottom = similarity
    shared = own.sparkSession.sparkContext.broadcast(common)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            fps, nodes, sizes, keys, maps = [], [], [], [], []
            for t in batch.column(1):
                hashes = list(shingle_hashes(t.as_py() or "", width))
                found = shingle_set(hashes)
                n = len(found)
                at = found & 8 * len(marks) - 1
                last = (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                fps.append(majority(hashes))
                nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                sizes.append(n)
                maps.append(parity_map(found))
                keys.append(np.concatenate([found[~last], found[last]])[: n - -(-top * n // bottom) + 1])
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *keys]))
            parity = pa.ListArray.from_arrays(np.cumsum([0, *map(len, maps)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *maps]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, nodes)], pa.array(sizes, pa.int32()), parity, lists], ["id", "mark", "fp", "node", "size", "parity", "keys"])

    return own.mapInArrow(run, f"id {own.schema[0].dataType.simpleString()}, mark long, fp long, node long, size int, parity array<long>, keys array<long>")


def maps_near(a: str, b: str, size_a: str, size_b: str, similarity: tuple[int, int]) -> Column:
    """Whether sets of these sizes and parity maps may be similar: true for all that are."""
    top, bottom = similarity
    shorter = F.least(F.size(a), F.size(b))

    def folded(x: str) -> Column:
        """Sets of like sizes have maps of one length, or of twice the other's."""
        halves = F.zip_with(F.slice(x, F.lit(1), shorter), F.slice(x, shorter + 1, shorter), lambda v, w: v.bitwiseXOR(w))
        return F.when(F.size(x) == shorter, F.col(x)).otherwise(halves)

    apart = F.aggregate(F.zip_with(folded(a), folded(b), lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda n, v: n + v).cast("long")
    like = bottom * F.least(size_a, size_b).cast("long") >= top * F.greatest(size_a, size_b).cast("long")
    return like & ((top + bottom) * apart <= (bottom - top) * (F.col(size_a) + F.col(size_b)).cast("long"))


def alike(pairs: DataFrame, own: DataFrame, unique: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets of shingles are similar. unique: one row a node (best, size, parity)."""
    top, bottom = similarity

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(1):
                found = shingle_set(list(shingle_hashes(t.as_py() or "", width)))
                node = np.array([xxhash.xxh3_64_intdigest(found.tobytes())], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(np.array([0, len(found)], np.int32), found)], ["node", "shingles"])

    maps = lambda x: unique.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("parity").alias(f"_{x}"))
    near = pairs.join(maps("a"), "a").join(maps("b"), "b").where(maps_near("_a", "_b", "size_a", "size_b", similarity))
    near = cut(near.select("a", "b"), "near")
    met = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    least = cut(unique.join(met, "node").select("node", "best.id", "best.mark"), "least")
    # one text stands for a node, that of the best row's hash; copies of it meet before their sets are made
    texts = perhaps_in(own, "mark", key_bitmaps(least, "mark")).join(least.select("mark"), "mark", "left_semi").select("mark", "text").groupBy("mark").agg(F.first("text").alias("text"))
    sets = cut(texts.mapInArrow(run, "node long, shingles array<long>").join(least.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    of = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"_{x}"))
    both = F.size(F.array_intersect("_a", "_b")).cast("long")
    return cut(near.join(of("a"), "a").join(of("b"), "b").where((top + bottom) * both >= top * (F.size("_a") + F.size("_b")).cast("long")).select("a", "b"), "alike")


def similar_components(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: id_col, component_id (least id reachable over pairs of texts whose shingles have the Jaccard similarity top / bottom or more).

    Texts of fewer words than width are one shingle, texts without a word alike. Null ids never are
    a component's id unless all its ids are null. Repeated rows count each; an empty table gives none.
    """
    out = similar_representatives(docs, width, similarity, id_col, text_col, bucket)
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("component_id"))


def similar_representatives(docs: DataFrame, width: int, similarity: tuple[int, int], id_col: str, text_col: str, bucket: int) -> DataFrame:
    """(id, mark, node, best, rows) for every row of docs."""
    top, bottom = similarity
    if not 0 < top <= bottom:
        raise ValueError("similarity is a fraction (top, bottom) over 0, 1 at most")
    with scratch(docs.sparkSession) as keep:
        own = marked(docs, id_col, text_col)
        rows = cut(prefixes(own, width, similarity, common_shingles(own, width)), "prefixes")
        ids = cut(rows.select("id", "mark", "node"), "ids")
        unique = cut(rows.groupBy("node").agg(best_row(), F.min("fp").alias("fp"), F.count("*").alias("n"), F.min("size").alias("size"), F.min("parity").alias("parity")), "unique")
        table = rows.select("node", "size", F.posexplode("keys").alias("at", "key"))
        met = cut(table.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key"), "met")
        table = cut(perhaps_in(table, "key", key_bitmaps(met, "key")).join(met, "key").distinct(), "shared")

        def enough(x: str, y: str) -> Column:
            """Both have, from the key on, as many shingles as they must share."""
            return ((top + bottom) * F.least(F.col(f"{x}.size") - F.col(f"{x}.at"), F.col(f"{y}.size") - F.col(f"{y}.at")).cast("long")) >= top * (F.col(f"{x}.size") + F.col(f"{y}.size")).cast("long")

        def sorted_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
            return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()

        # of a fingerprint's links the one to the least: more would only be verified again
        linked = links(unique.select("fp").distinct(), DISTANCE, bucket)
        named = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
        first = unique.groupBy("fp").agg(F.min("node").alias("node"))
        near = named.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
        same = unique.join(first.toDF("fp", "x"), "fp").select("x", F.col("node").alias("y"))
        # rounds in which every node goes to one other of its key's, another for each key and round; then every pair that is still apart
        edges = None
        for turn in range(ROUNDS + 1):
            if edges is None:
                held, others = table, table
            else:
                parts = connected_components(edges)
                held = cut(table.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "held")
                main = held.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", "count").alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
                held = cut(held.join(main, "key"), "apart")
                others = held.where("component = main")
            if turn == ROUNDS:
                break
            stars = others.groupBy("key").agg(F.min_by(F.struct("node", "size", "at"), F.xxhash64("node", "key", F.lit(turn))).alias("s")).select("key", "s.*")
            met = (held if edges is None else held.where("component <> main")).alias("p").join(stars.alias("q"), "key").where(enough("p", "q"))
            pairs = sorted_pairs(met, "p.node", "q.node")
            if edges is None:
                pairs = pairs.unionByName(sorted_pairs(near, "x", "y")).unionByName(sorted_pairs(same, "x", "y")).distinct()
            found = alike(cut(pairs, "stars"), own, unique, width, similarity)
            edges = found if edges is None else edges.unionByName(found)
        # maps are held against each other within the join, so that few pairs leave it
        held = held.join(unique.select("node", "parity"), "node")
        p, q = held.alias("p"), held.alias("q")
        wanted = (F.col("p.key") == F.col("q.key")) & (F.col("p.component") != F.col("q.component")) & ((F.col("q.component") == F.col("q.main")) | (F.col("p.node") < F.col("q.node")))
        rest = p.where("component <> main").join(q, wanted & enough("p", "q") & maps_near("p.parity", "q.parity", "p.size", "q.size", similarity))
        edges = edges.unionByName(alike(cut(sorted_pairs(rest, "p.node", "q.node"), "rest"), own, unique, width, similarity))
        return attached(ids, unique, connected_components(edges), "node", keep)


def drop_rest(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows of found that are not their component's best; of rows that repeat the best row's id and text one stays."""
    is_best = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark"))
    gone = found.where("rows > 1").groupBy("id", "mark").agg(F.bool_and(~is_best).alias("all"), F.count("*").alias("n")).where("all or n > 1")
    return without_rows(docs, gone, id_col, F.xxhash64(f"_{docs.columns.index(text_col)}"))


def drop_near_copies(docs: DataFrame, width: int = 3, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of least id, null after all others (of equal ids the text of least hash); all columns kept.

    Rows that repeat id and text are one row afterwards, of different other columns that of least hash.
    """
    return drop_rest(docs, representatives(docs, width, checked(distance), id_col, text_col, BUCKET), id_col, text_col)


def drop_similar(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """drop_near_copies() with the components of similar_components()."""
    return drop_rest(docs, similar_representatives(docs, width, similarity, id_col, text_col, BUCKET), id_col, text_col)
