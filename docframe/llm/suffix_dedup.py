"""Removal of byte strings that occur elsewhere, by suffix sorting in buckets.

Every window of LENGTH bytes has an anchor: the gram of GRAM bytes in it whose hash is least, the
leftmost of equals. Equal windows have equal anchors at the same place, so a window can repeat only
where its anchor's gram does. An anchor owns a stretch of neighbouring windows; the bytes that these
cover are its context. Anchors whose whole contexts are equal repeat altogether and count once from
then on. What remains are anchors whose gram occurs in several contexts: these form buckets by gram,
and each bucket's suffixes, one from each window, are sorted by themselves. Suffixes of a bucket are
synchronised by the anchor: those compared lie at the same distance from it, so the differences of
their places are 0 modulo PERIOD and one residue is a difference cover. Ranks of the sample at every
PERIOD-th place, found by doubling, settle all ties longer than the bytes before the next sample
place. Memory is bound by one bucket; a bucket of very many contexts is split by its windows' digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.shared import attach, cut, key_bitmaps, perhaps_in, pick, released, remove, scratch

#: Bytes of a string that counts, of an anchor's gram; grams in a window; places between cover samples.
LENGTH, GRAM, PERIOD = 200, 64, 32
SPAN = LENGTH - GRAM + 1
#: Window places whose hashes are held at once, contexts sorted at once, and contexts that a bucket may have.
PIECE, CONTEXTS, MOST = 1 << 16, 8192, 100_000
#: Column of the anchor in a bucket's matrix, and the matrix's width.
ANCHOR = -(-SPAN // PERIOD) * PERIOD
WIDTH = ANCHOR + -(-LENGTH // PERIOD) * PERIOD + PERIOD

_random = np.random.default_rng(7)
LETTERS = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _random.integers(0, 1 << 63, 6, np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = np.uint64((1 << 20) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on, by doubling."""
    h = LETTERS[data]
    for level, factor in enumerate(FACTORS):
        k = 1 << level
        h = h[:-k] * factor + h[k:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(y: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        y = np.minimum(y[:-size], y[size:])
        size *= 2
    rest = width - size
    return np.minimum(y[: len(y) - rest], y[rest:]) if rest else y


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, anchor, first window, last window, gram hash) of all anchors; places are those in data, which holds the documents end to end."""
    for lo in range(int(offsets[0]), int(offsets[-1]) - LENGTH + 1, PIECE):
        hi = min(lo + PIECE, int(offsets[-1]) - LENGTH + 1)
        hashes = gram_hashes(data[lo : hi - 1 + LENGTH])
        least = sliding_least(hashes & ~PLACE | np.arange(len(hashes), dtype=np.uint64), SPAN)
        # windows that end within their document
        valid = np.zeros(hi - lo + 1, np.int32)
        first, last = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left")
        starts, ends = np.maximum(offsets[first:last], lo), np.minimum(offsets[first + 1 : last + 1] - LENGTH + 1, hi)
        some = ends > starts
        np.add.at(valid, starts[some] - lo, 1)
        np.add.at(valid, ends[some] - lo, -1)
        at = np.flatnonzero(np.cumsum(valid[:-1]))
        if len(at):
            place = (least[at] & PLACE).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
            end = np.append(new[1:], len(at)) - 1
            windows = at[new] + lo
            yield np.searchsorted(offsets, windows, "right") - 1, place[new] + lo, windows, at[end] + lo, hashes[place[new]]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and where each value starts; nulls are empty."""
    values = [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)]).astype(np.int64)


def pack_place(anchor: np.ndarray, before: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One long: the anchor's place in its document, the bytes from its first window to it, its number of windows less one."""
    return anchor << 16 | before << 8 | count


def anchors(rows: DataFrame, kind: str) -> DataFrame:
    """rows: (id, mark, text). (id, mark, gram, context, place) of every anchor."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(2))
            view = memoryview(data)
            for doc, anchor, first, last, gram in anchors_of(data, offsets):
                before = anchor - first
                contexts = [xxhash.xxh64_intdigest(view[a : b + LENGTH], s) for a, b, s in zip(first.tolist(), last.tolist(), before.tolist())]
                which = pa.array(doc)
                place = pack_place(anchor - offsets[doc], before, last - first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(gram.view(np.int64)), pa.array(np.array(contexts, np.uint64).view(np.int64)), pa.array(place)], ["id", "mark", "gram", "context", "place"])

    return rows.mapInArrow(run, f"id {kind}, mark long, gram long, context long, place long")


def repeated_windows(texts: np.ndarray, group: np.ndarray, before: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether each window of a bucket's contexts occurs in two of them, as (contexts x SPAN) flags by distance to the anchor.

    texts: (contexts x WIDTH) bytes, anchors at column ANCHOR; group: a number for each gram.
    """
    n = len(texts)
    flags = np.zeros((n, SPAN), bool)
    words = np.ascontiguousarray(texts).view(">u8").astype(np.uint64)

    def ranks(*keys: np.ndarray) -> np.ndarray:
        """Dense ranks of tuples, the first key leading."""
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for k in keys:
            own = k[order]
            new[1:] |= own[1:] != own[:-1]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    # the cover sample: every PERIOD-th column; ranks of its suffixes to a depth of 5 periods, by doubling
    per, columns = PERIOD // 8, WIDTH // PERIOD
    one = ranks(*[words[:, k::per].ravel() for k in range(per)]).reshape(n, columns)
    two = ranks(one[:, :-1].ravel(), one[:, 1:].ravel()).reshape(n, columns - 1)
    four = ranks(two[:, :-2].ravel(), two[:, 2:].ravel()).reshape(n, columns - 3)
    five = ranks(four[:, :-1].ravel(), one[:, 4:].ravel()).reshape(n, columns - 4)
    for distance in range(SPAN):
        rows = np.flatnonzero((before >= distance) & (before - count <= distance))
        if len(rows) < 2:
            continue
        start = ANCHOR - distance
        sample = -(-start // PERIOD) * PERIOD
        head = padded_words(texts[rows, start:sample])
        tail = padded_words(texts[rows, sample + 5 * PERIOD : start + LENGTH])
        keys = [group[rows], *head, five[rows, sample // PERIOD], *tail]
        order = np.lexsort(keys[::-1])
        same = np.ones(len(rows) - 1, bool)
        for k in keys:
            own = k[order]
            same &= own[1:] == own[:-1]
        both = np.zeros(len(rows), bool)
        both[1:] |= same
        both[:-1] |= same
        flags[rows[order[both]], distance] = True
    return flags


def padded_words(texts: np.ndarray) -> list[np.ndarray]:
    """Columns of bytes as big-endian words, the last padded with zeros."""
    n, width = texts.shape
    if not width:
        return []
    full = np.zeros((n, -(-width // 8) * 8), np.uint8)
    full[:, :width] = texts
    return list(full.view(">u8").astype(np.uint64).T)


def spans_of(windows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs (first, last) of neighbouring numbers of a sorted array."""
    if len(windows):
        cuts = np.flatnonzero(np.diff(windows) > 1)
        yield from zip(windows[np.concatenate([[0], cuts + 1])].tolist(), windows[np.append(cuts, len(windows) - 1)].tolist())


SPAN_FIELDS = "mark long, start long, stop long"


def sorted_buckets(contexts: DataFrame, kind: str) -> DataFrame:
    """(id, mark, start, stop) of the repeated bytes of contexts that occur once; contexts: (gram, id, mark, place, n, bytes)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by gram; whole grams are sorted together, up to about CONTEXTS contexts."""
        rest: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            rest.append(batch)
            held += len(batch)
            if held >= CONTEXTS:
                whole = pa.Table.from_batches(rest).combine_chunks()
                gram = whole.column("gram").to_numpy()
                at = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0
                yield from settled(whole.slice(0, at))
                rest = whole.slice(at).to_batches()
                held = len(whole) - at if at else 0
        if rest:
            yield from settled(pa.Table.from_batches(rest))

    def settled(own: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(own) < 2:
            return
        gram, place, n = (own.column(c).to_numpy() for c in ("gram", "place", "n"))
        group = np.concatenate([[0], np.cumsum(gram[1:] != gram[:-1])])
        before, count = place >> 8 & 255, place & 255
        texts = np.zeros((len(own), WIDTH), np.uint8)
        for i, data in enumerate(own.column("bytes").to_pylist()):
            texts[i, ANCHOR - before[i] : ANCHOR - before[i] + len(data)] = np.frombuffer(data, np.uint8)
        flags = repeated_windows(texts, group, before, count)
        at, start, stop = [], [], []
        for i in np.flatnonzero(flags.any(axis=1) & (n == 1)).tolist():
            anchor = int(place[i] >> 16)
            for a, b in spans_of(anchor - np.flatnonzero(flags[i])[::-1]):
                at.append(i)
                start.append(a)
                stop.append(b + LENGTH)
        which = pa.array(at, pa.int64())
        out = pa.table([own.column("id").take(which), own.column("mark").take(which), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], ["id", "mark", "start", "stop"])
        yield from out.combine_chunks().to_batches()

    rows = contexts.repartition("gram").sortWithinPartitions("gram")
    return rows.mapInArrow(run, f"id {kind}, {SPAN_FIELDS}")


def split_buckets(contexts: DataFrame, kind: str) -> DataFrame:
    """As sorted_buckets(), for grams of any number of contexts: each window's 128-bit digest is a bucket of its own."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, at, window, high, low = batch.column("place").to_numpy(), [], [], [], []
            for i, data in enumerate(batch.column("bytes").to_pylist()):
                first = int(place[i] >> 16) - int(place[i] >> 8 & 255)
                for k in range(len(data) - LENGTH + 1):
                    digest = xxhash.xxh3_128_digest(data[k : k + LENGTH])
                    at.append(i)
                    window.append(first + k)
                    high.append(digest[:8])
                    low.append(digest[8:])
            which = pa.array(at, pa.int64())
            halves = [pa.array(np.frombuffer(b"".join(x), np.int64)) for x in (high, low)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(which) for c in ("id", "mark", "n")], pa.array(window, pa.int64()), *halves], ["id", "mark", "n", "window", "high", "low"])

    windows = cut(contexts.mapInArrow(run, f"id {kind}, mark long, n long, window long, high long, low long"), "windows")
    twice = windows.groupBy("high", "low").agg(F.count("*").alias("met")).where("met > 1").select("high", "low")
    return windows.where("n = 1").join(twice, ["high", "low"], "left_semi").select("id", "mark", F.col("window").alias("start"), (F.col("window") + LENGTH).alias("stop"))


def repeated_spans(rows: DataFrame, kind: str, most: int = MOST) -> DataFrame:
    """(id, mark, start, stop): bytes that repeated windows cover, in spans that may overlap. rows: (id, mark, text)."""
    with scratch(rows.sparkSession) as keep:
        spans = spans_of_rows(rows, kind, most)
        keep(spans)
    return spans


def spans_of_rows(rows: DataFrame, kind: str, most: int) -> DataFrame:
    found = cut(anchors(rows, kind), "anchors")
    twice = cut(found.groupBy("gram").agg(F.count("*").alias("met")).where("met > 1"), "twice")
    likely = perhaps_in(found, "gram", key_bitmaps(twice, "gram"))
    shared = cut(attach(likely, twice, "gram", "met", found.count()).drop("met"), "shared")
    remove(found)
    classes = cut(shared.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "place")).alias("one")), "classes")
    whole = shared.join(classes.where("n > 1").select("gram", "context"), ["gram", "context"], "left_semi")
    first = F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(F.lit(255))
    whole = whole.select("id", "mark", first.alias("start"), (first + F.col("place").bitwiseAND(F.lit(255)) + LENGTH).alias("stop"))
    mixed = cut(classes.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1").select("gram", "contexts"), "mixed")
    wanted = classes.join(mixed, "gram").select("gram", "n", "contexts", "one.*")
    lists = wanted.groupBy("id", "mark").agg(F.collect_list(F.struct("gram", "n", "contexts", "place")).alias("wanted"))
    held = rows.alias("r").join(lists.alias("l"), same_row("r", "l")).select("r.id", "r.mark", "r.text", "l.wanted")

    @released
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"gram": [], "n": [], "contexts": [], "place": [], "bytes": []}
            which: list[int] = []
            for i, (text, own) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
                data = text.as_py() or b""
                for w in own:
                    first = (w["place"] >> 16) - (w["place"] >> 8 & 255)
                    which.append(i)
                    for name in ("gram", "n", "contexts", "place"):
                        out[name].append(w[name])
                    out["bytes"].append(data[first : first + (w["place"] & 255) + LENGTH])
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *[pa.array(v, pa.binary() if k == "bytes" else pa.int64()) for k, v in out.items()]], ["id", "mark", *out])

    contexts = held.mapInArrow(read, f"id {kind}, mark long, gram long, n long, contexts long, place long, bytes binary")
    if mixed.where(F.col("contexts") > most).isEmpty():
        return cut(whole.unionByName(sorted_buckets(contexts, kind)), "spans")
    contexts = cut(contexts, "contexts")
    parts = sorted_buckets(contexts.where(F.col("contexts") <= most), kind), split_buckets(contexts.where(F.col("contexts") > most), kind)
    return cut(whole.unionByName(parts[0]).unionByName(parts[1]), "spans")


def same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.mark") == F.col(f"{b}.mark"))


def merged(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Sorted spans without overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], min(s["stop"], size)) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def joined_rest(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of UTF-8 bytes, without the parts of characters that a cut leaves over."""
    parts, at = [], 0
    for a, b in [*spans, (len(data), len(data))]:
        start, stop = at, a
        if at:  # bytes that go on a character begun in the span
            while start < stop and data[start] & 0xC0 == 0x80 and start - at < 3:
                start += 1
        if a < len(data):  # a character that the span goes on
            lead = stop - 1
            while lead >= start and data[lead] & 0xC0 == 0x80 and stop - lead < 4:
                lead -= 1
            if lead >= start and data[lead] >= 0xC0 and stop - lead < (2 if data[lead] < 0xE0 else 3 if data[lead] < 0xF0 else 4):
                stop = lead
        parts.append(data[start:stop])
        at = b
    return b"".join(parts)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text): id and mark, a hash of the text, tell rows apart; rows equal in both are copies."""
    return pick(docs, id_col, text_col).toDF("id", "text").select("id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))


def spans_by_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(id, mark, spans): for rows with repeated bytes."""
    rows = numbered(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    spans = repeated_spans(rows, kind, most)
    return spans.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans (start, stop).

    A byte goes if a string of LENGTH bytes that covers it starts at another place too, in any
    document or the same one; strings do not cross documents. Null and empty texts have no bytes;
    texts shorter than LENGTH lose none. Rows that repeat a whole row count as two places each.
    """
    own = spans_by_row(docs, id_col, text_col, most)
    rows = numbered(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    joined = rows.alias("r").join(own.alias("l"), same_row("r", "l"), "left").select("r.id", "r.text", "l.spans")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, digests, kept = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                data = text.as_py() or b""
                runs = merged(spans, len(data))
                sizes.append(len(data))
                gone.append(sum(b - a for a, b in runs))
                digests.append(hashlib.sha256(without(data, runs)).hexdigest())
                kept.append([{"start": a, "stop": b} for a, b in runs])
            kind_of = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(k) for k in kept], pa.int64()), pa.array(digests, pa.string()), pa.array(kept, kind_of)], ["id", "a", "b", "c", "d", "e"])

    out = joined.mapInArrow(run, f"id {kind}, a long, b long, c long, d string, e array<struct<start: long, stop: long>>")
    return out.toDF(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """docs with the repeated bytes cut out of text_col; parts of characters left at a cut go too. Other columns stay; null texts stay null."""
    own = spans_by_row(docs, id_col, text_col, most)
    names = docs.columns
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])
    at_id, at_text = f"_{names.index(id_col)}", f"_{names.index(text_col)}"

    @F.arrow_udf("binary")
    def cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts, spans.to_pylist()):
            data = text.as_py()
            if own and data is not None:
                data = joined_rest(data, merged(own, len(data)))
            out.append(data)
        return pa.array(out, pa.binary())

    joined = rows.withColumn("_mark", F.xxhash64(at_text)).join(own.withColumnsRenamed({"id": "_id", "mark": "_own"}), F.col(at_id).eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_own")), "left")
    return joined.withColumn(at_text, F.when(F.col("spans").isNull(), F.col(at_text)).otherwise(cut_out(F.col(at_text).cast("binary"), F.col("spans")).cast("string"))).select(rows.columns).toDF(*names)
