"""Sequence packing along a Hilbert curve through hashed document vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.byte_bpe import to_letters
from docframe.llm.shared import BATCH, cut, pick, released, slices

#: Slots of a hashed document vector, dimensions it is projected to, bits of a coordinate, tokens of a sequence.
SLOTS, DIMENSIONS, BITS, LENGTH = 1024, 4, 10, 2048
SEED = 20240
#: Words that a worker remembers before it starts afresh, documents whose vectors are made at once, parts of a slice that are tokenized at once.
WORDS, DOCUMENTS, PARTS = 300_000, 128, 2
#: Pieces and ids of a batch of pieces; an id takes 8 bytes.
PIECES, IDS = 4096, BATCH // 8


class WordTokens:
    """Token ids of whole texts by a tokenizers file whose pre-tokens never hold white space.

    A column of texts falls into words at ASCII white space, and each different word of it is looked
    up once; what is not remembered is tokenized by the library. Texts of letters below U+0240 are
    lower-cased beforehand, as the file's normalizer would. Strings of the file's special tokens keep
    their ids, as add_special_tokens=False leaves them.
    """

    ENDS = frozenset(".,")
    #: The first byte of all letters from U+0240 on is this or greater; the letter I with a dot has two lower-case letters.
    LEAD, DOTTED = 0xC9, "\u0130"
    OTHER = re.compile("[\u0240-\U0010ffff\u0130]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in two bytes")
        if not self.model.end_of_word_suffix:
            raise ValueError("a pre-token's last id must tell its end")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([*map(re.escape, self.special), self.OTHER.pattern]))
        self.last_of_piece = np.zeros(1 << 16, bool)
        self.last_of_piece[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(self.model.end_of_word_suffix)]] = True
        self.clear()

    def clear(self) -> None:
        """Word number n has sizes[n] ids, from starts[n] on in flat; the empty word is number 0."""
        self.known: dict[str, int] = {"": 0}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> np.ndarray:
        """New words get numbers, which are returned; words of Latin letters without special tokens go pre-token by pre-token."""
        odd, pieces, counts, plain, rest = self.odd.search, [], [], words, []
        if odd("\n".join(words)):  # no word holds white space, so nothing is found that lies across two
            places = {False: [], True: []}
            for k, word in enumerate(words):
                places[odd(word) is not None].append(k)
            plain, rest = ([words[k] for k in places[o]] for o in (False, True))
        for word in plain:
            low = word.lower()
            if low.isalpha():
                pieces.append(low if low.isascii() else to_letters(low.encode()))
                counts.append(1)
            elif low[-1] in self.ENDS and low[:-1].isalpha():
                pieces += (low[:-1] if low.isascii() else to_letters(low[:-1].encode()), low[-1])
                counts.append(2)
            else:
                own = self.split(low)
                pieces += [letters for letters, _ in own]
                counts.append(len(own))
        tokenize = self.model.tokenize
        ids = np.array([t.id for p in pieces for t in tokenize(p)], np.uint16)
        ends = np.concatenate([[0], np.flatnonzero(self.last_of_piece[ids]) + 1])[np.cumsum([0, *counts])]
        others = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in rest]
        sizes = np.concatenate([np.diff(ends), np.array([len(o) for o in others], np.int64)])
        numbers = np.arange(len(self.known), len(self.known) + len(words))
        self.known.update(zip(plain + rest, numbers.tolist()))
        if rest:
            back = np.empty(len(words), np.int64)
            back[places[False] + places[True]] = numbers
            numbers = back
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids, np.array([i for o in others for i in o], np.uint16)])
        return numbers

    def lower(self, texts: pa.Array) -> pa.Array:
        """Lower-cased are the texts whose letters have a lower case that all libraries agree on; special tokens' strings must not arise by it."""
        offsets, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        others = np.flatnonzero(data[offsets[0] : offsets[-1]] >= self.LEAD) + offsets[0]
        plain = pc.invert(pc.match_substring(texts, self.DOTTED)).to_numpy(zero_copy_only=False)
        plain[np.unique(np.searchsorted(offsets, others, "right") - 1)] = False
        low = pc.utf8_lower(texts)
        for s in self.special:
            plain &= ~pc.match_substring(low, s).to_numpy(zero_copy_only=False)
        return low if plain.all() else pc.if_else(pa.array(plain), low, texts)

    def encode(self, texts: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray]:
        """uint16 ids of all texts end to end, each text's followed by the last id, and where texts start and end."""
        texts = texts.cast(pa.large_string()).fill_null("")
        lists = pc.ascii_split_whitespace(self.lower(texts))
        words = lists.flatten().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > WORDS:
            self.clear()
        numbers = np.fromiter(map(self.known.get, different, repeat(-1)), np.int64, len(different))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            numbers[missing] = self.learn([different[k] for k in missing.tolist()])
        which = numbers[words.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self.sizes[which])])
        at = np.arange(ends[-1]) + np.repeat(self.starts[which] - ends[:-1], self.sizes[which])
        starts = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]
        return np.insert(self.flat[at], starts[1:], last), starts + np.arange(len(starts))


def projection() -> np.ndarray:
    """(slots x dimensions), fixed by SEED."""
    return np.random.default_rng(SEED).standard_normal((SLOTS, DIMENSIONS))


def coordinates(ids: np.ndarray, ends: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Of the documents that ends cuts ids into: hashed, normed vectors, projected, each dimension spread over 0 .. 2**BITS - 1 by the logistic curve."""
    n = len(ends) - 1
    slots = (ids.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(22)) + np.repeat(np.arange(n, dtype=np.uint32) * np.uint32(SLOTS), np.diff(ends))
    vectors = np.sqrt(np.bincount(slots, minlength=n * SLOTS).reshape(n, SLOTS))
    points = vectors @ matrix / np.maximum(1e-9, np.sqrt((vectors * vectors).sum(axis=1)))[:, None]
    return np.minimum((1 / (1 + np.exp(-1.7 * points)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of integer points (rows x dimensions), by rotating and reflecting sub-cubes from the top bit down."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[n - 1] & (1 << level)) != 0, turn ^ ((1 << level) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> level & 1
    return key


def tokenised(docs: DataFrame, tokenizer: str, last: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, ids): ids as two bytes each."""
    matrix = projection()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens(tokenizer)
        for batch in (s for b in batches for s in slices(b, 1, PARTS)):
            ids, ends = words.encode(batch.column(1), last)
            points = [coordinates(ids[ends[a] : ends[b]], ends[a : b + 1] - ends[a], matrix) for a in range(0, len(batch), DOCUMENTS) for b in (min(len(batch), a + DOCUMENTS),)]
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(ends * 2), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hilbert_keys(np.concatenate(points))), data.cast(pa.binary())], ["id", "key", "ids"])

    own = pick(docs, id_col, text_col)
    own = own.withColumn(text_col, F.make_valid_utf8(text_col))
    return own.mapInArrow(run, f"id {own.schema[0].dataType.simpleString()}, key long, ids binary")


def cut_sizes(n: int, length: int) -> list[int]:
    """The last n tokens of a run, fewer than length, as sequences of powers of two, the largest first: none needs padding."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, last: int = 1, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False) -> DataFrame:
    """Pieces: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (and tokens, an array, if asked for).

    Documents are ordered along the curve; equal keys are ordered by hash of id, so that a range of
    keys may end within a large group of like documents. Each range partition is one run of tokens,
    cut at every `length` and, at its end, into powers of two. sequence_id holds the partition in
    its upper bits. A null text has only the last id; null and repeated ids are carried as they come,
    each row for itself. Bytes that are no UTF-8 count as U+FFFD.
    """
    rows = cut(tokenised(docs, tokenizer, last, id_col, text_col), "tokens")
    kind = rows.schema["id"].dataType.simpleString()
    ordered = rows.withColumn("tie", F.xxhash64("id", "ids")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "id")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sequence is given out when it is full; what waits is less than one sequence, and a batch has about PIECES pieces and IDS ids at most."""
        names = ["id", "start", "length", "crc", "doc_tokens", "sequence", "offset", "tokens"]
        waiting: list[tuple] = []  # (id, start, ids, doc_tokens)
        filled, sequence, part = 0, 0, None

        def give(pieces: list[tuple]) -> pa.RecordBatch:
            ids, starts, parts, totals, numbers, offsets = zip(*pieces)
            crcs = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
            sizes = np.array([len(p) for p in parts])
            shown = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.concatenate(parts).astype(np.int64)) if tokens else pa.nulls(len(parts), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(ids, batch_type), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(totals, pa.int64()), pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64()), shown], names)

        batch_type, out, held = None, [], 0
        for batch in batches:
            batch_type = batch.column(0).type
            for doc, data, number in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                part = number
                ids = np.frombuffer(data.as_py(), np.uint16)
                at = 0
                while at < len(ids):
                    take = min(length - filled, len(ids) - at)
                    waiting.append((doc, at, ids[at : at + take], len(ids), filled))
                    filled, at = filled + take, at + take
                    if filled == length:
                        out += [(d, s, p, t, (part << 40) + sequence, o) for d, s, p, t, o in waiting]
                        waiting, filled, sequence, held = [], 0, sequence + 1, held + length
                        if len(out) > PIECES or held > IDS:
                            yield give(out)
                            out, held = [], 0
        start = 0
        for size in cut_sizes(filled, length):
            end = start + size
            for d, s, p, t, o in waiting:
                lo, hi = max(o, start), min(o + len(p), end)
                if lo < hi:
                    out.append((d, s + lo - o, p[lo - o : hi - o], t, (part << 40) + sequence, lo - start))
            start, sequence = end, sequence + 1
        if out:
            yield give(out)

    pieces = ordered.select("id", "ids", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, f"id {kind}, start long, length long, crc long, doc_tokens long, sequence long, offset long, tokens array<long>")
    out = pieces.toDF(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tokens")
    return out if tokens else out.drop("tokens")
