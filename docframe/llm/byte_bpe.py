"""Byte-level BPE by a sentencepiece model serialised straight from a rank vocabulary."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.shared import pick, slices

#: White space of one byte as the pre-token pattern sees it, and that of two and three bytes, as numbers.
SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
WIDE_SPACES = {n: np.array([int.from_bytes(c.encode(), "big") for c in map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]) if len(c.encode()) == n], np.int32) for n in (2, 3)}
#: Distinct units that a worker remembers before it starts afresh.
CACHE = 300_000
#: Parts pre-tokens while they are put into letters; units with the byte 0 go one by one.
BETWEEN = "\x00"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_letters() -> list[str]:
    """A letter for each byte: printable Latin-1 stands for itself, the rest takes letters from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


LETTERS = byte_letters()
TO_LETTERS = dict(enumerate(LETTERS))
TO_LETTERS_OR_BETWEEN = {**TO_LETTERS, 0: BETWEEN}
FROM_LETTER = {c: b for b, c in enumerate(LETTERS)}


def to_letters(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_LETTERS)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value: int | float | bytes | str) -> bytes:
    """One field of a protocol buffer."""
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece 0 is unknown, then the tokens in order of rank, scored by negative rank."""
    unknown, normal, bpe = 2, 1, 2
    tokens = sorted(ranks.items(), key=lambda x: x[1])
    pieces = [field(1, "<unk>") + field(2, 0.0) + field(3, unknown)]
    pieces += [field(1, to_letters(t)) + field(2, float(-r)) + field(3, normal) for t, r in tokens]
    trainer = field(3, bpe) + field(4, len(pieces)) + field(40, 0) + field(41, 2**64 - 1) + field(42, 2**64 - 1) + field(43, 2**64 - 1)
    normaliser = field(1, "identity") + field(2, b"") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join(field(1, p) for p in pieces) + field(2, trainer) + field(3, normaliser)


def unit_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where units of UTF-8 bytes end: before white space of ASCII that follows no white space at all, and at each text's end."""
    at = np.flatnonzero(SPACE[data])
    at = at[at > 0]
    before = data[at - 1]
    keep = ~SPACE[before]
    wide = np.flatnonzero(before >= 0x80)  # letters of more bytes may be white space themselves
    if len(wide):
        place = at[wide]
        last, second, third = data[place - 1], data[np.maximum(place - 2, 0)], data[np.maximum(place - 3, 0)]
        tail = second.astype(np.int32) << 8 | last
        keep[wide] &= ~(np.isin(tail, WIDE_SPACES[2]) | np.isin(third.astype(np.int32) << 16 | tail, WIDE_SPACES[3]))
    return np.unique(np.concatenate([at[keep], ends]))


class ByteBpe:
    """Encodes and decodes texts by a model of serialise_model().

    Texts fall into units (white space, then the rest up to the next white space). No pre-token
    crosses a unit's end, so each different unit of a column is looked up once, and its ids are
    remembered.
    """

    def __init__(self, model: bytes, ids: list[int], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.ids = np.array([0, *ids], np.uint32)
        tokens = [b""] * (max(ids, default=0) + 1)
        for k, i in enumerate(ids):
            tokens[i] = bytes(FROM_LETTER[c] for c in self.model.id_to_piece(k + 1))
        self.token_bytes, self.token_sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.clear()

    def clear(self) -> None:
        """Unit number n has sizes[n] ids, from starts[n] on in flat; the empty unit is number 0."""
        self.known: dict[str, int] = {"": 0}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, units: list[str]) -> None:
        parts, counts, findall = [], [], self.pattern.findall
        for u in units:
            own = findall(u)
            parts += own
            counts.append(len(own))
        joined = BETWEEN.join(parts)
        if joined.count(BETWEEN) == max(0, len(parts) - 1):  # one pass over all letters
            letters = joined.encode().decode("latin-1").translate(TO_LETTERS_OR_BETWEEN).split(BETWEEN) if parts else []
        else:
            letters = [to_letters(t.encode()) for t in parts]
        coded = self.model.encode(letters, out_type=int, num_threads=1) if letters else []
        ends = np.cumsum([0, *map(len, coded)])[np.cumsum([0, *counts])]
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units))))
        self.starts = np.concatenate([self.starts, len(self.flat) + ends[:-1]])
        self.sizes = np.concatenate([self.sizes, np.diff(ends)])
        self.flat = np.concatenate([self.flat, self.ids[np.fromiter(chain.from_iterable(coded), np.int64, int(ends[-1]))]])

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all units, and how many units each text has."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets[1:] - offsets[0]
        cuts = np.concatenate([[0], unit_ends(data, ends[ends > 0])]).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        different = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE:
            self.clear()
        numbers = list(map(self.known.get, different))
        missing = [u for u, n in zip(different, numbers) if n is None]
        if missing:
            self.learn(missing)
            numbers = list(map(self.known.__getitem__, different))
        return np.array(numbers, np.int64)[units.indices.to_numpy()], np.diff(np.searchsorted(cuts, np.concatenate([[0], ends])))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        which, units = self.numbered(texts)
        total = np.concatenate([[0], np.cumsum(self.sizes[which])])
        return np.diff(total[np.concatenate([[0], np.cumsum(units)])])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and where each text's start and end."""
        which, units = self.numbered(texts)
        ends = np.concatenate([[0], np.cumsum(self.sizes[which])])
        return gathered(self.flat, self.starts[which], self.sizes[which]), ends[np.concatenate([[0], np.cumsum(units)])]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids that ends cuts into texts, and where each text's start and end."""
        sizes = self.token_sizes[ids]
        return gathered(self.token_bytes, self.token_starts[ids], sizes), np.concatenate([[0], np.cumsum(sizes)])[ends]

    def encode(self, text: str) -> bytes:
        """The ids, each as four bytes, low byte first."""
        return self.encode_all(pa.array([text]))[0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        own = np.frombuffer(ids, "<u4").astype(np.int64)
        return self.decode_all(own, np.array([0, len(own)]))[0].tobytes()


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of all, end to end."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def coder(spark, vocabulary: str, pattern: str):
    """A function that makes a ByteBpe where it is called; the model travels as one broadcast of the vocabulary's size."""
    ranks = read_ranks(vocabulary)
    sent = spark.sparkContext.broadcast((serialise_model(ranks), sorted(ranks.values()), pattern))
    return lambda: ByteBpe(*sent.value)


def byte_bpe_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of every whole text; null counts as empty, which has no ids.

    Null and repeated ids and repeated rows are carried through as they come; other columns are not
    read. Bytes that are no UTF-8 count as U+FFFD.
    """
    make = coder(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = make()
        for batch in (s for b in batches for s in slices(b, 1)):
            ids, ends = bpe.encode_all(batch.column(1))
            data, places = bpe.decode_all(ids, ends)
            digests = [[hashlib.sha256(memoryview(flat[a:b])).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())] for flat, cuts in ((ids.astype("<u4"), ends), (data, places))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), *[pa.array(d, pa.string()) for d in digests]], ["id", "n", "a", "b"])

    own = pick(docs, id_col, text_col).withColumn(text_col, F.make_valid_utf8(text_col))
    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, n long, a string, b string").toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def byte_bpe_ids(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array of ints) of every text; null gives no ids."""
    make = coder(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = make()
        for batch in (s for b in batches for s in slices(b, 1)):
            ids, ends = bpe.encode_all(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.int32))], ["id", "ids"])

    own = pick(docs, id_col, text_col).withColumn(text_col, F.make_valid_utf8(text_col))
    return own.mapInArrow(run, f"id {own.schema[0].dataType.simpleString()}, ids array<int>").toDF(id_col, "ids")
