"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.shared import cut, pick, scratch

#: log2 of the hashed feature tables, steps of each fit.
BITS, STEPS = 18, 40
#: Bounds of the labelled sample that a fit reads: rows, and bytes of all their texts.
MOST_ROWS, MOST_BYTES = 2_000, 1 << 26
#: Tokens of a block whose transition products are taken side by side; tokens scored at once; words a worker remembers.
BLOCK, CHUNK, CACHE = 256, 1 << 20, 300_000
#: A token of a toxic document is labelled toxic if its word's weight is at least this share of the document's greatest.
SHARE, RATIO = 0.5, 9
TOKEN = re.compile(r"\w+")


def features_of(word: str) -> tuple[int, ...]:
    """Hashed features: the word, its first three, four and five letters, its last three, as far as it has more letters than that."""
    parts = [f"w{word}", *[f"{k}{word[:k]}" if len(word) > k else f"{k}" for k in (3, 4, 5)], f"e{word[-3:]}" if len(word) > 3 else "e"]
    return tuple(zlib.crc32(f.encode("utf-8", "replace")) & (1 << BITS) - 1 for f in parts)


class Emissions(dict):
    """A word's emission under a table of feature weights, remembered."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE:
            self.clear()
        e = float(self.weights[list(features_of(word))].sum())
        self[word] = e
        return e

    def of(self, text: str) -> np.ndarray:
        words = TOKEN.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


@dataclass
class Crf:
    """Two states; emissions, of state 1 against state 0, are sums of a word's feature weights."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    bias: float = -3.0
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Intercept and weights of a document's score.
    score: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))

    def chains(self, emissions: np.ndarray, first: np.ndarray):
        return chain(np.exp(np.clip(emissions + self.bias, -30, 30)), first, np.exp(self.start), np.exp(self.step))

    def probabilities(self, emissions: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(toxic) of each token."""
        forward, backward, _ = self.chains(emissions, first)
        on = forward[1] * backward[1]
        return on / (on + forward[0] * backward[0])

    def marginals(self, emissions: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each token, and the expected number of each (state before, state) within documents."""
        forward, backward, m = self.chains(emissions, first)
        on = forward[1] * backward[1]
        inner = np.flatnonzero(~first[1:]) + 1
        pair = [forward[i][inner - 1] * m[i][j][inner] * backward[j][inner] for i in (0, 1) for j in (0, 1)]
        total = pair[0] + pair[1] + pair[2] + pair[3]
        return on / (on + forward[0] * backward[0]), np.array([(x / total).sum() for x in pair]).reshape(2, 2)


def chain(x: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[list[np.ndarray]]]:
    """Forward and backward vectors (by state) of chains laid end to end, each up to a factor, and the transition matrices.

    A document's first token has a matrix of equal rows, so nothing passes from the document before;
    so have the tokens that pad the last block. Blocks stand side by side: their whole products are
    taken first, then vectors pass from block to block, then through all blocks at once.
    """
    n = len(x)
    blocks = max(1, -(-n // BLOCK))
    factor, new = np.ones(blocks * BLOCK), np.ones(blocks * BLOCK, bool)
    factor[:n], new[:n] = x, first
    factor, new = np.ascontiguousarray(factor.reshape(blocks, BLOCK).T), np.ascontiguousarray(new.reshape(blocks, BLOCK).T)
    m = [[np.where(new, start[0], step[i, 0]), np.where(new, start[1], step[i, 1]) * factor] for i in (0, 1)]
    none, one = np.zeros(blocks), np.ones(blocks)

    def whole(order: range, ahead: bool) -> np.ndarray:
        """Each block's product, as (2, 2, blocks)."""
        p = [[one, none], [none, one]]
        for k in order:
            q = [[m[i][j][k] for j in (0, 1)] for i in (0, 1)]
            left, right = (p, q) if ahead else (q, p)
            p = [[left[i][0] * right[0][j] + left[i][1] * right[1][j] for j in (0, 1)] for i in (0, 1)]
            if k % 8 == 0:
                total = p[0][0] + p[0][1] + p[1][0] + p[1][1]
                p = [[v / total for v in row] for row in p]
        return np.array(p)

    forth, back = range(BLOCK), range(BLOCK - 1, -1, -1)
    products = whole(forth, True)
    into, out = np.empty((2, blocks)), np.empty((2, blocks))
    v = np.array([0.5, 0.5])
    for b in range(blocks):
        into[:, b] = v
        v = v @ products[:, :, b]
        v = v / v.sum()
    products = whole(back, False)
    v = np.array([0.5, 0.5])
    for b in range(blocks - 1, -1, -1):
        out[:, b] = v
        v = products[:, :, b] @ v
        v = v / v.sum()
    forward = [np.empty((BLOCK, blocks)) for _ in (0, 1)]
    backward = [np.empty((BLOCK, blocks)) for _ in (0, 1)]
    u, w = into
    for k in forth:
        u, w = u * m[0][0][k] + w * m[1][0][k], u * m[0][1][k] + w * m[1][1][k]
        total = u + w
        u, w = u / total, w / total
        forward[0][k], forward[1][k] = u, w
    u, w = out
    for k in back:
        backward[0][k], backward[1][k] = u, w
        u, w = m[0][0][k] * u + m[0][1][k] * w, m[1][0][k] * u + m[1][1][k] * w
        total = u + w
        u, w = u / total, w / total
    flat = lambda y: y.T.ravel()[:n]
    return [flat(y) for y in forward], [flat(y) for y in backward], [[flat(y) for y in row] for row in m]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values end to end, whether a token is its document's first, and where documents begin and end."""
    ends = np.cumsum([0, *map(len, docs)])
    values = np.concatenate(docs) if docs else np.zeros(0)
    first = np.zeros(len(values), bool)
    first[ends[:-1][np.diff(ends) > 0]] = True
    return values, first, ends


def numbered(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's tokens as numbers of distinct words, and the features of those words."""
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in TOKEN.findall(t.lower())], np.int64) for t in texts]
    return docs, np.array([features_of(w) for w in number], np.int64).reshape(len(number), 5)


def feature_weights(docs: list[np.ndarray], features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression of documents' labels on the presence of features, both labels weighing the same."""
    sets = [np.unique(features[np.unique(d)]) for d in docs]
    used, at = np.unique(np.concatenate(sets), return_inverse=True)
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    norm = np.array([len(s) for s in sets]) ** -0.5
    w, b, last = np.zeros(len(used)), 0.0, np.zeros(len(used))
    for k in range(5 * STEPS):  # Nesterov's steps; documents have norm 1, so the curvature is 1/4 at most
        ahead = w + k / (k + 3) * (w - last)
        g = weight * (sigmoid(np.bincount(which, ahead[at], minlength=len(sets)) * norm + b) - toxic)
        last, w = w, ahead - 4 * (np.bincount(at, (g * norm)[which], minlength=len(used)) + 1e-5 * ahead)
        b -= g.sum()
    out = np.zeros(1 << BITS)
    out[used] = w
    return out


def token_labels(docs: list[np.ndarray], features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Labels of all tokens end to end: toxic are those of a toxic document whose words tell its label best.

    These weigh SHARE of the document's greatest at least; only words count of which toxic documents
    hold RATIO times as many, by document, as clean ones do, and more than one toxic document holds.
    """
    z = feature_weights(docs, features, toxic)[features].sum(axis=1)
    clean, bad = (np.bincount(np.concatenate([np.unique(d) for d, t in zip(docs, toxic) if t == kind]), minlength=len(z)) for kind in (False, True))
    z[(bad * (~toxic).sum() < RATIO * clean * toxic.sum()) | (bad < 2)] = 0
    return np.concatenate([(z[d] > 0) & (z[d] >= SHARE * z[d].max()) & bool(t) for d, t in zip(docs, toxic)])


def train(texts: list[str], toxic: np.ndarray) -> Crf:
    """Likelihood of the labelled tokens by adaptive gradient steps, then the document score's weights."""
    crf = Crf()
    docs, features = numbered(texts)
    some = [i for i, d in enumerate(docs) if len(d)]
    docs, toxic = [docs[i] for i in some], np.asarray(toxic, bool)[some]
    if not docs or toxic.all() or not toxic.any():
        return crf
    labels = token_labels(docs, features, toxic)
    words, first, ends = joined(docs)
    state = labels.astype(int)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (state[:-1][~first[1:]], state[1:][~first[1:]]), 1)
    begin = np.bincount(state[first], minlength=2).astype(float)
    params = {"weights": crf.weights, "start": crf.start, "step": crf.step, "bias": np.array([crf.bias])}
    seen = {k: np.full(v.shape, 1e-8) for k, v in params.items()}
    for _ in range(STEPS):
        crf.bias = float(params["bias"][0])
        p, pair = crf.marginals(crf.weights[features].sum(axis=1)[words], first)
        by_word = np.bincount(words, p - labels, minlength=len(features))
        grads = {
            "weights": np.bincount(features.ravel(), np.repeat(by_word, features.shape[1]), minlength=1 << BITS),
            "start": np.array([(1 - p[first]).sum(), p[first].sum()]) - begin,
            "step": pair - pairs,
            "bias": np.array([by_word.sum()]),
        }
        for k, v in params.items():
            g = grads[k] + 0.05 * v
            seen[k] += g * g
            v -= 0.5 * g / np.sqrt(seen[k])
    crf.bias = float(params["bias"][0])
    found = summary(crf.probabilities(crf.weights[features].sum(axis=1)[words], first), ends)
    x = np.column_stack([np.ones(len(found)), found])
    w = np.array([-2.0, 0.5, 0.0])
    for _ in range(100):  # Newton's steps, kept short since the labels may be separable
        q = sigmoid(x @ w)
        h = (x * (q * (1 - q))[:, None]).T @ x + np.eye(3)
        move = np.linalg.solve(h, x.T @ (q - toxic) + w)
        w -= move / max(1.0, float(np.abs(move).max()) / 0.2)
    crf.score = w
    return crf


def summary(p: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each document: log-odds of its greatest marginal, and the log of their sum. Documents without tokens have the least of both."""
    out = np.full((len(ends) - 1, 2), [-10.0, -10.0])
    full = np.flatnonzero(np.diff(ends) > 0)
    if len(full):
        top = np.clip(np.maximum.reduceat(p, ends[full]), 1e-5, 1 - 1e-5)
        out[full, 0] = np.log(top / (1 - top))
        out[full, 1] = np.log(np.add.reduceat(np.where(p > 0.05, p, 0), ends[full]) + 4.6e-5)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Crf:
    """Trains on labelled documents, half of each label and about most_rows in all at most, those of least xxhash64(id).

    Of these, rows are left out whose texts would take all together over most_bytes, so the driver
    gets a bounded sample. Only texts and labels are read. Null ids, texts and labels teach nothing;
    an id with two labels counts as toxic, an id with two texts teaches both.
    """
    known = pick(labels, id_col, label_col).toDF("id", "y").where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    counts = {bool(r.y): r.n for r in known.groupBy((F.col("y") != 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, most_rows / 2 / n) for y, n in counts.items()}
    draw = F.xxhash64("id").bitwiseAND(F.lit((1 << 32) - 1)) / float(1 << 32)
    chosen = known.where(draw < F.when(F.col("y") != 0, share.get(True, 0.0)).otherwise(share.get(False, 0.0)))
    texts = pick(docs, id_col, text_col).toDF("id", "text").where("text is not null")
    met = texts.join(F.broadcast(chosen), "id").select("id", F.make_valid_utf8("text").alias("text"), (F.col("y") != 0).alias("y"), F.octet_length("text").cast("long").alias("size"))
    with scratch(docs.sparkSession):
        drawn = cut(met, "drawn")  # about most_rows rows
        sizes = drawn.select("id", F.xxhash64("text").alias("mark"), "size").orderBy(F.xxhash64("id"), "mark").collect()
        total, over = 0, set()
        for r in sizes:
            if total + r["size"] > most_bytes:
                over.add((r.id, r.mark))
            else:
                total += r["size"]
        if over:
            out = docs.sparkSession.createDataFrame(sorted(over, key=str), f"_id {drawn.schema['id'].dataType.simpleString()}, _mark long")
            drawn = drawn.join(F.broadcast(out), (F.col("id") == F.col("_id")) & (F.xxhash64("text") == F.col("_mark")), "left_anti")
        got = drawn.select("text", "y").toArrow()
    return train(got.column("text").to_pylist(), np.array(got.column("y").to_pylist(), bool))


def tag(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id_col, score, predicted, spans (start, stop, p: code points and mean marginal of runs of toxic tokens) of every whole text.

    Null and empty texts have no tokens and the score of a text without any sign. Null and repeated
    ids pass as they come, each row for itself. Bytes that are no UTF-8 count as U+FFFD, which is no
    word. Tables of features are broadcast: 2**BITS x 8 bytes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        emissions = Emissions(own.weights)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))

        def scored(column: pa.Array, texts: list[str], tokens: list[np.ndarray]) -> pa.RecordBatch:
            values, first, ends = joined(tokens)
            p = own.probabilities(values, first) if len(values) else np.zeros(0)
            scores = sigmoid(np.column_stack([np.ones(len(texts)), summary(p, ends)]) @ own.score)
            spans: list[list[dict]] = [[] for _ in texts]
            for i in np.unique(np.searchsorted(ends, np.flatnonzero(p >= threshold), "right") - 1).tolist():
                spans[i] = offending(texts[i], p[ends[i] : ends[i + 1]], threshold)
            return pa.RecordBatch.from_arrays([column, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, span)], ["id", "score", "predicted", "spans"])

        for batch in batches:
            at, size, texts, tokens = 0, 0, [], []
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                tokens.append(emissions.of(texts[-1]))
                size += len(tokens[-1])
                if size >= CHUNK:
                    yield scored(batch.column(0).slice(at, i + 1 - at), texts, tokens)
                    at, size, texts, tokens = i + 1, 0, [], []
            if texts:
                yield scored(batch.column(0).slice(at, len(texts)), texts, tokens)

    own = pick(docs, id_col, text_col).withColumn(text_col, F.make_valid_utf8(text_col))
    kind = own.schema[0].dataType.simpleString()
    out = own.mapInArrow(run, f"id {kind}, score double, predicted int, spans array<struct<start: long, stop: long, p: double>>")
    return out.toDF(id_col, "score", "predicted", "spans")


def offending(text: str, p: np.ndarray, threshold: float) -> list[dict]:
    """Runs of toxic tokens. Offsets are those of the text itself where lower-casing keeps its length, else of the lower-cased text."""
    out: list[dict] = []
    last = -2
    for k, m in enumerate(TOKEN.finditer(text.lower())):
        if p[k] >= threshold:
            if last == k - 1:
                out[-1]["stop"] = m.end()
                out[-1]["ps"].append(float(p[k]))
            else:
                out.append({"start": m.start(), "stop": m.end(), "ps": [float(p[k])]})
            last = k
    return [{"start": s["start"], "stop": s["stop"], "p": sum(s["ps"]) / len(s["ps"])} for s in out]
