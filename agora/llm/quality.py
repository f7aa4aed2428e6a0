"""Quality classifier (operator 8): random indexing, pooled vectors, a two-layer network.

1. *Random indexing.*  Every token of every document adds the sparse ternary index vectors of
   its neighbours (window ``WINDOW``) to its own context vector.  Tokens are hashed to ``ROWS``
   rows, so the table has a fixed size (``ROWS * DIM`` numbers) whatever the vocabulary.  The
   statistics cover all documents; each task adds up its own table, and the tables are summed
   in two salted steps.
2. *Pooling.*  A document is the mean and the spread of its tokens' unit vectors, and the mean
   change from one token to the next (repetition makes it small).
3. *Network.*  tanh hidden layer and a logistic output, fitted with numpy on at most
   ``max_labelled`` labelled texts (the bound is a parameter; the texts are those with the
   smallest hash of doc_id and text).  A fifth of them is set aside to fit the temperature.

Only the text is an input of a score.  Null and empty texts pool to zero and get the score the
network gives to that vector.  A text of a doc_id counts once per different label of that doc_id,
however often the label or the row is repeated; rows
with a null label or doc_id are not used for fitting.  Without any usable label, or with
labels of one kind only, the score is the (smoothed) share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.common import groups_of_rows, hash_tokens, keep_rows, segments, text_hash, texts, utf8

ROWS, DIM, ACTIVE, WINDOW = 8192, 32, 2, 2
STRIPE = 512  # rows of the table in one record while it is summed
FEATURES = 3 * DIM
PIECE = 1 << 18  # bytes worked on at once: a token takes a few hundred bytes of vectors

# byte classes: 0 white space, 1 letter, digit or non-ASCII, 2 punctuation
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1


def token_rows(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table row and start of every token (a run of word bytes or of punctuation); ``cuts`` are
    the texts' first bytes, which no token crosses."""
    kind = _CLASS[data]
    starts, lengths = segments(kind, cuts)
    return (hash_tokens(data[kind > 0], lengths) & np.uint64(ROWS - 1)).astype(np.int64), starts


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each row's index vector."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, DIM, (ROWS, ACTIVE)), rng.choice([-1.0, 1.0], (ROWS, ACTIVE))


def _context_table(columns: Iterator[pa.Array]) -> np.ndarray:
    place, sign = index_vectors()
    table = np.zeros(ROWS * DIM)
    for column in columns:
        data, at = utf8(column)
        for a, b in groups_of_rows(at, PIECE):
            rows, starts = token_rows(data[at[a]:at[b]], at[a:b] - at[a])
            doc = np.searchsorted(at[a:b + 1] - at[a], starts, "right")
            for gap in range(1, WINDOW + 1):
                near = doc[gap:] == doc[:-gap]
                left, right = rows[:-gap][near], rows[gap:][near]
                for one, other in ((left, right), (right, left)):
                    for k in range(ACTIVE):
                        table += np.bincount(one * DIM + place[other, k], sign[other, k], ROWS * DIM)
    return table


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors (``ROWS x DIM``) from all documents of ``docs``."""
    salts = 32

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _context_table(b.column(0) for b in batches if b.num_rows)
        if table.any():
            salt = int(np.abs(table).sum()) % salts
            yield pa.RecordBatch.from_pydict({
                "stripe": pa.array(range(ROWS // STRIPE), pa.int32()),
                "salt": pa.array([salt] * (ROWS // STRIPE), pa.int32()),
                "part": [x.tobytes() for x in table.reshape(ROWS // STRIPE, -1)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(STRIPE * DIM)
        for part in pdf["part"]:
            total += np.frombuffer(part)
        return pd.DataFrame({"stripe": pdf["stripe"][:1], "salt": pdf["salt"][:1], "part": [total.tobytes()]})

    schema = "stripe int, salt int, part binary"
    parts = texts(docs).select("text").mapInArrow(partial, schema)
    sums = (parts.groupBy("stripe", "salt").applyInPandas(add, schema)
            .groupBy("stripe").applyInPandas(add, schema))
    table = np.zeros((ROWS // STRIPE, STRIPE * DIM))
    for row in sums.collect():  # ROWS * DIM numbers in all, whatever the input
        table[row["stripe"]] = np.frombuffer(row["part"])
    table = table.reshape(ROWS, DIM)
    damped = np.sign(table) * np.log1p(np.abs(table))
    return (damped / np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One feature row per text of an Arrow column."""
    data, at = utf8(column)
    out = np.zeros((len(column), FEATURES), np.float32)
    for a, b in groups_of_rows(at, PIECE):
        rows, starts = token_rows(data[at[a]:at[b]], at[a:b] - at[a])
        first = np.searchsorted(starts, at[a:b + 1] - at[a])
        count = np.diff(first)
        some = np.flatnonzero(count)
        if not len(some):
            continue
        v = vectors[rows]
        step = np.zeros_like(v)
        np.abs(v[1:] - v[:-1], out=step[1:])
        step[first[:-1][some]] = 0  # no change into the first token of a document
        n = count[some, None].astype(np.float32)
        mean = np.add.reduceat(v, first[:-1][some], axis=0) / n
        spread = np.sqrt(np.maximum(np.add.reduceat(v * v, first[:-1][some], axis=0) / n - mean ** 2, 0))
        change = np.add.reduceat(step, first[:-1][some], axis=0) / np.maximum(n - 1, 1)
        out[a + some] = np.hstack([mean, spread, change])
    return out


@dataclass(frozen=True)
class Network:
    """tanh layer, logistic output and temperature; ``constant`` replaces it if there was nothing to fit."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60,
                seed: int = 7) -> Network:
    """Adam on the log loss with L2; the temperature minimises the log loss of a held-back fifth."""
    if len(set(y.tolist())) < 2:
        return Network(*[np.zeros(1)] * 5, 0.0, 1.0, constant=float((y.sum() + 1) / (len(y) + 2)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, fit = order[:len(y) // 5], order[len(y) // 5:]
    shift, scale = x.mean(0), x.std(0) + 1e-4
    z = ((x - shift) / scale).astype(np.float64)
    weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden),
               rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        rate = 0.003 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 256)):
            step += 1
            h = np.tanh(z[part] @ weights[0] + weights[1])
            p = 1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -40, 40)))
            error = (p - y[part]) / max(len(part), 1)
            back_h = np.outer(error, weights[2]) * (1 - h * h)
            grads = [z[part].T @ back_h + 1e-4 * weights[0], back_h.sum(0),
                     h.T @ error + 1e-4 * weights[2], np.array([error.sum()])]
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - rate * (first[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    net = Network(shift, scale, weights[0], weights[1], weights[2], float(weights[3][0]), 1.0)
    logit, truth = net.logits(x[back]), y[back]

    def loss(t: float) -> float:
        s = np.where(truth > 0, 1, -1) * logit / t
        return float(np.mean(np.logaddexp(0, -s))) if len(s) else t
    best = min(np.geomspace(0.25, 8, 61), key=loss)
    return Network(shift, scale, weights[0], weights[1], weights[2], float(weights[3][0]), float(best))


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5; 0 is the held-out fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    network: Network

    def score(self, docs: DataFrame, threshold: float = 0.3) -> DataFrame:
        """``doc_id, text_hash, score, predicted`` for every row of ``docs``, and its other columns
        named in ``docs`` are not read."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = model.network.score(pool(batch.column(1), model.vectors))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(score, pa.float64()),
                     pa.array((score >= threshold).astype(np.int32))], ["doc_id", "text_hash", "score", "predicted"])

        return texts(docs, text_hash(docs).alias("text_hash")).mapInArrow(
            run, "doc_id bigint, text_hash bigint, score double, predicted int")


    def keep(self, docs: DataFrame, threshold: float = 0.3) -> DataFrame:
        """The rows of ``docs`` that score ``threshold`` at least, with all columns."""
        model = self
        return keep_rows(docs, lambda column: model.network.score(pool(column, model.vectors)) >= threshold)


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 16_000,
                train: Column | None = None) -> QualityModel:
    """Context vectors from all of ``docs``; the network from at most ``max_labelled`` texts with
    a row of ``labels`` (doc_id, quality) that satisfies ``train``."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    if train is not None:
        usable = usable.where(train)
    keyed = texts(docs, text_hash(docs).alias("text_hash"))
    found = keyed.select("doc_id", "text_hash").join(usable.distinct(), "doc_id").distinct()
    # at most max_labelled rows of three numbers, so the broadcast is bounded
    sample = F.broadcast(found.orderBy(F.xxhash64("doc_id", "text_hash"), "doc_id", "text_hash", "quality").limit(max_labelled))
    vectors = context_vectors(docs)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x.tobytes() for x in pool(batch.column(1), vectors)], pa.binary())],
                    ["quality", "x"])

    rows = (keyed.join(sample, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", "quality"]).select("quality", "text")
            .mapInArrow(features, "quality int, x binary").toPandas())
    x = np.array([np.frombuffer(b, np.float32) for b in rows["x"]], np.float32).reshape(-1, FEATURES)
    y = rows["quality"].to_numpy(np.float64)
    order = np.lexsort([*x.T[:4], y]) if len(y) else []  # task order does not change the fit
    return QualityModel(vectors, fit_network(x[order], y[order]))
