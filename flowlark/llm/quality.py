"""Quality scores: random-indexing word vectors, pooled, under a two-layer network."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .labelled import fold, sample, training_texts
from .scratch import small_batches

#: Hashed words and the length of their context vectors: a table of fixed size (4 MB).
WORD_BITS, DIMENSIONS = 15, 32
#: Neighbours on either side that make a word's context.
REACH = 2
HIDDEN = 24
#: At most so many labelled documents are learnt from; a fifth of them sets the temperature.
TRAINING_ROWS = 8000
STEPS = 2000
_SEGMENT = 1 << 10


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each token, first index of each text's): words and runs of other marks alike."""
    t = tk.tokens(data, offs)
    return (tk.range_hashes(t.data, t.start, t.end) >> np.uint64(64 - WORD_BITS)).astype(np.int64), t.first


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Each slot's random index vector: one dimension counts up, another down."""
    h = tk.mix64(np.arange(1 << WORD_BITS, dtype=np.uint64) + np.uint64(12345))
    up = (h % np.uint64(DIMENSIONS)).astype(np.int64)
    return up, (up + 1 + (h >> np.uint64(32)).astype(np.int64) % (DIMENSIONS - 1)) % DIMENSIONS


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the neighbours' index vectors for each slot, over a task's texts."""
    up, down = _index_vectors()
    total = np.zeros((1 << WORD_BITS) * DIMENSIONS, np.int64)
    for batch in batches:
        data, offs = tk.text_buffer(batch.column("text"))
        for a, b in tk.chunks(offs):
            word, first = _words(data, offs[a : b + 1])
            text = np.repeat(np.arange(b - a), np.diff(first))
            for step in range(1, REACH + 1):
                near = np.flatnonzero(text[step:] == text[:-step])
                one, two = word[near], word[near + step]
                for x, y in ((one, two), (two, one)):
                    total += np.bincount(x * DIMENSIONS + up[y], minlength=len(total))
                    total -= np.bincount(x * DIMENSIONS + down[y], minlength=len(total))
    parts = total.reshape(-1, _SEGMENT * DIMENSIONS)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["segment", "sums"])


def _add(parts: pa.Table) -> pa.Table:
    total = np.zeros(_SEGMENT * DIMENSIONS, np.int64)
    for x in parts["sums"]:
        total += np.frombuffer(zlib.decompress(x.as_buffer()), np.int64)
    return pa.table({"segment": parts["segment"][:1], "sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all slots, from the contexts of every word of every text.

    Counts are damped by a signed logarithm; a slot that never occurs has a zero vector.
    """
    schema = "segment int, sums binary"
    parts = docs.select("text").mapInArrow(_contexts, schema).groupBy("segment").applyInArrow(_add, schema)
    total = np.zeros((1 << WORD_BITS, DIMENSIONS))
    for r in parts.collect():  # a fixed number of parts of a fixed size
        total[r.segment * _SEGMENT : (r.segment + 1) * _SEGMENT] = np.frombuffer(zlib.decompress(r.sums), np.int64).reshape(-1, DIMENSIONS)
    total = np.sign(total) * np.log1p(np.abs(total))
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _pool(table: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each text's mean of its tokens' rows of ``table``; zeros where there are none."""
    out = np.zeros((len(first) - 1, table.shape[1]))
    some = np.diff(first) > 0
    if some.any():
        out[some] = np.add.reduceat(table[word], first[:-1][some], axis=0) / np.diff(first)[some, None]
    return out


class Network:
    """Two layers, tanh between them, trained by Adam; a temperature calibrates the result."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.temperature = 1.0
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(DIMENSIONS), np.ones(DIMENSIONS))
        if not len(y) or len(set(y.tolist())) < 2:
            rate = (y.mean() if len(y) else 0.5) * 0.998 + 0.001
            self.w1, self.b1, self.w2 = np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN)
            self.b2 = np.array([np.log(rate / (1 - rate))])
            return
        held = rng.permutation(len(y)) < len(y) // 5
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held = np.zeros(len(y), bool)
        z = (x - self.mean) / self.scale
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        params = [self.w1, self.b1, self.w2, self.b2]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        tx, ty = z[~held], y[~held]
        for step in range(1, STEPS + 1):
            pick = rng.integers(0, len(ty), min(512, len(ty)))
            h = np.tanh(tx[pick] @ self.w1 + self.b1)
            error = (1 / (1 + np.exp(-(h @ self.w2 + self.b2))) - ty[pick]) / len(pick)
            back = error[:, None] * self.w2 * (1 - h * h)
            grads = [tx[pick].T @ back + 1e-4 * self.w1, back.sum(0), h.T @ error + 1e-4 * self.w2, np.array([error.sum()])]
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        if held.any():  # the temperature with the least log loss on rows the weights haven't seen
            logit, ty = self.logits(x[held]), y[held]
            grid = np.exp(np.linspace(-1.5, 2.5, 60))
            loss = [np.mean(np.logaddexp(0, np.where(ty == 1, -1, 1) * logit / t)) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2) / self.temperature


def _pooled(table) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tk.text_buffer(batch.column("text"))
            x = [_pool(table.value, *_words(data, offs[a : b + 1])) for a, b in tk.chunks(offs)]
            x = np.concatenate(x) if x else np.zeros((0, DIMENSIONS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    return run


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, threshold: float = 0.7, rows: int = TRAINING_ROWS, columns: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every text, before them any other ``columns`` of ``docs``.

    Word vectors come from all texts; the network learns from at most ``rows`` labelled
    documents whose fold isn't ``held_out`` (ids choose rows and are no input of a
    score).  Null and empty texts are scored as a pooled vector of zeros.  Without
    labels, or with one class alone, all score the base rate.  Columns of ``docs``
    named like a new one are replaced; rows without a doc_id are scored, ``held_out``
    is then null.  Repeated rows are scored alike; of several texts of one labelled doc_id the last in order is
    learnt from.  Texts of any length are read whole, in chunks.
    """
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    vectors = word_vectors(docs)
    table = context.broadcast(vectors)
    chosen = sample(labels, label, fold("doc_id", folds) != held_out, rows)
    learnt = training_texts(docs, chosen).mapInArrow(_pooled(table), "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id")  # bounded by rows
    x = np.stack(learnt["x"].to_list()) if len(learnt) else np.zeros((0, DIMENSIONS))
    net = Network(x, learnt["label"].to_numpy())
    # The first layer is linear in the words, so its sums are pooled: no more than HIDDEN numbers a word.
    first_layer = (vectors / net.scale) @ net.w1
    model = context.broadcast((first_layer.astype(np.float32), net.b1 - (net.mean / net.scale) @ net.w1, net.w2, float(net.b2[0]), net.temperature))
    columns = [c for c in columns or [] if c not in ("doc_id", "held_out", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projected, b1, w2, b2, temperature = model.value
        for batch in batches:
            data, offs = tk.text_buffer(batch.column("text"))
            logit = [(np.tanh(_pool(projected, *_words(data, offs[a : b + 1])) + b1) @ w2 + b2) / temperature for a, b in tk.chunks(offs)]
            value = 1 / (1 + np.exp(-np.clip(np.concatenate(logit) if logit else np.zeros(0), -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), batch.column("doc_id"), pa.array(value)], names=[*columns, "doc_id", "score"])

    base = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select(*dict.fromkeys([*columns, "doc_id", "text"]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in columns] + ["doc_id long, score double"])
    scored = base.mapInArrow(run, schema)
    return scored.select(*columns, "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
