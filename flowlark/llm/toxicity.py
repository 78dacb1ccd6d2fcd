"""Toxicity scores from subword-bag embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .labelled import fold, sample, training_texts
from .scratch import saved, small_batches

#: Character n-grams of a word and its two edges, hashed into slots of a table of vectors.
SUBWORDS, SLOT_BITS, DIMENSIONS = (3, 4, 5), 18, 8
#: Words averaged into a text's bag: its most toxic ones.
BAG_WORDS = 3
#: So many labelled documents are learnt from at most, and so many distinct words of each: bounds what comes to the driver.
TRAINING_ROWS, TRAINING_WORDS = 3000, 1 << 14
EPOCHS, WHOLE_TEXT_EPOCHS, MIN_WORDS, DECAY = 50, 8, 4, 0.965
#: A Python worker forgets its scored words beyond so many.
CACHE_WORDS = 1 << 19


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, first index of each word's): the n-grams of ``<word>`` and the word itself."""
    size = end - start
    edged = size + 2
    first = np.append(0, np.cumsum(edged))
    buf = np.full(int(first[-1]), ord("<"), np.uint8)
    buf[first[1:] - 1] = ord(">")
    buf[tk.ragged(first[:-1] + 1, size)] = data[tk.ragged(start, size)]
    from_, to, word = [first[:-1]], [first[1:]], [np.arange(len(size))]
    for n in SUBWORDS:
        many = np.maximum(edged - n + 1, 0)
        many[edged == n] = 0  # that is the word itself
        at = tk.ragged(first[:-1], many)
        from_.append(at)
        to.append(at + n)
        word.append(np.repeat(np.arange(len(size)), many))
    word = np.concatenate(word)
    order = np.argsort(word, kind="stable")
    slot = (tk.range_hashes(buf, np.concatenate(from_), np.concatenate(to)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return slot[order], np.searchsorted(word[order], np.arange(len(size) + 1))


def _segment_mean(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Means of consecutive parts, none of them empty."""
    return np.add.reduceat(values, first[:-1], axis=0) / np.diff(first).reshape(-1, *[1] * (values.ndim - 1))


def _bags(value: np.ndarray, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, edge): the words of each text's bag, its BAG_WORDS words of the largest value, each once; ``word`` tells them apart.

    A text with fewer words has them all, one without words an empty bag.
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((word, -value, text))
    # Equal words have equal values, so they stand together.
    new = np.append(True, (np.diff(text[order]) != 0) | (word[order][1:] != word[order][:-1])) if len(order) else np.zeros(0, bool)
    order = order[new]
    place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
    order = order[place < BAG_WORDS]
    return order, np.searchsorted(text[order], np.arange(len(first)))


def _tokens(texts: pa.Array, most: int) -> tuple[tk.Tokens, np.ndarray, np.ndarray, np.ndarray] | None:
    """(tokens, each one's hash, words to learn from, where each text's begin): a text's distinct words, of more than ``most`` those of the least hashes."""
    if not len(texts):
        return None
    t = tk.tokens(*tk.text_buffer(texts), lower=True, marks=False)
    value = tk.range_hashes(t.data, t.start, t.end)
    text = np.repeat(np.arange(len(texts)), np.diff(t.first))
    order = np.lexsort((value, text))
    new = np.append(True, (np.diff(text[order]) != 0) | (value[order][1:] != value[order][:-1])) if len(order) else np.zeros(0, bool)
    order = order[new]
    order = order[np.arange(len(order)) - np.searchsorted(text[order], text[order]) < most]
    return t, value, order, np.searchsorted(text[order], np.arange(len(texts) + 1))


def _words(most: int):
    """The hashes of each text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, out = _tokens(batch.column("text"), most), []
            if found:
                _, value, order, edge = found
                out = [value[order[x:y]].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())], names=["doc_id", "label", "words"])

    return run


def _vocabulary(most: int):
    """A batch's distinct words: hash and slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _tokens(batch.column("text"), most)
            if found is None or not len(found[2]):
                continue
            t, value, order, _ = found
            value, at = np.unique(value[order], return_index=True)
            slot, edge = subwords(t.data, t.start[order[at]], t.end[order[at]])
            slots = [slot[x:y].astype(np.int32).tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(slots, pa.binary())], names=["word", "slots"])

    return run


def train(words: list[np.ndarray], known: np.ndarray, slots: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """(a weight for each slot, bias): the vectors times the softmax weights, which is all that scoring needs.

    ``words`` are the hashes of each text's words, ``slots`` those of the ``known`` words.
    Vectors and softmax are trained jointly, by gradient descent on all rows at once.  The first
    rounds average all words of a text; the later ones its most toxic words.
    """
    rng = np.random.default_rng(seed)
    if not len(known) or len(set(labels.tolist())) < 2:
        rate = float(np.mean(labels)) if len(labels) else 0.5
        return np.zeros(1 << SLOT_BITS), float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    order = np.argsort(known)
    many = np.array([len(slots[i]) for i in order], np.float32)
    slot = np.concatenate([slots[i] for i in order])
    word = np.searchsorted(known[order], np.concatenate(words)).astype(np.int32)
    text_first = np.append(0, np.cumsum([len(w) for w in words]))
    of_slot = np.repeat(np.arange(len(many), dtype=np.int32), many.astype(np.int64))
    # Slots of fewer than MIN_WORDS words keep a zero vector: nothing can be learnt about them.
    often = np.bincount(word, minlength=len(many)).astype(np.float32)
    seen = np.zeros(1 << SLOT_BITS)
    for i in range(0, len(slot), 1 << 20):
        seen += np.bincount(slot[i : i + (1 << 20)], often[of_slot[i : i + (1 << 20)]], 1 << SLOT_BITS)
    seen = seen >= MIN_WORDS
    of_slot, slot = of_slot[seen[slot]], slot[seen[slot]]
    used = np.flatnonzero(seen)
    slot = (np.cumsum(seen) - 1).astype(np.int32)[slot]
    edge = np.searchsorted(of_slot, np.arange(len(many) + 1))
    filled = np.diff(edge) > 0
    vectors = rng.normal(0, 0.01, (len(used), DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2)
    y = labels.astype(int)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    has = np.diff(text_first) > 0
    speed = [np.zeros_like(vectors), np.zeros_like(softmax), np.zeros_like(bias)]
    for epoch in range(EPOCHS):
        # With two classes the gradient of a vector is a number times the difference of the class weights.
        towards = softmax[:, 1] - softmax[:, 0]
        value = np.zeros(len(many))
        value[filled] = np.add.reduceat((vectors @ towards)[slot], edge[:-1][filled]) / many[filled]
        whole = epoch < WHOLE_TEXT_EPOCHS
        if whole:
            members, parts = word, np.append(0, np.cumsum(np.diff(text_first)[has]))
        else:
            at, edges = _bags(value[word], word, text_first)
            members, parts = word[at], np.append(0, np.cumsum(np.diff(edges)[has]))
        size = np.diff(parts)
        logit = np.full(len(y), bias[1] - bias[0])
        logit[has] += _segment_mean(value[members], parts)
        error = (1 / (1 + np.exp(-logit)) - y) * balance / len(y)
        to_word = np.bincount(members, np.repeat(error[has] / size, size), len(many)) / many
        to_slot = np.bincount(slot, to_word[of_slot], len(used))[:, None] * towards
        steps = [(vectors, speed[0], to_slot, 1.0), (bias, speed[2], np.array([-error.sum(), error.sum()]), 0.2)]
        if not whole:
            near, back = np.unique(members, return_inverse=True)
            at = tk.ragged(edge[near], np.diff(edge)[near])
            of = np.repeat(np.arange(len(near)), np.diff(edge)[near])
            near_vector = np.stack([np.bincount(of, vectors[slot[at], k], len(near)) for k in range(DIMENSIONS)], 1) / many[near, None]
            pooled = _segment_mean(near_vector[back], parts)
            pull = pooled.T @ error[has]
            steps.append((softmax, speed[1], np.stack([-pull, pull], 1), 0.02))
        # Steps are in proportion to the gradient, so that chance words of a few texts learn little.
        for x, v, g, rate in steps:
            v *= 0.8
            v -= g * (rate / (np.abs(g).max() + 1e-12)) * DECAY**epoch
            x += v
    weight = np.zeros(1 << SLOT_BITS)
    weight[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return weight, float(bias[1] - bias[0])


class _Scorer:
    """Scores of words are kept, as most words of a text have been met before."""

    def __init__(self, weight: np.ndarray):
        self.weight = weight
        self.forget()

    def forget(self) -> None:
        self.index, self.value = tk.HashIndex(), np.zeros(1 << 16)

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.index.count > CACHE_WORDS:
            self.forget()
        t = tk.tokens(data, offs, lower=True, marks=False)
        key = tk.range_hashes(t.data, t.start, t.end) | np.uint64(1)
        at = self.index.find(key)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = np.unique(key[missing], return_index=True)
            first = missing[first]
            slot, edge = subwords(t.data, t.start[first], t.end[first])
            n = self.index.count
            while n + len(new) > len(self.value):
                self.value = np.append(self.value, np.zeros_like(self.value))
            self.value[n : n + len(new)] = _segment_mean(self.weight[slot], edge)
            self.index.add(new)
            at[missing] = self.index.find(key[missing])
        members, edge = _bags(self.value[at], at, t.first)
        out = np.zeros(len(edge) - 1)
        some = np.diff(edge) > 0
        if some.any():
            out[some] = _segment_mean(self.value[at[members]], np.append(edge[:-1][some], edge[-1]))
        return out


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, threshold: float = 0.5, rows: int = TRAINING_ROWS, most: int = TRAINING_WORDS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every text.

    A bag of words is the mean of its words' vectors, a word's vector the mean of
    its character n-grams' vectors, so misspellings never met before are close to
    what they stand for; a text's bag are the few words of it that are most toxic, wherever they stand, and a linear softmax on the
    bag gives the score.  Learns from at most ``rows`` labelled documents, whatever their length,
    whose fold isn't ``held_out`` (ids choose rows and are no input of a score); executors turn them into
    hashes and slots of their distinct words, at most ``most`` of a document, chosen by hash.  Of several texts of one labelled doc_id the last in order is learnt from.

    Null and empty texts have the score of an empty bag.  Without labels, or with
    one class alone, all score the base rate.  Other columns are ignored, repeated
    rows scored alike; rows without a doc_id are scored, ``held_out`` is then null.
    """
    small_batches(docs.sparkSession)
    chosen = sample(labels, label, fold("doc_id", folds) != held_out, rows)
    learnt = saved(training_texts(docs, chosen), "labelled")
    # Both are bounded by rows and words.
    texts = learnt.mapInArrow(_words(most), "doc_id long, label int, words binary").toPandas().sort_values("doc_id")
    known = learnt.mapInArrow(_vocabulary(most), "word long, slots binary").dropDuplicates(["word"]).toPandas()
    weight, bias = train([np.frombuffer(x, np.int64) for x in texts["words"]], known["word"].to_numpy(np.int64), [np.frombuffer(x, np.int32) for x in known["slots"]], texts["label"].to_numpy())
    model = docs.sparkSession.sparkContext.broadcast((weight.astype(np.float32), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = model.value
        scorer = _Scorer(weight.astype(float))
        for batch in batches:
            data, offs = tk.text_buffer(batch.column("text"))
            logits = [scorer.logits(data, offs[a : b + 1]) for a, b in tk.chunks(offs)]
            value = 1 / (1 + np.exp(-np.clip((np.concatenate(logits) if logits else np.zeros(0)) + bias, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
