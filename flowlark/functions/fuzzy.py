"""Fuzzy hashes of payloads (context-triggered piecewise hashing, Kornblum 2006) and their likeness, 0 to 100.

A hash reads ``block size:signature:signature at twice the block size``.  Text is cut
where a rolling hash of seven bytes hits the block size; each piece gives one character.
Python works on Arrow batches only; what can be compared is found by joins on the
JVM side with ``grams``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

# Fixed values of the published hash.
WINDOW = 7
SMALLEST_BLOCK = 3
LONGEST_SIGNATURE = 64
PIECE_START = 0x28021967
PIECE_PRIME = 0x01000193
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

# A piece shows only the low six bits of its hash, and those depend on no higher bits.
_NEXT = [((state * PIECE_PRIME) ^ byte) & 63 for state in range(64) for byte in range(64)]
_TABLE = np.array(_NEXT, np.int64)


#: Bytes of text hashed at once, and pieces left from which on it is quicker to follow each alone.
BATCH_BYTES, FEW_PIECES = 1 << 20, 64


def _rolling(padded: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: plain, weighted and shifted sums of the last seven; ``padded`` begins with six zeros."""
    n = len(padded) - (WINDOW - 1)
    plain, weighted, shifted = (np.zeros(n, np.uint32) for _ in range(3))
    for age in range(WINDOW):
        byte = padded[WINDOW - 1 - age : len(padded) - age].astype(np.uint32)
        plain += byte
        weighted += byte * np.uint32(WINDOW - age)
        shifted ^= byte << np.uint32(5 * age)
    return plain + weighted + shifted


def _piece_states(low_bits: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The last state of each piece: step by step for all pieces that are long enough, the few longest alone."""
    order = np.argsort(start - end, kind="stable")
    start, size = start[order], (end - start)[order]
    states = np.full(len(start), PIECE_START & 63, np.int64)
    step, going = 0, int(np.count_nonzero(size > 0))
    while going > FEW_PIECES:
        states[:going] = _TABLE[states[:going] * 64 + low_bits[start[:going] + step]]
        step += 1
        going = int(np.searchsorted(-size, -step, "left"))
    for i in range(going):
        state = int(states[i])
        for byte in low_bits[start[i] + step : start[i] + size[i]].tobytes():
            state = _NEXT[state * 64 + byte]
        states[i] = state
    out = np.empty_like(states)
    out[order] = states
    return out


def hash_texts(texts: list[bytes]) -> list[str]:
    """The fuzzy hash of each payload; ``3::`` of an empty one."""
    if len(texts) > 1 and sum(map(len, texts)) > BATCH_BYTES:
        half = len(texts) // 2
        return hash_texts(texts[:half]) + hash_texts(texts[half:])
    # Six zeros before each text are what its rolling hash begins with.
    gap = bytes(WINDOW - 1)
    padded = np.frombuffer(gap + gap.join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size + WINDOW - 1) - size - (WINDOW - 1)
    rolling, low = _rolling(padded), padded[WINDOW - 1 :] & 63
    block = np.full(len(texts), SMALLEST_BLOCK, np.int64)
    while (small := block * LONGEST_SIGNATURE < size).any():
        block[small] *= 2
    starts, ends, of = [], [], []
    for i, n in enumerate(size.tolist()):
        roll = rolling[first[i] : first[i] + n]
        while block[i] > SMALLEST_BLOCK and np.count_nonzero(roll % np.uint32(block[i]) == block[i] - 1) < LONGEST_SIGNATURE // 2:
            block[i] //= 2
        for times, longest in ((1, LONGEST_SIGNATURE), (2, LONGEST_SIGNATURE // 2)):
            cuts = np.flatnonzero(roll % np.uint32(block[i] * times) == block[i] * times - 1) + 1
            stops = cuts[: longest - 1]
            if n and roll[-1]:
                stops = np.append(stops, n)
            elif len(cuts) >= longest:
                stops = np.append(stops, cuts[-1])
            starts.append(first[i] + np.append(0, stops[:-1])[: len(stops)])
            ends.append(first[i] + stops)
            of.append(len(stops))
    states = _piece_states(low, np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64)) if starts else np.zeros(0, int)
    letters = np.frombuffer(ALPHABET.encode(), np.uint8)[states].tobytes().decode()
    edge = np.append(0, np.cumsum(of)).tolist()
    return [f"{block[i]}:{letters[edge[2 * i] : edge[2 * i + 1]]}:{letters[edge[2 * i + 1] : edge[2 * i + 2]]}" for i in range(len(texts))]


def hash_bytes(data: bytes) -> str:
    """The fuzzy hash of one payload."""
    return hash_texts([data])[0]


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of a machine word."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _likeness(a: str, b: str, block: int) -> int:
    if len(a) < WINDOW or len(b) < WINDOW:
        return 0
    if not {a[i : i + WINDOW] for i in range(len(a) - WINDOW + 1)} & {b[i : i + WINDOW] for i in range(len(b) - WINDOW + 1)}:
        return 0
    edits = len(a) + len(b) - 2 * _common(a, b)
    score = 100 - 100 * (edits * LONGEST_SIGNATURE // (len(a) + len(b))) // LONGEST_SIGNATURE
    if block >= (99 + WINDOW) // WINDOW * SMALLEST_BLOCK:
        return score
    return min(score, block // SMALLEST_BLOCK * min(len(a), len(b)))


def _parts(value: str) -> tuple[int, str, str]:
    block, first, second = value.split(":", 2)
    return int(block), re.sub(r"(.)\1{3,}", r"\1\1\1", first), re.sub(r"(.)\1{3,}", r"\1\1\1", second)


def compare_hashes(a: str, b: str) -> int:
    """0 to 100; 0 unless block sizes are equal or one is twice the other and seven characters agree."""
    (p, a1, a2), (q, b1, b2) = _parts(a), _parts(b)
    if p == q:
        return 100 if (a1, a2) == (b1, b2) else max(_likeness(a1, b1, p), _likeness(a2, b2, 2 * p))
    if p == 2 * q:
        return _likeness(a1, b2, p)
    return _likeness(a2, b1, q) if q == 2 * p else 0


_LETTER = np.full(256, 255, np.uint8)
_LETTER[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(64)
#: Pairs of signatures compared at once.
PAIRS = 2048


def _likenesses(a: list[str], b: list[str], block: np.ndarray) -> np.ndarray:
    """``_likeness`` of many pairs of signatures of the published alphabet, side by side."""
    size = [np.array([len(x) for x in side]) for side in (a, b)]
    letters = []
    for side in (a, b):
        text = np.frombuffer("".join(x.ljust(LONGEST_SIGNATURE, "=") for x in side).encode(), np.uint8)
        letters.append(_LETTER[text].reshape(-1, LONGEST_SIGNATURE))
    many = LONGEST_SIGNATURE - WINDOW + 1
    grams = [sum(side[:, i : i + many].astype(np.int64) << 6 * i for i in range(WINDOW)) for side in letters]
    for side, n, sign in zip(grams, size, (-1, -2), strict=True):
        side[np.arange(many) > n[:, None] - WINDOW] = sign  # no gram begins here, and none equals the other side's
    shared = (grams[0][:, :, None] == grams[1][:, None, :]).any((1, 2))
    # Where each letter stands in the first signature, as bits; then the second one letter by letter.
    places = np.zeros((len(a), 256), np.uint64)
    for i in range(LONGEST_SIGNATURE):
        places[np.arange(len(a)), letters[0][:, i]] |= np.uint64(1 << i)
    row = np.full(len(a), ~np.uint64(0))
    for j in range(LONGEST_SIGNATURE):
        hit = row & places[np.arange(len(a)), letters[1][:, j]]
        row = np.where(j < size[1], (row + hit) | (row - hit), row)
    known = np.where(size[0] < 64, (np.uint64(1) << np.minimum(size[0], 63).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
    common = np.bitwise_count(~row & known).astype(np.int64)
    total = size[0] + size[1]
    score = 100 - 100 * ((total - 2 * common) * LONGEST_SIGNATURE // np.maximum(total, 1)) // LONGEST_SIGNATURE
    capped = np.minimum(score, block // SMALLEST_BLOCK * np.minimum(*size))
    return np.where(shared, np.where(block >= (99 + WINDOW) // WINDOW * SMALLEST_BLOCK, score, capped), 0)


def compare_many(a: list[str], b: list[str]) -> list[int]:
    """``compare_hashes`` of many pairs."""
    parts: dict[str, tuple[int, str, str]] = {}
    out, pairs = [0] * len(a), []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        for value in (x, y):
            if value not in parts:
                parts[value] = _parts(value)
        (p, a1, a2), (q, b1, b2) = parts[x], parts[y]
        if p == q and (a1, a2) == (b1, b2):
            out[i] = 100
            continue
        for one, other, block in [(a1, b1, p), (a2, b2, 2 * p)] if p == q else [(a1, b2, p)] if p == 2 * q else [(a2, b1, q)] if q == 2 * p else []:
            if min(len(one), len(other)) >= WINDOW:
                if max(len(one), len(other)) <= LONGEST_SIGNATURE and set(one) | set(other) <= _KNOWN:
                    pairs.append((i, one, other, block))
                else:  # not from this hash: one by one
                    out[i] = max(out[i], _likeness(one, other, block))
    for k in range(0, len(pairs), PAIRS):
        at, one, other, block = zip(*pairs[k : k + PAIRS], strict=True)
        for i, score in zip(at, _likenesses(list(one), list(other), np.array(block, np.int64)).tolist(), strict=True):
            out[i] = max(out[i], score)
    return out


_KNOWN = frozenset(ALPHABET)


@F.pandas_udf(StringType())
def fuzzy_hash(payload: pd.Series) -> pd.Series:
    """Fuzzy hash of a text's UTF-8 bytes; null for null."""
    known = payload.notna()
    out = pd.Series([None] * len(payload), dtype=object)
    out[known.to_numpy()] = hash_texts([text.encode("utf-8", "surrogatepass") for text in payload[known]])
    return out


@F.pandas_udf(IntegerType())
def fuzzy_compare(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two fuzzy hashes; null if either is null."""
    known = (a.notna() & b.notna()).to_numpy()
    score = np.zeros(len(a), np.int32)
    score[known] = compare_many(a[known].tolist(), b[known].tolist())
    return pd.Series(pd.arrays.IntegerArray(score, ~known))


def block_size(value: Column) -> Column:
    """The block size of a fuzzy hash."""
    return F.split(value, ":")[0].cast("long")


def _without_long_runs(signature: Column) -> Column:
    return F.regexp_replace(signature, r"(.)\1{3,}", "$1$1$1")


def shortened(value: Column) -> Column:
    """A fuzzy hash with long runs of one character cut to three, as hashes are compared."""
    parts = F.split(value, ":", 3)
    return F.concat_ws(":", parts[0], _without_long_runs(parts[1]), _without_long_runs(parts[2]))


def grams(value: Column) -> Column:
    """What two hashes must share to score more than 0 unless equal: ``block size:seven characters`` of either signature."""
    parts = F.split(value, ":")

    def of(signature: Column, block: Column) -> Column:
        def cut(text: Column) -> Column:
            places = F.when(F.length(text) >= WINDOW, F.sequence(F.lit(1), F.length(text) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda i: F.substr(text, i, F.lit(WINDOW)))

        # Inside the outer transform the shortened signature is a bound value, worked out once and not for each place.
        shortened = F.array(F.struct(block.cast("string").alias("block"), _without_long_runs(signature).alias("text")))
        return F.flatten(F.transform(shortened, lambda s: F.transform(cut(s["text"]), lambda gram: F.concat_ws(":", s["block"], gram))))

    return F.array_distinct(F.concat(of(parts[1], block_size(value)), of(parts[2], 2 * block_size(value))))


def register(spark: SparkSession) -> None:
    """``fuzzy_hash`` and ``fuzzy_compare`` for use in SQL; ``ip_to_long`` as a function of Spark's own SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ip_to_long(ip STRING) RETURNS BIGINT RETURN aggregate(split(ip, '[.]'), 0L, (a, x) -> a * 256L + CAST(x AS BIGINT))")
    spark.udf.register("fuzzy_hash", fuzzy_hash)
    spark.udf.register("fuzzy_compare", fuzzy_compare)
