"""Numpy kernels shared by the text operators of this subpackage.

Everything here works on one Arrow batch inside a Spark task.  Texts are taken
as UTF-8 bytes; words are maximal runs of bytes other than space and
``\\x09-\\x0D`` (all separators are ASCII, so byte and character words agree).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: bounds a task's memory (about 40 bytes each).
CHUNK_BYTES = 1 << 19

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: The first 0 to 8 bytes of a block of eight.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes hashed at one level; longer ranges are hashed as the hashes of pieces of this size.
_PIECE = 64


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on between tasks and share an executor's limit."""
    with contextlib.suppress(OSError, AttributeError):  # there is no such call on some systems
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), so that all bits of a sum matter."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ordered pair; not linear in either, so no sum or power of values hides a difference."""
    return mix64(mix64(a + np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xD6E8FEB86659FD93)))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offs


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each; a longer text is a range of its own."""
    first, n = 0, len(offs) - 1
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words(NamedTuple):
    """The words of a range of texts, in order."""

    data: np.ndarray  # bytes of the range
    start: np.ndarray  # byte positions in data
    end: np.ndarray
    first: np.ndarray  # for each text, the index of its first word; one more at the end
    hash: np.ndarray  # 64 bits


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> Words:
    """Words and their hashes for the texts ``data[offs[i]:offs[i + 1]]``."""
    data, offs = data[offs[0] : offs[-1]], offs - offs[0]
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SEP[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = inside[cut + 1]
    ends[cut - 1] = inside[cut]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offs), range_hashes(data, start, end))


def _blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte ranges ``data[start[i]:end[i]]``.

    Blocks of eight bytes are mixed in one after the other; a range of more than 64 bytes is
    the hash of the hashes of its pieces.
    """
    start, size = np.asarray(start, np.int64), np.asarray(end, np.int64) - start
    total = mix64(size.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    long = np.flatnonzero(size > _PIECE)
    if len(long):
        many = -(-size[long] // _PIECE)
        first = np.cumsum(many) - many
        begin = start[long].repeat(many) + ragged(np.zeros(len(long), np.int64), many) * _PIECE
        piece = range_hashes(data, begin, np.minimum(begin + _PIECE, (start + size)[long].repeat(many)))
        total[long] = pair_hashes(total[long], range_hashes(piece.view(np.uint8), 8 * first, 8 * (first + many)))
    block, at = _blocks(data), np.flatnonzero((size > 0) & (size <= _PIECE))
    done = 0
    while len(at):
        total[at] = pair_hashes(total[at], block[start[at] + done] & _FIRST_BYTES[np.minimum(size[at] - done, 8)])
        done += 8
        at = at[size[at] > done]
    return total


def equal_ranges(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``a[a_start[i]:][:size[i]]`` and ``b[b_start[i]:][:size[i]]`` are the same bytes."""
    out = np.ones(len(size), bool)
    long = np.flatnonzero(size > _PIECE)
    if len(long):
        many = -(-size[long] // _PIECE)
        step = ragged(np.zeros(len(long), np.int64), many) * _PIECE
        same = equal_ranges(a, a_start[long].repeat(many) + step, b, b_start[long].repeat(many) + step, np.minimum(_PIECE, size[long].repeat(many) - step))
        out[long] = np.logical_and.reduceat(same, np.cumsum(many) - many)
    x = _blocks(a)
    y, at, done = x if a is b else _blocks(b), np.flatnonzero((size > 0) & (size <= _PIECE)), 0
    while len(at):
        unequal = ((x[a_start[at] + done] ^ y[b_start[at] + done]) & _FIRST_BYTES[np.minimum(size[at] - done, 8)]) != 0
        out[at[unequal]] = False
        done += 8
        at = at[~unequal & (size[at] > done)]
    return out


def ngram_hashes(value: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` values, from those of shorter runs; as many as there are runs."""
    if len(value) < n:
        return np.zeros(0, np.uint64)
    out, done, level, width = None, 0, value, 1
    while True:
        if n & width:
            many = len(value) - done - width + 1
            out = level if out is None else pair_hashes(out[:many], level[done : done + many])
            done += width
        if done == n:
            return out[: len(value) - n + 1]
        level = pair_hashes(level[:-width], level[width:])
        width *= 2


def sliding_min(value: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each ``n`` consecutive values."""
    done = 1
    while done < n:
        step = min(done, n - done)
        value = np.minimum(value[: len(value) - step], value[step:])
        done += step
    return value


def runs(value: np.ndarray) -> np.ndarray:
    """Index of the first of each run of equal values, and the length at the end."""
    return np.append(np.flatnonzero(np.append(True, value[1:] != value[:-1])), len(value)) if len(value) else np.zeros(1, np.int64)


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices ``first[i] .. first[i] + count[i] - 1`` for all i in order."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count)
    return at + np.arange(total)


#: 0: white space, 1: part of a word (letters, digits and all beyond ASCII), 2: other characters.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[[*range(0x00, 0x21), 0x7F]] = 0


class Tokens(NamedTuple):
    """Runs of word characters, and of other visible characters, of a range of texts."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # for each text, the index of its first token; one more at the end
    is_word: np.ndarray


def tokens(data: np.ndarray, offs: np.ndarray, lower: bool = False, marks: bool = True) -> Tokens:
    """Tokens of the texts ``data[offs[i]:offs[i + 1]]``; without ``marks``, words alone."""
    data, offs = data[offs[0] : offs[-1]], offs - offs[0]
    if lower:
        data = _LOWER[data]
    kind = _KIND[data]
    change = np.append(True, kind[1:] != kind[:-1]) if len(kind) else np.zeros(0, bool)
    change[offs[:-1][np.diff(offs) > 0]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(data)) if len(start) else start
    of = kind[start]
    keep = of > 0 if marks else of == 1
    start, end = start[keep], end[keep]
    return Tokens(data, start, end, np.searchsorted(start, offs), of[keep] == 1)


class HashIndex:
    """Numbers for 64-bit keys (not 0), in an open-addressing table."""

    def __init__(self, bits: int = 17):
        self.key, self.at, self.count = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(65 - len(self.key).bit_length())).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where it is new."""
        slot = self._slot(key)
        have = self.key[slot]
        out = np.where(have == key, self.at[slot], -1).astype(np.int32)
        todo = np.flatnonzero((have != key) & (have != 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.key) - 1)
            have = self.key[slot]
            hit = have == key[todo]
            out[todo[hit]] = self.at[slot[hit]]
            go_on = ~hit & (have != 0)
            todo, slot = todo[go_on], slot[go_on]
        return out

    def _insert(self, key: np.ndarray, number: np.ndarray) -> None:
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            at = slot[todo]
            free = self.key[at] == 0
            self.key[at[free]] = key[todo[free]]  # of those that meet in a slot, one stays
            done = self.key[at] == key[todo]
            self.at[at[done]] = number[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)

    def add(self, key: np.ndarray) -> None:
        """New, distinct keys get the next numbers."""
        n, more = self.count, len(key)
        self.count += more
        if 2 * self.count > len(self.key):
            filled = self.key != 0
            old = self.key[filled], self.at[filled]
            room = len(self.key)
            while 2 * self.count > room:
                room *= 2
            self.key, self.at = np.zeros(room, np.uint64), np.zeros(room, np.int32)
            self._insert(*old)
        self._insert(key, np.arange(n, n + more, dtype=np.int32))
