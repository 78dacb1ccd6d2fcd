"""Byte-level BPE encoding and decoding of whole texts."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import small_batches

#: A piece of more bytes is a matrix of one row, in which all pairs of the least rank merge in one round.
LONG_PIECE = 256
#: A Python worker forgets its caches of encoded pieces and units beyond so many.
CACHE_PIECES, CACHE_UNITS = 1 << 17, 1 << 19
#: Bytes of text encoded at once.
ENCODE_BYTES = 2 << 20


#: The matrix width for each length.
_WIDTHS = [next(w for w in (3, 5, 7, 9, 12, 16, 24, 32, 64, 128, LONG_PIECE) if w >= n) for n in range(LONG_PIECE + 1)]


def _pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (((left.astype(np.int64) & 0xFFFFFF) << 24 | (right.astype(np.int64) & 0xFFFFFF)) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Token bytes by id, and the rank and result of each mergeable pair.

    ``source`` is the content of a rank file (base64 token and rank on each line)
    or of a JSON tokenizer file whose model is a byte-level BPE.
    """

    def __init__(self, source: bytes):
        if source.lstrip()[:1] == b"{":
            self._from_json(json.loads(source))
        else:
            self._from_ranks(source)
        size = max(self.tokens) + 1
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)])
        self.flat = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self.first = np.append(0, np.cumsum(lengths))
        self._hash()

    def _from_ranks(self, source: bytes) -> None:
        self.ids = {base64.b64decode(t): int(r) for t, r in map(bytes.split, source.splitlines())}
        self.tokens = {i: t for t, i in self.ids.items()}
        left, right, rank = [], [], []
        for token, r in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.pairs = np.array([left, right, rank], np.int64)
        self.merged = np.arange(max(self.tokens) + 1)
        self.whole = self.ids
        self.added: dict[bytes, int] = {}  # such a file has none

    def _from_json(self, source: dict) -> None:
        # The byte alphabet of byte-level models: printable characters stand for
        # themselves, the other bytes for 256, 257 and so on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = {t: i for t, i in source["model"]["vocab"].items()}
        as_bytes = lambda t: bytes(byte_of[c] for c in t)
        self.ids = {as_bytes(t): i for t, i in vocab.items() if all(c in byte_of for c in t)}
        self.tokens = {i: t for t, i in self.ids.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in source["model"]["merges"]]
        self.pairs = np.array([[vocab[a], vocab[b], r] for r, (a, b) in enumerate(merges)], np.int64).T
        self.merged = np.array([vocab[a + b] for a, b in merges])
        self.whole = {}  # this library always merges
        self.added = {t["content"].encode(): t["id"] for t in source.get("added_tokens", [])}

    def _hash(self) -> None:
        left, right, rank = self.pairs
        key, first = np.unique(_pair_key(left, right), return_index=True)
        self._index, self._ranks = tk.HashIndex(int(np.ceil(np.log2(4 * len(key) + 16)))), rank[first].astype(np.int32)
        self._index.add(key)

    NONE = np.int32(2**31 - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, by hashed lookup; NONE where it doesn't merge."""
        at = self._index.find(_pair_key(left, right).ravel())
        out = np.where((at >= 0) & (left >= 0).ravel() & (right >= 0).ravel(), self._ranks[at], self.NONE)
        return out.reshape(left.shape)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of each's).  Pieces of similar length are the rows of one padded matrix."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, their ids, their sizes
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            known = self.whole.get(piece)
            if known is not None:
                done.append((np.array([i]), np.array([known]), np.array([1])))
            elif len(piece) > LONG_PIECE:
                ids = self._merge_long(piece)
                done.append((np.array([i]), ids, np.array([len(ids)])))
            else:
                buckets.setdefault(_WIDTHS[len(piece)], []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 18) // max(width, 1))
            for k in range(0, len(rows), step):
                self._merge_rows(pieces, rows[k : k + step], width, done)
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, ids, size = (np.concatenate([d[k] for d in done]) for k in range(3))
        first = np.cumsum(size) - size
        order = np.argsort(rows)
        return ids[tk.ragged(first[order], size[order])], size[order]

    def _merge_rows(self, pieces: list[bytes], rows: list[int], width: int, done: list) -> None:
        size = np.array([len(pieces[i]) for i in rows])
        ids = np.full((len(rows), width + 1), -1, np.int32)  # the last column stays empty
        ids[np.arange(width + 1) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        rows = np.array(rows)
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            all_rows = np.arange(len(rows))
            at = ranks.argmin(axis=1) if width else np.zeros(len(rows), np.int64)  # the leftmost of the smallest
            least = ranks[all_rows, at] if width else np.full(len(rows), self.NONE)
            over = least == self.NONE
            if over.any():
                left = ids[over]
                done.append((rows[over], left[left >= 0], (left >= 0).sum(1)))
                going = ~over
                ids, ranks, rows, at, least = ids[going], ranks[going], rows[going], at[going], least[going]
                if not len(rows):
                    return
                all_rows = all_rows[: len(rows)]
            ids[all_rows, at] = self.merged[least]
            # Compaction: what stands behind the merged pair moves up by one.
            width -= 1
            behind = np.arange(width + 1) > at[:, None]
            ids = np.where(behind, ids[:, 1:], ids[:, :-1])
            ranks = np.where(behind[:, :width], ranks[:, 1:], ranks[:, :-1])
            # Two pairs of each row are new.
            if width:
                here = np.minimum(at, width - 1)
                ranks[all_rows, here] = self.rank(ids[all_rows, here], ids[all_rows, here + 1])
                more = np.flatnonzero(at > 0)
                here = at[more] - 1
                ranks[more, here] = self.rank(ids[more, here], ids[more, here + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for a long piece: as many rounds as different ranks come up.

        All pairs of the least rank merge at once, of those that overlap every other one from the left.  Where that would make
        a pair of a lower rank still, which may come before the rest, the leftmost merges alone.
        """
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != self.NONE:
            at = np.flatnonzero(ranks == least)
            first = np.maximum.accumulate(np.where(np.append(True, np.diff(at) > 1), at, 0))
            new_ids, new_ranks, lowest = self._merge_at(ids, ranks, at[(at - first) % 2 == 0])
            if lowest < least:
                new_ids, new_ranks, _ = self._merge_at(ids, ranks, at[:1])
            ids, ranks = new_ids, new_ranks
        return ids

    def _merge_at(self, ids: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, ranks, the least rank of a new pair) with the pairs ``at`` merged."""
        made = self.merged[ranks[at[0]]]
        ids = ids.copy()
        ids[at] = made
        ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
        here = at - np.arange(len(at))
        near = np.unique(np.append(here[here < len(ranks)], here[here > 0] - 1))
        ranks[near] = self.rank(ids[near], ids[near + 1])
        return ids, ranks, int(ranks[near].min(initial=self.NONE))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after the other."""
        return self.flat[tk.ragged(self.first[ids], self.first[ids + 1] - self.first[ids])]


class _Units(tk.HashIndex):
    """Ids of units, found by a 64-bit hash; a hit counts only if the bytes are the same."""

    def __init__(self):
        super().__init__()
        self.ids, self.first, self.size = np.zeros(1 << 17, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.text, self.begin, self.length = np.zeros(1 << 18, np.uint8), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.used = self.filled = 0

    def add_units(self, key: np.ndarray, text: np.ndarray, length: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        n, more = self.count, len(key)
        while n + more > len(self.first):
            self.first, self.size, self.begin, self.length = (np.append(x, np.zeros_like(x)) for x in (self.first, self.size, self.begin, self.length))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        while self.filled + len(text) > len(self.text):
            self.text = np.append(self.text, np.zeros_like(self.text))
        self.ids[self.used : self.used + len(ids)] = ids
        self.text[self.filled : self.filled + len(text)] = text
        self.first[n : n + more], self.size[n : n + more] = self.used + np.cumsum(size) - size, size
        self.begin[n : n + more], self.length[n : n + more] = self.filled + np.cumsum(length) - length, length
        self.used += len(ids)
        self.filled += len(text)
        self.add(key)

    def are(self, at: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> bool:
        """Whether the units numbered ``at`` are the given ranges of ``data``."""
        return bool((self.length[at] == length).all()) and bool(tk.equal_ranges(self.text[: self.filled], self.begin[at], data, start, length).all())


class Encoder:
    """Encodes texts with a cache of what it has met.

    Under patterns of this family, a space behind anything but white space starts
    a piece, whatever comes before.  So a text falls into units that are encoded
    alone; those met before are looked up by a 64-bit hash and compared byte by byte.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.units, self.pieces = _Units(), {}
        self._forget_pieces()

    def _forget_pieces(self) -> None:
        self.pieces, self.piece_ids, self.piece_first = {}, np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _new_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, number of each's)."""
        if len(self.pieces) > CACHE_PIECES:
            self._forget_pieces()
        found, many, split = [], [], self.split
        for unit in units:
            pieces = split(unit)
            found += pieces
            many.append(len(pieces))
        known = self.pieces
        new = [x for x in dict.fromkeys(found) if x not in known]
        if new:
            ids, size = self.vocabulary.encode_pieces([p.encode() for p in new])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.piece_first = np.append(self.piece_first, self.piece_first[-1] + np.cumsum(size))
            self.piece_ids = np.append(self.piece_ids, ids)
        at = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        size = self.piece_first[at + 1] - self.piece_first[at]
        total = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(many))]
        return self.piece_ids[tk.ragged(self.piece_first[at], size)], np.diff(total)

    def encode(self, data: np.ndarray, offs: np.ndarray, added: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts ``data[offs[i]:offs[i + 1]]``, first index of each text's); ``added`` tokens of the file are found as such."""
        data, offs = data[offs[0] : offs[-1]], offs - offs[0]
        if added and self.vocabulary.added:
            tokens = regex.compile(b"|".join(map(regex.escape, sorted(self.vocabulary.added, key=len, reverse=True))))
            raw = data.tobytes()
            found = [m for a, b in (zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True) if tokens.search(raw) else ()) for m in tokens.finditer(raw, a, b)]
            if found:
                # The parts between are encoded as texts of their own.
                begin, end = np.array([m.start() for m in found]), np.array([m.end() for m in found])
                cut = np.unique(np.concatenate([offs, begin, end]))
                ids, first = self._plain(data, cut)
                size = np.diff(first)
                is_token = np.searchsorted(cut, begin)
                at = first[is_token]
                ids[at] = [self.vocabulary.added[m[0]] for m in found]
                keep = np.ones(len(ids), bool)
                keep[tk.ragged(at + 1, size[is_token] - 1)] = False
                return ids[keep], np.append(0, np.cumsum(keep))[first[np.searchsorted(cut, offs)]]
        return self._plain(data, offs)

    def _plain(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.units.count > CACHE_UNITS or self.units.used > 8 * CACHE_UNITS or self.units.filled > 16 * CACHE_UNITS:
            self.units = _Units()
        start = _unit_starts(data, offs)
        end = np.append(start[1:], len(data))
        key = tk.range_hashes(data, start, end) | np.uint64(1)
        at = self.units.find(key)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = np.unique(key[missing], return_index=True)
            first = missing[first]
            ids, size = self._new_units(_texts(data, start[first], end[first]))
            length = end[first] - start[first]
            self.units.add_units(new, data[tk.ragged(start[first], length)], length, ids, size)
            at[missing] = self.units.find(key[missing])
        if self.units.are(at, data, start, end - start):
            size = self.units.size[at].astype(np.int64)
            ids = self.units.ids[tk.ragged(self.units.first[at], size)]
        else:  # two units of one hash
            ids, size = self._new_units(_texts(data, start, end))
        total = np.append(0, np.cumsum(size))
        return ids, total[np.searchsorted(start, offs)]


def _texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[i:j].decode() for i, j in zip(start.tolist(), end.tolist(), strict=True)]


#: Bytes that may end a character other than white space.
_ENDS = np.ones(256, bool)
_ENDS[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = False


def _unit_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where units start: at texts, and at spaces behind what is surely no white space."""
    at = np.flatnonzero((data[1:] == 0x20) & _ENDS[data[:-1]]) + 1
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    # White space beyond ASCII: C2 85, C2 A0, E1 9A 80, E2 80 .., E2 81 .., E3 80 80.
    doubtful = (one >= 0x80) & (((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | (((two == 0x80) | (two == 0x81) | (two == 0x9A)) & (three >= 0xE1) & (three <= 0xE3)))
    starts = np.zeros(len(data), bool)
    starts[at[~doubtful]] = True
    starts[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(starts)


_vocabularies: dict[int, Vocabulary] = {}
_encoders: dict[tuple[int, str], Encoder] = {}


def encoder(source: bytes, pattern: str) -> Encoder:
    """One for each file and pattern in a Python worker, which Spark uses for many tasks."""
    key = hash(source), pattern
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary(source), pattern)
    return _encoders[key]


def vocabulary(source: bytes) -> Vocabulary:
    """One for each file in a Python worker."""
    key = hash(source)
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(source)
    return _vocabularies[key]


def _binary(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each text's ids as little-endian 32-bit integers."""
    data = np.ascontiguousarray(ids, "<u4")
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(data)])


def encode(docs: DataFrame, path: str, pattern: str, columns: list[str] | None = None, key: str = "doc_id", added: bool = True) -> DataFrame:
    """``columns`` (by default ``key``) and ``ids``, the text's token ids as little-endian unsigned 32-bit integers.

    ``path`` is a rank file or a JSON file of a byte-level BPE (read once, on the driver; it is
    of the size of a vocabulary); ``pattern`` splits a text into pieces that are
    encoded separately.  No tokens are put around a text.  A rank file knows no special tokens; the added tokens
    of a JSON file (such as ``<|endoftext|>``) are found within texts, as its library does by default, unless
    ``added`` is false.  A null or empty text has no ids.  Rows are kept as they are, repeated ones and those without a key too; a
    column of ``columns`` called ids is replaced.  Use ``ids_array`` for an array of integers.
    """
    small_batches(docs.sparkSession)
    source = _read(path)
    columns = [c for c in columns or [key] if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(source, pattern)
        for batch in batches:
            data, offs = tk.text_buffer(batch.column("text"))
            for a, b in tk.chunks(offs, ENCODE_BYTES):
                part = batch.slice(a, b - a)
                ids, first = own.encode(data, offs[a : b + 1], added)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), _binary(ids, first)], names=[*columns, "ids"])

    base = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in columns] + ["ids binary"])
    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that its ``ids`` stand for; null ids give no bytes.  A column called decoded is replaced."""
    source = _read(path)
    columns = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(source)
        for batch in batches:
            column = batch.column("ids")
            data, offs = tk.text_buffer(column.fill_null(b"") if column.null_count else column)
            for a, b in tk.chunks(offs):
                ids = np.frombuffer(data[offs[a] : offs[b]].tobytes(), "<u4").astype(np.int64)
                total = np.append(0, np.cumsum(words.first[ids + 1] - words.first[ids]))[(offs[a : b + 1] - offs[a]) // 4]
                out = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(total.astype(np.int32)), pa.py_buffer(words.decode(ids))])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), out], names=[*columns, "decoded"])

    base = encoded.select(*columns)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["decoded binary"])
    return base.mapInArrow(run, schema)


def ids_array(encoded: DataFrame) -> DataFrame:
    """``encoded`` with its ``ids`` as an array of integers."""
    columns = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tk.text_buffer(batch.column("ids").fill_null(b""))
            ids = np.frombuffer(data[offs[0] : offs[-1]].tobytes(), "<i4")
            listed = pa.ListArray.from_arrays(pa.array(((offs - offs[0]) // 4).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([listed if c == "ids" else batch.column(c) for c in columns], names=columns)

    schema = ", ".join(f"`{f.name}` {'array<int>' if f.name == 'ids' else f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, schema)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:  # a vocabulary file installed beside the library
        return f.read()
