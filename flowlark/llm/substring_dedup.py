"""Removal of word sequences that occur earlier in the corpus, by relative Lempel-Ziv factors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import partitions, saved, small_batches
from .sketch import frequency_classes, order_keys

#: Words in an anchor; a window is indexed under the rarest anchor that it holds.
ANCHOR_WORDS = 3
#: Bytes of text that a task factors against itself before it deals out the rest.
FLUSH_BYTES = 4 << 20
#: Words handled at once of what comes to a task: bounds its memory.
PART_WORDS = 1 << 18

#: Bytes of rows that a task packs at once when texts move to their factors, how hard it packs them, and parts for each shuffle partition.
MOVE_BYTES, MOVE_LEVEL, PARTS_EACH = 32 << 20, 6, 4
#: How hard runs are packed.
DEALT_LEVEL = 6

#: ``row`` sets apart texts that share a doc_id.
_FACTORS = "doc_id long, row long, start int, many int, source_id long, source_start int"
_FACTOR_NAMES = [x.split()[0] for x in _FACTORS.split(", ")]
_FACTOR_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
#: Factors found by the task, and runs of one block; each packed.
_DEALT = "bucket int, found binary, runs binary"
_DEALT_NAMES = ["bucket", "found", "runs"]


def _anchors(data: np.ndarray, offs: np.ndarray, span: int) -> np.ndarray:
    return tk.ngram_hashes(tk.words(data, offs).hash, span)


def _runs(w: tk.Words, classes: np.ndarray, window: int):
    """Runs of consecutive windows of a text that are indexed under one occurrence of an anchor.

    Returns (text, first window, number of windows, anchor) of each run.
    """
    if window - ANCHOR_WORDS > 250:
        raise ValueError("a run must have fewer than 256 windows")
    span = min(ANCHOR_WORDS, window)
    grams = order_keys(tk.ngram_hashes(w.hash, span), classes)
    size = np.maximum(np.diff(w.first) - window + 1, 0)
    at = tk.ragged(w.first[:-1], size)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    low = tk.sliding_min(grams, window - span + 1)[at]
    text = np.repeat(np.arange(len(size)), size)
    start = at - w.first[text]
    # A window that starts with its anchor is the last under that occurrence of it.
    left = grams[at[:-1]] == low[:-1]
    first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | left))
    many = np.diff(np.append(first, len(low)))
    return text[first], start[first], many, low[first]


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one compressed blob; numbers go byte by byte, those of one weight together."""
    parts = []
    for x in arrays:
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
        parts += [f"{x.dtype.str} {len(x)}\n".encode(), raw.tobytes()]
    return zstandard.ZstdCompressor(level=DEALT_LEVEL).compress(b"".join(parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        end = raw.index(b"\n", at)
        kind, n = raw[at:end].decode().split(" ")
        size = np.dtype(kind).itemsize * int(n)
        planes = np.frombuffer(raw, np.uint8, size, end + 1).reshape(-1, int(n))
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at = end + 1 + size
    return out


def _spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the words' bytes with one space behind each, where each word starts, where it ends)."""
    size = end - start
    after = np.cumsum(size + 1) - 1
    out = np.full(int(after[-1]) + 1 if len(after) else 0, 0x20, np.uint8)
    for a in range(0, len(size), 1 << 16):
        n = size[a : a + (1 << 16)]
        out[tk.ragged(after[a : a + (1 << 16)] - n, n)] = data[tk.ragged(start[a : a + (1 << 16)], n)]
    return out, after - size, after


def _numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A number for each word: equal words have equal numbers, others don't.  Words are found by their hash ``value`` and compared."""
    _, first, number = np.unique(value, return_index=True, return_inverse=True)
    one = first[number]
    size = end - start
    if ((size == size[one]) & tk.equal_ranges(data, start, data, start[one], np.minimum(size, size[one]))).all():
        return number.astype(np.int32)
    raw, seen = data.tobytes(), {}
    return np.array([seen.setdefault(raw[i:j], len(seen)) for i, j in zip(start.tolist(), end.tolist(), strict=True)], np.int32)


def _copies(words: np.ndarray, lo: np.ndarray, size: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray):
    """(copies, their sources, all other runs but repeated ones): a copy has the words of its source, which is the earliest such run.

    ``words`` are numbers of words, a run's from ``lo`` on.  Runs are found by hash and count as copies only if their words are
    compared and equal.  Rows of one doc_id share their places; each text at the first place is kept.
    """
    words, lo, size = np.ascontiguousarray(words).view(np.uint8), 4 * lo, 4 * size
    key = tk.range_hashes(words, lo, lo + size)
    order = np.lexsort((row, start, doc, key))
    r = tk.runs(key[order])
    source = order[np.repeat(r[:-1], np.diff(r))]
    same = size[order] == size[source]
    at = np.flatnonzero(same & (order != source))
    same[at] = tk.equal_ranges(words, lo[order[at]], words, lo[source[at]], size[order[at]])
    later = same & ((doc[source] != doc[order]) | (start[source] != start[order]))
    again = np.append(False, same[1:] & (order[1:] != source[1:]) & (row[order[1:]] == row[order[:-1]])) if len(order) else same
    return order[later], source[later], np.sort(order[~later & ~again])


def _join_factors(doc, row, start, many, source, source_start):
    """Sorted neighbours that go on in both texts become one factor; equal ones, of repeated rows, count once."""
    order = np.lexsort((start, row, doc))
    doc, row, start, many, source, source_start = (x[order] for x in (doc, row, start, many, source, source_start))
    if not len(doc):
        return doc, row, start, many, source, source_start
    new = np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1]) | (many[1:] != many[:-1]))
    doc, row, start, many, source, source_start = (x[new] for x in (doc, row, start, many, source, source_start))
    goes_on = (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (start[1:] == start[:-1] + many[:-1]) & (source[1:] == source[:-1]) & (source_start[1:] == source_start[:-1] + many[:-1])
    first = np.flatnonzero(np.append(True, ~goes_on))
    return doc[first], row[first], start[first], np.add.reduceat(many, first), source[first], source_start[first]


def _deal(window: int, classes: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, texts = 0, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            doc, row, start, many, anchor, lo = (np.concatenate([p[i] for p in parts]) for i in range(6))
            data = np.concatenate([w.data for w in texts])
            move = np.cumsum([0] + [len(w.data) for w in texts])
            begin, end = (np.concatenate([getattr(w, side) + m for w, m in zip(texts, move, strict=False)]) for side in ("start", "end"))
            value = np.concatenate([w.hash for w in texts])
            parts.clear()
            texts.clear()
            if not len(doc):
                return
            words = _numbered(data, begin, end, value)
            spaced, begin, end = _spaced(data, begin, end)
            size = many + window - 1
            # Equal runs are one run from here on; the later ones are factors already.
            copy, source, keep = _copies(words, lo, size, doc, row, start)
            found = _join_factors(doc[copy], row[copy], start[copy], many[copy], doc[source], start[source])
            rows = []
            if len(found[0]):
                rows.append((int(tk.mix64(found[0][:1].view(np.uint64))[0] % np.uint64(buckets)), _pack([x.astype(t.to_pandas_dtype()) for x, t in zip(found, _FACTOR_TYPES, strict=True)]), None))
            at = ((tk.mix64(anchor[keep]) >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            keep = keep[np.argsort(at, kind="stable")]
            edge = np.searchsorted(np.sort(at), np.arange(buckets + 1))
            for b in range(buckets):
                x = keep[edge[b] : edge[b + 1]]
                if len(x):
                    d = np.append(np.flatnonzero(np.append(True, (doc[x][1:] != doc[x][:-1]) | (row[x][1:] != row[x][:-1]))), len(x))
                    first, last = begin[lo[x]], end[lo[x] + size[x] - 1] + 1
                    spelt = spaced[tk.ragged(first, last - first)]
                    spelt[np.cumsum(last - first) - 1] = 0x0A
                    step = np.diff(start[x], prepend=0).astype(np.int32)
                    arrays = [doc[x][d[:-1]], row[x][d[:-1]], np.diff(d).astype(np.uint32), (anchor[x] >> np.uint64(32)).astype(np.uint32), step, many[x].astype(np.uint8), spelt]
                    rows.append((b, None, _pack(arrays)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=_DEALT_NAMES)

        for batch in batches:
            doc_id, row_id = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
            data, offs = tk.text_buffer(batch.column("text"))
            for a, b in tk.chunks(offs):
                w = tk.words(data, offs[a : b + 1])
                text, start, many, anchor = _runs(w, classes, window)
                parts.append((doc_id[a:b][text], row_id[a:b][text], start, many, anchor, w.first[text] + start + sum(len(t.start) for t in texts)))
                texts.append(w)
                held += int(offs[b] - offs[a])
                if held >= FLUSH_BYTES:
                    yield from flush()
                    held = 0
        if parts:
            yield from flush()
        tk.give_back()

    return run


def _repeated(value: np.ndarray) -> np.ndarray:
    """Where values are that occur more than once."""
    order = np.argsort(value, kind="stable")
    r = tk.runs(value[order])
    return np.sort(order[np.repeat(np.diff(r) > 1, np.diff(r))])


def _numbers(value: np.ndarray) -> np.ndarray:
    return np.unique(value, return_inverse=True)[1]


class _Block:
    """A reference block: the words (as numbers) of runs, and an index of all windows by their words.

    A window's group are the windows with the same words.
    """

    def __init__(self, words: np.ndarray, lo: np.ndarray, many: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int):
        # Each run's words, one after the other.
        size = many + window - 1
        flat = words[tk.ragged(lo, size)]
        self.run = np.repeat(np.arange(len(many)), many)
        self.position = tk.ragged(np.zeros(len(many), np.int64), many)
        self.many = many
        at = (np.cumsum(size) - size)[self.run] + self.position
        group = _numbers(tk.ngram_hashes(flat.astype(np.uint64), window)[at]) if len(at) else at
        # Windows count as equal only if their words are.
        one = np.zeros(len(at), np.int64)
        one[group[::-1]] = np.arange(len(at))[::-1]
        raw = flat.view(np.uint8)
        if not tk.equal_ranges(raw, 4 * at, raw, 4 * at[one[group]], np.full(len(at), 4 * window)).all():
            seen: dict[bytes, int] = {}
            group = np.array([seen.setdefault(flat[i : i + window].tobytes(), len(seen)) for i in at.tolist()])
        self.group = group
        # Equal places, in rows of one doc_id, have equal ranks.
        place = start[self.run] + self.position
        order = np.lexsort((place, doc[self.run]))
        new = np.append(True, (np.diff(doc[self.run][order]) != 0) | (np.diff(place[order]) != 0)) if len(order) else order
        self.rank = np.zeros(len(at), np.int64)
        self.rank[order] = np.cumsum(new)
        self._find()

    def _find(self) -> None:
        """``longest``: how many windows from each one on also follow each other from an earlier place, and ``source``, where."""
        n = len(self.group)
        self.longest, self.source = np.zeros(n, np.int64), np.zeros(n, np.int64)
        left = self.many[self.run] - self.position
        at, group = np.arange(n), self.group
        for k in range(int(left.max(initial=0))):
            # All that have company and go on: with the same k windows before, is the next the same too?
            if k:
                more = left[at] > k
                at, group = at[more], group[more]
                group = _numbers(group.astype(np.int64) << 32 | self.group[at + k])
            order = np.lexsort((self.rank[at], group))
            at, group = at[order], group[order]
            r = tk.runs(group)
            first = np.repeat(at[r[:-1]], np.diff(r))
            earlier = self.rank[first] < self.rank[at]
            self.longest[at[earlier]], self.source[at[earlier]] = k + 1, first[earlier]
            company = np.repeat(np.diff(r) > 1, np.diff(r))
            at, group = at[company], group[company]
            if not len(at):
                break

    def parse(self) -> tuple[np.ndarray, np.ndarray]:
        """(first window, number of windows) of the factors of all runs, greedily the longest from the left.

        A factor ends where its words do; the windows across its end are looked up next.
        """
        n = len(self.longest)
        hits = np.flatnonzero(self.longest)
        end = np.cumsum(self.many)
        at = end - self.many
        found = []
        while True:
            i = np.searchsorted(hits, at)
            at = np.append(hits, n)[i]
            going = at < end
            at, end = at[going], end[going]
            if not len(at):
                break
            found.append(at)
            at = at + self.longest[at]
        at = np.concatenate([np.zeros(0, np.int64), *found])
        return at, self.longest[at]


def _factor(blobs: list[bytes], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Factors of what was dealt to one reference block: words that the block holds from an earlier place.

    Runs of different anchors have no window in common, so a large block is taken in parts by anchor.
    """
    docs, rows, runs, anchors, starts, manys, spelt = zip(*map(_unpack, blobs), strict=True)
    doc, row = (np.concatenate([np.repeat(x, n) for x, n in zip(ids, runs, strict=True)]) for ids in (docs, rows))
    anchor, many = np.concatenate(anchors), np.concatenate(manys).astype(np.int64)
    start = np.concatenate([np.cumsum(x, dtype=np.int64) for x in starts])
    data = np.concatenate(spelt)
    del docs, rows, runs, anchors, starts, manys, spelt
    end = np.flatnonzero((data == 0x20) | (data == 0x0A))
    size = many + window - 1
    lo = np.cumsum(size) - size
    # Runs of anchors that occur once have no partner.
    keep = _repeated(anchor)
    keep = keep[np.argsort(anchor[keep], kind="stable")]
    edge = tk.runs(anchor[keep])
    total = np.append(0, np.cumsum(size[keep]))[edge]
    first = 0
    while first < len(edge) - 1:
        last = max(first + 1, int(np.searchsorted(total, total[first] + PART_WORDS, "right")) - 1)
        part = np.sort(keep[edge[first] : edge[last]])
        at = tk.ragged(lo[part], size[part])
        yield _factor_part(data, np.where(at > 0, end[at - 1] + 1, 0), end[at], *(x[part] for x in (anchor, doc, row, start, many, size)), window)
        first = last


def _factor_part(data, begin, end, anchor, doc, row, start, many, size, window: int) -> tuple[np.ndarray, ...]:
    words = _numbered(data, begin, end, tk.range_hashes(data, begin, end))
    lo = np.cumsum(size) - size
    copy, source, keep = _copies(words, lo, size, doc, row, start)
    found = [(doc[copy], row[copy], start[copy], many[copy], doc[source], start[source])]
    keep = keep[_repeated(anchor[keep])]
    doc, row, start, many, lo = (x[keep] for x in (doc, row, start, many, lo))
    if len(keep):
        block = _Block(words, lo, many, doc, start, window)
        at, length = block.parse()
        of, source = block.run[at], block.source[at]
        found.append((doc[of], row[of], start[of] + block.position[at], length, doc[block.run[source]], start[block.run[source]] + block.position[source]))
    return _join_factors(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _factors(window: int):
    """Factors found in the map tasks pass; each bucket's runs are factored against the bucket."""

    def batch_of(found: tuple[np.ndarray, ...] | list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, _FACTOR_TYPES, strict=True)], names=_FACTOR_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        for batch in batches:
            for bucket, found, runs in zip(*(batch.column(c).to_pylist() for c in _DEALT_NAMES), strict=True):
                if found is not None:
                    yield batch_of(_unpack(found))
                    continue
                if bucket != at and blobs:
                    yield from map(batch_of, _factor(blobs, window))
                    blobs = []
                at = bucket
                blobs.append(runs)
        if blobs:
            yield from map(batch_of, _factor(blobs, window))
        tk.give_back()

    return run


def duplicate_factors(docs: DataFrame, window: int = 20) -> DataFrame:
    """Word sequences of ``window`` words or more that start earlier elsewhere: exact, words are compared.

    Returns factors ``doc_id, row, start, many, source_id, source_start``: the ``many``
    windows of ``window`` words of document ``doc_id`` (of its texts that with xxhash64 ``row``) from word ``start`` on also
    start, one after the other, at word ``source_start`` of document ``source_id``,
    which is earlier (a smaller doc_id, or the same and an earlier word).

    Every document is factored against every reference block that may hold words of it: each window goes to
    the block of the rarest anchor (run of three words) that it holds, by a frequency sketch of all anchors, so an
    anchor that very many texts share draws windows only where there is none but such.  A block
    holds the words around its anchors.  What comes to it is parsed greedily from the left into the longest
    factors that the block has from an earlier place; the windows across a factor's end are looked up in turn.
    A task first factors its own text by whole runs, so what it deals out has each frequent passage once.
    """
    small_batches(docs.sparkSession)
    parts = partitions(docs.sparkSession)
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    span = min(ANCHOR_WORDS, window)

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, offs = tk.text_buffer(batch.column("text"))
        for a, b in tk.chunks(offs):
            yield _anchors(data, offs[a : b + 1], span)

    classes = frequency_classes(source.select("text"), anchors)
    dealt = source.mapInArrow(_deal(window, classes, 4 * parts), _DEALT)
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_factors(window), _FACTORS)


def _deal_rows(columns: list[str]):
    """Rows of a task, packed together for each part that they go to, so that texts move compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= MOVE_BYTES:
                yield from pack(held)
                held, size = [], 0
        if held:
            yield from pack(held)

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        part = rows["_part"].to_numpy()
        order = np.argsort(part, kind="stable")
        edge = tk.runs(part[order])
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            sink = pa.BufferOutputStream()
            some = rows.select(columns).take(pa.array(order[lo:hi])).combine_chunks()
            with pa.ipc.new_stream(sink, some.schema) as writer:
                writer.write_table(some)
            blob = zstandard.ZstdCompressor(level=MOVE_LEVEL).compress(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([part[order[lo]]], pa.int32()), pa.array([blob], pa.binary())], names=["_part", "_rows"])

    return run


def _cut(window: int, schema: list[str]):
    """Words covered by a factor leave; the rest are joined by one space."""

    def run(packed: pa.Table, factors: pa.Table) -> pa.Table:
        doc, row, start, many = (factors[c].to_numpy() for c in ("_doc", "_row", "start", "many"))
        order = np.lexsort((start, row, doc))
        doc, row, start, many = (x[order] for x in (doc, row, start, many))
        edge = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(row) != 0))) if len(doc) else np.zeros(0, np.int64)
        of = {(doc[a], row[a]): slice(a, b) for a, b in zip(edge.tolist(), np.append(edge, len(doc))[1:].tolist(), strict=True)}
        out = []
        for blob in packed["_rows"]:
            rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob.as_py())).read_all().combine_chunks()
            texts, kept, total, gone = rows["text"].combine_chunks(), [], [], []
            for i, at in enumerate(zip(rows["_doc"].to_pylist(), rows["_row"].to_pylist(), strict=True)):
                words = texts[i].as_buffer().to_pybytes().split() if texts[i].is_valid else []
                total.append(len(words))
                if at in of:
                    s, m = start[of[at]], many[of[at]]
                    step = np.zeros(len(words) + 1, np.int32)
                    np.add.at(step, s, 1)
                    np.add.at(step, s + m + window - 1, -1)
                    keep = np.cumsum(step[:-1]) == 0
                    words = list(compress(words, keep.tolist()))
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            new = {"kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
            out.append(pa.table([new[c] if c in new else rows[c] for c in schema], names=schema))
        return pa.concat_tables(out)  # every factor has its text, so a part is never without rows

    return run


def remove_duplicate_spans(docs: DataFrame, window: int = 20, columns: list[str] | None = None) -> DataFrame:
    """``docs`` without the words covered by a window of ``window`` words that starts earlier elsewhere.

    Returns ``columns`` (by default ``doc_id`` alone; columns of ``docs``) with ``kept_text`` (the
    words kept, joined by one space), ``n_words`` and ``n_removed``.  Windows are
    judged on the input; the order is by doc_id, then by word.  Words are runs of
    anything but space and \\x09-\\x0D.  A null text has no words; a text shorter
    than the window keeps all; rows without a doc_id are left out; rows
    with one doc_id share their places: a window removes only such as start at a
    later word, in any of them.
    Columns of ``docs`` named like a new one are replaced.
    """
    columns = [c for c in columns or ["doc_id"] if c not in ("kept_text", "n_words", "n_removed")]
    factors = saved(duplicate_factors(docs, window).select("doc_id", "row", "start", "many"), "factors")
    parts = PARTS_EACH * partitions(docs.sparkSession)
    part = lambda doc, row: F.pmod(F.xxhash64(doc, row), F.lit(parts)).cast("int").alias("_part")
    marks = factors.select(part("doc_id", "row"), F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "start", "many")
    base = docs.where("doc_id is not null").select(*dict.fromkeys([*columns, "text"]), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_row"))
    packed = base.select("*", part("_doc", "_row")).mapInArrow(_deal_rows(base.columns), "_part int, _rows binary")
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in columns] + ["kept_text string", "n_words long", "n_removed long"]
    names = [f.name for f in base.schema if f.name in columns] + ["kept_text", "n_words", "n_removed"]
    return packed.groupBy("_part").cogroup(marks.groupBy("_part")).applyInArrow(_cut(window, names), ", ".join(schema))
