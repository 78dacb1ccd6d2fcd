"""Exact Jaccard join of word n-gram sets by a prefix tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .scratch import partitions, saved, small_batches
from .sketch import frequency_classes, order_keys

#: Part of a set, beyond the prefix that every partner must meet, that is used to count shared n-grams.
EXTRA = 0.1
#: Bytes of text whose n-grams are gathered before they are dealt out.
FLUSH_BYTES = 4 << 20
#: A shard of the tree join holds about so many sets and n-grams in each of two blocks; a larger one is split.
BLOCK_SETS, BLOCK_GRAMS = 500, 500_000


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, first index of each text's): each text's distinct n-grams in order of hash.

    Words have A-Z lower-cased.  A text of 1 to n - 1 words has its whole
    sequence as its only n-gram; one without words has none.
    """
    w = tk.words(data, offs, lower=True)
    size = np.diff(w.first)
    gram = tk.ngram_hashes(w.hash, n)
    many = np.maximum(size - n + 1, 0)
    value, doc = gram[tk.ragged(w.first[:-1], many)], np.repeat(np.arange(len(size)), many)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = size[short] > k
            total[has] = tk.pair_hashes(total[has] + np.uint64(1), w.hash[w.first[short[has]] + k])
        value, doc = np.append(value, total), np.append(doc, short)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])) if len(value) else np.zeros(0, bool)
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(len(size) + 1))


def set_keys(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of each whole set and a second one, 64 bits each and independent of each other: equal sets have equal keys."""
    size = np.diff(first).astype(np.uint64)
    total = np.zeros((2, len(value) + 1), np.uint64)
    np.cumsum(tk.mix64(value ^ np.uint64(0x5851F42D4C957F2D)), out=total[0, 1:])
    np.cumsum(tk.pair_hashes(value, value >> np.uint64(7)), out=total[1, 1:])
    total = total[:, first[1:]] - total[:, first[:-1]]
    return tk.pair_hashes(size, total[0]), tk.pair_hashes(total[1], size)


def _need(size, percent: int):
    """The overlap below which a set of this size can't reach the similarity with any other."""
    return -(-size * percent // 100)


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are independent of the order of n-grams: prefixes hold low hashes."""
    return ((tk.mix64(gram ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _deal(percent: int, n: int, buckets: int):
    """Rows of documents, and n-grams of each new set's prefix packed by bucket.

    Of sets that share an n-gram within a task, two are dealt; the others are known to share it, which their document's row counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        ids, sizes, keys, checks, grams, owners = [], [], [], [], [], []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, size, key, check, g, own = (np.concatenate(x) for x in (ids, sizes, keys, checks, grams, owners))
            for held_list in (ids, sizes, keys, checks, grams, owners):
                held_list.clear()
            order = np.lexsort((key[own], g))
            g, own = g[order], own[order]
            r = tk.runs(g)
            place = np.arange(len(g)) - np.repeat(r[:-1], np.diff(r))
            shared = np.bincount(own[place >= 2], minlength=len(doc))
            own, g = key[own[place < 2]], g[place < 2]
            columns = [tk.mix64(doc.view(np.uint64)) % np.uint64(buckets), doc, size, key.view(np.int64), check.view(np.int64), shared]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, _DEALT_TYPES, strict=False)] + [pa.nulls(len(doc), pa.binary())] * 3, names=_DEALT_NAMES)
            rows = _packed(g, own, buckets)
            none = [pa.nulls(len(rows), t) for t in _DEALT_TYPES[1:6]]
            at, *blobs = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *none, *(pa.array(x, pa.binary()) for x in blobs)], names=_DEALT_NAMES)

        for batch in batches:
            doc_id = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offs = tk.text_buffer(batch.column("text"))
            for a, b in tk.chunks(offs):
                value, first = shingle_sets(data, offs[a : b + 1], n)
                (key, check), size = set_keys(value, first), np.diff(first)
                new = np.zeros(b - a, bool)
                for i, k in enumerate(zip(key.tolist(), check.tolist(), strict=True)):
                    if k not in seen:
                        seen.add(k)
                        new[i] = True
                take = np.where(new & (size > 0), np.minimum(size - _need(size, percent) + 1 + (EXTRA * size).astype(np.int64), size), 0)
                grams.append(value[tk.ragged(first[:-1], take)])
                owners.append(np.repeat(np.arange(b - a) + sum(map(len, ids)), take))
                ids.append(doc_id[a:b])
                sizes.append(size)
                keys.append(key)
                checks.append(check)
                held += int(offs[b] - offs[a])
                if held >= FLUSH_BYTES:
                    yield from flush()
                    held = 0
        if ids:
            yield from flush()
        tk.give_back()

    return run


def _packed(gram: np.ndarray, owner: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """(bucket, owners, how many n-grams each has in turn, n-grams) of each bucket that has any."""
    at = _bucket(gram, buckets)
    order = np.lexsort((owner, at))
    gram, owner, at = gram[order], owner[order], at[order]
    edge = np.searchsorted(at, np.arange(buckets + 1))
    rows = []
    for b in range(buckets):
        x, y = edge[b], edge[b + 1]
        if x < y:
            r = tk.runs(owner[x:y])
            rows.append((b, owner[x:y][r[:-1]].tobytes(), np.diff(r).astype(np.uint32).tobytes(), gram[x:y].tobytes()))
    return rows


_DEALT = "bucket int, doc_id long, n_shingles long, set_key long, set_check long, shared long, owner binary, many binary, gram binary"
_DEALT_NAMES = [x.split()[0] for x in _DEALT.split(", ")]
_DEALT_TYPES = [pa.int32(), *[pa.int64()] * 5, *[pa.binary()] * 3]
_COUNTED = "doc_id long, n_shingles long, set_key long, set_check long, shared long"
_COUNTED_NAMES = [x.split()[0] for x in _COUNTED.split(", ")]


def _unpack(batch: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, the sets that have them), sorted, each pair once."""
    gram = np.concatenate([np.frombuffer(g, np.uint64) for _, _, g in batch])
    owner = np.concatenate([np.repeat(np.frombuffer(o, np.uint64), np.frombuffer(m, np.uint32)) for o, m, _ in batch])
    order = np.lexsort((owner, gram))
    gram, owner = gram[order], owner[order]
    keep = np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))
    return gram[keep], owner[keep]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[bytes, bytes, bytes]]]]:
    """The packed rows of each bucket; rows come sorted by bucket."""
    at, rows = None, []
    for batch in batches:
        for b, o, m, g in zip(*(batch.column(c).to_pylist() for c in ("bucket", "owner", "many", "gram")), strict=True):
            if b != at and rows:
                yield at, rows
                rows = []
            at = b
            if g is not None:
                rows.append((o, m, g))
    if rows:
        yield at, rows


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes documents on; for each set, how many of the bucket's n-grams it shares with another."""

    def plain() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            is_doc = table.column("doc_id").is_valid()
            documents = table.filter(is_doc).select(_COUNTED_NAMES).combine_chunks()
            out.extend(documents.to_batches())
            yield from table.filter(pa.compute.invert(is_doc)).to_batches()

    out: list[pa.RecordBatch] = []
    for _, rows in _grouped(plain()):
        yield from out
        out.clear()
        gram, owner = _unpack(rows)
        r = tk.runs(gram)
        with_other = np.repeat(np.diff(r) > 1, np.diff(r))
        key, many = np.unique(owner[with_other], return_counts=True)
        none = pa.nulls(len(key), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(key.view(np.int64)), none, pa.array(many.astype(np.int64))], names=_COUNTED_NAMES)
    yield from out
    tk.give_back()


def _sets(n: int):
    """Each document's set, if it is the one with the keys asked for (rows may share a doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            want = [batch.column(c).to_numpy().view(np.uint64) for c in ("set_key", "set_check")]
            data, offs = tk.text_buffer(batch.column("text"))
            for a, b in tk.chunks(offs):
                value, first = shingle_sets(data, offs[a : b + 1], n)
                key, check = set_keys(value, first)
                asked = np.flatnonzero((key == want[0][a:b]) & (check == want[1][a:b]))
                parts = [value[first[i] : first[i + 1]].tobytes() for i in asked]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked + a)), pa.array(parts, pa.binary())], names=["set_id", "grams"])

    return run


def _grams(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for g in batch.column("grams"):
        yield np.frombuffer(g.as_buffer(), np.uint64)


def _order(gram: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return np.argsort(order_keys(gram, classes), kind="stable")


def _deal_prefixes(percent: int, classes: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, owners = [], []
            for k, g in zip(batch.column("set_id").to_pylist(), batch.column("grams"), strict=True):
                g = np.frombuffer(g.as_buffer(), np.uint64)
                g = g[_order(g, classes)[: len(g) - _need(len(g), percent) + 1]]
                grams.append(g)
                owners.append(np.full(len(g), k, np.int64).view(np.uint64))
            rows = _packed(np.concatenate(grams), np.concatenate(owners), buckets) if grams else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "owner", "many", "gram"])

    return run


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``hub, set_id`` of sets that meet in an n-gram of their prefixes: the hub is the smallest set there.  Each once in a bucket."""
    for _, rows in _grouped(batches):
        gram, owner = _unpack(rows)
        owner = owner.view(np.int64)
        order = np.lexsort((owner, gram))
        gram, owner = gram[order], owner[order]
        r = tk.runs(gram)
        hub = np.repeat(owner[r[:-1]], np.diff(r))
        both = np.unique(np.stack([hub, owner])[:, hub != owner], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["hub", "set_id"])


class PrefixTree:
    """Sets of ranks in ascending order, stored as a compressed trie.

    Sets sorted as sequences make each subtree a range; a node holds the part of
    the sequence that all its range shares beyond its parent.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        # children: node -> list; node = (first, last, depth of parent, depth)
        self.root = self._node(0, len(sets), 0)

    def _node(self, lo: int, hi: int, depth: int):
        """Iterative build; a node is [lo, hi, from, to, smallest size, largest size, children]."""
        root = [lo, hi, depth, depth, 0, 0, []]
        todo = [root]
        while todo:
            node = todo.pop()
            lo, hi, depth = node[0], node[1], node[2]
            node[4], node[5] = int(self.size[lo:hi].min()), int(self.size[lo:hi].max())
            a, b = self.sets[lo], self.sets[hi - 1]
            m = min(len(a), len(b))
            unequal = np.flatnonzero(a[depth:m] != b[depth:m])
            end = depth + int(unequal[0]) if len(unequal) else m
            node[3] = end
            first = lo
            while first < hi and len(self.sets[first]) == end:
                first += 1  # these end here
            if first == hi:
                continue
            heads = np.array([s[end] for s in self.sets[first:hi]])
            r = tk.runs(heads) + first
            for x, y in zip(r[:-1].tolist(), r[1:].tolist(), strict=True):
                child = [x, y, end, end, 0, 0, []]
                node[6].append(child)
                todo.append(child)
        return root


def tree_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all pairs with similarity of at least ``percent``, by one walk of the tree per set.

    Overlap is summed once per node for all sets below it.  A subtree is left when
    the n-grams that remain can't make up the overlap needed, or when all its sets
    are already connected with the probe.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
    tree = PrefixTree([sets[i] for i in order])
    label = np.arange(len(order))
    mark = np.zeros(max((int(s[-1]) for s in sets if len(s)), default=0) + 1, bool)
    links = []
    for x, mine in enumerate(tree.sets):
        if x + 1 == len(order) or (label[x + 1 :] == label[x]).all():
            continue
        mark[mine] = True
        a = len(mine)
        todo = [(tree.root, 0)]
        while todo:
            node, overlap = todo.pop()
            lo, hi, start, end, least, most, children = node
            if hi <= x + 1 or (label[max(lo, x + 1) : hi] == label[x]).all():
                continue
            if end > start:
                part = tree.sets[lo][start:end]
                overlap += int(np.count_nonzero(mark[part]))
                left = a - int(np.searchsorted(mine, part[-1], "right"))
            else:
                left = a
            if (100 + percent) * (overlap + most - end) < percent * (a + most) or (100 + percent) * (overlap + left) < percent * (a + least):
                continue
            y = lo
            while y < hi and len(tree.sets[y]) == end:
                if y > x and label[y] != label[x] and (100 + percent) * overlap >= percent * (a + end):
                    links.append((order[x], order[y]))
                    label[label == label[y]] = label[x]
                y += 1
            todo.extend((c, overlap) for c in children)
        mark[mine] = False
    return links


def _join_shards(percent: int, classes: np.ndarray):
    def links_of(keys: list[int], grams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(g, np.uint64) for g in grams]
        known = np.unique(np.concatenate(sets))
        rank = np.empty(len(known), np.uint32)
        rank[_order(known, classes)] = np.arange(len(known), dtype=np.uint32)
        sets = [np.sort(rank[np.searchsorted(known, s)]) for s in sets]
        found = tree_links(sets, percent)
        ids = np.array(keys, np.int64)
        return ids[[x for x, _ in found]], ids[[y for _, y in found]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, grams = None, [], []
        src, dst = [], []

        def close() -> None:
            if len(keys) > 1:
                a, b = links_of(keys, grams)
                src.append(a)
                dst.append(b)

        for batch in batches:
            for s, k, g in zip(*(batch.column(c).to_pylist() for c in ("shard", "set_id", "grams")), strict=True):
                if s != shard:
                    close()
                    shard, keys, grams = s, [], []
                keys.append(k)
                grams.append(g)
        close()
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    return run


def _shard_sizes(members: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """``(by, blocks)``: in how many blocks each shard is walked."""
    sized = members.join(sizes, "set_id").groupBy(by)
    return sized.agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("m") / BLOCK_GRAMS)).cast("int").alias("blocks"))


def _pairs_of_blocks(members: DataFrame, sized: DataFrame) -> DataFrame:
    """``(set_id, shard)`` such that each two members of a hub's shard meet in a shard of at most two blocks."""
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("block")))
    placed = members.join(sized, "hub").withColumn("block", block).withColumn("other", F.explode(others))
    return placed.select("set_id", F.xxhash64("hub", F.least("block", "other"), F.greatest("block", "other")).alias("shard"))


def set_links(sets: DataFrame, percent: int) -> DataFrame:
    """``(src, dst)``: links of ``sets(set_id, grams)`` that connect all whose similarity is ``percent`` / 100 or more.

    Sets that meet in an n-gram of their prefixes (in the global order, frequent n-grams last) form a shard with the
    smallest of them, their hub; so any two that meet are in one shard, and a set is copied once for each hub.  Each
    shard is a prefix tree that its sets walk.  A shard of many sets is cut into blocks, each with the hub; only
    sets that so aren't yet connected with the hub have to meet all blocks.
    """
    spark = sets.sparkSession
    parts = partitions(spark)
    buckets = 4 * parts
    classes = frequency_classes(sets.select("grams"), _grams)
    dealt = sets.mapInArrow(_deal_prefixes(percent, classes, buckets), "bucket int, owner binary, many binary, gram binary")
    meeting = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meeting, "hub long, set_id long").distinct()
    members = saved(meeting, "meeting")
    members = members.union(members.select("hub", "hub").distinct())
    sizes = sets.select("set_id", (F.length("grams") / 8).alias("m"))
    sized = saved(_shard_sizes(members, sizes, "hub"), "shards")

    def walk(placed: DataFrame, name: str) -> DataFrame:
        dealt = sets.join(placed, "set_id").repartition(parts, "shard").sortWithinPartitions("shard")
        return saved(dealt.mapInArrow(_join_shards(percent, classes), "src long, dst long"), name)

    # A hub is in each block of its shard.
    block = F.when(F.col("set_id") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")))
    placed = members.join(sized, "hub").withColumn("block", F.explode(block))
    links = walk(placed.select("set_id", F.xxhash64("hub", "block").alias("shard")), "links")
    large = sized.where("blocks > 1")
    if large.isEmpty():
        return links
    label = saved(components(links), "labels")
    held = members.join(large, "hub").join(label.withColumnRenamed("id", "set_id").withColumnRenamed("component_id", "mine"), "set_id", "left")
    held = held.join(label.select(F.col("id").alias("hub"), F.col("component_id").alias("its")), "hub", "left")
    held = saved(held.select("hub", "set_id", "blocks", (F.coalesce("mine", "set_id") != F.coalesce("its", "hub")).alias("stray")), "strays")
    strays = held.where("stray").select("hub", "set_id")
    if strays.isEmpty():
        return links
    stray_blocks = saved(_shard_sizes(strays, sizes, "hub").withColumnRenamed("blocks", "stray_blocks"), "stray_blocks")
    both = held.join(stray_blocks, "hub")
    own = F.pmod(F.xxhash64("set_id"), F.when(F.col("stray"), F.col("stray_blocks")).otherwise(F.col("blocks"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("stray"), F.col("blocks")).otherwise(F.col("stray_blocks")) - 1)
    both = both.withColumn("own", own).withColumn("other", F.explode(other))
    across = both.select("set_id", F.when(F.col("stray"), F.xxhash64("hub", F.lit("x"), "other", "own")).otherwise(F.xxhash64("hub", F.lit("x"), "own", "other")).alias("shard"))
    among = _pairs_of_blocks(strays, stray_blocks.withColumnRenamed("stray_blocks", "blocks"))
    return links.union(walk(across.union(among), "stray_links"))


def ngram_components(docs: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """Links texts whose n-gram sets have a Jaccard similarity of ``percent`` / 100 or more; exact but for hashes.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored, and so are
    rows without a doc_id.  Returns ``doc_id, n_shingles, component_id``: a row per
    row of ``docs``, with the smallest doc_id that links reach.  Null and empty texts, and texts of white space
    alone, have no n-grams and stand alone.  Rows that share a doc_id are one document as to
    links, each with its own ``n_shingles``.  Equal sets are one set from the
    start, so copies cost no pairs.  An empty table gives an empty result.

    N-grams are told apart by 64-bit hashes that aren't linear in the text, whole sets by two such keys.

    1. Every new set deals the n-grams of its prefix (in hash order, somewhat
       longer than partners must meet in) into buckets; sets that share too few
       with others have no partner and leave.
    2. The rest are joined by prefix trees (``set_links``).
    3. What they link, and copies, make the components.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = partitions(spark)
    buckets = 4 * parts
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = source.mapInArrow(_deal(percent, n, buckets), _DEALT)
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
    counted = saved(dealt.mapInArrow(_count_shared, _COUNTED), "counted")
    rows = counted.where("doc_id is not null")
    shared = counted.groupBy("set_key").agg(F.sum("shared").alias("shared"), F.count_distinct("set_check").alias("sets"))
    # One row per distinct set; its first document stands for it.
    distinct = saved(rows.where("n_shingles > 0").groupBy("set_key", "set_check").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size")), "distinct")
    smallest = F.ceil(F.col("size") * percent / 100)
    # Counts of sets that have one key in common by chance say nothing.
    able = distinct.join(shared, "set_key").where((F.col("sets") > 1) | (F.col("shared") >= F.floor(smallest * EXTRA * 0.999999) + 1))
    sets = saved(able.select("doc_id", "set_key", "set_check").join(source, "doc_id").mapInArrow(_sets(n), "set_id long, grams binary"), "sets")
    # A doc_id that stands in several sets links them.
    key = F.struct("set_key", "set_check")
    several = rows.where("n_shingles > 0").groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b")
    several = rows.where("n_shingles > 0").join(several.select("doc_id"), "doc_id", "left_semi")
    twice = several.select(F.col("doc_id").alias("src"), "set_key", "set_check").join(distinct.withColumnRenamed("doc_id", "dst"), ["set_key", "set_check"]).select("src", "dst")
    linked = components(set_links(sets, percent).union(twice))
    named = distinct.join(linked, distinct.doc_id == linked.id, "left").select("set_key", "set_check", F.coalesce("component_id", "doc_id").alias("component_id"))
    # Rows of one doc_id may stand in several sets.
    found = rows.where("n_shingles > 0").join(named, ["set_key", "set_check"]).select("doc_id", "n_shingles", "component_id")
    return found.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
