"""Vectors and archives against plain Python."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlark.llm import embedding_dedup, neighbours, warc
from flowlark.llm.components import components


def vectors(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 8)) * rng.choice([0.05, 0.3], (n, 1))
    x[30:60] = x[3]
    rows = [(i, [float(v) for v in r], 0, 1) for i, r in enumerate(x)]
    bad = [(n, None, 0, 1), (n + 1, [0.0] * 8, 0, 1), (n + 2, [float("nan")] + [1.0] * 7, 0, 1), (n + 3, [None] + [1.0] * 7, 0, 1), (n + 4, [float("inf")] * 8, 0, 1)]
    return x, spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int, n_links int").repartition(3)


@pytest.mark.parametrize("block", [(2048, 16384), (10, 50)])
def test_embedding_dedup(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    x, df = vectors(spark)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, 0.95).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in x:
        label = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(x))])
    for i in range(len(x)):
        assert got[i] == (near[i].sum(), label[i], label[i] == i)
    assert all(got[400 + i] == (0, 400 + i, True) for i in range(5)) and len(got) == 405


@pytest.mark.parametrize("cell", [4096, 150, 20])
def test_neighbours(spark, cell, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_ROWS", cell)
    x, df = vectors(spark)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for i in range(0, 400, 20):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = [j for j in np.lexsort((np.arange(400), d)) if j != i][:10]
        mine = sorted(got[i])
        assert [r for r, *_ in mine] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-12 for _, v, s in mine)
        hit += len(set(want) & {v for _, v, _ in mine})
    assert hit >= 0.95 * 200 and not {q for q in got if q >= 400}


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = [*rng.normal(size=(40, 3)) * 1e20, *rng.normal(size=(40, 3)), *rng.normal(size=(10, 3)) * 1e-200]
    x += [x[0]] * 30 + [x[50]] * 30  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(500, [1.0, 2.0]), (501, []), (502, [1.0] * 7), (None, [1.0, 2.0, 3.0]), (503, None), (504, [0.0] * 3), (505, [1.0, float("nan"), 0.0])]
    again = [(60, rows[60][1]), (60, [5.0, 5.0, 5.0]), (61, [-5.0, 0.0, 5.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows + odd + again], "vec_id long, embedding array<double>, score int").repartition(3)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in range(len(rows)) if i % 10 == 0}
    every = rows + again
    hit = 0
    for i in sorted(got):
        best = {}
        for mine in (v for j, v in every if j == i):
            for j, v in every:
                if j != i:
                    gap = np.abs(np.array(v) - np.array(mine))
                    top = gap.max() or 1.0
                    best[j] = min(best.get(j, np.inf), top * np.sqrt(((gap / top) ** 2).sum()))
        want = sorted((s, j) for j, s in best.items())[:10]
        found = sorted(got[i])
        assert [r for r, *_ in found] == list(range(1, 11)) and len({v for _, v, _ in found}) == 10
        assert all(np.isclose(s, best[v], rtol=1e-12, atol=0) for _, v, s in found)
        if i < 40 or 90 <= i < 120:  # single precision tells the large ones apart; beside them the small ones are one place
            hit += len({j for _, j in want} & {v for _, v, _ in found})
    assert hit >= 0.9 * 10 * sum(i < 40 or 90 <= i < 120 for i in got)


def test_embedding_dedup_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1e200, 1e150]), (4, [0.0, 1.0]), (5, [1.0, 0.0, 0.0]), (6, []), (7, [0.0, 1e-200]), (None, [1.0, 0.0]), (8, None)]
    df = spark.createDataFrame([(*r, True) for r in rows], "vec_id long, embedding array<double>, kept boolean")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    assert got == sorted([(1, 3, 1, True)] * 2 + [(2, 3, 1, False), (3, 3, 1, False), (4, 1, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 4, False), (8, 0, 8, True)])


def test_empty_vectors(spark):
    _, df = vectors(spark)
    for part in (df.where("false"), df.where("vec_id >= 400")):
        assert embedding_dedup.near_duplicates(part).count() == part.count()
        assert neighbours.nearest(part, F.lit(True)).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "src long, dst long")
    got = {r.id: r.component_id for r in components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_warc_round_trip(spark, monkeypatch):
    html = ["", None, "a", "a", "é" * 50_000, "x\r\n\r\nWARC/1.1\r\n\r\n" * 20_000, "0\r\n\r\n", "a", "é" * 50_000]
    rows = [(i, None if i == 3 else f"http://h/{i} x", t, "clash") for i, t in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    data = [(t or "").encode() for t in html]
    for i, d in enumerate(data):
        last = max(j for j, other in enumerate(data) if other == d)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(d), base64.b32encode(hashlib.sha1(d).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if last == i else ("revisit", last))
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_has_a_record_for_each_row(spark):
    rows = [(1, "u", "a"), (1, "u", "b"), (1, "u", "b"), (2, None, "b"), (2, "v", "b"), (None, "w", "b"), (None, None, "c"), (None, None, "c"), (None, "x", None), (3, "y", "")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    d = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, 1, d("a"), "response", None), (1, 1, d("b"), "revisit", 2), (1, 1, d("b"), "revisit", 2), (2, 1, d("b"), "response", None), (2, 1, d("b"), "revisit", 2), (None, 1, d("b"), "revisit", 2)]
    want += [(None, 1, d("c"), "response", None), (None, 1, d("c"), "revisit", None), (None, 0, d(""), "revisit", 3), (3, 0, d(""), "response", None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_segments_are_checked(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "y" * 200_000)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    parts = warc.records(spark, str(tmp_path / "w"))
    assert parts.where("type = 'continuation'").count() == 3 and parts.where("total is not null").count() == 1
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_vectors_of_several_lengths_take_part(spark):
    """Those of each length are compared with each other, the rarer ones too."""
    x = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [1.0, 0.0, 0.0], [1.0, 0.0, 0.01], [0.0, 0.0, 5.0], [2.0, 0.0, 0.0], [7.0]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, 0.95).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (2, 3), 4: (2, 3), 5: (0, 5), 6: (2, 3), 7: (0, 7)}
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") >= 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [v for _, v in sorted(f)] for q, f in found.items()} == {0: [1, 2], 1: [0, 2], 2: [1, 0], 3: [4, 6, 5], 4: [3, 6, 5], 5: [4, 3, 6], 6: [3, 4, 5]}
    none = df.where("vec_id < 0")
    assert embedding_dedup.near_duplicates(none).count() == 0 and neighbours.nearest(none, F.col("vec_id") >= 0).count() == 0
