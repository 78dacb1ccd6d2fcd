"""Divergence of sources against plain Python, on odd rows and in small shards."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowlark.llm import divergence

SCHEMA = "doc_id long, lang string, source string, text string, term string, n int, rank string"


def brute(rows, least, limit):
    docs = [(r[1] or "", r[2] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r[3] or ""))) for r in rows]
    holding, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        holding[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted((t for t, n in holding[lang].items() if n >= least), key=str.encode)
        sources = sorted({s for of, s in counts if of == lang})
        p = {}
        for s in sources:
            total = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (total + 5 * len(kept)) for t in kept}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (n + 5) // (sum(whole.values()) + 5 * len(kept)) for t, n in whole.items()}
        for s in sources:
            found = [("pair", o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [("term", t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, most in ((found, None), (terms, limit)):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, i) for i, x in enumerate(part[:most], 1)]
    return sorted(out)


def rows(n=120, seed=3):
    rng = np.random.default_rng(seed)
    words = ["a", "B", "ab", "É", "é", "ß", "日本", "\U0001f600", "x1y", "don't", "A\x00b", "q\x7fr", "w", "Z-z"]
    made = []
    for i in range(n):
        text = " ".join(rng.choice(words[: rng.integers(1, len(words) + 1)], rng.integers(0, 30)))
        made.append((i, ["en", "de", None, ""][int(rng.choice(4, p=[0.7, 0.1, 0.1, 0.1]))], [f"s{int(rng.integers(0, 4))}", None, "hot"][int(rng.integers(0, 3))], text, "x", 1, "y"))
    made += [made[5]] * 3 + [(None, "en", "hot", None, None, None, None), (n, "xx", "alone", "", "", 0, ""), (n, "yy", "é", "!!", "", 0, ""), (n, "yy", "z", "once", "", 0, ""), (n, "en", "hot", "ab É " * 50_000, "", 0, "")]
    return made


@pytest.mark.parametrize("small", [False, True])
def test_same_as_plain_python(spark, monkeypatch, small):
    if small:  # many slices, merges, shards and blocks of terms
        for name, value in {"LEAST_ROWS": 3, "SLICE_BYTES": 200, "MERGE_ROWS": 40, "HOLD_ROWS": 10, "CELLS": 12}.items():
            monkeypatch.setattr(divergence, name, value)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = divergence.audit(df, 5, 4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows(), 5, 4)


def test_ties_go_to_the_smaller_bytes(spark):
    made = [(i, "l", s, "é z \U0001f600 Ａ", "", 0, "") for i in range(6) for s in ("a", "b")] + [(i, "l", "c", "other " * 6, "", 0, "") for i in (8, 9)]
    got = divergence.audit(spark.createDataFrame(made, SCHEMA), 2, 3)
    assert sorted(map(tuple, got.collect())) == brute(made, 2, 3)
    assert [r.item for r in got.where("part = 'term' and source = 'a'").orderBy("rank").collect()] == ["z", "é", "Ａ"]


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    totals = np.array([0, 7, 10**6, 10**13, 8 * 10**15])
    for total in totals:
        count = np.append(rng.integers(0, total + 1, 200), [0, total])
        assert divergence.shares(count, np.int64(total), 3).tolist() == [1 + 10**9 * (int(c) + 5) // (int(total) + 15) for c in count]
