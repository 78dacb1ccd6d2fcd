"""Each stage of the pipeline on odd rows: nulls in any column, empty and very long texts, repeated rows, empty tables, clashing names."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from flowlark.llm import pii, queries

CLASH = ["score", "predicted", "held_out", "kept_text", "n_words", "n_removed", "n_found", "found", "component_id", "label", "ids", "decoded", "row", "_c0"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
LONG = " ".join(f"l{i % 997}x{i}" for i in range(40_000))
PASSAGE = " ".join(f"p{i}" for i in range(30))


def rows():
    r = random.Random(3)
    prose = [" ".join(r.choices(["tane", "rimo", "sulu", "keda", "vuri", "lome"], k=40)) + f" end{i}" for i in range(40)]
    texts = [None, "", " \t", "one", LONG, PASSAGE + " first", "second " + PASSAGE, "mail a@b.example.com on 1/2/1999", *prose]
    made = [(i, t, None if i % 3 else "en", None if i % 4 else "s", None if i % 5 else 7, *(f"{c}{i}" if i % 2 else None for c in CLASH)) for i, t in enumerate(texts)]
    return [*made, made[5], made[9], (None, "no id " + PASSAGE, "en", None, 3, *(None for _ in CLASH)), (None, None, None, None, None, *("x" for _ in CLASH))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("labels"))
    labels = [(i, int(i >= 8), 0) for i in range(48)] + [(None, 1, None), (3, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def key(row):
    return str(row)


def test_quality(spark, docs, folder):
    out = corpus_pipeline.keep_good(spark, docs, folder)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = sorted(map(tuple, out.collect()), key=key)
    every = rows()
    assert all(got.count(x) == every.count(x) for x in got)  # whole rows, repeated ones alike
    assert {x[0] for x in got} >= set(range(8, 48))


def test_near_duplicates(spark, docs, folder):
    out = corpus_pipeline.keep_one_of_each_group(spark, docs, folder)
    assert out.columns == docs.columns
    # 5 and 6 are alike.
    want = list(dict.fromkeys(x for x in rows() if x[0] not in (None, 6))) + [x for x in rows() if x[0] is None]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_repeats(spark, docs, folder):
    out = corpus_pipeline.cut_repeats(spark, docs, folder)
    assert out.columns == docs.columns
    want = [x if x[0] != 6 else (6, "second", *x[2:4], 6, *x[5:]) for x in rows()]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_personal_data(spark, docs, folder):
    out = corpus_pipeline.pseudonymise(spark, docs, folder)
    assert out.columns == docs.columns
    f = pii.Feistel(queries.EXAMPLE_KEY)
    want = []
    for x in rows():
        new, found = pii.pseudonymise(x[1], f) if x[1] else (x[1], {})
        want.append((x[0], new, *x[2:4], len(new) if found else x[4], *x[5:]))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_packing(spark, docs, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, want = {}, {}
    for r in corpus_pipeline.pack(spark, docs, folder).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for x in rows():
        ids = [*library.encode(x[1] or "", add_special_tokens=False).ids, 0]
        cut = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want.setdefault(x[0], []).extend((i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty_tables(spark, docs, folder):
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
    small = none.select("doc_id", "text")  # without the column that counts characters
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, small, folder).columns == ["doc_id", "text"], name


def test_queries_over_their_tables(spark, tmp_path):
    """op4 to op8 and op10 as registered, against the libraries and brute force, on a small table of odd rows."""
    import hashlib

    import tiktoken

    from flowlark.llm import bpe

    d = str(tmp_path)
    docs = [(i, t) for i, (_, t, *_) in enumerate(rows())]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 8), int(i == 3)) for i in range(48)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 6))
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    made = {name: query(spark, d).collect() for name, query in queries.queries().items() if name.split("_")[0] in ("op4", "op5", "op6", "op7", "op8", "op10")}
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary(open(path, "rb").read()).ids, special_tokens={})
    ids = {i: library.encode_ordinary(t or "") for i, t in docs}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted(map(tuple, made["op4_bpe"])) == [(i, len(ids[i]), sha(np.array(ids[i], "<u4").tobytes()), sha((t or "").encode())) for i, t in docs]
    assert sum(r.length for r in made["op5_packing"]) == sum(len(x) + 1 for x in ids.values())
    x = vectors.astype(np.float32).astype(float)
    for q in (0, 100, 200):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [(n, int(v), far[v]) for n, v in enumerate([v for v in np.lexsort((np.arange(300), far)) if v != q][:10], 1)]
        assert [(r["rank"], r.vec_id, r.score) for r in sorted(made["op6_neighbours"], key=lambda r: r["rank"]) if r.query_id == q] == want
    for name, folds, held in (("op7_toxicity", 5, 0), ("op8_quality", 4, 2)):
        assert len(made[name]) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and r.predicted == int(r.score >= (0.5 if folds == 5 else 0.7)) for r in made[name])
    f = pii.Feistel(queries.EXAMPLE_KEY)
    assert {r.doc_id: r.text for r in made["op10_pii"]} == {i: pii.pseudonymise(t, f)[0] if t else t for i, t in docs}


def test_columns_keep_their_types(docs):
    moved, columns, back = corpus_pipeline._carried(docs.withColumn("a.b", F.lit(1)))
    assert back(moved).columns == [*docs.columns, "a.b"] and "text" in columns and "doc_id" not in columns
