"""Texts that polynomial hashes confuse: two Thue-Morse words of a length that is a power of two."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlark.llm import bpe, ngram_join, packing, substring_dedup
from flowlark.llm import textkit as tk


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


WORDS = [thue_morse(n) for n in (512, 1024, 2048, 4096)]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


def test_byte_ranges():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    start = rng.integers(0, 3000, 2000)
    size = rng.integers(0, 1000, 2000)
    by_text = {}
    for s, n, h in zip(start, size, tk.range_hashes(data, start, start + size), strict=True):
        assert by_text.setdefault(data[s : s + n].tobytes(), h) == h
    assert len(set(by_text.values())) == len(by_text)
    other = np.roll(start, 1)
    same = tk.equal_ranges(data, start, data, other, size % 9)
    assert same.tolist() == [data[a : a + n].tobytes() == data[b : b + n].tobytes() for a, b, n in zip(start, other, size % 9, strict=True)]
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in WORDS[-1])
    zero, whole = np.zeros(1, np.int64), np.array([4096])
    assert not tk.equal_ranges(a, zero, b, zero, whole)[0] and tk.equal_ranges(a, zero, a.copy(), zero, whole)[0]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 20])
def test_runs_of_values(n):
    value = np.random.default_rng(n).integers(0, 3, 300).astype(np.uint64)
    found = {}
    for i, h in enumerate(tk.ngram_hashes(value, n).tolist()):
        assert found.setdefault(tuple(value[i : i + n]), h) == h
    assert len(set(found.values())) == len(found) and i == 300 - n


def test_sets_of_other_words_are_not_linked(spark):
    texts = [x for pair in WORDS for x in pair] + [" ".join([x] * 6) for pair in WORDS for x in pair]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs_of(spark, texts)).collect()}
    assert got == {i: i for i in range(len(texts))}


def test_windows_of_other_words_stay(spark):
    texts = [" ".join([x] + [f"w{i}" for i in range(30)] + [x]) for pair in WORDS for x in pair]
    tail = " ".join(f"w{i}" for i in range(30))
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.remove_duplicate_spans(docs_of(spark, texts), 20).collect()}
    words = [x for pair in WORDS for x in pair]
    assert got[0] == (0, texts[0])
    assert all(got[i] == (30, f"{words[i]} {words[i]}") for i in range(1, len(words))) and tail in texts[0]
    alone = [" ".join([x] * 20) for pair in WORDS for x in pair]
    assert all(r.n_removed == 0 for r in substring_dedup.remove_duplicate_spans(docs_of(spark, alone), 20).collect())


def test_ids_of_other_words(spark):
    texts = [x for pair in WORDS for x in pair] + ["x" * 1000 + "y" * 700, "Ab" * 900]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary(open(path, "rb").read()).ids, special_tokens={})
    got = bpe.ids_array(bpe.encode(docs_of(spark, texts), path, public_tokenizers.PATTERN)).collect()
    assert {r.doc_id: r.ids for r in got} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = packing.pieces(docs_of(spark, texts), path, public_tokenizers.PATTERN, 4096).select("doc_id", F.hex("ids").alias("ids")).collect()
    assert {r.doc_id: bytes.fromhex(r.ids) for r in found} == {i: np.array([*library.encode(t).ids, 0], "<u4").tobytes() for i, t in enumerate(texts)}


def test_long_pieces_merge_as_the_library_does():
    rng = np.random.default_rng(8)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = bpe.Vocabulary(open(path, "rb").read())
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=vocabulary.ids, special_tokens={})
    texts = ["".join(rng.choice(list(letters), n)) for n in (257, 900, 5000) for letters in ("ab", "the quick", "etaoinshrdlu ETA", "xyzÄ日")]
    texts += ["a" * 999, "aab" * 400, "\n" * 700, " " * 3001]
    for t in texts:
        assert vocabulary._merge_long(t.encode()).tolist() == library.encode_ordinary(t)


def test_units_of_one_hash_are_told_apart(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = bpe.Encoder(bpe.Vocabulary(open(path, "rb").read()), public_tokenizers.PATTERN)
    texts = ["one two three", "four five", "six one"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.append(0, np.cumsum([len(t) for t in texts]))
    want = encoder.encode(data, offs)[0].tolist()
    monkeypatch.setattr(tk, "range_hashes", lambda data, start, end: np.full(len(start), 7, np.uint64))
    other = bpe.Encoder(encoder.vocabulary, public_tokenizers.PATTERN)
    assert other.encode(data, offs)[0].tolist() == want and other.encode(data, offs)[0].tolist() == want


def parsed(texts, buckets=3):
    """The factors of texts numbered from 0, without Spark."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "row", "text"])
    deal = substring_dedup._deal(20, np.zeros(1 << 22, np.uint8), buckets)
    rows = pa.Table.from_batches([d for i in range(len(texts)) for d in deal(iter([batch.slice(i, 1)]))]).sort_by("bucket").to_batches()
    return [x for b in substring_dedup._factors(20)(iter(rows)) for x in b.to_pylist()]


@pytest.mark.parametrize("weak", [False, True])
def test_factors_whatever_the_hash(monkeypatch, weak):
    rng = np.random.default_rng(6)
    base = [f"v{i}" for i in rng.integers(10, 99, 400)]
    texts = [" ".join(base[a : a + n] + [f"x{a}"] + base[b : b + 30]) for a, n, b in zip(rng.integers(0, 200, 25).tolist(), rng.integers(5, 150, 25).tolist(), rng.integers(0, 370, 25).tolist(), strict=True)] + ["y " * 60, None, ""]
    monkeypatch.setattr(substring_dedup, "PART_WORDS", 40 if weak else 1 << 18)
    if weak:  # words are told apart by their length alone
        monkeypatch.setattr(tk, "range_hashes", lambda data, start, end: tk.mix64((np.asarray(end) - start).astype(np.uint64)))
    found = parsed(texts)
    words = [(t or "").split() for t in texts]
    seen, want = {}, set()
    for i, w in enumerate(words):
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                want.add((i, k))
    assert {(r["doc_id"], r["start"] + k) for r in found for k in range(r["many"])} == want and want
    for r in found:
        assert (r["source_id"], r["source_start"]) < (r["doc_id"], r["start"])
        assert words[r["doc_id"]][r["start"] :][: r["many"] + 19] == words[r["source_id"]][r["source_start"] :][: r["many"] + 19]


def test_factors_are_the_longest():
    w = [f"v{i}" for i in range(60)]
    # The first place of a window goes on for one word, the second for ten.
    block = [w[:21] + ["a"] * 5, ["b"] * 3 + w[:30] + ["c"], w[:30] + ["d"] * 4]
    numbers = {x: i for i, x in enumerate(dict.fromkeys(x for run in block for x in run))}
    words = np.array([numbers[x] for run in block for x in run], np.int32)
    size = np.array([len(x) for x in block])
    made = substring_dedup._Block(words, np.cumsum(size) - size, size - 19, np.arange(3), np.zeros(3, np.int64), 20)
    at, length = made.parse()
    assert [(made.run[i], made.position[i], n, made.run[made.source[i]], made.position[made.source[i]]) for i, n in zip(at, length, strict=True)] == [(1, 3, 2, 0, 0), (2, 0, 11, 1, 3)]


def test_addresses_of_other_alphabets_and_numbers_of_other_countries():
    """All of the name goes, the shape and the country code stay, and the key leads back."""
    from flowlark.llm import pii

    f = pii.Feistel(b"some key")
    for text, kind, gone in [
        ("to Ünal.öz@example.com now", "email", ["Ünal", "öz@", "example"]), ("Иван.Петров@почта.рф", "email", ["Иван", "Петров", "почта"]), ("Łukasz@żółw.pl!", "email", ["Łukasz", "żółw"]),
        ("ünal@a.de", "email", ["nal@"]), ("请联系user@example.com谢谢", "email", ["user@", "example"]), ("+44 20 7946 0958 2023-01-05", "phone", ["7946", "2023"]), ("(+49 30 1234567)", "phone", ["1234567"]), ("+33 1 42 68 53 00,", "phone", ["42 68"]),
        ("+442079460958", "phone", ["2079"]), ("+81-3-1234-5678 or +52 55 1234 5678", "phone", ["1234"]), ("+1 415 555 2671", "phone", ["555 2671"]), ("+41 (0)44 668 18 00", "phone", ["668 18"]),
    ]:
        new, found = pii.pseudonymise(text, f)
        assert found[kind] >= 1 and len(new) == len(text) and not [g for g in gone if g in new], text
        assert pii.pseudonymise(new, f, True)[0] == text and new.split(" ")[0][:3] == text.split(" ")[0][:3] if text[0] == "+" else True
    for text in ("+999", "5 + 44 20 7946", "+12", "a@b", "+49", "x+49 30 1234567", "@example.com"):
        assert pii.pseudonymise(text, f) == (text, {})
