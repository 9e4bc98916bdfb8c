"""Removal of repeated strings against a plain count of all strings."""

import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("xxhash")

from pricelore.llm import suffixes  # noqa: E402


def plain(texts, least):
    """doc's bytes, kept bytes and removed runs by counting every string."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - least + 1):
            if count[d[i : i + least]] > 1:
                gone[i : i + least] = [True] * least
        out.append((len(d), bytes(b for b, g in zip(d, gone, strict=True) if not g), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))))
    return out


def found(spark, texts, least, gram, parts=3):
    rows = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in enumerate(texts)], "doc_id long, text string, k1 string, gram int, n int, body string").repartition(parts)
    got = {r.doc_id: r for r in suffixes.remove_repeats(rows, least, gram).collect()}
    assert len(got) == len(texts)
    out = []
    for i in range(len(texts)):
        r = got[i]
        assert r.n_bytes - len(r.kept) == sum(s.end - s.begin for s in r.spans)
        assert all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:], strict=False))
        out.append((r.n_bytes, bytes(r.kept), len(r.spans)))
    return out


def mixed(rng, n):
    """Texts that share passages of many lengths with different surroundings, also inside themselves; periodic ones; letters of several bytes."""
    letters = "ab" if rng.random() < 0.3 else "abcdefgh éß中"
    make = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [make(rng.randrange(8, 90)) for _ in range(6)]
    texts = ["", None, "a" * 150, "ab" * 90, make(16), "中" * 30]
    for _ in range(n):
        texts.append("".join(rng.choice(shared) if rng.random() < 0.5 else make(rng.randrange(0, 25)) for _ in range(rng.randrange(1, 7))))
    return texts + texts[8:11]


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_plain_count(spark, seed):
    texts = mixed(random.Random(seed), 40)
    assert found(spark, texts, 24, 8) == plain(texts, 24)


def test_boundaries_hot_grams_and_short_slices(spark, monkeypatch):
    """Buckets of a few rows, grams beyond HOT and slices that cut texts give the same."""
    monkeypatch.setattr(suffixes, "BUCKET", 5)
    monkeypatch.setattr(suffixes, "CHUNK", 3)
    monkeypatch.setattr(suffixes, "HOT", 4)
    monkeypatch.setattr(suffixes, "SLICE", 40)
    rng = random.Random(5)
    common = "the same sixteen byte passage"
    texts = mixed(rng, 25) + ["".join(rng.choice("xyz") for _ in range(rng.randrange(6, 12))) + common + "".join(rng.choice("xyz") for _ in range(rng.randrange(6, 12))) for _ in range(40)]
    assert found(spark, texts, 24, 8) == plain(texts, 24)
    assert found(spark, texts, 33, 16) == plain(texts, 33)


def test_production_parameters(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(k) for k in (30, 36, 40, 50, 120)]
    texts = [" ".join(rng.choice(passages) if rng.random() < 0.4 else prose(rng.randrange(3, 60)) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + "!", "x" * 199, "x" * 199, "y" * 200, "z" * 201, prose(40) + "\n" + prose(40)]
    assert found(spark, texts, 200, 64) == plain(texts, 200)


def test_megabyte_texts(spark):
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, 1_200_000, dtype=np.uint8)).decode()
    got = found(spark, [text, text[500_000:500_200] + "!", "?" + text[900_000:900_199]], 200, 64)
    assert [(n, len(kept), spans) for n, kept, spans in got] == [(1_200_000, 1_199_800, 1), (201, 1, 1), (200, 200, 0)]


def test_empty_table_null_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(empty).collect() == []
    rows = spark.createDataFrame([(None, "q" * 30), (1, "r" * 10), (1, "r" * 10), (1, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in suffixes.remove_repeats(rows, 24, 8).collect())
    assert got == [(0, 30, 0), (1, 0, 0), (1, 10, 10), (1, 10, 10)]


def test_multikey_quicksort_finds_equal_strings():
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(0, 2, 3000, dtype=np.uint8))
    at = np.arange(len(data) - 19)
    count = Counter(data[i : i + 20] for i in at.tolist())
    assert suffixes.repeated(data, at, 20).tolist() == [count[data[i : i + 20]] > 1 for i in at.tolist()]
