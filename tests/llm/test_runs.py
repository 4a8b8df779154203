"""Periodic runs against brute force: every stretch of every period, one word at a time."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from landsift.llm import runs


def by_hand(words, times=4, least=6):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            begin = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > begin and i - begin + p >= max(least, times * p):
                found.setdefault((begin, i - begin + p), p)
            i += i == begin
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def repeated(rng, kinds):
    words = []
    for _ in range(rng.randrange(8)):
        unit = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(1, 9))]
        words += unit * rng.choice([1, 1, 3, 4, 5, 9]) + unit[:rng.randrange(len(unit) + 1)]
    return words


def check(texts):
    n, found, clean = runs._piece(pa.array(texts, pa.string()), 4, 6)
    for text, size, rows, kept in zip(texts, n.tolist(), found.to_pylist(), clean.to_pylist(), strict=True):
        words = (text or "").split()
        want = by_hand(words)
        assert size == len(words)
        assert [(r["start"], r["length"], r["period"]) for r in rows] == want
        gone = {i for s, length, p in want for i in range(s + p, s + length)}
        assert kept == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_many_texts_of_repeats():
    rng = random.Random(5)
    for _ in range(150):
        check([None, "", *[" ".join(repeated(rng, rng.choice([1, 2, 3, 20]))) for _ in range(rng.randrange(1, 5))]])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=60), min_size=1, max_size=4))
def test_any_text_of_two_words(texts):
    check([" ".join(t.replace(" ", "")) for t in texts])


def test_common_extension_equals_comparing_words():
    rng = np.random.default_rng(3)
    codes = np.concatenate((np.tile(rng.integers(0, 3, 40), 9), rng.integers(0, 2, 500), [7], np.zeros(200, int), [8]))
    i, j = rng.integers(0, len(codes), (2, 4000))
    i, j = i[i != j], j[i != j]
    want = [next((k for k in range(len(codes)) if max(a, b) + k >= len(codes) or codes[a + k] != codes[b + k]), 0) for a, b in zip(i, j)]
    assert runs.CommonExtension(codes)(i, j).tolist() == want


def test_a_very_long_text_of_one_word_is_one_run():
    n, found, clean = runs._piece(pa.array(["a " + "the " * 60_000 + "b"]), 4, 6)
    assert found.to_pylist() == [[{"start": 1, "length": 60_000, "period": 1}]] and clean.to_pylist() == ["a the b"]


def test_rows_without_columns_of_their_own_and_empty_tables(spark):
    docs = spark.createDataFrame([("a b " * 4,), (None,), ("a b " * 4,)], "text string")
    rows = runs.collapse_runs(docs).collect()
    assert sorted(repr((r.text, r.n_words, [tuple(x) for x in r.runs], r.clean_text)) for r in rows) == sorted(map(repr, [
        ("a b " * 4, 8, [(0, 8, 2)], "a b"), ("a b " * 4, 8, [(0, 8, 2)], "a b"), (None, 0, [], "")]))
    assert runs.collapse_runs(docs.limit(0)).collect() == []
