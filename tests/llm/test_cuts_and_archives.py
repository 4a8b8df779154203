"""Repeated cuts in decontamination, WARC jobs that share a folder, and what a token task keeps of its words."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from landsift.llm import decontaminate, token_ids, warc
from landsift.session import shared_folder


def phrases(items, size=10):
    return decontaminate.Phrases.of([(str(k), t) for k, t in enumerate(items)], size)


def cut_all(words, windows):
    """Cut every occurrence of every window at once, and again, until none is left."""
    while True:
        hit = [False] * len(words)
        for w in windows:
            for i in range(len(words) - len(w) + 1):
                if words[i:i + len(w)] == w:
                    hit[i:i + len(w)] = [True] * len(w)
        if not any(hit):
            return words
        words = [w for w, h in zip(words, hit) if not h]


def test_thousands_of_nested_cuts_take_one_pass():
    began = time.time()
    (row,) = decontaminate._shard(pa.array(["a " * 5000 + "b " * 5000 + "c"]), phrases(["a b"]), True)
    assert row[1] == 2 and row[4].split() == ["c"] and time.time() - began < 30


def test_repeated_cuts_equal_searching_the_whole_text_again():
    rng = random.Random(4)
    for _ in range(400):
        items = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(1, 4))]
        size = rng.choice([2, 3, 10])
        windows = [w[i:i + min(size, len(w))] for w in map(str.split, items) for i in range(len(w) - min(size, len(w)) + 1)]
        texts = [" ".join(rng.choice("abcdx") for _ in range(rng.randrange(30))) for _ in range(3)]
        for text, row in zip(texts, decontaminate._shard(pa.array(texts), phrases(items, size), True), strict=True):
            assert row[4].split() == cut_all(text.split(), windows), (text, items, size)


@pytest.mark.parametrize("payload", [True, False])
def test_two_jobs_write_to_one_archive_folder(spark, payload):
    path = f"{shared_folder(spark)}/warc-two-{random.random()}"
    pages = lambda ids: spark.createDataFrame([(k, "u", "x" * k * 3000) for k in ids], "page_id long, url string, html string")
    warc.write_pages(pages([1, 2, 3]), path)
    warc.write_pages(pages([4, 5, 6]), path)
    rows = warc.read_warc(spark, path, payload=payload).collect()
    assert sorted(r.record_id for r in rows) == [f"urn:page:{k}" for k in range(1, 7)]
    assert all((r.payload is not None) == payload and r.http_headers["content-length"] == str(int(r.record_id[9:]) * 3000) for r in rows)
    spark.createDataFrame([("response", "urn:page:9", None, None, bytearray(b"new"))], "record_type string, record_id string, target_uri string, refers_to string, payload binary") \
        .write.format("warc").mode("overwrite").save(path)
    assert [r.record_id for r in warc.read_warc(spark, path).collect()] == ["urn:page:9"]


def test_a_task_keeps_bounded_words_and_leaves_nothing_behind(spark):
    public = pytest.importorskip("public_tokenizers")
    import tokenizers

    path = public.path("word_bpe_49k.json")
    json = open(path, encoding="utf-8").read()
    rng = random.Random(8)
    texts = pa.array([" ".join(rng.choice(["", "É", "x ", "DON'T", "<|endoftext|>"]) + str(rng.randrange(5000)) for _ in range(300)) for _ in range(40)])
    small, large = token_ids._Encoder(json, 1, 4000), token_ids._Encoder(json, 1)
    for begin in range(0, 40, 8):
        part = texts.slice(begin, 8)
        want = large.by_text(part)
        for found in (small.by_word(part), large.by_word(part)):
            assert (found[0] == want[0]).all() and (np.array(found[1]) == want[1]).all()
    assert 0 < len(small.high) < 200 < len(large.high)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts.to_pylist())], "doc_id long, text string").repartition(3)
    known = set(vars(tokenizers))
    first = [sorted(token_ids.positions(spark, token_ids.write_ids(docs, path, words_apart=True)).collect()) for _ in range(3)]
    assert first[0] == first[1] == first[2] and set(vars(tokenizers)) == known

    def state(_):
        import sys

        module = sys.modules.get("tokenizers")
        yield sorted(set(vars(module)) - known) if module else []

    assert spark.sparkContext.parallelize(range(16), 16).mapPartitions(state).collect() == [[]] * 16
