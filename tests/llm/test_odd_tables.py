"""Every operator on odd and on empty tables, against SQL; clashing extra columns change nothing."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import odd

from landsift.llm import decontaminate, lines, mixing, ngram_join, quality, runs, sharding, substrings, surrogates
from landsift.llm.catalog import CHECKS, QUERIES
from landsift.llm.settings import MIX

CHECKED = sorted(set(CHECKS) - {"pipeline"})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return odd.write(tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return odd.write(tmp_path_factory.mktemp("empty"), empty=True)


@pytest.mark.parametrize("name", CHECKED)
def test_odd_rows(spark, folder, name):
    odd.agree(spark, QUERIES[name], CHECKS[name], folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert [r.conv_id for r in rows] == [-1] if name == "op12_chat_tree" else rows == []


OPERATORS = {
    "quality": lambda d, b: quality.judge(d),
    "lines": lambda d, b: lines.drop_common_lines(d),
    "sharding": lambda d, b: sharding.shard_rows(d, ["doc_id", "text"], 3),
    "decontaminate": lambda d, b: decontaminate.decontaminate(d, b),
    "substrings": lambda d, b: substrings.remove_repeats(d),
    "mixing": lambda d, b: mixing.mix_documents(d, MIX),
    "surrogates": lambda d, b: surrogates.replace_entities(d, "key"),
    "runs": lambda d, b: runs.collapse_runs(d),
    "keep_one": lambda d, b: ngram_join.keep_one(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(spark, folder, name):
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = OPERATORS[name](docs, bench)
    added = [c for c in plain.columns if c not in docs.columns]
    own = ["row", "i", "d", "t", "w", "l", "s", "salt", "topic_", "gone", "block"]
    clashing = docs.select("*", *[F.lit(7).alias(c) for c in [*added, *own]])
    wide = OPERATORS[name](clashing, bench)
    assert set(wide.columns) == {*docs.columns, *added, *own}
    keys = [F.col(c).cast("string") for c in plain.columns]
    if name == "sharding":  # equal rows may change places
        keys = [F.col(c) for c in ("doc_id", "text")]
    assert sorted(map(repr, plain.select(*keys).collect())) == sorted(map(repr, wide.select(*keys).collect()))
    assert wide.filter("i = 7 and t = 7").count() == wide.count()
