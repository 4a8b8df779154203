"""From raw documents to shuffled training shards, in stages that each read what the last one wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landsift.llm import checks, mixing, ngram_join, quality, sharding
from landsift.llm.decontaminate import decontaminate
from landsift.llm.settings import MIX
from landsift.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 40


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with another text."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines. NULL texts do not pass."""
    return _with_text(quality.passed(docs.select(*COLUMNS)), "clean_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles join at a similarity of 0.8: the one with the least id."""
    return ngram_join.keep_one(docs.select(*COLUMNS), ngram_join.Jaccard(width=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the spans that hold benchmark windows. NULL texts stay NULL."""
    return _with_text(decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "clean_text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of source, language and topic."""
    return mixing.mix_documents(docs.select(*COLUMNS), MIX).filter("kept").select(*COLUMNS)


def shuffled_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ``shard`` and ``slot``."""
    return sharding.shard_rows(docs.select(*COLUMNS), ["doc_id"], SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", mix_sources),
    ("sharding", shuffled_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs


# A text is cut into words and what stands between them; a span ends with its last hit word.
_PIECES = f"regexp_extract_all(coalesce(text, ''), '{checks.ALNUM}|{checks.NOT_ALNUM}')"
ORACLE_SQL = f"""
    WITH RECURSIVE passed AS MATERIALIZED (SELECT doc_id, clean_text AS text, lang, source FROM ({checks.judged_sql()}) j WHERE kept),
    {checks.links_sql("passed", 5, 80)},
    single AS MATERIALIZED (SELECT * FROM passed WHERE doc_id IN (
        SELECT min(o.doc_id) FROM reach JOIN w o ON o.rid = reach.other GROUP BY reach.rid)),
    {checks.hits_sql("single")},
    hit AS MATERIALIZED (SELECT DISTINCT rid, k + j AS p FROM occurs, unnest(range(0, size)) v(j)),
    pieces AS MATERIALIZED (SELECT rid, i, l[i] AS x, regexp_matches(l[i], '^{checks.ALNUM}') AS is_word FROM (SELECT rid, {_PIECES} AS l FROM hd) y, unnest(range(1, len(l) + 1)) u(i)),
    worded AS MATERIALIZED (SELECT *, sum(CASE WHEN is_word THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS p FROM pieces),
    remains AS (SELECT v.rid, string_agg(x, '' ORDER BY i) AS text FROM worded v LEFT JOIN hit a ON a.rid = v.rid AND a.p = v.p LEFT JOIN hit b ON b.rid = v.rid AND b.p = v.p + 1
        WHERE NOT (CASE WHEN is_word THEN a.p IS NOT NULL ELSE a.p IS NOT NULL AND b.p IS NOT NULL END) GROUP BY v.rid),
    clean AS MATERIALIZED (SELECT doc_id, coalesce(remains.text, '') AS text, lang, source FROM hd LEFT JOIN remains USING (rid)),
    {mixing.mixing_sql(MIX, "clean")},
    drawn AS MATERIALIZED (SELECT doc_id, text, lang, source, CAST(length(text) AS BIGINT) AS n_chars FROM mixed WHERE kept),
    {checks.placed_sql("drawn", "doc_id NULLS FIRST")}
    SELECT doc_id, text, lang, source, n_chars, CAST(x % {SHARDS} AS INT) AS shard, CAST(x // {SHARDS} AS BIGINT) AS slot
    FROM numbered JOIN walk USING (ident) WHERE x < numbered.n"""
