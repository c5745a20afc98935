"""The training-data pipeline over ``documents``.

Stages take ``(spark, docs, sf_dir)``; all but the last give back rows with the columns
of ``docs``.  Extra columns travel along whatever they are called.  An empty table passes
every stage; null texts count as empty.  A stage drops the helper tables of the stages
before it, as their rows have been written by then; tables that ``docs`` still reads stay.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmap.llm import decontam, mixing, simhash, tokens, toxicity
from corpusmap.plans.util import cut_lineage, drop_table_files, drop_unread, temporary_tables

_HELPERS: dict = {}  # tables made by the stages so far, not dropped yet


def _stage(fn):
    """``fn`` with the helper tables of earlier stages dropped and its own noted."""
    @wraps(fn)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = drop_unread(_HELPERS, docs)
        _HELPERS.clear()
        with temporary_tables() as made:
            out = fn(spark, docs, sf_dir)
            _HELPERS.update(left | made.keep_all())
        return out
    return stage


@_stage
def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the classifier learns from the confirmed ones among ``docs``."""
    score = toxicity.classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) < 0.5)


@_stage
def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest id."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


@_stage
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    name = "_matches" + "_" * max(map(len, docs.columns))  # longer than any other name
    found = decontam.with_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out_col=name)
    return found.filter(F.size(name) == 0).drop(name)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: weights 5, 2, 1 by source, at most 3 times each."""
    mixed = mixing.mix(docs, mixing.repeating(5, 2, 1), carry=True).filter("repeats > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("row.*")


@_stage
def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of all that is left, read back: a row for each document."""
    import public_tokenizers

    # after the other stages' work in the same Python workers: little memory, at some cost in time
    out = tokens.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), batch_chars=1_000_000, keep_pieces=100_000)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_token_files),
]
ORACLE_SQL = None  # hashing, training and tokenizing are not SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            written = cut_lineage(out)
            drop_table_files(docs)
            docs = written
    return out
