"""Corpus pipeline: quality, exact copies, near copies, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``, the last one the encoded documents.
A stage's rows are written to the shared folder and read again as the next
one's input, so a lost executor costs at most the running stage.

Defined cases: the operators' own (see their modules).  Rows are told apart by
doc_id and text; rows that repeat both count once from the exact dedup on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import drop_rows, table
from canopy.llm.decontaminate import decontaminate
from canopy.llm.exact_dedup import drop_copies
from canopy.llm.ngram_join import jaccard_components
from canopy.llm.quality import fit, score
from canopy.llm.sentencepiece_scan import default_model, encode
from canopy.session import shared_dir

NEAR_WORDS, NEAR_PERCENT = 5, 80
#: A classifier, components of a similarity join and a tokenizer are beyond SQL.
ORACLE_SQL = None


def _key():
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither classifier rejects."""
    names = {f"_c{i}": n for i, n in enumerate(docs.columns)}  # the classifier's columns may have the same names
    rows = docs.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()], "text", "source", "lang", "n_chars")
    judged = score(rows, fit(docs, table(spark, sf_dir, "labels")), keep=list(names))
    return judged.where("kept").select(*[F.col(c).alias(n) for c, n in names.items()])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id."""
    groups = jaccard_components(docs.select(_key().alias("k"), "text"), "k", "text", NEAR_WORDS, NEAR_PERCENT)
    return drop_rows(docs, _key(), groups.where("not first").select(F.col("k").alias("key")))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    judged = decontaminate(docs.select(_key().alias("k"), "text"), table(spark, sf_dir, "benchmark"), "k")
    return drop_rows(docs, _key(), judged.where("not kept").select(F.col("k").alias("key")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of each document."""
    return encode(docs, default_model())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", leaks), ("sentencepiece", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}-{name}")
        docs = spark.read.parquet(f"{path}/{k}-{name}")
    return docs
