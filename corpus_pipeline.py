"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, substring dedup, best-fit packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. `run` writes every stage's result as Parquet to the shared
folder and hands what it reads back to the next. All but the last return the columns of ``documents``; n_chars follows
the text. A text that loses all its words stays as an empty row until near-dedup, where empty texts are one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, linededup, packing, simhash, substring
from tidemark.llm.common import Scratch, give_back, read, shield


def _as_documents(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language one of the models accepts.

    Null texts and texts without a letter go. Rows that repeat an id or a text are judged each. Without any labelled row there is no
    model that could reject: all stay. No rows give no rows.
    """
    model = langid.fit(langid.sample(docs))
    if model is None:
        return docs
    hidden, restore = shield(docs)
    kept = restore(langid.identify(hidden, model, keep=tuple(hidden.columns)).where("accepted"))
    del model  # the workers have it from a broadcast
    give_back(spark)
    return kept


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated line runs.

    Null texts stay null, null ids come first. Equal rows are one document and get equal results; rows that repeat an id with other texts are ordered by text hash. No rows give no rows.
    """
    return _as_documents(linededup.dedup(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard index 0.8) the first document.

    Null texts and texts without a word are one group. Null ids come first; equal rows are one document and stay or go together. No rows give no rows.
    """
    return simhash.keep_first(docs, k=5, least=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 20-word windows that also start earlier.

    Null texts stay null, null ids come first. Equal rows are one document and get equal results. No rows give no rows.
    """
    return _as_documents(substring.dedup(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens.

    Null and empty texts are one closing token. Rows that repeat an id or a text are documents of their own. No rows give no sequences.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", pack),
]

#: Fingerprints, models and token ids have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
