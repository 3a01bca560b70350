"""Corpus pipeline over ``documents``: language, recurring lines, near copies, personal data, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns a DataFrame, of the columns of ``documents`` in all stages but the last.

In every stage an empty table gives an empty one, columns besides id and text may be null, and rows are rows: those
without an id, and those that repeat an id with the same or another text, are each judged by themselves and keep their own
columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmark.llm.common import materialise
from plotmark.llm.language_id import UNDETERMINED, fit_language_model, held_out, predict_language
from plotmark.llm.line_dedup import line_dedup
from plotmark.llm.ngram_join import ngram_join
from plotmark.llm.packing import pack_documents
from plotmark.llm.pii import redact_pii
from plotmark.sources.storage import shared_dir

LEAST_SCORE = 0.5  # calibrated probability of the language below which a document is rejected


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with n_chars brought up to date and the columns in order."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that is known with some certainty, go (so do null and empty texts); lang becomes the
    predicted one. The model learns from rows with an id and a lang; without any, no language is known and all go."""
    model = fit_language_model(docs.filter(~held_out() & F.col("doc_id").isNotNull()))
    told = predict_language(docs, model).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return told.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as a table with a unique ``row_key``, since ids may be null or repeated."""
    return materialise(docs.withColumn("row_key", F.monotonically_increasing_id()), "keyed")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines are cut out of the texts; documents of which nothing is left go. Null text becomes empty, and has no
    recurring line; texts are whole, however long."""
    keyed = _keyed(docs)
    cleaned = line_dedup(keyed, id_col="row_key").select(F.col("doc_id").alias("row_key"), F.col("text").alias("cleaned"), "n_dropped")
    joined = keyed.join(cleaned.hint("merge"), "row_key").filter((F.col("n_dropped") == 0) | (F.trim("cleaned") != ""))
    return _sized(joined.withColumn("text", F.col("cleaned")), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row with the smallest id stays; a null id comes after all others, and of rows
    with one id any one. Null and blank texts are linked with none and stay."""
    keyed = _keyed(docs)
    classes = ngram_join(keyed, id_col="row_key").select(F.col("doc_id").alias("row_key"), "class_id")
    named = keyed.select("row_key", "doc_id").join(classes.hint("merge"), "row_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("first")
    stays = named.groupBy("class_id").agg(first).select(F.col("first.row_key").alias("row_key"))
    return keyed.join(stays.hint("merge"), "row_key", "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind, in every row; null text stays null or becomes empty."""
    return _sized(redact_pii(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: the pieces of all rows with their places; null and empty texts are one piece of one id."""
    return pack_documents(docs)


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("ngram_join", near_copies),
    ("pii", personal_data),
    ("packing", packing),
]

#: Language models, signatures and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
