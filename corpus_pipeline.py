"""A corpus pipeline: language ID, exact dedup, near-duplicate removal, source mixing, encoding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``.  All
but the last return the columns of ``documents``, in their order and with their types.

Every stage takes an empty table to an empty one, and columns beyond those of ``documents`` through, whatever their names.  Nulls: a null text has no language, so the first stage rejects it; later stages would take it as
empty.  A null source is a source of its own, and a row with a null key is kept by the stages that drop copies only
if no other row of its group has a key, or if it stands alone.  Rows that repeat key and text are decided together.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import durable, key_bits, maybe_in
from panelforge.llm.exact_dedup import exact_dedup
from panelforge.llm.jaccard import jaccard_classes
from panelforge.llm.language import UNDETERMINED, fit_languages, held_out, identify
from panelforge.llm.mixing import mixed_documents
from panelforge.llm.pieces import encode_pieces
from panelforge.llm.queries import tokenizer


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def keeps_columns(stage):
    """Other columns than those of ``documents`` go through a stage under names that no operator uses."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = docs.toDF(*[c if c in DOCUMENT else f"extra{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, inner, sf_dir).toDF(*docs.columns)

    return run


@keeps_columns
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (no text, or no letter in it); ``lang`` becomes the prediction.  Documents in
    several languages stay, with the one of the largest share."""
    model = fit_languages(docs.where(~held_out(F.col("doc_id"))))
    named = identify(docs, model).where(F.col("lang_pred") != UNDETERMINED)
    return named.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@keeps_columns
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup(docs).where("kept").select(*docs.columns)


@keeps_columns
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest key stays; a row without a key stays."""
    gone = durable(jaccard_classes(docs).where("component_id <> doc_id").select("doc_id").distinct(), "near-gone")
    # Only rows that the bits of the gone keys let through are shuffled, for the exact join.
    marked = maybe_in(docs, F.xxhash64("doc_id"), key_bits(gone.select(F.xxhash64("doc_id"))), "_maybe")
    hit = marked.where("_maybe").select(*docs.columns).join(gone, "doc_id", "left_anti")
    return hit.select(*docs.columns).unionByName(marked.where("NOT _maybe").select(*docs.columns))


@keeps_columns
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document holds the words that the mix takes of it; those of which it takes none go."""
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids with an end id, their number, a hash of their spans, and whether decoding gives the text back."""
    out = encode_pieces(docs.select("doc_id", "lang", "source", "text"), tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("begins", "ends").alias("spans_xxhash64"), (F.col("decoded") == F.col("text")).alias("round_trip"), "ids")


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixed), ("SentencePiece", pieces)]

#: Language ID and the Jaccard join are beyond SQL; the tests hold ``run`` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
