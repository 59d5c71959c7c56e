"""The corpus pipeline: language ID, SimHash near-dedup, suffix-array dedup, mixing, piece sampling.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of documents. Any column of a row may be null: a null text has no letter and goes in the first
stage; taken alone, the other stages keep it as an empty text would be kept. An empty table stays empty. Rows that repeat
count one by one, until near-dedup leaves one of them. No stage has a bound on a text's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, piece_sampling, simhash, suffix_dedup
from millrace.llm.common import Scratch, read_table

#: Posterior probability under which a document's language counts as unknown.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or of no sure language, go; a missing lang is filled in. Of
    languages that weigh the same the first by name counts, which is then not sure."""
    found = langid.identify(docs, langid.train_on_documents(docs))
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= SURE))
    fill = F.coalesce(F.col("record.lang").cast("string"), F.col("lang_pred")).alias("lang")
    return kept.select(*[fill if c == "lang" else F.col("record").getField(c).alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; null and empty texts are one group."""
    return simhash.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; documents of which nothing but spaces is left go. Null texts stay null."""
    found = suffix_dedup.dedup(docs)
    text = F.coalesce(F.col("kept"), F.col("record.text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    kept = found.where(F.col("kept").isNull() | (F.trim(F.translate("kept", "\t\n\r", "   ")) != ""))
    return kept.select(*[new.get(c, F.col("record").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null and blank texts have no size and come as often as all of their
    source does, documents without a source are a source of their own."""
    return mixing.mixed_documents(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document; of a null or empty text the one without pieces."""
    found = piece_sampling.sample_segmentations(docs, keep=("doc_id", "lang", "source"))
    return found.select("record.*", *found.columns[1:])


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("sample_pieces", sample_pieces),
]

#: Fingerprints, suffix removal and sampling have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
