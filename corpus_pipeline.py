"""Corpus pipeline: toxicity filter, line dedup, SimHash near-dedup, benchmark
decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; its result is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``docs``, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapflow.llm.bpe import encode_texts
from tapflow.llm.decontamination import remove_contaminated
from tapflow.llm.linededup import dedup_lines
from tapflow.llm.queries import table, vocabulary_path
from tapflow.llm.simhash import keep_one_of_each
from tapflow.llm.toxicity import drop_toxic, train_model
from tapflow.operators.common import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labels of
    ``docs`` that are not held out."""
    return drop_toxic(docs, train_model(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of more than 50 words that an earlier place has are cut out;
    a document that was all copied stays, with an empty text."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints, the smallest id stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents a twentieth of whose words are benchmark windows go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and decoded text."""
    return encode_texts(docs, vocabulary_path())


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("BPE encoding", bpe)]

# A trained network and XXH64 fingerprints are beyond SQL; tests/llm compares
# every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
