"""The corpus pipeline: from documents to packed sequences of training ids.

Each stage works on all that its predecessor kept and calls one operator of
``qualitylens.llm``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualitylens.llm import line_dedup, mixing, packing, quality, simhash
from qualitylens.llm.common import SPACE_CHARS
from qualitylens.session import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the classifier go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs in other documents go, but for the first;
    documents that lose all their words go whole. n_chars follows the text."""
    names = docs.columns
    longest = max(names, key=len)  # two names that no column has
    counts = (f"{longest}_lines", f"{longest}_dropped")
    rows = line_dedup.drop_lines(docs, counts=counts).where(~((F.col(f"`{counts[1]}`") > 0) & (F.btrim("text", F.lit(SPACE_CHARS)) == "")))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{n}`") for n in names])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the least id:
    fingerprints that differ in two bits or fewer, and texts of a Jaccard
    similarity of 0.8 or more over five-word shingles."""
    return simhash.keep_one(docs, similarity=simhash.SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, until each source has its share of the words."""
    return mixing.repeat_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Packing and the classifier are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before
    the next one reads it."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
