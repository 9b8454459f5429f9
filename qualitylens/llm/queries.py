"""The queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualitylens.llm import chat, embed_dedup, importance, license_scan, line_dedup, mixing, packing, preference, quality, simhash, spelling, toxicity, url_filter
from qualitylens.llm.common import word_count
from qualitylens.session import table


def op1_quality(spark, sf_dir):
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_mixing(spark, sf_dir):
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_embedding_dedup(spark, sf_dir):
    """Links and group of every vector."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark, sf_dir):
    """Host, path, rule and verdict of every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark, sf_dir):
    """Every document's text without the lines that recur elsewhere."""
    return line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_chat(spark, sf_dir):
    """Recovered role and rendering of every turn."""
    turns = table(spark, sf_dir, "conversations")
    return chat.decode(turns, chat.train(turns))


def op8_toxicity(spark, sf_dir):
    """Category probabilities and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.train(docs, toxicity.category_labels(table(spark, sf_dir, "labels"))))


def op9_packing(spark, sf_dir):
    """Pieces of all documents, packed into sequences of 2048 ids."""
    return packing.with_crc(packing.pack(table(spark, sf_dir, "documents")))


def op10_license_scan(spark, sf_dir):
    """The licence of every document. The table has no paths: documents are
    filed by source, language and hundreds of ids, and those of up to 40 words
    under a notice's name, so that one with a notice licenses its folder."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(word_count(F.col("text")) <= 40, F.concat(F.lit("NOTICE-"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    path = F.concat_ws("/", "source", "lang", F.expr("doc_id div 100").cast("string"), name)
    return license_scan.scan(docs.select("doc_id", path.alias("path"), "text"))


def op11_importance(spark, sf_dir):
    """Weight, score and place in the draw of every document."""
    rows = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_preference(spark, sf_dir):
    """Score and verdict of every document, learnt from preference pairs."""
    return preference.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling(spark, sf_dir):
    """Neighbours, form and root of every word."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat": op7_chat,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_license_scan": op10_license_scan,
    "op11_importance": op11_importance,
    "op12_preference": op12_preference,
    "op13_spelling": op13_spelling,
}

ORACLES = {
    "op6_line_dedup": line_dedup.ORACLE,
    "op3_mixing": mixing.MIXING_ORACLE,
    "op11_importance": importance.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
