"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.encode import count_tokens, decode_ids, encode_corpus
from tracewell.llm.listings import product_keys, same_product_pairs
from tracewell.llm.lookalikes import consistent_forms
from tracewell.llm.neighbours import measured_recall, mutual_pairs, nearest_neighbours
from tracewell.llm.packing import fill_containers
from tracewell.llm.split import split_by_tokens, split_items
from tracewell.llm.subjects import document_subjects, label_agreement, sentence_subjects, topic_table
from tracewell.sources import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "kec_chunks")
    pieces = split_items(chunks, "text", ["collection", "chunk_id", "clause"])
    return pieces.where("n_pieces > 1").select("collection", "chunk_id").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "kec_chunks")
    return split_items(chunks, "text", ["collection", "chunk_id", "clause"], oversized_only=True)


def p3_token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk in pieces of at most 384 tokens of byte_bpe_50k, each after the first with 48 tokens of the one before."""
    chunks = table(spark, sf_dir, "kec_chunks")
    return split_by_tokens(chunks, "text", ["collection", "chunk_id", "clause"], 384, 48)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_product_pairs(product_keys(table(spark, sf_dir, "material_knowledge_metadata")))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decided listing with its product's key."""
    return product_keys(table(spark, sf_dir, "material_knowledge_metadata")).select("listing_id", "product")


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar chunks of the same collection, of every chunk."""
    return nearest_neighbours(table(spark, sf_dir, "kec_chunks"), "chunk_seq", "collection", "embedding")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutual_pairs(p6_neighbours(spark, sf_dir), "chunk_seq")


def p6_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact neighbours that are found, by collection, for every chunk_seq divisible by 100 against all rows."""
    return measured_recall(table(spark, sf_dir, "kec_chunks"), "chunk_seq", "collection", "embedding")


def _forms(spark: SparkSession, sf_dir: str, forms: bool) -> DataFrame:
    catalogue, chunks = "material_knowledge_metadata", "kec_chunks"
    return consistent_forms(table(spark, sf_dir, catalogue), catalogue, "listing_id", ["name", "specification"], forms).unionByName(
        consistent_forms(table(spark, sf_dir, chunks), chunks, "chunk_seq", ["text"], forms)
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, False).where("disguised").select("table_name", "field_name", "row_key").distinct()


def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form and its comparison key (as a hash of the whole text) for every value."""
    rows = _forms(spark, sf_dir, True)
    return rows.select("table_name", "field_name", "row_key", "disguised", "form", F.xxhash64("form_key").alias("key_hash")).dropDuplicates(
        ["table_name", "field_name", "row_key"]
    )


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded texts of all documents, with the number of tokens."""
    ids = encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")
    return ids.select("doc_id", decode_ids("ids").alias("text"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with text in containers of 2,048 tokens: one row for each container it lies in."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", count_tokens("text").alias("n_tokens"))
    return fill_containers(docs, "doc_id", "n_tokens")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the least number possible, and the share of their space that is used."""
    fills = p9_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("size").alias("fill"))
    used = fills.agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"))
    return used.select("containers", F.ceil(F.col("tokens") / 2048).alias("least_possible"), (F.col("tokens") / (F.col("containers") * 2048)).alias("used_share"))


def _subject_inputs(spark: SparkSession, sf_dir: str) -> tuple:
    return table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "subject_areas"), table(spark, sf_dir, "subject_labels")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(*_subject_inputs(spark, sf_dir))


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences of each document treat each subject, and any."""
    return sentence_subjects(*_subject_inputs(spark, sf_dir))


def p10_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand labels of each subject, and how many of them the subjects found agree with."""
    _, key, _, areas, labels = _subject_inputs(spark, sf_dir)
    return label_agreement(p10_found(spark, sf_dir), key, areas, labels)


def p10_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted topics with their top terms and the subject they are mapped to."""
    return topic_table(*_subject_inputs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p3_found, p3_pieces, p3_token_pieces, p5_found, p5_groups, p6_found, p6_neighbours, p6_recall, p7_found, p7_forms, p8_ids, p8_roundtrip, p9_containers, p9_fill, p10_found, p10_sentences, p10_agreement, p10_topics)}

SQL = {
    "p3_found": "SELECT DISTINCT collection, chunk_id FROM kec_chunks WHERE length(text) > 1200",
    "p8_roundtrip": "SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents",
}
