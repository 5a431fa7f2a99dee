"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from ..storage import materialize
from . import canon, encode, fusion, neardup, neighbours, ocr, packing, split, topn

SCORES = ["similarity", "bm25_score", "fusion_score", "reranker_score"]
TOP = 5
AGREEMENT = 0.75
LEAST_WORDS = 20
NEIGHBOURS = 5
CLOSE = 0.80


def _same_passage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    members = materialize(neardup.bags(table(spark, d, "chunks"), "chunk_id", "text", "search_vector", LEAST_WORDS))
    classes = neardup.classes_of(members)
    return neardup.membership(members, classes), neardup.class_links(classes, AGREEMENT)


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with the group of chunks that tell the same passage."""
    own, links = _same_passage(spark, d)
    return neardup.groups(table(spark, d, "chunks"), "chunk_id", own, links)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    own, links = _same_passage(spark, d)
    return neardup.expand_pairs(own, links).select(F.col("key_a").alias("chunk_a"), F.col("key_b").alias("chunk_b"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every node's text in pieces within the limits of its configuration."""
    rows = table(spark, d, "chunk_config").collect()  # the fixed table of three rows
    limits = {r["config_id"]: split.Limits(r["hard_max_tokens"], r["overlap_tokens"], r["embedding_max_tokens"]) for r in rows}
    return split.split_rows(table(spark, d, "structure_nodes"), ["document_id", "ordinal"], "context_prefix", "text", "built_at", "config_id", limits, "default")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("oversized and piece = 0").select("document_id", "ordinal")


def p3_top_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks of every query, ranked."""
    scores = topn.latest_scores(table(spark, d, "semantic_results"), "query_id", "chunk_id", "similarity", "scored_at")
    return topn.top_n_by_bisection(scores, TOP).select(F.col("g").alias("query_id"), F.col("i").alias("chunk_id"), F.col("s").alias("similarity"), "rank")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_top_chunks(spark, d).select("query_id", "chunk_id")


def _nearest(spark: SparkSession, d: str, least: float | None) -> DataFrame:
    active = table(spark, d, "index_config").where("is_active").select("embedding_model", "dimension").first()  # the fixed table of two rows
    rows = table(spark, d, "chunk_vectors").where(F.col("embedding_model") == active["embedding_model"])
    return neighbours.nearest_vectors(rows, "chunk_id", "embedding", active["dimension"], NEIGHBOURS, least)


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar other vectors of every usable vector."""
    return _nearest(spark, d, None).select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), "similarity", "rank")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(_nearest(spark, d, CLOSE)).select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.latest_candidates(table(spark, d, "hybrid_results"), "query_id", "chunk_id", SCORES, "scored_at")
    return fusion.ideal_point_ranking(rows, len(SCORES))


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of every query, ranked by all four scores alike."""
    return _ranking(spark, d).select(F.col("g").alias("query_id"), F.col("i").alias("chunk_id"), "closeness", "rank")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The candidates that head their query's ranking and are among its first three by every score."""
    return fusion.leaders(_ranking(spark, d), len(SCORES)).select(F.col("g").alias("query_id"), F.col("i").alias("chunk_id"))


def _repair(spark: SparkSession, d: str) -> ocr.Repair:
    return ocr.Repair(table(spark, d, "doc_pages"), "document_id", "page_number", "raw_text", "extracted_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _repair(spark, d).found().select(F.col("doc").alias("document_id"), F.col("page").alias("page_number"), "kind", "item")


def p6_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page's repaired text; ``continues`` tells that its last paragraph goes on on the next page."""
    return _repair(spark, d).texts().select(F.col("doc").alias("document_id"), F.col("page").alias("page_number"), "text", "continues")


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document as continuous paragraphs, one row each, numbered from 1; one that goes on over pages is whole."""
    pages = p6_pages(spark, d).where("text <> ''")
    order = Window.partitionBy("document_id").orderBy("page_number")
    joined = F.coalesce(F.lag("continues").over(order), F.lit(False)).cast("int")
    numbered = pages.withColumns({"parts": F.split("text", "\n\n"), "joined": joined}).withColumn("before", F.coalesce(F.sum(F.size("parts") - F.col("joined")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = numbered.select("document_id", "page_number", "before", "joined", F.posexplode("parts").alias("pos", "part")).withColumn("paragraph", F.col("before") + F.col("pos") + 1 - F.col("joined"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "part"))), lambda p: p["part"]), " ")  # the pages of one paragraph
    return parts.groupBy("document_id", "paragraph").agg(F.min("page_number").alias("first_page"), whole.alias("text"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_table(table(spark, d, "documents"), "doc_id", "text", encode.vocabulary_path())


def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container under each capacity of pack_config."""
    counts = encode.encode_table(table(spark, d, "documents"), "doc_id", "text", encode.vocabulary_path(), count_only=True)
    capacities = {r["pack_id"]: r["capacity_tokens"] for r in table(spark, d, "pack_config").collect()}  # the fixed table of three rows
    return packing.pack_all(counts, "doc_id", "n_tokens", capacities).select("pack_id", "bin_id", "doc_id", "piece", "first_token", "n_tokens")


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its one consistent form."""
    return canon.canonical_text(table(spark, d, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "canonical")


def p9_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the class of documents that look the same."""
    forms = canon.canonical_text(table(spark, d, "documents"), "doc_id", "text")
    return canon.same_looking_groups(forms).withColumnRenamed("key", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    forms = canon.canonical_text(table(spark, d, "documents"), "doc_id", "text")
    return canon.same_looking_pairs(forms).select(F.col("key_a").alias("doc_a"), F.col("key_b").alias("doc_b"))


def queries() -> dict:
    """All pN_ queries by name."""
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_pieces, p3_found, p3_top_chunks, p4_found, p4_neighbours, p5_found, p5_ranking, p6_found, p6_pages, p6_documents, p7_ids, p8_bins, p9_found, p9_groups, p9_canonical)}
