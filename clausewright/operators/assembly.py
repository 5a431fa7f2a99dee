"""Composed texts, metadata checks, product mapping, merged branches, answers, embedding in batches and graph lookups."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

if TYPE_CHECKING:
    from ..sources.protocols import Embedder


def filled(c: str | Column) -> Column:
    """A text, or null if it is blank."""
    return F.when(F.trim(c) != "", F.col(c) if isinstance(c, str) else c)


def searchable_text(*columns: str) -> Column:
    """The columns' texts that are not blank, each once, in order, a line each."""
    return F.array_join(F.array_distinct(F.filter(F.array(*columns), lambda x: x.isNotNull() & (F.trim(x) != ""))), "\n")


def verify_metadata(claims: DataFrame, pages: DataFrame, products: DataFrame) -> DataFrame:
    """What the pages of each document say against what is claimed of it.

    ``claims``: document_id, standards, product, title, kind (one row a
    document). ``pages``: document_id, page_number, text. ``products``:
    product. Detected standards are those of the title and the first page, and
    claimed ones anywhere; the detected product is named on most pages.
    Result: document_id, detected_standards, detected_product, detected_kind,
    conflicts, status (verified or needs_review).
    """
    first = pages.groupBy("document_id").agg(F.min_by("text", "page_number").alias("first"))
    found = pages.select("document_id", F.explode(T.standards_in(F.col("text"))).alias("s")).groupBy("document_id").agg(F.collect_set("s").alias("found"))  # the standards a document cites
    tokens = pages.select("document_id", "page_number", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("product"))
    named = tokens.join(products.distinct(), "product").groupBy("document_id", "product").agg(F.count(F.lit(1)).alias("n"))
    main = named.groupBy("document_id").agg(F.max_by("product", F.struct("n", "product")).alias("detected_product"))
    rows = claims.join(first, "document_id", "left").join(found, "document_id", "left").join(main, "document_id", "left")
    none = F.array().cast("array<string>")
    claimed, everywhere = F.coalesce("standards", none), F.coalesce("found", none)
    strong = T.standards_in(F.concat_ws("\n", "title", "first"))
    rows = rows.withColumns({"claimed": claimed, "strong": strong, "detected": F.array_sort(F.array_union(strong, F.array_intersect(claimed, everywhere)))}).withColumn("detected_kind", T.first_hint(F.coalesce("first", F.lit(""))))
    some = lambda c: F.size(c) > 0
    specific = [k for k, _ in T.DOCUMENT_HINTS if k.startswith(("product_manual", "qco", "implementation", "extension"))]
    checks = {
        "standard_number_mismatch": (some("claimed") & some("detected") & ~F.arrays_overlap("claimed", "detected")) | (~some("claimed") & some("strong")),
        "product_mismatch": F.col("product") != F.col("detected_product"),
        "document_type_mismatch": F.col("detected_kind").isin(specific) & F.col("kind").isin(specific) & (F.col("kind") != F.col("detected_kind")),
    }
    conflicts = F.array_compact(F.array(*(F.when(c, n) for n, c in checks.items())))
    unsure = (some("claimed") & ~some("detected")) | (F.col("product").isNotNull() & F.col("detected_product").isNull())
    return rows.withColumn("conflicts", conflicts).select(
        "document_id", F.array_join("detected", ",").alias("detected_standards"), "detected_product", "detected_kind", F.array_join("conflicts", ",").alias("conflicts"),
        F.when(some("conflicts") | unsure, "needs_review").otherwise("verified").alias("status"),
    )


def content_words(text: Column) -> Column:
    """Distinct lower-case words of more than two characters that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(T.PATTERNS["alnum"]), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*T.STOP_WORDS)))


def map_products(queries: DataFrame, rules: DataFrame, standards: DataFrame, most: int = 5) -> DataFrame:
    """Candidate standards of each query: query_id, product, ambiguous, standard, basis, overlap, rank.

    ``rules``: word, product. ``standards``: product, standard, title. A
    standard named in the query counts alone; else the standards of its
    product, by how many of its words their titles hold (none only if it is
    the only one). A query with neither and one word at most is ambiguous; it
    and one without candidates has one row without a standard.
    """
    asked = F.coalesce("query", F.lit(""))
    q = queries.select("query_id", content_words(asked).alias("words"), T.standards_in(asked).alias("asked"))
    hit = q.select("query_id", F.explode("words").alias("word")).join(rules, "word").groupBy("query_id").agg(F.min("product").alias("product"))
    q = q.join(hit, "query_id", "left")
    exact = q.select("query_id", F.explode("asked").alias("standard")).distinct().join(standards.select("standard").distinct(), "standard").select("query_id", "standard", F.lit("number").alias("basis"), F.lit(0).alias("overlap"))
    by = q.where(F.size("asked") == 0).join(standards.distinct(), "product")
    overlap = F.size(F.filter("words", lambda w: F.contains(F.lower(F.coalesce("title", F.lit(""))), w)))
    scored = by.groupBy("query_id", "standard").agg(F.max(overlap).alias("overlap")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    found = exact.unionByName(scored.where("overlap > 0 or n = 1").select("query_id", "standard", F.lit("product").alias("basis"), "overlap"))
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "standard")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    ambiguous = F.col("product").isNull() & (F.size("asked") == 0) & (F.size("words") <= 1)
    return q.select("query_id", "product", ambiguous.alias("ambiguous")).join(best, "query_id", "left")


def merge_branches(branches: dict[str, DataFrame], least: float, most: int) -> DataFrame:
    """Rows (query_id, key, score) of several searches, each once with its best score and the search it is from.

    Scores under ``least`` are dropped, ``most`` rows a query are kept and
    scores are cut at 1.5 and rounded to 4 decimals.
    """
    every = None
    for name, df in branches.items():
        one = df.select("query_id", "key", "score", F.lit(name).alias("source"))
        every = one if every is None else every.unionByName(one)
    best = every.where("score is not null and not isnan(score)").groupBy("query_id", "key").agg(F.max(F.struct("score", "source")).alias("b")).select("query_id", "key", "b.score", "b.source")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    ranked = best.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.withColumn("score", F.round(F.least("score", F.lit(1.5)), 4))


def assemble_answers(evidence: DataFrame, excerpts: int = 5, length: int = 300) -> DataFrame:
    """One row per query from its included evidence (query_id, place, chunk_id, standard, clause, text, included).

    citations: E1:chunk, ... in order of place; sections: standards cited;
    answer: the first ``excerpts`` texts under their headings; testing and
    certification: excerpts that speak of them; guarded: the answer names no
    standard that its evidence does not stand for. A budget bounds what is
    gathered of a query.
    """
    e = evidence.where("included").withColumn("excerpt", F.substring(F.coalesce("text", F.lit("")), 1, length))
    heading = F.concat(F.lit("["), F.concat_ws(" · clause ", F.coalesce("standard", F.lit("")), "clause"), F.lit("] "), "excerpt")
    part = F.when((F.col("place") <= excerpts) & (F.trim("excerpt") != ""), heading)
    low = F.lower("excerpt")
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct("place", c.alias("c"))))), lambda p: p["c"]), "\n\n")
    rows = e.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "chunk_id"))), lambda p: F.concat(F.lit("E"), p["place"].cast("string"), F.lit(":"), p["chunk_id"])), ",").alias("citations"),
        F.countDistinct("standard").alias("sections"), joined(part).alias("answer"),
        F.count_if(F.contains(low, F.lit("test"))).alias("testing"), F.count_if(low.rlike("certification|licence|license|standard mark")).alias("certification"),
        F.collect_set("standard").alias("allowed"),
    )
    named = F.filter(T.standards_in(F.col("answer")), lambda s: ~F.array_contains("allowed", s))
    return rows.withColumn("guarded", F.size(named) == 0).drop("allowed")


def embed_batches(df: DataFrame, key: str, text: str, embedder: Embedder, size: int = 32) -> DataFrame:
    """(key, vector, problem) of every row: texts go to the embedder ``size`` at a time.

    A batch that fails is tried again row by row; a row that fails alone has
    no vector and its error's name. Vectors of wrong length are failures.
    """
    kind = df.schema[key].dataType.simpleString()

    def one(texts: list[str]) -> list[list[float]]:
        found = embedder.embed(texts)
        if len(found) != len(texts) or any(len(v) != embedder.dimension for v in found):
            raise ValueError("vectors do not fit")
        return found

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            rows = list(frame.itertuples(index=False, name=None))
            for at in range(0, len(rows), size):
                some = rows[at : at + size]
                try:
                    out += [(k, v, None) for (k, _), v in zip(some, one([t for _, t in some]), strict=True)]
                except Exception:
                    for k, t in some:
                        try:
                            out.append((k, one([t])[0], None))
                        except Exception as e:
                            out.append((k, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["key", "vector", "problem"])

    return df.select(key, text).mapInPandas(run, f"key {kind}, vector array<float>, problem string")


class Graph:
    """Lookups over merged edges (source_type, source_id, relation, target_type, target_id, status).

    Ids of a lookup are a column of a table, so one id or millions are the
    same join.
    """

    def __init__(self, edges: DataFrame) -> None:
        self.edges = edges

    def entities(self, kind: str) -> DataFrame:
        """Ids of one type on either side."""
        at = lambda side: self.edges.where(F.col(f"{side}_type") == kind).select(F.col(f"{side}_id").alias("id"))
        return at("source").unionByName(at("target")).distinct()

    def targets(self, ids: DataFrame, relation: str) -> DataFrame:
        """(id, target_id) over a relation."""
        return ids.join(self.edges.where(F.col("relation") == relation), F.col("id") == F.col("source_id")).select("id", "target_id").distinct()

    def sources(self, ids: DataFrame, relation: str) -> DataFrame:
        """(id, source_id) against a relation."""
        return ids.join(self.edges.where(F.col("relation") == relation), F.col("id") == F.col("target_id")).select("id", "source_id").distinct()

    def documents_for_standard(self, ids: DataFrame) -> DataFrame:
        return self.sources(ids, "USES_STANDARD").withColumnRenamed("source_id", "document_id")

    def documents_for_product(self, ids: DataFrame) -> DataFrame:
        return self.targets(ids, "HAS_DOCUMENT").withColumnRenamed("target_id", "document_id")

    def standards_for_document(self, ids: DataFrame) -> DataFrame:
        return self.targets(ids, "USES_STANDARD").withColumnRenamed("target_id", "standard")

    def standards_for_product(self, ids: DataFrame) -> DataFrame:
        documents = self.documents_for_product(ids)
        return documents.join(self.standards_for_document(documents.select(F.col("document_id").alias("id")).distinct()).withColumnRenamed("id", "document_id"), "document_id").select("id", "standard").distinct()

    def units(self, ids: DataFrame) -> DataFrame:
        return self.targets(ids, "HAS_STRUCTURAL_UNIT").withColumnRenamed("target_id", "unit_id")

    def chunks(self, ids: DataFrame) -> DataFrame:
        return self.targets(ids, "HAS_CHUNK").withColumnRenamed("target_id", "chunk_id")

    def laboratories_for_standard(self, ids: DataFrame) -> DataFrame:
        return self.targets(ids, "HAS_LABORATORY").withColumnRenamed("target_id", "laboratory_id")

    def tests_for_standard(self, ids: DataFrame) -> DataFrame:
        return self.targets(ids, "HAS_TESTING_REQUIREMENT").withColumnRenamed("target_id", "test_id")

    def relationships(self, ids: DataFrame, kind: str) -> DataFrame:
        """All edges of entities of a type, with the side they are on."""
        side = lambda s: ids.join(self.edges.where(F.col(f"{s}_type") == kind), F.col("id") == F.col(f"{s}_id")).select("id", F.lit(s).alias("side"), *self.edges.columns)
        return side("source").unionByName(side("target"))

    def related_documents(self, ids: DataFrame, kind: str) -> DataFrame:
        """(id, document_id): documents on the other end of an entity's edges, the entity itself if it is one."""
        near = self.relationships(ids, kind)
        other = near.select("id", F.when(F.col("side") == "source", F.col("target_type")).otherwise(F.col("source_type")).alias("t"), F.when(F.col("side") == "source", F.col("target_id")).otherwise(F.col("source_id")).alias("document_id"))
        found = other.where("t = 'document'").select("id", "document_id")
        return (found.unionByName(near.select("id", F.col("id").alias("document_id"))) if kind == "document" else found).distinct()
