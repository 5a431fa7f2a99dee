"""Queries of the sources: placed words, pages, crawls, snapshots and record parsing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..sources import connectors as K
from ..sources import pages as P
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WORDS = """SELECT chunk_id, w AS word, CAST(p % 8 AS DOUBLE) * 50 AS x0, CAST(p // 8 AS DOUBLE) * 12 + (p % 3) * 0.1 AS bottom FROM (SELECT chunk_id, unnest(range(len(l))) AS p, unnest(l) AS w FROM (SELECT chunk_id, string_split(max(text), ' ') AS l FROM chunks WHERE text IS NOT NULL GROUP BY 1))"""


def words(s: SparkSession, d: str) -> DataFrame:
    texts = table(s, d, "chunks").where("text is not null").groupBy("chunk_id").agg(F.max("text").alias("text"))
    w = texts.select("chunk_id", F.posexplode(F.split("text", " ")).alias("p", "word"))
    return w.select("chunk_id", "word", ((F.col("p") % 8).cast("double") * 50).alias("x0"), (F.floor(F.col("p") / 8).cast("double") * 12 + (F.col("p") % 3) * F.lit(0.1)).alias("bottom"))


@query(f"""SELECT chunk_id, CAST(round(bottom) AS INTEGER) AS baseline, string_agg(word, ' ' ORDER BY x0, word) AS line FROM ({WORDS}) WHERE trim(word, ' ') <> '' GROUP BY 1, 2""")
def word_lines(s: SparkSession, d: str) -> DataFrame:
    return K.reconstruct_lines(words(s, d), ["chunk_id"])


@query(f"""SELECT chunk_id, round(stddev_pop(length(word)) / nullif(avg(length(word)), 0), 6) AS variation, coalesce(stddev_pop(length(word)) / nullif(avg(length(word)), 0) > 0.5, false) AS multi_column FROM ({WORDS}) GROUP BY 1""")
def multi_column(s: SparkSession, d: str) -> DataFrame:
    return K.multi_column(words(s, d).withColumn("width", F.length("word")), ["chunk_id"], "width")


LINKS = "SELECT DISTINCT document_id AS source, 'std:' || x AS target FROM (SELECT document_id, unnest(standard_numbers) AS x FROM manifest)"


@query(f"""WITH l AS MATERIALIZED ({LINKS} UNION SELECT target, source FROM ({LINKS})), s0 AS (SELECT min(document_id) AS node FROM manifest), s1 AS (SELECT DISTINCT target AS node FROM l JOIN s0 ON source = node WHERE target NOT IN (SELECT node FROM s0)),
s2 AS (SELECT DISTINCT target AS node FROM l JOIN s1 ON source = node WHERE target NOT IN (SELECT node FROM s0 UNION SELECT node FROM s1)) SELECT node, 0 AS depth FROM s0 UNION ALL SELECT node, 1 FROM s1 UNION ALL SELECT node, 2 FROM s2""")
def crawl_frontier(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "manifest")
    there = m.select(F.col("document_id").alias("source"), F.explode("standard_numbers").alias("x")).select("source", F.concat(F.lit("std:"), "x").alias("target")).distinct()
    links = there.unionByName(there.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return K.frontier(links, m.agg(F.min("document_id").alias("node")), 2)


@query("""WITH e AS (SELECT DISTINCT product_id AS k, organization AS v FROM manifest WHERE product_id IS NOT NULL AND http_status = 200), x AS (SELECT k, min(v) AS v FROM e GROUP BY 1), s AS (SELECT product_id AS k, min(organization) AS v FROM manifest WHERE product_id IS NOT NULL GROUP BY 1) SELECT k, v, 'stored' AS origin FROM x UNION ALL SELECT k, v, 'seed' FROM s WHERE k NOT IN (SELECT k FROM x)""")
def seed_missing(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "manifest").where("product_id is not null")
    one = lambda df, o: df.groupBy(F.col("product_id").alias("k")).agg(F.min("organization").alias("v")).withColumn("origin", F.lit(o))
    return K.seed_missing(one(m.where("http_status = 200"), "stored"), one(m, "seed"), ["k"])


@query("""SELECT document_id, page_number, CASE WHEN extraction_quality IN ('LOW', 'EMPTY') AND length(trim(coalesce(other, ''), ' ')) > length(trim(coalesce(mine, ''), ' ')) THEN 'ocr' ELSE 'text' END AS source FROM (SELECT document_id, page_number, max(extraction_quality) AS extraction_quality, max(CASE WHEN extraction_method = 'pymupdf' THEN raw_text END) AS mine, max(CASE WHEN extraction_method = 'tesseract' THEN raw_text END) AS other FROM doc_pages GROUP BY 1, 2)""")
def ocr_choice(s: SparkSession, d: str) -> DataFrame:
    by = lambda m: F.max(F.when(F.col("extraction_method") == m, F.col("raw_text")))
    g = table(s, d, "doc_pages").groupBy("document_id", "page_number").agg(F.max("extraction_quality").alias("q"), by("pymupdf").alias("mine"), by("tesseract").alias("other"))
    size = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    return g.select("document_id", "page_number", F.when(F.col("q").isin("LOW", "EMPTY") & (size("other") > size("mine")), "ocr").otherwise("text").alias("source"))


@query("""SELECT chunk_id, replace(replace(replace(replace(regexp_replace('<p>' || text || '</p><b>x</b>', '<[^>]*>', chr(10), 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text FROM (SELECT chunk_id, max(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY 1)""")
def html_text(s: SparkSession, d: str) -> DataFrame:
    texts = table(s, d, "chunks").where("text is not null").groupBy("chunk_id").agg(F.max("text").alias("text"))
    return texts.select("chunk_id", T.strip_tags(F.concat(F.lit("<p>"), "text", F.lit("</p><b>x</b>"))).alias("text"))


def made_pages(s: SparkSession, d: str) -> DataFrame:
    """The manifest as HTML pages: one notice page per document."""
    m = C.latest_by(table(s, d, "manifest").select("document_id", "title", "document_type", "organization", "source_url", "standard_numbers", "retrieved_at", "discovered_at"), ["document_id"], ["retrieved_at", "discovered_at"])
    t, o, n = F.coalesce("title", F.lit("")), F.coalesce("organization", F.lit("")), F.array_join(F.coalesce("standard_numbers", F.array().cast("array<string>")), ", ")
    html = F.concat(F.lit("<html><head><title>"), t, F.lit("</title></head><body><h1>"), t, F.lit("</h1><p>Department of "), o, F.lit("</p><p>Effective from 12 March 2025 for "), n, F.lit('.</p><table><tr><th>Product</th></tr><tr><td>kettle</td></tr></table><a href="/more">more</a></body></html>'))
    return m.select("document_id", F.col("source_url").alias("url"), html.alias("html"), "document_type")


@query()
def html_extract(s: SparkSession, d: str) -> DataFrame:
    return P.page_texts(made_pages(s, d), "document_id", "url", "html")


@query()
def parse_sources(s: SparkSession, d: str) -> DataFrame:
    return P.parse_pages(made_pages(s, d), "document_id", "url", "html", "document_type")


@query("""SELECT product_id, document_id, lower(status) AS status FROM manifest WHERE product_id IS NOT NULL AND (retrieved_at >= TIMESTAMP '2025-10-01' OR product_id NOT IN (SELECT product_id FROM manifest WHERE product_id IS NOT NULL AND retrieved_at >= TIMESTAMP '2025-10-01')) GROUP BY ALL""")
def snapshot_replace(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "manifest").where("product_id is not null")
    fresh = m.where("retrieved_at >= timestamp_ntz '2025-10-01 00:00:00'")
    kept = m.join(fresh.select("product_id").distinct(), "product_id", "left_anti").select(*m.columns)
    return fresh.unionByName(kept).select("product_id", "document_id", F.lower("status").alias("status")).distinct()
