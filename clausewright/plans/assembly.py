"""Queries of composed texts, metadata checks, mapping, answers, gates and graph lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly as A
from ..operators import evidence as E
from ..sources.protocols import HashEmbedder
from ..sources.tables import table
from . import documents as PD
from . import retrieval as PR

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


STOPS = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
STANDARD = r"(?i)\bIS[\s\x0b]*:?[\s\x0b]*(\d{2,6})[\s\x0b]*[:(][\s\x0b]*(\d{4})"


def standards_sql(text: str) -> str:
    """SQL of the normalised standards of a text, each once, in order."""
    return f"(SELECT list_filter(l, lambda x, i: list_position(l, x) = i) FROM (SELECT list_transform(list_zip(regexp_extract_all({text}, '{STANDARD}', 1), regexp_extract_all({text}, '{STANDARD}', 2)), lambda p: 'IS ' || CAST(CAST(p[1] AS BIGINT) AS VARCHAR) || ':' || p[2]) AS l))"


PARTS = "[document_title, clause_number, clause_title, annex_identifier, text]"


@query(f"SELECT DISTINCT chunk_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10)) AS searchable FROM (SELECT chunk_id, list_filter({PARTS}, lambda x: x IS NOT NULL AND trim(x, ' ') <> '') AS l FROM chunks)")
def searchable_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", A.searchable_text("document_title", "clause_number", "clause_title", "annex_identifier", "text").alias("searchable")).distinct()


@query("""SELECT DISTINCT chunk_id, concat_ws(chr(10) || chr(10), CASE WHEN trim(context_prefix, ' ') <> '' THEN context_prefix END, CASE WHEN trim(text, ' ') <> '' THEN text END) AS embedding_text, concat_ws(chr(10), CASE WHEN trim(document_title, ' ') <> '' THEN document_title END, CASE WHEN trim(clause_title, ' ') <> '' THEN clause_title END, CASE WHEN trim(text, ' ') <> '' THEN text END) AS reranker_text FROM chunks""")
def model_texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", F.concat_ws("\n\n", A.filled("context_prefix"), A.filled("text")).alias("embedding_text"), F.concat_ws("\n", A.filled("document_title"), A.filled("clause_title"), A.filled("text")).alias("reranker_text")).distinct()


@query(f"""WITH claims AS (SELECT document_id, list_distinct(flatten(list(standard_numbers) FILTER (standard_numbers IS NOT NULL))) AS claimed, min(product_id) AS product, min(title) AS title, min(document_type) AS kind FROM manifest GROUP BY 1),
p AS ({PD.PAGES}), f AS (SELECT document_id, min_by(raw_text, page_number) AS first FROM p GROUP BY 1), a AS (SELECT document_id, list(DISTINCT s) AS found FROM (SELECT document_id, unnest({standards_sql("raw_text")}) AS s FROM p) GROUP BY 1),
m AS (SELECT document_id, max_by(product, (n, product)) AS detected_product FROM (SELECT document_id, product, count(*) AS n FROM (SELECT document_id, page_number, unnest(list_distinct(regexp_extract_all(lower(raw_text), '[a-z]+'))) AS product FROM p) JOIN (SELECT DISTINCT product_id AS product FROM manifest WHERE product_id IS NOT NULL) USING (product) GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT document_id, coalesce(claimed, []) AS claimed, product, kind, detected_product, coalesce(found, []) AS found, concat_ws(chr(10), title, first) AS head, {PD._hint_case("coalesce(first, '')")} AS detected_kind FROM claims LEFT JOIN f USING (document_id) LEFT JOIN a USING (document_id) LEFT JOIN m USING (document_id)),
t AS (SELECT *, {standards_sql("head")} AS strong FROM r), d AS (SELECT *, list_sort(list_distinct(list_concat(strong, list_filter(claimed, lambda x: list_contains(found, x))))) AS detected FROM t),
c AS (SELECT *, list_filter([CASE WHEN len(claimed) > 0 AND len(detected) > 0 AND NOT list_has_any(claimed, detected) OR len(claimed) = 0 AND len(strong) > 0 THEN 'standard_number_mismatch' END, CASE WHEN product <> detected_product THEN 'product_mismatch' END,
CASE WHEN detected_kind IN ('qco_amendment', 'qco', 'implementation_circular', 'extension_order', 'product_manual') AND kind IN ('qco_amendment', 'qco', 'implementation_circular', 'extension_order', 'product_manual') AND kind <> detected_kind THEN 'document_type_mismatch' END], lambda x: x IS NOT NULL) AS conflicts FROM d)
SELECT document_id, array_to_string(detected, ',') AS detected_standards, detected_product, detected_kind, array_to_string(conflicts, ',') AS conflicts, CASE WHEN len(conflicts) > 0 OR len(claimed) > 0 AND len(detected) = 0 OR product IS NOT NULL AND detected_product IS NULL THEN 'needs_review' ELSE 'verified' END AS status FROM c""")
def metadata_verification(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "manifest")
    claims = m.groupBy("document_id").agg(F.array_distinct(F.flatten(F.collect_set("standard_numbers"))).alias("standards"), F.min("product_id").alias("product"), F.min("title").alias("title"), F.min("document_type").alias("kind"))
    products = m.where("product_id is not null").select(F.col("product_id").alias("product")).distinct()
    return A.verify_metadata(claims, PD.pages(s, d).withColumnRenamed("raw_text", "text"), products)


CONTENT = f"list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN {STOPS}))"
OFFERED = "SELECT DISTINCT product_id AS product, standard, title FROM (SELECT product_id, title, unnest(standard_numbers) AS standard FROM manifest WHERE product_id IS NOT NULL)"


@query(f"""WITH q AS (SELECT query_id, {CONTENT} AS words, {standards_sql("query")} AS asked FROM {PR.EVERY}), h AS (SELECT query_id, min(w) AS product FROM (SELECT query_id, unnest(words) AS w FROM q) WHERE w IN (SELECT product_id FROM manifest) GROUP BY 1),
p AS (SELECT * FROM q LEFT JOIN h USING (query_id)), o AS ({OFFERED}), e AS (SELECT DISTINCT query_id, standard, 'number' AS basis, 0 AS overlap FROM (SELECT query_id, unnest(asked) AS standard FROM p) JOIN (SELECT DISTINCT standard FROM o) USING (standard)),
b AS (SELECT query_id, standard, max(len(list_filter(words, lambda w: contains(lower(coalesce(title, '')), w)))) AS overlap FROM p JOIN o USING (product) WHERE len(asked) = 0 GROUP BY 1, 2), n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM b),
f AS (SELECT * FROM e UNION ALL SELECT query_id, standard, 'product', overlap FROM n WHERE overlap > 0 OR n = 1), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, standard) AS INTEGER) AS rank FROM f)
SELECT query_id, product, product IS NULL AND len(asked) = 0 AND len(words) <= 1 AS ambiguous, standard, basis, CAST(overlap AS INTEGER) AS overlap, rank FROM p LEFT JOIN (SELECT * FROM r WHERE rank <= 5) USING (query_id)""")
def product_mapping(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "manifest").where("product_id is not null")
    rules = m.select(F.col("product_id").alias("word"), F.col("product_id").alias("product")).distinct()
    offered = m.select(F.col("product_id").alias("product"), F.explode("standard_numbers").alias("standard"), "title").distinct()
    return A.map_products(PR.every_query(s, d), rules, offered)


@query("""WITH e AS (SELECT query_id, chunk_id AS key, similarity AS score, 'vector' AS source FROM semantic_results UNION ALL SELECT query_id, chunk_id, fusion_score, 'fused' FROM hybrid_results),
b AS (SELECT query_id, key, max(score) AS score, max_by(source, (score, source)) AS source FROM e WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM b WHERE score >= 0.05),
c AS (SELECT chunk_id AS key, min(document_title) AS title, min(source_url) AS url FROM chunks GROUP BY 1) SELECT query_id, key, CAST(round(CAST(CAST(least(score, 1.5) AS VARCHAR) AS DECIMAL(30, 15)), 4) AS DOUBLE) AS score, source, rank, title, url FROM r LEFT JOIN c USING (key) WHERE rank <= 20""")
def backend_hybrid(s: SparkSession, d: str) -> DataFrame:
    key = F.col("chunk_id").alias("key")
    branches = {"vector": table(s, d, "semantic_results").select("query_id", key, F.col("similarity").alias("score")), "fused": table(s, d, "hybrid_results").select("query_id", key, F.col("fusion_score").alias("score"))}
    chunks = table(s, d, "chunks").groupBy(key).agg(F.min("document_title").alias("title"), F.min("source_url").alias("url"))
    return A.merge_branches(branches, 0.05, 20).join(chunks, "key", "left")


ANSWERED = f"""SELECT query_id, chunk_id, place, standard, clause, substr(coalesce(text, ''), 1, 300) AS excerpt FROM ({PR.BUDGET}) JOIN (SELECT chunk_id, min(standard_numbers)[1] AS standard, max(text) AS text, min(clause_number) AS clause FROM chunks GROUP BY 1) USING (chunk_id) WHERE included"""
ASSEMBLED = f"""SELECT query_id, string_agg('E' || place || ':' || chunk_id, ',' ORDER BY place) AS citations, count(DISTINCT standard) AS sections,
coalesce(string_agg(CASE WHEN place <= 5 AND trim(excerpt, ' ') <> '' THEN '[' || concat_ws(' · clause ', coalesce(standard, ''), clause) || '] ' || excerpt END, chr(10) || chr(10) ORDER BY place), '') AS answer,
count(CASE WHEN contains(lower(excerpt), 'test') THEN 1 END) AS testing, count(CASE WHEN regexp_matches(lower(excerpt), 'certification|licence|license|standard mark') THEN 1 END) AS certification, list(DISTINCT standard) FILTER (standard IS NOT NULL) AS allowed FROM ({ANSWERED}) GROUP BY 1"""


@query(f"""SELECT query_id, citations, sections, answer, testing, certification, len(list_filter(named, lambda x: NOT coalesce(list_contains(allowed, x), false))) = 0 AS guarded FROM (SELECT *, {standards_sql("answer")} AS named FROM ({ASSEMBLED}))""")
def response_assembly(s: SparkSession, d: str) -> DataFrame:
    return A.assemble_answers(PR.packages(s, d).withColumnRenamed("standard_number", "standard"))


@query(f"""WITH n AS (SELECT document_id, count(DISTINCT ordinal) AS parsed FROM structure_nodes GROUP BY 1), c AS (SELECT document_id, count(DISTINCT clause_number) AS listed FROM chunks WHERE clause_number IS NOT NULL GROUP BY 1), l AS (SELECT document_id, count(*) AS scanned FROM ({PD.PAGE_LINES}) WHERE regexp_matches(line, '{PD.CLAUSE}') GROUP BY 1)
SELECT document_id, CASE WHEN parsed > 0 THEN 'parsed' WHEN listed > 0 THEN 'metadata' WHEN scanned > 0 THEN 'lines' ELSE 'none' END AS origin, coalesce(parsed, listed, scanned, 0) AS clauses FROM (SELECT DISTINCT document_id FROM manifest) LEFT JOIN n USING (document_id) LEFT JOIN c USING (document_id) LEFT JOIN l USING (document_id)""")
def clause_preference(s: SparkSession, d: str) -> DataFrame:
    parsed = table(s, d, "structure_nodes").groupBy("document_id").agg(F.countDistinct("ordinal").alias("parsed"))
    listed = table(s, d, "chunks").where("clause_number is not null").groupBy("document_id").agg(F.countDistinct("clause_number").alias("listed"))
    lines = PD.D.lines_of(PD.pages(s, d), ["document_id", "page_number"], "raw_text").where(F.col("line").rlike(T.PATTERNS["clause_line"])).groupBy("document_id").agg(F.count(F.lit(1)).alias("scanned"))
    rows = table(s, d, "manifest").select("document_id").distinct()
    for side in (parsed, listed, lines):
        rows = rows.join(side, "document_id", "left")
    origin = F.when(F.col("parsed") > 0, "parsed").when(F.col("listed") > 0, "metadata").when(F.col("scanned") > 0, "lines").otherwise("none")
    return rows.select("document_id", origin.alias("origin"), F.coalesce("parsed", "listed", "scanned", F.lit(0)).alias("clauses"))


@query("""WITH l AS (SELECT document_id, max_by(http_status, retrieved_at) AS http_status, max_by(file_size, retrieved_at) AS file_size, max_by(source_url, retrieved_at) AS url, max(retrieved_at) AS seen_at FROM manifest WHERE retrieved_at IS NOT NULL GROUP BY 1)
SELECT document_id, CASE WHEN http_status IS NULL OR http_status <> 200 THEN 'not_fetched' WHEN file_size IS NULL OR file_size < 100000 THEN 'too_small' WHEN first <> document_id THEN 'duplicate' ELSE 'validated' END AS outcome, CASE WHEN first <> document_id THEN first END AS duplicate_of FROM (SELECT *, first_value(document_id) OVER (PARTITION BY coalesce(regexp_extract(url, '^[a-z]+://([^/]+)', 1), ''), file_size // 50000 ORDER BY seen_at, document_id) AS first FROM l)""")
def download_outcomes(s: SparkSession, d: str) -> DataFrame:
    last = lambda c: F.max_by(c, "retrieved_at").alias(c)
    rows = table(s, d, "manifest").where("retrieved_at is not null").groupBy("document_id").agg(last("http_status"), last("file_size"), last("source_url"), F.max("retrieved_at").alias("at"))
    host = F.coalesce(F.regexp_extract("source_url", "^[a-z]+://([^/]+)", 1), F.lit(""))
    same = rows.withColumns({"host": host, "content": F.floor(F.col("file_size") / 50000)})  # stands for the content's digest
    first = same.groupBy("host", "content").agg(F.min(F.struct("at", "document_id")).alias("f")).select("host", "content", F.col("f.document_id").alias("first"))
    joined = same.join(first, same["host"].eqNullSafe(first["host"]) & same["content"].eqNullSafe(first["content"]))
    other = F.col("first") != F.col("document_id")
    outcome = F.when(F.coalesce(F.col("http_status") != 200, F.lit(True)), "not_fetched").when(F.coalesce(F.col("file_size") < 100000, F.lit(True)), "too_small").when(other, "duplicate").otherwise("validated")
    return joined.select("document_id", outcome.alias("outcome"), F.when(other, F.col("first")).alias("duplicate_of"))


@query("SELECT document_id, count(DISTINCT ordinal) AS units, min(ordinal) = min(ordinal) AND max(ordinal) - min(ordinal) + 1 = count(DISTINCT ordinal) AS contiguous, count(*) - count(DISTINCT ordinal) AS repeated FROM structure_nodes GROUP BY 1")
def unit_consistency(s: SparkSession, d: str) -> DataFrame:
    n = F.countDistinct("ordinal")
    return table(s, d, "structure_nodes").groupBy("document_id").agg(n.alias("units"), (F.max("ordinal") - F.min("ordinal") + 1 == n).alias("contiguous"), (F.count(F.lit(1)) - n).alias("repeated"))


LAB_EDGES = """SELECT 'standard' AS source_type, CAST(l_partkey AS VARCHAR) AS source_id, 'HAS_LABORATORY' AS relation, 'laboratory' AS target_type, CAST(l_suppkey AS VARCHAR) AS target_id, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS level FROM lineitem
UNION ALL SELECT 'standard', CAST(l_partkey AS VARCHAR), 'HAS_TESTING_REQUIREMENT', 'test', l_returnflag, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 2 END FROM lineitem"""


def lab_edge_rows(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem")
    edge = lambda relation, kind, target, weak: rows.select(F.lit("standard").alias("source_type"), F.col("l_partkey").cast("string").alias("source_id"), F.lit(relation).alias("relation"), F.lit(kind).alias("target_type"), target.cast("string").alias("target_id"), F.when(F.col("l_linestatus") == "F", "VERIFIED").otherwise(weak).alias("status"))
    both = edge("HAS_LABORATORY", "laboratory", F.col("l_suppkey"), "UNVERIFIED").unionByName(edge("HAS_TESTING_REQUIREMENT", "test", F.col("l_returnflag"), "REQUIRES_REVIEW"))
    keys = ["source_type", "source_id", "relation", "target_type", "target_id"]
    return both.groupBy(*keys).agg(E.highest_status(E.status_level(F.col("status"))).alias("status"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT source_type, source_id, relation, target_type, target_id, CASE max(level) WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'UNVERIFIED' ELSE 'REQUIRES_REVIEW' END AS status, count(*) AS n FROM ({LAB_EDGES}) GROUP BY ALL")
def laboratory_edges(s: SparkSession, d: str) -> DataFrame:
    return lab_edge_rows(s, d)


@query(f"SELECT DISTINCT source_id AS id, target_id AS laboratory_id FROM ({LAB_EDGES}) WHERE relation = 'HAS_LABORATORY' AND source_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size <= 5)")
def laboratories_for_standard(s: SparkSession, d: str) -> DataFrame:
    ids = table(s, d, "part").where("p_size <= 5").select(F.col("p_partkey").cast("string").alias("id"))
    return A.Graph(lab_edge_rows(s, d)).laboratories_for_standard(ids)


@query(f"""SELECT DISTINCT ti AS id, si AS document_id FROM ({PR.EDGES}) WHERE rel = 'USES_STANDARD'""")
def related_sources(s: SparkSession, d: str) -> DataFrame:
    g = A.Graph(PR.entity_edges(s, d))
    return g.related_documents(g.entities("standard"), "standard")


@query(f"""SELECT DISTINCT p.si AS id, u.ti AS standard FROM ({PR.EDGES}) p JOIN ({PR.EDGES}) u ON p.rel = 'HAS_DOCUMENT' AND u.rel = 'USES_STANDARD' AND p.ti = u.si""")
def standards_for_product(s: SparkSession, d: str) -> DataFrame:
    g = A.Graph(PR.entity_edges(s, d))
    return g.standards_for_product(g.entities("product"))


@query("""SELECT 'document' AS entity_type, document_id AS entity_id, min(title) AS label FROM manifest GROUP BY 2 UNION ALL SELECT 'product', product_id, min(title) FROM manifest WHERE product_id IS NOT NULL GROUP BY 2 UNION ALL SELECT 'standard', x, min(x) FROM (SELECT unnest(standard_numbers) AS x FROM manifest UNION ALL SELECT unnest(standard_numbers) FROM chunks) GROUP BY 2
UNION ALL SELECT 'unit', document_id || '#' || ordinal, min(title) FROM structure_nodes GROUP BY 2 UNION ALL SELECT 'laboratory', CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL SELECT 'test', l_returnflag, min(l_returnflag) FROM lineitem GROUP BY 2""")
def entity_tables(s: SparkSession, d: str) -> DataFrame:
    def kind(name: str, df: DataFrame, key, label) -> DataFrame:
        return df.select(key.cast("string").alias("entity_id"), label.alias("label")).where("entity_id is not null").groupBy("entity_id").agg(F.min("label").alias("label")).select(F.lit(name).alias("entity_type"), "entity_id", "label")

    m, c, n = table(s, d, "manifest"), table(s, d, "chunks"), table(s, d, "structure_nodes")
    numbers = m.select(F.explode("standard_numbers").alias("x")).union(c.select(F.explode("standard_numbers")))
    parts = [
        kind("document", m, F.col("document_id"), F.col("title")), kind("product", m, F.col("product_id"), F.col("title")), kind("standard", numbers, F.col("x"), F.col("x")),
        kind("unit", n, F.concat("document_id", F.lit("#"), F.col("ordinal").cast("string")), F.col("title")), kind("laboratory", table(s, d, "supplier"), F.col("s_suppkey"), F.col("s_name")),
        kind("test", table(s, d, "lineitem"), F.col("l_returnflag"), F.col("l_returnflag")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


@query(r"""SELECT DISTINCT chunk_id, regexp_extract_all(t, '\[E\d+\]|[^\[]+|\[') AS parts, len(regexp_extract_all(t, '\[E\d+\]')) AS citations FROM (SELECT chunk_id, 'Under ' || coalesce(clause_number, '[none]') || ' [E1] and [E23], see [x].' AS t FROM chunks)""")
def citation_split(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Under "), F.coalesce("clause_number", F.lit("[none]")), F.lit(" [E1] and [E23], see [x]."))
    return table(s, d, "chunks").select("chunk_id", T.citation_parts(text).alias("parts"), F.size(F.regexp_extract_all(text, F.lit(T.PATTERNS["citation"]), F.lit(0))).alias("citations")).distinct()


@query(r"""SELECT DISTINCT status AS given, CASE WHEN regexp_matches(lower(trim(status, ' ')), '^[a-z0-9_.-]{1,64}$') THEN lower(trim(status, ' ')) ELSE 'unknown_error' END AS token FROM (SELECT status FROM manifest UNION SELECT title FROM manifest)""")
def error_tokens(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "manifest")
    return m.select("status").union(m.select("title")).distinct().select(F.col("status").alias("given"), T.error_token(F.col("status")).alias("token"))


@query("""SELECT CASE WHEN text IS NULL OR text = '' THEN 'ValueError' ELSE 'none' END AS problem, count(*) AS n, count(CASE WHEN text <> '' THEN 1 END) AS vectors FROM documents GROUP BY 1""")
def embedding_failures(s: SparkSession, d: str) -> DataFrame:
    rows = A.embed_batches(table(s, d, "documents"), "doc_id", "text", HashEmbedder(64))
    return rows.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"), F.count("vector").alias("vectors"))


# Gates: named row predicates, written once for both engines; {len} is the size of an array.
GATES = {
    "cleaning_gates": ("doc_pages", {
        "document_known": "document_id IS NOT NULL", "page_from_one": "page_number >= 1", "text_present": "length(raw_text) > 0", "count_of_characters": "length(raw_text) = character_count_raw",
        "method_known": "extraction_method IN ('pymupdf', 'tesseract')", "quality_known": "extraction_quality IN ('GOOD', 'LOW', 'EMPTY')", "ocr_known": "ocr_required IS NOT NULL",
        "no_replacement_characters": "NOT contains(raw_text, '�')", "empty_marked": "length(raw_text) > 0 OR extraction_quality = 'EMPTY'", "time_known": "extracted_at IS NOT NULL",
    }),
    "structure_gates": ("structure_nodes", {
        "document_known": "document_id IS NOT NULL", "ordinal_from_zero": "ordinal >= 0", "parent_before": "parent_ordinal IS NULL OR parent_ordinal < ordinal", "type_known": "type IN ('front_matter', 'section', 'clause', 'subclause', 'annex', 'table', 'references')",
        "confidence_known": "confidence IN ('high', 'medium', 'low')", "pages_in_order": "start_page <= end_page", "first_page_listed": "array_contains(pages, start_page)", "last_page_listed": "array_contains(pages, end_page)",
        "numbered_has_number": "type NOT IN ('section', 'clause', 'subclause') OR number IS NOT NULL", "title_present": "length(title) > 0", "path_present": "{len}(path) > 0", "text_present": "length(text) > 0",
    }),
    "chunk_gates": ("chunks", {
        "id_of_24": "length(chunk_id) = 24", "document_known": "document_id IS NOT NULL", "title_present": "length(document_title) > 0", "organization_present": "length(organization) > 0", "standards_known": "standard_numbers IS NOT NULL",
        "pages_in_order": "start_page <= end_page", "first_page_listed": "array_contains(pages, start_page)", "url_secure": "source_url LIKE 'https://%'", "text_present": "length(text) > 0", "search_text_present": "length(search_vector) > 0",
        "prefix_present": "length(context_prefix) > 0", "one_place": "clause_number IS NULL OR annex_identifier IS NULL", "product_known": "product IS NOT NULL", "retrieved": "retrieved_at IS NOT NULL",
    }),
    "embedding_gates": ("chunk_vectors", {
        "id_known": "chunk_id IS NOT NULL", "vector_present": "embedding IS NOT NULL", "dimension_true": "{len}(embedding) = embedding_dimension", "dimension_active": "embedding_dimension = 96", "model_known": "embedding_model IS NOT NULL", "revision_known": "embedding_model_revision IS NOT NULL",
        "normalized_known": "normalized IS NOT NULL", "not_all_zero": "NOT array_contains(embedding, CAST(0 AS FLOAT))", "time_known": "embedded_at IS NOT NULL",
    }),
}


def _gate(name: str, source: str, checks: dict[str, str]) -> None:
    counts = ", ".join(f"count(CASE WHEN NOT coalesce({p.format(len='len')}, false) THEN 1 END)" for p in checks.values())
    names = ", ".join(f"'{n}'" for n in checks)

    def run(s: SparkSession, d: str) -> DataFrame:
        return E.gate_row(table(s, d, source), {n: F.expr(p.format(len="size")) for n, p in checks.items()})

    run.__name__ = name
    query(f"""SELECT "check", failures, failures = 0 AS passed FROM (SELECT unnest([{names}]) AS "check", unnest([{counts}]) AS failures FROM {source})""")(run)


for _name, (_source, _checks) in GATES.items():
    _gate(_name, _source, _checks)
