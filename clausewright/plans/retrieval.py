"""Queries of retrieval, evidence, evaluation and the entity graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import manyfold as M
from ..operators import retrieval as R
from ..sources.tables import table
from ..streaming import incremental as I

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


ASKED = (("a", "gasket hardness of sealed chillers"), ("b", "who may approve the datasheet"), ("c", "IS 90512:2011 clause 4.1"), ("d", "visible rusting after testing under IS 94410:1995"))
ASKED_SQL = "(VALUES " + ", ".join(f"('{i}', '{q}')" for i, q in ASKED) + ") AS asked(query_id, query)"
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[.:/-][a-z0-9]+)*')"


def asked(s: SparkSession) -> DataFrame:
    return s.createDataFrame(list(ASKED), "query_id string, query string")


def bm25_sql(docs: str, key: str, queries: str, k: int) -> str:
    """SQL of the ``k`` best texts per query."""
    tokens = f"SELECT {key} AS key, {TOKENS.format("coalesce(text, '')")} AS t FROM {docs}"
    return f"""WITH t AS ({tokens}), p AS (SELECT key, length, term, count(*) AS tf FROM (SELECT key, len(t) AS length, unnest(t) AS term FROM t) GROUP BY 1, 2, 3),
a AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS term FROM {queries}) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), c AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t),
s AS (SELECT query_id, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean)) * qtf), 6) AS score FROM p JOIN a USING (term) JOIN f USING (term), c GROUP BY 1, 2)
SELECT query_id, key, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""


@query(bm25_sql("documents", "doc_id", ASKED_SQL, 20))
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return R.bm25(table(s, d, "documents"), "doc_id", "text", asked(s))


UNIQUE = "(SELECT chunk_id, max(text) AS text FROM chunks GROUP BY 1)"
EVERY = "(SELECT query_id, min(query) AS query FROM semantic_results WHERE query IS NOT NULL GROUP BY 1)"


def chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").groupBy("chunk_id").agg(F.max("text").alias("text"))


def every_query(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "semantic_results").where("query is not null").groupBy("query_id").agg(F.min("query").alias("query"))


@query(bm25_sql(UNIQUE, "chunk_id", EVERY, 5))
def bm25_many(s: SparkSession, d: str) -> DataFrame:
    return R.bm25(chunks(s, d), "chunk_id", "text", every_query(s, d), 5)


KNN = """SELECT q.vec_id AS query_id, e.vec_id AS key, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q"""


def knn(s: SparkSession, d: str, vectors: DataFrame, k: int) -> DataFrame:
    asked_ = table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.exact_knn(vectors, "vec_id", "embedding", asked_, 64, k)


@query(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM ({KNN})) WHERE rank <= 10")
def knn_topk(s: SparkSession, d: str) -> DataFrame:
    return knn(s, d, table(s, d, "embeddings"), 10)


@query(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM ({KNN} WHERE e.label = 1)) WHERE rank <= 5")
def knn_filtered(s: SparkSession, d: str) -> DataFrame:
    return knn(s, d, table(s, d, "embeddings").where("label = 1"), 5)


@query("""SELECT count(*) AS vectors, round(max(abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1)), 4) AS deviation, max(abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1)) <= 1e-5 AS unit FROM embeddings""")
def norm_gate(s: SparkSession, d: str) -> DataFrame:
    return R.norm_evidence(table(s, d, "embeddings"), "embedding")


@query("""SELECT 'missing_vector' AS problem, count(*) AS n FROM chunk_vectors WHERE embedding IS NULL UNION ALL SELECT 'wrong_dimension', count(*) FROM chunk_vectors WHERE len(embedding) <> 96 UNION ALL SELECT 'not_finite', count(*) FROM chunk_vectors WHERE len(list_filter(embedding, lambda x: x IS NULL OR x::VARCHAR = 'nan')) > 0 UNION ALL SELECT 'all_zero', count(*) FROM chunk_vectors WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) = 0 UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT chunk_id FROM chunk_vectors GROUP BY 1 HAVING count(*) > 1)""")
def index_gate(s: SparkSession, d: str) -> DataFrame:
    return R.index_problems(table(s, d, "chunk_vectors"), "chunk_id", "embedding", 96)


RANKS = """SELECT query_id, chunk_id AS key, min(CASE WHEN semantic_rank > 0 THEN semantic_rank END) AS a, min(CASE WHEN bm25_rank > 0 THEN bm25_rank END) AS b FROM hybrid_results GROUP BY 1, 2"""


def fused(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "hybrid_results").groupBy("query_id", F.col("chunk_id").alias("key")).agg(*(F.min(F.when(F.col(f"{c}_rank") > 0, F.col(f"{c}_rank"))).alias(c) for c in ("semantic", "bm25")))
    return R.reciprocal_rank_fusion({c: h.where(F.col(c).isNotNull()).select("query_id", "key", F.col(c).alias("rank")) for c in ("semantic", "bm25")})


@query(f"""SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, key) AS INTEGER) AS fusion_rank FROM (SELECT query_id, key, a AS semantic_rank, b AS bm25_rank, round(coalesce(1.0::DOUBLE / (60 + a), 0) + coalesce(1.0::DOUBLE / (60 + b), 0), 8) AS fusion_score FROM ({RANKS}) WHERE a IS NOT NULL OR b IS NOT NULL)""")
def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    return fused(s, d)


@query("""SELECT doc_id, round(share, 6) AS share FROM (SELECT doc_id, (CAST(contains(lower(coalesce(text, '')), 'gasket') AS INTEGER) + CAST(contains(lower(coalesce(text, '')), 'hardness') AS INTEGER) + CAST(contains(lower(coalesce(text, '')), 'chillers') AS INTEGER)) / 3.0::DOUBLE AS share FROM documents) WHERE share > 0""")
def keyword_branch(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.round(R.term_hits(F.col("text"), "the gasket hardness of chillers"), 6).alias("share")).where("share > 0")


@query("""SELECT doc_id AS key, CAST(len(list_filter(t, lambda x: x IN ('gasket', 'after', 'testing'))) AS INTEGER) AS occurrences FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents) WHERE list_contains(t, 'gasket') AND list_contains(t, 'after') AND list_contains(t, 'testing')""")
def fts_and(s: SparkSession, d: str) -> DataFrame:
    return R.all_terms(table(s, d, "documents"), "doc_id", "text", "Gasket, after testing!")


@query("""WITH h AS (SELECT doc_id AS key, text, title, 2 AS depth, licence_class AS licence, 0.4 AS score FROM documents WHERE text ILIKE '%gasket%' ), r AS (SELECT key, round(least(0.4 + 0.05 * (CAST(contains(p, 'gasket') AS INTEGER) + CAST(contains(p, 'hardness') AS INTEGER)) + 0.03, 1.5), 6)::DOUBLE AS reranked FROM (SELECT key, lower(substr(coalesce(text, ''), 1, 500)) || ' ' || lower(coalesce(title, '')) AS p FROM h))
SELECT key, reranked, CAST(row_number() OVER (ORDER BY reranked DESC, key) AS INTEGER) AS rank FROM r ORDER BY reranked DESC, key LIMIT 100""")
def heuristic_rerank(s: SparkSession, d: str) -> DataFrame:
    hits = table(s, d, "documents").where(F.col("text").ilike("%gasket%")).select(F.col("doc_id").alias("key"), "text", "title", F.lit(2).alias("depth"), F.col("licence_class").alias("licence"), F.lit(0.4).alias("score"))
    return R.heuristic_rerank(hits, "gasket hardness").select("key", "reranked", "rank")


@query("""SELECT chunk_id, clause_number, x AS standard_number FROM (SELECT chunk_id, clause_number, unnest(standard_numbers) AS x FROM chunks) WHERE x = (SELECT min(y) FROM (SELECT unnest(standard_numbers) AS y FROM chunks)) GROUP BY ALL""")
def resolve_identifier(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks")
    first = c.select(F.explode("standard_numbers").alias("x")).agg(F.min("x")).first()[0]
    state, standard = R.resolve_identifier(c, "standard_numbers", f"What does {first} require?")
    hit = F.array_contains("standard_numbers", standard) if state == "pinned" else F.lit(False)
    return c.where(hit).select("chunk_id", "clause_number", F.lit(standard).alias("standard_number")).distinct()


@query("""SELECT query_id, chunk_id, coalesce(standard_numbers[1], NULL) AS standard_number, pages[1] AS page, round(rerank, 6) AS reranker_score, concat_ws('+', CASE WHEN a IS NOT NULL THEN 'semantic' END, CASE WHEN b IS NOT NULL THEN 'bm25' END) AS methods FROM (SELECT query_id, chunk_id, max(CASE WHEN reranker_score::VARCHAR <> 'nan' THEN reranker_score END) AS rerank, min(CASE WHEN semantic_rank > 0 THEN semantic_rank END) AS a, min(CASE WHEN bm25_rank > 0 THEN bm25_rank END) AS b FROM hybrid_results GROUP BY 1, 2) JOIN (SELECT chunk_id, min(standard_numbers) AS standard_numbers, min(pages) AS pages FROM chunks GROUP BY 1) USING (chunk_id)""")
def evidence_shape(s: SparkSession, d: str) -> DataFrame:
    return evidence(s, d).select("query_id", "chunk_id", "standard_number", "page", F.round("rerank", 6).alias("reranker_score"), F.concat_ws("+", F.when(F.col("a").isNotNull(), "semantic"), F.when(F.col("b").isNotNull(), "bm25")).alias("methods"))


def evidence(s: SparkSession, d: str) -> DataFrame:
    rank = lambda c: F.min(F.when(F.col(c) > 0, F.col(c)))
    h = table(s, d, "hybrid_results").groupBy("query_id", "chunk_id").agg(F.max(F.when(~F.isnan("reranker_score"), F.col("reranker_score"))).alias("rerank"), rank("semantic_rank").alias("a"), rank("bm25_rank").alias("b"))
    c = table(s, d, "chunks").groupBy("chunk_id").agg(F.min("standard_numbers").alias("standard_numbers"), F.min("pages").alias("pages"), F.max("text").alias("text"), F.min("clause_number").alias("clause"))
    return h.join(c, "chunk_id").withColumn("standard_number", F.get("standard_numbers", F.lit(0))).withColumn("page", F.get("pages", F.lit(0)))


BUDGET = """SELECT query_id, chunk_id, place, sum(length(coalesce(text, ''))) OVER (PARTITION BY query_id ORDER BY place) + 2 * (place - 1) <= 3000 AS included FROM (SELECT query_id, chunk_id, text, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC NULLS LAST, chunk_id) AS place FROM (SELECT query_id, chunk_id, max(CASE WHEN reranker_score::VARCHAR <> 'nan' THEN reranker_score END) AS rerank FROM hybrid_results GROUP BY 1, 2) JOIN (SELECT chunk_id, max(text) AS text FROM chunks GROUP BY 1) USING (chunk_id))"""


def packages(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), "chunk_id")
    return E.budgeted(evidence(s, d).withColumn("place", F.row_number().over(w)), "query_id", "place", "text", 3000)


@query(f"SELECT query_id, chunk_id, CAST(place AS INTEGER) AS place, included FROM ({BUDGET})")
def evidence_budget(s: SparkSession, d: str) -> DataFrame:
    return packages(s, d).select("query_id", "chunk_id", "place", "included")


@query()
def guard_state(s: SparkSession, d: str) -> DataFrame:
    queries = table(s, d, "hybrid_results").select("query_id").distinct().join(every_query(s, d), "query_id", "left")
    rows = packages(s, d).select("query_id", "text", F.col("standard_number").alias("standard"), "clause", F.col("rerank").alias("reranker_score"), F.col("b").isNotNull().alias("in_bm25"), F.col("a").isNotNull().alias("in_semantic"), "included")
    return E.sufficiency(rows, queries)


@query("""SELECT query_id, n, best, CASE WHEN n >= 3 AND best >= 0.55 AND std THEN 'high' WHEN n >= 2 AND best >= 0.35 THEN 'medium' WHEN n >= 1 THEN 'low' ELSE 'none' END AS confidence FROM (SELECT query_id, count(DISTINCT chunk_id) AS n, round(max(CASE WHEN similarity::VARCHAR <> 'nan' THEN similarity END), 6) AS best, bool_or(standard IS NOT NULL) AS std FROM semantic_results GROUP BY 1)""")
def confidence_case(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "semantic_results").groupBy("query_id").agg(F.countDistinct("chunk_id").alias("n"), F.round(F.max(F.when(~F.isnan("similarity"), F.col("similarity"))), 6).alias("best"), F.bool_or(F.col("standard").isNotNull()).alias("std"))
    return g.select("query_id", "n", "best", E.confidence(F.col("n"), F.coalesce("best", F.lit(-1.0)), F.col("std")).alias("confidence"))


@query("""SELECT query_id, chunk_id, scored_at FROM (SELECT DISTINCT query_id, chunk_id, scored_at FROM semantic_results) QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY scored_at) = 1""")
def first_occurrence(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "semantic_results").groupBy("query_id", "chunk_id").agg(F.min("scored_at").alias("scored_at"))


@query("""SELECT query_id, standard, CAST(min(rank) AS INTEGER) AS first_rank, count(*) AS n, string_agg(chunk_id, '|' ORDER BY chunk_id) AS chunks FROM (SELECT DISTINCT query_id, standard, chunk_id, rank FROM semantic_results WHERE standard IS NOT NULL AND rank IS NOT NULL) GROUP BY 1, 2""")
def sections_grouped(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "semantic_results").where("standard is not null and rank is not null").select("query_id", "standard", "chunk_id", "rank").distinct()
    return rows.groupBy("query_id", "standard").agg(F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("chunk_id")), "|").alias("chunks"))


@query("""SELECT standard, count(DISTINCT chunk_id) AS citations, min_by(clause, (scored_at, chunk_id, clause)) AS first_clause FROM semantic_results WHERE standard IS NOT NULL AND clause IS NOT NULL GROUP BY 1""")
def citation_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "semantic_results").where("standard is not null and clause is not null").groupBy("standard").agg(F.countDistinct("chunk_id").alias("citations"), F.min_by("clause", F.struct("scored_at", "chunk_id", "clause")).alias("first_clause"))


@query("""SELECT standard, CASE max(level) WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'UNVERIFIED' ELSE 'REQUIRES_REVIEW' END AS status FROM (SELECT unnest(standard_numbers) AS standard, CASE WHEN http_status = 200 AND text_extractable THEN 0 WHEN http_status >= 400 THEN 2 ELSE 1 END AS level FROM manifest) GROUP BY 1""")
def status_lattice(s: SparkSession, d: str) -> DataFrame:
    status = F.when((F.col("http_status") == 200) & F.col("text_extractable"), "VERIFIED").when(F.col("http_status") >= 400, "REQUIRES_REVIEW").otherwise("UNVERIFIED")
    return table(s, d, "manifest").select(F.explode("standard_numbers").alias("standard"), status.alias("status")).groupBy("standard").agg(E.highest_status(E.status_level(F.col("status"))).alias("status"))


EDGES = """SELECT 'product' AS st, product_id AS si, 'HAS_DOCUMENT' AS rel, 'document' AS tt, document_id AS ti, CASE WHEN http_status = 200 THEN 0 ELSE 1 END AS lvl, 'manifest:' || document_id AS prov FROM manifest WHERE product_id IS NOT NULL
UNION ALL SELECT 'document', document_id, 'USES_STANDARD', 'standard', unnest(standard_numbers), CASE WHEN http_status = 200 THEN 0 ELSE 1 END, 'manifest:' || document_id FROM manifest
UNION ALL SELECT 'document', document_id, 'USES_STANDARD', 'standard', unnest(standard_numbers), 1, 'chunk:' || chunk_id FROM chunks
UNION ALL SELECT 'document', document_id, 'HAS_CHUNK', 'chunk', chunk_id, 1, 'chunk:' || chunk_id FROM chunks
UNION ALL SELECT 'document', document_id, 'HAS_STRUCTURAL_UNIT', 'unit', CAST(ordinal AS VARCHAR), CASE confidence WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, 'structure:' || CAST(ordinal AS VARCHAR) FROM structure_nodes"""


@query(f"""SELECT st AS source_type, si AS source_id, rel AS relation, tt AS target_type, ti AS target_id, CASE max(lvl) WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'UNVERIFIED' ELSE 'REQUIRES_REVIEW' END AS status, string_agg(DISTINCT prov, '|' ORDER BY prov) AS provenance, 'rel_' || substr(sha256(concat_ws(chr(31), st, si, rel, tt, ti)), 1, 24) AS relationship_id FROM ({EDGES}) GROUP BY 1, 2, 3, 4, 5""")
def entity_edges(s: SparkSession, d: str) -> DataFrame:
    m, c, n = table(s, d, "manifest"), table(s, d, "chunks"), table(s, d, "structure_nodes")
    ok = F.when(F.col("http_status") == 200, "VERIFIED").otherwise("UNVERIFIED")
    edge = lambda df, st, si, rel, tt, ti, status, prov: df.select(F.lit(st).alias("source_type"), si.alias("source_id"), F.lit(rel).alias("relation"), F.lit(tt).alias("target_type"), ti.cast("string").alias("target_id"), status.alias("status"), prov.alias("provenance"))
    doc, chunk = F.col("document_id"), F.concat(F.lit("chunk:"), "chunk_id")
    parts = [
        edge(m.where("product_id is not null"), "product", F.col("product_id"), "HAS_DOCUMENT", "document", doc, ok, F.concat(F.lit("manifest:"), doc)),
        edge(m.withColumn("x", F.explode("standard_numbers")), "document", doc, "USES_STANDARD", "standard", F.col("x"), ok, F.concat(F.lit("manifest:"), doc)),
        edge(c.withColumn("x", F.explode("standard_numbers")), "document", doc, "USES_STANDARD", "standard", F.col("x"), F.lit("UNVERIFIED"), chunk),
        edge(c, "document", doc, "HAS_CHUNK", "chunk", F.col("chunk_id"), F.lit("UNVERIFIED"), chunk),
        edge(n, "document", doc, "HAS_STRUCTURAL_UNIT", "unit", F.col("ordinal"), F.when(F.col("confidence") == "high", "VERIFIED").when(F.col("confidence") == "low", "REQUIRES_REVIEW").otherwise("UNVERIFIED"), F.concat(F.lit("structure:"), F.col("ordinal").cast("string"))),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return E.merge_edges(every)


@query("""SELECT relation, source_type, target_type, count(*) AS n, count(DISTINCT si) AS sources FROM (SELECT DISTINCT st AS source_type, si, rel AS relation, tt AS target_type, ti FROM (""" + EDGES + """)) GROUP BY 1, 2, 3""")
def graph_summary(s: SparkSession, d: str) -> DataFrame:
    return entity_edges(s, d).groupBy("relation", "source_type", "target_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"))


@query(f"""SELECT DISTINCT p.si AS product_id, u.ti AS standard FROM ({EDGES}) p JOIN ({EDGES}) u ON p.rel = 'HAS_DOCUMENT' AND u.rel = 'USES_STANDARD' AND p.ti = u.si""")
def graph_paths(s: SparkSession, d: str) -> DataFrame:
    e = entity_edges(s, d)
    has = e.where("relation = 'HAS_DOCUMENT'").select(F.col("source_id").alias("product_id"), F.col("target_id").alias("doc"))
    uses = e.where("relation = 'USES_STANDARD'").select(F.col("source_id").alias("doc"), F.col("target_id").alias("standard"))
    return has.join(uses, "doc").select("product_id", "standard").distinct()


@query(f"""SELECT product_id, standard, n, CAST(row_number() OVER (PARTITION BY product_id ORDER BY n DESC, standard) AS INTEGER) AS rank FROM (SELECT product_id, standard, count(DISTINCT document_id) AS n FROM (SELECT product_id, document_id, unnest(standard_numbers) AS standard FROM manifest WHERE product_id IS NOT NULL) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY n DESC, standard) <= 3""")
def product_standards(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "manifest").where("product_id is not null").select("product_id", "document_id", F.explode("standard_numbers").alias("standard"))
    return R.ranked(rows.groupBy("product_id", "standard").agg(F.countDistinct("document_id").alias("n")), "product_id", "n", "standard", 3)


@query("""SELECT query_id, count(DISTINCT query) AS texts, bool_or(query IS NULL) AS some_missing, count(DISTINCT query) = 1 AS valid FROM semantic_results GROUP BY 1""")
def query_gates(s: SparkSession, d: str) -> DataFrame:
    n = F.countDistinct("query")
    return table(s, d, "semantic_results").groupBy("query_id").agg(n.alias("texts"), F.bool_or(F.col("query").isNull()).alias("some_missing"), (n == 1).alias("valid"))


TRUTH = "SELECT DISTINCT query_id, chunk_id AS key FROM hybrid_results WHERE reranker_score > 0 AND reranker_score::VARCHAR <> 'nan'"
FUSED = f"SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS rank FROM (SELECT query_id, key, round(coalesce(1.0::DOUBLE / (60 + a), 0) + coalesce(1.0::DOUBLE / (60 + b), 0), 8) AS s FROM ({RANKS}) WHERE a IS NOT NULL OR b IS NOT NULL)"
RECALL = f"""SELECT query_id, count(*) AS expected, {", ".join(f"round(count(CASE WHEN rank <= {k} THEN 1 END) / count(*)::DOUBLE, 6) AS recall_{k}" for k in (1, 3, 5, 10))}, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS reciprocal_rank FROM ({TRUTH}) LEFT JOIN ({FUSED}) USING (query_id, key) GROUP BY 1"""


def recall(s: SparkSession, d: str) -> DataFrame:
    truth = table(s, d, "hybrid_results").where("reranker_score > 0 and not isnan(reranker_score)").select("query_id", F.col("chunk_id").alias("key"))
    return E.recall_and_rank(fused(s, d).select("query_id", "key", F.col("fusion_rank").alias("rank")), truth)


@query(RECALL)
def recall_mrr(s: SparkSession, d: str) -> DataFrame:
    return recall(s, d)


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN coalesce(expected, 0) = 0 THEN 'no_ground_truth' WHEN recall_10 = 0 THEN 'not_retrieved' WHEN recall_5 = 0 THEN 'below_final' WHEN recall_1 = 0 THEN 'not_first' ELSE 'none' END AS kind FROM (SELECT DISTINCT query_id FROM hybrid_results) LEFT JOIN ({RECALL}) USING (query_id)) GROUP BY 1""")
def failure_taxonomy(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "hybrid_results").select("query_id").distinct().join(recall(s, d), "query_id", "left")
    return rows.groupBy(E.failure_kind(F.col("expected"), F.lit(1), F.col("recall_10"), F.col("recall_5"), F.col("recall_1")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, quantile_disc(value, 0.95) AS p95, min(value) AS least, max(value) AS most FROM events WHERE value IS NOT NULL GROUP BY 1""")
def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    return E.latency_summary(table(s, d, "events"), ["event_type"], "value")


@query("""SELECT query_id, count(*) AS citations, count(c.chunk_id) AS supported, bool_and(c.chunk_id IS NOT NULL) AS all_supported FROM (SELECT DISTINCT query_id, chunk_id FROM semantic_results) r LEFT JOIN (SELECT DISTINCT chunk_id FROM hybrid_results) c USING (chunk_id) GROUP BY 1""")
def citation_eval(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "hybrid_results").select("chunk_id").distinct().withColumn("k", F.lit(True))
    return table(s, d, "semantic_results").select("query_id", "chunk_id").distinct().join(known, "chunk_id", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("citations"), F.count("k").alias("supported"), F.bool_and(F.col("k").isNotNull()).alias("all_supported"))


@query("""SELECT query_id, chunk_id, round(coalesce(len(list_filter(q, lambda w: list_contains(t, w))) / nullif(len(q), 0)::DOUBLE, 0), 6) AS score FROM (SELECT query_id, chunk_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM (SELECT DISTINCT query_id, query, chunk_id FROM semantic_results WHERE query IS NOT NULL) JOIN (SELECT chunk_id, max(text) AS text FROM chunks GROUP BY 1 HAVING max(text) IS NOT NULL) USING (chunk_id))""")
def lexical_overlap(s: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(T.PATTERNS["alnum"]), F.lit(0)))
    rows = table(s, d, "semantic_results").where("query is not null").select("query_id", "query", "chunk_id").distinct().join(chunks(s, d).where("text is not null"), "chunk_id")
    score = F.coalesce(F.try_divide(F.size(F.array_intersect(words(F.col("query")), words(F.col("text")))).cast("double"), F.size(words(F.col("query"))).cast("double")), F.lit(0.0))
    return rows.select("query_id", "chunk_id", F.round(score, 6).alias("score"))


@query()
def hash_embed(s: SparkSession, d: str) -> DataFrame:
    embed = R.hash_embedding()
    return table(s, d, "documents").select("doc_id", embed(F.col("text")).alias("v")).select("doc_id", F.round(T.l2_norm(F.col("v")), 4).alias("length"), F.size("v").alias("dimension"))


def hybrid(s: SparkSession, d: str, queries: DataFrame) -> DataFrame:
    embed = R.hash_embedding()
    docs = chunks(s, d).where("text is not null").select(F.col("chunk_id").alias("key"), "text")
    vectors = docs.select("key", embed(F.col("text")).alias("vector"))
    return R.hybrid_search(s, docs, vectors, queries.withColumn("vector", embed(F.col("query"))), R.HASH_DIMENSION)


@query()
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    return hybrid(s, d, asked(s))


@query()
def hybrid_many(s: SparkSession, d: str) -> DataFrame:
    docs = chunks(s, d).where("text is not null").select(F.col("chunk_id").alias("key"), "text")
    return M.hybrid_many(docs, every_query(s, d))


# incremental work, as batch and as stream


@query("""SELECT user_id, event_type, value, version FROM (SELECT user_id, event_type, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_events(s: SparkSession, d: str) -> DataFrame:
    return I.latest_versions(table(s, d, "events"))


@query("""SELECT user_id, event_type, value, version FROM (SELECT user_id, event_type, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def stream_dedup_versions(s: SparkSession, d: str) -> DataFrame:
    return I.stream_latest(s, d)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_hourly(s: SparkSession, d: str) -> DataFrame:
    return I.stream_hourly(s, d)


@query("""SELECT o_custkey AS case_id, o_orderstatus AS status, o_orderdate AS changed_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus IN ('O', 'F', 'P')) WHERE k = 1""")
def case_status(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").where(F.col("o_orderstatus").isin("O", "F", "P"))
    return o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.max_by(F.struct("o_orderstatus", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("case_id", F.col("r.o_orderstatus").alias("status"), F.col("r.o_orderdate").alias("changed_at"))


@query("""SELECT c_custkey AS case_id, string_agg(CAST(p AS VARCHAR), '|' ORDER BY p) AS parts FROM customer JOIN (SELECT DISTINCT o_custkey, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 48) ON o_custkey = c_custkey GROUP BY 1""")
def case_links(s: SparkSession, d: str) -> DataFrame:
    l, o = table(s, d, "lineitem").where("l_quantity >= 48"), table(s, d, "orders")
    pairs = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("case_id"), F.col("l_partkey").alias("p")).distinct()
    known = table(s, d, "customer").select(F.col("c_custkey").alias("case_id"))
    return pairs.join(known, "case_id", "left_semi").groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x.cast("string")), "|").alias("parts"))


@query("""SELECT p_partkey, string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS labs, count(DISTINCT s_suppkey) AS n_labs, count(DISTINCT l_returnflag || l_linestatus) AS n_tests, max(r.n) AS n_related FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN (SELECT p_brand AS b, p_type AS t, count(*) - 1 AS n FROM part GROUP BY 1, 2) r ON r.b = p_brand AND r.t = p_type GROUP BY 1""")
def standard_detail(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", "p_brand", "p_type")
    related = p.groupBy("p_brand", "p_type").agg((F.count(F.lit(1)) - 1).alias("n_related"))
    links = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set("l_suppkey").alias("ids"), F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("tests"))
    names = links.select("p_partkey", F.explode("ids").alias("s_suppkey")).join(table(s, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    labs = names.groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_set("s_name")), "|").alias("labs"), F.count(F.lit(1)).alias("n_labs"))
    links = labs.join(links.select("p_partkey", F.size("tests").cast("long").alias("n_tests")), "p_partkey")
    return p.join(related, ["p_brand", "p_type"]).join(links, "p_partkey").select("p_partkey", "labs", "n_labs", "n_tests", "n_related")
