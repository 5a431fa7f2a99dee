"""Queries of the relational catalogue over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
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


LABELS = {"product_manual": "Product manual", "circular": "Circular", "quality_control_order": "Quality control order"}
TRUSTED = [f"norms{k}.example" for k in range(1, 4)]
SORTS = ["p_name", "p_brand", "p_size", "p_retailprice"]


@query("""SELECT doc_id, title, CASE WHEN licence_class = 'full_text_ok' THEN substr(text, 1, 420) END AS snippet FROM documents
WHERE text ILIKE '%gasket%' OR title ILIKE '%gasket%' OR is_number ILIKE '%gasket%' OR licence_class ILIKE '%gasket%'""")
def search_ilike(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where(C.any_ilike(["text", "title", "is_number", "licence_class"], "gasket"))
    return C.licence_masked(docs, "text").select("doc_id", "title", F.substring("text", 1, C.SNIPPET).alias("snippet"))


@query("""SELECT document_id, title, retrieved_at FROM manifest WHERE document_type = 'product_manual' AND http_status = 200 AND title ILIKE '%for%'""")
def filter_and(s: SparkSession, d: str) -> DataFrame:
    return C.all_filters(table(s, d, "manifest"), {"document_type": "product_manual", "http_status": 200, "organization": None}, {"title": "for"}).select("document_id", "title", "retrieved_at")


@query("""SELECT licence_class, count(*) AS n, count(CASE WHEN licence_class = 'full_text_ok' THEN text END) AS shown, CAST(sum(CASE WHEN licence_class = 'full_text_ok' THEN length(substr(text, 1, 4000)) END) AS BIGINT) AS chars FROM documents GROUP BY licence_class""")
def licence_mask(s: SparkSession, d: str) -> DataFrame:
    shown = C.licence_masked(table(s, d, "documents"), "text")
    return shown.groupBy("licence_class").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("shown"), F.sum(F.length(F.substring("text", 1, 4000))).alias("chars"))


@query("""SELECT chunk_id, CASE document_type WHEN 'product_manual' THEN 'Product manual' WHEN 'circular' THEN 'Circular' WHEN 'quality_control_order' THEN 'Quality control order' ELSE document_type END AS label FROM chunks""")
def label_lookup(s: SparkSession, d: str) -> DataFrame:
    return C.labelled(table(s, d, "chunks"), "document_type", LABELS, "label").select("chunk_id", "label")


@query("""SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS field FROM events, (SELECT unnest(['page', 'ref', 'k', 'a', 'x']) AS k) WHERE json_extract_string(props, '$.' || k) IS NOT NULL""")
def json_path(s: SparkSession, d: str) -> DataFrame:
    fields = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.get_json_object("props", f"$.{k}").alias("value")) for k in ("page", "ref", "k", "a", "x"))))
    return table(s, d, "events").select("event_id", fields.alias("f")).select("event_id", "f.value", "f.field").where("value is not null")


@query("""SELECT chunk_id, clause_number FROM chunks WHERE list_contains(standard_numbers, (SELECT min(x) FROM (SELECT unnest(standard_numbers) AS x FROM chunks))) AND document_type = 'product_manual'""")
def metadata_filter(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "chunks")
    first = chunks.select(F.explode("standard_numbers").alias("x")).agg(F.min("x")).first()[0]
    return C.metadata_mask(chunks, {"standard_numbers": first or "", "document_type": "product_manual"}, ["standard_numbers", "document_type", "product"]).select("chunk_id", "clause_number")


CAP = ["document_type", "organization", "product", "annex_identifier", "clause_number"]


@query("\nUNION ALL\n".join(f"""SELECT '{c}' AS field, count(*) AS rows, count(CASE WHEN trim({c}) <> '' THEN 1 END) AS present,
round(count(CASE WHEN trim({c}) <> '' THEN 1 END) / count(*)::DOUBLE, 6) AS coverage,
CASE WHEN count(CASE WHEN trim({c}) <> '' THEN 1 END) = 0 THEN 'unavailable' WHEN count(CASE WHEN trim({c}) <> '' THEN 1 END) = count(*) THEN 'supported' ELSE 'partial' END AS state,
coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM chunks WHERE trim({c}) <> '' ORDER BY 1 LIMIT 10)), '') AS examples FROM chunks""" for c in CAP))
def filter_capabilities(s: SparkSession, d: str) -> DataFrame:
    return C.filter_capabilities(table(s, d, "chunks"), CAP)


@query("""SELECT document_id, source_url FROM manifest WHERE lower(status) = 'validated' AND http_status = 200 AND text_extractable AND regexp_matches(source_url, '\\.pdf$')""")
def select_records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "manifest").where((F.lower("status") == "validated") & (F.col("http_status") == 200) & F.col("text_extractable") & F.col("source_url").rlike(r"\.pdf$")).select("document_id", "source_url")


@query("""SELECT product_id, count(DISTINCT document_id) AS candidates, CASE WHEN count(DISTINCT document_id) = 1 THEN min(document_id) END AS only_document FROM manifest WHERE product_id IS NOT NULL GROUP BY product_id""")
def exactly_one(s: SparkSession, d: str) -> DataFrame:
    n = F.countDistinct("document_id")
    return table(s, d, "manifest").where("product_id is not null").groupBy("product_id").agg(n.alias("candidates"), F.when(n == 1, F.min("document_id")).alias("only_document"))


@query("""WITH asked AS (SELECT unnest(['q001', 'q000000004', 'q000000010', 'nowhere']) AS query_id)
SELECT a.query_id, count(r.chunk_id) AS n, count(r.chunk_id) = 0 AS unknown FROM asked a LEFT JOIN semantic_results r USING (query_id) GROUP BY 1""")
def select_by_ids(s: SparkSession, d: str) -> DataFrame:
    asked = s.createDataFrame([(q,) for q in ("q001", "q000000004", "q000000010", "nowhere")], "query_id string")
    n = table(s, d, "semantic_results").where(F.col("query_id").isin("q001", "q000000004", "q000000010", "nowhere")).groupBy("query_id").agg(F.count("chunk_id").alias("n"))
    return asked.join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("n").isNull().alias("unknown"))


@query("""SELECT query_id, count(*) AS n, round(max(similarity), 6) AS best FROM semantic_results WHERE similarity::VARCHAR <> 'nan' AND similarity >= 0.05 GROUP BY query_id""")
def score_threshold(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "semantic_results").where("not isnan(similarity) and similarity >= 0.05").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("similarity"), 6).alias("best"))


@query("""SELECT document_id, lower(regexp_extract(source_url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_matches(source_url, '^https://[^/@?#:]+(:443)?([/?#]|$)') AND lower(regexp_extract(source_url, '^[a-z]+://([^/:?#]+)', 1)) IN ('norms1.example', 'norms2.example', 'norms3.example') AS trusted,
regexp_matches(lower(source_url), '\\.(xlsx|zip|docx|jpg)$') AS blocked FROM manifest WHERE source_url IS NOT NULL""")
def trusted_url(s: SparkSession, d: str) -> DataFrame:
    u = F.col("source_url")
    return table(s, d, "manifest").where("source_url is not null").select("document_id", T.url_host(u).alias("host"), T.trusted_url(u, TRUSTED).alias("trusted"), F.lower(u).rlike(r"\.(xlsx|zip|docx|jpg)$").alias("blocked"))


@query("""SELECT CASE WHEN lower(status) IN ('downloaded', 'duplicate') THEN 'skip' WHEN http_status IS NULL THEN 'fetch' WHEN http_status >= 500 OR http_status = 429 THEN 'retry' WHEN http_status >= 400 THEN 'fail' ELSE 'fetch' END AS route, count(*) AS n FROM manifest GROUP BY 1""")
def status_routing(s: SparkSession, d: str) -> DataFrame:
    code = F.col("http_status")
    route = F.when(F.lower("status").isin("downloaded", "duplicate"), "skip").when(code.isNull(), "fetch").when((code >= 500) | (code == 429), "retry").when(code >= 400, "fail").otherwise("fetch")
    return table(s, d, "manifest").groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


# joins


@query("""SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def join_inner(s: SparkSession, d: str) -> DataFrame:
    o, c = table(s, d, "orders"), table(s, d, "customer").where("c_mktsegment = 'BUILDING'")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "o_totalprice")


@query("""SELECT DISTINCT p_partkey, s_suppkey, s_name, n_name FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE p_size = 10""")
def join_m2n(s: SparkSession, d: str) -> DataFrame:
    link = table(s, d, "lineitem").select("l_partkey", "l_suppkey")
    p, x = table(s, d, "part").where("p_size = 10"), table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return link.join(p, link.l_partkey == p.p_partkey).select("p_partkey", "l_suppkey").distinct().join(x, F.col("l_suppkey") == F.col("s_suppkey")).select("p_partkey", "s_suppkey", "s_name", "n_name")


@query("""SELECT a.p_partkey AS base_key, b.p_partkey AS related_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def join_self(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    q = p.withColumnRenamed("p_partkey", "related_key")
    return p.join(q, ["p_brand", "p_type", "p_size"]).where("p_partkey < related_key").select(F.col("p_partkey").alias("base_key"), "related_key")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name ILIKE '%a%')""")
def semi_in_filter(s: SparkSession, d: str) -> DataFrame:
    wanted = table(s, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    places = table(s, d, "nation").where(F.col("n_name").ilike("%a%")).select(F.col("n_nationkey").alias("s_nationkey"))
    return table(s, d, "supplier").join(wanted, "s_suppkey", "left_semi").join(places, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


@query("""SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey WHERE l_discount > 0.09 OR o_orderpriority = '1-URGENT' AND c_acctbal < 0""")
def or_predicates(s: SparkSession, d: str) -> DataFrame:
    l, o, c = table(s, d, "lineitem"), table(s, d, "orders"), table(s, d, "customer")
    joined = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return joined.where((F.col("l_discount") > 0.09) | ((F.col("o_orderpriority") == "1-URGENT") & (F.col("c_acctbal") < 0))).select("l_orderkey", "l_linenumber")


@query("""SELECT t.o_orderkey, c_name, n_name, r_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) t LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def topk_enrich(s: SparkSession, d: str) -> DataFrame:
    top = table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
    c, n, r = table(s, d, "customer"), table(s, d, "nation"), table(s, d, "region")
    full = top.join(c, top.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return full.select("o_orderkey", "c_name", "n_name", "r_name")


@query("""SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = d.doc_id)""")
def exists_check(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id").join(table(s, d, "events").select(F.col("user_id").alias("doc_id")), "doc_id", "left_semi")


@query("""SELECT DISTINCT c.chunk_id, m.product_id FROM chunks c LEFT JOIN (SELECT document_id, min(product_id) AS product_id FROM manifest GROUP BY 1) m USING (document_id)""")
def product_lookup(s: SparkSession, d: str) -> DataFrame:
    products = table(s, d, "manifest").groupBy("document_id").agg(F.min("product_id").alias("product_id"))
    return table(s, d, "chunks").select("chunk_id", "document_id").join(products, "document_id", "left").select("chunk_id", "product_id").distinct()


@query("""SELECT DISTINCT c.chunk_id, CASE WHEN c.organization IS NULL OR trim(c.organization) = '' THEN m.organization ELSE c.organization END AS organization, CASE WHEN c.document_type IS NULL OR trim(c.document_type) = '' THEN m.document_type ELSE c.document_type END AS document_type
FROM chunks c LEFT JOIN (SELECT document_id, min(organization) AS organization, min(document_type) AS document_type FROM manifest GROUP BY 1) m USING (document_id)""")
def fill_metadata(s: SparkSession, d: str) -> DataFrame:
    side = table(s, d, "manifest").groupBy("document_id").agg(F.min("organization").alias("organization"), F.min("document_type").alias("document_type"))
    rows = table(s, d, "chunks").select("chunk_id", "document_id", "organization", "document_type")
    return C.fill_empty(rows, side, "document_id", ["organization", "document_type"]).select("chunk_id", "organization", "document_type").distinct()


@query("""SELECT s_suppkey, coalesce(string_agg(DISTINCT t, '|' ORDER BY t), '') AS tests FROM supplier LEFT JOIN (SELECT l_suppkey, l_returnflag || l_linestatus AS t FROM lineitem WHERE l_quantity = 50) ON l_suppkey = s_suppkey GROUP BY s_suppkey""")
def left_outer_collect(s: SparkSession, d: str) -> DataFrame:
    tests = table(s, d, "lineitem").where("l_quantity = 50").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.array_join(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), "|").alias("tests"))
    return table(s, d, "supplier").select("s_suppkey").join(tests, "s_suppkey", "left").select("s_suppkey", F.coalesce("tests", F.lit("")).alias("tests"))


@query("""WITH b AS (SELECT chunk_id, 0.4 AS s, 'keyword' AS b, 0 AS k FROM chunks WHERE text ILIKE '%gasket%' UNION ALL SELECT chunk_id, 0.5, 'metadata', 1 FROM chunks WHERE document_type = 'circular' UNION ALL SELECT chunk_id, similarity, 'vector', 2 FROM semantic_results WHERE similarity >= 0.9 AND similarity::VARCHAR <> 'nan')
SELECT chunk_id, round(max(s), 6)::DOUBLE AS score, (SELECT string_agg(b, '+' ORDER BY k) FROM (SELECT DISTINCT b, k FROM b x WHERE x.chunk_id = b0.chunk_id)) AS branches FROM b b0 GROUP BY chunk_id""")
def branch_merge(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "chunks")
    merged = C.merge_branches({
        "keyword": chunks.where(F.col("text").ilike("%gasket%")).select("chunk_id", F.lit(0.4).alias("score")),
        "metadata": chunks.where("document_type = 'circular'").select("chunk_id", F.lit(0.5).alias("score")),
        "vector": table(s, d, "semantic_results").where("similarity >= 0.9 and not isnan(similarity)").select("chunk_id", F.col("similarity").alias("score")),
    }, "chunk_id", "score")
    return merged.withColumn("score", F.round("score", 6))


@query("""SELECT chunk_id, 'left_only' AS side FROM (SELECT chunk_id FROM chunks EXCEPT SELECT chunk_id FROM chunk_vectors) UNION ALL SELECT chunk_id, 'right_only' FROM (SELECT chunk_id FROM chunk_vectors EXCEPT SELECT chunk_id FROM chunks)""")
def set_equality(s: SparkSession, d: str) -> DataFrame:
    return C.symmetric_difference(table(s, d, "chunks"), table(s, d, "chunk_vectors"), "chunk_id")


@query("""SELECT DISTINCT c.chunk_id, n.ordinal FROM chunks c JOIN structure_nodes n ON c.document_id = n.document_id AND c.clause_number = n.number""")
def path_join(s: SparkSession, d: str) -> DataFrame:
    c, n = table(s, d, "chunks").select("chunk_id", "document_id", F.col("clause_number").alias("number")), table(s, d, "structure_nodes").select("document_id", "number", "ordinal")
    return c.join(n, ["document_id", "number"]).select("chunk_id", "ordinal").distinct()


@query("""SELECT m.document_id, max(coalesce(r.pages_processed, 0)) AS pages, bool_or(r.document_id IS NULL) AS no_report FROM manifest m LEFT JOIN page_reports r ON m.document_id = r.document_id GROUP BY 1""")
def report_join(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "page_reports").select("document_id", "pages_processed", F.lit(True).alias("has"))
    return table(s, d, "manifest").select("document_id").join(r, "document_id", "left").groupBy("document_id").agg(F.max(F.coalesce("pages_processed", F.lit(0))).alias("pages"), F.bool_or(F.col("has").isNull()).alias("no_report"))


@query("""SELECT a.document_id, concat_ws(',', CASE WHEN a.title IS DISTINCT FROM b.title THEN 'title' END, CASE WHEN a.dt IS DISTINCT FROM b.dt THEN 'document_type' END, CASE WHEN a.org IS DISTINCT FROM b.org THEN 'organization' END) AS fields
FROM (SELECT document_id, min(title) AS title, min(document_type) AS dt, min(organization) AS org FROM manifest GROUP BY 1) a JOIN (SELECT document_id, min(document_title) AS title, min(document_type) AS dt, min(organization) AS org FROM chunks GROUP BY 1) b USING (document_id)
WHERE a.title IS DISTINCT FROM b.title OR a.dt IS DISTINCT FROM b.dt OR a.org IS DISTINCT FROM b.org""")
def field_diff(s: SparkSession, d: str) -> DataFrame:
    fields = ["title", "document_type", "organization"]
    a = table(s, d, "manifest").groupBy("document_id").agg(*(F.min(f).alias(f) for f in fields))
    b = table(s, d, "chunks").withColumn("title", F.col("document_title")).groupBy("document_id").agg(*(F.min(f).alias(f) for f in fields))
    return C.changed_fields(a, b, "document_id", fields)


@query("""SELECT coalesce(n_name, 'unlinked') AS section, count(s_suppkey) AS n FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = s_nationkey GROUP BY 1""")
def unlinked_group(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").where("n_regionkey < 3")
    return table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.coalesce("n_name", F.lit("unlinked")).alias("section")).agg(F.count("s_suppkey").alias("n"))


@query("""SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(s_suppkey) > 0 OR n_nationkey IN (3, 7)""")
def non_empty_or_pinned(s: SparkSession, d: str) -> DataFrame:
    counted = C.child_counts(table(s, d, "nation"), "n_nationkey", table(s, d, "supplier"), "s_nationkey", "n")
    return counted.where((F.col("n") > 0) | F.col("n_nationkey").isin(3, 7)).select("n_nationkey", "n")


@query("""SELECT DISTINCT c.chunk_id, n.ordinal FROM chunks c JOIN structure_nodes n ON c.document_id = n.document_id AND c.start_page <= n.end_page AND c.end_page >= n.start_page""")
def page_overlap_join(s: SparkSession, d: str) -> DataFrame:
    span = lambda a, b: F.explode(F.sequence(a, b)).alias("page")
    c = table(s, d, "chunks").where("end_page >= start_page").select("chunk_id", "document_id", span("start_page", "end_page"))
    n = table(s, d, "structure_nodes").where("end_page >= start_page").select("document_id", "ordinal", span("start_page", "end_page"))
    return c.distinct().join(n.distinct(), ["document_id", "page"]).select("chunk_id", "ordinal").distinct()


@query("""WITH a AS (SELECT DISTINCT standard FROM semantic_results WHERE standard IS NOT NULL), w AS (SELECT standard AS asked FROM a UNION SELECT split_part(standard, ':', 1) FROM a),
q AS (SELECT asked, regexp_extract(asked, 'IS *([0-9]+)', 1) AS n, regexp_extract(asked, 'IS *[0-9]+ *: *([0-9]{4})', 1) AS y FROM w WHERE regexp_matches(asked, 'IS *[0-9]+')),
t AS (SELECT DISTINCT standard, regexp_extract(standard, '^ *IS *([0-9]+) *: *([0-9]{4}) *$', 1) AS n, regexp_extract(standard, '^ *IS *([0-9]+) *: *([0-9]{4}) *$', 2) AS y FROM (SELECT is_number AS standard FROM documents UNION SELECT unnest(standard_numbers) FROM chunks) WHERE regexp_matches(standard, '^ *IS *[0-9]+ *: *[0-9]{4} *$'))
SELECT asked, standard FROM q JOIN t ON q.n = t.n AND (q.y = '' OR q.y = t.y)""")
def standard_match(s: SparkSession, d: str) -> DataFrame:
    given = table(s, d, "semantic_results").select("standard").where("standard is not null").distinct()
    asked = given.select(F.explode(F.array("standard", F.split_part("standard", F.lit(":"), F.lit(1)))).alias("asked")).distinct()  # with and without the year
    q = asked.select("asked", F.regexp_extract("asked", r"IS *([0-9]+)", 1).alias("n"), F.regexp_extract("asked", r"IS *[0-9]+ *: *([0-9]{4})", 1).alias("y")).where("n <> ''")
    known = table(s, d, "documents").select(F.col("is_number").alias("standard")).union(table(s, d, "chunks").select(F.explode("standard_numbers")))
    t = known.distinct().select("standard", F.regexp_extract("standard", T.PATTERNS["standard_strict"], 1).alias("n"), F.regexp_extract("standard", T.PATTERNS["standard_strict"], 2).alias("ty")).where("n <> ''")
    return q.join(t, "n").where("y = '' or y = ty").select("asked", "standard")


@query("""SELECT coalesce(a.query_id, b.query_id) AS query_id, a.query_id IS NULL AS missing_left, b.query_id IS NULL AS missing_right FROM (SELECT DISTINCT query_id FROM semantic_results) a FULL JOIN (SELECT DISTINCT query_id FROM hybrid_results) b ON a.query_id = b.query_id WHERE a.query_id IS NULL OR b.query_id IS NULL""")
def full_assert(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "semantic_results").select("query_id").distinct().withColumn("l", F.lit(True))
    b = table(s, d, "hybrid_results").select("query_id").distinct().withColumn("r", F.lit(True))
    return a.join(b, "query_id", "full").where("l is null or r is null").select("query_id", F.col("l").isNull().alias("missing_left"), F.col("r").isNull().alias("missing_right"))


@query("""SELECT r.query_id, r.chunk_id, c.document_id, c.clause_number, c.chunk_id IS NULL AS unsupported FROM (SELECT DISTINCT query_id, chunk_id FROM hybrid_results WHERE fusion_score > 0.03) r LEFT JOIN (SELECT chunk_id, min(document_id) AS document_id, min(clause_number) AS clause_number FROM chunks GROUP BY 1) c USING (chunk_id)""")
def citation_join(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "hybrid_results").where("fusion_score > 0.03").select("query_id", "chunk_id").distinct()
    c = table(s, d, "chunks").groupBy("chunk_id").agg(F.min("document_id").alias("document_id"), F.min("clause_number").alias("clause_number"), F.lit(True).alias("has"))
    return e.join(c, "chunk_id", "left").select("query_id", "chunk_id", "document_id", "clause_number", F.col("has").isNull().alias("unsupported"))


# counts, sorting, paging, sets


@query("""SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'documents', count(*) FROM documents""")
def stats_union(s: SparkSession, d: str) -> DataFrame:
    return C.table_counts({t: table(s, d, t) for t in ("customer", "orders", "lineitem", "part", "supplier", "documents")})


@query("""SELECT source, n, CAST(row_number() OVER (ORDER BY n DESC, source NULLS LAST) AS INTEGER) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""")
def group_count(s: SparkSession, d: str) -> DataFrame:
    counts = table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.asc_nulls_last("source"))))  # one row a source


@query("""SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def child_counts(s: SparkSession, d: str) -> DataFrame:
    return C.child_counts(table(s, d, "customer"), "c_custkey", table(s, d, "orders"), "o_custkey", "orders").select("c_custkey", "orders")


@query("""SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_name ILIKE '%e%') AS total FROM part WHERE p_name ILIKE '%e%' ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50""")
def paginate(s: SparkSession, d: str) -> DataFrame:
    hits = table(s, d, "part").where(F.col("p_name").ilike("%e%"))
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return C.page(hits, [F.asc("p_name"), F.asc("p_partkey")], 25, 50).crossJoin(total).select("p_partkey", "p_name", "total")  # one row of total


@query("""SELECT p_partkey, p_size FROM part ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 30""")
def sort_whitelist(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    return C.page(part, C.sort_by(part, "p_size", "desc", SORTS, "p_name", "p_partkey"), 30).select("p_partkey", "p_size")


@query("""SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'licence_class', licence_class, count(*) FROM documents WHERE licence_class IS NOT NULL GROUP BY licence_class UNION ALL SELECT 'year', CAST(year(parsed_at) AS VARCHAR), count(*) FROM documents WHERE parsed_at IS NOT NULL GROUP BY year(parsed_at)""")
def facets(s: SparkSession, d: str) -> DataFrame:
    return C.facets(table(s, d, "documents").withColumn("year", F.year("parsed_at")), ["lang", "licence_class", "year"])


@query("""SELECT document_id, title, retrieved_at, lower(status) AS status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY retrieved_at DESC NULLS LAST, discovered_at DESC NULLS LAST, title DESC NULLS LAST) AS k FROM manifest) WHERE k = 1""")
def latest_version(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "manifest").select("document_id", "title", "retrieved_at", "discovered_at", "status")
    return C.latest_by(rows, ["document_id"], ["retrieved_at", "discovered_at", "title"]).select("document_id", "title", "retrieved_at", F.lower("status").alias("status"))


@query("""SELECT event_type, user_id, best FROM (SELECT event_type, user_id, round(sum(value), 4) AS best, row_number() OVER (PARTITION BY event_type ORDER BY round(sum(value), 4) DESC, user_id) AS k FROM events GROUP BY 1, 2) WHERE k = 1""")
def argmax_score(s: SparkSession, d: str) -> DataFrame:
    sums = table(s, d, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 4).alias("best"))
    return sums.groupBy("event_type").agg(F.max_by(F.struct("user_id", "best"), F.struct("best", -F.col("user_id"))).alias("t")).select("event_type", "t.user_id", "t.best")


@query("""SELECT extraction_method, count(*) AS pages, CAST(sum(character_count_raw) AS BIGINT) AS chars, round(avg(character_count_raw), 4) AS mean, min(character_count_raw) AS least, max(character_count_raw) AS most, count(CASE WHEN ocr_required THEN 1 END) AS ocr FROM doc_pages GROUP BY 1""")
def stage_rollup(s: SparkSession, d: str) -> DataFrame:
    n = "character_count_raw"
    return table(s, d, "doc_pages").groupBy("extraction_method").agg(F.count(F.lit(1)).alias("pages"), F.sum(n).alias("chars"), F.round(F.avg(n), 4).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_if("ocr_required").alias("ocr"))


@query("""SELECT x AS standard, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM (SELECT DISTINCT chunk_id, document_id, unnest(standard_numbers) AS x FROM chunks) GROUP BY 1""")
def count_by_list(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunks").select("chunk_id", "document_id", F.explode("standard_numbers").alias("standard")).distinct()
    return rows.groupBy("standard").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("document_id").alias("documents"))


@query("""SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events WHERE value IS NOT NULL GROUP BY 1""")
def rates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").where("value is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("rate"))


@query("""SELECT 'headers_removed' AS field, round(avg(headers_removed), 6) AS mean, count(headers_removed) AS n FROM page_reports UNION ALL SELECT 'dehyphenations', round(avg(dehyphenations), 6), count(dehyphenations) FROM page_reports UNION ALL SELECT 'line_joins', round(avg(line_joins), 6), count(line_joins) FROM page_reports""")
def mean_fields(s: SparkSession, d: str) -> DataFrame:
    fields = ["headers_removed", "dehyphenations", "line_joins"]
    long = table(s, d, "page_reports").select(*(F.col(f).cast("double").alias(f) for f in fields)).unpivot([], fields, "field", "v")
    return long.groupBy("field").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("n"))


@query("""SELECT doc_id, title FROM documents WHERE is_number IN (SELECT is_number FROM documents WHERE title ILIKE '%s%') AND doc_id NOT IN (SELECT doc_id FROM documents WHERE licence_class = 'metadata_only')""")
def set_difference(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    wanted = docs.where(F.col("title").ilike("%s%")).select("is_number")
    return docs.join(wanted, "is_number", "left_semi").join(docs.where("licence_class = 'metadata_only'").select("doc_id"), "doc_id", "left_anti").select("doc_id", "title")


@query("""SELECT standard, count(*) AS authorities FROM (SELECT DISTINCT unnest(standard_numbers) AS standard, 'manifest' AS a FROM manifest UNION SELECT DISTINCT unnest(standard_numbers), 'chunks' FROM chunks UNION SELECT DISTINCT is_number, 'documents' FROM documents WHERE is_number IS NOT NULL UNION SELECT DISTINCT standard, 'results' FROM semantic_results WHERE standard IS NOT NULL) GROUP BY 1""")
def entity_union(s: SparkSession, d: str) -> DataFrame:
    part = lambda df, c, a: df.select(c.alias("standard"), F.lit(a).alias("a")).where("standard is not null")
    m, c = table(s, d, "manifest"), table(s, d, "chunks")
    parts = part(m, F.explode("standard_numbers"), "manifest").union(part(c, F.explode("standard_numbers"), "chunks")).union(part(table(s, d, "documents"), F.col("is_number"), "documents")).union(part(table(s, d, "semantic_results"), F.col("standard"), "results"))
    return parts.distinct().groupBy("standard").agg(F.count(F.lit(1)).alias("authorities"))


@query("""SELECT product_id, bool_and(known) AS covered, count(*) AS required FROM (SELECT DISTINCT m.product_id, x.s, x.s IN (SELECT standard FROM semantic_results WHERE standard IS NOT NULL) AS known FROM manifest m, (SELECT document_id, unnest(standard_numbers) AS s FROM manifest) x WHERE x.document_id = m.document_id AND m.product_id IS NOT NULL) GROUP BY 1""")
def coverage_report(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "manifest")
    needed = m.select("document_id", F.explode("standard_numbers").alias("s")).join(m.where("product_id is not null").select("document_id", "product_id"), "document_id").select("product_id", "s").distinct()
    seen = table(s, d, "semantic_results").where("standard is not null").select(F.col("standard").alias("s"), F.lit(True).alias("k")).distinct()
    return needed.join(seen, "s", "left").groupBy("product_id").agg(F.bool_and(F.col("k").isNotNull()).alias("covered"), F.count(F.lit(1)).alias("required"))
