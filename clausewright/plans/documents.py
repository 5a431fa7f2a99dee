"""Queries of the document dataflow and the text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import documents as D
from ..operators import evidence as E
from ..operators import structure as S
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


WORDS = "CASE WHEN trim(regexp_replace(coalesce({0}, ''), '[\\s\\x0b]+', ' ', 'g'), ' ') = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '[\\s\\x0b]+', ' ', 'g'), ' '), ' ')) END"
LINES = "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL)"
CLAUSE = "^(\\d+(?:\\.\\d+)+)[\\s\\x0b]+(.+)$"
CLAUSES = f"""SELECT * EXCLUDE k, CAST(row_number() OVER (PARTITION BY doc_id, parent_path ORDER BY line_no) AS INTEGER) AS sibling FROM (
SELECT doc_id, line_no, path, trim(regexp_extract(line, '{CLAUSE}', 2)) AS title, CASE WHEN contains(path, '.') THEN regexp_replace(path, '\\.\\d+$', '') END AS parent_path, CAST(len(string_split(path, '.')) AS INTEGER) AS depth, row_number() OVER (PARTITION BY doc_id, path ORDER BY line_no) AS k
FROM (SELECT *, regexp_extract(line, '{CLAUSE}', 1) AS path FROM ({LINES})) WHERE path <> '') WHERE k = 1"""


def plain_lines(s: SparkSession, d: str) -> DataFrame:
    return D.lines_of(table(s, d, "documents").where("text is not null"), ["doc_id"], "text")


def clauses(s: SparkSession, d: str) -> DataFrame:
    return D.clause_rows(plain_lines(s, d), ["doc_id"])


@query(f"""SELECT doc_id, length(text) AS chars, CAST({WORDS.format('text')} AS INTEGER) AS words, CASE WHEN trim(text, ' ') = '' THEN 'EMPTY' WHEN length(trim(text, ' ')) < 50 OR len(regexp_split_to_array(trim(text, ' '), '[\\s\\x0b]+')) < 8 THEN 'LOW' ELSE 'GOOD' END AS quality FROM documents WHERE text IS NOT NULL""")
def text_stats(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.length(t).alias("chars"), T.word_count(t).alias("words"), T.text_quality(t).alias("quality"))


@query("""SELECT t AS term, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.:/-][a-z0-9]+)*')) AS t FROM chunks) GROUP BY 1""")
def lexical_tokens(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunks").select("chunk_id", F.explode(T.lexical_tokens(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("chunks"))


@query("""SELECT doc_id, first FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS first FROM documents WHERE text IS NOT NULL) WHERE first <> doc_id""")
def content_hash_dups(s: SparkSession, d: str) -> DataFrame:
    return D.duplicates_of(table(s, d, "documents"), "doc_id", "text", ["doc_id"])


@query("""SELECT doc_id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 90) AS slug FROM documents WHERE title IS NOT NULL""")
def slugify(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("title is not null").select("doc_id", T.slug(F.col("title")).alias("slug"))


def _hint_case(column: str) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower({column}), '{p}')" for p in phrases) + f" THEN '{kind}'" for kind, phrases in T.DOCUMENT_HINTS)
    return f"CASE {arms} ELSE 'unknown' END"


@query(f"SELECT document_id, title, {_hint_case('title')} AS kind FROM manifest WHERE title IS NOT NULL")
def doc_type_case(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "manifest").where("title is not null").select("document_id", "title", T.first_hint(F.col("title")).alias("kind"))


@query(f"""SELECT document_id, score, CASE WHEN score >= 5 OR (score >= 4 AND kind <> 'unknown') THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'REJECTED' END AS relevance FROM (
SELECT document_id, {_hint_case("coalesce(title, '')")} AS kind, CAST(4 * least(len(coalesce(standard_numbers, [])), 1) + 2 * CAST(contains(lower(coalesce(title, '')), 'chromium') AS INTEGER) + 2 * CAST(contains(lower(coalesce(title, '')), 'fan') AS INTEGER) + CAST(product_id IS NOT NULL AS INTEGER) AS INTEGER) AS score FROM manifest)""")
def relevance_score(s: SparkSession, d: str) -> DataFrame:
    title = F.lower(F.coalesce("title", F.lit("")))
    hit = lambda w: F.contains(title, F.lit(w)).cast("int")
    score = 4 * F.least(F.coalesce(F.size("standard_numbers"), F.lit(0)), F.lit(1)) + 2 * hit("chromium") + 2 * hit("fan") + F.col("product_id").isNotNull().cast("int")
    rows = table(s, d, "manifest").select("document_id", T.first_hint(title).alias("kind"), score.alias("score"))
    level = F.when((F.col("score") >= 5) | ((F.col("score") >= 4) & (F.col("kind") != "unknown")), "HIGH").when(F.col("score") >= 2, "MEDIUM").when(F.col("score") > 0, "LOW").otherwise("REJECTED")
    return rows.select("document_id", "score", level.alias("relevance"))


STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"""SELECT query, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda w: NOT list_contains([{STOPS}], w)), lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END), lambda w: length(w) > 1 AND NOT list_contains([{STOPS}], w)))), ' ') AS terms FROM (SELECT DISTINCT query FROM semantic_results WHERE query IS NOT NULL)""")
def guard_tokens(s: SparkSession, d: str) -> DataFrame:
    asked = table(s, d, "semantic_results").where("query is not null").select("query").distinct()
    return asked.select("query", F.array_join(F.sort_array(T.guard_tokens(F.col("query"))), " ").alias("terms"))


@query("""SELECT doc_id, x AS standard, count(*) AS n FROM (SELECT doc_id, 'IS ' || CAST(CAST(unnest(regexp_extract_all(text, '(?i)\\bIS[\\s\\x0b]*:?[\\s\\x0b]*(\\d{2,6})[\\s\\x0b]*[:(][\\s\\x0b]*(\\d{4})', 1)) AS BIGINT) AS VARCHAR) || ':' || unnest(regexp_extract_all(text, '(?i)\\bIS[\\s\\x0b]*:?[\\s\\x0b]*(\\d{2,6})[\\s\\x0b]*[:(][\\s\\x0b]*(\\d{4})', 2)) AS x FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2""")
def standards_in_text(s: SparkSession, d: str) -> DataFrame:
    numbers, years = (F.regexp_extract_all("text", F.lit(T.PATTERNS["standard"]), F.lit(k)) for k in (1, 2))
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(F.zip_with(numbers, years, T.normal_standard)).alias("standard"))
    return rows.groupBy("doc_id", "standard").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT document_id, title, regexp_extract(standard, ':\\s*(\\d{4})', 1) AS edition_year FROM (SELECT document_id, title, unnest(standard_numbers) AS standard FROM manifest)""")
def edition_year(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "manifest").select("document_id", "title", F.explode("standard_numbers").alias("standard"))
    return rows.select("document_id", "title", F.regexp_extract("standard", T.PATTERNS["edition_year"], 1).alias("edition_year"))


@query(f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\\b(?:clause|cl\\.?)[\\s\\x0b:-]*(\\d+(?:\\.\\d+)*)\\b', 1)) AS INTEGER) AS clauses, CAST(len(regexp_extract_all(text, '\\d+(?:\\.\\d+)?[\\s\\x0b]*(?:V|Hz|W|A|kg|mm|kPa|MPa|Nm|N|s|min|h|percent)(?:[^A-Za-z0-9_]|$)')) AS INTEGER) AS measures, CAST(len(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')) AS INTEGER) AS numbers FROM documents WHERE text IS NOT NULL""")
def critical_tokens(s: SparkSession, d: str) -> DataFrame:
    count = lambda p, g: F.size(F.regexp_extract_all("text", F.lit(T.PATTERNS[p]), F.lit(g)))
    return table(s, d, "documents").where("text is not null").select("doc_id", count("clause", 1).alias("clauses"), count("measure", 0).alias("measures"), count("number", 0).alias("numbers"))


@query(f"SELECT doc_id, line_no, path, title, parent_path, depth, sibling FROM ({CLAUSES})")
def clause_lines(s: SparkSession, d: str) -> DataFrame:
    return clauses(s, d).select("doc_id", "line_no", "path", "title", "parent_path", "depth", "sibling")


@query(f"WITH c AS ({CLAUSES}) SELECT c.doc_id, c.path, p.path IS NOT NULL AS parent_found FROM c LEFT JOIN c p ON p.doc_id = c.doc_id AND p.path = c.parent_path")
def clause_parent(s: SparkSession, d: str) -> DataFrame:
    return D.with_parent(clauses(s, d), ["doc_id"]).select("doc_id", "path", "parent_found")


@query(f"""WITH c AS ({CLAUSES}), r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS chunk_index, path || ' ' || title AS text FROM c UNION ALL SELECT doc_id, 0, substr(text, 1, 1000) FROM documents WHERE length(trim(coalesce(text, ''), ' ')) > 0 AND doc_id NOT IN (SELECT doc_id FROM c))
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, length(text) AS chars FROM r""")
def chunk_fallback(s: SparkSession, d: str) -> DataFrame:
    return D.chunks_with_fallback(table(s, d, "documents"), clauses(s, d), "doc_id", "text").select("doc_id", "chunk_index", F.length("text").alias("chars"))


@query("""SELECT gate, count(*) AS n FROM (SELECT CASE WHEN licence_class IS NULL OR licence_class NOT IN ('full_text_ok', 'metadata_only') THEN 'unknown_licence' WHEN licence_class = 'metadata_only' AND length(trim(coalesce(text, ''), ' ')) > 0 THEN 'text_not_allowed' ELSE 'ok' END AS gate FROM documents) GROUP BY 1""")
def licence_gate(s: SparkSession, d: str) -> DataFrame:
    return D.licence_gate(table(s, d, "documents"), "licence_class", "text").groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH stored AS (SELECT doc_id AS k, 1 AS version, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND lang = 'en' UNION ALL SELECT doc_id, 2, sha256(text || '!') FROM documents WHERE text IS NOT NULL AND lang = 'en' AND licence_class = 'full_text_ok'),
latest AS (SELECT k, max(version) AS v, max_by(h, version) AS h FROM stored GROUP BY k)
SELECT action, CAST(version AS INTEGER) AS version, count(*) AS n FROM (SELECT CASE WHEN v IS NULL THEN 'new' WHEN h = sha256(text) THEN 'unchanged' ELSE 'changed' END AS action, CASE WHEN h = sha256(text) THEN v ELSE coalesce(v, 0) + 1 END AS version FROM documents LEFT JOIN latest ON k = doc_id WHERE text IS NOT NULL) GROUP BY 1, 2""")
def ingest_versions(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "text", "lang", "licence_class")
    first = docs.where("lang = 'en'").select("doc_id", F.lit(1).alias("version"), T.content_hash(F.col("text")).alias("content_hash"))
    second = docs.where("lang = 'en' and licence_class = 'full_text_ok'").select("doc_id", F.lit(2).alias("version"), T.content_hash(F.concat("text", F.lit("!"))).alias("content_hash"))
    return D.next_versions(docs, first.union(second), "doc_id", "text").groupBy("action", "version").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT standard AS is_number, depth_parts, CAST(row_number() OVER (ORDER BY depth_parts, standard) AS INTEGER) AS place FROM (SELECT DISTINCT clause_number AS standard, len(string_split(clause_number, '.')) AS depth_parts FROM chunks WHERE clause_number IS NOT NULL)""")
def clause_order(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunks").where("clause_number is not null").select(F.col("clause_number").alias("is_number")).distinct().withColumn("depth_parts", F.size(F.split("is_number", r"\.")))
    return C.numbered(rows, [F.col("depth_parts"), F.col("is_number")], "place")


@query("""SELECT number, place FROM (SELECT number, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(number, 'IS (\\d+)', 1) AS BIGINT), number) AS INTEGER) AS place FROM (SELECT DISTINCT unnest(standard_numbers) AS number FROM manifest))""")
def natural_sort(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "manifest").select(F.explode("standard_numbers").alias("number")).distinct()
    return C.numbered(rows, [F.regexp_extract("number", r"IS (\d+)", 1).cast("long"), F.col("number")], "place")


@query("""SELECT chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY start_page NULLS FIRST, end_page NULLS FIRST, annex_identifier NULLS FIRST, len(string_split(coalesce(clause_number, ''), '.')), clause_number NULLS FIRST, chunk_id) AS INTEGER) AS place FROM (SELECT DISTINCT chunk_id, document_id, start_page, end_page, annex_identifier, clause_number FROM chunks)""")
def canonical_order(s: SparkSession, d: str) -> DataFrame:
    keys = ["start_page", "end_page", "annex_identifier", F.size(F.split(F.coalesce("clause_number", F.lit("")), r"\.")), "clause_number", "chunk_id"]
    rows = table(s, d, "chunks").select("chunk_id", "document_id", "start_page", "end_page", "annex_identifier", "clause_number").distinct()
    return rows.select("chunk_id", F.row_number().over(Window.partitionBy("document_id").orderBy(*keys)).alias("place"))


@query(f"""SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS rank, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line, first_value(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS first_line FROM ({LINES}) WHERE trim(line, ' ') <> ''""")
def line_windows(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return plain_lines(s, d).where("trim(line) <> ''").select("doc_id", "line_no", F.row_number().over(w).alias("rank"), F.lead("line").over(w).alias("next_line"), F.first("line_no").over(w).alias("first_line"))


@query(f"""SELECT doc_id, line_no, coalesce(list_filter(list(CASE WHEN trim(line, ' ') <> '' THEN line END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), lambda x: x IS NOT NULL)[1], '') AS next_filled, coalesce(array_to_string(list_filter(list(CASE WHEN trim(line, ' ') <> '' THEN line END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 13 FOLLOWING), lambda x: x IS NOT NULL)[1:6], ' '), '') AS context FROM ({LINES})""")
def look_ahead(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("line_no")
    filled = F.when(F.trim("line") != "", F.col("line"))
    return plain_lines(s, d).select("doc_id", "line_no", F.coalesce(F.first(filled, ignorenulls=True).over(w.rowsBetween(1, 6)), F.lit("")).alias("next_filled"), F.array_join(F.slice(F.collect_list(filled).over(w.rowsBetween(1, 13)), 1, 6), " ").alias("context"))


@query(f"""SELECT doc_id, line_no, path, lead(line_no, 1, total + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS end_line FROM ({CLAUSES}) JOIN (SELECT doc_id, max(line_no) AS total FROM ({LINES}) GROUP BY doc_id) USING (doc_id)""")
def segment_end(s: SparkSession, d: str) -> DataFrame:
    total = plain_lines(s, d).groupBy("doc_id").agg(F.max("line_no").alias("total"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return clauses(s, d).join(total, "doc_id").select("doc_id", "line_no", "path", F.coalesce(F.lead("line_no").over(w), F.col("total") + 1).alias("end_line"))


@query(f"""SELECT doc_id, line_no, last_value(CASE WHEN regexp_matches(line, '^\\d+(\\.\\d+)+[\\s\\x0b]') THEN regexp_extract(line, '^(\\d+(\\.\\d+)+)[\\s\\x0b]', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM ({LINES})""")
def carry_forward(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("line").rlike(r"^\d+(\.\d+)+\s"), F.regexp_extract("line", r"^(\d+(\.\d+)+)\s", 1))
    return plain_lines(s, d).select("doc_id", "line_no", F.last(mark, ignorenulls=True).over(w).alias("section"))


PAGES = "SELECT document_id, page_number, max_by(raw_text, (extracted_at, page_id)) AS raw_text FROM doc_pages WHERE raw_text IS NOT NULL GROUP BY 1, 2"
PAGE_LINES = f"SELECT document_id, page_number, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT *, string_split(replace(replace(raw_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM ({PAGES}))"


def pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "doc_pages").where("raw_text is not null").groupBy("document_id", "page_number").agg(F.max_by("raw_text", F.struct("extracted_at", "page_id")).alias("raw_text"))


@query(f"""WITH f AS (SELECT * FROM ({PAGE_LINES}) WHERE trim(line, ' ') <> ''), m AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY line_no) AS a, row_number() OVER (PARTITION BY document_id, page_number ORDER BY line_no DESC) AS b FROM f),
t AS (SELECT document_id, count(DISTINCT page_number) AS total FROM f GROUP BY 1)
SELECT document_id, key, pages FROM (SELECT document_id, lower(trim(regexp_replace(line, '[\\s\\x0b]+', ' ', 'g'), ' ')) AS key, count(DISTINCT page_number) AS pages FROM m WHERE a <= 3 OR b <= 3 GROUP BY 1, 2) JOIN t USING (document_id) WHERE pages >= greatest(3, ceil(total * 0.8))""")
def marginal_lines(s: SparkSession, d: str) -> DataFrame:
    return D.margin_repeats(D.lines_of(pages(s, d), ["document_id", "page_number"], "raw_text"), "document_id", "page_number")


@query(f"""SELECT document_id, page_number, line_no, CAST(tokens AS BIGINT) AS tokens FROM (SELECT *, row_number() OVER w AS rank, sum({WORDS.format('line')}) OVER (w ROWS UNBOUNDED PRECEDING) AS tokens FROM ({PAGE_LINES}) WHERE trim(line, ' ') <> '' WINDOW w AS (PARTITION BY document_id, page_number ORDER BY line_no)) WHERE rank = 1 OR tokens <= 24 AND rank <= 20""")
def table_header_context(s: SparkSession, d: str) -> DataFrame:
    return D.header_lines(D.lines_of(pages(s, d), ["document_id", "page_number"], "raw_text"), ["document_id", "page_number"], 24).select("document_id", "page_number", "line_no", "tokens")


@query("""WITH r AS (SELECT DISTINCT document_id, start_page AS s, end_page AS e FROM chunks WHERE start_page IS NOT NULL AND end_page IS NOT NULL), f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY document_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM r)
SELECT document_id, min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY s, e) AS island FROM f) GROUP BY document_id, island""")
def interval_merge(s: SparkSession, d: str) -> DataFrame:
    return D.islands(table(s, d, "chunks").select("document_id", "start_page", "end_page").distinct(), "document_id", "start_page", "end_page")


@query("""WITH c AS (SELECT chunk_id, min(document_id) AS document_id, min(pages) AS pages, min(length(coalesce(text, ''))) < 60 AS ctx FROM chunks GROUP BY 1), v AS (SELECT document_id, list(DISTINCT p) AS covered FROM (SELECT document_id, unnest(pages) AS p FROM c WHERE NOT ctx) GROUP BY 1)
SELECT chunk_id, ctx AND len(list_filter(coalesce(pages, []), lambda p: NOT list_contains(coalesce(covered, []), p))) = 0 AS dropped FROM c LEFT JOIN v USING (document_id) WHERE pages IS NOT NULL""")
def context_only_drop(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").groupBy("chunk_id").agg(F.min("document_id").alias("document_id"), F.min("pages").alias("pages"), (F.min(F.length(F.coalesce("text", F.lit("")))) < 60).alias("ctx")).where("pages is not null")
    return D.context_only_drop(c, "document_id", "ctx", "pages").select("chunk_id", F.col("drop").alias("dropped"))


@query("""SELECT document_id, ordinal, array_to_string(list_transform(path, lambda p: concat_ws(' — ', coalesce(p.identifier, p.number), p.title)), ' | ') AS prefix FROM (SELECT DISTINCT document_id, ordinal, path FROM structure_nodes WHERE path IS NOT NULL)""")
def context_prefix(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "structure_nodes").where("path is not null").select("document_id", "ordinal", D.context_prefix(F.col("path")).alias("prefix"), "path").distinct().drop("path")


@query("""WITH RECURSIVE n AS (SELECT DISTINCT document_id, ordinal, parent_ordinal FROM structure_nodes), t AS (SELECT document_id, ordinal, 1 AS depth FROM n WHERE parent_ordinal IS NULL UNION ALL SELECT n.document_id, n.ordinal, t.depth + 1 FROM n JOIN t ON n.document_id = t.document_id AND n.parent_ordinal = t.ordinal) SELECT document_id, ordinal, depth FROM t""")
def clause_tree_depth(s: SparkSession, d: str) -> DataFrame:
    return S.tree_depth(table(s, d, "structure_nodes"), "document_id", "ordinal", "parent_ordinal")


@query(f"""SELECT document_id, max_by(title, (CASE WHEN {_hint_case("coalesce(title, '')")} <> 'unknown' THEN 2 ELSE 1 END, coalesce(discovered_at, TIMESTAMP '0001-01-01'), coalesce(title, ''))) AS title, string_agg(DISTINCT coalesce(source_url, ''), '|' ORDER BY coalesce(source_url, '')) AS sources FROM manifest GROUP BY 1""")
def candidate_upsert(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "manifest").select("document_id", F.coalesce("title", F.lit("")).alias("title"), "discovered_at", F.coalesce("source_url", F.lit("")).alias("source_url"))
    rank = F.struct(F.when(T.first_hint(F.col("title")) != "unknown", 2).otherwise(1), F.coalesce("discovered_at", F.lit("0001-01-01").cast("timestamp_ntz")))
    return D.upsert_candidates(rows, "document_id", rank, "title", "source_url").select("document_id", F.when(F.col("title") != "", F.col("title")).alias("title"), "sources")


@query("""WITH p AS (SELECT DISTINCT document_id, page_number AS p FROM doc_pages), c AS (SELECT DISTINCT document_id, unnest(range(start_page, end_page + 1)) AS p FROM chunks WHERE start_page IS NOT NULL AND end_page >= start_page),
m AS (SELECT *, p - row_number() OVER (PARTITION BY document_id ORDER BY p) AS island FROM (SELECT document_id, p FROM p EXCEPT SELECT document_id, p FROM c)) SELECT document_id, min(p) AS first_missing, max(p) AS last_missing FROM m GROUP BY document_id, island""")
def coverage_gaps(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").where("end_page >= start_page").select("document_id", F.explode(F.sequence("start_page", "end_page")).alias("p")).distinct()
    missing = table(s, d, "doc_pages").select("document_id", F.col("page_number").alias("p")).distinct().join(c, ["document_id", "p"], "left_anti")
    island = F.col("p") - F.row_number().over(Window.partitionBy("document_id").orderBy("p"))
    return missing.withColumn("island", island).groupBy("document_id", "island").agg(F.min("p").alias("first_missing"), F.max("p").alias("last_missing")).drop("island")


@query("""SELECT document_id, CASE WHEN title IS NOT NULL AND NOT regexp_matches(lower(title), '^(https?://|untitled|document$)') THEN title ELSE first_line END AS chosen FROM (SELECT document_id, min(title) AS title FROM manifest GROUP BY 1) LEFT JOIN (SELECT document_id, min_by(line, (page_number, line_no)) AS first_line FROM (""" + PAGE_LINES + """) WHERE length(trim(line, ' ')) > 20 GROUP BY 1) USING (document_id)""")
def title_choice(s: SparkSession, d: str) -> DataFrame:
    first = D.lines_of(pages(s, d), ["document_id", "page_number"], "raw_text").where("length(trim(line)) > 20").groupBy("document_id").agg(F.min_by("line", F.struct("page_number", "line_no")).alias("first_line"))
    m = table(s, d, "manifest").groupBy("document_id").agg(F.min("title").alias("title")).join(first, "document_id", "left")
    good = F.col("title").isNotNull() & ~F.lower("title").rlike(r"^(https?://|untitled|document$)")
    return m.select("document_id", F.when(good, F.col("title")).otherwise(F.col("first_line")).alias("chosen"))


@query("""SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN a.chunk_id IS NULL THEN 'new' WHEN b.chunk_id IS NULL THEN 'retired' ELSE 'kept' END AS change FROM (SELECT DISTINCT chunk_id FROM chunks WHERE retrieved_at < TIMESTAMP '2025-09-01') a FULL JOIN (SELECT DISTINCT chunk_id FROM chunks WHERE retrieved_at >= TIMESTAMP '2025-07-01') b ON a.chunk_id = b.chunk_id""")
def rechunk_audit(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks")
    old = c.where("retrieved_at < timestamp_ntz '2025-09-01 00:00:00'").select("chunk_id").distinct().withColumn("o", F.lit(True))
    new = c.where("retrieved_at >= timestamp_ntz '2025-07-01 00:00:00'").select("chunk_id").distinct().withColumn("n", F.lit(True))
    return old.join(new, "chunk_id", "full").select("chunk_id", F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "retired").otherwise("kept").alias("change"))


@query("""SELECT "check", failures, failures = 0 AS passed FROM (SELECT unnest(['chunk_id_set', 'text_present', 'pages_ordered', 'has_standard', 'url_https']) AS "check", unnest([count(CASE WHEN NOT coalesce(length(chunk_id) = 24, false) THEN 1 END), count(CASE WHEN NOT coalesce(length(trim(text)) > 0, false) THEN 1 END), count(CASE WHEN NOT coalesce(start_page <= end_page, false) THEN 1 END), count(CASE WHEN NOT coalesce(len(standard_numbers) > 0, false) THEN 1 END), count(CASE WHEN NOT coalesce(source_url LIKE 'https://%', false) THEN 1 END)]) AS failures FROM chunks)""")
def quality_gates(s: SparkSession, d: str) -> DataFrame:
    return E.gate_row(table(s, d, "chunks"), {
        "chunk_id_set": F.length("chunk_id") == 24, "text_present": F.length(F.trim("text")) > 0, "pages_ordered": F.col("start_page") <= F.col("end_page"),
        "has_standard": F.size("standard_numbers") > 0, "url_https": F.col("source_url").startswith("https://"),
    })


@query("""SELECT document_id, sha256(string_agg(chunk_id || '|' || coalesce(sha256(text), ''), chr(10) ORDER BY chunk_id)) AS tree FROM (SELECT DISTINCT document_id, chunk_id, text FROM chunks) GROUP BY 1""")
def tree_hash(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunks").select("document_id", "chunk_id", "text").distinct().select("document_id", F.concat("chunk_id", F.lit("|"), F.coalesce(T.content_hash(F.col("text")), F.lit(""))).alias("part"))
    return rows.groupBy("document_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("part")), "\n"), 256).alias("tree"))


@query("""SELECT embedding_model, count(*) AS n, count(DISTINCT embedding_model_revision || '/' || embedding_dimension) AS kinds, (SELECT count(DISTINCT embedding_model || embedding_model_revision || embedding_dimension) > 1 FROM chunk_vectors) AS mixed FROM chunk_vectors GROUP BY 1""")
def mixed_provenance(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "chunk_vectors").select("embedding_model", F.concat_ws("/", "embedding_model_revision", "embedding_dimension").alias("kind"))
    by = v.groupBy("embedding_model").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kind").alias("kinds"))
    return by.crossJoin(v.agg((F.countDistinct(F.concat("embedding_model", "kind")) > 1).alias("mixed")))  # one row


@query("""SELECT document_id, replace(lower(document_type), '_', ' ') AS low, upper(substr(replace(lower(document_type), '_', ' '), 1, 1)) || substr(replace(lower(document_type), '_', ' '), 2) AS label, strftime(retrieved_at, '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN length(title) > 40 THEN rtrim(substr(title, 1, 39)) || '…' ELSE title END AS short FROM manifest WHERE document_type IS NOT NULL""")
def label_helpers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "manifest").where("document_type is not null").select("document_id", F.lower(F.replace("document_type", F.lit("_"), F.lit(" "))).alias("low"), T.humanise(F.col("document_type")).alias("label"), F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), T.ellipsis(F.col("title"), 40).alias("short"))


@query("""SELECT document_id, ordinal, 'ent_' || substr(sha256(concat_ws(chr(31), document_id, CAST(ordinal AS VARCHAR), coalesce(number, ''))), 1, 24) AS entity_id FROM (SELECT DISTINCT document_id, ordinal, number FROM structure_nodes)""")
def stable_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "structure_nodes").select("document_id", "ordinal", "number").distinct().select("document_id", "ordinal", T.stable_id("ent_", F.col("document_id"), F.col("ordinal"), F.col("number")).alias("entity_id"))


@query()
def clean_pages(s: SparkSession, d: str) -> DataFrame:
    bare = D.without_margins(pages(s, d), "document_id", "page_number", "raw_text")
    return bare.select("document_id", "page_number", D.clean_page_text(F.col("raw_text")).alias("text"))


LINE = f"SELECT document_id, page_number, line_no, trim(regexp_replace(line, '{S.BLANKS}', ' ', 'g'), ' ') AS line FROM ({PAGE_LINES})"
NUMBER, DOT, TITLE = (f"regexp_extract(line, '{S.NUMBERED}', {k})" for k in (1, 2, 3))
BARE = f"NOT contains({NUMBER}, '.') AND {DOT} = ''"
CAPITALS, LETTERS = (f"length(regexp_replace({TITLE}, '[^{c}]', '', 'g'))" for c in ("A-Z", "A-Za-z"))
REASON = f"""CASE WHEN contains(line, '|') THEN 'table_row' WHEN length(line) > 240 THEN 'too_long' WHEN regexp_matches({TITLE}, '{S.UNIT}') THEN 'quantity' WHEN regexp_matches({TITLE}, '{S.QUOTED}') THEN 'citation' WHEN regexp_matches({TITLE}, '{S.MONTH}') THEN 'date'
WHEN coalesce(TRY_CAST(regexp_extract({NUMBER}, '^\\d+') AS HUGEINT) > 99, false) THEN 'top_number' WHEN {BARE} AND ({LETTERS} = 0 OR {CAPITALS} < {LETTERS} * 0.7 AND NOT (len(string_split({TITLE}, ' ')) <= 8 AND regexp_matches({TITLE}, '^[A-Z]') AND NOT ends_with({TITLE}, '.'))) THEN 'sentence' END"""
EVENTS = f"""SELECT document_id, page_number, line_no, kind, CASE kind WHEN 'annex' THEN upper(regexp_extract(line, '{S.ANNEX}', 1)) WHEN 'table' THEN regexp_extract(line, '{S.TABLE}', 1) WHEN 'heading' THEN {NUMBER} END AS number,
nullif(trim(CASE kind WHEN 'annex' THEN regexp_extract(line, '{S.ANNEX}', 2) WHEN 'table' THEN regexp_extract(line, '{S.TABLE}', 2) WHEN 'heading' THEN {TITLE} END, ' '), '') AS title,
CASE WHEN kind <> 'heading' OR NOT ({BARE}) THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN kind = 'heading' THEN {REASON} END AS reason
FROM (SELECT *, CASE WHEN regexp_matches(line, '{S.ANNEX}') THEN 'annex' WHEN regexp_matches(line, '{S.TABLE}') THEN 'table' WHEN regexp_matches(line, '{S.REFERENCES}') THEN 'references' WHEN {NUMBER} <> '' THEN 'heading' END AS kind FROM ({LINE})) WHERE kind IS NOT NULL"""
UPTO = "(PARTITION BY document_id ORDER BY page_number, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
HERE, AHEAD = UPTO.format("CURRENT ROW"), UPTO.format("1 PRECEDING")
ORDER = "(PARTITION BY document_id ORDER BY page_number, line_no)"
PREFIX = "array_to_string(string_split(number, '.')[1:{} + lettered], '.')"
UPPER = ", ".join(
    f"CASE WHEN kind = 'heading' AND level > {j} AND at{j}.segment = segment{'' if j == 0 else f' AND at{j}.number = ' + PREFIX.format(j)} THEN at{j}.ordinal END AS up{j}" for j in range(6)
)
TREE = f"""WITH e AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(number, '^[A-Z]') THEN 1 ELSE 0 END AS lettered, last_value(CASE WHEN kind = 'annex' THEN number END IGNORE NULLS) OVER {HERE} AS annex, count(CASE WHEN kind = 'annex' THEN 1 END) OVER {HERE} AS segment FROM ({EVENTS}) WHERE reason IS NULL),
l AS (SELECT *, CASE kind WHEN 'annex' THEN 0 WHEN 'heading' THEN len(string_split(number, '.')) - lettered END AS level FROM e WHERE kind <> 'heading' OR lettered = 0 OR number[1] = annex),
t AS (SELECT *, lag(kind) OVER {ORDER} AS after, last_value(CASE WHEN level = 1 THEN number END IGNORE NULLS) OVER {AHEAD} AS top FROM l),
n AS MATERIALIZED (SELECT *, CAST(row_number() OVER {ORDER} - 1 AS INTEGER) AS ordinal FROM t WHERE NOT coalesce(after = 'table' AND level = 1 AND lettered = 0 AND NOT coalesce(TRY_CAST(number AS BIGINT) = coalesce(TRY_CAST(top AS BIGINT), 0) + 1, false), false)),
a AS (SELECT *, {", ".join(f"last_value(CASE WHEN level = {j} THEN {{'segment': segment, 'number': number, 'ordinal': ordinal}} END IGNORE NULLS) OVER {AHEAD} AS at{j}" for j in range(6))} FROM n),
u AS (SELECT *, {UPPER} FROM a), v AS (SELECT *, list_filter([up0, up1, up2, up3, up4, up5], lambda x: x IS NOT NULL) AS up, coalesce(CASE level WHEN 1 THEN up0 WHEN 2 THEN up1 WHEN 3 THEN up2 WHEN 4 THEN up3 WHEN 5 THEN up4 WHEN 6 THEN up5 END, -1) >= 0 AS near FROM u),
w AS (SELECT * REPLACE (CASE WHEN kind = 'table' THEN coalesce(last_value(CASE WHEN kind IN ('heading', 'annex') THEN list_append(up, ordinal) END IGNORE NULLS) OVER {AHEAD}, []) ELSE up END AS up) FROM v),
z AS MATERIALIZED (SELECT *, greatest(page_number, coalesce(lead(page_number) OVER {ORDER}, last_page)) AS own_end FROM w JOIN (SELECT document_id, max(page_number) AS last_page FROM ({PAGES}) GROUP BY 1) USING (document_id)),
r AS (SELECT document_id, ordinal, max(own_end) AS end_page FROM (SELECT document_id, unnest(list_append(up, ordinal)) AS ordinal, own_end FROM z) GROUP BY 1, 2)
SELECT document_id, ordinal, CASE WHEN kind <> 'heading' THEN kind WHEN level = 1 AND lettered = 0 THEN 'section' WHEN len(string_split(number, '.')) <= 2 THEN 'clause' ELSE 'subclause' END AS type, number, title, confidence, page_number AS start_page, end_page, line_no AS start_line, up[-1] AS parent_ordinal, coalesce(contains(number, '.') AND NOT near AND kind = 'heading', false) AS missing_parent FROM z JOIN r USING (document_id, ordinal)"""


def page_events(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    some = pages(s, d)
    return some, S.line_events(D.lines_of(some, ["document_id", "page_number"], "raw_text"), ["document_id", "page_number", "line_no"], "line")


@query(f"SELECT document_id, page_number, line_no, number, title, reason FROM ({EVENTS}) WHERE reason IS NOT NULL")
def ambiguous_headings(s: SparkSession, d: str) -> DataFrame:
    return page_events(s, d)[1].where("reason is not null").select("document_id", "page_number", "line_no", "number", "title", "reason")


@query(TREE)
def structure_tree(s: SparkSession, d: str) -> DataFrame:
    some, events = page_events(s, d)
    return S.document_tree(events.where("reason is null"), some, "document_id", "page_number", "line_no")


def budgets(s: SparkSession, d: str) -> dict[str, D.Budgets]:
    rows = table(s, d, "chunk_config").collect()  # the fixed table of three rows
    return {r["config_id"]: D.Budgets(r["target_tokens"], r["soft_max_tokens"], r["hard_max_tokens"], r["overlap_tokens"], r["embedding_max_tokens"]) for r in rows}


@query()
def split_text(s: SparkSession, d: str) -> DataFrame:
    return D.split_rows(table(s, d, "documents"), ["doc_id"], "text", budgets(s, d), "default").withColumnRenamed("doc_id", "key")


@query()
def split_nodes(s: SparkSession, d: str) -> DataFrame:
    newest = table(s, d, "structure_nodes").groupBy("document_id", "ordinal").agg(F.max(F.struct("built_at", "text", "context_prefix", "config_id")).alias("row"))
    return D.split_rows(newest.select("document_id", "ordinal", "row.*"), ["document_id", "ordinal"], "text", budgets(s, d), "default", "context_prefix", "config_id")


@query(r"""WITH u AS (SELECT document_id, upper(substr(source_url, 1, 5)) || substr(source_url, 6, 1000) || '#part' AS u FROM manifest WHERE source_url IS NOT NULL)
SELECT document_id, CASE WHEN regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) = '' THEN u ELSE lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(u, '://([^/?#]*)', 1)), ':(80|443)$', '') || regexp_replace(regexp_extract(u, '://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') || regexp_extract(u, '(\?[^#]*)', 1) END AS url FROM u""")
def canonical_urls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "manifest").where("source_url is not null").select("document_id", T.canonical_url(F.concat(F.upper(F.substring("source_url", 1, 5)), F.substring("source_url", 6, 1000), F.lit("#part"))).alias("url"))
