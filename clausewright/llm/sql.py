"""DuckDB SQL for the queries that SQL can state."""

LATEST_SCORES = """
  SELECT query_id, chunk_id, max_by(similarity, (scored_at, similarity)) + 0.0::DOUBLE AS similarity FROM semantic_results
  WHERE similarity IS NOT NULL AND similarity::VARCHAR <> 'nan' GROUP BY query_id, chunk_id
"""
TOP = f"""
  SELECT query_id, chunk_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank
  FROM ({LATEST_SCORES})
"""
PLACES = ", ".join(
    f"CASE WHEN {c} IS NULL THEN 99 ELSE rank() OVER (PARTITION BY query_id ORDER BY {c} DESC NULLS LAST) END AS p{k}"
    for k, c in enumerate(("s", "b", "f", "r"))
)

# The token pattern with its classes spelled out, since \\w and \\s know only ASCII there.
COUNT = r"len(regexp_extract_all(coalesce({}, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]'))"

WORDS = "regexp_extract_all(lower(coalesce(text, search_vector)), '[a-z0-9]+')"
AGREEING = f"""
  WITH c AS (SELECT DISTINCT chunk_id, list_sort({WORDS}) AS w FROM chunks WHERE len({WORDS}) >= 20),
  t AS (SELECT chunk_id, len(w) AS n, term, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS term FROM c) GROUP BY 1, 2, 3),
  p AS (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, any_value(a.n) AS na, any_value(b.n) AS nb, sum(least(a.tf, b.tf)) AS common
        FROM t a JOIN t b ON a.term = b.term AND a.chunk_id < b.chunk_id AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n) GROUP BY 1, 2)
  SELECT chunk_a, chunk_b FROM p WHERE common >= 0.75 * (na + nb - common)
"""
GROUPED = f"""
  WITH RECURSIVE bag AS (SELECT DISTINCT chunk_id, list_sort({WORDS}) AS w FROM chunks WHERE len({WORDS}) >= 20),
  class AS (SELECT w, min(chunk_id) AS class_id FROM bag GROUP BY w), own AS (SELECT chunk_id, class_id FROM bag JOIN class USING (w)),
  pair AS ({AGREEING}),
  link AS (SELECT DISTINCT a.class_id AS x, b.class_id AS y FROM pair JOIN own a ON a.chunk_id = chunk_a JOIN own b ON b.chunk_id = chunk_b WHERE a.class_id <> b.class_id),
  edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
  reach AS (SELECT class_id AS x, class_id AS y FROM class UNION SELECT reach.x, edge.y FROM reach JOIN edge ON edge.x = reach.y),
  head AS (SELECT x AS class_id, min(y) AS group_id FROM reach GROUP BY x), degree AS (SELECT x AS class_id, count(*) AS n FROM edge GROUP BY x)
  SELECT k.chunk_id, coalesce(group_id, k.chunk_id) AS group_id, own.class_id, CAST(coalesce(degree.n, 0) AS INTEGER) AS n_links
  FROM (SELECT DISTINCT chunk_id FROM chunks) k LEFT JOIN own ON own.chunk_id = k.chunk_id LEFT JOIN head ON head.class_id = own.class_id LEFT JOIN degree ON degree.class_id = own.class_id
"""
NEAREST = """
  WITH v AS (SELECT chunk_id, max(embedding) AS e FROM chunk_vectors, index_config WHERE is_active AND chunk_vectors.embedding_model = index_config.embedding_model AND len(embedding) = dimension
             AND len(list_filter(embedding, lambda x: x IS NULL OR x::VARCHAR = 'nan' OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)
  SELECT chunk_id, neighbour_id, similarity, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY similarity DESC, neighbour_id) AS INTEGER) AS rank FROM (
      SELECT a.chunk_id, b.chunk_id AS neighbour_id, round(list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]), 6) AS similarity FROM v a JOIN v b ON a.chunk_id <> b.chunk_id)) WHERE rank <= 5
"""

SCORES = ("similarity", "bm25_score", "fusion_score", "reranker_score")
NEWEST = "SELECT query_id, chunk_id, " + ", ".join(f"CASE WHEN {c}::VARCHAR <> 'nan' THEN {c} END AS x{k}" for k, c in enumerate(SCORES)) + """
  FROM hybrid_results QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY scored_at DESC) = 1"""
ORDERED = ", ".join(f"row_number() OVER (PARTITION BY query_id ORDER BY x{k} NULLS LAST) AS r{k}, count(x{k}) OVER (PARTITION BY query_id) AS c{k}" for k in range(4))
LIMITS = ", ".join(f"min(x{k}) AS lo{k}, max(x{k}) AS hi{k}, max(CASE WHEN r{k} = greatest(1, ceil(0.2 * c{k})) THEN x{k} END) AS l{k}, max(CASE WHEN r{k} = greatest(1, ceil(0.8 * c{k})) THEN x{k} END) AS u{k}" for k in range(4))
CLIPPED = ", ".join(f"coalesce(least(greatest(x{k}, l{k}), u{k}) - l{k}, 0) AS w{k}, coalesce(u{k} - l{k}, 0) AS best{k}" for k in range(4))
SCALED = " + ".join(f"CASE WHEN hi{k} > lo{k} AND x{k} IS NOT NULL THEN (x{k} - lo{k}) / (hi{k} - lo{k}) ELSE 0 END" for k in range(4))
UNITS = ", ".join(f"CASE WHEN sum(w{k} * w{k}) OVER q > 0 THEN sqrt(sum(w{k} * w{k}) OVER q) END AS len{k}" for k in range(4))
OFF = "sqrt(" + " + ".join(f"pow(0.25 * coalesce(w{k} / len{k}, 0), 2)" for k in range(4)) + ")"
AWAY = "sqrt(" + " + ".join(f"pow(0.25 * (coalesce(best{k} / len{k}, 0) - coalesce(w{k} / len{k}, 0)), 2)" for k in range(4)) + ")"
RANKED = f"""
  WITH newest AS ({NEWEST}), ordered AS (SELECT *, {ORDERED} FROM newest), limits AS (SELECT query_id, {LIMITS} FROM ordered GROUP BY query_id),
  clipped AS (SELECT query_id, chunk_id, {CLIPPED}, round({SCALED}, 9) AS scaled FROM newest JOIN limits USING (query_id)),
  units AS (SELECT *, {UNITS} FROM clipped WINDOW q AS (PARTITION BY query_id)),
  parts AS (SELECT query_id, chunk_id, scaled, {OFF} AS o, {AWAY} AS a FROM units),
  closest AS (SELECT query_id, chunk_id, scaled, round(CASE WHEN o + a > 0 THEN o / (o + a) ELSE 0 END, 9) AS closeness FROM parts)
  SELECT query_id, chunk_id, closeness, row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, scaled DESC, chunk_id) AS rank FROM closest
"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {
        "p1_found": AGREEING,
        "p1_groups": GROUPED,
        "p4_neighbours": NEAREST,
        "p4_found": f"SELECT DISTINCT least(chunk_id, neighbour_id) AS chunk_a, greatest(chunk_id, neighbour_id) AS chunk_b FROM ({NEAREST}) WHERE similarity >= 0.80",
        "p2_found": f"""
            SELECT document_id, ordinal FROM (
              SELECT *, {COUNT.format("n.text")} AS t, {COUNT.format("n.context_prefix")} AS p
              FROM (SELECT *, row_number() OVER (PARTITION BY document_id, ordinal ORDER BY built_at DESC) AS k FROM structure_nodes) n
              JOIN chunk_config c ON c.config_id = coalesce(n.config_id, 'default') WHERE k = 1)
            WHERE t > hard_max_tokens OR p + t > embedding_max_tokens
        """,
        "p3_top_chunks": f"SELECT * FROM ({TOP}) WHERE rank <= 5",
        "p3_found": f"SELECT query_id, chunk_id FROM ({TOP}) WHERE rank <= 5",
        "p5_ranking": RANKED,
        "p5_found": f"""
            WITH newest AS (
              SELECT query_id, chunk_id, similarity AS s, bm25_score AS b, fusion_score AS f, CASE WHEN reranker_score::VARCHAR = 'nan' THEN NULL ELSE reranker_score END AS r
              FROM hybrid_results QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY scored_at DESC) = 1)
            SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, {PLACES} FROM newest) WHERE p0 <= 3 AND p1 <= 3 AND p2 <= 3 AND p3 <= 3
        """,
    }
