"""Evidence packages, sufficiency, confidence, citations, evaluation and graph edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import materialize

STATUS = ("VERIFIED", "UNVERIFIED", "REQUIRES_REVIEW")
POSITIVE, STRONG = 0.0, 3.0


def budgeted(evidence: DataFrame, query: str, rank: str, text: str, budget: int) -> DataFrame:
    """Evidence in rank order with ``included``: while the characters and two per separator fit; nothing after the first that does not."""
    w = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    place = Window.partitionBy(query).orderBy(rank)
    used = F.sum(F.length(F.coalesce(text, F.lit("")))).over(w) + 2 * (F.row_number().over(place) - 1)
    return evidence.withColumn("used", used).withColumn("included", F.col("used") <= budget)


def sufficiency(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """State and reason per query from aggregated signals, by ordered rules.

    ``evidence``: query_id, text, standard, clause, reranker_score, in_bm25,
    in_semantic, included. ``queries``: query_id, query. A query without
    evidence is INSUFFICIENT. The terms of a query's included evidence, which
    its budget bounds, are the only thing gathered.
    """
    evidence = materialize(evidence)
    asked = F.coalesce("query", F.lit(""))
    structure = F.lower(F.regexp_extract(asked, r"(?i)\b((?:annex|table)\s+[A-Z0-9][A-Z0-9.-]*)", 1))
    q = queries.select(
        "query_id", T.guard_tokens(asked).alias("terms"), F.regexp_extract(asked, T.PATTERNS["standard_query"], 1).alias("std_no"), F.regexp_extract(asked, T.PATTERNS["standard_query"], 2).alias("std_year"),
        F.regexp_extract(asked, T.PATTERNS["clause"], 1).alias("asked_clause"), structure.alias("asked_structure"),
        F.filter(F.transform(F.split(asked, r"(?i)\b(?:and|plus|also)\b"), T.guard_tokens), lambda t: F.size(t) > 0).alias("segments"),
    )
    e = evidence.where("included").join(q, "query_id")
    actual = lambda k: F.regexp_extract("standard", T.PATTERNS["standard_strict"], k)
    standard = F.coalesce((F.col("std_no") != "") & (actual(1) == F.col("std_no")) & ((F.col("std_year") == "") | (actual(2) == F.col("std_year"))), F.lit(False))
    clause = F.coalesce((F.col("asked_clause") != "") & (F.col("clause") == F.col("asked_clause")), F.lit(False))
    whole = F.concat_ws("\n", "standard", "clause", "text")
    structural = (F.col("asked_structure") != "") & F.contains(F.lower(whole), F.col("asked_structure"))
    own = T.guard_tokens(whole)
    overlap = F.size(F.array_intersect("terms", own)) > 0
    positive = F.coalesce(F.col("reranker_score") >= POSITIVE, F.lit(False))
    strong = F.coalesce(F.col("reranker_score") >= STRONG, F.lit(False)) & F.col("in_semantic")
    supports = standard | clause | structural | (positive & (F.col("in_bm25") | overlap)) | strong
    flags = ("standard_hit", "clause_hit", "structure_hit", "lexical", "in_bm25", "supports")
    flagged = e.select("query_id", standard.alias("standard_hit"), clause.alias("clause_hit"), structural.alias("structure_hit"), overlap.alias("lexical"), "in_bm25", supports.alias("supports"), own.alias("own"))
    signals = flagged.groupBy("query_id").agg(F.count(F.lit(1)).alias("included"), *(F.count_if(F.col(c)).alias(c) for c in flags), F.array_distinct(F.flatten(F.collect_set("own"))).alias("known"))
    omitted = evidence.groupBy("query_id").agg(F.count_if(~F.col("included")).alias("omitted"))
    s = q.join(signals, "query_id", "left").join(omitted, "query_id", "left").na.fill(0, ["included", *flags, "omitted"]).withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    identifiers = T.guard_tokens(F.concat_ws(" ", F.lit("clause annex table"), F.when(F.col("std_no") != "", F.concat(F.lit("IS "), "std_no", F.lit(" "), "std_year")), "asked_clause", "asked_structure"))
    subject = F.array_except("terms", identifiers)
    needed = lambda t: F.when(F.size(t) <= 3, F.size(t)).otherwise(F.floor((F.size(t) + 1) / 2))
    met = F.size(F.filter("segments", lambda t: F.size(F.array_intersect(t, F.col("known"))) >= needed(t)))
    asked_std, asked_clause = F.col("std_no") != "", F.col("asked_clause") != ""
    exact = (F.col("standard_hit") > 0) | (F.col("clause_hit") > 0) | (F.col("structure_hit") > 0)
    supported = F.col("supports") > 0
    rules = [
        (F.col("included") == 0, "INSUFFICIENT", "empty_evidence"),
        (asked_std & (F.col("standard_hit") == 0), "INSUFFICIENT", "unresolved_exact_standard"),
        (asked_clause & (F.col("clause_hit") == 0) & (F.col("standard_hit") > 0) & supported, "PARTIAL", "unresolved_exact_clause"),
        (asked_clause & (F.col("clause_hit") == 0), "INSUFFICIENT", "unresolved_exact_clause"),
        (exact & (F.size(subject) > 0) & (F.size(F.array_intersect(subject, F.col("known"))) == 0), "PARTIAL", "exact_identifier_only_support"),
        ((F.size("segments") >= 2) & (met > 0) & (met < F.size("segments")) & supported, "PARTIAL", "compound_query_partially_supported"),
        ((F.col("omitted") > 0) & supported, "PARTIAL", "context_budget_omitted_evidence"),
        (supported & exact, "SUFFICIENT", "exact_identifier_match"),
        (supported, "SUFFICIENT", "multi_signal_support"),
        ((F.col("in_bm25") == 0) & (F.col("lexical") == 0) & ~asked_std & ~asked_clause, "OUT_OF_DOMAIN", "no_domain_alignment"),
    ]
    pick = lambda k, rest: reduce(lambda c, r: c.when(r[0], r[k]), rules[1:], F.when(rules[0][0], rules[0][k])).otherwise(rest)
    return s.select("query_id", pick(1, "INSUFFICIENT").alias("state"), pick(2, "weak_evidence_support").alias("reason"), F.col("included").alias("n_included"), F.col("supports").alias("n_supporting"))


def confidence(count: Column, top: Column, has_standard: Column) -> Column:
    """high, medium, low or none from the hits, their best score and whether a standard matched."""
    return F.when((count >= 3) & (top >= 0.55) & has_standard, "high").when((count >= 2) & (top >= 0.35), "medium").when(count >= 1, "low").otherwise("none")


def recall_and_rank(results: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query of ``truth`` (query_id, key): recall at each k and the reciprocal rank of the first hit.

    ``results`` has query_id, key, rank; ``truth`` may repeat a key. A query
    without known truth is absent; one without hits has zeros.
    """
    wanted = truth.distinct()
    size = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    hits = wanted.join(results.select("query_id", "key", "rank"), ["query_id", "key"]).groupBy("query_id").agg(*(F.countDistinct(F.when(F.col("rank") <= k, F.col("key"))).alias(f"h{k}") for k in ks), F.min("rank").alias("first"))
    both = size.join(hits, "query_id", "left")
    return both.select("query_id", "expected", *(F.round(F.coalesce(F.col(f"h{k}"), F.lit(0)) / F.col("expected"), 6).alias(f"recall_{k}") for k in ks), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def failure_kind(expected: Column, candidates: Column, found_10: Column, found_5: Column, found_1: Column) -> Column:
    """First failure that applies: no_ground_truth, no_candidates, not_retrieved, below_final, not_first, none."""
    return F.when(F.coalesce(expected, F.lit(0)) == 0, "no_ground_truth").when(F.coalesce(candidates, F.lit(0)) == 0, "no_candidates").when(found_10 == 0, "not_retrieved").when(found_5 == 0, "below_final").when(found_1 == 0, "not_first").otherwise("none")


def latency_summary(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """count, mean, median (interpolated), p95 (nearest rank), min and max of a measure per group."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, 0.5), 6).alias("median"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"), F.min(value).alias("least"), F.max(value).alias("most"),
    )


def status_level(status: Column) -> Column:
    """Position of a status in the lattice; null counts as UNVERIFIED."""
    return F.coalesce(*(F.when(status == s, k) for k, s in enumerate(STATUS)), F.lit(1))


def highest_status(level: Column) -> Column:
    """The status of the greatest level; null (no member) is UNVERIFIED."""
    return F.coalesce(F.element_at(F.array(*map(F.lit, STATUS)), F.max(level) + 1), F.lit("UNVERIFIED"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges (source_type, source_id, relation, target_type, target_id, status, provenance) merged: highest status, sorted distinct provenance, stable id."""
    keys = ["source_type", "source_id", "relation", "target_type", "target_id"]
    merged = edges.groupBy(*keys).agg(highest_status(status_level(F.col("status"))).alias("status"), F.array_join(F.sort_array(F.collect_set("provenance")), "|").alias("provenance"))
    return merged.withColumn("relationship_id", T.stable_id("rel_", *(F.col(k) for k in keys)))


def gate_row(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, failures, passed) of named row predicates in one pass; a null predicate fails."""
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    return counts.unpivot([], list(checks), "check", "failures").withColumn("passed", F.col("failures") == 0)
