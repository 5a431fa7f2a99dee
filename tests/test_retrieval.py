import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.operators import evidence as E
from clausewright.operators import retrieval as R

DOCS = [("a", "kettle safety test"), ("b", "IS 367:1993 electric kettle"), ("c", "Clause 1.3.1 scope"), ("d", None), ("e", "kettle kettle test")]


def brute_bm25(docs, query):
    tokens = {k: (t or "").lower().replace(",", "").split() for k, t in docs}
    n, mean = len(docs), sum(map(len, tokens.values())) / len(docs)
    scores = Counter()
    for q, qtf in Counter(query.lower().split()).items():
        df = sum(q in t for t in tokens.values())
        for k, t in tokens.items():
            tf = t.count(q)
            if tf:
                scores[k] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean)) * qtf
    return {k: round(s, 6) for k, s in scores.items()}


@pytest.mark.parametrize("batch", [4096, 2])
def test_bm25(spark, batch, monkeypatch):
    monkeypatch.setattr(R, "BATCH", batch)
    docs = spark.createDataFrame(DOCS, "key string, text string")
    asked = [("1", "kettle test test"), ("2", "IS 367:1993"), ("3", "nothing")]
    got = R.bm25(docs, "key", "text", spark.createDataFrame(asked, "query_id string, query string"), 3).collect()
    for q, text in asked:
        want = brute_bm25(DOCS, text)
        assert {r.key: r.score for r in got if r.query_id == q} == pytest.approx({k: want[k] for k in sorted(want, key=lambda k: (-want[k], k))[:3]}, abs=2e-6)


def test_fusion_value(spark):
    one = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, key string, rank int")
    two = spark.createDataFrame([("q", "a", 1), ("q", "c", 2)], "query_id string, key string, rank int")
    got = {r.key: (r.fusion_score, r.fusion_rank) for r in R.reciprocal_rank_fusion({"s": one, "b": two}).collect()}
    assert got["a"] == (round(2 / 61, 8), 1) and got["b"] == (round(1 / 62, 8), 2) and got["c"][1] == 3


@pytest.mark.parametrize("budget", [1 << 20, 64])
def test_exact_knn(spark, budget):
    x = np.random.default_rng(1).normal(size=(300, 8)).astype(np.float32)
    rows = [(k, x[k].tolist()) for k in range(300)] + [(999, None), (998, [1.0])]
    df = spark.createDataFrame(rows, "key long, v array<float>")
    got = R.exact_knn(df, "key", "v", df.where("key < 5").selectExpr("key as query_id", "v as vector"), 8, 4, budget=budget).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(5):
        s = np.round(u @ u[q], 6)
        assert [r.key for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(300), -s))[:4].tolist()


def test_identifier_states(spark):
    rows = spark.createDataFrame([(["IS 367:1993"],), (["IS 15:2001", "IS 15:2011"],), (None,)], "s array<string>")
    assert R.resolve_identifier(rows, "s", "kettles") == ("none", None)
    assert R.resolve_identifier(rows, "s", "what is IS 367?") == ("pinned", "IS 367:1993")
    assert R.resolve_identifier(rows, "s", "IS 15") == ("ambiguous", None)
    assert R.resolve_identifier(rows, "s", "IS 15:2011") == ("pinned", "IS 15:2011")
    assert R.resolve_identifier(rows, "s", "IS 99") == ("unknown", None)


def test_index_problems_and_hash_embedding(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [nan, 0.0]), ("e", [0.0, 0.0])], "k string, v array<float>")
    assert {r.problem: r.n for r in R.index_problems(df, "k", "v", 2).collect()} == {"missing_vector": 1, "wrong_dimension": 1, "not_finite": 1, "all_zero": 1, "repeated_key": 1}
    embed = R.hash_embedding(64)
    rows = spark.createDataFrame([("kettle test",), ("test Kettle!",), (None,), ("of the",)], "t string").select(embed("t").alias("v")).collect()
    assert rows[0].v == rows[1].v and abs(np.linalg.norm(rows[0].v) - 1) < 1e-6 and not any(rows[2].v) and not any(rows[3].v)


def test_hybrid_search(spark):
    embed = R.hash_embedding(64)
    docs = spark.createDataFrame([x for x in DOCS if x[1]], "key string, text string")
    queries = spark.createDataFrame([("q", "electric kettle IS 367:1993")], "query_id string, query string").withColumn("vector", embed("query"))
    top = R.hybrid_search(spark, docs, docs.select("key", embed("text").alias("vector")), queries, 64, 2).orderBy("rank").collect()
    assert top[0].key == "b" and [r["rank"] for r in top] == [1, 2]


def test_budget_is_a_prefix(spark):
    rows = [("q", k, "x" * n) for k, n in enumerate([50, 40, 100, 1], 1)]
    got = E.budgeted(spark.createDataFrame(rows, "q string, rank int, text string"), "q", "rank", "text", 100).collect()
    assert [r.included for r in sorted(got, key=lambda r: r["rank"])] == [True, True, False, False]


def test_recall(spark):
    results = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3), ("r", "z", 1)], "query_id string, key string, rank int")
    truth = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "b"), ("r", "y")], "query_id string, key string")
    got = {r.query_id: r for r in E.recall_and_rank(results, truth).collect()}
    assert (got["q"].recall_1, got["q"].recall_3, got["q"].reciprocal_rank) == (0.5, 1.0, 1.0) and got["r"].reciprocal_rank == 0.0


def test_sufficiency_rules(spark):
    queries = spark.createDataFrame([("1", "kettle safety"), ("2", "IS 9:2000 kettle"), ("3", "astronomy"), ("4", "IS 5:2001 clause 4.1 kettle"), ("5", "kettle"), ("6", "kettle safety"), ("7", "IS 5:2001 lanterns"), ("8", "kettle safety and lantern colour"), ("9", "Annex B sizes")], "query_id string, query string")
    e = [("1", "kettle safety text", "IS 5:2001", "4.2", 1.0, True, True, True), ("2", "kettle", "IS 5:2001", "1", 1.0, True, True, True), ("3", "plants", None, None, -5.0, False, False, True), ("4", "kettle", "IS 5:2001", "4.2", 1.0, True, True, True), ("6", "kettle safety", "IS 5:2001", "1", 2.0, True, True, True), ("6", "kettle", "IS 5:2001", "1", 2.0, True, True, False)]
    e += [("7", "kettle", "IS 5:2001", "1", 1.0, True, True, True), ("8", "kettle safety", None, None, 1.0, True, True, True), ("9", "sizes of ANNEX B", None, None, -1.0, False, False, True)]
    got = {r.query_id: (r.state, r.reason) for r in E.sufficiency(spark.createDataFrame(e, "query_id string, text string, standard string, clause string, reranker_score double, in_bm25 boolean, in_semantic boolean, included boolean"), queries).collect()}
    assert got == {"1": ("SUFFICIENT", "multi_signal_support"), "2": ("INSUFFICIENT", "unresolved_exact_standard"), "3": ("OUT_OF_DOMAIN", "no_domain_alignment"), "4": ("PARTIAL", "unresolved_exact_clause"), "5": ("INSUFFICIENT", "empty_evidence"), "6": ("PARTIAL", "context_budget_omitted_evidence"), "7": ("PARTIAL", "exact_identifier_only_support"), "8": ("PARTIAL", "compound_query_partially_supported"), "9": ("SUFFICIENT", "exact_identifier_match")}


def test_edges_merge(spark):
    rows = [("p", "1", "HAS", "d", "2", "VERIFIED", "m"), ("p", "1", "HAS", "d", "2", "REQUIRES_REVIEW", "c"), ("p", "1", "HAS", "d", "3", None, "c")]
    got = {r.target_id: (r.status, r.provenance) for r in E.merge_edges(spark.createDataFrame(rows, "source_type string, source_id string, relation string, target_type string, target_id string, status string, provenance string")).collect()}
    assert got == {"2": ("REQUIRES_REVIEW", "c|m"), "3": ("UNVERIFIED", "c")}


def test_hybrid_many_answers_every_query(spark):
    from clausewright.plans import retrieval as P

    root = "/root/testdata/sf0.001"
    queries = P.every_query(spark, root)
    many = {}
    for r in P.QUERIES["hybrid_many"](spark, root).collect():
        many.setdefault(r.query_id, []).append((r["rank"], r.key, r.fusion_score, r.rerank_score))
    assert set(many) == {r.query_id for r in queries.collect()} and len(many) > 4
    some = sorted(many)[:3]
    alone = {}
    for r in P.hybrid(spark, root, queries.where(F.col("query_id").isin(some))).collect():
        alone.setdefault(r.query_id, []).append((r["rank"], r.key, r.fusion_score, r.rerank_score))
    assert {q: sorted(many[q]) for q in some} == {q: sorted(alone[q]) for q in some}


def test_exact_knn_equal_scores_go_by_key(spark):
    rows = [(f"k{k:04d}", [1.0, 0.0] if k % 3 else [0.0, 1.0]) for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, v array<float>").repartition(5)
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0])], "query_id string, vector array<float>")
    got = {(r.query_id, r["rank"]): r.key for r in R.exact_knn(df, "key", "v", asked, 2, 3).collect()}
    assert got == {("a", 1): "k0001", ("a", 2): "k0002", ("a", 3): "k0004", ("b", 1): "k0000", ("b", 2): "k0003", ("b", 3): "k0006"}
