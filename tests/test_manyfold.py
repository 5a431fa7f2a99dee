import numpy as np
import pytest

from clausewright.operators import manyfold as M
from clausewright.operators import retrieval as R

WORDS = "kettle toaster valve gasket rotor clause annex noise creep torque shall limits".split()


@pytest.mark.parametrize("positive", [False, True])
@pytest.mark.parametrize("n", [3, 700, 2500])
def test_best_equals_brute_force(n, positive):
    rng = np.random.default_rng(n)
    x = np.where(rng.random((n, 40)) < rng.random(40) ** 3, rng.integers(1, 4, (n, 40)) / 4, 0.0) * (1 if positive else rng.choice([-1, 1], 40))
    y = np.where(rng.random((300, 40)) < 0.06, rng.integers(1, 3, (300, 40)) / 2, 0.0)
    y[:2] = 0
    (q, t), (row, term) = np.nonzero(y), np.nonzero(x)
    asked = M.Asked(q, t, y[q, t], np.arange(300))
    lists = M.Lists(row, term, x[row, term], 40)
    least = np.full(300, -np.inf)
    for _ in range(2):  # again with the bounds of the first time
        place, at, score = (np.concatenate(p) for p in zip(*M.best(asked, lists, n, 20, positive, least), strict=True))
        for i, one in enumerate(asked.q):
            want = np.round(x @ y[one], 6)
            order = [k for k in np.lexsort((np.arange(n), -want)) if want[k] > 0 or not positive][:20]
            assert at[place == i].tolist() == order and score[place == i] == pytest.approx(want[order], abs=2e-6)
    assert not any(len(p) for _, p, _ in M.best(asked, lists, n, 20, positive, np.full(300, 1e6)))  # better ones were found before


def test_hybrid_many_equals_hybrid_search_and_builds_no_dense_vectors(spark, monkeypatch):
    """Texts in many copies, in other order, empty or without a word; queries in copies, without words, unknown."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(WORDS, rng.integers(1, 9))) for _ in range(150)] + ["", "of the"]
    docs = spark.createDataFrame([(f"k{rng.integers(10**6):06d}-{i}", texts[i % len(texts)] if i % 3 else texts[7]) for i in range(400)], "key string, text string")
    asked = [" ".join(rng.choice(WORDS, rng.integers(1, 4))) for _ in range(25)] + ["which", "", "lantern", "Kettle, kettle!"]
    queries = spark.createDataFrame([(f"q{i}", asked[i % len(asked)]) for i in range(40)], "query_id string, query string")
    embed = R.hash_embedding()
    rows = lambda df: sorted((r.query_id, r["rank"], r.key, r.fusion_score, r.rerank_score) for r in df.collect())
    want = rows(R.hybrid_search(spark, docs, docs.select("key", embed("text").alias("vector")), queries.withColumn("vector", embed("query")), R.HASH_DIMENSION))
    monkeypatch.setattr(R, "exact_knn", None)
    monkeypatch.setattr(R, "bm25", None)
    assert rows(M.hybrid_many(docs, queries)) == want and len(want) > 150
    monkeypatch.setattr(M, "QUERIES", 7)
    assert rows(M.hybrid_many(docs, queries)) == want


def test_hybrid_many_query_scans_lists(spark, monkeypatch):
    from clausewright.plans import retrieval as P

    monkeypatch.setattr(R, "exact_knn", None)  # which compares every query with every text in 1,536 dimensions
    assert P.QUERIES["hybrid_many"](spark, "/root/testdata/sf0.001").count() > 0


def test_hybrid_many_of_nothing(spark):
    docs, queries = spark.createDataFrame([("a", "kettle")], "key string, text string"), spark.createDataFrame([("q", "kettle")], "query_id string, query string")
    assert M.hybrid_many(docs.where("false"), queries).count() == 0
    assert M.hybrid_many(docs, queries.where("false")).count() == 0
