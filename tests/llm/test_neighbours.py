import numpy as np

from clausewright.llm import neighbours as N

SCHEMA = "chunk_id string, embedding array<float>, id string, v int"


def brute(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = set()
    for r, i in enumerate(ids):
        s[r, r] = -9
        for c in np.lexsort((np.arange(len(ids)), -s[r]))[: min(k, len(ids) - 1)]:
            out.add((i, ids[c]))
    return out


def data(n=900, copies=40):
    random = np.random.default_rng(5)
    centres = random.normal(size=(60, 24))
    vectors = {f"c{k:04d}": (centres[random.integers(60)] + random.normal(size=24) * 0.3).tolist() for k in range(n)}
    same = random.normal(size=24).tolist()
    return vectors | {f"s{k:03d}": same for k in range(copies)}


def rows_of(vectors):
    nan = float("nan")
    return [(i, v, "x", 1) for i, v in vectors.items()] + [("c0001", vectors["c0001"], None, None), ("bad1", None, "x", 1), ("bad2", [0.0] * 24, "x", 1), ("bad3", [1.0] * 23, "x", 1), ("bad4", [nan] + [1.0] * 23, "x", 1), ("bad5", [None] + [1.0] * 23, "x", 1), (None, [1.0] * 24, "x", 1)]


def test_recall_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_SIZE", 64)
    monkeypatch.setattr(N, "MEMBER_BLOCK", 50)
    monkeypatch.setattr(N, "QUERY_BLOCK", 100)
    vectors = data()
    df = spark.createDataFrame(rows_of(vectors), SCHEMA)
    want = brute(vectors, 5)
    found = N.nearest_vectors(df, "chunk_id", "embedding", 24, 5).collect()
    got = {(r.id, r.other) for r in found}
    assert len(got & want) / len(want) > 0.97
    assert {(i, o) for i, o in want if i.startswith("s")} <= got
    ranks = {}
    for r in found:
        ranks.setdefault(r.id, []).append(r["rank"])
    assert all(sorted(x) == [1, 2, 3, 4, 5] for x in ranks.values()) and set(ranks) == set(vectors)
    near = N.nearest_vectors(df, "chunk_id", "embedding", 24, 5, least=0.8).collect()
    assert {(r.id, r.other) for r in near} == {(r.id, r.other) for r in found if r.similarity >= 0.8}


def test_empty_and_single(spark):
    assert N.nearest_vectors(spark.createDataFrame([], SCHEMA), "chunk_id", "embedding", 24).count() == 0
    assert N.nearest_vectors(spark.createDataFrame([("a", [1.0] * 24, "x", 1)], SCHEMA), "chunk_id", "embedding", 24).count() == 0


def test_lists_grow_with_vectors_and_dense_regions():
    random = np.random.default_rng(2)
    x = random.normal(size=(2000, 16))
    x[:700] = x[0] + random.normal(size=(700, 16)) * 0.01  # a third of all in a small region
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sizes = [N.Quantiser(x, total) for total in (2_000, 20_000, 200_000)]
    assert [len(q.subs) for q in sizes][0] == 1 and sizes[0].lists < sizes[1].lists < sizes[2].lists
    assert [q.visited(16) for q in sizes] == sorted(q.visited(16) for q in sizes) and sizes[2].visited(16) > 16
    dense = np.bincount(sizes[2].encode(x[:700].astype(np.float32))[0])
    assert dense.max() * 100 < 4 * 4 * N.LIST_SIZE * 10
    at = sizes[2].encode(x.astype(np.float32))[0]
    visited = sizes[2].probes(x.astype(np.float32), 16)
    assert np.mean((visited == at[:, None]).any(1)) > 0.95 and all(len(set(r)) == len(r) for r in visited[:50])


def test_two_levels_of_lists_keep_the_recall(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_SIZE", 8)
    monkeypatch.setattr(N, "CELLS", 10)
    vectors = data()
    want = brute(vectors, 5)
    got = {(r.id, r.other) for r in N.nearest_vectors(spark.createDataFrame(rows_of(vectors), SCHEMA), "chunk_id", "embedding", 24, 5).collect()}
    assert len(got & want) / len(want) > 0.95
