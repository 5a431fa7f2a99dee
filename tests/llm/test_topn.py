import datetime
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from clausewright.llm import topn

SCHEMA = "q string, c string, s double, at timestamp_ntz, g string, extra int"
T0 = datetime.datetime(2025, 1, 1)


def brute(rows, n):
    best = {}
    for q, c, s, at, *_ in rows:
        if q is None or c is None or s is None or s != s:
            continue
        mark = (at is not None, at or T0, s)
        if (q, c) not in best or mark > best[q, c]:
            best[q, c] = mark
    by = {}
    for (q, c), (_, _, s) in best.items():
        by.setdefault(q, []).append((-s, c.encode(), c))
    return {(q, c, -s, k + 1) for q, cs in by.items() for k, (s, _, c) in enumerate(sorted(cs)[:n])}


def run(spark, rows, n, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    scores = topn.latest_scores(df, "q", "c", "s", "at")
    return {(r.g, r.i, r.s, r["rank"]) for r in topn.top_n_by_bisection(scores, n, **kw).collect()}


def test_ties_nulls_repeats_and_late_rows(spark):
    at = lambda k: T0 + datetime.timedelta(days=k)
    rows = [("a", f"c{k:02d}", 0.5, at(0), "x", 1) for k in range(40)]
    rows += [("a", "top", 0.9, at(0), "x", 1), ("a", "top", 0.1, at(5), "x", 1), ("a", "c39", 0.6, at(1), None, None)]
    rows += [("a", "n", None, at(0), "x", 1), ("a", "nan", float("nan"), at(0), "x", 1), (None, "c", 1.0, at(0), "x", 1), ("a", None, 1.0, at(0), "x", 1)]
    rows += [("b", "one", -3.0, None, "x", 1)] * 3
    assert run(spark, rows, 5) == brute(rows, 5)
    assert run(spark, rows, 3, fan_out=2) == brute(rows, 3)


def test_long_shared_prefixes_and_empty(spark):
    rows = [("a", "prefix" * 5 + f"{k:03d}", 1.0, T0, "x", 1) for k in range(300)] + [("a", "prefix", 1.0, T0, "x", 1), ("a", "prefix\0", 1.0, T0, "x", 1)]
    assert run(spark, rows, 7) == brute(rows, 7)
    assert run(spark, [], 5) == set()


def test_hot_group(spark):
    random.seed(3)
    rows = [("hot", f"{random.random():.12f}", round(random.random(), 2), T0, "x", 1) for _ in range(5000)] + [(f"q{k}", "c", 0.1, T0, "x", 1) for k in range(200)]
    rows += [("hot", "inf", float("inf"), T0, "x", 1), ("hot", "ninf", float("-inf"), T0, "x", 1)]
    assert run(spark, rows, 5) == brute(rows, 5)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.text("xyé一", max_size=9), st.sampled_from([0.0, -0.0, 0.1, 1e-300, -5.5, 1e300])), max_size=60))
def test_against_brute_force(spark, items):
    rows = [(q, c, s + 0.0, T0, None, None) for q, c, s in items]
    assert run(spark, rows, 4, fan_out=3) == brute(rows, 4)
