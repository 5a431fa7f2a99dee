import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausewright.llm import packing


def check(counts, capacity, places, bins):
    load, placed, large = Counter(), Counter(), Counter()
    for size, n, first, per in places:
        placed[size] += n
        for k in range(n):
            load[first + k // per] += size
            large[first + k // per] += 3 * size > capacity
    assert placed == Counter({s: n for s, n in counts.items() if n and s})
    assert max(load.values(), default=0) <= capacity and sorted(load) == list(range(bins))
    assert max(large.values(), default=0) <= 2
    return load


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 60), max_size=25), st.integers(40, 60))
def test_plan_is_valid(counts, capacity):
    places, bins = packing.plan_bins(counts, capacity)
    check(counts, capacity, places, bins)
    total = sum(s * n for s, n in counts.items())
    assert bins >= -(-total // capacity)


def test_plan_fills_well_and_does_not_grow_with_items():
    random.seed(2)
    counts = Counter(min(100, int(random.expovariate(1 / 30)) + 1) for _ in range(20000))
    places, bins = packing.plan_bins(counts, 100)
    check(counts, 100, places, bins)
    assert sum(s * n for s, n in counts.items()) / (bins * 100) > 0.97
    many, _ = packing.plan_bins({s: n * 1000 for s, n in counts.items()}, 100)
    assert len(many) < 4 * 100


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_A_PART", 10)
    random.seed(4)
    rows = [(f"d{k}", random.choice([7, 7, 7, 3, 12, 50, 0, None, 33]), k) for k in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "doc string, n int, size int"), "doc", "n", 20).collect()
    load, own = Counter(), {}
    for r in got:
        own.setdefault(r.doc, []).append((r.piece, r.first_token, r.n_tokens))
        if r.n_tokens:
            load[r.bin_id] += r.n_tokens
        else:
            assert r.bin_id is None
    assert max(load.values()) <= 20 and sorted(load) == list(range(len(load)))
    for doc, n, _ in rows:
        pieces = sorted(own[doc])
        assert sum(p[2] for p in pieces) == (n or 0)
        assert [p[1] for p in pieces] == [sum(x[2] for x in pieces[:k]) for k in range(len(pieces))]
        assert len(pieces) == max(1, -(-(n or 0) // 20))
    again = packing.pack(spark.createDataFrame(rows, "doc string, n int, size int").repartition(7), "doc", "n", 20).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_empty_and_bad_capacity(spark):
    none = spark.createDataFrame([], "doc string, n int")
    assert packing.pack(none, "doc", "n", 5).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, "doc", "n", 0)
