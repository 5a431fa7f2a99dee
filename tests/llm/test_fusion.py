import datetime
import random

from clausewright.llm import fusion

SCHEMA = "q string, c string, a double, b double, at timestamp_ntz, g string"
T0 = datetime.datetime(2025, 1, 1)


def ranking(spark, rows, **kw):
    latest = fusion.latest_candidates(spark.createDataFrame(rows, SCHEMA), "q", "c", ["a", "b"], "at")
    return fusion.ideal_point_ranking(latest, 2, **kw)


def test_range_does_not_matter(spark):
    base = [("q", f"c{k}", float(k), float((k * 7) % 12), T0, "g") for k in range(12)]
    scaled = [(q, c, a * 1e6 - 5e7, b, at, g) for q, c, a, b, at, g in base]
    one = [(r.i, r["rank"]) for r in ranking(spark, base).orderBy("rank").collect()]
    two = [(r.i, r["rank"]) for r in ranking(spark, scaled).orderBy("rank").collect()]
    assert one == two and [k for _, k in one] == list(range(1, 13))


def test_missing_scores_repeats_ties(spark):
    nan = float("nan")
    rows = [("q", "old", 9.0, 9.0, T0, "g"), ("q", "old", 0.0, 0.0, T0 + datetime.timedelta(1), "g"), ("q", "n", None, nan, T0, "g"), ("q", "x", 1.0, 2.0, T0, "g"), ("q", "x", 1.0, 2.0, T0, "g"), ("q", "y", 3.0, 3.0, None, "g"), ("e", "only", None, None, T0, "g"), (None, "z", 1.0, 1.0, T0, "g"), ("t", "b", 1.0, 1.0, T0, "g"), ("t", "a", 1.0, 1.0, T0, "g")]
    got = {(r.g, r.i): r["rank"] for r in ranking(spark, rows).collect()}
    assert got["q", "y"] == 1 and len(got) == 7
    assert got["t", "a"] == 1 and got["t", "b"] == 2 and got["e", "only"] == 1
    assert ranking(spark, []).count() == 0


def test_large_group_is_cut_alike(spark):
    rows = [("q", f"c{k:03d}", float(k % 37), float(k % 11), T0, "g") for k in range(300)]
    whole = {(r.i, r["rank"]) for r in ranking(spark, rows).collect()}
    cut = {(r.i, r["rank"]) for r in ranking(spark, rows, part_rows=10).collect()}
    assert whole == cut


def brute_leaders(rows):
    out = set()
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        for r in own:
            if all(r[k] is not None and sum(o[k] is not None and o[k] > r[k] for o in own) < 3 for k in (2, 3)):
                out.add((g, r[1]))
    return out


def test_leaders_are_first_by_every_score(spark):
    rows = [("q", f"c{k}", float(k), float(100 - k), T0, "g") for k in range(20)] + [("q", "lead", 18.5, 98.5, T0, "g")]
    r = ranking(spark, rows)
    assert [x.i for x in fusion.leaders(r, 2).collect()] == ["lead"]
    assert r.where("rank = 1").select("i").first()[0] == "lead"


def test_head_of_the_ranking_holds_all_leaders(spark):
    pick = random.Random(3)
    value = lambda: pick.choice([None, float(pick.randint(0, 6)), pick.gauss(0, 100)])
    rows = [(f"q{g}", f"c{k:02d}", value(), value(), T0, "g") for g in range(60) for k in range(pick.choice([1, 2, 5, 15, 40]))]
    rows += [("same", f"c{k:02d}", 1.0, 2.0, T0, "g") for k in range(30)]
    want = brute_leaders(rows)
    got = {(x.g, x.i) for x in fusion.leaders(ranking(spark, rows), 2).collect()}
    assert got == want and len(want) > 60
    assert {(x.g, x.i) for x in fusion.leaders(ranking(spark, rows, part_rows=3), 2).collect()} == want


def test_third_best_counts_equal_values(spark):
    rows = spark.createDataFrame([("q", str(k), v) for k, v in enumerate([5.0, 5.0, 4.0, 3.0, None])] + [("r", "1", None)], "g string, i string, x0 double")
    got = {r.g: (r.n, r.t0) for r in fusion.group_statistics(rows, 1).collect()}
    assert got == {"q": (5, 4.0), "r": (1, None)}
