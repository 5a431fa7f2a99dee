import pytest
from pyspark.sql import functions as F

from clausewright.operators import catalog as C
from clausewright.plans.catalog import QUERIES


def frame(spark):
    rows = [(1, "Gasket 50%", "full_text_ok", ["IS 1:2000"], "a"), (2, "gasket_x", "metadata_only", [], None), (3, None, None, None, "b"), (4, "seal", "full_text_ok", ["IS 1:2000", "IS 2:2001"], "a")]
    return spark.createDataFrame(rows, "id long, text string, licence_class string, standards array<string>, kind string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_search_and_filters(spark):
    df = frame(spark)
    assert ids(df.where(C.any_ilike(["text", "kind"], "GASKET"))) == [1, 2]
    assert ids(df.where(C.any_ilike(["text"], "gas_et"))) == [1, 2]
    assert ids(C.all_filters(df, {"kind": "a", "licence_class": None}, {"text": None})) == [1, 4]
    assert ids(C.metadata_mask(df, {"standards": "IS 2:2001"}, ["standards"])) == [4]
    with pytest.raises(ValueError):
        C.metadata_mask(df, {"text": "x"}, ["standards"])


def test_licence_mask_is_total(spark):
    shown = {r.id: r.text for r in C.licence_masked(frame(spark), "text").collect()}
    assert shown == {1: "Gasket 50%", 2: None, 3: None, 4: "seal"}


def test_paging_and_sorting(spark):
    df = frame(spark)
    order = C.sort_by(df, "nope", "sideways", ["text"], "text", "id")
    assert [r.id for r in C.page(df, order, 2, 1).collect()] == [2, 4]
    for bad in (0, 101):
        with pytest.raises(ValueError):
            C.page(df, order, bad)


def test_counts_facets_capabilities(spark):
    df = frame(spark)
    kids = spark.createDataFrame([(1,), (1,), (None,)], "parent long")
    assert {r.id: r.n for r in C.child_counts(df, "id", kids, "parent", "n").collect()} == {1: 2, 2: 0, 3: 0, 4: 0}
    assert {(r.facet, r.value): r.n for r in C.facets(df, ["kind"]).collect()} == {("kind", "a"): 2, ("kind", "b"): 1}
    caps = {r.field: r for r in C.filter_capabilities(df, ["standards", "kind"]).collect()}
    assert caps["standards"].present == 2 and caps["standards"].examples == "IS 1:2000|IS 2:2001" and caps["kind"].state == "partial"
    assert {r.name: r.n for r in C.table_counts({"a": df, "b": kids}).collect()} == {"a": 4, "b": 3}


def test_merging(spark):
    a, b = spark.createDataFrame([("x", 0.4), ("y", 0.4)], "k string, s double"), spark.createDataFrame([("x", 0.9)], "k string, s double")
    assert {tuple(r) for r in C.merge_branches({"kw": a, "vec": b}, "k", "s").collect()} == {("x", 0.9, "kw+vec"), ("y", 0.4, "kw")}
    left, right = spark.createDataFrame([(1, "a", None), (2, " ", "z")], "k int, f string, g string"), spark.createDataFrame([(1, "b", None), (2, "q", "z")], "k int, f string, g string")
    assert {r.k: r.f for r in C.fill_empty(left, right, "k", ["f"]).collect()} == {1: "a", 2: "q"}
    assert {tuple(r) for r in C.changed_fields(left, right, "k", ["f", "g"]).collect()} == {(1, "f"), (2, "f")}
    assert {tuple(r) for r in C.symmetric_difference(left, right.where("k = 1"), "k").collect()} == {(2, "left_only")}
    assert {r.k: r.f for r in C.latest_by(left.unionByName(right.withColumn("f", F.lit("new"))), ["k"], ["f"]).collect()} == {1: "new", 2: "new"}


def test_no_query_shows_text_of_a_closed_licence(spark):
    rows = QUERIES["search_ilike"](spark, "/root/testdata/sf0.001")
    closed = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("licence_class is null or licence_class <> 'full_text_ok'").select("doc_id")
    assert rows.join(closed, "doc_id").where("snippet is not null").count() == 0


def test_filters_reach_the_scan(spark):
    plan = QUERIES["join_inner"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in plan and "c_acctbal" not in plan
