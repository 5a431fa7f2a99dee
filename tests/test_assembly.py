from clausewright import __main__ as cli
from clausewright import api
from clausewright.functions import text as T
from clausewright.operators import assembly as A
from clausewright.operators import catalog as C
from clausewright.sources import demo
from clausewright.sources.protocols import HashEmbedder
from pyspark.sql import functions as F


def test_texts(spark):
    df = spark.createDataFrame([("a", " ", "a", None, "b")], "p string, q string, r string, s string, t string")
    assert df.select(A.searchable_text(*"pqrst")).first()[0] == "a\nb"
    assert df.select(A.filled("q"), A.filled("p")).first() == (None, "a")
    parts = spark.createDataFrame([("x [E1][E22] y [z",)], "t string").select(T.citation_parts(F.col("t"))).first()[0]
    assert parts == ["x ", "[E1]", "[E22]", " y ", "[", "z"] and "".join(parts) == "x [E1][E22] y [z"
    tokens = spark.createDataFrame([(" Rate_Limit ",), ("token sk-123 leaked",), (None,)], "t string").select(T.error_token(F.col("t"))).collect()
    assert [r[0] for r in tokens] == ["rate_limit", "unknown_error", "unknown_error"]


def test_metadata(spark):
    claims = spark.createDataFrame([("a", ["IS 90001:2001"], "kettle", "T", "product_manual"), ("b", ["IS 90001:2001"], "kettle", None, None), ("c", None, None, None, None), ("d", [], "stove", "IS 90009:1999", None)], "document_id string, standards array<string>, product string, title string, kind string")
    pages = spark.createDataFrame([("a", 1, "kettle"), ("a", 2, "kettle, stove; see IS 90001:2001"), ("b", 1, "Stove under IS 90002:2002"), ("d", 1, None)], "document_id string, page_number int, text string")
    products = spark.createDataFrame([("kettle",), ("stove",)], "product string")
    got = {r.document_id: (r.detected_standards, r.detected_product, r.conflicts, r.status) for r in A.verify_metadata(claims, pages, products).collect()}
    assert got["a"] == ("IS 90001:2001", "kettle", "", "verified")
    assert got["b"] == ("IS 90002:2002", "stove", "standard_number_mismatch,product_mismatch", "needs_review")
    assert got["c"][3] == "verified" and got["d"] == ("IS 90009:1999", None, "standard_number_mismatch", "needs_review")


def test_product_mapping(spark):
    q = spark.createDataFrame([("1", "sealed kettle gasket"), ("2", "IS 90001:2001 please"), ("3", "the it"), ("4", "unknown thing here"), ("5", None)], "query_id string, query string")
    rules = spark.createDataFrame([("kettle", "kettle")], "word string, product string")
    standards = spark.createDataFrame([("kettle", "IS 90001:2001", "Gasket of kettles"), ("kettle", "IS 90002:2002", "Lids"), ("stove", "IS 90003:2003", None)], "product string, standard string, title string")
    got = {(r.query_id, r.standard): (r.basis, r.ambiguous) for r in A.map_products(q, rules, standards).collect()}
    assert got == {("1", "IS 90001:2001"): ("product", False), ("2", "IS 90001:2001"): ("number", False), ("3", None): (None, True), ("4", None): (None, False), ("5", None): (None, True)}


def test_branches_and_answers(spark):
    nan = float("nan")
    one = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.01), ("q", "c", None), ("q", "d", nan)], "query_id string, key string, score double")
    two = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 0.9)], "query_id string, key string, score double")
    assert {(r.key, r.score, r.source, r["rank"]) for r in A.merge_branches({"x": one, "y": two}, 0.05, 5).collect()} == {("a", 1.5, "y", 1), ("b", 0.9, "y", 2)}
    e = spark.createDataFrame([("q", 1, "c1", "IS 90001:2001", "4.1", "Tested under IS 90002:2002.", True), ("q", 2, "c2", None, None, None, True), ("q", 3, "c3", "S", "1", "x", False)], "query_id string, place int, chunk_id string, standard string, clause string, text string, included boolean")
    r = A.assemble_answers(e).first()
    assert r.citations == "E1:c1,E2:c2" and r.answer == "[IS 90001:2001 · clause 4.1] Tested under IS 90002:2002." and (r.sections, r.testing, r.certification, r.guarded) == (1, 1, 0, False)


def test_embedding_records_failures(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "", None, "c"] * 20)], "k long, t string").coalesce(1)
    got = A.embed_batches(rows, "k", "t", HashEmbedder(8), size=7).collect()
    assert len(got) == 80 and all((r.vector is None) == (r.problem is not None) == (r.key % 4 in (1, 2)) for r in got)


def test_graph(spark):
    edges = spark.createDataFrame([("product", "p", "HAS_DOCUMENT", "document", "d"), ("document", "d", "USES_STANDARD", "standard", "s"), ("document", "d", "HAS_CHUNK", "chunk", "c"), ("document", "d", "HAS_STRUCTURAL_UNIT", "unit", "0"), ("standard", "s", "HAS_LABORATORY", "laboratory", "l"), ("standard", "s", "HAS_TESTING_REQUIREMENT", "test", "t")], "source_type string, source_id string, relation string, target_type string, target_id string")
    g = A.Graph(edges)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    of = lambda df: {tuple(r) for r in df.collect()}
    assert of(g.entities("document")) == {("d",)} and of(g.standards_for_product(ids("p", "x"))) == {("p", "s")}
    assert of(g.documents_for_standard(ids("s"))) == {("s", "d")} and of(g.units(ids("d"))) == {("d", "0")} and of(g.chunks(ids("d"))) == {("d", "c")}
    assert of(g.laboratories_for_standard(ids("s"))) == {("s", "l")} and of(g.tests_for_standard(ids("s"))) == {("s", "t")}
    assert of(g.related_documents(ids("s"), "standard")) == {("s", "d")} and of(g.related_documents(ids("d"), "document")) == {("d", "d")}
    assert g.relationships(ids("s"), "standard").count() == 3


def test_api_and_command_line(spark, tmp_path, capsys):
    root = str(tmp_path)
    demo.write(spark, root)
    assert {(r.doc_id, r.snippet is None) for r in api.search(spark, root, "scope").collect()} == {(1, False), (2, True)}
    one = api.document(spark, root, 1).first()
    assert [c.path for c in one.clauses] == ["3.1", "3.1.1"] and one.text and api.document(spark, root, 2).first().text is None
    assert {(r.p_partkey, r.laboratories) for r in api.standards(spark, root).collect()} == {(1, 2), (2, 1)}
    assert [r.s_suppkey for r in api.standard_laboratories(spark, root, 1).collect()] == [1, 2] and api.standard_tests(spark, root, 1).count() == 2
    assert api.standard(spark, root, 1).count() == 1 and api.related_standards(spark, root, 1).count() == 1 and api.standard_documents(spark, root, "IS 90367:1993").count() == 1
    assert {r.place for r in api.laboratories(spark, root).collect()} == {"CANADA", "GERMANY"} and api.laboratory(spark, root, 1).first().standards == 2
    assert {(r.source, r.documents) for r in api.sources(spark, root).collect()} == {("demo", 2), (None, 1)} and api.document_types(spark, root).count() >= 1
    assert api.stats(spark, root).count() == 4 and api.health(spark, root, ("part", "nothing")).where("not readable").count() == 1
    assert api.retrieve(spark, root, "kettles").first().key == 1
    assert {r.column: r.nulls for r in cli.profile(spark, root, "documents").collect()}["text"] == 1
    assert cli.main(["list"]) == 0 and cli.main(["sql", "facets"]) == 0 and cli.main(["tables", root]) == 0 and cli.main(["sql", "nothing"]) == 2 and cli.main([]) == 2
    assert "documents" in capsys.readouterr().out


def test_places_over_all_rows(spark):
    rows = spark.createDataFrame([(k * 7919 % 1000,) for k in range(1000)], "v int").repartition(7)
    got = C.numbered(rows, [F.col("v")], "place").collect()
    assert all(r.place == r.v + 1 for r in got) and len(got) == 1000
    assert C.numbered(rows.where("v < 0"), [F.col("v")], "place").count() == 0
