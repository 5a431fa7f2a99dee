import pytest
from pyspark.sql import functions as F

from clausewright.sources import connectors as K
from clausewright.sources import pages as P
from clausewright.sources import protocols as X


def test_jsonl_keys_and_schema(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"k": "a", "n": 1}\n{"k": "b"}\n')
    assert K.read_jsonl(spark, str(path), "k string, n int", "k").count() == 2
    path.write_text('{"k": "a"}\n{"k": "a"}\n')
    with pytest.raises(ValueError):
        K.read_jsonl(spark, str(path), "k string, n int", "k")


def test_files_and_pdf_checks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4" + b"x" * 2000 + b"%%EOF")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r.path[-5:]: r.valid for r in K.pdf_checks(files).collect()} == {"a.pdf": True, "b.pdf": False}
    assert K.file_hashes(spark, str(tmp_path), "b*").first().sha256.startswith("2cf24dba")


def test_snapshot_log_manifest(spark, tmp_path):
    base = str(tmp_path)
    K.replace_snapshot(spark.createDataFrame([("p", 1), ("q", 2)], "p string, v int"), base + "/snap", "p")
    K.replace_snapshot(spark.createDataFrame([("p", 9)], "p string, v int"), base + "/snap", "p")
    assert {tuple(r) for r in spark.read.parquet(base + "/snap").select("p", "v").collect()} == {("p", 9), ("q", 2)}
    rows = spark.createDataFrame([("a", "FAILED"), ("b", "ok")], "k string, status string")
    K.append_log(rows, base + "/log")
    K.append_log(rows, base + "/log")
    assert spark.read.json(base + "/log").count() == 4
    K.write_manifest(rows, base + "/m", ["failed"])
    assert [r.k for r in spark.read.json(base + "/m/failures_jsonl").collect()] == ["a"]


def test_index_round_trip(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "k string, v array<float>")
    K.save_index(v, str(tmp_path), "k", "v", "h1")
    df, meta = K.load_index(spark, str(tmp_path), "h1")
    assert df.count() == 2 and meta["dimension"] == 2 and meta["unit"]
    with pytest.raises(ValueError):
        K.load_index(spark, str(tmp_path), "h2")


def test_frontier_and_seed(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    got = {r.node: r.depth for r in K.frontier(links, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    have, new = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert {tuple(r) for r in K.seed_missing(have, new, ["k"]).collect()} == {("a", 1), ("b", 3)}
    assert K.retry_delays(5) == [1.0, 2.0, 4.0, 8.0, 8.0]
    assert K.jdbc_options("postgres://u:p%40x@host:5432/db?ssl=true") == {"url": "jdbc:postgresql://host:5432/db?ssl=true", "user": "u", "password": "p@x"}
    assert K.jdbc_options("jdbc:h2:mem:x") == {"url": "jdbc:h2:mem:x"}


def test_frontier_keeps_the_limit_of_a_domain(spark):
    links = spark.createDataFrame([("a/0", f"{d}/{k}") for d in "ab" for k in range(1, 6)] + [("b/1", "b/9")], "source string, target string")
    got = {r.node for r in K.frontier(links, spark.createDataFrame([("a/0",)], "node string"), 3, F.substring("node", 1, 1), 3).collect()}
    assert got == {"a/0", "a/1", "a/2", "b/1", "b/2", "b/3"}


HTML = """<html><head><title>T &amp; U</title><script>x()</script></head><body><h1>Order on kettles</h1><p>Ministry of Steel</p><p>Enforcement from 12 March 2025, IS 367:1993</p>
<table><tr><th>Product name</th><th>x</th></tr><tr><td>Kettle</td><td>1</td></tr><tr><td>Acme Test Labs Pvt</td><td>8123456 Delhi IS 15:2001 suspended</td></tr></table>
<div class="question">Why?</div><div class="answer">Because IS 9</div><a href="/a">a</a><p>open</body>"""


def test_pages(spark):
    page = P.Page(HTML)
    assert page.title == "T & U" and page.links == ["/a"] and "x()" not in "\n".join(page.lines)
    read = lambda t: P.records(P.rule_for(t), page)
    note = read("qco")[0]
    assert (note["title"], note["date"], note["name"], note["publisher"]) == ("Order on kettles", "12 March 2025", "Kettle", "Ministry of Steel")
    (lab,) = read("lab_list")
    assert (lab["code"], lab["state"], lab["status"], lab["standards"]) == ("8123456", "Delhi", "suspended", ["IS 15:2001"])
    assert read("faq")[0]["title"] == "Why?" and read("regulation")[0]["standards"] == ["IS 367:1993"] and read("indigenous_pdf")[0]["title"] == "T & U"
    rows = spark.createDataFrame([(1, "https://h/x", HTML, "qco"), (2, None, None, "odd"), (3, None, HTML, "laboratories")], "k long, u string, h string, t string")
    got = {(r.key, r.kind) for r in P.parse_pages(rows, "k", "u", "h", "t").collect()}
    assert got == {(1, "notice"), (2, "generic"), (3, "laboratory")}
    texts = {r.key: r for r in P.page_texts(rows, "k", "u", "h").collect()}
    assert texts[1].links == ["https://h/a"] and texts[2].text == "" and P.rule_for(None) is None


def test_words(spark):
    rows = [(1, 50.0, 10.2, "world"), (1, 0.0, 9.9, "hello"), (1, 0.0, 30.0, "next"), (1, 9.0, 30.1, " ")]
    lines = K.reconstruct_lines(spark.createDataFrame(rows, "p int, x0 double, bottom double, word string"), ["p"]).orderBy("baseline").collect()
    assert [r.line for r in lines] == ["hello world", "next"]
    wide = spark.createDataFrame([(1, 1.0), (1, 9.0), (2, 5.0), (2, 5.0)], "p int, w double")
    assert {r.p: r.multi_column for r in K.multi_column(wide, ["p"], "w").collect()} == {1: True, 2: False}


def test_grounded_answers():
    assert X.grounded_answer(X.Queue(["no", "yes [E1]"]), "p", {"E1"}) == X.Answer("yes [E1]", 2, None)
    assert X.grounded_answer(X.Queue(["a [E9]", ""]), "p", {"E1"}).problem == "empty_answer"
    assert X.grounded_answer(X.Queue([]), "p", set()).problem == "no_evidence"
    assert X.PlainText().pages(b"a\fb") == ["a", "b"]
