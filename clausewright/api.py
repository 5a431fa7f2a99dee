"""The catalogue's questions as functions: each takes the session and a table folder and returns a DataFrame.

These are what the endpoints of a service would call; nothing here serves HTTP.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import catalog as C
from .operators import documents as D
from .operators import retrieval as R
from .sources.tables import table

SEARCHED = ("title", "is_number", "text")
SORTS = ("title", "is_number", "parsed_at")


def health(s: SparkSession, root: str, tables: tuple[str, ...] = ("documents", "part", "supplier")) -> DataFrame:
    """(table, readable, problem) of each table the catalogue needs."""
    rows = []
    for t in tables:
        try:
            table(s, root, t)
            rows.append((t, True, None))
        except Exception as e:
            rows.append((t, False, type(e).__name__))
    return s.createDataFrame(rows, "table string, readable boolean, problem string")


def stats(s: SparkSession, root: str, tables: tuple[str, ...] = ("documents", "part", "supplier", "lineitem")) -> DataFrame:
    """Rows of each table."""
    return C.table_counts({t: table(s, root, t) for t in tables})


def search(s: SparkSession, root: str, text: str = "", licence: str | None = None, source: str | None = None, size: int = 20, skip: int = 0) -> DataFrame:
    """Documents that hold the text in title, number or body, with text only under an open licence: a page of them by title."""
    docs = C.all_filters(table(s, root, "documents"), {"licence_class": licence, "source": source})
    hits = docs.where(C.any_ilike(SEARCHED, text)) if text.strip() else docs
    shown = F.when(F.col("licence_class") == C.OPEN_LICENCE, F.substring("text", 1, C.SNIPPET)).alias("snippet")
    return C.page(hits, [F.asc_nulls_last("title"), F.asc("doc_id")], size, skip).select("doc_id", "title", "is_number", "licence_class", shown)


def document(s: SparkSession, root: str, doc_id: int) -> DataFrame:
    """One row of a document with its clause tree; its text only under an open licence."""
    one = table(s, root, "documents").where(F.col("doc_id") == doc_id)
    clauses = D.with_parent(D.clause_rows(D.lines_of(one, ["doc_id"], "text"), ["doc_id"]), ["doc_id"])
    tree = clauses.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "path", "title", "parent_path", "depth"))).alias("clauses"))  # the clauses of one document
    return one.join(tree, "doc_id", "left").select("doc_id", "title", "is_number", "licence_class", F.when(F.col("licence_class") == C.OPEN_LICENCE, F.col("text")).alias("text"), "clauses")


def document_types(s: SparkSession, root: str) -> DataFrame:
    """Documents of each type that their titles tell."""
    return table(s, root, "documents").groupBy(T.first_hint(F.coalesce("title", F.lit(""))).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def standards(s: SparkSession, root: str, name: str = "", size: int = 20, skip: int = 0) -> DataFrame:
    """A page of standards by name, with how many laboratories test each."""
    hits = table(s, root, "part").where(C.any_ilike(["p_name", "p_type"], name)) if name.strip() else table(s, root, "part")
    some = C.page(hits, [F.asc("p_name"), F.asc("p_partkey")], size, skip).select("p_partkey", "p_name", "p_type")
    labs = table(s, root, "lineitem").join(some.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("laboratories"))
    return some.join(labs, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_name", "p_type", F.coalesce("laboratories", F.lit(0)).alias("laboratories"))


def standard(s: SparkSession, root: str, key: int) -> DataFrame:
    """One standard."""
    return table(s, root, "part").where(F.col("p_partkey") == key)


def standard_laboratories(s: SparkSession, root: str, key: int) -> DataFrame:
    """Laboratories that test a standard, by name."""
    ids = table(s, root, "lineitem").where(F.col("l_partkey") == key).select("l_suppkey").distinct()
    return table(s, root, "supplier").join(ids, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name").orderBy("s_name", "s_suppkey")


def standard_tests(s: SparkSession, root: str, key: int) -> DataFrame:
    """Tests of a standard: laboratory, test, times."""
    return table(s, root, "lineitem").where(F.col("l_partkey") == key).groupBy("l_suppkey", F.col("l_returnflag").alias("test")).agg(F.count(F.lit(1)).alias("n"))


def standard_documents(s: SparkSession, root: str, number: str) -> DataFrame:
    """Documents of a standard's number, newest first."""
    return table(s, root, "documents").where(F.col("is_number") == number).select("doc_id", "title", "licence_class", "parsed_at").orderBy(F.desc_nulls_last("parsed_at"), "doc_id")


def related_standards(s: SparkSession, root: str, key: int) -> DataFrame:
    """Other standards of the same type."""
    one = table(s, root, "part").where(F.col("p_partkey") == key).select("p_type")
    return table(s, root, "part").where(F.col("p_partkey") != key).join(one, "p_type", "left_semi").select("p_partkey", "p_name")


def laboratories(s: SparkSession, root: str, name: str = "", nation: str | None = None, size: int = 20, skip: int = 0) -> DataFrame:
    """A page of laboratories by name and place."""
    rows = table(s, root, "supplier").join(F.broadcast(table(s, root, "nation")), F.col("s_nationkey") == F.col("n_nationkey"), "left")  # the nations of the world
    hits = C.all_filters(rows.where(C.any_ilike(["s_name"], name)) if name.strip() else rows, {"n_name": nation})
    return C.page(hits, [F.asc("s_name"), F.asc("s_suppkey")], size, skip).select("s_suppkey", "s_name", F.col("n_name").alias("place"))


def laboratory(s: SparkSession, root: str, key: int) -> DataFrame:
    """One laboratory with the standards it tests."""
    tested = table(s, root, "lineitem").where(F.col("l_suppkey") == key).groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("standards"))
    return table(s, root, "supplier").where(F.col("s_suppkey") == key).join(tested, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "s_name", F.coalesce("standards", F.lit(0)).alias("standards"))


def sources(s: SparkSession, root: str) -> DataFrame:
    """Sources of the documents with how many each has and when it was last read."""
    return table(s, root, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("parsed_at").alias("last"))


def retrieve(s: SparkSession, root: str, text: str, k: int = 20) -> DataFrame:
    """The ``k`` best documents for a question by BM25."""
    return R.bm25(table(s, root, "documents"), "doc_id", "text", s.createDataFrame([("q", text)], "query_id string, query string"), k).drop("query_id")
