"""Small in-memory tables of the catalogue, for demonstrations and tests: the same queries over arrays."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

T0 = datetime(2025, 1, 1)
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long, title string, is_number string, licence_class string, parsed_at timestamp_ntz", [
        (1, "3.1 Scope\n3.1.1 Kettles\nThe kettle is earthed.", "en", "demo", 47, "Electric kettles", "IS 90367:1993", "full_text_ok", T0),
        (2, "3.1 Scope\nHidden text", "en", "demo", 20, "Gas heaters", "IS 90015:2001", "metadata_only", T0),
        (3, None, None, None, 0, None, None, None, None),
    ]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(1, "Northern laboratory", 3, 10.0), (2, "Southern laboratory", 7, 20.0)]),
    "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(1, "kettle standard", "B1", "STANDARD", 3, 1.0), (2, "heater standard", "B2", "STANDARD", 9, 2.0)]),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string", [(1, 1, 1, 1, "N", "O"), (1, 1, 2, 2, "R", "F"), (2, 2, 1, 1, "N", "O")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(3, "CANADA", 1), (7, "GERMANY", 3)]),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    """A demonstration table by the name it has in storage."""
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def write(spark: SparkSession, root: str) -> None:
    """Write every demonstration table under ``root``, where the queries read them."""
    for name in TABLES:
        table(spark, name).write.mode("overwrite").parquet(f"{root}/{name}.parquet")
