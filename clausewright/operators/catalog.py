"""Relational catalogue operators: search, filters, masks, counts, facets, paging."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

OPEN_LICENCE = "full_text_ok"
SNIPPET = 420


def any_ilike(columns: Iterable[str], query: str) -> Column:
    """Whether any of the columns contains ``query``; % and _ in it are wildcards. Null never matches."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).cast("string").ilike(f"%{query}%"), F.lit(False)) for c in columns))


def all_filters(df: DataFrame, equal: Mapping[str, object | None] | None = None, like: Mapping[str, str | None] | None = None) -> DataFrame:
    """Rows that meet every supplied filter; a filter of None is not supplied."""
    for column, value in (equal or {}).items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    for column, value in (like or {}).items():
        if value is not None:
            df = df.where(F.col(column).ilike(f"%{value}%"))
    return df


def metadata_mask(df: DataFrame, filters: Mapping[str, str], allowed: Iterable[str]) -> DataFrame:
    """Conjunction of equality filters; on an array column the value must be a member. A missing field never matches; an unknown one is an error."""
    unknown = sorted(set(filters) - set(allowed))
    if unknown:
        raise ValueError(f"unknown filter fields: {', '.join(unknown)}")
    for field, value in filters.items():
        is_list = df.schema[field].dataType.typeName() == "array"
        hit = F.array_contains(field, value) if is_list else F.col(field).cast("string") == value
        df = df.where(F.coalesce(hit, F.lit(False)))
    return df


def licence_masked(df: DataFrame, text: str, licence: str = "licence_class", open_class: str = OPEN_LICENCE) -> DataFrame:
    """``df`` with ``text`` null in every row whose licence does not allow full text; the only view text is served from."""
    return df.withColumn(text, F.when(F.col(licence) == open_class, F.col(text)))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered result; ``limit`` is 1 to 100."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def sort_by(df: DataFrame, column: str | None, order: str | None, allowed: Iterable[str], default: str, tie: str) -> list[Column]:
    """Ordering by a whitelisted column; an unknown one means ``default``, any order but "desc" means ascending; nulls last."""
    chosen = column if column in set(allowed) else default
    key = F.col(chosen).desc_nulls_last() if order == "desc" else F.col(chosen).asc_nulls_last()
    return [key, F.col(tie).asc()]


def child_counts(parents: DataFrame, key: str, children: DataFrame, foreign: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 for none; children are counted before the join."""
    counts = children.groupBy(F.col(foreign).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row (name, n) per table, in one job."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("name")).groupBy("name").count().withColumnRenamed("count", "n") for name, df in tables.items()))


def facets(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(facet, value, n) of the distinct non-null values of each column, in one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).select("p.facet", "p.value").where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def filter_capabilities(df: DataFrame, fields: Iterable[str], examples: int = 10) -> DataFrame:
    """Per field: rows, rows with a value, coverage, state and up to ``examples`` sorted values.

    A list with no members is no value. The state is supported at full
    coverage, partial below, unavailable without any. Values are reduced to
    distinct ones before the examples are taken.
    """
    fields = list(fields)
    value = lambda c: F.explode_outer(F.col(c).cast("array<string>")) if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
    present = lambda c: (F.size(c) > 0) if df.schema[c].dataType.typeName() == "array" else F.trim(F.col(c).cast("string")) != ""
    flags = df.select(*(F.coalesce(present(c), F.lit(False)).alias(c) for c in fields))
    counts = flags.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c)).alias(c) for c in fields))
    long = counts.unpivot("rows", fields, "field", "present")
    values = reduce(DataFrame.unionByName, (df.select(F.lit(c).alias("field"), value(c).alias("v")) for c in fields))
    distinct = values.where("v is not null and trim(v) <> ''").distinct()
    from pyspark.sql import Window

    first = distinct.withColumn("k", F.row_number().over(Window.partitionBy("field").orderBy("v"))).where(F.col("k") <= examples)
    shown = first.groupBy("field").agg(F.array_join(F.sort_array(F.collect_list("v")), "|").alias("examples"))
    state = F.when(F.col("present") == 0, "unavailable").when(F.col("present") == F.col("rows"), "supported").otherwise("partial")
    coverage = F.coalesce(F.try_divide(F.col("present").cast("double"), F.col("rows").cast("double")), F.lit(0.0))
    return long.join(shown, "field", "left").select("field", "rows", "present", F.round(coverage, 6).alias("coverage"), state.alias("state"), F.coalesce("examples", F.lit("")).alias("examples"))


def labelled(df: DataFrame, column: str, labels: Mapping[str, str], name: str) -> DataFrame:
    """``df`` with a label for ``column``; a value without one is its own label."""
    pairs = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return df.withColumn(name, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has; empty when the id sets are equal."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right_only")))


def changed_fields(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys of both sides whose rows differ, with the names of the fields that do (null equals null)."""
    left, right = a.select(key, *(F.col(f).alias(f"l_{f}") for f in fields)), b.select(key, *(F.col(f).alias(f"r_{f}") for f in fields))
    names = F.filter(F.array(*(F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return left.join(right, key).select(key, names.alias("_n")).where(F.size("_n") > 0).select(key, F.array_join("_n", ",").alias("fields"))


def fill_empty(df: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``df`` with empty (null or blank) fields taken from the row of ``other`` with the same key."""
    side = other.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    keep = lambda f: F.when(F.col(f).isNull() | (F.trim(f) == ""), F.col(f"_{f}")).otherwise(F.col(f)).alias(f)
    return df.join(side, key, "left").select(*(keep(c) if c in fields else F.col(c) for c in df.columns))


def merge_branches(branches: Mapping[str, DataFrame], key: str, score: str) -> DataFrame:
    """Union of scored branches: per key the highest score and the branch names in the order given."""
    tagged = [df.select(key, F.col(score).alias("s"), F.struct(F.lit(k).alias("k"), F.lit(name).alias("name")).alias("tag")) for k, (name, df) in enumerate(branches.items())]
    merged = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.max("s").alias(score), F.sort_array(F.collect_set("tag")).alias("tags"))
    return merged.select(key, score, F.array_join(F.transform("tags", lambda t: t["name"]), "+").alias("branches"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row, from 1, in one order over all rows.

    Rows are divided by ranges of the order, numbered in their range, and
    moved by the counts of the ranges before; only those counts meet.
    """
    cut = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return cut.withColumn(name, place).join(F.broadcast(offsets), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_range", "_before")
