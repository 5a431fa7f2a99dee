"""Sources and sinks: JSON lines, file sets, event logs, snapshots, seeds, vector indexes, databases."""

from __future__ import annotations

import json
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

INDEX_FORMAT = 1


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, key: str | None = None) -> DataFrame:
    """JSON lines under a declared schema; malformed lines fail. With ``key`` a missing or repeated key fails too."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if key:
        bad = df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).agg(F.count(F.lit(1)).alias("n"), F.min(F.col(key).cast("string")).alias("example")).first()
        if bad["n"]:
            raise ValueError(f"{bad['n']} missing or repeated values of {key} in {path}, such as {bad['example']}")
    return df


def read_json_documents(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """One row per JSON file of a folder, reports left out, with the file's name; sorted output is up to the caller."""
    df = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    return df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).where(~F.col("file").endswith("_report.json"))


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length and sha256 of every file of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def pdf_checks(files: DataFrame, least: int = 1024, tail: int = 8192) -> DataFrame:
    """Validity of PDF files (path, content): size, signature, end marker."""
    end = F.substring("content", F.greatest(F.octet_length("content") - tail + 1, F.lit(1)), F.lit(tail))
    tests = {"size": F.octet_length("content") >= least, "signature": F.substring("content", 1, 5) == F.lit("%PDF-").cast("binary"), "end_marker": F.contains(end, F.lit("%%EOF").cast("binary"))}
    ok = None
    for t in tests.values():
        ok = t if ok is None else ok & t
    return files.select("path", *(t.alias(n) for n, t in tests.items()), ok.alias("valid"))


def append_log(events: DataFrame, path: str) -> None:
    """Append events to a JSON lines log."""
    events.write.mode("append").json(path)


def write_manifest(manifest: DataFrame, base: str, failed: list[str]) -> None:
    """The manifest as Parquet and JSON lines, and its failures as JSON lines; one computation for the three."""
    manifest.write.mode("overwrite").parquet(f"{base}/manifest")
    stored = manifest.sparkSession.read.schema(manifest.schema).parquet(f"{base}/manifest")
    stored.write.mode("overwrite").json(f"{base}/manifest_jsonl")
    stored.where(F.lower("status").isin([s.lower() for s in failed])).write.mode("overwrite").json(f"{base}/failures_jsonl")


def replace_snapshot(rows: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions that ``rows`` has; all others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def seed_missing(existing: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` and those seeds whose natural key it lacks; the first of equal seeds counts."""
    return existing.unionByName(seeds.dropDuplicates(key).join(existing.select(*key), key, "left_anti"), allowMissingColumns=True)


def jdbc_options(url: str) -> dict[str, str]:
    """JDBC options of a postgres:// or postgresql:// URL: url, and user and password if it has them; others are kept."""
    given = urlsplit(url)
    if given.scheme not in ("postgres", "postgresql", "postgresql+asyncpg"):
        return {"url": url}
    place = f"jdbc:postgresql://{given.netloc.rpartition('@')[2]}{given.path}{'?' + given.query if given.query else ''}"
    login = {"user": given.username, "password": given.password}
    return {"url": place} | {k: unquote(v) for k, v in login.items() if v}


def read_jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric column when bounds are given."""
    reader = spark.read.format("jdbc").options(**jdbc_options(url)).option("dbtable", name).options(**options)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def save_index(vectors: DataFrame, path: str, key: str, vector: str, source_hash: str) -> None:
    """Write a vector index and its description: format, dimension, count, whether lengths are 1, hash of the source."""
    from ..functions import text as T

    vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).write.mode("overwrite").parquet(f"{path}/vectors")
    stored = vectors.sparkSession.read.parquet(f"{path}/vectors")
    row = stored.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.max(F.abs(T.l2_norm(F.col("vector")) - 1)).alias("off")).first()
    if row["n"] and row["least"] != row["most"]:
        raise ValueError(f"vectors of {row['least']} and {row['most']} numbers")
    meta = {"format": INDEX_FORMAT, "dimension": row["most"], "count": row["n"], "unit": bool(row["n"]) and row["off"] <= 1e-5, "source_hash": source_hash}
    vectors.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_index(spark: SparkSession, path: str, source_hash: str | None = None) -> tuple[DataFrame, dict]:
    """A saved index and its description; another format, or with ``source_hash`` another source, is refused."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    if meta["format"] != INDEX_FORMAT:
        raise ValueError(f"index format {meta['format']}, expected {INDEX_FORMAT}")
    if source_hash is not None and meta["source_hash"] != source_hash:
        raise ValueError("the index is older than its source")
    return spark.read.parquet(f"{path}/vectors"), meta


def frontier(links: DataFrame, seeds: DataFrame, depth: int, domain: Column | None = None, per_domain: int | None = None) -> DataFrame:
    """Breadth-first crawl over known links (source, target) from seeds (node): node, depth, at most ``depth`` steps.

    Each step joins only the newest nodes; a node keeps its least depth. With
    ``per_domain`` (the crawl's politeness limit) at most so many nodes of a
    ``domain``, an expression over node, are taken up, nearer and then
    smaller ones first; seeds count and always stay.
    """
    from ..storage import materialize

    seen = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    newest = seen
    for step in range(1, depth + 1):
        reached = newest.join(links, newest["node"] == links["source"]).select(F.col("target").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        if per_domain is not None and domain is not None:
            used = seen.groupBy(domain.alias("site")).agg(F.count(F.lit(1)).alias("used"))
            place = F.row_number().over(Window.partitionBy("site").orderBy("node"))
            reached = reached.withColumn("site", domain).withColumn("place", place).join(used, "site", "left").where(F.col("place") + F.coalesce("used", F.lit(0)) <= per_domain).select("node")
        newest = materialize(reached.withColumn("depth", F.lit(step)))
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    return seen


def retry_delays(attempts: int, most: float = 8.0) -> list[float]:
    """Seconds to wait before each further attempt: doubling up to ``most``."""
    return [min(2.0**k, most) for k in range(attempts)]


def reconstruct_lines(words: DataFrame, page: list[str]) -> DataFrame:
    """Lines of a page from placed words (x0, bottom, word): words of one rounded baseline from left to right."""
    filled = words.where(F.trim("word") != "")
    grouped = filled.groupBy(*page, F.round("bottom").cast("int").alias("baseline")).agg(F.sort_array(F.collect_list(F.struct("x0", "word"))).alias("ws"))
    return grouped.select(*page, "baseline", F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("line"))


def multi_column(words: DataFrame, page: list[str], width: str) -> DataFrame:
    """Pages whose word widths vary by more than half of their mean: page, variation, multi_column."""
    variation = F.try_divide(F.stddev_pop(width), F.avg(width))
    return words.groupBy(*page).agg(F.round(variation, 6).alias("variation"), F.coalesce(variation > 0.5, F.lit(False)).alias("multi_column"))
