"""Headings, annexes, tables and reference sections of page texts as a tree of nodes, in the JVM.

Every line is classified by itself: a row of predicates names why a numbered
line is not a heading, and the lines without a reason are events. What depends
on other lines comes from running windows over a document's events, which are
few beside its lines: the annex an event stands in, the latest event at each
level, and from these the parents. Spans reach to where the next event begins;
a node's span is the greatest of its subtree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = r"[ \t\r\f\x0b]+"
NUMBERED = r"^((?:\d+|[A-Z]\.\d+)(?:\.\d+)*)(\.?) (.+)$"
ANNEX = r"(?i)^annex(?:ure)? ([A-Z])(?:$|[^A-Za-z0-9_][ :–-]*(.*)$)"
TABLE = r"(?i)^table (\d+[A-Z]?)(?:$|[^A-Za-z0-9_][ :–-]*(.*)$)"
REFERENCES = r"(?i)^(?:\d+\.? )?(?:normative )?references$"
# Units, the words that make a number before them a quantity or a citation, and the months that make it a date.
UNIT = r"(?i)^(?:\d+(?:\.\d+)? ?)?(?:V|Hz|W|A|kg|g|mm|cm|m|%|kPa|MPa|Nm|N|s|min|h)(?: |$)"
QUOTED = r"(?i)^(?:to \d|is \d|cl\. ?\d)"
MONTH = r"(?i)^(?:January|February|March|April|May|June|July|August|September|October|November|December),? \d{4}"


@dataclass(frozen=True)
class HeadingRules:
    """Limits of a conservative heading: characters of the line, top number, share of capitals or words of a title, levels."""

    characters: int = 240
    top_number: int = 99
    capitals: float = 0.7
    words: int = 8
    levels: int = 6


def plain_line(line: Column) -> Column:
    """A line with blanks made single and trimmed."""
    return F.trim(F.regexp_replace(line, BLANKS, " "))


def rejection(number: Column, dotted: Column, title: Column, line: Column, rules: HeadingRules) -> Column:
    """Why a numbered line is no heading; null for a heading."""
    letters = F.length(F.regexp_replace(title, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(title, "[^A-Z]", ""))
    short = (F.size(F.split(title, " ")) <= rules.words) & title.rlike("^[A-Z]") & ~title.endswith(".")
    bare = ~number.contains(".") & (dotted == "")
    top = F.regexp_extract(number, r"^0*(\d+)", 1)
    reasons = {
        "table_row": line.contains("|"),
        "too_long": F.length(line) > rules.characters,
        "quantity": title.rlike(UNIT),
        "citation": title.rlike(QUOTED),
        "date": title.rlike(MONTH),
        "top_number": (F.length(top) > 18) | (top.try_cast("long") > rules.top_number),
        "sentence": bare & ((letters == 0) | ((capitals < letters * rules.capitals) & ~short)),
    }
    out = F.lit(None).cast("string")
    for name, found in reversed(list(reasons.items())):
        out = F.when(F.coalesce(found, F.lit(False)), name).otherwise(out)
    return out


def line_events(lines: DataFrame, keys: list[str], line: str, rules: HeadingRules = HeadingRules()) -> DataFrame:
    """Lines that open a node or are numbered like one: keys, kind, number, title, confidence, reason.

    ``reason`` tells why a numbered line is left out; it is null for events.
    Null and blank lines have none.
    """
    text = plain_line(F.coalesce(line, F.lit("")))
    rows = lines.select(*keys, text.alias("line")).where(F.col("line").rlike(r"(?i)^(?:\d|[A-Z]\.\d|annex|table|normative|references)"))
    part = lambda pattern, k: F.regexp_extract("line", pattern, k)
    number, dot, title = part(NUMBERED, 1), part(NUMBERED, 2), part(NUMBERED, 3)
    kind = F.when(F.col("line").rlike(ANNEX), "annex").when(F.col("line").rlike(TABLE), "table").when(F.col("line").rlike(REFERENCES), "references").when(number != "", "heading")
    known = rows.withColumn("kind", kind).where("kind is not null")
    pick = lambda annex, table, heading: F.when(F.col("kind") == "annex", annex).when(F.col("kind") == "table", table).when(F.col("kind") == "heading", heading)
    sure = (F.col("kind") != "heading") | number.contains(".") | (dot != "")
    reason = F.when(F.col("kind") == "heading", rejection(number, dot, title, F.col("line"), rules))
    titled = F.trim(pick(part(ANNEX, 2), part(TABLE, 2), title))
    return known.select(
        *keys, "kind", pick(F.upper(part(ANNEX, 1)), part(TABLE, 1), number).alias("number"), F.when(titled != "", titled).alias("title"),
        F.when(sure, "high").otherwise("medium").alias("confidence"), reason.alias("reason"),
    )


def document_tree(events: DataFrame, pages: DataFrame, doc: str, page: str, line_no: str, rules: HeadingRules = HeadingRules()) -> DataFrame:
    """Nodes of each document with their parents: doc, ordinal, type, number, title, confidence, start_page, end_page, start_line, parent_ordinal, missing_parent.

    ``events`` are line_events without a reason, ``pages`` names the pages of
    each document. A heading with a letter counts inside the annex of that
    letter only. After a table an undotted number counts only if it carries
    the section numbers on. The parent is the latest node of the deepest
    higher level whose number begins this one's, else the annex; a table hangs
    on the latest node. ``missing_parent`` tells that it is not the next
    higher number.
    """
    order = Window.partitionBy(doc).orderBy(page, line_no)
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    letter = F.last(F.when(F.col("kind") == "annex", F.col("number")), ignorenulls=True).over(upto)
    lettered = F.col("number").rlike("^[A-Z]")
    level = F.when(F.col("kind") == "annex", 0).when(F.col("kind") == "heading", F.size(F.split("number", r"\.")) - lettered.cast("int"))
    placed = events.withColumns({"annex": letter, "level": level, "segment": F.count_if(F.col("kind") == "annex").over(upto)})
    placed = placed.where((F.col("kind") != "heading") | ~lettered | (F.substring("number", 1, 1) == F.col("annex")))
    top = F.last(F.when(F.col("level") == 1, F.col("number")), ignorenulls=True).over(before)
    carried = F.coalesce(F.col("number").try_cast("long") == F.coalesce(top.try_cast("long"), F.lit(0)) + 1, F.lit(False))
    cell = (F.lag("kind").over(order) == "table") & (F.col("level") == 1) & ~lettered & ~carried
    nodes = placed.withColumn("cell", F.coalesce(cell, F.lit(False))).where("not cell").withColumn("ordinal", F.row_number().over(order) - 1)
    parts = F.split("number", r"\.")
    latest = [F.last(F.when(F.col("level") == j, F.struct("segment", "number", "ordinal")), ignorenulls=True).over(before) for j in range(rules.levels)]
    nodes = nodes.withColumns({f"at{j}": c for j, c in enumerate(latest)})

    def ancestor(j: int) -> Column:
        same = F.col(f"at{j}.segment") == F.col("segment")
        begins = F.lit(True) if j == 0 else F.col(f"at{j}.number") == F.array_join(F.slice(parts, F.lit(1), F.lit(j) + lettered.cast("int")), ".")
        return F.when(same & begins & (F.col("level") > j), F.struct(F.col(f"at{j}.ordinal").alias("ordinal"), F.lit(j).alias("level")))

    up = F.filter(F.array(*map(ancestor, range(rules.levels))), lambda a: a.isNotNull())
    own = nodes.withColumn("up", F.when(F.col("kind") == "heading", F.transform(up, lambda a: a["ordinal"])).otherwise(F.array().cast("array<int>")))
    own = own.withColumn("near", F.when(F.col("kind") == "heading", F.try_element_at(up, F.lit(-1))["level"] == F.col("level") - 1))
    path = F.last(F.when(F.col("kind").isin("heading", "annex"), F.concat("up", F.array("ordinal"))), ignorenulls=True).over(before)
    own = own.withColumn("up", F.when(F.col("kind") == "table", F.coalesce(path, F.array().cast("array<int>"))).otherwise(F.col("up")))
    last = pages.groupBy(doc).agg(F.max(page).alias("last_page"))
    spans = own.withColumn("next_page", F.lead(page).over(order)).join(last, doc).withColumn("own_end", F.greatest(F.col(page), F.coalesce("next_page", "last_page")))
    reach = spans.select(doc, F.explode(F.concat("up", F.array("ordinal"))).alias("ordinal"), "own_end").groupBy(doc, "ordinal").agg(F.max("own_end").cast("int").alias("end_page"))
    kinds = F.when(F.col("kind") != "heading", F.col("kind")).when((F.col("level") == 1) & ~lettered, "section").when(F.size(parts) <= 2, "clause").otherwise("subclause")
    missing = F.col("number").contains(".") & ~F.coalesce("near", F.lit(False)) & (F.col("kind") == "heading")
    return spans.join(reach, [doc, "ordinal"]).select(
        doc, "ordinal", kinds.alias("type"), "number", "title", "confidence", F.col(page).cast("int").alias("start_page"), "end_page", F.col(line_no).alias("start_line"),
        F.try_element_at("up", F.lit(-1)).alias("parent_ordinal"), F.coalesce(missing, F.lit(False)).alias("missing_parent"),
    )


def tree_depth(nodes: DataFrame, doc: str, ordinal: str, parent: str) -> DataFrame:
    """Depth from 1 of every node that hangs on a root: doc, ordinal, depth.

    Pointer doubling: each round a node takes over its ancestor's ancestor, so
    a chain of n nodes needs log n rounds of one join, whatever their number.
    Orphans and cycles, which hang on no root, have no row. Repeated rows count
    once.
    """
    from ..storage import materialize

    state = materialize(nodes.select(F.col(doc).alias("doc"), F.col(ordinal).alias("ordinal"), F.col(parent).alias("up")).distinct().withColumn("depth", F.lit(1)))
    done = state.where("up is null").select("doc", "ordinal", "depth")
    pending = state.where("up is not null")
    for _ in range(64):
        if pending.isEmpty():
            break
        above = state.select("doc", F.col("ordinal").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = materialize(pending.join(above, ["doc", "up"]).select("doc", "ordinal", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")).unionByName(done.select("doc", "ordinal", F.lit(None).cast("int").alias("up"), "depth")))
        fresh = state.where("up is not null")
        if fresh.count() == pending.count() and fresh.join(pending, ["doc", "ordinal", "up"], "left_anti").isEmpty():
            break  # only cycles are left
        done, pending = state.where("up is null").select("doc", "ordinal", "depth"), fresh
    return done.select(F.col("doc").alias(doc), F.col("ordinal").alias(ordinal), "depth")
