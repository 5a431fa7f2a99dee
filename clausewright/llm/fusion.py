"""One ranking from several differently-scaled scores by closeness to an ideal point.

Per group each score is winsorised, shifted to its lower limit and divided by
its vector length over the group, so that every score spans a comparable
range whatever its unit. A row's weighted distances to the best and to the
worst point give its relative closeness, by which the group is ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from ..storage import materialize

TRIM = 0.2
ACCURACY = 10_000
PLACES = 3
ROWS_A_PART = 1_000_000


def latest_candidates(df: DataFrame, group: str, item: str, scores: list[str], at: str) -> DataFrame:
    """One row per (group, item), the one with greatest ``at``: g, i, x0, x1, ...

    A score that is NaN becomes null (not scored). Rows with a null group or
    item are left out. A null ``at`` is the oldest; rows of equal ``at`` are
    told apart by their scores, highest first in the order given.
    """
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    best = (
        df.where(F.col(group).isNotNull() & F.col(item).isNotNull())
        .groupBy(F.col(group).alias("g"), F.col(item).alias("i"))
        .agg(F.max(F.struct(F.col(at).alias("at"), *(value(c).alias(f"x{k}") for k, c in enumerate(scores)))).alias("best"))
    )
    return best.select("g", "i", *(F.col(f"best.x{k}").alias(f"x{k}") for k in range(len(scores))))


def group_statistics(rows: DataFrame, m: int) -> DataFrame:
    """Per group the count n and, for each score, p (lower and upper limit), lo, hi and t (its PLACES-th highest value).

    One aggregation that combines before its shuffle; its state is bounded for
    any size of group. A score with fewer values has its lowest one as t, or
    null.
    """
    ks = range(m)
    return rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.percentile_approx(f"x{k}", [TRIM, 1 - TRIM], ACCURACY).alias(f"p{k}") for k in ks),
        *(F.min(f"x{k}").alias(f"lo{k}") for k in ks), *(F.max(f"x{k}").alias(f"hi{k}") for k in ks),
        *(F.array_min(InternalFunction.collect_top_k(F.col(f"x{k}"), PLACES, False)).alias(f"t{k}") for k in ks),
    )


def _numbered(df: DataFrame, keep: list[str], m: int, part_rows: int) -> DataFrame:
    """``rank`` of each written row within ``g`` and ``place``, which rows of equal closeness and scores share.

    A group of more than ``part_rows`` rows is divided along the order; a
    row's number is that in its part plus the rows of the parts before. Only
    counts of parts meet in one task.
    """
    c, steps = F.col("closeness"), 1 << 20
    level = F.when(c >= 1, 0).when(c <= 0, steps + 2).otherwise(F.floor((1 - c) * steps) + 1).cast("long")
    level = level * 1024 + F.when((c >= 1) | (c <= 0), F.floor((1 - F.col("scaled") / m) * 1023)).otherwise(0)  # many rows share the extremes
    cut = df.withColumn("part", F.when(F.col("n") > part_rows, level).otherwise(F.lit(0).cast("long")))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("g", "part").count().select("g", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    best = [F.col("closeness").desc(), F.col("scaled").desc()]
    part = Window.partitionBy("g", "part")
    numbered = cut.withColumns({"row": F.row_number().over(part.orderBy(*best, F.col("i").asc())), "same": F.rank().over(part.orderBy(*best))})
    return numbered.join(offsets, ["g", "part"]).select(*keep, (F.col("same") + F.col("before")).alias("place"), (F.col("row") + F.col("before")).alias("rank"))


def ideal_point_ranking(rows: DataFrame, m: int, weights: list[float] | None = None, part_rows: int = ROWS_A_PART) -> DataFrame:
    """Rank the rows (g, i, x0..) of each group by relative closeness.

    The limits of a score are its 20th and 80th percentile in every group,
    small or large (percentile ranks are exact to one in 10,000). A row
    without a score has the worst value in it. Equal closeness is broken by
    the sum of the scores scaled to 0..1, then by ``i``. A group in which no
    score tells rows apart has closeness 0 throughout. Intermediate rows are
    written, so that joins with a group's figures may divide a hot group.
    Result: g, i, x.., t.. (third best values), closeness, place, rank.
    """
    weights = weights or [1.0 / m] * m
    ks = range(m)
    rows = materialize(rows)
    low, high = (lambda k: F.col(f"p{k}")[0]), (lambda k: F.col(f"p{k}")[1])
    clip = lambda k: F.coalesce(F.least(F.greatest(F.col(f"x{k}"), low(k)), high(k)) - low(k), F.lit(0.0))
    share = lambda k: F.coalesce(F.try_divide(F.col(f"x{k}") - F.col(f"lo{k}"), F.col(f"hi{k}") - F.col(f"lo{k}")), F.lit(0.0))
    clipped = materialize(
        rows.join(group_statistics(rows, m), "g").select(
            "g", "i", "n", *(f"x{k}" for k in ks), *(f"t{k}" for k in ks), *(clip(k).alias(f"w{k}") for k in ks),
            *(F.coalesce(high(k) - low(k), F.lit(0.0)).alias(f"best{k}") for k in ks), F.round(sum((share(k) for k in ks), F.lit(0.0)), 9).alias("scaled"),
        )
    )
    lengths = clipped.groupBy("g").agg(*(F.sqrt(F.sum(F.col(f"w{k}") * F.col(f"w{k}"))).alias(f"len{k}") for k in ks))
    unit = lambda c, k: F.coalesce(F.try_divide(F.col(c), F.col(f"len{k}")), F.lit(0.0))
    square = lambda e: e * e
    away = F.sqrt(sum((square(F.lit(weights[k]) * (unit(f"best{k}", k) - unit(f"w{k}", k))) for k in ks), F.lit(0.0)))
    off = F.sqrt(sum((square(F.lit(weights[k]) * unit(f"w{k}", k)) for k in ks), F.lit(0.0)))
    closeness = F.round(F.coalesce(F.try_divide(F.col("off"), F.col("off") + F.col("away")), F.lit(0.0)), 9)
    keep = ["g", "i", *(f"x{k}" for k in ks), *(f"t{k}" for k in ks), "closeness"]
    scored = materialize(clipped.join(lengths, "g").withColumns({"away": away, "off": off}).withColumn("closeness", closeness).select(*keep, "n", "scaled"))
    return _numbered(scored, keep, m, part_rows)


def leaders(ranking: DataFrame, m: int) -> DataFrame:
    """Rows of an ideal_point_ranking that are among the first three by every score.

    They are taken from the head of the ranking and then checked. The head
    holds them all: closeness never falls when a score rises, so only a row
    with a greater value in some score can stand before such a row, and each
    score has two of those at most. Its place is 2m + 1 or better.
    """
    keep = F.col("place") <= (PLACES - 1) * m + 1
    for k in range(m):
        keep = keep & (F.col(f"x{k}") >= F.col(f"t{k}"))
    return ranking.where(keep)
