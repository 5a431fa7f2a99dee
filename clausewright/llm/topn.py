"""Top N rows of every group by simultaneous bisection of per-group cutoffs.

Every row has an order-preserving code, a sequence of digits that are exact
doubles: digit 0 is the negated score, each further digit holds six bytes of
the identifier, so that a smaller code means a better row. For all groups at
once, each round counts the rows above equally spaced midpoints of the
interval that still holds a group's cutoff and keeps only that interval: rows
above it are chosen, rows below it dismissed. When an interval has shrunk to
one value, its rows go on with their next digit. No group is ever sorted or
gathered: a group with a third of all rows costs a few partial counts a
round, and the rows in play shrink by the fan-out each time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

DIGIT_BYTES = 6
DIGIT_MAX = float(256**DIGIT_BYTES - 1)
LARGEST = 1.7976931348623157e308


def latest_scores(df: DataFrame, group: str, item: str, score: str, at: str) -> DataFrame:
    """One row (group, item, score) per group and item: the one with greatest ``at``.

    Rows whose score is null or NaN, and rows with a null group or item, are
    left out. A null ``at`` is the oldest; among rows of the same ``at`` the
    highest score counts. Partial aggregation runs before the shuffle.
    """
    value = F.col(score).cast("double") + F.lit(0.0)  # one zero only
    ok = value.isNotNull() & ~F.isnan(value) & F.col(group).isNotNull() & F.col(item).isNotNull()
    best = df.where(ok).groupBy(F.col(group).alias("g"), F.col(item).alias("i")).agg(F.max(F.struct(F.col(at).alias("at"), value.alias("s"))).alias("best"))
    return best.select("g", "i", F.col("best.s").alias("s"))


def _digits(count: int) -> list[Column]:
    """The code's digits: the score, then the identifier's bytes and length."""
    raw = F.encode("i", "UTF-8")
    parts = [F.conv(F.rpad(F.hex(F.substring(raw, 1 + DIGIT_BYTES * k, DIGIT_BYTES)), 2 * DIGIT_BYTES, "0"), 16, 10).cast("double") for k in range(count)]
    score = F.least(F.greatest(F.col("s"), F.lit(-LARGEST)), F.lit(LARGEST))
    return [-score, *parts, F.octet_length("i").cast("double")]


def top_n_by_bisection(scores: DataFrame, n: int, fan_out: int = 128) -> DataFrame:
    """The ``n`` best rows of each group of ``scores`` (g, i, s), with their rank.

    Order: ``s`` descending, then ``i`` ascending by bytes; (g, i) must be
    unique and ``s`` without null or NaN (see latest_scores). Infinite scores
    count as the largest finite ones. A group of fewer than ``n`` rows comes
    out whole; an empty input gives no rows. Result: g, i, s, rank (1..n).
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = materialize(scores.select(F.col("g"), F.col("i").cast("string").alias("i"), F.col("s").cast("double").alias("s")))
    longest = rows.agg(F.max(F.octet_length("i"))).first()[0] or 0
    digits = _digits(-(-longest // DIGIT_BYTES))
    x = reduce(lambda rest, k: F.when(F.col("d") == k, digits[k]).otherwise(rest), range(len(digits) - 1), digits[-1])
    # The first interval of a group is that of its scores, found by one aggregation; rows are not written for it.
    bounds = rows.groupBy("g").agg(F.min(digits[0]).alias("lo"), F.max(digits[0]).alias("hi"))
    play = rows.join(bounds, "g").select("g", "i", "s", F.lit(0).alias("d"), F.lit(n).cast("long").alias("need"), "lo", "hi")
    chosen = None
    running = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        cell = F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * fan_out)
        placed = play.withColumn("x", x).withColumn("b", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(fan_out - 1), cell)).otherwise(F.lit(0)).cast("int"))
        counts = placed.groupBy("g", "b").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo2"), F.max("x").alias("hi2"), F.min("need").alias("need2"))
        state = (
            counts.withColumn("before", F.coalesce(F.sum("c").over(running), F.lit(0)))
            .where(F.col("before") < F.col("need2"))
            .select("g", "b", "lo2", "hi2", (F.col("need2") - F.col("before")).alias("left"), (F.col("before") + F.col("c") <= F.col("need2")).alias("in"))
        )
        next_digit = F.col("lo2") == F.col("hi2")
        moved = materialize(
            placed.join(state, ["g", "b"]).select(
                "g", "i", "s", "in",
                F.when(next_digit, F.col("d") + 1).otherwise(F.col("d")).alias("d"),
                F.col("left").alias("need"),
                F.when(next_digit, 0.0).otherwise(F.col("lo2")).alias("lo"),
                F.when(next_digit, DIGIT_MAX).otherwise(F.col("hi2")).alias("hi"),
            )
        )
        done = moved.where("in").select("g", "i", "s")
        chosen = done if chosen is None else chosen.unionByName(done)
        play = moved.where("not in").drop("in")
        if play.isEmpty():
            break
    order = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i").asc())
    return chosen.withColumn("rank", F.row_number().over(order))
