"""Filling fixed-capacity containers: large items matched in pairs, small ones best-fit.

Sizes are whole numbers up to the capacity, so how containers are filled
depends only on how many items there are of each size. The plan is made on
that histogram, whose length is the capacity however many items there are;
items then take the places of their size in the order of their rank among the
items of that size. Items longer than the capacity are divided into full
containers and a rest, which is packed like any other item.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

ITEMS_A_PART = 500_000


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places for ``counts`` items of each size: (size, items, first bin, items per bin); number of bins.

    Items above a third of the capacity go two to a bin at most: from the
    largest down, each takes the largest other one that still fits beside it.
    Smaller items then go, largest first, where the least room is left that
    holds them, and open a new bin when there is none. Equal bins are handled
    as one run, so the work depends on the capacity only.
    """
    left = {s: n for s, n in counts.items() if 0 < s <= capacity and n}
    places: list[tuple[int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first bin, bins)

    def add_gap(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            gaps.setdefault(room, []).append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while (n := left.get(size, 0)) > 0:
            at = bisect_left(large, capacity - size + 1) - 1
            while at >= 0 and left.get(large[at], 0) == 0:
                at -= 1
            mate = large[at] if at >= 0 else 0
            if mate == size and n > 1:
                pairs = n // 2
                places.append((size, 2 * pairs, bins, 2))
                left[size] = n - 2 * pairs
            elif mate and mate != size:
                pairs = min(n, left[mate])
                places += [(size, pairs, bins, 1), (mate, pairs, bins, 1)]
                left[size] -= pairs
                left[mate] -= pairs
            else:
                pairs, mate = n, 0
                if at >= 0 and large[at] == size:  # the last one of its size; a smaller mate may fit
                    below = next((large[b] for b in range(at - 1, -1, -1) if left.get(large[b], 0)), 0)
                    if below:
                        pairs, mate = 1, below
                        places.append((mate, 1, bins, 1))
                        left[mate] -= 1
                places.append((size, pairs, bins, 1))
                left[size] -= pairs
            add_gap(capacity - size - mate, bins, pairs)
            bins += pairs

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[size]
        while n > 0:
            rooms = sorted(gaps)
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                full, rest = divmod(n, per)
                if full:
                    places.append((size, full * per, bins, per))
                    add_gap(capacity - per * size, bins, full)
                    bins += full
                if rest:
                    places.append((size, rest, bins, rest))
                    add_gap(capacity - rest * size, bins, 1)
                    bins += 1
                break
            room = rooms[at]
            first, k = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
            per = room // size
            full = min(k, n // per)
            if full:
                places.append((size, full * per, first, per))
                add_gap(room - per * size, first, full)
                n -= full * per
                first, k = first + full, k - full
            if k and n:  # fewer are left than one more bin takes
                places.append((size, n, first, n))
                add_gap(room - n * size, first, 1)
                n, first, k = 0, first + 1, k - 1
            add_gap(room, first, k)
    return places, bins


def _ranks(items: DataFrame, total: int) -> DataFrame:
    """``rank`` from 0 of each item among those of its size, by key and piece.

    A size that a third of all items share is divided into parts by a hash of
    the key; only the counts of the parts meet.
    """
    parts = max(1, -(-total // ITEMS_A_PART))
    cut = items.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("size", "part").count().select("size", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("size", "part").orderBy("key", "piece")
    return cut.withColumn("r", F.row_number().over(within).cast("long") - 1).join(offsets, ["size", "part"]).withColumn("rank", F.col("r") + F.col("before")).drop("r", "before", "part")


def pack(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Every item of ``sizes`` with its container: key, piece, first_token, n_tokens, bin_id.

    An item within the capacity has the one piece 0. A longer one has pieces
    of exactly the capacity, each alone in a container, and a last piece of
    the rest. An item of size 0 or null needs no room: piece 0, no bin_id.
    ``key`` must be unique. The containers are numbered from 0.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = sizes.sparkSession
    items = sizes.select(F.col(key).alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"))
    cap = F.lit(capacity)
    pieces = items.select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / cap) - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.withColumn("size", F.least(F.col("n") - F.col("piece") * cap, cap).cast("int")).withColumn("first_token", F.col("piece") * cap)
    histogram = {r["size"]: r["count"] for r in pieces.where("size > 0").groupBy("size").count().collect()}  # at most one row per size up to the capacity
    places, _ = plan_bins(histogram, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    for s, n, first, per in places:
        mine = slots.setdefault(s, [])
        mine.append((mine[-1][0] + mine[-1][3] if mine else 0, first, per, n))
    lookup = {s: (np.array([m[0] for m in mine]), np.array([m[1] for m in mine]), np.array([m[2] for m in mine])) for s, mine in slots.items()}
    shared = spark.sparkContext.broadcast(lookup)  # a few runs for each size: bounded by the capacity

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            size_, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            bins = np.full(len(size_), -1, np.int64)
            for s in np.unique(size_):
                rows = np.flatnonzero(size_ == s)
                start, first, per = table[int(s)]
                at = np.searchsorted(start, rank[rows], side="right") - 1
                bins[rows] = first[at] + (rank[rows] - start[at]) // per[at]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "piece", "first_token", "size")] + [pa.array(bins)], ["key", "piece", "first_token", "size", "bin_id"])

    total = sum(histogram.values())
    kind = sizes.schema[key].dataType.simpleString()
    ranked = _ranks(pieces.where("size > 0").drop("n"), total)
    placed = ranked.select("key", "piece", "first_token", "size", "rank").mapInArrow(assign, f"key {kind}, piece long, first_token long, size int, bin_id long")
    empty = pieces.where("size <= 0").select("key", "piece", "first_token", F.lit(0).alias("size"), F.lit(None).cast("long").alias("bin_id"))
    return placed.unionByName(empty).select(F.col("key").alias(key), "piece", "first_token", F.col("size").alias("n_tokens"), "bin_id")


def pack_all(sizes: DataFrame, key: str, size: str, capacities: dict[str, int]) -> DataFrame:
    """``pack`` for each named capacity over the same written sizes, with column pack_id."""
    stored = materialize(sizes.select(key, size))
    out = None
    for name, capacity in sorted(capacities.items()):
        one = pack(stored, key, size, capacity).withColumn("pack_id", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
