"""Near-duplicate texts by anchor-point covering of fingerprints.

Texts with the same words (in any order) form one class. Each class has a
fingerprint from min-hashes over its multiset of words: two classes differ in
a bit with probability (1 - agreement) / 2 and in a min-hash with 1 -
agreement. The fingerprint is cut into blocks of 23 bits and ``wide``
min-hashes of eight bits. The anchors of a block are the words of a product
code: the perfect binary Golay code over the bits (every 23 bits lie within
radius 3 of exactly one word, the home) times the trivial code over the
min-hashes. Blocks of a pair that differ in at most SLACK bits and in no
min-hash meet at the home of one of them if the other is sent to every anchor
within 3 + SLACK. Each anchor compares the blocks at home there with those
sent there; candidates are then checked word by word.

The code's length grows with the number n of classes: ``wide`` is the number
of times that SPREAD divides n / (4096 LOAD), so that the blocks at home at an
anchor stay about LOAD as long as unrelated texts agree in up to 1 / SPREAD of
their words. More min-hashes make a meeting less likely, so there are more
blocks: enough that a pair at 0.75 agreement is missed by all with
probability MISS, and by the check bits with 1e-6; both fall steeply above.
The tests of a class grow as its blocks, n to the power 0.18; the work as n
to the power 1.18. No pair of texts is formed outside an anchor, and an
anchor that many blocks share is divided by adaptive skew joins.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

BITS = 23
RADIUS = 3
SLACK = 1
LEAST_AGREEMENT = 0.75
MISS = 2e-5
LOAD = 1
SPREAD = 5
CHECK_BITS = 128
CHECK_LIMIT = 36
GENERATOR = 0b110001110101  # fixed value: generator polynomial of the Golay code
SEED = 20_011
TABLE_BYTES = 64 << 20
CID = "cid long"


def words(text: Column) -> Column:
    """The longest runs of a-z and 0-9 after lower-casing."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def bags(df: DataFrame, key: str, text: str, fallback: str, least: int) -> DataFrame:
    """Distinct (key, form, bag, n): the sorted words of each row of at least ``least`` words.

    ``fallback`` stands in for a null text; a row with neither, or with fewer
    words, or with a null key, has none. ``form`` is the 256-bit digest of the
    bag, by which rows of equal words meet. Of several rows of a key with
    different words each has its own form.
    """
    bag = F.array_sort(words(F.coalesce(F.col(text), F.col(fallback))))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), bag.alias("bag")).where(F.size("bag") >= least)
    flat = F.array_join("bag", " ")
    return rows.select("key", F.unhex(F.sha2(flat, 256)).alias("form"), flat.alias("bag"), F.size("bag").alias("n")).dropDuplicates(["key", "form"])


def classes_of(members: DataFrame) -> DataFrame:
    """One written row per class of equal bags: cid, form, bag, n.

    All rows of a form hold the same bag, so any of them serves. ``cid`` is a
    running number, so no two classes share one; it is fixed by being written.
    """
    some = members.groupBy("form").agg(F.min_by("bag", "key").alias("bag"), F.min("n").alias("n"))
    return materialize(some.select(F.monotonically_increasing_id().alias("cid"), "form", "bag", "n"))


def membership(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, cid) of every member."""
    return members.select("key", "form").join(classes.select("form", "cid"), "form").select("key", "cid")


@dataclass(frozen=True)
class Plan:
    """The code's length for a number of classes: min-hashes a block, and blocks."""

    wide: int
    blocks: int

    @staticmethod
    def of(classes: int) -> Plan:
        wide = max(0, math.ceil(math.log(max(classes, 1) / ((LOAD << (BITS - 11)))) / math.log(SPREAD)))
        same = (1 + LEAST_AGREEMENT) / 2
        meet = sum(math.comb(BITS, k) * same ** (BITS - k) * (1 - same) ** k for k in range(SLACK + 1)) * LEAST_AGREEMENT**wide
        return Plan(wide, math.ceil(math.log(MISS) / math.log(1 - meet)))

    @property
    def bits(self) -> int:
        return self.blocks * BITS + CHECK_BITS

    @property
    def hashes(self) -> int:
        return self.bits + self.blocks * self.wide


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all low and high halves, and per syndrome the offsets of errors of weight up to RADIUS + SLACK, lightest first."""

    def syndrome(word: int) -> int:
        for bit in range(BITS - 1, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    unit = [syndrome(1 << b) for b in range(BITS)]
    patterns: dict[int, list[int]] = {0: [0]}
    level = [(0, 0, -1)]
    for _ in range(RADIUS + SLACK):
        level = [(e | 1 << b, s ^ unit[b], b) for e, s, top in level for b in range(top + 1, BITS)]
        for e, s, _ in level:
            patterns.setdefault(s, []).append(e)
    table = np.zeros(1 << 12, np.int32)
    high = np.zeros(1 << 11, np.int32)
    for b in range(12):
        table[1 << b : 2 << b] = table[: 1 << b] ^ unit[b]
    for b in range(11):
        high[1 << b : 2 << b] = high[: 1 << b] ^ unit[12 + b]
    width = max(map(len, patterns.values()))
    errors = np.full((1 << 11, width), -1, np.int32)
    for s, es in patterns.items():
        errors[s, : len(es)] = es
    return table, high, errors


def anchors_within(blocks: np.ndarray) -> np.ndarray:
    """Anchors (12-bit numbers of code words) within RADIUS + SLACK of each block; -1 fills; the home comes first."""
    low, high, errors = golay()
    found = errors[low[blocks & 0xFFF] ^ high[blocks >> 12]]
    return np.where(found < 0, -1, (blocks[..., None] ^ found) >> 11)


@lru_cache(maxsize=2)
def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return random.integers(1, 2**63, n, np.uint64) * 2 + 1, random.integers(0, 2**63, n, np.uint64)


class Fingerprints:
    """Min-hashes of multisets; hash rows of words are kept while they fit."""

    def __init__(self, plan: Plan) -> None:
        self.plan = plan
        self.index: dict[str, int] = {}
        self.table = np.empty((max(64, TABLE_BYTES // (4 * plan.hashes)), plan.hashes), np.uint32)

    def rows(self, elements: list[str]) -> np.ndarray:
        room = len(self.table)
        new = [e for e in elements if e not in self.index]
        if len(self.index) + len(new) > room:
            self.index.clear()
            new = elements
        if len(new) > room:  # one text with more elements than are kept
            parts = [self.rows(elements[k : k + room]).min(0) for k in range(0, len(elements), room)]
            return np.array(parts)
        if new:
            a, b = _mixers(self.plan.hashes)
            h = np.array([xxhash.xxh64_intdigest(e) for e in new], np.uint64)[:, None]
            with np.errstate(over="ignore"):
                h = (h ^ b) * a
                h ^= h >> np.uint64(29)
                h *= np.uint64(0x9E3779B97F4A7C15)
            first = len(self.index)
            self.table[first : first + len(new)] = (h >> np.uint64(32)).astype(np.uint32)
            for k, e in enumerate(new):
                self.index[e] = first + k
        return self.table[[self.index[e] for e in elements]]

    def minima(self, bag: str) -> np.ndarray:
        """The low byte of each min-hash; the k-th occurrence of a word is an element of its own."""
        seen: Counter[str] = Counter()
        elements = []
        for w in bag.split(" "):
            elements.append(f"{w} {seen[w]}" if seen[w] else w)
            seen[w] += 1
        return self.rows(elements).min(0).astype(np.uint8)


def _sides(wide: np.ndarray) -> np.ndarray:
    """40 bits of the block's number and its min-hashes, above the anchor's 12."""
    mixed = np.broadcast_to(np.arange(wide.shape[1], dtype=np.uint64) + np.uint64(1), wide.shape[:2])
    with np.errstate(over="ignore"):
        for k in range(wide.shape[2]):
            mixed = (mixed ^ (wide[:, :, k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            mixed = mixed ^ (mixed >> np.uint64(31))
        mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(24)).astype(np.int64) << 12


def fingerprints(classes: DataFrame, plan: Plan) -> DataFrame:
    """cid, n, c0, c1 (check bits), blocks, sides (the part of the anchor beyond the Golay code) of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(plan)
        place = 1 << np.arange(BITS, dtype=np.int64)
        for batch in batches:
            least = np.array([prints.minima(b) for b in batch.column("bag").to_pylist()], np.uint8).reshape(batch.num_rows, plan.hashes)
            bits = least[:, : plan.bits] & 1
            blocks = (bits[:, : plan.blocks * BITS].reshape(-1, plan.blocks, BITS) @ place).astype(np.int32)
            check = np.packbits(bits[:, plan.blocks * BITS :], axis=1).view(">i8").astype(np.int64)
            sides = _sides(least[:, plan.bits :].reshape(batch.num_rows, plan.blocks, plan.wide))
            listed = lambda x, kind: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), kind), plan.blocks).cast(pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("n"), pa.array(check[:, 0]), pa.array(check[:, 1]), listed(blocks, pa.int32()), listed(sides, pa.int64())], ["cid", "n", "c0", "c1", "blocks", "sides"])

    return classes.select("cid", "n", "bag").mapInArrow(run, f"{CID}, n int, c0 long, c1 long, blocks array<int>, sides array<long>")


def sent(prints: DataFrame, plan: Plan, home: bool) -> DataFrame:
    """anchor, block, cid, n, c0, c1: every block at its home, or at all anchors within RADIUS + SLACK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, 1_000)
                blocks = part.column("blocks").flatten().to_numpy().reshape(-1, plan.blocks)
                sides = part.column("sides").flatten().to_numpy().reshape(-1, plan.blocks)
                near = anchors_within(blocks)
                if home:
                    near = near[..., :1]
                row, block, at = np.nonzero(near >= 0)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(sides[row, block] | near[row, block, at]), pa.array(blocks[row, block]), *(part.column(c).take(take) for c in ("cid", "n", "c0", "c1"))], ["anchor", "block", "cid", "n", "c0", "c1"])

    return prints.mapInArrow(run, f"anchor long, block int, {CID}, n int, c0 long, c1 long")


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common, either = [], []
        for a, b in zip(batch.column("bag_a").to_pylist(), batch.column("bag_b").to_pylist(), strict=True):
            x, y = Counter(a.split(" ")), Counter(b.split(" "))
            both = (x & y).total()
            common.append(both)
            either.append(x.total() + y.total() - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int32()), pa.array(either, pa.int32())], ["a", "b", "common", "either"])


def class_links(classes: DataFrame, threshold: float, plan: Plan | None = None) -> DataFrame:
    """Pairs a < b of written classes (cid, bag, n) whose words agree to ``threshold`` (at least 0.75): a, b, agreement."""
    if not LEAST_AGREEMENT <= threshold <= 1:
        raise ValueError("the number of blocks is chosen for thresholds from 0.75")
    plan = plan or Plan.of(classes.count())
    prints = materialize(fingerprints(classes, plan))
    home, away = sent(prints, plan, True).alias("h"), sent(prints, plan, False).alias("v")
    differ = lambda c: F.bit_count(F.col(f"h.{c}").bitwiseXOR(F.col(f"v.{c}")))
    short, long = F.least("h.n", "v.n"), F.greatest("h.n", "v.n")
    near = (F.col("h.anchor") == F.col("v.anchor")) & (F.col("h.cid") < F.col("v.cid")) & (differ("block") <= SLACK) & (differ("c0") + differ("c1") <= CHECK_LIMIT) & (short >= long * threshold)
    candidates = home.join(away, near).select(F.col("h.cid").alias("a"), F.col("v.cid").alias("b")).distinct()
    left = classes.select(F.col("cid").alias("a"), F.col("bag").alias("bag_a"))
    right = classes.select(F.col("cid").alias("b"), F.col("bag").alias("bag_b"))
    checked = candidates.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(_agreement, "a long, b long, common int, either int")
    return checked.where(F.col("common") >= F.col("either") * threshold).select("a", "b", (F.col("common") / F.col("either")).alias("agreement"))


def expand_pairs(own: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct pairs key_a < key_b of rows (key, cid) of linked or equal classes."""
    shared = own.groupBy("cid").count().where("count > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    joined = links.select("a", "b").unionByName(shared)
    pairs = joined.join(own.withColumnsRenamed({"cid": "a", "key": "x"}), "a").join(own.withColumnsRenamed({"cid": "b", "key": "y"}), "b").where("x <> y")
    return pairs.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node, root (the least node of its component).

    Alternates the large-star and small-star steps until nothing changes;
    each round is written, and a node's neighbours are only reduced to a
    minimum, never gathered.
    """
    both = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        near = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small_least, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        both = materialize(small)
        now = both.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    stars = both.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return stars.unionByName(both.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(stars.select("node"), "node", "left_anti"))


def groups(df: DataFrame, key: str, own: DataFrame, links: DataFrame) -> DataFrame:
    """One row per key of ``df``: group_id (least key of its group), class_id (least key of its class), links of its class to other classes.

    A key without enough words is a group of its own with a null class. A key
    with rows of different words takes the class of the greatest class_id.
    """
    rows = materialize(links.select("a", "b"))
    roots = components(rows)
    degree = rows.select(F.col("a").alias("cid")).unionByName(rows.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count(F.lit(1)).cast("int").alias("n_links"))
    heads = own.groupBy("cid").agg(F.min("key").alias("class_id")).join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(degree, "cid", "left")
    heads = heads.withColumns({"root": F.coalesce("root", "cid"), "n_links": F.coalesce("n_links", F.lit(0))})
    least = heads.groupBy("root").agg(F.min("class_id").alias("group_id"))
    found = own.join(heads.join(least, "root"), "cid").groupBy("key").agg(F.max(F.struct("class_id", "group_id", "n_links")).alias("c"))
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    joined = keys.join(found, "key", "left")
    return joined.select(F.col("key").alias(key), F.coalesce("c.group_id", "key").alias("group_id"), F.col("c.class_id").alias("class_id"), F.coalesce("c.n_links", F.lit(0)).alias("n_links"))
