"""Most similar vectors of every vector: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and residual code books are fitted on a bounded sample; every
usable vector is indexed. The lists are the cells of a coarse code book, each
divided by a second code book over the residuals; the second one grows with
the largest cell, so that lists stay about LIST_SIZE to 4 LIST_SIZE long at
any number of vectors, in dense regions too, while the model holds a few
thousand vectors. A query visits the lists of the nearest centroids, more of
them as the lists grow in number; there the inner product with a member is
estimated as that with the centroid plus, for each part of the residual, an
entry of the query's own table (asymmetric distance). The best estimates are
reranked by the exact cosine where the members' vectors lie: every vector is
sent once as a member and once for each visit, which moves less than sending
codes and fetching the vectors of SHORTLIST candidates afterwards would.
Equal vectors are one entry, so that copies neither fill the shortlists nor
crowd a list; a long list or many visitors of one list are divided into blocks
that are compared apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

SAMPLE = 65_536
LIST_SIZE = 256
CELLS = 4_096
PROBES = 16
PARTS = 16
CODES = 256
SHORTLIST = 96
ROUNDS = 8
MEMBER_BLOCK = 4_096
QUERY_BLOCK = 8_192


def usable_vectors(df: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """(id, v): one row per key with a vector of ``dimension`` finite numbers that are not all zero.

    Of several usable vectors of a key the greatest counts (repeated rows hold
    the same). Rows with a null key are left out.
    """
    v = F.col(vector).cast("array<float>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) == dimension) & finite & F.exists(v, lambda x: x != 0)
    return df.where(ok).groupBy(F.col(key).alias("id")).agg(F.max(v).alias("v"))


def distinct_vectors(usable: DataFrame, keep: int) -> DataFrame:
    """One row per different vector: cid (its smallest id), v, ids (its ``keep`` smallest)."""
    order = Window.partitionBy("v").orderBy("id")
    first = usable.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "v", "ids")


def matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """Unit rows, in double precision, of a column of float lists."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)
    x /= np.abs(x).max(1, initial=1e-300, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of Lloyd's algorithm from random rows; an empty one moves to a random row."""
    centres = x[random.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = nearest_centre(x, centres)
        order = np.argsort(nearest, kind="stable")
        present, start = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(x[order], start, axis=0)
        centres[present] = sums / np.diff(np.append(start, len(x)))[:, None]
        lost = np.setdiff1d(np.arange(len(centres)), present)
        if len(lost):
            centres[lost] = x[random.choice(len(x), len(lost))]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row, in slices of bounded size."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + 8_192] @ centres.T - half, axis=1) for a in range(0, len(x), 8_192)]) if len(x) else np.zeros(0, int)


class Quantiser:
    """Coarse centroids in two levels, and code books for the parts of the residuals."""

    def __init__(self, sample: np.ndarray, total: int, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        x = sample.astype(np.float32)
        self.cells = k_means(x, max(1, min(CELLS, round(total / LIST_SIZE))), random).astype(np.float32)
        at = nearest_centre(x, self.cells)
        largest = np.bincount(at).max() * total / len(x)
        rest = x - self.cells[at]
        self.subs = k_means(rest, math.ceil(largest / (4 * LIST_SIZE)), random).astype(np.float32) if largest > 4 * LIST_SIZE else np.zeros((1, x.shape[1]), np.float32)
        self.cross = self.cells @ self.subs.T
        rest -= self.subs[nearest_centre(rest, self.subs)]
        self.parts = np.array_split(np.arange(x.shape[1]), min(PARTS, x.shape[1]))
        self.books = [k_means(np.ascontiguousarray(rest[:, p]), CODES, random).astype(np.float32) for p in self.parts]

    @property
    def lists(self) -> int:
        return len(self.cells) * len(self.subs)

    def visited(self, probes: int) -> int:
        """Lists that a query visits: at least ``probes``, twice the binary logarithm of their number beyond."""
        return min(self.lists, max(probes, round(2 * math.log2(self.lists))))

    def centre(self, at: np.ndarray) -> np.ndarray:
        """Centroids of lists."""
        return self.cells[at // len(self.subs)] + self.subs[at % len(self.subs)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and residual codes of each row."""
        at = nearest_centre(x, self.cells)
        at = at * len(self.subs) + nearest_centre(x - self.cells[at], self.subs)
        rest = x - self.centre(at)
        return at, np.stack([nearest_centre(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def probes(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The lists each row visits: among the cells of greatest inner product those of the nearest centroids."""
        n = self.visited(probes)
        out = np.empty((len(x), n), np.int32)
        first = min(n, len(self.cells))
        for a in range(0, len(x), 512):
            part = x[a : a + 512]
            near = part @ self.cells.T
            cells = np.argpartition(-near, first - 1, axis=1)[:, :first]
            if len(self.subs) == 1:
                out[a : a + 512] = cells
                continue
            far = (self.subs * self.subs).sum(1)[None, None] / 2 + self.cross[cells] - (part @ self.subs.T)[:, None]  # half the squared distance, less what all lists share
            far += ((self.cells * self.cells).sum(1)[cells] / 2 - np.take_along_axis(near, cells, 1))[..., None]
            best = np.argpartition(far.reshape(len(part), -1), n - 1, axis=1)[:, :n]
            out[a : a + 512] = np.take_along_axis(cells, best // len(self.subs), 1) * len(self.subs) + best % len(self.subs)
        return out

    def estimates(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric inner products of queries with the members of one list."""
        out = np.repeat((x @ self.centre(np.array([at]))[0])[:, None], len(codes), axis=1)
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out += (x[:, p] @ b.T)[:, codes[:, k]]
        return out


def fit(vectors: DataFrame, dimension: int) -> Quantiser:
    """Fit on at most about SAMPLE vectors, chosen by a hash of their id."""
    n = vectors.count()
    chosen = vectors if n <= SAMPLE else vectors.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30)))
    return Quantiser(matrix(chosen.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("v").toArrow().column("v"), dimension), n)


def nearest_vectors(df: DataFrame, key: str, vector: str, dimension: int, k: int = 5, least: float | None = None, probes: int = PROBES) -> DataFrame:
    """The ``k`` most similar other vectors of every usable vector: id, other, similarity, rank.

    Similarity is the cosine rounded to 6 decimals; equal ones are ordered by
    id. ``least`` drops lower similarities. A vector with fewer than ``k``
    others in the lists it visits has fewer rows; no usable vector gives none.
    """
    spark = df.sparkSession
    usable = materialize(usable_vectors(df, key, vector, dimension))
    vectors = materialize(distinct_vectors(usable, k + 1))
    if vectors.isEmpty():
        return spark.createDataFrame([], "id string, other string, similarity double, rank int")
    index = spark.sparkContext.broadcast(fit(vectors, dimension))  # CELLS centroids, one more for each 1024 vectors of the largest cell, and PARTS x CODES codewords

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dimension).astype(np.float32)
            at, codes = index.value.encode(x)
            code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            lists = index.value.probes(x, probes)
            visits = pa.FixedSizeListArray.from_arrays(pa.array(lists.ravel()), lists.shape[1]).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), code, batch.column("cid"), batch.column("v"), visits], ["list", "code", "cid", "v", "visits"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, found, similar = [pa.array([], pa.string())], [pa.array([], pa.string())], [np.empty(0)]
        if left.num_rows and right.num_rows:
            at = left.column("list")[0].as_py()
            x = matrix(left.column("v"), dimension)
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            ids, cids = left.column("cid").combine_chunks(), right.column("asker").combine_chunks()
            place = np.empty(len(x), np.int64)
            place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(x))
            q = matrix(right.column("asked"), dimension)
            take, keep = min(SHORTLIST, len(x)), min(k + 1, len(x))
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                guess = index.value.estimates(part.astype(np.float32), at, codes)
                short = np.argpartition(-guess, take - 1, axis=1)[:, :take]
                exact = np.round(np.einsum("qd,qrd->qr", part, x[short]), 6)
                order = np.lexsort((place[short], -exact), axis=1)[:, :keep]
                best = np.take_along_axis(exact, order, 1).ravel()
                some = np.flatnonzero(best >= (-2.0 if least is None else least))
                asked.append(cids.take(pa.array(a + some // keep)))
                found.append(ids.take(pa.array(np.take_along_axis(short, order, 1).ravel()[some])))
                similar.append(best[some])
        return pa.table([pa.chunked_array(asked), pa.chunked_array(found), pa.array(np.concatenate(similar))], ["cid", "near", "similarity"])

    kept = materialize(vectors.mapInArrow(encode, "list int, code binary, cid string, v array<float>, visits array<int>"))
    asked = kept.select(F.explode("visits").alias("list"), F.col("cid").alias("asker"), F.col("v").alias("asked"))
    loads = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qb"))
    grid = materialize(kept.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / MEMBER_BLOCK).cast("int").alias("mb")).join(loads, "list"))
    cut = grid.where("mb > 1 or qb > 1")  # rows for crowded lists only
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    left = kept.drop("visits").join(cut, "list", "left").withColumn("m", F.pmod(F.xxhash64("cid"), one("mb")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), one("qb") - 1)))
    right = asked.join(cut, "list", "left").withColumn("q", F.pmod(F.xxhash64("asker"), one("qb")).cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), one("mb") - 1)))
    found = left.select("list", "m", "q", "code", "cid", "v").groupBy("list", "m", "q").cogroup(right.select("list", "m", "q", "asker", "asked").groupBy("list", "m", "q")).applyInArrow(compare, "cid string, near string, similarity double")
    order = lambda by, *last: Window.partitionBy(by).orderBy(F.col("similarity").desc(), *last)
    # The k + 1 best classes by their smallest id hold the k + 1 best ids.
    classes = found.withColumn("place", F.row_number().over(order("cid", "near"))).where(F.col("place") <= k + 1).drop("place")
    several = classes.join(vectors.select(F.col("cid").alias("near"), "ids"), "near").select("cid", "similarity", F.explode("ids").alias("other"))
    best = several.withColumn("place", F.row_number().over(order("cid", "other"))).where(F.col("place") <= k + 1).drop("place")
    owners = usable.join(vectors.select("cid", "v"), "v").select("id", "cid")
    mine = owners.join(best, "cid").where(F.col("id") != F.col("other"))
    return mine.withColumn("rank", F.row_number().over(order("id", "other"))).where(F.col("rank") <= k).select("id", "other", "similarity", "rank")


def close_pairs(neighbours: DataFrame) -> DataFrame:
    """Distinct pairs a < b of which one is among the neighbours of the other."""
    return neighbours.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
