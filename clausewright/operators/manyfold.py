"""Hybrid retrieval for thousands of queries: both halves as sparse products, exact, block by block.

Equal query texts are answered once and equal texts are scored once. The
vectors of ``retrieval.hash_embedding`` have few entries, so BM25 and the
cosine are sums over short lists; a task scores blocks of texts where they lie
and keeps the best of each query.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import materialize
from . import retrieval as R

BLOCK = 32768  # texts scored at once
AGAIN = 512  # joined lists kept
GROUPS = 512  # groups whose greatest scores give a bound
HEAD = 160  # best texts kept of a shared sum
PART = 1024  # queries merged at once
QUERIES = 1 << 17  # queries sent to the tasks at once
SLACK = 1e-6
BEST = "part int, q array<long>, doc array<long>, score array<double>, n array<int>"


class Asked:
    """Sparse queries (q, term, weight), in an order in which neighbours share their first terms."""

    def __init__(self, q: np.ndarray, term: np.ndarray, weight: np.ndarray, every: np.ndarray):
        by = np.lexsort((weight, term))
        new = (np.diff(term[by]) != 0) | (np.diff(weight[by]) != 0)
        step = np.empty(len(by), np.int64)  # a term with its weight; the commonest come first
        step[by] = np.concatenate([[0], np.cumsum(new)])[: len(by)]
        common = np.bincount(step)
        place = np.empty(len(common), np.int64)
        place[np.argsort(-common, kind="stable")] = np.arange(len(common))
        step = place[step]
        order = np.lexsort((step, q))
        q, term, weight, every = q[order], term[order], weight[order], np.unique(every)
        start, end = np.searchsorted(q, every), np.searchsorted(q, every, side="right")
        path, terms = step[order].tolist(), term.tolist()
        rows = sorted((path[a:b], i) for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)))
        self.q = every[[i for _, i in rows]] if rows else every
        self.terms = [terms[start[i] : end[i]] for _, i in rows]
        self.weights = [weight[start[i] : end[i]].tolist() for _, i in rows]
        self.shared = [0] * (len(rows) + 1)  # leading terms shared with the query before
        for i in range(1, len(rows)):
            a, b = rows[i - 1][0], rows[i][0]
            self.shared[i] = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905


class Lists:
    """The texts of a block by term."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, vocabulary: int):
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order].astype(np.int64), weight[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=vocabulary))]).tolist()

    def add(self, to: np.ndarray, terms: list[int], weights: list[float]) -> np.ndarray:
        for t, x in zip(terms, weights, strict=True):
            a, b = self.start[t], self.start[t + 1]
            if a < b:
                to[self.doc[a:b]] += self.weight[a:b] * x
        return to


def best(asked: Asked, lists: Lists, n: int, k: int, positive: bool, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ``k`` best of ``n`` texts for each query, ``PART`` queries at a time: (place of the query, text, score to 6 decimals); equal scores by text.

    ``positive``: only scores above zero. ``least`` holds each query's ``k``-th
    best score so far, below which nothing is needed, and is raised. The sum of
    leading terms is kept for the queries that share them. Where the other
    terms are in few texts, only these can leave the order of that sum.
    """
    empty = np.zeros(-(-max(n, 1) // GROUPS) * GROUPS)
    empty[n:] = -np.inf
    work, more = np.empty_like(empty), np.zeros_like(empty)
    spare: list[np.ndarray] = []
    stack: list[list] = [[0, empty, None]]  # terms, their sum, its HEAD best texts once they are asked for
    again: dict[tuple, tuple | None] = {}  # lists of several terms that more than one query adds
    floor = 0.0 if positive else -np.inf

    def cut(at: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(s) > 8 * k:
            few = np.flatnonzero(s >= np.partition(s, -k)[-k])
            at, s = at[few], s[few]
        first = np.lexsort((at, -s))[:k]
        return at[first], s[first]

    def whole(score: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The best by a scan; the k-th of the greatest scores of groups is at most the k-th score."""
        bound = np.partition(score.reshape(-1, GROUPS).max(axis=0), -k)[-k] if k < GROUPS else -np.inf
        at = np.flatnonzero(score > max(bound - SLACK, floor))
        return cut(at, np.round(score[at], 6), k)

    def join(spans: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray]:
        at = np.unique(np.concatenate([lists.doc[a:b] for a, b, _ in spans]))
        for a, b, x in spans:
            more[lists.doc[a:b]] += lists.weight[a:b] * x
        gain = more[at]
        more[at] = 0
        return at, gain

    def few(entry: list, spans: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray] | None:
        """The best where the spans of the lists hold the only texts whose score differs from the entry's sum."""
        if entry[2] is None:
            entry[2] = whole(entry[1], HEAD, -np.inf)
        head, s = entry[2]
        joined = None
        if len(spans) == 1:
            a, b, x = spans[0]
            joined = lists.doc[a:b], lists.weight[a:b] * x
        elif (key := tuple(spans)) in again:
            joined = again[key] = again[key] or join(spans)
        else:
            if len(again) >= AGAIN:
                again.clear()
            again[key] = None
        if joined:
            at, gain = joined
            sums = entry[1][at] + gain
            other = at[np.minimum(np.searchsorted(at, head), len(at) - 1)] != head
        else:
            for a, b, x in spans:
                more[lists.doc[a:b]] += lists.weight[a:b] * x
            at = np.concatenate([lists.doc[a:b] for a, b, _ in spans])
            sums = entry[1][at] + more[at]
            work[head] = 0
            work[at] = 1
            other = work[head] == 0
            more[at] = 0
        head, s = head[other][:k], s[other][:k]
        if len(head) < min(k, n) and len(other) < n:
            return None
        near = np.flatnonzero(sums > max(s[-1] - SLACK if len(s) == k else -np.inf, floor))
        at, sums = at[near], np.round(sums[near], 6)
        if not joined and len(at) > 1:
            at, one = np.unique(at, return_index=True)
            sums = sums[one]
        return cut(np.concatenate([head, at]), np.concatenate([s, sums]), k)

    which: list[int] = []
    found: list[np.ndarray] = []
    scores: list[np.ndarray] = []
    for i, (terms, weights) in enumerate(zip(asked.terms, asked.weights, strict=True)):
        while stack[-1][0] > asked.shared[i]:
            spare.append(stack.pop()[1])
        depth, base, _ = stack[-1]
        if (deeper := asked.shared[i + 1]) > depth:
            above, base = base, spare.pop() if spare else np.empty_like(empty)
            np.copyto(base, above)
            lists.add(base, terms[depth:deeper], weights[depth:deeper])
            stack.append([deeper, base, None])
            depth = deeper
        spans = [(lists.start[t], lists.start[t + 1], x) for t, x in zip(terms[depth:], weights[depth:], strict=True) if lists.start[t] < lists.start[t + 1]]
        got = None
        if not spans:
            if stack[-1][2] is None:
                stack[-1][2] = whole(base, HEAD, -np.inf)
            got = stack[-1][2][0][:k], stack[-1][2][1][:k]
        elif sum(b - a for a, b, _ in spans) * 4 < n:
            got = few(stack[-1], spans)
        if got is None:
            np.copyto(work, base)
            lists.add(work, terms[depth:], weights[depth:])
            got = whole(work, k, max(least[i] - SLACK, floor))
        at, s = got
        wanted = (s >= least[i]) & (s > floor)
        at, s = at[wanted], s[wanted]
        if len(at) == k:
            least[i] = s[-1]
        which.append(len(at))
        found.append(at)
        scores.append(s)
        if len(which) == PART or i + 1 == len(asked.q):
            yield np.repeat(np.arange(i + 1 - len(which), i + 1), which), np.concatenate(found), np.concatenate(scores)
            which, found, scores = [], [], []


def _scan(shared, entries: Callable, vocabulary: int, k: int, positive: bool) -> Callable:
    """Score the texts (doc, n copies, what ``entries`` reads) against the queries, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        least = np.full(len(asked.q), -np.inf)

        def score(held: list) -> Iterator[pa.RecordBatch]:
            doc, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            row = np.concatenate([x[2] + b for x, b in zip(held, np.cumsum([0] + [len(x[0]) for x in held]), strict=False)])
            term, weight = (np.concatenate([x[i] for x in held]) for i in (3, 4))
            held.clear()
            order = np.argsort(doc)  # files come in any order
            doc, n, row = doc[order], n[order], np.argsort(order)[row]
            lists = Lists(row, term, weight, vocabulary)
            del row, term, weight
            for part, (place, at, s) in enumerate(best(asked, lists, len(doc), k, positive, least)):
                if len(place):
                    one = (asked.q[place], doc[at], s, np.minimum(n[at], k).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(place)], pa.int32()), pa.array(x)) for x in one)], ["part", "q", "doc", "score", "n"])

        held, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(a, BLOCK)
                if size + piece.num_rows > BLOCK and held:
                    yield from score(held)
                    held, size = [], 0
                held.append((piece.column("doc").to_numpy(), piece.column("n").to_numpy(), *entries(piece)))
                size += piece.num_rows
        if held:
            yield from score(held)

    return run


def _merge(k: int) -> Callable:
    """The ``k`` best of all blocks, without those that ``k`` copies of better ones precede."""

    def run(table: pa.Table) -> pa.Table:
        q, doc, s, n = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("q", "doc", "score", "n"))
        order = np.lexsort((doc, -s, q))
        q, doc, s, n = q[order], doc[order], s[order], n[order]
        first = np.searchsorted(q, q)
        before = np.cumsum(n) - n
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (s[1:] != s[:-1])])
        better = before[np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))] - before[first]
        keep = (np.arange(len(q)) - first < k) & (better < k)
        return pa.table({"q": q[keep], "doc": doc[keep], "score": s[keep]})

    return run


def _hashed(dimension: int) -> Callable:
    """Entries (row, slot, value) of the unit vectors that ``retrieval.hash_embedding`` gives a column of texts."""
    stops, word = frozenset(T.STOP_WORDS), re.compile(T.PATTERNS["alnum"])
    numbers: dict[str, int] = {}
    slots, signs = [], []

    def number(w: str) -> int:
        if w not in numbers:
            if len(w) < 2 or w in stops:
                numbers[w] = -1
            else:
                hashes = [int.from_bytes(blake2b(f"{salt}:{w}".encode(), digest_size=8).digest(), "big") for salt in (0, 1)]
                numbers[w] = len(slots)
                slots.append([h % dimension for h in hashes])
                signs.append([1.0 if h >> 63 else -1.0 for h in hashes])
        return numbers[w]

    def entries(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))]
        for a in range(0, len(texts), 512):
            known = [[x for w in word.findall((t or "").lower()) if (x := numbers[w] if w in numbers else number(w)) >= 0] for t in texts[a : a + 512]]
            flat = np.array([x for xs in known for x in xs], np.int64)
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(known)), [len(xs) for xs in known])
            at = (row[:, None] * dimension + np.array(slots)[flat]).ravel()
            v = np.bincount(at, np.array(signs)[flat].ravel(), len(known) * dimension).reshape(-1, dimension)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = R._unit(pa.array(np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float32).ravel()), dimension)
            row, slot = np.nonzero(v)
            out.append(((row + a).astype(np.int32), slot.astype(np.int32), v[row, slot]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return entries


def _semantic(texts: DataFrame, asked: DataFrame, dimension: int, k: int) -> DataFrame:
    spark = texts.sparkSession

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _hashed(dimension)
        for batch in batches:
            row, slot, v = hashed(batch.column("query").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(row)), pa.array(slot.astype(np.int64)), pa.array(v, pa.float64())], ["q", "term", "weight"])

    rows = asked.select("q", "query").mapInArrow(vectors, "q long, term long, weight double").toArrow()
    shared = spark.sparkContext.broadcast(Asked(*(rows.column(c).to_numpy() for c in ("q", "term", "weight")), asked.select("q").toArrow().column("q").to_numpy()))
    kept: list[Callable] = []

    def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not kept:
            kept.append(_hashed(dimension))
        return kept[0](batch.column("text").to_pylist())

    return texts.select("doc", "n", "text").mapInArrow(_scan(shared, entries, dimension, k, False), BEST)


def _lexical(texts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = texts.sparkSession
    rows = asked.select("q", F.explode(T.lexical_tokens(F.col("query"))).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("qtf")).toArrow()
    terms = rows.column("term").combine_chunks().dictionary_encode()
    q, qtf = rows.column("q").to_numpy(), rows.column("qtf").to_numpy().astype(np.float64)
    vocabulary = len(terms.dictionary)
    words = spark.sparkContext.broadcast(terms.dictionary)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column("t")
            length = np.diff(t.offsets.to_numpy())
            term = pc.index_in(t.flatten(), words.value).fill_null(-1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), length)[term >= 0]
            pair, tf = np.unique(row * vocabulary + term[term >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * vocabulary).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % max(vocabulary, 1), tf))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n"), pa.array(length.astype(np.int32)), *lists], ["doc", "n", "length", "term", "tf"])

    hits = materialize(texts.select("doc", "n", T.lexical_tokens(F.col("text")).alias("t")).mapInArrow(postings, "doc long, n long, length int, term array<int>, tf array<int>"))
    total = hits.agg(F.sum("n").alias("n"), F.sum(F.col("length") * F.col("n")).alias("length")).first()
    counts = hits.select("n", F.explode("term").alias("term")).groupBy("term").agg(F.sum("n").alias("df")).toArrow()
    df = np.zeros(vocabulary)
    df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
    n = total["n"] or 0
    idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), (total["length"] or 0) / max(n, 1)
    shared = spark.sparkContext.broadcast(Asked(q, terms.indices.to_numpy().astype(np.int64), qtf, q))
    gains = spark.sparkContext.broadcast(idf)

    def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists, length = batch.column("term"), batch.column("length").to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        term, tf = lists.flatten().to_numpy().astype(np.int64), batch.column("tf").flatten().to_numpy().astype(np.float64)
        return row, term, gains.value[term] * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * length[row] / mean))

    return hits.mapInArrow(_scan(shared, entries, vocabulary, k, True), BEST)


def hybrid_many(chunks: DataFrame, queries: DataFrame, dimension: int = R.HASH_DIMENSION, final: int = 5, reranker: R.Reranker | None = None) -> DataFrame:
    """What ``retrieval.hybrid_search`` gives with hashed vectors, for many queries: query_id, key, fusion_score, rerank_score, rank.

    ``chunks``: key, text (not null), key unique. ``queries``: query_id,
    query (not null). Candidates, fusion and reranking are exact and whole.
    """
    k, reranker = R.CANDIDATES, reranker or R.Reranker()
    stored = materialize(chunks.select("key", "text", F.sha2("text", 256).alias("digest")))
    same = Window.partitionBy("digest")
    members = stored.select("key", "digest").withColumn("place", F.row_number().over(same.orderBy("key"))).withColumn("n", F.count(F.lit(1)).over(same))
    members = materialize(members.where(F.col("place") <= k))
    distinct = stored.join(members.where("place = 1").select("key", "n"), "key")
    parts = max(12, -(-stored.count() // BLOCK))
    texts = materialize(distinct.repartitionByRange(parts, "key").sortWithinPartitions("key").select(F.monotonically_increasing_id().alias("doc"), "n", "digest", "text"))  # doc rises with the first key
    known = members.select("digest", "key").join(texts.select("digest", "doc"), "digest").select("doc", "key")

    queries = materialize(queries.select("query_id", "query"))
    asked = materialize(queries.select("query").distinct().withColumn("q", F.monotonically_increasing_id()))
    blocks = max(1, -(-asked.count() // QUERIES))
    halves: dict[str, DataFrame] = {}
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        for name, found in (("semantic", _semantic(texts, some, dimension, k)), ("bm25", _lexical(texts, some, k))):
            top = materialize(found.groupBy("part").applyInArrow(_merge(k), "q long, doc long, score double"))
            halves[name] = halves[name].unionByName(top) if name in halves else top
    ranks = {name: R.ranked(x.join(known, "doc"), "q", "score", "key", k).select("q", "key", "doc", F.col("rank").alias(name)) for name, x in halves.items()}
    place = {name: F.coalesce(1.0 / (R.RRF_K + F.min(name)), F.lit(0.0)) for name in ranks}
    both = ranks["semantic"].unionByName(ranks["bm25"], allowMissingColumns=True)  # at most 2 k a query, so fusion cuts none
    fused = both.groupBy("q", "key", "doc").agg(F.round(place["semantic"] + place["bm25"], 8).alias("fusion_score"))
    pairs = fused.join(asked.select("q", reranker.features(F.col("query")).alias("asked")), "q").join(texts.select("doc", reranker.features(F.col("text")).alias("given")), "doc")
    scored = pairs.select("q", "key", "fusion_score", F.round(reranker.score(F.col("asked"), F.col("given")), 6).alias("rerank_score"))
    w = Window.partitionBy("q").orderBy(F.col("rerank_score").desc(), F.col("fusion_score").desc(), F.col("key").asc())
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= final)
    return queries.join(asked, "query").select("query_id", "q").join(top, "q").select("query_id", "key", "fusion_score", "rerank_score", "rank")
