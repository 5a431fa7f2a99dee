"""Lexical, vector and hybrid retrieval for one query or many in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import materialize

K1, B, RRF_K, CANDIDATES = 1.5, 0.75, 60, 20
HASH_DIMENSION = 1536
BATCH = 4096
QUERY_BYTES = 64 << 20


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): the inverted statistics of every text; null and empty texts have none."""
    tokens = docs.select(F.col(key).alias("key"), T.lexical_tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return tokens.select("key", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("key", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The ``k`` best texts per query by BM25: query_id, key, score (6 decimals), rank; ties by key.

    ``queries`` has query_id and query. The texts are cut into tokens once;
    only tokens that some query asks for are joined and shuffled. Batches of
    texts meet blocks of queries, one query or many alike, and only the ``k``
    best rows of each meeting are shuffled.
    """
    asked = materialize(queries.select("query_id", F.explode(T.lexical_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))
    tokens = docs.select(F.col(key).alias("key"), T.lexical_tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    tokens = materialize(tokens.select("key", F.size("t").alias("length"), "t"))
    totals = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    hits = tokens.select("key", "length", F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("key", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    hits = materialize(hits)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    weighed = hits.join(df, "term").crossJoin(F.broadcast(totals)).select("key", "term", gain.alias("w"))  # totals is one row
    scores = _block_scores(weighed, asked, tokens.count(), asked.select("query_id").distinct().count(), k)
    return ranked(scores.where("score > 0"), "query_id", "score", "key", k)


def _block_scores(weighed: DataFrame, asked: DataFrame, n_docs: int, n_queries: int, k: int) -> DataFrame:
    """Scores of the ``k`` best texts of each batch for each query (more where the last are equal)."""
    parts = max(1, -(-n_docs // BATCH))
    batches = weighed.groupBy(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("b")).agg(F.collect_list(F.struct("key", "term", "w")).alias("rows")).select("rows")
    blocks = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n_queries // BATCH)))).alias("b")).agg(F.collect_list(F.struct("query_id", "term", "qtf")).alias("qs")).select("qs")
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, key {weighed.schema['key'].dataType.simpleString()}, score double"

    def run(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches:
            for rows, qs in zip(batch.column("rows"), batch.column("qs"), strict=True):
                r, q = rows.values, qs.values
                keys, terms, asks = (pa.array(x).dictionary_encode() for x in (r.field("key"), r.field("term"), q.field("query_id")))
                place = {t: i for i, t in enumerate(terms.dictionary.to_pylist())}
                order = np.argsort(terms.indices.to_numpy(), kind="stable")
                at, w = keys.indices.to_numpy()[order], r.field("w").to_numpy()[order]
                start = np.searchsorted(terms.indices.to_numpy()[order], np.arange(len(place) + 1))
                found: list[list[np.ndarray]] = [[], [], []]
                mine = asks.indices.to_numpy()
                by_query = np.argsort(mine, kind="stable")
                edges = np.searchsorted(mine[by_query], np.arange(len(asks.dictionary) + 1))
                q_terms, q_tf = q.field("term").to_pylist(), q.field("qtf").to_numpy()
                for i in range(len(asks.dictionary)):
                    score = np.zeros(len(keys.dictionary))
                    for j in by_query[edges[i] : edges[i + 1]]:
                        t = place.get(q_terms[j])
                        if t is not None:
                            a, b = start[t], start[t + 1]
                            score[at[a:b]] += w[a:b] * q_tf[j]
                    score = np.round(score, 6)
                    hit = np.flatnonzero(score > 0)
                    if len(hit) > k:
                        hit = hit[score[hit] >= np.partition(score[hit], -k)[-k]]
                    found[0].append(np.full(len(hit), i))
                    found[1].append(hit)
                    found[2].append(score[hit])
                qi, ki, sc = (np.concatenate(x) if x else np.zeros(0) for x in found)
                yield pa.RecordBatch.from_arrays([asks.dictionary.take(pa.array(qi.astype(np.int64))), keys.dictionary.take(pa.array(ki.astype(np.int64))), pa.array(sc)], ["query_id", "key", "score"])

    return batches.crossJoin(blocks).mapInArrow(run, kinds)  # a stated query set, in blocks


def ranked(scores: DataFrame, query: str, score: str, key: str, k: int) -> DataFrame:
    """``rank`` 1..k by score descending, then key; cut before and after the shuffle."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key).asc())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_knn(vectors: DataFrame, key: str, vector: str, queries: DataFrame, dimension: int, k: int, budget: int = QUERY_BYTES) -> DataFrame:
    """The ``k`` nearest vectors of each query by exact cosine: query_id, key, score (6 decimals), rank.

    ``queries`` (query_id, vector) is a stated set, sent to the tasks in
    blocks of at most ``budget`` bytes. A task scans its vectors where they
    lie and keeps the ``k`` best of all it has seen, so that k rows per query
    and task are shuffled and no vector is.
    """
    spark = vectors.sparkSession
    asked = materialize(queries.select("query_id", F.col("vector").cast("array<float>").alias("v")).where(F.size("v") == dimension))
    kind, key_kind = queries.schema["query_id"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    usable = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == dimension)).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    parts = max(1, -(-asked.count() * dimension * 4 // budget))
    usable = usable if parts == 1 else materialize(usable)
    found = None
    for part in range(parts):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()  # about ``budget`` bytes
        one = usable.mapInArrow(_nearest_scan(spark.sparkContext.broadcast(block), dimension, k), f"query_id {kind}, key {key_kind}, score double")
        found = one if found is None else found.unionByName(one)
    return ranked(found, "query_id", "score", "key", k)


def _nearest_scan(shared: Broadcast, dimension: int, k: int) -> Callable:
    """A scan that keeps each query's ``k`` best vectors; equal scores by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value.column("query_id").combine_chunks()
        y = _unit(shared.value.column("v").combine_chunks().flatten(), dimension)
        who, score, what = np.zeros(0, np.int64), np.zeros(0), None
        worst = np.full(len(y), -np.inf)
        kind = None
        for batch in batches:
            if not batch.num_rows or not len(y):
                continue
            kind = batch.column("key").type
            keys, x = np.array(batch.column("key").to_pylist()), _unit(batch.column("v").flatten(), dimension)
            rows, sims, names = [who], [score], [keys[:0] if what is None else what]
            for a in range(0, len(y), 256):
                s = np.round(y[a : a + 256] @ x.T, 6)
                least = np.partition(s, -k, axis=1)[:, -k] if k < len(x) else np.full(len(s), -np.inf)
                q, at = np.nonzero(s >= np.maximum(least, worst[a : a + 256])[:, None])
                rows.append(q + a)
                sims.append(s[q, at])
                names.append(keys[at])
            who, score, what = np.concatenate(rows), np.concatenate(sims), np.concatenate(names)
            order = np.lexsort((what, -score, who))
            who, score, what = who[order], score[order], what[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            keep = place < k
            who, score, what, place = who[keep], score[keep], what[keep], place[keep]
            worst[who[place == k - 1]] = score[place == k - 1]
        if len(who):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), pa.array(what.tolist(), kind), pa.array(score)], ["query_id", "key", "score"])

    return run


def _unit(flat: pa.Array, dimension: int) -> np.ndarray:
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def norm_evidence(vectors: DataFrame, vector: str, tolerance: float = 1e-5) -> DataFrame:
    """One row: vectors, the greatest deviation of a length from 1, and whether the inner product may stand for the cosine."""
    deviation = F.max(F.abs(T.l2_norm(F.col(vector)) - 1))
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.round(deviation, 4).alias("deviation"), (deviation <= tolerance).alias("unit"))


def index_problems(vectors: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """(problem, n) of an index to be built: null, wrongly sized and non-finite vectors, repeated keys."""
    v = F.col(vector)
    flags = {
        "missing_vector": v.isNull(),
        "wrong_dimension": v.isNotNull() & (F.size(v) != dimension),
        "not_finite": v.isNotNull() & F.exists(v, lambda x: F.isnan(x) | x.isNull()),
        "all_zero": v.isNotNull() & F.forall(v, lambda x: x == 0),
    }
    counts = vectors.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items())).unpivot([], list(flags), "problem", "n")
    repeated = vectors.groupBy(key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated_key").alias("problem"), "n")
    return counts.unionByName(repeated)


def reciprocal_rank_fusion(lists: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """Full outer merge of ranked lists (query_id, key, rank): score is the sum of 1 / (k + rank); ties by key."""
    merged = None
    for name, df in lists.items():
        one = df.select("query_id", "key", F.col("rank").alias(f"{name}_rank"))
        merged = one if merged is None else merged.join(one, ["query_id", "key"], "full")
    part = lambda n: F.coalesce(1.0 / (k + F.col(f"{n}_rank")), F.lit(0.0))
    total = part(next(iter(lists)))
    for n in list(lists)[1:]:
        total = total + part(n)
    scored = merged.withColumn("fusion_score", F.round(total, 8))
    w = Window.partitionBy("query_id").orderBy(F.col("fusion_score").desc(), F.col("key").asc())
    return scored.withColumn("fusion_rank", F.row_number().over(w))


def heuristic_rerank(hits: DataFrame, query: str, strategy: str = "relevance", top_k: int = 100) -> DataFrame:
    """The ``top_k`` best of a query's hits (key, text, title, depth, licence, score) reranked: new score and rank.

    relevance adds 0.05 per query term found in the first 500 characters or
    the title and 0.01 for each level above depth 5, capped at 1.5; authority
    adds 0.1 for open licences, capped at 1; freshness changes nothing.
    """
    terms = [t for t in dict.fromkeys(query.lower().split()) if len(t) > 2]
    place = F.concat_ws(" ", F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 500)), F.lower(F.coalesce("title", F.lit(""))))
    found = sum((F.contains(place, F.lit(t)).cast("int") for t in terms), F.lit(0))
    scores = {
        "relevance": F.least(F.col("score") + found * 0.05 + F.greatest(5 - F.col("depth"), F.lit(0)) * 0.01, F.lit(1.5)),
        "authority": F.least(F.col("score") + F.when(F.col("licence") == "full_text_ok", 0.1).otherwise(0.0), F.lit(1.0)),
        "freshness": F.col("score"),
    }
    if strategy not in scores:
        raise ValueError(f"unknown strategy: {strategy}")
    w = Window.orderBy(F.col("reranked").desc(), F.col("key").asc())
    top = hits.withColumn("reranked", F.round(scores[strategy], 6)).orderBy(F.desc("reranked"), "key").limit(top_k)
    return top.withColumn("rank", F.row_number().over(w))


def term_hits(text: Column, query: str) -> Column:
    """Share of the query's terms (over two letters, no stop words) that the text contains."""
    terms = [t for t in dict.fromkeys(query.lower().split()) if len(t) > 2 and t not in T.STOP_WORDS]
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0)) / float(max(1, len(terms)))


def all_terms(docs: DataFrame, key: str, text: str, query: str, most: int = 8) -> DataFrame:
    """Keys whose text has every one of the first ``most`` alphanumeric terms of the query: key, occurrences."""
    terms = [t for t in dict.fromkeys("".join(c if c.isalnum() else " " for c in query.lower()).split())][:most]
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(T.PATTERNS["alnum"]), F.lit(0))
    count = F.size(F.filter("t", lambda x: x.isin(terms)))
    return docs.select(F.col(key).alias("key"), tokens.alias("t")).where(F.size(F.array_intersect("t", F.array(*map(F.lit, terms)))) == len(terms)).select("key", count.alias("occurrences"))


def resolve_identifier(rows: DataFrame, standards: str, query: str) -> tuple[str, str | None]:
    """(state, standard) for the first standard number in a query: none, unknown, ambiguous or pinned.

    Two standards reach the driver: the first and the last edition of the asked number.
    """
    import re

    m = re.search(T.PATTERNS["standard_query"], query)
    if not m:
        return "none", None
    number, year = m[1].lstrip("0") or "0", m[2]
    value = F.explode(standards) if rows.schema[standards].dataType.typeName() == "array" else F.col(standards)
    edition = F.col("s").rlike(rf"^IS\s*0*{number}:{year}$" if year else rf"^IS\s*0*{number}(:|$)")
    known = rows.select(value.alias("s")).where(edition).agg(F.min("s").alias("first"), F.max("s").alias("last")).first()
    if known["first"] is None:
        return "unknown", None
    return ("pinned", known["first"]) if known["first"] == known["last"] else ("ambiguous", None)


def hash_embedding(dimension: int = HASH_DIMENSION) -> Callable:
    """Arrow UDF: signed feature hashing of a text's words into a unit vector (all zero without words)."""
    import re

    stops = frozenset(T.STOP_WORDS)
    word = re.compile(T.PATTERNS["alnum"])

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        slots: dict[str, list[tuple[int, float]]] = {}
        out = []
        for t in texts:
            v = np.zeros(dimension)
            for w in word.findall((t or "").lower()):
                if len(w) < 2 or w in stops:
                    continue
                if w not in slots:
                    hashes = [int.from_bytes(blake2b(f"{salt}:{w}".encode(), digest_size=8).digest(), "big") for salt in (0, 1)]
                    slots[w] = [(h % dimension, 1.0 if h >> 63 else -1.0) for h in hashes]
                for at, sign in slots[w]:
                    v[at] += sign
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return embed


class Reranker:
    """Protocol of a pair scorer; the default is the share of query words in the text."""

    def features(self, text: Column) -> Column:
        """What the score needs of a query or a text, taken once of each."""
        return T.guard_tokens(text)

    def column(self, query: Column, text: Column) -> Column:
        return self.score(self.features(query), self.features(text))

    def score(self, asked: Column, given: Column) -> Column:
        return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, given)).cast("double"), F.size(asked).cast("double")), F.lit(0.0))


def hybrid_search(spark: SparkSession, chunks: DataFrame, vectors: DataFrame, queries: DataFrame, dimension: int, final: int = 5, reranker: Reranker | None = None) -> DataFrame:
    """BM25 and exact vector candidates, fused, reranked and cut: query_id, key, fusion_score, rerank_score, rank.

    ``chunks``: key, text. ``vectors``: key, vector. ``queries``: query_id,
    query, vector.
    """
    lexical = bm25(chunks, "key", "text", queries)
    semantic = exact_knn(vectors, "key", "vector", queries, dimension, CANDIDATES)
    fused = reciprocal_rank_fusion({"semantic": semantic, "bm25": lexical}).where(F.col("fusion_rank") <= 2 * CANDIDATES)
    score = (reranker or Reranker()).column(F.col("query"), F.col("text"))
    scored = fused.join(chunks.select("key", "text"), "key").join(queries.select("query_id", "query"), "query_id").withColumn("rerank_score", F.round(score, 6))
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("fusion_score").desc(), F.col("key").asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= final).select("query_id", "key", "fusion_score", "rerank_score", "rank")
