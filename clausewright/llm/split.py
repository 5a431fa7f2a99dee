"""Cutting oversized texts into pieces at valleys of lexical cohesion, with overlap.

Between the words before and after a gap a similarity is kept while the gap
slides over the text; where it dips between two rises the topic changes. Each
piece ends at the deepest valley among the natural gaps (paragraph, line or
sentence end) of its size window; a window without a natural gap is cut
between two tokens. The next piece starts ``overlap`` tokens earlier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]")
BLOCK = 60
STOPS = ".!?;।。！？"


@dataclass(frozen=True)
class Limits:
    """Sizes in tokens; ``embedding_max`` None means no such limit."""

    hard_max: int
    overlap: int
    embedding_max: int | None


def natural_gaps(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """For each gap before token i (0 and n included) 3 at a paragraph, 2 at a line, 1 at a sentence end, else 0."""
    out = [0] * (len(spans) + 1)
    for i in range(1, len(spans)):
        between = text[spans[i - 1][1] : spans[i][0]]
        lines = between.count("\n") or between.count("\r")
        before = text[spans[i - 1][1] - 1]
        if lines:
            out[i] = 3 if lines > 1 else 2
        elif before in STOPS and (between or before in "。！？"):
            out[i] = 1
    return out


def valley_depths(words: list[str], gaps: list[int]) -> dict[int, float]:
    """Depth of the cohesion valley at each natural gap.

    Similarity is the cosine of the counts of BLOCK tokens on either side,
    updated in constant time as the gap moves. The depth is the height of
    the rises to the left and right above the gap.
    """
    n = len(words)
    ids: dict[str, int] = {}
    seq = [ids.setdefault(w, len(ids)) if w[0].isalnum() else -1 for w in words]
    left, right = [0] * len(ids), [0] * len(ids)
    dot = ll = rr = 0

    def add(side: list[int], other: list[int], k: int, by: int) -> tuple[int, int]:
        old = side[k]
        side[k] = old + by
        return by * other[k], (old + by) ** 2 - old**2

    for k in seq[:BLOCK]:
        if k >= 0:
            d, q = add(right, left, k, 1)
            dot, rr = dot + d, rr + q
    at, similar = [], []
    for g in range(1, n):
        for k, side, other, by in ((seq[g - 1], right, left, -1), (seq[g - 1], left, right, 1), (seq[g - 1 - BLOCK] if g > BLOCK else -1, left, right, -1), (seq[g - 1 + BLOCK] if g - 1 + BLOCK < n else -1, right, left, 1)):
            if k >= 0:
                d, q = add(side, other, k, by)
                dot += d
                if side is left:
                    ll += q
                else:
                    rr += q
        if gaps[g]:
            at.append(g)
            similar.append(dot / (ll * rr) ** 0.5 if ll and rr else 0.0)
    rise = [0.0] * len(at)
    for order in (range(len(at)), range(len(at) - 1, -1, -1)):
        peak, last = 0.0, None
        for j in order:
            peak = peak if last is not None and last >= similar[j] else similar[j]
            rise[j] += peak - similar[j]
            last = similar[j]
    return dict(zip(at, rise, strict=True))


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces (first token, end token, shared tokens) of at most ``limit`` tokens that cover the text."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, n, 0)]
    overlap = min(overlap, limit - 1)
    gaps = natural_gaps(text, spans)
    depths = valley_depths([text[a:b].lower() for a, b in spans], gaps)
    pieces, done = [], 0
    while done < n:
        shared = min(overlap, done)
        room = limit - shared
        if n - done <= room:
            end = n
        else:
            end = done + room
            for low in (done + room // 2, done):
                inside = [g for g in range(low + 1, done + room + 1) if gaps[g]]
                if inside:
                    end = max(inside, key=lambda g: (round(depths[g], 6), gaps[g], g))
                    break
        pieces.append((done - shared, end, shared))
        done = end
    return pieces


def split_rows(nodes: DataFrame, keys: list[str], prefix: str, text: str, at: str, config: str, limits: dict[str, Limits], default: str) -> DataFrame:
    """Pieces of every node: keys, piece, pieces, oversized, first_token, n_tokens, shared_tokens, first_char, end_char, text.

    Of several rows of a key the one with greatest ``at`` counts (repeated
    rows are whole). A null or unknown ``config`` means ``default``. A text
    within its limits, also a null, empty or blank one, is one piece. Pieces
    hold at most hard_max tokens and, with the prefix, embedding_max; a prefix
    that leaves no room is not counted. Joined by their characters from the
    end of the piece before, pieces give back the text.
    """
    names = [f"k{i}" for i in range(len(keys))]
    newest = nodes.groupBy(*(F.col(k).alias(a) for k, a in zip(keys, names, strict=True))).agg(F.max(F.struct(F.col(at).alias("at"), F.col(text).alias("text"), F.col(prefix).alias("prefix"), F.col(config).alias("config"))).alias("row"))
    rows = newest.select(*names, "row.text", "row.prefix", "row.config")
    kinds = ", ".join(f"{a} {nodes.schema[k].dataType.simpleString()}" for k, a in zip(keys, names, strict=True))
    fields = ["piece int", "pieces int", "oversized boolean", "first_token int", "n_tokens int", "shared_tokens int", "first_char int", "end_char int", "text string"]
    arrow = [pa.int32(), pa.int32(), pa.bool_(), *[pa.int32()] * 5, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source: list[int] = []
            out: list[tuple] = []
            for r, (body, head, name) in enumerate(zip(batch.column("text").to_pylist(), batch.column("prefix").to_pylist(), batch.column("config").to_pylist(), strict=True)):
                rule = limits.get(name) or limits[default]
                body, used = body or "", sum(1 for _ in TOKEN.finditer(head or ""))
                spans = [m.span() for m in TOKEN.finditer(body)]
                most = rule.embedding_max
                oversized = len(spans) > rule.hard_max or (most is not None and used + len(spans) > most)
                room = rule.hard_max if most is None else min(rule.hard_max, most - used if used < most else most)
                pieces = cut(body, room, rule.overlap) if oversized else [(0, len(spans), 0)]
                for k, (first, end, shared) in enumerate(pieces):
                    a = spans[first][0] if k else 0
                    b = spans[end - 1][1] if k < len(pieces) - 1 else len(body)
                    source.append(r)
                    out.append((k, len(pieces), oversized, first, end - first, shared, a, b, body[a:b]))
            columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
            keep = [batch.column(a).take(pa.array(source, pa.int64())) for a in names]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))], [*names, *(f.split()[0] for f in fields)])

    return rows.mapInArrow(run, ", ".join([kinds, *fields])).withColumnsRenamed(dict(zip(names, keys, strict=True)))
