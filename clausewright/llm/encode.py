"""Token ids of whole texts by a public byte-level tokenizer, over overlapping chunks.

A text of up to ``chunk`` characters is encoded at once. A longer one is cut
into chunks that become rows of their own, so that one huge text is worked on
by many tasks. Pre-tokens are found in each chunk from its own start; where
its scan and the scan of the chunk before share a boundary, both go on alike,
since the pattern looks ahead only. The text is divided at the first shared
boundary of each overlap and each piece is encoded alone; the ids of the
pieces in order are the ids of the text. A text with an overlap without a
shared boundary (one pre-token longer than the overlap) is encoded at once.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from importlib.util import find_spec

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 16_384
OVERLAP = 1_024
# Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """Path of a .tiktoken rank file in ``folder``, by default the installed public vocabularies."""
    if folder is None:
        found = find_spec("public_tokenizers")
        folder = os.path.dirname(found.origin) if found and found.origin else "/opt/tokenizers"
    return os.path.join(folder, f"{name}.tiktoken")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a rank file, loaded once per process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pre_tokens() -> regex.Pattern:
    return regex.compile(PATTERN)


def _boundaries(text: str, start: int, end: int) -> list[int]:
    """Pre-token starts of text[start:end] as scanned from ``start``.

    A pre-token that touches the end could reach further, and one before it
    could be cut otherwise; the last two starts are left out.
    """
    return [m.start() for m in _pre_tokens().finditer(text, start, end)][:-2]


def sync_point(window: str, first: int, second: int, overlap: int) -> int | None:
    """First boundary at or after ``second`` that scans from ``first`` and ``second`` share.

    A boundary after white space is not taken: the piece before it would end
    in white space and lose the sight of what follows it.
    """
    end = min(len(window), second + overlap)
    later = set(_boundaries(window, second, end))
    return next((p for p in _boundaries(window, first, end) if p >= second and p in later and not window[p - 1].isspace()), None)


def split_points(length: int, chunk: int) -> list[int]:
    """Starts of the chunks of a text."""
    return list(range(0, max(length, 1), chunk))


def encode_table(df: DataFrame, key: str, text: str, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP, count_only: bool = False) -> DataFrame:
    """Columns ``key`` and ids (array<int>), or n_tokens (int) with ``count_only``, for every row.

    An empty or null text has an empty list (count 0). No special tokens are
    added; strings that look like them are ordinary text. ``key`` must be
    unique; other columns of ``df`` do not matter.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("overlap must be between 1 and chunk")
    kind = df.schema[key].dataType.simpleString()
    out = "n int" if count_only else "ids array<int>"
    source = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    value = (lambda ids: len(ids)) if count_only else (lambda ids: ids)
    arrow = pa.int32() if count_only else pa.list_(pa.int32())

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        for batch in batches:
            ids = [value(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, arrow)], ["key", out.split()[0]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Chunk k travels with the chunk before and the overlap after, all that its two sync points need.
        for batch in batches:
            for key_, whole in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                starts = split_points(len(whole), chunk)
                for k, at in enumerate(starts):
                    low = max(0, at - chunk)
                    window = whole[low : at + chunk + overlap]
                    last = k == len(starts) - 1
                    yield pa.RecordBatch.from_arrays([pa.array([key_.as_py()], batch.column(0).type), pa.array([k], pa.int32()), pa.array([at - low], pa.int32()), pa.array([last]), pa.array([window])], ["key", "k", "at", "last", "window"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        for batch in batches:
            ks, ats, lasts, windows = (batch.column(c).to_pylist() for c in ("k", "at", "last", "window"))
            ids, synced = [], []
            for k, at, last, window in zip(ks, ats, lasts, windows, strict=True):
                begin = 0 if k == 0 else sync_point(window, 0, at, overlap)
                end = len(window) if last else sync_point(window, at, at + chunk, overlap)
                ok = begin is not None and end is not None
                synced.append(ok)
                ids.append(value(encode(window[begin:end])) if ok else value([]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(synced), pa.array(ids, arrow)], ["key", "k", "synced", out.split()[0]])

    name = out.split()[0]
    direct = source.where(F.length("text") <= chunk).mapInArrow(short, f"key {kind}, {out}")
    long = source.where(F.length("text") > chunk)
    chunks = long.mapInArrow(cut, f"key {kind}, k int, at int, last boolean, window string").repartition("key", "k")
    encoded = chunks.mapInArrow(pieces, f"key {kind}, k int, synced boolean, {out}")
    whole = F.sum(name).cast("int") if count_only else F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", name))), lambda p: p[name]))
    joined = encoded.groupBy("key").agg(F.bool_and("synced").alias("synced"), whole.alias(name))
    stitched = joined.where("synced").select("key", name)
    unstitched = long.join(joined.where("not synced").select("key"), "key", "left_semi").mapInArrow(short, f"key {kind}, {out}")
    result = direct.unionByName(stitched).unionByName(unstitched)
    return result.withColumnsRenamed({"key": key, "n": "n_tokens"})


def decode(ids: list[int], vocabulary: str) -> str:
    """The text of a list of ids: the tokens' raw bytes joined, then read as UTF-8."""
    return tokenizer(vocabulary).decode_bytes(list(ids)).decode("utf-8", errors="replace")
