"""Interfaces of what cannot be computed here (models, readers, fetchers), with deterministic local forms."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass
from hashlib import blake2b
from typing import Protocol


class Embedder(Protocol):
    """Texts to unit vectors; created once per worker."""

    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """An embedder without a model: signed hashes of a text's words; an empty text is refused."""

    def __init__(self, dimension: int) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            if not t:
                raise ValueError("empty text")
            v = [0.0] * self.dimension
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out


class PageReader(Protocol):
    """Bytes of a document to its pages' texts (PDF text, OCR)."""

    def pages(self, content: bytes) -> list[str]: ...


class Fetcher(Protocol):
    """A URL to status and bytes."""

    def get(self, url: str) -> tuple[int, bytes]: ...


class Provider(Protocol):
    """A prompt to generated text."""

    def generate(self, prompt: str) -> str: ...


class Queue:
    """A provider that gives prepared answers in order."""

    def __init__(self, answers: Iterable[str]) -> None:
        self._answers = deque(answers)

    def generate(self, prompt: str) -> str:
        return self._answers.popleft()


class PlainText:
    """A page reader for text files: form feeds end pages."""

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8", errors="replace").split("\f")


@dataclass(frozen=True)
class Answer:
    """A generated answer and why it was refused, if it was."""

    text: str | None
    attempts: int
    problem: str | None


def citation_problem(text: str, evidence: set[str]) -> str | None:
    """What is wrong with the citations of an answer: none at all, or ids outside the evidence."""
    cited = set(re.findall(r"\[(E\d+)\]", text))
    if not text.strip():
        return "empty_answer"
    if not cited:
        return "no_citation"
    return "unknown_citation" if cited - evidence else None


def grounded_answer(provider: Provider, prompt: str, evidence: set[str], attempts: int = 2) -> Answer:
    """The first of ``attempts`` answers that cites only its evidence; without evidence nothing is asked."""
    if not evidence:
        return Answer(None, 0, "no_evidence")
    problem = None
    for k in range(1, attempts + 1):
        text = provider.generate(prompt)
        problem = citation_problem(text, evidence)
        if problem is None:
            return Answer(text, k, None)
    return Answer(None, attempts, problem)
