"""HTML pages and their parsers: text, title, links, table rows, notices, listings, questions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

BLOCKS = frozenset("p div br li tr td th h1 h2 h3 h4 h5 h6 section article table ul ol title".split())
SILENT = frozenset(("script", "style", "noscript"))
STANDARD = re.compile(r"IS\s*\d+(?:\s*:\s*\d{4})?", re.I)
DAY = r"(\d{1,2}\s+[A-Za-z]+\s+\d{4})"
# Phrases that date a notice, in order of preference.
DATED = [re.compile(p, re.I) for p in (rf"enforcement[^\d]*{DAY}", rf"{DAY}[^\d]*enforcement", rf"effective[^\d]*{DAY}", rf"{DAY}[^\d]*effective")]
# States a laboratory's row may name.
STATES = re.compile("(Delhi|Maharashtra|Tamilnadu|Karnataka|Gujarat|Uttar|Haryana|Madhya|Rajasthan|West Bengal|Andhra|Telangana|Kerala|Punjab)")


class Page(HTMLParser):
    """One pass over a page that gathers its title, text lines, links, table rows and marked elements."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.lines, self.links, self.rows, self.marked = "", [""], [], [], []
        self._stack: list[tuple[str, str, int]] = []
        self._cells: list[list[str]] = []
        self._text: list[str] = []
        self.feed(html)
        self.close()
        self.lines = [x for x in (" ".join(line.split()) for line in self.lines) if x]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag in BLOCKS:
            self.lines.append("")
        if tag == "a" and given.get("href"):
            self.links.append(given["href"])
        if tag == "tr":
            self._cells.append([])
        if tag in ("td", "th") and self._cells:
            self._cells[-1].append("")
        if tag not in ("br", "img", "hr", "meta", "link", "input"):
            self._stack.append((tag, given.get("class") or "", len(self._text)))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self._stack):
            return
        while self._stack:
            name, kind, start = self._stack.pop()
            inside = " ".join("".join(self._text[start:]).split())
            if kind or name[:1] == "h" and name[1:].isdigit():
                self.marked.append((name, kind, inside))
            if name == "title":
                self.title = inside
            if name == "tr" and self._cells:
                self.rows.append([" ".join(c.split()) for c in self._cells.pop()])
            if name == tag:
                break
        if tag in BLOCKS:
            self.lines.append("")

    def handle_data(self, data: str) -> None:
        if self._stack and self._stack[-1][0] in SILENT:
            return
        self._text.append(data)
        self.lines[-1] += data
        if self._cells and self._cells[-1]:
            self._cells[-1][-1] += data

    def first(self, *kinds: str) -> str | None:
        """Text of the first element with one of the classes or tags."""
        return next((t for name, kind, t in self.marked if t and (name in kinds or set(kind.split()) & set(kinds))), None)


@dataclass(frozen=True)
class Field:
    """Where a field of a record comes from: the first of its finders that gives something."""

    name: str
    finders: tuple[Callable[[Scope], object], ...]


@dataclass(frozen=True)
class Scope:
    """The part of a page that one record describes, and the page."""

    page: Page
    text: str
    parts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """How the records of one kind are read from a page: the parts that become records, what a record needs, its fields."""

    kind: str
    licence_class: str
    fields: tuple[Field, ...]
    parts: Callable[[Page], list[Scope]]
    needs: tuple[str, ...] = ()


def marked(*kinds: str) -> Callable[[Scope], object]:
    """Text of the page's first element with one of the classes or tags."""
    return lambda s: s.page.first(*kinds)


def matched(pattern: str | re.Pattern, group: int = 0) -> Callable[[Scope], object]:
    """The first match in the part's text."""
    p = re.compile(pattern)
    return lambda s: m[group].strip() if (m := p.search(s.text)) else None


def word_of(words: dict[str, str], otherwise: str) -> Callable[[Scope], object]:
    """What the first of the words found in the part stands for."""
    return lambda s: next((to for w, to in words.items() if w in s.text.lower()), otherwise)


def below(header: str) -> Callable[[Scope], object]:
    """The cell under the first header cell that holds a word."""

    def find(s: Scope) -> object:
        cells = ((row, k) for head, row in zip(s.page.rows, s.page.rows[1:], strict=False) for k, cell in enumerate(head) if header in cell.lower())
        return next((row[k] for row, k in cells if k < len(row)), None)

    return find


def standards(most: int | None = None) -> Callable[[Scope], object]:
    """Distinct standard numbers of the part in order."""
    return lambda s: list(dict.fromkeys(STANDARD.findall(s.text)))[:most]


def titled(s: Scope) -> object:
    return s.page.title


def part(k: int) -> Callable[[Scope], object]:
    return lambda s: s.parts[k]


def constant(value: str) -> Callable[[Scope], object]:
    return lambda s: value


def whole(page: Page) -> list[Scope]:
    """The page as one part."""
    return [Scope(page, "\n".join(page.lines))]


def table_rows(least: int) -> Callable[[Page], list[Scope]]:
    """Table rows of at least so many characters."""
    return lambda page: [Scope(page, text) for row in page.rows if len(text := " ".join(row)) >= least]


def paired(first: set[str], second: set[str]) -> Callable[[Page], list[Scope]]:
    """Elements of the first classes with those of the second, in order, where both hold text."""

    def find(page: Page) -> list[Scope]:
        of = lambda classes: [t for _, kind, t in page.marked if classes & set(kind.split())]
        return [Scope(page, b, (a, b)) for a, b in zip(of(first), of(second), strict=False) if a and b]

    return find


DATES = Field("date", tuple(map(lambda p: matched(p, 1), DATED)))
CODE, NAME = r"\b(\d{7,8})\b", r"[A-Za-z][A-Za-z&.\s]{3,}"
RULES = {
    "qco": Rule(
        "notice", "full_text_ok",
        (Field("title", (marked("h1", "page-title", "heading"), titled, constant("Notice"))), Field("standards", (standards(),)), DATES,
         Field("publisher", (matched(r"(?i)\b(?:department|ministry|government of)\b[^\n]{0,100}"),)), Field("name", (marked("product-name", "item-description"), below("product")))),
        whole,
    ),
    "kys_catalogue": Rule("listing", "metadata_only", (Field("title", (titled, constant("Catalogue"))), Field("standards", (standards(1),))), whole),
    "lab_list": Rule(
        "laboratory", "full_text_ok",
        (Field("title", (titled,)), Field("standards", (standards(),)), Field("code", (matched(CODE, 1),)), Field("name", (matched(NAME),)),
         Field("state", (matched(STATES, 1),)), Field("status", (word_of({"suspen": "suspended", "revoked": "revoked"}, "active"),))),
        table_rows(20), ("code", "name"),
    ),
    "hallmarking": Rule("question", "metadata_only", (Field("title", (part(0),)), Field("name", (part(1),)), Field("standards", (standards(),))), paired({"question", "faq-question", "accordion-button"}, {"answer", "faq-answer", "accordion-content"})),
    "scheme_regulation": Rule(
        "regulation", "metadata_only",
        (Field("title", (matched(r"(?i)(?:hallmarking|scheme|regulation)[^\n]{0,200}"), titled)), Field("standards", (standards(1),)), Field("date", (matched(rf"(?i)(?:amendment|amdt)[^\d]*{DAY}", 1), *DATES.finders))),
        whole,
    ),
    "indigenous_pdf": Rule("standard", "full_text_ok", (Field("standards", (standards(1),)), Field("title", (lambda s: next((x for x in s.page.lines[:5] if not re.match(r"\d+(?:\.\d+)*\s|IS\s*\d", x)), None),))), whole),
}
GENERIC = Rule("generic", "metadata_only", (Field("title", (titled,)), Field("standards", (lambda s: [],))), whole)
ALIASES = {"quality_control_order": "qco", "know_your_standards": "kys_catalogue", "laboratories": "lab_list", "faq": "hallmarking", "regulation": "scheme_regulation", "scheme_guideline": "scheme_regulation", "testing_manual": "indigenous_pdf", "product_manual": "indigenous_pdf"}
FIELDS = "kind string, title string, standards array<string>, date string, publisher string, name string, code string, state string, status string, licence_class string"
NAMES = tuple(f.split()[0] for f in FIELDS.split(", "))


def records(rule: Rule, page: Page) -> list[dict]:
    """The records a rule reads from a page; a part that lacks what the rule needs gives none."""
    out = []
    for scope in rule.parts(page):
        found = {f.name: next((v for find in f.finders if (v := find(scope))), None) for f in rule.fields}
        if all(found[n] for n in rule.needs):
            out.append(dict.fromkeys(NAMES) | {"kind": rule.kind, "licence_class": rule.licence_class, "standards": []} | {k: v for k, v in found.items() if v})
    return out


def rule_for(source_type: str | None) -> Rule | None:
    """The rule of a source type or alias; None for an unknown one."""
    return RULES.get(ALIASES.get(source_type or "", source_type or ""))


def parse_pages(pages: DataFrame, key: str, url: str, html: str, source_type: str) -> DataFrame:
    """Records of every page by the rule of its source type; an unknown type gives one generic record."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(k, u, *(r[n] for n in NAMES)) for k, u, h, t in frame.itertuples(index=False) for r in records(rule_for(t) or GENERIC, Page(h or ""))]
            yield pd.DataFrame(out, columns=["key", "url", *NAMES])

    return pages.select(key, url, html, source_type).mapInPandas(run, f"key {kind}, url string, {FIELDS}")


def page_texts(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, title, text (a line per block) and absolute links of every page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = [(k, u, Page(h or "")) for k, u, h in frame.itertuples(index=False)]
            yield pd.DataFrame([(k, p.title or None, "\n".join(p.lines), [urljoin(u or "", x) for x in p.links]) for k, u, p in read], columns=["key", "title", "text", "links"])

    return pages.select(key, url, html).mapInPandas(run, f"key {kind}, title string, text string, links array<string>")
