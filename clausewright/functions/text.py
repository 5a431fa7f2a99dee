"""Scalar functions over text as JVM expressions, and the registry of named patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named patterns. They are not equivalent on purpose; each belongs to one stage.
PATTERNS = {
    "standard": r"(?i)\bIS\s*:?\s*(\d{2,6})\s*[:(]\s*(\d{4})",
    "standard_strict": r"^\s*IS\s*(\d+)\s*:\s*(\d{4})\s*$",
    "standard_query": r"(?i)\bIS\s*[-/]?\s*(\d+)(?:\s*:\s*(\d{4}))?",
    "clause": r"(?i)\b(?:clause|cl\.?)[\s:-]*(\d+(?:\.\d+)*)\b",
    "clause_line": r"^(\d+(?:\.\d+)+)\s+(.+)$",
    "edition_year": r":\s*(\d{4})",
    "lexical": r"[a-z0-9]+(?:[.:/-][a-z0-9]+)*",
    "alnum": r"[a-z0-9]+",
    "citation": r"\[E\d+\]",
    "measure": r"\d+(?:\.\d+)?\s*(?:V|Hz|W|A|kg|mm|kPa|MPa|Nm|N|s|min|h|percent)(?:[^A-Za-z0-9_]|$)",
    "number": r"\d+(?:\.\d+)?",
}
# Grammatical words that carry no subject.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "what", "when", "where", "which", "who", "with",
    "apply", "applies", "require", "required", "requirement", "requirements", "specified", "specify", "about", "according", "establish", "established",
)
# Phrases that tell a document's type; the first kind with a hit wins.
DOCUMENT_HINTS = (
    ("qco_amendment", ("quality control amendment", "qco amendment", "amendment order", "(amendment) order")),
    ("qco", ("quality control order", "qco")),
    ("implementation_circular", ("implementation", "circular", "revised is")),
    ("extension_order", ("extension", "last date", "concurrent running")),
    ("product_manual", ("product manual", "product-manual", "pm/ is", "pm-is", "bilingual-pm", "approved-is", "scheme of inspection and testing")),
    ("certification_faq", ("frequently asked questions", "certification faq")),
    ("laboratory_scope", ("laboratory scope", "testing charges", "lims")),
    ("scheme_information", ("scheme-i", "scheme i", "scheme-1", "isi mark scheme")),
    ("certification_guidance", ("certification process", "guidelines for grant", "product certification", "product specific information", "product specific guidelines", "first licence", "marking fee")),
    ("consumer_information", ("hallmarking", "consumer", "complaint redressal", "bis care")),
    ("technical_document", ("standards club", "training programme", "overview of nits", "know your standards")),
    ("standard", ("preview", "specification")),
)


def lexical_tokens(text: Column) -> Column:
    """Lower-case tokens; parts joined by . : / - stay together."""
    return F.regexp_extract_all(F.lower(text), F.lit(PATTERNS["lexical"]), F.lit(0))


def guard_tokens(text: Column) -> Column:
    """Distinct subject words: without stop words and single letters, a plural s taken off words of more than four letters."""
    stops = F.array(*map(F.lit, STOP_WORDS))
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(PATTERNS["alnum"]), F.lit(0)), lambda w: ~F.array_contains(stops, w))
    stems = F.transform(words, lambda w: F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_distinct(F.filter(stems, lambda w: (F.length(w) > 1) & ~F.array_contains(stops, w)))


def normal_standard(number: Column, year: Column) -> Column:
    """``IS number:year`` without leading zeros."""
    return F.concat(F.lit("IS "), number.cast("long").cast("string"), F.lit(":"), year)


def standards_in(text: Column) -> Column:
    """Normalised standard numbers of a text, each once, in order."""
    numbers = F.regexp_extract_all(text, F.lit(PATTERNS["standard"]), F.lit(1))
    years = F.regexp_extract_all(text, F.lit(PATTERNS["standard"]), F.lit(2))
    return F.array_distinct(F.zip_with(numbers, years, normal_standard))


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text in hex."""
    return F.sha2(text, 256)


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """A short id from the parts, joined by a unit separator; null parts count as empty."""
    joined = F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def slug(text: Column, most: int = 90) -> Column:
    """Lower-case letters and digits joined by single hyphens."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, most)


def first_hint(text: Column, hints=DOCUMENT_HINTS, default: str = "unknown") -> Column:
    """The first kind one of whose phrases the text contains."""
    low = F.lower(text)
    out = None
    for kind, phrases in hints:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(low, F.lit(p))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(default)


def text_quality(text: Column) -> Column:
    """EMPTY, LOW (under 50 characters or 8 words) or GOOD."""
    t = F.trim(F.coalesce(text, F.lit("")))
    words = F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))
    return F.when(t == "", "EMPTY").when((F.length(t) < 50) | (words < 8), "LOW").otherwise("GOOD")


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null or blank."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def line_key(text: Column) -> Column:
    """Lower case, trimmed, white space made single."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def strip_tags(html: Column) -> Column:
    """Text of HTML with each tag as a line break and entities for & < > resolved."""
    text = F.regexp_replace(html, r"<[^>]*>", "\n")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(ch))
    return text


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port or fragment, single slashes in the path."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/{2,}", "/")
    query = F.regexp_extract(url, r"(\?[^#]*)", 1)
    return F.when(scheme == "", url).otherwise(F.concat(scheme, F.lit("://"), host, path, query))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without credentials and port, or null."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def trusted_url(url: Column, hosts: list[str]) -> Column:
    """https, no credentials, no port but 443, host on the list."""
    shape = url.rlike(r"^https://[^/@?#:]+(:443)?([/?#]|$)")
    return F.coalesce(shape & url_host(url).isin(hosts), F.lit(False))


def ellipsis(text: Column, most: int = 280) -> Column:
    """The text, or its first ``most`` - 1 characters and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def humanise(code: Column) -> Column:
    """A code as a label: separators to blanks, first letter upper case."""
    words = F.lower(F.regexp_replace(code, r"[_-]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))


def l2_norm(vector: Column) -> Column:
    """Euclidean length of an array of numbers."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is all zero."""
    return F.coalesce(F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b)), F.lit(0.0))


def citation_parts(text: Column) -> Column:
    """A text cut at its inline citations, which are parts of their own."""
    return F.regexp_extract_all(text, F.lit(r"\[E\d+\]|[^\[]+|\["), F.lit(0))


def error_token(text: Column, otherwise: str = "unknown_error") -> Column:
    """A foreign error code if it is a plain short token, else ``otherwise``; nothing else of it may reach a log."""
    token = F.lower(F.trim(text))
    return F.when(token.rlike(r"^[a-z0-9_.-]{1,64}$"), token).otherwise(otherwise)
