"""One form for texts that look the same: a compiled longest-match transducer.

The mapping is computed once from Unicode's data (width, font, ligature and
no-break variants, composition, spaces, the property of drawing nothing) and a
table of look-alike letters and dashes, checked for conflicts and compiled to
one pattern over grapheme clusters. A text is rewritten in a single pass:
every cluster that can change is looked up as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

# Letters of other scripts drawn like Latin ones (Greek, Cyrillic, Armenian, Cherokee, Lisu), after the public table of confusable characters.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ѵ": "V", "Ү": "Y", "Һ": "h", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "օ": "o", "Օ": "O",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "µ": "μ",
}
# Dashes of the same shape, by the one that stands for them.
DASHES = {"-": "\u2010\u2011\u02d7\ufe63", "\u2013": "\u2012\u2212", "\u2014": "\u2015\ufe58"}
SAME_SHAPE = LOOKALIKES | {c: to for to, cs in DASHES.items() for c in cs}
#: Unicode's property of what draws nothing: soft hyphen, zero-width, joining and direction marks, fillers, variation selectors, tags.
IGNORABLE = r"\p{Default_Ignorable_Code_Point}"
JOINERS = "\u200c\u200d"
# A cluster holds at most one ASCII character, its first; text between runs stays as it is.
RUN = re.compile("[\x00-\x7f]?[^\x00-\x7f]+")
VIRAMA = 9  # canonical combining class
BLOCKS = ((0x80, 0x4E00), (0xA000, 0xAC00), (0xE000, 0x30000), (0xE0000, 0xE1000))  # all assigned characters but unified ideographs, Hangul syllables and surrogates

_ignorable = regex.compile(IGNORABLE)


def invisible(ch: str) -> bool:
    """Whether a character draws nothing by itself."""
    return _ignorable.match(ch) is not None


def plain_form(ch: str) -> str:
    """The ordinary form of a character that Unicode's data knows as a variant of the same shape.

    Variants are full and half widths, fonts (mathematical letters), no-break
    forms, ligatures and digraphs of letters, Roman numerals and Kangxi
    radicals. Superscripts, fractions, circled and positional forms are drawn
    differently and stay.
    """
    kind, _, rest = unicodedata.decomposition(ch).partition(" ")
    if not kind.startswith("<"):
        return ch
    to = "".join(chr(int(h, 16)) for h in rest.split())
    letters = len(to) > 1 and all(unicodedata.category(c)[0] == "L" for c in to)
    shape = kind in ("<wide>", "<narrow>", "<font>", "<noBreak>") or kind == "<compat>" and (letters or unicodedata.category(ch) == "Nl" or unicodedata.name(ch, "").startswith("KANGXI"))
    return "".join(map(plain_form, to)) if shape else ch


def _single(ch: str) -> str:
    """The decomposed canonical form of one character."""
    if invisible(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    return "".join(SAME_SHAPE.get(c, c) for p in plain_form(ch) for w in unicodedata.normalize("NFD", SAME_SHAPE.get(p, p)) for v in unicodedata.normalize("NFD", plain_form(w)) for c in unicodedata.normalize("NFD", SAME_SHAPE.get(v, v)))


@lru_cache(maxsize=1)
def compile_table() -> dict[str, str]:
    """Every single character whose form differs from it, with conflicts refused.

    A conflict is a target that would itself be rewritten further: then one
    pass would not reach a fixed point.
    """
    table = {}
    for first, end in BLOCKS:
        for cp in range(first, end):
            ch = chr(cp)
            if (to := _single(ch)) != ch:
                table[ch] = to
    for ch, to in table.items():
        if "".join(_single(c) for c in to) != to:
            raise ValueError(f"conflict: {ch!r} gives {to!r}, which is rewritten again")
    return table


class Transducer:
    """Longest match over clusters: a character, its marks, and invisible ones between."""

    def __init__(self) -> None:
        self.table = compile_table()
        moved = (c for c, to in self.table.items() if to and unicodedata.category(c)[0] != "M" and unicodedata.normalize("NFC", to) != c)
        changing = "".join(f"\\U{ord(c):08x}" for c in moved)
        # Sequences whose joiners and tags show: joined pictures, and flags spelled with tags.
        emoji = rf"\p{{Extended_Pictographic}}[\ufe0f\p{{EMod}}]*(?:\u200d\p{{Extended_Pictographic}}[\ufe0f\p{{EMod}}]*)+|\U0001f3f4[\U000e0020-\U000e007f]+"
        self.pattern = regex.compile(rf"{emoji}|[^\s\p{{M}}{IGNORABLE}](?:[{IGNORABLE}]*\p{{M}})+[{JOINERS}]?|[ｦ-ﾝ][ﾞﾟ]|[\u1100-\u11ff]+|[{changing}]|[{IGNORABLE}]+|\p{{M}}+")
        self.emoji = regex.compile(emoji)
        self.known: dict[str, str] = {}

    def cluster(self, piece: str) -> str:
        """The form of one cluster; joiners stay in emoji and after a virama."""
        if self.emoji.fullmatch(piece):
            return piece.replace("\ufe0f", "")
        out: list[str] = []
        last = ""
        for ch in piece:
            if ch in JOINERS and last and unicodedata.combining(last) == VIRAMA:
                out.append(ch)
            else:
                out.append(self.table.get(ch, ch))
            if not invisible(ch):
                last = ch
        return unicodedata.normalize("NFC", "".join(out))

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        known = self.known
        if len(known) > 200_000:
            known.clear()

        def put(match) -> str:
            run = match[0]
            if (to := known.get(run)) is None:
                to = self.pattern.sub(self._piece, run)
                if len(run) <= 24:
                    known[run] = to
            return to

        return RUN.sub(put, text)

    def _piece(self, match) -> str:
        return self.cluster(match[0])


_here: list[Transducer] = []


def transducer() -> Transducer:
    """This process's compiled transducer."""
    if not _here:
        _here.append(Transducer())
    return _here[0]


def canonical_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, text, canonical for every row of ``df``.

    A null text has a null form, an empty one an empty form. Texts equal in
    form look the same; case, digits, accents, words and line breaks are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = transducer()
        for batch in batches:
            texts = batch.column(1)
            forms = pa.array([None if t is None else form(t) for t in texts.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, forms], ["key", "text", "canonical"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, text string, canonical string")


def visible(text: Column) -> Column:
    """Whether a canonical text holds anything besides spaces and control characters."""
    return text.rlike(r"[^\s\p{Cc}\p{Cf}\p{Z}]")


def digests(forms: DataFrame) -> DataFrame:
    """(key, form, stored): digests of the canonical and the stored text of every row with a visible form; written once."""
    return materialize(forms.where(F.col("canonical").isNotNull() & visible(F.col("canonical"))).select("key", F.unhex(F.sha2("canonical", 256)).alias("form"), F.unhex(F.sha2("text", 256)).alias("stored")))


def looks(rows: DataFrame) -> DataFrame:
    """One row per form of ``digests``: form, class_id (its least key), members, spellings (1, or 2 for two and more)."""
    found = rows.groupBy("form").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("members"), F.min("stored").alias("lo"), F.max("stored").alias("hi"))
    return found.select("form", "class_id", "members", F.when(F.col("lo") == F.col("hi"), 1).otherwise(2).alias("spellings"))


def same_looking_groups(forms: DataFrame) -> DataFrame:
    """One row per key: class_id, members (rows that look the same, itself included), mixed (not all stored alike).

    A row without a visible form is a class of its own that is not mixed. A
    class costs its rows only, however large it is.
    """
    rows = digests(forms)
    own = rows.join(looks(rows), "form").select("key", "class_id", "members", (F.col("spellings") > 1).alias("mixed"))
    keys = forms.select("key").join(own, "key", "left")
    return keys.select("key", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("mixed", F.lit(False)).alias("mixed"))


def same_looking_pairs(forms: DataFrame) -> DataFrame:
    """Pairs key_a < key_b of different stored texts with the same visible form.

    Only digests travel; forms that a single stored text has are dropped
    before the join, and equal stored texts make no pair. The output itself
    holds every pair of a class; same_looking_groups has one row per key.
    """
    rows = digests(forms)
    some = rows.join(looks(rows).where("spellings > 1").select("form"), "form", "left_semi")
    a, b = some.alias("a"), some.alias("b")
    return a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.key") < F.col("b.key")) & (F.col("a.stored") != F.col("b.stored"))).select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))
