import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from clausewright.llm import canon

T = canon.Transducer()


def test_mapping():
    assert T("ＡＢ１２　ｘ") == "AB12 x"
    assert T("Ѕее аnd οr Α") == "See and or A"
    assert T("é") == "é" == T("е́") == T("e​́")
    assert T("a b c d") == "a b c d"
    assert T("gr­o​up﻿") == "group"
    assert T("non‑metallic") == "non-metallic"
    assert T("Ω K Å µF") == "Ω K Å μF"
    assert T("ﾄﾞ ド") == "ド ド"


def test_kept():
    for text in ("Ä ä", "Fall fall", "a\nb", "٣ १", "’", "½", "²", "①", "…", "ı", "ſ", "क्‍ष", "👩‍🔬", "\U0001f3f4\U000e0067\U000e0062\U000e007f"):
        assert T(text) == unicodedata.normalize("NFC", text)
    assert T("a‍b") == "ab"


def test_variants_known_to_unicode():
    for text, form in (("a\ufe0f", "a"), ("x\u3164y\u115f\uffa0", "xy"), ("t\U000e0041ag", "tag"), ("1\u20122\u2212", "1\u20132\u2013"), ("a\u2010b\u2011c\ufe63", "a-b-c-"), ("\u2015", "\u2014")):
        assert T(text) == form
    assert T("\U0001d400\U0001d7ce \U0001d6c0 \u211d") == "A0 Ω R"
    assert T("\u2160\u2173") == "Iiv" and T("\ufb01n\ufb03") == "finffi" and T("\u01c4 \u0133") == "DŽ ij" and T("\u2f00") == "一"
    assert T("νον ѵ Ꭰ ꓮ") == "vov v D A"
    assert T("❤\ufe0f") == "❤" and T("👩\u200d❤\ufe0f\u200d👨") == "👩\u200d❤\u200d👨"


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(min_codepoint=1, max_codepoint=0x2FFF, exclude_categories=("Cs",)), max_size=30))
def test_one_pass_reaches_a_fixed_point_for_plain_scripts(text):
    once = T(text)
    assert T(once) == once


def test_pairs(spark):
    rows = [(1, "Ѕee 1", "c"), (2, "See 1", "c"), (3, "See 1", "c"), (4, "see 1", "c"), (5, "​", "c"), (6, " ", "c"), (7, None, "c"), (8, "", "c"), (9, "See １", "c")]
    forms = canon.canonical_text(spark.createDataFrame(rows, "doc_id long, text string, canonical string"), "doc_id", "text")
    got = {tuple(r) for r in canon.same_looking_pairs(forms).collect()}
    assert got == {(1, 2), (1, 3), (1, 9), (2, 9), (3, 9)}
    assert {r.key: r.canonical for r in forms.collect()}[7] is None
    assert canon.same_looking_pairs(forms.where("key < 0")).count() == 0


def test_groups_agree_with_pairs(spark):
    rows = [(1, "Ѕee 1"), (2, "See 1"), (3, "See 1"), (4, "see 1"), (5, "\u200b"), (6, " "), (7, None), (8, ""), (9, "See １"), (10, "same"), (11, "same")]
    forms = canon.canonical_text(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    got = {r.key: (r.class_id, r.members, r.mixed) for r in canon.same_looking_groups(forms).collect()}
    assert got == {1: (1, 4, True), 2: (1, 4, True), 3: (1, 4, True), 9: (1, 4, True), 10: (10, 2, False), 11: (10, 2, False)} | {k: (k, 1, False) for k in (4, 5, 6, 7, 8)}
    assert canon.same_looking_groups(forms.where("key < 0")).count() == 0
