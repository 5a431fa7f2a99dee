import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from clausewright.llm import split

T0 = datetime.datetime(2025, 1, 1)
LIMITS = {"default": split.Limits(50, 8, None), "small": split.Limits(20, 5, 24)}


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n,é。", max_size=300), st.integers(1, 30), st.integers(0, 12))
def test_pieces_cover_and_stay_within(text, limit, overlap):
    n = len(split.TOKEN.findall(text))
    pieces = split.cut(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == n
    for (a, b, shared), last in zip(pieces[1:], pieces, strict=False):
        assert a + shared == last[1] and b > last[1] and b - a <= limit
        assert shared == min(overlap, limit - 1, last[1])


def test_cuts_where_the_topic_changes():
    one = "The gasket of the chiller seals the gasket. The chiller gasket seals. "
    two = "Licence fees fall due. Fees of a licence fall due to the licence office. "
    text = one * 3 + two * 3
    first = split.cut(text, 70, 0)[0]
    spans = [m.span() for m in split.TOKEN.finditer(text)]
    assert text[spans[first[1] - 1][0] :].count("Licence") == 3 and first[1] == len(split.TOKEN.findall(one * 3))


def test_rows(spark):
    long = "One sentence of a few words here. " * 40
    rows = [
        ("d", 1, long, "pre fix", T0, None, "x"), ("d", 1, long, "pre fix", T0, None, "x"), ("d", 1, "older", None, T0 - datetime.timedelta(1), None, "x"),
        ("d", 2, None, "p", T0, "small", "x"), ("d", 3, "", None, None, "small", None), ("d", 4, "word " * 21, None, T0, "small", "x"), ("d", 5, "word " * 19, "a b c d e f", T0, "small", "x"),
        ("d", 6, "word " * 18, "p " * 30, T0, "small", "x"), ("d", 7, "word " * 50, None, T0, "unknown", "x"), ("e", 1, "单" * 60, None, T0, "small", "x"), (None, None, long, None, T0, None, "x"),
    ]
    df = spark.createDataFrame(rows, "document_id string, ordinal int, text string, context_prefix string, built_at timestamp_ntz, config_id string, piece string")
    got = {}
    for r in split.split_rows(df, ["document_id", "ordinal"], "context_prefix", "text", "built_at", "config_id", LIMITS, "default").collect():
        got.setdefault((r.document_id, r.ordinal), []).append(r)
    assert len(got) == 9
    for rs in got.values():
        rs.sort(key=lambda r: r.piece)
        assert [r.piece for r in rs] == list(range(rs[0].pieces))
    assert {k for k, rs in got.items() if rs[0].oversized} == {("d", 1), ("d", 4), ("d", 5), ("d", 6), (None, None)}
    d1 = got["d", 1]
    assert all(r.n_tokens <= 50 for r in d1) and all(r.text.rstrip().endswith(".") for r in d1)
    at, back = 0, ""
    for r in d1:
        back += long[at : r.end_char]
        at = r.end_char
    assert back == long and all(long[r.first_char : r.end_char] == r.text for r in d1)
    assert all(r.n_tokens <= 18 for r in got["d", 5]) and got["d", 2][0].text == ""


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, text string, p string, at timestamp_ntz, c string")
    assert split.split_rows(df, ["k"], "p", "text", "at", "c", LIMITS, "default").count() == 0
