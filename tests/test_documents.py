import datetime
import math
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import documents as D
from clausewright.operators import structure as S


def one(spark, column, text, kind="string"):
    return spark.createDataFrame([(text,)], f"t {kind}").select(column(F.col("t"))).first()[0]


def test_scalars(spark):
    assert one(spark, T.standards_in, "IS 0367:1993, is: 15 (2001) and IS 367:1993") == ["IS 367:1993", "IS 15:2001"]
    assert one(spark, T.guard_tokens, "What are the Requirements of glass kettles in class A") == ["glass", "kettle", "class"]
    assert one(spark, T.lexical_tokens, "IS 367:1993 Clause 1.3.1") == ["is", "367:1993", "clause", "1.3.1"]
    assert one(spark, T.slug, "  A--B c/9 ") == "a-b-c-9"
    assert [one(spark, T.text_quality, t) for t in (None, "  ", "short", "word " * 20)] == ["EMPTY", "EMPTY", "LOW", "GOOD"]
    assert one(spark, lambda c: T.first_hint(c), "Draft QCO amendment") == "qco_amendment"
    assert one(spark, T.canonical_url, "HTTPS://Ex.org:443/a//b?q=1#x") == "https://ex.org/a/b?q=1"
    assert one(spark, lambda c: T.trusted_url(c, ["a.example"]), "https://u@a.example/") is False
    assert one(spark, lambda c: T.trusted_url(c, ["a.example"]), "https://A.example:443/x") is True
    assert one(spark, lambda c: T.cosine(c, c), [0.0, 0.0], "array<double>") == 0.0
    assert one(spark, T.humanise, "product_manual") == "Product manual"
    assert one(spark, T.strip_tags, "<p>a &amp; b</p>") == "\na & b\n"


def test_versions(spark):
    stored = spark.createDataFrame([("u", "a"), ("v", "b")], "k string, text string").select("k", F.lit(3).alias("version"), T.content_hash(F.col("text")).alias("content_hash"))
    new = spark.createDataFrame([("u", "a"), ("v", "c"), ("w", "a")], "k string, text string")
    assert {(r.k, r.action, r.version) for r in D.next_versions(new, stored, "k", "text").collect()} == {("u", "unchanged", 3), ("v", "changed", 4), ("w", "new", 1)}


def test_licence_gate(spark):
    df = spark.createDataFrame([("a", "full_text_ok", "x"), ("b", "metadata_only", "x"), ("c", "metadata_only", " "), ("d", None, None)], "k string, l string, t string")
    assert {r.k: r.gate for r in D.licence_gate(df, "l", "t").collect()} == {"a": "ok", "b": "text_not_allowed", "c": "ok", "d": "unknown_licence"}


def test_clauses_and_fallback(spark):
    docs = spark.createDataFrame([(1, "3.1 Scope\r\ntext\n3.1.1 Kettles\n3.1 Again\n4.2 Late"), (2, "no clause"), (3, None)], "doc long, text string")
    rows = D.clause_rows(D.lines_of(docs, ["doc"], "text"), ["doc"])
    got = {(r.path, r.title, r.parent_path, r.depth) for r in rows.collect()}
    assert got == {("3.1", "Scope", "3", 2), ("3.1.1", "Kettles", "3.1", 3), ("4.2", "Late", "4", 2)}
    assert {r.path: r.parent_found for r in D.with_parent(rows, ["doc"]).collect()} == {"3.1": False, "3.1.1": True, "4.2": False}
    chunks = D.chunks_with_fallback(docs, rows, "doc", "text").collect()
    assert {(r.doc, r.chunk_index) for r in chunks} == {(1, 0), (1, 1), (1, 2), (2, 0)}


def tree(spark, pages):
    df = spark.createDataFrame(pages, "doc string, page int, text string")
    events = S.line_events(D.lines_of(df, ["doc", "page"], "text"), ["doc", "page", "line_no"], "line")
    return events, S.document_tree(events.where("reason is null"), df, "doc", "page", "line_no")


def test_structure(spark):
    text = "Foreword\n\n4 REQUIREMENTS\nIntro\n4.1 General\nBody\n4.1.1 Safety\nRequirement\n4 230 V\n5.3.2 Far\nANNEX A Tests\nA.1 Scope\nTABLE 1 Sizes\n9 Rows\n12/03/2024"
    _, found = tree(spark, [("d", 1, text), ("d", 2, "A.1.1 More\nIS 5 reference\nB.1 Other annex\n5 NEXT\nNormative references"), ("e", 1, None), ("e", 2, "4.1 Lone")])
    rows = found.collect()
    nodes = {r.number: r for r in rows if r.doc == "d"}
    assert [nodes[n].type for n in ("4", "4.1", "4.1.1")] == ["section", "clause", "subclause"]
    assert nodes["4.1.1"].parent_ordinal == nodes["4.1"].ordinal and nodes["4.1"].parent_ordinal == nodes["4"].ordinal
    assert nodes["5.3.2"].missing_parent and nodes["A"].type == "annex" and nodes["A.1"].end_page == 2
    assert nodes["A.1.1"].parent_ordinal == nodes["A.1"].ordinal and nodes["A.1"].parent_ordinal == nodes["A"].ordinal and nodes["1"].parent_ordinal == nodes["A.1"].ordinal
    assert "230" not in nodes and nodes["1"].type == "table" and "B.1" not in nodes and "9" not in nodes and nodes[None].type == "references"
    assert [r.parent_ordinal for r in rows if r.doc == "e"] == [None]
    assert tree(spark, [])[1].count() == 0


def test_lines_that_are_no_headings(spark):
    lines = ["4 230 V", "3 mm gap", "12 March 2024 was a day", "100 General", "2 IS 5 applies", "4.2 a | b", "7 " + "x" * 250, "3 the sealed part carries more words than a heading has.", "3. Scope", "2 Short title", "4.1 lower", "55555555555555555555 Far"]
    events, _ = tree(spark, [("d", k, t) for k, t in enumerate(lines)])
    got = {r.page: r.reason for r in events.collect()}
    assert got == {0: "quantity", 1: "quantity", 2: "date", 3: "top_number", 4: "citation", 5: "table_row", 6: "too_long", 7: "sentence", 8: None, 9: None, 10: None, 11: "top_number"}


def test_depth_of_long_chains_orphans_and_cycles(spark):
    chain = [("d", k, k - 1 if k else None) for k in range(1000)]
    odd = [("d", 2000, 3000), ("c", 1, 2), ("c", 2, 1), ("c", 3, None), ("c", 4, 3), ("c", 4, 3)]
    got = {(r.doc, r.k): r.depth for r in S.tree_depth(spark.createDataFrame(chain + odd, "doc string, k int, up int"), "doc", "k", "up").collect()}
    assert got == {("d", k): k + 1 for k in range(1000)} | {("c", 3): 1, ("c", 4): 2}


def test_pages_cleaning_and_margins(spark):
    dirty = "Title\r\n  Page 1 of 3 \nthe mois-\nture is\nhigh,\n\n\n\nnext"
    assert one(spark, D.clean_page_text, dirty) == "Title\n\nthe moisture is high,\n\nnext"
    rows = [("d", p, k + 1, line) for p in range(1, 5) for k, line in enumerate(["Head  Line", f"body {p}", "more", "other", "last", f"{p}"])]
    got = D.margin_repeats(spark.createDataFrame(rows, "doc string, page int, line_no int, line string"), "doc", "page").collect()
    assert {(r.key, r.pages) for r in got} == {("head line", 4), ("more", 4), ("other", 4), ("last", 4)}


def test_intervals_duplicates_upsert(spark):
    spans = spark.createDataFrame([("a", 1, 3), ("a", 2, 2), ("a", 4, 5), ("a", 8, 9), ("b", None, 2)], "k string, s int, e int")
    assert {(r.k, r.start, r.end) for r in D.islands(spans, "k", "s", "e").collect()} == {("a", 1, 5), ("a", 8, 9)}
    docs = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None)], "k int, t string")
    assert {tuple(r) for r in D.duplicates_of(docs, "k", "t", ["k"]).collect()} == {(3, 1)}
    t = datetime.datetime(2025, 1, 1)
    rows = spark.createDataFrame([("d", "low", t, "u1", 1), ("d", "high", t, "u2", 2), ("d", "late", t + datetime.timedelta(1), "u1", 1)], "k string, title string, at timestamp_ntz, url string, r int")
    got = D.upsert_candidates(rows, "k", F.col("r"), "at", "url").first()
    assert (got.title, got.sources) == ("high", "u1|u2")


def test_context_only_and_header_lines(spark):
    rows = [("d", 1, True, [1, 2]), ("d", 2, False, [2, 3]), ("d", 3, True, [3]), ("e", 4, True, [1])]
    got = D.context_only_drop(spark.createDataFrame(rows, "doc string, c int, ctx boolean, pages array<int>"), "doc", "ctx", "pages").collect()
    assert {r.c: r["drop"] for r in got} == {1: False, 2: False, 3: True, 4: False}
    lines = spark.createDataFrame(pd.DataFrame({"k": [1] * 4, "line_no": [1, 2, 3, 4], "line": ["a " * 9, " ", "b", "c"]}))
    assert [r.line_no for r in D.header_lines(lines, ["k"], 10).collect()] == [1, 3]


def by_reference(text, budgets):
    """The reference's split_text, spelled out with its counts of substrings."""
    count = lambda t: len(D.TOKEN.findall(t))
    if not text.strip():
        return []
    if count(text) <= budgets.soft:
        return [(0, len(text), 0)]
    ends = sorted({len(text)} | {m.end() for p in (r"\n\s*\n", r"\n", r"[.!?](?:[\"')\]]*)\s+") for m in re.finditer(p, text)})
    out, start, done = [], 0, 0
    while start < len(text):
        rest = text[start:]
        if count(rest) <= budgets.soft:
            end = len(text)
        else:
            fits = [b for b in ends if b > start and count(text[start:b]) <= budgets.target] or [b for b in ends if b > start and count(text[start:b]) <= budgets.hard]
            end = fits[-1] if fits else start + [m.end() for m in D.TOKEN.finditer(rest)][budgets.hard - 1]
        out.append((start, end, count(text[start:done]) if done > start else 0))
        if end >= len(text):
            break
        shared = min(budgets.overlap, count(text[start:end]) // 4)
        before = [m.start() for m in D.TOKEN.finditer(text[:end])]
        back = end if shared <= 0 else 0 if len(before) <= shared else before[-shared]
        done, start = end, back if back > start else end
    return out


def test_split_equals_reference():
    rng = random.Random(5)
    for _ in range(400):
        joints = rng.choice([[" "], [" ", " ", "\n"], [" ", ". ", "\n\n", "\n"], ["", " ", "-", ".) "], [" "] * 30 + ["! "]])
        text = "".join(rng.choice(["word", "4.2", "it's", "(x", "漢字", "é"]) + rng.choice(joints) for _ in range(rng.randrange(120)))
        hard = rng.randrange(2, 60)
        soft = rng.randrange(2, hard + 1)
        target = rng.randrange(1, soft + 1)
        b = D.Budgets(target, soft, hard, rng.randrange(target))
        assert D.split_pieces(text, b) == by_reference(text, b), (text, b)


def test_split_prefers_ends_then_hard_then_cut():
    b = D.Budgets(8, 10, 12, 3)
    text = "a b c. d e f\n\ng h i j k l. m n o p"
    assert [text[s:e] for s, e, _ in D.split_pieces(text, b)][0] == "a b c. d e f\n\n"
    assert D.split_pieces("x " * 11 + ". " + "y " * 9, b)[0][1] == 24  # no end within target, one within the hard budget
    cut = D.split_pieces("w " * 40, b)
    assert cut[0] == (0, 23, 0) and cut[1][2] == 3 and all(len(D.TOKEN.findall("w " * 40, s, e)) <= 12 for s, e, _ in cut)
    assert D.split_pieces(None, b) == D.split_pieces(" \n", b) == []


def test_split_counts_prefix_and_snaps():
    b = D.Budgets(8, 8, 8, 2, 10)
    text = "don't stop " * 6
    pieces = D.split_pieces(text, b, "4.1 Scope | x")  # six tokens leave four
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(n[0] <= p[1] for p, n in zip(pieces, pieces[1:], strict=False))
    assert all(len(D.TOKEN.findall(text[s:e])) <= 4 for s, e, _ in pieces)
    assert D.split_pieces("a b c d e", b, "p " * 10) == [(0, 9, 0)]  # a prefix without room is not counted
    assert D.split_pieces("alpha beta gamma 3.55 omega delta", D.Budgets(4, 4, 4, 0, 4))[0] == (0, 17, 0)


def test_split_rows_use_config(spark):
    rows = spark.createDataFrame([(1, "u v w x y z", None, "small"), (2, "u v w x y z", "p q", None), (3, None, None, "odd")], "k int, t string, p string, c string")
    sizes = {"small": D.Budgets(2, 2, 2, 0), "default": D.Budgets(6, 6, 6, 0, 5)}
    got = {(r.k, r.piece, r.text) for r in D.split_rows(rows, ["k"], "t", sizes, "default", "p", "c").collect()}
    assert got == {(1, 0, "u v"), (1, 1, " w x"), (1, 2, " y z"), (2, 0, "u v "), (2, 1, "w x "), (2, 2, "y z")}  # the safe break is the white space before a cut word


def test_running_lines_are_removed_from_pages(spark):
    page = "Uncontrolled  when\u00a0printed\r\n\r\nIS 9367:1993 Manual\n{0} Body of page {0}\nNOTE kept\nAlpha {0}\nBeta {0}\nGamma {0}\nDelta {0}\nUncontrolled when printed {0}\nOffice of the Registrar\n"
    rows = [("d", p, page.format(p)) for p in range(1, 5)] + [("d", 5, "Other page\nUNCONTROLLED WHEN PRINTED"), ("e", 1, page.format(1)), ("e", 2, page.format(1)), ("f", 1, "")]
    got = {(r.doc, r.page): r.text for r in D.without_margins(spark.createDataFrame(rows, "doc string, page int, text string"), "doc", "page", "text").collect()}
    assert len(got) == 8
    for p in range(1, 5):
        lines = [x for x in got["d", p].split("\n") if x]
        assert lines[0] == "IS 9367:1993 Manual" and lines[-1] == f"Uncontrolled when printed {p}"  # evidence stays, the running lines are gone
    assert got["d", 5] == "Other page"  # a header within the first four lines, in other letter case
    assert "Registrar" in got["e", 1] and got["f", 1] == ""  # two pages do not repeat
    body = "\n".join(f"line {k} end." for k in range(9)) + "\nRunning Head\n" + "\n".join(f"tail {k} end." for k in range(9))
    deep = spark.createDataFrame([("g", p, f"Running Head\n{body}") for p in range(3)], "doc string, page int, text string")
    for r in D.without_margins(deep, "doc", "page", "text").collect():
        assert r.text.count("Running Head") == 1 and not r.text.startswith("Running")  # outside the margin it stays


def test_clean_pages_has_no_running_lines(spark):
    from clausewright.plans import documents as P

    root = "/root/testdata/sf0.001"
    raw = P.pages(spark, root).collect()
    clean = {(r.document_id, r.page_number): r.text for r in P.clean_pages(spark, root).collect()}
    assert set(clean) == {(r.document_id, r.page_number) for r in raw}
    pages = {}
    for r in raw:
        lines = [" ".join(x.split()).lower() for x in re.split(r"\r\n?|\n", r.raw_text) if x.strip()]
        pages.setdefault(r.document_id, []).append((r.page_number, lines))
    found = 0
    for doc, some in pages.items():
        for key in {lines[0] for _, lines in some if lines}:
            at = [p for p, lines in some if lines[:1] == [key]]
            if len(at) >= max(3, math.ceil(0.8 * len(some))) and key[:1].isalpha() and not re.search(r"\d", key) and len(key) >= 4:
                found += 1
                assert not any(clean[doc, p].lower().startswith(key + "\n") for p in at), (doc, key)
    assert found
