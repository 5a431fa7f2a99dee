import datetime
import random

from clausewright.llm import ocr

T0 = datetime.datetime(2025, 1, 1)
SENTENCES = ["The gasket of the sealed chiller carries a brass plate", "Readings outside the limits are repeated by another assessor", "Each moulded valve shall withstand the pressure for ten minutes", "The examiner and the inspector sign the statement after testing", "Any drip-proof housing is tightened before the measurement begins", "Visible corrosion obliges the manufacturer to amend the batch"]
NOISE = [("e", "c"), ("t", "f"), ("n", "ri"), ("d", "cl"), ("h", "b")]


def build():
    rows, truth = [], set()
    k = 0
    for d in range(30):
        doc = f"doc{d:02d}"
        for page in range(1, 5):
            lines = [f"Council of Norms {1990 + d}", ""]
            for s in range(9):
                line = SENTENCES[(d + page + s) % 6] + "."
                if s == 8:
                    line = line[:-1] + f" in hall {chr(97 + d % 26) * 3}{'_kmwz'[page] * 3}."
                k += 1
                if k % 4 == 0:
                    words = line.split()
                    at = k % len(words)
                    a, b = NOISE[k // 4 % len(NOISE)]
                    if len(words[at].strip(".")) > 4 and a in words[at][1:] and "-" not in words[at]:
                        good = words[at].strip(".").lower()
                        words[at] = words[at][0] + words[at][1:].replace(a, b, 1)
                        if s != 8:
                            truth.add((doc, page, "misread", good))
                    line = " ".join(words)
                lines.append(line)
            lines[4] = "It is held to be a drip-"
            lines[5] = "proof kind of mois-"
            lines[6] = "ture trap."
            truth |= {(doc, page, "break", "drip-proof"), (doc, page, "break", "moisture")}
            lines[7] = "All moisture counts."
            if page < 4:
                lines.append("At the end of the page the manu-")
                truth.add((doc, page, "break", "manufacturer"))
            if page > 1:
                lines.insert(2, f"facturer signs {chr(97 + d % 26) * 4}{'_kmwz'[page] * 2}.")
                lines[5:8] = ["It is held to be a drip-", "proof kind of mois-", "ture trap."]
                lines[8] = "All moisture counts."
            lines += ["", f"   - {page} -"]
            truth |= {(doc, page, "header", f"Council of Norms {1990 + d}"), (doc, page, "pageno", f"- {page} -")}
            rows.append((doc, page, "\r\n".join(lines) if d % 2 else "\n".join(lines), T0, "x"))
    return rows, truth


SCHEMA = "document_id string, page_number int, raw_text string, extracted_at timestamp_ntz, text string"


def repair(spark, rows):
    return ocr.Repair(spark.createDataFrame(rows, SCHEMA), "document_id", "page_number", "raw_text", "extracted_at")


def test_repair(spark):
    rows, truth = build()
    rows += [rows[0], ("doc00", 9, None, T0, "x"), ("doc00", 10, "  \n ", T0, None), (None, 1, "x", T0, "x"), ("doc00", None, "x", T0, "x")]
    r = repair(spark, rows)
    got = {tuple(x) for x in r.found().collect()}
    for kind in ("break", "header", "pageno"):
        assert {g for g in got if g[2] == kind} == {t for t in truth if t[2] == kind}, kind
    texts = {(x.doc, x.page): x for x in r.texts().collect()}
    one = texts["doc02", 1]
    assert "drip-proof kind of moisture trap." in one.text and "Council" not in one.text and "- 1 -" not in one.text
    assert one.text.endswith("the manufacturer") and one.continues and texts["doc02", 2].text.startswith("signs ")
    assert texts["doc00", 9].text == "" and not texts["doc00", 9].continues


def scanned(documents=40, pages=5):
    """Pages of made-up words with planted cases of every kind."""
    pick = random.Random(9)
    syllables = [a + b for a in "bcdfghlmnprstv" for b in "aeiou"]
    vocabulary = sorted({"".join(pick.choice(syllables) for _ in range(pick.choice([3, 3, 4]))) + pick.choice(["", "n", "s", "t"]) for _ in range(400)})
    compounds = [f"{a}-{b}" for a, b in zip(vocabulary[::20], vocabulary[7::20], strict=False)]
    rows, truth = [], set()
    for d in range(documents):
        doc, head = f"d{d:02d}", " ".join(w.capitalize() for w in pick.sample(vocabulary, 3))
        number = pick.choice(["{}", "- {} -", "Page {}", "{} of 99", None])
        for page in range(1, pages + 1):
            lines = [head if page % 2 else f"{head} {page}", ""]
            truth.add((doc, page, "header", lines[0]))
            for _ in range(22):
                words = []
                for _ in range(9):
                    w = pick.choice(vocabulary + compounds * 2)
                    if pick.random() < 0.03:
                        n = str(pick.randint(100, 99999))
                        noisy = n.replace("0", "o", 1).replace("1", "l", 1)
                        if noisy != n and pick.random() < 0.4 and sum(c.isdigit() for c in noisy) * 2 >= len(noisy):
                            truth.add((doc, page, "misread", n))
                            n = noisy
                        words.append(n)
                    elif pick.random() < 0.02 and "-" not in w:
                        a, b = pick.choice([("e", "c"), ("t", "f"), ("n", "ri"), ("d", "cl"), ("h", "b"), ("o", "0"), ("l", "1")])
                        if a in w[1:-1]:
                            truth.add((doc, page, "misread", w))
                            w = w[0] + w[1:-1].replace(a, b, 1) + w[-1]
                        words.append(w)
                    else:
                        words.append(w)
                if len(lines) > 2 and lines[-1][-1:] == "-" and lines[-1][-2:-1].isalpha():
                    words.insert(0, rest)
                if pick.random() < 0.25 and len(lines) < 22:
                    w = pick.choice(vocabulary + compounds * 3)
                    at = w.index("-") if "-" in w else pick.randint(2, len(w) - 2)
                    words.append(w[:at] + "-")
                    rest = w[at:].lstrip("-")
                    truth.add((doc, page, "break", w))
                lines.append(" ".join(words))
            if number:
                lines += ["", number.format(page)]
                truth.add((doc, page, "pageno", number.format(page)))
            rows.append((doc, page, "\n".join(lines), T0, "x"))
    return rows, truth


def test_recall_and_precision_of_every_kind(spark):
    rows, truth = scanned()
    got = {tuple(x) for x in repair(spark, rows).found().collect()}
    for kind in ("break", "header", "pageno", "misread"):
        want, found = ({t for t in x if t[2] == kind} for x in (truth, got))
        recall, precision = len(want & found) / len(want), len(want & found) / len(found)
        print(kind, len(want), round(recall, 3), round(precision, 3))
        assert recall >= 0.9 and precision >= 0.9, (kind, recall, precision, sorted(found - want)[:5], sorted(want - found)[:5])


def test_editor_makes_numbers_whole():
    words = {f"{a}o{b}e": 300 for a in ("carb", "fl", "sm", "gl", "pr", "st") for b in ("nd", "rt", "st")}
    noisy = {w.replace("o", "0"): 1 for w in words}
    editor = ocr.train(words | noisy, [], [str(n) for n in range(100, 999, 7)])
    assert editor.number("5o7") == "507" and editor.number("507") is None and editor.number("o.x") is None


def test_empty(spark):
    r = repair(spark, [])
    assert r.found().count() == 0 and r.texts().count() == 0


def test_lines_and_labels():
    assert ocr.page_label("– iv –") == (4, "–r–") and ocr.page_label("3 | P a g e")[0] == 3 and ocr.page_label("Sheet 4 of 7") == (4, "sheet#/")
    assert ocr.page_label("4 Valve") is None and ocr.page_label("12.") is None and ocr.page_label("lx of something") is None
    assert ocr.line_key("Issued by the Iristitute 3") == ocr.line_key("lssued by the 1nstitute 14")
    assert ocr.core("(arries,") == "(arries" and ocr.core("(word).") == "word" and ocr.core("a)") == "a"


def test_editor_learns_and_corrects():
    clean = {w: 300 - k for k, w in enumerate("gasket chiller brass plate readings outside limits repeated another assessor moulded valve withstand pressure minutes statement testing tightened measurement corrosion manufacturer amend batch examiner inspector housing begins obliges visible sealed carries".split())}
    noisy = {"gaskef": 1, "plafe": 1, "oufside": 1, "valvc": 1, "prcssure": 1, "statcment": 1, "rcpeated": 1, "amencl": 1, "moulcled": 1, "sealecl": 1, "wifhstand": 1}
    editor = ocr.train(clean | noisy)
    for w, good in (("corrosiori", None), ("tesfing", "testing"), ("limifs", "limits"), ("visiblc", "visible"), ("tightenecl", "tightened")):
        if good:
            assert good in dict(editor.proposals(w)), w
