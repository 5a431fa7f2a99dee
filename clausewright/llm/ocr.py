"""Repair of text from scanned pages: furniture, broken words, misread characters.

An averaged perceptron decides three things. Of the lines at the head and foot
of a page it tells running lines and page numbers from the body by features of
the position on the page (side, rank, gap, width) and of how the line and its
number recur over the pages of a document and over documents. As an editor of
characters (keep, replace, delete, insert) it corrects misread words and
numbers; it learns from pairs of a rare and a frequent word of this very corpus
that differ in one short stretch. At the end of a line inside a divided word it
says whether the parts are joined or keep the hyphen. A proposed word counts
when the corpus has it far more often. No labels exist: the perceptron is
fitted on a bounded sample that labelling rules mark, and decides everywhere.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

MARGIN = 4
TRAINING_WORDS = 12_000
TRAINING_LINES = 6_000
TRAINING_NUMBERS = 1_000
LEAST_SUPPORT = 3
MARGIN_RATIO = 8
EPOCHS = 4
LINES = re.compile(r"\r\n|\r|\n")
HYPHENS = "-\u2010\u2011\u00ad\u00ac"
EDGES = ".,;:!?\"'“”‘’…"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
# Words and marks that may stand beside a page's number on a line of its own.
PAGE_LINE = re.compile(r"^[^\w.,;]*(?:(?:p\s*a\s*g\s*e|pg|p|seite|folio|sheet)\b[\W_]*(?:no\b[\W_]*)?)?(?P<n>[0-9olis]+|[ivxlc]+)(?:[\W_]*(?:of\b|/|\|)[\W_]*(?P<m>[0-9olis]+))?[^\w.,;]*(?:(?:p\s*a\s*g\s*e|pg|p)\b)?[^\w.,;]*$")
# Shapes that scanners confuse, brought to one letter so that a running line and its misread copies get the same key.
SINGLE = str.maketrans("e(a0y6bh5t1i9", "ccoovuuusfllg")
SHAPES = (("rn", "m"), ("rl", "n"), ("cl", "d"), ("vv", "w"), ("ll", "u"))


def latest_pages(df: DataFrame, doc: str, page: str, text: str, at: str) -> DataFrame:
    """(doc, page, text): the newest non-null text of each page; null and blank pages stay without lines."""
    ok = F.col(doc).isNotNull() & F.col(page).isNotNull()
    best = df.where(ok).groupBy(F.col(doc).alias("doc"), F.col(page).cast("int").alias("page")).agg(F.max(F.struct(F.col(text).isNotNull().alias("has"), F.col(at).alias("at"), F.col(text).alias("text"))).alias("row"))
    return best.select("doc", "page", F.coalesce(F.col("row.text"), F.lit("")).alias("text"))


def line_key(line: str) -> str:
    """A running line's key: lower case, numbers out, confusable shapes made one; empty without a word."""
    out = []
    for token in re.findall(r"[^\W_(]+(?:\([^\W_]+)*|\(", line.lower()):
        if sum(c.isdigit() for c in token) * 2 < len(token) and not set(token) <= set(ROMAN):
            token = token.translate(SINGLE)
            for a, b in SHAPES:
                token = token.replace(a, b)
            out.append(token)
    return " ".join(out)


def page_label(line: str) -> tuple[int, str] | None:
    """The number on a line that holds only a page number, and the line's pattern."""
    m = PAGE_LINE.match(line.lower().strip())
    if not m:
        return None
    n = m["n"]
    style = "#" if any(c.isdigit() for c in n) else "r"
    if style == "r" and set(n) <= set(ROMAN):
        values = [ROMAN[c] for c in n]
        number = sum(-v if k + 1 < len(values) and v < values[k + 1] else v for k, v in enumerate(values))
    else:
        style, digits = "#", n.translate(str.maketrans("olis", "0115"))
        if not digits.isdigit() or len(digits) > 9:
            return None
        number = int(digits)
    rest = line.lower().strip()
    pattern = rest[: m.start("n")].strip() + style + ("/" if m["m"] else rest[m.end("n") :].strip())
    return number, re.sub(r"\s+", "", pattern)


def margin_lines(pages: DataFrame) -> DataFrame:
    """The MARGIN outermost non-blank lines of each end of each page with their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, out = [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                lines = [(k, " ".join(x.split())) for k, x in enumerate(LINES.split(text)) if x.strip()]
                widest = max((len(x) for _, x in lines), default=1)
                for side, some in (("head", lines[:MARGIN]), ("foot", lines[::-1][:MARGIN])):
                    for rank, (k, line) in enumerate(some):
                        label = page_label(line)
                        take.append(r)
                        key = "" if broken(line.split()[-1]) else line_key(line)  # a line with the beginning of a word is body
                        inner = lines[rank + 1 : rank + 2] if side == "head" else lines[::-1][rank + 1 : rank + 2]
                        gap = not inner or abs(inner[0][0] - k) > 1
                        out.append((side, rank, k, line, key, label and label[0], label and label[1], gap, 4 * len(line) // widest))
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int32()]
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(rows), batch.column("page").take(rows), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc", "page", "side", "rank", "line", "item", "key", "number", "pattern", "gap", "width"])

    return pages.select("doc", "page", "text").mapInArrow(run, "doc string, page int, side string, rank int, line int, item string, key string, number int, pattern string, gap boolean, width int")


class Perceptron:
    """Averaged perceptron over named features with several answers."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}

    def scores(self, features: list[str], answers: Iterable[str]) -> dict[str, float]:
        found = dict.fromkeys(answers, 0.0)
        for f in features:
            for answer, w in self.weights.get(f, {}).items():
                if answer in found:
                    found[answer] += w
        return found

    def best(self, features: list[str], answers: Iterable[str]) -> str:
        return max(self.scores(features, answers).items(), key=lambda x: (x[1], x[0]))[0]

    def fit(self, examples: list[tuple[list[str], str, Iterable[str]]], group: list[int] | None = None, seed: int = 5) -> None:
        """Examples are features, the right answer, and the answers to choose from; those of one ``group`` stay together."""
        total: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        stamp: dict[tuple[str, str], int] = defaultdict(int)
        weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        self.weights = weights
        starts = np.flatnonzero(np.diff(group, prepend=-1)) if group else np.arange(len(examples))
        ends = np.append(starts[1:], len(examples))
        step, random = 0, np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for at in random.permutation(len(starts)):
                for features, gold, answers in examples[starts[at] : ends[at]]:
                    step += 1
                    if (guess := self.best(features, answers)) != gold:
                        for f in features:
                            for answer, by in ((gold, 1.0), (guess, -1.0)):
                                total[f][answer] += (step - stamp[f, answer]) * weights[f][answer]
                                stamp[f, answer] = step
                                weights[f][answer] += by
        for f, mine in weights.items():
            for answer, w in mine.items():
                total[f][answer] += (step - stamp[f, answer]) * w
        self.weights = {f: {answer: w / max(step, 1) for answer, w in mine.items()} for f, mine in total.items()}


LINE_KINDS = ("body", "header", "pageno")


def line_signals(margins: DataFrame) -> DataFrame:
    """Margin lines with the counts their features come from.

    pages: of the document; even: pages on which a line of this pattern has a
    number as far from the page's; styles: documents in which the pattern runs
    so; seen: pages with this line at this side; docs: other documents that
    repeat it.
    """
    total = margins.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    labels = margins.where("number is not null").withColumn("offset", F.col("number") - F.col("page"))
    even = labels.groupBy("doc", "pattern", "offset").agg(F.countDistinct("page").alias("even"))
    runs = margins.where("key <> ''").groupBy("doc", "side", "key").agg(F.countDistinct("page").alias("seen"), F.max(F.col("item").rlike("[.,;]$")).alias("stopped"))
    often = lambda c, share: (F.col(c) >= 2) & (F.col(c) * share >= F.col("pages"))
    styles = even.join(total, "doc").where(often("even", 5) & ~F.col("pattern").isin("#", "r")).groupBy("pattern").agg(F.countDistinct("doc").alias("styles"))
    words = F.size(F.split("key", " "))
    docs = runs.join(total, "doc").where(often("seen", 5) & (words > 1) & (~F.col("stopped") | often("seen", 2))).groupBy("side", "key").agg(F.countDistinct("doc").alias("docs"))
    joined = (
        margins.withColumn("offset", F.col("number") - F.col("page"))
        .join(total, "doc")
        .join(even, ["doc", "pattern", "offset"], "left")
        .join(styles, "pattern", "left")
        .join(runs, ["doc", "side", "key"], "left")
        .join(docs, ["side", "key"], "left")
        .withColumn("words", F.when(F.col("key") == "", 0).otherwise(words))
        .withColumn("ends", F.col("item").rlike("[.,;]$"))
    )
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("even", "styles", "seen", "docs")}
    return joined.withColumns(counts | {"stopped": F.coalesce("stopped", F.lit(False))}).select("doc", "page", "side", "rank", "line", "item", "gap", "width", "number", "pages", "words", "ends", "stopped", *counts)


def likely_kind() -> Column:
    """The labelling rule for the sample of lines the perceptron is fitted on.

    A page number runs with the page's over two pages and a fifth of the
    document's at least, or has a decorated pattern known from three
    documents. A running line recurs on two pages and a fifth (a single word,
    or one that ends like a sentence, on half) of them, or in two documents.
    """
    often = lambda c, share: (F.col(c) >= 2) & (F.col(c) * share >= F.col("pages"))
    number = (F.col("even") > 0) & often("even", 5) | (F.col("styles") >= 3) & (F.col("number") > 0)
    single = F.col("stopped") | (F.col("words") <= 1)
    running = (F.col("words") > 0) & (often("seen", 2) | ~single & often("seen", 5) | (F.col("docs") >= 2) & ~F.col("ends"))
    return F.when(number, "pageno").when(running, "header").otherwise("body")


def line_features(r: dict) -> tuple:
    """What the perceptron sees of a line: position, and recurrence in steps."""
    steps = lambda n: 0 if n < 1 else 1 if n < 2 else 2 if n < 3 else 3
    share = lambda n: 0 if n < 2 else 1 if n * 5 < r["pages"] else 2 if n * 2 < r["pages"] else 3
    single = r["words"] <= 1
    number = r["number"] is not None
    return (
        f"side {r['side']} {r['rank']}", f"rank {r['rank']}", f"gap {r['gap']}", f"width {r['width']}", f"words {min(r['words'], 4)}",
        f"ends {r['ends']}", f"seen {share(r['seen'])} {single} {r['stopped']}", f"docs {min(r['docs'], 2)} {r['ends']} {r['words'] > 0}",
        f"even {share(r['even'])} {number}", f"styles {steps(r['styles'])} {number and r['number'] > 0}", f"number {number} {single}",
    )


def furniture(margins: DataFrame) -> DataFrame:
    """Margin lines that are running lines or page numbers: doc, page, line, item, kind.

    The perceptron is fitted on at most TRAINING_LINES lines, chosen by hash,
    and decides for all. Nothing further in than a line of the body counts.
    """
    lines = materialize(line_signals(margins))
    columns = [c for c in lines.columns if c not in ("doc", "page", "line", "item")]
    chosen = lines.select(*columns, likely_kind().alias("kind"), F.xxhash64("doc", "page", "line", "side").alias("h"))
    sample = [r.asDict() for r in chosen.orderBy("h").limit(TRAINING_LINES).collect()]  # a bounded sample
    model = Perceptron()
    model.fit([(list(line_features(r)), r["kind"], LINE_KINDS) for r in sample])
    shared = lines.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, str] = {}
        for batch in batches:
            kinds = []
            for r in batch.select(columns).to_pylist():
                f = line_features(r)
                if (kind := known.get(f)) is None:
                    kind = known[f] = shared.value.best(list(f), LINE_KINDS)
                kinds.append(kind if kind != "body" else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "page", "side", "rank", "line", "item")), pa.array(kinds, pa.string())], ["doc", "page", "side", "rank", "line", "item", "kind"])

    marked = lines.mapInArrow(run, "doc string, page int, side string, rank int, line int, item string, kind string")
    outward = Window.partitionBy("doc", "page", "side").orderBy("rank")
    reached = marked.withColumn("ok", F.min(F.col("kind").isNotNull()).over(outward)).where("ok")
    return reached.groupBy("doc", "page", "line").agg(F.min("item").alias("item"), F.min("kind").alias("kind"))


def core(token: str) -> str:
    """A word without the punctuation around it, in lower case."""
    w = token.strip(EDGES)
    if w.startswith("(") and w.endswith(")"):
        w = w[1:-1]
    elif w.endswith(")") and "(" not in w:
        w = w[:-1].strip(EDGES)
    return w.strip(EDGES).lower()


def body_words(pages: DataFrame) -> DataFrame:
    """Per page (doc, page, text, lines): words, breaks (left, right and both joined forms), tail, head and head_form at the page's ends.

    ``lines`` are the numbers of furniture lines. ``tail`` is the beginning of
    a word that the page's last body line ends with; ``head``, the first
    token, is not among the words, since it may end a word of the page before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([(c, pa.string()) for c in ("left", "right", "plain", "hyphened")]))
        for batch in batches:
            words, breaks, tails, heads, forms = [], [], [], [], []
            for text, skip in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                gone = set(skip or ())
                body = [x.split() for k, x in enumerate(LINES.split(text)) if k not in gone and x.strip()]
                mine: Counter[str] = Counter()
                split_: list[tuple[str, str]] = []
                tail = head = None
                for k, line in enumerate(body):
                    if not k:
                        head = line[0]
                    first = 1 if not k or broken(body[k - 1][-1]) else 0
                    last = len(line)
                    if broken(line[-1]) and last > first:
                        last -= 1
                        if k + 1 < len(body):
                            split_.append((line[-1], body[k + 1][0]))
                        else:
                            tail = line[-1]
                    mine.update(c for c in map(core, line[first:last]) if c)
                words.append(list(mine.items()))
                breaks.append([dict(zip(("left", "right", "plain", "hyphened"), (a, b, *join_forms(a, b)), strict=True)) for a, b in split_])
                tails.append(tail)
                heads.append(head)
                forms.append(core(head) if head else None)
            counted = pa.array([[{"word": w, "n": n} for w, n in m] for m in words], pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("page"), counted, pa.array(breaks, pair), pa.array(tails, pa.string()), pa.array(heads, pa.string()), pa.array(forms, pa.string())], ["doc", "page", "words", "breaks", "tail", "head", "head_form"])

    return pages.select("doc", "page", "text", "lines").mapInArrow(run, "doc string, page int, words array<struct<word:string,n:int>>, breaks array<struct<left:string,right:string,plain:string,hyphened:string>>, tail string, head string, head_form string")


def broken(token: str) -> bool:
    """Whether a line's last token is the beginning of a divided word."""
    return len(token) > 1 and token[-1] in HYPHENS and token[-2].isalpha()


def join_forms(left: str, right: str) -> tuple[str, str]:
    """A divided word joined without and with its hyphen."""
    a, b = left.rstrip(HYPHENS), right
    return core(a + b), core(a + "-" + b)


def divided_word(plain: Column, hyphened: Column) -> Column:
    """A break's parts (columns left and right) in lower case with a line end between them, and which spelling the corpus has more often (p, h or =)."""
    parts = F.concat(F.lower(F.expr(f"rtrim('{HYPHENS}', left)")), F.lit("\n"), F.regexp_extract(F.lower("right"), r"^\W*([\w-]*)", 1))
    return F.concat(parts, F.when(plain > hyphened, "\tp").when(plain < hyphened, "\th").otherwise("\t="))


class Editor(Perceptron):
    """The perceptron over the characters of a word.

    Operations: keep, delete, or replace the character by one or two others
    (two: a replacement and an insertion); for a line end inside a divided
    word, join or keep (its hyphen). Only operations seen in training for a
    character are weighed.
    """

    def __init__(self) -> None:
        super().__init__()
        self.allowed: dict[str, list[str]] = {}

    @staticmethod
    def features(word: str, k: int) -> list[str]:
        w = f"^^{word}$$"
        c = k + 2
        if word[k] == "\n":  # the end of a line inside a divided word
            left, (right, evidence) = word[:k], word[k + 1 :].split("\t")
            return ["0", f"1{left}", f"2{right}", f"3{left[-2:]}", f"4{right[:2]}", f"5{len(left)}", f"6{len(right)}", f"7{left[-1:]}{right[:1]}", *[f"8{evidence}"] * 3]
        return [f"0{w[c]}", f"1{w[c - 1 : c + 1]}", f"2{w[c : c + 2]}", f"3{w[c - 1 : c + 2]}", f"4{w[c - 2 : c + 1]}", f"5{w[c : c + 3]}", f"6{w[c]}{len(word) // 4}", f"7{any(x.isdigit() for x in word)}", f"9{w[c]}{w[c - 1].isdigit()}{w[c + 1].isdigit()}"]

    def at(self, word: str, k: int) -> dict[str, float]:
        """Scores of the operations on one character."""
        return self.scores(self.features(word, k), self.allowed.get(word[k], ("keep",)))

    def learn(self, pairs: list[tuple[str, list[str]]]) -> None:
        seen: dict[str, set[str]] = defaultdict(lambda: {"keep"})
        for word, ops in pairs:
            for ch, op in zip(word, ops, strict=True):
                seen[ch].add(op)
        self.allowed = {ch: sorted(ops) for ch, ops in seen.items()}
        examples, group = [], []
        for g, (word, ops) in enumerate(pairs):
            for k, gold in enumerate(ops):
                if len(self.allowed[word[k]]) > 1:  # nothing to choose elsewhere
                    examples.append((self.features(word, k), gold, self.allowed[word[k]]))
                    group.append(g)
        self.fit(examples, group)

    def number(self, word: str) -> str | None:
        """``word`` with the letters among its digits edited, if that makes a number of it."""
        out = []
        for k, ch in enumerate(word):
            op = self.best(self.features(word, k), [o for o in self.allowed.get(ch, ("keep",)) if o == "keep" or o[0].isdigit() and o[1:] == ">1"]) if ch.isalpha() else "keep"
            out.append(ch if op == "keep" else op[0])
        plain = "".join(out)
        return plain if plain != word and NUMBER.fullmatch(plain) else None

    def proposals(self, word: str, pairs: int = 12) -> list[tuple[str, float]]:
        """Words by any one edit, or by two of the ``pairs`` best, with the score they gain over keeping all."""
        singles = []
        for k in range(len(word)):
            found = self.at(word, k)
            keep = found.get("keep", 0.0)
            for op, s in found.items():
                if op == "delete" or op == "keep":
                    continue
                a, _, width = op.partition(">")
                if int(width) == 2:
                    if k + 1 == len(word) or "delete" not in self.allowed.get(word[k + 1], ()):
                        continue
                    nxt = self.at(word, k + 1)
                    s = s + nxt["delete"] - nxt.get("keep", 0.0)
                singles.append((s - keep, k, k + int(width), a))
        singles.sort(key=lambda x: -x[0])
        out: dict[str, float] = {}
        for s, a, b, to in singles:
            out.setdefault(word[:a] + to + word[b:], s)
        for x, (s, a, b, to) in enumerate(singles[:pairs]):
            for s2, a2, b2, to2 in singles[x + 1 : pairs]:
                if b <= a2:
                    out.setdefault(word[:a] + to + word[b:a2] + to2 + word[b2:], s + s2 - 1)
                elif b2 <= a:
                    out.setdefault(word[:a2] + to2 + word[b2:a] + to + word[b:], s + s2 - 1)
        out.pop(word, None)
        return list(out.items())


def weak_pairs(counts: dict[str, int]) -> list[tuple[str, str, int, int, str]]:
    """(noisy, true, start, end, replacement): a rare and a frequent word that differ in one stretch of up to two characters.

    Kept are only stretches that recur in LEAST_SUPPORT pairs of different
    words, and noisy words with one frequent counterpart.
    """
    masks: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)
    ordered = sorted(counts, key=lambda w: (-counts[w], w))
    for w in ordered[: TRAINING_WORDS // 2]:
        if len(w) > 3 and w.isalpha():
            for k in range(len(w)):
                for width in (1, 2):
                    if k + width <= len(w):
                        masks[w[:k], w[k + width :]].append((w, w[k : k + width]))
    found: dict[str, list[tuple[str, str, int, int, str]]] = {}
    for w in ordered:
        if len(w) < 4 or not any(c.isalpha() for c in w):
            continue
        mine = {}
        for k in range(len(w)):
            for width in (1, 2):
                if k + width > len(w):
                    continue
                piece = w[k : k + width]
                for true, to in masks.get((w[:k], w[k + width :]), ()):
                    minimal = piece[0] != to[0] and piece[-1] != to[-1]
                    if true != w and minimal and counts[true] >= MARGIN_RATIO * counts[w]:
                        mine.setdefault(true, (w, true, k, k + width, to))
        if len(mine) == 1:
            found[w] = list(mine.values())
    support = Counter((p[0][p[2] : p[3]], p[4]) for ps in found.values() for p in ps)
    return [p for ps in found.values() for p in ps if support[p[0][p[2] : p[3]], p[4]] >= LEAST_SUPPORT]


NUMBER = re.compile(r"[0-9]+(?:[.:/,-][0-9]+)*%?")


def train(counts: dict[str, int], divided: Iterable[tuple[str, str]] = (), numbers: Iterable[str] = ()) -> Editor:
    """An editor from the weak pairs of a bounded sample of words, as many clean words, numbers, and divided words (see divided_word; join or keep).

    A digit that is read for a letter is read as one, too: numbers are learned
    from copies with one digit replaced. Divided words are learned with and
    without the evidence of the corpus.
    """
    pairs = weak_pairs(counts)
    noisy = {p[0] for p in pairs}
    examples = []
    for w, _, a, b, to in pairs:
        ops = ["keep"] * len(w)
        ops[a] = f"{to}>{b - a}"
        if b - a == 2:
            ops[a + 1] = "delete"
        examples.append((w, ops))
    for w, op in divided:
        for seen in (w, w[:-1] + "="):
            ops = ["keep"] * len(seen)
            ops[seen.index("\n")] = op
            examples.append((seen, ops))
    letters = sorted({(w[a], to) for w, _, a, b, to in pairs if b - a == 1 and w[a].isdigit() and len(to) == 1 and to.isalpha()})
    for k, n in enumerate(sorted(set(numbers))):
        examples.append((n, ["keep"] * len(n)))
        copies = [[pair] for pair in letters] + [letters[x:] + letters[:x] for x in (k % max(len(letters), 1),)]  # one letter, or one for each digit
        for some in copies if len(n) > 1 else ():
            chars, ops = list(n), ["keep"] * len(n)
            for x, (digit, letter) in enumerate(some):
                places = [i for i, c in enumerate(n) if c == digit and chars[i] == digit]
                if places and sum(c.isdigit() for c in chars) * 2 > len(n):
                    i = places[(k + x) % len(places)]
                    chars[i], ops[i] = letter, f"{digit}>1"
            if chars != list(n):
                examples.append(("".join(chars), ops))
    mostly_digits = lambda w: sum(c.isdigit() for c in w) * 2 >= len(w)
    clean = [w for w in sorted(counts, key=lambda w: (-counts[w], w)) if w not in noisy and len(w) > 2 and not mostly_digits(w)][: max(500, len(pairs))]
    editor = Editor()
    editor.learn(examples + [(w, ["keep"] * len(w)) for w in clean])
    return editor


def corrections(forms: DataFrame, editor: Editor) -> DataFrame:
    """(form, count) with the correction it gets, if any: form, count, fixed, fixed_count.

    A proposal counts when the corpus has it MARGIN_RATIO times as often as
    the form (three times a form seen once). A form at least half of digits
    that the editor turns into a number becomes that number.
    """
    model = forms.sparkSession.sparkContext.broadcast(editor)  # weights of at most TRAINING_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edit = model.value
        for batch in batches:
            take, to, score, sure = [], [], [], []
            for r, w in enumerate(batch.column("form").to_pylist()):
                mixed = any(c.isalpha() for c in w)
                number = edit.number(w) if mixed and sum(c.isdigit() for c in w) * 2 >= len(w) else None
                found = [(number, 0.0)] if number else edit.proposals(w) if mixed else []
                take += [r] * len(found)
                to += [f[0] for f in found]
                score += [f[1] for f in found]
                sure += [number is not None] * len(found)
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("form").take(rows), batch.column("count").take(rows), pa.array(to, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], ["form", "count", "to", "score", "number"])

    proposed = forms.select("form", "count").mapInArrow(run, "form string, count long, to string, score double, number boolean")
    known = forms.where("count > 0").select(F.col("form").alias("to"), F.col("count").alias("to_count"))
    likely = proposed.join(known, "to", "left").withColumn("to_count", F.coalesce("to_count", F.lit(0)))
    likely = likely.where(F.col("number") | (F.col("to_count") >= F.when(F.col("count") <= 1, 3).otherwise(F.col("count") * MARGIN_RATIO)))
    best = likely.groupBy("form").agg(F.max_by(F.struct("to", "to_count"), F.struct(F.col("score") + F.log(F.col("to_count") + 1.0), F.col("to"))).alias("b"))
    return forms.join(best, "form", "left").select("form", "count", F.col("b.to").alias("fixed"), F.col("b.to_count").alias("fixed_count"))


HEADING = re.compile(r"^(?:\d{1,2}(?:\.\d{1,2})*|[A-Z](?:\.\d+)+)\s+[A-Z][a-z]{2,}(?:\s[\w-]+){0,5}$")


def like(token: str, form: str, item: str) -> str:
    """``token`` with its word ``form`` written as ``item``, in the token's letter case."""
    at = token.lower().find(form)
    if at < 0:
        return token
    old = token[at : at + len(form)]
    letters = [c for c in old if c.isalpha()]
    new = item.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else item[:1].upper() + item[1:] if old[:1].isupper() else item
    return token[:at] + new + token[at + len(form) :]


def page_paragraphs(text: str, gone: set[int], fixes: dict[str, str], joins: dict[tuple[str, str], str], carry: str | None, skip: bool) -> tuple[list[str], bool]:
    """A page's paragraphs, and whether the last one goes on over the page's end.

    ``carry`` is the token that ends the page's last divided word; ``skip``
    tells that the first token ended a word of the page before.
    """
    paragraphs: list[list[str]] = [[]]
    fixed = lambda t: like(t, core(t), fixes[core(t)]) if core(t) in fixes else t
    lines = [(k, x.split()) for k, x in enumerate(LINES.split(text)) if k not in gone]
    body = [k for k, tokens in lines if tokens]
    last = None
    for k, tokens in lines:
        if not tokens:
            if paragraphs[-1] and last is None:
                paragraphs.append([])
            continue
        heading = last is None and HEADING.match(" ".join(tokens)) and tokens[-1][-1] not in ".,;"
        if heading and paragraphs[-1]:
            paragraphs.append([])
        words = tokens[1:] if skip and k == body[0] else tokens
        if last is not None:
            after = core(words[0]) if words else ""
            tail = words[0][words[0].lower().find(after) + len(after) :] if after else ""
            item = joins.get((last, words[0]) if words else ("", ""))
            paragraphs[-1].append(like(last.rstrip(HYPHENS), core(last.rstrip(HYPHENS)), item) + tail if item else last + (words[0] if words else ""))
            words, last = words[1:], None
        if words and broken(words[-1]):
            last = words[-1]
            words = words[:-1]
        paragraphs[-1] += map(fixed, words)
        if heading:
            paragraphs.append([])
    if last is not None:
        item = joins.get((last, carry or ""))
        paragraphs[-1].append(like(last.rstrip(HYPHENS), core(last.rstrip(HYPHENS)), item) if item else last)
    done = [" ".join(p) for p in paragraphs if p]
    return done, bool(done) and not heading_only(done[-1]) and done[-1][-1] not in ".!?:"


def heading_only(paragraph: str) -> bool:
    """Whether a paragraph is a numbered heading."""
    return bool(HEADING.match(paragraph)) and paragraph[-1] not in ".,;"


class Repair:
    """The stages of the repair over one table of pages; each is written once."""

    def __init__(self, df: DataFrame, doc: str, page: str, text: str, at: str) -> None:
        self.pages = materialize(latest_pages(df, doc, page, text, at))
        self.furniture = materialize(furniture(materialize(margin_lines(self.pages))))
        lines = self.furniture.groupBy("doc", "page").agg(F.collect_list("line").alias("lines"))
        self.bodies = materialize(body_words(self.pages.join(lines, ["doc", "page"], "left")))
        ends = self.bodies.select("doc", (F.col("page") - 1).alias("page"), F.col("head").alias("right"))
        over = self.bodies.where("tail is not null").select("doc", "page", F.col("tail").alias("left")).join(ends, ["doc", "page"]).where("right is not null")
        inside = self.bodies.select("doc", "page", F.explode("breaks").alias("b")).select("doc", "page", "b.*")
        forms = F.udf(join_forms, "struct<plain:string,hyphened:string>", useArrow=True)
        over = over.withColumn("f", forms("left", "right")).select("doc", "page", "left", "right", "f.plain", "f.hyphened")
        self.breaks = materialize(inside.unionByName(over))
        carried = self.bodies.where("tail is not null").select("doc", (F.col("page") + 1).alias("page"))
        heads = self.bodies.where("head_form <> ''").select("doc", "page", F.col("head_form").alias("form"), F.lit(1).alias("n")).join(carried, ["doc", "page"], "left_anti")
        inner = self.bodies.select("doc", "page", F.explode("words").alias("w")).select("doc", "page", F.col("w.word").alias("form"), F.col("w.n").alias("n"))
        self.words = inner.unionByName(heads)  # many rows, cheap to unfold again from the written pages
        counts = self.words.groupBy("form").agg(F.sum("n").alias("count"))
        both = self.breaks.select(F.explode(F.array("plain", "hyphened")).alias("form"), F.lit(0).cast("long").alias("count"))
        every = materialize(counts.unionByName(both).groupBy("form").agg(F.sum("count").alias("count")))
        sample = {r["form"]: r["count"] for r in self._sample(every).collect()}  # at most TRAINING_WORDS rows
        numbers = every.where((F.col("count") > 0) & F.col("form").rlike(f"^(?:{NUMBER.pattern})$")).orderBy(F.xxhash64("form"), "form").limit(TRAINING_NUMBERS)
        labelled = [(r["divided"], r["op"]) for r in self._labelled(every).collect()]  # half as many at most
        self.editor = train(sample, labelled, [r["form"] for r in numbers.collect()])
        self.forms = materialize(corrections(every, self.editor))

    def _labelled(self, forms: DataFrame) -> DataFrame:
        """A hash sample of divided words of which the corpus knows one spelling only."""
        count = lambda c: forms.select(F.col("form").alias(c), F.col("count").alias(f"{c}_count"))
        known = self.breaks.select("left", "right", "plain", "hyphened").distinct().join(count("plain"), "plain").join(count("hyphened"), "hyphened")
        known = known.withColumn("divided", divided_word(F.col("plain_count"), F.col("hyphened_count")))
        one = known.where((F.least("plain_count", "hyphened_count") == 0) & (F.greatest("plain_count", "hyphened_count") > 0))
        op = F.when(F.col("hyphened_count") > 0, "keep").otherwise("join")
        return one.select("divided", op.alias("op")).distinct().orderBy(F.xxhash64("divided"), "divided").limit(TRAINING_WORDS // 2)

    @staticmethod
    def _sample(forms: DataFrame) -> DataFrame:
        """The most frequent words and a hash sample of the rest, half of TRAINING_WORDS each."""
        letters = forms.where((F.col("count") > 0) & F.col("form").rlike("[a-z]") & (F.length("form") < 40))
        half = TRAINING_WORDS // 2
        common = letters.orderBy(F.desc("count"), "form").limit(half)
        rest = letters.where(~F.col("form").rlike(r"^[a-z]{1,3}\d+$")).orderBy(F.xxhash64("form"), "form").limit(half)
        return common.unionByName(rest).distinct()

    def joined(self) -> DataFrame:
        """Every break with the word it should read: doc, page, left, right, item.

        The perceptron decides about the hyphen, with what the corpus has of
        either spelling among its features.
        """
        model = self.pages.sparkSession.sparkContext.broadcast(self.editor)

        @F.pandas_udf("boolean")
        def keeps(words: pd.Series) -> pd.Series:
            found = (model.value.at(w, w.index("\n")) for w in words)
            return pd.Series([f.get("keep", 0.0) > f.get("join", 0.0) for f in found])

        side = lambda c, a: self.forms.select(F.col("form").alias(c), F.coalesce("fixed", "form").alias(f"{a}_word"), F.coalesce("fixed_count", "count").alias(f"{a}_count"))
        kinds = self.breaks.select("left", "right", "plain", "hyphened").distinct().join(side("plain", "p"), "plain", "left").join(side("hyphened", "h"), "hyphened", "left")
        decided = kinds.withColumn("hyphen", keeps(divided_word(F.coalesce("p_count", F.lit(0)), F.coalesce("h_count", F.lit(0)))))
        items = decided.select("left", "right", F.when(F.col("hyphen"), F.col("h_word")).otherwise(F.col("p_word")).alias("item"))
        return self.breaks.join(items, ["left", "right"]).select("doc", "page", "left", "right", "item")

    def misread(self) -> DataFrame:
        """Misread body words: doc, page, form, item."""
        wrong = self.forms.where("fixed is not null").select("form", F.col("fixed").alias("item"))
        return self.words.join(wrong, "form").select("doc", "page", "form", "item")

    def found(self) -> DataFrame:
        """All repairs, each once: doc, page, kind, item."""
        parts = [self.furniture.select("doc", "page", "kind", "item"), self.joined().select("doc", "page", F.lit("break").alias("kind"), "item"), self.misread().select("doc", "page", F.lit("misread").alias("kind"), "item")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()

    def texts(self) -> DataFrame:
        """Every page's repaired text: doc, page, text, continues (the last paragraph goes on)."""
        lines = self.furniture.groupBy("doc", "page").agg(F.collect_set("line").alias("lines"))
        fixes = self.misread().groupBy("doc", "page").agg(F.collect_set(F.struct("form", "item")).alias("fixes"))
        joins = self.joined().groupBy("doc", "page").agg(F.collect_set(F.struct("left", "right", "item")).alias("joins"))
        heads = self.bodies.select("doc", (F.col("page") - 1).alias("page"), F.col("head").alias("carry"))
        tails = self.bodies.where("tail is not null").select("doc", (F.col("page") + 1).alias("page"), F.lit(True).alias("skip"))
        rows = self.pages
        for side in (lines, fixes, joins, heads, tails):
            rows = rows.join(side, ["doc", "page"], "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, more = [], []
                for r in batch.to_pylist():
                    fix = {f["form"]: f["item"] for f in r["fixes"] or ()}
                    join = {(j["left"], j["right"]): j["item"] for j in r["joins"] or ()}
                    paragraphs, goes_on = page_paragraphs(r["text"], set(r["lines"] or ()), fix, join, r["carry"], bool(r["skip"]))
                    texts.append("\n\n".join(paragraphs))
                    more.append(goes_on)
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("page"), pa.array(texts, pa.string()), pa.array(more, pa.bool_())], ["doc", "page", "text", "continues"])

        return rows.select("doc", "page", "text", "lines", "fixes", "joins", "carry", "skip").mapInArrow(run, "doc string, page int, text string, continues boolean")
