import math
import random
from collections import Counter

import numpy as np

from clausewright.llm import neardup

SCHEMA = "chunk_id string, text string, search_vector string, key string, n int"


def brute(rows):
    bags = {}
    for i, t, s, *_ in rows:
        words = [w for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (t if t is not None else s or "").lower()).split()]
        if i is not None and len(words) >= 20:
            bags.setdefault(i, Counter(words))
    ids = sorted(bags)
    out = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = (bags[a] & bags[b]).total()
            if 4 * common >= 3 * (bags[a].total() + bags[b].total() - common):
                out.add((a, b))
    return out


def make(n):
    random.seed(7)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        words = random.choices(vocabulary, k=random.randint(20, 120))
        rows.append((f"c{k:04d}", " ".join(words), None, "x", 1))
        for j in range(random.choice([0, 0, 1, 3])):
            edited = list(words)
            for _ in range(random.randint(0, len(words) // 6)):
                edited[random.randrange(len(edited))] = random.choice(vocabulary)
            random.shuffle(edited)
            text = " ".join(edited).upper()
            rows.append((f"c{k:04d}{j}", None, text.lower(), "x", 1) if j % 2 else (f"c{k:04d}{j}", text, "cut", None, None))
    long = random.choices(vocabulary, k=9000)
    rows += [("long1", " ".join(long), None, "x", 1), ("long2", " ".join(long[::-1] + ["one", "more"]), None, "x", 1)]
    rows += [("short1", "a few words", None, "x", 1), ("short2", "a few words", None, "x", 1), ("none", None, None, "x", 1), ("blank", "", "", "x", 1), (None, rows[0][1], None, "x", 1), rows[0], rows[0]]
    return rows


def links(df, plan=None):
    members = neardup.bags(df, "chunk_id", "text", "search_vector", 20)
    classes = neardup.classes_of(members)
    return neardup.membership(members, classes), neardup.class_links(classes, 0.75, plan)


def test_pairs_and_groups(spark):
    rows = make(250)
    df = spark.createDataFrame(rows, SCHEMA)
    own, found = links(df)
    want = brute(rows)
    assert {tuple(r) for r in neardup.expand_pairs(own, found).collect()} == want and len(want) > 50
    longer = neardup.Plan.of(10**6)
    assert longer.wide > 1
    assert {tuple(r) for r in neardup.expand_pairs(*links(df, longer)).collect()} == want
    got = {r.chunk_id: r.group_id for r in neardup.groups(df, "chunk_id", own, found).collect()}
    root = {i: i for i in got}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {i: find(i) for i in got}
    assert {"none", "blank", "short1"} <= set(got)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    own, found = links(df)
    assert neardup.expand_pairs(own, found).count() == 0
    assert neardup.groups(df, "chunk_id", own, found).count() == 0


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200), (200, 300)], "a long, b long")
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100, 300: 100}


def test_code_covers_every_block():
    blocks = np.random.default_rng(1).integers(0, 1 << 23, 5000).astype(np.int32)
    near = neardup.anchors_within(blocks)
    for flip in (0, *(1 << b for b in range(23))):
        other = neardup.anchors_within(blocks ^ flip)[:, 0]
        assert (near == other[:, None]).any(1).all()


def test_code_grows_with_the_number_of_classes():
    loads = [neardup.Plan.of(n) for n in (0, 1, 10**4, 10**5, 10**6, 10**9)]
    assert [p.wide for p in loads] == [0, 0, 1, 2, 4, 8]
    assert [p.blocks for p in loads] == sorted(p.blocks for p in loads)
    for n, p in zip((10**4, 10**5, 10**6, 10**9), loads[2:], strict=True):
        assert n / 4096 / neardup.SPREAD**p.wide <= neardup.LOAD


def test_tests_of_a_class_do_not_grow_with_the_collection(spark):
    """Pairs that meet at an anchor, counted for unrelated texts at three sizes; LOAD low, so that the code grows at once."""
    random.seed(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    per_class = []
    for n in (400, 1600, 6400):
        rows = [(k, " ".join(sorted(random.choices(vocabulary, k=60))), 60) for k in range(n)]
        classes = spark.createDataFrame(rows, "cid long, bag string, n int")
        plan = neardup.Plan(wide=round(math.log(n / 400, 8) * 3) // 3 + (n > 400), blocks=12)
        prints = neardup.fingerprints(classes, plan)
        home, away = neardup.sent(prints, plan, True), neardup.sent(prints, plan, False)
        per_class.append(home.join(away, "anchor").count() / n)
    assert per_class[2] < 2 * per_class[0]
