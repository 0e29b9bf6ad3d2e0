import random
import re
from collections import Counter, defaultdict

import pytest

from dialectry.llm import ngram_join as J
from dialectry.llm.components import components
from dialectry.llm.decontamination import contained_items, without_items

VOCABULARY = [f"w{i}" for i in range(2000)]


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, percent):
    sets, lists, common, root = {d: shingles(t, k) for d, t in rows}, defaultdict(list), Counter(), {d: d for d, _ in rows}
    for d, s in sets.items():
        for g in s:
            lists[g].append(d)
    for own in lists.values():
        common.update((own[j], own[i]) for i in range(len(own)) for j in range(i))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def texts(seed):
    r = random.Random(seed)
    rows = ["", None, "a", "A", "a b c", "A  b\tC", " \n"]
    for copies in (1, 2, 5, 40, 25):
        base = [r.choice(VOCABULARY) for _ in range(r.randint(20, 120))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5, 8])):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            rows.append(" ".join(w))
    passage = [r.choice(VOCABULARY) for _ in range(30)]
    rows += [" ".join(passage + [r.choice(VOCABULARY) for _ in range(r.randint(1, 25))]) for _ in range(60)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 1024), (5, 80, 16)])
def test_join_against_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(J, "LIST_BLOCK", block)
    rows = texts(k)
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked_components(docs, k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_join_edges(spark):
    same = "one two three four five six seven"
    rows = [(9, same), (None, same), (4, same), (4, "x y z q r s"), (7, "x y z q r s"), (1, None), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.linked_components(docs, 4, 85).collect()), key=str)
    assert got == sorted([(9, 4, 4), (None, 4, None), (4, 4, 4), (4, 3, 4), (7, 3, 4), (1, 0, 1), (1, 0, 1)], key=str)
    assert J.linked_components(docs.where("doc_id < 0"), 4, 85).count() == 0


def test_components_of_a_path(spark):
    order = list(range(60))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(100, 101), (100, 100)], "a long, b long")
    assert {r.node: r.label for r in components(edges).collect()} == dict.fromkeys(range(60), 0) | {100: 100, 101: 100}


def test_decontamination_against_brute_force(spark):
    r = random.Random(8)
    words = lambda n: [r.choice(VOCABULARY) for _ in range(n)]
    items = [(i, " ".join(words(r.choice([3, 6, 8, 15, 37, 64, 130])))) for i in range(30)] + [(98, None), (99, "")]
    docs = []
    for d in range(150):
        w = words(r.choice([2, 40, 400, 3000]))
        if d % 3 == 0:
            own = items[r.randrange(30)][1].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                own[r.randrange(len(own))] = "zz"
            at = r.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in own]
        docs.append((d, " ".join(w)))
    docs += [(200, None), (201, ""), (202, items[0][1])]

    def grams(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {}
    for d, t in docs:
        g = grams(t)
        for i, s in items:
            q = grams(s)
            if q and len(q & g) >= 0.8 * len(q):
                want[d, i] = (len(q & g), len(q))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.shared, x.item_shingles) for x in contained_items(df, bench).collect()}
    assert len(want) > 25 and got == want
    assert {(x.doc_id, x.item_id) for x in contained_items(df, bench, items_at_once=7).collect()} == set(want)
    leaky = {d for d, _ in want}
    assert {x.doc_id for x in without_items(df, bench).collect()} == {d for d, _ in docs} - leaky
    nameless = spark.createDataFrame([(None, items[5][1] + " more"), (None, "clean words only here")], "doc_id long, text string")
    assert [x.text for x in without_items(nameless, bench).collect()] == ["clean words only here"]
    assert contained_items(df, bench.where("item_id < 0")).count() == 0


def test_items_whose_parts_lie_far_apart(spark, monkeypatch):
    from dialectry.llm import decontamination as D

    monkeypatch.setattr(D, "BYTES", 2000)  # several blocks
    r = random.Random(11)
    items, docs = [], []
    for i in range(60):
        w = [f"q{i}x{k}" for k in range(r.choice([24, 40, 90]))]
        items.append((i, " ".join(w)))
        text = [r.choice(VOCABULARY) for _ in range(3000)]
        # pieces that overlap by four words keep all shingles, cut apart by at least 200 words
        for n, k in enumerate(range(0, len(w) - 4, 2)):
            text.insert((n * 211) % len(text), " ".join(w[k : k + 6]))
        docs.append((i, " ".join(text)))
    items += [items[0]] * 3
    got = contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(g.doc_id, g.item_id) for g in got} >= {(i, i) for i in range(60)} and sum(g.item_id == 0 for g in got) == 4
