import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dialectry.llm import spelling


def words_of(rows, least=7, every=31):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: (k := h % len(run))] + run[k + 1 :] if h % every == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(n, times=10):
    out, form = [], {}
    about = {w: sorted((-n[v], v) for v in n if near(w, v)) for w in n}
    for w, found in about.items():
        form[w] = found[0][1] if found and -found[0][0] >= times * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(about[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def corpus(seed=4, size=60):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdéÀo") for _ in range(rnd.randrange(6, 12))) for _ in range(25)]
    texts = []
    for _ in range(size):
        words = []
        for _ in range(80):
            w = base[min(int(rnd.expovariate(0.3)), 24)]
            if rnd.random() < 0.12:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abcé") + w[k:], w[:k] + "x" + w[k + 1 :]])
            words.append(w.upper() if rnd.random() < 0.1 else w)
        texts.append(rnd.choice([" ", "-", "1", ", ", "œ"]).join(words))
    return texts


def rows():
    return list(enumerate(corpus())) + [(60, None), (61, ""), (62, "z" * 3000 + " " + "z" * 3001), (63, "z" * 3000 + " " + "z" * 3001), (None, "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa"), (5, "e" * 70 + "ÿ×÷ " * 3), (5, "e" * 70 + "ÿ×÷ " * 3)]


@pytest.mark.parametrize("most", [1 << 16, 5])
def test_against_a_loop(spark, most):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.spelling_variants(docs, most=most).collect()
    want = grouped({w: k for w, k in words_of(rows()).items() if k >= 2})
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert any(r.form for r in got)


def test_counts_and_crc(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    assert {r.word: r.n for r in spelling.vocabulary(docs, least=2, every=3).collect()} == words_of(rows(), 2, 3)
    raw = np.frombuffer(b"abc" * 50, np.uint8)
    starts, ends = np.array([0, 0, 5, 10]), np.array([150, 64, 70, 12])
    before = np.array([zlib.crc32(x) for x in (b"", b"1:", b"22:", b"x")], dtype=np.uint32)
    assert spelling.crc_of_runs(raw, starts, ends, before).tolist() == [zlib.crc32(raw[a:b].tobytes(), int(c)) for a, b, c in zip(starts, ends, before)]


def test_every_pair_is_met_once(spark):
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9))) for _ in range(400)})
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    for most in (1 << 16, 3):
        got = [(r.word, r.near) for r in spelling.near_words(table, most).collect()]
        assert sorted(got) == sorted((a, b) for a in words for b in words if near(a, b))


def test_long_chains_and_empty_tables(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb"]
    text = [" ".join([w] * 2 * 10**k) for k, w in enumerate(chain)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    got = {r.word: r for r in spelling.spelling_variants(docs, every=1 << 33).collect()}
    assert all(got[w].root == chain[-1] for w in chain) and got[chain[0]].form == chain[1] and got[chain[-1]].form is None
    assert spelling.spelling_variants(docs.where("doc_id < 0")).count() == 0
    assert spelling.spelling_variants(docs.select("doc_id", docs.text.substr(1, 3).alias("text"))).count() == 0
