import math
import random
import re
from collections import Counter

import pytest

from dialectry.llm import license_scan as S

COMMON = {"the", "of", "this", "to", "and", "in", "is", "or", "for", "any", "be", "it", "as", "a", "by", "with", "not", "all"}


@pytest.fixture(scope="module")
def space():
    return S.Space(1000, {w: 900 if w in COMMON else 3 for w in S.VOCABULARY}, 0.6)


def vector(found, space):
    terms = Counter(found)
    terms.update(f"{a} {b}" for a, b in zip(found, found[1:]) if f"{a} {b}" in space.idf)
    return {t: (1 + math.log(c)) * space.idf.get(t, space.foreign) for t, c in terms.items()}


def cosine(a, b):
    dot = sum(x * b.get(t, 0.0) for t, x in a.items())
    return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if a and b else 0.0


def brute(text, space):
    """Largest cosine of any candidate with any template, and the labels that reach it."""
    templates = [(label, vector(re.findall("[a-z0-9]+", t.lower()), space)) for label, t in S.TEMPLATES]
    lines = [re.findall("[a-z0-9]+", x.lower()) for x in text.split("\n")]
    edge = [bool(x) and 2 * sum(w in space.idf for w in x) >= len(x) for x in lines]
    spans = {(0, len(lines))} | {(i, i + 1) for i in range(len(lines))}
    spans |= {(i, j) for i in range(len(lines)) for j in range(i + 2, min(len(lines), i + S.WINDOW) + 1) if edge[i] and edge[j - 1]}
    for i in range(len(lines)):
        for j in range(i + 1, len(lines) + 1):
            if all(lines[i:j]) and (i == 0 or not lines[i - 1]) and (j == len(lines) or not lines[j]):
                spans.add((i, j))
    scores = [(cosine(vector([w for x in lines[i:j] for w in x], space), v), label) for i, j in spans for label, v in templates]
    top = max(s for s, _ in scores)
    return top, {label for s, label in scores if s > top - 1e-5}


def test_header_against_brute_force_cosine(space):
    r = random.Random(5)
    hits = 0
    for _ in range(120):
        parts = []
        for _ in range(r.randint(1, 4)):
            if r.random() < 0.6:
                w = r.choice(S.TEMPLATES)[1].split()
                a = r.randrange(max(1, len(w) // 2))
                w = [x if r.random() < 0.95 else "zebra" for x in w[a : a + r.randint(3, 60)]]
            else:
                w = [r.choice(["int", "x", "return", "the", "license", "code", "version", "2", "of"]) for _ in range(r.randint(1, 12))]
            width = r.choice([4, 9, 99])
            mark = r.choice(["", "# ", " * ", "// "])
            parts.append("\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width)))
        text = r.choice(["\n", "\n\n"]).join(parts)
        score, label, a, b = space.header(text)
        top, labels = brute(text, space)
        if top >= 0.6:
            hits += 1
            assert math.isclose(score, top, rel_tol=1e-5) and label in labels
            assert math.isclose(space.best(S.words(text[a:b]))[0], score)
        else:
            assert label is None
    assert hits > 50


def test_anchor_terms_lose_nothing(space):
    for _, text in S.TEMPLATES:
        found = S.words(text)
        for k in range(1, len(found) + 1):
            for part in (found[:k], found[-k:]):
                if space.best(part)[1]:
                    assert re.search(space.pattern, " ".join(part), re.I)


def wrapped(text, width, mark):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) >= width:
            out.append(mark + line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*out, mark + line])


@pytest.mark.parametrize("width", [30, 40, 72])
def test_wrapped_notices_keep_their_edition(space, width):
    for label, text in S.TEMPLATES:
        score, found, a, b = space.header("package x;\n\n" + wrapped(text, width, " * ") + "\n\nint main() { return x; }")
        assert found == label and score > 0.999
    gpl = next(t for k, t in S.TEMPLATES if k == "GPL-2.0" and "modify" in t)
    for notice in (gpl, gpl.replace("(at your option) ", ""), "Copyright 2020 some one\n" + gpl):
        assert space.header(notice)[1] == "GPL-2.0" and space.header(notice.replace("version 2", "version 3"))[1] == "GPL-3.0"


def test_ties_repeats_and_long_texts(spark):
    mit = "Released under the MIT License.\n"
    rows = [(3, "d/LICENSE", mit), (2, "d/COPYING", mit), (2, "d/COPYING", mit), (5, "d/x.txt", "prose"), (6, "d/e/long.txt", "words and words\n" * 20_000), (6, "d/e/long.txt", "words and words\n" * 20_000), (7, "long/notice.txt", "prose line\n" * 20_000 + mit), (8, "long/y.txt", None)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = sorted(((r.doc_id, r.license, r.found, r.from_doc_id) for r in S.scan(files).collect()), key=str)
    assert got == sorted([(3, "MIT", "header", None), (2, "MIT", "header", None), (2, "MIT", "header", None), (5, "MIT", "inherited", 2), (6, "MIT", "inherited", 2), (6, "MIT", "inherited", 2), (7, "MIT", "header", None), (8, "MIT", "inherited", 7)], key=str)
