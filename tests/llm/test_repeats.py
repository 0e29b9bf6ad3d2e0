"""Repeated passages against brute force, whatever lines and marks they are spread over."""

import os
import random
import re

import duckdb
import pytest

from dialectry.llm.queries import ORACLE, QUERIES
from dialectry.llm.substring_dedup import deduplicated

SF = "/root/testdata/sf0.001"
CUT = {"paragraph": lambda gap: gap.count("\n") > 1, "line": lambda gap: "\n" in gap, "clause": lambda gap: any(c in gap for c in "\n.,;:!?")}


def brute_units(text, unit):
    """(start, end, words) of each unit; words are lower-cased."""
    found = [(m[0].lower(), *m.span()) for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")]
    out = []
    for k, (w, a, _) in enumerate(found):
        if k == 0 or CUT[unit](text[found[k - 1][2] : a]) or unit == "clause" and len(found[k - 1][0]) >= 10:
            out.append([a, None, []])
        out[-1][2].append(w)
    for x, y in zip(out, out[1:] + [[len(text or "")]]):
        x[1] = y[0]
    return out


def brute(rows, unit, least):
    """(text, spans, kept ids) of each row; rows are (id, text) in input order."""
    seen, gone, stay, kept, units = {}, {}, {}, {}, [brute_units(t, unit) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    for r in order:
        for i in range(len(units[r])):
            j, words = i, list(units[r][i][2])
            while len(words) < least and j + 1 < len(units[r]):
                j += 1
                words += units[r][j][2]
            if len(words) < least:
                break
            if tuple(words) in seen:
                first, at = seen[tuple(words)]
                gone.setdefault(r, set()).update(range(i, j + 1))
                stay.setdefault(first, set()).update(at)
                if rows[first][0] is not None:
                    kept.setdefault(r, set()).add(rows[first][0])
            else:
                seen[tuple(words)] = r, range(i, j + 1)
    out = []
    for r, (_, t) in enumerate(rows):
        spans = []
        for k in sorted(gone.get(r, set()) - stay.get(r, set())):
            a, b, _ = units[r][k]
            if spans and spans[-1][1] == a:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        clean = t if t is None else "".join(c for i, c in enumerate(t) if not any(a <= i < b for a, b in spans))
        out.append((clean, spans, sorted(kept.get(r, ()))))
    return out


def texts(r):
    words = lambda n: [r.choice(["é", "Ünder", "a", "bc", "zz", "longerwörd"]) + str(r.randrange(300)) for _ in range(n)]
    pool = [words(n) for n in (9, 12, 14, 25, 60)]
    out = ["w " * 60, "x. y. " * 30, None, "", " .,\n", "one", " ".join(pool[4]), " ".join(pool[4]).upper(), "a,b\n" * 40]
    for _ in range(90):
        w = words(r.choice([0, 3, 20, 60]))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            p = r.choice(pool)
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() if r.random() < 0.1 else x for x in p[r.choice([0, 0, r.randrange(len(p))]) :]]
        out.append("".join(x + r.choice([" ", " ", "  ", "\n", ", ", ". ", "\n\n", " - "]) for x in w))
    return out


@pytest.mark.parametrize(("unit", "least"), [("clause", 12), ("line", 1), ("paragraph", 10)])
def test_against_brute_force(spark, unit, least):
    r = random.Random(least)
    rows = [(r.choice([None, *range(40)]), t) for t in texts(r)]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, removed_spans string").coalesce(1)
    got = deduplicated(docs, unit, least)
    assert got.columns == ["doc_id", "text", "removed_spans", "removed_spans_", "kept_ids"]
    have = sorted(((x.doc_id, x.text, [tuple(s) for s in x["removed_spans_"]], x.kept_ids) for x in got.collect()), key=repr)
    want = [(d, *w) for (d, _), w in zip(rows, brute(rows, unit, least))]
    assert sum(bool(w[2]) for w in want) > (5 if unit == "paragraph" else 20)
    assert have == sorted(want, key=repr)
    few = sorted(((x.doc_id, x.text) for x in deduplicated(docs, unit, least, changed_only=True).collect()), key=repr)
    assert few == sorted([w[:2] for w in want if w[2]], key=repr)


def test_passage_inside_longer_lines_and_over_lines(spark):
    passage = " ".join(f"p{i}" + ("," if i % 9 == 8 else "") for i in range(54))
    alone = ["stock line, often seen", passage]
    rows = [(i, f"{' '.join(f'{c}{k}' for k in range(9))}, {passage} stock line, often seen") for i, c in enumerate("ab")]
    rows += [(7, passage.replace(", ", "\n")), (8, "\n".join([*alone, "end"])), (9, "stock line, often seen")]
    got = {r.doc_id: r for r in deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), changed_only=True).collect()}
    assert sorted(got) == [1, 7, 8] and all(g.kept_ids == [0] for g in got.values())
    assert got[1].text == "b0 b1 b2 b3 b4 b5 b6 b7 b8, stock line, often seen"
    assert got[7].text == "" and got[8].text == "stock line, often seen\nend"


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 12))) for _ in range(3000)]

    def prose(n):
        return " ".join(r.choice(vocabulary) + r.choice(["", "", "", "", "", "", ",", "."]) for _ in range(n))

    stock = [prose(9) for _ in range(20)]
    texts = ["\n".join(x for _ in range(6) for x in (prose(r.randint(5, 60)), r.choice(stock))) for _ in range(400)]
    places = r.sample(range(400), 160)
    later = set()
    for k in range(0, 160, 2):
        passage, pair = prose(r.randint(51, 75)), sorted(places[k : k + 2])
        for i in pair:
            words = texts[i].split(" ")
            at = r.randrange(len(words))
            texts[i] = " ".join([*words[:at], passage, *words[at:]])
        later.add(pair[1])
    got = {x.doc_id for x in deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), changed_only=True).collect()}
    assert len(got & later) >= 0.95 * len(later) and not got - later


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{i % 5000}{'.' if i % 11 == 0 else ''}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, "before. " + long)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in deduplicated(docs).collect()}
    # the period of 55,000 words repeats inside the first text too
    assert len(got[1]) < len(long) and got[2].startswith("before. ") and len(got[2]) < 200
    assert deduplicated(docs.where("doc_id < 0")).count() == 0
    assert deduplicated(docs.where("doc_id < 0"), changed_only=True).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    want = {d: (t, " ".join(f"{a}-{b}" for a, b in s), k[0]) for (d, _), (t, s, k) in zip(rows, brute(rows, "clause", 32)) if s}
    assert {r.doc_id: (r.text, r.removed_spans, r.kept_doc_id) for r in QUERIES["op3_substring_dedup"](spark, SF).collect()} == want
    rel = duckdb.sql(ORACLE["op3_substring_dedup"].replace("FROM documents", f"FROM '{SF}/documents.parquet'"))
    assert len(rel.fetchall()) == len(want)
