import hashlib
import random

import numpy as np
import pytest

from dialectry.llm import fill_in_middle as fim

TEXTS = ["", None, "a", "é", "𝄞", "a<b", "<P>", "x<S>y", "<M", "<", "<<P", "P>S>M>", "<S<P>", "<P<S<M", "ab\ncd é<", "à" * 700, "<" * 600, "x" * 255 + "<M>" + "y" * 300, "𝄞" * 400 + "<P" + "é" * 500, "word\r\n" * 90, "\u0000́e"]


def transformed(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def rows():
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice("<PSM>aé€𝄞 \n") for _ in range(rnd.choice([3, 40, 254, 255, 256, 257, 258, 900]))) for _ in range(300)]
    return [(i, t, "c", 5) for i, t in enumerate(texts)] + [(None, "no id", "c", 5), (7, "again", "c", 5), (7, "again", "c", 5)]


def test_against_a_loop(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, form string, n int").repartition(3)
    done = fim.fill_in_middle(docs)
    got = done.select("*", fim.restored(done.output, done.form).alias("back")).collect()
    want = sorted(((i, *transformed(i, t), t or "") for i, t, *_ in rows()), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_digests_and_empty_table(spark):
    docs = spark.createDataFrame([(4, "l'aiga é clara")], "doc_id long, text string")
    r = fim.with_digests(fim.fill_in_middle(docs, moved_percent=100)).first()
    assert r.restored_sha256 == hashlib.sha256("l'aiga é clara".encode()).hexdigest() and r.output_sha256 != r.restored_sha256
    assert fim.with_digests(fim.fill_in_middle(docs.where("doc_id = 0"))).count() == 0


def test_lanes_start_in_the_state_of_one_scan():
    dfa, rnd = fim.Automaton(), random.Random(5)
    for _ in range(30):
        data = "".join(rnd.choice("<PSM>é€𝄞a") for _ in range(1500)).encode()
        state, at_lane = 0, []
        for i, b in enumerate(data):
            if i % fim.LANE == 0:
                at_lane.append(state)
            state = int(dfa.next[state, b])
        steps, first, _ = dfa.lanes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        # a finished sentinel's node and the root go on alike
        assert all((dfa.next[a] == dfa.next[b]).all() and (dfa.emits[a] == dfa.emits[b]).all() for a, b in zip(at_lane, first))


def test_other_sentinels(spark):
    docs = spark.createDataFrame([(i, "un [pre] dos" if i % 2 else f"text {i} [pr [suf") for i in range(40)], "doc_id long, text string")
    marks = ("[prefix]", "[suffix]", "[middle]")
    done = fim.fill_in_middle(docs, moved_percent=100, sentinels=marks)
    assert {r.form for r in done.collect()} == {"psm", "spm"}
    back = done.select("doc_id", fim.restored(done.output, done.form, marks).alias("back"))
    assert back.join(docs, "doc_id").where("back = text").count() == 40
    for bad in (("<P>", "<P>x", "<M>"), ("ab", "ba", "c"), ("", "a", "b"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.Automaton(bad)
