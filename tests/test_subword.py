import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialectry.functions.text import config_name
from dialectry.operators import subword as S


def test_alias_draws_follow_the_weights():
    rng, w = np.random.default_rng(1), np.array([1.0, 5.0, 0.5, 3.5])
    got = np.bincount(S.draws(S.alias_table(w), (200_000,), rng), minlength=4) / 200_000
    assert np.abs(got - w / w.sum()).max() < 0.01


@pytest.mark.parametrize("n", [1, 2, 3, 9, 40])
def test_best_labels_against_all_leaves(n):
    rng = np.random.default_rng(n)
    counts = rng.integers(1, 1000, n).tolist()
    children, paths, turns = S.code_tree(counts)
    assert len(children) == n - 1
    right = rng.random(max(1, n - 1))
    every = [float(np.prod([right[p] if t else 1 - right[p] for p, t in zip(paths[k], turns[k])])) for k in range(n)]
    assert abs(sum(every) - 1) < 1e-9
    want = sorted(range(n), key=lambda k: -every[k])
    for k in (1, 3, n):
        got = S.best_labels(children, right, k)
        assert [x for x, _ in got] == want[:k] and np.allclose([p for _, p in got], [every[x] for x in want[:k]])
    # a Huffman code is never longer for a more frequent label
    assert all(len(paths[a]) <= len(paths[b]) for a, b in product(range(n), range(n)) if counts[a] > counts[b])


ROOTS = ["gat", "can", "ostal", "camin", "flor", "pont"]


def sentences(n, seed=1):
    """Each root stands among words of its own, in one form or another; endings stand beside words of their own."""
    rnd, rows = random.Random(seed), []
    for _ in range(n):
        k = rnd.randrange(len(ROOTS))
        ending, marks = rnd.choice([("ada", ["uèi", "ara"]), ("olet", ["ièr", "delà"])])
        own = [f"{ROOTS[k]}c{i}" .replace(ROOTS[k], f"x{k}q") for i in range(4)]
        rows.append([*rnd.sample(own, 2), ROOTS[k] + ending, *rnd.sample(own, 2), rnd.choice(marks)])
    return rows


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_skip_gram_vectors(spark):
    df = spark.createDataFrame([(x,) for x in sentences(1500)] + [(None,), ([],)], "tokens array<string>")
    # two words are never met in training, only their n-grams
    unseen = ["gatadas", "florolets"]
    model = S.skip_gram(df, dim=16, n_epochs=6, rate=0.1, subwords=(3, 4), buckets=1 << 20, min_count=2, sample=1.0, block_tokens=3000)
    words = [r + e for r in ROOTS for e in ("ada", "olet")]
    v = {r.word: r.vector for r in model.of(spark.createDataFrame([(w,) for w in [*words, *unseen, "zzzzzz"]], "word string")).collect()}
    assert v["zzzzzz"] is None and len(v["gatada"]) == 16
    # of one root, the two forms are nearer than forms of different roots
    same = np.mean([cosine(v[r + "ada"], v[r + "olet"]) for r in ROOTS])
    other = np.mean([cosine(v[r + "ada"], v[q + "olet"]) for r in ROOTS for q in ROOTS if r != q])
    assert same > other + 0.2
    assert cosine(v["gatadas"], v["gatada"]) > max(cosine(v["gatadas"], v[q + "ada"]) for q in ROOTS[1:])
    # a : b as c : d
    right = 0
    for r, q in ((r, q) for r in ROOTS for q in ROOTS if r != q):
        want = np.array(v[r + "olet"]) - v[r + "ada"] + v[q + "ada"]
        right += max((w for w in words if w not in (r + "olet", r + "ada", q + "ada")), key=lambda w: cosine(want, v[w])) == q + "olet"
    assert right >= 24  # of 30


def test_classifier(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([f"m{k}", f"n{k}", "e", "lo", "la"]) for _ in range(8)], f"l{k}") for i, k in ((i, i % 5) for i in range(600))]
    df = spark.createDataFrame(rows + [(900, None, "l0"), (901, ["lo"], None)], "row_id long, tokens array<string>, label string")
    grid = [{"grams": g, "dim": 8} for g in (1, 2)]
    models = S.train_grid(df.where("row_id % 3 > 0"), str(tmp_path), grid, config_name, n_epochs=12, rate=0.5, buckets=500, block_tokens=900)
    assert len(models) == 2
    for clf in models.values():
        got = clf.predict(df, k=2).collect()
        assert len(got) == 2 * df.count()
        first = {r.row_id: r for r in got if r["rank"] == 1}
        assert np.mean([first[i].label == y for i, _, y in rows if i % 3 == 0]) > 0.9
        assert all(0 < r.score <= 1 and r.runtime >= 0 for r in got)
    again = S.train_grid(df.where("row_id < 0"), str(tmp_path), grid, config_name)  # nothing is trained: all are there
    assert [c.labels for c in again.values()] == [c.labels for c in models.values()]


def test_pretrained_vectors_are_where_training_begins(spark):
    docs = spark.createDataFrame([(["a", "b", "c"], "x"), (["d", "e", "c"], "y")] * 40, "tokens array<string>, label string")
    vectors = S.skip_gram(docs, dim=4, n_epochs=1, subwords=(3, 3), buckets=50, min_count=1, sample=1.0)
    clf = S.train_classifier(docs, dim=4, n_epochs=0, pretrained=vectors)
    before = {r.id: bytes(r.vec) for r in vectors.vectors.collect()}
    assert {r.id: bytes(r.vec) for r in clf.vectors.collect()} == before
    clf = S.train_classifier(docs.where(F.array_contains("tokens", "a")).unionByName(docs.where(F.array_contains("tokens", "d"))), dim=4, n_epochs=3, rate=0.5, pretrained=vectors)
    assert {r.row_id: r.label for r in clf.predict(spark.createDataFrame([(1, ["a"]), (2, ["e"])], "row_id long, tokens array<string>")).collect()} == {1: "x", 2: "y"}


@pytest.mark.parametrize("numbers", [[], [0], [5, 0, 300, 70_000, 2**31 - 1]])
def test_numbers_are_squeezed_and_back(numbers):
    assert S.unsqueezed(S.squeezed(np.array(numbers, np.int32)), len(numbers)).tolist() == numbers


def test_a_group_gets_each_vector_once_and_trains_as_its_blocks_do(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([f"m{i % 3}", "e", "lo", f"u{i}"]) for _ in range(6)], f"l{i % 3}") for i in range(400)] + [(900, None, "l0"), (901, [], "l1")]
    df = spark.createDataFrame(rows, "row_id long, tokens array<string>, label string").coalesce(1)
    made, sent = [], []
    for limit in (1, 1 << 30):  # each block by itself; as many groups as there are tasks
        monkeypatch.setattr(S, "GROUP_BYTES", limit)
        clf = S.train_classifier(df, dim=8, n_epochs=6, rate=0.5, block_tokens=150, passes=2)
        made.append({r.id: np.frombuffer(bytes(r.vec), np.float32) for r in clf.vectors.collect()})
        groups = S.text_groups(df.select("tokens", "row_id"), "row_id", 8, 1, None, 100, 150)
        got = groups.rows.collect()
        assert sorted(i for r in got if r.own is not None for i in r.own) == sorted(r[0] for r in rows)
        assert len([r for r in got if r.names is not None]) == groups.n
        sent.append(sum(len(r.names) // 8 for r in got if r.names is not None))
    assert made[0].keys() == made[1].keys()
    assert max(np.abs(made[0][i] - made[1][i]).max() for i in made[0]) < 1e-4
    assert sent[1] < 0.9 * sent[0]


def test_shares_of_distinct_ids_take_the_steps_of_all_tokens():
    r = np.random.default_rng(2)
    ids, a, pull = r.integers(0, 6, 40), r.normal(size=(6, 3)).astype(np.float32), r.normal(size=3)
    own, share = S.distinct_shares(ids)
    assert np.allclose(share @ a[own], a[ids].mean(axis=0), atol=1e-6) and S.distinct_shares(ids[:0])[0].size == 0
    want = a.copy()
    np.add.at(want, ids, (pull / 40).astype(np.float32))
    a[own] += share[:, None] * pull.astype(np.float32)
    assert np.allclose(a, want, atol=1e-6)
