import os
import random

import numpy as np

from dialectry.operators import encoder as E
from dialectry.operators import subword


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(4)
    dim, hidden, k = 6, 3, 4
    rows, e, mask, y = r.normal(size=(hidden + k + 2, dim)), r.normal(size=(5, 7, dim)), np.arange(7) < np.array([[7], [1], [3], [6], [2]]), r.integers(0, k, 5)

    def loss(rows, e):
        return -np.log(E.Dense(rows, hidden, k).forward(e, mask)[3][np.arange(5), y]).sum()

    de, g = E.Dense(rows, hidden, k).gradients(e, mask, y)
    for of, got in ((rows, g), (e, de)):
        for _ in range(40):
            at = tuple(r.integers(0, n) for n in of.shape)
            up, down = of.copy(), of.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            pair = [(up, e), (down, e)] if of is rows else [(rows, up), (rows, down)]
            want = (loss(*pair[0]) - loss(*pair[1])) / 2e-5
            used = not (of is rows and (at[0] == hidden and at[1] >= hidden or at[0] == hidden + 1 + k and at[1] >= k)) and not (of is e and not mask[at[:2]])
            assert abs(got[at] - (want if used else 0)) < 1e-5


def test_batches_hold_every_text_once():
    r = random.Random(1)
    sizes = [r.choice([0, 1, 3, 50, 4000, 40_000]) for _ in range(200)]
    got = E.batches_by_length(sizes)
    assert sorted(x for b in got for x in b) == [x for x, n in enumerate(sizes) if n]
    assert all(len(b) == 1 or len(b) <= E.ROWS and len(b) * max(sizes[x] for x in b) <= E.CELLS for b in got)


def made(n=400, seed=2):
    rnd = random.Random(seed)
    return [(i, [rnd.choice("e lo la que un".split()) for _ in range(rnd.randrange(3, 25))] + [f"m{i % 4}{rnd.randrange(3)}"], f"l{i % 4}") for i in range(n)]


def test_fine_tuning_stops_early_and_goes_on(spark, tmp_path):
    df = spark.createDataFrame(made() + [(1000, None, "l0"), (1001, ["lo"], None)], "row_id long, tokens array<string>, label string")
    dev = df.where("row_id % 5 = 0 and label is not null")
    options = dict(dim=12, hidden=4, block_tokens=1500, patience=2)
    folder = str(tmp_path / "run")
    clf, scores = E.fine_tune(df.where("row_id % 5 > 0"), dev, folder, n_epochs=8, **options)
    assert max(scores) > 0.95 and (len(scores) == 8 or scores.index(max(scores)) == len(scores) - 3)
    got = {r.row_id: r for r in clf.predict(df).collect()}
    assert len(got) == df.count() and all(0 < r.score <= 1 for r in got.values())
    # the last epoch is lost half-way: only that one is trained anew
    last = len(scores) - 1
    os.remove(f"{folder}/epoch-{last}/score/_SUCCESS")
    kept = os.path.getmtime(f"{folder}/epoch-0/vectors")
    again, same = E.fine_tune(df.where("row_id % 5 > 0"), dev, folder, n_epochs=8, **options)
    assert np.allclose(same, scores, atol=0.1) and os.path.getmtime(f"{folder}/epoch-0/vectors") == kept


def test_pretrained_vectors_are_fine_tuned(spark, tmp_path):
    df = spark.createDataFrame(made(80), "row_id long, tokens array<string>, label string")
    vectors = subword.skip_gram(df, dim=8, n_epochs=1, min_count=1, sample=1.0, subwords=(3, 3), buckets=100)
    clf, _ = E.fine_tune(df, df, str(tmp_path / "p"), dim=8, hidden=2, n_epochs=1, subwords=(3, 3), buckets=100, pretrained=vectors)
    before, after = ({r.id: bytes(r.vec) for r in x.collect()} for x in (vectors.vectors, clf.vectors))
    assert before.keys() < after.keys() and before != {k: after[k] for k in before}


def test_texts_are_made_ready_once_for_all_epochs(spark, tmp_path, monkeypatch):
    df, made_ready, ready = spark.createDataFrame(made(60), "row_id long, tokens array<string>, label string"), [], E.text_groups
    monkeypatch.setattr(E, "text_groups", lambda *a, **k: made_ready.append(1) or ready(*a, **k))
    _, scores = E.fine_tune(df, df, str(tmp_path / "once"), dim=6, hidden=2, n_epochs=2, block_tokens=200)
    assert len(scores) == 2 and len(made_ready) == 2  # to train on and to score


def test_places_of_a_batch_are_found_once():
    r = np.random.default_rng(3)
    lists, a = [r.integers(0, 9, n) for n in (4, 1, 7)], r.normal(size=(9, 5)).astype(np.float32)
    one = E.Places([2, 0, 1], lists)
    e, mask = E.padded([a[x] for x in lists], 5)
    assert (one.filled(a[one.ids]) == e).all() and (one.mask == mask).all() and one.ids.tolist() == np.unique(np.concatenate(lists)).tolist()
    de, want = r.normal(size=e.shape), np.zeros((9, 5))
    np.add.at(want, np.concatenate(lists), de[mask])
    assert np.allclose(one.summed(de), want[one.ids])
