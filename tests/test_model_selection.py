import numpy as np
import pytest
from pyspark.sql import functions as F

from dialectry.operators import linear
from dialectry.operators import metrics as M
from dialectry.operators import models
from dialectry.sources import readers as R
from dialectry.sources import writers as K


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, ("lo gat e la taula " if i % 2 else "the cat and a table ") + "xyz"[i % 3], "oc" if i % 2 else "en") for i in range(36)]
    return spark.createDataFrame(data, "row_id long, text string, dialect string").cache()


def test_runs_are_averaged(rows):
    scores = iter([{"recall_macro": 0.5, "accuracy": 0.2}, {"recall_macro": 0.9, "accuracy": 0.4}])
    clf, mean, seed = models.train_runs(rows, lambda c: next(scores), [3, 4], chars=False, max_iter=2)
    assert mean == pytest.approx({"recall_macro": 0.7, "accuracy": 0.3}) and seed == 4 and clf.labels == ["en", "oc"]


def test_runs_differ(rows):
    clf, _, _ = models.train_runs(rows, lambda c: {"recall_macro": 0.0}, [1], chars=False, share=0.5)
    other, _, _ = models.train_runs(rows, lambda c: {"recall_macro": 0.0}, [2], chars=False, share=0.5)
    assert clf.weights_.shape != other.weights_.shape or not np.allclose(clf.weights_, other.weights_)


def test_grid_search(rows):
    best, table = models.grid_search(rows, {"max_iter": [0, 50]}, folds=3, chars=False)
    got = {(r.params, r.fold): r.f1_macro for r in table.collect()}
    assert len(got) == 6 and best == {"max_iter": 50} and all((f == 1.0) == ("50" in p) for (p, _), f in got.items())


def test_squared_hinge_against_the_whole_problem(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(60, 5)) * (r.random((60, 5)) < 0.6), r.integers(0, 3, 60)
    data = [(n, int(k), [int(i) for i in np.flatnonzero(v)], [float(f) for f in v[v != 0]]) for n, (k, v) in enumerate(zip(y, x))]
    rows = spark.createDataFrame(data, "row_id long, label int, indices array<int>, values array<double>").repartition(3)
    counts = np.bincount(y, minlength=3).tolist()
    w = linear.fit(rows, 5, counts, c=0.7, tol=1e-6)
    ones = np.concatenate([x, np.ones((60, 1))], axis=1)
    for k in range(3):
        sign = np.where(y == k, 1.0, -1.0)
        weight = 0.7 * np.where(y == k, 60 / (3 * counts[k]), 1.0)
        gap = np.maximum(0, 1 - sign * (ones @ w[:, k]))
        # the objective is strictly convex: its only minimum has no gradient
        assert np.abs(w[:, k] - 2 * ones.T @ (weight * sign * gap)).max() < 1e-3
    got = {i: b for i, b in linear.predict(rows, w, "row_id", "long").collect()}
    want = {q.row_id: int((np.bincount(q.indices, q["values"], minlength=5) @ w[:5] + w[5]).argmax()) for q in rows.collect()}
    assert got == want


def test_evaluate_all(rows):
    models_ = {"same": lambda d: d.withColumn("label_pred", F.col("dialect")), "one": lambda d: d.withColumn("label_pred", F.lit("oc"))}
    got = {(r.testset, r.model, r.metric): r.value for r in M.evaluate_all(models_, {"a": rows, "b": rows.where("row_id < 10")}).collect()}
    assert got["a", "same", "f1_macro"] == 1.0 and got["b", "one", "accuracy"] == 0.5 and got["a", "baseline_random", "accuracy"] == 0.5 and got["a", "one", "recall_oc"] == 1.0


def test_word_vectors(spark, rows, tmp_path):
    toks = rows.withColumn("tokens", F.split("text", " "))
    vec = models.word_vectors(toks, dim=4, epochs=1, min_count=1)
    clf, labels = models.mean_vector_classifier(toks, vec, epochs=20)
    assert labels == ["en", "oc"] and clf.numClasses == 2
    K.word_vectors(vec, str(tmp_path / "v"), spark)
    assert (tmp_path / "v/0-head.txt").is_file()
    lines = [r.value for r in R.vectors_text(spark, str(tmp_path / "v")).orderBy("line").collect()]
    assert lines[0] == f"{len(lines) - 1} 4" and all(len(x.split(" ")) == 5 for x in lines[1:])
    assert M.runtime_summary(models.predict_in_batches(rows, lambda: lambda t: [("en", 0.5)] * len(t))).first().score_std == 0


def test_subword_vectors(spark, rows):
    tokens = [r[0] for r in spark.range(1).select(models.subword_tokens(F.array(F.lit("gat"), F.lit("e")), 3, 4)).collect()][0]
    assert tokens == ["gat", "<ga", "gat", "at>", "<gat", "gat>", "e"]
    model = models.word_vectors(rows.withColumn("tokens", F.split("text", " ")), dim=4, epochs=1, min_count=1, subwords=(3, 4))
    got = {r.word: r.vector for r in models.vectors_of(model, spark.createDataFrame([("gat",), ("gats",), ("zzz",)], "word string"), (3, 4)).collect()}
    known = {r.word: r.vector.toArray() for r in model.getVectors().collect()}
    assert np.allclose(got["gats"], np.mean([known[p] for p in ("<ga", "gat", "<gat")], axis=0)) and got["zzz"] is None and len(got["gat"]) == 4


def test_cells_by_feature_are_those_of_the_rows(spark, monkeypatch):
    """Cells in several blocks and slices give the optimum of the whole problem, rows of a repeated id, without one or without a text among them."""
    data = [(i, ("lo gat e la taula " if i % 2 else "the cat and a table ") + "xyz"[i % 3] + f" own{i // 2}", "oc" if i % 2 else "en") for i in range(40)] + [(7, "lo lo gat", "oc"), (None, "lo gat", "oc"), (50, None, "en"), (51, "gat", None)]
    df = spark.createDataFrame(data, "row_id long, text string, dialect string")
    (words, chars, terms), ready, names, counts = models.prepare(df)
    size = terms.count()
    want = linear.fit(ready, size, counts, tol=1e-6)
    for name, k in (("STORED_CELLS", 300), ("CELLS", 20), ("BLOCK", 7)):
        monkeypatch.setattr(linear, name, k)
    monkeypatch.setattr(models.feat, "SLICE", 30)
    space, cells, same, n = models.prepare_cells(df)
    assert (same, n, cells.n) == (names, counts, 43) and space[2].exceptAll(terms).isEmpty() and cells.blocks.where("n is not null").count() > 4
    assert np.bincount(cells.labels).tolist() == counts
    got = linear.fit(cells, size, counts, tol=1e-6)
    assert np.abs(got - want).max() < 1e-4
    turned = cells.turned(np.ones((2, 43)))
    assert turned.shape == (2, 43) and np.isfinite(turned).all()
    rows = {r.row_id: r.preds for r in models.NgramClassifier(got, names, *space).predict_each(df, [got, np.zeros_like(got)]).collect()}
    assert rows[0] == ["en", "en"] and rows[1] == ["oc", "en"]


def test_held_rows_are_scored_once_for_all_parameters(rows, monkeypatch):
    scored, score = [], models.feat.linear_scores
    monkeypatch.setattr(models.feat, "linear_scores", lambda *a, **k: scored.append(1) or score(*a, **k))
    best, table = models.grid_search(rows, {"max_iter": [0, 20]}, folds=2, chars=False)
    assert len(scored) == 2 and best == {"max_iter": 20} and table.count() == 4


def test_top_features_store_no_rows_of_vectors(rows, monkeypatch):
    names, store = [], models.stored
    monkeypatch.setattr(models, "stored", lambda df, name, *a: names.append(name) or store(df, name, *a))
    top = models.top_features(models.train(rows, chars=False), 2)
    assert "rows" not in names and {r.label for r in top.collect()} == {"en", "oc"} and top.count() == 4
