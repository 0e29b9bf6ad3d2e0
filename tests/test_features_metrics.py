import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dialectry.functions import labels as L
from dialectry.operators import features as V
from dialectry.operators import metrics as M
from dialectry.operators.frequency import frequent_terms


def char_wb(text):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in range(2, 6):
            if len(w) <= n:
                out.append(w)
                break
            out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return out


def test_ngrams(spark):
    t = ["Un gat e a", "", "x  y\nlonga"]
    df = spark.createDataFrame(list(enumerate(t)), "k long, t string")
    got = [sorted(r[0]) for r in df.orderBy("k").select(V.char_wb_ngrams(F.col("t"))).collect()]
    assert got == [sorted(char_wb(x)) for x in t]
    words = F.filter(F.split("t", r"\s+"), lambda x: x != "")
    assert df.where("k = 0").select(V.word_ngrams(words, 1, 2)).first()[0] == ["Un", "gat", "e", "a", "Un gat", "gat e", "e a"]


def test_tf_idf_formula(spark):
    r = random.Random(2)
    docs = [(i, [r.choice("abcdefgh") for _ in range(r.randint(1, 9))]) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, toks array<string>")
    got = {(x.doc_id, x.term): x.weight for x in V.tf_idf(df, F.col("toks")).collect()}
    dfs = Counter(t for _, d in docs for t in set(d))
    want = {}
    for i, d in docs:
        w = {t: (1 + math.log(c)) * (math.log(13 / (1 + dfs[t])) + 1) for t, c in Counter(d).items() if 2 <= dfs[t] <= 0.9 * 12}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, t): x / norm for t, x in w.items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    with pytest.raises(ValueError):
        V.vectorize("other", df, F.col("toks"))
    terms = V.numbered_terms(V.counts(df, F.col("toks")))
    assert sorted(x.idx for x in terms.collect()) == list(range(8))


def test_scores_with_other_and_undefined(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "zz"), ("c", "a")]
    df = spark.createDataFrame(rows, "ref string, pred string")
    per = {x.label: (x.precision, x.recall, x.f1) for x in M.class_scores(M.group_other(df)).collect()}
    assert per["other"] == (0.0, None, 0.0) and per["c"] == (None, 0.0, 0.0) and per["a"] == (0.5, 0.5, 0.5)
    s = M.scores(df).first()
    assert s.accuracy == 0.4 and math.isclose(s.recall_macro, (0.5 + 0.5 + 0) / 3) and math.isclose(s.precision_macro, (0.5 + 0.5 + 0) / 3) and math.isclose(s.f1_macro, 0.25)
    m = {x.ref: x for x in M.confusion_matrix(M.group_other(df), ["a", "b", "other"]).collect()}
    assert m["b"]["other"] == 50.0 and m["c"]["a"] == 100.0
    long = M.scores_long(df, "t1", "m1").unionByName(M.scores_long(df, "t2", "m1"))
    assert M.best_per_testset(long, "accuracy").count() == 2 and M.metric_matrix(long, "accuracy", ["t1", "t2"]).first()["t2"] == 40.0
    assert M.report_row(long, "t1", "m1", ["a", "b"]).first()["f1_a"] == 50.0
    b = M.random_baseline_macro(df.withColumnRenamed("ref", "dialect")).first()
    assert math.isclose(b.accuracy, 1 / 3) and math.isclose(b.precision_macro, 1 / 3)


def test_labels(spark):
    df = spark.createDataFrame([("gascon",), ("x",), (None,)], "l string")
    m = L.SCHEMES["ttb"]
    assert [r[0] for r in df.select(L.map_label(F.col("l"), m)).collect()] == ["gas", None, None]
    assert [r[0] for r in df.select(L.map_label(F.col("l"), m, "passthrough")).collect()] == ["gas", "x", None]
    with pytest.raises(Exception, match="unmapped label"):
        df.select(L.map_label(F.col("l"), m, "error")).collect()
    with pytest.raises(Exception, match="unexpected label"):
        df.select(L.spelling_free_label(F.col("l"))).collect()
    names = spark.createDataFrame([("d/concatnowiki_x.csv",), ("a/Wiki.csv",), ("soft-1",)], "n string")
    assert [r[0] for r in names.select(L.detect_source(F.col("n"))).collect()] == ["wiki", None, "soft"]
    assert sorted(map(tuple, L.label_index(df, "l", ["z", "gascon"]).collect())) == [("gascon", 0), ("x", 2), ("z", 1)]


def test_models(spark, tmp_path):
    from dialectry.operators import models

    rows = [(i, ("lo gat e la taula " if i % 2 else "the cat and a table ") + "xyz"[i % 3], "oc" if i % 2 else "en") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, text string, dialect string")
    clf = models.train(df, chars=False, max_iter=5)
    assert clf.predict(df).where("dialect <> label_pred").count() == 0
    assert clf.predict_list(spark, ["the table", ""]) == ["en", "en"]
    assert {x.term for x in models.top_features(clf, 3).where("label = 'oc'").collect()} <= {"w_lo", "w_gat", "w_e", "w_la", "w_taula"}
    assert models.feature_table(clf, 4).count() == 4
    clf.save(str(tmp_path / "m"))
    again = models.NgramClassifier.load(spark, str(tmp_path / "m"))
    assert again.labels == ["en", "oc"] and again.predict(df).where("dialect <> label_pred").count() == 0
    tagged = df.withColumn("pos", F.split("text", " "))
    assert models.train(tagged, chars=False, max_iter=3, list_col="pos").predict(tagged).where("dialect <> label_pred").count() == 0
    got = models.predict_in_batches(df, lambda: lambda texts: [("en", 1.0)] * len(texts))
    assert got.count() == 40 and M.runtime_summary(got).first().score_mean == 1.0


def test_char_grams_in_arrow_equal_the_column(spark):
    texts = ["Un gat e a", "", None, "x  y\nlonga", "ÉTÉ été " * 30, "x" * 3000, "  \t "]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, "Un autre gat"), (None, "un")], "doc_id long, t string")
    for low, high in ((2, 5), (1, 3), (4, 4)):
        a = V.term_frequencies(df, V.CharGrams(F.col("t"), low, high))
        b = V.term_frequencies(df, V.char_wb_ngrams(F.col("t"), low, high))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert V.term_frequencies(df.where("false"), V.CharGrams(F.col("t"))).count() == 0


def test_words_are_cut_from_their_buffer(monkeypatch):
    import pyarrow as pa

    words = pa.array(["--", "été", "é", "", "a𝄞b", "xx"]).slice(1)
    assert V._bytes(words) == "étééa𝄞bxx".encode() and V._bytes(words.slice(5)) == b""
    made = []
    monkeypatch.setattr(pa, "array", lambda *x, f=pa.array: made.append(1) or f(*x))
    starts, ids, terms = V._cut(words, 2, 5)
    monkeypatch.undo()
    # an array for the characters, one for n-grams of each length from 2, one for the first characters: no length is numbered twice
    assert len(made) <= 6 and sorted(terms.take(pa.array(ids[starts[1] : starts[2]])).to_pylist()) == [" é", " é ", "é "]


def test_terms_are_dealt_to_as_many_tasks_as_slices(spark, monkeypatch):
    monkeypatch.setattr(V, "SLICE", 50)
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.lit("t"), F.col("id") % 20 * 10 + k)).alias("toks"))
    slices = V.Slices(df, F.col("toks"))
    found = V._found(slices, 1, 1.0, None)
    assert slices.n == 40 and found.rdd.getNumPartitions() == 40
    assert {(r.term, r.df) for r in found.collect()} == {(f"t{k}", 10) for k in range(200)}


def test_fitted_terms_are_looked_up_by_as_many_tasks_as_slices(spark, monkeypatch):
    monkeypatch.setattr(V, "SLICE", 50)
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.lit("t"), F.col("id") % 20 * 10 + k)).alias("toks"))
    fitted = spark.range(0, 400, 2).select(F.concat(F.lit("t"), "id").alias("term"), F.col("id").alias("idf"))
    slices = V.Slices(df, F.col("toks"))
    own = {(x["_slice"], x.term) for x in slices.terms().collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit, tasks in (("-1", 40), (before, None)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = V._looked_up(slices, fitted)
            rows = got.collect()
            assert tasks is None or got.rdd.getNumPartitions() == tasks
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert slices.n == 40 and sorted((x["_slice"], x.term, x.idf) for x in rows) == sorted((k, t, int(t[1:])) for k, t in own if int(t[1:]) % 2 == 0)


def test_sketch_never_drops_a_frequent_term(spark):
    r = random.Random(5)
    docs = [(i, [f"t{int(r.paretovariate(0.6)) % 4000}" for _ in range(60)] + [f"own{i}-{k}" for k in range(20)]) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, toks array<string>").repartition(5)
    dfs = Counter(t for _, d in docs for t in set(d))
    rows = V.term_rows(df, F.col("toks"), distinct=True)
    for least in (2, 7, 200):
        reaches = frequent_terms(rows, least, bits=16)
        kept = {x.term for x in rows.where(reaches(F.col("term"))).distinct().collect()}
        want = {t for t, n in dfs.items() if n >= least}
        assert want <= kept and len(kept - want) < 0.05 * len(dfs)
    plain, sketched = ({(x.doc_id, x.term): x.weight for x in V.tf_idf(df, F.col("toks"), sketch_bits=b).collect()} for b in (None, 16))
    assert plain.keys() == sketched.keys() and all(math.isclose(plain[k], sketched[k]) for k in plain)
    none = df.where("false")
    assert V.tf_idf(none, F.col("toks"), sketch_bits=16).count() == 0
    with pytest.raises(ValueError):
        frequent_terms(rows, 2, bits=33)


def _exchanges(df):
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [x for x in plan.split("\n\n") if ") Exchange" in x]


def test_terms_of_documents_are_never_shuffled(spark, monkeypatch):
    """Only texts, and the distinct terms of slices, go through exchanges; blocks and slices of any size give the same."""
    r = random.Random(7)
    docs = [(i % 60, " ".join(r.choice("lo gat taula gatòta és été xyzxyz".split()) for _ in range(r.randint(0, 40)))) for i in range(64)] + [(None, "lo gat"), (None, "gat"), (99, None)]
    df = spark.createDataFrame(docs, "doc_id long, t string").repartition(3)
    grams = V.CharGrams(F.col("t"))
    words = lambda: sorted((x.doc_id or -1, x.term, round(x.weight, 9)) for x in V.tf_idf(df, grams).collect())
    own: dict = {}
    for k, t in docs:
        own.setdefault(k, Counter()).update(char_wb(t or ""))
    n, dfs = len(docs), Counter(t for _, d in docs for t in set(char_wb(d or "")))
    want = []
    for k, tf in own.items():
        w = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + dfs[t])) + 1) for t, c in tf.items() if 2 <= dfs[t] <= 0.9 * n}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want += [(k if k else -1, t, round(x / norm, 9)) for t, x in w.items()]
    first = words()
    assert first == sorted(want)
    tf = {(x.doc_id, x.term): x.tf for x in V.term_frequencies(df, grams).collect()}
    assert tf == {(k, t): c for k, cells in own.items() for t, c in cells.items()}
    assert not any("tf#" in x or "weight#" in x or "_words#" in x for x in _exchanges(V.tf_idf(df, grams)))
    unique = df.where("doc_id > 10 and doc_id < 50")
    assert not _exchanges(V.term_frequencies(unique, grams))[1:]
    for name, k in (("WORDS", 5), ("ROWS", 3), ("SLICE", 20), ("GATHERED", 2)):
        monkeypatch.setattr(V, name, k)
    terms = {x.term: x.df for x in V.vocabulary(df, grams, n, 1, 1.0).collect()}
    assert words() == first and terms == dfs


def test_sparse_rows_without_rows_of_cells(spark):
    """Words and characters side by side, as the union of their cells gives them, while no cell is a row of its own."""
    from dialectry.operators import models

    rows = [(i, ("lo gat e la taula " if i % 2 else "the cat and a table ") + "xyz"[i % 3], "oc" if i % 2 else "en") for i in range(30)] + [(30, None, "en")]
    df = spark.createDataFrame(rows, "row_id long, text string, dialect string")
    (words, chars, terms), ready, names, counts = models.prepare(df)
    assert names == ["en", "oc"] and counts == [16, 15] and ready.count() == 31
    clf = models.NgramClassifier(None, names, words, chars, terms)
    got = clf.features(df)
    blocks = {"w": V.tf_idf(df, clf.tokens(F.lower("text")), "row_id", fitted=words), "c": V.tf_idf(df, V.char_wb_ngrams(F.col("text")), "row_id", fitted=chars)}
    want = V.sparse_rows(V.union_features(blocks, "row_id"), terms, "row_id")
    cells = lambda t: {x.row_id: sorted((i, round(v, 9)) for i, v in zip(x.indices, x["values"], strict=True)) for x in t.collect()}
    assert cells(got) == cells(want)
    assert not any("weight#" in x for x in _exchanges(got))


def test_terms_travel_packed(spark):
    import numpy as np
    import pyarrow as pa

    terms = pa.array(["", " a", " été", "a𝄞b", "lo gat", "lo gatàs"])
    assert V._unpacked(*V._packed(terms), len(terms)) == terms and V._unpacked(*V._packed(terms.slice(0, 1)), 1).to_pylist() == [""]
    parts = V._parts(terms, 1 << 20)
    assert len(set(parts)) == 6 and (V._parts(terms.slice(2), 1 << 20) == parts[2:]).all()
    assert np.bincount(V._parts(pa.array([f"t{k}" for k in range(20_000)]), 20), minlength=20).min() > 800
    df = spark.createDataFrame([(i, ["lo", "gat", f"u{i // 2}"]) for i in range(40)], "doc_id long, toks array<string>")
    # no term is a row of an exchange, on its way to its count or back
    seen = _exchanges(V.tf_idf(df, F.col("toks"), sketch_bits=16))
    assert seen and not any(" term#" in x or "[term#" in x or "idf#" in x for x in seen)
