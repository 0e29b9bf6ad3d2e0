import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialectry.llm import license_scan as S
from dialectry.llm import secret_scan as X
from dialectry.llm.language_id import identify, with_language
from dialectry.llm.permutation_index import nearest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_language_id_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "12 !?", "en"), (10**6 + 2, "", None), (None, "the and of with", "en"), (10**6 + 3, "der die und " * 4000, None)], docs.schema)
    got = identify(docs.unionByName(odd)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 205
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert len(held) > 40 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    assert [by[10**6 + k].lang_pred for k in range(4)] == ["und", "und", "und", "de"] and by[None].held_out is False
    kept = {r.doc_id for r in with_language(docs.unionByName(odd)).collect()}
    assert set(lang) <= kept and not {10**6, 10**6 + 1, 10**6 + 2} & kept
    assert with_language(docs.withColumnRenamed("text", "_certainty"), text_col="_certainty").columns == ["doc_id", "_certainty", "lang"]
    none = identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert identify(docs.where("doc_id < 0")).count() == 0


def test_every_label_is_learned_and_repeats_count_once(spark):
    from dialectry.llm.language_id import labelled_windows

    rows = [(i, f"text number {i} of label {i % 1300}", f"l{i % 1300}") for i in range(9100)] + [(3, "copies of a row", "l3")] * 500 + [(None, "no id", "l1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = labelled_windows(docs, per_label=50)
    assert {k for k, _ in got} == {f"l{i % 1300}" for i in range(9100) if zlib.crc32(str(i).encode()) % 3 != 1} and sum(w == "copies of a row" for _, w in got) <= 2
    few = labelled_windows(docs, per_label=50, sample_rows=1300)
    assert 1300 < len(few) < 4000
    assert 200 < len(labelled_windows(docs, per_label=50, sample_rows=300)) < 1000


def test_forest_and_secrets(spark):
    x, y = X.labelled_findings(800, seed=77)
    assert ((X.trained().predict(x) >= 0.5) == y).mean() > 0.95
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'é token = "{key}" end', "s", "c"), (2, f"commit {key}", "s", "c"), (3, None, None, "c"), (4, "", "s", "c"), (5, "mail5.example.com and 4785380592391139", "s", "c"), (1, f'é token = "{key}" end', "s", "c"), (6, "a" * 100_000 + "1", None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    got = sorted((r.doc_id, r.start, r.end, r.is_secret) for r in X.findings(docs).collect() if r.is_secret)
    assert got == [(1, 11, 51, True)] * 2
    clean = {r.doc_id: r.text for r in X.redacted(docs).collect()}
    assert clean[1] == 'é token = "<secret>" end' and clean[2] == f"commit {key}" and clean[3] is None and clean[4] == ""
    assert X.findings(docs.where("doc_id < 0")).count() == 0


def test_license_scan(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.\n\nmore words"), (2, "a/b/c/x.py", "# Licensed under the Apache License, Version 2.0.\ncode"), (3, "a/b/y.py", "print"), (4, "z/y.py", None),
        (5, None, "All rights reserved."), (6, "a/b/c/d/e.txt", ""), (7, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), (8, "top.txt", "prose about the public and the general license of things"), (9, "a/b/z.py", "code\nLicensed under CC BY-NC 4.0."),
    ]
    files = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, path string, text string, folder string")
    got = {r.doc_id: (r.license, r.found, r.from_doc_id) for r in S.scan(files).collect()}
    assert got == {
        1: ("MIT", "header", None), 2: ("Apache-2.0", "header", None), 3: ("MIT", "inherited", 1), 4: (None, "none", None), 5: ("Proprietary", "header", None),
        6: ("GPL-3.0", "inherited", 7), 7: ("GPL-3.0", "header", None), 8: (None, "none", None), 9: ("CC-BY-NC-4.0", "header", None),
    }
    assert S.scan(files.where("doc_id < 0")).count() == 0


def test_permutation_index(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(700, 16)) * r.uniform(0.5, 2, (700, 1))
    x[5] = x[6]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0] * 3), (1080, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*a, "c") for a in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for a in nearest(df, df.where("vec_id % 20 = 0"), k=20, shard_rows=200, query_rows=10, least=64, share=0.3).orderBy("query_id", "rank").collect():
        got.setdefault(a.query_id, []).append((a["rank"], a.vec_id, a.score))
    assert sorted(got) == list(range(0, 700, 20))
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(700), -score))[:20]
        assert [k for k, _, _ in found] == list(range(1, 21)) and all(np.isclose(s, score[v]) for _, v, s in found)
        assert [v for _, v, _ in found] == [v for _, v, _ in sorted(found, key=lambda f: (-f[2], f[1]))]
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9
    few = df.where("vec_id < 3")
    assert nearest(few, few.where("vec_id = 0"), k=20).count() == 2
    assert nearest(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0
