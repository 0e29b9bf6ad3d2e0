"""Nulls, repeated and missing ids, empty tables, long texts and clashing columns in every stage."""

import zlib

import numpy as np
import pytest

EXTRA = ["row", "id", "_row", "doc", "n", "h", "spans", "_certainty", "component_id", "ids"]
WORDS = {"en": "the and of with this that from have are was".split(), "de": "der die und nicht auch für sich aber wenn noch".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    r = np.random.default_rng(1)
    prose = lambda lang, n: " ".join(r.choice(WORDS[lang], n)) + f" tail{r.integers(10**9)}"
    rows = [(i, prose(lang, 40), lang, f"src{i}", 1) for i, lang in enumerate(["en", "de"] * 60)]
    secret = "24be64439e3e49cf46b2d7c90f3602a3"
    rows += [
        (200, None, "en", "s", None), (200, None, "en", "s", None), (None, None, None, None, None), (201, "", "en", "s", 0), (202, "12 34 !!", None, None, 8), (None, rows[0][1], "en", None, 1), (0, rows[0][1], "en", "s", 1),
        (0, prose("en", 30), "en", "s", 1), (203, f"{prose('de', 20)} token = {secret}", "de", None, 5), (204, prose("en", 30_000), "en", "s", 1), (205, "of the " * 20 + "benchmark words that no one else has in a row here " + prose("en", 9), "en", "s", 1),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "benchmark words that no one else has in a row here"), (2, None), (3, ""), (None, "some other item with enough words in it")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def widened(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA])


def test_every_stage_keeps_its_columns_and_the_right_rows(spark, folder):
    import corpus_pipeline as C

    docs = widened(spark.read.parquet(f"{folder}/documents.parquet"))
    source = docs.collect()
    seen = {}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in EXTRA)
        seen[name] = rows
        out.write.parquet(f"{folder}/after-{name}")
        docs = spark.read.parquet(f"{folder}/after-{name}")
    told = seen["language_id"]
    assert all(r.text and any(c.isalpha() for c in r.text) for r in told) and len(told) == sum(bool(r.text) and any(c.isalpha() for c in r.text) for r in source)
    kept = seen["ngram_join"]
    assert sum(r.text == source[0].text for r in kept) == 1 and len({r.text for r in kept}) == len(kept) == len({r.text for r in told})
    clean = seen["decontamination"]
    assert {r.doc_id for r in kept} - {r.doc_id for r in clean} == {205}
    masked = {r.doc_id: r for r in seen["secret_scan"]}
    assert masked[203].text.endswith("token = <secret>") and masked[203].n_chars == len(masked[203].text) and len(masked) == len({r.doc_id for r in clean})
    pieces = C.packing(spark, docs, folder).collect()
    assert {p.doc_id for p in pieces} == set(masked)


def test_stages_alone_on_nulls(spark, folder):
    import corpus_pipeline as C

    docs = widened(spark.read.parquet(f"{folder}/documents.parquet")).where("text is null or doc_id >= 200")
    n = docs.count()
    assert C.ngram_join(spark, docs, folder).count() == n and C.secret_scan(spark, docs, folder).count() == n
    assert C.decontamination(spark, docs, folder).count() == n - 1
    got = [p for p in C.packing(spark, docs, folder).collect() if p.doc_tokens == 1]
    assert len(got) == 4 and {p.ids_crc32 for p in got} == {zlib.crc32(b"\0" * 4)}


def test_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline as C

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = widened(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    for _, stage in C.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert C.run(spark, str(tmp_path)).count() == 0
    whole = widened(spark.read.parquet(f"{folder}/documents.parquet"))
    assert C.decontamination(spark, whole, str(tmp_path)).count() == whole.count()
    assert "n_chars" not in C.secret_scan(spark, whole.drop("n_chars"), folder).columns
