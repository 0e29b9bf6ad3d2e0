"""The pipeline's stages on the smallest tables against brute force."""

import os

import duckdb
import pytest

from test_near_duplicates import brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages(spark):
    import corpus_pipeline as C
    from dialectry.llm.common import stored

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(kept["language_id"]) == set(source)
    groups = brute_components([(d, r.text) for d, r in kept["language_id"].items()], 5, 80)
    assert set(kept["ngram_join"]) == {c for _, c in groups.values()}
    leaks = {r[0] for r in duckdb.sql(__import__("dialectry.llm.queries", fromlist=["x"]).ORACLE["op8_decontamination"].replace("FROM documents", f"FROM '{SF}/documents.parquet'").replace("FROM benchmark", f"FROM '{SF}/benchmark.parquet'")).fetchall()}
    assert set(kept["decontamination"]) == set(kept["ngram_join"]) - leaks
    assert set(kept["secret_scan"]) == set(kept["decontamination"])
    for d, r in kept["secret_scan"].items():
        assert r.n_chars == len(r.text) and "token = \"" not in r.text.replace('token = "<secret>"', "")
        assert "<secret>" in r.text or r.text == kept["decontamination"][d].text
    pieces = C.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(kept["secret_scan"])
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


@pytest.mark.parametrize("name", ["op3_substring_dedup", "op8_decontamination", "op9_html_extraction", "op10_ngram_join"])
def test_queries_with_oracles(spark, name):
    from dialectry.llm.queries import ORACLE, QUERIES

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = db.sql(ORACLE[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
