def test_rows_with_clashing_or_missing_ids(spark):
    import corpus_pipeline as C

    same, other = "one two three four five six seven eight", "p q r s t u v w x y"
    alone = "a different text under an id that others have too"
    rows = [(9, same), (None, same), (4, same), (4, alone), (4, other), (None, other), (None, "k l m n o p q"), (None, "k l m n o p q"), (1, None), (1, None)]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, source string")
    got = C.ngram_join(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(4, same), (4, alone), (4, other), (None, "k l m n o p q"), (1, None), (1, None)], key=str)
