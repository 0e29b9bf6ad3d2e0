import json

from test_contributions import XML

from dialectry.__main__ import main, split_articles


def test_build_split_and_lines(spark, tmp_path):
    dump = tmp_path / "d.xml"
    dump.write_text(XML, encoding="utf-8")
    clean = str(tmp_path / "clean")
    spark.createDataFrame([("x/ocwiki/1", "Un doas.\n\nTres quatre.", "2020-01-03T00:00:00Z")], "id string, text string, date_modified string").write.parquet(clean)
    main(["build", str(dump), str(tmp_path / "out"), "--clean", clean, "--until", "2020-12-31"])
    (line,) = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    got = json.loads(line)
    assert got["id"] == 1 and got["paragraphs"] == ["Un doas.", "Tres quatre."] and got["oc_level_first"] is None
    main(["split", str(tmp_path / "out"), str(tmp_path / "csv")])
    full = spark.read.csv(str(tmp_path / "csv/full.csv"), header=True)
    assert sorted(r.text for r in full.collect()) == ["Tres quatre.", "Un doas."]
    main(["fasttext", str(tmp_path / "csv/full.csv"), str(tmp_path / "ft"), "--scheme", "wiki"])
    assert {r[0] for r in spark.read.text(str(tmp_path / "ft")).collect()} == {"__label__gas Un doas.", "__label__gas Tres quatre."}


def test_splits_share_no_article(spark):
    rows = [(i, "\n\n".join(f"par {i} {k}" for k in range(i % 4 + 1)), "ab"[i % 2]) for i in range(80)]
    got = split_articles(spark.createDataFrame(rows, "article_id long, text string, dialect string"), "paragraph").collect()
    by = {}
    for r in got:
        by.setdefault(r.article_id, set()).add(r.split)
    assert len(got) == sum(i % 4 + 1 for i in range(80)) and all(len(v) == 1 for v in by.values()) and {s for v in by.values() for s in v} == {"train", "dev", "test"}


def test_options_from_a_file_and_merge(spark, tmp_path):
    rows = [(i, "ab"[i % 2], "\n\n".join(f"par {i} {k}" for k in range(3))) for i in range(60)]
    articles = str(tmp_path / "a")
    spark.createDataFrame(rows, "id long, dialect string, text_finewiki string").write.json(articles)
    (tmp_path / "o.json").write_text(json.dumps({"split": {"test_size": 12, "dev_size": 0.1, "unit": "article", "most": 20, "single": True}}))
    main(["--config", str(tmp_path / "o.json"), "split", articles, str(tmp_path / "csv")])
    sizes = {s: spark.read.csv(str(tmp_path / f"csv/{s}.csv"), header=True, multiLine=True).count() for s in ("train", "dev", "test", "full")}
    assert sizes == {"train": 42, "dev": 6, "test": 12, "full": 60} and (tmp_path / "csv/test.csv").is_file()
    main(["--config", str(tmp_path / "o.json"), "split", articles, str(tmp_path / "two"), "--test_size", "20"])
    assert spark.read.csv(str(tmp_path / "two/test.csv"), header=True, multiLine=True).count() == 20
    (tmp_path / "news").mkdir()
    (tmp_path / "news/oc-x.csv").write_text("".join(f"t{i}§oc-gascon-grclass\n" for i in range(30)) + "t1§OC-gascon-grmistr\nq§oc-cisaup-grclass\n")
    main(["merge", str(tmp_path / "merged"), str(tmp_path / "news")])
    assert spark.read.csv(str(tmp_path / "merged/full.csv"), header=True).count() == 30
