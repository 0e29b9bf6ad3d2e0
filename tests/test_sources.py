import json
import os

import pytest
from pyspark.sql import functions as F

from dialectry.functions import labels as L
from dialectry.sources import readers as R
from dialectry.sources import writers as K
from dialectry.streaming.ingest import ingest_new


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_two_csv_readings(spark, tmp_path):
    p = put(tmp_path / "wiki-train.csv", 'text,dialect\n"",gascon\n,gascon\nNA,x\n"a ""q"" b\nc",lemosin\n')
    assert [tuple(r) for r in R.csv_verbatim(spark, p).collect()] == [("", "gascon"), ("", "gascon"), ("NA", "x"), ('a "q" b\nc', "lemosin")]
    assert [r[0] for r in R.csv_with_missing(spark, p).collect()] == [None, None, None, 'a "q" b\nc']
    got = R.labelled_sources(spark, [p]).collect()
    assert [r.dialect for r in got] == ["gas", "gas", None, "lim"] and {r.source for r in got} == {"wiki"}


def test_section_csv(spark, tmp_path):
    put(tmp_path / "oc-b.csv", 'x "q§oc-gascon-grclass§z\n')
    put(tmp_path / "oc-a.csv", "y§oc-lemosin-grclass\n")
    put(tmp_path / "other.csv", "n§n\n")
    put(tmp_path / "oc-c.csv", "".join(f"long line number {i}§oc-gascon-grmistr\n" for i in range(4000)) + "y§OC-lemosin-grmistr\nz§oc-cisaup-grclass\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        every = R.section_csv(spark, str(tmp_path))
        assert every.rdd.getNumPartitions() > 3
        rows = every.orderBy("row_id").collect()
        assert [r.text for r in rows] == ["y", 'x "q', *(f"long line number {i}" for i in range(4000)), "y", "z"]
        merged = R.merged_sections(spark, [str(tmp_path), str(tmp_path)]).orderBy("row_id").collect()
        assert [r.text for r in merged] == [r.text for r in rows[:-2]] and {r.dialect for r in merged} == {"lemosin", "gascon"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    os.remove(tmp_path / "oc-c.csv")
    got = R.section_csv(spark, str(tmp_path)).orderBy("row_id").select("text", L.spelling_free_label(F.col("dialect"))).collect()
    assert [tuple(r) for r in got] == [("y", "lemosin"), ('x "q', "gascon")]


def test_lines_are_placed_where_they_are_read(spark, tmp_path):
    from dialectry.plans.roundtrips import _section_files

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("line "), "id").alias("text"), F.lit("fr").alias("lang")).repartition(7)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        base = _section_files(spark, str(tmp_path))
        rows = R.section_csv(spark, base)
        # no file is written or read by one task
        assert rows.rdd.getNumPartitions() > 3 and rows.select("row_id.part").distinct().count() > 3 and rows.select("file").distinct().count() == 3
        got = R.placed(rows)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        wanted = {(f"line {i}", f"oc-{'bac'[i % 3]}.csv", i // 3) for i in range(3000)}
        assert {(r.text, r.file.rsplit("/", 1)[-1], r.place) for r in got.collect()} == wanted
        # plain files and folders of parts beside each other
        put(tmp_path / "oc-y.csv", "".join(f"y{i}§l\n" for i in range(900)))
        K.text_parts(spark.range(900).select(F.concat(F.lit("z"), "id", F.lit("§l")).alias("value")), str(tmp_path / "oc-x.csv"))
        got = R.placed(R.section_csv(spark, str(tmp_path)))
        assert {(r.text, r.place) for r in got.collect()} == {(f"{c}{i}", i) for c in "yz" for i in range(900)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_conllu_and_lines(spark, tmp_path):
    p = put(tmp_path / "a.conllu", "# sent_id = f_gascon.conllu.s1\n# text = Un dos.\n1\tUn\n\n# sent_id = f_limousin.conllu.s2\n# text = Tres\n1\tTres\n\n")
    assert [tuple(r) for r in R.conllu(spark, p).collect()] == [("f_gascon.conllu.s1", "Un dos.", "gascon"), ("f_limousin.conllu.s2", "Tres", "limousin")]
    bad = put(tmp_path / "b.conllu", "# sent_id = zzz\n# text = x\n")
    with pytest.raises(Exception, match="unexpected sentence id"):
        R.conllu(spark, bad).collect()
    lines = put(tmp_path / "l.txt", " __label__gas  Un dos \n__label__lan\n\n")
    assert [tuple(r) for r in R.fasttext_lines(spark, lines).collect()] == [("__label__gas", "Un dos")]


def test_json_forum_and_translations(spark, tmp_path):
    p = put(tmp_path / "f.json", json.dumps({"id": "1", "text": "a\nb", "author_dialect": "gasc-1240"}) + "\n")
    assert tuple(R.forum(spark, p).first()) == ("1", "a b", "gasc-1240")
    d = put(tmp_path / "d.json", '{"day": "2020-01-02T03:00", "oc_level_first": "0"}\n')
    r = R.json_lines(spark, d, "day string, oc_level_first string", ("day",)).first()
    assert str(r.day) == "2020-01-02" and r.oc_level_first == "0"
    df = spark.createDataFrame([(0.8, ("x",)), (0.79, ("y",))], "target_sentence_lid double, translation struct<oci_Latn: string>")
    assert [r[0] for r in R.accepted_translations(df).collect()] == ["x"]


def test_store_operations(spark):
    users = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3), (3, "c", 4)], "id long, username string, o int")
    assert sorted(r.o for r in R.first_by_keys(users, ["id", "username"], F.col("o")).collect()) == [1, 4]
    new = spark.createDataFrame([(3, None)], "id long, username string")
    assert {r.id: r.username for r in R.updated(users.where("o > 2"), new, "username").collect()} == {2: "a", 3: None}
    assert R.not_yet_written(users, new).where("id = 3").count() == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a  b\nc", "gascon", "train"), (2, 'q"r', "lemosin", "dev"), (3, "", "gascon", "train")], "id long, text string, dialect string, split string")
    K.csv_splits(df, str(tmp_path / "csv"))
    assert sorted(x for x in os.listdir(tmp_path / "csv") if x[0] != ".") == ["dev.csv", "full.csv", "train.csv"]
    K.csv_splits(df, str(tmp_path / "single"), single=True)
    for base in ("csv", "single"):
        back = R.csv_verbatim(spark, str(tmp_path / base / "full.csv"), "id long, text string, dialect string")
        assert sorted(r.text for r in back.collect()) == ["", "a  b\nc", 'q"r']
    assert (tmp_path / "single/dev.csv").read_text().startswith("id,text,dialect\n2,")
    K.fasttext_lines(df.where("id = 2"), str(tmp_path / "ft"), L.SCHEMES["wiki"])
    assert spark.read.text(str(tmp_path / "ft")).first()[0] == '__label__lim q"r'
    K.one_line_texts(df.where("id = 1"), str(tmp_path / "one"))
    assert spark.read.text(str(tmp_path / "one")).first()[0] == "a b c"
    K.json_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1,"b":null}'
    arts = spark.createDataFrame([(1, "Text", "Niçard", "x-1"), (2, None, "gascon", "y-2")], "id long, text_finewiki string, dialect string, title_slugify string")
    K.texts_by_variety(arts, str(tmp_path / "txt"))
    assert (tmp_path / "txt/nicard/x-1.txt").read_text() == "Text\n" and sorted(x for x in os.listdir(tmp_path / "txt") if x[0] != ".") == ["nicard"]
    assert [tuple(r) for r in R.texts_by_variety(spark, str(tmp_path / "txt")).collect()] == [("nicard", "x-1", "Text")]
    with pytest.raises(Exception, match="empty article: 3"):
        K.texts_by_variety(spark.createDataFrame([(3, " ", "gascon", "z-3")], arts.schema), str(tmp_path / "blank"))
    K.scores_json(spark.createDataFrame([("t", "m", "f1", 0.5)], "testset string, model string, metric string, value double"), str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"t": {"m": {"f1": 0.5}}}


def test_incremental_ingestion(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    os.mkdir(src)
    put(tmp_path / "src/a.json", '{"id": 1, "text": "x"}\n{"id": 1, "text": "x"}\n')
    ingest_new(spark, src, "id long, text string", out, ck)
    put(tmp_path / "src/b.json", '{"id": 1, "text": "y"}\n{"id": 2, "text": "z"}\n')
    ingest_new(spark, src, "id long, text string", out, ck)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "x"), (2, "z")]
