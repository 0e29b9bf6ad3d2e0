import os

import pytest
from pyspark.sql import functions as F

from dialectry.sources import writers as K


def files(path):
    return {os.path.relpath(os.path.join(at, f), path): open(os.path.join(at, f), encoding="utf-8").read() for at, _, names in os.walk(path) for f in names}


def articles(spark, rows):
    return spark.createDataFrame(rows, "id long, dialect string, title_slugify string, text_finewiki string").repartition(3)


def test_all_files_at_once(spark, tmp_path):
    path = str(tmp_path / "out")
    K.texts_by_variety(articles(spark, [(1, "Niçard", "a-1", "un\ndos"), (2, None, "b-2", "é𝒳"), (3, "gascon", "c-3", None), (4, "gascon", "d-4", "z" * 300_000), (5, "gascon", "d-4", "again")]), path)
    assert files(path) == {"nicard/a-1.txt": "un\ndos\n", "none/b-2.txt": "é𝒳\n", "gascon/d-4.txt": "again\n" + "z" * 300_000 + "\n"}
    assert os.listdir(tmp_path) == ["out"]
    K.texts_by_variety(articles(spark, [(9, "gascon", "e-9", "new")]), path)
    assert files(path) == {"gascon/e-9.txt": "new\n"}
    K.texts_by_variety(articles(spark, []), path)
    assert files(path) == {} and os.listdir(tmp_path) == ["out"]


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    K.texts_by_variety(articles(spark, [(1, "gascon", "a-1", "old")]), path)
    many = [(i, "gascon", f"f-{i}", "text") for i in range(200)]
    for bad in ((999, "gascon", "x-1", "  "), (999, "gascon", "../x", "text"), (999, "gascon", None, "text")):
        with pytest.raises(Exception):
            K.texts_by_variety(articles(spark, [*many, bad]), path)
        assert files(path) == {"gascon/a-1.txt": "old\n"} and os.listdir(tmp_path) == ["out"]


def test_columns_and_existing_folders(spark, tmp_path):
    from dialectry.sources.article_files import ArticleFiles

    spark.dataSource.register(ArticleFiles)
    with pytest.raises(Exception, match="folder, file and text"):
        spark.range(1).write.format("article_files").mode("append").save(str(tmp_path / "o"))
    one = spark.range(1).select(F.lit("a").alias("folder"), F.lit("b").alias("file"), F.lit("c").alias("text"))
    one.write.format("article_files").mode("append").save(str(tmp_path / "o"))
    with pytest.raises(Exception, match="exists"):
        one.write.format("article_files").mode("append").save(str(tmp_path / "o"))
    assert files(tmp_path) == {"o/a/b.txt": "c\n"}
