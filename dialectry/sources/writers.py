"""Writers. Each writes a folder of part files; order inside a file follows the rows of a partition."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectry.functions import labels as L
from dialectry.functions import text as X
from dialectry.sources.article_files import ArticleFiles


def json_lines(df: DataFrame, path: str) -> None:
    """One object a line, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _fs(spark, path: str):
    """The Hadoop file system of a path, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _renamed_parts(spark, folder: str, path: str) -> None:
    """The only part file of ``folder`` becomes the file ``path``; an empty folder an empty file."""
    fs, make = _fs(spark, path)
    parts = [f.getPath() for f in fs.listStatus(make(folder)) if f.getPath().getName().startswith("part-")]
    if len(parts) > 1:
        raise ValueError(f"{folder} has {len(parts)} parts")
    target = make(path)
    fs.mkdirs(target.getParent())
    fs.delete(target, True)
    if parts:
        fs.rename(parts[0], target)
    else:
        fs.create(target).close()
    fs.delete(make(folder), True)


def one_file(lines: DataFrame, path: str) -> None:
    """The column ``value`` as one text file, for results that one task can write; their order is kept."""
    folder = f"{path}.parts"
    lines.select("value").coalesce(1).write.mode("overwrite").text(folder)
    _renamed_parts(lines.sparkSession, folder, path)


def text_parts(lines: DataFrame, path: str) -> None:
    """The column ``value`` as a folder of part files whose names sort in the order of the lines."""
    lines.select("value").write.mode("overwrite").text(path)


CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": ""}


def csv_file(df: DataFrame, path: str, single: bool = False) -> None:
    """A CSV with header under ``path``: a folder of part files, or with ``single`` one file written by one task."""
    if not single:
        df.write.mode("overwrite").options(**CSV).csv(path)
        return
    df.coalesce(1).write.mode("overwrite").options(**CSV).csv(f"{path}.parts")
    _renamed_parts(df.sparkSession, f"{path}.parts", path)


def texts_by_variety(df: DataFrame, path: str, text: str = "text_finewiki", label: str = "dialect") -> None:
    """One file ``variety/title.txt`` per article; articles without a text are left out, a blank one fails the job.

    All files appear at once, by one rename of their folder, and a job that fails leaves what was there before.
    """
    blank = F.raise_error(F.concat(F.lit("empty article: "), F.col("id").cast("string"))).cast("string")
    rows = df.where(F.col(text).isNotNull()).select(X.slug(F.coalesce(label, F.lit("none"))).alias("folder"), F.col("title_slugify").alias("file"), F.when(F.trim(text) != "", F.col(text)).otherwise(blank).alias("text"))
    df.sparkSession.dataSource.register(ArticleFiles)
    rows.repartition("folder", "file").sortWithinPartitions("folder", "file", "text").write.format("article_files").mode("overwrite").save(path)


def csv_splits(df: DataFrame, path: str, split: str = "split", single: bool = False) -> None:
    """``train.csv``, ``dev.csv``, ``test.csv`` as there are splits, and ``full.csv`` with all rows.

    Each is a folder of part files, or with ``single`` one file; all are written in one job.
    """
    both = df.unionByName(df.withColumn(split, F.lit("full")))
    folder = f"{path}/.parts"
    (both.repartition(split) if single else both).write.mode("overwrite").partitionBy(split).options(**CSV).csv(folder)
    spark = df.sparkSession
    fs, make = _fs(spark, path)
    for name in [f.getPath().getName() for f in fs.listStatus(make(folder)) if f.isDirectory()]:
        target = f"{path}/{name.split('=', 1)[1]}.csv"
        if single:
            _renamed_parts(spark, f"{folder}/{name}", target)
        else:
            fs.delete(make(target), True)
            fs.rename(make(f"{folder}/{name}"), make(target))
    fs.delete(make(folder), True)


def fasttext_lines(df: DataFrame, path: str, mapper: dict[str, str], text: str = "text", label: str = "dialect") -> None:
    """Labelled lines; an unmapped label fails the job."""
    mapped = L.map_label(F.col(label), mapper, "error")
    df.select(L.fasttext_line(mapped, F.col(text)).alias("value")).write.mode("overwrite").text(path)


def one_line_texts(df: DataFrame, path: str, text: str = "text") -> None:
    df.select(X.normalise_spaces(F.col(text)).alias("value")).write.mode("overwrite").text(path)


def word_vectors(model, path: str, spark) -> None:
    """The vectors of a Spark model as text."""
    from pyspark.ml.functions import vector_to_array

    vectors_text(model.getVectors().select("word", vector_to_array("vector").alias("vector")), path)


def vectors_text(vectors: DataFrame, path: str) -> None:
    """(word, vector) as text: a first file with the number of words and dimensions, then a line for each word in word order.

    The parts are written in parallel; their names sort in the order of the lines.
    """
    n, d = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    value = F.concat_ws(" ", F.col("word"), F.array_join(F.transform("vector", lambda x: x.cast("double").cast("string")), " "))
    vectors.orderBy("word").select(value.alias("value")).write.mode("overwrite").text(path)
    one_file(vectors.sparkSession.createDataFrame([(f"{n} {d}",)], "value string"), f"{path}/0-head.txt")


def scores_json(long: DataFrame, path: str) -> None:
    """The nested scores (test set, model, metric), a small table, as one JSON file."""
    out: dict = {}
    for r in long.collect():
        out.setdefault(r["testset"], {}).setdefault(r["model"], {})[r["metric"]] = r["value"]
    one_file(long.sparkSession.createDataFrame([(json.dumps(out, indent=2, sort_keys=True),)], "value string"), path)
