"""Readers. All take explicit schemas, and work on any path that Spark can open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialectry import schema as S
from dialectry.functions import labels as L

#: What a default CSV reader takes for missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: A marker that no field holds, so that no field is taken for null.
NO_NULL = "\u0000"


def pages_xml(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a history dump (plain, .bz2 or .gz), one row each, revisions in document order; namespaces are ignored."""
    options = {"rowTag": "page", "ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE", "mode": "FAILFAST"}
    return spark.read.format("xml").options(**options).schema(S.PAGE_XML).load(path)


def limited(pages: DataFrame, n: int | None, order: str = "id") -> DataFrame:
    return pages if n is None else pages.orderBy(order).limit(n)


def routed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Article pages and user pages; other namespaces are dropped."""
    return pages.where("ns = 0"), pages.where("ns = 2")


def json_lines(spark: SparkSession, path: str, schema: str, dates: tuple[str, ...] = ()) -> DataFrame:
    df = spark.read.schema(schema).json(path)
    return df.withColumns({c: F.to_date(F.substring(c, 1, 10)) for c in dates}) if dates else df


def csv_verbatim(spark: SparkSession, path: str, schema: str = S.LABELLED, columns: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """The named columns of a CSV with header, in which nothing is missing: an empty field is the empty string, ``NA`` is text.

    Columns are found by name; a file may have more of them. Nothing is inferred: all fields are read as text.
    With ``multi_line`` fields may hold line feeds, and each file is read by one task; without, large files are split.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"', nullValue=NO_NULL, emptyValue="", inferSchema=False)
    wanted = [f for f in S.schema(schema).fields if columns is None or f.name in columns]
    df = raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def csv_with_missing(spark: SparkSession, path: str, schema: str = S.LABELLED, columns: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """The same file, with empty fields and the usual markers as null."""
    df = csv_verbatim(spark, path, schema, columns, multi_line)
    return df.select(*[F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def section_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Files ``oc-*.csv`` without header and quotes, fields parted by a section sign: text, label, file, and ``row_id``.

    A folder ``oc-*.csv`` of part files is one file, its parts in the order of their names.
    ``row_id`` (file, part, block, number) sorts by file name and by place in the file, however Spark deals out files and blocks.
    """
    df = spark.read.text(f"{folder.rstrip('/')}/oc-*.csv")
    parts, part = F.split("value", "§"), F.col("_metadata.file_path")
    file = F.regexp_replace(part, r"(/oc-[^/]*\.csv)/[^/]*$", "$1")
    row = F.struct(file.alias("file"), part.alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return df.select(parts[0].alias("text"), F.try_element_at(parts, F.lit(2)).alias("dialect"), file.alias("file"), row.alias("row_id"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows of :func:`section_csv` with ``place``, the line's number in its file, from 0.

    Lines are numbered where they are read: a block's lines follow one another in one task. Only a row for each block is shuffled and
    broadcast. The files are read twice and dealt out alike both times, as the same table reads them.
    """
    block = ["file", "part", "block"]
    sizes = rows.groupBy(*[F.col(f"row_id.{c}").alias(c) for c in block]).agg(F.min("row_id.n").alias("first"), F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.struct(*block).alias("_block"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_start"))
    own = rows.withColumn("_block", F.struct(*[F.col(f"row_id.{c}").alias(c) for c in block]))
    return own.join(F.broadcast(starts), "_block").withColumn("place", F.col("row_id.n") + F.col("_start")).drop("_block", "_start")


def merged_sections(spark: SparkSession, folders: list[str], left_out: tuple[str, ...] = ("cisaup",)) -> DataFrame:
    """The files of several folders, in order: labels without their spelling, the first of equal rows, then without some varieties."""
    from dialectry.operators.split import keep_first

    out = None
    for k, folder in enumerate(folders):
        rows = section_csv(spark, folder).withColumn("dialect", L.spelling_free_label(F.col("dialect"))).withColumn("row_id", F.struct(F.lit(k).alias("folder"), "row_id"))
        out = rows if out is None else out.unionByName(rows)
    return keep_first(out, ["text", "dialect"]).where(~F.col("dialect").isin(*left_out))


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of CoNLL-U files: sent_id, text and the variety named in the id. An id of another form fails the job."""
    blocks = spark.read.text(path, lineSep="\n\n").where(F.trim("value") != "")
    sent = F.regexp_extract("value", r"(?m)^# sent_id = (.*)$", 1)
    found = F.regexp_extract(sent, r"_([a-z]+)\.conllu\.s\d+", 1)
    label = F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("unexpected sentence id: "), sent)).cast("string"))
    return blocks.select(sent.alias("sent_id"), F.regexp_extract("value", r"(?m)^# text = (.*)$", 1).alias("text"), label.alias("dialect"))


def fasttext_lines(spark: SparkSession, path: str) -> DataFrame:
    """(label, text) of labelled lines; lines without a text are dropped."""
    line = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    pattern = r"(?sU)^(\S+)\s+(.*)$"
    return spark.read.text(path).where(line.rlike(pattern)).select(F.regexp_extract(line, pattern, 1).alias("label"), F.regexp_extract(line, pattern, 2).alias("text"))


def texts_by_variety(spark: SparkSession, path: str) -> DataFrame:
    """Files ``variety/article.txt``: variety, article and text, without the line feed that ends a file."""
    df = spark.read.text(f"{path.rstrip('/')}/*/*.txt", wholetext=True)
    parts = F.split("_metadata.file_path", "/")
    return df.select(F.element_at(parts, -2).alias("variety"), F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("article"), F.regexp_replace("value", r"\n\z", "").alias("text"))


def vectors_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a word-vector text: number (0 for the head, then in word order) and value."""
    head = spark.read.text(f"{path}/0-head.txt").select(F.lit(0).alias("line"), "value")
    words = spark.read.text(f"{path}/part-*")
    return head.unionByName(words.select(F.row_number().over(Window.orderBy(F.substring_index("value", " ", 1))).alias("line"), "value"))


def scores_json(spark: SparkSession, path: str) -> DataFrame:
    """(testset, model, metric, value) of nested scores in one JSON file."""
    nested = "map<string, map<string, map<string, double>>>"
    df = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", nested)).alias("testset", "m"))
    return df.select("testset", F.explode("m").alias("model", "s")).select("testset", "model", F.explode("s").alias("metric", "value"))


def snapshot(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A local Parquet snapshot of a published dataset."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def forum(spark: SparkSession, path: str) -> DataFrame:
    """Forum posts: the author's label as dialect, line feeds as spaces."""
    df = spark.read.schema(S.FORUM).json(path)
    return df.select("id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"), F.col("author_dialect").alias("dialect"))


def accepted_translations(df: DataFrame, language: str = "oci_Latn", least: float = 0.8) -> DataFrame:
    """Target sentences of a parallel corpus whose language score is high enough."""
    return df.where(F.col("target_sentence_lid") >= least).select(F.col(f"translation.{language}").alias("text"))


def labelled_sources(spark: SparkSession, paths: list[str], policy: str = "null") -> DataFrame:
    """Split files of several sources under one label set, in the given order; each source is told by its file's name."""
    out = None
    for k, path in enumerate(paths):
        base = path.rstrip("/").rsplit("/", 1)[-1]
        source = next((s for s in L.SOURCE_SCHEMES if s in base), None)
        if source is None:
            raise ValueError(f"no source is known for {base}")
        mapper = L.SCHEMES[L.SOURCE_SCHEMES[source]]
        df = csv_with_missing(spark, path).select("text", L.map_label(F.col("dialect"), mapper, policy).alias("dialect"), F.lit(source).alias("source"), F.lit(k).alias("source_ord"), F.monotonically_increasing_id().alias("row_id"))
        out = df if out is None else out.unionByName(df)
    return out


def not_yet_written(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not in ``done``: a re-run does only what is missing."""
    return df.join(done.select(key), key, "left_anti")


def first_by_keys(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Insert-or-ignore: for each key in turn only its first row stays."""
    for key in keys:
        df = df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k")
    return df


def updated(df: DataFrame, changes: DataFrame, column: str, key: str = "id") -> DataFrame:
    """``df`` with one column replaced where ``changes`` has the key."""
    new = changes.select(key, F.col(column).alias("_new"), F.lit(True).alias("_has"))
    return df.join(new, key, "left").withColumn(column, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_has")
