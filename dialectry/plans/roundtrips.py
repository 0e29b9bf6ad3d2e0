"""Queries on sources and sinks: a table is written through a writer into the scratch folder and read back through a reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectry.functions import labels as L
from dialectry.functions import text as X
from dialectry.operators import split as P
from dialectry.plans.registry import documents, query, table
from dialectry.sources import readers as R
from dialectry.sources import writers as K
from dialectry.sources.scratch import scratch_path

FIELDS = "row_id long, text string, dialect string"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with fields that a careless reader takes for missing: empty, NA, quotes."""
    k = F.col("doc_id") % 7
    text = F.when(k == 0, "").when(k == 1, "NA").when(k == 2, F.concat(F.lit('say "'), F.col("lang"), F.lit('", '), F.col("text"))).otherwise(F.col("text"))
    return documents(spark, d).select(F.col("doc_id").alias("row_id"), text.alias("text"), F.col("lang").alias("dialect"))


TEXT = "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN 'say \"' || lang || '\", ' || text ELSE text END"


def _splits(spark: SparkSession, d: str, name: str) -> str:
    """CSV splits, ``dev`` for every third row; the base folder."""
    path = scratch_path(spark, name)
    K.csv_splits(labelled(spark, d).withColumn("split", F.when(F.col("row_id") % 3 == 0, "dev").otherwise("train")), path)
    return path


@query(f"SELECT doc_id AS row_id, {TEXT} AS text, lang AS dialect FROM documents WHERE doc_id % 3 = 0")
def csv_verbatim(spark, d):
    return R.csv_verbatim(spark, f"{_splits(spark, d, 'csv')}/dev.csv", FIELDS)


@query(f"SELECT doc_id AS row_id, nullif(nullif({TEXT}, ''), 'NA') AS text, lang AS dialect FROM documents")
def csv_with_missing(spark, d):
    return R.csv_with_missing(spark, f"{_splits(spark, d, 'csv')}/full.csv", FIELDS)


@query(f"SELECT doc_id AS row_id, {TEXT} AS text FROM documents WHERE doc_id % 3 <> 0")
def csv_some_columns(spark, d):
    return R.csv_verbatim(spark, f"{_splits(spark, d, 'csv')}/train.csv", FIELDS, ["row_id", "text"])


@query("""WITH s AS (
  SELECT 0 AS source_ord, 'wiki' AS source, text, CASE lang WHEN 'fr' THEN 'gas' WHEN 'es' THEN 'lim' END AS dialect FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT 1, 'ttb', text, CASE lang WHEN 'fr' THEN 'gas' WHEN 'de' THEN 'lim' END FROM documents WHERE doc_id % 2 = 1
) SELECT source_ord, source, text, dialect, count(*) AS n FROM s GROUP BY ALL""")
def concat_sources(spark, d):
    """Two sources with their own labels under one label set; the third label of each is unknown there."""
    named = F.when(F.col("lang") == "fr", "gascon").when(F.col("lang") == "es", "lemosin").when(F.col("lang") == "de", "limousin").otherwise("other")
    rows, paths = documents(spark, d).select("doc_id", "text", named.alias("dialect")), []
    for k, name in enumerate(("wiki-train", "ttb-train")):
        paths.append(scratch_path(spark, "sources") + f"/{name}.csv")
        K.csv_file(rows.where(F.col("doc_id") % 2 == k).select("text", "dialect"), paths[-1])
    return R.labelled_sources(spark, paths).groupBy("source_ord", "source", "text", "dialect").agg(F.count(F.lit(1)).alias("n"))


SECTION = """f AS (
  SELECT CASE doc_id % 3 WHEN 0 THEN 'oc-b.csv' WHEN 1 THEN 'oc-a.csv' ELSE 'oc-c.csv' END AS file, doc_id, replace(text, chr(10), ' ') AS text, 'OC-' || CASE lang WHEN 'fr' THEN 'gascon' WHEN 'es' THEN 'lemosin' WHEN 'de' THEN 'cisaup' ELSE 'aranes' END || CASE WHEN doc_id % 2 = 0 THEN '-grclass' ELSE '-grmistr' END AS label FROM documents
)"""


def _section_files(spark: SparkSession, d: str) -> str:
    k, lang = F.col("doc_id") % 3, F.col("lang")
    variety = F.when(lang == "fr", "gascon").when(lang == "es", "lemosin").when(lang == "de", "cisaup").otherwise("aranes")
    label = F.concat(F.lit("OC-"), variety, F.when(F.col("doc_id") % 2 == 0, "-grclass").otherwise("-grmistr"))
    base = scratch_path(spark, "section")
    for n, name in enumerate("bac"):
        rows = documents(spark, d).where(k == n).orderBy("doc_id")
        K.text_parts(rows.select(F.concat_ws("§", F.replace("text", F.lit("\n"), F.lit(" ")), label, F.lit("x")).alias("value")), f"{base}/oc-{name}.csv")
    return base


@query(f"WITH {SECTION} SELECT text, label AS dialect, file, row_number() OVER (PARTITION BY file ORDER BY doc_id) - 1 AS place FROM f")
def section_csv(spark, d):
    """Lines keep their place in each file, however files are dealt out."""
    rows = R.placed(R.section_csv(spark, _section_files(spark, d)))
    return rows.select("text", "dialect", F.substring_index("file", "/", -1).alias("file"), F.col("place").cast("int").alias("place"))


@query(f"""WITH {SECTION}, m AS (SELECT *, regexp_extract(label, '^OC-([a-z]+)-gr', 1) AS dialect FROM f)
SELECT text, dialect, file FROM m WHERE dialect <> 'cisaup' QUALIFY row_number() OVER (PARTITION BY text, dialect ORDER BY file, doc_id) = 1""")
def merge_folders(spark, d):
    """One folder's files under one label each, first of equal rows, without a variety that is left out."""
    return R.merged_sections(spark, [_section_files(spark, d)]).select("text", "dialect", F.substring_index("file", "/", -1).alias("file"))


@query(r"SELECT 'f_' || replace(replace(lang, 'en', 'gascon'), 'fr', 'limousin') || '.conllu.s' || doc_id AS sent_id, regexp_replace(text, '\s+', ' ', 'g') AS text, replace(replace(lang, 'en', 'gascon'), 'fr', 'limousin') AS dialect FROM documents")
def conllu(spark, d):
    name = F.replace(F.replace("lang", F.lit("en"), F.lit("gascon")), F.lit("fr"), F.lit("limousin"))
    block = F.concat(F.lit("# sent_id = f_"), name, F.lit(".conllu.s"), F.col("doc_id").cast("string"), F.lit("\n# text = "), X.normalise_spaces(F.col("text")), F.lit("\n1\tx\n"))
    path = scratch_path(spark, "conllu")
    documents(spark, d).select(block.alias("value")).write.text(path)
    return R.conllu(spark, path)


@query(r"""SELECT '__label__' || CASE lang WHEN 'fr' THEN 'gas' WHEN 'es' THEN 'lim' WHEN 'de' THEN 'ara' ELSE 'lan' END AS label, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, CASE lang WHEN 'fr' THEN 'gas' WHEN 'es' THEN 'lim' WHEN 'de' THEN 'ara' ELSE 'lan' END AS dialect FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''""")
def labelled_lines(spark, d):
    """Labelled lines written under a label scheme, read back and stripped of their prefix."""
    path = scratch_path(spark, "lines")
    mapper = {"fr": "gas", "es": "lim", "de": "ara", "en": "lan"}
    K.fasttext_lines(documents(spark, d).select(X.normalise_spaces(F.col("text")).alias("text"), F.col("lang").alias("dialect")), path, mapper)
    return R.fasttext_lines(spark, path).withColumn("dialect", L.strip_prefix(F.col("label")))


@query(r"SELECT regexp_replace(text, '\s+', ' ', 'g') AS value, count(*) AS n FROM conversations GROUP BY 1")
def one_line_texts(spark, d):
    path = scratch_path(spark, "texts")
    K.one_line_texts(table(spark, d, "conversations"), path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id::VARCHAR AS id, replace(text, chr(10), ' ') AS text, CASE WHEN doc_id % 5 > 0 THEN lang END AS dialect FROM documents")
def forum_posts(spark, d):
    path = scratch_path(spark, "forum")
    K.json_lines(documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), "text", F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("author_dialect"), "source"), path)
    return R.forum(spark, path)


@query("SELECT o_orderkey, o_orderdate::DATE AS day, nullif(o_orderpriority, '5-LOW') AS priority FROM orders")
def json_lines(spark, d):
    path = scratch_path(spark, "json")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    K.json_lines(table(spark, d, "orders").select("o_orderkey", day.alias("day"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")), path)
    return R.json_lines(spark, path, "o_orderkey long, day string, priority string", ("day",))


@query("SELECT CASE WHEN item_id % 2 = 0 THEN 'nicard' ELSE 'gascon' END AS variety, 'page-' || item_id AS article, text FROM benchmark WHERE item_id % 5 <> 3")
def texts_by_variety(spark, d):
    """One file an article, ``variety/article.txt``, read back with the names from the path; a missing text makes no file."""
    items, key = table(spark, d, "benchmark"), F.col("item_id")
    path = scratch_path(spark, "articles")
    text = F.when(key % 5 != 3, F.col("text"))
    K.texts_by_variety(items.select(key.alias("id"), text.alias("text_finewiki"), F.when(key % 2 == 0, "Niçard").otherwise("gascon").alias("dialect"), F.concat(F.lit("page-"), key.cast("string")).alias("title_slugify")), path)
    return R.texts_by_variety(spark, path)


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def field_update(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return R.updated(c, c.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("new")), "c_mktsegment", "c_custkey")


@query("""WITH a AS (SELECT event_id, user_id, value::VARCHAR AS v FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
SELECT event_id, user_id, v FROM a QUALIFY row_number() OVER (PARTITION BY left(v, 2) ORDER BY event_id) = 1""")
def insert_or_ignore(spark, d):
    """The first row of each user, then the first of each key among these."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("value").cast("string").alias("v")).withColumn("key", F.substring("v", 1, 2))
    return R.first_by_keys(e, ["user_id", "key"], F.col("event_id")).drop("key")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0")
def skip_existing(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return R.not_yet_written(o, o.where("o_orderkey % 4 = 0"), "o_orderkey")


@query("SELECT text, count(*) AS n FROM conversations WHERE (conv_id % 10) / 10.0 >= 0.8 GROUP BY 1")
def lid_threshold(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") % 10 / 10).alias("target_sentence_lid"), F.struct(F.col("text").alias("oci_Latn")).alias("translation"))
    return R.accepted_translations(c).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang FROM documents")
def parquet_snapshot(spark, d):
    return R.snapshot(spark, f"{d}/documents.parquet", ["doc_id", "lang"])


@query("WITH s AS (SELECT source AS testset, lang AS model, count(*) / 100.0 AS value FROM documents GROUP BY ALL) SELECT testset, model, 'n' AS metric, value::DOUBLE AS value FROM s")
def scores_json(spark, d):
    path = scratch_path(spark, "scores")
    K.scores_json(documents(spark, d).groupBy(F.col("source").alias("testset"), F.col("lang").alias("model")).agg((F.count(F.lit(1)) / 100.0).cast("double").alias("value")).withColumn("metric", F.lit("n")), path)
    return R.scores_json(spark, path)


@query("""SELECT 0 AS line, '4 2' AS value UNION ALL
SELECT row_number() OVER (ORDER BY lang), lang || ' ' || (count(*) / 4)::DOUBLE || ' ' || (count(*) / -8)::DOUBLE FROM documents GROUP BY lang""")
def word_vectors(spark, d):
    """Four words with vectors, written as one header and their lines; lines are numbered by word."""
    path = scratch_path(spark, "vectors")
    n = F.count(F.lit(1))
    K.vectors_text(documents(spark, d).groupBy(F.col("lang").alias("word")).agg(F.array(n / 4, n / -8).alias("vector")), path)
    return R.vectors_text(spark, path)


@query(f"SELECT doc_id AS row_id, {TEXT} AS text, lang AS dialect, CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents")
def csv_splits(spark, d):
    """Both splits, read back from their own files."""
    path = _splits(spark, d, "csv")
    parts = [R.csv_verbatim(spark, f"{path}/{s}.csv", FIELDS).withColumn("split", F.lit(s)) for s in ("dev", "train")]
    return parts[0].unionByName(parts[1])


@query("SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS line FROM documents WHERE text <> ''")
def unit_rows(spark, d):
    rows = documents(spark, d).select("doc_id", "text")
    return P.expand_units(rows, F.filter(F.split("text", "\n"), lambda x: x != ""), collapse=False).select("doc_id", F.col("text").alias("line"))
