"""Clean texts for articles, and the export projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialectry.functions import text as X
from dialectry.schema import EXPORT_COLUMNS


def clean_texts(samples: DataFrame, wiki: str = "ocwiki", order_col: str | None = None) -> DataFrame:
    """(id, text_clean, date_clean); the last sample of an id wins. An id of another form fails the job."""
    found = F.regexp_extract("id", f"{wiki}/(.*)", 1)
    key = F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("unexpected id: "), F.col("id"))).cast("string")).try_cast("long")
    order = F.col(order_col) if order_col else F.col("date_modified")
    last = F.row_number().over(Window.partitionBy("_id").orderBy(order.desc()))
    return samples.withColumn("_id", key).withColumn("_k", last).where("_k = 1").select(F.col("_id").alias("id"), F.col("text").alias("text_finewiki"), F.col("date_modified").alias("date_modified_finewiki"))


def with_clean_text(articles: DataFrame, clean: DataFrame) -> DataFrame:
    """Left join: articles without a clean text keep null."""
    return articles.join(clean, "id", "left")


def date_audit(enriched: DataFrame) -> DataFrame:
    """Number of matches, and of matches whose dates differ."""
    met = F.col("date_modified_finewiki").isNotNull()
    return enriched.agg(F.count_if(met).alias("matches"), F.count_if(met & ~F.col("date_modified_finewiki").eqNullSafe(F.col("date_latest"))).alias("date_mismatches"))


def export(articles: DataFrame) -> DataFrame:
    """The exported columns in their order: split texts, cut dates, lists instead of joined strings."""
    clean = F.col("text_finewiki")
    pairs = lambda c: F.transform(F.regexp_extract_all(F.col(c), F.lit(r'"([^"]*)": (-?\d+)'), 0), lambda x: F.struct(F.regexp_extract(x, '"([^"]*)"', 1).alias("key"), F.regexp_extract(x, r"(-?\d+)$", 1).cast("long").alias("value")))
    out = articles.withColumns(
        {
            "paragraphs": X.paragraphs(clean),
            "segments": X.segments(clean),
            "date_creation": X.date_part(F.col("date_creation")),
            "date_latest_xml": X.date_part(F.col("date_latest")),
            "date_latest_finewiki": X.date_part(F.col("date_modified_finewiki")),
            "user_dialects": F.when(F.length("user_dialects") > 0, F.split("user_dialects", " ")),
            **{c: pairs(c) for c in ("user_rank_freq", "user_rank_size", "oc_level_rank_freq", "oc_level_rank_size")},
        }
    )
    return out.select(*EXPORT_COLUMNS)
