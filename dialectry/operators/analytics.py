"""Descriptive statistics of a labelled corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialectry.functions import text as X


def distribution(df: DataFrame, label: str = "dialect", text: str = "text") -> DataFrame:
    """Texts and tokens per label, in one pass."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_texts"), F.sum(X.token_count(F.col(text))).alias("n_tokens")).orderBy(F.desc("n_tokens"), label)


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and interpolated quartiles of a numeric column."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q.alias("_q"), F.max(value).alias("max"))
    return out.select("count", "mean", "std", "min", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "max")


def value_counts(df: DataFrame, col: str, keep_null: bool = False, share: bool = False) -> DataFrame:
    rows = df if keep_null else df.where(F.col(col).isNotNull())
    out = rows.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return out.select(col, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share")) if share else out


def share_of(df: DataFrame, condition: Column, name: str = "share") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(condition).alias("n_true"), F.avg(F.coalesce(condition, F.lit(False)).cast("int")).alias(name))


def active_users(people: DataFrame, contribs: DataFrame, key: str = "user_id") -> DataFrame:
    """Users with a contribution."""
    return people.join(contribs.where(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct(), "id", "left_semi")


def bot_share(contribs: DataFrame, people: DataFrame, min_diff: int | None = None, key: str = "user_id") -> DataFrame:
    """Contributions, those of bots, and their share; a ``min_diff`` of 0 or none means no filter."""
    rows = contribs.where(F.col("diff_bytes") > min_diff) if min_diff else contribs
    bots = people.where("is_bot = 1").select(F.col("id").alias("_bot")).distinct()
    met = rows.join(bots, F.col(key) == F.col("_bot"), "left")
    return met.agg(F.count(F.lit(1)).alias("n"), F.count("_bot").alias("n_bot"), F.try_divide(F.count("_bot"), F.count(F.lit(1))).alias("bot_share"))


def variety_match(articles: DataFrame, people: DataFrame, label: str = "dialect") -> DataFrame:
    """Per label: articles, those with a contributor of the same variety, their percentage, and users of the variety."""
    own = F.array_contains(F.split("user_dialects", " "), F.col(label))
    per = articles.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("n_match"))
    users = people.where("dialect is not null").groupBy(F.col("dialect").alias("_d")).agg(F.count(F.lit(1)).alias("n_users"))
    out = per.withColumn("percent", F.bround(100 * F.col("n_match") / F.col("n"), 2)).join(users, F.col(label) == F.col("_d"), "left").drop("_d")
    return out.fillna(0, ["n_users"])


def level_counts(articles: DataFrame) -> DataFrame:
    """Articles by first and by highest level; missing counts are 0."""
    first = articles.where("oc_level_first is not null").groupBy(F.col("oc_level_first").alias("level")).agg(F.count(F.lit(1)).alias("n_first"))
    top = articles.where("oc_level_max is not null").groupBy(F.col("oc_level_max").alias("level")).agg(F.count(F.lit(1)).alias("n_max"))
    return first.join(top, "level", "full_outer").fillna(0, ["n_first", "n_max"])


def level_gain(articles: DataFrame) -> DataFrame:
    """Median of highest minus first level, by first level."""
    diff = X.level_number(F.col("oc_level_max")) - X.level_number(F.col("oc_level_first"))
    return articles.groupBy("oc_level_first").agg(F.median(diff.cast("double")).alias("median_diff"))


def sample_at(df: DataFrame, position: int, label: str = "dialect", order: str = "row_id") -> DataFrame:
    """The row at a position of each label, the last one if there are fewer.

    Ranks beyond the position are cut before the shuffle; the rest of the row is joined back by order.
    """
    slim = df.select(F.col(label).alias("_l"), F.col(order).alias("_o"))
    first = slim.withColumn("_k", F.row_number().over(Window.partitionBy("_l").orderBy("_o"))).where(F.col("_k") <= position + 1)
    taken = first.groupBy("_l").agg(F.max_by("_o", "_k").alias("_o"))
    return df.join(taken.select("_o"), F.col(order) == F.col("_o"), "left_semi")
