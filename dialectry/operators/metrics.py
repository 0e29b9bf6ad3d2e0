"""Scores of predictions: confusion, precision, recall and F1 with undefined values as null, and their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OTHER = "other"


def group_other(df: DataFrame, ref: str = "ref", pred: str = "pred", other: str = OTHER) -> DataFrame:
    """Predictions that are no reference label become ``other``."""
    known = df.select(F.col(ref).alias("_known")).distinct()
    joined = df.join(known, F.col(pred) == F.col("_known"), "left")
    return joined.withColumn(pred, F.when(F.col("_known").isNotNull(), F.col(pred)).otherwise(F.lit(other))).drop("_known")


def confusion(df: DataFrame, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """(ref, pred, n); everything below is computed from these few rows."""
    return df.groupBy(F.col(ref).alias("ref"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_percent(df: DataFrame, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """(ref, pred, percent of the reference label's rows)."""
    total = F.sum("n").over(Window.partitionBy("ref"))
    return confusion(df, ref, pred).select("ref", "pred", (F.col("n") / total * 100).alias("percent"))


def confusion_matrix(df: DataFrame, labels: list[str], ref: str = "ref", pred: str = "pred") -> DataFrame:
    return confusion_percent(df, ref, pred).groupBy("ref").pivot("pred", labels).agg(F.first("percent")).fillna(0.0, labels)


def class_scores(df: DataFrame, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """(label, precision, recall, f1) over reference and predicted labels.

    Undefined values are null: precision of a label never predicted, recall of one never referred to. F1 is
    undefined only if both are; a label with either one and no hit has F1 0.
    """
    c = confusion(df, ref, pred)
    hits = c.where("ref = pred").select(F.col("ref").alias("label"), F.col("n").alias("tp"))
    refs = c.groupBy(F.col("ref").alias("label")).agg(F.sum("n").alias("n_ref"))
    preds = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("n_pred"))
    all_ = refs.join(preds, "label", "full_outer").join(hits, "label", "left").fillna(0, ["tp", "n_ref", "n_pred"])
    return all_.select("label", F.try_divide("tp", "n_pred").alias("precision"), F.try_divide("tp", "n_ref").alias("recall"), F.try_divide(F.col("tp") * 2, F.col("n_ref") + F.col("n_pred")).alias("f1"), "n_ref", "n_pred", "tp")


def scores(df: DataFrame, ref: str = "ref", pred: str = "pred", grouped: bool = True) -> DataFrame:
    """Accuracy and macro scores in one row; undefined class values leave the mean."""
    if grouped:
        df = group_other(df, ref, pred)
    per = class_scores(df, ref, pred)
    return per.agg(
        F.avg("f1").alias("f1_macro"),
        (F.sum("tp") / F.sum("n_ref")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
    )


def scores_long(df: DataFrame, testset: str, model: str, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """(testset, model, metric, value): macro scores and those of each label."""
    grouped = group_other(df, ref, pred)
    macro = scores(grouped, ref, pred, grouped=False)
    whole = macro.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in macro.columns))).alias("m")).select("m.*")
    per = class_scores(grouped, ref, pred).select(F.explode(F.array(*(F.struct(F.concat(F.lit(f"{c}_"), F.col("label")).alias("metric"), F.col(c).alias("value")) for c in ("f1", "precision", "recall")))).alias("m")).select("m.*")
    return whole.unionByName(per).select(F.lit(testset).alias("testset"), F.lit(model).alias("model"), "metric", "value")


def evaluate_all(models: dict[str, Callable[[DataFrame], DataFrame]], testsets: dict[str, DataFrame], label: str = "dialect", pred: str = "label_pred", baseline: str | None = "baseline_random") -> DataFrame:
    """(testset, model, metric, value) of every model on every test set, the random baseline's macro scores among them.

    A model is a function that adds its predictions to a test set.
    """
    out = None
    for name, rows in testsets.items():
        parts = [scores_long(f(rows), name, model, label, pred) for model, f in models.items()]
        if baseline:
            macro = random_baseline_macro(rows, label)
            each = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in macro.columns)))
            parts.append(macro.select(each.alias("m")).select(F.lit(name).alias("testset"), F.lit(baseline).alias("model"), "m.metric", "m.value"))
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out


def random_baseline(df: DataFrame, label: str = "dialect") -> DataFrame:
    """Expected scores of a uniform random prediction, per label."""
    per = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    p, r = F.col("n") / F.sum("n").over(every), F.lit(1.0) / F.count(F.lit(1)).over(every)
    out = per.select("label", p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def random_baseline_macro(df: DataFrame, label: str = "dialect") -> DataFrame:
    return random_baseline(df, label).agg(F.avg("f1").alias("f1_macro"), F.first("recall").alias("accuracy"), F.avg("precision").alias("precision_macro"), F.first("recall").alias("recall_macro"))


def best_per_testset(long: DataFrame, metric: str, models: str | None = None, exact: bool = True) -> DataFrame:
    """The best model of each test set; the first name wins ties. ``models`` selects one name, or names that contain it."""
    rows = long.where(F.col("metric") == metric)
    if models is not None:
        rows = rows.where(F.col("model") == models if exact else F.col("model").contains(models))
    k = F.row_number().over(Window.partitionBy("testset").orderBy(F.desc_nulls_last("value"), "model"))
    return rows.withColumn("_k", k).where("_k = 1").drop("_k")


def mean_std(long: DataFrame, by: str = "model") -> DataFrame:
    """Mean and sample deviation over test sets, undefined values left out."""
    return long.groupBy(by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def metric_matrix(long: DataFrame, metric: str, testsets: list[str]) -> DataFrame:
    """Percent of a metric by model and test set; missing is null."""
    return long.where(F.col("metric") == metric).groupBy("model").pivot("testset", testsets).agg(F.first("value") * 100)


def report_row(long: DataFrame, testset: str, model: str, labels: list[str], prefix: str = "f1_") -> DataFrame:
    """One model's scores on one test set, one column a label."""
    wanted = [prefix + x for x in labels]
    return long.where((F.col("testset") == testset) & (F.col("model") == model)).groupBy("testset", "model").pivot("metric", wanted).agg(F.first("value") * 100)


def runtime_summary(df: DataFrame) -> DataFrame:
    """Mean and sample deviation of predictions' scores and run times."""
    return df.agg(F.avg("score").alias("score_mean"), F.stddev_samp("score").alias("score_std"), F.avg("runtime").alias("runtime_mean"), F.stddev_samp("runtime").alias("runtime_std"))
