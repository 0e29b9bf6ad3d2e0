"""Queries on models, over texts that one marked word tells apart, so that the right answers are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectry.functions import text as X
from dialectry.operators import metrics as M
from dialectry.operators import encoder, models, subword
from dialectry.operators import split as P
from dialectry.plans.registry import documents, query, table
from dialectry.sources.scratch import scratch_path, stored


def marked(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a word of its language among words that say nothing."""
    text = F.concat(F.lit("common word"), (F.col("doc_id") % 5).cast("string"), F.lit(" Mark"), F.col("lang"), F.lit(" tail"), (F.col("doc_id") % 3).cast("string"))
    return documents(spark, d).select(F.col("doc_id").alias("row_id"), text.alias("text"), F.col("lang").alias("dialect"))


def _words_only(rows: DataFrame, **options):
    return models.train(rows, chars=False, tokens=lambda c: F.split(c, " "), max_df=0.95, **options)


def _accuracy(rows: DataFrame):
    return lambda clf: M.scores(clf.predict(rows), "dialect", "label_pred").select("accuracy", "recall_macro").first().asDict()


@query("SELECT doc_id AS row_id, lang AS label_pred FROM documents")
def linear_predict(spark, d):
    rows = marked(spark, d)
    return _words_only(rows).predict(rows).select("row_id", "label_pred")


@query("SELECT lang AS label, 'w_mark' || lang AS term, 1 AS rank FROM documents GROUP BY lang")
def linear_top_feature(spark, d):
    return models.top_features(_words_only(marked(spark, d)), 1).select("label", "term", "rank")


@query("SELECT DISTINCT 'w_mark' || lang AS term FROM documents")
def linear_feature_table(spark, d):
    """The features of the largest total weight: one a label."""
    rows = marked(spark, d)
    clf = _words_only(rows)
    return models.feature_table(clf, len(clf.labels)).select("term")


@query("SELECT count(*) AS n, count(*) AS n_equal, count(DISTINCT lang) AS n_labels FROM documents")
def model_saved(spark, d):
    """A model written, read back, and asked again."""
    rows, path = marked(spark, d), scratch_path(spark, "model")
    _words_only(rows).save(path)
    clf = models.NgramClassifier.load(spark, path, lambda c: F.split(c, " "))
    return clf.predict(rows).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label_pred") == F.col("dialect")).alias("n_equal"), F.count_distinct("label_pred").alias("n_labels"))


@query("""SELECT '{"max_iter": 50}' AS best, fold::INTEGER AS fold, 1.0::DOUBLE AS f1_macro FROM range(2) t(fold)""")
def grid_best(spark, d):
    """The better of two numbers of steps, none and enough, with its folds' scores."""
    best, table = models.grid_search(marked(spark, d), {"max_iter": [0, 50]}, folds=2, chars=False, tokens=lambda c: F.split(c, " "), max_df=0.95)
    return table.where(F.col("params") == str(best).replace("'", '"')).select(F.col("params").alias("best"), "fold", "f1_macro")


@query("SELECT unnest(['accuracy', 'recall_macro']) AS metric, 1.0::DOUBLE AS mean")
def runs_mean(spark, d):
    """Mean scores of two seeded runs."""
    rows = marked(spark, d)
    _, mean, _ = models.train_runs(rows, _accuracy(rows), [1, 2], chars=False, tokens=lambda c: F.split(c, " "), max_df=0.95)
    return spark.createDataFrame(sorted(mean.items()), "metric string, mean double")


@query("SELECT doc_id AS row_id, lang AS label, 0.5::DOUBLE AS score FROM documents")
def batch_predict(spark, d):
    """Any model in batches: here one that reads the mark."""
    return models.predict_in_batches(marked(spark, d), lambda: lambda texts: [(t.split("Mark")[1].split(" ")[0], 0.5) for t in texts]).select("row_id", "label", "score")


@query("SELECT doc_id AS row_id, lang AS label_pred FROM documents")
def list_column_predict(spark, d):
    """Word features from a column of token lists."""
    rows = marked(spark, d).withColumn("tokens", F.split("text", " "))
    return models.train(rows, chars=False, list_col="tokens", max_df=0.95).predict(rows).select("row_id", "label_pred")


@query("SELECT 'lossq-' || coalesce(quality::VARCHAR, '') || '-x_toxi' || coalesce(toxic::VARCHAR, '') AS name, doc_id FROM labels")
def config_name_rows(spark, d):
    """File names of configurations that a table's rows hold."""
    value = F.concat(F.lit(" Q "), F.coalesce(F.col("quality").cast("string"), F.lit("")), F.lit("/X!"))
    return table(spark, d, "labels").select(X.config_name_of(F.create_map(F.lit("toxicity"), F.col("toxic").cast("string"), F.lit("loss function"), value)).alias("name"), "doc_id")


_DRAWN = "('0x' || substr(md5('{0}:' || doc_id), 1, 10))::BIGINT"
FOLDS = f"folds AS (SELECT doc_id, lang, text, ((row_number() OVER (PARTITION BY lang ORDER BY {_DRAWN.format('folds')}, doc_id) - 1) % 3)::INTEGER AS fold FROM documents WHERE lang IS NOT NULL)"


@query(f"WITH {FOLDS} SELECT doc_id, fold FROM folds")
def stratified_folds(spark, d):
    return P.stratified_folds(documents(spark, d), 3, "lang", "doc_id")


@query(f"SELECT 1 AS seed, doc_id FROM documents WHERE {_DRAWN.format(1)} < {int(0.9 * (1 << 40))} UNION ALL SELECT 2, doc_id FROM documents WHERE {_DRAWN.format(2)} < {int(0.9 * (1 << 40))}")
def run_rows(spark, d):
    """The rows that two runs learn from."""
    rows = documents(spark, d).select("doc_id")
    return models.run_rows(rows, 1, doc="doc_id").select(F.lit(1).alias("seed"), "doc_id").unionByName(models.run_rows(rows, 2, doc="doc_id").select(F.lit(2).alias("seed"), "doc_id"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("dialect"))


@query(f"""WITH {FOLDS} SELECT '{{"max_iter": 8}}' AS best, fold, count(*) AS n_held, true AS above_90 FROM folds GROUP BY fold""")
def grid_whole_texts(spark, d):
    """No step against eight, by words of whole texts over three folds: the better, the rows held back, and whether their macro F1 exceeds 0.9."""
    rows = _texts(spark, d)
    best, scores = models.grid_search(rows, {"max_iter": [0, 8]}, folds=3, chars=False)
    held = P.stratified_folds(rows, 3).groupBy("fold").agg(F.count(F.lit(1)).alias("n_held"))
    chosen = scores.where(F.col("params") == str(best).replace("'", '"'))
    return chosen.join(held, "fold").select(F.col("params").alias("best"), "fold", "n_held", (F.col("f1_macro") > 0.9).alias("above_90"))


@query("SELECT lang AS label, count(*) AS n, true AS f1_above_90 FROM documents WHERE doc_id % 3 = 1 AND lang IS NOT NULL GROUP BY 1")
def subword_classifier(spark, d):
    """Whole texts held back, by label, and whether the hierarchical-softmax classifier's F1 there exceeds 0.9."""
    rows = documents(spark, d).where("lang is not null").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("label"), F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "").alias("tokens"))
    held = rows.where("row_id % 3 = 1")
    clf = subword.train_classifier(rows.where("row_id % 3 <> 1"), dim=16, n_epochs=3, passes=12, rate=2.0)
    got = held.select("row_id", F.col("label").alias("ref")).join(clf.predict(held).select("row_id", F.col("label").alias("pred")), "row_id")
    f1 = 2 * F.count_if((F.col("ref") == F.col("label")) & (F.col("pred") == F.col("label"))) / (F.count_if(F.col("ref") == F.col("label")) + F.count_if(F.col("pred") == F.col("label")))
    each = got.select(F.explode(F.array_distinct(F.array("ref", "pred"))).alias("label"), "ref", "pred")
    return each.groupBy("label").agg(F.count_if(F.col("ref") == F.col("label")).alias("n"), (f1 > 0.9).alias("f1_above_90")).where("n > 0")


@query("SELECT doc_id AS row_id, lang AS label_pred FROM documents")
def linear_blocks_predict(spark, d):
    """The linear model with weights as a table."""
    rows = marked(spark, d)
    return models.train_in_blocks(rows, chars=False, tokens=lambda c: F.split(c, " "), max_df=0.95).predict(rows).select("row_id", "label_pred")


@query("SELECT lang AS label, 'w_mark' || lang AS term, 1 AS rank FROM documents GROUP BY lang")
def linear_blocks_top_feature(spark, d):
    rows = marked(spark, d)
    return models.top_features(models.train_in_blocks(rows, chars=False, tokens=lambda c: F.split(c, " "), max_df=0.95), 1).select("label", "term", "rank")


@query("SELECT lang AS label, count(*) AS n, true AS accurate, true AS scored FROM documents WHERE doc_id % 3 = 1 AND lang IS NOT NULL GROUP BY 1")
def encoder_held_out(spark, d):
    """The fine-tuned encoder on whole texts held back: their number by label, whether its accuracy exceeds 0.85, and whether every text has a score and a time."""
    rows = documents(spark, d).where("lang is not null").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("label"), F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "").alias("tokens"))
    held = rows.where("row_id % 3 = 1")
    clf, _ = encoder.fine_tune(rows.where("row_id % 3 = 0"), rows.where("row_id % 3 = 2"), scratch_path(spark, "encoder"), dim=16, hidden=8, n_epochs=3, rate=0.2, passes=6)
    got = held.select("row_id", F.col("label").alias("ref")).join(clf.predict(held).select("row_id", F.col("label").alias("pred"), "score", "runtime"), "row_id")
    ok = (F.col("score") > 0) & (F.col("score") <= 1) & (F.col("runtime") >= 0)
    per = stored(got.groupBy(F.col("ref").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ref") == F.col("pred")).alias("hit"), F.bool_and(ok).alias("scored")), "encoder-held-out")
    hit, n = per.agg(F.sum("hit"), F.sum("n")).first()
    return per.select("label", "n", F.lit(hit / n > 0.85).alias("accurate"), "scored")
