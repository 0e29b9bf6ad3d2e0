"""Linear classifiers over n-gram features, their selection and inspection, and hooks for other models.

The linear model has squared hinge loss and is trained one against the rest (:mod:`linear`).
"""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, Word2Vec
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialectry.functions import text as X
from dialectry.operators import features as feat
from dialectry.operators import linear, linear_blocks
from dialectry.operators import metrics as M
from dialectry.operators import split as P
from dialectry.sources.scratch import discard, stored


@dataclass
class NgramClassifier:
    """A fitted feature space and its linear model: weights by feature and label, the bias in the last row."""

    weights_: np.ndarray
    labels: list[str]
    words: DataFrame | None
    chars: DataFrame | None
    terms: DataFrame
    tokens: Callable = X.tokenize
    list_col: str | None = None

    def features(self, df: DataFrame, text: str = "text", doc: str = "row_id") -> DataFrame:
        """(doc, indices, values) of texts in the fitted space."""
        return _indexed(df, self._blocks(text), self.terms, doc)

    def predict(self, df: DataFrame, text: str = "text", doc: str = "row_id") -> DataFrame:
        """``df`` with ``label_pred``; a text without a known feature gets the label of the largest bias, to nine digits, the first of equal ones."""
        return self.predict_each(df, [self.weights_], text, doc).withColumn("label_pred", F.col("preds")[0]).drop("preds")

    def predict_each(self, df: DataFrame, weights: list[np.ndarray], text: str = "text", doc: str = "row_id") -> DataFrame:
        """``df`` with ``preds``, the labels by several models over the same features, as :meth:`predict` gives them."""
        names, k = F.array(*map(F.lit, self.labels)), len(self.labels)
        whole = np.concatenate(weights, axis=1)
        parts = [feat.linear_scores(df, grams, _numbered(fitted, self.terms, kind), whole, doc) for kind, (fitted, grams) in self._blocks(text).items() if fitted is not None]
        sums = parts[0] if len(parts) < 2 else parts[0].unionByName(parts[1]).groupBy(doc).agg(*(F.sum(F.col("scores")[x]).alias(f"s{x}") for x in range(whole.shape[1])))
        score = (lambda x: F.col("scores")[x]) if len(parts) < 2 else (lambda x: F.col(f"s{x}"))
        best, default = [], []
        for w, at in zip(weights, range(0, whole.shape[1], k)):
            scores = F.array(*(score(at + x) + F.lit(float(np.float32(w[-1, x]))) for x in range(k)))
            best.append(_bound(scores, lambda s: F.array_position(s, F.array_max(s)).cast("int")))
            default.append(F.lit(int(w[-1].round(9).argmax()) + 1))
        got = sums.select(doc, F.array(*best).alias("_best"))
        return df.join(got, doc, "left").withColumn("preds", F.array(*(F.element_at(names, F.coalesce(F.col("_best")[x], d)) for x, d in enumerate(default)))).drop("_best")

    def _blocks(self, text: str) -> dict:
        own = F.col(self.list_col) if self.list_col else self.tokens(F.lower(text))
        return {"w": (self.words, own), "c": (self.chars, feat.CharGrams(F.col(text)))}

    def predict_list(self, spark, texts: list[str]) -> list[str]:
        rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
        return [r["label_pred"] for r in self.predict(rows).orderBy("row_id").collect()]

    def _numbers(self, spark: SparkSession) -> DataFrame:
        columns = {"idx": pa.array(np.arange(len(self.weights_), dtype=np.int32))} | {f"w{k}": pa.array(self.weights_[:, k]) for k in range(len(self.labels))}
        return spark.createDataFrame(pa.table(columns))

    def save(self, path: str) -> None:
        """Weights, vocabularies and labels as a folder that any executor can read."""
        spark = self.terms.sparkSession
        for name, df in (("words", self.words), ("chars", self.chars), ("terms", self.terms), ("weights", self._numbers(spark))):
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        meta = [(k, x, self.words is not None, self.chars is not None, self.list_col) for k, x in enumerate(self.labels)]
        spark.createDataFrame(meta, "k int, label string, words boolean, chars boolean, list_col string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark, path: str, tokens: Callable = X.tokenize) -> NgramClassifier:
        meta = spark.read.parquet(f"{path}/meta").orderBy("k").collect()
        part = lambda name: spark.read.parquet(f"{path}/{name}")
        numbers = part("weights").orderBy("idx").toArrow()
        w = np.stack([numbers.column(f"w{k}").to_numpy() for k in range(len(meta))], axis=1)
        m = meta[0]
        return NgramClassifier(w, [r["label"] for r in meta], part("words") if m["words"] else None, part("chars") if m["chars"] else None, part("terms"), tokens, m["list_col"])

    def weights(self) -> DataFrame:
        """(term, label, weight) of every feature."""
        pairs = F.array(*(F.struct(F.lit(x).alias("label"), F.col(f"w{k}").alias("weight")) for k, x in enumerate(self.labels)))
        return self.terms.join(self._numbers(self.terms.sparkSession), "idx").select("term", F.explode(pairs).alias("p")).select("term", "p.label", "p.weight")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def _numbered(fitted: DataFrame, terms: DataFrame, kind: str) -> DataFrame:
    """(term, idf, idx) of a fitted vocabulary."""
    named = fitted.withColumn("_name", X.feature_name(F.col("term"), kind))
    return named.join(terms.withColumnRenamed("term", "_name"), "_name").select("term", "idf", "idx")


def _indexed(df: DataFrame, blocks: dict, terms: DataFrame, doc: str) -> DataFrame:
    """(doc, indices, values) of the blocks side by side; a block has its kind, fitted vocabulary (or none) and n-grams."""
    parts = []
    for kind, (fitted, grams) in blocks.items():
        if fitted is not None:
            parts.append(feat.indexed_tf_idf(df, grams, _numbered(fitted, terms, kind), doc))
    if len(parts) < 2:
        return parts[0]
    return parts[0].unionByName(parts[1]).groupBy(doc).agg(F.flatten(F.collect_list("indices")).alias("indices"), F.flatten(F.collect_list("values")).alias("values"))


def _numbered_labels(df: DataFrame, label: str) -> tuple[Column, list[str], list[int]]:
    """The number of a row's label from 0, the labels by number, and their rows."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    names = sorted(counts)
    number = F.array_position(F.array(*map(F.lit, names)), F.col(label)) - 1
    return number.cast("int"), names, [counts[x] for x in names]


def _terms(fitted: dict, doc: str) -> DataFrame:
    return stored(feat.numbered_terms(feat.union_features({k: v.withColumns({doc: F.lit(0), "weight": F.lit(0.0)}) for k, v in fitted.items() if v is not None}, doc)), "terms")


def prepare(df: DataFrame, text: str = "text", label: str = "dialect", doc: str = "row_id", words: bool = True, chars: bool = True, min_df: int = 2, max_df: float = 0.9, tokens: Callable = X.tokenize, list_col: str | None = None):
    """The fitted feature space (words, chars, terms), the labelled sparse rows, the label names and their counts; all tables are stored.

    The texts are stored too, as they are read several times.
    """
    df = stored(df.where(F.col(label).isNotNull()), "texts")
    n = df.count()
    own = F.col(list_col) if list_col else tokens(F.lower(text))
    grams = {"w": own if words else None, "c": feat.CharGrams(F.col(text)) if chars else None}
    fitted = {kind: None if g is None else stored(feat.vocabulary(df, g, n, min_df, max_df), f"vocabulary-{kind}") for kind, g in grams.items()}
    terms = _terms(fitted, doc)
    number, names, counts = _numbered_labels(df, label)
    cells = _indexed(df, {k: (fitted[k], g) for k, g in grams.items()}, terms, doc)
    rows = df.select(doc, number.alias("label")).join(cells, doc, "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    ready = stored(rows.select("label", empty("indices", "int"), empty("values", "double")), "rows", "zstd")
    discard(df)
    return (fitted["w"], fitted["c"], terms), ready, names, counts


def prepare_cells(df: DataFrame, text: str = "text", label: str = "dialect", doc: str = "row_id", words: bool = True, chars: bool = True, min_df: int = 2, max_df: float = 0.9, tokens: Callable = X.tokenize, list_col: str | None = None) -> tuple[tuple, linear.Cells, list[str], list[int]]:
    """As :func:`prepare`, with the cells by feature instead of rows: a document's cells are packed where they are counted, and words' and characters' are never brought together."""
    df = stored(df.where(F.col(label).isNotNull()).select(*(x for x in df.columns if x in (doc, text, label, list_col))), "texts")
    number, names, counts = _numbered_labels(df, label)
    own = F.col(list_col) if list_col else tokens(F.lower(text))
    every = {k: feat.Slices(df.withColumn("_label", number), g, doc) for k, g in (("w", own if words else None), ("c", feat.CharGrams(F.col(text)) if chars else None)) if g is not None}
    found, fitted = {}, {"w": None, "c": None}
    for kind, slices in every.items():
        slices.deal(max(x.n for x in every.values()))  # rows are numbered by slice, alike for all kinds
        found[kind] = stored(slices.terms(), f"terms-{kind}", "zstd")
        fitted[kind] = stored(feat._with_idf(found[kind].groupBy("term").agg(F.sum("n").alias("df")), slices.rows, min_df, max_df), f"vocabulary-{kind}")
    terms = _terms(fitted, doc)
    sizes = dict(sorted((r[0], r[1]) for r in slices.dealt.groupBy("_slice").count().collect()))
    offsets = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist()))
    parts, base, kept = [], 0, [df, *found.values()]
    for k, (kind, slices) in enumerate(every.items()):
        n_blocks = linear.blocks_for(fitted[kind].agg(F.sum("df")).first()[0] or 0)
        numbered = stored(_numbered(fitted[kind], terms, kind), "numbered")
        kept.append(numbered)
        known = feat._looked_up(slices, numbered, found[kind]).select("_slice", "term", F.col("idf").alias("value"), "idx")
        parts += [slices.cells(known, "_label", k, base, n_blocks, offsets), numbered.select((F.lit(base) + F.col("idx") % n_blocks).alias("block"), F.lit(k).alias("kind"), "idx", F.col("idf").alias("scale"))]
        base += n_blocks
    pieces = parts[0]
    for p in parts[1:]:
        pieces = pieces.unionByName(p, allowMissingColumns=True)
    cells = linear.Cells.stored(pieces, base, sum(counts))
    discard(*kept)
    return (fitted["w"], fitted["c"], terms), cells, names, counts


def train(df: DataFrame, text: str = "text", label: str = "dialect", doc: str = "row_id", words: bool = True, chars: bool = True, max_iter: int = 2000, c: float = 1.0, min_df: int = 2, max_df: float = 0.9, tokens: Callable = X.tokenize, list_col: str | None = None, balanced: bool = True) -> NgramClassifier:
    """Fit word and character features and a balanced one-against-rest linear model.

    With ``list_col`` the word features come from that column of token lists.
    """
    (w_terms, c_terms, terms), cells, names, counts = prepare_cells(df, text, label, doc, words, chars, min_df, max_df, tokens, list_col)
    w = linear.fit(cells, terms.count(), counts, c, balanced, max_iter)
    discard(cells.blocks)
    return NgramClassifier(w, names, w_terms, c_terms, terms, tokens, list_col)


@dataclass
class TableClassifier(NgramClassifier):
    """A linear model whose weights are a table (idx, label number, weight), the bias at the number of features."""

    table: DataFrame | None = None

    def predict(self, df: DataFrame, text: str = "text", doc: str = "row_id") -> DataFrame:
        names, size = F.array(*map(F.lit, self.labels)), self.terms.count()
        got = linear_blocks.predict(self.features(df, text, doc), self.table, size, doc)
        bias = {r["label"]: r["weight"] for r in self.table.where(F.col("idx") == size).collect()}
        default = max(range(len(self.labels)), key=lambda k: (round(bias.get(k, 0.0), 9), -k))
        return df.join(got, doc, "left").withColumn("label_pred", F.element_at(names, F.coalesce("best", F.lit(default)) + 1)).drop("best")

    def weights(self) -> DataFrame:
        names = F.array(*map(F.lit, self.labels))
        return self.terms.join(self.table.withColumnRenamed("label", "_k"), "idx").select("term", F.element_at(names, F.col("_k") + 1).alias("label"), "weight")

    def save(self, path: str) -> None:
        raise NotImplementedError("write the tables themselves")


def train_in_blocks(df: DataFrame, text: str = "text", label: str = "dialect", doc: str = "row_id", words: bool = True, chars: bool = True, max_iter: int = 2000, c: float = 1.0, min_df: int = 2, max_df: float = 0.9, tokens: Callable = X.tokenize, list_col: str | None = None, balanced: bool = True) -> TableClassifier:
    """:func:`train`, for vocabularies whose weights no single process should hold."""
    (w_terms, c_terms, terms), rows, names, counts = prepare(df, text, label, doc, words, chars, min_df, max_df, tokens, list_col)
    table = linear_blocks.fit(rows, terms.count(), counts, c, balanced, max_iter)
    discard(rows)
    return TableClassifier(np.zeros((0, len(names))), names, w_terms, c_terms, terms, tokens, list_col, table)


def top_features(clf: NgramClassifier, n: int = 20) -> DataFrame:
    """The n features with the largest weight of each label, with their rank."""
    k = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("weight"), "term"))
    return clf.weights().withColumn("rank", k).where(F.col("rank") <= n)


def feature_table(clf: NgramClassifier, n: int) -> DataFrame:
    """The n features with the largest total of absolute weights, one column per label."""
    wide = clf.weights().groupBy("term").pivot("label", clf.labels).agg(F.first("weight"))
    total = sum((F.abs(F.col(f"`{x}`")) for x in clf.labels), F.lit(0.0))
    return wide.withColumn("weight_total_absolute", total).orderBy(F.desc("weight_total_absolute"), "term").limit(n)


def run_rows(df: DataFrame, seed: int, share: float = 0.9, doc: str = "row_id") -> DataFrame:
    """The ``share`` of the rows that a run's seed draws, by a hash."""
    return df.where(P.drawn(str(seed), F.col(doc)) < int(share * (1 << 40)))


def train_runs(df: DataFrame, evaluate: Callable[[NgramClassifier], dict[str, float]], seeds: list[int], best_on: str = "recall_macro", share: float = 0.9, doc: str = "row_id", **options) -> tuple[NgramClassifier, dict[str, float], int]:
    """Train once per seed; the best model, the mean scores and the best seed.

    The solver is deterministic, so a seed draws the run's own ``share`` of the rows by a hash.
    """
    runs = []
    for seed in seeds:
        clf = train(run_rows(df, seed, share, doc), doc=doc, **options)
        runs.append((seed, clf, evaluate(clf)))
    seed, clf, _ = max(runs, key=lambda r: r[2][best_on])
    names = runs[0][2].keys()
    return clf, {k: sum(r[2][k] for r in runs) / len(runs) for k in names}, seed


def grid_search(df: DataFrame, grid: dict[str, list], folds: int = 5, label: str = "dialect", doc: str = "row_id", **options) -> tuple[dict, DataFrame]:
    """The parameters with the best mean macro F1 over stratified folds, and (params, fold, f1_macro) of all; nothing is refitted.

    Parameters of the solver (``c``, ``balanced``, ``max_iter``) share the features of a fold.
    """
    fold = P.stratified_folds(df, folds, label, doc).select(F.col(doc).alias("_doc"), F.col("fold").alias("_fold"))
    rows = stored(df.join(fold, F.col(doc) == F.col("_doc")).drop("_doc"), "folds")
    combos = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    spark, got = df.sparkSession, []
    for k in range(folds):
        space, cells, names, counts = prepare_cells(rows.where(F.col("_fold") != k), label=label, doc=doc, **options)
        held, size = rows.where(F.col("_fold") == k), space[2].count()
        weights = [linear.fit(cells, size, counts, **p) for p in combos]
        clf = NgramClassifier(weights[0], names, *space, **{x: options[x] for x in ("tokens", "list_col") if x in options})
        # held rows are scored once for all parameters
        preds = stored(clf.predict_each(held, weights, doc=doc).select(label, "preds"), "preds")
        for x, p in enumerate(combos):
            f1 = M.scores(preds.withColumn("label_pred", F.col("preds")[x]), label, "label_pred").first()["f1_macro"]
            got.append((json.dumps(p, sort_keys=True), k, float(f1)))
        discard(cells.blocks, preds)
    table = spark.createDataFrame(got, "params string, fold int, f1_macro double")
    mean = {p: sum(f for q, _, f in got if q == p) for p, _, _ in got}
    return json.loads(max(mean, key=mean.get)), table


def subword_tokens(tokens: Column, low: int = 3, high: int = 6) -> Column:
    """Each word followed by the character n-grams of the word between angle brackets."""

    def of_word(w: Column) -> Column:
        marked = F.concat(F.lit("<"), w, F.lit(">"))
        grams = [F.when(F.length(marked) > n, F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), feat.substring_of(marked, n))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
        return F.concat(F.array(w), *grams)

    return F.flatten(F.transform(tokens, of_word))


def word_vectors(df: DataFrame, tokens: str = "tokens", dim: int = 300, epochs: int = 5, min_count: int = 5, rate: float = 0.05, subwords: tuple[int, int] | None = None, window: int = 5):
    """Skip-gram word vectors.

    With ``subwords`` (shortest and longest n-gram) words and their n-grams are trained side by side in one
    window, wide enough to reach the words around; see :func:`vectors_of` for words that are unknown.
    """
    if subwords:
        df, window = df.withColumn(tokens, subword_tokens(F.col(tokens), *subwords)), 4 * window
    return Word2Vec(inputCol=tokens, outputCol="mean_vector", vectorSize=dim, maxIter=epochs, minCount=min_count, stepSize=rate, windowSize=window).fit(df)


def vectors_of(model, words: DataFrame, subwords: tuple[int, int], word: str = "word") -> DataFrame:
    """(word, vector): the mean vector of a word's known parts, itself among them; null if none is known."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    known = model.getVectors().select(F.col("word").alias("part"), "vector")
    parts = words.select(word).distinct().select(word, F.explode(subword_tokens(F.array(word), *subwords)).alias("part"))
    mean = parts.join(known, "part").groupBy(word).agg(vector_to_array(Summarizer.mean(F.col("vector"))).alias("vector"))
    return words.select(word).distinct().join(mean, word, "left")


def mean_vector_classifier(df: DataFrame, vectors, label: str = "dialect", epochs: int = 20) -> tuple[LogisticRegression, list[str]]:
    """A softmax over mean word vectors."""
    index = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(df)
    return LogisticRegression(featuresCol="mean_vector", maxIter=epochs).fit(vectors.transform(index.transform(df))), index.labels


def predict_in_batches(df: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]], text: str = "text", doc: str = "row_id") -> DataFrame:
    """Apply any model in Arrow batches: ``load`` runs once a task and returns a function from texts to (label, score).

    ``runtime`` is the batch's mean milliseconds a text.
    """

    def run(batches: Iterator):
        import pandas as pd

        model = load()
        for batch in batches:
            began = time.perf_counter()
            got = model(batch[text].tolist())
            each = 1000 * (time.perf_counter() - began) / max(1, len(batch))
            yield pd.DataFrame({doc: batch[doc], "label": [g[0] for g in got], "score": [g[1] for g in got], "runtime": each})

    return df.select(doc, text).mapInPandas(run, f"{doc} long, label string, score double, runtime double")
