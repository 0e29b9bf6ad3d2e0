"""A small trained text encoder: attention pooling over subword vectors, fine-tuned with early stopping.

Every parameter is a row of the table of ids and vectors in :mod:`subword`, the dense layers too, so training in
blocks with averaged vectors, and the bounds on memory, are those stated there. After each epoch the vectors are
written, and macro F1 on the development rows decides when to stop. A run that is started again with the same
folder goes on after its last complete epoch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectry.operators import metrics as M
from dialectry.operators.subword import SubwordVectors, TextGroups, first_vector, group_epochs, looked_up, received, text_groups, texts_of
from dialectry.sources.scratch import discard

#: Padded places of a batch, and the most texts in it.
CELLS, ROWS = 1 << 15, 16


def batches_by_length(sizes: list[int]) -> list[list[int]]:
    """Texts of like lengths together, so that little is padded: at most ``ROWS`` of them, and ``CELLS`` places or one text. Empty texts are left out."""
    out: list[list[int]] = []
    for r in sorted((r for r, n in enumerate(sizes) if n), key=lambda r: sizes[r]):
        if not out or len(out[-1]) >= ROWS or (len(out[-1]) + 1) * sizes[r] > CELLS:
            out.append([])
        out[-1].append(r)
    return out


class Dense:
    """The layers above the vectors, cut out of rows of ``dim`` numbers: attention (hidden rows), its query, output (a row per label), bias."""

    def __init__(self, rows: np.ndarray, hidden: int, k: int):
        self.rows, self.hidden, self.k = rows, hidden, k
        self.attend, self.query = rows[:hidden], rows[hidden, :hidden]
        self.out, self.bias = rows[hidden + 1 : hidden + 1 + k], rows[hidden + 1 + k, :k]

    def forward(self, e: np.ndarray, mask: np.ndarray):
        t = np.tanh(e @ self.attend.T)
        s = np.where(mask, t @ self.query, -1e30)
        a = np.exp(s - s.max(axis=1, keepdims=True)) * mask
        a /= a.sum(axis=1, keepdims=True)
        z = np.einsum("bl,bld->bd", a, e)
        logits = z @ self.out.T + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return t, a, z, p / p.sum(axis=1, keepdims=True)

    def gradients(self, e: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Of the summed cross-entropy: by the vectors, and by the rows of the layers."""
        t, a, z, p = self.forward(e, mask)
        p[np.arange(len(y)), y] -= 1
        g = np.zeros_like(self.rows)
        g[self.hidden + 1 : self.hidden + 1 + self.k], g[self.hidden + 1 + self.k, : self.k] = p.T @ z, p.sum(axis=0)
        dz = p @ self.out
        da = np.einsum("bld,bd->bl", e, dz)
        ds = a * (da - (a * da).sum(axis=1, keepdims=True))
        g[self.hidden, : self.hidden] = np.einsum("bl,blh->h", ds, t)
        pre = ds[:, :, None] * self.query * (1 - t * t)
        g[: self.hidden] = np.einsum("blh,bld->hd", pre, e)
        return a[:, :, None] * dz[:, None, :] + pre @ self.attend, g


@dataclass
class Encoder:
    """A trained encoder: all its vectors, and how texts become ids."""

    vectors: DataFrame
    dense_ids: list[int]
    labels: list[str]
    dim: int
    hidden: int
    subwords: tuple[int, int] | None
    buckets: int

    def predict(self, df: DataFrame, tokens: str = "tokens", doc: str = "row_id", block_tokens: int = 1 << 19, groups: TextGroups | None = None) -> DataFrame:
        """(doc, label, score, runtime): the most likely label, its probability and the block's mean milliseconds a text; an empty text is judged by the zero vector."""
        found = {r[0]: np.frombuffer(bytes(r[1]), dtype=np.float32) for r in self.vectors.where(F.col("id").isin(self.dense_ids)).select("id", "vec").collect()}
        dense = Dense(starting_layers(self.dense_ids, found, self.dim, self.hidden), self.hidden, len(self.labels))
        labels, dim = self.labels, self.dim
        groups = self.groups(df, tokens, doc, block_tokens) if groups is None else groups
        parts = groups.parts(self.vectors)

        def run(batches: Iterator[pa.RecordBatch]):
            batches = iter(batches)
            if (one := next(batches, None)) is None:
                return
            own_type = one.schema.field("own").type.value_type
            _, _, held, known, blocks = received(chain([one], batches), parts, dim)
            empty = dense.forward(np.zeros((1, 1, dim), np.float32), np.ones((1, 1), bool))[3][0]
            for block in blocks:
                began = time.perf_counter()
                own, texts = texts_of(block)
                vectors, has = held[own], known[own]
                lists = [x[has[x]] for x in texts]
                p = np.tile(empty, (len(lists), 1))
                for batch in batches_by_length([len(x) for x in lists]):
                    e, mask = padded([vectors[lists[r]] for r in batch], dim)
                    p[batch] = dense.forward(e, mask)[3]
                best = p.argmax(axis=1)
                each = 1000 * (time.perf_counter() - began) / max(1, len(lists))
                yield pa.record_batch([pa.array(block["own"], own_type), pa.array([labels[k] for k in best], pa.string()), pa.array([float(p[r, k]) for r, k in enumerate(best)], pa.float64()), pa.array([each] * len(best), pa.float64())], [doc, "label", "score", "runtime"])

        return groups.with_vectors(looked_up(groups, self.vectors, parts), run, f"{doc} {df.schema[doc].dataType.simpleString()}, label string, score double, runtime double")

    def groups(self, df: DataFrame, tokens: str = "tokens", doc: str = "row_id", block_tokens: int = 1 << 19) -> TextGroups:
        """Texts made ready for :meth:`predict`, of this encoder or of its other epochs."""
        return text_groups(df.select(F.col(doc).alias("_doc"), F.col(tokens).alias("tokens")), "_doc", self.dim, 1, self.subwords, self.buckets, block_tokens)


def padded(lists: list[np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray]:
    e = np.zeros((len(lists), max(map(len, lists)), dim), dtype=np.float32)
    mask = np.zeros(e.shape[:2], dtype=bool)
    for r, x in enumerate(lists):
        e[r, : len(x)], mask[r, : len(x)] = x, True
    return e, mask


class Places:
    """Where the distinct ids of a batch's texts stand in its padded texts."""

    def __init__(self, rows: list[int], lists: list[np.ndarray]):
        self.rows = rows
        self.ids, at = np.unique(np.concatenate(lists), return_inverse=True)
        sizes = np.array([len(x) for x in lists])
        self.mask = np.arange(sizes.max()) < sizes[:, None]
        self.at, place = at.astype(np.int32), np.flatnonzero(self.mask)
        order = np.argsort(at, kind="stable")
        # padded places by id, and where each id's begin
        self.place, self.starts = place[order].astype(np.int32), np.flatnonzero(np.diff(at[order], prepend=-1))

    def filled(self, vectors: np.ndarray) -> np.ndarray:
        e = np.zeros((*self.mask.shape, vectors.shape[1]), dtype=np.float32)
        e[self.mask] = vectors[self.at]
        return e

    def summed(self, de: np.ndarray) -> np.ndarray:
        """The sum of ``de`` over the places of each id."""
        return np.add.reduceat(de.reshape(-1, de.shape[-1])[self.place], self.starts, axis=0).astype(np.float64)


def starting_layers(ids: list[int], held: dict[int, np.ndarray], dim: int, hidden: int) -> np.ndarray:
    """The layers' rows: as held, else attention drawn from its ids and all others zero."""
    return np.stack([held[i] if i in held else first_vector(i, dim) if k < hidden else np.zeros(dim, np.float32) for k, i in enumerate(ids)]).copy()


def fine_tune(df: DataFrame, dev: DataFrame, folder: str, tokens: str = "tokens", label: str = "label", doc: str = "row_id", dim: int = 64, hidden: int = 16, n_epochs: int = 10, patience: int = 2, rate: float = 0.1, subwords: tuple[int, int] | None = None, buckets: int = 200_000, pretrained: SubwordVectors | None = None, block_tokens: int = 1 << 19, seed: int = 1, passes: int = 1) -> tuple[Encoder, list[float]]:
    """The encoder of the epoch with the best macro F1 on ``dev``, and the scores of all epochs.

    Training ends after ``patience`` epochs without a better score; in an epoch, blocks go ``passes`` times over
    their rows before vectors are averaged. ``folder`` must be one that driver and executors
    share. Rows without a label take no part; labels, and the layers of hidden + labels + 2 rows, are all the driver holds.
    """
    spark = df.sparkSession
    df = df.where(F.col(label).isNotNull())
    labels = sorted(r[0] for r in df.select(label).distinct().collect())
    if hidden > dim or len(labels) > dim:
        raise ValueError("vectors must have as many numbers as there are labels and hidden places")
    k, n_dense = len(labels), hidden + len(labels) + 2
    dense_ids = [r[0] for r in spark.range(1).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_dense - 1)), lambda x: F.xxhash64(F.lit("layer"), x)))).collect()]
    number = F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1
    groups = text_groups(df.select(number.cast("int").alias("label"), F.col(tokens).alias("tokens")), "label", dim, 1, subwords, buckets, block_tokens, dense_ids)

    def train(epoch: int, block: int, y: list[int], texts: list[np.ndarray], a: np.ndarray, rows: np.ndarray):
        rng = np.random.default_rng([seed, epoch, block])
        dense, y = Dense(rows, hidden, k), np.array(y)
        used, batches = np.zeros(len(a)), batches_by_length([len(x) for x in texts])
        # steps are divided by the size of those before them, in this epoch and block (Adagrad)
        past, dense_past, lr = np.zeros((len(a), dim)), np.zeros_like(dense.rows, dtype=np.float64), rate * (1 - epoch / n_epochs)
        ready = [Places(x, [texts[r] for r in x]) for x in batches]  # once for all passes
        for b in np.concatenate([rng.permutation(len(batches)) for _ in range(passes)]):
            one = ready[b]
            own = a[one.ids]
            de, g = dense.gradients(one.filled(own), one.mask, y[one.rows])
            pull = one.summed(de)
            squares = past[one.ids] + pull * pull
            past[one.ids] = squares
            a[one.ids] = own - (lr * pull / (np.sqrt(squares) + 1e-8)).astype(np.float32)
            dense_past += g * g
            dense.rows -= (lr * g / (np.sqrt(dense_past) + 1e-8)).astype(np.float32)
            used[one.ids] += 1
        return used, np.full(len(rows), float(max(1, len(batches))))

    scores: list[float] = []
    held: TextGroups | None = None
    params = pretrained.vectors if pretrained else None
    made = lambda vectors: Encoder(vectors, dense_ids, labels, dim, hidden, subwords, buckets)
    for epoch in range(n_epochs):
        at = f"{folder}/epoch-{epoch}"
        if not _complete(spark, f"{at}/score"):
            group_epochs(groups, dense_ids, dense_ids[hidden:], params, range(epoch, epoch + 1), train, pretrained is not None).write.mode("overwrite").parquet(f"{at}/vectors")
            now = made(spark.read.parquet(f"{at}/vectors"))
            held = now.groups(dev, tokens, doc) if held is None else held
            got = dev.select(F.col(doc).alias("row_id"), F.col(label).alias("ref")).join(now.predict(dev, tokens, doc, groups=held).select(F.col(doc).alias("row_id"), "label"), "row_id")
            f1 = float(M.scores(got, "ref", "label").first()["f1_macro"] or 0.0)
            spark.createDataFrame([(json.dumps({"f1_macro": f1}),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{at}/score")
        scores.append(json.loads(spark.read.parquet(f"{at}/score").first()[0])["f1_macro"])
        params = spark.read.parquet(f"{at}/vectors")
        if epoch - int(np.argmax(scores)) >= patience:
            break
    discard(groups.rows, *([held.rows] if held else []))
    return made(spark.read.parquet(f"{folder}/epoch-{int(np.argmax(scores))}/vectors")), scores


def _complete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
