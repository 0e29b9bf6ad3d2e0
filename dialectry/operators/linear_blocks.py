"""The linear model of :mod:`linear` with weights that are a table: neither the driver nor any task holds all of them.

L-BFGS in its vector-free form (Chen, Wang and Zhou, 2014). Weights, gradient and the last steps are rows of a table, one
row for each block of features. The driver sees only the inner products of these vectors, and from them finds
the next direction as a combination of them. Cells are stored in sub-blocks of rows by features: a direction is
joined to them by feature block to give margins, and the losses' slopes by row block to give the gradient.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectry.operators.linear import MEMORY, cells_of
from dialectry.sources.scratch import discard, stored

#: Steps of a line search, each half the one before; all are tried in one pass.
HALVINGS = 30


def _map(df: DataFrame, f: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of ``df`` through ``f`` (its columns to tuples), one row at a time in Arrow batches; binaries are float64 arrays."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            columns = [[np.frombuffer(x.as_buffer()) if x.is_valid else None for x in col] if pa.types.is_binary(col.type) else col.to_pylist() for col in batch.columns]
            for row in zip(*columns):
                for got in f(*row):
                    yield pa.record_batch([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x]) for x in got], names)

    return df.mapInArrow(run, schema)


def _summed(df: DataFrame, key: str) -> DataFrame:
    """(key, data): the sum of the arrays of each key, one array in memory at a time."""

    def run(batches):
        at, total = None, None
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(blob.as_buffer())
                if k == at:
                    total = total + own
                    continue
                if at is not None:
                    yield pa.record_batch([pa.array([at], pa.int64()), pa.array([total.tobytes()])], [key, "data"])
                at, total = k, own
        if at is not None:
            yield pa.record_batch([pa.array([at], pa.int64()), pa.array([total.tobytes()])], [key, "data"])

    return df.select(key, "data").repartition(key).sortWithinPartitions(key).mapInArrow(run, f"{key} long, data binary")


def _totals(df: DataFrame, f: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all rows of an array of fixed size; each task sends one."""

    def run(batches):
        total = None
        for batch in batches:
            for row in zip(*(list(col) for col in batch.columns)):
                own = f(*(np.frombuffer(x.as_buffer()) if pa.types.is_binary(x.type) else x.as_py() for x in row))
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()])], ["data"])

    return sum(np.frombuffer(bytes(r[0])) for r in df.mapInArrow(run, "data binary").collect())


def sub_blocks(rows: DataFrame, size: int, feature_block: int, row_block: int) -> DataFrame:
    """(fb, rb, n, y, r, f, v): the cells of rows (label, indices, values) by feature block and row block, the bias as the last feature.

    ``y`` holds the block's labels, in one of its sub-blocks only (that of the bias).
    """

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            y = batch.column("label").to_numpy().astype(np.float64)
            for lo, starts, idx, val in cells_of(batch):
                for a in range(0, len(starts) - 1, row_block):
                    b = min(a + row_block, len(starts) - 1)
                    own = slice(starts[a], starts[b])
                    r = np.concatenate([np.repeat(np.arange(b - a), np.diff(starts[a : b + 1])), np.arange(b - a)])
                    f = np.concatenate([idx[own].astype(np.int64), np.full(b - a, size)])
                    v = np.concatenate([val[own], np.ones(b - a)])
                    order = np.argsort(f // feature_block, kind="stable")
                    r, f, v = r[order], f[order], v[order]
                    cuts = np.flatnonzero(np.diff(f // feature_block)) + 1
                    for x, z in zip([0, *cuts], [*cuts, len(f)]):
                        fb = int(f[x]) // feature_block
                        names = y[lo + a : lo + b].tobytes() if fb == size // feature_block else None
                        yield pa.record_batch([pa.array([fb], pa.int64()), pa.array([(part << 32) + number]), pa.array([b - a], pa.int64()), pa.array([names], pa.binary()), *(pa.array([c.astype(np.float64).tobytes()]) for c in (r[x:z], f[x:z] % feature_block, v[x:z]))], ["fb", "rb", "n", "y", "r", "f", "v"])
                    number += 1

    return stored(rows.select("label", "indices", "values").mapInArrow(run, "fb long, rb long, n long, y binary, r binary, f binary, v binary"), "sub-blocks", "zstd")


def _scatter(to: np.ndarray, what: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``what`` by their places."""
    out = np.zeros((n, what.shape[1]))
    np.add.at(out, to.astype(np.int64), what)
    return out


def direction(gram: np.ndarray, m: int) -> np.ndarray:
    """Coefficients of the next direction among [weights, gradient, m steps, m gradient changes], from their inner products; for one class."""
    delta = np.zeros(2 + 2 * m)
    delta[1] = -1.0
    good = [i for i in range(m) if gram[2 + i, 2 + m + i] > 1e-12]
    a = {}
    for i in reversed(good):
        a[i] = (delta @ gram[:, 2 + i]) / gram[2 + i, 2 + m + i]
        delta[2 + m + i] -= a[i]
    if good:
        i = good[-1]
        delta *= gram[2 + i, 2 + m + i] / max(gram[2 + m + i, 2 + m + i], 1e-300)
    for i in good:
        delta[2 + i] += a[i] - (delta @ gram[:, 2 + m + i]) / gram[2 + i, 2 + m + i]
    return delta


def fit(rows: DataFrame, size: int, counts: list[int], c: float = 1.0, balanced: bool = True, max_iter: int = 2000, tol: float = 0.01, feature_block: int = 1 << 15, row_block: int = 1 << 12) -> DataFrame:
    """(idx, label, weight) of the same optimum as :func:`linear.fit`; the bias is feature ``size``, labels are numbers."""
    n, k = sum(counts), len(counts)
    positive = np.array([n / (k * x) if balanced and x else 1.0 for x in counts])
    cells = sub_blocks(rows, size, feature_block, row_block)
    names = np.arange(k)

    def gaps(y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sign = np.where(y[:, None] == names, 1.0, -1.0)
        return np.where(sign > 0, positive, 1.0) * sign, np.maximum(0.0, 1.0 - sign * m)

    def pulls(margins: DataFrame) -> DataFrame:
        def pull(rb, y, m):
            weight, gap = gaps(y, m.reshape(-1, k))
            yield rb, -2.0 * c * weight * gap

        return _map(margins, pull, "rb long, data binary")

    def gradients(margins: DataFrame) -> DataFrame:
        def part(fb, r, f, v, p):
            yield fb, _scatter(f, p.reshape(-1, k)[r.astype(np.int64)] * v[:, None], feature_block)

        return _summed(_map(cells.select("fb", "rb", "r", "f", "v").join(pulls(margins), "rb").select("fb", "r", "f", "v", "data"), part, "fb long, data binary"), "fb")

    def shaped(data: np.ndarray) -> np.ndarray:
        return data.reshape(-1, feature_block, k)

    margins = stored(_map(cells.where("y is not null").select("rb", "y"), lambda rb, y: iter([(rb, y, np.zeros(len(y) * k))]), "rb long, y binary, m binary"), "margins")
    basis = stored(_map(gradients(margins), lambda fb, g: iter([(fb, np.concatenate([np.zeros(len(g)), g]))]), "fb long, data binary"), "basis")
    m, active, least = 0, None, None
    for step in range(max_iter + 1):
        count = 2 + 2 * m
        gram = _totals(basis.select("data"), lambda data: np.einsum("afk,bfk->kab", shaped(data), shaped(data)).ravel()).reshape(k, count, count)
        norm = np.sqrt(gram[:, 1, 1])
        if step == 0:
            least = np.maximum(tol * norm, 1e-12)
            active = norm > least
        active = active & (norm > least)
        if not active.any() or step == max_iter:
            break
        deltas = np.stack([direction(gram[x], m) for x in range(k)])
        slope = np.einsum("ka,ka->k", deltas, gram[:, :, 1])
        for x in np.flatnonzero(slope >= 0):  # no descent: the gradient itself
            deltas[x] = 0
            deltas[x, 1], slope[x] = -1.0, -gram[x, 1, 1]
        ways = _map(basis, lambda fb, data, d=deltas: iter([(fb, np.einsum("afk,ka->fk", shaped(data), d))]), "fb long, data binary")

        def moved(rb, rows_, r, f, v, data):
            yield rb, _scatter(r, data.reshape(-1, k)[f.astype(np.int64)] * v[:, None], int(rows_))

        turn = _summed(_map(cells.select("fb", "rb", "n", "r", "f", "v").join(ways, "fb").select("rb", "n", "r", "f", "v", "data"), moved, "rb long, data binary"), "rb")
        both = stored(margins.join(turn, "rb").select("rb", "y", "m", "data"), "margins")
        first = np.where(active, 1.0, 0.0) / (np.maximum(norm, 1.0) if m == 0 else 1.0)
        tries = first[None, :] * 0.5 ** np.arange(HALVINGS)[:, None]
        tries = np.concatenate([np.zeros((1, k)), tries])

        def losses(y, own, way):
            own, way = own.reshape(-1, k), way.reshape(-1, k)
            out = np.empty((len(tries), k))
            for t, at in enumerate(tries):
                weight, gap = gaps(y, own + at * way)
                out[t] = c * (np.abs(weight) * gap * gap).sum(axis=0)
            return out.ravel()

        loss = _totals(both.select("y", "m", "data"), losses).reshape(len(tries), k)
        ww, wp = gram[:, 0, 0], np.einsum("ka,ka->k", deltas, gram[:, :, 0])
        pp = np.einsum("ka,kb,kab->k", deltas, deltas, gram)
        loss = loss + 0.5 * (ww + 2 * tries * wp + tries**2 * pp)
        fine = loss[1:] <= loss[0] + 1e-4 * tries[1:] * slope
        took = np.where(fine.any(axis=0), tries[1:][fine.argmax(axis=0), names], 0.0)
        active = active & (took > 0)
        if not took.any():
            discard(both)
            break
        new_margins = stored(_map(both, lambda rb, y, own, way, a=took: iter([(rb, y, (own.reshape(-1, k) + a * way.reshape(-1, k)).ravel())]), "rb long, y binary, m binary"), "margins")

        def stepped(fb, data, grad, d=deltas, a=took, m=m):
            old = shaped(data)
            s = a * np.einsum("afk,ka->fk", old, d)
            w = old[0] + s
            g = w + (0 if grad is None else grad.reshape(feature_block, k))
            past, change = [*old[2 : 2 + m], s][-MEMORY:], [*old[2 + m :], g - old[1]][-MEMORY:]
            yield fb, np.stack([w, g, *past, *change]).ravel()

        grown = _map(basis.join(gradients(new_margins).withColumnRenamed("data", "grad"), "fb", "left").select("fb", "data", "grad"), stepped, "fb long, data binary")
        new_basis = stored(grown, "basis")
        discard(both, margins, basis)
        margins, basis, m = new_margins, new_basis, min(m + 1, MEMORY)

    def listed(batches):
        for batch in batches:
            for fb, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = shaped(np.frombuffer(blob.as_buffer()))[0]
                f, label = np.nonzero(w)
                yield pa.record_batch([pa.array(fb * feature_block + f), pa.array(label.astype(np.int32)), pa.array(w[f, label])], ["idx", "label", "weight"])

    out = stored(basis.mapInArrow(listed, "idx long, label int, weight double"), "weights")
    discard(cells, margins, basis)
    return out


def predict(rows: DataFrame, weights: DataFrame, size: int, doc: str) -> DataFrame:
    """(doc, best): the label number of the largest score of rows (doc, indices, values), by a join of their cells to the weights; ties to the smaller number."""
    cells = rows.select(doc, F.explode(F.concat(F.arrays_zip("indices", "values"), F.array(F.struct(F.lit(size).alias("indices"), F.lit(1.0).alias("values"))))).alias("c"))
    scores = cells.select(doc, F.col("c.indices").cast("long").alias("idx"), F.col("c.values").alias("value")).join(weights, "idx").groupBy(doc, "label").agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
    return scores.groupBy(doc).agg(F.max_by("label", F.struct("s", -F.col("label"))).alias("best"))
