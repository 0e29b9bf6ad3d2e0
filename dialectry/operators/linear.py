"""Linear classifiers with squared hinge loss, one against the rest, fitted over cells that are dealt out by feature.

Per class, half the squared norm of the weights (the bias among them) plus ``c`` times the sum of
squared hinge losses is minimised; losses of the class's own rows are weighted by its balance weight.
The optimum, and every step from zero to it, are combinations of the rows, so the solver's vectors have a number for each row and
class, not for each feature: of these there are more by far. A pass sends such a vector to the tasks, each of which has some blocks of
whole features (:class:`Cells`), and adds up by rows what comes back, which is the step's change of the margins. The driver holds about
fifteen arrays of rows by classes, and at the end the weights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectry.sources.scratch import discard, stored

#: Rows of one block of margins, non-zero cells worked on at once, and cells of a stored block, about.
BLOCK, CELLS, STORED_CELLS = 1 << 16, 1 << 18, 1 << 22
#: Steps that are remembered.
MEMORY = 5


def cells_of(batch: pa.RecordBatch, indices: str = "indices", values: str = "values"):
    """Slices of a batch of at most about ``CELLS`` cells: (first row, row starts, indices, values)."""
    column = batch.column(indices)
    at = column.offsets.to_numpy().astype(np.int64)
    idx, val = column.values.to_numpy(), batch.column(values).values.to_numpy()
    lo, v0 = 0, batch.column(values).offsets.to_numpy()[0]
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CELLS, "right")) - 1)
        hi = min(hi, batch.num_rows)
        a, b = at[lo], at[hi]
        yield lo, at[lo : hi + 1] - a, idx[a:b], val[a - at[0] + v0 : b - at[0] + v0]
        lo = hi


def margins(w: np.ndarray, starts: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
    """Scores of each row and class; the last row of ``w`` is the bias."""
    out = np.tile(w[-1], (len(starts) - 1, 1))
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] += np.add.reduceat(w[idx] * val[:, None], starts[full], axis=0)
    return out


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed by place of the bytes: the high ones are mostly zero."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _row(schema: str, **cells) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    names = [c.split(" ") for c in schema.split(", ")]
    return pa.record_batch([pa.array([cells.get(n)], kinds[t]) for n, t in names], [n for n, _ in names])


PIECE = "block int, kind int, n long, rows binary, features binary, codes binary, values binary, idx int, scale double, first long, labels binary, norms binary"
STORED = "block int, kind int, n long, rows binary, features binary, sizes binary, codes binary, values binary, scales binary, first long, labels binary, norms binary"


def pieces(kind: int, base: int, n_blocks: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray):
    """Rows as in ``PIECE``: cells by the block of their feature, by feature and row there; few distinct values are numbered."""
    table, code = np.unique(value, return_inverse=True)
    order = np.lexsort((row, feature, feature % n_blocks))
    row, feature, code = row[order], feature[order], code[order]
    cuts = np.flatnonzero(np.diff(feature % n_blocks)) + 1
    for x, z in zip([0, *cuts], [*cuts, len(row)]):
        if x < z:
            used, own = np.unique(code[x:z], return_inverse=True)
            yield _row(PIECE, block=base + int(feature[x]) % n_blocks, kind=kind, n=z - x, rows=squeezed(row[x:z]), features=squeezed(np.diff(feature[x:z], prepend=0)), codes=squeezed(own), values=table[used].tobytes())


@dataclass
class Cells:
    """Cells of ``n`` rows, stored in blocks of whole features, a row for each; a cell is value x scale of its feature / norm of its row, by kind of feature."""

    blocks: DataFrame
    n: int
    labels: np.ndarray
    norms: dict[int, np.ndarray]

    @staticmethod
    def stored(found: DataFrame, n_blocks: int, n: int) -> Cells:
        """``found`` is as in ``PIECE``."""
        bits_n = int(n).bit_length()

        def merge(batches):
            rows, features, codes, tables, scale, head = [], [], [], [], {}, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["labels"] is not None or r["norms"] is not None:
                        yield _row(STORED, kind=r["kind"], first=r["first"], labels=r["labels"], norms=r["norms"])
                    elif r["idx"] is not None:
                        scale[r["idx"]] = r["scale"]
                    else:
                        head = r["block"], r["kind"]
                        rows.append(unsqueezed(r["rows"], r["n"]))
                        features.append(np.cumsum(unsqueezed(r["features"], r["n"]), dtype=np.int64).astype(np.uint32))
                        codes.append(unsqueezed(r["codes"], r["n"]).astype(np.int32))
                        tables.append(np.frombuffer(r["values"]))
            if head is None:
                return
            table, at = np.unique(np.concatenate(tables), return_inverse=True)
            ends = np.cumsum([0, *map(len, tables)])
            code = np.concatenate([at[lo:hi][c] for c, lo, hi in zip(codes, ends, ends[1:])])
            names, feature = np.unique(np.concatenate(features), return_inverse=True)
            row = np.concatenate(rows)
            del rows, features, codes
            bits_c = len(table).bit_length()
            if len(names).bit_length() + bits_n + bits_c < 63:
                key = np.sort((feature << (bits_n + bits_c)) | (row.astype(np.int64) << bits_c) | code)
                feature, row, code = key >> (bits_n + bits_c), (key >> bits_c) & ((1 << bits_n) - 1), key & ((1 << bits_c) - 1)
            else:
                order = np.lexsort((row, feature))
                feature, row, code = feature[order], row[order].astype(np.int64), code[order]
            first = np.diff(feature, prepend=-1) > 0
            step = np.where(first, row, row - np.append(0, row[:-1]))
            scales = np.array([scale.get(int(i), 1.0) for i in names])
            yield _row(STORED, block=head[0], kind=head[1], n=len(row), rows=squeezed(step), features=names.tobytes(), sizes=np.bincount(feature).astype(np.int32).tobytes(), codes=squeezed(code), values=table.tobytes(), scales=scales.tobytes())

        blocks = stored(found.repartitionById(n_blocks, F.col("block")).mapInArrow(merge, STORED), "cells")
        labels, norms = np.zeros(n, np.int32), {}
        for r in blocks.where("first is not null").select("kind", "first", "labels", "norms").collect():
            if r["labels"] is not None:
                y = np.frombuffer(bytes(r["labels"]), np.int32)
                labels[r["first"] : r["first"] + len(y)] = y
            if r["norms"] is not None:
                x = np.frombuffer(bytes(r["norms"]))
                norms.setdefault(r["kind"], np.ones(n))[r["first"] : r["first"] + len(x)] = x
        return Cells(blocks, n, labels, norms)

    def _mapped(self, vector: np.ndarray, use: Callable, end: Callable, schema: str) -> DataFrame:
        """``use`` of the features, starts, rows and values of some features of a block, their scales, and what the rows' ``vector`` (classes by rows) gives them."""
        spark = self.blocks.sparkSession
        sent = spark.sparkContext.broadcast((vector, self.norms))

        def run(batches):
            vector, norms = sent.value
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for x in range(batch.num_rows):
                    r = batch.slice(x, 1).to_pylist()[0]
                    if r["kind"] not in held:
                        held[r["kind"]] = vector / norms[r["kind"]] if r["kind"] in norms else vector
                    own, n = held[r["kind"]], r["n"]
                    names, sizes, scales = np.frombuffer(r["features"], np.uint32), np.frombuffer(r["sizes"], np.int32), np.frombuffer(r["scales"])
                    ends = np.cumsum(sizes)
                    step, value = unsqueezed(r["rows"], n), np.frombuffer(r["values"])[unsqueezed(r["codes"], n)]
                    lo = 0
                    while lo < len(names):
                        a = ends[lo] - sizes[lo]
                        hi = max(lo + 1, int(np.searchsorted(ends, a + CELLS, "right")))
                        starts, few = ends[lo:hi] - sizes[lo:hi] - a, sizes[lo:hi]
                        row = np.cumsum(step[a : ends[hi - 1]], dtype=np.int64)
                        row -= np.repeat(row[starts] - step[a + starts], few)
                        val = value[a : ends[hi - 1]]
                        got = np.stack([np.add.reduceat(v[row] * val, starts) for v in own])
                        yield from use(r["kind"], names[lo:hi], few, row, val, scales[lo:hi], got)
                        lo = hi
            yield from end(norms)

        few = self.blocks.where("first is null").select("kind", "n", "rows", "features", "sizes", "codes", "values", "scales")
        # what tasks add up has the size of the rows, so there are no more of them than can run at once
        out = few.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, schema)
        out._sent = sent
        return out

    def turned(self, vector: np.ndarray) -> np.ndarray:
        """(classes, rows): the margins of the weights that are the cells' combination by ``vector``; the bias is a feature that is one everywhere."""
        k, n = len(vector), self.n
        total: dict[int, np.ndarray] = {}

        def use(kind, names, sizes, row, value, scales, got):
            out = total.setdefault(kind, np.zeros((k, n)))
            for to, w in zip(out, got * scales**2):
                np.add.at(to, row, value * np.repeat(w, sizes))
            return ()

        def end(norms):
            whole = sum((x / norms[kind] if kind in norms else x for kind, x in total.items()), np.zeros((k, n)))
            total.clear()
            for at in range(0, n, BLOCK):
                yield pa.record_batch([pa.array([at // BLOCK], pa.int32()), pa.array([whole[:, at : at + BLOCK].tobytes()], pa.binary())], ["block", "data"])

        def add(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                    part = np.frombuffer(blob.as_buffer())
                    held[b] = held[b] + part if b in held else part.copy()
            for b, data in held.items():
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["block", "data"])

        schema = "block int, data binary"
        parts = self._mapped(vector, use, end, schema)
        out = np.zeros((k, n))
        for b, blob in parts.repartition("block").mapInArrow(add, schema).collect():
            out[:, b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(bytes(blob)).reshape(k, -1)
        parts._sent.destroy()
        parts.sparkSession._jvm.System.gc()  # the pass's shuffle files go
        return out + vector.sum(axis=1, keepdims=True)

    def weights(self, vector: np.ndarray, size: int) -> np.ndarray:
        """(features, classes) that are the cells' combination by ``vector``; the last row is the bias."""

        def use(kind, names, sizes, row, value, scales, got):
            yield pa.record_batch([pa.array([names.astype(np.int32).tobytes()]), pa.array([(got * scales).tobytes()])], ["names", "data"])

        w, k = np.zeros((size + 1, len(vector))), len(vector)
        w[-1] = vector.sum(axis=1)
        if vector.any():
            parts = self._mapped(vector, use, lambda norms: (), "names binary, data binary")
            found = stored(parts, "weights")
            for names, data in found.toLocalIterator():
                w[np.frombuffer(bytes(names), np.int32)] = np.frombuffer(bytes(data)).reshape(k, -1).T
            parts._sent.destroy()
            discard(found)
        return w


def cells_by_feature(rows: DataFrame) -> Cells:
    """The cells of rows (label number, indices, values), which must come in the same parts when they are read again."""
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)), F.sum(F.size("indices").cast("long"))).collect()}
    offsets, n = {}, 0
    for part in sorted(sizes):
        offsets[part], n = n, n + sizes[part][0]
    n_blocks = blocks_for(sum(x[1] for x in sizes.values()))

    def run(batches):
        from pyspark import TaskContext

        at = offsets.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            if batch.num_rows:
                yield _row(PIECE, block=at % n_blocks, kind=0, first=at, labels=batch.column("label").to_numpy().astype(np.int32).tobytes())
            for lo, starts, idx, val in cells_of(batch):
                yield from pieces(0, 0, n_blocks, np.repeat(np.arange(at + lo, at + lo + len(starts) - 1), np.diff(starts)), idx.astype(np.int64), val)
            at += batch.num_rows

    return Cells.stored(rows.select("label", "indices", "values").mapInArrow(run, PIECE), n_blocks, n)


def blocks_for(n_cells: int) -> int:
    return max(1, -(-n_cells // STORED_CELLS))


def minimise(turned: Callable[[np.ndarray], np.ndarray], sign: np.ndarray, weight: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """(classes, rows): the combination of the rows that is the optimum; ``turned`` gives the margins of a combination, and is called once a step.

    A step is the best one among the combinations of the gradient, the weights and the last steps.
    """
    k, n = sign.shape
    a, m = np.zeros((k, n)), np.zeros((k, n))
    past: list[tuple[np.ndarray, np.ndarray]] = []
    least, active = None, np.ones(k, bool)
    for step in range(max_iter):
        p = 2.0 * weight * sign * np.maximum(0.0, 1.0 - sign * m)
        p[~active] = 0.0
        down = p - a, turned(p) - m
        norm = np.sqrt(np.maximum(0.0, np.einsum("kn,kn->k", *down)))
        least = np.maximum(tol * norm, 1e-12) if least is None else least
        active &= norm > least
        if not active.any():
            break
        ways = [down, *([(a, m)] if step else []), *past]
        del p, down
        moved, turn = np.zeros((k, n)), np.zeros((k, n))
        for x in np.flatnonzero(active):
            t = _best(np.stack([w[1][x] for w in ways]), np.stack([w[0][x] for w in ways]), a[x], m[x], sign[x], weight[x])
            active[x] = bool(t.any())
            for y, (d, kd) in zip(t, ways):
                moved[x] += y * d[x]
                turn[x] += y * kd[x]
        past = [(moved, turn), *past][:MEMORY]
        a, m = a + moved, m + turn
    return a


def _best(turn: np.ndarray, ways: np.ndarray, a: np.ndarray, m: np.ndarray, sign: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of one class, the numbers of the best combination of ``ways`` to add to ``a``, by Newton's method."""
    size = np.sqrt(np.maximum(np.einsum("jn,jn->j", ways, turn), 1e-300))
    turn = turn / size[:, None]
    gram, line, t = (ways / size[:, None]) @ turn.T, turn @ a, np.zeros(len(size))
    gram = (gram + gram.T) / 2

    def loss(t):
        gap = np.maximum(0.0, 1.0 - sign * (m + t @ turn))
        return 0.5 * t @ gram @ t + t @ line + weight @ (gap * gap), gap

    now, gap = loss(t)
    begin = None
    for _ in range(50):
        g = gram @ t + line - 2.0 * turn @ (weight * sign * gap)
        begin = np.abs(g).max() if begin is None else begin
        if np.abs(g).max() <= 1e-9 * begin:
            break
        on = weight * (gap > 0)
        move = np.linalg.lstsq(gram + 2.0 * (turn * on) @ turn.T, -g, rcond=1e-13)[0]
        share, slope = 1.0, g @ move
        while share > 1e-9:
            new, new_gap = loss(t + share * move)
            if new <= now + 1e-4 * share * slope:
                break
            share /= 2
        if share <= 1e-9 or new >= now:
            break
        t, now, gap = t + share * move, new, new_gap
    return t / size


def fit(rows: DataFrame | Cells, size: int, counts: list[int], c: float = 1.0, balanced: bool = True, max_iter: int = 2000, tol: float = 0.01) -> np.ndarray:
    """Weights by feature (the bias last) and class; ``counts`` are the rows of each label number."""
    n, k = sum(counts), len(counts)
    positive = np.array([n / (k * x) if balanced and x else 1.0 for x in counts])
    cells = cells_by_feature(rows) if isinstance(rows, DataFrame) else rows
    own = cells.labels == np.arange(k)[:, None]
    a = minimise(cells.turned, np.where(own, 1.0, -1.0), c * np.where(own, positive[:, None], 1.0), max_iter, tol)
    w = cells.weights(a, size)
    if cells is not rows:
        discard(cells.blocks)
    return w


def predict(rows: DataFrame, w: np.ndarray, doc: str, kind: str) -> DataFrame:
    """(doc, label number of the largest score) of rows with indices and values."""
    sent = rows.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    def run(batches):
        w = sent.value
        for batch in batches:
            best = np.zeros(batch.num_rows, dtype=np.int32)
            for lo, starts, idx, val in cells_of(batch):
                best[lo : lo + len(starts) - 1] = margins(w, starts, idx, val).argmax(axis=1)
            yield pa.record_batch([batch.column(doc), pa.array(best)], [doc, "best"])

    return rows.select(doc, "indices", "values").mapInArrow(run, f"{doc} {kind}, best int").select(doc, F.col("best"))
