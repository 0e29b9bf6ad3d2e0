"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a fixed-length window
and classified by a softmax. The model is fitted on a bounded sample of labelled texts: about
``per_label`` texts of every label, or ``sample_rows`` by the number of labels if that is less, drawn
evenly over all of them by a hash of id and text, two windows each. (With more labels than
``sample_rows`` rows are drawn whatever their label, so that some labels are not learned.) Every text is then read whole, in consecutive windows; its
probabilities are the mean of its windows' log probabilities, weighted by their bytes.

For inference the embedding and the filters fold into one table per byte position, so a convolution
is a sum of table rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if
no labelled text exists. A null doc_id is not held out and not learned from. Equal texts get equal
results; repeated rows count once in the sample. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectry.llm.common import text_buffer

WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
WINDOW = 256
SAMPLE_CHARS = 240
GROUP = 16  #: windows convolved at once, so that the work stays in the processor's cache


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def labelled_windows(docs: DataFrame, per_label: int, sample_rows: int = 100_000, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> list[tuple[str, str]]:
    """About ``per_label`` texts a label, ``sample_rows`` in all at most, two windows each, as (label, window)."""
    usable = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 3 != 1))
    named = usable.select(F.col(label_col).cast("string").alias("label"), F.xxhash64(F.lit(11), id_col, text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    counts = named.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labels = counts.count()
    if not labels:
        return []
    size = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))
    pick = lambda seed: F.substring("text", (F.pmod(F.xxhash64(F.lit(seed), "h"), size) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    chance = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    if labels <= sample_rows:
        # at most sample_rows labels: a table of bounded size
        shares = counts.select("label", (F.lit(min(per_label, sample_rows / labels)) / F.col("n")).alias("share"))
        chosen = named.join(F.broadcast(shares), "label").where(chance < F.col("share"))
    else:
        chosen = named.where(chance < sample_rows / counts.agg(F.sum("n")).first()[0])
    drawn = chosen.select("label", "h", F.array(pick(1), pick(2)).alias("windows")).dropDuplicates(["label", "h"])
    got = drawn.select("label", "h", F.explode("windows").alias("window")).orderBy("h", "label", "window").collect()
    return [(r["label"], r["window"]) for r in got]


def _windows(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows of all rows, each window's row and its bytes."""
    sizes = np.diff(at)
    n = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), n)
    first = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = at[:-1][row] + first * WINDOW
    length = np.minimum(WINDOW, at[1:][row] - begin)
    out = np.zeros((len(row), WINDOW + max(WIDTHS)), dtype=np.uint8)
    whole = length == WINDOW
    if whole.any():
        out[whole, :WINDOW] = raw[begin[whole][:, None] + np.arange(WINDOW)]
    for i in np.flatnonzero(~whole):
        out[i, : length[i]] = raw[begin[i] : begin[i] + length[i]]
    return out, row, length


class ByteCNN:
    """Parameters, training and inference."""

    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"e": r.normal(0, 0.3, (256, DIM))}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS))
            self.p[f"c{w}"] = np.zeros(FILTERS)
        self.p["o"] = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels)))
        self.p["b"] = np.zeros(len(labels))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["e"][0] = 0

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy on windows x with label numbers y."""
        p, n = self.p, len(x)
        emb = p["e"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1)[:, :WINDOW].transpose(0, 1, 3, 2).reshape(n, WINDOW, w * DIM)
            z = cols @ p[f"w{w}"]
            top = z.argmax(axis=1)
            value = np.take_along_axis(z, top[:, None], axis=1)[:, 0] + p[f"c{w}"]
            pooled.append(np.maximum(value, 0))
            kept.append((cols, top, value > 0))
        h = np.concatenate(pooled, axis=1)
        z = h @ p["o"] + p["b"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        d = q
        d[np.arange(n), y] -= 1
        d /= n
        g = {"o": h.T @ d, "b": d.sum(axis=0), "e": np.zeros_like(p["e"])}
        dh = d @ p["o"].T
        for k, (w, (cols, top, on)) in enumerate(zip(WIDTHS, kept)):
            dv = dh[:, k * FILTERS : (k + 1) * FILTERS] * on
            g[f"c{w}"] = dv.sum(axis=0)
            best = cols[np.arange(n)[:, None], top]
            g[f"w{w}"] = np.einsum("nf,nfd->df", dv, best)
            de = (dv[:, :, None] * p[f"w{w}"].T[None]).reshape(n, FILTERS, w, DIM)
            for j in range(w):
                np.add.at(g["e"], x[np.arange(n)[:, None], top + j], de[:, :, j])
        g["e"][0] = 0
        return g

    def fit(self, labels: np.ndarray, windows: np.ndarray, epochs: int = 8, steps: int = 400, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> ByteCNN:
        """At least ``epochs`` passes and ``steps`` steps."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t = 0
        for _ in range(max(epochs, -(-steps * batch // max(1, len(labels))))):
            order = r.permutation(len(labels))
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                x = windows[own].copy()
                # shorter views of half the windows, so that short texts are known too
                cut = r.integers(16, WINDOW, len(own))
                for i in np.flatnonzero(r.random(len(own)) < 0.5):
                    x[i, cut[i] :] = 0
                t += 1
                for k, g in self._step(x, labels[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def tables(self) -> list[np.ndarray]:
        """For each byte position, 256 rows of the sums it adds to the filters that reach that far, widest first."""
        out = []
        for j in range(max(WIDTHS)):
            reach = [w for w in sorted(WIDTHS, reverse=True) if j < w]
            out.append(np.concatenate([self.p["e"] @ self.p[f"w{w}"][j * DIM : (j + 1) * DIM] for w in reach], axis=1).astype(np.float32))
        return out

    def log_probabilities(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        order = sorted(WIDTHS, reverse=True)
        bias = np.concatenate([self.p[f"c{w}"] for w in order])
        weight = np.concatenate([self.p["o"][WIDTHS.index(w) * FILTERS : (WIDTHS.index(w) + 1) * FILTERS] for w in order])
        pooled = np.empty((len(windows), len(bias)), dtype=np.float32)
        for lo in range(0, len(windows), GROUP):
            x = windows[lo : lo + GROUP]
            z = tables[0][x[:, :WINDOW]]
            for j in range(1, len(tables)):
                z[:, :, : tables[j].shape[1]] += tables[j][x[:, j : j + WINDOW]]
            pooled[lo : lo + GROUP] = z.max(axis=1)
        h = np.maximum(pooled + bias, 0) @ weight + self.p["b"]
        h -= h.max(axis=1, keepdims=True)
        return h - np.log(np.exp(h).sum(axis=1, keepdims=True))


def train(docs: DataFrame, per_label: int = 500, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> ByteCNN | None:
    """Fit on the bounded sample; None if no text is labelled."""
    sample = labelled_windows(docs, per_label, text_col=text_col, label_col=label_col, id_col=id_col)
    if not sample:
        return None
    labels = sorted({k for k, _ in sample})
    windows, row, _ = _windows(*text_buffer(pa.array([w for _, w in sample])))
    known = np.array([labels.index(k) for k, _ in sample])[row]
    return ByteCNN(labels).fit(known, windows)


def scored(net: ByteCNN | None, tables: list[np.ndarray] | None, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Label and score of each text."""
    letters = pc.match_substring_regex(text, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
    name, score = np.full(len(text), "und", dtype=object), np.zeros(len(text))
    if net is None or not letters.any():
        return name, score
    raw, at = text_buffer(text)
    total = np.zeros((len(text), len(net.labels)))
    # rows are taken by the megabyte they begin in
    edges = [0, *(np.flatnonzero(np.diff(at >> 20)) + 1), len(text)]
    for a, b in zip(edges[:-1], edges[1:]):
        if a < b:
            windows, row, length = _windows(raw, at[a : b + 1])
            np.add.at(total, row + a, net.log_probabilities(windows, tables) * length[:, None])
    mean = total / np.maximum(np.diff(at), 1)[:, None]
    q = np.exp(mean - mean.max(axis=1, keepdims=True))
    q /= q.sum(axis=1, keepdims=True)
    best = q.argmax(axis=1)
    return np.where(letters, np.array(net.labels, dtype=object)[best], "und"), np.where(letters, np.clip(q[np.arange(len(q)), best], 0, 1), 0.0)


def predict(docs: DataFrame, model: ByteCNN | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = sent.value
        tables = net.tables() if net else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                few = batch.slice(lo, 500)
                name, score = scored(net, tables, few.column(1))
                yield pa.record_batch([few.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, per_label: int = 500, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = train(docs, per_label, text_col, label_col, id_col)
    return predict(docs, model, text_col, id_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, per_label: int = 500, min_score: float = 0.5, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The documents whose language is told with at least ``min_score``, with their columns.

    At 0.5 a language must be likelier than all others together, however many there are. The same
    network is applied beside the rows themselves, so nothing is joined.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, per_label, text_col, label_col, id_col))

    @F.pandas_udf("double")
    def certainty(texts):
        import pandas as pd

        net = sent.value
        tables, out = net.tables() if net else None, np.zeros(len(texts))
        for lo in range(0, len(texts), 500):
            out[lo : lo + 500] = scored(net, tables, pa.array(texts.iloc[lo : lo + 500], pa.string()))[1]
        return pd.Series(out)

    return docs.where(certainty(F.col(text_col)) >= min_score)
