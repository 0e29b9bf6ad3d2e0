"""Subword models trained in blocks: skip-gram vectors with hashed n-grams, and a hierarchical-softmax classifier.

Parameters are a table of ids and vectors, never held by the driver or by one task. Rows are dealt out into blocks of
about ``block_tokens`` tokens. In an epoch each block gets the vectors of its own ids by a join, takes its steps on them in
numpy, and returns them; the vectors of an id are averaged over its blocks, weighed by their numbers of steps. So
memory is bound by the block, and the driver holds the label tree (bounded by the number of labels) and a few totals.

The models on whole texts (:class:`TextGroups`) train a group of blocks in a task, one block after another, from the same vectors:
an id's vector travels once to and from a group, not a block, many of them packed in a row, and the result is that of
the blocks alone. A group has as many blocks as ``GROUP_BYTES`` allow, fewer where that would leave tasks idle.

An id is the hash of a word (apart as input and as target), or the bucket of an n-gram's hash. A vector that no
block has trained yet is drawn from its id, so nothing has to be written before the first epoch.
"""

from __future__ import annotations

import heapq
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectry.operators.features import word_ngrams
from dialectry.sources.scratch import discard, stored

#: Tokens of a piece of a text: windows do not reach over its ends.
PIECE = 1024
VECTOR = "id long, vec binary, steps double"
#: Bytes of a group's vectors and their sums in its task, if no id is in two of its blocks.
GROUP_BYTES = 1 << 30
#: Vectors of a part, on average; rows of a batch of vectors.
PART, ROWS = 1 << 20, 1 << 14
#: Epochs that are run before their vectors are stored.
LINEAGE = 4
ANSWER = "grp int, part int, known binary, vecs binary"
UPDATE = "part int, grp int, ids binary, known binary, vecs binary, steps binary"


# ids ------------------------------------------------------------------------------------------------


def word_id(word: Column, kind: str) -> Column:
    """The id of a word as ``input`` or ``target``."""
    return F.xxhash64(F.lit(kind), word)


def bucket_ids(grams: Column, buckets: int) -> Column:
    """Ids of n-grams: their hash buckets, from 0."""
    return F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)))


def char_grams(word: Column, low: int, high: int) -> Column:
    """The character n-grams of a word between angle brackets, the whole aside."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    at = lambda n: F.when(F.length(marked) > n, F.sequence(F.lit(1), F.length(marked) - n + 1)).otherwise(F.array().cast("array<int>"))
    of = lambda n: F.transform(at(n), lambda i: F.substring(marked, i, F.lit(n)))
    return F.concat(*(of(n) for n in range(low, high + 1)))


def input_ids(word: Column, subwords: tuple[int, int] | None, buckets: int) -> Column:
    own = F.array(word_id(word, "input"))
    return own if subwords is None else F.concat(own, bucket_ids(char_grams(word, *subwords), buckets))


def first_vector(key: int, dim: int) -> np.ndarray:
    """The vector of an input id before it is trained: uniform, drawn from the id."""
    return np.random.default_rng(key & 0xFFFFFFFFFFFFFFFF).uniform(-1 / dim, 1 / dim, dim).astype(np.float32)


# blocks ---------------------------------------------------------------------------------------------


def merged(updates: DataFrame) -> DataFrame:
    """The mean vector of each id, weighed by steps."""

    def run(batches: Iterator[pa.RecordBatch]):
        key, total, steps = None, None, 0.0
        for batch in batches:
            out: list[tuple] = []
            for i, blob, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                own = np.frombuffer(blob.as_buffer(), dtype=np.float32) * n
                if i != key:
                    if key is not None:
                        out.append((key, (total / steps).astype(np.float32).tobytes(), steps))
                    key, total, steps = i, own.astype(np.float64), n
                else:
                    total, steps = total + own, steps + n
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.float64()))], ["id", "vec", "steps"])
        if key is not None:
            yield pa.record_batch([pa.array([key]), pa.array([(total / steps).astype(np.float32).tobytes()]), pa.array([steps])], ["id", "vec", "steps"])

    return updates.repartition("id").sortWithinPartitions("id").mapInArrow(run, VECTOR)


def epochs(rows: DataFrame, needs: DataFrame, start: DataFrame | None, n: int, train: Callable, spark: SparkSession) -> DataFrame:
    """The trained vectors. ``rows`` are the blocks' examples, ``needs`` their (block, id); ``train(epoch, examples, vectors)`` yields (id, vec, steps)."""

    def steps(epoch: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            held = {i: np.frombuffer(v.as_buffer(), dtype=np.float32) for i, v in zip(right.column("id").to_pylist(), right.column("vec"))}
            got = list(train(epoch, left, held)) if left.num_rows else []
            stepped = {g[0] for g in got}  # the others go on as they are
            got += [(i, v.tobytes(), 1e-9) for i, v in held.items() if i not in stepped]
            return pa.table([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.float64()))], ["id", "vec", "steps"])

        return run

    params = start if start is not None else spark.createDataFrame([], VECTOR)
    for epoch in range(n):
        vectors = needs.join(params.select("id", "vec"), "id").select("block", "id", "vec")
        new = merged(rows.groupBy("block").cogroup(vectors.groupBy("block")).applyInArrow(steps(epoch), VECTOR))
        if epoch == 0 and start is not None:  # vectors that no block needs stay; all others come back
            new = new.unionByName(params.join(needs.select("id").distinct(), "id", "left_anti"))
        done = stored(new, "vectors")
        if epoch:
            discard(params)
        params = done
    return params


def local_vectors(ids: list[int], held: dict[int, np.ndarray], dim: int, zero: set[int]) -> np.ndarray:
    """A matrix of the ids' vectors; targets not trained yet are zero."""
    return np.stack([held[i] if i in held else np.zeros(dim, np.float32) if i in zero else first_vector(i, dim) for i in ids]) if ids else np.zeros((0, dim), np.float32)


def block_count(rows: DataFrame, tokens: str, block_tokens: int) -> int:
    total = rows.agg(F.sum(F.size(tokens))).first()[0] or 0
    return max(1, -(-total // block_tokens))


def in_blocks(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))


def deal(rows: DataFrame, tokens: str, block_tokens: int) -> DataFrame:
    """Add ``block``: rows by a hash of their place, in so many blocks that each has about ``block_tokens`` tokens."""
    return in_blocks(rows, block_count(rows, tokens, block_tokens))


def ragged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in lists], dtype=np.int64)
    return (np.concatenate(lists) if lists else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum(size)])


def spans(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat places of the named spans, and their sizes."""
    size = at[which + 1] - at[which]
    ends = np.cumsum(size)
    return np.repeat(at[which] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0), size


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds and aliases for draws in constant time, in proportion to ``weights``."""
    n = len(weights)
    share, other = weights * (n / weights.sum()), np.arange(n)
    small, large = [i for i in range(n) if share[i] < 1], [i for i in range(n) if share[i] >= 1]
    while small and large:
        s, big = small.pop(), large[-1]
        other[s] = big
        share[big] -= 1 - share[s]
        if share[big] < 1:
            small.append(large.pop())
    for i in small + large:
        share[i] = 1.0
    return share, other


def draws(table: tuple[np.ndarray, np.ndarray], shape: tuple[int, ...], rng: np.random.Generator) -> np.ndarray:
    share, other = table
    k = rng.integers(len(share), size=shape)
    return np.where(rng.random(shape) < share[k], k, other[k])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# groups of blocks -----------------------------------------------------------------------------------


@dataclass
class TextGroups:
    """Texts as ids, a row for each block, and for each group of blocks a row of the ids that it needs (``names``).

    A block's row has what was given of its texts (``own``), their sizes, and all their ids as places in ``names``.
    The ids of parameters that every block needs come last in ``names``.
    """

    rows: DataFrame
    n: int
    dim: int

    def parts(self, params: DataFrame | None = None) -> int:
        """Parts that ids are dealt to where vectors meet."""
        return max(self.n, self.rows.sparkSession.sparkContext.defaultParallelism, -(-params.count() // PART) if params is not None else 0)

    def with_vectors(self, answers: DataFrame | None, run: Callable, schema) -> DataFrame:
        """``run`` on each group's rows and the vectors found for it."""
        rows = self.rows if answers is None else self.rows.unionByName(answers, allowMissingColumns=True)
        if answers is None:
            rows = rows.withColumns({c.split(" ")[0]: F.lit(None).cast(c.split(" ")[1]) for c in ANSWER.split(", ")[1:]})
        return rows.repartitionById(self.n, F.col("grp")).mapInArrow(run, schema)


def text_groups(df: DataFrame, own: str, dim: int, grams: int, subwords: tuple[int, int] | None, buckets: int, block_tokens: int, layers: list[int] = ()) -> TextGroups:
    """Texts with their ids (words, their n-grams, and word n-grams in buckets) in blocks and groups of blocks; ``layers`` are ids that all need. Stored."""
    tokens = F.coalesce("tokens", F.array().cast("array<string>"))
    ids = F.transform(tokens, lambda w: word_id(w, "input")) if subwords is None else F.flatten(F.transform(tokens, lambda w: input_ids(w, subwords, buckets)))
    if grams > 1:
        ids = F.concat(ids, bucket_ids(word_ngrams(tokens, 2, grams), buckets))
    rows = df.select(F.col(own).alias("own"), ids.alias("ids"))
    n_blocks = block_count(rows, "ids", block_tokens)
    rows = in_blocks(rows, n_blocks)
    # blocks are dealt by a hash, so a few tell how many ids one has
    most = rows.where("block < 4").select("block", F.explode("ids").alias("id")).groupBy("block").agg(F.count_distinct("id").alias("n")).agg(F.max("n")).first()[0] or 0
    each = max(1, GROUP_BYTES // ((most + len(layers) + 1) * (12 * dim + 64)))
    n = min(n_blocks, max(df.sparkSession.sparkContext.defaultParallelism, -(-n_blocks // each)))
    kind = rows.schema["own"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        schema = pa.schema([("grp", pa.int32()), ("block", pa.int64()), ("own", pa.list_(given[0].schema.field("own").type)), ("sizes", pa.list_(pa.int32())), ("places", pa.binary()), ("names", pa.binary())])
        table = pa.Table.from_batches(given).combine_chunks()
        grp, block, packed = table.column("grp")[0].as_py(), table.column("block").to_numpy(), []
        for b in np.unique(block):
            few = table.select(["own", "ids"]).take(pa.array(np.flatnonzero(block == b))).combine_chunks()
            lists = few.column("ids").chunk(0)
            names, at, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
            packed.append((int(b), few.column("own").chunk(0), lists.value_lengths(), names, at.astype(np.int32), times))
        names, place = np.unique(np.concatenate([x[3] for x in packed]), return_inverse=True)
        # frequent ids get small numbers, which take least room
        order = np.argsort(-np.bincount(place, np.concatenate([x[5] for x in packed]), len(names)), kind="stable")
        number = np.empty(len(names), np.int32)
        number[order] = np.arange(len(names), dtype=np.int32)
        yield pa.record_batch([pa.array([grp], pa.int32()), pa.array([None], pa.int64()), pa.array([None], schema.field("own").type), pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.binary()), pa.array([np.append(names[order], np.array(layers, np.int64)).tobytes()])], schema=schema)
        lo = 0
        for b, values, sizes, own_names, at, _ in packed:
            places = number[place[lo : lo + len(own_names)]][at]
            lo += len(own_names)
            yield pa.record_batch([pa.array([grp], pa.int32()), pa.array([b]), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), sizes.cast(pa.int32())), pa.array([squeezed(places)]), pa.array([None], pa.binary())], schema=schema)

    dealt = rows.withColumn("grp", F.pmod("block", F.lit(n)).cast("int")).select("grp", "block", "own", "ids").repartitionById(n, F.col("grp"))
    return TextGroups(stored(dealt.mapInArrow(run, f"grp int, block long, own array<{kind}>, sizes array<int>, places binary, names binary"), "text-groups"), n, dim)


def received(batches: Iterator[pa.RecordBatch], parts: int, dim: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, list[dict]] | None:
    """A group's number, names, their vectors, which of these are known, and its blocks in their order."""
    names, answers, blocks = None, [], []
    for batch in batches:
        for r in batch.to_pylist():
            if r["names"] is not None:
                names, grp = np.frombuffer(r["names"], np.int64), r["grp"]
            else:
                (blocks if r["vecs"] is None else answers).append(r)
    if names is None:
        return None
    held, known, part = np.zeros((len(names), dim), np.float32), np.zeros(len(names), bool), np.mod(names, parts)
    for r in answers:
        at = asked(part, r["part"], r["known"])
        held[at], known[at] = np.frombuffer(r["vecs"], np.float32).reshape(-1, dim), True
    return grp, names, held, known, sorted(blocks, key=lambda r: r["block"])


def asked(part: np.ndarray, p: int, known: bytes) -> np.ndarray:
    """Places of the names of a part that are known."""
    at = np.flatnonzero(part == p)
    return at[np.unpackbits(np.frombuffer(known, np.uint8), count=len(at)).astype(bool)]


def distinct_shares(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct ids, and the share of its tokens that each has."""
    own, n = np.unique(ids, return_counts=True)
    return own, (n / max(1, len(ids))).astype(np.float32)


def squeezed(numbers: np.ndarray) -> bytes:
    """Compressed by place of the bytes: the high ones are mostly zero."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def texts_of(block: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places of a block's distinct ids in its group's names, and its texts as numbers of these."""
    ends = np.cumsum(block["sizes"])
    flat = unsqueezed(block["places"], int(ends[-1]))
    own, at = np.unique(flat, return_inverse=True)
    return own, np.split(at, ends[:-1])


def vector_rows(ids: np.ndarray, vectors: np.ndarray, steps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows as in ``VECTOR``."""
    for lo in range(0, len(ids), ROWS):
        few = np.ascontiguousarray(vectors[lo : lo + ROWS], np.float32)
        ends = np.arange(len(few) + 1, dtype=np.int32) * (4 * few.shape[1])
        yield pa.record_batch([pa.array(ids[lo : lo + ROWS]), pa.BinaryArray.from_buffers(pa.binary(), len(few), [None, pa.py_buffer(ends), pa.py_buffer(few)]), pa.array(steps[lo : lo + ROWS])], ["id", "vec", "steps"])


def answer(grp: int, part: int, known: bytes, vectors: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([grp], pa.int32()), pa.array([part], pa.int32()), pa.array([known], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], ["grp", "part", "known", "vecs"])


def looked_up(groups: TextGroups, params: DataFrame, parts: int) -> DataFrame:
    """The vectors that each group needs, as in ``ANSWER``; ids that the table lacks are not known."""
    dim = groups.dim

    def ask(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                names = np.frombuffer(r["names"], np.int64)
                part = np.mod(names, parts)
                for p in np.unique(part).tolist():
                    yield pa.record_batch([pa.array([p], pa.int32()), pa.array([r["grp"]], pa.int32()), pa.array([names[part == p].tobytes()])], ["part", "grp", "ids"])

    def find(batches: Iterator[pa.RecordBatch]):
        ids, vectors, requests, part = [], [], [], None
        for batch in batches:
            is_vector = batch.column("ids").is_null()
            found = batch.filter(is_vector)
            if found.num_rows:
                ids.append(found.column("id").to_numpy())
                vectors.append(matrix_of(found.column("vec"), dim))
            requests += batch.filter(pc.invert(is_vector)).select(["part", "grp", "ids"]).to_pylist()
        if not requests or not ids:
            return
        ids, vectors = np.concatenate(ids), np.concatenate(vectors)
        order = np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        for r in requests:
            want = np.frombuffer(r["ids"], np.int64)
            at = np.minimum(np.searchsorted(ids, want), len(ids) - 1)
            known = ids[at] == want
            yield answer(r["grp"], r["part"], np.packbits(known).tobytes(), vectors[at[known]])

    requests = groups.rows.where("names is not null").select("grp", "names").mapInArrow(ask, "part int, grp int, ids binary")
    both = requests.unionByName(params.select(F.pmod("id", F.lit(parts)).cast("int").alias("part"), "id", "vec"), allowMissingColumns=True)
    return both.repartitionById(parts, F.col("part")).mapInArrow(find, ANSWER)


def matrix_of(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), np.float32).reshape(-1, dim)


def mean_vectors(updates: DataFrame, parts: int, dim: int, as_rows: bool, rest: DataFrame | None = None) -> DataFrame:
    """The mean vector of each id, weighed by steps: as rows, with those of ``rest`` that no group has, or as answers to the groups that have it."""
    more = rest is not None

    def run(batches: Iterator[pa.RecordBatch]):
        chunks, others = [], []
        for batch in batches:
            is_other = batch.column("ids").is_null()
            chunks += batch.filter(pc.invert(is_other)).select(["part", "grp", "ids", "known", "vecs", "steps"]).to_pylist()
            if more:
                others.append(batch.filter(is_other).select(["id", "vec", "weight"]))
        ids = [np.frombuffer(c["ids"], np.int64) for c in chunks]
        every, at = np.unique(np.concatenate([np.zeros(0, np.int64), *ids]), return_inverse=True)
        total, steps, ends = np.zeros((len(every), dim)), np.zeros(len(every)), np.cumsum([0, *map(len, ids)])
        for c, lo, hi in zip(chunks, ends, ends[1:]):  # a chunk has an id once
            n = np.frombuffer(c["steps"])
            total[at[lo:hi]] += np.frombuffer(c["vecs"], np.float32).reshape(-1, dim) * n[:, None]
            steps[at[lo:hi]] += n
        total /= np.maximum(steps, 1e-300)[:, None]
        mean = total.astype(np.float32)
        if not as_rows:
            for c, lo, hi in zip(chunks, ends, ends[1:]):
                yield answer(c["grp"], c["part"], c["known"], mean[at[lo:hi]])
            return
        yield from vector_rows(every, mean, steps)
        for b in others:
            kept = b.filter(pa.array(~np.isin(b.column("id").to_numpy(), every)))
            yield pa.record_batch(kept.columns, ["id", "vec", "steps"])

    if more:
        updates = updates.unionByName(rest.select(F.pmod("id", F.lit(parts)).cast("int").alias("part"), "id", "vec", F.col("steps").alias("weight")), allowMissingColumns=True)
    return updates.repartitionById(parts, F.col("part")).mapInArrow(run, VECTOR if as_rows else ANSWER)


def group_epochs(groups: TextGroups, layers: list[int], zero: list[int], start: DataFrame | None, every: range, train: Callable, rest: bool) -> DataFrame:
    """The vectors after the epochs ``every``; with ``rest`` those of ``start`` that no text needs stay in the table.

    ``train(epoch, block, values, texts, vectors, layers)`` takes a block's steps in place and returns how many there were by vector and by layer. ``zero`` are layers that begin at zero.
    """
    dim, n_layers = groups.dim, len(layers)
    parts = groups.parts(start)

    def steps(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]):
            got = received(batches, parts, dim)
            if got is None:
                return
            grp, names, held, known, blocks = got
            nothing = set(zero)
            for k in np.flatnonzero(~known).tolist():
                if (i := int(names[k])) not in nothing:
                    held[k] = first_vector(i, dim)
            total, weight, upper = np.zeros((len(names), dim)), np.zeros(len(names)), np.arange(len(names) - n_layers, len(names))
            for block in blocks:
                own, texts = texts_of(block)
                a, o = held[own], held[upper]
                for at, after, used in zip((own, upper), (a, o), train(epoch, block["block"], block["own"], texts, a, o)):
                    # those without a step go on as they are
                    w = np.where(used > 0, used, np.where(known[at], 1e-9, 0.0))
                    total[at] += after * w[:, None]
                    weight[at] += w
            vectors, part = (total / np.maximum(weight, 1e-300)[:, None]).astype(np.float32), np.mod(names, parts)
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p)
                has = weight[at] > 0
                at = at[has]
                cells = [p, grp, names[at].tobytes(), np.packbits(has).tobytes(), vectors[at].tobytes(), weight[at].tobytes()]
                yield pa.record_batch([pa.array([x], t) for x, t in zip(cells, (pa.int32(), pa.int32(), *[pa.binary()] * 4))], ["part", "grp", "ids", "known", "vecs", "steps"])

        return run

    answers = looked_up(groups, start, parts) if start is not None else None
    for k, epoch in enumerate(every, 1):
        last = k == len(every)
        updates = groups.with_vectors(answers, steps(epoch), UPDATE)
        answers = mean_vectors(updates, parts, dim, last, start if last and rest else None)
        if not last and k % LINEAGE == 0:
            answers = stored(answers, "answers")
    return answers if len(every) else start if start is not None else groups.rows.sparkSession.createDataFrame([], VECTOR)


# skip-gram ------------------------------------------------------------------------------------------


@dataclass
class SubwordVectors:
    """Trained vectors by id, and the words learned from; a vector is the mean of a word's ids that are known."""

    vectors: DataFrame
    words: DataFrame
    dim: int
    subwords: tuple[int, int]
    buckets: int

    def of(self, words: DataFrame, word: str = "word") -> DataFrame:
        """(word, vector) of any words, unseen ones by their n-grams; null if no id is known."""
        ids = words.select(F.col(word).alias("word")).distinct().select("word", F.explode(F.array_distinct(input_ids(F.col("word"), self.subwords, self.buckets))).alias("id"))
        found = ids.join(self.vectors, "id").select("word", "vec").groupBy("word")

        def mean(key, table):
            own = np.mean([np.frombuffer(v.as_buffer(), dtype=np.float32) for v in table.column("vec").combine_chunks()], axis=0)
            return pa.table([pa.array([key[0].as_py()]), pa.array([own.tolist()], pa.list_(pa.float32()))], ["word", "vector"])

        return words.select(F.col(word).alias("word")).distinct().join(found.applyInArrow(mean, "word string, vector array<float>"), "word", "left")


def skip_gram(df: DataFrame, tokens: str = "tokens", dim: int = 300, n_epochs: int = 5, rate: float = 0.05, subwords: tuple[int, int] = (3, 6), buckets: int = 2_000_000, min_count: int = 5, window: int = 5, negatives: int = 5, sample: float = 1e-4, block_tokens: int = 1 << 19, seed: int = 1) -> SubwordVectors:
    """Skip-gram vectors of words and their hashed character n-grams, with negative sampling.

    Noise words are drawn from the block's own words by the square root of their occurrences, frequent words are
    thinned out by ``sample``, the rate falls evenly to 0. Null texts and words with fewer than ``min_count`` occurrences take no part.
    """
    spark = df.sparkSession
    n_pieces = F.ceil(F.size(tokens) / PIECE).cast("int")
    pieces = df.where(F.size(tokens) > 0).select(F.explode(F.transform(F.sequence(F.lit(0), n_pieces - 1), lambda k: F.slice(tokens, k * PIECE + 1, PIECE))).alias("tokens"))
    pieces = stored(deal(pieces, "tokens", block_tokens), "pieces", "zstd")
    met = stored(pieces.select("block", F.explode("tokens").alias("word")).groupBy("block", "word").agg(F.count(F.lit(1)).alias("k")), "block-words")
    words = stored(met.groupBy("word").agg(F.sum("k").alias("n")).where(F.col("n") >= min_count), "words")
    total = words.agg(F.sum("n")).first()[0] or 1
    own = stored(met.join(words, "word").select("block", "word", "n", input_ids(F.col("word"), subwords, buckets).alias("ids"), word_id(F.col("word"), "target").alias("target")), "block-words")
    needs = stored(own.select("block", F.explode(F.array_distinct(F.concat("ids", F.array("target")))).alias("id")).distinct(), "needs")
    examples = pieces.select("block", "tokens", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("long").alias("target"))
    examples = examples.unionByName(own.select("block", F.lit(None).cast("array<string>").alias("tokens"), "word", "n", "ids", "target"))

    def train(epoch: int, table: pa.Table, held: dict[int, np.ndarray]):
        rng = np.random.default_rng([seed, epoch, table.column("block")[0].as_py()])
        known = [(r["word"], r["n"], r["ids"], r["target"]) for r in table.select(["word", "n", "ids", "target"]).to_pylist() if r["word"] is not None]
        number = {w: k for k, (w, *_) in enumerate(known)}
        if not known:
            return
        targets = [t for *_, t in known]
        inputs = sorted({i for _, _, ids, _ in known for i in ids})
        place = {i: k for k, i in enumerate(inputs)}
        a, o = local_vectors(inputs, held, dim, set()).copy(), local_vectors(targets, held, dim, set(targets)).copy()
        flat, at = ragged([np.array([place[i] for i in ids]) for _, _, ids, _ in known])
        n = np.array([x for _, x, *_ in known], dtype=np.float64)
        keep = np.minimum(1.0, np.sqrt(sample * total / n) + sample * total / n)
        noise = alias_table(np.sqrt(n))
        centres, contexts = [], []
        for piece in table.column("tokens").to_pylist():
            w = np.array([number[x] for x in piece or () if x in number], dtype=np.int64)
            w = w[rng.random(len(w)) < keep[w]]
            reach = rng.integers(1, window + 1, len(w))
            for off in range(1, window + 1):
                for x, y in ((slice(0, -off), slice(off, None)), (slice(off, None), slice(0, -off))):
                    near = reach[x] >= off
                    centres.append(w[x][near])
                    contexts.append(w[y][near])
        centre, context = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (centres, contexts))
        order = rng.permutation(len(centre))
        used_in, used_out = np.zeros(len(inputs)), np.zeros(len(targets))
        for lo in range(0, len(order), 64):
            c, y = centre[order[lo : lo + 64]], context[order[lo : lo + 64]]
            lr = rate * (1 - (epoch + lo / len(order)) / n_epochs)
            where, size = spans(at, c)
            ids, starts = flat[where], np.concatenate([[0], np.cumsum(size)[:-1]])
            h = np.add.reduceat(a[ids], starts, axis=0) / size[:, None]
            other = draws(noise, (len(c), negatives), rng)
            to = np.concatenate([y[:, None], other], axis=1)
            wanted = np.zeros(to.shape, dtype=np.float32)
            wanted[:, 0] = 1
            g = lr * (wanted - sigmoid(np.einsum("bd,bkd->bk", h, o[to])))
            g[:, 1:][other == y[:, None]] = 0
            pull = np.einsum("bk,bkd->bd", g, o[to])
            np.add.at(o, to.ravel(), (g[:, :, None] * h[:, None, :]).reshape(-1, dim).astype(np.float32))
            np.add.at(a, ids, np.repeat(pull, size, axis=0).astype(np.float32))
            np.add.at(used_in, ids, 1)
            np.add.at(used_out, to.ravel(), 1)
        for names, matrix, used in ((inputs, a, used_in), (targets, o, used_out)):
            for k in np.flatnonzero(used):
                yield names[k], matrix[k].tobytes(), float(used[k])

    vectors = epochs(examples, needs, None, n_epochs, train, spark)
    discard(pieces, met, own, needs)
    return SubwordVectors(vectors, words, dim, subwords, buckets)


# hierarchical softmax -------------------------------------------------------------------------------


def code_tree(counts: list[int]) -> tuple[list[tuple[int, int]], list[list[int]], list[list[int]]]:
    """The Huffman tree of label counts: children of each inner node (a label k as ``~k``), and each label's inner nodes and turns from the root."""
    heap = [(n, k, ~k) for k, n in enumerate(counts)]
    heapq.heapify(heap)
    children: list[tuple[int, int]] = []
    while len(heap) > 1:
        (n, _, x), (m, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        children.append((x, y))
        heapq.heappush(heap, (n + m, len(counts) + len(children), len(children) - 1))
    paths, turns = [[] for _ in counts], [[] for _ in counts]
    todo = [(len(children) - 1, [], [])] if children else []
    while todo:
        at, path, turn = todo.pop()
        for t, child in enumerate(children[at]):
            if child < 0:
                paths[~child], turns[~child] = [*path, at], [*turn, t]
            else:
                todo.append((child, [*path, at], [*turn, t]))
    return children, paths, turns


def best_labels(children: list[tuple[int, int]], right: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k most likely labels with their probabilities, best first; ``right`` is the probability of the second child at each inner node.

    Best-first search: a subtree is looked into only if its own probability may still beat a label found.
    """
    if not children:
        return [(0, 1.0)]
    queue, out = [(-1.0, 0, len(children) - 1)], []
    while queue and len(out) < k:
        p, leaf, at = heapq.heappop(queue)
        if leaf:
            out.append((~at, -p))
            continue
        for child, share in zip(children[at], (1 - right[at], right[at])):
            heapq.heappush(queue, (p * float(share), int(child < 0), child))
    return out


@dataclass
class SubwordClassifier:
    """Input vectors by id, the label tree with the vectors of its inner nodes, and how texts become ids."""

    vectors: DataFrame
    nodes: np.ndarray
    labels: list[str]
    counts: list[int]
    dim: int
    grams: int
    subwords: tuple[int, int] | None
    buckets: int

    def save(self, path: str) -> None:
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        meta = json.dumps({"nodes": self.nodes.tolist(), "labels": self.labels, "counts": self.counts, "dim": self.dim, "grams": self.grams, "subwords": self.subwords, "buckets": self.buckets})
        self.vectors.sparkSession.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SubwordClassifier:
        m = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
        m["nodes"], m["subwords"] = np.array(m["nodes"], dtype=np.float32).reshape(-1, m["dim"]), tuple(m["subwords"]) if m["subwords"] else None
        return SubwordClassifier(vectors=spark.read.parquet(f"{path}/vectors"), **m)

    def predict(self, df: DataFrame, k: int = 1, tokens: str = "tokens", doc: str = "row_id", block_tokens: int = 1 << 19) -> DataFrame:
        """(doc, rank, label, score, runtime): each text's k most likely labels; ``runtime`` is its block's mean milliseconds a text.

        A text without a known id is judged by the zero vector.
        """
        children, _, _ = code_tree(self.counts)
        nodes, labels, dim = self.nodes, self.labels, self.dim
        groups = text_groups(df.select(F.col(doc).alias("_doc"), F.col(tokens).alias("tokens")), "_doc", dim, self.grams, self.subwords, self.buckets, block_tokens)
        parts, kind = groups.parts(self.vectors), df.schema[doc].dataType

        def run(batches: Iterator[pa.RecordBatch]):
            batches = iter(batches)
            if (one := next(batches, None)) is None:
                return
            own_type = one.schema.field("own").type.value_type
            _, _, held, known, blocks = received(chain([one], batches), parts, dim)
            for block in blocks:
                began = time.perf_counter()
                own, texts = texts_of(block)
                vectors, has, out = held[own], known[own], []
                for d, ids in zip(block["own"], texts):
                    ids = ids[has[ids]]
                    h = vectors[ids].mean(axis=0) if len(ids) else np.zeros(dim, np.float32)
                    out += [(d, r, labels[x], p) for r, (x, p) in enumerate(best_labels(children, sigmoid(nodes @ h), k), 1)]
                each = 1000 * (time.perf_counter() - began) / max(1, len(texts))
                columns = list(zip(*out)) if out else [[]] * 4
                yield pa.record_batch([pa.array(columns[0], own_type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.float64()), pa.array([each] * len(out), pa.float64())], [doc, "rank", "label", "score", "runtime"])

        return groups.with_vectors(looked_up(groups, self.vectors, parts), run, f"{doc} {kind.simpleString()}, rank int, label string, score double, runtime double")


def train_classifier(df: DataFrame, tokens: str = "tokens", label: str = "label", dim: int = 300, n_epochs: int = 20, rate: float = 0.1, grams: int = 1, subwords: tuple[int, int] | None = None, buckets: int = 200_000, pretrained: SubwordVectors | None = None, block_tokens: int = 1 << 19, seed: int = 1, passes: int = 1) -> SubwordClassifier:
    """A linear classifier on the mean of a text's vectors, with hierarchical softmax over the labels' Huffman tree.

    ``pretrained`` vectors are where training begins; blocks go ``passes`` times over their rows in an epoch before vectors are averaged. Rows without a label take no part; labels are counted in
    the driver, whose memory they bound.
    """
    spark = df.sparkSession
    df = df.where(F.col(label).isNotNull())
    known = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    labels = sorted(known)
    counts = [known[x] for x in labels]
    children, paths, turns = code_tree(counts)
    number = F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1
    own = F.transform(F.sequence(F.lit(0), F.lit(max(0, len(children) - 1))), lambda k: F.xxhash64(F.lit("node"), k))
    node_ids = [r[0] for r in spark.range(1).select(F.explode(own)).collect()][: len(children)]
    groups = text_groups(df.select(number.cast("int").alias("label"), F.col(tokens).alias("tokens")), "label", dim, grams, subwords, buckets, block_tokens, node_ids)

    def train(epoch: int, block: int, y: list[int], texts: list[np.ndarray], a: np.ndarray, o: np.ndarray):
        rng = np.random.default_rng([seed, epoch, block])
        used_in, used_out = np.zeros(len(a)), np.zeros(len(o))
        # a text's distinct ids and their shares of its tokens are found once for all passes
        shares = [distinct_shares(x) for x in texts]
        turn = [np.array(x, dtype=np.float32) for x in turns]
        ways = [np.array(x, dtype=np.int64) for x in paths]
        for t, r in enumerate(np.concatenate([rng.permutation(len(texts)) for _ in range(passes)])):
            ids, share = shares[r]
            if not len(ids) or not node_ids:
                continue
            lr = rate * (1 - (epoch + t / (passes * len(texts))) / n_epochs)
            path = ways[y[r]]
            own, upper = a[ids], o[path]
            h = share @ own
            g = lr * (turn[y[r]] - sigmoid(upper @ h))
            a[ids] = own + share[:, None] * (g @ upper).astype(np.float32)
            o[path] = upper + g[:, None] * h
            used_in[ids] += 1
            used_out[path] += 1
        return used_in, used_out

    vectors = group_epochs(groups, node_ids, node_ids, pretrained.vectors if pretrained else None, range(n_epochs), train, pretrained is not None)
    vectors = stored(vectors, "vectors") if n_epochs else vectors
    discard(groups.rows)
    found = {r[0]: np.frombuffer(bytes(r[1]), dtype=np.float32) for r in vectors.where(F.col("id").isin(node_ids)).select("id", "vec").collect()} if node_ids else {}
    nodes = np.stack([found.get(i, np.zeros(dim, np.float32)) for i in node_ids]) if node_ids else np.zeros((0, dim), np.float32)
    return SubwordClassifier(vectors, nodes, labels, counts, dim, grams, subwords, buckets)


def train_grid(df: DataFrame, folder: str, grid: list[dict], name: Callable[[dict], str], **options) -> dict[str, SubwordClassifier]:
    """A classifier for each set of parameters, saved below ``folder``; those already there are read back, not trained."""
    spark, out = df.sparkSession, {}
    for params in grid:
        path = f"{folder}/{name(params)}"
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            train_classifier(df, **{**options, **params}).save(path)
        out[path] = SubwordClassifier.load(spark, path)
    return out
