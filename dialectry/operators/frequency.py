"""Which terms may be frequent enough: a count-min sketch of document frequencies, as a bitmap that Catalyst expressions read.

Counters stop at the frequency that is asked for, so a task's sketch has a fixed size, whatever it reads, and sketches
merge by addition. A term's estimate is never below its true frequency: what is dropped can't be frequent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialectry.sources.scratch import stored

#: Counters of one row of a partial sketch.
CHUNK = 1 << 16
#: Hashes that are counted at once.
BLOCK = 1 << 20


def _places(h: np.ndarray, bits: int, depth: int):
    """The counter of each hash in each line of the sketch: disjoint bits of the hash."""
    return [((h >> np.uint64(d * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64) for d in range(depth)]


def _counter(least: int):
    """The smallest type that holds twice the bound, so that two counters can be added."""
    return np.uint8 if least < 1 << 7 else np.uint16 if least < 1 << 15 else np.uint64


def bitmaps(terms: DataFrame, least: int, bits: int = 22, depth: int = 2) -> DataFrame:
    """(line, words): of each line of the sketch, the counters that reach ``least``, as bits in arrays of longs.

    ``terms`` has a row, with a column ``term``, for each document and each of its distinct terms; nulls count as a term that nobody asks for.
    With a column ``n`` a row stands for so many documents. Lines have 2^bits counters and take ``bits`` of a term's 64-bit hash each.
    """
    if bits * depth > 64 or bits < 16:
        raise ValueError("lines of a sketch need 16 bits at least, and 64 in all")
    kind, size = _counter(least), 1 << bits
    counts = "line int, chunk int, counters binary"

    def count(batches):
        table, held, n = np.zeros((depth, size), kind), [], 0

        def add():
            if held:
                hashes, times = map(np.concatenate, zip(*held, strict=True))
                for line, at in zip(table, _places(hashes, bits, depth), strict=True):
                    slots, of = np.unique(at, return_inverse=True)
                    line[slots] = np.minimum(line[slots] + np.bincount(of, times).astype(np.uint64), least)
                held.clear()

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= BLOCK:
                add()
                n = 0
        add()
        yield from _rows(((d, k, table[d, k * CHUNK : (k + 1) * CHUNK]) for d in range(depth) for k in range(size // CHUNK)))

    def merge(batches):
        sums = {}
        for batch in batches:
            for line, chunk, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(raw, kind) if raw else np.zeros(CHUNK, kind)
                old = sums.get((line, chunk))
                sums[line, chunk] = part if old is None else np.minimum(old + part, least)
        for (line, chunk), part in sums.items():
            words = np.packbits(part >= least, bitorder="little").view(np.int64)
            yield pa.record_batch([pa.array([line], pa.int32()), pa.array([chunk], pa.int32()), pa.array([words.tolist()], pa.list_(pa.int64()))], ["line", "chunk", "words"])

    every = F.col("id") % (size // CHUNK)
    none = terms.sparkSession.range(depth * size // CHUNK, numPartitions=1).select((F.col("id") / (size // CHUNK)).cast("int").alias("line"), every.cast("int").alias("chunk"), F.lit(b"").alias("counters"))
    times = F.col("n") if "n" in terms.columns else F.lit(1)
    parts = terms.select(F.xxhash64("term").alias("h"), times.cast("long").alias("n")).mapInArrow(count, counts).unionByName(none)
    merged = parts.repartition("line", "chunk").mapInArrow(merge, "line int, chunk int, words array<long>")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "words"))), lambda c: c["words"]))
    return merged.groupBy("line").agg(whole.alias("words"))


def _rows(parts):
    """Chunks that hold anything."""
    for line, chunk, part in parts:
        if part.any():
            yield pa.record_batch([pa.array([line], pa.int32()), pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["line", "chunk", "counters"])


def frequent_terms(terms: DataFrame, least: int, bits: int = 22, depth: int = 2) -> Callable[[Column], Column]:
    """A condition on a term that is false only where the term surely is in fewer than ``least`` documents.

    The sketch is stored once and read by the plan as scalar subqueries, of ``depth`` times 2^bits bits (1 MB by default).
    With many more distinct terms than counters it passes more of them; exact counts decide among what passes.
    """
    if least <= 1:
        return lambda t: F.lit(True)
    kept = stored(bitmaps(terms, least, bits, depth), "frequent")
    lines = [kept.where(F.col("line") == d).select("words").scalar() for d in range(depth)]

    def reaches(h: Column, line: Column, d: int) -> Column:
        at = F.shiftrightunsigned(h, d * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        return F.getbit(F.get(line, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    return lambda t: reduce(lambda a, b: a & b, [reaches(F.xxhash64(t), line, d) for d, line in enumerate(lines)])
