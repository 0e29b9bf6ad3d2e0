"""Shared helpers: scratch tables (from the sources) and vectorised shingle hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectry.sources.scratch import discard, stored  # noqa: F401

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


SLICE = 1 << 22  #: bytes of text that a task works on at once, where no single row holds more


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose strings in ``column`` hold at most ``SLICE`` bytes together, or of one longer row."""
    _, at = text_buffer(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random64(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers, equal in every process."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def lower_table() -> np.ndarray:
    """Byte to byte: A-Z become a-z, all others stay."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def white_words() -> np.ndarray:
    """Byte classes for words ``[^\\x20\\x09-\\x0D]+``: the lower-cased byte plus one, or 0 for white space."""
    t = lower_table().astype(np.uint16) + 1
    t[WHITE] = 0
    return t


def alnum_words() -> np.ndarray:
    """Byte classes for words of ASCII letters, digits and all non-ASCII bytes."""
    t = np.zeros(256, dtype=np.uint16)
    low = lower_table()
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            t[b] = int(low[b]) + 1
    return t


SEGMENT = 1 << 17
ODD = 0x9E3779B97F4A7C15


class Shingler:
    """Hashes of k-word shingles for the rows of a text buffer, in numpy.

    A row with at least one word and fewer than ``k`` has one shingle, its whole sequence; a row
    without words has none. Memory besides the input is about ten bytes per byte of text for flags
    and word hashes plus a fixed segment buffer.
    """

    def __init__(self, k: int, classes: np.ndarray):
        self.k, self.classes = k, classes
        value = random64(257, 0xA5A5)
        value[0] = 0
        self.value = value[classes]
        self.inside = classes > 0
        self._powers(2 * SEGMENT)
        self.step = random64(k, 0x5EED)
        self.short = random64(k + 1, 0xBEEF)

    def _powers(self, n: int) -> None:
        """Powers of an odd number and of its inverse modulo 2^64."""
        self.power = np.multiply.accumulate(np.full(n, ODD, dtype=np.uint64))
        self.inverse = np.multiply.accumulate(np.full(n, pow(ODD, -1, 1 << 64), dtype=np.uint64))

    def words(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of each word, and the n + 1 offsets of the rows' words."""
        if not len(raw):
            none = np.zeros(0, dtype=np.int64)
            return none.astype(np.uint64), none, none, np.zeros(len(at), dtype=np.int64)
        inside = self.inside[raw]
        cuts = at[(at > 0) & (at < len(raw))]
        edge = np.empty_like(inside)
        edge[0] = False
        edge[1:] = inside[:-1]
        edge[cuts] = False
        starts = np.flatnonzero(inside & ~edge)
        edge[-1] = False
        edge[:-1] = inside[1:]
        edge[cuts - 1] = False
        ends = np.flatnonzero(inside & ~edge) + 1
        del inside, edge
        hashes = np.empty(len(starts), dtype=np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT)))
            base = starts[i]
            own = (starts[i:j] - base).astype(np.int64)
            part = raw[base : ends[j - 1]]
            if len(part) > len(self.power):
                self._powers(len(part))
            got = self.value[part]
            got *= self.power[: len(part)]
            # a word's sum starts at its place in the segment; the inverse power moves it to 0
            hashes[i:j] = np.add.reduceat(got, own) * self.inverse[own]
            i = j
        return mix64(hashes), starts, ends, np.searchsorted(starts, at)

    def shingles(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All shingle hashes, repeats included, and the n + 1 offsets of the rows' shingles."""
        words, _, _, rows = self.words(raw, at)
        counts = np.diff(rows)
        made = np.where(counts >= self.k, counts - self.k + 1, np.minimum(counts, 1))
        out_at = np.concatenate([[0], np.cumsum(made)])
        n = len(words)
        full = np.zeros(max(n - self.k + 1, 0), dtype=np.uint64)
        for j in range(self.k):
            full += words[j : j + len(full)] * self.step[j]
        full = mix64(full)
        out = np.empty(int(out_at[-1]), dtype=np.uint64)
        # positions of the first words of full shingles: all but the last k - 1 of each long row
        long = counts >= self.k
        if long.all():
            keep = np.ones(n, dtype=bool)
            for j in range(1, self.k):
                keep[rows[1:] - j] = False
            return full[keep[: len(full)]] if len(full) else out, out_at
        for r in np.flatnonzero(counts > 0):
            a, b = rows[r], rows[r + 1]
            if long[r]:
                out[out_at[r] : out_at[r + 1]] = full[a : b - self.k + 1]
            else:
                whole = (words[a:b] * self.step[: b - a]).sum(dtype=np.uint64, keepdims=True)
                out[out_at[r]] = mix64(whole * self.short[b - a])[0]
        return out, out_at


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    if len(x) > 1:
        keep = np.empty(len(x), dtype=bool)
        keep[0] = True
        np.not_equal(x[1:], x[:-1], out=keep[1:])
        x = x[keep]
    return x


BLOCK = 1 << 16


def pack_counts(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Non-empty blocks of a count array as (block, bytes): sparse pairs or a compressed whole."""
    import zlib

    for k in range(0, len(counts), BLOCK):
        own = counts[k : k + BLOCK]
        at = np.flatnonzero(own)
        if not len(at):
            continue
        if len(at) < BLOCK // 8:
            yield k // BLOCK, b"s" + at.astype("<u2").tobytes() + np.minimum(own[at], 2**32 - 1).astype("<u4").tobytes()
        else:
            yield k // BLOCK, b"d" + zlib.compress(np.minimum(own, 2**32 - 1).astype("<u4").tobytes(), 1)


def add_packed(total: np.ndarray, blob: bytes) -> None:
    import zlib

    if blob[:1] == b"s":
        n = (len(blob) - 1) // 6
        at = np.frombuffer(blob, dtype="<u2", count=n, offset=1)
        total[at] += np.frombuffer(blob, dtype="<u4", count=n, offset=1 + 2 * n)
    else:
        total += np.frombuffer(zlib.decompress(blob[1:]), dtype="<u4")


def summed_blocks(packed: DataFrame, finish) -> list[tuple[int, bytes]]:
    """Sum the (block, data) rows that tasks have emitted; ``finish`` turns a block's totals into bytes.

    Every task emits each of the fixed number of blocks at most once; a summing task streams over
    them and keeps one array per block. What returns to the driver has a fixed bound: one byte
    string per block.
    """

    def add(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("block").to_pylist(), batch.column("data")):
                add_packed(total.setdefault(k, np.zeros(BLOCK, dtype=np.uint64)), blob.as_py())
        keys = sorted(total)
        yield pa.record_batch([pa.array(keys, pa.int32()), pa.array([finish(total[k]) for k in keys], pa.binary())], ["block", "data"])

    return [(r[0], bytes(r[1])) for r in packed.repartition("block").mapInArrow(add, "block int, data binary").collect()]


ID_BUCKETS = 1 << 22  #: bits of a filter on row numbers: a fixed broadcast, whatever the input


def id_hash(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.uint64)) & np.uint64(ID_BUCKETS - 1)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """Packed bits of the numbers in the only column of ``ids``: a filter of fixed size that lets all of them through, and a few more."""

    def mark(batches):
        bits = np.zeros(ID_BUCKETS, dtype=np.int64)
        for batch in batches:
            bits[id_hash(batch.column(0).to_numpy(zero_copy_only=False))] = 1
        for block, data in pack_counts(bits):
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])

    bits = np.zeros(ID_BUCKETS, dtype=bool)
    for block, data in summed_blocks(ids.mapInArrow(mark, "block int, data binary"), lambda c: np.packbits(c > 0).tobytes()):
        bits[block * BLOCK : (block + 1) * BLOCK] = np.unpackbits(np.frombuffer(data, dtype=np.uint8)).astype(bool)
    return np.packbits(bits)


def holds(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which numbers a packed filter lets through."""
    at = id_hash(numbers)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def filter_udf(spark: SparkSession, bits: np.ndarray):
    """A function of a number column: whether a packed filter, broadcast, holds the number. Only that column goes to Python."""
    sent = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def held(numbers):
        return type(numbers)(holds(sent.value, numbers.to_numpy()))

    return held


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many ``_`` behind it as it takes to differ from all columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
