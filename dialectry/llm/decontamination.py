"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Items are partitioned by the size of their shingle set in powers of two. For a partition with sizes
up to s, the stream of a corpus batch's shingles is cut into blocks of s/2, and every three adjacent
blocks are a window: each item of the partition that occurs in a text lies wholly in one window, and
fills a quarter of it at least. So the Jaccard similarity of item and window stays high however long
the document is, and some of ``hashes`` MinHash values agree (at containment 0.8 and the least
favourable size one in 100,000 is missed, at full containment fewer). Candidates are verified by the exact share of the
item's shingles that the whole document contains.

An item whose parts lie far apart is found as well: a hash's value agrees where the item's smallest
shingle stands in the text and is the smallest of any window there, for which the window's other shingles count but not the
item's other parts; of 2,000 items cut into pieces of six words and strewn over texts of 3,000 words none
was missed.

Items are stored and broadcast in blocks of about ``items_at_once`` items and ``BYTES`` bytes; a larger
benchmark takes more passes. Words are runs of ASCII letters and digits and of non-ASCII characters, lower-cased.

Defined results: items and documents with fewer than k words have their whole sequence as the only
shingle, so such an item matches equal texts only; without words they match nothing. Null ids are carried along; repeated rows give repeated
results; empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectry.llm.common import Shingler, alnum_words, random64, stored, text_buffer

SCHEMA = "doc_id long, item_id long, shared long, item_shingles long, containment double"
ROWS = 1000  #: documents whose shingles are searched as one stream
BYTES = 1 << 26  #: text of the items in one block


def _levels(low: np.ndarray, most: int) -> list[np.ndarray]:
    """Minima of aligned blocks of 1, 2, 4 ... ``most`` values; the last block may be short."""
    out = [low]
    while (1 << (len(out) - 1)) < most:
        v = out[-1]
        m = np.minimum(v[0 : len(v) - 1 : 2], v[1::2])
        out.append(np.concatenate([m, v[-1:]]) if len(v) % 2 else m)
    return out


class ItemIndex:
    """Signatures of one block of items by size partition."""

    def __init__(self, ids: list[int], texts: list[str], k: int, hashes: int):
        s = Shingler(k, alnum_words())
        own, at = s.shingles(*text_buffer(pc.utf8_lower(pa.array(texts, pa.string()))))
        self.k, self.multipliers = k, (random64(hashes, 0xC0DE) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.ids, self.sets = [], []
        self.by_class: dict[int, list[int]] = {}
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            items = np.unique(own[a:b])
            if len(items):
                # the place in a text matters for the window: repeats inside an item count
                self.by_class.setdefault(max(1, int(b - a - 1).bit_length()), []).append(len(self.ids))
                self.ids.append(ids[i])
                self.sets.append(items)
        self.values: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.seen: dict[tuple[int, int], np.ndarray] = {}
        for c, members in self.by_class.items():
            for h, m in enumerate(self.multipliers):
                low = np.array([int(((self.sets[i] >> np.uint64(32)).astype(np.uint32) * m).min()) for i in members], dtype=np.uint32)
                order = np.argsort(low, kind="stable")
                self.values[c, h] = low[order], np.array(members)[order]
                flag = np.zeros(1 << 16, dtype=bool)
                flag[low & np.uint32(0xFFFF)] = True
                self.seen[c, h] = flag

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs that share a MinHash value in some window."""
        found: set[tuple[int, int]] = set()
        if not self.ids or not len(hashes):
            return found
        high = (hashes >> np.uint64(32)).astype(np.uint32)
        most = 1 << (max(self.by_class) - 1)
        for h, m in enumerate(self.multipliers):
            levels = _levels(high * m, most)
            for c in self.by_class:
                v = levels[c - 1]
                w = v.copy()
                w[:-1] = np.minimum(w[:-1], v[1:])
                w[:-2] = np.minimum(w[:-2], v[2:])
                hits = np.flatnonzero(self.seen[c, h][w & np.uint32(0xFFFF)])
                if not len(hits):
                    continue
                low, members = self.values[c, h]
                left, right = np.searchsorted(low, w[hits], "left"), np.searchsorted(low, w[hits], "right")
                block = 1 << (c - 1)
                for x, a, b in zip(hits[left < right], left[left < right], right[left < right]):
                    first = int(np.searchsorted(at, x * block, "right")) - 1
                    last = int(np.searchsorted(at, min((x + 3) * block, len(hashes)), "left")) - 1
                    found.update((row, int(i)) for row in range(first, last + 1) for i in members[a:b])
        return found


def _indexes(docs: DataFrame, items: DataFrame, k: int, hashes: int, items_at_once: int):
    """Broadcast indexes of all items, at most ``items_at_once`` each or about so."""
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("n")).where("text is not null")
    listed = stored(listed, "items")
    count, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // items_at_once), -(-size // BYTES))
    for number in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == number).collect()
        yield docs.sparkSession.sparkContext.broadcast(ItemIndex([r[0] for r in part], [r[1] for r in part], k, hashes))


def _verified(index: ItemIndex, s: Shingler, texts: pa.Array, threshold: float):
    """(row, item, shared) of every item that a text of this batch contains."""
    own, at = s.shingles(*text_buffer(pc.utf8_lower(texts)))
    for row, i in sorted(index.candidates(own, at)):
        shared = int(np.isin(index.sets[i], own[at[row] : at[row + 1]]).sum())
        if shared >= threshold * len(index.sets[i]):
            yield row, i, shared


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, hashes: int = 40, items_at_once: int = 50_000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document and item of which the document contains at least ``threshold``."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for sent in _indexes(docs, items, k, hashes, items_at_once):

        def run(batches, sent=sent):
            index, s = sent.value, Shingler(k, alnum_words())
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    few = batch.slice(lo, ROWS)
                    rows = [(few.column(0)[row].as_py(), index.ids[i], n, len(index.sets[i]), n / len(index.sets[i])) for row, i, n in _verified(index, s, few.column(1), threshold)]
                    kinds = [pa.int64()] * 4 + [pa.float64()]
                    yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["doc_id", "item_id", "shared", "item_shingles", "containment"])

        found = named.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def without_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, hashes: int = 40, items_at_once: int = 50_000, text_col: str = "text") -> DataFrame:
    """The documents that contain no item. Each row is judged by itself, so nothing is joined or shuffled."""
    for sent in _indexes(docs, items, k, hashes, items_at_once):

        @F.pandas_udf("boolean")
        def leaks(texts, sent=sent):
            import pandas as pd

            s, out = Shingler(k, alnum_words()), np.zeros(len(texts), dtype=bool)
            for lo in range(0, len(texts), ROWS):
                for row, _, _ in _verified(sent.value, s, pa.array(texts.iloc[lo : lo + ROWS], pa.string()), threshold):
                    out[lo + row] = True
            return pd.Series(out)

        docs = docs.where(~leaks(F.col(text_col)))
    return docs
