"""Spelling variants: a trie self-join with active-node sets, at edit distance one.

Two words at distance one, the shorter of ``s`` letters, agree in their first ``s // 2`` letters or in
their last ``s - s // 2``. So the vocabulary is dealt out twice: by prefix, and (the same for the trie of
reversed words) by suffix; a part holds the words of ``s`` and ``s + 1`` letters that share the fixed ends. Parts of
more than ``most`` words are halved in the same way, until one letter is left open, which few words can share.

A task builds the tries of its parts, from the letters that are open, and walks down level by level. Each
node keeps its active nodes, those at distance one; a step by a letter keeps the child by that letter of
an active node, and adds the siblings, the parent and the children. Words that end at a node and at an active
node of it are near. Nothing else is compared, and no pair is met twice.

Words are counted before anything is shuffled, and results follow words by joins. Defined results: a null
text has no words; a null doc_id is written as nothing before the colon; repeated rows count each; an
empty table gives an empty result. Only the named columns are read, so further columns do no harm.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialectry.llm.common import discard, lower_table, slices, stored, text_buffer

#: Words that a task's tries hold at once, and the most words of a part before it is halved.
TOGETHER, MOST = 1 << 16, 1 << 16
#: Runs of more bytes than this are hashed one by one.
LONG = 64


# words and their counts -------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1)
    return t


def crc_of_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The CRC-32 of each run, going on from the CRC ``before`` it; all runs step together."""
    table, size = crc_table(), ends - starts
    order = np.argsort(-size, kind="stable")
    c, at, left = ~before[order].astype(np.uint32), starts[order], size[order]
    n_long = int(np.searchsorted(-left, -LONG, "left"))
    for k in range(n_long):
        c[k] = ~np.uint32(zlib.crc32(raw[at[k] : at[k] + left[k]].tobytes(), int(~c[k])))
    active = np.searchsorted(-left, -np.arange(LONG), "left")
    for t in range(LONG):
        hi = int(active[t])  # the runs of more than t bytes
        if hi <= n_long:
            break
        own = c[n_long:hi]
        c[n_long:hi] = table[(own ^ raw[at[n_long:hi] + t]) & np.uint32(255)] ^ (own >> np.uint32(8))
    out = np.empty(len(c), dtype=np.uint32)
    out[order] = ~c
    return out


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[65:91] = t[97:123] = True
    t[0xC3] = True  # the first byte of all letters from U+00C0 to U+00FF
    return t


def written_words(raw: np.ndarray, at: np.ndarray, ids: list, least: int, every: int) -> pa.Array:
    """The words of at least ``least`` letters of all texts, lower-cased, one letter of every ``every``-th hash left out."""
    if not len(raw):
        return pa.array([], pa.large_string())
    low = lower_table()[raw]
    two = low == 0xC3
    inside = letter_table()[raw]
    inside[1:] |= two[:-1]
    edge = np.empty(len(low) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[at] = True
    cuts = np.flatnonzero(edge)
    kept = inside[cuts[:-1]]
    starts, ends = cuts[:-1][kept], cuts[1:][kept]
    wide = np.concatenate([[0], np.cumsum(two)])
    letters = ends - starts - (wide[ends] - wide[starts])
    kept = letters >= least
    starts, ends, letters = starts[kept], ends[kept], letters[kept]
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], dtype=np.uint32)
    h = crc_of_runs(low, starts, ends, before[np.searchsorted(at, starts, "right") - 1]).astype(np.int64)
    spoilt = h % every == 0
    kept = letters - spoilt >= least
    starts, ends, letters, h, spoilt = starts[kept], ends[kept], letters[kept], h[kept], spoilt[kept]
    mark = np.zeros(len(low) + 1, dtype=np.int8)
    mark[starts] += 1
    np.add.at(mark, ends, -1)
    own = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    hit = np.flatnonzero(spoilt)
    if len(hit):
        first = np.flatnonzero((low & 0xC0) != 0x80)  # where letters begin
        gone = first[np.searchsorted(first, starts[hit]) + h[hit] % letters[hit]]
        own[gone] = False
        own[gone[two[gone]] + 1] = False
    place = np.concatenate([[0], np.cumsum(own)])
    offsets = np.append(place[starts], place[-1]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(low[own]))


def vocabulary(docs: DataFrame, least: int = 7, every: int = 31, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n): the distinct words of all texts with their occurrences, counted within slices of texts before they are shuffled."""

    def run(batches):
        for batch in batches:
            for few in slices(batch, "text"):
                counted = pc.value_counts(written_words(*text_buffer(few.column("text")), few.column("doc_id").to_pylist(), least, every))
                yield pa.record_batch([counted.field("values").cast(pa.string()), counted.field("counts")], ["word", "n"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# parts of the vocabulary ------------------------------------------------------------------------------


def _key() -> list[Column]:
    """A part: the letters of its shorter words, how many are fixed at both ends, and these."""
    return [F.col("s"), F.col("i"), F.col("j"), F.expr("left(word, i)"), F.expr("right(word, j)")]


def _halved(rows: DataFrame) -> DataFrame:
    """Each part's words in two parts: the first half of the open letters fixed, or the second."""
    half = F.expr("int((s - i - j) div 2)")
    sides = F.array(F.struct((F.col("i") + half).alias("i"), F.col("j").alias("j")), F.struct(F.col("i").alias("i"), (F.col("s") - F.col("i") - half).alias("j")))
    return rows.withColumn("side", F.explode(sides)).select("word", "n", "s", "side.i", "side.j")


def parts(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, s, i, j): the words in all their parts. Parts of more than ``most`` words are halved while two letters are open."""
    size = F.length("word")
    lengths = F.array(size, size - 1)
    rows = _halved(words.select("word", "n", F.explode(lengths).alias("s"), F.lit(0).alias("i"), F.lit(0).alias("j")).where("s > 0"))
    names = ["s", "i", "j", "a", "b"]
    done = None
    while True:
        keyed = rows.select("word", "n", "s", "i", "j", F.expr("left(word, i)").alias("a"), F.expr("right(word, j)").alias("b"))
        large = stored(keyed.where("s - i - j > 1").groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n"), "large-parts")
        if large.isEmpty():
            discard(large)
            return rows if done is None else done.unionByName(rows)
        small = keyed.join(large, names, "left_anti").drop("a", "b")
        done = small if done is None else done.unionByName(small)
        rows = stored(_halved(keyed.join(large, names, "left_semi").drop("a", "b")), "halved-parts")


# the join ---------------------------------------------------------------------------------------------


class Level:
    """The nodes of one depth: parent, letter, the word that ends here (or -1), and where their children begin."""

    def __init__(self, parent: np.ndarray, letter: np.ndarray):
        self.parent, self.letter = parent, letter
        self.word = np.full(len(parent), -1, dtype=np.int64)


def trie(letters: np.ndarray, size: np.ndarray, root: np.ndarray) -> list[Level]:
    """The tries of words under numbered roots, level by level; a level's nodes are ordered by parent and letter."""
    n_roots = int(root.max()) + 1 if len(root) else 0
    levels = [Level(np.arange(n_roots), np.zeros(n_roots, dtype=np.int64))]
    node, row, depth = root.copy(), np.arange(len(root)), 0
    while True:
        ends = size[row] == depth
        levels[-1].word[node[ends]] = row[ends]
        node, row = node[~ends], row[~ends]
        if not len(row):
            break
        code, node = np.unique(node * 256 + letters[row, depth], return_inverse=True)
        levels.append(Level(code >> 8, code & 255))
        depth += 1
    for level, below in zip(levels, [*levels[1:], Level(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]):
        level.child = np.searchsorted(below.parent, np.arange(len(level.parent) + 1))
        level.code = below.parent * 256 + below.letter
    return levels


def expand(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range each is of."""
    n = stop - start
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + start[which], which


def near_pairs(levels: list[Level]) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs of words of one trie at distance one, by active-node sets propagated from the roots down."""
    none = np.zeros(0, dtype=np.int64)
    child, which = expand(levels[0].child[:-1], levels[0].child[1:])
    active = {-1: (none, none), 0: (none, none), 1: (which, child)}  # node, active node so many levels below
    found = []

    def ended(depth: int) -> None:
        for below, (u, v) in active.items():
            if depth + below < len(levels) and len(u):
                a, b = levels[depth].word[u], levels[depth + below].word[v]
                both = (a >= 0) & (b >= 0)
                found.append((a[both], b[both]))

    ended(0)
    for depth in range(len(levels) - 1):
        here, below = levels[depth], levels[depth + 1]
        own = np.arange(len(below.parent))
        moved = {}
        for by, (u, v) in active.items():
            # a child of u, and the child of v by the same letter
            child, pair = expand(here.child[u], here.child[u + 1])
            if depth + by >= len(levels) - 1 or not len(child):
                moved[by] = (none, none)
                continue
            to = levels[depth + by]
            want = v[pair] * 256 + below.letter[child]
            at = np.searchsorted(to.code, want)
            hit = at < len(to.code)
            hit[hit] = to.code[at[hit]] == want[hit]
            moved[by] = (child[hit], at[hit])
        sibling, which = expand(here.child[below.parent], here.child[below.parent + 1])
        other = sibling != which
        deeper, above = expand(below.child[:-1], below.child[1:])
        added = {-1: (own, below.parent), 0: (which[other], sibling[other]), 1: (above, deeper)}
        for by in active:
            u, v = (np.concatenate(x) for x in zip(moved[by], added[by]))
            width = max(1, len(levels[depth + 1 + by].parent)) if depth + 1 + by < len(levels) else 1
            both = np.unique(u * width + v)
            active[by] = (both // width, both % width)
        ended(depth + 1)
    return tuple(np.concatenate(x) if x else none for x in zip(*found)) if found else (none, none)


def joined(words: list[str], n: np.ndarray, s: np.ndarray, i: np.ndarray, j: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    """(word, near, near_n) of the words of whole parts, which ``root`` numbers."""
    many = np.bincount(root)[root] > 1
    words, n, s, i, j, root = [w for w, x in zip(words, many) if x], n[many], s[many], i[many], j[many], root[many]
    a = b = np.zeros(0, dtype=np.int64)
    if len(words):
        opened = [w[x : len(w) - y].encode("latin-1") for w, x, y in zip(words, i.tolist(), j.tolist())]
        size = np.array([len(w) for w in opened], dtype=np.int64)
        width = int(size.max())
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in opened), dtype=np.uint8).reshape(len(words), width).astype(np.int64)
        a, b = near_pairs(trie(letters, size, np.unique(root, return_inverse=True)[1]))
        free = s - i - j
        # longer words meet in their own parts; what the first letters decide was met in the other half
        kept = (size[a] == free[a]) | (size[b] == free[a])
        a, b = a[kept], b[kept]
        kept = np.array([not y or opened[p][:f] != opened[q][:f] for p, q, y, f in zip(a.tolist(), b.tolist(), j[a].tolist(), free[a].tolist())], dtype=bool)
        a, b = a[kept], b[kept]
    table = pa.array(words, pa.string())
    return pa.record_batch([table.take(pa.array(a)), table.take(pa.array(b)), pa.array(n[b], pa.int64())], ["word", "near", "near_n"])


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words of (word, n) at edit distance one; letters are those up to U+00FF."""

    def run(batches):
        held: list[pa.Table] = []
        total = 0

        def whole(table: pa.Table, last: bool):
            """Join the parts that are complete; the rows of the last one stay, as it may go on."""
            s, i, j = (table.column(c).to_numpy() for c in ("s", "i", "j"))
            words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
            keys = [(a, b, c, w[:b], w[len(w) - c :]) for w, a, b, c in zip(words, s.tolist(), i.tolist(), j.tolist())]
            new = np.array([True] + [x != y for x, y in zip(keys, keys[1:])])
            starts = np.flatnonzero(new)
            stop = len(words) if last else int(starts[-1])
            root = np.cumsum(new) - 1
            cuts, k = np.append(starts[starts < stop], stop), 0
            while k < len(cuts) - 1:  # as many parts as fit an array of letters; lengths ascend
                lo = int(cuts[k])
                most_rows = max(64, (TOGETHER << 4) // max(16, int(s[lo])))
                end = min(lo + most_rows, int(np.searchsorted(s, 2 * s[lo] + 16, "right")))
                k = max(k + 1, int(np.searchsorted(cuts, end, "right")) - 1)
                hi = int(cuts[k])
                yield joined(words[lo:hi], n[lo:hi], s[lo:hi], i[lo:hi], j[lo:hi], root[lo:hi] - root[lo])
            held[:] = [table.slice(stop)] if stop < len(words) else []

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                total += batch.num_rows
                if total >= TOGETHER:
                    yield from whole(pa.concat_tables(held).combine_chunks(), False)
                    total = sum(t.num_rows for t in held)
        if held:
            yield from whole(pa.concat_tables(held).combine_chunks(), True)

    dealt = parts(words, most).repartition(*_key()).sortWithinPartitions(*_key())
    return dealt.mapInArrow(run, "word string, near string, near_n long")


def spelling_variants(docs: DataFrame, least: int = 7, every: int = 31, least_n: int = 2, times: int = 10, most: int = MOST, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with ``least_n`` occurrences.

    A word's form is the most frequent near word, if that has ``times`` its occurrences; the root follows
    forms to the last. Occurrences grow by that factor with each form, so few doublings reach the root.
    """
    words = stored(vocabulary(docs, least, every, text_col, id_col).where(F.col("n") >= least_n), "vocabulary")
    best = near_words(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    form = F.when(-F.col("b.m") >= times * F.col("n"), F.col("b.near"))
    known = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("b.m")).alias("form_n")), "forms")
    root = known.where("form is not null").select("word", F.col("form").alias("root"))
    top = known.agg(F.max("form_n")).first()[0]
    steps, left = 1, top
    while left is not None and left >= least_n * times:  # the longest chain that these counts allow
        left, steps = left // times, steps + 1
    reach = 1
    while top is not None and reach < steps:
        on = root.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        longer = stored(root.join(on, "root", "left").select("word", F.coalesce("_up", "root").alias("root")), "roots")
        if reach > 1:
            discard(root)
        root, reach = longer, 2 * reach
    out = known.join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
