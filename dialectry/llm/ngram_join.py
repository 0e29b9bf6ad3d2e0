"""N-gram Jaccard self-join with rare-first prefix filtering.

1. One pass over all texts counts shingle hashes in a fixed number of buckets. The bucket count,
   then the hash, is a total order of shingles with the rare first; any total order gives the same
   result, a good one gives fewer candidates.
2. A second pass writes each text's set size, a digest of the set, its prefix (the rarest
   n - ceil(t n) + 1 shingles). Equal sets form a class; only the class with its smallest doc_id goes
   on.
3. Prefix postings meet by shingle. In each posting list every member is paired with the list's
   leader, the member for which the shingle stands earliest in its prefix (the least edited copy
   where there are many); pairs that pass the filters are verified on the full sets and joined to
   components.
4. Only lists that still hold several components go on. Their members meet in blocks of bounded
   size, and pairs of different components that pass the filters are verified, each once. Pairs
   inside one component need no check: they can't change the components.

Filters: the length filter compares set sizes. The positional filter takes a shared shingle for the
first one of a pair: all before it is unshared and must fit into the Hamming distance that a link
allows, and what follows must fill the least overlap. A linked pair passes at its first shared
shingle, where it is either tested with the list's leader or met in step 4. The suffix filter
compares the rest of the prefixes: below the smaller of the two last prefix shingles both sets are
known, so their difference there is a lower bound of the Hamming distance. Prefixes are sent with
32 bits a shingle; a chance match can only let a pair through.

The result is exact for 64-bit shingle hashes: no cap on candidates, lists or partners.

Defined results: documents without words have no set and link with nothing; a null doc_id takes no
part and has a null component; rows of one doc_id count as one document, linked by any of its
texts, and each row has its own set size. Only the named columns are read. Empty tables give none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectry.llm.common import BLOCK, Shingler, discard, distinct, filter_udf, holds, id_filter, pack_counts, stored, summed_blocks, text_buffer, white_words
from dialectry.llm.components import components

ORDER_BUCKETS = 1 << 22  #: buckets of the shingle order: one byte each is broadcast, whatever the input
LIST_BLOCK = 1024  #: members of one list that meet in one block


def _named(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _chunks(batch, rows: int = 500):
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def shingle_order(named: DataFrame, k: int, buckets: int) -> np.ndarray:
    """One byte per bucket: eight times the binary logarithm of its count."""

    def count(batches):
        s, total = Shingler(k, white_words()), np.zeros(buckets, dtype=np.int64)
        mask = np.uint64(buckets - 1)
        for batch in batches:
            for few in _chunks(batch):
                hashes, _ = s.shingles(*text_buffer(few.column(0)))
                np.add.at(total, (hashes & mask).astype(np.int64), 1)
        for block, data in pack_counts(total):
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])

    finish = lambda c: np.minimum(255, 8 * np.log2(c.astype(np.float64) + 1)).astype(np.uint8).tobytes()
    order = np.zeros(buckets, dtype=np.uint8)
    for block, data in summed_blocks(named.select("text").mapInArrow(count, "block int, data binary"), finish):
        order[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(data, dtype=np.uint8)
    return order


def text_sets(named: DataFrame, order, k: int, percent: int) -> DataFrame:
    """doc_id, set size n, digest, rarest-first prefix and the high 32 bits of each of its places, of every text."""

    def run(batches):
        s, rank = Shingler(k, white_words()), order.value
        mask = np.uint64(len(rank) - 1)
        for batch in batches:
            for few in _chunks(batch):
                hashes, at = s.shingles(*text_buffer(few.column(1)))
                size, digest, prefix, short = [], [], [], []
                for a, b in zip(at[:-1], at[1:]):
                    own = distinct(hashes[a:b])
                    n = len(own)
                    size.append(n)
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
                    if n:
                        key = (rank[(own & mask).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (own >> np.uint64(8))
                        p = n - (percent * n + 99) // 100 + 1
                        first = np.sort(np.partition(key, p - 1)[:p] if p < n else key)
                        prefix.append(first.view(np.int64))
                        short.append((first >> np.uint64(32)).astype("<u4").tobytes())
                    else:
                        prefix.append(np.zeros(0, dtype=np.int64))
                        short.append(b"")
                flat = np.concatenate(prefix) if prefix else np.zeros(0, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(flat))
                yield pa.record_batch([few.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), lists, pa.array(short, pa.binary())], ["doc_id", "n", "digest", "prefix", "short"])

    return named.mapInArrow(run, "doc_id long, n long, digest binary, prefix array<long>, short binary")


def sets_of(named: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, set) of the documents whose ids occur in ``ids``, and a few more.

    A fixed-size filter of the ids, not their list, is broadcast, so that only these texts' sets are
    shuffled.
    """

    wanted = named.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches):
        # the filter is asked here and not before, which would take a second Python process a task
        s = Shingler(k, white_words())
        for batch in batches:
            batch = batch.filter(pa.array(holds(wanted.value, batch.column(0).to_numpy(zero_copy_only=False))))
            for few in _chunks(batch):
                hashes, at = s.shingles(*text_buffer(few.column(1)))
                yield pa.record_batch([few.column(0), pa.array([distinct(hashes[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["doc_id", "own"])

    return named.where("doc_id is not null").mapInArrow(run, "doc_id long, own binary")


class PairFilter:
    """Length and suffix filter of one set against many, on short prefixes."""

    def __init__(self, percent: int):
        self.percent, self.here = percent, np.zeros(1 << 16, dtype=bool)

    def need(self, n: int, others: np.ndarray) -> np.ndarray:
        """Least overlap of linked sets of these sizes."""
        return -((-self.percent * (others + n)) // (100 + self.percent))

    def passing(self, n: int, mine: np.ndarray, others: np.ndarray, theirs: list[np.ndarray], before: int = 0, theirs_before: np.ndarray | int = 0) -> np.ndarray:
        """Which of the other sets may link; ``before`` counts unshared places before the given parts of the prefixes."""
        need = self.need(n, others)
        ok = 100 * np.minimum(n, others) >= self.percent * np.maximum(n, others)
        sizes = np.array([len(x) for x in theirs])
        every = np.concatenate(theirs)
        at = np.cumsum(sizes) - sizes
        last = np.minimum(every[at + sizes - 1], mine[-1])
        known = every < np.repeat(last, sizes)
        self.here[mine & np.uint32(0xFFFF)] = True
        both = np.add.reduceat(known & self.here[every & np.uint32(0xFFFF)], at, dtype=np.int64)
        self.here[mine & np.uint32(0xFFFF)] = False
        b = np.add.reduceat(known, at, dtype=np.int64)
        a = np.searchsorted(mine, last, "left")
        both = np.minimum(both, np.minimum(a, b))
        a, b = a + before, b + theirs_before
        ok &= a + b - 2 * both <= n + others - 2 * need
        return ok & (both + np.minimum(n - a, others - b) >= need)


def filtered(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that the length and suffix filters let through; ``sets`` has doc_id, n and short."""

    def run(batches):
        f = PairFilter(percent)
        for batch in batches:
            keep = [
                bool(f.passing(nx, np.frombuffer(x.as_buffer(), dtype="<u4"), np.array([ny]), [np.frombuffer(y.as_buffer(), dtype="<u4")])[0])
                for nx, ny, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5))
            ]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(sets.toDF("a", "nx", "x"), "a").join(sets.toDF("b", "ny", "y"), "b").select("a", "b", "nx", "ny", "x", "y")
    return met.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = 0
                if 100 * len(x) >= percent * len(y) and len(x):
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    both = int((y[at] == x).sum())
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return met.mapInArrow(run, "a long, b long")


def _block_pairs(percent: int):
    """A function over rows sorted by (token, c1, c2): the pairs of each block that pass all filters."""

    def block(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        rep, n, pos, comp, side = (t.column(c).to_numpy() for c in ("rep", "n", "pos", "comp", "side"))
        cross = t.column("c1")[0].as_py() != t.column("c2")[0].as_py()
        short = [np.frombuffer(x.as_buffer(), dtype="<u4") for x in t.column("short")]
        f = PairFilter(percent)
        for i in np.flatnonzero(side == 1) if cross else range(len(rep)):
            need = f.need(n[i], n)
            ok = (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            ok &= (np.minimum(n - pos, n[i] - pos[i]) >= need) & (pos + pos[i] <= n + n[i] - 2 * need)
            if cross:
                ok &= side == 2
            else:
                ok[: i + 1] = False
            js = np.flatnonzero(ok)
            if len(js):
                for j in js[f.passing(n[i], short[i], n[js], [short[j] for j in js], pos[i], pos[js])]:
                    yield min(rep[i], rep[j]), max(rep[i], rep[j])

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def flush():
            if len(held) and sum(x.num_rows for x in held) > 1:
                found = list(block(held))
                if found:
                    a, b = zip(*found)
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                key = tuple(keys[:, lo])
                if key != last:
                    yield from flush()
                    last = key
                held.append(batch.slice(lo, hi - lo))
        yield from flush()

    return run


def linked_components(docs: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id", order_buckets: int = ORDER_BUCKETS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (see the module's text).

    Two documents link when ``100 * intersection >= percent * union`` of their sets of ``k``-word
    shingles; the component is the smallest doc_id reachable by links.
    """
    named = _named(docs, text_col, id_col)
    order = docs.sparkSession.sparkContext.broadcast(shingle_order(named, k, order_buckets))
    sets = stored(text_sets(named, order, k, percent), "prefixes", "zstd")
    real = sets.where("n > 0 and doc_id is not null")
    classes = stored(real.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = real.join(classes, "digest").where("doc_id = rep")
    postings = reps.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    # stored, so that the join meets two plain exchanges, of which adaptive execution can split the skewed one
    lists = stored(postings.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("pos", "rep", "n")).alias("lead")).where("m > 1").drop("m"), "lists", "zstd")
    shared = stored(postings.join(lists, "token").select("token", "rep", "n", "pos", F.col("lead.rep").alias("leader"), F.col("lead.n").alias("leader_n"), F.col("lead.pos").alias("leader_pos")), "postings", "zstd")
    discard(lists)

    near = f"100 * least(n, leader_n) >= {percent} * greatest(n, leader_n) and pos + leader_pos <= n + leader_n - 2 * ceil({percent} * (n + leader_n) / {100 + percent})"
    star = shared.where("rep <> leader").where(near).select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    shorts = real.select("doc_id", "n", "short")
    met_once = stored(star, "pairs")
    star = stored(filtered(met_once, shorts, percent), "pairs")
    met = stored(sets_of(named, star.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), k), "sets")
    links = stored(verified(star, met, percent), "links")
    discard(met_once, star, met)
    names = real.groupBy("doc_id").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).where("d1 <> d2").select("doc_id")
    same = real.join(names, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = stored(links.unionByName(same).distinct(), "links")
    label = components(links)

    tagged = shared.join(label.toDF("rep", "label"), "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label", "leader_n", "leader_pos")
    untested = F.when(F.col("rep") != F.col("leader"), F.col("comp"))
    open_ = stored(tagged.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(untested).alias("c_min"), F.max(untested).alias("c_max")).where("c_min <> c_max").select("token", "m"), "open-lists")
    rest = stored(tagged.join(open_, "token").where("rep <> leader").drop("leader"), "open")
    discard(shared, open_)
    if not rest.isEmpty():
        own = shorts.select(F.col("doc_id").alias("rep"), "short").join(rest.select("rep").distinct(), "rep")
        parts = F.ceil(F.col("m") / F.lit(LIST_BLOCK)).cast("int")
        mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
        blocks = rest.withColumn("parts", parts).withColumn("c", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        blocks = blocks.select("token", F.least("c", "other").cast("int").alias("c1"), F.greatest("c", "other").cast("int").alias("c2"), F.when(F.col("c") <= F.col("other"), 1).otherwise(2).alias("side"), "rep", "n", "pos", "comp")
        # what stands before the shared shingle is unshared by assumption: its number is enough
        tail = F.substring("short", 4 * F.col("pos") + 1, F.length("short")).alias("short")
        blocks = blocks.join(own, "rep").select("token", "c1", "c2", "side", "rep", "n", "pos", "comp", tail)
        dealt = blocks.repartition("token", "c1", "c2").sortWithinPartitions("token", "c1", "c2", "rep")
        more = stored(dealt.mapInArrow(_block_pairs(percent), "a long, b long").distinct(), "pairs")
        met = stored(sets_of(named, more.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), k), "sets")
        links = stored(links.unionByName(verified(more, met, percent)), "links")
        discard(more, met)
        label = components(links)
    of_class = classes.join(label.toDF("rep", "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("label"))
    out = sets.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_per_component(docs: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Keep of each component the row with the smallest id, null last, then the smallest row number; all columns stay.

    Rows are told apart by a stored number of their own: rows with one id and different texts are
    different documents, and rows without an id are compared as all others. Rows without words stay.
    Rows that a fixed-size filter of the dropped numbers does not hold pass without a shuffle.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*others).alias("doc")), "rows", "zstd")
    groups = stored(linked_components(rows.select("row", "text"), k, percent, "text", "row").select(F.col("doc_id").alias("row"), "component_id"), "groups")
    # stored, as the other small sides of joins by hot keys
    several = stored(groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id"), "several")
    members = stored(groups.join(several, "component_id").join(rows.select("row", "id"), "row"), "members")
    best = stored(members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("by")), "best")
    dropped = stored(members.join(best, "component_id").where("row <> by.row").select("row"), "dropped")
    discard(several, members, best, groups)
    maybe = filter_udf(docs.sparkSession, id_filter(dropped))
    own = [(F.col("text") if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns]
    checked = rows.where(maybe("row")).join(dropped, "row", "left_anti")
    return rows.where(~maybe("row")).select(*own).unionByName(checked.select(*own))
