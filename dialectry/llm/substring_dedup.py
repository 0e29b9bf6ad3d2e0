"""Substring deduplication by hashing lines, paragraphs or clauses, and runs of them.

1. Every text is cut into units: paragraphs (between blank lines), lines, or clauses: lines cut
   further behind ``. , ; : ! ?`` and behind words of ``LONG`` characters or more, so that passages
   without marks hold whole units too, wherever their lines begin. A unit reaches from its first word
   to the first word of the next one, so units tile the text; what stands before the first word belongs
   to none. A unit's words are lower-cased runs of ASCII letters and digits and of non-ASCII characters:
   case, marks and white space don't count.
2. From each unit on, the shortest run of adjacent units that reaches ``least`` words is hashed to 128
   bits. With ``least=1`` each unit stands for itself. The default of 32 finds passages of 50 words
   inside other lines even where nine words at either end belong to a unit of the text around them. A
   single stock line is shorter than a run and is left alone; a passage that is spread over lines, or
   stands inside longer ones, holds whole runs.
3. Half of the digest is counted over all texts first (partial counts, then one shuffle of longs).
   Only runs whose half repeats go on; of equal runs the first in rank stays, the others are removed.
4. A document loses the units of its removed runs, but for those that also belong to a run that
   stays. Spans are offsets in code points of the original text.

Rank: documents by id (null last), then rows of one id by their place in the input, then the place in
the text. The keeper's row is joined back to its copies, so a run that a third of all rows share is
only ever the skewed side of a join, which adaptive execution splits.

Defined results: null and empty texts have no unit and stay as they are; so do texts of fewer than
``least`` words; repeated rows are copies of the first of them; repetitions inside one text count as
any other. Input columns of any name are kept; a new column whose name is taken gets ``_`` appended.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialectry.llm.common import Shingler, alnum_words, discard, filter_udf, free_name, id_filter, mix64, stored, text_buffer

#: Texts hashed at once.
FEW = 400
#: Characters of a word that ends a clause.
LONG = 10
#: Characters that end a unit, and how many of them must stand between two words.
CUTS = {"paragraph": ("\n", 2), "line": ("\n", 1), "clause": ("\n.,;:!?", 1)}


class Runs:
    """The runs of some texts: row, place of the first unit, offsets of start and end, and both hashes."""

    def __init__(self, shingler: Shingler, texts: pa.Array, unit: str, least: int):
        raw, at = text_buffer(pc.utf8_lower(texts))
        words, starts, ends, rows = shingler.words(raw, at)
        n, counts = len(words), np.diff(rows)
        marks, times = CUTS[unit]
        is_mark = np.zeros(256, dtype=bool)
        is_mark[[ord(c) for c in marks]] = True
        seen = np.zeros(len(raw) + 1, dtype=np.int32)
        np.cumsum(is_mark[raw], out=seen[1:])
        new = np.ones(n, dtype=bool)
        new[1:] = seen[starts[1:]] - seen[ends[:-1]] >= times
        lead = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
        if unit == "clause":
            new[1:] |= (lead[ends] - lead[starts])[:-1] >= LONG
        new[rows[:-1][counts > 0]] = True
        first = np.flatnonzero(new)
        behind = np.append(first[1:], n) if n else first
        row = np.repeat(np.arange(len(counts)), counts)[first]
        last = np.searchsorted(behind, first + least)
        whole = np.flatnonzero(row[np.minimum(last, len(row) - 1)] == row) if n else first
        whole = whole[last[whole] < len(first)]
        last = last[whole]
        self.row = row[whole]
        base, size = lead[at[:-1]], lead[at[1:]]
        self.start = lead[starts[first[whole]]] - base[self.row]
        ends_row = (last + 1 == len(first)) | (row[np.minimum(last + 1, max(len(row) - 1, 0))] != self.row)
        next_start = lead[starts[first[np.minimum(last + 1, max(len(first) - 1, 0))]]]
        self.end = np.where(ends_row, size[self.row], next_start) - base[self.row]
        if n > len(shingler.power):
            shingler._powers(n)
        a, b = first[whole], behind[last]
        self.hashes = []
        for seed in (0x51, 0xB7):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(mix64(words + np.uint64(seed)) * shingler.power[:n], out=total[1:])
            self.hashes.append(mix64((total[b] - total[a]) * shingler.inverse[a] + (b - a).astype(np.uint64)).view(np.int64))


def _halves(unit: str, least: int):
    def run(batches):
        shingler = Shingler(1, alnum_words())
        for batch in batches:
            for lo in range(0, batch.num_rows, FEW):
                yield pa.record_batch([pa.array(Runs(shingler, batch.column(0).slice(lo, FEW), unit, least).hashes[0])], ["half"])

    return run


def _runs(unit: str, least: int):
    def run(batches):
        shingler = Shingler(1, alnum_words())
        for batch in batches:
            for lo in range(0, batch.num_rows, FEW):
                few = batch.slice(lo, FEW)
                r = Runs(shingler, few.column(2), unit, least)
                own = pa.array(r.row)
                yield pa.record_batch(
                    [*(pa.array(h) for h in r.hashes), few.column(0).take(own), few.column(1).take(own), pa.array(r.start.astype(np.int32)), pa.array(r.end.astype(np.int32))],
                    ["half", "rest", "row", "id", "start", "end"],
                )

    return run


def repeated_runs(rows: DataFrame, unit: str = "clause", least: int = 32) -> tuple[DataFrame, list[DataFrame]]:
    """Every run that occurs more than once: row, id, start, end, whether it stays, and where the first one stands;
    and the stored tables behind this.

    ``rows`` are stored rows (row, id, text).
    """
    halves = rows.select("text").mapInArrow(_halves(unit, least), "half long")
    # stored, so that the join meets two plain exchanges, of which adaptive execution can split the skewed one
    often = stored(halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"), "halves", "zstd")
    every = rows.select("row", "id", "text").mapInArrow(_runs(unit, least), "half long, rest long, row long, id long, start int, end int")
    met = stored(every.join(often, "half", "left_semi"), "runs", "zstd")
    discard(often)
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "start")
    first = stored(met.groupBy("half", "rest").agg(F.count(F.lit(1)).alias("copies"), F.min(rank).alias("keep")).where("copies > 1"), "keepers", "zstd")
    stays = (F.col("row") == F.col("keep.row")) & (F.col("start") == F.col("keep.start"))
    judged = met.join(first, ["half", "rest"]).select("row", "id", "start", "end", stays.alias("stays"), F.col("keep.id").alias("kept_id"), F.col("keep.start").alias("kept_start"), "copies")
    return judged, [met, first]


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch joined, in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1] if len(first) else ends


def without(gone: tuple[np.ndarray, np.ndarray], stay: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """What is left of the joined spans ``gone`` outside the joined spans ``stay``."""
    out, k = [], 0
    kept = list(zip(stay[0].tolist(), stay[1].tolist()))
    for a, b in zip(gone[0].tolist(), gone[1].tolist()):
        while k < len(kept) and kept[k][1] <= a:
            k += 1
        j = k
        while j < len(kept) and kept[j][0] < b:
            if kept[j][0] > a:
                out.append((a, kept[j][0]))
            a = max(a, kept[j][1])
            j += 1
        if a < b:
            out.append((a, b))
    return out


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column of numbers as arrays; null is empty."""
    at, sizes = column.offsets.to_numpy(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a : a + n] for a, n in zip(at[:-1], sizes)]


SPANS = "array<struct<start: int, end: int>>"


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return "".join([*parts, text[at:]])


def deduplicated(docs: DataFrame, unit: str = "clause", least: int = 32, changed_only: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated runs cut out of the text, ``removed_spans`` of the original text and the sorted ``kept_ids`` of what was kept instead.

    ``changed_only`` returns only the rows that lose something. Untouched rows have empty lists.
    """
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("doc")), "rows", "zstd")
    part = lambda spans, c: F.transform(spans, lambda s: s[c])
    span = F.struct("start", "end")
    runs, behind = repeated_runs(rows, unit, least)
    found = runs.groupBy("row").agg(
        F.collect_list(F.when(~F.col("stays"), span)).alias("gone"), F.collect_list(F.when(F.col("stays"), span)).alias("stay"), F.array_sort(F.collect_set(F.when(~F.col("stays"), F.col("kept_id")))).alias("kept")
    )
    found = stored(found.where("size(gone) > 0"), "found", "zstd")
    discard(*behind)
    named = rows.select("row", "text", "doc")
    if changed_only:
        # a fixed-size filter, so that only texts that may lose something are shuffled
        named = named.where(filter_udf(docs.sparkSession, id_filter(found.select("row")))("row"))
    joined = named.join(found, "row", "inner" if changed_only else "left")
    joined = joined.select("doc", "text", *(part(spans, c).alias(f"{spans}_{c}") for spans in ("gone", "stay") for c in ("start", "end")), "kept")

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, FEW):
                few = batch.slice(lo, FEW)
                spans = [without(union(a, b), union(c, d)) if len(a) else [] for a, b, c, d in zip(*(_lists(few.column(k)) for k in range(2, 6)))]
                texts = [_cut(t.as_py(), x) if x else t.as_py() for t, x in zip(few.column(1), spans)]
                listed = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                out = pa.record_batch([few.column(0), pa.array(texts, pa.string()), listed, few.column(6)], ["doc", "text", "spans", "kept"])
                yield out.filter(pa.array([bool(x) for x in spans])) if changed_only else out

    judged = joined.mapInArrow(cut, T.StructType([*joined.select("doc", "text").schema.fields, T.StructField("spans", T._parse_datatype_string(SPANS)), joined.schema["kept"]]))
    own = [F.col("text") if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns]
    own = [c.alias(name) for c, name in zip(own, docs.columns)]
    kept = F.coalesce("kept", F.array().cast("array<long>"))
    return judged.select(*own, F.col("spans").alias(free_name(docs, "removed_spans")), kept.alias(free_name(docs, "kept_ids")))
