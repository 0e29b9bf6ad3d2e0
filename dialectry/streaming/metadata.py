"""Contributor metadata kept up to date: state by page, updated by new revisions only.

The state of a page is one value: the runs of consecutive revisions seen so far, with the length at each run's end. A
revision is counted as soon as the one before it has been met, so files may bring revisions in any order, and a revision
that comes again changes nothing. The state grows with the gaps between revisions, not with these or with contributors.

Each micro-batch writes what it adds to the statistics of contributors (:func:`contributions.contributor_stats`) to a folder of
its own number, so a repeated batch overwrites itself; the rows of a page and contributor add up. Checkpoints of the former
state, by contributor, can't be gone on with.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dialectry.operators.contributions import STATS
from dialectry.schema import NON_EMPTY_BYTES, SIGNIFICANT_BYTES

REVISIONS = "page_id long, pos_revision long, contributor_id string, user_id long, len_bytes long"
CHANGED = f"page_id long, contributor_id string, user_id long, {STATS}"
#: Revisions of a page that are put in order at once.
CHUNK = 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _halved(diff: int) -> int:
    return max(1, round(abs(diff) / 2))


def counted(stats: tuple | None, user_id: int | None, pos: int, length: int, diff: int) -> tuple:
    """A contributor's statistics with one more revision."""
    _, n, size, rank_size, first, last, *marks = stats or (user_id, 0, 0, 0, pos, pos, None, None, None, None)
    weight = diff if diff > 0 else _halved(diff)
    ranked = _halved(diff) if diff < 0 else diff
    for k, least in ((0, NON_EMPTY_BYTES), (2, SIGNIFICANT_BYTES)):
        if length >= least:
            marks[k] = pos if marks[k] is None else min(marks[k], pos)
            marks[k + 1] = pos if marks[k + 1] is None else max(marks[k + 1], pos)
    return (user_id, n + 1, size + weight, rank_size + ranked, min(first, pos), max(last, pos), *marks)


class Contributors(StatefulProcessor):
    """Keeps the runs of a page's revisions; yields what new ones add to its contributors' statistics."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a list of runs: first and last place, the last one's length, and contributor, user and length of the first one, which is not counted before the run is joined to another or begins at 0
        self.runs = handle.getValueState("runs", "runs string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.runs.get()
        before = known[0] if known is not None else "[]"
        runs = {first: tuple(run) for first, *run in json.loads(before)}
        starts = sorted(runs)
        added: dict[str, tuple] = {}

        def count(who: str, user: int | None, pos: int, length: int, diff: int) -> None:
            added[who] = counted(added.get(who), user, pos, length, diff)

        rows = iter(rows)
        while part := sorted(((r["pos_revision"], r["contributor_id"], r["user_id"], r["len_bytes"]) for r in islice(rows, CHUNK)), key=lambda r: r[0]):
            for pos, who, user, length in part:
                i = bisect.bisect_right(starts, pos) - 1
                end = runs[starts[i]][0] if i >= 0 else -1
                if pos <= end:
                    continue  # it came before
                if i >= 0 and end == pos - 1:
                    start = starts[i]
                    _, last_len, *first = runs[start]
                    count(who, user, pos, length, length - last_len)
                else:
                    start, first = pos, [who, user, length]
                    i += 1
                    starts.insert(i, pos)
                    if pos == 0:
                        count(who, user, pos, length, length)
                runs[start] = (pos, length, *first)
                if i + 1 < len(starts) and starts[i + 1] == pos + 1:
                    last, last_len, next_who, next_user, next_len = runs.pop(starts.pop(i + 1))
                    count(next_who, next_user, pos + 1, next_len, next_len - length)
                    runs[start] = (last, last_len, *first)
        after = json.dumps([[first, *runs[first]] for first in starts])
        if after != before:
            self.runs.update((after,))
        names = [c.split(" ")[0] for c in CHANGED.split(", ")]
        for who, stats in added.items():
            yield Row(**dict(zip(names, (key[0], who, *stats), strict=True)))

    def close(self) -> None:
        pass


def keep_up(spark: SparkSession, source: str, target: str, checkpoint: str, files: int | None = None, fmt: str = "parquet") -> None:
    """Take in the new files of ``source`` (columns as in ``REVISIONS``), ``files`` of them at a time, and write what changed below ``target``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    reader = spark.readStream.format(fmt).schema(REVISIONS)
    stream = (reader if files is None else reader.option("maxFilesPerTrigger", files)).load(source)
    kept = stream.groupBy("page_id").transformWithState(Contributors(), outputStructType=CHANGED, outputMode="Update", timeMode="None")
    kept.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The statistics as they are now: of each page and contributor the sum of all batches."""
    rows = spark.read.option("basePath", target).schema(f"{CHANGED}, batch long").parquet(target)
    of = lambda c: F.sum if c in ("n", "size", "rank_size") else F.min if c.startswith("first") else F.max
    names = [c.split(" ")[0] for c in STATS.split(", ")]
    return rows.groupBy("page_id", "contributor_id").agg(F.max_by("user_id", "batch").alias("user_id"), *[of(c)(c).alias(c) for c in names])


def compact(spark: SparkSession, target: str, compacted: str) -> DataFrame:
    """The current statistics written as one batch, -1, of a new folder, which later batches may follow."""
    current(spark, target).write.mode("overwrite").parquet(f"{compacted}/batch=-1")
    return current(spark, compacted)
