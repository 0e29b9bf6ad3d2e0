import random

import pytest
from pyspark.sql import functions as F

from dialectry.operators import contributions as C
from dialectry.streaming import metadata as M

KEYS = ["page_id", "contributor_id"]


@pytest.fixture(scope="module")
def revisions(spark):
    rnd, rows = random.Random(8), []
    for page in range(12):
        for pos in range(rnd.choice([1, 3, 30, 80])):
            user = rnd.choice([None, 1, 2, 3, 4])
            rows.append((page, pos, str(user) if user else f"10.0.0.{rnd.randrange(3)}", user, rnd.choice([0, 5, 99, 100, 250, 251, 900])))
    return spark.createDataFrame(rows, M.REVISIONS).cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*KEYS, "user_id", *[c.split(" ")[0] for c in M.STATS.split(", ")]).collect()), key=repr)


def test_any_split_into_batches(spark, revisions, tmp_path):
    want = rows_of(C.contributor_stats(C.with_diff(revisions)))
    for seed, n in ((1, 1), (2, 4)):
        at = tmp_path / str(seed)
        # every row in a file by chance, some twice
        split = revisions.withColumn("k", F.pmod(F.xxhash64(F.lit(seed), "page_id", "pos_revision"), F.lit(n)))
        again = split.where("pos_revision % 5 = 0").withColumn("k", (F.col("k") + 1) % n)
        for k in range(n):
            split.unionByName(again).where(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(str(at / "in"))
            if k % 2:  # some files are taken in when they come, others with the next
                M.keep_up(spark, str(at / "in"), str(at / "out"), str(at / "check"), files=1)
        M.keep_up(spark, str(at / "in"), str(at / "out"), str(at / "check"), files=1)
        assert rows_of(M.current(spark, str(at / "out"))) == want
    assert rows_of(M.compact(spark, str(at / "out"), str(at / "one"))) == want


def test_only_what_changed_is_written(spark, revisions, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    revisions.coalesce(1).write.parquet(src)
    M.keep_up(spark, src, out, check)
    spark.createDataFrame([(0, revisions.where("page_id = 0").count(), "9", 9, 400)], M.REVISIONS).coalesce(1).write.mode("append").parquet(src)
    M.keep_up(spark, src, out, check)
    last = spark.read.parquet(out).where("batch = 1").collect()
    assert [(r.page_id, r.contributor_id, r.n) for r in last] == [(0, "9", 1)]


def test_batches_after_compaction_add_up(spark, revisions, tmp_path):
    src, out, check, one = (str(tmp_path / x) for x in ("in", "out", "check", "one"))
    odd = F.col("pos_revision") % 2 == 1
    revisions.where(odd).coalesce(1).write.parquet(src)
    M.keep_up(spark, src, out, check)
    M.compact(spark, out, one)
    revisions.where(~odd).coalesce(1).write.mode("append").parquet(src)
    M.keep_up(spark, src, one, check)
    assert rows_of(M.current(spark, one)) == rows_of(C.contributor_stats(C.with_diff(revisions)))


class Counted:
    """A state that counts how often it is asked or told."""

    def __init__(self):
        self.value, self.calls = {}, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "update":
                self.value = args[0]
            return self.value or None

        return call


def test_state_is_asked_and_told_once_a_page_and_batch():
    state, page = Counted(), M.Contributors()
    page.init(state)
    row = lambda k: {"pos_revision": k, "contributor_id": f"u{k}", "user_id": k, "len_bytes": 10 * k}
    assert list(page.handleInputRows((7,), iter([row(k) for k in range(399, 0, -2)]), None)) == []
    got = list(page.handleInputRows((7,), iter([row(k) for k in range(0, 400, 2)]), None))
    assert sorted((r.contributor_id, r.n, r.size) for r in got) == sorted((f"u{k}", 1, 10 if k else 1) for k in range(400))
    assert state.calls == 4
