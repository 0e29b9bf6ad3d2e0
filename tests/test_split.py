import random

import pytest

from dialectry.operators import split as P


def round_robin(rows, caps, n):
    """The sampler as a loop: labels in order, one row each, while caps and n allow."""
    by = {d: [r for r in rows if r[1] == d and r[2] > 0] for d in sorted(caps)}
    at, taken, out, total = dict.fromkeys(by, 0), dict.fromkeys(by, 0), [], 0
    while total < n:
        moved = False
        for d in by:
            if total >= n or taken[d] >= caps[d] or at[d] >= len(by[d]):
                continue
            r = by[d][at[d]]
            at[d], taken[d], total, moved = at[d] + 1, taken[d] + r[2], total + r[2], True
            out.append(r[0])
        if not moved:
            break
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_balanced_against_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice("abbccccdddddddd"), r.choice([0, 1, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, dialect string, units long")
    for units in (None, "units"):
        limits = {"ratio": 0.5, "threshold": 10, "most": 40}
        caps = {x.dialect: x.cap for x in P.class_caps(df, units=units, **limits).collect()}
        own = [(i, d, u if units else 1) for i, d, u in rows]
        for n in (None, 17, sum(caps.values()) // 2):
            got = sorted(x[0] for x in P.select_balanced(df, n, units=units, limits=limits).select("row_id").collect())
            assert got == round_robin(own, caps, sum(caps.values()) if n is None else n)
    with pytest.raises(ValueError):
        P.select_balanced(df, 10_000)


def test_one_class_of_nine_tenths(spark):
    r = random.Random(9)
    rows = [(i, "a" if r.random() < 0.9 else r.choice("bc"), r.choice([0, 1, 3])) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, dialect string, units long").repartition(6)
    limits = {"ratio": 0.5, "threshold": 10, "most": 60}
    caps = {x.dialect: x.cap for x in P.class_caps(df, units="units", **limits).collect()}
    got = P.select_balanced(df, units="units", limits=limits)
    assert sorted(x.row_id for x in got.collect()) == round_robin(rows, caps, sum(caps.values()))
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    # the partial limit stands below the exchange
    assert "WindowGroupLimit" in plan and "Exchange hashpartitioning" in plan[: plan.index("Partial")]
    free = {**limits, "most": None}
    every = {x.dialect: x.cap for x in P.class_caps(df, units="units", **free).collect()}
    assert every["a"] > 60 and sorted(x.row_id for x in P.select_balanced(df, units="units", limits=free).collect()) == round_robin(rows, every, sum(every.values()))


def test_caps(spark):
    rows = [(i, d) for d, n in (("a", 3), ("b", 10), ("c", 11), ("e", 13), ("f", 2000)) for i in range(n)]
    got = {x.dialect: x.cap for x in P.class_caps(spark.createDataFrame(rows, "row_id long, dialect string")).collect()}
    assert got == {"a": 3, "b": 10, "c": 6, "e": 6, "f": 500}


def test_dedup_and_nulls(spark):
    rows = [(1, "t", "a"), (2, "t", "a"), (3, "u", "a"), (4, "u", "b"), (5, None, "a"), (6, None, "a"), (7, "v", None)]
    df = spark.createDataFrame(rows, "row_id long, text string, dialect string")
    assert sorted(x.row_id for x in P.keep_first(df, ["text", "dialect"]).collect()) == [1, 3, 4, 5, 7]
    assert sorted(x.row_id for x in P.deduplicate(df).collect()) == [1, 5, 7]


def test_train_dev_test(spark):
    r = random.Random(1)
    rows = [(i, f"t{i}", r.choice("abc")) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, text string, dialect string")
    got = {x.row_id: x.split for x in P.train_dev_test(df, most=20).collect()}
    assert len(got) == 200 and {v: list(got.values()).count(v) for v in set(got.values())} == {"test": 60, "dev": 60, "train": 80}
    s = P.train_dev_test(df, test_strategy="stratify", test_size=0.25, dev_strategy="stratify", dev_size=10).groupBy("split").count().collect()
    assert dict(map(tuple, s)) == {"test": 50, "dev": 10, "train": 140}
    assert dict(map(tuple, P.train_dev_test(df, test_size=0, dev_size=0).groupBy("split").count().collect())) == {"train": 200}
    with pytest.raises(ValueError):
        P.train_dev_test(df, test_strategy="other", test_size=5)


def test_units_are_expanded_within_the_split(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "ab\n\ncd  e", "x"), (2, "", "x"), (3, None, "x")], "row_id long, text string, split string")
    from dialectry.functions.text import paragraphs

    assert [(x.row_id, x.unit_pos, x.text) for x in P.expand_units(df, paragraphs(F.col("text"))).collect()] == [(1, 0, "ab"), (1, 1, "cd e")]


def test_a_share_above_the_caps_takes_all_candidates(spark):
    rows = [(i, f"t{i}", "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, text string, dialect string")
    got = P.train_dev_test(df, test_size=0.5, dev_size=17, most=30).groupBy("split").count().collect()
    assert dict(map(tuple, got)) == {"test": 60, "dev": 17, "train": 323}
    with pytest.raises(ValueError):
        P.train_dev_test(df, test_size=200, most=30)
