import random

from pyspark.sql import functions as F

from dialectry.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_equal_to_percentile(spark):
    r = random.Random(2)
    draw = {"a": lambda: r.choice([5.0] * 50 + [7.5]), "b": lambda: r.choice([-1, 1]) * 10 ** r.uniform(-290, 290), None: lambda: r.choice([0.0, -0.0, -3.25, 1e-12]), "one": lambda: 2.0, "none": lambda: None}
    rows = [(g, draw[g]()) for g in draw for _ in range(1 if g == "one" else 700)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(x.g, x.prob): x.quantile for x in exact_quantiles(df, "v", PROBS, by="g").collect()}
    for x in df.where("v is not null").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, PROBS))).alias("q")).collect():
        for p, q in zip(PROBS, x.q):
            assert abs(got.pop((x.g, p)) - q) <= 1e-9 * abs(q)
    assert not got
    every = {x.prob: x.quantile for x in exact_quantiles(df, "v", [0.5]).collect()}
    assert every[0.5] == df.agg(F.percentile("v", 0.5)).first()[0]
    assert exact_quantiles(df.where("g = 'none'"), "v", PROBS).count() == 0
