"""Exact quantiles by histogram refinement, with state of a fixed size.

A number becomes a 64-bit whole number of the same order. Four passes fix sixteen bits each of the value at every
wanted rank: a pass counts, among the values that share the bits found so far, those by the next sixteen bits, at most
65,536 counts for each rank and group, summed before they are shuffled. Equal values are one count, however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType
from pyspark.sql.window import Window

from dialectry.sources.scratch import discard, stored

STEP, TURN = 16, 0x7FFFFFFFFFFFFFFF


@F.pandas_udf(LongType())
def _ordered(values):
    """Doubles as whole numbers of the same order; both zeros are one, all not-a-numbers the last."""
    import numpy as np

    bits = (values.to_numpy(dtype="float64") + 0.0).view("int64")
    return type(values)(np.where(bits < 0, bits ^ TURN, bits))


@F.pandas_udf(DoubleType())
def _number(ordered):
    import numpy as np

    bits = ordered.to_numpy(dtype="int64")
    return type(ordered)(np.where(bits < 0, bits ^ TURN, bits).view("float64"))


def _digit(bits: Column, k: int) -> Column:
    """The k-th sixteen bits; the first ones keep the sign, so that they are ordered."""
    return F.shiftright(bits, 48) if k == 0 else F.shiftright(bits, 48 - STEP * k).bitwiseAND((1 << STEP) - 1)


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: str | None = None) -> DataFrame:
    """(by, prob, quantile) of a numeric column, interpolated between the two ranks around ``prob``; nulls take no part.

    Without ``by`` there is one group, whose column is left out. A null group is a group.
    """
    group = F.col(by) if by else F.lit(0)
    rows = stored(df.where(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).cast("double").alias("v")).select("g", _ordered("v").alias("x")), "ordered")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    at = F.col("prob") * (F.col("n") - 1)
    wanted = sizes.select("g", F.explode(F.array(*map(F.lit, probs))).alias("prob"), "n").withColumn("at", at)
    targets = stored(wanted.select("g", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank")).distinct().select("g", "rank", F.col("rank").alias("left"), F.lit(0).cast("long").alias("found")), "ranks")
    for k in range(4):
        of = targets.select(F.col("g").alias("_g"), "rank", "left", "found")
        same = rows.g.eqNullSafe(F.col("_g"))
        if k:
            same = same & (F.shiftright("x", 64 - STEP * k) == F.col("found"))
        counts = rows.join(F.broadcast(of) if by is None else of, same).groupBy("_g", "rank", "left", "found", _digit(F.col("x"), k).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("_g", "rank").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        here = counts.withColumn("upto", upto).where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
        found = F.col("digit") if k == 0 else F.shiftleft("found", STEP) + F.col("digit")
        new = stored(here.select(F.col("_g").alias("g"), "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), found.cast("long").alias("found")), "ranks")
        discard(targets)
        targets = new
    values = targets.select(F.col("g").alias("_g"), "rank", _number("found").alias("v"))
    low, high = (values.select(F.col("_g").alias(f"{s}_g"), F.col("rank").alias(f"{s}_rank"), F.col("v").alias(s)) for s in ("low", "high"))
    out = wanted.join(low, wanted.g.eqNullSafe(F.col("low_g")) & (F.floor("at") == F.col("low_rank"))).join(high, wanted.g.eqNullSafe(F.col("high_g")) & (F.ceil("at") == F.col("high_rank")))
    share = F.col("at") - F.floor("at")
    quantile = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - share) * F.col("low") + share * F.col("high"))
    return out.select(*([F.col("g").alias(by)] if by else []), "prob", quantile.alias("quantile"))
