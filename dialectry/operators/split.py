"""Deduplication and balanced or weighted splitting of labelled texts.

Every order-dependent operator takes an explicit order column, which must tell rows apart. Texts are
compared by 128-bit digests: only digests, labels and orders are shuffled, and what is to be left out
is joined back by order, so neither long texts nor a very frequent one meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialectry.sources.scratch import stored


def digest(keys: list[str]) -> Column:
    """Two independent 64-bit hashes of some columns; nulls are equal to each other only."""
    parts = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(0x5EED), *parts).alias("b"))


def _without(df: DataFrame, losers: DataFrame, order: str) -> DataFrame:
    """``df`` without the orders in ``losers``."""
    return df.join(losers.select(F.col("_o").alias("_gone")), F.col(order) == F.col("_gone"), "left_anti")


def keep_first(df: DataFrame, keys: list[str], order: str = "row_id") -> DataFrame:
    """The first row of each key in the given order; null keys are equal."""
    slim = df.select(digest(keys).alias("_d"), F.col(order).alias("_o"))
    first = slim.groupBy("_d").agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _without(df, slim.join(first, "_d").where("_o > _first"), order)


def keep_unrepeated(df: DataFrame, keys: list[str], order: str = "row_id") -> DataFrame:
    """Only rows whose key occurs once."""
    slim = df.select(digest(keys).alias("_d"), F.col(order).alias("_o"))
    return _without(df, slim.join(slim.groupBy("_d").count().where("count > 1"), "_d"), order)


def deduplicate(df: DataFrame, text: str = "text", label: str = "dialect", order: str = "row_id") -> DataFrame:
    """First of each (text, label), then no text that has several labels."""
    slim = df.select(digest([text]).alias("_d"), digest([label]).alias("_l"), F.col(order).alias("_o"))
    pairs = slim.groupBy("_d", "_l").agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("_n"))
    texts = pairs.groupBy("_d").agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_labels")).where("_n > 1")
    return _without(df, slim.join(texts, "_d").where("_labels > 1 or _o > _first"), order)


def cap(count: Column, ratio: float = 0.5, threshold: int = 10, most: int | None = 500) -> Column:
    """All of small classes, else a share rounded to even, at most ``most``."""
    part = F.bround(count * ratio)
    return F.when(count <= threshold, count).otherwise(F.least(part, F.lit(most)) if most else part).cast("long")


def class_caps(df: DataFrame, label: str = "dialect", units: str | None = None, **limits) -> DataFrame:
    count = F.sum(units) if units else F.count(F.lit(1))
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(count.alias("count")).withColumn("cap", cap(F.col("count"), **limits))


def class_weights(df: DataFrame, label: str = "dialect") -> DataFrame:
    """Each row with its class's share of all rows; one row per class is summed and joined back."""
    per = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    shares = per.select("_l", (F.col("_n") / F.sum("_n").over(Window.partitionBy())).alias("weight"))
    return df.join(shares, F.col(label).eqNullSafe(F.col("_l")), "left").drop("_l")


def select_balanced(df: DataFrame, n: int | None = None, label: str = "dialect", order: str = "row_id", units: str | None = None, limits: dict | None = None, strict: bool = True) -> DataFrame:
    """Rows that a round robin over the sorted classes takes until ``n`` units or all caps are reached.

    More than the caps allow is an error, unless not ``strict``: then all candidates are taken.

    Within a class, in row order over rows with units, a row is a candidate while the units before it
    are below the cap. Candidates are taken by (round, class) while the units before them are below n.
    Only orders, labels and units are sorted. Where the caps bound the candidates, these meet in the final
    running sum; where they don't, no class and no sum is in one task.
    """
    caps = class_caps(df, label, units, **(limits or {}))
    total = caps.agg(F.coalesce(F.sum("cap"), F.lit(0))).first()[0]
    n = total if n is None else n
    if strict and total < n:
        raise ValueError(f"{n} samples are asked for, the caps allow {total}")
    u = F.col(units).cast("long") if units else F.lit(1).cast("long")
    slim = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_l"), F.col(order).alias("_o"), u.alias("_u")).where("_u > 0")
    most = (limits or {}).get("most", 500)
    if most:
        # units are at least 1, so no later row of a class can be a candidate: a rank limit, applied before the shuffle
        own = Window.partitionBy("_l").orderBy("_o")
        slim = slim.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= max(most, (limits or {}).get("threshold", 10)))
        slim = slim.withColumn("_b", F.sum("_u").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_u"))
    else:
        slim = running(slim)
    candidates = slim.join(caps.select(F.col(label).alias("_l"), "cap"), "_l").where("_b < cap")
    if most:
        placed = candidates.withColumn("_g", F.sum("_u").over(Window.orderBy("_r", "_l").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_u"))
    else:
        placed = units_before(candidates.select("_r", "_l", "_o", "_u"), ["_r", "_l"], "_u", "_g")
    taken = placed.where(F.col("_g") < n).select("_o")
    return df.join(taken, F.col(order) == F.col("_o"), "left_semi")


def running(slim: DataFrame) -> DataFrame:
    """Rank ``_r`` and the units before a row ``_b`` in each class of (_l, _o, _u), without a class in one task.

    Rows are sorted over range partitions and stored; the partitions' totals are summed to bases.
    """
    placed = stored(slim.repartitionByRange("_l", "_o").withColumn("_p", F.spark_partition_id()), "running")
    totals = placed.groupBy("_l", "_p").agg(F.count(F.lit(1)).alias("_n"), F.sum("_u").alias("_s"))
    before = Window.partitionBy("_l").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_l", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_units"))
    own = Window.partitionBy("_l", "_p").orderBy("_o")
    within = placed.withColumn("_k", F.row_number().over(own)).withColumn("_w", F.sum("_u").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_u"))
    return within.join(bases, ["_l", "_p"]).select("_l", "_o", "_u", (F.col("_rows") + F.col("_k")).alias("_r"), (F.col("_units") + F.col("_w")).alias("_b"))


def units_before(df: DataFrame, order: list[str], units: str, name: str) -> DataFrame:
    """``df`` with the sum of ``units`` over all rows before a row in ``order``, which tells rows apart.

    Rows are sorted over range partitions and stored; one total a partition goes to the driver and back.
    """
    placed = stored(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "placed")
    bases, at = [], 0
    for p, total in sorted(placed.groupBy("_p").agg(F.sum(units)).collect()):
        bases.append((p, at))
        at += total
    own = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.broadcast(df.sparkSession.createDataFrame(bases, "_p int, _base long"))
    return placed.join(known, "_p").withColumn(name, F.col("_base") + F.sum(units).over(own) - F.col(units)).drop("_p", "_base")


def drawn(seed: str, key: Column) -> Column:
    """A whole number below 2^40 by a hash of seed and key, which SQL can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, 10), 16, 10).cast("long")


def stratified_folds(df: DataFrame, folds: int, label: str = "dialect", order: str = "row_id", seed: str = "folds") -> DataFrame:
    """(order, fold): the rows of each class dealt out in turn, in the order of a hash; rows without a label are in no fold."""
    slim = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_l"), F.struct(drawn(seed, F.col(order)).alias("h"), F.col(order).alias("o")).alias("_o"), F.lit(1).cast("long").alias("_u"))
    return running(slim).select(F.col("_o.o").alias(order), ((F.col("_r") - 1) % folds).cast("int").alias("fold"))


def select_weighted(df: DataFrame, n: int, label: str = "dialect", order: str = "row_id", seed: int = 1) -> DataFrame:
    """A sample without replacement, rows weighted by their class's share (exponential keys from a hash of seed and order)."""
    weighted = class_weights(df, label)
    u = (drawn(str(seed), F.col(order)) + 1) / float((1 << 40) + 1)
    return weighted.withColumn("_key", -F.log(u) / F.col("weight")).orderBy("_key", order).limit(n).select(*df.columns)


def _size(size: float | int | None, rows: int) -> int | None:
    if size is None or size > 1.0:
        return size
    return round(rows * size)


def train_dev_test(
    df: DataFrame, label: str = "dialect", text: str = "text", order: str = "row_id", test_strategy: str = "balance", dev_strategy: str = "balance",
    test_size: float | int | None = None, dev_size: float | int | None = None, ratio: float = 0.5, threshold: int = 10, most: int | None = 500, seed: int = 1, units: str | None = None,
) -> DataFrame:
    """The deduplicated rows with a ``split`` of train, dev or test.

    A size up to 1.0 is a share of the rows, and a balanced part takes as much of it as the caps allow; a larger size is a number that must be reached.
    """
    limits = {"ratio": ratio, "threshold": threshold, "most": most}

    def select(rows: DataFrame, strategy: str, size: int | None, strict: bool) -> DataFrame:
        if strategy == "balance":
            return select_balanced(rows, size, label, order, units, limits, strict)
        if strategy == "stratify":
            if size is None:
                raise ValueError("the weighted strategy needs a size")
            return select_weighted(rows, size, label, order, seed)
        raise ValueError(f"unknown strategy: {strategy}")

    rows = deduplicate(df, text, label, order)
    share = lambda s: s is not None and s <= 1.0
    n = rows.count() if share(test_size) or share(dev_size) else 0
    strict = {"test": not share(test_size), "dev": not share(dev_size)}
    test_size, dev_size = _size(test_size, n), _size(dev_size, n)
    parts = []
    for name, strategy, size in (("test", test_strategy, test_size), ("dev", dev_strategy, dev_size)):
        if size is not None and size <= 0:
            continue
        chosen = select(rows, strategy, size, strict[name])
        parts.append(chosen.withColumn("split", F.lit(name)))
        rows = rows.join(chosen.select(F.col(order).alias("_taken")), F.col(order) == F.col("_taken"), "left_anti")
    out = rows.withColumn("split", F.lit("train"))
    for p in parts:
        out = out.unionByName(p)
    return out


def expand_units(df: DataFrame, unit: Column, text: str = "text", collapse: bool = True) -> DataFrame:
    """One row per unit (paragraph or segment), in order, with white space collapsed unless told otherwise; rows without units vanish."""
    from dialectry.functions.text import normalise_spaces

    out = df.select(*[c for c in df.columns if c != text], F.posexplode(unit).alias("unit_pos", "_t"))
    return out.withColumn(text, normalise_spaces(F.col("_t")) if collapse else F.col("_t")).drop("_t")
