"""Sharding by jump consistent hashing, in DataFrame functions only.

The jump walk of a key is a chain of steps b -> j; the shard among n is the last b below n. When
shards are appended, only rows whose next jump lands on a new shard move.

The generator is the published 64-bit linear congruential one. Spark's ANSI mode has no wrapping
product, so the key is kept as two unsigned 32-bit halves and multiplied in 16-bit steps.

Defined results: a null key hashes as 0; equal keys go to one shard, at different slots; a null text has size 1
and the CRC of the empty string; an empty table gives an empty result. Only the named columns are
read, so extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialectry.llm.common import free_name, stored

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF


def _product_low(x: Column, m: int) -> Column:
    """Low 32 bits of x * m for unsigned 32-bit x and m."""
    high_part = F.shiftrightunsigned(x, 16) * F.lit(m).cast("long")
    return ((x.bitwiseAND(0xFFFF) * F.lit(m).cast("long")).bitwiseAND(LOW) + F.shiftleft(high_part.bitwiseAND(0xFFFF), 16)).bitwiseAND(LOW)


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Both halves of key * MULTIPLIER + 1 modulo 2^64."""
    mh, ml = MULTIPLIER >> 32, MULTIPLIER & LOW
    a = lo.bitwiseAND(0xFFFF) * F.lit(ml).cast("long")
    b = F.shiftrightunsigned(lo, 16) * F.lit(ml).cast("long")
    low = a.bitwiseAND(LOW) + F.shiftleft(b.bitwiseAND(0xFFFF), 16) + 1
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 16) + F.shiftrightunsigned(low, 32) + _product_low(hi, ml) + _product_low(lo, mh)
    return high.bitwiseAND(LOW), low.bitwiseAND(LOW)


def jump_walk(key: Column, shards: int) -> Column:
    """Struct (b, j): the shard among ``shards`` and the first jump at or beyond that number."""
    state = lambda hi, lo, b, j: F.struct(hi.alias("hi"), lo.alias("lo"), b.alias("b"), j.alias("j"))
    start = state(F.shiftrightunsigned(key, 32), key.bitwiseAND(LOW), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        # the halves are bound once by a one-element transform, not computed for each use
        moved = F.transform(
            F.array(F.struct(hi.alias("hi"), lo.alias("lo"))),
            lambda k: state(k["hi"], k["lo"], s["j"], F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(k["hi"], 1) + 1).cast("double"))).cast("long")),
        )
        return F.when(s["j"] >= shards, s).otherwise(moved[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)


def assign(df: DataFrame, shards: int, key_col: str = "doc_id") -> DataFrame:
    """Add ``shard`` (among ``shards``) and ``grown_shard`` (among one more), in place of columns of these names; all others stay."""
    walk, tmp = jump_walk(F.coalesce(F.col(key_col).cast("long"), F.lit(0).cast("long")), shards), free_name(df, "_walk")
    grown = F.when(F.col(f"{tmp}.j") == shards, F.lit(shards)).otherwise(F.col(f"{tmp}.b")).cast("int")
    return df.withColumn(tmp, walk).withColumn("shard", F.col(f"{tmp}.b").cast("int")).withColumn("grown_shard", grown).drop(tmp)


def with_slots(df: DataFrame, name: str = "sharding") -> DataFrame:
    """Add ``slot``, in place of a column of that name: a gapless count from 0 within each ``shard``.

    Rows are numbered within (shard, input partition) and shifted by the counts of the earlier
    partitions, so neither a shard nor a group of equal rows meets in one task. The places are
    written first; a lost executor can't change them.
    """
    part, row, k, n, base = (free_name(df, x) for x in ("_part", "_row", "_k", "_n", "_base"))
    placed = stored(df.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()), name)
    counts = placed.groupBy("shard", part).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    numbered = placed.withColumn(k, F.row_number().over(Window.partitionBy("shard", part).orderBy(row)))
    return numbered.join(bases, ["shard", part]).withColumn("slot", (F.col(base) + F.col(k) - 1).cast("long")).drop(part, row, k, n, base)


def shard_documents(docs: DataFrame, shards: int = 16, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Shard, slot, size and text CRC of every document, under the law ``key``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = with_slots(assign(named, shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
