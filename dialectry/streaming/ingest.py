"""Incremental ingestion: new files of a folder are appended once, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectry.sources.readers import first_by_keys, not_yet_written


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "id", transform: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "json", order: str | None = None) -> None:
    """Read what is new under ``source``, transform it, and append rows whose key the target lacks.

    The stream remembers the files it has read, and the key check makes a repeated batch harmless. Of
    rows of one key in a batch the first by ``order`` counts, by all columns where none is given.
    """

    def append(batch: DataFrame, _: int) -> None:
        rows = transform(batch) if transform else batch
        rows = first_by_keys(rows, [key], F.col(order) if order else F.struct(*rows.columns))
        if written(spark, target):
            rows = not_yet_written(rows, spark.read.schema(rows.schema).parquet(target), key)
        rows.write.mode("append").parquet(target)

    stream = spark.readStream.format(fmt).schema(schema).load(source)
    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
