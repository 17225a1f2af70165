"""Continuing a run: rows whose key is done are skipped, new ones are appended, also from a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't in done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def run_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, step: Callable[[DataFrame], DataFrame]) -> None:
    """Applies step to new JSON-lines files of a folder and appends the results to a Parquet table, each key once.

    A batch that is repeated after a failure finds its keys in the table and adds nothing twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        new = df.dropDuplicates([key])
        try:
            new = remaining(new, spark.read.parquet(target), key)
        except Exception as e:  # the table doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        step(new).write.mode("append").parquet(target)

    q = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
