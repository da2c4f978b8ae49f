"""New raster files as a stream: every micro-batch runs the operators that a batch would run.

The operators need all pixels of an image at once, so an image must arrive in one file; results are
appended under the batch's number, which makes a repeated batch overwrite its own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lumaflow.model import MOSAIC_SCHEMA


def develop_stream(spark: SparkSession, source: str, target: str, checkpoint: str, develop: Callable[[DataFrame], DataFrame], files_per_trigger: int = 64) -> StreamingQuery:
    """Apply `develop` to the mosaics of every new Parquet file under `source`; stops when all present files are done."""

    def batch(df: DataFrame, number: int) -> None:
        develop(df).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(MOSAIC_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
