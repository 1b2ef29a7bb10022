"""Incremental building of a candidate cache from a directory that grows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from dotloom.sources.cache import append_missing


def build_cache(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda d: d, key: str = "image_id") -> StreamingQuery:
    """Runs ``step`` on each new batch of Parquet files and adds the images that ``target`` lacks.

    A batch that is run again after a failure adds nothing twice, as its images are in the target already. All rows
    of an image must come in one file batch. The query ends when what is there has been read.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(lambda d, _: append_missing(step(d), target, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
