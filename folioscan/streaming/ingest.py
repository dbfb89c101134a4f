"""Library pages and candidate batches as streams that end when all that landed is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.library import Store
from ..sources import mappers


def ingest_library(spark: SparkSession, landed: str, store: Store, checkpoint: str, deleted: DataFrame | None = None) -> None:
    """Every landed library page into the store, once each, in order of arrival; later files win, and keys of ``deleted`` go."""
    pages = spark.readStream.schema(schemas.LIBRARY_PAGE).option("multiLine", True).option("maxFilesPerTrigger", 100).json(landed)

    def apply(batch: DataFrame, number: int) -> None:
        items = mappers.library_item(batch.withColumn("_at", F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"))), "_at")
        fetched = items.withColumnRenamed("_at", "ord")
        mark = fetched.agg(F.max("version")).first()[0]
        store.sync(fetched.withColumn("ord", F.col("ord").cast("string")), deleted, mark)

    pages = pages.select("*", "_metadata")
    pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counts_by_day(works: DataFrame, at: str, late: str = "7 days") -> DataFrame:
    """Works a day and source of a stream of candidates; rows later than ``late`` are left out."""
    return works.withWatermark(at, late).groupBy(F.window(at, "1 day"), "source").agg(F.count("*").alias("works"))
