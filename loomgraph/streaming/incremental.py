"""Incremental reconciliation and windows over arriving records, with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..session import shared_dir


def _drain(spark: SparkSession, stream: DataFrame, tag: str, mode: str) -> DataFrame:
    """Run a stream over what has arrived; every batch's updates are stored with its number."""
    base = f"{shared_dir(spark)}/loomgraph-stream-{tag}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def arriving(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def first_of_name(spark: SparkSession, entities: DataFrame) -> DataFrame:
    """(name_key, first_id, seen): the first entity of each name among all that have arrived.

    The state is one row per name.  A chunk that arrives late may come before the first so far: the
    name's row is then updated, which is what the last update per name shows.
    """
    chunk = F.coalesce("chunk_id", F.substring_index("id", "::", 1))
    # By number: chunk 10 comes after chunk 2.
    place = F.struct(F.substring_index(chunk, "_", 1).try_cast("bigint").alias("doc"), F.substring_index(chunk, "_", -1).try_cast("bigint").alias("chunk"), F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint").alias("number"), "id")
    stream = entities.where(F.col("name").isNotNull() & (name_key("name") != "")).groupBy(name_key("name").alias("name_key")).agg(F.min(place).alias("first"), F.count("*").alias("seen"))
    out = _drain(spark, stream, "names", "update")
    return out.groupBy("name_key").agg(F.max_by(F.struct("first", "seen"), "_batch").alias("x")).select("name_key", F.col("x.first.id").alias("first_id"), "x.seen")


def question_windows(spark: SparkSession, questions: DataFrame, window: str = "7 days", late: str = "60 days") -> DataFrame:
    """(window_start, chunk_known, questions): questions per time window; those later than the watermark allows are left out."""
    stream = questions.withWatermark("recorded_at", late).groupBy(F.window("recorded_at", window).alias("w"), F.col("chunk_id").isNotNull().alias("chunk_known")).agg(F.count("*").alias("questions"))
    out = _drain(spark, stream, "windows", "update")
    return out.groupBy("w", "chunk_known").agg(F.max_by("questions", "_batch").alias("questions")).select(F.col("w.start").alias("window_start"), "chunk_known", "questions")
