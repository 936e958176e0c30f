"""Windows over event streams; each works on a stream and on a table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files with the schema of a table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def read_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """A stream of files as they arrive in a folder: path, content, length."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(folder)


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late else out


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    w = _timed(events, late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str | None = None) -> DataFrame:
    w = _timed(events, late).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    w = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once; state is kept as long as the watermark allows late rows."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that a bounded stream has to give, in a table in memory; for tests and small inputs."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
