"""Profiles of arriving files, and windowed counts of labels: additions for continuous loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import bytesx
from ..operators import profile


def arriving(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of files (path, modificationTime, length, content) that land in a folder."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)


def profiled(files: DataFrame) -> DataFrame:
    """The profile of each file; stateless, so it works on a stream as it does on a table."""
    return profile.profile(files, F.col("content"), ["path", "modificationTime", "length"])


def format_counts(events: DataFrame, time: str, text: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, data_fmt, n) of tumbling windows, with a watermark; late rows beyond it are dropped."""
    labelled = events.withWatermark(time, late).select(time, profile.data_format(bytesx.lenient_text(bytesx.sample(bytesx.as_bytes(F.col(text))))).alias("data_fmt"))
    return labelled.groupBy(F.window(time, window).alias("w"), "data_fmt").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "data_fmt", "n")


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
