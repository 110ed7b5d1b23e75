"""Results that arrive over time: the running class distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.values import base_name, is_image_name
from tagloom.operators.insight import label_stream

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images as they are put into a folder: image_name, image_path, content."""
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).load(folder)
    name = base_name(F.col("path"))
    return stream.filter(is_image_name(name)).select(name.alias("image_name"), F.col("path").alias("image_path"), "content")


def running_class_counts(results: DataFrame) -> DataFrame:
    """Counts per label over a stream of results; run it in ``update`` or ``complete`` mode.

    Only one count per label is kept as state.
    """
    return label_stream(results).groupBy("label").agg(F.count("*").alias("n"))
