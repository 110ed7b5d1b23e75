"""Image folders as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.values import base_name, is_image_name
from tagloom.sources.headers import sizes_of


def _path(column: Column) -> Column:
    """One spelling for local files: the two sources differ in the slashes behind ``file:``."""
    return F.regexp_replace(column, "^file:/+", "/")


PNG_SIGNATURE = "89504E470D0A1A0A"


def scan_images(spark: SparkSession, folder: str, with_content: bool = False, with_times: bool = False) -> DataFrame:
    """Images directly in ``folder`` by extension: image_name, image_path, n_bytes (and modified_at, content).

    Without ``with_content`` only the listing is read, never the files. Empty files are left out, as Spark never lists them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = base_name(F.col("path"))
    columns = [name.alias("image_name"), _path(F.col("path")).alias("image_path"), F.col("length").alias("n_bytes")]
    if with_times:  # part of the question in an answer log: a changed image is asked about again
        columns.append(F.col("modificationTime").alias("modified_at"))
    if with_content:
        columns.append(F.col("content"))
    return files.filter(is_image_name(name)).select(*columns)


def with_image_ids(images: DataFrame) -> DataFrame:
    """Key images by a hash of their path: no order and no shuffle needed."""
    return images.withColumn("image_id", F.xxhash64("image_path"))


def image_sizes(spark: SparkSession, folder: str, whole_files: bool = False) -> DataFrame:
    """image_name, image_path, image_width, image_height of PNG and JPEG files, whatever they are named; unreadable ones come with nulls.

    Workers fetch the first bytes of each file by its path. In a store that only Spark reads, set ``whole_files``.
    """
    scanned = scan_images(spark, folder, with_content=whole_files)
    if whole_files:
        return sizes_of(scanned.select("image_name", "image_path", "content"), "content")
    paths = scanned.select("image_name", "image_path", F.col("image_path").alias("_path"))
    return sizes_of(paths, "_path")


def png_size(content: Column) -> Column:
    """Width and height from the header of a PNG, null for other data: no pixel is decoded."""

    def number(start: int) -> Column:
        return F.conv(F.hex(F.substring(content, start, 4)), 16, 10).cast("int")

    return F.when(
        F.hex(F.substring(content, 1, 8)) == PNG_SIGNATURE,
        F.struct(number(17).alias("image_width"), number(21).alias("image_height")),
    )
