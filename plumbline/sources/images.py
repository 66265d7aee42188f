"""Image files by id, and their pixels as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def image_name(split: str, image_id: Column, year: int = 2014) -> Column:
    """File name of an image: the split and the id with twelve digits."""
    return F.format_string(f"COCO_{split}{year}_%012d.jpg", image_id.cast("long"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, image_id, content) of the .jpg files of a folder; the id is the number at the end of the name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder)
    return files.select("path", F.regexp_extract("path", r"(\d+)\.jpg$", 1).cast("long").alias("image_id"), "content")
