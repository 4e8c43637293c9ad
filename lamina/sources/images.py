"""Image folders: scans by Spark's own readers, census and official split from the paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import keys

# File names that count as images.
SUFFIXES = ("png", "jpg", "jpeg", "bmp")


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """path, modified, length of images under root, without their content (the column is pruned)."""
    glob = "*.{" + ",".join([*SUFFIXES, *(s.upper() for s in SUFFIXES)]) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", F.col("modificationTime").alias("modified"), "length")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """path, image (origin, height, width, nChannels, mode, data; BGR). An image that can't be read is an error."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).load(root).select("image")
    bad = F.col("image.height") <= 0
    origin = F.when(bad, F.raise_error(F.concat(F.lit("not a readable image: "), F.col("image.origin")))).otherwise(F.col("image.origin"))
    return rows.withColumn("path", origin).select("path", "image")


def _parts(images: DataFrame, category: str) -> DataFrame:
    inner = F.regexp_extract("path", rf"/{category}/(train|test)/([^/]+)/[^/]+$", 0)
    part = F.regexp_extract("path", rf"/{category}/(train|test)/([^/]+)/[^/]+$", 1)
    subset = F.regexp_extract("path", rf"/{category}/(train|test)/([^/]+)/[^/]+$", 2)
    return images.where(inner != "").withColumn("part", part).withColumn("subset", subset)


def census(images: DataFrame, category: str) -> DataFrame:
    """category, train_normal, test_normal, test_defect, defect_types, is_usable: one row."""
    rows = _parts(images, category)
    train, good = F.col("part") == "train", F.col("subset") == "good"
    per = rows.agg(F.count_if(train & good).alias("train_normal"), F.count_if(~train & good).alias("test_normal"), F.count_if(~train & ~good).alias("test_defect"), F.sort_array(F.collect_set(F.when(~train & ~good, F.col("subset")))).alias("defect_types"))
    usable = (F.col("train_normal") > 0) & (F.col("test_normal") > 0) & (F.col("test_defect") > 0)
    return per.select(F.lit(category).alias("category"), "train_normal", "test_normal", "test_defect", "defect_types", usable.alias("is_usable"))


def official_manifest(images: DataFrame, category: str) -> DataFrame:
    """The folder's own split: train/good is train, test/* is test, val is empty; each image is a group."""
    rows = _parts(images, category).where((F.col("part") == "test") | (F.col("subset") == "good"))
    group = F.concat_ws("/", "part", "subset", keys.path_stem("path"))
    label = F.when(F.col("subset") == "good", "normal").otherwise("defect")
    return rows.select("path", group.alias("group_id"), label.alias("label"), F.concat_ws("/", "part", "subset").alias("source_video"), F.lit(0).cast("long").alias("frame_index"), F.lit(0.0).alias("timestamp_s"), F.col("part").alias("split"))


def artifact(spark: SparkSession, root: str, key: str) -> DataFrame:
    """path, content of a stored artifact; an unsafe key is an error."""
    if not spark.range(1).select(keys.key_is_safe(F.lit(key))).first()[0]:
        raise ValueError(f"key leaves the storage root: {key!r}")
    return spark.read.format("binaryFile").load(f"{root}/{key.replace(chr(92), '/')}").select("path", "content")
