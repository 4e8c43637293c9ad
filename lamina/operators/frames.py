"""The frame table: its schema, its constraints, and counts by group and split.

A row is one frame: path (its identity), group_id (the physical piece, the unit of correlation), label,
source_video, frame_index, timestamp_s, and whatever else is carried along (a hash, a thumbnail).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.config import LABELS, SPLITS
from lamina.functions import keys

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False), T.StructField("group_id", T.StringType(), False),
        T.StructField("label", T.StringType(), False), T.StructField("source_video", T.StringType(), False),
        T.StructField("frame_index", T.LongType(), False), T.StructField("timestamp_s", T.DoubleType(), False),
    ]
)


def violations() -> dict[str, F.Column]:
    """A message and the condition of each row constraint."""
    return {
        "path must not be empty": F.coalesce(F.length("path") == 0, F.lit(True)),
        "group_id must not be empty": F.coalesce(F.length("group_id") == 0, F.lit(True)),
        "label must be normal or defect": ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)),
        "frame_index must be 0 or more": ~F.coalesce(F.col("frame_index") >= 0, F.lit(False)),
        "timestamp_s must be 0 or more": ~F.coalesce((F.col("timestamp_s") >= 0) & ~F.isnan("timestamp_s"), F.lit(False)),
    }


def checked(frames: DataFrame) -> DataFrame:
    """frames, with an error as soon as a row that breaks a constraint is read. No extra pass: the check
    rides on a column."""
    bad = F.lit(None).cast("string")
    for message, condition in reversed(violations().items()):
        bad = F.when(condition, F.lit(message)).otherwise(bad)
    failed = F.concat(bad, F.lit(": "), F.coalesce("path", F.lit("null")))
    return frames.withColumn("group_id", F.when(bad.isNotNull(), F.raise_error(failed)).otherwise(F.col("group_id")))


def invalid(frames: DataFrame) -> DataFrame:
    """The rows that break a constraint, and which ones."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in violations().items()]))
    return frames.withColumn("violations", broken).where(F.size("violations") > 0)


def duplicate_paths(frames: DataFrame) -> DataFrame:
    """path, n of paths that occur more than once; there should be none."""
    return frames.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")


def with_keys(frames: DataFrame) -> DataFrame:
    """frames with storage path and clip name filled in from group and index."""
    return frames.withColumn("path", keys.frame_key("group_id", "frame_index")).withColumn("source_video", keys.clip_of("source_video", "group_id"))


def group_counts(frames: DataFrame) -> DataFrame:
    """group_id, n_frames, label of each group; a group's label is its one label."""
    return frames.groupBy("group_id").agg(F.count("*").alias("n_frames"), F.min("label").alias("label"))


def label_conflicts(frames: DataFrame) -> DataFrame:
    """group_id, n_labels of groups with more than one label."""
    return frames.groupBy("group_id").agg(F.count_distinct("label").alias("n_labels")).where("n_labels > 1")


def consistent_groups(frames: DataFrame) -> DataFrame:
    """group_counts, with an error for a group of more than one label."""
    per = frames.groupBy("group_id").agg(F.count("*").alias("n_frames"), F.min("label").alias("label"), F.max("label").alias("other"))
    mixed = F.raise_error(F.concat(F.lit("a group has more than one label: "), F.col("group_id")))
    return per.select("group_id", "n_frames", F.when(F.col("label") == F.col("other"), F.col("label")).otherwise(mixed).alias("label"))


def split_counts(manifest: DataFrame) -> DataFrame:
    """split, n_frames, n_groups of all three splits, zeros included."""
    spark = manifest.sparkSession
    names = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    counts = manifest.groupBy("split").agg(F.count("*").alias("n_frames"), F.count_distinct("group_id").alias("n_groups"))
    return names.join(counts, "split", "left").na.fill(0, ["n_frames", "n_groups"])


def groups_of(manifest: DataFrame, split: str) -> DataFrame:
    return manifest.where(F.col("split") == split).select("group_id").distinct()


def samples(manifest: DataFrame, split: str) -> DataFrame:
    """What a trainer reads: image_path, split, label_index (1: defect), mask_path."""
    return manifest.where(F.col("split") == split).select(F.col("path").alias("image_path"), "split", (F.col("label") == "defect").cast("int").alias("label_index"), F.lit("").alias("mask_path"))


def capped(frames: DataFrame, max_frames: int) -> DataFrame:
    """The first max_frames frames of each clip: a filter that reaches the scan."""
    return frames.where(F.col("frame_index") < max_frames)


def systematic(frames: DataFrame, every: int = 15) -> DataFrame:
    """One frame in `every`, for quality control."""
    return frames.where(F.col("frame_index") % every == 0)


def after_warm_up(frames: DataFrame, skip: int = 5, most: int = 31) -> DataFrame:
    """The first `most` frames of each group without the first `skip`; all of them if there are no others."""
    few = frames.where(F.col("frame_index") < most)
    longer = few.groupBy("group_id").agg((F.max("frame_index") >= skip).alias("longer"))
    return few.join(longer, "group_id").where(~F.col("longer") | (F.col("frame_index") >= skip)).drop("longer")
