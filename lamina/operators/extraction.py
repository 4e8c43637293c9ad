"""From a clip's decoded frames to the frame table: sample first, then hash what is kept, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.config import SamplerConfig
from lamina.functions import keys
from lamina.functions.images import Hasher, thumbnail_of

from .sampling import sample


def extract(decoded: DataFrame, *, config: SamplerConfig | None = None, hasher: Hasher | None = None, max_frames: int | None = None) -> DataFrame:
    """path, group_id, label, source_video, frame_index, timestamp_s, phash, image of kept frames.

    decoded: group_id, label, source_video (null: the group's own clip), frame_index, timestamp_s, image. The cap is
    a filter at the scan; the sampler runs on thumbnails, so the hash (the dearer function) sees kept frames only.
    """
    config, hasher = config or SamplerConfig(), hasher or Hasher()
    rows = decoded if max_frames is None else decoded.where(F.col("frame_index") < max_frames)
    small = rows.withColumn("thumb", thumbnail_of(F.col("image"), config.thumbnail))
    kept = sample(small, config).where("kept").drop("kept", "thumb")
    named = kept.withColumn("path", keys.frame_key("group_id", "frame_index")).withColumn("source_video", keys.clip_of("source_video", "group_id"))
    return named.withColumn("phash", hasher(F.col("image"))).select("path", "group_id", "label", "source_video", "frame_index", "timestamp_s", "phash", "image")


def near_duplicates(originals: DataFrame, duplicates: int, config=None) -> DataFrame:
    """group_id, frame_index, image: each original (group_id, image) and `duplicates` jittered copies; index 0
    is the intact original. A copy's seed depends on its group and index alone."""
    from lamina.functions.images import jittered

    every = originals.withColumn("frame_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(duplicates).cast("long"))))
    seed = F.when(F.col("frame_index") == 0, F.lit(-1).cast("long")).otherwise(keys.stable_seed("group_id", "frame_index"))
    return every.withColumn("image", jittered(F.col("image"), seed, config))
