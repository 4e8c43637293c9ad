"""Quality of frames and clips: exposure, flicker, sharpness, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limits beyond which a clip is warned about.
CLIPPED, FLICKER, BRIGHTNESS_DRIFT, SHARPNESS_LOSS = 0.02, 0.03, 0.10, 0.40


def clip_quality(frames: DataFrame, by: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """n_frames, brightness_mean, brightness_cv (population deviation over mean, 0 if the mean is 0),
    clipped_max, sharpness_median and warnings of each clip, from frame rows with brightness, clipped_dark,
    clipped_bright and sharpness."""
    per = frames.groupBy(*by).agg(
        F.count("*").alias("n_frames"), F.avg("brightness").alias("brightness_mean"), F.stddev_pop("brightness").alias("sd_"),
        F.max("clipped_dark").alias("dark_"), F.max("clipped_bright").alias("bright_"), F.percentile("sharpness", F.lit(0.5)).alias("sharpness_median"),
    )
    per = per.withColumn("brightness_cv", F.when(F.col("brightness_mean") > 0, F.col("sd_") / F.col("brightness_mean")).otherwise(F.lit(0.0))).withColumn("clipped_max", F.greatest("dark_", "bright_"))
    clipped = F.when(F.col("clipped_max") > CLIPPED, F.when(F.col("dark_") >= F.col("bright_"), "clipped_dark").otherwise("clipped_bright"))
    flicker = F.when((F.col("n_frames") > 1) & (F.col("brightness_cv") > FLICKER), "flicker")
    return per.withColumn("warnings", F.array_compact(F.array(clipped, flicker))).select(*by, "n_frames", "brightness_mean", "brightness_cv", "clipped_max", "sharpness_median", "warnings")


def summary(clips: DataFrame) -> DataFrame:
    """clips, rounded as they are archived."""
    return clips.withColumns({c: F.round(c, 2 if c == "sharpness_median" else 4) for c in ("brightness_mean", "brightness_cv", "clipped_max", "sharpness_median")})


def drift(clips: DataFrame, *, session: tuple[str, ...], order: str) -> DataFrame:
    """clips with the relative change of brightness and loss of sharpness against the first clip of the session,
    and drift_warnings. A reference of 0 gives no warning."""
    w = Window.partitionBy(*session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ref_b, ref_s = F.first("brightness_mean").over(w), F.first("sharpness_median").over(w)
    out = clips.withColumn("ref_b_", ref_b).withColumn("ref_s_", ref_s)
    change = F.when(F.col("ref_b_") > 0, F.abs(F.col("brightness_mean") - F.col("ref_b_")) / F.col("ref_b_"))
    loss = F.when(F.col("ref_s_") > 0, F.lit(1.0) - F.col("sharpness_median") / F.col("ref_s_"))
    out = out.withColumn("brightness_drift", change).withColumn("sharpness_loss", loss)
    warned = F.array_compact(F.array(F.when(F.col("brightness_drift") > BRIGHTNESS_DRIFT, "brightness_drift"), F.when(F.col("sharpness_loss") > SHARPNESS_LOSS, "sharpness_loss")))
    return out.withColumn("drift_warnings", warned).drop("ref_b_", "ref_s_")
