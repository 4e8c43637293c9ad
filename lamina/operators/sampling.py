"""Change-based sampling of ordered frames, in batch. streaming.sampler has the same rule on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.config import SamplerConfig


def vector_difference(a: Column, b: Column, scale: float = 255.0) -> Column:
    """Mean absolute difference of two arrays, over scale."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)
    return total / F.size(a) / F.lit(float(scale))


def scalar_difference(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.abs(a.cast("double") - b.cast("double")) / F.lit(float(scale))


def sample(frames: DataFrame, config: SamplerConfig | None = None, *, signal: str = "thumb", group: str = "group_id", order: str = "frame_index", difference=None) -> DataFrame:
    """frames with kept, decided for each group in order.

    The first frame is kept. Then a frame is dropped while fewer than min_interval frames have passed since the
    last kept one, kept once max_interval have, and kept if it differs from the last *kept* one by
    min_difference. The state (reference, frames since) never crosses groups: the group is the key. One shuffle
    by group; signal is the array or number that is compared.
    """
    config = config or SamplerConfig()
    kind = frames.schema[signal].dataType
    difference = difference or (vector_difference if kind.typeName() == "array" else scalar_difference)
    item = F.struct(F.col(order).alias("o"), F.col(signal).alias("x"), F.struct(*frames.columns).alias("row"))
    per = frames.groupBy(group).agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)).alias("xs"))
    start = F.struct(F.lit(None).cast(kind).alias("ref"), F.lit(0).alias("since"), F.lit(True).alias("first"), F.lit("").alias("flags"))

    def step(a, x):
        since = a["since"] + 1
        forced = since >= config.max_interval if config.max_interval is not None else F.lit(False)
        keep = F.when(a["first"], True).when(since < config.min_interval, False).otherwise(forced | F.coalesce(difference(x["x"], a["ref"]) >= config.min_difference, F.lit(False)))
        return F.struct(F.when(keep, x["x"]).otherwise(a["ref"]).alias("ref"), F.when(keep, F.lit(0)).otherwise(since).alias("since"), F.lit(False).alias("first"), F.concat(a["flags"], keep.cast("int").cast("string")).alias("flags"))

    flags = F.split(F.aggregate("xs", start, step)["flags"], "")  # a character a frame: appending to an array would copy it
    rows = per.select(F.explode(F.arrays_zip("xs", flags.alias("flags"))).alias("z"))
    return rows.select("z.xs.row.*", (F.col("z.flags") == "1").alias("kept"))


def stats(flagged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """seen, kept, retained_fraction (1.0 if nothing was seen; 6 digits)."""
    counts = flagged.groupBy(*by).agg(F.count("*").alias("seen"), F.count_if("kept").alias("kept"))
    return counts.withColumn("retained_fraction", F.when(F.col("seen") == 0, F.lit(1.0)).otherwise(F.round(F.col("kept") / F.col("seen").cast("double"), 6)))
