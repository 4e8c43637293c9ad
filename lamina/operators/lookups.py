"""Keyed lookups: hashes, scores, references, capture sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Pieces that the capture protocol asks for.
TARGETS = {"normal": 30, "defect": 15}


def with_hashes(frames: DataFrame, hashes: DataFrame) -> DataFrame:
    """frames with their hash, by path."""
    return frames.join(hashes.select("path", "phash"), "path")


def aligned_scores(frames: DataFrame, predictions: DataFrame) -> DataFrame:
    """frames with their score, by path. predictions (batch, path, score): the last batch wins. A frame without
    a score is an error when its row is read."""
    last = predictions.groupBy("path").agg(F.max_by("score", "batch").alias("score"))
    joined = frames.join(last, "path", "left")
    missing = F.raise_error(F.concat(F.lit("no score for "), F.col("path"))).cast("double")
    return joined.withColumn("score", F.when(F.col("score").isNull(), missing).otherwise(F.col("score")))


def missing_scores(frames: DataFrame, predictions: DataFrame) -> DataFrame:
    """path of frames without a score."""
    return frames.select("path").join(predictions.select("path"), "path", "left_anti")


def unpacked_batches(batches: DataFrame) -> DataFrame:
    """batch, path, score from rows of parallel arrays (batch, paths, scores); ragged ones are an error."""
    ragged = F.raise_error(F.lit("a batch has more paths than scores, or fewer"))
    zipped = F.when(F.size("paths") == F.size("scores"), F.arrays_zip(F.col("paths").alias("p"), F.col("scores").alias("s"))).otherwise(ragged)
    return batches.select("batch", F.explode(zipped).alias("z")).select("batch", F.col("z.p").alias("path"), F.col("z.s").cast("double").alias("score"))


def with_reference(cells: DataFrame, references: DataFrame) -> DataFrame:
    """cells (model, category, ...) with reference, origin (paper before library) and floor; references has
    (model, category, paper, library) and cells or references a floor by model."""
    joined = cells.join(references, ["model", "category"], "left")
    origin = F.when(F.col("paper").isNotNull(), "paper").when(F.col("library").isNotNull(), "library")
    return joined.withColumn("reference", F.coalesce("paper", "library")).withColumn("origin", origin)


def not_yet_captured(planned: DataFrame, captured: DataFrame) -> DataFrame:
    """Pieces of planned that captured lacks."""
    return planned.join(captured.select("piece").distinct(), "piece", "left_anti")


def last_by_key(cache: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value of the last write."""
    return cache.groupBy(key).agg(F.max_by(value, order).alias(value))


def progress(pieces: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """label, n_pieces, target, is_rehearsal (the target isn't met), for each label of targets."""
    targets = targets or TARGETS
    wanted = pieces.sparkSession.createDataFrame(list(targets.items()), "label string, target long")
    counts = pieces.groupBy("label").agg(F.count_distinct("group_id").alias("n_pieces"))
    joined = wanted.join(counts, "label", "left").na.fill(0, ["n_pieces"])
    return joined.select("label", "n_pieces", "target", (F.col("n_pieces") < F.col("target")).alias("is_rehearsal"))


def next_ids(pieces: DataFrame, prefixes: list[str], column: str = "piece") -> DataFrame:
    """prefix, next_id: the largest number of the prefix plus one, three digits at least; 0 if there is none."""
    known = pieces.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    used = pieces.select(F.split_part(F.col(column), F.lit("-"), F.lit(1)).alias("prefix"), F.split_part(F.col(column), F.lit("-"), F.lit(2)).try_cast("long").alias("n"))
    most = used.groupBy("prefix").agg(F.max("n").alias("n"))
    number = F.coalesce(F.col("n") + 1, F.lit(0)).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return known.join(most, "prefix", "left").select("prefix", F.concat("prefix", F.lit("-"), padded).alias("next_id"))


def first_of(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each value of `by`."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("n_ = 1").drop("n_")
