"""Leakage between splits, from the manifest alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit(manifest: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each value of `by`): shared_train_test, shared_train_val, shared_val_test groups,
    contaminated test frames, normal_test frames, total frames, fraction, is_clean.

    One aggregation by group with partial sums, then one over groups; contaminated counts all test frames of
    groups that are in train, the fraction is over normal test frames (0 if there are none). is_clean is
    about train only; shared_val_test is reported beside it.
    """
    is_ = {s: F.col("split") == s for s in ("train", "val", "test")}
    per = manifest.groupBy(*by, "group_id").agg(
        *[F.bool_or(c).alias(f"in_{s}") for s, c in is_.items()],
        F.sum(is_["test"].cast("long")).alias("n_test"), F.sum((is_["test"] & (F.col("label") == "normal")).cast("long")).alias("n_normal"), F.count("*").alias("n"),
    )

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")

    both = F.col("in_train") & F.col("in_test")
    found = per.groupBy(*by).agg(
        total(both).alias("shared_train_test"), total(F.col("in_train") & F.col("in_val")).alias("shared_train_val"), total(F.col("in_val") & F.col("in_test")).alias("shared_val_test"),
        F.coalesce(F.sum(F.when(both, F.col("n_test")).otherwise(0)), F.lit(0)).cast("long").alias("contaminated"),
        F.coalesce(F.sum("n_normal"), F.lit(0)).cast("long").alias("normal_test"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"),
    )
    fraction = F.when(F.col("normal_test") == 0, F.lit(0.0)).otherwise(F.col("contaminated") / F.col("normal_test").cast("double"))
    return found.withColumn("fraction", fraction).withColumn("is_clean", (F.col("shared_train_test") == 0) & (F.col("shared_train_val") == 0))


def payload(manifest: DataFrame) -> DataFrame:
    """The audit as it is archived: the fraction with 6 digits."""
    return audit(manifest).withColumn("fraction", F.round("fraction", 6))


def shared_groups(manifest: DataFrame, a: str = "train", b: str = "test") -> DataFrame:
    """The groups of both splits."""
    left, right = (manifest.where(F.col("split") == s).select("group_id") for s in (a, b))
    return left.intersect(right)


def contaminated_frames(manifest: DataFrame) -> DataFrame:
    """Test frames whose group is in train."""
    train = manifest.where(F.col("split") == "train").select("group_id").distinct()
    return manifest.where(F.col("split") == "test").join(train, "group_id", "left_semi")


def assert_clean(manifest: DataFrame) -> DataFrame:
    """manifest; an error at once if a group is in train and in another split."""
    found = audit(manifest).first()
    if not found["is_clean"]:
        raise ValueError(f"groups are shared between splits: train/test {found['shared_train_test']}, train/val {found['shared_train_val']}")
    return manifest
