"""Controlled leakage: two training arms that differ in nothing but what leaked, and the dose table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.config import SplitRatios

from .splitting import ranked_by_seed


def leaked_arms(frames: DataFrame, *, seeds: Sequence[int], doses: Sequence[float], ratios: SplitRatios | None = None) -> DataFrame:
    """seed, dose, arm (clean or leaked), split, and the columns of frames.

    frames: label normal - an intact original (frame_index 0) and its near-duplicates for each group; label
    defect - evaluation only. For each seed the normal groups stand in seeded order and are cut at
    round(n * ratio). test: the originals of the test groups and all defects, the same in both arms and for
    every dose. val: the originals of the val groups. clean train: all frames of the train groups. leaked
    train: clean train without its first n rows (groups in seeded order, frames in theirs), and the first n, in
    seeded order, of the test groups' near-duplicates (never an original); n = round(n_train * dose). The
    orders don't depend on the dose, so doses are nested. Too few near-duplicates, or an empty split, is an error.
    """
    ratios = ratios or SplitRatios()
    if any(not 0.0 <= d <= 1.0 for d in doses):
        raise ValueError("a dose must be in [0, 1]")
    names = frames.columns
    every = frames.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    normal = every.where("label = 'normal'")
    groups = normal.groupBy("seed", "group_id").agg(F.count("*").alias("n_frames"))
    seed = F.col("seed")
    groups = ranked_by_seed(groups, seed, "group_id", ("seed",)).withColumnsRenamed({"rn": "g_rank", "total": "n_groups"})
    n = F.col("n_groups").cast("double")
    cut_train, cut_val = F.bround(n * ratios.train), F.bround(n * ratios.val)
    groups = groups.withColumn("split", F.when(F.col("g_rank") <= cut_train, "train").when(F.col("g_rank") <= cut_train + cut_val, "val").otherwise("test"))
    bad = (cut_train == 0) | (cut_val == 0) | (cut_train + cut_val >= n)
    groups = groups.withColumn("split", F.when(bad, F.raise_error(F.lit("there are too few groups to split"))).otherwise(F.col("split")))
    # rows of clean train before a group: prefix sums over groups
    held = F.when(F.col("split") == "train", F.col("n_frames")).otherwise(0)
    groups = ranked_by_seed(groups, seed, "group_id", ("seed",), held).withColumn("before", F.col("rn") - held).withColumnRenamed("total", "n_train").drop("rn")
    placed = normal.join(groups.select("seed", "group_id", "split", "before", "n_train"), ["seed", "group_id"])
    in_group = F.row_number().over(Window.partitionBy("seed", "group_id").orderBy("frame_index", "path"))
    placed = placed.withColumn("rn", F.col("before") + in_group)
    evaluation = placed.where("split <> 'train' AND frame_index = 0").select("seed", *names, "split").unionByName(every.where("label = 'defect'").select("seed", *names, F.lit("test").alias("split")))
    dose = F.explode(F.array(*[F.lit(float(d)) for d in doses]))
    arms = F.explode(F.array(F.lit("clean"), F.lit("leaked")))
    columns = ("seed", "dose", "arm", "split", *names)
    evaluation = evaluation.withColumn("dose", dose).withColumn("arm", arms).select(*columns)
    train = placed.where("split = 'train'").withColumn("dose", dose).withColumn("arm", arms)
    n_leak = F.bround(F.col("n_train").cast("double") * F.col("dose"))
    train = train.where((F.col("arm") == "clean") | (F.col("rn") > n_leak)).select(*columns)
    spare = placed.where("split = 'test' AND frame_index > 0")
    spare = ranked_by_seed(spare.drop("rn"), seed, "path", ("seed",)).withColumnRenamed("total", "n_spare")
    leak = spare.withColumn("dose", dose).withColumn("arm", F.lit("leaked"))
    short = F.raise_error(F.lit("a dose needs more near-duplicates of test groups than there are"))
    leak = leak.withColumn("split", F.when(n_leak > F.col("n_spare"), short).otherwise(F.lit("train"))).where(F.col("rn") <= n_leak).select(*columns)
    return train.unionByName(leak).unionByName(evaluation)


def clean_minus_leaked(arms: DataFrame) -> DataFrame:
    """seed, dose, path of training rows of the clean arm that the leaked arm lacks."""
    train = arms.where("split = 'train'")
    keys = ["seed", "dose", "path"]
    return train.where("arm = 'clean'").select(*keys).exceptAll(train.where("arm = 'leaked'").select(*keys))


def arm_sizes(arms: DataFrame) -> DataFrame:
    """seed, dose, arm, n_train, n_val, n_test, n_leaked (near-duplicates of test groups in train)."""
    test_groups = arms.where("split = 'test' AND label = 'normal'").select("seed", F.col("group_id").alias("g_")).distinct().withColumnRenamed("seed", "s_")
    joined = arms.join(test_groups, (F.col("seed") == F.col("s_")) & (F.col("group_id") == F.col("g_")), "left")
    is_ = {s: F.col("split") == s for s in ("train", "val", "test")}
    return joined.groupBy("seed", "dose", "arm").agg(*[F.count_if(c).alias(f"n_{s}") for s, c in is_.items()], F.count_if(is_["train"] & F.col("g_").isNotNull()).alias("n_leaked"))


def mean_by_dose(results: DataFrame, value: str = "auroc") -> DataFrame:
    """dose, arm, mean of replicate results (dose, seed, arm, value)."""
    return results.groupBy("dose", "arm").agg(F.avg(value).alias(f"mean_{value}"))


def paired_by_dose(results: DataFrame, value: str = "auroc") -> DataFrame:
    """dose, seed, treatment (leaked), control (clean) of the doses that leak something. The clean arm is the
    same for every dose of a seed and is given once, as any dose."""
    leaked = results.where("arm = 'leaked' AND dose > 0").select("dose", "seed", F.col(value).alias("treatment"))
    clean = results.where("arm = 'clean'").groupBy("seed").agg(F.min_by(value, "dose").alias("control"))
    return leaked.join(clean, "seed")


def cost_seconds(n_trainings: F.Column, n_images: F.Column, seconds_an_image: float) -> F.Column:
    """Estimated time of a run."""
    return n_trainings * n_images * F.lit(float(seconds_an_image))
