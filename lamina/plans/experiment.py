"""The dose-response experiment: arms, replicate results, contrasts, correction, monotonicity, verdicts."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import arms, metrics, statistics


def config_key(**config) -> str:
    """A cache key from everything that a result depends on."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def replicate_auroc(scores: DataFrame) -> DataFrame:
    """dose, seed, arm, auroc from (dose, seed, arm, score, y): one aggregation, nothing is looped over."""
    return metrics.auroc(scores, by=("dose", "seed", "arm"))


def dose_response(results: DataFrame, *, alpha: float = 0.05, min_effect: float = 0.02, n_bootstrap: int = 10_000, seed: int = 0) -> DataFrame:
    """A row for each measured dose: the paired comparison of leaked and clean, Holm-corrected p, and whether the
    effect is relevant. Doses without leaked frames have no contrast: their difference is 0 by construction."""
    compared = statistics.compare(arms.paired_by_dose(results), "dose", n_bootstrap=n_bootstrap, seed=seed)
    corrected = statistics.holm(compared, "p_value", ("dose",))
    return corrected.withColumn("relevant", statistics.significant("p_value", "mean_difference", alpha, min_effect) & (F.col("p_corrected") < alpha))


def dose_monotonicity(curve: DataFrame) -> DataFrame:
    """Rank correlation of dose and mean difference over measured doses (three or more)."""
    return statistics.monotonicity(curve.withColumn("contrast", F.lit("dose")), "contrast", "dose", "mean_difference")


def zero_dose_holds(results: DataFrame) -> DataFrame:
    """n, max_difference between the arms at dose 0: both arms are the same there, so it must be 0."""
    zero = results.where("dose = 0").groupBy("seed").pivot("arm", ["clean", "leaked"]).agg(F.first("auroc"))
    return zero.agg(F.count("*").alias("n"), F.max(F.abs(F.col("leaked") - F.col("clean"))).alias("max_difference"))
