"""Ranks, AUROC, confusion, and threshold calibration.

Ordered operators are windows over *distinct scores* within `by` (replicate, dose, arm, ...): rows are
aggregated to one for each score first. With `by` empty and very many distinct scores, `buckets` deals the
scores into ranges by approximate quantiles, so that no task sorts all of them; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checked_scores(scores: DataFrame, score: str = "score") -> DataFrame:
    """scores, with an error for a null or non-finite one (Spark would sort NaN last and equal to itself)."""
    s = F.col(score).cast("double")
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    return scores.withColumn(score, F.when(bad, F.raise_error(F.lit("a score is not a finite number"))).otherwise(s))


def running(df: DataFrame, by: tuple[str, ...], key: str, sums: dict[str, str], *, descending: bool = False, buckets: int = 0) -> DataFrame:
    """df with, for each {name: column} of sums, the sum of the column over rows before this one in order of
    key (distinct within by), and name_total."""
    order = F.col(key).desc() if descending else F.col(key).asc()
    if not buckets:
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        every = Window.partitionBy(*by)
        return df.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in sums.items()], *[F.sum(c).over(every).alias(f"{n}_total") for n, c in sums.items()])
    cuts = df.groupBy(*by).agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("cuts_"))
    dealt = df.join(cuts, list(by)) if by else df.crossJoin(F.broadcast(cuts))
    dealt = dealt.withColumn("bucket_", F.size(F.filter("cuts_", lambda c: c < F.col(key))) * (-1 if descending else 1)).drop("cuts_")
    per = dealt.groupBy(*by, "bucket_").agg(*[F.sum(c).alias(f"{n}_b") for n, c in sums.items()])
    up = Window.partitionBy(*by).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, "bucket_", *[F.coalesce(F.sum(f"{n}_b").over(up), F.lit(0)).alias(f"{n}_up") for n in sums], *[F.sum(f"{n}_b").over(Window.partitionBy(*by)).alias(f"{n}_total") for n in sums])
    inner = Window.partitionBy(*by, "bucket_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(per), [*by, "bucket_"])  # a row for each bucket
    return joined.select(*df.columns, *[(F.col(f"{n}_up") + F.coalesce(F.sum(c).over(inner), F.lit(0))).alias(n) for n, c in sums.items()], *[f"{n}_total" for n in sums])


def by_score(scores: DataFrame, by: tuple[str, ...] = (), score: str = "score", label: str = "y") -> DataFrame:
    """by, score, n, n_pos: one row for each distinct score."""
    return scores.groupBy(*by, score).agg(F.count("*").alias("n"), F.count_if(label).alias("n_pos"))


def mid_ranks(rows: DataFrame, value: str, by: tuple[str, ...] = (), into: str = "mid_rank", buckets: int = 0) -> DataFrame:
    """rows with the average rank (from 1) of value, ties sharing the mean of their ranks."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n_"))
    ranked = running(counts, by, value, {"before_": "n_"}, buckets=buckets)
    ranks = ranked.select(*[F.col(c).alias(f"{c}_by_") for c in by], F.col(value).alias("v_"), (F.col("before_") + (F.col("n_") + 1) / F.lit(2.0).cast("double")).alias(into))
    same = F.col(value) == F.col("v_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_by_"))
    return rows.join(ranks, same).select(*rows.columns, into)


def auroc(scores: DataFrame, by: tuple[str, ...] = (), score: str = "score", label: str = "y", buckets: int = 0) -> DataFrame:
    """by, n, n_pos, auroc: (sum of the positives' mid-ranks - p (p + 1) / 2) / (p * q), from one row for each
    distinct score; null if a class is absent."""
    counts = running(by_score(scores, by, score, label), by, score, {"before_": "n"}, buckets=buckets)
    mid = F.col("before_") + (F.col("n") + 1) / F.lit(2.0).cast("double")
    p, q = F.col("n_pos").cast("double"), (F.col("n") - F.col("n_pos")).cast("double")
    per = counts.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_pos"), F.lit(0)).alias("n_pos"), F.sum(F.col("n_pos") * mid).alias("ranks_"))
    return per.withColumn("auroc", F.when((p > 0) & (q > 0), (F.col("ranks_") - p * (p + 1) / 2) / (p * q))).drop("ranks_")


def strict_auroc(scores: DataFrame, **how) -> float:
    """The AUROC of one set of scores; an error if a score is not finite or a class is absent."""
    found = auroc(checked_scores(scores, how.get("score", "score")), **how).first()
    if found is None or found["auroc"] is None:
        raise ValueError("AUROC needs both classes")
    return found["auroc"]


def flagged(score: F.Column | str, threshold: F.Column | float) -> F.Column:
    """Whether a score is an alarm; the threshold itself is."""
    return (F.col(score) if isinstance(score, str) else score) >= threshold


def confusion(scores: DataFrame, threshold: F.Column | float, by: tuple[str, ...] = (), score: str = "score", label: str = "y") -> DataFrame:
    """by, tp, fp, tn, fn."""
    f, y = flagged(score, threshold), F.col(label)
    return scores.groupBy(*by).agg(F.count_if(f & y).alias("tp"), F.count_if(f & ~y).alias("fp"), F.count_if(~f & ~y).alias("tn"), F.count_if(~f & y).alias("fn"))


def _ratio(a: F.Column, b: F.Column) -> F.Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def rates(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, tn, fn) with recall, precision, f1 and false_alarm_rate; 0 where a denominator is."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumn("recall", _ratio(tp, tp + fn)).withColumn("precision", _ratio(tp, tp + fp)).withColumn("false_alarm_rate", _ratio(fp, fp + tn))
    return out.withColumn("f1", _ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def calibrate_f1(scores: DataFrame, *, split: str, by: tuple[str, ...] = (), score: str = "score", label: str = "y", buckets: int = 0) -> DataFrame:
    """by, threshold, f1_on_val, candidates: the distinct score with the best F1, the lowest of equal ones. Only
    scores of the validation split may be used. Null threshold if a class is absent.

    Cumulative counts from the top replace one confusion matrix for each candidate.
    """
    if split != "val":
        raise ValueError(f"a threshold is calibrated on val only, not on {split}")
    counts = running(by_score(scores, by, score, label), by, score, {"flag_": "n", "hit_": "n_pos"}, descending=True, buckets=buckets)
    tp, alarms, p = F.col("hit_") + F.col("n_pos"), F.col("flag_") + F.col("n"), F.col("hit__total")
    precision, recall = _ratio(tp, alarms), _ratio(tp, p)
    f1 = _ratio(F.lit(2.0) * precision * recall, precision + recall)
    # equal F1 values are compared as computed, rounded beyond the last meaningful digit
    best = F.max_by(F.struct(F.col(score).alias("threshold"), f1.alias("f1")), F.struct(F.round(f1, 12).alias("f"), (-F.col(score)).alias("s")))
    per = counts.groupBy(*by).agg(best.alias("b"), F.count("*").alias("candidates"), F.max((p > 0) & (p < F.col("flag__total"))).alias("both"))
    return per.select(*by, F.when(F.col("both"), F.col("b.threshold")).alias("threshold"), F.when(F.col("both"), F.col("b.f1")).alias("f1_on_val"), "candidates")


def verdict(value: F.Column, reference: F.Column, floor: F.Column, tolerance: float) -> F.Column:
    """Within tolerance of the reference; without one, not below the floor."""
    return F.when(F.when(reference.isNotNull(), F.abs(value - reference) <= tolerance).otherwise(value >= floor), "PASA").otherwise("FALLA")
