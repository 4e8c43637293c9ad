"""Paired statistics of experiment arms.

Input is long: `by` (a contrast, such as the dose), a replicate key, treatment and control. Everything that is
a sum, a rank or a window stays in Spark, one contrast a partition key; resampling and exact permutation
tests run in numpy, a contrast at a time (its replicates are few by nature).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import mid_ranks

# Limits of the size of an effect, each belongs to the size above it; and the sizes' names.
NEGLIGIBLE, SMALL, MEDIUM = 0.147, 0.33, 0.474
MAGNITUDES = ("despreciable", "pequeno", "mediano", "grande")
#: Exact permutation tests up to so many points.
MAX_EXACT = 10
#: The exact signed-rank distribution without ties up to so many differences; with ties up to MAX_SIGN_FLIPS.
MAX_EXACT_RANKS, MAX_SIGN_FLIPS = 50, 13


def paired(treatment: DataFrame, control: DataFrame, on: list[str], value: str) -> DataFrame:
    """on, treatment, control; an error for a replicate that one side lacks, or a value that is not finite."""
    a = treatment.select(*on, F.col(value).cast("double").alias("treatment"))
    b = control.select(*on, F.col(value).cast("double").alias("control"))
    joined = a.join(b, on, "full")
    bad = F.lit(False)
    for c in ("treatment", "control"):
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return joined.withColumn("treatment", F.when(bad, F.raise_error(F.lit("a replicate is missing or not finite"))).otherwise(F.col("treatment")))


def differences(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("d", F.col("treatment").cast("double") - F.col("control").cast("double"))


def paired_difference(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, mean_difference, median_difference."""
    return differences(pairs).groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), F.percentile("d", F.lit(0.5)).alias("median_difference"))


def rank_biserial(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, rank_biserial: (positive - negative rank sums) / all rank sums of non-zero differences; 0 without any."""
    d = differences(pairs).withColumn("abs_", F.abs("d"))
    ranked = mid_ranks(d.where("d <> 0"), "abs_", by)
    share = ranked.groupBy(*by).agg((F.sum(F.signum("d") * F.col("mid_rank")) / F.sum("mid_rank")).alias("r_"))
    groups = pairs.groupBy(*by).agg(F.count("*").alias("n_"))
    joined = groups.join(share, list(by), "left") if by else groups.crossJoin(share)
    return joined.select(*by, F.coalesce("r_", F.lit(0.0)).alias("rank_biserial"))


def cliffs_delta(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, cliffs_delta: the mean sign of treatment - control over all pairs of replicates, from ranks: the mean of
    2 * (mid-rank of a treatment among both - its rank among treatments) / controls - 1. No pairs are formed."""
    both = pairs.select(*by, F.explode(F.array(F.struct(F.col("treatment").alias("v"), F.lit(True).alias("t")), F.struct(F.col("control").alias("v"), F.lit(False).alias("t")))).alias("x")).select(*by, "x.v", "x.t")
    ranked = mid_ranks(both, "v", by)
    p, q = F.count_if("t").cast("double"), F.count_if(~F.col("t")).cast("double")
    u = F.sum(F.when(F.col("t"), F.col("mid_rank")).otherwise(0.0)) - p * (p + 1) / 2
    return ranked.groupBy(*by).agg((F.lit(2.0) * u / (p * q) - 1).alias("cliffs_delta"))


def holm(tests: DataFrame, p: str = "p_value", key: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """tests with p_corrected: in ascending order of p the running maximum of p * (m - i), at most 1. A p-value
    outside [0, 1] is an error."""
    order = Window.partitionBy(*by).orderBy(p, *key)
    m, i = F.count("*").over(Window.partitionBy(*by)), F.row_number().over(order)
    value = F.when((F.col(p) >= 0) & (F.col(p) <= 1) & ~F.isnan(p), F.col(p)).otherwise(F.raise_error(F.lit("a p-value is outside [0, 1]")))
    scaled = tests.withColumn("scaled_", value * (m - i + 1))
    return scaled.withColumn("p_corrected", F.least(F.lit(1.0), F.max("scaled_").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("scaled_")


def spearman_rho(points: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, rho on mid-ranks; 0 if a side is constant."""
    ranked = mid_ranks(mid_ranks(points, x, by, "rx_"), y, by, "ry_")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.nanvl(F.corr("rx_", "ry_"), F.lit(0.0)), F.lit(0.0)).alias("rho"))


def magnitude(r: F.Column | str) -> F.Column:
    """The name of an effect's size."""
    a = F.abs(r)
    return F.when(a < NEGLIGIBLE, MAGNITUDES[0]).when(a < SMALL, MAGNITUDES[1]).when(a < MEDIUM, MAGNITUDES[2]).otherwise(MAGNITUDES[3])


def significant(p: F.Column | str, mean_difference: F.Column | str, alpha: float = 0.05, min_effect: float = 0.0) -> F.Column:
    """Significant, and large enough to matter."""
    p = F.col(p) if isinstance(p, str) else p
    return (p < alpha) & (F.abs(mean_difference) >= min_effect)


def min_achievable_p(n: F.Column | str) -> F.Column:
    """The smallest exact p-value that n points can give; 0 beyond exact tests."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n > MAX_EXACT, F.lit(0.0)).otherwise(F.lit(2.0).cast("double") / F.factorial(n))


# ---------------------------------------------------------------- numpy kernels


def ranks(values: np.ndarray) -> np.ndarray:
    """Mid-ranks from 1."""
    _, back, n = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2.0)[back]


def bootstrap_ci(d: np.ndarray, n_bootstrap: int = 10_000, seed: int = 0) -> tuple[float, float]:
    """Percentile interval (95 %) of the mean by resampling with replacement."""
    if n_bootstrap < 100:
        raise ValueError("n_bootstrap must be 100 or more")
    rng = np.random.default_rng(seed)
    at_once = max(1, (1 << 22) // max(1, len(d)))  # replicates drawn at a time: 32 MB
    means = np.concatenate([rng.choice(d, size=(min(at_once, n_bootstrap - k), len(d)), replace=True).mean(axis=1) for k in range(0, n_bootstrap, at_once)])
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)


def wilcoxon_p(d: np.ndarray) -> float:
    """Two-sided signed-rank p-value, zero differences dropped; 1 if none is left.

    Without ties the exact distribution of the rank sum, by counting subsets, up to MAX_EXACT_RANKS; with ties all sign
    flips up to MAX_SIGN_FLIPS differences; otherwise the normal approximation with tie correction.
    """
    d = np.asarray(d, np.float64)
    n_all = len(d)
    d = d[d != 0]
    n = len(d)
    if not n:
        return 1.0
    r = ranks(np.abs(d))
    plus = float(r[d > 0].sum())
    total = n * (n + 1) / 2
    tied = len(np.unique(r)) < n or n < n_all
    if not tied and n <= MAX_EXACT_RANKS:
        ways = np.zeros(int(total) + 1)
        ways[0] = 1.0
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        cdf = np.cumsum(ways) / 2.0**n
        low = min(plus, total - plus)
        return float(min(1.0, 2.0 * cdf[int(low)]))
    if n <= MAX_SIGN_FLIPS:
        sums = np.zeros(1)
        for x in r:
            sums = np.concatenate([sums, sums + x])
        return float((np.abs(sums - total / 2) >= abs(plus - total / 2) - 1e-9).mean())
    _, counts = np.unique(r, return_counts=True)
    variance = n * (n + 1) * (2 * n + 1) / 24 - (counts.astype(float) ** 3 - counts).sum() / 48
    z = (plus - total / 2) / math.sqrt(variance)
    return float(math.erfc(abs(z) / math.sqrt(2)))


def spearman(x: np.ndarray, y: np.ndarray) -> tuple[float, float, bool]:
    """(rho, p, whether p is exact): the share of all permutations at least as extreme, up to MAX_EXACT points;
    beyond, the t approximation."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    if len(x) != len(y) or len(x) < 3:
        raise ValueError("three points or more are needed, as many of x as of y")
    a, b = ranks(x), ranks(y)
    a, b = a - a.mean(), b - b.mean()
    norm = math.sqrt(float((a * a).sum() * (b * b).sum()))
    rho = float((a * b).sum() / norm) if norm else 0.0
    n = len(x)
    if n <= MAX_EXACT:
        return rho, _permutation_p(a, b, norm, rho), True
    if abs(rho) >= 1:
        return rho, 0.0, False
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return rho, _beta_inc((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2)), False


def _permutation_p(a: np.ndarray, b: np.ndarray, norm: float, rho: float) -> float:
    """All orders of b, built one place at a time: sums so far by the set of places used, in numpy batches."""
    n, limit = len(a), abs(rho) - 1e-12
    if not norm:
        return 1.0
    states = {0: np.zeros(1)}
    for i in range(n):
        following: dict[int, list[np.ndarray]] = {}
        for used, sums in states.items():
            for j in range(n):
                if not used >> j & 1:
                    following.setdefault(used | 1 << j, []).append(sums + a[i] * b[j])
        states = {k: np.concatenate(v) for k, v in following.items()}
    sums = states[(1 << n) - 1]
    return float((np.abs(sums / norm) >= limit).mean())


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = out
        for k in (even, odd):
            d, c = 1.0 / (1.0 + k * d), 1.0 + k / c
            out *= c * d
        if abs(out - before) <= 1e-15 * abs(out):
            break
    return front * out


# ---------------------------------------------------------------- whole comparisons

_COMPARED = "n long, mean_difference double, median_difference double, ci_low double, ci_high double, p_value double"


def compare(pairs: DataFrame, by: str, *, n_bootstrap: int = 10_000, seed: int = 0) -> DataFrame:
    """by, n, mean_difference, median_difference, ci_low, ci_high, p_value, rank_biserial, cliffs_delta,
    effect_magnitude. Fewer than two replicates are an error."""
    kind = pairs.schema[by].dataType.simpleString()

    def run(key, rows):
        import pandas as pd

        d = (rows["treatment"].astype(float) - rows["control"].astype(float)).to_numpy()
        if len(d) < 2:
            raise ValueError("two replicates or more are needed")
        low, high = bootstrap_ci(d, n_bootstrap, seed)
        return pd.DataFrame([[key[0], len(d), d.mean(), float(np.median(d)), low, high, wilcoxon_p(d)]])

    order = [c for c in ("seed", "replicate") if c in pairs.columns]
    ordered = pairs.select(by, *order, "treatment", "control")

    def sorted_run(key, rows):
        return run(key, rows.sort_values(order) if order else rows)

    found = ordered.groupBy(by).applyInPandas(sorted_run, f"{by} {kind}, {_COMPARED}")
    found = found.join(rank_biserial(pairs, (by,)), by).join(cliffs_delta(pairs, (by,)), by)
    return found.withColumn("effect_magnitude", magnitude("rank_biserial"))


def equivalence(compared: DataFrame, margin: float) -> DataFrame:
    """compared with margin, is_equivalent (the interval lies in [-margin, margin]) and is_inconclusive."""
    if margin <= 0:
        raise ValueError("margin must be positive")
    inside = (F.col("ci_low") >= -margin) & (F.col("ci_high") <= margin)
    return compared.withColumn("margin", F.lit(float(margin))).withColumn("is_equivalent", inside).withColumn("is_inconclusive", ~inside & (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))


def monotonicity(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """by, n, rho, p_value, exact, min_achievable_p of the rank correlation of x and y."""
    kind = points.schema[by].dataType.simpleString()

    def run(key, rows):
        import pandas as pd

        rho, p, exact = spearman(rows[x].to_numpy(float), rows[y].to_numpy(float))
        return pd.DataFrame([[key[0], len(rows), rho, p, exact]])

    found = points.select(by, x, y).groupBy(by).applyInPandas(run, f"{by} {kind}, n long, rho double, p_value double, exact boolean")
    return found.withColumn("min_achievable_p", min_achievable_p("n"))
