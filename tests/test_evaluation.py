import itertools
import math

import numpy as np
import pytest

from lamina.operators import arms, metrics, statistics
from lamina.plans import views


def scores(spark, s, y):
    return spark.createDataFrame(list(zip(range(len(s)), map(float, s), map(bool, y), strict=True)), "key long, score double, y boolean")


def brute(s, y):
    pos, neg = [a for a, b in zip(s, y, strict=True) if b], [a for a, b in zip(s, y, strict=True) if not b]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)


@pytest.mark.parametrize("buckets", [0, 4])
def test_auroc(spark, buckets):
    rng = np.random.default_rng(0)
    for s, y in (([0.1, 0.4, 0.35, 0.8], [0, 0, 1, 1]), ([1, 1, 1, 1], [0, 1, 0, 1]), (rng.integers(0, 9, 200), rng.random(200) < 0.2)):
        assert metrics.auroc(scores(spark, s, y), buckets=buckets).first()["auroc"] == pytest.approx(brute(s, y))
    assert metrics.auroc(scores(spark, [1, 2], [1, 1])).first()["auroc"] is None
    with pytest.raises(ValueError):
        metrics.strict_auroc(scores(spark, [1, 2], [1, 1]))
    with pytest.raises(Exception, match="finite"):
        metrics.strict_auroc(scores(spark, [1, math.nan], [1, 0]))


@pytest.mark.parametrize("buckets", [0, 4])
def test_calibration(spark, buckets):
    s = scores(spark, [0.05, 0.10, 0.15, 0.60, 0.70, 0.80], [0, 0, 0, 1, 1, 1])
    best = metrics.calibrate_f1(s, split="val", buckets=buckets).first()
    assert (best["threshold"], best["f1_on_val"], best["candidates"]) == (0.6, 1.0, 6)
    with pytest.raises(ValueError, match="val only"):
        metrics.calibrate_f1(s, split="test")
    counts = metrics.rates(metrics.confusion(s, 0.6)).first()  # the threshold itself is an alarm
    assert (counts["tp"], counts["fp"], counts["tn"], counts["fn"], counts["f1"]) == (3, 0, 3, 0, 1.0)
    tie = scores(spark, [1, 2, 3], [0, 1, 0])
    rows = [(t, metrics.rates(metrics.confusion(tie, t)).first()["f1"]) for t in (1.0, 2.0, 3.0)]
    assert metrics.calibrate_f1(tie, split="val").first()["threshold"] == min(t for t, f in rows if f == max(f for _, f in rows))


def test_ranks_and_effects(spark):
    a, b = [0.9, 0.8, 0.7, 0.6, 0.5], [0.5, 0.8, 0.6, 0.65, 0.1]
    p = spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "contrast long, replicate long, treatment double, control double")
    assert statistics.cliffs_delta(p, ("contrast",)).first()["cliffs_delta"] == pytest.approx(np.mean([np.sign(x - y) for x in a for y in b]))
    d = np.array(a) - np.array(b)
    d = d[np.abs(d) > 1e-12]
    r = statistics.ranks(np.abs(d))
    assert statistics.rank_biserial(p, ("contrast",)).first()["rank_biserial"] == pytest.approx((r[d > 0].sum() - r[d < 0].sum()) / r.sum())
    whole = statistics.compare(p, "contrast", n_bootstrap=200).first()
    assert whole["n"] == 5 and whole["ci_low"] <= whole["mean_difference"] <= whole["ci_high"]
    with pytest.raises(Exception, match="missing"):
        statistics.paired(p.select("replicate", "treatment"), p.where("replicate < 4").select("replicate", p["control"].alias("treatment")), ["replicate"], "treatment").collect()


def test_holm(spark):
    t = spark.createDataFrame([(0, 0.01), (1, 0.02), (2, 0.03)], "id long, p_value double")
    assert [r["p_corrected"] for r in statistics.holm(t, key=("id",)).orderBy("id").collect()] == pytest.approx([0.03, 0.04, 0.04])
    with pytest.raises(Exception, match="outside"):
        statistics.holm(spark.createDataFrame([(0, 1.5)], "id long, p_value double")).collect()


def test_exact_tests():
    x = np.arange(6.0)
    assert statistics.spearman(x, x)[:2] == (pytest.approx(1.0), pytest.approx(2 / 720))
    assert statistics.spearman(x[:5], x[:5])[1] == pytest.approx(2 / 120)
    y = np.array([1, 3, 2, 2, 5])
    rho = statistics.spearman(x[:5], y)[0]
    a, b = statistics.ranks(x[:5]), statistics.ranks(y)
    a, b = a - a.mean(), b - b.mean()
    n = math.sqrt((a @ a) * (b @ b))
    share = np.mean([abs(a @ b[list(o)]) / n >= abs(rho) - 1e-12 for o in itertools.permutations(range(5))])
    assert statistics.spearman(x[:5], y)[1] == pytest.approx(share)
    rng = np.random.default_rng(0)
    d = rng.normal(size=9)
    r = statistics.ranks(np.abs(d))
    plus = r[d > 0].sum()
    all_sums = [sum(c) for k in range(10) for c in itertools.combinations(r, k)]
    want = np.mean([abs(s - r.sum() / 2) >= abs(plus - r.sum() / 2) - 1e-9 for s in all_sums])
    assert statistics.wilcoxon_p(d) == pytest.approx(want)
    assert statistics.wilcoxon_p(np.zeros(5)) == 1.0
    # t distribution with 28 degrees of freedom, by integration
    rho, p, exact = statistics.spearman(np.arange(30.0), np.arange(30.0) + 9 * np.sin(np.arange(30)))
    t = rho * math.sqrt(28 / (1 - rho * rho))
    xs = np.linspace(t, t + 400, 4_000_001)
    density = np.exp(math.lgamma(14.5) - math.lgamma(14)) / math.sqrt(28 * math.pi) * (1 + xs * xs / 28) ** -14.5
    assert not exact and p == pytest.approx(2 * np.trapezoid(density, xs), rel=1e-3)
    low, high = statistics.bootstrap_ci(np.array([0.1, 0.2, 0.3]), 1000)
    assert 0.1 <= low <= high <= 0.3
    with pytest.raises(ValueError):
        statistics.bootstrap_ci(np.ones(3), 10)


def test_arms(spark):
    rows = [(f"p{g}/{i}", f"p{g}", "normal", i) for g in range(20) for i in range(4)] + [(f"d{k}", f"d{k}", "defect", 0) for k in range(10)]
    f = spark.createDataFrame(rows, "path string, group_id string, label string, frame_index long")
    a = arms.leaked_arms(f, seeds=[0], doses=[0.0, 0.1, 0.2]).cache()
    tests = {(r["dose"], r["arm"]): set(r["s"]) for r in a.where("split = 'test'").groupBy("dose", "arm").agg({"path": "collect_set"}).withColumnRenamed("collect_set(path)", "s").collect()}
    assert len({frozenset(s) for s in tests.values()}) == 1 and len(tests) == 6
    sizes = {(r["dose"], r["arm"]): r for r in arms.arm_sizes(a).collect()}
    assert len({r["n_train"] for r in sizes.values()}) == 1
    assert [sizes[d, "leaked"]["n_leaked"] for d in (0.0, 0.1, 0.2)] == [0, 5, 10] and sizes[0.2, "clean"]["n_leaked"] == 0
    assert a.where("arm = 'leaked' AND split = 'train' AND frame_index = 0").join(a.where("split = 'test'").select("path"), "path").isEmpty()
    assert arms.clean_minus_leaked(a).groupBy("dose").count().count() == 2
    with pytest.raises(Exception, match="near-duplicates"):
        arms.leaked_arms(f, seeds=[0], doses=[0.9]).collect()


def test_replicates_round_exact_means(spark, tmp_path):
    """Means that lie halfway are rounded as such, whatever the order of rows; values that are no short decimals keep doubles."""
    rng = np.random.default_rng(0)
    halfway = [0.07, 89.93, 0.29, 89.71, 0.57, 89.43, 1.13, 88.87, 12.34, 77.66, 33.31, 56.69, 45.0]  # their mean is 45
    users = [rng.permutation(halfway).tolist() for _ in range(40)]
    odd = {40: [-45.0], 41: [1 / 3], 42: [1e20], 43: [math.nan], 44: [44.9999999999999], 45: [None, 5.0], 46: [None]}
    rows = [(u, k, v) for u, values in [*enumerate(users), *odd.items()] for v in values for k in ("click", "view")] + [(47, "click", 1.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert any(np.cumsum(x)[-1] / 13 < 45 for x in users)
    want = {**dict.fromkeys(range(40), 5.0), 40: -5.0, 41: 0.0, 42: 1e19, 44: 4.0, 45: 1.0}
    got = {r["replicate"]: (r["contrast"], r["treatment"], r["control"]) for r in views.replicates(spark, str(tmp_path)).collect()}
    assert all(map(math.isnan, got.pop(43)[1:]))
    assert got == {u: (u % 4, x, x) for u, x in want.items()}
