import hashlib

import pytest
from pyspark.sql import functions as F

from lamina.config import SplitRatios
from lamina.operators import frames as fr
from lamina.operators import leakage, splitting


def test_group_split_is_clean_and_total(frames):
    m = splitting.split_by_group(frames, seed=3).cache()
    assert m.count() == frames.count()
    assert m.select("path").distinct().count() == frames.count()
    a = leakage.audit(m).first()
    assert a["is_clean"] and a["shared_val_test"] == 0 and a["fraction"] == 0.0
    assert m.where("label = 'defect' AND split = 'train'").isEmpty()
    share = m.where("label = 'normal' AND split = 'train'").count() / frames.where("label = 'normal'").count()
    assert 0.5 <= share <= 0.7
    assert {r["split"] for r in fr.split_counts(m).collect()} == {"train", "val", "test"}


def test_seeds_give_different_splits(frames):
    seen = {tuple(sorted(r["group_id"] for r in fr.groups_of(splitting.split_by_group(frames, seed=s), "train").collect())) for s in range(4)}
    assert len(seen) == 4


def test_naive_split_leaks(frames):
    a = leakage.audit(splitting.split_naive(frames, seed=0)).first()
    assert a["fraction"] > 0.9 and not a["is_clean"]
    with pytest.raises(ValueError, match="shared"):
        leakage.assert_clean(splitting.split_naive(frames))


def test_assignment_is_the_greedy_rule(spark):
    """Against the rule in plain Python, on groups of unequal size."""
    sizes = {f"g{i}": 1 + i * 7 % 23 for i in range(500)}
    goal = {"train": 0.5, "val": 0.25, "test": 0.25}
    groups = spark.createDataFrame(list(sizes.items()), "group_id string, n_frames long")
    got = {r["group_id"]: r["split"] for r in splitting.assign(groups, goal, seed=1).collect()}
    total, held, want = sum(sizes.values()), dict.fromkeys(goal, 0), {}
    for g in sorted(sizes, key=lambda g: (hashlib.sha256(f"1:{g}".encode()).hexdigest(), g)):
        s = max(goal, key=lambda s: goal[s] * total - held[s])
        want[g], held[s] = s, held[s] + sizes[g]
    assert got == want
    assert splitting.assign(groups.limit(0), goal, seed=1).isEmpty()


def test_defect_fraction(frames):
    for split in (splitting.split_by_group, splitting.split_naive):
        for bad in (-0.1, 1.5):
            with pytest.raises(ValueError, match="defect_val_fraction"):
                split(frames, defect_val_fraction=bad)


def test_too_few_groups(frames):
    few = frames.where("group_id IN ('ok-000', 'ok-001')")
    with pytest.raises(Exception, match="three normal groups"):
        splitting.split_by_group(few).collect()
    one_defect = frames.where("label = 'normal' OR group_id = 'def-000'")
    with pytest.raises(Exception, match="empty"):
        splitting.split_by_group(one_defect).collect()
    assert splitting.split_by_group(frames.where("label = 'normal'")).count() == 1200


def test_ratios():
    for bad in ((0.5, 0.2, 0.2), (1.0, 0.0, 0.0)):
        with pytest.raises(ValueError):
            SplitRatios(*bad)


def test_row_constraints(spark, frames):
    bad = spark.createDataFrame([("p", "", "normal", "v", 0, 0.0), ("q", "g", "other", "v", -1, -1.0)], frames.schema)
    assert {len(r["violations"]) for r in fr.invalid(bad).collect()} == {1, 3}
    for row, says in (("p", "group_id"), ("q", "label")):
        with pytest.raises(Exception, match=says):
            fr.checked(bad.where(f"path = '{row}'")).collect()
    mixed = frames.withColumn("label", F.when(F.col("frame_index") == 0, "defect").otherwise(F.col("label")))
    with pytest.raises(Exception, match="more than one label"):
        fr.consistent_groups(mixed).collect()
