import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lamina.operators import dedup
from lamina.plans.curation import curate

SCHEMA = "path string, group_id string, label string, source_video string, frame_index long, timestamp_s double, phash long"


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def table(spark, hashes, group=lambda i: "g"):
    return spark.createDataFrame([(f"p{i:05d}", group(i), "normal", "v", i, 0.0, signed(h)) for i, h in enumerate(hashes)], SCHEMA)


def greedy(hashes, d):
    kept, out = [], []
    for h in hashes:
        keep = all(bin(h ^ k).count("1") > d for k in kept)
        out.append(keep)
        if keep:
            kept.append(h)
    return out


def flags(df):
    return [r["kept"] for r in df.orderBy("path").collect()]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, (1 << 64) - 1).map(lambda h: h & 0xF000000000000F0F), min_size=1, max_size=40), st.integers(0, 6))
def test_both_forms_equal_the_greedy_rule(spark, hashes, d):
    t = table(spark, hashes)
    assert flags(dedup.deduplicate(t, max_distance=d)) == flags(dedup.deduplicate_sorted(t, max_distance=d)) == greedy(hashes, d)


def test_not_compared_with_the_frame_before_only(spark):
    a, b = 0, (1 << 20) - 1
    assert flags(dedup.deduplicate(table(spark, [a, b, a, b]), max_distance=4)) == [True, True, False, False]


def test_groups_are_separate_unless_global(spark):
    t = table(spark, [7, 7], lambda i: f"g{i}")
    assert flags(dedup.deduplicate(t, max_distance=0)) == [True, True]
    assert sorted(flags(dedup.deduplicate(t, max_distance=0, within_group=False))) == [False, True]


def test_wide_hashes(spark):
    rows = [("a", "g", "normal", "v", 0, 0.0, [0, 0]), ("b", "g", "normal", "v", 1, 0.0, [0, 3]), ("c", "g", "normal", "v", 2, 0.0, [-1, 0])]
    t = spark.createDataFrame(rows, SCHEMA.replace("phash long", "phash array<long>"))
    assert flags(dedup.deduplicate(t, max_distance=2)) == [True, False, True]


def test_profile_is_monotone(spark):
    rng = random.Random(0)
    hashes = [rng.getrandbits(64) & 0xFFFF for _ in range(60)]
    kept = [r["kept"] for r in dedup.redundancy_profile(table(spark, hashes)).orderBy("max_distance").collect()]
    assert kept == sorted(kept, reverse=True) and len(kept) == 7


def test_pairs_are_all_pairs(spark):
    rng = random.Random(1)
    hashes = [rng.getrandbits(64) & 0xFFFFF for _ in range(50)]
    want = {(f"p{i:05d}", f"p{j:05d}", bin(hashes[i] ^ hashes[j]).count("1")) for i in range(50) for j in range(i + 1, 50) if bin(hashes[i] ^ hashes[j]).count("1") <= 6}
    got = [tuple(r) for r in dedup.hamming_pairs(table(spark, hashes), 6).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pipeline_keeps_one_of_each_orientation(spark):
    rng = random.Random(2)
    rows = []
    for kind, n in (("ok", 8), ("def", 4)):
        for g in range(n):
            for o in range(4):
                h = signed(rng.getrandbits(64))
                rows += [(f"{kind}{g}/{o}/{k}", f"{kind}{g}", "normal" if kind == "ok" else "defect", f"{kind}{g}", o * 10 + k, 0.0, h) for k in range(10)]
    t = spark.createDataFrame(rows, SCHEMA)
    c = curate(t, max_distance=2)
    assert {r["count"] for r in c.manifest.groupBy("group_id").count().collect()} == {4}
    assert c.leakage().first()["is_clean"]
    naive = curate(t, strategy="naive_by_frame", max_distance=2, dedup_splits=("train",))
    assert naive.leakage().first()["fraction"] > 0.9
    d = {r["split"]: r for r in naive.dedup(2, ("train",)).collect()}
    assert d["test"]["max_distance"] is None and d["test"]["retained_fraction"] == 1.0 and d["train"]["max_distance"] == 2
