import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.config import JitterConfig, Settings
from lamina.functions import images as im
from lamina.functions import keys
from lamina.operators import extraction, lookups, quality
from lamina.plans.engine import Engine
from lamina.sources import images, records, sinks


def png_tree(root):
    rng = np.random.default_rng(0)
    for part, sub, n in (("train", "good", 4), ("test", "good", 2), ("test", "scratch", 2)):
        for i in range(n):
            p = root / "cat" / part / sub
            p.mkdir(parents=True, exist_ok=True)
            (p / f"{i:03d}.png").write_bytes(im.png_bytes(rng.integers(0, 255, (64, 64, 3), dtype=np.uint8)))


def test_image_folder(spark, tmp_path):
    png_tree(tmp_path)
    listed = images.list_images(spark, str(tmp_path))
    c = images.census(listed, "cat").first()
    assert (c["train_normal"], c["test_normal"], c["test_defect"], c["defect_types"], c["is_usable"]) == (4, 2, 2, ["scratch"], True)
    m = images.official_manifest(listed, "cat")
    assert m.count() == 8 and m.select("group_id").distinct().count() == 8 and m.where("split = 'val'").isEmpty()
    read = images.read_images(spark, str(tmp_path))
    q = read.select(im.quality_of(F.col("image")).alias("q")).select("q.*").toPandas()
    assert ((q.brightness > 0.4) & (q.brightness < 0.6)).all()
    h = read.select(im.Hasher("phash")("image").alias("phash"))
    assert h.distinct().count() == 8


def test_png_is_bgr(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(im.png_bytes(np.full((3, 5, 3), (30, 20, 10), np.uint8)))
    row = images.read_images(spark, str(tmp_path)).first()["image"]
    assert (row["height"], row["width"]) == (3, 5) and bytes(row["data"][:3]) == bytes((30, 20, 10))


@pytest.mark.parametrize("name", ["ahash", "phash", "dhash", "whash"])
def test_hashes(name):
    rng = np.random.default_rng(1)
    base = np.kron(rng.integers(0, 255, (8, 8)), np.ones((16, 16))).astype(np.uint8)
    image = np.stack([base] * 3, -1)
    near = im.jitter(image, 5, JitterConfig(0.005, 0.3, 0.005, 0.02, 1.0))
    other = np.stack([np.kron(rng.integers(0, 255, (8, 8)), np.ones((16, 16))).astype(np.uint8)] * 3, -1)
    bits = [im.hash_bits(x, name, 8) for x in (image, near, other)]
    assert len(bits[0]) == 64 and (bits[0] != bits[1]).sum() < (bits[0] != bits[2]).sum()
    assert len(im.pack(im.hash_bits(image, name, 16))) == 4
    with pytest.raises(ValueError):
        im.Hasher("nohash")
    with pytest.raises(ValueError):
        im.Hasher("whash", 6)


def test_jitter_repeats_itself():
    image = np.random.default_rng(2).integers(0, 255, (40, 40, 3), dtype=np.uint8)
    assert (im.jitter(image, 1) == im.jitter(image, 1)).all() and (im.jitter(image, 1) != im.jitter(image, 2)).any()
    still = im.jitter(image, 3, JitterConfig(0, 0, 0, 0, 0))
    assert (still == image).all()
    with pytest.raises(ValueError):
        JitterConfig(max_rotation_degrees=30)


def test_clips_and_extraction(spark, tmp_path):
    stack = np.concatenate([np.full((20, 32, 32, 3), v, np.uint8) for v in (10, 120, 240)])
    np.save(tmp_path / "piece-1.npy", stack)
    decoded = Engine(spark, Settings(sampler_max_interval=None)).clips(str(tmp_path / "piece-1.npy")).withColumn("label", F.lit("normal"))
    assert decoded.count() == 60 and decoded.first()["fps"] == 30.0 and not decoded.first()["fps_is_measured"]
    got = extraction.extract(decoded, config=Settings(sampler_max_interval=None).sampler(), max_frames=50).orderBy("frame_index").collect()
    assert [r["frame_index"] for r in got] == [0, 20, 40] and got[1]["path"] == "frames/piece-1/00020.png"
    copies = extraction.near_duplicates(decoded.where("frame_index = 0").select("group_id", "image"), 2)
    assert copies.count() == 3 and copies.select("image.data").distinct().count() == 3


def test_clip_quality(spark):
    rows = [("a", 0.5, 0.0, 0.0, 10.0), ("a", 0.5, 0.0, 0.0, 20.0), ("b", 0.2, 0.1, 0.0, 1.0), ("b", 0.6, 0.0, 0.0, 3.0)]
    c = {r["group_id"]: r for r in quality.clip_quality(spark.createDataFrame(rows, "group_id string, brightness double, clipped_dark double, clipped_bright double, sharpness double")).collect()}
    assert c["a"]["warnings"] == [] and c["a"]["sharpness_median"] == 15.0
    assert c["b"]["warnings"] == ["clipped_dark", "flicker"] and c["b"]["brightness_cv"] == pytest.approx(0.5)
    assert im.laplacian_variance(np.ones((2, 9))) == 0.0


def test_manifest(spark, frames, tmp_path):
    from lamina.operators.splitting import split_by_group

    m = split_by_group(frames)
    sinks.write_manifest(m, f"{tmp_path}/m", strategy="by_group", seed=0, metadata={"a": "b"})
    rows, meta = records.read_manifest(spark, f"{tmp_path}/m")
    assert rows.select("path", "split").exceptAll(m.select("path", "split")).isEmpty() and rows.count() == frames.count()
    head = meta.first()
    assert head["metadata"] == {"a": "b"} and sum(head["frame_counts"].values()) == 1800 and head["leakage"]["fraction"] == 0.0
    (tmp_path / "m.json").write_text(json.dumps({"strategy": "by_group", "seed": 1, "metadata": {}, "assignments": {"train": [{"path": "p", "group_id": "g", "label": "normal", "source_video": "v", "frame_index": 0, "timestamp_s": 0.0}], "val": []}}))
    assert records.read_manifest_json(spark, str(tmp_path / "m.json")).first()["split"] == "train"


def test_records(spark, tmp_path):
    assert records.read_captures(spark, f"{tmp_path}/none.jsonl").isEmpty() and records.read_cache(spark, f"{tmp_path}/none.jsonl").isEmpty()
    (tmp_path / "c.jsonl").write_text('{"clave":"k","auroc":0.5}\n{"clave":"j","auroc":0.1}\n{"clave":"k","auroc":0.9}\n')
    assert {(r["clave"], r["auroc"]) for r in records.read_cache(spark, f"{tmp_path}/c.jsonl").collect()} == {("k", 0.9), ("j", 0.1)}
    sinks.append_records(spark.createDataFrame([("ok-001",), ("ok-007",), ("def-002",)], "piece string"), f"{tmp_path}/log")
    log = spark.read.schema("piece string").json(f"{tmp_path}/log")
    assert {r["next_id"] for r in lookups.next_ids(log, ["ok", "def", "x"]).collect()} == {"ok-008", "def-003", "x-000"}


def test_artifacts_stay_under_root(spark, tmp_path):
    good = spark.createDataFrame([("a/b.bin", b"x")], "key string, content binary")
    sinks.put_artifacts(good, f"{tmp_path}/art")
    for bad in ("../x", "/etc/x", "..\\x", "a/../../x", None):
        with pytest.raises(Exception, match="root"):
            spark.createDataFrame([(bad,)], "key string").select(keys.safe_key("key")).collect()


def test_scores_align_by_path(spark):
    f = spark.createDataFrame([("a",), ("b",)], "path string")
    batches = spark.createDataFrame([(0, ["a", "b"], [0.1, 0.2]), (1, ["b"], [0.9])], "batch long, paths array<string>, scores array<double>")
    got = {r["path"]: r["score"] for r in lookups.aligned_scores(f, lookups.unpacked_batches(batches)).collect()}
    assert got == {"a": 0.1, "b": 0.9}
    with pytest.raises(Exception, match="no score"):
        lookups.aligned_scores(f.union(spark.createDataFrame([("c",)], "path string")), lookups.unpacked_batches(batches)).collect()
    with pytest.raises(Exception, match="more paths"):
        lookups.unpacked_batches(spark.createDataFrame([(0, ["a"], [0.1, 0.2])], batches.schema)).collect()


def test_settings():
    s = Settings.from_env({"LAMINA_SAMPLER_MAX_INTERVAL": "none", "LAMINA_HASH_SIZE": "16", "LAMINA_SAMPLER_MIN_DIFFERENCE": "0.5"})
    assert s.sampler_max_interval is None and s.hash_size == 16 and s.sampler_min_difference == 0.5
    with pytest.raises(ValueError, match="HASH_SIZE|hash_size"):
        Settings.from_env({"LAMINA_HASH_SIZE": "x"})
    for bad in ({"hash_size": 1}, {"dedup_max_distance": 65}, {"live_max_frames": 0}, {"split_strategy": "no"}, {"hash_algorithm": "whash", "hash_size": 6}):
        with pytest.raises(ValueError):
            Settings(**bad)
