import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.config import SamplerConfig
from lamina.operators import frames as fr
from lamina.operators import sampling
from lamina.streaming.sampler import run_to_end, sample_stream


def rule(xs, c):
    ref, since, out = None, 0, []
    for x in xs:
        if ref is None:
            keep = True
        else:
            since += 1
            keep = since >= c.min_interval and ((c.max_interval is not None and since >= c.max_interval) or abs(x - ref) >= c.min_difference)
        if keep:
            ref, since = x, 0
        out.append(keep)
    return out


@pytest.mark.parametrize("config", [SamplerConfig(0.1, 1, 9), SamplerConfig(0.3, 3, None), SamplerConfig(1.0, 1, 5), SamplerConfig(0.0, 2, 90)])
def test_batch_equals_rule(spark, config):
    rng = np.random.default_rng(0)
    data = {g: rng.random(50).round(3).tolist() for g in ("a", "b")}
    t = spark.createDataFrame([(g, i, x) for g, xs in data.items() for i, x in enumerate(xs)], "group_id string, frame_index long, signal double")
    got = sampling.sample(t, config, signal="signal").orderBy("group_id", "frame_index").collect()
    assert [r["kept"] for r in got] == [k for g in ("a", "b") for k in rule(data[g], config)]


def test_vectors(spark):
    t = spark.createDataFrame([("g", 0, [0.0, 0.0]), ("g", 1, [5.0, 5.0]), ("g", 2, [10.0, 10.0])], "group_id string, frame_index long, thumb array<float>")
    assert [r["kept"] for r in sampling.sample(t, SamplerConfig(0.03)).orderBy("frame_index").collect()] == [True, False, True]
    assert sampling.stats(sampling.sample(t, SamplerConfig(0.03))).first()["retained_fraction"] == 0.666667


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    config = SamplerConfig(0.2, 2, 7)
    t = spark.createDataFrame([(g, i, float(x)) for g in "abc" for i, x in enumerate(rng.random(40).round(3))], "group_id string, frame_index long, signal double")
    for k in range(2):
        t.where(F.floor(F.col("frame_index") / 20) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run_to_end(sample_stream(stream, config, signal="signal"), f"{tmp_path}/out", f"{tmp_path}/state")
    want = sampling.sample(t, config, signal="signal").select("group_id", "frame_index", "kept")
    assert got.count() == 120 and got.exceptAll(want).isEmpty()
    # a frame that comes late is reported and changes nothing
    spark.createDataFrame([("a", 3, 0.5)], t.schema).write.mode("append").parquet(f"{tmp_path}/in")
    again = run_to_end(sample_stream(stream, config, signal="signal"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert again.where("kept IS NULL").count() == 1 and again.count() == 121


def test_caps_and_warm_up(frames):
    assert fr.capped(frames, 10).count() == 450
    assert fr.systematic(frames).count() == 45 * 3
    assert fr.after_warm_up(frames).groupBy("group_id").count().first()["count"] == 26
    assert fr.after_warm_up(frames.where("frame_index < 3")).count() == 45 * 3


def test_config():
    for bad in ({"min_difference": -1}, {"min_interval": 0}, {"max_interval": 0}, {"thumbnail": 7}):
        with pytest.raises(ValueError):
            SamplerConfig(**bad)
