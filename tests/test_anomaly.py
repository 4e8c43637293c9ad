import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import anomaly, splitting
from lamina.plans import catalogue, views

SF = "/root/testdata/sf0.001"


def parts(spark):
    """The manifest of the queries, and its normal training vectors in the order in which they are chosen from."""
    m = splitting.split_by_group(views.vectors(spark, SF)).cache()
    train = m.where("split = 'train' AND label = 'normal'").orderBy(F.xxhash64("path"), "path").collect()
    return m, np.array([r["vector"] for r in train], np.float64)


def auroc(scored):
    bad, good = ([s for s, y in scored if y == want] for want in (True, False))
    return round(sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / len(bad) / len(good), 6)


def rows(m, scored):
    test = {r["path"]: (np.array(r["vector"], np.float64), r["label"] == "defect") for r in m.where("split = 'test'").collect()}
    got = {r["path"]: r["score"] for r in scored.where("split = 'test'").collect()}
    assert got.keys() == test.keys()
    return test, got


def test_memory_against_brute_force(spark):
    m, train = parts(spark)
    memory = [train[0]]
    while len(memory) < max(1, round(len(train) * 0.1)):
        memory.append(max(train, key=lambda v: min(np.linalg.norm(v - x) for x in memory)))
    model = anomaly.NearestMemory.fit(m)
    assert np.array_equal(model.memory, np.array(memory))
    assert model.saved(spark).count() == len(memory)
    test, got = rows(m, model.scores(m))
    want = {p: min(np.linalg.norm(v - x) for x in memory) for p, (v, _) in test.items()}
    assert got == pytest.approx(want, abs=1e-6)
    found = catalogue.QUERIES["anomaly_memory_auroc"](spark, SF).collect()
    assert [r["auroc"] for r in found] == [auroc([(want[p], y) for p, (_, y) in test.items()])]


def test_mahalanobis_against_brute_force(spark):
    m, train = parts(spark)
    precision = np.linalg.inv(np.cov(train.T) + 0.01 * np.eye(train.shape[1]))
    test, got = rows(m, anomaly.Mahalanobis.fit(m).scores(m))
    want = {p: float(np.sqrt((v - train.mean(0)) @ precision @ (v - train.mean(0)))) for p, (v, _) in test.items()}
    assert got == pytest.approx(want, rel=1e-6)
    found = catalogue.QUERIES["anomaly_mahalanobis_auroc"](spark, SF).collect()
    assert [r["auroc"] for r in found] == [auroc([(want[p], y) for p, (_, y) in test.items()])]


def test_no_normal_training_rows(spark):
    m, _ = parts(spark)
    for kind in (anomaly.NearestMemory, anomaly.Mahalanobis):
        with pytest.raises(ValueError, match="no normal rows"):
            kind.fit(m.where("split = 'test'"))
