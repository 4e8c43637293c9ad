import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frames(spark):
    """30 normal and 15 defect pieces of 40 frames each."""
    rows = []
    for kind, n in (("ok", 30), ("def", 15)):
        for g in range(n):
            group = f"{kind}-{g:03d}"
            rows += [(f"frames/{group}/{i:05d}.png", group, "normal" if kind == "ok" else "defect", f"{group}.mp4", i, i / 30) for i in range(40)]
    return spark.createDataFrame(rows, "path string, group_id string, label string, source_video string, frame_index long, timestamp_s double").cache()
