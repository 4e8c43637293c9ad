"""One object that builds everything from validated settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.config import SPLITS, Settings
from lamina.functions.images import Hasher
from lamina.operators import extraction, metrics
from lamina.operators.dedup import deduplicate
from lamina.operators.sampling import sample
from lamina.sources import sinks
from lamina.sources.clips import ClipSource

from .curation import Curated, curate


class Engine:
    """Engine(spark).curate(frames) and so on, by settings (default: those of the session)."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None) -> None:
        self.spark, self.settings = spark, settings or Settings.from_conf(spark)
        self.hasher = Hasher(self.settings.hash_algorithm, self.settings.hash_size)

    def clips(self, *paths: str, fps: float = 0.0) -> DataFrame:
        self.spark.dataSource.register(ClipSource)
        return self.spark.read.format("clip").option("paths", ",".join(paths)).option("fps", str(fps)).load()

    def sample(self, frames: DataFrame, **how) -> DataFrame:
        return sample(frames, self.settings.sampler(), **how)

    def extract(self, decoded: DataFrame, live: bool = False) -> DataFrame:
        return extraction.extract(decoded, config=self.settings.sampler(), hasher=self.hasher, max_frames=self.settings.live_max_frames if live else None)

    def deduplicate(self, frames: DataFrame) -> DataFrame:
        return deduplicate(frames, max_distance=self.settings.dedup_max_distance)

    def curate(self, frames: DataFrame, strategy: str | None = None, dedup_splits=SPLITS) -> Curated:
        s = self.settings
        return curate(frames, strategy=strategy or s.split_strategy, seed=s.seed, max_distance=s.dedup_max_distance, defect_val_fraction=s.defect_val_fraction, dedup_splits=dedup_splits)

    def write_manifest(self, curated: Curated, name: str, strategy: str | None = None) -> str:
        path = f"{self.settings.storage_root}/{name}"
        sinks.write_manifest(curated.manifest, path, strategy=strategy or self.settings.split_strategy, seed=self.settings.seed)
        return path

    def evaluate(self, scored: DataFrame) -> DataFrame:
        """threshold calibrated on val, and counts and rates on test at it: scored has split, score, y."""
        best = metrics.calibrate_f1(scored.where("split = 'val'"), split="val")
        test = scored.where("split = 'test'").crossJoin(best.select("threshold"))
        return metrics.rates(metrics.confusion(test, test["threshold"], by=("threshold",)))
