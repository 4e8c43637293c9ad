"""Split by a strategy, drop near-duplicates inside each split, audit what is left - in this order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.config import SPLITS, SplitRatios
from lamina.operators import dedup, frames, leakage
from lamina.operators.splitting import STRATEGIES


@dataclass(frozen=True)
class Curated:
    """Lazy tables of a curation."""

    flagged: DataFrame
    """All rows with split and kept."""

    @property
    def manifest(self) -> DataFrame:
        return self.flagged.where("kept").drop("kept")

    def leakage(self) -> DataFrame:
        return leakage.audit(self.manifest)

    def dedup(self, max_distance: int, dedup_splits: Sequence[str]) -> DataFrame:
        """split, max_distance (null where nothing was deduplicated), total, kept, removed, retained_fraction."""
        per = dedup.summary(self.flagged, ("split",))
        return per.withColumn("max_distance", F.when(F.col("split").isin(list(dedup_splits)), F.lit(max_distance)))

    def counts(self) -> DataFrame:
        return frames.split_counts(self.manifest)


def curate(hashed: DataFrame, *, strategy: str = "by_group", seed: int = 0, max_distance: int = 4, ratios: SplitRatios | None = None, defect_val_fraction: float = 0.3, dedup_splits: Sequence[str] = SPLITS) -> Curated:
    """hashed: frame columns and phash. The hash rides in the row, so the only shuffles are the group counts and
    the one by (split, group) of the fold. Splits outside dedup_splits keep all rows."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    manifest = STRATEGIES[strategy](hashed, ratios=ratios or SplitRatios(), seed=seed, defect_val_fraction=defect_val_fraction)
    chosen = F.col("split").isin(list(dedup_splits))
    flagged = dedup.deduplicate(manifest.where(chosen), max_distance=max_distance, by=("split", "group_id"))
    if set(dedup_splits) != set(SPLITS):
        flagged = flagged.unionByName(manifest.where(~chosen).withColumn("kept", F.lit(True)))
    return Curated(flagged)
