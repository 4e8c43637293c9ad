"""Writers: manifests, frames, artifacts, append-only records, result archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import keys
from lamina.functions.images import array_of, png_bytes
from lamina.operators import frames as fr
from lamina.operators import leakage


def write_manifest(manifest: DataFrame, path: str, *, strategy: str, seed: int, metadata: dict[str, str] | None = None) -> None:
    """Explicit rows, partitioned by split, and one metadata row with counts and the leakage audit."""
    names = [f.name for f in fr.FRAME_SCHEMA]
    manifest.select(*names, "split").write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    rows = manifest.sparkSession.read.parquet(f"{path}/rows")  # audit what was written
    counts = fr.split_counts(rows).agg(F.map_from_entries(F.collect_list(F.struct("split", "n_frames"))).alias("frame_counts"), F.map_from_entries(F.collect_list(F.struct("split", "n_groups"))).alias("group_counts"))
    found = leakage.payload(rows).select(F.struct("shared_train_test", "shared_train_val", "contaminated", "normal_test", "total", "fraction").alias("leakage"))
    entries = [F.lit(x) for kv in (metadata or {}).items() for x in kv]
    meta = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    counts.crossJoin(found).select(F.lit(strategy).alias("strategy"), F.lit(seed).cast("long").alias("seed"), meta.alias("metadata"), "frame_counts", "group_counts", "leakage").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def write_frames(frames: DataFrame, path: str) -> None:
    """path and a lossless PNG of each frame, as a table; keys must stay under the root."""

    @F.pandas_udf("binary")
    def png(images):
        import pandas as pd

        return pd.Series([png_bytes(array_of(h, w, c, d)) for h, w, c, d in zip(images["height"], images["width"], images["nChannels"], images["data"], strict=True)])

    frames.select(keys.safe_key("path").alias("path"), png("image").alias("content")).write.mode("append").parquet(path)


def put_artifacts(rows: DataFrame, path: str) -> None:
    """key, content rows, appended; keys must stay under the root."""
    rows.select(keys.safe_key("key").alias("key"), "content").write.mode("append").parquet(path)


def append_records(rows: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    rows.write.mode("append").json(path)


def archive(rows: DataFrame, path: str) -> None:
    """A result archive: nested rows as JSON, replaced as a whole."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def materialise(frames: DataFrame, path: str) -> None:
    """Near-duplicates, written once: an existing table is left as it is."""
    frames.write.mode("ignore").parquet(path)
