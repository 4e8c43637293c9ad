"""The change-based sampler on a stream.

The rule is that of operators.sampling; the state of a group (last kept signal, frames since, last index) lives in
Spark's state store, so it survives micro-batches and restarts. A stream guarantees no order: within a micro-batch
a group's frames are taken by frame_index, and a frame whose index is not above the last one seen is late - it is
reported with kept = null, and changes nothing. (Order and late frames are this library's own extension.)
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamina.config import SamplerConfig


def sample_stream(frames: DataFrame, config: SamplerConfig | None = None, *, signal: str = "thumb", group: str = "group_id", order: str = "frame_index", scale: float | None = None) -> DataFrame:
    """group, order and kept of each frame of a stream (or of a batch table)."""
    config = config or SamplerConfig()
    kind = frames.schema[signal].dataType
    vector = kind.typeName() == "array"
    scale = scale if scale is not None else 255.0 if vector else 1.0
    group_kind, order_kind = (frames.schema[c].dataType.simpleString() for c in (group, order))

    def step(key: tuple, batches, state: GroupState):
        import pandas as pd

        parts = list(batches)  # one group's rows of one micro-batch
        if not parts:
            return
        rows = pd.concat(parts).sort_values(order, kind="stable")
        ref, since, last = state.get if state.exists else (None, 0, None)
        kept = []
        for at, x in zip(rows[order], rows[signal], strict=True):
            if last is not None and at <= last:
                kept.append(None)
                continue
            last = int(at)
            value = np.asarray(x, np.float64).reshape(-1)
            if ref is None:
                keep = True
            else:
                since += 1
                keep = since >= config.min_interval and (config.max_interval is not None and since >= config.max_interval or np.abs(value - np.asarray(ref)).mean() / scale >= config.min_difference)
            if keep:
                ref, since = value.tolist(), 0
            kept.append(bool(keep))
        state.update((ref, since, last))
        yield pd.DataFrame({group: [key[0]] * len(rows), order: rows[order].to_numpy(), "kept": pd.Series(kept, dtype=object)})

    return frames.select(group, order, signal).groupBy(group).applyInPandasWithState(
        step, outputStructType=f"{group} {group_kind}, {order} {order_kind}, kept boolean", stateStructType="ref array<double>, since int, last long", outputMode="append", timeoutConf=GroupStateTimeout.NoTimeout
    )


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all that is available, append to Parquet at path, and return the table. A restart with the same
    checkpoint goes on where it ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
