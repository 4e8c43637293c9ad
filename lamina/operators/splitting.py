"""Train, validation and test: by group, and row by row as the baseline that leaks.

Shuffles are replaced by the order of a seeded hash (functions.keys.seeded_order), so a split depends on
the seed and the keys alone, on any engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lamina.config import SPLITS, SplitRatios
from lamina.functions.keys import seeded_order

from .frames import consistent_groups


def assign(groups: DataFrame, targets: dict[str, float], seed: int) -> DataFrame:
    """group_id, split for groups (group_id, n_frames): in seeded order each group goes to the split with the
    largest deficit, target * total - assigned so far; ties go to the first split. A split with a positive
    target that stays empty is an error; no groups give no rows.

    The rule is sequential, but its state is a number a split: groups (not rows) are sorted into one partition, on
    disk if need be, and stream through a task that holds no more than those numbers, whatever their count.
    """
    names = [s for s in SPLITS if s in targets]
    goal = [float(targets[s]) for s in names]
    total = groups.agg(F.coalesce(F.sum("n_frames"), F.lit(0)).cast("double").alias("total"))
    ordered = groups.select("group_id", F.col("n_frames").cast("double").alias("n"), seeded_order(seed, "group_id").alias("o")).crossJoin(F.broadcast(total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some = [0.0] * len(names), False
        for b in batches:
            to, some = [], some or b.num_rows > 0
            whole = [t * b.column(3)[0].as_py() for t in goal] if b.num_rows else []
            for n in b.column(1).to_pylist():
                deficit = [w - h for w, h in zip(whole, held, strict=True)]
                k = deficit.index(max(deficit))
                held[k] += n
                to.append(names[k])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(to, pa.string())], names=["group_id", "split"])
        if some and any(t > 0 and not h for t, h in zip(goal, held, strict=True)):
            raise ValueError("a split would be empty: there are too few groups")

    kind = StructType([groups.schema["group_id"], StructField("split", StringType())])
    return ordered.repartition(1).sortWithinPartitions("o", "group_id").mapInArrow(run, kind)


def _fraction(value: float) -> float:
    if not 0.0 <= value <= 1.0:
        raise ValueError("defect_val_fraction must be in [0, 1]")
    return value


def with_assignment(frames: DataFrame, assignment: DataFrame) -> DataFrame:
    """frames with their group's split. The join is on the group; it is broadcast if Spark sees it is small."""
    return frames.join(assignment, "group_id")


def split_by_group(frames: DataFrame, *, ratios: SplitRatios | None = None, seed: int = 0, defect_val_fraction: float = 0.3) -> DataFrame:
    """Normal groups go to train, val and test by ratios; defect groups to val and test only. No group is in
    two splits. Fewer than three normal groups are an error."""
    ratios, defect_val_fraction = ratios or SplitRatios(), _fraction(defect_val_fraction)
    groups = consistent_groups(frames)
    normal = groups.where("label = 'normal'")
    few = normal.agg(F.when(F.count("*") < 3, F.raise_error(F.lit("three normal groups or more are needed"))).otherwise(F.lit(True)).cast("boolean").alias("enough"))
    normal = normal.crossJoin(F.broadcast(few)).where(F.coalesce("enough", F.lit(True)))
    to = assign(normal, {"train": ratios.train, "val": ratios.val, "test": ratios.test}, seed)
    defect = assign(groups.where("label = 'defect'"), {"val": defect_val_fraction, "test": 1.0 - defect_val_fraction}, seed)
    return with_assignment(frames, to.unionByName(defect))


def ranked_by_seed(frames: DataFrame, seed: int | Column, key: str, by: tuple[str, ...], value: Column | None = None) -> DataFrame:
    """frames with rn (position in seeded order, from 1) and total, within `by`, without a task that holds all
    rows: rows are dealt by the order's leading digits, cells are counted, and a row's position is its cell's
    offset plus its position in the cell. With value, rn and total are sums of it, the row's own included."""
    value = F.lit(1) if value is None else value
    rows = frames.withColumn("o_", seeded_order(seed, key)).withColumn("lead_", F.substring("o_", 1, 3)).withColumn("v_", value)
    cells = rows.groupBy(*by, "lead_").agg(F.sum("v_").alias("c_"))
    before = Window.partitionBy(*by).orderBy("lead_").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("b_", F.coalesce(F.sum("c_").over(before), F.lit(0))).withColumn("total", F.sum("c_").over(Window.partitionBy(*by)))
    inner = F.sum("v_").over(Window.partitionBy(*by, "lead_").orderBy("o_", key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("i_", inner).join(F.broadcast(cells.drop("c_")), [*by, "lead_"])  # 4096 cells a value of by
    return placed.withColumn("rn", F.col("b_") + F.col("i_")).drop("o_", "lead_", "i_", "b_", "v_")


def split_naive(frames: DataFrame, *, ratios: SplitRatios | None = None, seed: int = 0, defect_val_fraction: float = 0.3) -> DataFrame:
    """Row by row, whatever the group: normal rows in seeded order, cut at round(n * ratio) (half to even);
    defect rows into val and test. This is the baseline that leaks."""
    ratios, defect_val_fraction = ratios or SplitRatios(), _fraction(defect_val_fraction)
    rows = ranked_by_seed(frames, seed, "path", ("label",))
    n, rn = F.col("total").cast("double"), F.col("rn")
    train, val = F.bround(n * ratios.train), F.bround(n * ratios.val)
    defect = F.bround(n * defect_val_fraction)
    normal_split = F.when(rn <= train, "train").when(rn <= train + val, "val").otherwise("test")
    split = F.when(F.col("label") == "normal", normal_split).otherwise(F.when(rn <= defect, "val").otherwise("test"))
    return rows.withColumn("split", split).drop("rn", "total")


#: Strategies by name: frames -> manifest.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {"by_group": split_by_group, "naive_by_frame": split_naive}
