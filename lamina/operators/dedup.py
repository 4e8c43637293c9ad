"""Near-duplicates by perceptual hash."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.bits import hamming, hamming_wide

DISTANCES = (0, 2, 4, 6, 8, 10, 12)


def _wide(frames: DataFrame) -> bool:
    return frames.schema["phash"].dataType.typeName() == "array"


def deduplicate(frames: DataFrame, *, max_distance: int | F.Column, by: Sequence[str] = ("group_id",), within_group: bool = True) -> DataFrame:
    """frames with kept: in the order of (source_video, frame_index, path) the first frame is kept, and each
    later one unless a *kept* one is within max_distance bits. Not connected components, and not a comparison
    with the frame before.

    A group's (order, hash) array is folded in one expression; one shuffle by group, and the rest of the row is
    not shuffled twice. within_group=False makes one pool of all rows of each value of the other keys: such a
    fold is sequential by nature and meant for small tables. For groups of very many frames see
    deduplicate_sorted, which holds only what is kept.
    """
    keys = [k for k in by if within_group or k != "group_id"]
    d = F.lit(max_distance) if isinstance(max_distance, int) else max_distance
    far = hamming_wide if _wide(frames) else hamming
    names = frames.columns
    item = F.struct("source_video", "frame_index", "path", F.col("phash").alias("h"), F.struct(*names).alias("row"))
    pool = frames.withColumn("d_", d).groupBy(*(keys or [F.lit(0).alias("pool_")]), "d_").agg(F.array_sort(F.collect_list(item), lambda a, b: _order(a, b)).alias("xs"))
    hashes = F.transform("xs", lambda x: x["h"])
    start = F.struct(F.slice(hashes, 1, 0).alias("kept"), F.lit("").alias("flags"))

    def step(a, x):
        near = F.exists(a["kept"], lambda k: far(k, x) <= F.col("d_"))
        return F.struct(F.when(near, a["kept"]).otherwise(F.array_append(a["kept"], x)).alias("kept"), F.concat(a["flags"], (~near).cast("int").cast("string")).alias("flags"))

    folded = pool.withColumn("flags", F.split(F.aggregate(hashes, start, step)["flags"], ""))  # a character a frame: appending to an array would copy it
    rows = folded.select(F.explode(F.arrays_zip("xs", "flags")).alias("z"))
    return rows.select("z.xs.row.*", (F.col("z.flags") == "1").alias("kept"))


def _order(a, b):
    def compare(x, y):
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    first, second = compare(a["source_video"], b["source_video"]), compare(a["frame_index"], b["frame_index"])
    return F.when(first != 0, first).when(second != 0, second).otherwise(compare(a["path"], b["path"]))


def deduplicate_sorted(frames: DataFrame, *, max_distance: int, by: Sequence[str] = ("group_id",)) -> DataFrame:
    """As deduplicate, for groups of any size: rows are dealt and sorted by Spark (on disk if need be) and
    read as a stream; a task holds the kept hashes of one group. Hashes up to 64 bits."""
    keys = list(by)
    names = [*frames.columns, "kept"]
    schema = frames.schema.add("kept", "boolean")
    at = {c: i for i, c in enumerate(frames.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept, n = None, np.zeros(64, np.uint64), 0
        for b in batches:
            ids = list(zip(*(b.column(at[k]).to_pylist() for k in keys), strict=True))
            flags = []
            for key, h in zip(ids, b.column(at["phash"]).to_numpy().view(np.uint64), strict=True):
                if key != group:
                    group, n = key, 0
                keep = not n or int(np.bitwise_count(kept[:n] ^ h).min()) > max_distance
                if keep:
                    if n == len(kept):
                        kept = np.concatenate([kept, np.zeros(n, np.uint64)])
                    kept[n] = h
                    n += 1
                flags.append(keep)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(flags, pa.bool_())], names=names)

    dealt = frames.repartition(*keys).sortWithinPartitions(*keys, "source_video", "frame_index", "path")
    return dealt.mapInArrow(run, schema)


def summary(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """total, kept, removed, retained_fraction (1.0 if there is nothing; 6 digits)."""
    counts = flagged.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("kept").alias("kept"))
    share = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.round(F.col("kept") / F.col("total").cast("double"), 6))
    return counts.select(*by, "total", "kept", (F.col("total") - F.col("kept")).alias("removed"), share.alias("retained_fraction"))


def redundancy_profile(frames: DataFrame, distances: Sequence[int] = DISTANCES, by: Sequence[str] = ("group_id",)) -> DataFrame:
    """max_distance, total, kept, removed, retained_fraction of each distance: one pass over the rows, each row
    once for every distance."""
    every = frames.withColumn("max_distance", F.explode(F.array(*[F.lit(int(d)) for d in distances])))
    flagged = deduplicate(every, max_distance=F.col("max_distance"), by=["max_distance", *by])
    return summary(flagged, ["max_distance"])


def hamming_pairs(frames: DataFrame, max_distance: int, bits: int = 64) -> DataFrame:
    """path_a, path_b, distance of all pairs within max_distance, found through bands: the hash is cut into
    max_distance + 1 bands, and two hashes within the distance agree in one of them at least. The pair is
    reported in the first band that agrees, so no distinct is needed."""
    n = max_distance + 1
    cut = [bits * i // n for i in range(n + 1)]
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("phash", a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1).cast("bigint")).alias("v")) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))])
    keyed = frames.select("path", "phash", F.explode(bands).alias("band"))
    a = keyed.select(F.col("path").alias("path_a"), F.col("phash").alias("h_a"), "band")
    b = keyed.select(F.col("path").alias("path_b"), F.col("phash").alias("h_b"), "band")
    x = F.col("h_a").bitwiseXOR(F.col("h_b"))
    first = F.lit(n)
    for i in reversed(range(n)):
        lo, hi = cut[i], cut[i + 1]
        same = F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1).cast("bigint")) == 0
        first = F.when(same, F.lit(i)).otherwise(first)
    met = a.join(b, (a["band"] == b["band"]) & (F.col("path_a") < F.col("path_b")) & (F.bit_count(x) <= max_distance) & (a["band.i"] == first))
    return met.select("path_a", "path_b", F.bit_count(x).alias("distance"))
