"""Connected components of an undirected graph, by alternating large-star and small-star steps.

Links and labels stay distributed. Every round's links are written to the shared folder, which cuts
the lineage; the number of rounds grows with the logarithm of the longest path. A node's smallest
neighbour is an ordinary (partially aggregated) minimum, and the join that hands it to the node's links
is one that adaptive execution splits where a node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, new_folder

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long, any direction, repeats and self-links allowed) -> node, component (the
    smallest node reachable) for each node that has a link to another."""
    spark = links.sparkSession
    old = None

    def kept(df: DataFrame):
        path = new_folder(spark, "links")
        df.write.parquet(path)
        return path, spark.read.schema("u long, v long").parquet(path)

    path, edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(MAX_ROUNDS):
        # large star: each node sends its larger neighbours to its smallest neighbour or itself
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node sends its smaller neighbours and itself to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(low, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        new_path, edges = kept(small.select("e.u", "e.v").where("u <> v").distinct())
        if old:
            delete(spark, old)
        old, path = path, new_path
        h = F.xxhash64("u", "v")
        seen = edges.agg(F.count("*"), F.bit_xor(h), F.sum(h % 1_000_003)).first()  # a digest of the set
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
