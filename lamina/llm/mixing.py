"""Mixing sources to target weights by systematic sampling.

Sizes are words. The mix takes `share` of all words; sources share it by weight, a source at most
`most` times its own size, and what a source can't take is shared again by weight until none is above.
That water filling has a closed form: in the order of (cap / weight), the first sources are at their cap
and the others get a common rate times their weight; two running sums over one row a source find it.

Within a source each document expects target / source_size copies. Documents stand in an order (size
class, then a hash of doc_id), the expected copies are summed up along it, one random offset of the
source is added, and a document is emitted once for each integer that its interval crosses. The order by
size makes the words taken come near the target, not only the documents.

The running sums need no task that holds a source: documents are dealt by (source, size class, leading
hash digits), each such cell's number of documents is counted first (an aggregation), and a document's
place is its cell's offset plus its place in the cell. The number of hash digits follows the number of
documents, so a cell stays near `cell` documents, even if one source and size hold most of the table.
The order itself does not depend on the number of digits, and all is a function of the rows: reruns agree.

A null text has size 0; its document is drawn like any other and takes 0 words. A null source is a source
of its own, last in order. Ties of doc_id are ordered by the hash of the text; equal rows are drawn apart.
A source of size 0 has target 0. Empty tables give empty results. Clashing column names are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, require, staged

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = 7
CELL = 20_000


def size_class(size: Column) -> Column:
    """The length of the size in bits and its leading five bits: sizes within about 6 %."""
    bits = F.bin(size)
    return F.length(bits) * 32 + F.conv(F.rpad(F.substring(bits, 1, 5), 5, "0"), 2, 10).cast("int")


def offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1), of 20 bits: sums with it stay exact."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(1048576.0)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size) -> also target. One row a source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(kinds, (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    goal = F.least(F.sum("source_size").over(every) * F.lit(float(share)), F.sum("cap").over(every))
    rate = (goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rated = ranked.withColumn("rate", rate).withColumn("open", F.col("rate") * F.col("weight") <= F.col("cap"))
    # the first source that is not above its cap sets the rate of all that follow it
    common = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("rate")))).over(every)["rate"]
    rated = rated.withColumn("common", common)
    return rated.select("source", "source_size", F.when(F.col("common").isNull() | (F.col("cap") < F.col("common") * F.col("weight")), F.col("cap")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def copies(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, cell: int = CELL) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, text_hash for each row of docs."""
    require(docs, "doc_id", "text", "source")
    sized = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("place"), F.xxhash64("text").alias("text_hash"),
        ).withColumn("class", size_class(F.col("size"))),
        "mix-sizes",
    )
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    total, digits = sized.count(), 0
    while cell * 16**digits < total and digits < 12:
        digits += 1
    keyed = sized.withColumn("lead", F.substring("place", 1, digits))
    cells = keyed.groupBy("source", "class", "lead").agg(F.count("*").alias("n"))
    # running sums over cells: first over the classes of a source, then over the leads of a class
    per_class = cells.groupBy("source", "class").agg(F.sum("n").alias("n_class"))
    up = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    per_class = per_class.select(F.col("source").alias("s_"), F.col("class").alias("c_"), F.coalesce(F.sum("n_class").over(up), F.lit(0)).alias("before_class"))
    within = Window.partitionBy("source", "class").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("before_lead", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = placed.join(per_class, placed["source"].eqNullSafe(F.col("s_")) & (placed["class"] == F.col("c_")))
    placed = placed.join(goal.select(F.col("source").alias("g_"), "source_size", "target"), placed["source"].eqNullSafe(F.col("g_")))
    placed = placed.select(F.col("source").alias("s_"), F.col("class").alias("c_"), F.col("lead").alias("l_"), (F.col("before_class") + F.col("before_lead")).alias("before"), "source_size", "target")
    in_cell = Window.partitionBy("source", "class", "lead").orderBy("place", "doc_id", "text_hash")
    rows = keyed.withColumn("i", F.row_number().over(in_cell).cast("long"))
    rows = rows.join(placed, rows["source"].eqNullSafe(F.col("s_")) & (rows["class"] == F.col("c_")) & (rows["lead"] == F.col("l_")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("before") + F.col("i")
    start = offset(F.col("source"), seed)
    crossed = F.floor(start + rate * place) - F.floor(start + rate * (place - 1))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.least(crossed, F.lit(int(-(-most // 1)))).cast("long").alias("copies"), "text_hash")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it. Equal rows (doc_id, text and source) are drawn as
    a set: of n such rows that take c copies together, each is emitted c div n times and the rest once."""
    drawn = copies(docs, **how).groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("n_copies"), F.count("*").alias("n_rows"))
    drawn = drawn.where("n_copies > 0").select(F.col("doc_id").alias("mix_d"), F.col("text_hash").alias("mix_h"), F.col("source").alias("mix_s"), "n_copies", "n_rows")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), F.col("source").cast("string").alias("s"))
    joined = rows.join(drawn, F.col("d").eqNullSafe(F.col("mix_d")) & (F.col("h") == F.col("mix_h")) & F.col("s").eqNullSafe(F.col("mix_s")))
    once = joined.where("n_rows = 1").select("row", F.col("n_copies").alias("times"))
    nth = F.row_number().over(Window.partitionBy("d", "h", "s").orderBy(F.lit(0)))
    more = joined.where("n_rows > 1").withColumn("nth", nth).select("row", (F.floor(F.col("n_copies") / F.col("n_rows")) + (F.col("nth") <= F.col("n_copies") % F.col("n_rows")).cast("int")).alias("times"))
    return once.union(more).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
