"""The driver's tables as frames. Each view has a Spark side and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions.bits import pack_bits, sign_bits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_label(key: Column) -> Column:
    """A label that is constant in a group: about one group in three is a defect."""
    return F.when(F.conv(F.substring(F.md5(key), 1, 2), 16, 10).cast("int") % 3 == 0, "defect").otherwise("normal")


def label_sql(key: str) -> str:
    return f"CASE WHEN ('0x' || substr(md5({key}), 1, 2))::INT % 3 = 0 THEN 'defect' ELSE 'normal' END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the frames of a piece, in order of time; the signal is their value."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    group = F.col("user_id").cast("string")
    index = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    rows = e.withColumn("frame_index", index)
    return rows.select(
        F.format_string("frames/%s/%05d.png", group, "frame_index").alias("path"), group.alias("group_id"), piece_label(group).alias("label"), F.concat(group, F.lit(".mp4")).alias("source_video"),
        "frame_index", (F.col("frame_index") / F.lit(30.0).cast("double")).alias("timestamp_s"), F.col("value").alias("signal"), "event_type", "ts", "event_id",
    )


EVENTS = f"""e AS (
  SELECT 'frames/' || user_id || '/' || lpad(frame_index::VARCHAR, greatest(5, length(frame_index::VARCHAR))::INT, '0') || '.png' AS path, user_id::VARCHAR AS group_id,
    {label_sql("user_id::VARCHAR")} AS label, user_id || '.mp4' AS source_video, frame_index, frame_index / 30.0::DOUBLE AS timestamp_s, value AS signal, event_type, ts, event_id
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index FROM events)
)"""


def vectors(spark: SparkSession, sf_dir: str, bits: int = 64) -> DataFrame:
    """Embeddings as hashed frames: the hash is the sign bits of their components."""
    v = table(spark, sf_dir, "embeddings")
    group = F.col("label").cast("string")
    return v.select(
        F.col("vec_id").cast("string").alias("path"), group.alias("group_id"), piece_label(group).alias("label"), F.concat(group, F.lit(".mp4")).alias("source_video"),
        F.col("vec_id").alias("frame_index"), (F.col("vec_id") / F.lit(30.0).cast("double")).alias("timestamp_s"), pack_bits(F.slice(sign_bits("embedding"), 1, bits)).alias("phash"), F.col("embedding").alias("vector"),
    )


def vectors_sql(bits: int = 64) -> str:
    return f"""v AS (
  SELECT vec_id::VARCHAR AS path, label::VARCHAR AS group_id, {label_sql("label::VARCHAR")} AS label, label || '.mp4' AS source_video, vec_id AS frame_index,
    list_sum(list_transform(range(1, {bits + 1}), lambda i: CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (({bits} - i)::INT)) ELSE 0::HUGEINT END))::UBIGINT AS phash
  FROM embeddings
)"""


def lines(spark: SparkSession, sf_dir: str, group: str = "l_orderkey") -> DataFrame:
    """Order lines as frames, grouped by order or by supplier."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", group) if group != "l_orderkey" else table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    g = F.col(group).cast("string")
    path = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return li.select(path.alias("path"), g.alias("group_id"), piece_label(g).alias("label"), F.concat(g, F.lit(".mp4")).alias("source_video"), F.col("l_linenumber").cast("long").alias("frame_index"), (F.col("l_linenumber") / F.lit(30.0).cast("double")).alias("timestamp_s"))


def lines_sql(group: str = "l_orderkey") -> str:
    return f"""l AS (
  SELECT l_orderkey || '-' || l_linenumber AS path, {group}::VARCHAR AS group_id, {label_sql(group + "::VARCHAR")} AS label, {group} || '.mp4' AS source_video, l_linenumber::BIGINT AS frame_index FROM lineitem
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label: key, split by hash of the key, score (their length), y (toxic)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    bucket = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2), 16, 10).cast("int") % 5
    split = F.when(bucket < 2, "val").otherwise("test")
    return d.select(F.col("doc_id").alias("path"), split.alias("split"), F.col("n_chars").cast("double").alias("score"), (F.col("toxic") == 1).alias("y"))


SCORED = """d AS (
  SELECT doc_id AS path, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 2))::INT % 5 < 2 THEN 'val' ELSE 'test' END AS split, n_chars::DOUBLE AS score, toxic = 1 AS y
  FROM documents JOIN labels USING (doc_id)
)"""


def _mean_in_tenths(kind: str, name: str) -> tuple[list[Column], Column]:
    """Aggregates, and from them the mean of a kind's values over 10, rounded half away from zero (null without values).

    A sum of doubles depends on the order of its rows, which would decide means that lie halfway. So values that are
    decimals of at most 14 and 12 digits are summed and divided as such; a group with any other value keeps doubles.
    """
    x = F.when(F.col("event_type") == kind, F.col("value"))
    exact = x.try_cast("decimal(26,12)")
    sums = [F.avg(x).alias(f"{name}_mean"), F.count(x).alias(f"{name}_n"), F.sum(exact).alias(f"{name}_sum"), F.every(exact.cast("double").eqNullSafe(x)).alias(f"{name}_exact")]
    twice, n = f"abs({name}_sum) + abs({name}_sum)", f"cast({name}_n * {{}} as decimal(18,0))"
    whole = F.expr(f"signum({name}_sum) * (({twice} + {n.format(10)}) div {n.format(20)})")
    return sums, F.when(F.col(f"{name}_n") == 0, None).when(F.col(f"{name}_exact"), whole).otherwise(F.round(F.col(f"{name}_mean") / 10, 0))


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired replicates: of each user the mean value of clicks (treatment) and of views (control), in tenths so
    that ties and zero differences occur; the contrast is the user's number modulo 4."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    (t, treatment), (c, control) = _mean_in_tenths("click", "t"), _mean_in_tenths("view", "c")
    per = e.groupBy("user_id").agg(*t, *c).where("t_n > 0 AND c_n > 0")
    return per.select((F.col("user_id") % 4).cast("long").alias("contrast"), F.col("user_id").alias("replicate"), treatment.alias("treatment"), control.alias("control"))


REPLICATES = """r AS (
  SELECT user_id % 4 AS contrast, user_id AS replicate, round(t / 10, 0) AS treatment, round(c / 10, 0) AS control
  FROM (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) AS t, avg(CASE WHEN event_type = 'view' THEN value END) AS c FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id)
  WHERE t IS NOT NULL AND c IS NOT NULL
)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and day as the frames of a clip, with made-up quality figures from their values."""
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    return e.select(
        F.col("user_id").cast("string").alias("class"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.least(F.lit(1.0), v / 255.0).alias("brightness"),
        F.when(v < 1, F.lit(0.05)).otherwise(F.lit(0.0)).alias("clipped_dark"), F.when(v > 200, F.lit(0.03)).otherwise(F.lit(0.0)).alias("clipped_bright"), (v * 2).alias("sharpness"),
    )


CLIPS = """c AS (
  SELECT user_id::VARCHAR AS class, strftime(ts, '%Y-%m-%d') AS day, least(1.0::DOUBLE, value / 255.0::DOUBLE) AS brightness,
    CASE WHEN value < 1 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS clipped_dark, CASE WHEN value > 200 THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END AS clipped_bright, value * 2 AS sharpness FROM events
)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate results: dose, seed, arm, auroc. A contrast's replicates are a dose's; four users share a seed."""
    r = replicates(spark, sf_dir)
    both = F.explode(F.array(F.struct(F.lit("leaked").alias("arm"), F.col("treatment").alias("auroc")), F.struct(F.lit("clean").alias("arm"), F.col("control").alias("auroc"))))
    return r.select((F.col("contrast") * F.lit(0.1)).alias("dose"), F.floor(F.col("replicate") / 4).cast("long").alias("seed"), both.alias("x")).select("dose", "seed", "x.arm", "x.auroc")


RESULTS = f"""{REPLICATES}, res AS (
  SELECT contrast * 0.1::DOUBLE AS dose, replicate // 4 AS seed, arm, CASE WHEN arm = 'leaked' THEN treatment ELSE control END AS auroc FROM r, (VALUES ('leaked'), ('clean')) a(arm)
)"""
