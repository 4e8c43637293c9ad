"""Manifests, capture logs, result caches and reference values, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.config import SPLITS
from lamina.operators.frames import FRAME_SCHEMA

MANIFEST = T.StructType(
    [
        T.StructField("strategy", T.StringType()), T.StructField("seed", T.LongType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("assignments", T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in FRAME_SCHEMA])))),
    ]
)
CAPTURE = (
    "pieza STRING, clase STRING, etiqueta STRING, ruta STRING, segundos_pedidos DOUBLE, frames INT, fps_medido DOUBLE, fps_declarado DOUBLE, resolucion ARRAY<INT>, controles_aplicados MAP<STRING,BOOLEAN>, "
    "calidad STRUCT<n_frames INT, brightness_mean DOUBLE, brightness_cv DOUBLE, clipped_max DOUBLE, sharpness_median DOUBLE, warnings ARRAY<STRING>>, avisos_deriva ARRAY<STRING>, fecha STRING"
)
CACHE = "clave STRING, auroc DOUBLE"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at path, on any of Spark's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_manifest_json(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file with explicit assignments -> strategy, seed, split and frame columns, a row a frame."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return raw.select("strategy", "seed", F.explode("assignments").alias("split", "rows")).select("strategy", "seed", "split", F.explode("rows").alias("r")).select("strategy", "seed", "split", "r.*")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, one metadata row) as sinks.write_manifest left them. split is a partition column, so a read of one
    split opens its files only."""
    rows = spark.read.schema(T.StructType([*FRAME_SCHEMA.fields, T.StructField("split", T.StringType())])).parquet(f"{path}/rows")
    meta = spark.read.schema("strategy string, seed long, metadata map<string,string>, frame_counts map<string,long>, group_counts map<string,long>, leakage struct<shared_train_test:long,shared_train_val:long,contaminated:long,normal_test:long,total:long,fraction:double>").json(f"{path}/meta")
    return rows.where(F.col("split").isin(*SPLITS)), meta


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """A capture log, a row a clip; a log that doesn't exist is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], CAPTURE)
    return spark.read.schema(CAPTURE).json(path)


def frames_of_captures(captures: DataFrame) -> DataFrame:
    """piece, class, label (normal or defect), clip path of each capture."""
    label = F.when(F.col("etiqueta") == "normal", "normal").otherwise("defect")
    return captures.select(F.col("pieza").alias("group_id"), F.col("clase").alias("class"), label.alias("label"), F.col("ruta").alias("source_video"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """clave, auroc of a result cache, the last write of a key; a cache that doesn't exist is empty. Lines are
    ordered by file and their place in it."""
    if not exists(spark, path):
        return spark.createDataFrame([], CACHE)
    lines = spark.read.text(path).select(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"), F.from_json("value", CACHE).alias("r"))
    return lines.where("r.clave IS NOT NULL").groupBy("r.clave").agg(F.max_by("r.auroc", F.struct("t", "f", "n")).alias("auroc"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """model, source (paper or library), category, value of verified reference values; names beside the
    categories of a block are left out by their type."""
    block = "map<string,string>"
    raw = spark.read.schema(f"referencias map<string,map<string,{block}>>").option("multiLine", True).json(path)
    flat = raw.select(F.explode("referencias").alias("model", "sources")).select("model", F.explode("sources").alias("source", "block")).where("block['verificado'] = 'true'")
    named = flat.select("model", F.when(F.col("source").contains("paper"), "paper").otherwise("library").alias("source"), F.explode("block").alias("category", "raw"))
    return named.withColumn("value", F.col("raw").try_cast("double")).where("value IS NOT NULL").drop("raw")
