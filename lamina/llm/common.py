"""What the training-text operators share: the cluster's shared folder, staged tables, a worker's memory, schema guards."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this subpackage has it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch of texts.
TEXT_ROWS = 1024

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset in a local
    session (tests) a temporary folder is set; on a cluster that is an error, as executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder, as the master is {master}")
        found = "file://" + tempfile.mkdtemp(prefix="lamina-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lamina-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before; the folder is scratch space
        pass


def delete(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder early."""
    _delete(spark, path)


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df, written once to the shared folder and read back: its lineage is cut, and what is
    written outlives every executor. Used for tables that are read more than once."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """While it lasts, what the session executes passes `rows` rows at a time to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


_KEPT: dict[str, object] = {}


def kept_by_worker(owner: str, make: Callable[[], object] = object):
    """What make() gave, kept by a Python worker from task to task. A worker outlives the stage of an operator, so it keeps
    things of one owner at a time: those of another go first, and their memory with them."""
    found = _KEPT.get(owner)
    if found is None:
        if _KEPT:
            _KEPT.clear()
            trim()
        found = _KEPT[owner] = make()
    return found


def trim() -> None:
    """Give free memory back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # glibc's only
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, most: int, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `rows` rows whose column (string or binary) has `most` bytes or one value."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > begin and (held + n > most or i - begin == rows):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


def lower_ascii(text):
    """A-Z to lower case, nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def n_words(text):
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores so that no column of df clashes with it (any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def local_path(uri: str) -> str | None:
    """The path of a file: URI (or a bare path); None for other stores."""
    m = re.match(r"^file:(?://[^/]*)?(/.*)$", uri)
    return m[1] if m else uri if uri.startswith("/") else None
