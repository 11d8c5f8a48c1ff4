"""What the corpus operators share: tables, the shared folder, text and hash helpers.

Rules that hold for every operator here:

* a column the operator adds replaces a column of that name in its input;
  other columns of the input are left alone or are not read at all;
* a null text counts as stated in each operator's docstring and never raises;
* an empty table gives an empty result with the full schema.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers, by rows and by bytes.

    The options hold for the session from then on, since a result is computed when it is
    used; one that is set lower already stays.
    """
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= value:
            spark.conf.set(key, str(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and the master is local (tests) a folder of our own is used.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(found)
        return found.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="thalweg-checkpoint-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries made and run inside go when each has ended, not when the driver next collects garbage.

    A query counts if its own DataFrame is made inside, so results that are given to a caller are not touched.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


#: Folders of the checkpoints made inside checkpoints_dropped().
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, keep it in the shared folder and forget how it was made, its shuffle files too."""
    shared_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        kept = df.select("*").checkpoint(eager=True)
    if (made := _MADE.get()) is not None:
        made.append(kept._jdf.logicalPlan().rdd().getCheckpointFile().get())
    return kept


@contextmanager
def checkpoints_dropped(spark: SparkSession) -> Iterator[None]:
    """What cut() keeps inside goes at the end, when all that was made of it must be written."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for folder in made:
            drop_folder(spark, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_empty(df: DataFrame) -> bool:
    """Whether df has no row, leaving no shuffle files."""
    with shuffles_dropped(df.sparkSession):
        return not df.select(F.lit(1)).limit(1).collect()  # isEmpty() leaves them where there is a row


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for a folder named by a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def one_thread() -> None:
    """Keep numpy's matrix products in a Python worker to the task's own core; other cores have tasks of their own."""
    import ctypes
    from pathlib import Path

    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


#: What this worker keeps from task to task: how to forget it, by the operator that keeps it.
HELD: dict[str, Callable[[], None]] = {}


def working(on: str) -> None:
    """Called where a task starts: what other operators keep in this worker goes.

    Workers live on between stages, and so would caches that no later stage reads.
    """
    others = [name for name in HELD if name != on]
    for name in others:
        HELD.pop(name)()
    if others:
        release()


def columns_of(docs: DataFrame) -> list:
    """All columns of docs by their own names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def release() -> None:
    """Give memory that a finished task no longer needs back to the system.

    Python workers are used again by later stages, so what one stage has freed must not
    stay with it.
    """
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call


def plain_id(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with doc_id never null and _null beside it, since a null among them would turn pandas' integers into floats."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    return docs.select(doc_id.alias("doc_id"), F.col("doc_id").isNull().alias("_null"), *columns)


def ids_of(rows: pd.DataFrame):
    """The ids of rows that plain_id() made, null where they were."""
    return pd.arrays.IntegerArray(rows["doc_id"].to_numpy(dtype=np.int64), rows["_null"].to_numpy(dtype=bool))


def doc_crc(column: str = "doc_id"):
    """crc32 of the id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
