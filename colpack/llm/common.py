"""What the operators share: materialising, word splitting and the like."""

import ctypes
import functools
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one where it is unset and all runs in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file:///tmp/colpack-shared"
    return found.rstrip("/") + "/colpack-" + spark.sparkContext.applicationId


#: What a Python worker keeps between tasks.
_kept: list[dict] = []


def kept_by_worker() -> dict:
    """A dictionary for objects that a worker keeps between tasks, until another operator's task drops them."""
    _kept.append({})
    return _kept[-1]


def drop_kept() -> None:
    """Free the word caches that earlier operators have left in this worker, which Spark reuses."""
    for kept in _kept:
        kept.clear()
    trim()


#: The C library's way to return free memory; None where it has none.
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give the system back what Arrow and the C library keep free: Spark's Python workers, also idle ones, live on beside its heap."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def lean(run):
    """run, a function from batches to batches, whose worker is trimmed when its task ends."""

    @functools.wraps(run)
    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


#: Folders of intermediate tables that still exist, as (application, path, owner).
_scratch: list[tuple[str, str, str | None]] = []
#: Who owns the intermediate tables that are being written; nobody but for the stages of a pipeline.
_owner: ContextVar[str | None] = ContextVar("owner", default=None)


@contextmanager
def owned(owner: str):
    """Inside, intermediate tables belong to owner, whose release() deletes them."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation, and rows that were
    numbered stay as they were.  The files go by discard() or release(), at last when the application's
    file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    _scratch.append((spark.sparkContext.applicationId, path, _owner.get()))
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, entry: tuple) -> None:
    files, at = _file_system(spark, entry[1])
    files.delete(at, True)
    _scratch.remove(entry)


def _read_by(df: DataFrame) -> set[str]:
    """Names of the intermediate tables that df reads."""
    return {parts[-2] for f in df.inputFiles() if len(parts := f.split("/")) > 1}


def discard(df: DataFrame) -> None:
    """Delete the intermediate tables that df reads, when nothing reads them any more."""
    read = _read_by(df)
    for entry in [*_scratch]:
        if entry[0] == df.sparkSession.sparkContext.applicationId and entry[1].rsplit("/", 1)[1] in read:
            _drop(df.sparkSession, entry)


def release(docs: DataFrame, owner: str) -> None:
    """Delete the intermediate tables of owner but those that docs reads; those of others stay."""
    read = _read_by(docs)
    for entry in [*_scratch]:
        if entry[0] == docs.sparkSession.sparkContext.applicationId and entry[2] == owner and entry[1].rsplit("/", 1)[1] not in read:
            _drop(docs.sparkSession, entry)


@contextmanager
def cleaned_shuffles(spark: SparkSession):
    """Inside, a finished query's shuffle files go at once, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def by_size(texts: pa.Array, most: int = 2 << 20) -> list[tuple[int, int]]:
    """(first, number) of stretches of texts with about most bytes together, so that long texts go alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(sizes // most)) + 1 if len(sizes) else []
    bounds = [0, *cuts, len(sizes)] if len(sizes) else [0]
    return [(int(a), int(b - a)) for a, b in zip(bounds, bounds[1:])]


def let(value, body):
    """Bind a column value once inside an expression, so lambdas in body do not compute it again."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
