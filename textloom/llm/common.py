"""What the corpus operators share: scratch tables, Arrow batches, checks of keys."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
#: Scratch paths that are still there, in the order made.
_PATHS: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; where that is unset, a local one if all runs on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="textloom-"))
    return _OWN[0]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed by ``release`` or when the driver ends."""
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    atexit.register(remove_path, spark, path)
    return path


def mark() -> int:
    """For ``release``: what is made from now on."""
    return len(_PATHS)


def release(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Removes the scratch tables made since the mark, except the one that ``keep`` reads."""
    held = set() if keep is None else {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in keep.inputFiles()}
    for path in _PATHS[since:]:
        if path.split(":", 1)[-1].lstrip("/") not in held:
            remove_path(spark, path)
            _PATHS.remove(path)


def remove_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_text(column: str = "text") -> Column:
    """The text's UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def blobs(array: pa.Array) -> Iterator[bytes]:
    """The values of a binary Arrow array one by one; null as empty."""
    for x in array:
        yield x.as_py() or b""


def _give_back() -> None:
    """Returns freed memory to the system: a Python worker waits for further tasks with what it has."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that leaves no freed memory behind in its worker."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _give_back()

    return run


#: Bytes of a column that are worked on at once, except for a single longer value.
SLICE_BYTES = 1_000_000


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a binary or text column holds about ``most`` bytes."""
    for batch in batches:
        if not len(batch):
            continue
        off, _ = buffer_of(batch.column(column))
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def buffer_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a binary Arrow array without copying the data."""
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return off - off[0], np.empty(0, np.uint8)
    return off - off[0], np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
