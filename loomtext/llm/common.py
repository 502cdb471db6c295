"""Shared helpers: lineage cuts in the shared folder, partition counts, columnar blobs."""

from __future__ import annotations

import ctypes
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id wherever ids are compared: null sorts last.
NULL_ID = (1 << 63) - 1
#: ASCII white space, the separators of words (also what ``bytes.split()`` splits on).
WORD = "[^\\x20\\x09-\\x0D]+"


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local one serves a session of one machine (tests); a cluster's raises ValueError."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="loomtext-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder: its lineage ends and lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/loomtext-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for rows that are wide or read column by column. ``drop_stored`` deletes all of a session's."""
    path = f"{_tables_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Deletes the tables that ``stored`` has written in this session: for when no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _trim() -> None:
    """Gives what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def bounded_batches(spark: SparkSession, batch_bytes: int = 4 << 20) -> None:
    """Lets Arrow batches have about ``batch_bytes`` at most, unless the session has a bound of its own.

    For applications that run operators over whole texts in little memory, to be
    called once: the setting is the session's, so operators leave it alone.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(batch_bytes))


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kinds: str) -> DataFrame:
    """``df.mapInArrow(run, kinds)``, for rows with whole texts: workers live on between tasks, so they return freed memory after each."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return df.mapInArrow(tidy, kinds)


def partitions_for(df: DataFrame, each: int = 16 << 20) -> int:
    """Shuffle partitions for ``df``: the session's number, more where the input is known to be larger than ``each`` bytes a partition."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return most if size >= 1 << 53 else max(most, min(-(-size // each), 100_000))  # beyond that, Spark doesn't know


def id_key(name: str = "doc_id"):
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays to one zstandard blob; ``unpack`` needs their types."""
    body = b"".join(struct.pack("<q", a.nbytes) + np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    body, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for t in types:
        (n,) = struct.unpack_from("<q", body, at)
        out.append(np.frombuffer(body, t, n // np.dtype(t).itemsize, at + 8))
        at += 8 + n
    return out


def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows to an Arrow batch."""
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
