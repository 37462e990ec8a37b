"""What the operators of this folder share: tables, durable cuts of the lineage, word kernels."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
#: Seconds between two collections of the driver's garbage.
PAUSE = 3
_collected = 0.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a local one on a local master (tests), else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not at.isDefined() and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = at.get() if at.isDefined() else f"file://{tempfile.mkdtemp(prefix='kelpie-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def durable(df: DataFrame, parts_by: int = 0) -> DataFrame:
    """df written as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs only the tasks it was running, as the rows lie outside the
    executors. Shuffle files that only df needed can go then, so the driver is asked to collect its garbage.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/kelpie-{uuid.uuid4().hex}"
    (df.coalesce(parts_by) if parts_by else df).write.option("compression", "zstd").parquet(at)
    _WRITTEN.append((spark, at))
    out = spark.read.schema(df.schema).parquet(at)
    out.kelpie_path = at  # type: ignore[attr-defined]
    del df
    if time.monotonic() - _collected > PAUSE:
        tidy(spark)
    return out


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing needs any more; after a large one it is worth a call of its own."""
    global _collected
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _collected = time.monotonic()


def discard(df: DataFrame | None) -> None:
    """Deletes what durable() wrote, when nothing reads it any more; anything else is left alone."""
    at = getattr(df, "kelpie_path", None)
    if at:
        _delete(df.sparkSession, at)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != at]


def _delete(spark: SparkSession, at: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _tidy() -> None:
    for spark, at in _WRITTEN:
        try:
            _delete(spark, at)
        except Exception:  # noqa: BLE001  the session has ended: nothing more can be done here
            break


# ---------------------------------------------------------------- words of whole Arrow columns

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first 0 to 8 bytes of a little-endian 64-bit number.
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words longer than this are hashed one by one.
LONG = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits look independent (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def blocks(offsets: np.ndarray, most: int = 1 << 20):
    """(first, last) row ranges of about `most` bytes each; a longer text is a block of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of the rows, and for each row the first word's index (n+1 long)."""
    return placed_words(raw, offsets, lower)[:2]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as a little-endian number (zeros behind the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def placed_words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words(), with the place and the length in bytes of each word.

    Words of up to eight bytes and one length have different hashes; of longer ones each eight bytes go through a mixing of their own,
    so no pattern of letters cancels out in the sum, and those over LONG bytes have a BLAKE2 digest.
    """
    n, none = len(raw), np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    inside = ~SPACE[raw]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    lengths = np.flatnonzero(last) + 1 - starts
    data = LOWER[raw] if lower else raw
    eight = eights(data)
    h = mix((eight[starts] & HEAD[np.minimum(lengths, 8)]) + _STEP)
    more, j = np.flatnonzero(lengths > 8), 8
    if len(more) and int(lengths.max()) > LONG:
        for i in np.flatnonzero(lengths > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + lengths[i]].tobytes(), digest_size=8).digest(), "little")
        more = more[lengths[more] <= LONG]
    while len(more):
        x = eight[starts[more] + j] & HEAD[np.minimum(lengths[more] - j, 8)]
        h[more] += mix(x + mix(np.array([j], np.uint64) * _STEP))
        j += 8
        more = more[lengths[more] > j]
    return mix(h + lengths.astype(np.uint64) * _STEP), np.searchsorted(starts, offsets).astype(np.int64), starts, lengths


def lean(run):
    """run(batches) whose worker gives freed memory back when its task is over: workers live on, and several share an executor."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
