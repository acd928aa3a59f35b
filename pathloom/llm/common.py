"""Shared pieces: lineage cuts, word hashing over Arrow text, table access.

Words are maximal runs of ASCII letters and digits and of non-ASCII characters,
after Unicode lower-casing. A null text counts as an empty one everywhere.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A slice of a batch holds about so many bytes, whatever the batch size is.
SLICE_BYTES = 1 << 19
#: Words in a shingle, and the similarity from which texts are near-duplicates.
SHINGLE = 5
SIMILARITY = 0.8


#: Rows and bytes of a batch that Spark hands to Python: they hold whole texts, so few are enough,
#: and of long ones fewer still, as the JVM and the worker hold a batch each.
BATCH_ROWS, BATCH_BYTES = 1_000, 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the folder. Sets the session's Arrow batches to BATCH_ROWS and BATCH_BYTES if they are larger."""
    conf = spark._jsparkSession.sessionState().conf()
    if not 0 < conf.arrowMaxRecordsPerBatch() <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if conf.arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder where that is unset and all runs in one JVM, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return context._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Writes ``df``, and has the shuffle files of that removed at once: what reads the table never needs them.

    Else they stay on executors' disks until the driver happens to collect its garbage. The session's
    setting is put back.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so its lineage ends there.

    A written table also has its true size: a checkpoint keeps its plan's estimate, and in a loop
    of joins such estimates multiply until planning takes longer than the work.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    write_table(df, path)
    found = spark.read.schema(df.schema).parquet(path)
    found._cut_path = path
    return found


def release(*tables: DataFrame) -> None:
    """Removes the files of tables from ``cut`` that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_cut_path", None):
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: glibc's call that gives freed memory back; other systems lack it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split batches so that the text of each slice is about ``most`` bytes or one row.

    At the end what Arrow's pool and NumPy have freed goes back to the system: workers outlive their
    tasks, and would hold it beside the next stage's.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // most
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, n], strict=True):
            yield batch.slice(int(a), int(b - a))
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_RADIX_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, radix in enumerate((_RADIX, _RADIX_INVERSE)):
            steps = np.full(max(n, SLICE_BYTES * 2), radix, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = np.asarray(h)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each row starts (one more at the end)."""
    array = pc.fill_null(array, "")
    if pa.types.is_large_string(array.type):
        kind = np.int64
    else:
        array, kind = array.cast(pa.string()), np.int32
    offsets = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    body = array.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each row (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    opens = np.empty(len(data) + 1, bool)
    opens[0] = opens[-1] = True
    opens[1:-1] = ~inside[:-1]
    shuts = np.empty(len(data) + 1, bool)
    shuts[-1] = True
    shuts[:-1] = ~inside
    opens[offsets] = True
    shuts[offsets] = True
    starts = np.flatnonzero(inside & opens[:-1])
    ends = np.flatnonzero(inside & shuts[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one pass of polynomial prefix sums."""
    power, inverse = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII and Latin-1 capitals lowered in place, so that byte places stay."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    low[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return low


def words(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and where each row's words start."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(array, "")))
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


_STEP = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within rows, and where each row's runs start.

    A row with fewer than ``k`` words, but some, has one run of all its words.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(count, out=begin[1:])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    left = np.repeat(first[1:], count) - at
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        here = padded[at + j]
        if j:
            here = np.where(left > j, here, np.uint64(0))
        out += mix(here + np.uint64(int(_STEP[j % 5]) * (j + 1) % (1 << 64)))
    return mix(out), begin


def text_column(df: DataFrame, *keep: str) -> DataFrame:
    """Only the named columns and the text, whatever else the table has."""
    return df.select(*keep, "text")
