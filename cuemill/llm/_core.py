"""Shared pieces of the corpus operators: staged tables and vectorised word hashing.

Words are runs of bytes outside 0x20 and 0x09-0x0D, which in UTF-8 is the same as
runs of code points outside those characters.  All hashing works on whole Arrow
batches with numpy, in blocks of about ``BLOCK`` bytes, so that a Python worker
holds a bounded working set however long its partition is.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = _IDENTITY.copy()
LOWER[65:91] += 32

#: Spans of more bytes are hashed one by one.
LONG_SPAN = 64
_SEED = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: A key is hot if it holds more than this share of all rows, so there are at most HOT_KEYS such keys.
HOT_KEYS = 1000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the folder named by spark.checkpoint.dir, which every executor sees.

    Where the setting is absent a local master (tests on one machine) gets a temporary folder for the
    session; any other master is refused, as its executors would each write to a disk of their own."""
    return f"{_shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def lasting_dir(spark: SparkSession, name: str) -> str:
    """A folder below spark.checkpoint.dir that keeps its name from run to run."""
    return f"{_shared_base(spark)}/{name}"


def _shared_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cuemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there, and a lost
    executor costs only the re-reading of files."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, column: str = "text"):
    """The text column with null taken as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of width consecutive values, each put together from two shorter runs."""
    if width == 1:
        return h
    reach = width // 2
    half = runs(h, reach)
    n = max(0, len(half) - reach)
    out = mix(half[:n] * np.uint64(0xD6E8FEB86659FD93) + half[reach : reach + n])
    if width % 2:
        n = max(0, n - 1)
        out = mix(out[:n] * np.uint64(0xA0761D6478BD642F) + h[width - 1 : width - 1 + n])
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK):
    """Ranges of rows with about limit bytes each; one long row is a range by itself."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Word boundaries of some rows: first byte, end byte, and for row i the words rows[i]:rows[i+1]."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        inside = ~between[raw]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.rows = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, translate: np.ndarray = _IDENTITY) -> np.ndarray:
        """64-bit hash of each word after a byte translation."""
        return span_hashes(self.raw, self.start, self.end, translate)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, translate: np.ndarray = _IDENTITY) -> np.ndarray:
    """64-bit hash of byte spans: a chain of finalised steps over eight bytes each, of long spans a BLAKE2 digest.

    Each step is a bijection of the eight bytes, so no two spans have a collision by their structure."""
    if translate is not _IDENTITY:
        raw = translate[raw]
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    h = mix(mix(size.astype(np.uint64) + _SEED) ^ (eight[start] & _MASK[np.minimum(size, 8)]))
    done = 8
    more = np.flatnonzero((size > done) & (size <= LONG_SPAN))
    while len(more):
        h[more] = mix(h[more] ^ (eight[start[more] + done] & _MASK[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def sums_by_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of values[rows[i]:rows[i+1]] for each i, 0 for empty ranges (wraps around for uint64)."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[rows[1:]] - total[rows[:-1]]


def word_blocks(column: pa.Array, limit: int = BLOCK, between: np.ndarray = _SPACE):
    """(first row, end row, Words) over a column, block by block; between marks the bytes outside words."""
    raw, offsets = buffers(column)
    for lo, hi in blocks(offsets, limit):
        a, b = offsets[lo], offsets[hi]
        yield lo, hi, Words(raw[a:b], offsets[lo : hi + 1] - a, between)


def join_split(rows: DataFrame, table: DataFrame, key: str, most_hot: int = HOT_KEYS) -> DataFrame:
    """rows left-joined to table (one row a key) on a column both have, without a task for a hot key.

    Keys that hold more than one of most_hot of all rows are hot; there are fewer than most_hot of them,
    so their rows of table are broadcast; all other keys are joined by shuffling.  Null keys match nothing."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    total = rows.count()
    hot = staged(counts.where(F.col("count") * most_hot > total).select(F.col(key).alias("_hot_key")), "hot-keys")
    if hot.isEmpty():
        return rows.join(table, key, "left")
    rare = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left_anti")
    often = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left_semi")
    few = table.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left_semi")
    return rare.join(table, key, "left").unionByName(often.join(F.broadcast(few), key, "left"))
