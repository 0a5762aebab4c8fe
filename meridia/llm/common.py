"""Shared helpers: scratch tables, range shards, Arrow text buffers and vectorised word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that are hashed at once; a longer run without a separator is hashed whole.
SEGMENT = 1 << 19


# --- tables in the shared folder -------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master gets a
    temporary folder; a cluster must name one, since its machines share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="meridia-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/meridia/{tag}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    A collection of the driver's garbage follows, so that the context cleaner drops the shuffle files
    of the finished job rather than keeping them until the query ends.
    """
    spark = df.sparkSession
    path = path or table_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that scratch() wrote and that no later step reads."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_added(df: DataFrame, names: list[str], added: list[str]) -> DataFrame:
    """df, whose columns are those of docs and then the added ones, by these names; a column of docs that is named like an
    added one is left out."""
    places = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return places.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate([*names, *added]) if i >= len(names) or n not in added))


def integer_key(docs: DataFrame, key: str):
    """The key as a long column; an id of another type than integers is refused when the plan is made."""
    kind = docs.schema[key].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"column {key} must hold integers, not {kind}")
    return F.col(key).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- workers ---------------------------------------------------------------------------------

_OWNER: list[str] = [""]
CACHES: list[dict] = []


def begin(owner: str) -> None:
    """Called where a task of an operator starts: a reused worker keeps the caches of one operator at a time,
    and gives the memory of earlier tasks back to the system."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        for c in CACHES:
            c.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# --- range shards ----------------------------------------------------------------------------


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending values that occur in key; they cut it into ranges of about equal counts.

    Reads the key column alone. The list is as long as the number of shards, not as the input.
    """
    if n < 2:
        return []
    row = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n).alias("b")).first()
    return sorted(set(row["b"] or []))


def shard_of(key, bounds: list[int]):
    """Column: how many bounds are at most key; a null key goes to shard 0."""
    if not bounds:
        return F.lit(0)
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key.isNull(), 0).otherwise(_tree(key, bounds, 0, len(bounds)))


def _tree(key, bounds, lo, hi):
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key < F.lit(bounds[mid]), _tree(key, bounds, lo, mid)).otherwise(_tree(key, bounds, mid + 1, hi))


# --- Arrow -----------------------------------------------------------------------------------


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about most bytes of text each; one longer text stands alone."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    _, off = text_buffer(col)
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def binaries(chunks: np.ndarray, width: int) -> pa.Array:
    """Rows of a contiguous 2-d array as a binary column of fixed width."""
    raw = np.ascontiguousarray(chunks)
    n = raw.shape[0]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width)), pa.py_buffer(raw)])


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


# --- word hashes -----------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class Words:
    """Byte classes of a definition of words: which bytes belong to words, and whether A-Z are lower-cased."""

    def __init__(self, separators, lower: bool):
        member = np.ones(256, bool)
        member[list(separators)] = False
        self.member = member
        fold = np.arange(256)
        if lower:
            fold[65:91] += 32
        self.table = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64, 256, dtype=U64)[fold]

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte and 64-bit hash of each word of all rows, and the n + 1 word offsets of the rows."""
        n = len(data)
        inside = self.member[data]
        before = np.empty(n, bool)
        before[1:] = inside[:-1]
        before[:1] = False
        edges = offsets[:-1][offsets[:-1] < n]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[:-1] = inside[1:]
        after[-1:] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        hashes = np.empty(len(starts), U64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
            a, b = int(starts[i]), int(ends[j - 1])
            hashes[i:j] = self._hash(data[a:b], starts[i:j] - a, ends[i:j] - a)
            i = j
        return starts, ends, hashes, np.searchsorted(starts, offsets)

    def _hash(self, data, starts, ends):
        power, inverse = powers(len(data) + 1)
        total = np.empty(len(data) + 1, U64)
        total[0] = 0
        np.cumsum(self.table[data] * power[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


_POWERS: dict[str, list[np.ndarray]] = {}
CACHES.append(_POWERS)


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least n of each; those of SEGMENT are kept."""
    kept = SEGMENT + (1 << 16)
    if n > kept:
        return _make_powers(n)
    if "" not in _POWERS:
        _POWERS[""] = _make_powers(kept)
    return _POWERS[""]


def _make_powers(n: int) -> list[np.ndarray]:
    base = 0x9E3779B97F4A7C15
    found = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, U64)
        p[0] = 1
        found.append(np.cumprod(p, dtype=U64))
    return found


#: Words between blanks, unchanged.
PLAIN = Words([0x20, *range(0x09, 0x0E)], lower=False)
#: Runs of digits, letters and bytes of other scripts; A-Z lower-cased.
FOLDED = Words([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)


def grams(words: np.ndarray, offsets: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one row, their n + 1 offsets, and the index of their first words.

    short: a row of 1 to k - 1 words yields one gram of all its words.
    """
    count = np.diff(offsets)
    m = np.maximum(count - k + 1, 0)
    size = len(words)
    out = np.zeros(max(size - k + 1, 0), U64)
    for i in range(k):
        out += words[i : i + len(out)] * U64(2 * i + 1)
        out = (out << U64(7)) | (out >> U64(57))
    index = np.repeat(offsets[:-1], m) + ramp(m)
    hashes = mix(out[index] if len(index) else np.zeros(0, U64))
    if short and (few := (count > 0) & (count < k)).any():
        at = np.flatnonzero(few)
        extra = np.zeros(len(at), U64)
        for i in range(k - 1):
            has = count[at] > i
            extra[has] += words[offsets[:-1][at[has]] + i] * U64(2 * i + 1)
            extra = (extra << U64(7)) | (extra >> U64(57))
        m = m + few
        place = np.concatenate([[0], np.cumsum(m)])[:-1]
        whole = np.empty(int(m.sum()), U64)
        first = np.empty(len(whole), np.int64)
        mask = np.zeros(len(whole), bool)
        mask[place[at]] = True
        whole[~mask], first[~mask] = hashes, index
        whole[mask], first[mask] = mix(extra + U64(k)), offsets[:-1][at]
        hashes, index = whole, first
    return hashes, np.concatenate([[0], np.cumsum(m)]), index


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each length n, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths)
