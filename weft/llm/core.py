"""What the operators share: tables cut from their lineage, and text as arrays of word hashes.

Text is handled as one byte buffer per Arrow batch. Words are maximal runs of bytes other than
0x20 and 0x09-0x0D, so word boundaries and word hashes of a whole batch come from a few numpy
passes; no Python object is made per word.

Hashes chain 8 bytes at a time through a 64-bit mixer, and runs of words are hashed as a tree of
the words' hashes, so no sum of powers can cancel. Two seeds give 128 bits where a hash decides.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.lineage import cut as cut  # the operators take it from here

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Seeds of two independent hashes.
ONE, TWO = 0x5851F42D4C957F2D, 0x14057B7EF767814F
#: Stretches of more bytes than this are hashed one by one.
LONG_STRETCH = 256
#: Texts are hashed in slices of about this many bytes, so a batch of long texts stays small.
SLICE_BYTES = 1 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id as a long and columns, one row for each doc_id; rows without a doc_id have no place in any result.

    Where a doc_id is repeated, the row whose columns sort first (null before all) is the document,
    so the order of rows never matters. Only ids are counted to see whether any is repeated.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c) for c in columns)).where("doc_id IS NOT NULL")
    again = cut(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return rows
    # merge joins at every size: no side is known to be small
    many = rows.join(again.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("row"))
    return rows.join(again.hint("merge"), "doc_id", "left_anti").unionByName(many.select("doc_id", *(F.col("row").getField(c).alias(c) for c in columns)))


def tidied(run: Callable) -> Callable:
    """run, over batches; what it used goes back to the system when a task ends."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(given)
        finally:
            given_back()

    return batches


def tidied_group(run: Callable) -> Callable:
    """The same for a function of one table, or of two, each of them large."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            given_back()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            given_back()

    return one if run.__code__.co_argcount == 1 else two


def given_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def longs(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is the empty text."""
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, size: int = SLICE_BYTES):
    """Row ranges [a, b) of about size bytes each; a longer row has a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a little-endian number; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded.data, strides=(1,))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def stretch_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = ONE) -> np.ndarray:
    """64-bit hashes of data[start:end]; of one length up to 8 bytes, no two are equal."""
    view, size = lanes(data), end - start
    with np.errstate(over="ignore"):
        out = mixed(size.astype(np.uint64) * ODD + np.uint64(seed))
    live = np.flatnonzero((size > 0) & (size <= LONG_STRETCH))
    at, left, h = start[live], size[live], out[live]
    while len(live):
        h = mixed(h ^ (view[at] & _MASKS[np.minimum(left, 8)]))
        out[live] = h
        more = left > 8
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(size > LONG_STRETCH).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two hashed stretches, one after the other."""
    with np.errstate(over="ignore"):
        return mixed(a * ODD + b)


def runs(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of values[i : i+length] for each i that has as many, by doubling."""
    if len(values) < length:
        return np.zeros(0, np.uint64)
    out, done, part, width = None, 0, values, 1
    while True:
        if length & width:
            m = len(values) - (done + width) + 1
            out = part[:m] if out is None else joined(out[:m], part[done : done + m])
            done += width
        if done == length:
            return joined(out, np.full(1, length, np.uint64))
        part, width = joined(part[:-width], part[width:]), 2 * width


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Words:
    """Words of rows of a byte buffer: hash, start and end of each, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        base = int(offsets[0])
        self.data, at = data[base : int(offsets[-1])], (offsets - base)
        n = len(self.data)
        word = ~_SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        end[:-1] &= ~word[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, at)
        self.read = _LOWER[self.data] if lower else self.data
        self.hash = stretch_hash(self.read, self.start, self.end)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def other(self) -> np.ndarray:
        """A second, independent hash of each word."""
        return stretch_hash(self.read, self.start, self.end, TWO)

    def kept(self, row: int, keep: np.ndarray | None = None) -> bytes:
        """Words of a row (those that keep marks), joined by one space."""
        a, b = self.first[row], self.first[row + 1]
        if a == b:
            return b""
        raw = self.data[self.start[a] : self.end[b - 1]].tobytes().split()
        return b" ".join(raw if keep is None else [w for w, k in zip(raw, keep.tolist(), strict=True) if k])


def remembered(key, make):
    """make(), once per Python worker process: later tasks of the same worker find it again."""
    import sys
    import types

    kept = sys.modules.setdefault("weft_worker_memory", types.ModuleType("weft_worker_memory")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
