"""Find values that occur more than once among billions, moving a few bytes for each.

Mappers turn texts into (hash, doc_id, position) entries, answer repeats inside a slice of input at
once, and send one entry for each distinct hash of the slice, packed with its neighbours into one
compressed block for each partition. A hash that stands in a third of all rows therefore reaches
its partition once for each slice, like a partial aggregate. Reducers answer with the entries that
occur again, addressed to the chunk of documents that holds them.

Rows in flight: (key int: the partition, chunk int: -1 for entries, else where an answer belongs,
blob binary: the packed entries).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.core import longs, shuffle_partitions, tidied

SCHEMA = "key int, chunk int, blob binary"
#: Input bytes (as the files have them) for each partition and chunk, at most.
PART_BYTES = 32 << 20


def parts_for(docs: DataFrame) -> int:
    """Partitions for the entries of docs: the session's number, more if the input asks for it; odd."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    estimate = math.ceil(size / PART_BYTES) if size < 1 << 60 else 0
    return max(shuffle_partitions(docs.sparkSession), estimate, 3) | 1


def chunk_of(doc: np.ndarray, chunks: int) -> np.ndarray:
    return np.mod(doc ^ (doc.view(np.uint64) >> np.uint64(17)).view(np.int64), chunks)


def chunk_column(chunks: int) -> Column:
    """chunk_of(doc_id) as a column."""
    return F.pmod(F.col("doc_id").bitwiseXOR(F.shiftrightunsigned("doc_id", 17)), F.lit(chunks)).cast("int")


def pack(doc: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns of one length, doc as differences, compressed."""
    raw = [np.array([len(doc)], np.int64), np.diff(doc, prepend=np.int64(0)), *columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in raw))


def unpack(blob: bytes, *dtypes: type) -> list[np.ndarray]:
    """doc and the columns of these types."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, out, at = int(np.frombuffer(raw, np.int64, 1)[0]), [], 8
    for dtype in (np.int64, *dtypes):
        out.append(np.frombuffer(raw, dtype, n, at))
        at += n * np.dtype(dtype).itemsize
    return [np.cumsum(out[0]), *out[1:]]


def grouped(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (h, more, doc, pos), whether each entry begins a hash there, and whether its hash has two distinct entries."""
    order = np.lexsort((pos, doc, h) if more is None else (pos, doc, more, h))
    h, doc, pos = h[order], doc[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if more is not None:
        new[1:] |= more[order[1:]] != more[order[:-1]]
    other = np.zeros(len(h), bool)
    other[1:] = ~new[1:] & ((doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]))
    first = np.flatnonzero(new)
    many = np.logical_or.reduceat(other, first) if len(first) else np.zeros(0, bool)
    return order, new, np.repeat(many, np.diff(np.append(first, len(h))))


def answers(doc: np.ndarray, pos: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    chunk = chunk_of(doc, parts)
    order = np.lexsort((pos, doc, chunk))
    chunk, doc, pos = chunk[order], doc[order], pos[order]
    edge = np.flatnonzero(np.diff(chunk, prepend=-1, append=-1))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(chunk[a]), int(chunk[a]), pack(doc[a:b], pos[a:b].astype(np.uint32))


def entries(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, parts: int, more: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Rows for a slice: its own repeats as answers, and one entry for each distinct hash.

    more: 64 further bits, which go along, so that hashes decide. Without them 32 bits of the hash
    are sent besides its partition: enough to sift, not to decide.
    """
    if not len(h):
        return
    order, new, many = grouped(h, doc, pos, more)
    yield from answers(doc[order[many]], pos[order[many]], parts)
    own = order[new]
    part = (h[own] % np.uint64(parts)).astype(np.int64)
    by = np.lexsort((pos[own], doc[own], part))
    own, part = own[by], part[by]
    h, doc, pos = h[own], doc[own], pos[own].astype(np.uint32)
    hashes = [h, more[own]] if more is not None else [(h // np.uint64(parts)).astype(np.uint32)]
    edge = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(part[a]), -1, pack(doc[a:b], *(x[a:b] for x in hashes), pos[a:b])


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    key, chunk, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(key, pa.int32()), pa.array(chunk, pa.int32()), pa.array(blob, pa.binary())], ["key", "chunk", "blob"])


def meet(rows: DataFrame, parts: int, exact: bool) -> DataFrame:
    """(chunk, blob): for each chunk of documents, the entries whose hash occurs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            mine = b.column(1).to_numpy() < 0
            got += [unpack(x.as_py(), *([np.uint64] * 2 if exact else [np.uint32]), np.uint32) for x in b.column(2).filter(pa.array(mine))]
            yield b.filter(pa.array(~mine)).select(["chunk", "blob"])
        if got:
            doc, h, *more, pos = (np.concatenate(x) for x in zip(*got, strict=True))
            got.clear()
            order, _, many = grouped(h, doc, pos, *more)
            found = [(c, blob) for _, c, blob in answers(doc[order[many]], pos[order[many]].astype(np.int64), parts)]
            if found:
                yield pa.record_batch([pa.array([c for c, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["chunk", "blob"])

    return rows.repartitionById(parts, "key").mapInArrow(tidied(run), "chunk int, blob binary")


def answered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """doc and position of all answers in a table of blobs, sorted and distinct."""
    got = [unpack(x.as_py(), np.uint32) for x in table.column("blob")]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, pos = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    return doc[new], pos[new]


def rows_of(table: pa.Table, doc: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The answered documents of a chunk: their ids, texts, and for each answer the row among them."""
    ids = longs(table.column("doc_id").combine_chunks()) if table.num_rows else np.zeros(0, np.int64)
    order = np.argsort(ids)
    wanted, inverse = np.unique(doc, return_inverse=True)
    found = order[np.searchsorted(ids[order], wanted)] if len(wanted) else np.zeros(0, np.int64)
    texts = table.column("text").combine_chunks().take(pa.array(found)) if len(found) else pa.array([], pa.string())
    return wanted, texts, inverse
