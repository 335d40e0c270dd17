"""Operator 9: suffix-array dedup of byte strings.

Each byte that stands in a 100-byte string which also starts earlier (smaller doc_id, or the same
document and an earlier start) is removed. A suffix array of all texts would be many times their
size, so suffixes are sorted only where sorting has something to decide:

1. Of any 69 consecutive 32-byte grams the one with the smallest hash is an anchor, so equal
   100-byte strings have an anchor at the same place. Anchors meet by hash, with a 64-bit hash of
   all bytes that a 100-byte string through the anchor can touch (its context, up to 168 bytes).
   Hashes only sift here: anchors that meet bring their contexts' bytes.
2. Contexts whose bytes are equal need no sorting: all but the first lose every string through
   them. A chunk of documents compares its own and sends each distinct one once.
3. Where one gram has several contexts, one text of each context goes to the gram's partition.
   There a suffix array of the contexts is built in two stages: suffixes smaller than their
   successors are sorted directly, the others are induced by scanning the buckets of first bytes
   in order; adjacent common prefixes of 100 bytes or more then show the equal strings, and all
   but the earliest are removed.
4. A gram with more than GROUP contexts (a short boilerplate line in a third of all texts) would
   be one task's burden; the strings through its anchors are matched by 128 bits of two independent
   hashes of their 100 bytes instead, each chunk sending a distinct string once.

Texts are shuffled once, by chunk of documents, and used twice.

Defined results: null and empty texts have no bytes; fewer than 100 bytes are kept; a repeated
doc_id is one document, its smallest text; rows without doc_id are left out; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import rendezvous as rv
from weft.llm.core import ODD, TWO, buffer, keyed, lanes, longs, mixed, slices, stretch_hash, tidied, tidied_group

LENGTH = 100
GRAM = 32
GROUP = 2048
#: Text bytes whose anchors meet before they are sent, and context bytes of one suffix array, about.
GATHER_BYTES = 16 << 20
ARRAY_BYTES = 2 << 20
#: What an answer says of an anchor (bits): its context occurs again, its gram has several contexts, or very many.
SAME, SORT, HASH = 1, 2, 4


def running(x: np.ndarray, width: int, of) -> np.ndarray:
    """of (minimum or maximum) over x[i : i+width], for each i with as many."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = of(x[:-step], x[step:])
        done += step
    return x


class Bytes:
    """Rows of a byte buffer, with their anchors."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base = int(offsets[0])
        self.data, self.at = data[base : int(offsets[-1])], offsets - base

    def grams(self) -> np.ndarray:
        """32 bits for each gram; enough to choose anchors."""
        view, n, out = lanes(self.data), len(self.data) - GRAM + 1, np.uint64(0)
        with np.errstate(over="ignore"):
            for k in range(0, GRAM, 8):
                out = out * ODD + view[k : k + n]
                out ^= out >> np.uint64(29)
            return (out * ODD >> np.uint64(32)).astype(np.uint32)

    def row(self, index: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, index, "right") - 1

    def anchors(self, length: int) -> np.ndarray:
        """Indexes of the anchors of rows of at least length bytes."""
        n, span = len(self.data), length - GRAM + 1
        if n < length:
            return np.zeros(0, np.int64)
        start = np.arange(n - GRAM + 1)
        gram = self.grams()
        left = np.repeat(self.at[1:], np.diff(self.at))[: len(gram)] - start
        gram[left < GRAM] = 0xFFFFFFFF
        least = running(gram, span, np.minimum)
        least[left[: len(least)] < length] = 0
        most = running(np.concatenate([np.zeros(span - 1, np.uint32), least, np.zeros(span - 1, np.uint32)]), span, np.maximum)
        return np.flatnonzero((gram == most[: len(gram)]) & (most[: len(gram)] > 0) & (left >= GRAM))

    def contexts(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        row = self.row(at)
        return np.maximum(self.at[row], at - (length - GRAM)), np.minimum(self.at[row + 1], at + length)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text (uint8; the last symbol is 0) in the order of at least their first depth symbols."""
    n = len(text)
    end = np.flatnonzero(np.diff(text.astype(np.int16), append=-1))
    end = end[np.searchsorted(end, np.arange(n))]
    after = np.append(text, 0)[end + 1]
    smaller = text[end] < after  # than its successor
    smaller[end == n - 1] = False
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    keys = np.ascontiguousarray(sliding_window_view(padded, depth)[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    first = text[direct]
    edge = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[0].append(np.array([n - 1]))
    out = []
    for c in range(256):
        parts = waiting[c]
        wave = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        parts = [wave]
        while len(wave):
            wave = wave[wave > 0] - 1
            wave = wave[(text[wave] == c) & ~smaller[wave]]
            parts.append(wave)
        bucket = np.concatenate([*parts, direct[edge[c] : edge[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (text[before] > c)]
        symbol = text[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        cuts = np.append(np.flatnonzero(np.diff(symbol.astype(np.int16), prepend=-1)), len(symbol))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            waiting[int(symbol[a])].append(before[a:b])
        waiting[c] = []
    return np.concatenate(out)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of common prefixes of suffixes a and b, up to most."""
    padded, out = np.concatenate([text, np.zeros(most, np.uint8)]), np.empty(len(a), np.int64)
    view = sliding_window_view(padded, most)
    for i in range(0, len(a), 16384):
        other = view[a[i : i + 16384]] != view[b[i : i + 16384]]
        out[i : i + 16384] = np.where(other.any(axis=1), other.argmax(axis=1), most)
    return out


def later(group: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which entries are not the earliest (doc, pos) of their group."""
    order = np.lexsort((pos, doc, group))
    g, d, p = group[order], doc[order], pos[order]
    first = np.flatnonzero(np.diff(g, prepend=g[0] - 1 if len(g) else 0)) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(g)))
    out = np.empty(len(g), bool)
    out[order] = (d != np.repeat(d[first], size)) | (p != np.repeat(p[first], size))
    return out


def equal_strings(texts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the strings of length bytes in texts that also start earlier in them; by a suffix array."""
    text = np.frombuffer(b"\0".join(t.translate(SHIFT) for t in texts) + b"\0", np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    base = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(texts)), size)
    order = suffix_order(text, length + 4)
    order = order[base[owner[order] + 1] - 1 - order >= length]
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.cumsum(np.append(True, common_prefix(text, order[:-1], order[1:], length) < length))
    d, p = doc[owner[order]], start[owner[order]] + order - base[owner[order]]
    gone = later(group, d, p)
    return d[gone], p[gone]


#: Bytes plus one: 0 then ends a text. UTF-8 has no byte 255.
SHIFT = bytes([*range(1, 256), 255])


def spans(doc: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings (doc, pos) as stretches of following starts: doc, first byte, end."""
    if not len(doc):
        return doc, pos, pos
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    first = np.flatnonzero((np.diff(doc, prepend=doc[0] - 1) != 0) | (np.diff(pos, prepend=-9) > 1))
    last = np.append(first[1:], len(pos)) - 1
    return doc[first], pos[first], pos[last] + length


def addressed(parts: int, doc: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows for the chunks of doc."""
    chunk = rv.chunk_of(doc, parts)
    order = np.lexsort((columns[0], doc, chunk))
    chunk, edge = chunk[order], np.flatnonzero(np.diff(chunk[order], prepend=-1, append=-1))
    doc, columns = doc[order], [c[order] for c in columns]
    return [(int(chunk[a]), int(chunk[a]), rv.pack(doc[a:b], *(c[a:b] for c in columns))) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def sent(parts: int, mark: int, key: np.ndarray, doc: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows for the partitions of key."""
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((doc, part))
    part, edge = part[order], np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    doc, columns = doc[order], [c[order] for c in columns]
    return [(int(part[a]), mark, rv.pack(doc[a:b], *(c[a:b] for c in columns))) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def packed(parts: int, mark: int, raw: bytes, key: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, tag: np.ndarray, place: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows for the partitions of key: doc, tag and place of each text raw[start:end], with the texts."""
    part, rows = (key % np.uint64(parts)).astype(np.int64), []
    order = np.lexsort((tag, part))
    edge = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    for x, y in zip(edge[:-1], edge[1:], strict=True):
        i = order[x:y]
        head = rv.pack(doc[i], tag[i], place[i].astype(np.uint32), (end - start)[i].astype(np.uint16))
        text = b"".join(raw[s:e] for s, e in zip(start[i].tolist(), end[i].tolist(), strict=True))
        rows.append((int(part[i[0]]), mark, len(head).to_bytes(4, "little") + head + rv.zstandard.ZstdCompressor(level=1).compress(text)))
    return rows


def unpacked(blobs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """doc, tag, place and size of the texts of packed(), and the texts; blobs is emptied."""
    d, tag, place, size = (np.concatenate([x[i] for x in blobs]) for i in range(4))
    raw = b"".join(rv.zstandard.ZstdDecompressor().decompress(x[4]) for x in blobs)
    blobs.clear()
    return d, tag, place.astype(np.int64), size.astype(np.int64), raw


def numbered(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A number for each distinct pair."""
    order, out = np.lexsort((two, one)), np.empty(len(one), np.int64)
    out[order] = np.cumsum((np.diff(one[order], prepend=~one[order[:1]]) != 0) | (np.diff(two[order], prepend=~two[order[:1]]) != 0))
    return out


def table(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return rv.batch(rows).select(["chunk", "blob"])


def dedup_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (long), kept (binary: the remaining bytes)."""
    docs = keyed(docs, "text")
    parts = rv.parts_for(docs)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, (data, offsets) = longs(batch.column(0)), buffer(batch.column(1))
            for low, high in slices(offsets, GATHER_BYTES):
                got = []
                for a, b in slices(offsets[low : high + 1]):
                    own = Bytes(data, offsets[low + a : low + b + 1])
                    at = own.anchors(length)
                    start, end = own.contexts(at, length)
                    row = own.row(at)
                    got.append((stretch_hash(own.data, at, at + GRAM), mixed(stretch_hash(own.data, start, end) + (at - start).astype(np.uint64)), doc[low + a + row], at - own.at[row]))
                gram, context, d, p = (np.concatenate(x) for x in zip(*got, strict=True))
                order, new, many = rv.grouped(context, d, p)
                again, one = order[many], order[new]
                rows = addressed(parts, d[again], p[again].astype(np.uint32), np.full(len(again), SAME, np.uint8))
                rows += sent(parts, -1, gram[one], d[one], (gram[one] // np.uint64(parts)).astype(np.uint32), context[one], p[one].astype(np.uint32))
                yield rv.batch(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            mine = b.column(1).to_numpy() < 0
            got += [rv.unpack(x.as_py(), np.uint32, np.uint64, np.uint32) for x in b.column(2).filter(pa.array(mine))]
            yield b.filter(pa.array(~mine)).select(["chunk", "blob"])
        if not got:
            return
        d, gram, context, p = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        order = np.lexsort((p, d, context, gram))
        d, gram, context, p = d[order], gram[order], context[order], p[order]
        new_gram = np.diff(gram.astype(np.int64), prepend=-1) != 0
        new = new_gram | (np.diff(context, prepend=~context[:1]) != 0)
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        many = np.bincount(np.cumsum(new_gram) - 1, new)[np.cumsum(new_gram) - 1]
        kind = np.where(size > 1, SAME, 0) | np.where(new & (many > 1), np.where(many > GROUP, HASH, SORT), 0)
        yield table(addressed(parts, d[kind > 0], p[kind > 0], kind[kind > 0].astype(np.uint8)))

    def second(texts: pa.Table, found: pa.Table) -> pa.Table:
        got = [rv.unpack(x.as_py(), np.uint32, np.uint8) for x in found.column("blob")]
        if not got:
            return pa.Table.from_batches([rv.batch([])])
        d, p, kind = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((p, d))
        d, p, kind = d[order], p[order].astype(np.int64), kind[order]
        one = np.flatnonzero((np.diff(d, prepend=d[0] - 1) != 0) | (np.diff(p, prepend=-1) != 0))
        d, p, kind = d[one], p[one], np.bitwise_or.reduceat(kind, one)
        wanted, texts, inverse = rv.rows_of(texts, d)
        data, offsets = buffer(texts)
        rows, hashes, seen = [], [], set()
        for a, b in slices(offsets):
            own, mine = Bytes(data, offsets[a : b + 1]), np.flatnonzero((inverse >= a) & (inverse < b))
            at = own.at[inverse[mine] - a] + p[mine]
            start, end = own.contexts(at, length)
            base = own.at[inverse[mine] - a]
            raw = own.data.tobytes()
            same, later_ones, first_ones = np.flatnonzero(kind[mine] & SAME), [], []
            for i, o, s, e in zip(same.tolist(), (at - start)[same].tolist(), start[same].tolist(), end[same].tolist(), strict=True):
                context = (o, raw[s:e])
                (later_ones if context in seen else first_ones).append(i)
                seen.add(context)
            gone = np.array(later_ones, np.int64)
            rows += addressed(parts, d[mine[gone]], (start - base)[gone].astype(np.uint32), (end - base)[gone].astype(np.uint32))
            i = np.array(first_ones, np.int64)
            rows += packed(parts, -3, raw, stretch_hash(own.data, start[i], end[i]), start[i], end[i], d[mine[i]], (at - start)[i].astype(np.uint64), (start - base)[i])
            i = np.flatnonzero(kind[mine] & SORT)
            gram = stretch_hash(own.data, at[i], at[i] + GRAM)
            rows += packed(parts, -2, raw, gram, start[i], end[i], d[mine[i]], gram, (start - base)[i])
            hot = np.flatnonzero(kind[mine] & HASH)
            mark = np.zeros(len(own.data) + 1, np.int64)
            np.add.at(mark, start[hot], 1)
            np.add.at(mark, end[hot] - length + 1, -1)
            at = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            row = own.row(at)
            hashes.append((stretch_hash(own.data, at, at + length), stretch_hash(own.data, at, at + length, TWO), wanted[a + row], at - own.at[row]))
        h, other, hd, hp = (np.concatenate(x) for x in zip(*hashes, strict=True))
        gone = later(numbered(h, other), hd, hp)
        sd, s, e = spans(hd[gone], hp[gone], length)
        rows += addressed(parts, sd, s.astype(np.uint32), e.astype(np.uint32))
        rows += sent(parts, -1, h[~gone], hd[~gone], h[~gone], other[~gone], hp[~gone].astype(np.uint32))
        return pa.Table.from_batches([rv.batch(rows)])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, sorted_, same = [], [], []
        for b in batches:
            kind = b.column(1).to_numpy()
            hashed += [rv.unpack(x.as_py(), np.uint64, np.uint64, np.uint32) for x in b.column(2).filter(pa.array(kind == -1))]
            for mark, into in ((-2, sorted_), (-3, same)):
                for x in b.column(2).filter(pa.array(kind == mark)):
                    blob = x.as_py()
                    size = int.from_bytes(blob[:4], "little")
                    into.append((*rv.unpack(blob[4 : 4 + size], np.uint64, np.uint32, np.uint16), blob[4 + size :]))
            yield b.filter(pa.array(kind >= 0)).select(["chunk", "blob"])
        if hashed:
            d, h, other, p = (np.concatenate(x) for x in zip(*hashed, strict=True))
            gone = later(numbered(h, other), d, p.astype(np.int64))
            d, s, e = spans(d[gone], p[gone].astype(np.int64), length)
            yield table(addressed(parts, d, s.astype(np.uint32), e.astype(np.uint32)))
        if same:
            d, at, start, size, raw = unpacked(same)
            base, seen, gone = np.concatenate([[0], np.cumsum(size)]), set(), []
            order = np.lexsort((start, d))
            for i, o, s, e in zip(order.tolist(), at[order].tolist(), base[order].tolist(), base[order + 1].tolist(), strict=True):
                context = (o, raw[s:e])
                if context in seen:
                    gone.append(i)
                seen.add(context)
            gone = np.array(gone, np.int64)
            yield table(addressed(parts, d[gone], start[gone].astype(np.uint32), (start + size)[gone].astype(np.uint32)))
        if sorted_:
            d, gram, start, size, raw = unpacked(sorted_)
            base = np.concatenate([[0], np.cumsum(size)])
            order = np.argsort(gram, kind="stable")
            # whole grams, about ARRAY_BYTES of contexts at a time
            ends = np.flatnonzero(np.append(np.diff(gram[order]) != 0, True)) + 1
            upto = np.cumsum(size[order])[ends - 1]
            cuts = np.unique(np.append(ends[np.searchsorted(upto, np.arange(ARRAY_BYTES, upto[-1], ARRAY_BYTES), "right").clip(max=len(ends) - 1)], ends[-1]))
            for x, y in zip(np.append(0, cuts[:-1]), cuts, strict=True):
                i = order[x:y]
                gd, gp = equal_strings([raw[base[k] : base[k + 1]] for k in i.tolist()], d[i], start[i], length)
                gd, s, e = spans(gd, gp, length)
                yield table(addressed(parts, gd, s.astype(np.uint32), e.astype(np.uint32)))

    def last(texts: pa.Table, found: pa.Table) -> pa.Table:
        ids, (data, offsets) = longs(texts.column("doc_id").combine_chunks()), buffer(texts.column("text").combine_chunks())
        got = [rv.unpack(x.as_py(), np.uint32, np.uint32) for x in found.column("blob")]
        d, s, e = (np.concatenate(x).astype(np.int64) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
        row = np.argsort(ids)[np.searchsorted(np.sort(ids), d)] if len(d) else d
        order = np.argsort(row, kind="stable")
        row, s, e = row[order], s[order], e[order]
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        total, removed, count, kept = np.diff(offsets), [], [], []
        for i in range(len(ids)):
            own = data[offsets[i] : offsets[i + 1]]
            if at[i] == at[i + 1]:
                removed.append(0)
                count.append(0)
                kept.append(own.tobytes())
                continue
            mark = np.zeros(len(own) + 1, np.int64)
            np.add.at(mark, s[at[i] : at[i + 1]], 1)
            np.add.at(mark, e[at[i] : at[i + 1]], -1)
            gone = np.cumsum(mark)[:-1] > 0
            removed.append(int(gone.sum()))
            count.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            kept.append(own[~gone].tobytes())
        return pa.table([texts.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    # the same exchange of texts serves both passes
    chunks = docs.withColumn("chunk", rv.chunk_column(parts)).groupBy("chunk")
    met = docs.mapInArrow(tidied(first), rv.SCHEMA).repartitionById(parts, "key").mapInArrow(tidied(meet), "chunk int, blob binary")
    opened = chunks.cogroup(met.groupBy("chunk")).applyInArrow(tidied_group(second), rv.SCHEMA)
    decided = opened.repartitionById(parts, "key").mapInArrow(tidied(decide), "chunk int, blob binary")
    return chunks.cogroup(decided.groupBy("chunk")).applyInArrow(tidied_group(last), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: for each document, its bytes, how many went in how many runs, and the digest of the rest."""
    out = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
), mark AS (
  SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM dup
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM mark GROUP BY doc_id, g
), ends AS (
  SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs
), spans AS (
  SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(CASE WHEN before >= a THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a) AS n FROM ends) GROUP BY doc_id, n
), gaps AS (
  SELECT doc_id, b AS a, lead(a, 1, 2000000000) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
), gone AS (
  SELECT doc_id, sum(b - a) AS n, count(*) AS m FROM spans GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(m, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
