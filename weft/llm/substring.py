"""Operator 7: substring dedup by difference-cover anchors.

A window is 35 consecutive words of one document; each word that stands in a window whose word
sequence also starts anywhere else is removed. Anchors are 15-word runs at word positions whose
remainder modulo 21 lies in a difference cover: of any two equal windows, wherever they start, some
position of the first 21 is an anchor in both, so equal windows share an anchor. Anchors that occur
again (sifted by 39 and more bits of hash) give the candidate windows around them; only these are
hashed in full, twice: windows are equal if two independent 64-bit hashes of their words agree, 128
bits in all, which no set of texts of any size will see by chance.

Both matchings go through rendezvous: about a quarter of the words is sent at 7 bytes each, then
the windows of repeated passages. Texts are shuffled once, by chunk of documents, and used twice.

Defined results: null and empty texts have no words and nothing is removed; a repeated
doc_id is one document, its smallest text; rows without doc_id are left out; extra columns
are ignored; documents of any length are handled whole, one slice at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import rendezvous as rv
from weft.llm.core import Words, buffer, keyed, longs, runs, slices, tidied, tidied_group

#: Perfect difference sets: the differences of each give every remainder once. Fixed values.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
WINDOW = 35
#: Text bytes whose entries are matched among themselves before they are sent.
GATHER_BYTES = 16 << 20


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of two fifths of the window."""
    return max((p, c) for p, c in COVERS.items() if p == 3 or window - p + 1 >= 0.4 * window)


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and position of the anchors of rows that have a whole window."""
    period, cover = cover_for(window)
    length = window - period + 1
    marked = np.zeros(period, bool)
    marked[list(cover)] = True
    size = np.diff(words.first)
    position = np.arange(len(words.row)) - words.first[words.row]
    at = np.flatnonzero(marked[position % period] & (position + length <= size[words.row]) & (size[words.row] >= window))
    return runs(words.hash, length)[at], words.row[at], position[at]


def candidates(words: Words, row: np.ndarray, position: np.ndarray, window: int) -> np.ndarray:
    """Word indexes at which a window starts that contains one of the anchors (row, position)."""
    period, _ = cover_for(window)
    first, size = words.first[row], np.diff(words.first)[row]
    mark = np.zeros(len(words.row) + 1, np.int64)
    np.add.at(mark, first + np.maximum(position - period + 1, 0), 1)
    np.add.at(mark, first + np.minimum(position, size - window) + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[:-1] > 0)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, layout: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed (long) and kept (string: the kept words, joined by one space), then carry.

    layout: a document that loses nothing keeps its text as it is, blanks included. carry: columns
    of docs (other than those above) that go along.
    """
    docs = keyed(docs, "text", *carry)
    parts = rv.parts_for(docs)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, (data, offsets) = longs(batch.column(0)), buffer(batch.column(1))
            for low, high in slices(offsets, GATHER_BYTES):
                got = []
                for a, b in slices(offsets[low : high + 1]):
                    h, row, position = anchors(Words(data, offsets[low + a : low + b + 1]), window)
                    got.append((h, doc[low + a + row], position))
                yield rv.batch(list(rv.entries(*(np.concatenate(x) for x in zip(*got, strict=True)), parts)))

    def second(texts: pa.Table, found: pa.Table) -> pa.Table:
        doc, position = rv.answered(found)
        wanted, texts, inverse = rv.rows_of(texts, doc)
        data, offsets = buffer(texts)
        got = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for a, b in slices(offsets):
            words, mine = Words(data, offsets[a : b + 1]), (inverse >= a) & (inverse < b)
            at = candidates(words, inverse[mine] - a, position[mine], window)
            row = words.row[at]
            got.append((runs(words.hash, window)[at], wanted[a + row], at - words.first[row], runs(words.other(), window)[at]))
        h, doc, position, other = (np.concatenate(x) for x in zip(*got, strict=True))
        return pa.Table.from_batches([rv.batch(list(rv.entries(h, doc, position, parts, other)))])

    def last(texts: pa.Table, found: pa.Table) -> pa.Table:
        ids, (data, offsets) = longs(texts.column("doc_id").combine_chunks()), buffer(texts.column("text").combine_chunks())
        doc, position = rv.answered(found)
        row = np.argsort(ids)[np.searchsorted(np.sort(ids), doc)] if len(doc) else doc
        total, removed, kept = [], [], []
        for a, b in slices(offsets):
            words = Words(data, offsets[a : b + 1])
            mine = (row >= a) & (row < b)
            mark, at = np.zeros(len(words.row) + 1, np.int64), words.first[row[mine] - a] + position[mine]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + window, -1)
            keep = np.cumsum(mark)[:-1] == 0
            for i in range(b - a):
                own = keep[words.first[i] : words.first[i + 1]]
                gone = len(own) - int(own.sum())
                total.append(len(own))
                removed.append(gone)
                kept.append(data[offsets[a + i] : offsets[a + i + 1]].tobytes() if layout and not gone else words.kept(i, own if gone else None))
        made = [texts.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table([*made, *(texts.column(c) for c in carry)], ["doc_id", "n_words", "n_removed", "kept", *carry])

    schema = "doc_id long, n_words long, n_removed long, kept string" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    # the same exchange of texts serves both passes
    chunks = docs.withColumn("chunk", rv.chunk_column(parts)).groupBy("chunk")
    repeated = rv.meet(docs.select("doc_id", "text").mapInArrow(tidied(first), rv.SCHEMA), parts, exact=False)
    windows = chunks.cogroup(repeated.groupBy("chunk")).applyInArrow(tidied_group(second), rv.SCHEMA)
    return chunks.cogroup(rv.meet(windows, parts, exact=True).groupBy("chunk")).applyInArrow(tidied_group(last), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: for each document, its words, how many were removed, and the digest of the rest."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, hash(list_slice(ws, i, i + 34)) AS h, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS m
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), dup AS (
  SELECT h, m FROM win GROUP BY h, m HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM win JOIN dup USING (h, m), range(0, 35) AS t(k)
), word AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
