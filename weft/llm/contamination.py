"""Operator 4: benchmark decontamination by CGK embeddings and bit-sampling LSH.

Texts and items are words with A-Z in lower case; an item is in a document if some run of the
document's words is within floor((1 - similarity) * words) word edits of it.

Item-sized windows are embedded by random walks (step j copies the current word and advances if a
random function of j and the word says so), which turns edit distance into Hamming distance; then
tables of a few sampled positions are looked up. There are as many tables as bring a window that
agrees with its item at half of the positions to the target recall. Windows are embedded only where
they can matter: an item of w words within k edits keeps a run of floor(w / (k+1)) words intact, so
windows stand on the diagonals, give or take k, of such runs. Each candidate is verified by the
exact edit distance of the item to any run of words there.

Items go to every executor, in blocks of about BLOCK_BYTES of text whose index is some five times
as large; documents are read once for each block and nothing is shuffled.

Defined results: null or empty texts and items match nothing; a repeated doc_id is one document, its
smallest text; a repeated item_id gives a row for each document that holds any of its texts; rows without an id are left out; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.core import Words, buffer, cut, keyed, longs, mixed, runs, slices, tidied

SIMILARITY = 0.8
RECALL = 0.99
SAMPLED = 4
WALKS = 12
LONGEST_RUN = 4
BLOCK_BYTES = 4 << 20


def tables_for(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - 0.5**SAMPLED))


def embedded(windows: np.ndarray, seed: int) -> np.ndarray:
    """CGK embedding of rows of word hashes: three steps for each word."""
    n, width = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    factors = np.random.default_rng(seed).integers(0, 1 << 63, 3 * width, np.uint64) * np.uint64(2) + np.uint64(1)
    out, at, rows = np.empty((n, 3 * width), np.uint64), np.zeros(n, np.int64), np.arange(n)
    with np.errstate(over="ignore"):
        for j in range(3 * width):
            word = padded[rows, at]
            out[:, j] = word
            at = np.minimum(at + ((word * factors[j]) >> np.uint64(63)).astype(np.int64), width)
    return out


def sampled_keys(windows: np.ndarray, recall: float) -> np.ndarray:
    """A key for each row and table."""
    n, width = windows.shape
    per_walk = math.ceil(tables_for(recall) / WALKS)
    keys = np.empty((n, WALKS * per_walk), np.uint64)
    for walk in range(WALKS):
        seed = 1000 * width + walk
        walked, rng = embedded(windows, seed), np.random.default_rng(seed + 500)
        for k in range(per_walk):
            key = np.full(n, walk * per_walk + k, np.uint64)
            for j in rng.integers(0, 3 * width, SAMPLED):
                with np.errstate(over="ignore"):
                    key = mixed(key * np.uint64(0x100000001B3) + walked[:, j])
            keys[:, walk * per_walk + k] = key
    return keys


def best_fit(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """The least word edits between item and any run of words, and where that run ends."""
    row = np.zeros(len(words) + 1, np.int64)
    ramp = np.arange(len(words) + 1)
    for i, w in enumerate(item.tolist()):
        change = np.empty_like(row)
        change[0] = i + 1
        np.minimum(row[:-1] + (words != w), row[1:] + 1, out=change[1:])
        row = np.minimum.accumulate(change - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [low, high): which range each of their numbers is of, and the numbers, one after another."""
    size = np.maximum(high - low, 0)
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


class Lookup:
    """Values by 64-bit key: two sorted arrays, 12 bytes an entry."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order].astype(np.int32)
        bits = min(20, len(keys).bit_length() + 4)  # a sift of sixteen places an entry and more, up to a megabyte
        self.shift, self.seen = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of keys are known, once for each value, and the values."""
        hit = np.flatnonzero(self.seen[(keys >> self.shift).astype(np.int64)])
        of, at = spread(np.searchsorted(self.keys, keys[hit], "left"), np.searchsorted(self.keys, keys[hit], "right"))
        return hit[of], self.values[at].astype(np.int64)


class Items:
    """A block of items, ready to be looked up; arrays only, so it travels and stays small."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float, recall: float):
        raw = [t.encode() for t in texts]
        words = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), lower=True)
        self.recall, self.ids, self.hash, self.first = recall, np.array(ids, np.int64), words.hash, words.first
        self.width = np.diff(words.first)
        self.edits = np.floor((1 - similarity) * self.width + 1e-9).astype(np.int64)
        run = np.minimum(LONGEST_RUN, np.maximum(1, self.width // (self.edits + 1)))
        self.grams: list[tuple[int, Lookup]] = []
        self.tables: dict[int, Lookup] = {}
        for length in np.unique(run[self.width > 0]).tolist():
            whole = runs(self.hash, length)
            # a gram is known by its place among all items' words
            _, place = spread(self.first[:-1][run == length], (self.first[1:] - length + 1)[run == length])
            self.grams.append((length, Lookup(whole[place], place)))
        for width in np.unique(self.width[self.width > 0]).tolist():
            mine = np.flatnonzero(self.width == width)
            keys = sampled_keys(self.hash[self.first[mine][:, None] + np.arange(width)], recall)
            self.tables[width] = Lookup(keys.ravel(), np.repeat(mine, keys.shape[1]))

    def starts(self, words: Words) -> np.ndarray:
        """Rows (width, row, start) of the windows to embed: those on the diagonals, give or take the item's edits, of its intact runs."""
        got = [np.zeros((0, 3), np.int64)]
        for length, known in self.grams:
            at, place = known.find(runs(words.hash, length))
            inside = words.row[at] == words.row[at + length - 1]
            at, place = at[inside], place[inside]
            item = np.searchsorted(self.first, place, "right") - 1
            found = np.unique(np.stack([item, words.row[at], at - (place - self.first[item])], 1), axis=0)
            item, row, start = found.T
            of, s = spread(np.maximum(start - self.edits[item], words.first[row]), np.minimum(start + self.edits[item] + 1, words.first[row + 1]))
            got.append(np.stack([self.width[item][of], row[of], s], 1))
        return np.unique(np.concatenate(got), axis=0)

    def found(self, words: Words) -> list[tuple[int, int, int, int]]:
        """(row, item, edits, end) of the best fit of each item in each row that holds it."""
        places, out = self.starts(words), {}
        cuts = np.flatnonzero(np.diff(places[:, 0], prepend=-1, append=-1))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            width, pairs = int(places[low, 0]), []
            for part in range(low, high, 8192):
                row, start = places[part : min(high, part + 8192), 1:].T
                index = start[:, None] + np.arange(width)
                windows = np.where(index < words.first[row + 1][:, None], words.hash[np.minimum(index, len(words.hash) - 1)], np.uint64(0))
                keys = sampled_keys(windows, self.recall)
                at, item = self.tables[width].find(keys.ravel())
                at //= keys.shape[1]
                pairs.append(np.stack([row[at], item, start[at]], 1))
            candidates = np.unique(np.concatenate(pairs), axis=0)
            if not len(candidates):  # no window met its item in any table
                continue
            group = np.flatnonzero((np.diff(candidates[:, 0], prepend=-1) != 0) | (np.diff(candidates[:, 1], prepend=-1) != 0))
            for a, b in zip(group.tolist(), [*group[1:].tolist(), len(candidates)], strict=True):
                r, i = candidates[a, :2].tolist()
                where, k, item = candidates[a:b, 2], int(self.edits[i]), self.hash[self.first[i] : self.first[i + 1]]
                begin = np.flatnonzero(np.diff(where, prepend=-1 - 2 * width) > width)
                for x, y in zip(where[begin].tolist(), where[np.append(begin[1:], len(where)) - 1].tolist(), strict=True):
                    left, right = max(int(words.first[r]), x - k), min(int(words.first[r + 1]), y + width + k)
                    edits, end = best_fit(item, words.hash[left:right])
                    if edits <= k:
                        out[r, i] = min(out.get((r, i), (edits, 1 << 60)), (edits, int(left + end - words.first[r])))
        return [(r, i, *x) for (r, i), x in out.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, edits and end_word of each item that a document holds."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = max(1, math.ceil(size / BLOCK_BYTES)), None
    schema, texts = "doc_id long, item_id long, edits int, end_word long", keyed(docs, "text")
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        ready = Items([r.item_id for r in rows], [r.text for r in rows], similarity, recall)

        def run(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, (data, offsets) = longs(batch.column(0)), buffer(batch.column(1))
                rows = [(doc[a + r], int(ready.ids[i]), edits, end) for a, b in slices(offsets) for r, i, edits, end in ready.found(Words(data, offsets[a : b + 1], lower=True))]
                columns = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "edits", "end_word"])

        part = texts.mapInArrow(tidied(run), schema)
        if blocks > 1:  # a block's index is not kept beyond its scan
            part = cut(part, "hits")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "end_word")).alias("best")).select("doc_id", "item_id", "best.edits", "best.end_word")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: each benchmark item that a document holds within a fifth of its words."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
