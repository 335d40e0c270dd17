"""Operator 2: quality classifier on random-indexing word vectors.

Tokens are runs of letters, of digits or of other visible bytes. Random indexing: every token has a
sparse ternary index vector, drawn from its own hash, and a context vector, the sum of the index
vectors of its neighbours two to each side over all documents. Context vectors are kept in BUCKETS
rows, which tokens share by hash, so the table has one size whatever the vocabulary.
A document is pooled as the mean word vector over its tokens and over its distinct tokens, with the
logarithms of both counts. A two-layer network, trained in numpy, scores the pooled vector; its
logits are divided by a temperature fitted on rows that it was not trained on.

Context vectors are summed over all documents, one partial row for each bucket and task, so what
reaches the driver (BUCKETS x SIZE numbers, 8 MB) does not grow. The network is fitted on at most
FIT_ROWS labelled documents, those of smallest hash; that bound is the parameter fit_rows.

Defined results: null and empty texts pool to zeros and get that score; labels that disagree for a
document count by their mean; labels that are null are ignored; without usable labels every score
is the prior of one half; a repeated doc_id is one document, its smallest text; rows without doc_id
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.core import ODD, buffer, keyed, mixed, slices, stretch_hash, tidied

SIZE = 32
BUCKETS = 1 << 16
NONZERO = 4
WIDTH = 4 * SIZE + 2
FIT_ROWS = 20_000
HIDDEN = 32
EPOCHS = 400

_CLASS = np.full(256, 3, np.uint8)  # other visible bytes
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice, and the first token of each row."""
    base = int(offsets[0])
    data, at = data[base : int(offsets[-1])], offsets - base
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    seen = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[seen], end[seen]
    return stretch_hash(data, start, end), np.searchsorted(start, at)


def index_places(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where each token's index vector is not zero, one place in each of NONZERO parts of it, and which sign stands there."""
    width = SIZE // NONZERO
    for k in range(NONZERO):
        x = mixed(h + np.uint64(k + 1))
        yield (x % np.uint64(width)).astype(np.int64) + width * k, np.where((x >> np.uint64(40)) & np.uint64(1), 1, -1)


def index_vectors(h: np.ndarray) -> np.ndarray:
    """Ternary vectors of tokens."""
    out, row = np.zeros((len(h), SIZE), np.int32), np.arange(len(h))
    for place, sign in index_places(h):
        out[row, place] = sign
    return out


def bucket(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def context_sums(docs: DataFrame) -> np.ndarray:
    """Context vectors over all documents."""
    names = [f"c{i}" for i in range(SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros((BUCKETS, SIZE), np.int32), False
        for batch in batches:
            data, offsets = buffer(batch.column(0))
            for a, b in slices(offsets):
                h, first = tokens(data, offsets[a : b + 1])
                if not len(h):
                    continue
                used, at = True, bucket(h)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                vectors, near = index_vectors(h), np.zeros((len(at), SIZE), np.int32)
                for d in (1, 2):
                    same = (row[d:] == row[:-d])[:, None]
                    near[d:] += vectors[:-d] * same
                    near[:-d] += vectors[d:] * same
                order = np.argsort(at, kind="stable")
                edge = np.flatnonzero(np.diff(at[order], prepend=-1))
                total[at[order][edge]] += np.add.reduceat(near[order], edge, axis=0)
        if used:
            rows = np.flatnonzero(total.any(axis=1))
            yield pa.record_batch([pa.array(rows), *(pa.array(total[rows, i]) for i in range(SIZE))], ["bucket", *names])

    sums = docs.select("text").mapInArrow(tidied(run), "bucket long, " + ", ".join(f"{n} int" for n in names)).groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names))
    found, out = sums.toArrow(), np.zeros((BUCKETS, SIZE), np.float32)
    if found.num_rows:
        out[found.column("bucket").to_numpy()] = np.stack([found.column(n).to_numpy() for n in names], axis=1)
    return out


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Unit context vectors."""
    norm = np.sqrt((context**2).sum(axis=1, keepdims=True))
    return (context / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text: means of context and of index vectors over its tokens, then over its distinct tokens, and both counts."""
    out = np.zeros((len(offsets) - 1, WIDTH), np.float32)
    for a, b in slices(offsets):
        h, first = tokens(data, offsets[a : b + 1])
        n, many = np.diff(first), b - a
        row = np.repeat(np.arange(many), n)
        _, kept = np.unique(mixed(h + row.astype(np.uint64) * ODD), return_index=True)
        kept.sort()
        types = np.bincount(row[kept], minlength=many)
        for column, at, of, size in ((0, h, row, n), (2 * SIZE, h[kept], row[kept], types)):
            some = np.flatnonzero(size)
            if not len(some):
                continue
            edge = np.concatenate([[0], np.cumsum(size)])[some]
            out[a + some, column : column + SIZE] = np.add.reduceat(vectors[bucket(at)], edge, axis=0) / size[some, None]
            index = np.zeros(many * SIZE)
            for place, sign in index_places(at):
                index += np.bincount(of * SIZE + place, sign, many * SIZE)
            out[a:b, column + SIZE : column + 2 * SIZE] = index.reshape(many, SIZE) / (np.maximum(size, 1)[:, None] * np.sqrt(NONZERO))
        out[a:b, -2], out[a:b, -1] = np.log1p(n), np.log1p(types)
    return out


class Network:
    """Two layers over standardised features, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(11)
        self.mean, self.scale, self.temperature, self.constant = x.mean(axis=0), x.std(axis=0) + 1e-3, 1.0, None
        if len(np.unique(y > 0.5)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(x))
        held = order[: len(x) // 5]
        fit = order[len(x) // 5 :] if len(x) >= 50 else order
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        self.weights, xf, yf = w, x[fit].astype(np.float64), y[fit]
        for step in range(1, EPOCHS + 1):
            part = rng.choice(len(xf), min(len(xf), 2048), replace=False)
            inner = np.tanh(xf[part] @ w[0] + w[1])
            p = 1 / (1 + np.exp(-(inner @ w[2] + w[3])))
            d = (p - yf[part]) / len(part)
            back = d[:, None] * w[2] * (1 - inner**2)
            gradient = [xf[part].T @ back + 1e-4 * w[0], back.sum(axis=0), inner.T @ d + 1e-4 * w[2], np.array([d.sum()])]
            for i, g in enumerate(gradient):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g**2
                w[i] -= 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if len(held) and len(fit) < len(x):
            z, yh = self.logits(x[held]), y[held]
            loss = lambda t: np.mean(np.logaddexp(0, z / t) - yh * z / t)
            self.temperature = float(min(np.geomspace(0.25, 8, 81), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-self.logits((x - self.mean) / self.scale) / self.temperature))


def held_out() -> Column:
    """Documents of which no label is ever learnt."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (the probability that labels (doc_id, quality) would mark the document 1), then carry (columns of docs)."""
    carried, docs = keyed(docs, "text", *(c for c in carry if c != "text")), keyed(docs, "text")
    vectors = word_vectors(context_sums(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    mark = {r.doc_id: r.quality for r in known.collect()}
    spark = docs.sparkSession

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(*buffer(batch.column(1)), vectors)
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    ids = spark.createDataFrame([(i,) for i in sorted(mark)], "doc_id long")
    rows = docs.join(F.broadcast(ids), "doc_id").mapInArrow(tidied(features), "doc_id long, x binary").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(len(rows), WIDTH) if rows else np.zeros((0, WIDTH), np.float32)
    network = Network(x, np.array([mark[r.doc_id] for r in rows], np.float64)) if rows else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(*buffer(batch.column(1)), vectors)
            scores = pa.array(network.scores(x) if network else np.full(len(x), 0.5), pa.float64())
            yield pa.record_batch([batch.column(0), scores, *(batch.column(c) for c in carry)], ["doc_id", "score", *carry])

    return carried.mapInArrow(tidied(score), "doc_id long, score double" + "".join(f", `{c}` {carried.schema[c].dataType.simpleString()}" for c in carry))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: a quality score for every document; labels of every fifth are never learnt."""
    out = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
