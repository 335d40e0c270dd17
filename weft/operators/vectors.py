"""Exact vector search and pair scores.

Single searches stay in expressions and end in a bounded top-k. Searches of many against many go in
blocks: each block of one side meets each block of the other in one task, as a matrix product, and
only the best k of each query leave the task, so no pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.lineage import cut

EPSILON = 1e-9
BLOCK_ROWS = 2048
STRIPE_ROWS = 256  # of a block, whose scores are in memory at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def search(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest (id, score) to one vector; ties by id."""
    if k < 0:
        raise ValueError("k must not be negative")
    return vectors.select("id", cosine(F.col("vector"), literal(query)).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def fused(scores: list[Column], how: str, weights: list[float] | None = None) -> Column:
    """One score from those of several queries: max, mean, sum or weighted; an unknown name means max, weights of another number mean uniform."""
    n = len(scores)
    if how == "weighted":
        weights = weights if weights is not None and len(weights) == n else [1.0] * n
        total = sum(weights) + EPSILON
        return sum((s * (w / total) for s, w in zip(scores, weights, strict=True)), F.lit(0.0))
    if how in ("mean", "sum"):
        return sum(scores, F.lit(0.0)) / (n if how == "mean" else 1)
    return F.greatest(*scores) if n > 1 else scores[0]


def search_many(vectors: DataFrame, queries: list[list[float]], k: int, how: str = "max", weights: list[float] | None = None) -> DataFrame:
    """The k best by the fused score of several query vectors."""
    score = fused([cosine(F.col("vector"), literal(q)) for q in queries], how, weights)
    return vectors.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def upserted(old: DataFrame, new: DataFrame, dimension: int) -> DataFrame:
    """old with the rows of new in place of those of the same id; other dimensions are an error when read."""
    checked = new.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")).otherwise(F.raise_error(F.lit("wrong dimension"))))
    return old.join(new.select("id"), "id", "left_anti").unionByName(checked)


def best_matches(left: DataFrame, right: DataFrame, k: int | None, least: float | None = None, upper: bool = False, digits: int | None = None) -> DataFrame:
    """(left, right, score, rank): the k best right ids of each left id; ties by right id.

    upper: only pairs with right > left, for a table against itself. Blocks are then ranges of ids, and a block meets only those
    that do not lie below it, which is half the work.

    Each side is dealt into blocks of BLOCK_ROWS once, packed as rows of 4-byte numbers and cut; tasks read the blocks that meet from
    there (a Cartesian product), so what is shuffled and written grows with the input, not with the pairs of blocks. The left side
    comes in stripes of a block, dealt evenly; a task holds the blocks of one file split, a stripe's scores and a best-k list.
    digits: scores are rounded, halves away from zero.
    """
    blocks = lambda n: max(1, math.ceil(n / BLOCK_ROWS))
    n_left, n_right = blocks(left.count()), blocks(right.count())
    by_hash = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    own_left, own_right = by_hash(n_left), by_hash(n_right)
    if upper and max(n_left, n_right) > 1:
        n_left = n_right = max(n_left, n_right)
        edges = right.select(F.percentile_approx("id", [i / n_right for i in range(1, n_right)], 10_000)).first()[0]
        own_left = own_right = F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in edges)), lambda e: e < F.col("id")))
    pack = lambda df, own: df.select("id", "vector", own.cast("int").alias("own")).groupBy("own").applyInArrow(_packed, "own int, ids binary, rows binary")
    a = cut(pack(left, own_left), "blocks")
    b = a if upper and left.sameSemantics(right) else cut(pack(right, own_right), "blocks")
    a, b = (df.select(F.col("own").alias(f"own_{c}"), F.col("ids").alias(f"ids_{c}"), F.col("rows").alias(f"rows_{c}")) for df, c in ((a.mapInArrow(_striped, a.schema), "x"), (b, "y")))
    a = a.repartition(min(n_left * -(-BLOCK_ROWS // STRIPE_ROWS), 4 * left.sparkSession.sparkContext.defaultParallelism), F.xxhash64("ids_x"))
    meets = F.col("own_y") >= F.col("own_x") if upper else F.lit(True)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ix, rx, iy, ry in zip(*(batch.column(c) for c in range(4)), strict=True):
                ids_x, ids_y = np.frombuffer(ix.as_py(), np.int64), np.frombuffer(iy.as_py(), np.int64)
                yield _met(ids_x, _unit(rx.as_py(), len(ids_x)), ids_y, _unit(ry.as_py(), len(ids_y)), k, least, upper, digits)

    met = a.join(b.hint("shuffle_replicate_nl"), meets).select("ids_x", "rows_x", "ids_y", "rows_y").mapInArrow(meet, "left long, right long, score double")
    if k is None:
        return met
    rank = F.row_number().over(W.partitionBy("left").orderBy(F.desc("score"), "right"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def _packed(rows: pa.Table) -> pa.Table:
    """A block's ids in order and its vectors, as bytes."""
    ids = rows.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    flat = rows.column("vector").combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(flat), -1)[order]
    return pa.table([pa.array([rows.column("own")[0].as_py()], pa.int32()), pa.array([ids[order].astype(np.int64).tobytes()]), pa.array([x.tobytes()])], ["own", "ids", "rows"])


def _striped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in stripes of STRIPE_ROWS vectors."""
    for batch in batches:
        for own, ids, rows in zip(*batch.columns, strict=True):
            ids, rows = ids.as_py(), rows.as_py()
            n = -(-len(ids) // (8 * STRIPE_ROWS))
            wide = len(rows) // (len(ids) // 8) * STRIPE_ROWS
            yield pa.record_batch([pa.array([own.as_py()] * n, pa.int32()), pa.array([ids[i * 8 * STRIPE_ROWS : (i + 1) * 8 * STRIPE_ROWS] for i in range(n)]), pa.array([rows[i * wide : (i + 1) * wide] for i in range(n)])], ["own", "ids", "rows"])


def _rounded(score: np.ndarray, digits: int | None) -> np.ndarray:
    if digits is None:
        return score
    scaled = score * 10.0**digits
    whole = np.trunc(scaled)
    return (whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)) / 10.0**digits + 0.0


def _unit(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(raw, np.float32).astype(np.float64).reshape(n, -1)
    return x / (np.sqrt((x**2).sum(axis=1, keepdims=True)) + EPSILON)


def _met(ids_x: np.ndarray, x: np.ndarray, ids_y: np.ndarray, y: np.ndarray, k: int | None, least: float | None, upper: bool, digits: int | None = None) -> pa.RecordBatch:
    """The k best (None: all, in the order of ids) of y for each of x; ids_y in order, so ties go to the smaller."""
    score = x @ y.T
    fit = np.ones(score.shape, bool) if least is None else score >= least
    if upper:
        fit &= ids_y[None, :] > ids_x[:, None]
    if k is None:
        i, j = np.nonzero(fit & (score > -np.inf))
        return pa.record_batch([pa.array(ids_x[i]), pa.array(ids_y[j]), pa.array(_rounded(score[i, j], digits))], ["left", "right", "score"])
    score = np.where(fit, score, -np.inf)
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(ids_x)), best.shape[1])
    found = score[row, best.ravel()]
    keep = found > -np.inf
    return pa.record_batch([pa.array(ids_x[row][keep]), pa.array(ids_y[best.ravel()][keep]), pa.array(_rounded(found[keep], digits))], ["left", "right", "score"])


def pair_scores(left: DataFrame, right: DataFrame, least: float | None = None, upper: bool = False, digits: int | None = None) -> DataFrame:
    """(left, right, score) of all pairs, which are the result; in blocks, as best_matches()."""
    return best_matches(left, right, None, least, upper, digits)


def fused_search(vectors: DataFrame, queries: DataFrame, k: int, how: str = "max") -> DataFrame:
    """The k best (id, score) by the fused score of any number of queries (id, vector and, if weighted, weight).

    Scores are cosines, so their sum, mean and weighted mean are the scores of one vector, the sum of the unit queries; it is all
    that reaches the driver. The maximum is taken over blocks.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    if how not in ("mean", "sum", "weighted"):
        best = best_matches(vectors.select("id", "vector"), queries.select("id", "vector"), 1)
        return best.select(F.col("left").alias("id"), "score").orderBy(F.desc("score"), "id").limit(k)
    weight = F.col("weight").cast("double") if how == "weighted" and "weight" in queries.columns else F.lit(1.0)
    unit = F.transform("vector", lambda x: x.cast("double") / (norm(F.col("vector")) + EPSILON))
    parts = queries.select(weight.alias("w"), F.posexplode(unit).alias("i", "x"))
    sums = parts.groupBy("i").agg(F.sum(F.col("w") * F.col("x")).alias("x"), F.sum("w").alias("w"), F.count("*").alias("n")).orderBy("i").collect()
    scale = {"sum": 1.0, "mean": 1.0 / sums[0].n, "weighted": 1.0 / (sums[0].w + EPSILON)}[how] if sums else 0.0
    whole = literal([r.x * scale for r in sums])
    score = dot(F.col("vector"), whole) / (norm(F.col("vector")) + EPSILON)
    return vectors.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def indexed(old: DataFrame | None, new: DataFrame, dimension: int) -> DataFrame:
    """(id, vector, position) after an upsert: known ids keep their positions, new ones follow in the order of id."""
    if old is None:
        return positions(new.select("id", "vector"), [F.col("id")], "position")
    kept = upserted(old.select("id", "vector"), new.select("id", "vector"), dimension).join(old.select("id", "position"), "id", "left")
    fresh = positions(kept.where("position IS NULL").select("id", "vector"), [F.col("id")], "position")
    last = old.agg(F.coalesce(F.max("position"), F.lit(0)).alias("last"))
    fresh = fresh.crossJoin(F.broadcast(last)).select("id", "vector", (F.col("position") + F.col("last")).alias("position"))  # one row: a constant
    return kept.where("position IS NOT NULL").unionByName(fresh)


def missing(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that have no vector yet."""
    return ids.select("id").distinct().join(vectors.where("vector IS NOT NULL").select("id"), "id", "left_anti")


def best_pairs(left: DataFrame, right: DataFrame, k: int, least: float | None = None, upper: bool = False) -> DataFrame:
    """The k best pairs overall: they are among the k best of their left ids."""
    return best_matches(left, right, k, least, upper).select("left", "right", "score").orderBy(F.desc("score"), "left", "right").limit(k)


def fuse(graph: Column, text: Column, alpha: float = 0.5) -> Column:
    """Elementwise alpha * graph + (1 - alpha) * text."""
    return F.zip_with(graph, text, lambda x, y: x.cast("double") * alpha + y.cast("double") * (1 - alpha))


def ngd(fx: Column, fy: Column, fxy: Column, n: Column, least: int = 1) -> Column:
    """Normalised corpus distance in [0, 1]; 1 where a count is too small or the denominator is not positive."""
    x, y, both = (F.log(c.cast("double")) for c in (fx, fy, fxy))
    below = F.log(n.cast("double")) - F.least(x, y)
    raw = (F.greatest(x, y) - both) / F.when(below > 0, below)
    few = (fx < least) | (fy < least) | (fxy < least)
    return F.when(few, 1.0).otherwise(F.coalesce(clamped(raw), F.lit(1.0)))


def corpus_distances(words: DataFrame, asked: DataFrame, total: int, least: int = 1) -> DataFrame:
    """(a, b, distance) of asked terms (term) with every term that stands in a document with them; words: distinct (doc_id, term).

    Counts of single terms are made once. A document's asked terms are gathered (they are as few as asked) and meet its words by the
    document, so work grows with words times asked terms, not with pairs of words.
    """
    seen = cut(words, "words")
    counts = cut(seen.groupBy("term").agg(F.count("*").alias("n")), "counts")
    mine = seen.join(F.broadcast(asked.select("term")), "term").groupBy("doc_id").agg(F.collect_set("term").alias("mine"))  # asked: the caller's query set
    pairs = seen.join(mine, "doc_id").select(F.explode("mine").alias("a"), F.col("term").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    of = lambda c: counts.select(F.col("term").alias(c), F.col("n").alias(f"n_{c}"))
    rows = pairs.join(of("b"), "b").join(of("a"), "a")
    return rows.select("a", "b", ngd(F.col("n_a"), F.col("n_b"), F.col("n"), F.lit(total), least).alias("distance"))


def hybrid(cos: Column, corpus: Column, weight: float) -> Column:
    return cos * (1 - weight) + corpus * weight


def google_index(distance: Column) -> Column:
    """The likeness that a corpus distance leaves, in [0, 1]; 0 where there is none."""
    return F.coalesce(clamped(1 - distance), F.lit(0.0))


def all_scores(pairs: DataFrame, weight: float = 0.5) -> DataFrame:
    """pairs (score: a cosine, corpus: a likeness) with cosine, corpus and hybrid; weight, in [0, 1], is the corpus's."""
    if not 0 <= weight <= 1:
        raise ValueError("the weight must be between 0 and 1")
    rows = pairs.withColumn("cosine", clamped(F.col("score"))).withColumn("corpus", clamped(F.col("corpus").cast("double")))
    return rows.withColumn("hybrid", hybrid(F.col("cosine"), F.col("corpus"), weight)).drop("score")


def positions(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their position, from 1, in an order over all of them, without bringing them to one task: rows are dealt by ranges of the
    order, numbered in each, and the sizes of the ranges before are added (one number for each range).
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return within.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("int")).drop("_part", "_at", "_before")


def ranked(pairs: DataFrame) -> DataFrame:
    """Three positions of each pair (seq, cosine, corpus, hybrid); ties keep the order of the ranking before."""
    rows = positions(pairs, [F.desc("cosine"), F.col("seq")], "cosine_rank")
    rows = positions(rows, [F.desc("corpus"), F.col("cosine_rank")], "corpus_rank")
    return positions(rows, [F.desc("hybrid"), F.col("corpus_rank")], "hybrid_rank")


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null where a column does not vary."""
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
