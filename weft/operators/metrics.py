"""Evaluation of alignments, rankings and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def overlap(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of pair sets (l, r)."""
    marks = predicted.select("l", "r").distinct().withColumn("p", F.lit(1)).join(gold.select("l", "r").distinct().withColumn("g", F.lit(1)), ["l", "r"], "full_outer")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    p, g = F.col("p").isNotNull(), F.col("g").isNotNull()
    counts = marks.agg(n(p & g).alias("tp"), n(p & ~g).alias("fp"), n(~p & g).alias("fn"))
    rows = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(scored: DataFrame) -> DataFrame:
    """Binary metrics of (label, predicted), both 0 or 1."""
    n = lambda label, said: F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("predicted") == said), 1).otherwise(0)), F.lit(0))
    rows = scored.agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    sensitivity, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    mcc = ratio(tp * tn - fp * fn, F.nullif(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), F.lit(0.0)))
    return rows.select(
        "tp", "tn", "fp", "fn", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), specificity.alias("specificity"),
        ((sensitivity + specificity) / 2).alias("balanced_accuracy"), mcc.alias("mcc"), ratio(tp, tp + fp).alias("precision"), sensitivity.alias("recall"),
    )


def ranking(matches: DataFrame, gold: DataFrame, asked: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Hits@k and mean reciprocal rank over asked (left): the best rank at which a gold pair stands."""
    first = matches.join(gold.distinct(), ["left", "right"], "left_semi").groupBy("left").agg(F.min("rank").alias("best"))
    rows = asked.select("left").distinct().join(first, "left", "left")
    hits = (F.avg(F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0))).alias(f"hits_{k}") for k in ks)
    return rows.agg(*hits, F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr"))


def summary(column: str) -> list[Column]:
    """mean, population deviation, least, most and exact median."""
    return [F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("least"), F.max(column).alias("most"), F.percentile(column, 0.5).alias("median")]


def methods(pairs: DataFrame, names: tuple[str, ...] = ("cosine", "corpus", "hybrid")) -> DataFrame:
    """One row: for each method mean, population deviation, least and most of its scores, and for each two their correlation; in one pass."""
    from weft.operators.vectors import correlation

    each = (c.alias(f"{n}_{what}") for n in names for c, what in zip(summary(n)[:4], ("mean", "std", "least", "most"), strict=True))
    two = (correlation(a, b).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i + 1 :])
    return pairs.agg(F.count("*").alias("n"), *each, *two)


def score_bins(pairs: DataFrame, column: str = "score", high: float = 0.8, low: float = 0.4) -> DataFrame:
    """summary() of the scores, and how many are high, in between and low; in one pass."""
    stats = (c.alias(n) for c, n in zip(summary(column), ("mean", "std", "least", "most", "median"), strict=True))
    x = F.col(column)
    return pairs.agg(*stats, F.count_if(x >= high).alias("high"), F.count_if((x >= low) & (x < high)).alias("middle"), F.count_if(x < low).alias("low"))


def aligned_means(pairs: DataFrame, gold: DataFrame, names: tuple[str, ...] = ("cosine", "corpus", "hybrid")) -> DataFrame:
    """How many scored pairs are gold (left, right), and the mean of each method over them."""
    return pairs.join(gold.distinct(), ["left", "right"], "left_semi").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in names))


def embedding_stats(vectors: DataFrame) -> DataFrame:
    """How many vectors, their greatest dimension, mean and deviation of their lengths."""
    from weft.operators.vectors import norm

    rows = vectors.select(F.size("vector").alias("dim"), norm(F.col("vector")).alias("norm"))
    return rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim"), F.avg("norm").alias("mean_norm"), F.stddev_pop("norm").alias("std_norm"))


def vocabulary(nodes: DataFrame, fields: tuple[str, ...] = ("labels", "exact_synonyms")) -> DataFrame:
    """term and n of the lower-case names, labels and synonyms (arrays) of nodes (name, fields)."""
    said = F.concat(F.array("name"), *(F.coalesce(F.col(f), F.array().cast("array<string>")) for f in fields))
    return nodes.select(F.explode(F.transform(said, lambda x: F.lower(F.trim(x)))).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n"))
