"""Normalisation and deterministic scores of (source, relation, target) tuples, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.predicates import mapped

# Relation aliases, and the weight of each relation in a score.
ALIASES = {
    "is_a": "isA", "is-a": "isA", "type": "isA", "sub_class_of": "subClassOf", "sub-class-of": "subClassOf", "same_as": "sameAs",
    "same-as": "sameAs", "identical": "sameAs", "has_property": "hasProperty", "has-property": "hasProperty",
}
WEIGHTS = {"isa": 0.9, "subclassof": 0.9, "instanceof": 0.8, "hasproperty": 0.7, "relatedto": 0.6, "sameas": 0.95, "equivalentto": 0.95, "similarto": 0.8}

#: A rewrite: (priority, condition, {column: new value}); higher priorities run first.
Rewrite = tuple[int, Column, dict[str, Column]]


def relation_name(relation: Column) -> Column:
    known = F.lower(relation)
    return F.when(known.isin(*ALIASES), mapped(known, ALIASES)).otherwise(relation)


def concept_name(name: Column) -> Column:
    """Underscores to blanks, one blank between words, each word capitalised."""
    return F.initcap(F.trim(F.regexp_replace(F.translate(name, "_", " "), r"\s+", " ")))


def rewritten(tuples: DataFrame, rewrites: Sequence[Rewrite]) -> DataFrame:
    """Rewrites one after another, by descending priority."""
    for _, condition, values in sorted(rewrites, key=lambda r: -r[0]):
        tuples = tuples.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})
    return tuples


def normalized(tuples: DataFrame, extra: Sequence[Rewrite] = ()) -> DataFrame:
    default = [
        (20, F.lit(True), {"relation": relation_name(F.col("relation"))}),
        (10, F.lit(True), {"source": concept_name(F.col("source")), "target": concept_name(F.col("target"))}),
    ]
    return rewritten(tuples, [*default, *extra])


def semantic_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the word sets, 0.3 more where one text contains the other, at most 1; 1 for equal texts."""
    x, y = F.lower(a), F.lower(b)
    words = lambda t: F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")
    u, v = words(x), words(y)
    overlap = F.size(F.array_intersect(u, v)) / F.greatest(F.size(F.array_union(u, v)), F.lit(1))
    bonus = F.when(F.contains(x, y) | F.contains(y, x), 0.3).otherwise(0.0)
    return F.when(x == y, 1.0).when((F.size(u) == 0) | (F.size(v) == 0), 0.0).otherwise(F.least(F.lit(1.0), overlap + bonus))


def evaluated(tuples: DataFrame) -> DataFrame:
    """With semantic, graph, confidence and overall scores."""
    key = F.lower("relation")
    weight = F.lit(0.5)
    for name, value in WEIGHTS.items():
        weight = F.when(key == name, value).otherwise(weight)
    rows = tuples.withColumn("semantic", semantic_similarity(F.col("source"), F.col("target"))).withColumn("_w", weight)
    same = key.isin("sameas", "equivalentto") & (F.col("semantic") > 0.8)
    kind = key.isin("isa", "subclassof") & (F.col("semantic") > 0.5)
    rows = rows.withColumn("graph", F.when(same, F.least(F.lit(1.0), F.col("_w") + 0.1)).when(kind, F.col("_w")).otherwise(F.col("_w") * 0.8)).drop("_w")
    agree = F.greatest(F.lit(0.0), 1 - F.abs(F.col("semantic") - F.col("graph")))
    length = F.least(F.lit(1.0), (F.length("source") + F.length("target")) / 20)
    rows = rows.withColumn("confidence", F.least(F.lit(1.0), ((F.col("semantic") + F.col("graph")) / 2 + agree + length) / 3))
    base = 0.6 * F.col("semantic") + 0.4 * F.col("graph")
    return rows.withColumn("overall", F.least(F.lit(1.0), base * (0.5 + 0.5 * F.col("confidence"))))


def statistics(scored: DataFrame) -> DataFrame:
    """One row: count, means, population deviation and shares of high scores; zeros for an empty table."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scored.agg(
        F.count("*").alias("n"),
        zero(F.avg("overall")).alias("mean_score"),
        zero(F.stddev_pop("overall")).alias("score_stddev"),
        zero(F.avg("confidence")).alias("mean_confidence"),
        zero(F.avg((F.col("confidence") > 0.7).cast("double"))).alias("high_confidence_ratio"),
        zero(F.avg((F.col("overall") > 0.8).cast("double"))).alias("high_score_ratio"),
    )
