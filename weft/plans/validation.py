"""Tuples through normalisation, evaluation and statistics, and on into graph tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import predicates as P
from weft.functions import tuples as T
from weft.lineage import cut
from weft.plans import refine as R


@dataclass(frozen=True)
class Validated:
    """What became of tuples (source, relation, target), and the ontology and graph of them as they came, where asked."""

    normalized: DataFrame
    evaluations: DataFrame
    statistics: DataFrame
    concepts: DataFrame | None = None
    graph: DataFrame | None = None


def process(rows: DataFrame) -> Validated:
    normal = T.normalized(rows)
    evaluated = cut(T.evaluated(normal), "evaluated")
    return Validated(normal, evaluated, T.statistics(evaluated))


def process_ontology(rows: DataFrame) -> Validated:
    """process(), and the graph tables of the tuples as they came: only what is judged is normalised, not what is built."""
    done = process(rows)
    triples = rows.select(F.trim("source").alias("s"), F.col("relation").alias("p"), F.trim("target").alias("o")).where("s <> '' AND o <> '' AND trim(p) <> ''")
    same = triples.where(P.is_equivalence(F.col("p"))).select(F.col("s").alias("src"), F.col("o").alias("tgt"))
    links = triples.where(~P.is_equivalence(F.col("p"))).select(F.col("s").alias("src"), F.col("o").alias("tgt"), F.when(P.is_hierarchy(F.col("p")), 2.0).otherwise(1.0).alias("score"))
    return Validated(done.normalized, done.evaluations, done.statistics, R.concepts(triples), R.concept_graph(same, links))
