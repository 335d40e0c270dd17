"""One ontology and what a user does with it: read, refine, describe, embed, search, gather context, ask from memory.

Each step is a table or a plan on tables; nothing is held outside Spark but the caller's own search terms.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import AbstractContextManager
from dataclasses import dataclass, field
from functools import cached_property
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import names as N
from weft.functions import predicates as P
from weft.functions import text as T
from weft.lineage import cut
from weft.operators import graph as G
from weft.operators import lookup as L
from weft.operators import memory as M
from weft.operators import vectors as X
from weft.plans import refine as R
from weft.registry import ENCODERS
from weft.sources import readers

PROMPT = "Answer from these concepts only.\n{context}\n\nQuestion: {question}"


@dataclass
class Workspace:
    """An ontology file, folder or pattern. encoder: a name in the registry; refined: whether relations are closed and reduced first."""

    spark: SparkSession
    path: str
    form: str | None = None
    encoder: str = "hashed"
    refined: bool = True
    rules: P.Rules = field(default_factory=lambda: P.DEFAULT)

    @cached_property
    def statements(self) -> DataFrame:
        """Everything that the files say: s, p, o, kind."""
        return cut(readers.triples(self.spark, self.path, self.form), "statements")

    @cached_property
    def triples(self) -> DataFrame:
        """Relations between classes, refined where asked."""
        links = readers.ontology_triples(self.statements).where("p IS NOT NULL")
        return cut(R.refine_unless_grown(links, self.rules).triples if self.refined else links.distinct(), "triples")

    @cached_property
    def edges(self) -> DataFrame:
        return self.triples.select(F.col("s").alias("src"), F.col("o").alias("tgt")).distinct()

    @cached_property
    def texts(self) -> DataFrame:
        """id, name and text of each class: its labels, synonyms and definitions, or else its local name."""
        report = R.node_report(self.statements.where("kind <> 'bnode'")).where(~F.startswith("id", F.lit("_:")))
        known = self.triples.select(F.col("s").alias("id")).union(self.triples.select("o")).distinct()
        said = F.concat_ws(" | ", *(F.nullif(F.array_join(c, ", "), F.lit("")) for c in ("labels", "synonyms", "definitions", "comments")))
        name = N.display_name(F.col("labels"), F.col("id"), F.lit(None).cast("string"), F.col("id"))
        return cut(known.join(report, "id").select("id", name.alias("name"), F.coalesce(F.nullif(said, F.lit("")), name).alias("text")), "texts")

    @cached_property
    def vectors(self) -> DataFrame:
        """id and vector of each class."""
        return cut(self.encoded(self.texts.select(F.col("id").alias("doc_id"), "text")), "vectors")

    def encoded(self, texts: DataFrame) -> DataFrame:
        return ENCODERS.create(self.encoder, texts).select(F.col("doc_id").alias("id"), "vector")

    def summary(self) -> DataFrame:
        """Classes, relations and statements, in one row."""
        return R.summary(self.triples)

    def search(self, terms: Sequence[str], k: int = 10, prefixes: Sequence[str] = (), exclusive: bool = False, how: str = "max", weights: list[float] | None = None) -> DataFrame:
        """id, name, score of the classes nearest to the terms, of those whose IRI begins with a prefix."""
        asked = self.encoded(self.spark.createDataFrame(list(enumerate(terms)), "doc_id long, text string")).orderBy("id").collect()
        nodes = self.vectors.where(L.has_prefix(F.array("id"), prefixes, exclusive))
        return X.search_many(nodes, [list(r.vector) for r in asked], k, how, weights).join(self.texts.select("id", "name"), "id").select("id", "name", "score")

    def neighbours(self, nodes: DataFrame, hops: int = 1) -> DataFrame:
        """seed, id, hop around nodes (id)."""
        return G.neighbourhood(self.edges, nodes, hops).where("hop > 0")

    def context(self, question: str, k: int = 10, hops: int = 0, passages: DataFrame | None = None) -> DataFrame:
        """id, text, source, score of what a prompt about the question may take."""
        found = cut(self.search([question], k).join(self.texts.select("id", "text"), "id"), "found")
        near = self.neighbours(found, hops).select(F.col("seed").alias("match"), "id").join(self.texts.select("id", "text"), "id") if hops else None
        return L.context_candidates(found, near, passages)

    def ask(self, questions: DataFrame, tiers: list[tuple[str, DataFrame]], k: int = 5) -> DataFrame:
        """question, answer, source and prompt of questions (question): the first memory tier (name, (key, answer)) that knows it
        answers; for the others the prompt is made, and whoever holds a model may answer. The questions are the caller's, so they are few.
        """
        keyed = questions.withColumn("key", T.question_key(F.col("question")))
        told = M.answers_in_tiers(keyed, tiers)
        prompts = []
        for r in told.where("answer IS NULL").select("question").distinct().collect():
            shown = self.context(r.question, k).select(F.concat(F.lit("- "), "text").alias("line")).collect()
            prompts.append((r.question, PROMPT.format(context="\n".join(x.line for x in shown), question=r.question)))
        made = self.spark.createDataFrame(prompts, "question string, prompt string")
        return told.join(made, "question", "left").select("question", "answer", "source", "prompt")

    def evaluate(self, other: Workspace, gold: DataFrame, k: int = 1) -> DataFrame:
        """Precision, recall and F1 of the nearest classes of another workspace against gold (l, r)."""
        from weft.operators import metrics

        mine, theirs = X.positions(self.vectors, [F.col("id")], "at"), X.positions(other.vectors, [F.col("id")], "at")
        pairs = X.best_matches(mine.select(F.col("at").cast("long").alias("id"), "vector"), theirs.select(F.col("at").cast("long").alias("id"), "vector"), k)
        named = pairs.join(mine.select(F.col("at").alias("left"), F.col("id").alias("l")), "left").join(theirs.select(F.col("at").alias("right"), F.col("id").alias("r")), "right")
        return metrics.overlap(named.select("l", "r"), gold)


class RunControl(AbstractContextManager):
    """Work under a tag that another thread can stop, with its stages noted: with RunControl(spark, "import") as run: ..."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.stages = spark, tag, []

    def __enter__(self) -> RunControl:
        self.spark.addTag(self.tag)
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.spark.removeTag(self.tag)

    def stage(self, name: str, done: int, total: int) -> str:
        """Note how far a stage is; the line to show."""
        self.stages.append((name, done, total))
        return f"{name}: {done}/{total}"

    def stop(self) -> list[str]:
        """Stop all work under the tag."""
        return list(self.spark.interruptTag(self.tag))
