"""Named strategies: what a user may plug in, and the ones that come with the engine.

Every strategy is a function from DataFrames or Columns to DataFrames or Columns, so what is plugged
in is planned with the rest. Nothing is imported by name: a strategy is registered by its object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import lookup, memory, tables, vectors


@dataclass
class Registry:
    """Strategies of one kind by name, case aside, each with what is known of it."""

    kind: str
    known: dict[str, tuple[Callable[..., Any], dict[str, Any]]] = field(default_factory=dict)

    def register(self, name: str, make: Callable[..., Any], replace: bool = False, **about: Any) -> Callable[..., Any]:
        key = name.strip().lower()
        if not key:
            raise ValueError(f"a {self.kind} needs a name")
        if not callable(make):
            raise TypeError(f"{name}: not callable")
        if key in self.known and not replace:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self.known[key] = (make, about)
        return make

    def get(self, name: str) -> Callable[..., Any]:
        try:
            return self.known[name.strip().lower()][0]
        except KeyError:
            raise ValueError(f"unknown {self.kind}: {name!r}; known: {', '.join(sorted(self.known))}") from None

    def create(self, name: str, *given: Any, **options: Any) -> Any:
        return self.get(name)(*given, **options)

    def about(self, name: str) -> dict[str, Any]:
        self.get(name)
        return dict(self.known[name.strip().lower()][1])

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self.known))

    def __contains__(self, name: str) -> bool:
        return name.strip().lower() in self.known


#: (vectors, queries or query, k, ...) -> nearest
INDEXES = Registry("vector index")
INDEXES.register("exact", vectors.search_many, exact=True)
INDEXES.register("exact_blocks", vectors.best_matches, exact=True, batched=True)

#: (a: Column, b: Column) -> Column
SIMILARITIES = Registry("similarity")
SIMILARITIES.register("cosine", vectors.cosine)
SIMILARITIES.register("cosine_clamped", lambda a, b: vectors.clamped(vectors.cosine(a, b)))
SIMILARITIES.register("dot", vectors.dot)

#: (responses: id, said[, score, weight]) -> id, ...
SCORERS = Registry("response scorer")
SCORERS.register("agreement", lambda rows: tables.majority(rows).withColumnRenamed("agreement", "confidence"))
SCORERS.register("majority", tables.majority)
SCORERS.register("ensemble", tables.ensemble)

#: (capacity) -> Tier
EVICTIONS = Registry("eviction policy")
for _name in ("lru", "lfu", "2q", "lowest-count"):
    EVICTIONS.register(_name, lambda capacity=memory.HOT, _name=_name: memory.Tier(capacity, _name))

#: (candidates: id, relevance, ...) -> candidates with selected, returned
HARNESSES = Registry("context harness")
HARNESSES.register("passthrough", lambda rows: rows.withColumn("selected", F.lit(True)).withColumn("returned", F.lit(True)))
HARNESSES.register("threshold", lambda rows, least=0.2: lookup.selected(rows, least, shadow=False))
HARNESSES.register("shadow", lambda rows, least=0.2: lookup.selected(rows, least, shadow=True))

#: (texts: doc_id, text) -> doc_id, vector; a trained encoder is registered as a pandas UDF behind the same shape
ENCODERS = Registry("encoder")


def _hashed(texts: DataFrame, size: int = 64) -> DataFrame:
    from weft.operators.learning import hashed_text

    return hashed_text(texts, size)


ENCODERS.register("hashed", _hashed, trained=False)

#: (texts, terms) -> term, n
COUNTS = Registry("count provider")
COUNTS.register("corpus", lookup.hits, offline=True)
COUNTS.register("static", lambda counts, terms, default=1000: terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(default)).alias("n")), offline=True)

#: (arguments: DataFrame, ...) -> DataFrame
TOOLS = Registry("tool")
TOOLS.register("node_search", lookup.node_search, arguments={"limit": 10})
TOOLS.register("entity_search", lookup.entity_search, arguments={"most": 10})
TOOLS.register("corpus_hits", lookup.hits)

#: (options) -> argv or a plan to run
EXPERIMENTS = Registry("experiment strategy")


@dataclass(frozen=True)
class Rule:
    """A check over matches: how many rows offend, as one aggregate, and how bad that is."""

    name: str
    offending: Callable[[DataFrame], Column]
    severity: str = "error"


DUPLICATES = Rule("No Duplicate Matches", lambda rows: F.count("*") - F.count_distinct(F.struct(*rows.columns)))


def checked(matches: DataFrame, rules: tuple[Rule, ...] = (DUPLICATES,)) -> DataFrame:
    """rule, severity, passed, offending and checked of each rule; all are counted in one pass."""
    counts = matches.agg(F.count("*").alias("checked"), *(rule.offending(matches).alias(f"r{i}") for i, rule in enumerate(rules)))
    rows = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), (F.col(f"r{i}") == 0).alias("passed"), F.col(f"r{i}").alias("offending"), F.col("checked")) for i, r in enumerate(rules)))
    return counts.select(F.inline(rows))


@dataclass(frozen=True)
class Matching:
    """A matching task: two different sources, what scores a pair, who may judge it, and from which score on a pair matches."""

    source: DataFrame
    target: DataFrame
    similarities: tuple[str, ...]
    judges: tuple[str, ...]
    threshold: float

    def __post_init__(self) -> None:
        if self.source is self.target:
            raise ValueError("source and target must differ")
        if not self.similarities or not self.judges:
            raise ValueError("at least one similarity and one judge")
        for name in self.similarities:
            SIMILARITIES.get(name)
        if isinstance(self.threshold, bool) or not isinstance(self.threshold, (int, float)):
            raise TypeError("the threshold is a number")
        if not 0 <= self.threshold <= 1:
            raise ValueError("the threshold must be between 0 and 1")


@dataclass(frozen=True)
class Suite:
    """Named runs with their settings."""

    experiments: tuple[Mapping[str, Any], ...]
    results: str = "results/experiments"
    keep_going: bool = False

    @classmethod
    def read(cls, value: Mapping[str, Any]) -> Suite:
        """From a settings object of version 1: a list of experiments, each with a name of its own."""
        if value.get("schema_version", 1) != 1:
            raise ValueError(f"unsupported schema_version: {value['schema_version']!r}")
        runs = value.get("experiments")
        if not isinstance(runs, list) or not runs:
            raise ValueError("experiments must be a list that is not empty")
        names = [r.get("name") for r in runs]
        if None in names or len(set(names)) < len(names):
            raise ValueError("each experiment needs a name of its own")
        return cls(tuple(runs), str(value.get("results_dir", cls.results)), bool(value.get("continue_on_error", False)))
