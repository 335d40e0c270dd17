"""Relation names: canonical form, kinds, and declarative rewrite rules, as column expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that make a relation hierarchical or an equivalence.
HIERARCHY = ("subclassof", "broader", "is_a", "isa", "is-a")
HIERARCHY_PART = "subclassof|broader|isa|is-a"
EQUIVALENCE = ("equivalentclass", "sameas", "exactmatch", "equivalentto")


def canonical(p: Column) -> Column:
    """Lower-case local name of an IRI, CURIE or bare relation name; null is empty."""
    bare = F.lower(F.regexp_replace(F.trim(F.coalesce(p, F.lit(""))), "^[<>]+|[<>]+$", ""))
    return F.regexp_replace(F.regexp_replace(bare, "(?s)^.*[#/]", ""), "(?s)^[^:]*:", "")


def canonical_text(p: str) -> str:
    """canonical() of a name at hand."""
    bare = (p or "").strip().strip("<>").lower()
    local = bare[max(bare.rfind("#"), bare.rfind("/")) + 1 :]
    return local.partition(":")[2] if ":" in local else local


def is_hierarchy(p: Column) -> Column:
    """True for the hierarchy names and for any name that contains one of their stems."""
    key = canonical(p)
    return key.isin(*HIERARCHY) | key.rlike(HIERARCHY_PART)


def is_equivalence(p: Column) -> Column:
    return canonical(p).isin(*EQUIVALENCE)


def local_part(key: Column) -> Column:
    """Fragment of an IRI, local name of a CURIE, or the bare name."""
    iri = F.regexp_extract(key, "([^#/]*)$", 1)
    return F.when(F.contains(key, F.lit("://")), iri).otherwise(F.regexp_replace(key, "^[^:]*:", ""))


def mapped(key: Column, table: Mapping[str, str]) -> Column:
    """key through a small constant map, unchanged where it has no entry."""
    if not table:
        return key
    entries = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in sorted(table.items())))
    return F.coalesce(F.try_element_at(entries, key), key)


@dataclass(frozen=True)
class Rules:
    """Declarative rewrites of relations; the fields are those of the JSON rule file."""

    normalize: Mapping[str, str] = field(default_factory=dict)
    inverse: Mapping[str, str] = field(default_factory=dict)
    transitive: frozenset[str] = frozenset()
    drop: frozenset[str] = frozenset()
    grammar: Mapping[str, str] = field(default_factory=dict)
    grammar_flip: frozenset[str] = frozenset()
    domain_range: Mapping[str, tuple[frozenset[str], frozenset[str]]] = field(default_factory=dict)

    def resolved(self) -> Rules:
        """With every name canonical and sent through normalize and grammar."""
        tidy = lambda table: {canonical_text(k): canonical_text(v) for k, v in table.items() if canonical_text(k) and canonical_text(v)}
        normalize, grammar = tidy(self.normalize), tidy(self.grammar)

        def name(p: str) -> str:
            p = canonical_text(p)
            p = normalize.get(p, p)
            return grammar.get(p, p)

        inverse = {name(k): name(v) for k, v in self.inverse.items() if name(k) and name(v)}
        names = lambda some: frozenset(name(p) for p in some if name(p))
        transitive = frozenset(inverse.get(p, p) for p in names(self.transitive))
        domains = {name(p): pair for p, pair in self.domain_range.items()}
        return Rules(normalize, inverse, transitive, names(self.drop), grammar, names(self.grammar_flip), domains)

    def merged(self, data: Mapping) -> Rules:
        """These rules with a rule file's on top."""
        domains = {p: (frozenset(v["domain"]), frozenset(v["range"])) if isinstance(v, Mapping) else (frozenset(v[0]), frozenset(v[1])) for p, v in data.get("domain_range", {}).items()}
        both = lambda mine, key: {**mine, **data.get(key, {})}
        more = lambda mine, key: mine | frozenset(data.get(key, ()))
        return Rules(both(self.normalize, "normalize"), both(self.inverse, "inverse"), more(self.transitive, "transitive"), more(self.drop, "drop"), both(self.grammar, "grammar"), more(self.grammar_flip, "grammar_flip"), {**self.domain_range, **domains})

    @classmethod
    def load(cls, path: str | None) -> Rules:
        if path is None:
            return DEFAULT
        with open(path, encoding="utf-8") as file:
            return DEFAULT.merged(json.load(file))


# The default rewrites.
DEFAULT = Rules(
    normalize={
        "subclassof": "subclassof", "broader": "subclassof", "is_a": "subclassof", "isa": "subclassof", "is-a": "subclassof",
        "narrower": "superclassof", "partof": "part_of", "part_of": "part_of", "has_part": "has_part",
        "equivalentclass": "equivalentclass", "sameas": "sameas", "exactmatch": "exactmatch", "equivalentto": "equivalentto",
    },
    inverse={"superclassof": "subclassof", "has_part": "part_of"},
    transitive=frozenset({"subclassof", "part_of"}),
)


def normalized(triples: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Triples (s, p, o) trimmed, renamed, inverted and flipped; empty and dropped ones go; duplicates stay."""
    r = rules.resolved()
    p = mapped(mapped(canonical(F.col("p")), r.normalize), r.grammar)
    rows = triples.select(*(c for c in triples.columns if c not in "spo"), F.trim("s").alias("s"), p.alias("p"), F.trim("o").alias("o"))
    rows = rows.where("s <> '' AND p <> '' AND o <> ''")
    if r.drop:
        rows = rows.where(~F.col("p").isin(*sorted(r.drop)))
    turned = F.col("p").isin(*sorted(r.inverse)) if r.inverse else F.lit(False)
    after = mapped(F.col("p"), r.inverse)
    rows = rows.select(*(c for c in rows.columns if c not in "spo"), "s", "o", after.alias("p"), turned.alias("_turned"))
    passive = F.col("p").rlike("^(is_|was_).*_by$")
    flipped = passive | F.col("p").isin(*sorted(r.grammar_flip)) if r.grammar_flip else passive
    swap = F.col("_turned") != flipped
    return rows.select(*(c for c in rows.columns if c not in ("s", "p", "o", "_turned")), F.when(swap, F.col("o")).otherwise(F.col("s")).alias("s"), "p", F.when(swap, F.col("s")).otherwise(F.col("o")).alias("o"))
