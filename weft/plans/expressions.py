"""Class expressions of OWL as text: restrictions, intersections, unions, complements, enumerations."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.names import NAMESPACES
from weft.operators import graph as G

OWL, RDF = NAMESPACES["owl"], NAMESPACES["rdf"]
# Cardinalities and how they are said.
QUALIFIED = (("qualifiedCardinality", "exactly"), ("minQualifiedCardinality", "min"), ("maxQualifiedCardinality", "max"))
PLAIN = (("cardinality", "exactly"), ("minCardinality", "min"), ("maxCardinality", "max"))


class Expressions:
    """The statements about some anonymous nodes: {node: {predicate: [(object, kind)]}}."""

    def __init__(self, statements: Mapping[str, Mapping[str, list[tuple[str, str]]]], prefixes: Mapping[str, str]):
        self.said, self.prefixes = statements, sorted(prefixes.items(), key=lambda p: -len(p[1]))

    def one(self, node: str, name: str, space: str = OWL) -> tuple[str, str] | None:
        found = self.said.get(node, {}).get(space + name)
        return found[0] if found else None

    def short(self, node: str) -> str:
        for prefix, base in self.prefixes:
            local = node[len(base) :]
            if node.startswith(base) and local and not set("/#:") & set(local):
                return f"{prefix}:{local}"
        return node if node.startswith("_:") else f"<{node}>"

    def items(self, head: str) -> list[tuple[str, str]]:
        out, seen = [], set()
        while head != RDF + "nil" and head not in seen:
            seen.add(head)
            if first := self.one(head, "first", RDF):
                out.append(first)
            rest = self.one(head, "rest", RDF)
            if rest is None:
                break
            head = rest[0]
        return out

    def value(self, term: tuple[str, str], nested: bool) -> str:
        name, kind = term
        return name if kind == "literal" else self.text(name, nested) if kind == "bnode" else self.short(name)

    def number(self, term: tuple[str, str]) -> str:
        return str(int(term[0])) if term[1] == "literal" else self.short(term[0])

    def restriction(self, node: str) -> str:
        on = self.one(node, "onProperty")
        name = self.short(on[0]) if on else "<?>"
        own = self.one(node, "hasSelf")
        if own and own[1] == "literal" and own[0].lower() in ("true", "1"):
            return f"{name} Self"
        for property_, word in QUALIFIED:
            if n := self.one(node, property_):
                of = self.one(node, "onClass")
                return f"{name} {word} {self.number(n)}" + (f" {self.value(of, True)}" if of else "")
        for property_, word in PLAIN:
            if n := self.one(node, property_):
                return f"{name} {word} {self.number(n)}"
        if v := self.one(node, "hasValue"):
            return f"{name} value {v[0] if v[1] == 'literal' else self.short(v[0])}"
        for property_, word in (("someValuesFrom", "some"), ("allValuesFrom", "only")):
            if of := self.one(node, property_):
                return f"{name} {word} {self.value(of, True)}"
        return node

    def text(self, node: str, nested: bool = False) -> str:
        """node as an expression; one with and or or in it stands in parentheses where it is nested."""
        closed = lambda x: f"({x})" if nested and (" and " in x or " or " in x) else x
        if (OWL + "Restriction", "iri") in self.said.get(node, {}).get(RDF + "type", ()):
            return self.restriction(node)
        for property_, word in (("intersectionOf", " and "), ("unionOf", " or ")):
            if head := self.one(node, property_):
                return closed(word.join(self.value(x, True) for x in self.items(head[0])))
        if of := self.one(node, "complementOf"):
            return f"not {closed(self.value(of, True))}"
        if head := self.one(node, "oneOf"):
            return "{" + ", ".join(x if kind == "literal" else self.short(x) for x, kind in self.items(head[0])) + "}"
        return self.short(node)


def class_expressions(triples: DataFrame, prefixes: Mapping[str, str] = NAMESPACES) -> DataFrame:
    """id and text of the anonymous class expressions of triples (s, p, o, kind) that no other expression contains.

    Anonymous nodes that are linked make a group, which is one expression with its parts, and is rendered in one piece; groups are
    independent, whatever their number.
    """
    blank = triples.where(F.startswith("s", F.lit("_:"))).select("s", "p", "o", "kind")
    links = blank.where("kind = 'bnode'")
    groups = G.components(links.select(F.col("s").alias("src"), F.col("o").alias("tgt")))
    rows = blank.join(groups.withColumnRenamed("id", "s"), "s", "left").withColumn("component", F.coalesce("component", "s"))
    known = dict(prefixes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        said: dict[str, dict[str, list[tuple[str, str]]]] = {}
        for s, p, o, kind in group[["s", "p", "o", "kind"]].sort_values(["s", "p", "o"]).itertuples(index=False):
            said.setdefault(s, {}).setdefault(p, []).append((o, kind))
        inner = {o for about in said.values() for mine in about.values() for o, kind in mine if kind == "bnode"}
        wanted = {OWL + x for x in ("onProperty", "intersectionOf", "unionOf", "complementOf", "oneOf")}
        out = [(s, Expressions(said, known).text(s)) for s, about in sorted(said.items()) if s not in inner and wanted & set(about)]
        return pd.DataFrame(out, columns=["id", "text"])

    return rows.groupBy("component").applyInPandas(run, "id string, text string")
