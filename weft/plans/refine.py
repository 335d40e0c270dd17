"""Refinement of triples: normalise, close, reduce, validate; and the tables built from them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions import predicates as P
from weft.lineage import cut
from weft.operators import graph as G


@dataclass(frozen=True)
class Refined:
    """Refined triples, and what was noticed: diagnostics (stage, code, n)."""

    triples: DataFrame
    diagnostics: DataFrame


def domain_valid(triples: DataFrame, types: DataFrame, domains: Mapping[str, tuple[frozenset[str], frozenset[str]]]) -> DataFrame:
    """Triples whose ends' known types (id, types) meet the relation's domain and range; unknown types pass."""
    for end, at in (("s", 0), ("o", 1)):
        allowed = F.array().cast("array<string>")
        for p, pair in domains.items():
            allowed = F.when(F.col("p") == p, F.array(*map(F.lit, sorted(pair[at]))).cast("array<string>")).otherwise(allowed)
        known = types.select(F.col("id").alias(end), F.col("types").alias("_types"))
        ok = F.col("_types").isNull() | (F.size("_types") == 0) | (F.size(allowed) == 0) | F.arrays_overlap("_types", allowed)
        triples = triples.join(known, end, "left").where(ok).drop("_types")
    return triples


def fact_checked(triples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Triples that no verdict (s, p, o, verdict) denies; a null verdict denies nothing."""
    return triples.join(verdicts.where("NOT verdict"), ["s", "p", "o"], "left_anti")


def limited_closure(edges: DataFrame, most: int | None, reach: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """New edges of the closure (reach, if it is known); with a limit, the first in (src, tgt) order, and whether some were left out."""
    reach = G.closure(edges) if reach is None else reach
    new = reach.where("src <> tgt").join(edges.select("src", "tgt"), ["src", "tgt"], "left_anti")
    if most is None:
        return new, False
    kept = new.orderBy("src", "tgt").limit(max(0, most) + 1)
    kept = cut(kept, "limited")
    return kept.orderBy("src", "tgt").limit(max(0, most)), kept.count() > max(0, most)


def refine(triples: DataFrame, rules: P.Rules = P.DEFAULT, close: bool = True, reduce: bool = True, most_new: int | None = None, types: DataFrame | None = None, verdicts: DataFrame | None = None) -> Refined:
    """Normalise and dedup; close and reduce each transitive relation; drop type mismatches and denied facts."""
    spark, notes = triples.sparkSession, []
    known = cut(P.normalized(triples, rules).select("s", "p", "o").distinct(), "normalized")
    before, after = triples.count(), known.count()
    if after < before:
        notes.append(("normalize", "triples_removed", before - after))
    resolved = rules.resolved()
    present = {r.p for r in known.where(F.col("p").isin(*sorted(resolved.transitive))).select("p").distinct().collect()} if close or reduce else ()
    for p in sorted(present):
        edges = cut(known.where((F.col("p") == p) & (F.col("s") != F.col("o"))).select(F.col("s").alias("src"), F.col("o").alias("tgt")), "relation")
        rest = known.where((F.col("p") != p) | (F.col("s") == F.col("o")))
        reach = G.closure(edges)
        cyclic = not reach.where("src = tgt").isEmpty()
        if close:
            new, short = limited_closure(edges, most_new, reach)
            edges = edges.unionByName(new) if not reduce or cyclic else edges  # a reduction of the closure is one of the edges
            if short:
                notes.append(("transitive_closure", "closure_truncated", most_new))
        if cyclic:
            notes.append(("transitive_reduction" if reduce else "transitive_closure", "cycle_detected", 1))
        if reduce and not cyclic:
            edges = G.reduction(edges, reach)
        known = cut(rest.unionByName(edges.select(F.col("src").alias("s"), F.lit(p).alias("p"), F.col("tgt").alias("o"))), "refined")
    if types is not None:
        valid = cut(domain_valid(known, types, resolved.domain_range).select("s", "p", "o"), "valid")
        if (lost := known.count() - valid.count()) > 0:
            notes.append(("validation", "domain_mismatch", lost))
        known = valid
    reversible = resolved.transitive | set(resolved.inverse) | set(resolved.inverse.values()) | set(resolved.domain_range) | {"subclassof"}
    if (doubtful := known.where(~F.col("p").isin(*sorted(reversible))).count()) > 0:
        notes.append(("validation", "non_reversible", doubtful))
    if verdicts is not None:
        checked = cut(fact_checked(known, verdicts), "checked")
        if (lost := known.count() - checked.count()) > 0:
            notes.append(("validation", "factual_denied", lost))
        known = checked
    return Refined(known, spark.createDataFrame(notes, "stage string, code string, n long"))


def refine_unless_grown(triples: DataFrame, rules: P.Rules = P.DEFAULT) -> Refined:
    """refine(); again without closure if the result has more triples than the input."""
    out = refine(triples, rules)
    return refine(triples, rules, close=False) if out.triples.count() > triples.count() else out


def concepts(triples: DataFrame) -> DataFrame:
    """name, nodeid and degrees of every node."""
    edges = triples.select("s", "p", "o").distinct().select(F.col("s").alias("src"), F.col("o").alias("tgt"))
    return G.degrees(edges).select(F.col("id").alias("name"), F.concat(F.lit("N"), F.md5(F.col("id").cast("binary"))).alias("nodeid"), "n_out", "n_in")


def concept_graph(same: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between equivalence classes (named by their smallest member): how many, and the highest score."""
    classes = G.components(same)
    of = lambda end: classes.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c"))
    rows = edges.join(of("src"), "src", "left").join(of("tgt"), "tgt", "left")
    rows = rows.select(F.coalesce("src_c", "src").alias("src"), F.coalesce("tgt_c", "tgt").alias("tgt"), "score").where("src <> tgt")
    return rows.groupBy("src", "tgt").agg(F.count("*").alias("n"), F.max("score").alias("score"))


def closure_sizes(edges: DataFrame) -> DataFrame:
    """id, and how many nodes it reaches and is reached from."""
    reach = G.closure(edges)
    ends = reach.select(F.col("src").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(reach.select("tgt", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("n_up"), F.sum("down").alias("n_down"))


def numbered(values: DataFrame, column: str) -> DataFrame:
    """Distinct values with their position in order, from 0, without gathering them: counts before each range partition are added."""
    part = F.spark_partition_id()
    ranged = cut(values.select(column).distinct().repartitionByRange(column).withColumn("_part", part), "ranged")
    within = ranged.withColumn("_i", F.row_number().over(W.partitionBy("_part").orderBy(column)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(before), "_part").select(column, (F.col("_before") + F.col("_i") - 1).alias("i"))


def incidence_matrix(incidence: DataFrame) -> DataFrame:
    """row, col, value of the sparse incidence matrix; indexes are positions of sorted ids."""
    rows, cols = numbered(incidence, "vid").withColumnRenamed("i", "row"), numbered(incidence, "eid").withColumnRenamed("i", "col")
    return incidence.select("vid", "eid").distinct().join(rows, "vid").join(cols, "eid").select("row", "col", F.lit(1.0).alias("value"))


def inserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the triples of new that it lacks."""
    return old.unionByName(new.distinct().join(old, ["s", "p", "o"], "left_anti").select(*old.columns))


def lint(triples: DataFrame, schema: DataFrame) -> DataFrame:
    """check, value, status: isolated classes, components, repeated statements, relations without domain and range."""
    edges = triples.select(F.col("s").alias("src"), F.col("o").alias("tgt"))
    nodes = edges.select("src").union(edges.select("tgt")).distinct().withColumnRenamed("src", "id")
    ends = nodes.join(edges.select(F.col("src").alias("id")).union(edges.select("tgt")), "id", "left_anti")
    row = lambda check, found, bad: found.select(F.lit(check).alias("check"), F.col("n").cast("double").alias("value"), F.when(F.col("n") > bad[1], bad[0]).otherwise("PASS").alias("status"))
    counted = lambda df: df.agg(F.count("*").alias("n"))
    out = row("isolated_classes", counted(ends), ("WARN", 0))
    out = out.unionByName(row("connected_components", counted(G.components(edges).select("component").distinct()), ("WARN", 1)))
    out = out.unionByName(row("duplicate_labels", counted(triples.groupBy("s", "p", "o").count().where("count > 1")), ("WARN", 0)))
    return out.unionByName(row("missing_domain_range", counted(schema.select("p").distinct()), ("FAIL", 0)))


def exit_code(report: DataFrame) -> int:
    """2 for a FAIL, 1 for a WARN, else 0."""
    return report.agg(F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))).first()[0] or 0


def with_metadata(rows: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """rows with what metadata (key, ...) says of them, null where it says nothing; the least row of a repeated key counts."""
    fields = [c for c in metadata.columns if c != key]
    one = metadata.groupBy(key).agg(F.min(F.struct(*fields)).alias("_m")).select(key, "_m.*")
    return rows.join(one, key, "left")


def merged_metadata(tables: list[DataFrame], key: str, column: str) -> DataFrame:
    """key and the values (arrays) of all tables, each once, in the order of the tables and of each list."""
    parts = [t.select(key, F.lit(i).alias("_t"), F.col(column).alias("_v")) for i, t in enumerate(tables)]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.union(more)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_t", "_v"))), lambda x: x["_v"])
    return rows.groupBy(key).agg(F.array_distinct(F.flatten(ordered)).alias(column))


def extract(triples: DataFrame, subject: str | None = None, literals: bool = True, blank: bool = True) -> DataFrame:
    """s, p, o of triples (s, p, o, kind) in order: of one subject, without literals, without blank nodes, as asked."""
    rows = triples if subject is None else triples.where(F.col("s") == subject)
    if not literals:
        rows = rows.where("kind <> 'literal'")
    if not blank:
        rows = rows.where("kind <> 'bnode'").where(~F.startswith("s", F.lit("_:")))
    return rows.select("s", "p", "o").orderBy("s", "p", "o")


def node_report(triples: DataFrame) -> DataFrame:
    """id and, by relation, what is said of each subject or object: types, labels, synonyms, definitions, comments, parents, children, equivalents, disjoint classes, uses."""
    said = lambda *names: F.array_sort(F.collect_set(F.when(F.col("name").isin(*names) & F.col("out"), F.col("other"))))
    name = P.canonical(F.col("p"))
    rows = triples.select(F.col("s").alias("id"), name.alias("name"), F.col("o").alias("other"), F.lit(True).alias("out"), P.is_hierarchy(F.col("p")).alias("up"))
    if "kind" in triples.columns:
        triples = triples.where("kind <> 'literal'")
    into = triples.select(F.col("o").alias("id"), name.alias("name"), F.col("s").alias("other"), F.lit(False).alias("out"), P.is_hierarchy(F.col("p")).alias("up"))
    return rows.unionByName(into).groupBy("id").agg(
        said("type").alias("types"), said("label", "preflabel").alias("labels"), said("altlabel", "hasexactsynonym", "hasrelatedsynonym").alias("synonyms"),
        said("definition", "iao_0000115").alias("definitions"), said("comment").alias("comments"),
        F.array_sort(F.collect_set(F.when(F.col("up") & F.col("out"), F.col("other")))).alias("parents"),
        F.array_sort(F.collect_set(F.when(F.col("up") & ~F.col("out"), F.col("other")))).alias("children"),
        said("equivalentclass", "sameas", "exactmatch").alias("equivalents"), said("disjointwith").alias("disjoint"),
        F.count_if("out").alias("n_out"), F.count_if(~F.col("out")).alias("n_in"),
    )


def live(records: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """What a cache that is rebuilt from its log holds: of each key the newest record, if its status is live."""
    newest = records.groupBy(key).agg(F.max_by(F.struct(*(c for c in records.columns if c != key)), order).alias("_r"))
    return newest.where("_r.status = 'live'").select(key, "_r.*")


def summary(triples: DataFrame) -> DataFrame:
    """Classes, relations and statements of an ontology, in one pass over its distinct triples."""
    rows = triples.select("s", "p", "o").distinct()
    ends = rows.select(F.explode(F.array(F.struct(F.col("s").alias("x"), F.lit(0).alias("k")), F.struct(F.col("o").alias("x"), F.lit(0).alias("k")), F.struct(F.col("p").alias("x"), F.lit(1).alias("k")))).alias("e")).select("e.*")
    kinds = ends.distinct().agg(F.count_if(F.col("k") == 0).alias("classes"), F.count_if(F.col("k") == 1).alias("relations"))
    return kinds.crossJoin(rows.agg(F.count("*").alias("statements")))  # one row each
