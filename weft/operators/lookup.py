"""Finding nodes and thoughts, gathering prompt context, and the decisions taken on what was found."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.tables import first_per

CONTEXT_LIMIT = 256


def folded(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def _holds(nodes: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    wanted = re.sub("[^a-z0-9]+", "", term.lower())
    return nodes.where(F.coalesce(F.exists(F.array(*columns), lambda x: F.contains(folded(x), F.lit(wanted))), F.lit(False)))


def node_search(nodes: DataFrame, term: str, columns: Sequence[str], limit: int, key: str = "id") -> DataFrame:
    """The first nodes, by key, of which some column has the term, case and punctuation aside."""
    return _holds(nodes, term, columns).orderBy(key).limit(limit)


def pool_search(nodes: DataFrame, term: str, columns: Sequence[str], per_pool: int, pool: str = "kg", only: Sequence[str] | None = None, key: str = "id") -> DataFrame:
    """node_search() in each pool (of those named, if any), per_pool nodes each."""
    found = _holds(nodes if only is None else nodes.where(F.col(pool).isin(*only)), term, columns)
    return first_n(found, [pool], [key], per_pool)


def first_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each key."""
    from pyspark.sql import Window as W

    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def incident(edges: DataFrame, node: str, limit: int | None = None) -> DataFrame:
    """Edges (src, tgt, ...) at a node, in order; a node's own loops once."""
    found = edges.where((F.col("src") == node) | (F.col("tgt") == node)).orderBy("src", "tgt")
    return found if limit is None else found.limit(limit)


def incident_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, direction (out before in) and the edges at each of nodes (id); a loop is an out edge only."""
    out = edges.join(nodes.select(F.col("id").alias("src")), "src").select(F.col("src").alias("id"), F.lit("out").alias("direction"), "src", "tgt")
    into = edges.where("src <> tgt").join(nodes.select(F.col("id").alias("tgt")), "tgt").select(F.col("tgt").alias("id"), F.lit("in").alias("direction"), "src", "tgt")
    return out.unionByName(into)


def sampled(nodes: DataFrame, limit: int, labels: Sequence[str] | None = None, seed: int = 42, key: str = "id") -> DataFrame:
    """limit nodes (of those with one of the labels, if any are named) in an order drawn by hash: it depends on the seed, not on the plan."""
    some = nodes if labels is None else nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))
    return some.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(limit)


def has_prefix(members: Column, prefixes: Sequence[str], exclusive: bool = False) -> Column:
    """Whether some member (exclusive: each of at least one) begins with one of the prefixes; without prefixes all pass."""
    if not prefixes:
        return F.lit(True)
    begins = lambda m: reduce(lambda a, b: a | b, (F.startswith(m, F.lit(p)) for p in prefixes))
    return (F.size(members) > 0) & F.forall(members, begins) if exclusive else F.exists(members, begins)


def tagged(rows: DataFrame, tags: Sequence[str], every: bool = False, column: str = "tags") -> DataFrame:
    """Rows with one of the tags, or with every one."""
    wanted = F.array(*map(F.lit, tags))
    return rows.where(F.size(F.array_except(wanted, column)) == 0 if every else F.arrays_overlap(column, wanted))


def search_thoughts(thoughts: DataFrame, query: str, most: int, fields: Sequence[str] = ("question", "answer", "content", "name"), order: str = "seq") -> DataFrame:
    """id, kind and match of the first hits: the id, or else the first field and the first tag that hold the query."""
    has = lambda c: F.contains(F.lower(c), F.lit(query.lower()))
    hit = lambda kind, match: F.struct(F.lit(kind).alias("kind"), match.alias("match"))
    field = F.coalesce(*(F.when(has(F.col(f)), hit(f"content_{f}", F.col(f))) for f in fields))
    tag = F.get(F.filter("tags", has), F.lit(0))
    hits = F.when(has(F.col("id")), F.array(hit("thought_id", F.col("id")))).otherwise(F.array_compact(F.array(field, F.when(tag.isNotNull(), hit("tag", tag)))))
    rows = thoughts.select(order, "id", F.posexplode(hits).alias("at", "hit"))
    return rows.orderBy(order, "id", "at").limit(most).select("id", "hit.kind", "hit.match")


def in_order(spark: SparkSession, ids: Sequence, rows: DataFrame, key: str) -> DataFrame:
    """pos and the rows of the ids asked for; ids without a row are passed over. ids are the caller's, so they are few."""
    kind = rows.schema[key].dataType.simpleString()
    asked = spark.createDataFrame(list(enumerate(ids)), f"pos int, {key} {kind}")
    return rows.join(F.broadcast(asked), key).select("pos", *rows.columns)


def context_candidates(matches: DataFrame, neighbours: DataFrame | None = None, passages: DataFrame | None = None, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """id, text, source and score of what a prompt may take: matches (id, text, score) by score, each before its
    neighbours (match, id, text), then passages (id, text); the first of an id counts.
    """
    place = lambda *parts: F.struct(*(F.lit(p).alias(f"p{i}") if not isinstance(p, Column) else p.alias(f"p{i}") for i, p in enumerate(parts)))
    none = F.lit(None).cast("double")
    rank = -F.col("score")
    out = matches.select("id", "text", F.lit("concept").alias("source"), "score", place(0, rank, F.col("id"), 0, F.col("id")).alias("at"))
    if neighbours is not None:
        near = neighbours.join(matches.select(F.col("id").alias("match"), "score"), "match")
        out = out.unionByName(near.select("id", "text", F.lit("neighborhood").alias("source"), none.alias("score"), place(0, rank, F.col("match"), 1, F.col("id")).alias("at")))
    if passages is not None:
        out = out.unionByName(passages.select("id", "text", F.lit("web").alias("source"), none.alias("score"), place(1, F.lit(0.0), F.col("id"), 0, F.col("id")).alias("at")))
    return first_per(out.where("id IS NOT NULL AND text <> ''"), ["id"], ["at"]).orderBy("at").limit(limit).drop("at")


def selected(candidates: DataFrame, least: float = 0.2, shadow: bool = True) -> DataFrame:
    """candidates (id, relevance, ...) with selected and returned: relevance of least and more selects, none retains;
    in shadow everything is returned, else what is selected.
    """
    if not 0 <= least <= 1:
        raise ValueError("least must be between 0 and 1")
    keep = F.coalesce(F.col("relevance") >= least, F.lit(True))
    return candidates.withColumn("selected", keep).withColumn("returned", F.lit(True) if shadow else keep)


def selection_metrics(decisions: DataFrame, *keys: str) -> DataFrame:
    """Candidates, selected, returned and the rejection rate (0 without candidates), for each of keys."""
    return decisions.groupBy(*keys).agg(
        F.count("*").alias("candidate_count"), F.count_if("selected").alias("selected_count"), F.count_if("returned").alias("returned_count"),
        F.coalesce(F.try_divide(F.count_if(~F.col("selected")), F.count("*")), F.lit(0.0)).alias("rejection_rate"),
    )


def routed(readings: DataFrame, same_intent: float = 0.8, continues: float = 0.8) -> DataFrame:
    """id, route, question, continues of readings (id, same_intent, closeness, continues, choice, nearest, cached, fail_open).

    cached: the remembered questions; choice and nearest: a question's text or null. A named remembered
    question is replayed; so is the nearest (or the only) one where intent and closeness agree; all else,
    and a reading that failed, is retrieved.
    """
    known = lambda q: F.coalesce(F.array_contains("cached", q), F.lit(False))
    near = F.when(known(F.col("nearest")), F.col("nearest")).when(F.size("cached") == 1, F.get("cached", F.lit(0)))
    agrees = (F.coalesce("same_intent", F.lit(0.0)) >= same_intent) & F.coalesce(F.col("closeness") == "Same question", F.lit(False))
    question = F.when(F.coalesce("fail_open", F.lit(False)), None).when(known(F.col("choice")), F.col("choice")).when(agrees, near)
    goes_on = F.coalesce("continues", F.lit(0.0)) >= continues
    return readings.select("id", F.when(question.isNull(), "retrieve").otherwise("replay").alias("route"), question.alias("question"), goes_on.alias("continues"))


def gated(calls: DataFrame, tools: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """calls (tool_name, risk, ...) with gated and blocked: a gated tool is blocked at the threshold, and where its risk is unknown."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    is_gated = F.coalesce(F.col("tool_name").isin(*tools), F.lit(False))
    return calls.withColumn("gated", is_gated).withColumn("blocked", is_gated & F.coalesce(F.col("risk") >= threshold, F.lit(True)))


def best_route(options: DataFrame, fallback: str) -> DataFrame:
    """id and the route of highest score of options (id, route, score); without any score the fallback."""
    return options.groupBy("id").agg(F.coalesce(F.max_by("route", F.when(F.col("score").isNotNull(), F.struct("score", "route"))), F.lit(fallback)).alias("route"))


def merged_items(items: DataFrame, term: str, most: int, order: str = "seq") -> DataFrame:
    """Items (source, iri, uri, id, name, summary, description, keywords, kg, seq) of one search, one for each source
    and key (iri, uri, id or name), texts filled from later ones, the best by name first.
    """
    first = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    key = F.lower(F.coalesce(first("iri"), first("uri"), first("id"), first("name"), F.lit("")))
    filled = [c for c in ("summary", "description", "keywords") if c in items.columns]
    given = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order)))
    kept = [c for c in items.columns if c not in ("source", order, *filled)]
    rows = items.withColumn("_key", key).groupBy("source", "_key").agg(F.min(order).alias(order), *(F.min_by(c, order).alias(c) for c in kept), *(given(c).alias(c) for c in filled))
    name, t, kg = F.lower(F.coalesce("name", F.lit(""))), term.lower(), F.lower(F.coalesce("kg", F.lit("")))
    score = F.when(name == t, 10.0).when(F.startswith(name, F.lit(t)), 6.0).when(F.contains(name, F.lit(t)), 3.0).otherwise(0.0)
    score = score + F.when(F.col("source") == "neo4j", 1.0).otherwise(0.0) + F.when((kg != "") & ~kg.isin("hetionet", "neo4j"), 0.5).otherwise(0.0)
    return rows.withColumn("score", score).orderBy(F.desc("score"), order).limit(most).drop("_key")


def entity_search(pools: Sequence[DataFrame], term: str, most: int) -> DataFrame:
    """merged_items() over what several sources found; a column that a source lacks is null there."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pools)
    return merged_items(rows, term, most)


def term_records(records: DataFrame, fields: dict[str, Sequence[str]]) -> DataFrame:
    """Each field of a record from the first of its columns that says something; a JSON column is read as a map of texts."""
    pick = lambda names: F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names))
    return records.select(*(pick(names).alias(field) for field, names in fields.items()))


def from_properties(properties: Column, names: Sequence[str]) -> Column:
    """The first of names that a map of properties has a value for."""
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(properties, F.lit(n))), F.lit("")) for n in names))


def merged_terms(terms: DataFrame, order: str = "seq") -> DataFrame:
    """The first of each term (iri, prefix, short_form, label): by iri, or else by the other three."""
    key = F.coalesce(F.nullif("iri", F.lit("")), F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in ("prefix", "short_form", "label"))))
    return first_per(terms.withColumn("_key", key), ["_key"], [order]).drop("_key")


def schema_counts(triples: DataFrame, kinds: Sequence[str], prefix: str) -> DataFrame:
    """How many subjects of each of the kinds (objects of rdf:type) begin with prefix."""
    rows = triples.where((F.col("p") == "rdf:type") & F.col("o").isin(*kinds) & F.startswith("s", F.lit(prefix)))
    return rows.groupBy(F.col("o").alias("kind")).agg(F.count_distinct("s").alias("n"))


def hits(texts: DataFrame, terms: DataFrame, column: str = "text") -> DataFrame:
    """term and in how many texts it stands as a word (or run of words), case aside; terms: (term), of up to five words.

    Texts are read once: their distinct runs of as many words as terms have meet the terms by a join.
    """
    word = "[\\p{L}\\p{N}]+"
    asked = terms.select("term", F.array_join(F.regexp_extract_all(F.lower("term"), F.lit(word), 0), " ").alias("run")).where("run <> ''").distinct()
    words = F.col("words")
    run = lambda n: words if n == 1 else F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    lengths = [r[0] for r in asked.select(F.size(F.split("run", " ")).alias("n")).distinct().limit(6).collect()]
    if any(n > 5 for n in lengths):
        raise ValueError("a term has more than five words")
    every = F.array_distinct(F.concat(*(F.when(F.size(words) >= n, run(n)).otherwise(F.array().cast("array<string>")) for n in sorted(lengths) or [1])))
    rows = texts.select(F.regexp_extract_all(F.lower(column), F.lit(word), 0).alias("words"))
    seen = rows.select(F.explode(every).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    return asked.join(seen, "run", "left").select("term", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
