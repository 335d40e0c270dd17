"""Graph operators over edge tables (src, tgt): components, closure, reduction, ranks, cycles, neighbourhoods.

Each is a loop of joins whose tables are cut from their lineage each round, and ends when a round
changes nothing. Direction is always src -> tgt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.lineage import cut

ROUNDS = 10_000
#: Nodes that a task contracts at a time.
CONTRACT = 500_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges of the same components: each CONTRACT of a partition's edges as stars around the smallest ids of their components."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def top(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        def stars(types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
            names = list(root)
            for i in range(0, len(names), 50_000):
                yield pa.record_batch([pa.array([top(x) for x in names[i : i + 50_000]], types[0]), pa.array(names[i : i + 50_000], types[1])], ["src", "tgt"])
            root.clear()

        types = None
        for b in batches:
            types = b.schema.types
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s, t = top(s), top(t)
                if s != t:
                    root[max(s, t)] = min(s, t)
            if len(root) > CONTRACT:  # what a task holds is bounded; the rest is the joins' work
                yield from stars(types)
        if types is not None:
            yield from stars(types)

    return edges.select("src", "tgt").mapInArrow(run, f"src {kind}, tgt {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that undirected edges reach.

    Partitions contract their own edges to stars first; then labels spread, and path lengths halve
    each round.
    """
    edges = cut(contracted(edges.where("src IS NOT NULL AND tgt IS NOT NULL")), "stars")
    both = cut(edges.select("src", "tgt").union(edges.select("tgt", "src")).distinct(), "both")
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.least("src", F.min("tgt")).alias("component")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels.withColumnRenamed("id", "tgt"), "tgt").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        step = cut(labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("before")), "labels")
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        step = cut(step.join(jump, "component").select("id", F.least("component", "further").alias("component"), "before"), "labels")
        labels = step.select("id", "component")
        if step.where("component <> before").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """All (src, tgt) with a path of one edge or more, self loops included where there is a cycle.

    Rounds double path lengths: what a round found new, paths of more than 2**(k-1) edges, is joined with all that is
    known on its left, so a path of n edges is found in log2(n) rounds. Each round appends its pairs as a
    table of its own; nothing that is known is written again. Rounds without an end are an error.
    """
    found = [cut(edges.select("src", "tgt").distinct(), "reached")]
    frontier = found[0]
    for _ in range(rounds):
        known = _together(found)
        step = known.join(frontier.select(F.col("src").alias("tgt"), F.col("tgt").alias("far")), "tgt").select("src", F.col("far").alias("tgt")).distinct()
        frontier = cut(step.join(known, ["src", "tgt"], "left_anti"), "reached")
        if frontier.isEmpty():
            return known
        found.append(frontier)
    raise RuntimeError("closure did not settle")


def _together(tables: list[DataFrame]) -> DataFrame:
    """Tables of one schema that cut() wrote, as one scan."""
    paths = [p for t in tables for p in t.inputFiles()]
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths) if paths else tables[0]


def reduction(edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """Edges of an acyclic graph without those that a longer path implies; a cyclic one is returned whole."""
    edges = cut(edges.select("src", "tgt").where("src <> tgt").distinct(), "edges")
    reach = closure(edges) if reach is None else reach
    if not reach.where("src = tgt").isEmpty():
        return edges
    implied = edges.join(reach.select(F.col("src").alias("tgt"), F.col("tgt").alias("far")), "tgt").select("src", F.col("far").alias("tgt"))
    return edges.join(implied, ["src", "tgt"], "left_anti")


def peeled(edges: DataFrame) -> tuple[DataFrame, bool]:
    """(id, rank) with rank the longest path to a sink, and whether edges are left over (a cycle)."""
    edges = cut(edges.select("src", "tgt").distinct(), "edges")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("tgt")).distinct()
    done = cut(nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("rank")), "ranks")
    rest, level = edges, 0
    while not rest.isEmpty():
        level += 1
        rest = cut(rest.join(done.where(F.col("rank") == level - 1).select(F.col("id").alias("tgt")), "tgt", "left_anti"), "rest")
        free = edges.select(F.col("src").alias("id")).distinct().join(rest.select(F.col("src").alias("id")), "id", "left_anti").join(done, "id", "left_anti")
        free = cut(free.select("id", F.lit(level).alias("rank")), "ranks")
        if free.isEmpty():
            return done, not rest.isEmpty()
        done = cut(done.unionByName(free), "ranks")
    return done, False


def ranks(edges: DataFrame) -> DataFrame:
    """Longest path to a sink; an acyclic graph only."""
    found, cyclic = peeled(edges)
    if cyclic:
        raise ValueError("ranks need an acyclic graph")
    return found


def has_cycle(edges: DataFrame) -> bool:
    return peeled(edges)[1]


def siblings(edges: DataFrame) -> DataFrame:
    """(src, tgt) of nodes that share a source: every pair, which is the result; see neighbourhood() for those of some nodes."""
    other = edges.select("src", F.col("tgt").alias("to"))
    return edges.join(other, "src").where("tgt <> to").select(F.col("tgt").alias("src"), F.col("to").alias("tgt")).distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int, with_siblings: bool = True) -> DataFrame:
    """(seed, id, hop): nodes within hops of each seed (id), over either direction and siblings.

    Siblings are reached from the frontier, up to distinct parents and down again, so no pair of siblings is made for nodes that no seed is near.
    """
    down = cut(edges.select("src", "tgt").distinct(), "steps")
    steps = down.union(down.select("tgt", "src"))
    seen = frontier = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop")).distinct(), "seen")
    for hop in range(1, hops + 1):
        near = frontier.join(steps, F.col("id") == F.col("src")).select("seed", F.col("tgt").alias("id"))
        if with_siblings:
            parents = frontier.join(down.withColumnRenamed("tgt", "id"), "id").select("seed", "src").distinct()
            near = near.union(parents.join(down, "src").select("seed", F.col("tgt").alias("id")))
        near = near.distinct()
        frontier = cut(near.join(seen, ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        seen = cut(seen.unionByName(frontier), "seen")
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    """id, n_out, n_in; in one pass over both ends."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("tgt", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def mapped(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between classes (id, component): unmapped ends drop the edge, loops go; other columns stay."""
    rest = [c for c in edges.columns if c not in ("src", "tgt")]
    of = lambda end: classes.select(F.col("id").alias(end), F.col("component").alias(f"{end}_class"))
    rows = edges.join(of("src"), "src").join(of("tgt"), "tgt").where("src_class <> tgt_class")
    return rows.select(F.col("src_class").alias("src"), F.col("tgt_class").alias("tgt"), *rest)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("tgt")), "tgt", "left_semi")


def strongest(edges: DataFrame, k: int, weight: str = "score") -> DataFrame:
    """Undirected edges that are among the k strongest of either end; ties by the other end."""
    pairs = edges.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), weight)
    mirrored = pairs.select("src", "tgt", weight, F.col("src").alias("u"), F.col("tgt").alias("v")).union(pairs.select("src", "tgt", weight, "tgt", "src"))
    at = F.row_number().over(W.partitionBy("u").orderBy(F.desc(weight), "v"))
    return mirrored.withColumn("at", at).where(F.col("at") <= k).select("src", "tgt", weight).distinct()


def dense_subgraph(edges: DataFrame, most: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """The nodes of highest (degree, out-degree, id), degrees perturbed by Gumbel noise where asked."""
    degree = (F.col("n_out") + F.col("n_in")).cast("double")
    if noise:
        degree = degree - noise * F.log(-F.log(F.greatest(F.rand(seed), F.lit(1e-12))))
    return degrees(edges).withColumn("degree", degree).orderBy(F.desc("degree"), F.desc("n_out"), F.desc("id")).limit(most)


def collapsed(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges between blocks (id, component); loops go, and equal (src, tgt, relation) keep the highest score."""
    return mapped(edges, blocks).groupBy("src", "tgt", "relation").agg(F.max("score").alias("score"))


def hyperedges(edges: DataFrame) -> DataFrame:
    """One hyperedge for each (src, pred): its tail and sorted head."""
    return edges.groupBy("src", "pred").agg(F.array_sort(F.collect_set("tgt")).alias("head"), F.max("score").alias("score")).select(F.array("src").alias("tail"), "head", F.col("pred").alias("predicate"), "score")


def pairwise(hyper: DataFrame, by_head: bool = True) -> DataFrame:
    """Tail x head edges; the score is divided among the heads where asked."""
    score = F.col("score") / F.size("head") if by_head else F.col("score")
    return hyper.select(F.explode("tail").alias("src"), "head", "predicate", score.alias("score")).select("src", F.explode("head").alias("tgt"), "predicate", "score")


def two_section(incidence: DataFrame, block: int = 1024) -> DataFrame:
    """(a, b, n): vertices that share n hyperedges; incidence: (vid, eid).

    Pairs are the result. A hyperedge's members meet in pairs of blocks of about block members, so one of any size is dealt over
    many tasks, and blocks are paired once, not both ways.
    """
    rows = incidence.select("vid", "eid").distinct()
    sizes = rows.groupBy("eid").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = rows.join(sizes, "eid").withColumn("own", F.pmod(F.xxhash64("vid"), "blocks").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = spread.select("eid", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "vid")
    keys = ["eid", "low", "high"]
    left, right = met.select(*keys, F.col("own").alias("own_a"), F.col("vid").alias("a")), met.select(*keys, F.col("own").alias("own_b"), F.col("vid").alias("b"))
    pairs = left.join(right, keys).where((F.col("a") < F.col("b")) & ((F.col("own_a") != F.col("own_b")) | (F.col("low") == F.col("high"))))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def bisimulation(nodes: DataFrame, edges: DataFrame, key: Column | str = "key") -> DataFrame:
    """(id, component): the coarsest split of equal-key blocks in which members have equal (relation, block) sets both ways."""
    name = lambda signature: F.sha2(F.to_json(signature), 256)
    blocks = cut(nodes.select("id", F.sha2(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), 256).alias("block")), "blocks")
    before = blocks.select("block").distinct().count()
    for _ in range(ROUNDS):
        side = lambda mine, other, as_: edges.join(blocks.select(F.col("id").alias(other), "block"), other).groupBy(F.col(mine).alias("id")).agg(F.array_sort(F.collect_set(F.struct("relation", "block"))).alias(as_))  # noqa: B023, E731
        signed = blocks.join(side("src", "tgt", "down"), "id", "left").join(side("tgt", "src", "up"), "id", "left")
        blocks = cut(signed.select("id", name(F.struct("block", "down", "up")).alias("block")), "blocks")
        after = blocks.select("block").distinct().count()
        if after == before:
            least = blocks.groupBy("block").agg(F.min("id").alias("component"))
            return blocks.join(least, "block").select("id", "component")
        before = after
    raise RuntimeError("bisimulation did not settle")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id) at no edge."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("tgt"))
    return nodes.select("id").distinct().join(ends, "id", "left_anti")


def undeclared(properties: DataFrame, domains: DataFrame, ranges: DataFrame) -> DataFrame:
    """Properties (p) with neither a domain nor a range."""
    return properties.select("p").distinct().join(domains.select("p"), "p", "left_anti").join(ranges.select("p"), "p", "left_anti")


def twins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, keeps): nodes that have the same sources and the same targets as keeps, the least of them."""
    side = lambda mine, other, name: edges.groupBy(F.col(mine).alias("id")).agg(F.array_sort(F.collect_set(other)).alias(name))
    rows = nodes.select("id").distinct().join(side("src", "tgt", "down"), "id", "left").join(side("tgt", "src", "up"), "id", "left")
    rows = rows.select("id", F.sha2(F.to_json(F.struct(F.coalesce("down", F.array()).alias("d"), F.coalesce("up", F.array()).alias("u"))), 256).alias("signature"))
    same = rows.groupBy("signature").agg(F.min("id").alias("keeps"))
    return rows.join(same, "signature").where("id <> keeps").select("id", "keeps")


def resolved_endpoints(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """(id, node, is_new) of incoming (id, keys) against known classes (id, keys): the class of that id, or else the least that shares a key, or else itself as a new one."""
    by_id = incoming.select("id").join(known.select("id"), "id").select("id", F.col("id").alias("node"), F.lit(0).alias("rank"))
    mine, theirs = incoming.select("id", F.explode("keys").alias("key")), known.select(F.col("id").alias("node"), F.explode("keys").alias("key"))
    by_key = mine.join(theirs, "key").select("id", "node", F.lit(1).alias("rank"))
    found = by_id.union(by_key).groupBy("id").agg(F.min(F.struct("rank", "node")).alias("best"))
    return incoming.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("best.node", "id").alias("node"), F.col("best").isNull().alias("is_new"))


def resolved_keys(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, id): the last entry (id, name, iri, seq) whose name or IRI is the key, or else the first whose local part is."""
    local = F.regexp_extract(F.coalesce("iri", "name"), "([^#/]*)$", 1)
    exact = entries.select(F.explode(F.array("name", "iri")).alias("key"), "id", F.lit(0).alias("rank"), (-F.col("seq")).alias("at"))
    rows = exact.union(entries.select(local.alias("key"), "id", F.lit(1).alias("rank"), F.col("seq").alias("at"))).where("key <> ''")
    best = keys.select("key").distinct().join(rows, "key").groupBy("key").agg(F.min(F.struct("rank", "at", "id")).alias("best"))
    return best.select("key", F.col("best.id").alias("id"))


def path_edges(edges: DataFrame, nodes: DataFrame, most: int | None = None, hierarchy: float = 2.0) -> DataFrame:
    """(src, predicate, tgt) of the edges between nodes: subclass from the score of hierarchy on, else related."""
    pred = F.when(F.col("score") >= hierarchy, "subClassOf").otherwise("related")
    rows = induced(edges, nodes).select("src", pred.alias("predicate"), "tgt").distinct().orderBy("src", "tgt", "predicate")
    return rows if most is None else rows.limit(most)


def rank_partitions(ranks: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, rank, block): nodes of one rank that mean the same (equal key) stand in the block of their least id; a node without a key is alone."""
    rows = ranks.join(keys, "id", "left").withColumn("_key", F.coalesce(F.col("key").cast("string"), F.concat(F.lit("\x1f"), F.col("id"))))
    least = rows.groupBy("rank", "_key").agg(F.min("id").alias("block"))
    return rows.join(least, ["rank", "_key"]).select("id", "rank", "block")


def structural_signatures(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, down, up): the sets of (relation, block) of a node's targets and of its sources; blocks: (id, block)."""
    side = lambda mine, other, name: edges.join(blocks.select(F.col("id").alias(other), "block"), other).groupBy(F.col(mine).alias("id")).agg(F.array_sort(F.collect_set(F.struct("relation", "block"))).alias(name))
    none = F.array().cast("array<struct<relation:string,block:string>>")
    rows = blocks.select("id").join(side("src", "tgt", "down"), "id", "left").join(side("tgt", "src", "up"), "id", "left")
    return rows.select("id", F.coalesce("down", none).alias("down"), F.coalesce("up", none).alias("up"))


def star(incidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bipartite graph of a hypergraph: nodes (id, part: node or edge) and its edges (src: hyperedge, tgt: vertex)."""
    rows = incidence.select("eid", "vid").distinct()
    nodes = rows.select(F.col("vid").alias("id"), F.lit("node").alias("part")).union(rows.select("eid", F.lit("edge"))).distinct()
    return nodes, rows.select(F.col("eid").alias("src"), F.col("vid").alias("tgt"))


def edited(incidence: DataFrame, put: DataFrame | None = None, extend: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """Incidence (eid, vid) without the hyperedges of remove (eid), with those of put in place of any of that name, and with the members of extend added."""
    rows = incidence.select("eid", "vid")
    for gone in (remove, put):
        if gone is not None:
            rows = rows.join(gone.select("eid").distinct(), "eid", "left_anti")
    for more in (put, extend):
        if more is not None:
            rows = rows.unionByName(more.select("eid", "vid"))
    return rows.distinct()


def sizes(incidence: DataFrame) -> DataFrame:
    """How many hyperedges, their least, greatest and mean size, and the share of those of one vertex."""
    each = incidence.groupBy("eid").agg(F.count_distinct("vid").alias("size"))
    return each.agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most"), F.avg("size").alias("mean"), F.avg((F.col("size") == 1).cast("double")).alias("singletons"))


def filtered_section(incidence: DataFrame, least: int = 1, k: int | None = None, keep: DataFrame | None = None) -> DataFrame:
    """(src, tgt, score) of the two-section: pairs of least shared hyperedges and more, of the k strongest of either end, among keep (id)."""
    rows = two_section(incidence).where(F.col("n") >= least).select(F.col("a").alias("src"), F.col("b").alias("tgt"), F.col("n").alias("score"))
    rows = rows if keep is None else induced(rows, keep)
    return rows if k is None else strongest(rows, k)
