"""Runs of an agent as graphs: trees of thoughts, typed edges, paths, statistics.

Thoughts: (id, parent_id, kind, ...); edges: (id, src, dst, kind, seq). Walks are loops of joins whose
tables are cut each round, so a run of any length, and all runs at once, need no task of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.lineage import cut
from weft.operators.tables import first_per

# The kind of the edge into a thought of a kind, and how a view names edge kinds.
EDGE_INTO = {"reasoning": "justifies", "tool_call": "tool_invocation", "tool_result": "tool_invocation", "reflection": "reflects"}
VIEW_EDGE = {"justifies": "reasoning", "tool_invocation": "tool_call", "tool_result_of": "tool_call", "reflects": "reflection"}
VIEW_RESPONSE = {"reasoning": "reasoning", "tool_call": "tool", "tool_result": "tool"}


def _named(column: str, names: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for key, value in names.items():
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out


def trace_edges(thoughts: DataFrame) -> DataFrame:
    """src, dst, kind: an edge from each parent that exists; its kind is the child's."""
    known = thoughts.select(F.col("id").alias("src"))
    rows = thoughts.select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), _named("kind", EDGE_INTO, "next").alias("kind"))
    return rows.where("src IS NOT NULL").join(known, "src", "left_semi").select("src", "dst", "kind")


def step_edges(steps: DataFrame) -> DataFrame:
    """src, dst of the steps (run, i, id) of each run, one after another."""
    before = F.lag("id").over(W.partitionBy("run").orderBy("i"))
    return steps.select("run", before.alias("src"), F.col("id").alias("dst")).where("src IS NOT NULL")


def depths(thoughts: DataFrame) -> DataFrame:
    """id, root, depth and leaf of each thought that hangs on a root; a parent that does not exist makes a root.

    Ancestors are doubled each round: paths of length n end after log2(n) rounds. Thoughts on a cycle of
    parents have no root and are left out.
    """
    nodes = thoughts.select("id", "parent_id").dropDuplicates(["id"])
    roots = nodes.join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id")
    above = nodes.join(roots, "id", "left_anti").select("id", F.col("parent_id").alias("top"), F.lit(1).alias("depth"))
    climbing = cut(above.unionByName(roots.select("id", F.col("id").alias("top"), F.lit(0).alias("depth"))), "climbing")
    total = climbing.count()
    for _ in range(max(1, total).bit_length() + 1):
        step = climbing.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        after = cut(climbing.join(step, "top").select("id", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("next") != F.col("top")).alias("moved")), "climbing")
        climbing = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    done = climbing.join(roots.select(F.col("id").alias("top")), "top", "left_semi")
    parents = nodes.select(F.col("parent_id").alias("id")).where("id IS NOT NULL").distinct().withColumn("parent", F.lit(True))
    return done.join(parents, "id", "left").select("id", F.col("top").alias("root"), "depth", F.col("parent").isNull().alias("leaf"))


def paths_to_root(thoughts: DataFrame, of: DataFrame) -> DataFrame:
    """id and path (ids, root first) of the thoughts named in of (id)."""
    parents = thoughts.select("id", "parent_id").dropDuplicates(["id"])
    known = parents.select(F.col("id").alias("at"), F.col("parent_id").alias("up"))
    open_ = cut(of.select("id").distinct().join(parents.select("id"), "id", "left_semi").select("id", F.col("id").alias("at"), F.array("id").alias("path")), "open")
    done = None
    while not open_.isEmpty():
        step = open_.join(known, "at", "left")
        on = F.col("up").isNotNull() & F.col("exists") & ~F.array_contains("path", F.col("up"))
        there = known.select(F.col("at").alias("up"), F.lit(True).alias("exists"))
        step = cut(step.join(there, "up", "left").withColumn("exists", F.coalesce("exists", F.lit(False))).withColumn("on", F.coalesce(on, F.lit(False))), "step")
        ended = step.where("NOT on").select("id", "path")
        done = ended if done is None else done.unionByName(ended)
        open_ = step.where("on").select("id", F.col("up").alias("at"), F.concat(F.array("up"), F.col("path")).alias("path"))
    return of.sparkSession.createDataFrame([], done_schema(of)) if done is None else done


def done_schema(of: DataFrame) -> str:
    kind = of.schema["id"].dataType.simpleString()
    return f"id {kind}, path array<{kind}>"


def shortest_paths(edges: DataFrame, pairs: DataFrame, within: str | None = None) -> DataFrame:
    """start, end, node_ids, edge_ids of a shortest path (in edges) of each of pairs (start, end), the first in the order
    in which edges (id, src, dst, seq) leave each node, breadth first; pairs without a path have no row.

    within: a column of pairs and edges; a path then stays on edges of that value.
    """
    more = [within] if within else []
    steps = edges.select("src", "dst", F.col("id").alias("edge"), "seq", *more)
    frontier = cut(pairs.distinct().select("start", "end", *more, F.col("start").alias("at"), F.array("start").alias("node_ids"), F.array().cast(f"array<{edges.schema['id'].dataType.simpleString()}>").alias("edge_ids"), F.array().cast("array<long>").alias("turns")), "frontier")
    seen = frontier.select("start", "end", *more, "at")
    found = []
    while not frontier.isEmpty():
        found.append(frontier.where("at = end").select("start", "end", *more, "node_ids", "edge_ids"))
        on = [F.col("at") == F.col("src"), *(F.col(f"f.{c}") == F.col(f"s.{c}") for c in more)]
        near = frontier.where("at <> end").alias("f").join(steps.alias("s"), on)
        near = near.select("start", "end", *(F.col(f"f.{c}") for c in more), F.col("dst").alias("at"), F.array_append("node_ids", F.col("dst")).alias("node_ids"), F.array_append("edge_ids", F.col("edge")).alias("edge_ids"), F.array_append("turns", F.col("seq").cast("long")).alias("turns"))
        near = near.join(seen, ["start", "end", *more, "at"], "left_anti")
        frontier = cut(first_per(near, ["start", "end", *more, "at"], ["turns", "edge_ids"]), "frontier")
        seen = cut(seen.unionByName(frontier.select(*seen.columns)), "seen")
    out = found[0]
    for more_found in found[1:]:
        out = out.unionByName(more_found)
    return out


def run_paths(thoughts: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id and path of every run: from its first thought tagged user_query to its last tagged final_result (else the
    first and last in time), over its own edges.
    """
    tagged = lambda tag: F.array_contains("tags", tag)
    time = F.struct("created_at", "id")
    ends = thoughts.groupBy("run_id").agg(
        F.coalesce(F.min_by("id", F.when(tagged("user_query"), time)), F.min_by("id", time)).alias("start"),
        F.coalesce(F.max_by("id", F.when(tagged("final_result"), time)), F.max_by("id", time)).alias("end"),
    )
    own = edges.join(thoughts.select(F.col("id").alias("src"), "run_id"), ["src", "run_id"], "left_semi").join(thoughts.select(F.col("id").alias("dst"), "run_id"), ["dst", "run_id"], "left_semi")
    return shortest_paths(own, ends, within="run_id")


def deduplicated(thoughts: DataFrame, order: str = "seq") -> DataFrame:
    """One thought for each (question, answer): the first one's id; tags merged and sorted; the first value of each meta key."""
    key = F.sha2(F.concat(F.coalesce("question", F.lit("")), F.lit("|"), F.coalesce("answer", F.lit(""))), 256)
    rows = thoughts.withColumn("key", key)
    first = rows.groupBy("key").agg(F.min_by("id", order).alias("id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags"), F.count("*").alias("n"))
    if "meta" not in thoughts.columns:
        return first
    pairs = rows.select("key", order, F.explode("meta").alias("name", "value"))
    metas = pairs.groupBy("key", "name").agg(F.min_by("value", order).alias("value")).groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("meta"))
    return first.join(metas, "key", "left")


def prompt_response_view(thoughts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prompts, responses and edges as a chat viewer wants them; an edge without a confidence weighs 1."""
    text = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(""))
    prompts = thoughts.where("kind = 'prompt'").select("id", text("question", "content").alias("content"), F.coalesce("prompt_type", F.lit("user")).alias("prompt_type"))
    responses = thoughts.where("kind <> 'prompt'").select("id", text("answer", "content").alias("content"), _named("kind", VIEW_RESPONSE, "assistant").alias("response_type"))
    links = edges.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), _named("kind", VIEW_EDGE, "flow").alias("edge_type"), F.coalesce("confidence", F.lit(1.0)).alias("weight"))
    return prompts, responses, links


def merged_runs(thoughts: DataFrame, edges: DataFrame, order: str = "run_order") -> tuple[DataFrame, DataFrame]:
    """One graph of several runs: the first run's thought (and edge) of an id counts; edges need both ends."""
    nodes = first_per(thoughts, ["id"], [order])
    ends = nodes.select("id")
    links = first_per(edges, ["id"], [order])
    links = links.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, links


def statistics(thoughts: DataFrame, edges: DataFrame) -> DataFrame:
    """measure, name, value: thoughts and edges by kind, greatest and mean depth, characters."""
    row = lambda df, measure: df.select(F.lit(measure).alias("measure"), "name", F.col("value").cast("double").alias("value"))
    by = lambda df, column, measure: row(df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("value")), measure)
    whole = thoughts.agg(F.max("depth").alias("greatest_depth"), F.avg("depth").alias("mean_depth"), F.sum("chars").alias("chars"), F.avg("chars").alias("mean_chars"))
    shaped = whole.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c in whole.columns))).alias("x")).select("x.*")
    return by(thoughts, "kind", "thoughts").unionByName(by(edges, "kind", "edges")).unionByName(row(shaped, "whole"))


def reasoning_depths(steps: DataFrame) -> DataFrame:
    """steps (trace, seq, kind, delta) with the depth at which each is told, and the step it stands under.

    A reasoning step goes deeper by delta, a step back goes up by delta, not above 0, and is no thought.
    The depth after a step is its running sum, less the lowest the sum has been below 0.
    """
    order = W.partitionBy("trace").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    move = F.when(F.col("kind") == "reasoning", F.coalesce("delta", F.lit(1))).when(F.col("kind") == "step_back", -F.coalesce("delta", F.lit(1))).otherwise(0)
    rows = steps.withColumn("_sum", F.sum(move).over(order))
    rows = rows.withColumn("depth", (F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(order))).cast("int"))
    told = rows.where("kind <> 'step_back'")
    return told.withColumn("parent", F.lag("seq").over(W.partitionBy("trace").orderBy("seq"))).drop("_sum")


def durations(steps: DataFrame) -> DataFrame:
    """steps (started, ended, ...) with duration_ms; null while a step has not ended."""
    return steps.withColumn("duration_ms", (F.col("ended").cast("double") - F.col("started").cast("double")) * 1000)
