"""Which thoughts to ask about: profiles from the closure, clusters, representatives, priorities, budgets.

Profiles and clusters are tables. Only the chosen representatives (one for each cluster) reach the
driver, and of them only as many as the budget and its shifted alternatives need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.lineage import cut
from weft.operators import graph as G
from weft.operators.tables import first_per
from weft.operators.vectors import EPSILON, norm


def profiles(nodes: DataFrame, edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """id, rank (longest way from a source; 0 on a cycle), n_above, n_below (nodes that reach it, that it reaches) and score.

    score: how evenly a yes or no about the node parts the graph, n_below * (n - n_below).
    """
    ids = cut(nodes.select("id").distinct(), "nodes")
    back = edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    level, _ = G.peeled(back)
    reach = G.closure(edges) if reach is None else reach
    below = reach.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_below"))
    above = reach.groupBy(F.col("tgt").alias("id")).agg(F.count("*").alias("n_above"))
    rows = ids.join(level, "id", "left").join(above, "id", "left").join(below, "id", "left").na.fill(0)
    total = ids.agg(F.count("*").alias("n"))
    # one row: a constant
    return rows.crossJoin(F.broadcast(total)).select("id", "rank", "n_above", "n_below", (F.col("n_below") * (F.col("n") - F.col("n_below"))).alias("score"))


def features(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """id and vector: the unit embedding with rank, n_above and n_below, each as a share of the greatest."""
    most = found.agg(*(F.greatest(F.max(c), F.lit(1)).alias(f"most_{c}") for c in ("rank", "n_above", "n_below")))
    rows = found.join(vectors, "id").crossJoin(F.broadcast(most))  # one row: constants
    unit = F.transform("vector", lambda x: x.cast("double") / (norm(F.col("vector")) + EPSILON))
    return rows.select("id", F.concat(unit, F.array(*((F.col(c) / F.col(f"most_{c}")).cast("double") for c in ("rank", "n_above", "n_below")))).alias("vector"))


def representatives(found: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster and id: of the members within one rank of the cluster's lower median member, the one of highest score (the least id on ties)."""
    rows = clusters.join(found, "id")
    order = W.partitionBy("cluster").orderBy("rank", "id")
    placed = rows.withColumn("_at", F.row_number().over(order)).withColumn("_n", F.count("*").over(W.partitionBy("cluster")))
    middle = placed.where(F.col("_at") == F.floor((F.col("_n") + 1) / 2)).select("cluster", F.col("rank").alias("_median"))
    near = rows.join(middle, "cluster").where(F.abs(F.col("rank") - F.col("_median")) <= 1)
    return first_per(near, ["cluster"], [F.desc("score"), "id"]).select("cluster", "id")


def priorities(found: DataFrame, clusters: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """cluster, n and priority = n * (1 + diversity) * (1 + spread).

    spread: the range of ranks as a share of the greatest rank. diversity: 1 less the mean cosine of all pairs of members (each
    with itself too), which is the squared length of the mean unit vector, so no pair is made; 0.5 for one member or where vectors are missing.
    """
    rows = clusters.join(found.select("id", "rank"), "id")
    most = found.agg(F.greatest(F.max("rank"), F.lit(1)).alias("most"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("n"), (F.max("rank") - F.min("rank")).alias("range")).crossJoin(F.broadcast(most))  # one row: a constant
    if vectors is None:
        mixed = sizes.withColumn("diversity", F.lit(0.5))
    else:
        unit = rows.join(vectors, "id").select("cluster", "id", F.posexplode(F.transform("vector", lambda x: x.cast("double") / F.greatest(norm(F.col("vector")), F.lit(1e-12)))).alias("i", "x"))
        total = unit.groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.count("*").alias("have"))
        square = total.groupBy("cluster").agg(F.sum(F.col("x") * F.col("x")).alias("square"), F.min("have").alias("have"))
        known = (F.col("n") > 1) & (F.col("have") == F.col("n"))
        mixed = sizes.join(square, "cluster", "left").withColumn("diversity", F.when(known, 1 - F.col("square") / (F.col("n") * F.col("n"))).otherwise(0.5))
    return mixed.select("cluster", "n", (F.col("n") * (1 + F.col("diversity")) * (1 + F.col("range") / F.col("most"))).alias("priority"))


def expected_left(reach: DataFrame, nodes: DataFrame, asked: list[str], trials: DataFrame) -> DataFrame:
    """target and how many candidates are left if the asked nodes are answered for the target: yes if a node reaches it.

    A yes strikes what is above the asked node out, a no what is below it and itself. reach: the graph's closure.
    """
    spark = nodes.sparkSession
    questions = spark.createDataFrame([(a,) for a in asked], "asked string")
    mine = F.broadcast(questions)  # as many as the budget
    said = trials.select(F.col("id").alias("target")).crossJoin(mine).join(reach.select(F.col("src").alias("asked"), F.col("tgt").alias("target"), F.lit(True).alias("yes")), ["asked", "target"], "left")
    below = reach.join(mine.withColumnRenamed("asked", "src"), "src").select(F.col("src").alias("asked"), F.col("tgt").alias("id"), F.lit(False).alias("when")).unionByName(questions.select("asked", F.col("asked").alias("id"), F.lit(False).alias("when")))
    above = reach.join(mine.withColumnRenamed("asked", "tgt"), "tgt").select(F.col("tgt").alias("asked"), F.col("src").alias("id"), F.lit(True).alias("when"))
    struck = said.withColumn("when", F.coalesce("yes", F.lit(False))).join(below.unionByName(above).distinct(), ["asked", "when"]).select("target", "id").distinct()
    struck = struck.join(nodes.select("id"), "id", "left_semi").groupBy("target").agg(F.count("*").alias("struck"))
    total = nodes.select("id").distinct().count()
    return trials.select(F.col("id").alias("target")).join(struck, "target", "left").select("target", (F.lit(total) - F.coalesce("struck", F.lit(0))).alias("left"))


def chosen_queries(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, budget: int, vectors: DataFrame | None = None, quantile: float = 0.9, trials: int = 50, seed: int = 42) -> list[str]:
    """The ids of the nodes to ask, budget at most: representatives of the clusters of highest priority, filled up with other members.

    With more clusters than the budget, the sets that begin one and two clusters later are tried too; the one with the least quantile
    of expected_left() over trials targets (drawn by hash) is taken.
    """
    reach = G.closure(edges)
    found = cut(profiles(nodes, edges, reach), "profiles")
    best = representatives(found, clusters).join(priorities(found, clusters, vectors), "cluster").orderBy(F.desc("priority"), "cluster")
    order = [r.id for r in best.select("id").limit(budget + 2).collect()]
    base = order[:budget]
    if len(base) < budget:
        ranked = priorities(found, clusters, vectors).select("cluster", "priority")
        taken = nodes.sparkSession.createDataFrame([(i,) for i in base], "id string") if base else None
        rest = clusters.join(ranked, "cluster")
        rest = rest if taken is None else rest.join(F.broadcast(taken), "id", "left_anti")
        base += [r.id for r in rest.orderBy(F.desc("priority"), "cluster", "id").limit(budget - len(base)).collect()]
    sets = [base] + [order[i : i + budget] for i in (1, 2) if len(order) >= i + budget]
    if len(sets) == 1:
        return base
    targets = cut(nodes.select("id").distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(trials), "targets")
    scored = [(expected_left(reach, nodes, s, targets).agg(F.percentile("left", quantile)).first()[0], i) for i, s in enumerate(sets)]
    return sets[min(scored)[1]]


def candidates_left(nodes: DataFrame, edges: DataFrame, answers: DataFrame) -> DataFrame:
    """id of the nodes that the answers (id, yes) leave: a yes strikes what is above its node out, a no what is below it and itself."""
    reach = cut(G.closure(edges), "reach")
    above = answers.where("yes").join(reach.withColumnRenamed("tgt", "id"), "id").select(F.col("src").alias("id"))
    below = answers.where("NOT yes").join(reach.withColumnRenamed("src", "id"), "id").select(F.col("tgt").alias("id"))
    struck = above.union(below).union(answers.where("NOT yes").select("id")).distinct()
    return nodes.select("id").distinct().join(struck, "id", "left_anti")
