"""Connected components, and joins whose heaviest keys skip the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.core import cut

#: Keys that hold at least one row in HEAVY are joined by broadcast; there can be no more of them than HEAVY.
HEAVY = 1000
ROUNDS = 200


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """rows left join table (one row for each key).

    heavy: the part of table whose keys hold at least one of HEAVY rows each, so at most HEAVY rows;
    it is broadcast, and no other key brings more than that share of rows to one task.
    """
    new = [c for c in table.columns if c not in keys]
    marked = rows.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), keys, "left")
    hot = marked.where("_heavy").drop("_heavy")
    rest = marked.where("_heavy IS NULL").drop("_heavy", *new).join(table, keys, "left")
    return hot.unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for each id that has a link.

    Each round takes the smallest label among neighbours and then the label's own label, so path
    lengths halve; tables between rounds are cut, and a round's joins are of plain scans.
    """
    edges = cut(links.select(F.col("a").alias("id"), F.col("b").alias("to")).union(links.select("b", "a")).distinct(), "edges")
    labels = cut(edges.groupBy("id").agg(F.least("id", F.min("to")).alias("component")), "labels")
    for _ in range(ROUNDS):
        near = edges.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("component").alias("near"))
        after = cut(labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("before")), "labels")
        parents = after.select(F.col("id").alias("component"), F.col("component").alias("parent"))
        jumped = cut(after.join(parents, "component").select("id", F.least("component", "parent").alias("component"), "before"), "labels")
        labels = jumped.select("id", "component")
        if jumped.where("component <> before").isEmpty():
            return labels
    raise RuntimeError(f"no end after {ROUNDS} rounds")
