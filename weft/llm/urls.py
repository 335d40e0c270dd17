"""Operator 10: URL filter by a path-template tree with smoothed purity.

The path of a URL is split into segments; digits in a segment stand for any number. Each host has a
tree of segments, generalised from the root: children whose labels do not differ from those of all
their siblings together (two-proportion z below Z, or too few labels to say) are merged into one
wildcard and only the others keep a branch of their own, however many children a node has. Levels
are built until no node has labels enough for a branch, as then no deeper one has: the segments
that are left are wildcards.

A template's purity is its share of good labels, smoothed towards its host's, and that towards the
share over all labels, by STRENGTH pseudo-labels each; below PURITY it is rejected.

Rules (host, path) come first: a rule fits its host and all subdomains if the path starts with the
rule's; the longest fitting rule decides.

Pages are aggregated to distinct (host, segments) before anything is built, and each level works on
that table. Tables are joined by lookup(): the keys with a thousandth of all rows are broadcast.

Defined results: a null URL, or one without ://, has an empty host and path and the verdict of
that host's tree; labels that are null are ignored, disagreeing ones count by their mean; repeated
page_id rows give one row each; extra columns (html among them) are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.core import cut
from weft.llm.graph import HEAVY, lookup

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
Z = 1.96
LEAST_LABELS = 5
STRENGTH = 4.0
PURITY = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def route_of(path: Column) -> Column:
    """The path's segments joined by slashes, digits generalised."""
    return F.regexp_replace(F.array_join(F.filter(F.split(path, "/"), lambda x: x != ""), "/"), "[0-9]+", "#")


def by_rule(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def heavy(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The part of table whose keys hold a thousandth of rows or more."""
    least = max(2, rows.count() // HEAVY)
    return table.join(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*keys), keys)


def templates(urls: DataFrame) -> DataFrame:
    """Distinct (host, route) with n, good, bad and the template they belong to."""
    tree = urls.groupBy("host", "route").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    tree = cut(tree.select("*", F.when(F.col("route") == "", 0).otherwise(F.size(F.split("route", "/"))).alias("size"), F.lit("").alias("template")), "tree")
    keys, level = ["host", "template"], 0
    while True:
        part = F.get(F.split("route", "/"), F.lit(level))
        children = cut(tree.where(F.col("size") > level).groupBy(*keys, part.alias("part")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "children")
        parents = children.groupBy(*keys).agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad")).where(F.col("all_good") + F.col("all_bad") >= 2 * LEAST_LABELS)
        parents = cut(parents, "parents")
        if parents.isEmpty():
            rest = F.repeat(F.lit("/*"), F.greatest(F.col("size") - level, F.lit(0)))
            return tree.select("host", "route", "n", "good", "bad", F.concat("template", rest).alias("template"))
        children = children.where(F.col("good") + F.col("bad") >= LEAST_LABELS)
        known = lookup(children, parents, keys, heavy(parents, children, keys)).where("all_good IS NOT NULL")
        other_good, other_bad = F.col("all_good") - F.col("good"), F.col("all_bad") - F.col("bad")
        mine, others = F.col("good") + F.col("bad"), other_good + other_bad
        pool = F.col("all_good") / F.nullif(mine + others, F.lit(0))
        spread = F.sqrt(pool * (1 - pool) * (1 / F.nullif(mine, F.lit(0)) + 1 / F.nullif(others, F.lit(0))))
        z = F.abs(F.col("good") / F.nullif(mine, F.lit(0)) - other_good / F.nullif(others, F.lit(0))) / F.nullif(spread, F.lit(0.0))
        own = known.where((mine >= LEAST_LABELS) & (others >= LEAST_LABELS) & (z >= Z)).select(*keys, "part", F.col("part").alias("branch"))
        own = cut(own, "branches")
        tree = tree.withColumn("part", part)
        tree = lookup(tree, own, [*keys, "part"], heavy(own, tree, [*keys, "part"]))
        step = F.when(F.col("size") <= level, "").otherwise(F.concat(F.lit("/"), F.coalesce("branch", F.lit("*"))))
        tree = cut(tree.withColumn("template", F.concat("template", step)).drop("branch", "part"), "tree")
        level += 1


def judged(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, template, purity and verdict of each page; labels: (page_id, good 0/1)."""
    marks = labels.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.avg("good").alias("mark"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("*", route_of(F.col("path")).alias("route"))
    rows = cut(rows.join(marks, "page_id", "left").select(*rows.columns, F.coalesce(F.col("mark"), F.lit(0.0)).alias("good"), F.coalesce(1 - F.col("mark"), F.lit(0.0)).alias("bad")), "pages")
    tree = templates(rows)
    total = tree.agg(F.sum("good"), F.sum(F.col("good") + F.col("bad"))).first()
    prior = (total[0] + 1) / (total[1] + 2) if total[1] else 1.0
    smoothed = lambda good, bad, towards: (good + STRENGTH * towards) / (good + bad + STRENGTH)
    hosts = tree.groupBy("host").agg(smoothed(F.sum("good"), F.sum("bad"), F.lit(prior)).alias("host_purity"))
    nodes = tree.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    nodes = lookup(nodes, hosts, ["host"], heavy(hosts, nodes, ["host"])).select("host", "template", smoothed(F.col("g"), F.col("b"), F.col("host_purity")).alias("purity"))
    nodes = cut(nodes, "nodes")
    keys = ["host", "route"]
    placed = cut(lookup(tree.select(*keys, "template", "n"), nodes, ["host", "template"], heavy(nodes, tree, ["host", "template"])), "placed")
    many = max(2, rows.count() // HEAVY)
    out = lookup(rows, placed.drop("n"), keys, placed.where(F.col("n") >= many).drop("n"))
    name, verdict = by_rule(rules)
    return out.select("page_id", "host", "path", name.alias("rule"), "template", "purity", F.coalesce(verdict, F.when(F.col("purity") < PURITY, "block").otherwise("allow")).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: host, path, rule and verdict of every page; a page's label is that of the document of its number."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), F.col("quality").cast("double").alias("good"))
    out = judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels)
    return out.select("page_id", "host", "path", "rule", "verdict")
