"""Small relational operators: keep-latest, first per key, eviction, prefix tries, run paths, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.operators.vectors import positions


def first_per(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merged(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key; each column's first value that is not null, in order."""
    fields = [c for c in rows.columns if c not in (*keys, order)]
    values = (F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields)
    return rows.groupBy(*keys).agg(*values)


#: Policy -> the order in which entries (frequency, last_used, ord, queue) of a tier go.
EVICTION = {
    "lru": ["last_used", "ord"],
    "lfu": ["frequency", "last_used", "ord"],
    "2q": ["_old", "_age", "last_used", "ord"],
}


def evicted(entries: DataFrame, cap: int, policy: str, tier: str = "tier") -> DataFrame:
    """Entries that go so that each tier keeps cap: those that the policy names first.

    2q: entries on probation (queue a1) go first, oldest first; then the least recently used.
    """
    probation = F.col("queue") == "a1"
    rows = entries.withColumn("_old", F.when(probation, 0).otherwise(1)).withColumn("_age", F.when(probation, F.col("ord")))
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(tier).orderBy(*EVICTION[policy])))
    sizes = entries.groupBy(tier).agg(F.count("*").alias("_size"))
    return rows.join(sizes, tier).where(F.col("_n") <= F.col("_size") - cap).drop("_n", "_size", "_old", "_age")


def prefixes(paths: DataFrame, column: str = "path") -> DataFrame:
    """prefix, depth and how many paths pass: the nodes of their trie."""
    steps = F.explode(F.sequence(F.lit(1), F.size(column)))
    return paths.select(column, steps.alias("depth")).select(F.array_join(F.slice(column, F.lit(1), F.col("depth")), "/").alias("prefix"), "depth").groupBy("prefix", "depth").agg(F.count("*").alias("n"))


def longest_prefix(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """id, prefix: the longest stored path (array) that begins each query's path; by an equi-join on prefixes."""
    steps = queries.where(F.size("path") > 0).select("id", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth"))
    tried = steps.select("id", "depth", F.array_join(F.slice("path", F.lit(1), F.col("depth")), "/").alias("prefix"))
    known = stored.select(F.array_join("path", "/").alias("prefix")).distinct()
    return tried.join(known, "prefix").groupBy("id").agg(F.max_by("prefix", "depth").alias("prefix"))


def usage(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens, seconds and the cost of priced calls; prices: (model, input, output) per million tokens."""
    rows = calls.join(F.broadcast(prices), "model", "left").withColumn("cost", (F.col("input_tokens") * F.col("input") + F.col("output_tokens") * F.col("output")) / 1e6)
    return rows.agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
    )


def majority(responses: DataFrame) -> DataFrame:
    """id, answer and agreement of the parsed responses (id, said); a tie is no; null responses are not counted."""
    counts = responses.where("said IS NOT NULL").groupBy("id").agg(F.count_if(F.col("said")).alias("yes"), F.count_if(~F.col("said")).alias("no"))
    return counts.select("id", (F.col("yes") > F.col("no")).alias("answer"), (F.greatest("yes", "no") / (F.col("yes") + F.col("no"))).alias("agreement"))


def ensemble(scores: DataFrame) -> DataFrame:
    """id and the weighted mean of its scorers (id, score, weight), each clamped to [0, 1]."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scores.where("score IS NOT NULL").groupBy("id").agg((F.sum(score * F.col("weight")) / F.sum("weight")).alias("score"))


def newest(runs: DataFrame, limit: int | None = None, time: str = "created_at", key: str = "run_id") -> DataFrame:
    """Runs, the newest first; ties by id, the greater first."""
    rows = runs.orderBy(F.desc(time), F.desc(key))
    return rows if limit is None else rows.limit(limit)


def load_run(runs: DataFrame, run_id, key: str = "run_id") -> DataFrame:
    """The rows of one run; the filter reaches the scan."""
    return runs.where(F.col(key) == run_id)


def latest_ids(rows: DataFrame, limit: int, times: list[str], key: str = "run_id") -> DataFrame:
    """The ids of the runs seen last, the latest first; a row's time is the first of times that it has."""
    seen = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.coalesce(*times)).alias("_t"))
    return seen.orderBy(F.desc("_t"), F.desc(key)).limit(limit).select(key)


def run_endpoints(rows: DataFrame, run: str = "run_id", time: str = "created_at") -> DataFrame:
    """start: the first user_query of each run, end: its last final_result (tags); else the first and last in time."""
    tagged = lambda tag: F.array_contains("tags", tag)
    at = F.struct(time, "id")
    return rows.groupBy(run).agg(
        F.coalesce(F.min_by("id", F.when(tagged("user_query"), at)), F.min_by("id", at)).alias("start"),
        F.coalesce(F.max_by("id", F.when(tagged("final_result"), at)), F.max_by("id", at)).alias("end"),
    )


def compared_previous(runs: DataFrame, keys: list[str]) -> DataFrame:
    """runs (keys, run_id, status, fingerprint) that have an earlier one of the same keys that passed: its id, and whether the fingerprint is the same."""
    before = W.partitionBy(*keys).orderBy("run_id").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("status") == "passed", F.struct("run_id", "fingerprint")), ignorenulls=True).over(before)
    rows = runs.withColumn("_p", last).where("_p IS NOT NULL")
    return rows.withColumn("previous", F.col("_p.run_id")).withColumn("reproducible", F.col("_p.fingerprint") == F.col("fingerprint")).drop("_p")


# Words that say little of a text.
STOP_WORDS = ("the", "of", "and", "a", "to", "in", "for", "on", "with", "as", "by", "an", "is", "are", "or", "that", "from", "at", "be", "this", "it", "its", "into", "within", "which", "such")


def top_terms(texts: DataFrame, limit: int, keys: list[str], exclude: list[str] = (), column: str = "text") -> DataFrame:
    """keys, term, n of the limit commonest words of each of keys: three letters and more, no stop words, none of exclude; ties by word."""
    words = texts.select(*keys, F.explode(F.regexp_extract_all(F.lower(column), F.lit("[a-z][a-z-]{2,}"), 0)).alias("term"))
    gone = [*STOP_WORDS, *(e.lower() for e in exclude)]
    counts = words.where(~F.col("term").isin(*gone)).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    at = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "term"))
    return counts.withColumn("_at", at).where(F.col("_at") <= limit).drop("_at")


def duplicate_labels(labels: DataFrame, least: int = 2) -> DataFrame:
    """label and n of labels (subject, label) that least pairs of subject and label or more have."""
    return labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def coverage(nodes: DataFrame, having: DataFrame) -> DataFrame:
    """The percentage of nodes (id) among having (id), to one digit, half to even; 100 without nodes."""
    has = having.select("id", F.lit(1.0).alias("has")).distinct()
    share = F.avg(F.coalesce("has", F.lit(0.0)))
    return nodes.select("id").distinct().join(has, "id", "left").agg(F.coalesce(F.bround(100 * share, 1), F.lit(100.0)).alias("coverage"))


def patterns(turns: DataFrame) -> DataFrame:
    """Conversations, turns, the mean, greatest and least length, and all kinds of turns (conversation, kind, tools), in one row."""
    each = turns.groupBy("conversation").agg(F.count("*").alias("n"))
    kinds = turns.agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    whole = each.agg(F.count("*").alias("conversations"), F.sum("n").alias("turns"), F.avg("n").alias("mean"), F.max("n").alias("longest"), F.min("n").alias("shortest"))
    return whole.crossJoin(kinds)  # one row each


def recall(answers: DataFrame) -> DataFrame:
    """id and the share of gold labels (id, label, answer) that the answer holds, case aside."""
    return answers.groupBy("id").agg(F.avg(F.contains(F.lower("answer"), F.lower("label")).cast("double")).alias("recall"))


def sampled_parents(children: DataFrame, k: int, low: int = 3, high: int = 8) -> DataFrame:
    """About k parents (parent, child) that have low to high children: every n // k-th in the order of name."""
    rows = children.groupBy("parent").agg(F.count_distinct("child").alias("n")).where(F.col("n").between(low, high))
    step = max(1, rows.count() // k)
    return positions(rows, [F.col("parent")], "at").where((F.col("at") - 1) % step == 0).orderBy("at").limit(k).select("parent", "n")


def hottest(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Cache entries by hits; ties by tier and key."""
    rows = entries.orderBy(F.desc("frequency"), "tier", "key")
    return rows if limit is None else rows.limit(limit)


def multigraph_counts(edges: DataFrame) -> DataFrame:
    """Nodes, edges and distinct pairs of a multigraph, in one row."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("id")).agg(F.count_distinct("id").alias("nodes"))
    return edges.agg(F.count("*").alias("edges"), F.count_distinct("src", "tgt").alias("pairs")).crossJoin(ends)  # one row each


def parallel_sums(edges: DataFrame) -> DataFrame:
    """(src, tgt, score, n): parallel edges as one, their scores summed."""
    return edges.groupBy("src", "tgt").agg(F.sum("score").alias("score"), F.count("*").alias("n"))


def first_occurrences(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct keys with the place at which each first stands."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))
