"""Operator 3: quality rules with risk-controlled thresholds; DataFrame functions only.

Each rule rejects documents whose statistic reaches a cutoff. For every stratum (language), rule and
cutoff of a fixed grid, the labelled good documents that the cutoff would reject are counted: k of
n. The rules share RISK evenly: a cutoff is safe if k is so small that a false rejection rate of
r = RISK / rules or more has probability at most DELTA over the number of tests (Bonferroni over
strata, rules and cutoffs), by the exact binomial tail P(Bin(n, r) <= k). The lowest safe cutoff of
each stratum and rule is used, so with probability 1 - DELTA the rules together falsely reject at
most RISK of the good documents of any stratum.
Where the labels cannot show that, the rule does not reject. Above EXACT good documents the tail is
summed downward from k until terms no longer count, so its length grows with the root of n only.

Statistics are computed once, in the row, and cut; strata with a thousandth of all documents or
more (so at most a thousand of them) are looked up by broadcast, the others by a shuffle.

Defined results: null and empty texts have all counts 0 and fail the base; a null language is a
stratum of its own; labels that are null are ignored, disagreeing ones count by their mean (0.5 and
more: good); a repeated doc_id is one document, its smallest text; rows without doc_id are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.core import cut, keyed
from weft.llm.graph import HEAVY, lookup

#: What all rules together may falsely reject of a stratum.
RISK = 0.04
DELTA = 0.05
EXACT = 1_000_000
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
#: Rule -> (statistic, cutoffs from strict to lax).
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)),
    "long_words": ("word_chars / greatest(n_words, 1)", (8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 17.0, 20.0)),
}


def repeat_words(windows: Column) -> Column:
    """Words covered by 3-word windows whose value stands at two or more places; windows: (value, place) sorted."""
    again = F.filter(windows, lambda x, i: ((i > 0) & (F.get(windows, i - 1)["h"] == x["h"])) | F.coalesce(F.get(windows, i + 1)["h"] == x["h"], F.lit(False)))
    places = F.array_sort(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))
    step = lambda acc, i: F.struct((acc["total"] + i + 3 - F.greatest(i, acc["end"])).alias("total"), (i + 3).alias("end"))
    return F.aggregate(places, start, step, lambda acc: acc["total"])


def statistics(docs: DataFrame) -> DataFrame:
    """The counts of each document, and its stratum."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.trim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    rows = keyed(docs, "text", "lang").select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("stratum"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)).alias("words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    hashes = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    rows = rows.select(
        "doc_id", "stratum", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, hashes).otherwise(F.array().cast("array<long>")).alias("hashes"),
    )
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    pairs = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("windows", F.when(repeated, pairs)).drop("hashes")
    return rows.withColumn("n_repeat_words", F.when(F.col("windows").isNull(), F.lit(0).cast("long")).otherwise(repeat_words(F.col("windows")))).drop("windows")


def log_tail(n: Column, k: Column, risk: float) -> Column:
    """Logarithm of P(Bin(n, risk) <= k); k at most risk * n."""
    odds, none = math.log(risk / (1 - risk)), n * math.log(1 - risk)
    both = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    term = lambda acc, j: acc["term"] + F.log(n - j + 1) - F.log(j.cast("double")) + odds
    step = lambda acc, j: F.struct(term(acc, j).alias("term"), both(acc["sum"], term(acc, j)).alias("sum"))
    upward = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), F.struct(none.alias("term"), none.alias("sum")), step, lambda acc: acc["sum"])
    # the term of k by Loader's form of Stirling's series; the others relative to it
    rate = k / n
    stirling = lambda x: 1 / (12 * x) - 1 / (360 * x * x * x)
    real = lambda x: x.cast("double")
    top = -n * (rate * F.log(rate / risk) + (1 - rate) * F.log((1 - rate) / (1 - risk))) + stirling(real(n)) - stirling(real(k)) - stirling(real(n - k)) - F.log(2 * math.pi * k * (1 - rate)) / 2
    reach = F.least(k, F.ceil(12 * F.sqrt(n * risk)) + 50)  # terms beyond are below exp(-50) of the first
    down = lambda acc, i: acc["term"] * (k - i + 1) / (n - k + i) * ((1 - risk) / risk)
    more = lambda acc, i: F.struct(down(acc, i).alias("term"), (acc["sum"] + down(acc, i)).alias("sum"))
    one = F.lit(1.0)
    downward = top + F.log(F.aggregate(F.sequence(F.lit(1).cast("long"), reach), F.struct(one.alias("term"), one.alias("sum")), more, lambda acc: acc["sum"]))
    return F.when((n <= EXACT) | (k <= 100), upward).otherwise(downward)


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum and, by rule, the lowest safe cutoff (null: none is safe)."""
    risk /= len(RULES)
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").groupBy("doc_id").agg(F.avg("quality").alias("quality")).where("quality >= 0.5").select("doc_id")
    counts = stats.join(good, "doc_id", "left_semi").groupBy("stratum").agg(
        F.count("*").alias("n"),
        *(F.sum(F.when(F.expr(statistic) >= c, 1).otherwise(0)).alias(f"{rule}_{i}") for rule, (statistic, grid) in RULES.items() for i, c in enumerate(grid)),
    )
    tests = sum(len(grid) for _, grid in RULES.values())
    tried = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{i}").cast("long").alias("k")) for rule, (_, grid) in RULES.items() for i, c in enumerate(grid)))
    counts = cut(counts.select("stratum", "n", F.explode(tried).alias("t")).select("stratum", "n", "t.*"), "tried")
    strata = counts.select("stratum").distinct().count()
    safe = counts.where(F.col("k") <= risk * F.col("n")).where(log_tail(F.col("n"), F.col("k"), risk) <= math.log(delta / max(1, strata * tests)))
    return safe.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES))


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The counts of each document, base_failed, the rules that reject it, and kept."""
    stats = cut(statistics(docs), "rules")
    limits = cut(cutoffs(stats, labels, risk, delta), "cutoffs")
    sizes = stats.groupBy("stratum").agg(F.count("*").alias("size"))
    heavy = limits.join(sizes, "stratum").where(F.col("size") >= max(1, stats.count() // HEAVY)).drop("size")
    rows = lookup(stats, limits, ["stratum"], heavy)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejects = F.array_compact(F.array(*(F.when(F.expr(statistic) >= F.col(f"cut_{rule}"), F.lit(rule)) for rule, (statistic, _) in RULES.items())))
    rows = rows.withColumn("base_failed", failed).withColumn("rejected_by", rejects)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: counts, base verdict and verdict of every document."""
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    tests, risk = sum(len(grid) for _, grid in RULES.values()), RISK / len(RULES)
    stat = ", ".join(f"CAST({s.replace(' / ', ' AS DOUBLE) / ')} AS {rule}" for rule, (s, _) in RULES.items())
    grid = " UNION ALL ".join(f"SELECT '{rule}' AS rule, {c} AS c, {rule} >= {c} AS hit, stratum FROM g" for rule, (_, cs) in RULES.items() for c in cs)
    hit = " OR ".join(f"coalesce({rule} >= (SELECT min(c) FROM safe WHERE safe.rule = '{rule}' AND safe.stratum = st.stratum), false)" for rule in RULES)
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), again AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS m FROM win), range(0, 3) AS r(k) WHERE m > 1 GROUP BY doc_id
), st AS (
  SELECT *, {stat} FROM (
    SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN again USING (doc_id))
), g AS (
  SELECT st.* FROM st SEMI JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING avg(quality) >= 0.5) USING (doc_id)
), cand AS (
  SELECT stratum, rule, c, count(*) AS n, count(*) FILTER (hit) AS k FROM ({grid}) GROUP BY stratum, rule, c
), safe AS (
  SELECT stratum, rule, c FROM cand WHERE k <= {risk} * n AND
    list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk}))))
    <= {DELTA} / ({tests} * (SELECT count(DISTINCT stratum) FROM g))
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {hit} AS hit FROM st
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT hit AS kept FROM v
"""


ORACLE_SQL = _oracle()
