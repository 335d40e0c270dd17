"""Seeded and learnt operators: clustering, walks, hashed text vectors, noise, centralities of small graphs."""

from __future__ import annotations

import random
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.lineage import cut
from weft.operators.vectors import EPSILON, norm, positions


#: Steps of walks that are planned together.
STEPS = 8
#: Nodes in walks that a task trains on, about.
WORDS = 500_000


def clustered(vectors: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(id, cluster) by k-means on unit vectors."""
    unit = F.transform("vector", lambda x: x.cast("double") / (norm(F.col("vector")) + EPSILON))
    rows = vectors.select("id", array_to_vector(unit).alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))


def walks(edges: DataFrame, length: int, per_node: int, seed: int = 1, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """(start, walk, path): biased random walks over either direction; edges: (src, tgt and, if they have one, weight, finite).

    From v, come from u, a neighbour has the weight of its edge, divided by p if it is u, and by q if it is no neighbour of u.
    A step is drawn by rejection, which follows these weights exactly and never lists the neighbours of a node: edges are numbered in
    the order of source, binary magnitude of the weight, and target, so the edges of one source and magnitude are a run of numbers,
    and a trial is one number looked up. u is drawn apart, so trials fail by the weight's magnitude (half at most) and by q only. A
    walk that no trial of a round moves gets more in the next, until all have moved. Lots are drawn by hash, so a walk depends on
    the seed only, not on the plan. Tables are cut each round.
    """
    if not (p > 0 and q > 0):
        raise ValueError("p and q must be positive")
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    rows = edges.select("src", "tgt", F.when((weight < float("inf")) | weight.isNull(), weight).otherwise(F.raise_error(F.lit("a weight is not finite"))).alias("weight"))
    steps = cut(rows.union(rows.select("tgt", "src", "weight")).groupBy("src", "tgt").agg(F.max("weight").alias("weight")).where("weight > 0"), "steps")
    numbered = cut(positions(steps.withColumn("size", F.floor(F.log2("weight"))), [F.col("src"), F.col("size"), F.col("tgt")], "number"), "numbered")
    if p == q == 1 and "weight" not in edges.columns:
        return _even_walks(numbered, length, per_node, seed)
    runs = numbered.groupBy("src", "size").agg(F.min("number").alias("first"), F.count("*").alias("n"), F.max("weight").alias("top"))
    runs = runs.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("size", "first", "n", "top"))).alias("runs"))  # one for each magnitude, not edge
    mass = lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + x["n"] * x["top"])
    until = F.transform("runs", lambda x, i: F.struct(mass(F.slice("runs", F.lit(1), i + 1)).alias("until"), x["first"].alias("first"), x["n"].alias("n"), x["top"].alias("top")))
    nodes = cut(runs.select(F.col("src").alias("at"), until.alias("runs"), mass(F.col("runs")).alias("mass")), "nodes")
    looked_up = numbered.select("number", "tgt", "weight")
    near = steps.select(F.col("src").alias("before"), "tgt", F.lit(True).alias("near"))
    most = max(1.0, 1 / q)
    at = nodes.select(F.col("at").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("walk"))
    at = at.select("start", "walk", F.array("start").alias("path"), F.lit(None).cast(steps.schema["src"].dataType).alias("before"), F.lit(0.0).alias("came"), F.col("start").alias("at"))
    for i in range(1, length):
        biased = i > 1 and (p != 1 or q != 1)
        moved, trials, first = None, 4 if biased or "weight" in edges.columns else 1, 1
        while True:
            lot = lambda kind: (F.pmod(F.xxhash64(F.lit(kind), "trial", "start", "walk", F.lit(i), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)  # noqa: B023, E731
            drawn = at.join(nodes, "at").withColumn("trial", F.explode(F.sequence(F.lit(first), F.lit(first + trials - 1))))
            back = F.col("came") / p if biased else F.lit(0.0)
            drawn = drawn.withColumn("lot", lot("which") * (back + F.col("mass") * (most if biased else 1.0)) - back)
            run = F.coalesce(F.get(F.filter("runs", lambda x: x["until"] * (most if biased else 1.0) > F.col("lot")), F.lit(0)), F.element_at("runs", -1))
            drawn = drawn.withColumn("run", run).withColumn("number", F.col("run.first") + F.least(F.floor(lot("edge") * F.col("run.n")), F.col("run.n") - 1))
            drawn = drawn.select("start", "walk", "trial", "path", "before", "came", "at", "lot", F.col("run.top").alias("top"), "number").join(looked_up, "number")
            fits, go = lot("fits") * F.col("top") < F.col("weight"), F.struct("trial", "tgt", "weight")
            if biased:
                drawn = drawn.join(near, ["before", "tgt"], "left")
                other = (F.col("tgt") != F.col("before")) & (lot("fits") * F.col("top") * most < F.col("weight") * F.when(F.col("near"), 1.0).otherwise(1 / q))
                fits = (F.col("lot") < 0) | other
                go = F.when(F.col("lot") < 0, F.struct("trial", F.col("before").alias("tgt"), F.col("came").alias("weight"))).otherwise(go)
            chosen = drawn.groupBy("start", "walk").agg(F.min(F.when(fits, go)).alias("next"), *(F.first(c).alias(c) for c in ("path", "before", "came", "at")))
            tried = cut(chosen, "walks")
            on = tried.where("next IS NOT NULL").select("start", "walk", F.array_append("path", F.col("next.tgt")).alias("path"), F.col("at").alias("before"), F.col("next.weight").alias("came"), F.col("next.tgt").alias("at"))
            moved = on if moved is None else moved.unionByName(on)
            at = tried.where("next IS NULL").drop("next")
            if at.isEmpty():
                break
            first, trials = first + trials, min(4 * trials, 4096)
        at = moved
    return at.select("start", "walk", "path")


def _even_walks(numbered: DataFrame, length: int, per_node: int, seed: int) -> DataFrame:
    """walks() where all neighbours have the same chance, so every first trial holds: edges (src, tgt, number) are joined once with where the
    edges of their targets stand, and a step is one lookup by number. No number is hot, whatever the degrees.
    """
    nodes = cut(numbered.groupBy("src").agg(F.min("number").alias("first"), F.count("*").alias("n")), "nodes")
    linked = cut(numbered.select("number", "tgt").join(nodes.withColumnRenamed("src", "tgt"), "tgt"), "linked")
    at = nodes.select(F.col("src").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("walk"), F.array("src").alias("path"), "first", "n")
    for i in range(1, length):
        lot = (F.pmod(F.xxhash64(F.lit("edge"), F.lit(1), "start", "walk", F.lit(i), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        drawn = at.select("start", "walk", "path", (F.col("first") + F.least(F.floor(lot * F.col("n")), F.col("n") - 1)).alias("number"))
        at = drawn.join(linked, "number").select("start", "walk", F.array_append("path", F.col("tgt")).alias("path"), "first", "n")
        if i % STEPS == 0 and i + 1 < length:
            at = cut(at, "walks")
    return at.select("start", "walk", "path")


def node_vectors(edges: DataFrame, size: int = 64, length: int = 10, per_node: int = 50, window: int = 5, seed: int = 1, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """(id, vector): word vectors of walks(). Each WORDS of their nodes train in a task of their own; a node's vector is the mean over the tasks it is in."""
    paths = cut(walks(edges, length, per_node, seed, p, q).select(F.transform("path", lambda x: x.cast("string")).alias("path")), "paths")  # read twice
    parts = 1 + (paths.agg(F.sum(F.size("path"))).first()[0] or 0) // WORDS
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=1, seed=seed, numPartitions=parts, inputCol="path", outputCol="out").fit(paths)
    return model.getVectors().select(F.col("word").alias("id"), vector_to_array("vector").alias("vector"))


def weighted_graph(edges: DataFrame) -> DataFrame:
    """(src, tgt, weight) of edges (src, tgt, score, seq): the last of parallel edges counts."""
    return edges.groupBy("src", "tgt").agg(F.max_by("score", "seq").alias("weight"))


def hashed_text(texts: DataFrame, size: int) -> DataFrame:
    """doc_id and the hashed term counts of its words, of unit length; where no encoder is at hand."""
    words = texts.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("words"))
    rows = HashingTF(numFeatures=size, inputCol="words", outputCol="features").transform(words).select("doc_id", vector_to_array("features").alias("vector"))
    return rows.select("doc_id", F.transform("vector", lambda x: x / (norm(F.col("vector")) + EPSILON)).alias("vector"))


# Neighbours on a keyboard, shapes that scanners confuse, spellings of one sound.
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
OCR = (("0", "O"), ("1", "l"), ("1", "I"), ("2", "Z"), ("5", "S"), ("8", "B"), ("rn", "m"), ("cl", "d"))
SOUND = (("ph", "f"), ("ght", "t"), ("ck", "k"), ("c", "k"), ("q", "k"), ("x", "ks"), ("z", "s"))


@dataclass(frozen=True)
class Noise:
    """How likely each edit is: of a record, of a value in it, of a character, of a text."""

    record: float = 0.1
    value: float = 0.5
    delete: float = 0.01
    insert: float = 0.01
    substitute: float = 0.01
    transpose: float = 0.005
    split: float = 0.01
    merge: float = 0.01
    case: float = 0.01
    blank: float = 0.01
    ocr: float = 0.02
    sound: float = 0.01
    name: float = 0.03
    swap: float = 0.01

    def near(self, c: str, rng: random.Random) -> str:
        """A key beside c, or any letter."""
        for row, keys in enumerate(KEYS):
            at = keys.find(c.lower())
            if at >= 0 and rng.random() < 0.7:
                beside = keys[max(0, at - 1) : at + 2].replace(c.lower(), "") + (KEYS[row + 1][at : at + 1] if row < 2 else "")
                picked = rng.choice(beside)
                return picked.upper() if c.isupper() else picked
        return rng.choice(string.ascii_letters + string.digits)

    def characters(self, text: str, rng: random.Random) -> str:
        out, at = [], 0
        while at < len(text):
            c, at = text[at], at + 1
            if rng.random() < self.delete:
                continue
            if at < len(text) and rng.random() < self.transpose:
                out += [text[at], c]
                at += 1
                continue
            out.append(self.near(c, rng) if rng.random() < self.substitute else c)
            if rng.random() < self.insert:
                out.append(self.near(c, rng))
        return "".join(out)

    def words(self, text: str, rng: random.Random) -> str:
        words = text.split()
        if words and rng.random() < self.split:
            at = rng.randrange(len(words))
            if len(words[at]) > 2:
                place = rng.randrange(1, len(words[at]))
                words[at : at + 1] = [words[at][:place], words[at][place:]]
        if len(words) > 1 and rng.random() < self.merge:
            at = rng.randrange(len(words) - 1)
            words[at : at + 2] = [words[at] + words[at + 1]]
        return " ".join(words) if words else text

    def surface(self, text: str, rng: random.Random) -> str:
        out = []
        for c in text:
            if c.isspace() and rng.random() < self.blank:
                out.append(c * rng.choice((0, 2)))
            else:
                out.append(c.swapcase() if c.isalpha() and rng.random() < self.case else c)
        return "".join(out)

    def text(self, text: str, rng: random.Random) -> str:
        """One noisy form of a text; a blank one stays."""
        if not text or not text.strip():
            return text
        if rng.random() < self.ocr:
            a, b = rng.choice(OCR)
            text = text.replace(a, b) if a in text and rng.random() < 0.5 else text.replace(b, a)
        if rng.random() < self.sound:
            a, b = rng.choice(SOUND)
            text = text.replace(a, b) if rng.random() < 0.7 else text
        for step in (self.characters, self.words, self.surface):
            text = step(text, rng)
        return text


def drawn(key: Column, seed: int, what: str) -> Column:
    """A number in [0, 1) for each key, by hash."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(what)), F.lit(1 << 30)) / float(1 << 30)


def noised(text: Column, key: Column, noise: Noise = Noise(), seed: int = 1) -> Column:
    """A noisy form of each text. Random numbers are seeded by the row's key, so a row's noise depends on nothing else."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, keys in batches:
            yield pd.Series([t if t is None else noise.text(t, random.Random(int(k))) for t, k in zip(texts, keys, strict=True)], dtype="object")

    return run(text, F.xxhash64(key, F.lit(seed)))


def noised_list(values: Column, key: Column, noise: Noise = Noise(), seed: int = 1) -> Column:
    """Each value of a list noisy with the probability of a value; the others stay."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lists, keys in batches:
            out = []
            for items, k in zip(lists, keys, strict=True):
                rng = random.Random(int(k))
                out.append(None if items is None else [noise.text(v, rng) if rng.random() < noise.value else v for v in items])
            yield pd.Series(out, dtype="object")

    return run(values, F.xxhash64(key, F.lit(seed)))


def noised_ontology(nodes: DataFrame, fields: tuple[str, ...] = ("labels",), noise: Noise = Noise(), seed: int = 1) -> DataFrame:
    """nodes (id, name, the fields as lists) with noise, and changed (map: field to changed values), renamed and swapped_with.

    Some records are noised: their fields' values, and rarely their name. Then records that the lot draws swap their
    first field's values in pairs; those drawn meet in hash order within buckets of about 64, and one left over in its bucket keeps its own.
    """
    hit = drawn(F.col("id"), seed, "record") < noise.record
    rows = nodes.select("*", hit.alias("_hit"))
    for f in fields:
        rows = rows.withColumn(f"_{f}", F.when(F.col("_hit"), noised_list(F.col(f), F.concat_ws("|", F.lit(f), "id"), noise, seed)).otherwise(F.col(f)))
    rename = F.col("_hit") & (drawn(F.col("id"), seed, "name") < noise.name)
    rows = rows.withColumn("_name", F.when(rename, F.coalesce(F.nullif(noised(F.col("name"), F.concat_ws("|", F.lit("name"), "id"), noise, seed), F.lit("")), F.col("name"))).otherwise(F.col("name")))
    diff = lambda f: F.coalesce(F.size(F.filter(F.zip_with(f, f"_{f}", lambda a, b: ~a.eqNullSafe(b)), lambda x: x)), F.lit(0))
    counts = F.map_filter(F.create_map(*(x for f in fields for x in (F.lit(f), diff(f)))), lambda _, n: n > 0)
    rows = cut(rows.withColumn("changed", counts).withColumn("renamed", F.col("_name") != F.col("name")), "noised")
    first = f"_{fields[0]}"
    lots = rows.where((F.size(first) > 0) & (drawn(F.col("id"), seed, "swap") < noise.swap)).select("id", F.col(first).alias("theirs"), F.xxhash64("id", F.lit(seed)).alias("lot"))
    buckets = max(1, lots.count() // 64)
    placed = lots.withColumn("bucket", F.pmod("lot", F.lit(buckets))).withColumn("at", F.row_number().over(W.partitionBy("bucket").orderBy("lot", "id")))
    pair = [F.col("bucket"), F.floor((F.col("at") + 1) / 2).alias("pair")]
    mine, other = placed.select(*pair, "id"), placed.select(*pair, F.col("id").alias("swapped_with"), "theirs")
    swaps = mine.join(other, ["bucket", "pair"]).where("id <> swapped_with").select("id", "swapped_with", "theirs")
    out = rows.join(swaps, "id", "left").withColumn(first, F.coalesce("theirs", F.col(first)))
    keep = [c for c in nodes.columns if c not in (*fields, "name")]
    return out.select(*keep, F.col("_name").alias("name"), *(F.col(f"_{f}").alias(f) for f in fields), "changed", "renamed", "swapped_with")


def entailment_edges(entailed: DataFrame, least: float = 0.01) -> DataFrame:
    """(grp, a, b, weight): pairs of a group's responses whose mean entailment either way is above least; entailed: (grp, a, b, p), p clamped to [0, 1]."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))
    rows = entailed.where("a <> b").groupBy("grp", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg((F.sum(p) / 2).alias("weight"))
    return rows.where(F.col("weight") > least).select("grp", F.col("x").alias("a"), F.col("y").alias("b"), "weight")


CENTRALITIES = ("degree", "closeness", "betweenness", "page_rank", "harmonic", "laplacian")


def centralities(edges: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """grp and the means, clamped to [0, 1], of six centralities of each small undirected graph (grp, a, b[, weight]), of a few responses each.

    sizes: (grp, size) where graphs have nodes without edges. Degree, rank and Laplacian go by weight; paths count edges.
    """
    weighted = edges.select("grp", "a", "b", F.col("weight").cast("double").alias("weight") if "weight" in edges.columns else F.lit(1.0).alias("weight"))
    rows = weighted if sizes is None else weighted.join(sizes, "grp")

    def run(table: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*table["a"], *table["b"]})
        at, n = {x: i for i, x in enumerate(names)}, max(len(names), int(table["size"].iloc[0]) if "size" in table else 0)
        w = np.zeros((n, n))
        for a, b, x in zip(table["a"], table["b"], table["weight"], strict=True):
            w[at[a], at[b]] = w[at[b], at[a]] = x
        return pd.DataFrame([(int(table["grp"].iloc[0]), *graph_means(w))], columns=["grp", *CENTRALITIES])

    return rows.groupBy("grp").applyInPandas(run, "grp long, " + ", ".join(f"{c} double" for c in CENTRALITIES))


def graph_means(w: np.ndarray) -> list[float]:
    """The six means of one graph, given its symmetric weights (0: no edge)."""
    n, near = len(w), w > 0
    strength, others = w.sum(axis=1), max(n - 1, 1)
    closeness = harmonic = 0.0
    between = np.zeros(n)
    for s in range(n):
        # breadth first: how far, by how many shortest ways; then credit flows back along them
        far, ways = np.full(n, -1), np.zeros(n)
        far[s], ways[s] = 0, 1.0
        level, levels = np.array([s]), []
        while len(level):
            levels.append(level)
            reach = near[level].T @ ways[level]
            level = np.flatnonzero((reach > 0) & (far < 0))
            far[level], ways[level] = len(levels), reach[level]
        total, met = far[far > 0].sum(), int((far >= 0).sum())
        closeness += (met - 1) / total * (met - 1) / others if total else 0.0
        harmonic += float((1 / far[far > 0]).sum()) / others
        credit = np.zeros(n)
        for up, down in zip(levels[-2::-1], levels[:0:-1], strict=True):
            flow = (1 + credit[down]) / ways[down]
            credit[up] += ways[up] * (near[np.ix_(up, down)] @ flow)
        credit[s] = 0
        between += credit
    scale = (n - 1) * (n - 2)
    rank = np.full(n, 1 / n)
    share = np.divide(w, strength[:, None], out=np.zeros_like(w), where=strength[:, None] > 0)
    for _ in range(1000):
        after = 0.85 * (rank @ share + rank[strength == 0].sum() / n) + 0.15 / n
        done = np.abs(after - rank).sum() < n * 1e-6
        rank = after
        if done:
            break
    energy = lambda m: float((m.sum(axis=1) ** 2).sum() + (m**2).sum())
    whole, drops = energy(w), []
    for s in range(n):
        rest = np.delete(np.delete(w, s, 0), s, 1)
        drops.append((whole - energy(rest)) / whole if whole else 0.0)
    found = (strength.mean() / others, closeness / n, between.mean() / scale if scale else 0.0, rank.mean(), harmonic / n, float(np.mean(drops)))
    return [float(min(1.0, max(0.0, x))) for x in found]
