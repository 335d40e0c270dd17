"""Online refinement of a class graph by streamed updates: accept, defer, split, merge.

Row-wise parts (lanes by confidence) run on streams as they are. Insertion is sequential by nature:
each update sees the graph that the one before left. Updates are therefore applied one group after
another, a group being a connected component of graph and updates together; groups are independent
and run in parallel, each by one pure function over an indexed graph.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.operators import graph as G

CONFIDENCE = 8.5
#: Edges of this score and more are hierarchy; ranks are taken over them.
HIERARCHY = 2.0
RESULT = "source string, target string, relation string, score double, lane string"


def lane(confidence: Column) -> Column:
    """LOW_CONFIDENCE below the threshold; no confidence passes."""
    return F.when(confidence < CONFIDENCE, "LOW_CONFIDENCE").otherwise("accepted")


class ClassGraph:
    """Classes with their members, and scored edges by (source, target, relation); ranks are the longest way to a sink."""

    def __init__(self, edges: Iterable[tuple] = (), members: dict[str, Iterable[str]] | None = None):
        self.members: dict[str, list[str]] = {}
        self.class_of: dict[str, str] = {}
        self.down: dict[str, dict[tuple[str, str], float]] = defaultdict(dict)
        self.up: dict[str, dict[tuple[str, str], float]] = defaultdict(dict)
        self._ranks: dict[str, int] | None = {}
        for name, keys in (members or {}).items():
            self.add(name, keys)
        for edge in edges:
            source, target, relation, score = (*edge, "no", HIERARCHY)[:4] if len(edge) < 4 else edge
            self.add(source), self.add(target)
            self.connect(source, target, relation, score)

    def add(self, name: str, keys: Iterable[str] = ()) -> None:
        if name not in self.members:
            self.members[name] = list(dict.fromkeys([*keys])) or [name]
            for key in self.members[name]:
                self.class_of.setdefault(key, name)
            self._ranks = None

    def connect(self, source: str, target: str, relation: str, score: float) -> None:
        """An edge; of equal ones the highest score stays; a class has none to itself."""
        if source != target:
            score = max(score, self.down[source].get((target, relation), score))
            self.down[source][target, relation] = self.up[target][source, relation] = score
            self._ranks = None

    def edges(self) -> list[tuple[str, str, str, float]]:
        return sorted((s, t, r, x) for s, out in self.down.items() for (t, r), x in out.items())

    def children(self, name: str) -> set[str]:
        return {t for t, _ in self.down.get(name, ())}

    def parents(self, name: str) -> set[str]:
        return {s for s, _ in self.up.get(name, ())}

    def resolve(self, name: str, keys: Iterable[str] = ()) -> str | None:
        """The class of this name, or else the first class that has one of the keys."""
        if name in self.members:
            return name
        found = {self.class_of[k] for k in (*keys, name) if k in self.class_of}
        return min(found) if found else None

    def ranks(self) -> dict[str, int]:
        """By peeling sinks; what a cycle holds has rank 0."""
        if self._ranks is None:
            left = {n: len({t for (t, _), x in self.down.get(n, {}).items() if x >= HIERARCHY}) for n in self.members}
            out, free = {}, [n for n, k in left.items() if not k]
            for n in free:
                out.setdefault(n, 0)
                for s in {s for (s, _), x in self.up.get(n, {}).items() if x >= HIERARCHY}:
                    out[s] = max(out.get(s, 0), out[n] + 1)
                    left[s] -= 1
                    if not left[s]:
                        free.append(s)
            self._ranks = {n: out.get(n, 0) if not left[n] else 0 for n in self.members}
        return self._ranks

    def reaches(self, start: str, end: str) -> bool:
        seen, todo = {start}, [start]
        while todo:
            here = todo.pop()
            if here == end:
                return True
            new = self.children(here) - seen
            seen |= new
            todo += new
        return False

    def twins(self, a: str, b: str) -> bool:
        """Whether two classes have the same neighbours both ways, one another aside."""
        pair = {a, b}
        return self.parents(a) - pair == self.parents(b) - pair and self.children(a) - pair == self.children(b) - pair

    def _rewired(self, change: Callable[[str], tuple[str, ...]]) -> None:
        """Each end of each edge is replaced by the classes that change names."""
        old, self.down, self.up = self.edges(), defaultdict(dict), defaultdict(dict)
        for s, t, r, x in old:
            for a in change(s):
                for b in change(t):
                    self.connect(a, b, r, x)
        self._ranks = None

    def merge(self, names: Iterable[str]) -> str:
        """One class of several, named by the least; its edges are theirs."""
        gone = sorted(set(names))
        keep = gone[0]
        keys = list(dict.fromkeys(k for n in gone for k in self.members[n]))
        for n in gone[1:]:
            del self.members[n]
        self.members[keep] = keys
        self.class_of.update(dict.fromkeys(keys, keep))
        self._rewired(lambda n: (keep,) if n in gone else (n,))
        return keep

    def split(self, name: str, keys: Iterable[str], wanted: str) -> str | None:
        """Members with one of the keys leave their class, and both halves keep all its edges; None if all or none would."""
        out = [m for m in self.members[name] if m in set(keys)]
        rest = [m for m in self.members[name] if m not in out]
        if not out or not rest:
            return None
        free = lambda n: bool(n) and n != name and n not in self.members
        new = next((n for n in (wanted, out[0]) if free(n)), f"{name}::split")
        self.members[name], self.members[new] = rest, out
        self.class_of.update(dict.fromkeys(out, new))
        self._rewired(lambda n: (name, new) if n == name else (n,))
        return new

    def merge_twins(self, name: str, others: Iterable[str], similar: Callable[[str, str], bool]) -> tuple[str, ...] | None:
        """name merged with those of others that are like it and stand where it stands; the names that went together."""
        if name not in self.members:
            return None
        like = [o for o in sorted(set(others)) if o != name and o in self.members and similar(name, o) and self.twins(name, o)]
        if not like:
            return None
        self.merge([name, *like])
        return tuple(sorted([name, *like]))


def _known(value) -> bool:
    return value is not None and value == value


def refine_graph(graph: ClassGraph, updates: list[dict], similar: Callable[[str, str], bool] = lambda a, b: a == b, threshold: float = CONFIDENCE) -> list[dict]:
    """Apply updates to graph (it is changed); what became of each, and merges and splits as rows of their own.

    Updates: source, target, relation, score, confidence, similar (does the updater say that both ends
    mean the same), source_keys and target_keys; all but the first two may be missing. They are taken by the rank that
    their source would have if all were applied, then by source and target. Deferred are: low confidence; an end
    that is not like the other though both are one class (which is split); an edge that would close a
    cycle; one from a known class to a known class of higher rank. After an insertion, classes of the ranks that it joined are
    merged with their twins.
    """
    ends = lambda u: ((u["source"], u.get("source_keys") or ()), (u["target"], u.get("target_keys") or ()))

    def entered(into: ClassGraph, name: str, keys: Iterable[str]) -> tuple[str, bool]:
        found = into.resolve(name, keys)
        if found is None:
            into.add(name, keys)
        return found or name, found is not None

    trial = ClassGraph(graph.edges(), graph.members)
    first = []
    for u in updates:
        (s, _), (t, _) = (entered(trial, *end) for end in ends(u))
        trial.connect(s, t, u.get("relation") or "no", float(u.get("score") or HIERARCHY))
        first.append(s)
    projected = trial.ranks()
    order = sorted(range(len(updates)), key=lambda i: (projected.get(first[i], 0), updates[i]["source"], updates[i]["target"]))
    out, extra = [], []
    for u in (updates[i] for i in order):
        relation, score = u.get("relation") or "no", float(u.get("score") or HIERARCHY)

        def said(where: str, u: dict = u, relation: str = relation, score: float = score) -> None:
            out.append({"source": u["source"], "target": u["target"], "relation": relation, "score": score, "lane": where})

        if _known(u.get("confidence")) and u["confidence"] < threshold:
            said("LOW_CONFIDENCE")
            continue
        (s, s_known), (t, t_known) = (entered(graph, *end) for end in ends(u))
        alike = bool(u["similar"]) if _known(u.get("similar")) else similar(s, t)
        if s == t and not alike:
            new = graph.split(t, {u["target"], *(u.get("target_keys") or ())}, u["target"])
            if new is not None:
                extra.append({"source": s, "target": new, "relation": "", "score": 0.0, "lane": "split"})
            said("SEMANTIC_CONFLICT")
            continue
        rank, parents, children = graph.ranks(), graph.parents(t), graph.children(s)
        s_rank, t_rank = rank.get(s, 0), rank.get(t, 0)
        if graph.reaches(t, s):
            said("CYCLE")
            continue
        if s_known and t_known and s_rank < t_rank:
            said("INCONSISTENT_RANK")
            continue
        graph.connect(s, t, relation, score)
        said("applied")
        for name, others, level in ((s, parents, s_rank), (t, children, t_rank)):
            if s_rank > t_rank:
                others = [n for n, r in graph.ranks().items() if r == level]
            elif s_rank < t_rank:
                continue
            merged = graph.merge_twins(name, others, similar)
            if merged:
                extra.append({"source": merged[0], "target": ",".join(merged[1:]), "relation": "", "score": 0.0, "lane": "merged"})
    return out + extra


def refine(edges: DataFrame, updates: DataFrame, members: DataFrame | None = None, similar: Callable[[str, str], bool] = lambda a, b: a == b, threshold: float = CONFIDENCE) -> DataFrame:
    """source, target, relation, score, lane of updates (source, target, relation, score, confidence and, if they
    say it, similar), and rows merged (source: what stays, target: what went) and split (source, target: the new class).

    edges: (src, tgt and, if known, relation and score); members: (id, keys array) of classes of several.
    """
    own = members.select("id", F.explode("keys").alias("key")).select(F.col("id").alias("src"), F.col("key").alias("tgt")) if members is not None else None
    pairs = edges.select("src", "tgt").union(updates.select("source", "target"))
    groups = G.components(pairs if own is None else pairs.union(own))
    of = lambda end: groups.select(F.col("id").alias(end), F.col("component").alias("grp"))
    given = edges.select("src", "tgt", *(F.col(c) if c in edges.columns else F.lit(v).alias(c) for c, v in (("relation", "no"), ("score", HIERARCHY))))
    mine = given.join(of("src"), "src").select("grp", "src", "tgt", "relation", F.col("score").cast("double").alias("score"), F.lit(None).cast("array<string>").alias("keys"))
    if members is not None:
        mine = mine.unionByName(members.join(of("id"), "id").select("grp", F.col("id").alias("src"), F.lit(None).cast("string").alias("tgt"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("double").alias("score"), "keys"))
    theirs = updates.join(of("source"), "source")

    def run(graph: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        names = ["source", "target", "relation", "score", "lane"]
        if todo.empty:
            return pd.DataFrame([], columns=names)
        held = {s: list(k) for s, k in zip(graph["src"], graph["keys"], strict=True) if k is not None}
        known = [(s, t, r, x) for s, t, r, x in zip(graph["src"], graph["tgt"], graph["relation"], graph["score"], strict=True) if t is not None]
        return pd.DataFrame(refine_graph(ClassGraph(known, held), todo.to_dict("records"), similar, threshold), columns=names)

    return mine.groupBy("grp").cogroup(theirs.groupBy("grp")).applyInPandas(run, RESULT)


def stream(updates: DataFrame, graph_path: str, deferred_path: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of updates to the edges at graph_path; what is deferred goes to deferred_path.

    Each micro-batch appends under its number, so a batch that is tried again overwrites itself.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        edges = spark.read.parquet(graph_path).where(F.col("batch") < number).select("src", "tgt")
        done = batch.persist()
        result = refine(edges, done).persist()
        result.where("lane = 'applied'").select(F.col("source").alias("src"), F.col("target").alias("tgt")).write.mode("overwrite").parquet(f"{graph_path}/batch={number}")
        result.where("lane <> 'applied'").write.mode("overwrite").parquet(f"{deferred_path}/batch={number}")
        result.unpersist()
        done.unpersist()

    return updates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and tumbling window, for batch and stream alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    totals = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return totals.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "n")
