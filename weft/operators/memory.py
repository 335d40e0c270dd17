"""Answer caches as state: bounded tiers with an eviction policy, a trie of paths, promotion, replay, lookups in order.

A tier is sequential by nature: each request sees what the one before left. So a tier's requests are
sorted and streamed through one task, which holds the tier's entries (bounded by its capacity) and
nothing else; tiers run beside one another. The same fold runs on streams, with the entries as state.
"""

from __future__ import annotations

import heapq
import json
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.text import content_key
from weft.operators.tables import first_per, longest_prefix

HOT, SHORT, LONG, GHOSTS, PROMOTE = 32, 512, 1024, 1024, 3


@dataclass
class Entry:
    """What a policy may look at, and the answer that is kept."""

    answer: str | None = None
    count: int = 0
    order: int = 0
    last_used: int = 0
    frequency: int = 0
    queue: str = ""

    def rank(self, policy: str) -> tuple:
        """Entries of the least rank go first."""
        if policy == "lru":
            return (self.last_used, self.order)
        if policy == "lfu":
            return (self.frequency, self.last_used, self.order)
        return (0, self.order, self.last_used) if self.queue == "a1" else (1, self.last_used, self.order)


class Tier:
    """A bounded cache; policy: lru, lfu (or lowest-count) or 2q, which remembers GHOSTS keys that left probation."""

    def __init__(self, capacity: int = HOT, policy: str = "lru", ghosts: int = GHOSTS):
        policy = {"lowest-count": "lfu"}.get(policy, policy)
        if policy not in ("lru", "lfu", "2q"):
            raise ValueError(f"unknown eviction policy: {policy}")
        self.capacity, self.policy, self.most_ghosts = max(1, capacity), policy, max(1, ghosts)
        self.entries: dict[str, Entry] = {}
        self.ghosts: OrderedDict[str, None] = OrderedDict()
        self.clock = 1
        self.heap: list[tuple] = []  # (rank, key); ranks that are out of date are passed over

    def touch(self, key: str) -> None:
        heapq.heappush(self.heap, (self.entries[key].rank(self.policy), key))
        if len(self.heap) > 8 * self.capacity + 64:
            self.heap = [(e.rank(self.policy), k) for k, e in self.entries.items()]
            heapq.heapify(self.heap)

    def get(self, key: str) -> str | None:
        found = self.entries.get(key)
        if found is None:
            return None
        found.last_used, found.frequency = self.clock, found.frequency + 1
        if self.policy == "2q":
            found.queue = "am"
        self.clock += 1
        self.touch(key)
        return found.answer

    def put(self, key: str, answer: str | None) -> list[str]:
        """Store an answer; the keys that had to go. Empty keys and answers are not stored."""
        if not key or not answer:
            return []
        old = self.entries.get(key)
        known = old or Entry(order=self.clock)
        queue = ""
        if self.policy == "2q":
            queue = "am" if old is not None or key in self.ghosts else "a1"
            if queue == "am":
                self.ghosts.pop(key, None)
        self.entries[key] = Entry(answer, known.count + 1, known.order, self.clock, known.frequency + 1, queue)
        self.clock += 1
        self.touch(key)
        return self.shrink()

    def shrink(self) -> list[str]:
        gone = []
        while len(self.entries) > self.capacity:
            rank, key = heapq.heappop(self.heap)
            entry = self.entries.get(key)
            if entry is None or entry.rank(self.policy) != rank:
                continue
            del self.entries[key]
            gone.append(key)
            if self.policy == "2q" and entry.queue == "a1" and key not in self.ghosts:
                self.ghosts[key] = None
                while len(self.ghosts) > self.most_ghosts:
                    self.ghosts.popitem(last=False)
        return gone

    def dumped(self) -> str:
        return json.dumps({"clock": self.clock, "ghosts": list(self.ghosts), "entries": {k: asdict(e) for k, e in self.entries.items()}})

    def loaded(self, text: str) -> Tier:
        state = json.loads(text)
        self.clock, self.ghosts = state["clock"], OrderedDict.fromkeys(state["ghosts"])
        self.entries = {k: Entry(**e) for k, e in state["entries"].items()}
        self.heap = [(e.rank(self.policy), k) for k, e in self.entries.items()]
        heapq.heapify(self.heap)
        self.shrink()
        return self


def asked(tier: Tier, key: str, answer: str | None) -> tuple[bool, list[str]]:
    """One request: a hit, or else the answer is stored; what had to go."""
    hit = tier.get(key) is not None
    return hit, [] if hit else tier.put(key, answer)


def consulted(requests: DataFrame, capacity: int = HOT, policy: str = "lru") -> DataFrame:
    """tier, seq, key, hit and evicted (array) of requests (tier, seq, key, answer), each tier in the order of seq."""
    Tier(capacity, policy)  # an unknown policy is an error here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tier = None, Tier(capacity, policy)
        for b in batches:
            names, keys, answers = (b.column(c).to_pylist() for c in (0, 2, 3))
            hits, gone = [], []
            for at, key, answer in zip(names, keys, answers, strict=True):
                if at != name:
                    name, tier = at, Tier(capacity, policy)
                hit, left = asked(tier, key, answer)
                hits.append(hit)
                gone.append(left)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(hits, pa.bool_()), pa.array(gone, pa.list_(pa.string()))], ["tier", "seq", "key", "hit", "evicted"])

    rows = requests.select(F.col("tier").cast("string").alias("tier"), F.col("seq").cast("long").alias("seq"), F.col("key").cast("string").alias("key"), F.col("answer").cast("string").alias("answer"))
    rows = rows.where("tier IS NOT NULL").repartition("tier").sortWithinPartitions("tier", "seq", "key")
    return rows.mapInArrow(run, "tier string, seq long, key string, hit boolean, evicted array<string>")


def remaining(requests: DataFrame, capacity: int = HOT, policy: str = "lru") -> DataFrame:
    """tier, key, answer, count, frequency, queue of what each tier holds after all its requests."""
    Tier(capacity, policy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tier", "key", "answer", "count", "frequency", "queue"]

        def held(name: str, tier: Tier) -> pa.RecordBatch:
            rows = [(name, k, e.answer, e.count, e.frequency, e.queue) for k, e in tier.entries.items()]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        name, tier = None, Tier(capacity, policy)
        for b in batches:
            for at, key, answer in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if at != name:
                    if name is not None:
                        yield held(name, tier)
                    name, tier = at, Tier(capacity, policy)
                asked(tier, key, answer)
        if name is not None:
            yield held(name, tier)

    rows = requests.select(F.col("tier").cast("string").alias("tier"), F.col("key").cast("string").alias("key"), F.col("answer").cast("string").alias("answer"), "seq")
    rows = rows.where("tier IS NOT NULL").repartition("tier").sortWithinPartitions("tier", "seq", "key").drop("seq")
    return rows.mapInArrow(run, "tier string, key string, answer string, count long, frequency long, queue string")


def stream_consulted(requests: DataFrame, capacity: int = HOT, policy: str = "lru") -> DataFrame:
    """consulted() on a stream: a tier's entries are the state; requests of one batch are taken in the order of seq."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tier = Tier(capacity, policy)
        if state.exists:
            tier.loaded(state.get[0])
        rows = pd.concat(list(frames)).sort_values(["seq", "key"])
        done = [asked(tier, k, a) for k, a in zip(rows["key"], rows["answer"], strict=True)]
        state.update((tier.dumped(),))
        yield pd.DataFrame({"tier": key[0], "seq": rows["seq"], "key": rows["key"], "hit": [h for h, _ in done]})

    return requests.groupBy("tier").applyInPandasWithState(step, "tier string, seq long, key string, hit boolean", "state string", "append", "NoTimeout")


def trie_eviction(nodes: DataFrame, most: int = SHORT, policy: str = "lfu") -> DataFrame:
    """trie and path of the nodes that go so that each trie keeps most: leaves only, one at a time, and a parent
    whose last child went is a leaf too. nodes: (trie, path array, count, order, last_used, frequency, queue).
    """
    Tier(1, policy)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        entries = {tuple(p): Entry(None, int(c), int(o), int(u), int(f) or int(c), q or "") for p, c, o, u, f, q in zip(*(rows[x] for x in ("path", "count", "order", "last_used", "frequency", "queue")), strict=True)}
        children = dict.fromkeys(entries, 0)
        for path in entries:
            if path[:-1] in children:
                children[path[:-1]] += 1
        heap = [(entries[p].rank(policy), p) for p, n in children.items() if not n]
        heapq.heapify(heap)
        gone = []
        while len(entries) - len(gone) > max(1, most) and heap:
            _, path = heapq.heappop(heap)
            gone.append(path)
            up = path[:-1]
            if up in children:
                children[up] -= 1
                if not children[up]:
                    heapq.heappush(heap, (entries[up].rank(policy), up))
        return pd.DataFrame({"trie": rows["trie"].iloc[0], "path": ["/".join(p) for p in gone]}, columns=["trie", "path"])

    rows = nodes.select(F.col("trie").cast("string").alias("trie"), "path", "count", "order", "last_used", F.coalesce("frequency", F.lit(0)).alias("frequency"), "queue")
    return rows.groupBy("trie").applyInPandas(run, "trie string, path string")


def trie_nodes(paths: DataFrame) -> DataFrame:
    """path (array), count, order (when it first came), last_used and the last answer of each node of the trie of paths (seq, path, answer)."""
    steps = paths.where(F.size("path") > 0).select("seq", "answer", F.size("path").alias("size"), "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth"))
    rows = steps.select(F.slice("path", F.lit(1), F.col("depth")).alias("path"), "seq", F.when(F.col("depth") == F.col("size"), F.col("answer")).alias("answer"))
    return rows.groupBy("path").agg(F.count("*").alias("count"), F.min("seq").alias("order"), F.max("seq").alias("last_used"), F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("seq"))).alias("answer"))


def promoted(nodes: DataFrame, least: int = PROMOTE, most: int = LONG) -> DataFrame:
    """Completed paths seen least times or more, the most frequent most of them."""
    return nodes.where((F.col("count") >= least) & F.col("answer").isNotNull()).orderBy(F.desc("count"), F.desc("last_used"), "path").limit(most)


def path_answers(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and answer of the stored path that is exactly the query's path (id, path)."""
    key = lambda c: F.array_join(c, "\x1f")
    stored = nodes.where("answer IS NOT NULL").select(key("path").alias("_key"), "answer")
    return queries.select("id", key("path").alias("_key")).join(stored, "_key", "left").select("id", "answer")


def replayed_prefixes(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """id and the longest stored path that is a proper beginning of the query's path."""
    return longest_prefix(queries.where(F.size("path") > 1).withColumn("path", F.slice("path", F.lit(1), F.size("path") - 1)), stored)


def replay_key(ids: str = "ids"):
    """The key under which an answer about these concepts is replayed: the concepts in order, each once."""
    return F.array_join(F.array_sort(F.array_distinct(ids)), ",")


def answers_in_tiers(questions: DataFrame, tiers: list[tuple[str, DataFrame]], key: str = "key") -> DataFrame:
    """Each question (key, ...) with answer and source: the first tier (name, (key, answer)) that has its key; else neither."""
    rows = questions
    found = []
    for i, (name, table) in enumerate(tiers):
        one = first_per(table.where("answer IS NOT NULL").select(key, "answer"), [key], ["answer"])
        rows = rows.join(one.select(key, F.struct(F.col("answer"), F.lit(name).alias("source")).alias(f"_{i}")), key, "left")
        found.append(F.col(f"_{i}"))
    best = F.coalesce(*found)
    return rows.withColumn("answer", best["answer"]).withColumn("source", best["source"]).drop(*(f"_{i}" for i in range(len(tiers))))


def rebuilt_index(trie: DataFrame, patterns: DataFrame) -> DataFrame:
    """path and answer to index: the trie's answers, those of patterns (path, answer) in their place where both have one."""
    rows = trie.where("answer IS NOT NULL AND size(path) > 0").select("path", "answer", F.lit(1).alias("rank")).unionByName(patterns.where("answer IS NOT NULL").select("path", "answer", F.lit(0).alias("rank")))
    return first_per(rows, ["path"], ["rank", "answer"]).select("path", "answer")


def longest_answers(turns: DataFrame) -> DataFrame:
    """key and answer: of the turns (seq, question, answer) whose questions ask for the same content, the longest answer (the first on ties)."""
    rows = turns.where("answer <> ''").withColumn("key", F.array_join(content_key(F.col("question")), ","))
    return rows.groupBy("key").agg(F.max_by("answer", F.struct(F.length("answer"), -F.col("seq"))).alias("answer"))


def chained(turns: DataFrame) -> DataFrame:
    """turns (chat, seq, continues, ...) with the number of the chain in its chat: a turn that does not continue begins one."""
    from pyspark.sql import Window as W

    order = W.partitionBy("chat").orderBy("seq")
    begins = (F.row_number().over(order) == 1) | ~F.coalesce("continues", F.lit(False))
    return turns.withColumn("_new", begins.cast("int")).withColumn("chain", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")
