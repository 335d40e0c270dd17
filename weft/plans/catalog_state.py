"""Queries on answer memory, runs and traces, graphs with state, optimisation, sinks and validation, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weft import registry as Y
from weft.lineage import shared_dir, until_exit
from weft.operators import graph as G
from weft.operators import learning as E
from weft.operators import memory as M
from weft.operators import optimizer as Z
from weft.operators import tables as B
from weft.operators import thoughts as H
from weft.plans import expressions as C
from weft.plans import refine as R
from weft.plans import validation as D
from weft.plans import views as V
from weft.plans.catalog_graph import CLOSED, EVALUATED, GEO, GEO_EDGES, INCIDENCE, SUPPLY, geo, geo_edges
from weft.plans.catalog_lookup import conversations, documents, events, nation, part
from weft.sources import readers as S
from weft.sources import writers as K
from weft.streaming import online as O

TH = V.plain(V.THOUGHTS)
OWL = "http://www.w3.org/2002/07/owl#"
#: A user's events of a day as a path.
PATHS = "(SELECT user_id * 100 + day(ts) AS id, list(event_type ORDER BY event_id) AS path, max(event_id) AS seq FROM events GROUP BY user_id, day(ts))"
NODES = f"(SELECT array_to_string(path[1:k], '/') AS prefix, count(*) AS n, min(seq) AS born, max(seq) AS used, count(*) FILTER (k = len(path)) AS ends FROM (SELECT path, seq, unnest(range(1, len(path) + 1)) AS k FROM {PATHS}) GROUP BY 1)"
LRU = "WITH r AS (SELECT event_type AS tier, event_id AS seq, user_id AS key FROM events), p AS (SELECT *, lag(seq) OVER (PARTITION BY tier, key ORDER BY seq) AS prev FROM r), g AS (SELECT p.tier, p.seq, count(DISTINCT x.key) AS between_ FROM p JOIN r x ON x.tier = p.tier AND x.seq > p.prev AND x.seq < p.seq GROUP BY ALL)"
TREE = f"walk(id, root, depth, path) AS (SELECT id, id, 0, id FROM {TH} WHERE root UNION ALL SELECT t.id, w.root, w.depth + 1, w.path || '>' || t.id FROM {TH} t JOIN walk w ON t.parent_id = w.id AND NOT t.root)"
INSERTS = [("root", "new", 9.0, None), ("leaf", "root", 9.0, None), ("root", "middle", 5.0, None), ("x", "x", None, None), ("far", "away", None, None), ("b", "b", 9.0, False), ("r2", "twin2", 9.5, None)]
CLASSES = """
_:r1 a owl:Restriction ; owl:onProperty ex:has ; owl:someValuesFrom [ owl:unionOf ( ex:A ex:B ) ] . _:r2 a owl:Restriction ; owl:onProperty ex:has ; owl:minQualifiedCardinality 2 ; owl:onClass ex:C .
_:u owl:intersectionOf ( ex:A [ owl:complementOf ex:B ] _:r3 ) . _:r3 a owl:Restriction ; owl:onProperty ex:of ; owl:hasValue "x" . _:o owl:oneOf ( ex:a ex:b ) . _:c a owl:Restriction ; owl:onProperty ex:n ; owl:cardinality 3 .
"""


def place(s, name):
    return until_exit(s, f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}")


def requests(s, d):
    return events(s, d).select(F.col("event_type").alias("tier"), F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.lit("answer").alias("answer"))


def paths(s, d):
    rows = events(s, d).groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("path"), F.max("event_id").alias("seq"))
    return rows.select((F.col("user_id") * 100 + F.col("day")).alias("id"), "path", "seq", F.concat(F.lit("a"), "seq").alias("answer"))


def trie(s, d):
    return M.trie_nodes(paths(s, d))


def named(rows):
    return rows.withColumn("prefix", F.array_join("path", "/")).drop("path")


def thoughts(s, d):
    return V.view(s, d, V.THOUGHTS)


def runs(s, d):
    rows = conversations(s, d).select(F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("conv_id").alias("run_id"), F.col("turn").alias("created_at"), F.when(F.col("role") == "user", F.array(F.lit("user_query"))).when(F.col("role") == "assistant", F.array(F.lit("final_result"))).otherwise(F.array()).alias("tags"))
    links = thoughts(s, d).where("parent_id IS NOT NULL").select(F.concat(F.lit("e"), "id").alias("id"), F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"))
    return rows, links


def shortest(s, d):
    links = geo_edges(s, d).select(F.concat_ws(">", "src", "tgt").alias("id"), "src", F.col("tgt").alias("dst"), F.substring("tgt", 2, 9).cast("long").alias("seq"))
    pairs = geo_edges(s, d).where("src LIKE 'c%' AND tgt LIKE 'r%'").select(F.col("src").alias("start"), F.col("tgt").alias("end"))
    up = V.table(s, d, "supplier").join(nation(s, d), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("r"), "n_regionkey"))
    return H.shortest_paths(links, pairs.union(up)).select("start", "end", F.array_join("node_ids", ">").alias("path"), F.size("edge_ids").alias("n"))


def online_fixed(s):
    members = s.createDataFrame([("b", ["b", "b2"])], "id string, keys array<string>")
    edges = s.sql("SELECT * FROM VALUES ('root', 'middle'), ('middle', 'leaf'), ('top', 'b'), ('r2', 'twin1'), ('p', 'r2') AS t(src, tgt)")
    rows = s.createDataFrame([(a, b, "yes", 2.0, c, m) for a, b, c, m in INSERTS], "source string, target string, relation string, score double, confidence double, similar boolean")
    return O.refine(edges, rows, members, similar=lambda a, b: a[:-1] == b[:-1] and a[:4] == "twin").select("source", "target", "lane")


def updates(s, d):
    """Every event as an update among the classes of its user, so users are independent of one another."""
    at = lambda x: F.concat(F.lit("u"), "user_id", F.lit("_"), x % 12)
    return events(s, d).select(at(F.col("event_id")).alias("source"), at(F.col("event_id") * 7 + F.dayofmonth("ts")).alias("target"), F.col("event_type").alias("relation"), F.lit(2.0).alias("score"), F.least(F.col("value") / 5, F.lit(10.0)).alias("confidence"))


def online(s, d):
    return O.refine(s.createDataFrame([], "src string, tgt string"), updates(s, d))


def tokens(s, d):
    return V.table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), (F.col("vec_id") % 7).cast("int").alias("rank"), (F.col("vec_id") * 13 % 101).alias("score")), V.table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").alias("cluster"))


def vectors(s, d):
    return V.table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))


def rdf_round_trip(form):
    def run(s, d):
        path = place(s, "rdf")
        K.write_rdf(geo(s, d), path, form, base="urn:g:", labels=True)
        return S.triples(s, path, form).select("s", "p", "o", "kind").distinct()

    return run


RDF_SQL = f"SELECT DISTINCT 'urn:g:' || s AS s, 'http://www.w3.org/2000/01/rdf-schema#subClassOf' AS p, 'urn:g:' || o AS o, 'iri' AS kind FROM {GEO} UNION SELECT 'urn:g:' || x, 'http://www.w3.org/2000/01/rdf-schema#label', x, 'literal' FROM (SELECT s AS x FROM {GEO} UNION SELECT o FROM {GEO})"


def run_graph(s, d):
    path = place(s, "run-graph")
    nodes, links = runs(s, d)
    K.save_run_graph(nodes.withColumn("expires", F.when(F.col("created_at") % 5 == 4, F.lit("2024-01-01").cast("timestamp"))), links.withColumn("expires", F.lit(None).cast("timestamp")), path)
    a, b = K.load_run_graph(s, path, 7, "id string, created_at long, tags array<string>", "id string, src string, dst string, seq long", now="2024-06-01")
    return a.select("id", F.lit("node").alias("item"), F.col("created_at").alias("at")).union(b.select("id", F.lit("edge"), "seq"))


def embeddings_saved(s, d):
    path, rows = place(s, "embeddings"), vectors(s, d)
    mark = K.digest(geo(s, d))
    K.save_embeddings(rows.select("id", F.col("vector").alias("graph"), F.col("vector").alias("text"), F.col("vector").alias("fused")), path, mark)
    same = K.load_embeddings(s, path, rows, mark)
    other = K.load_embeddings(s, path, rows, mark, alpha=0.25)
    fewer = K.load_embeddings(s, path, rows.where("id <> '0'"), mark)
    return s.range(1).select(F.lit(same.count()).alias("same"), F.lit(other is None).alias("other_settings"), F.lit(fewer is None).alias("other_ids"), F.lit(K.clear_embeddings(s, [path], mark) == [path]).alias("cleared"), F.lit(K.exists(s, path)).alias("left"))


def memory_saved(s, d):
    path = place(s, "memory")
    hot, short = M.remaining(requests(s, d)), named(trie(s, d))
    K.save_memory(hot, short, named(M.promoted(trie(s, d))), path)
    held = K.load_memory(s, path)
    return held["hot"].groupBy(F.col("tier").alias("name")).agg(F.count("*").alias("n")).union(held["short_term"].agg(F.lit("short"), F.count("*"))).union(held["long_term"].agg(F.lit("long"), F.count("*")))


def noise_report(s, d):
    nodes = part(s, d).select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("labels"))
    rows = E.noised_ontology(nodes, ("labels",), E.Noise(record=1.0, value=1.0, delete=0.3, swap=0.0, name=0.0))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.size("changed") > 0).alias("changed"), F.count_if("renamed").alias("renamed"), F.count_if(F.col("swapped_with").isNotNull()).alias("swapped"))


def centrality(s, d):
    """Each user's days as responses that entail one another as far as their event types agree."""
    rows = events(s, d).select(F.col("user_id").alias("grp"), F.dayofmonth("ts").alias("day"), "event_type").distinct()
    pairs = rows.withColumnRenamed("day", "a").join(rows.withColumnRenamed("day", "b"), ["grp", "event_type"]).where("a <> b").groupBy("grp", "a", "b").agg((F.count("*") / 5).alias("p"))
    return E.centralities(E.entailment_edges(pairs))


QUERIES = {
    "X7_hot_cache": (
        lambda s, d: M.consulted(requests(s, d), 32, "lru").select("tier", "seq", "hit"),
        f"{LRU} SELECT p.tier, p.seq, prev IS NOT NULL AND coalesce(between_, 0) < 32 AS hit FROM p LEFT JOIN g USING (tier, seq)",
    ),
    "X12_two_queues": (lambda s, d: M.remaining(requests(s, d), 32, "2q"), None),
    "X12_frequent": (lambda s, d: M.consulted(requests(s, d), 32, "lfu").groupBy("tier").agg(F.count_if("hit").alias("hits"), F.sum(F.size("evicted")).alias("evicted")), None),
    "X8_prefix_trie": (
        lambda s, d: named(trie(s, d)).select("prefix", "count", "order", "last_used"),
        f"SELECT prefix, n AS count, born AS \"order\", used AS last_used FROM {NODES}",
    ),
    "X8_trie_eviction": (lambda s, d: M.trie_eviction(trie(s, d).select(F.lit("t").alias("trie"), "path", "count", "order", "last_used", F.col("count").alias("frequency"), F.lit("").alias("queue")), 60), None),
    "X9_promoted": (
        lambda s, d: named(M.promoted(trie(s, d))).select("prefix", "count"),
        f"SELECT prefix, n AS count FROM {NODES} WHERE n >= 3 AND ends > 0 ORDER BY n DESC, used DESC LIMIT 1024",
    ),
    "Z21_path_answers": (
        lambda s, d: M.path_answers(paths(s, d), trie(s, d)),
        f"SELECT q.id, 'a' || max(p.seq) AS answer FROM {PATHS} q JOIN {PATHS} p ON p.path = q.path GROUP BY q.id",
    ),
    "X11_longest_prefix": (
        lambda s, d: B.longest_prefix(paths(s, d), M.promoted(trie(s, d)).select("path")),
        f"WITH k AS (SELECT prefix FROM {NODES} WHERE n >= 3 AND ends > 0 ORDER BY n DESC, used DESC LIMIT 1024) SELECT q.id, arg_max(array_to_string(q.path[1:k], '/'), k) AS prefix FROM (SELECT id, path, unnest(range(1, len(path) + 1)) AS k FROM {PATHS}) q WHERE array_to_string(q.path[1:k], '/') IN (SELECT prefix FROM k) GROUP BY q.id",
    ),
    "Z20_replayed_prefix": (
        lambda s, d: M.replayed_prefixes(paths(s, d), paths(s, d)),
        f"SELECT q.id, arg_max(array_to_string(q.path[1:k], '/'), k) AS prefix FROM (SELECT id, path, unnest(range(1, len(path))) AS k FROM {PATHS}) q WHERE array_to_string(q.path[1:k], '/') IN (SELECT array_to_string(path, '/') FROM {PATHS}) GROUP BY q.id",
    ),
    "X10_replay_key": (
        lambda s, d: paths(s, d).groupBy(M.replay_key("path").alias("key")).agg(F.count("*").alias("n")),
        f"SELECT array_to_string(list_sort(list_distinct(path)), ',') AS key, count(*) AS n FROM {PATHS} GROUP BY 1",
    ),
    "Z19_rebuilt_index": (
        lambda s, d: named(M.rebuilt_index(trie(s, d), M.promoted(trie(s, d)).select("path", F.concat(F.lit("p"), "count").alias("answer")))),
        f"SELECT t.prefix, coalesce(l.answer, t.answer) AS answer FROM (SELECT array_to_string(path, '/') AS prefix, 'a' || max(seq) AS answer FROM {PATHS} GROUP BY 1) t LEFT JOIN (SELECT prefix, 'p' || n AS answer FROM {NODES} WHERE n >= 3 AND ends > 0 ORDER BY n DESC, used DESC LIMIT 1024) l USING (prefix)",
    ),
    "X13_consult_tiers": (
        lambda s, d: M.answers_in_tiers(events(s, d).select(F.col("user_id").cast("string").alias("key")).distinct(), [("hot", M.remaining(requests(s, d)).where("tier = 'click'").select("key", "answer")), ("path", paths(s, d).where(F.size("path") >= 5).select(F.floor(F.col("id") / 100).cast("string").alias("key"), F.lit("p").alias("answer"))), ("store", events(s, d).where("event_type = 'error'").select(F.col("user_id").cast("string").alias("key"), F.lit("s").alias("answer")))]),
        f"SELECT key, CASE source WHEN 'hot' THEN 'answer' WHEN 'path' THEN 'p' WHEN 'store' THEN 's' END AS answer, source FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'click' GROUP BY 1 ORDER BY max(event_id) DESC LIMIT 32) THEN 'hot' WHEN user_id IN (SELECT id // 100 FROM {PATHS} WHERE len(path) >= 5) THEN 'path' WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'store' END AS source FROM events)",
    ),
    "X14_longest_answers": (
        lambda s, d: M.longest_answers(documents(s, d).select(F.col("doc_id").alias("seq"), F.concat(F.lit("What are the "), "source", F.lit(" in "), "lang", F.lit("?")).alias("question"), F.col("text").alias("answer"))).select("key", F.md5(F.col("answer").cast("binary")).alias("answer")),
        "SELECT array_to_string(list_sort(list_distinct([CASE WHEN length(source) > 4 AND ends_with(source, 's') THEN source[1:length(source) - 1] ELSE source END, lang])), ',') AS key, md5(arg_max(text, (length(text), -doc_id))) AS answer FROM documents WHERE text <> '' GROUP BY 1",
    ),
    "X15_chat_chains": (
        lambda s, d: M.chained(conversations(s, d).select(F.col("conv_id").alias("chat"), F.col("turn").alias("seq"), (F.col("role") != "user").alias("continues"))).select("chat", "seq", "chain"),
        "SELECT conv_id AS chat, turn AS seq, sum(CASE WHEN role = 'user' OR first THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS chain FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS first FROM conversations)",
    ),
    "X17_event_fold": (
        lambda s, d: H.reasoning_depths(events(s, d).select(F.col("user_id").alias("trace"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "reasoning").when(F.col("event_id") % 3 == 1, "step_back").otherwise("prompt").alias("kind"), F.lit(1).alias("delta"))).select("trace", "seq", "depth", "parent"),
        "WITH r AS (SELECT user_id AS trace, event_id AS seq, event_id % 3 AS k, sum(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events), m AS (SELECT *, t - least(0, min(t) OVER (PARTITION BY trace ORDER BY seq)) AS depth FROM r) SELECT trace, seq, CAST(depth AS INTEGER) AS depth, lag(seq) OVER (PARTITION BY trace ORDER BY seq) AS parent FROM m WHERE k <> 1",
    ),
    "X18_live_rebuild": (
        lambda s, d: R.live(events(s, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "dead").otherwise("live").alias("status"), "event_type")).select("key", "seq", "event_type"),
        "SELECT user_id AS key, event_id AS seq, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'",
    ),
    "X1_online_fixed": (
        lambda s, d: online_fixed(s),
        "SELECT * FROM (VALUES ('root', 'new', 'applied'), ('leaf', 'root', 'CYCLE'), ('root', 'middle', 'LOW_CONFIDENCE'), ('x', 'x', 'SEMANTIC_CONFLICT'), ('far', 'away', 'applied'), ('b', 'b', 'SEMANTIC_CONFLICT'), ('b', 'b::split', 'split'), ('r2', 'twin2', 'applied'), ('twin1', 'twin2', 'merged')) AS t(source, target, lane)",
    ),
    "X1_online_refine": (online, None),
    "X6_deferred_lanes": (lambda s, d: online(s, d).groupBy("lane").agg(F.count("*").alias("n")), None),
    "X3_split_class": (
        lambda s, d: s.createDataFrame([tuple(e) for e in split_edges()], "src string, tgt string, relation string, score double"),
        "SELECT * FROM (VALUES ('a', 'c', 'r', 3.0), ('a', 'k', 'r', 2.0), ('b', 'c', 'r', 3.0), ('b', 'k', 'r', 2.0), ('up', 'a', 'r', 2.0), ('up', 'b', 'r', 2.0)) AS t(src, tgt, relation, score)",
    ),
    "X5_structural_twins": (
        lambda s, d: G.twins(V.table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")), geo_edges(s, d)),
        f"WITH e AS ({GEO_EDGES}), g AS (SELECT src AS id, string_agg(tgt, ',' ORDER BY tgt) AS up FROM e WHERE src LIKE 's%' GROUP BY src), m AS (SELECT *, min(id) OVER (PARTITION BY up) AS keeps FROM g) SELECT id, keeps FROM m WHERE id <> keeps",
    ),
    "G18_find_path": (
        shortest,
        f"SELECT s AS start, o AS \"end\", s || '>' || o AS path, 1 AS n FROM (SELECT DISTINCT s, o FROM {GEO} WHERE s LIKE 'c%' AND o LIKE 'r%') UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 's' || s_suppkey || '>n' || n_nationkey || '>r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "G18_run_paths": (
        lambda s, d: H.run_paths(*runs(s, d)).select("run_id", F.array_join("node_ids", ">").alias("path")),
        "WITH e AS (SELECT conv_id, coalesce(min(turn) FILTER (role = 'user'), min(turn)) AS a, coalesce(max(turn) FILTER (role = 'assistant'), max(turn)) AS z FROM conversations GROUP BY 1) SELECT conv_id AS run_id, string_agg(conv_id || '_' || turn, '>' ORDER BY turn) AS path FROM conversations JOIN e USING (conv_id) WHERE a <= z AND turn BETWEEN a AND z GROUP BY 1",
    ),
    "G22_trace_tree": (
        lambda s, d: H.depths(thoughts(s, d)),
        f"WITH RECURSIVE {TREE} SELECT w.id, w.root, w.depth, NOT EXISTS (SELECT 1 FROM {TH} c WHERE c.parent_id = w.id AND NOT c.root) AS leaf FROM walk w",
    ),
    "G22_path_to_root": (
        lambda s, d: H.paths_to_root(thoughts(s, d), thoughts(s, d).where("turn % 3 = 2").select("id")).select("id", F.array_join("path", ">").alias("path")),
        f"WITH RECURSIVE {TREE} SELECT id, path FROM walk WHERE id IN (SELECT id FROM {TH} WHERE turn % 3 = 2)",
    ),
    "G23_trace_edges": (
        lambda s, d: H.trace_edges(thoughts(s, d).withColumn("kind", F.when(F.col("role") == "assistant", "reasoning").when(F.col("turn") % 4 == 2, "tool_call").otherwise("prompt"))),
        f"SELECT parent_id AS src, id AS dst, CASE WHEN role = 'assistant' THEN 'justifies' WHEN turn % 4 = 2 THEN 'tool_invocation' ELSE 'next' END AS kind FROM {TH} WHERE NOT root",
    ),
    "G24_dedup_thoughts": (
        lambda s, d: H.deduplicated(documents(s, d).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.col("lang").alias("question"), F.col("text").alias("answer"), F.array("lang", "source").alias("tags"), F.create_map(F.lit("source"), F.col("source")).alias("meta"))).select("key", "id", "n", F.array_join("tags", ",").alias("tags"), F.col("meta")["source"].alias("source")),
        "WITH k AS (SELECT *, sha256(coalesce(lang, '') || '|' || coalesce(text, '')) AS key FROM documents), t AS (SELECT key, string_agg(t, ',' ORDER BY t) AS tags FROM (SELECT DISTINCT key, unnest([lang, source]) AS t FROM k) GROUP BY key) SELECT key, min(doc_id) AS id, count(*) AS n, any_value(tags) AS tags, arg_min(source, doc_id) AS source FROM k JOIN t USING (key) GROUP BY key",
    ),
    "P21_prompt_response": (
        lambda s, d: (lambda v: v[0].select("id", F.md5(F.col("content").cast("binary")).alias("content"), F.col("prompt_type").alias("kind")).union(v[1].select("id", F.md5(F.col("content").cast("binary")), "response_type")).union(v[2].select("source_id", "target_id", "edge_type")))(H.prompt_response_view(thoughts(s, d).select("id", F.when(F.col("role") == "user", "prompt").when(F.col("role") == "system", "reasoning").otherwise("response").alias("kind"), F.col("text").alias("question"), F.lit("").alias("content"), F.col("text").alias("answer"), F.lit(None).cast("string").alias("prompt_type")), H.trace_edges(thoughts(s, d).withColumn("kind", F.lit("reasoning"))).withColumn("confidence", F.lit(None).cast("double")))),
        f"SELECT id, md5(text) AS content, CASE role WHEN 'user' THEN 'user' WHEN 'system' THEN 'reasoning' ELSE 'assistant' END AS kind FROM {TH} UNION ALL SELECT parent_id, id, 'reasoning' FROM {TH} WHERE NOT root",
    ),
    "S12_merge_runs": (
        lambda s, d: H.merged_runs(events(s, d).where("event_type IN ('click', 'view')").select(F.col("event_id").alias("id"), F.lit(0).alias("run_order")).union(events(s, d).where("event_type IN ('view', 'error')").select("event_id", F.lit(1))), events(s, d).select(F.col("event_id").alias("id"), F.col("event_id").alias("src"), (F.col("event_id") + 4).alias("dst"), F.lit(0).alias("run_order")))[1].select("src", "dst"),
        "WITH n AS (SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'error')) SELECT event_id AS src, event_id + 4 AS dst FROM n WHERE event_id + 4 IN (SELECT event_id FROM n)",
    ),
    "U6_merge_first": (
        lambda s, d: H.merged_runs(conversations(s, d).select(F.md5(F.concat_ws("|", "role", "text").cast("binary")).alias("id"), F.col("conv_id").alias("run_order"), "turn").groupBy("id", "run_order").agg(F.min("turn").alias("turn")), s.createDataFrame([], "id string, src string, dst string, run_order long"))[0],
        "SELECT id, run_order, turn FROM (SELECT md5(role || '|' || text) AS id, conv_id AS run_order, min(turn) AS turn FROM conversations GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY run_order) = 1",
    ),
    "A22_run_statistics": (
        lambda s, d: H.statistics(H.depths(thoughts(s, d)).join(thoughts(s, d).select("id", F.col("role").alias("kind"), F.length("text").alias("chars")), "id"), H.trace_edges(thoughts(s, d).withColumn("kind", F.lit("prompt")))).withColumn("value", F.round("value", 6)),
        f"WITH RECURSIVE {TREE}, x AS (SELECT w.depth, length(t.text) AS c, t.role FROM walk w JOIN {TH} t ON t.id = w.id) SELECT 'thoughts' AS measure, role AS name, CAST(count(*) AS DOUBLE) AS value FROM x GROUP BY role UNION ALL SELECT 'edges', 'next', CAST(count(*) AS DOUBLE) FROM {TH} WHERE NOT root UNION ALL SELECT 'whole', 'greatest_depth', CAST(max(depth) AS DOUBLE) FROM x UNION ALL SELECT 'whole', 'mean_depth', round(avg(depth), 6) FROM x UNION ALL SELECT 'whole', 'chars', CAST(sum(c) AS DOUBLE) FROM x UNION ALL SELECT 'whole', 'mean_chars', round(avg(c), 6) FROM x",
    ),
    "Z39_durations": (
        lambda s, d: H.durations(events(s, d).select("event_id", F.col("ts").cast("timestamp").alias("started"), (F.col("ts").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, CAST(event_id % 100 AS DECIMAL(18, 6)) / 8)")).alias("ended"))).select("event_id", F.round("duration_ms", 1).alias("duration_ms")),
        "SELECT event_id, round((event_id % 100) * 125.0, 1) AS duration_ms FROM events",
    ),
    "J3_copy_metadata": (
        lambda s, d: R.with_metadata(geo_edges(s, d), nation(s, d).select(F.concat(F.lit("n"), "n_nationkey").alias("src"), "n_name"), "src"),
        f"SELECT src, tgt, n_name FROM ({GEO_EDGES}) LEFT JOIN nation ON src = 'n' || n_nationkey",
    ),
    "J4_merge_metadata": (
        lambda s, d: R.merged_metadata([V.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("v")), V.table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.array_sort(F.collect_set(F.concat(F.lit("s"), F.col("s_suppkey") % 3))).alias("v")), nation(s, d).select(F.col("n_nationkey").alias("k"), F.array(F.lit("s1"), F.lit("n")).alias("v"))], "k", "v").select("k", F.array_join("v", ",").alias("all")),
        "WITH v AS (SELECT c_nationkey AS k, 0 AS t, c_mktsegment AS v FROM customer UNION SELECT s_nationkey, 1, 's' || (s_suppkey % 3) FROM supplier UNION SELECT n_nationkey, 2, unnest(['s1', 'n']) FROM nation), f AS (SELECT k, v, min((t, CASE WHEN t = 2 AND v = 'n' THEN '~' ELSE v END)) AS r FROM v GROUP BY k, v) SELECT k, string_agg(v, ',' ORDER BY r) AS \"all\" FROM f GROUP BY k",
    ),
    "J5_resolve_keys": (
        lambda s, d: G.resolved_keys(nation(s, d).select(F.explode(F.array("n_name", F.lower("n_name"), F.concat(F.lit("urn:n/"), "n_name"))).alias("key")), nation(s, d).select(F.col("n_nationkey").alias("id"), "n_name", F.explode(F.array(F.lit(0), F.lit(1))).alias("c")).select((F.col("id") + 100 * F.col("c")).alias("id"), F.when(F.col("c") == 0, F.col("n_name")).otherwise(F.concat(F.lit("x"), "id")).alias("name"), F.when(F.col("c") == 0, F.concat(F.lit("urn:n/"), "n_name")).otherwise(F.concat(F.lit("urn:m/"), F.lower("n_name"))).alias("iri"), (F.col("id") + 100 * F.col("c")).alias("seq"))),
        "SELECT n_name AS key, n_nationkey AS id FROM nation UNION ALL SELECT 'urn:n/' || n_name, n_nationkey FROM nation UNION ALL SELECT lower(n_name), n_nationkey + 100 FROM nation",
    ),
    "J10_isolated_classes": (
        lambda s, d: G.isolated(part(s, d).select(F.concat(F.lit("p"), "p_partkey").alias("id")), V.view(s, d, V.SUPPLY).where("score >= 50")),
        f"SELECT 'p' || p_partkey AS id FROM part WHERE 'p' || p_partkey NOT IN (SELECT tgt FROM {SUPPLY} WHERE score >= 50)",
    ),
    "J11_without_schema": (
        lambda s, d: G.undeclared(part(s, d).select(F.col("p_name").alias("p")), part(s, d).where("p_size > 48").select(F.col("p_name").alias("p")), part(s, d).where("p_retailprice > 2000").select(F.col("p_name").alias("p"))),
        "SELECT DISTINCT p_name AS p FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 48) AND p_name NOT IN (SELECT p_name FROM part WHERE p_retailprice > 2000)",
    ),
    "J12_resolve_endpoints": (
        lambda s, d: G.resolved_endpoints(V.table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey") + 5).alias("id"), F.array(F.concat(F.lit("k"), F.col("s_nationkey") * 2)).alias("keys")), V.table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.array(F.concat(F.lit("k"), "s_nationkey")).alias("keys"))),
        "WITH i AS (SELECT 's' || (s_suppkey + 5) AS id, 'k' || (s_nationkey * 2) AS k FROM supplier), n AS (SELECT 's' || s_suppkey AS id, 'k' || s_nationkey AS k FROM supplier), r AS (SELECT i.id, CASE WHEN i.id IN (SELECT id FROM n) THEN i.id ELSE (SELECT min(n.id) FROM n WHERE n.k = i.k) END AS node FROM i) SELECT id, coalesce(node, id) AS node, node IS NULL AS is_new FROM r",
    ),
    "F26_node_report": (
        lambda s, d: R.node_report(geo(s, d).select("s", "p", "o").union(nation(s, d).select(F.concat(F.lit("n"), "n_nationkey"), F.lit("rdfs:label"), "n_name"))).select("id", *(F.array_join(c, ",").alias(c) for c in ("labels", "parents", "children")), "n_out", "n_in"),
        f"WITH t AS (SELECT s, p, o FROM {GEO} UNION ALL SELECT 'n' || n_nationkey, 'rdfs:label', n_name FROM nation), e AS (SELECT s AS id, p, o AS x, true AS out FROM t UNION ALL SELECT o, p, s, false FROM t) SELECT id, coalesce(string_agg(DISTINCT CASE WHEN out AND p = 'rdfs:label' THEN x END, ',' ORDER BY CASE WHEN out AND p = 'rdfs:label' THEN x END), '') AS labels, coalesce(string_agg(DISTINCT CASE WHEN out AND p <> 'rdfs:label' THEN x END, ',' ORDER BY CASE WHEN out AND p <> 'rdfs:label' THEN x END), '') AS parents, coalesce(string_agg(DISTINCT CASE WHEN NOT out AND p <> 'rdfs:label' THEN x END, ',' ORDER BY CASE WHEN NOT out AND p <> 'rdfs:label' THEN x END), '') AS children, count(*) FILTER (out) AS n_out, count(*) FILTER (NOT out) AS n_in FROM e GROUP BY id",
    ),
    "G8_limited_closure": (
        lambda s, d: R.limited_closure(geo_edges(s, d), 50)[0],
        f"WITH RECURSIVE {CLOSED} SELECT * FROM (SELECT src, tgt FROM tc EXCEPT SELECT src, tgt FROM edge) ORDER BY src, tgt LIMIT 50",
    ),
    "G13_rank_partitions": (
        lambda s, d: G.rank_partitions(G.ranks(geo_edges(s, d)), V.table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("key"))),
        f"WITH i AS (SELECT DISTINCT s AS id FROM {GEO} UNION SELECT o FROM {GEO}), k AS (SELECT id, CASE id[1] WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END AS rank, c_mktsegment AS key FROM i LEFT JOIN customer ON id = 'c' || c_custkey) SELECT id, CAST(rank AS INTEGER) AS rank, min(id) OVER (PARTITION BY rank, coalesce(key, id)) AS block FROM k",
    ),
    "G14_structural_signatures": (
        lambda s, d: G.structural_signatures(geo(s, d).select(F.col("s").alias("src"), F.col("o").alias("tgt"), F.col("p").alias("relation")).distinct(), V.table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("block")).union(nation(s, d).select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("n"), "n_regionkey")))).select("id", F.to_json("down").alias("down"), F.to_json("up").alias("up")),
        "WITH c AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS n, c_mktsegment AS b FROM customer), n AS (SELECT 'n' || n_nationkey AS id, 'n' || n_regionkey AS b FROM nation) SELECT c.id, '[{\"relation\":\"is_a\",\"block\":\"' || n.b || '\"}]' AS down, '[]' AS up FROM c JOIN n ON n.id = c.n UNION ALL SELECT n.id, '[]', '[' || coalesce((SELECT string_agg(DISTINCT '{\"relation\":\"is_a\",\"block\":\"' || c.b || '\"}', ',' ORDER BY '{\"relation\":\"is_a\",\"block\":\"' || c.b || '\"}') FROM c WHERE c.n = n.id), '') || ']' FROM n",
    ),
    "G25_star_expansion": (
        lambda s, d: (lambda x: x[0].withColumn("to", F.lit(None).cast("string")).union(x[1].select("src", F.lit("edge to"), "tgt")))(G.star(V.view(s, d, V.INCIDENCE))),
        f"SELECT DISTINCT vid AS id, 'node' AS part, NULL AS \"to\" FROM {INCIDENCE} UNION ALL SELECT DISTINCT eid, 'edge', NULL FROM {INCIDENCE} UNION ALL SELECT eid, 'edge to', vid FROM {INCIDENCE}",
    ),
    "G26_hyperedge_edits": (
        lambda s, d: G.edited(V.view(s, d, V.INCIDENCE), put=s.sql("SELECT * FROM VALUES ('o2', 'p1'), ('new', 'p1') AS t(eid, vid)"), extend=s.sql("SELECT * FROM VALUES ('o3', 'p1'), ('o3', 'px') AS t(eid, vid)"), remove=s.sql("SELECT 'o1' AS eid")),
        f"SELECT eid, vid FROM {INCIDENCE} WHERE eid NOT IN ('o1', 'o2') UNION SELECT * FROM (VALUES ('o2', 'p1'), ('new', 'p1'), ('o3', 'p1'), ('o3', 'px'))",
    ),
    "G29_filtered_section": (
        lambda s, d: G.filtered_section(V.view(s, d, V.INCIDENCE), 1, 1),
        f"WITH p AS (SELECT x.vid AS src, y.vid AS tgt, count(*) AS score FROM {INCIDENCE} x JOIN {INCIDENCE} y ON x.eid = y.eid AND x.vid < y.vid GROUP BY 1, 2), m AS (SELECT *, src AS u, tgt AS v FROM p UNION ALL SELECT *, tgt, src FROM p) SELECT DISTINCT src, tgt, score FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, v) AS r FROM m) WHERE r <= 1",
    ),
    "A2_hyperedge_sizes": (
        lambda s, d: G.sizes(V.view(s, d, V.INCIDENCE)).withColumns({"mean": F.round("mean", 6), "singletons": F.round("singletons", 6)}),
        f"SELECT count(*) AS n, min(size) AS least, max(size) AS most, round(avg(size), 6) AS mean, round(avg(CASE WHEN size = 1 THEN 1.0 ELSE 0 END), 6) AS singletons FROM (SELECT eid, count(*) AS size FROM {INCIDENCE} GROUP BY eid)",
    ),
    "G28_random_walks": (lambda s, d: E.walks(geo_edges(s, d), 4, 2, p=0.5, q=2.0), None),
    "G28_node_vectors": (lambda s, d: E.node_vectors(geo_edges(s, d), 8, 6, 4), None),
    "Z49_weighted_graph": (
        lambda s, d: E.weighted_graph(events(s, d).select(F.col("user_id").alias("src"), F.col("event_type").alias("tgt"), F.col("value").alias("score"), F.col("event_id").alias("seq"))),
        "SELECT user_id AS src, event_type AS tgt, arg_max(value, event_id) AS weight FROM events GROUP BY 1, 2",
    ),
    "A28_centralities": (centrality, None),
    "F30_noise": (lambda s, d: part(s, d).select("p_partkey", E.noised(F.col("p_name"), F.col("p_partkey"), E.Noise(substitute=0.2, ocr=0.5)).alias("noisy")), None),
    "F31_noise_report": (noise_report, None),
    "Z33_profiles": (
        lambda s, d: Z.profiles(geo_edges(s, d).select(F.explode(F.array("src", "tgt")).alias("id")), geo_edges(s, d)),
        f"WITH RECURSIVE {CLOSED}, n AS (SELECT src AS id FROM edge UNION SELECT tgt FROM edge), up(id, d) AS (SELECT src, 0 FROM edge WHERE src NOT IN (SELECT tgt FROM edge) UNION SELECT edge.tgt, d + 1 FROM up JOIN edge ON edge.src = up.id), a AS (SELECT tgt AS id, count(*) AS n_above FROM tc GROUP BY 1), b AS (SELECT src AS id, count(*) AS n_below FROM tc GROUP BY 1) SELECT n.id, CAST((SELECT max(d) FROM up WHERE up.id = n.id) AS INTEGER) AS rank, coalesce(n_above, 0) AS n_above, coalesce(n_below, 0) AS n_below, coalesce(n_below, 0) * ((SELECT count(*) FROM n) - coalesce(n_below, 0)) AS score FROM n LEFT JOIN a ON a.id = n.id LEFT JOIN b ON b.id = n.id",
    ),
    "Z34_representatives": (
        lambda s, d: Z.representatives(*tokens(s, d)),
        "WITH f AS (SELECT CAST(vec_id AS VARCHAR) AS id, label AS cluster, vec_id % 7 AS rank, vec_id * 13 % 101 AS score FROM embeddings), p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rank, id) AS at_, count(*) OVER (PARTITION BY cluster) AS n FROM f), m AS (SELECT cluster, rank AS median FROM p WHERE at_ = (n + 1) // 2) SELECT cluster, id FROM (SELECT f.*, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, id) AS r FROM f JOIN m USING (cluster) WHERE abs(rank - median) <= 1) WHERE r = 1",
    ),
    "Z35_cluster_priorities": (
        lambda s, d: Z.priorities(*tokens(s, d), vectors(s, d)).withColumn("priority", F.round("priority", 4)),
        "WITH f AS (SELECT label AS cluster, vec_id % 7 AS rank, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM f), s AS (SELECT x.cluster, avg(list_dot_product(x.v, y.v) / (x.n * y.n)) AS mean FROM u x JOIN u y USING (cluster) GROUP BY 1), c AS (SELECT cluster, count(*) AS n, max(rank) - min(rank) AS span FROM f GROUP BY 1) SELECT cluster, n, round(n * CASE WHEN n > 1 THEN 2 - mean ELSE 1.5 END * (1 + span / (SELECT max(rank) FROM f)), 4) AS priority FROM c JOIN s USING (cluster)",
    ),
    "T11_chosen_queries": (
        lambda s, d: s.createDataFrame([(i, x) for i, x in enumerate(Z.chosen_queries(geo_edges(s, d).select(F.explode(F.array("src", "tgt")).alias("id")).distinct(), geo_edges(s, d), geo_edges(s, d).select(F.explode(F.array("src", "tgt")).alias("id")).distinct().select("id", F.substring("id", 1, 1).alias("cluster")), 2))], "at int, id string"),
        None,
    ),
    "U5_candidates_left": (
        lambda s, d: Z.candidates_left(geo_edges(s, d).select(F.explode(F.array("src", "tgt")).alias("id")), geo_edges(s, d), s.sql("SELECT * FROM VALUES ('r1', true), ('n3', false), ('s5', false) AS t(id, yes)")),
        f"WITH RECURSIVE {CLOSED}, n AS (SELECT src AS id FROM edge UNION SELECT tgt FROM edge) SELECT id FROM n WHERE id NOT IN (SELECT src FROM tc WHERE tgt = 'r1') AND id NOT IN ('n3', 's5') AND id NOT IN (SELECT tgt FROM tc WHERE src IN ('n3', 's5'))",
    ),
    "K1_turtle": (rdf_round_trip("turtle"), RDF_SQL),
    "K1_rdfxml": (rdf_round_trip("xml"), RDF_SQL),
    "K3_snapshot": (
        lambda s, d: (lambda p: (K.save_snapshot({"triples": geo(s, d), "nations": nation(s, d)}, p, name="geo"), K.load_snapshot(s, p, name="geo"))[1]["triples"].groupBy("p").agg(F.count("*").alias("n")))(place(s, "snapshot")),
        f"SELECT p, count(*) AS n FROM {GEO} GROUP BY p",
    ),
    "K4_embeddings_saved": (embeddings_saved, "SELECT count(*) AS same, true AS other_settings, true AS other_ids, true AS cleared, false AS \"left\" FROM embeddings"),
    "K6_memory_saved": (
        memory_saved,
        f"SELECT event_type AS name, least(32, count(DISTINCT user_id)) AS n FROM events GROUP BY 1 UNION ALL SELECT 'short', count(*) FROM {NODES} UNION ALL SELECT 'long', least(1024, count(*)) FROM {NODES} WHERE n >= 3 AND ends > 0",
    ),
    "K8_run_graph": (
        run_graph,
        "SELECT '7_' || turn AS id, 'node' AS item, turn AS at FROM conversations WHERE conv_id = 7 AND turn % 5 <> 4 UNION ALL SELECT 'e7_' || turn, 'edge', turn FROM conversations WHERE conv_id = 7 AND turn > (SELECT min(turn) FROM conversations WHERE conv_id = 7)",
    ),
    "K11_wide_metrics": (
        lambda s, d: K.wide_metrics(events(s, d).groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))).select("run", F.coalesce("click", F.lit(0)).alias("click"), F.coalesce("view", F.lit(0)).alias("view")),
        "SELECT user_id AS run, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1",
    ),
    "F25_class_expressions": (
        lambda s, d: C.class_expressions(s.createDataFrame(list(S.parse_turtle(f"@prefix ex: <http://x/> . @prefix owl: <{OWL}> ." + CLASSES)), S.TRIPLES), {"ex": "http://x/", "owl": OWL}).select("text"),
        "SELECT * FROM (VALUES ('ex:has some (ex:A or ex:B)'), ('ex:has min 2 ex:C'), ('ex:A and not ex:B and ex:of value x'), ('{ex:a, ex:b}'), ('ex:n exactly 3')) AS t(text)",
    ),
    "Y4_validated_matches": (
        lambda s, d: Y.checked(geo(s, d).select("s", "o"), (Y.DUPLICATES, Y.Rule("No Self Matches", lambda rows: F.count_if(F.col("s") == F.col("o")), "warning"))),
        f"SELECT 'No Duplicate Matches' AS rule, 'error' AS severity, count(*) = count(DISTINCT (s, o)) AS passed, count(*) - count(DISTINCT (s, o)) AS offending, count(*) AS checked FROM {GEO} UNION ALL SELECT 'No Self Matches', 'warning', true, 0, count(*) FROM {GEO}",
    ),
    "C7_validation": (
        lambda s, d: D.process(V.view(s, d, V.TUPLES)).evaluations.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg("overall"), 6).alias("overall")),
        EVALUATED.replace("ev AS (SELECT p_partkey,", "ev AS (SELECT p_partkey, rel,") + "SELECT CASE rel WHEN 'isa' THEN 'isA' WHEN 'sameas' THEN 'sameAs' WHEN 'hasproperty' THEN 'hasProperty' ELSE 'relatedTo' END AS relation, count(*) AS n, round(avg(overall), 6) AS overall FROM ev GROUP BY 1",
    ),
    "Z30_process_ontology": (
        lambda s, d: (lambda v: v.concepts.agg(F.lit("concepts").alias("what"), F.count("*").alias("n")).union(v.normalized.agg(F.lit("tuples"), F.count("*"))))(D.process_ontology(V.view(s, d, V.TUPLES))),
        f"SELECT 'concepts' AS what, count(*) AS n FROM (SELECT source FROM {V.plain(V.TUPLES)} UNION SELECT target FROM {V.plain(V.TUPLES)}) UNION ALL SELECT 'tuples', count(*) FROM {V.plain(V.TUPLES)}",
    ),
    "C1_summary": (
        lambda s, d: R.summary(geo(s, d)),
        f"SELECT (SELECT count(*) FROM (SELECT s FROM {GEO} UNION SELECT o FROM {GEO})) AS classes, (SELECT count(DISTINCT p) FROM {GEO}) AS relations, (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM {GEO})) AS statements",
    ),
}


def split_edges():
    """A class of two members, split: both halves keep its edges, and the highest score of equal ones."""
    graph = O.ClassGraph([("up", "a", "r", 2.0), ("a", "c", "r", 3.0), ("a", "k", "r", 2.0)], {"a": ["a", "b"], "c": ["c"], "k": ["k"], "up": ["up"]})
    graph.split("a", {"b"}, "b")
    return graph.edges()
