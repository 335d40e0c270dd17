"""Queries on node search, prompt context, decisions, names and answers, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import names as N
from weft.functions import parsing as J
from weft.functions import text as T
from weft.operators import answers as A
from weft.operators import graph as G
from weft.operators import lookup as L
from weft.operators import vectors as X
from weft.plans import refine as R
from weft.plans import views as V
from weft.plans.catalog_graph import GEO, GEO_EDGES, geo, geo_edges
from weft.sources import readers as S

PREFIXES = {"www": "https://www.", "ex": "https://example.com/"}
CALL = {"look": {"tool_name": "Look_Up", "aliases": ["find"], "tool_type": "MODULE", "arguments": {"max_results": 10, "exact": False}}}
SAYS = [
    (1, 'Sure: {"tool_name": "find", "arguments": {"max_results": "25", "exact": "Yes", "sources": ["a"]}} done'),
    (2, '```json\n{"tool_name": "other", /* note */ "arguments": {"q": "x {y}",},}\n```'),
    (3, "no object"),
    (4, '{"answer": "YES", "confidence": 7}'),
    (5, 'first {"answer": "maybe"} then {"answer": "no", "confidence": 0.5}'),
    (6, None),
]
MINE = "(SELECT event_id AS id, CASE WHEN event_id % 7 <> 0 THEN value / 50 END AS si, CASE WHEN event_id % 3 = 0 THEN 'Same question' ELSE 'Related' END AS cl, CASE WHEN event_id % 4 = 0 THEN value / 60 END AS co, CASE WHEN event_id % 5 = 0 THEN 'click' WHEN event_id % 5 = 1 THEN 'nothing' END AS ch, CASE WHEN event_id % 2 = 0 THEN event_type END AS ne, event_id % 13 = 0 AS fo, event_id % 17 = 0 AS one FROM events)"
NODES = ("pages", "documents", "conversations", "part", "events", "nation")


def table(name):
    return lambda s, d: V.table(s, d, name)


pages, documents, conversations, part, events, nation = map(table, NODES)


def said(s):
    return s.createDataFrame(SAYS, "id int, said string")


def readings(s, d):
    return events(s, d).selectExpr(
        "event_id AS id", "CASE WHEN event_id % 7 <> 0 THEN value / 50 END AS same_intent", "CASE WHEN event_id % 3 = 0 THEN 'Same question' ELSE 'Related' END AS closeness",
        "CASE WHEN event_id % 4 = 0 THEN value / 60 END AS continues", "CASE WHEN event_id % 5 = 0 THEN 'click' WHEN event_id % 5 = 1 THEN 'nothing' END AS choice", "CASE WHEN event_id % 2 = 0 THEN event_type END AS nearest",
        "CASE WHEN event_id % 17 = 0 THEN array('view') ELSE array('click', 'view', 'error') END AS cached", "event_id % 13 = 0 AS fail_open",
    )


def context(s, d):
    docs = documents(s, d).select(F.col("doc_id"), F.col("doc_id").cast("string").alias("id"), "lang", "n_chars")
    matches = docs.where("doc_id % 20 = 0").select("id", F.col("lang").alias("text"), F.col("n_chars").cast("double").alias("score"))
    near = docs.where("doc_id % 20 IN (0, 1, 2)").select((F.col("doc_id") - F.col("doc_id") % 20).cast("string").alias("match"), "id", F.col("lang").alias("text"))
    web = pages(s, d).select(F.concat(F.lit("web-"), "page_id").alias("id"), F.col("url").alias("text"))
    return L.context_candidates(matches, near, web)


CONTEXT = """WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, lang, CAST(n_chars AS DOUBLE) AS score FROM documents), m AS (SELECT * FROM d WHERE doc_id % 20 = 0),
c AS (SELECT id, lang AS text, 'concept' AS source, score, 0 AS a, -score AS b, id AS c, 0 AS e FROM m UNION ALL
SELECT d.id, d.lang, 'neighborhood', NULL, 0, -m.score, m.id, 1 FROM d JOIN m ON d.doc_id - d.doc_id % 20 = m.doc_id WHERE d.doc_id % 20 IN (0, 1, 2) UNION ALL
SELECT 'web-' || page_id, url, 'web', NULL, 1, 0.0, 'web-' || page_id, 0 FROM pages),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY a, b, c, e) AS r FROM c WHERE text <> '')
SELECT id, text, source, score FROM o WHERE r = 1 ORDER BY a, b, c, e, id LIMIT 256"""


def answer_matches(s, d):
    rows = A.indexed(documents(s, d), "doc_id")
    questions = rows.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "q")
    return A.matched(questions, rows.withColumnRenamed("doc_id", "a")).select("q", "a", F.round("score", 6).alias("score"))


def tags(s, d):
    return documents(s, d).select("doc_id", F.array("lang", "source").alias("tags"))


def items(s, d):
    """What two sources found of parts: one lacks summaries, and both name some of the same."""
    one = part(s, d).select(F.lit("neo4j").alias("source"), F.lit("neo4j").alias("kg"), F.lit("").alias("iri"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("summary"), F.col("p_partkey").alias("seq"))
    two = part(s, d).select(F.lit("dump").alias("source"), F.lit("parts").alias("kg"), F.concat(F.lit("urn:"), "p_type").alias("iri"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("id"), F.col("p_type").alias("name"), F.when(F.col("p_size") > 30, F.col("p_name")).alias("summary"), (F.col("p_partkey") + 10_000_000).alias("seq"))
    return L.entity_search([one, two], "st", 12).select("source", "name", "summary", "score")


ITEMS = """WITH i AS (SELECT 'neo4j' AS source, p_name AS name, lower(p_name) AS k, NULL AS summary, p_partkey AS seq, 1.0 AS more FROM part UNION ALL SELECT 'dump', p_type, 'urn:' || lower(p_type), CASE WHEN p_size > 30 THEN p_name END, p_partkey + 10000000, 0.5 FROM part),
g AS (SELECT source, k, min(seq) AS seq, arg_min(name, seq) AS name, arg_min(summary, seq) FILTER (summary IS NOT NULL) AS summary, max(more) AS more FROM i GROUP BY source, k)
SELECT source, name, summary, CAST(more + CASE WHEN lower(name) = 'st' THEN 10 WHEN starts_with(lower(name), 'st') THEN 6 WHEN contains(lower(name), 'st') THEN 3 ELSE 0 END AS DOUBLE) AS score FROM g ORDER BY score DESC, seq LIMIT 12"""
RUNS = "list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
LINES = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"

QUERIES = {
    "S13_node_search": (
        lambda s, d: L.node_search(part(s, d), "O-l", ["p_name", "p_type"], 25, "p_partkey").select("p_partkey"),
        "SELECT p_partkey FROM part WHERE contains(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 'ol') OR contains(regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g'), 'ol') ORDER BY 1 LIMIT 25",
    ),
    "S14_pool_search": (
        lambda s, d: L.pool_search(part(s, d), "e", ["p_name"], 3, "p_brand", key="p_partkey").select("p_brand", "p_partkey"),
        "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part WHERE contains(lower(p_name), 'e')) WHERE r <= 3",
    ),
    "S15_one_hop": (
        lambda s, d: L.incident(geo_edges(s, d), "n3", 30),
        f"SELECT * FROM ({GEO_EDGES}) WHERE src = 'n3' OR tgt = 'n3' ORDER BY src, tgt LIMIT 30",
    ),
    "G27_incident_edges": (
        lambda s, d: L.incident_of(geo_edges(s, d), nation(s, d).select(F.concat(F.lit("n"), "n_nationkey").alias("id"))),
        f"WITH e AS ({GEO_EDGES}) SELECT src AS id, 'out' AS direction, src, tgt FROM e WHERE src LIKE 'n%' UNION ALL SELECT tgt, 'in', src, tgt FROM e WHERE tgt LIKE 'n%'",
    ),
    "S16_random_nodes": (lambda s, d: L.sampled(part(s, d), 10, key="p_partkey").select("p_partkey"), None),
    "S19_schema_counts": (
        lambda s, d: L.schema_counts(pages(s, d).select(F.col("url").alias("s"), F.lit("rdf:type").alias("p"), F.when(F.col("page_id") % 3 == 0, "owl:Class").otherwise("owl:ObjectProperty").alias("o")), ["owl:Class"], "https://"),
        "SELECT 'owl:Class' AS kind, count(DISTINCT url) AS n FROM pages WHERE page_id % 3 = 0 AND starts_with(url, 'https://') HAVING count(*) > 0",
    ),
    "S20_term_projection": (
        lambda s, d: L.term_records(events(s, d).withColumn("k", L.from_properties(F.from_json("props", "map<string,string>"), ["none", "k"])), {"id": ["event_id"], "label": ["k", "event_type"], "kind": ["event_type"]}),
        "SELECT CAST(event_id AS VARCHAR) AS id, coalesce(props->>'k', event_type) AS label, event_type AS kind FROM events",
    ),
    "S27_corpus_hits": (
        lambda s, d: L.hits(documents(s, d), part(s, d).select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).union(s.sql("SELECT * FROM VALUES ('that'), ('Public License'), ('under the'), ('no such run')")).distinct()),
        "WITH t AS (SELECT unnest(string_split(lower(p_name), ' ')) AS term FROM part UNION SELECT * FROM (VALUES ('that'), ('Public License'), ('under the'), ('no such run'))), d AS (SELECT ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS x FROM documents) SELECT term, (SELECT count(*) FROM d WHERE contains(x, ' ' || lower(term) || ' ')) AS n FROM t",
    ),
    "P18_prefix_filter": (
        lambda s, d: pages(s, d).select("page_id", F.array("url", F.concat(F.lit("https://"), F.regexp_extract("url", "://([^/]*)", 1))).alias("m")).select("page_id", L.has_prefix(F.col("m"), ["https://www", "https://n"]).alias("some"), L.has_prefix(F.col("m"), ["https://www", "https://n"], exclusive=True).alias("every")),
        "WITH m AS (SELECT page_id, regexp_matches(url, '^https://(www|n)') AS a, regexp_matches('https://' || regexp_extract(url, '://([^/]*)', 1), '^https://(www|n)') AS b FROM pages) SELECT page_id, a OR b AS some, a AND b AS every FROM m",
    ),
    "P19_tags": (
        lambda s, d: L.tagged(tags(s, d), ["fr", "src3"]).select("doc_id", F.lit("any").alias("mode")).union(L.tagged(tags(s, d), ["fr", "src3"], every=True).select("doc_id", F.lit("every"))),
        "SELECT doc_id, 'any' AS mode FROM documents WHERE lang = 'fr' OR source = 'src3' UNION ALL SELECT doc_id, 'every' FROM documents WHERE lang = 'fr' AND source = 'src3'",
    ),
    "P20_search_thoughts": (
        lambda s, d: L.search_thoughts(conversations(s, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("text").alias("content"), F.array(F.lit("turn"), F.col("role")).alias("tags")), "US", 100, ("content",)).select("id", "kind", F.md5(F.col("match").cast("binary")).alias("match")),
        "WITH h AS (SELECT conv_id * 1000 + turn AS seq, conv_id || '_' || turn AS id, 0 AS place, 'content_content' AS kind, text AS m FROM conversations WHERE contains(lower(text), 'us') UNION ALL SELECT conv_id * 1000 + turn, conv_id || '_' || turn, 1, 'tag', role FROM conversations WHERE contains(lower(role), 'us')) SELECT id, kind, md5(m) AS match FROM h ORDER BY seq, id, place LIMIT 100",
    ),
    "P22_ordered_lookup": (
        lambda s, d: L.in_order(s, [17, 3, 999999999, 8], documents(s, d).select("doc_id", "lang"), "doc_id"),
        "SELECT pos, doc_id, lang FROM (VALUES (0, 17), (1, 3), (3, 8)) AS t(pos, doc_id) JOIN documents USING (doc_id)",
    ),
    "P23_context_candidates": (context, CONTEXT),
    "P24_context_selection": (
        lambda s, d: L.selected(events(s, d).select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("value") / 100).alias("relevance")), 0.2, shadow=False),
        "SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN value / 100 END AS relevance, event_id % 11 = 0 OR value / 100 >= 0.2 AS selected, event_id % 11 = 0 OR value / 100 >= 0.2 AS returned FROM events",
    ),
    "P25_selection_metrics": (
        lambda s, d: L.selection_metrics(L.selected(events(s, d).withColumn("relevance", F.col("value") / 100)), "event_type").withColumn("rejection_rate", F.round("rejection_rate", 6)),
        "SELECT event_type, count(*) AS candidate_count, count(*) FILTER (value / 100 >= 0.2) AS selected_count, count(*) AS returned_count, round(count(*) FILTER (value / 100 < 0.2) / count(*), 6) AS rejection_rate FROM events GROUP BY 1",
    ),
    "P26_route": (
        lambda s, d: L.routed(readings(s, d)),
        f"WITH r AS (SELECT *, CASE WHEN one THEN ['view'] ELSE ['click', 'view', 'error'] END AS cached FROM {MINE}), q AS (SELECT id, coalesce(co, 0) >= 0.8 AS continues, CASE WHEN fo THEN NULL WHEN ch IS NOT NULL AND list_contains(cached, ch) THEN ch WHEN coalesce(si, 0) >= 0.8 AND cl = 'Same question' THEN CASE WHEN ne IS NOT NULL AND list_contains(cached, ne) THEN ne WHEN len(cached) = 1 THEN cached[1] END END AS question FROM r) SELECT id, CASE WHEN question IS NULL THEN 'retrieve' ELSE 'replay' END AS route, question, continues FROM q",
    ),
    "P27_tool_gate": (
        lambda s, d: L.gated(events(s, d).select("event_id", F.col("event_type").alias("tool_name"), F.when(F.col("event_id") % 11 != 0, F.col("value") / 100).alias("risk")), ["click", "purchase"]).drop("risk"),
        "SELECT event_id, event_type AS tool_name, event_type IN ('click', 'purchase') AS gated, event_type IN ('click', 'purchase') AND (event_id % 11 = 0 OR value / 100 >= 0.5) AS blocked FROM events",
    ),
    "P27_best_route": (
        lambda s, d: L.best_route(events(s, d).select(F.col("user_id").alias("id"), F.col("event_type").alias("route"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("score")), "ask"),
        "SELECT user_id AS id, coalesce(arg_max(event_type, (value, event_type)) FILTER (event_id % 3 <> 0), 'ask') AS route FROM events GROUP BY 1",
    ),
    "P28_redact": (
        lambda s, d: documents(s, d).select("doc_id", F.md5(T.redacted(F.concat(F.lit("Bearer abc.def sk-ABCDEFGHIJKLMNOP1 "), "text")).cast("binary")).alias("digest")),
        "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace('Bearer abc.def sk-ABCDEFGHIJKLMNOP1 ' || text, '(?i)\\bBearer\\s+\\S+', 'Bearer ******', 'g'), '(?i)\\bsk-[A-Za-z0-9]{16,}\\b', 'sk-******', 'g'), '(?i)\\bghp_[A-Za-z0-9]{20,}\\b', 'ghp_******', 'g')) AS digest FROM documents",
    ),
    "P28_redact_map": (
        lambda s, d: nation(s, d).select("n_nationkey", F.to_json(T.redacted_map(F.create_map(F.lit("Token"), "n_name", F.lit("note"), F.concat(F.lit("bearer "), "n_name")))).alias("json")),
        "SELECT n_nationkey, '{\"Token\":\"******\",\"note\":\"Bearer ******' || CASE WHEN contains(n_name, ' ') THEN regexp_replace(n_name, '^\\S+', '') ELSE '' END || '\"}' AS json FROM nation",
    ),
    "P29_display_names": (
        lambda s, d: pages(s, d).select("page_id", N.display_name(F.when(F.col("page_id") % 3 == 0, F.array(F.concat(F.lit(" Page "), "page_id"))), F.col("url"), F.lit(None).cast("string"), F.col("page_id").cast("string")).alias("name"), N.namespace_of(F.col("url")).alias("namespace")),
        "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Page ' || page_id ELSE coalesce(nullif(regexp_replace(regexp_replace(url, '^.*#', ''), '^.*/', ''), ''), CAST(page_id AS VARCHAR)) END AS name, CASE WHEN contains(url, '#') THEN regexp_extract(url, '^(.*#)', 1) ELSE regexp_extract(url, '^(.*/)', 1) END AS namespace FROM pages",
    ),
    "P30_drop_echo": (
        lambda s, d: conversations(s, d).select("conv_id", "turn", T.presentable(F.concat(F.lit("The heart. Relevant concepts: x! From cluster two. Cluster 4 says so? "), F.col("text"))).alias("kept")),
        "WITH t AS (SELECT conv_id, turn, 'The heart. Relevant concepts: x! From cluster two. Cluster 4 says so? ' || text AS x FROM conversations) SELECT conv_id, turn, CASE WHEN contains(lower(x), 'tool_name') OR contains(lower(x), 'i will use the tools') THEN '' ELSE array_to_string(list_filter(list_transform(string_split(x, chr(10) || chr(10)), lambda p: array_to_string(list_filter(list_transform(regexp_split_to_array(p, '\\r\\n|\\n|\\r'), lambda l: array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(l, ' ' || chr(9)), '(\\d[.!?])(\\s)', '\\1' || chr(2) || '\\2', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda q: replace(q, chr(2), '')), lambda q: q <> '' AND NOT regexp_matches(lower(q), 'relevant concept clusters|key relations|concept clusters|from cluster|\\(cluster|most relevant concepts|relevant concepts') AND NOT (contains(lower(q), 'cluster') AND regexp_matches(q, '\\d'))), ' ')), lambda l: l <> ''), chr(10))), lambda p: p <> ''), chr(10) || chr(10)) END AS kept FROM t",
    ),
    "P31_member_names": (
        lambda s, d: part(s, d).groupBy("p_type").agg(F.array_sort(F.collect_set(F.struct(F.concat(F.lit("urn:x/"), "p_name").alias("name"), F.when(F.col("p_size") == 1, F.array("p_brand")).alias("labels"), F.when(F.col("p_size") == 2, F.array("p_type")).alias("alt_labels")))).alias("m")).select("p_type", N.member_names(F.col("m")).alias("names"), N.member_names(F.col("m"), labels=True).alias("labels")),
        "WITH m AS (SELECT DISTINCT p_type, p_name, CASE WHEN p_size = 1 THEN p_brand END AS l, CASE WHEN p_size = 2 THEN p_type END AS a FROM part) SELECT p_type, string_agg('urn:x/' || p_name, ', ' ORDER BY p_name, l NULLS FIRST, a NULLS FIRST) AS names, string_agg(coalesce(l, a, p_name), ', ' ORDER BY p_name, l NULLS FIRST, a NULLS FIRST) AS labels FROM m GROUP BY p_type",
    ),
    "F27_compact_names": (
        lambda s, d: pages(s, d).select("page_id", N.compacted(F.regexp_replace("url", "[?#].*$", ""), PREFIXES).alias("short")).select("page_id", "short", N.expanded(F.col("short"), PREFIXES).alias("full")),
        "WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages), s AS (SELECT page_id, u, CASE WHEN regexp_matches(u, '^https://example\\.com/[^/#:]+$') THEN 'ex:' || u[21:] WHEN regexp_matches(u, '^https://www\\.[^/#:]+$') THEN 'www:' || u[13:] ELSE '<' || u || '>' END AS short FROM u) SELECT page_id, short, u AS \"full\" FROM s",
    ),
    "F10_uuid_slug": (
        lambda s, d: part(s, d).select("p_partkey", N.uuid_name(F.md5(F.col("p_partkey").cast("string").cast("binary")), "slug").alias("slug")),
        "SELECT p_partkey, rtrim(translate(base64(unhex(md5(CAST(p_partkey AS VARCHAR)))), '+/', '-_'), '=') AS slug FROM part",
    ),
    "F10_uuid_names": (
        lambda s, d: s.sql("SELECT * FROM VALUES ('00000000-0000-0000-0000-000000000000'), ('ffffffff-ffff-ffff-ffff-ffffffffffff'), ('no uuid') AS t(u)").select("u", N.uuid_name(F.col("u"), "slug62").alias("s62"), N.uuid_name(F.col("u"), "slug32").alias("s32")),
        "SELECT * FROM (VALUES ('00000000-0000-0000-0000-000000000000', repeat('0', 22), repeat('A', 26)), ('ffffffff-ffff-ffff-ffff-ffffffffffff', '7n42DGM5Tflk9n8mt7Fhc7', repeat('7', 25) || '4'), ('no uuid', NULL, NULL)) AS t(u, s62, s32)",
    ),
    "F15_slug": (
        lambda s, d: pages(s, d).select("page_id", T.slug(F.concat(F.lit(" Café Zürich: "), "url")).alias("slug")),
        "SELECT page_id, trim(regexp_replace(regexp_replace(('Cafe Zurich: ' || url)[1:50], '[^a-zA-Z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '._') AS slug FROM pages",
    ),
    "F16_preview": (
        lambda s, d: documents(s, d).select("doc_id", T.preview(F.col("text"), 60).alias("preview")),
        "SELECT doc_id, CASE WHEN length(t) > 60 THEN t[1:60] || '…' ELSE t END AS preview FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g'), '^\\s+', ''), '\\s+$', '') AS t FROM documents)",
    ),
    "F17_tool_json": (
        lambda s, d: said(s).select("id", J.tool_json(F.col("said")).alias("json")),
        """SELECT * FROM (VALUES (1, '{"arguments": {"exact": "Yes", "max_results": "25", "sources": ["a"]}, "tool_name": "find"}'), (2, '{"arguments": {"q": "x {y}"}, "tool_name": "other"}'), (3, NULL), (4, '{"answer": "YES", "confidence": 7}'), (5, '{"answer": "maybe"}'), (6, NULL)) AS t(id, json)""",
    ),
    "F18_equivalence_answer": (
        lambda s, d: said(s).select("id", J.equivalence_answer(F.col("said")).alias("a")).select("id", "a.yes", "a.confidence"),
        "SELECT * FROM (VALUES (1, NULL, NULL), (2, NULL, NULL), (3, NULL, NULL), (4, true, 7.0::DOUBLE), (5, false, 0.5), (6, NULL, NULL)) AS t(id, yes, confidence)",
    ),
    "Z43_coerced_calls": (
        lambda s, d: said(s).where("id < 4").select("id", J.coerced_calls(F.col("said"), CALL).alias("call")),
        """SELECT * FROM (VALUES (1, '{"arguments": {"exact": true, "max_results": 25, "ontologies": ["a"]}, "tool_name": "find", "tool_type": "module"}'), (2, '{"arguments": {"q": "x {y}"}, "tool_name": "other", "tool_type": "module"}'), (3, NULL)) AS t(id, call)""",
    ),
    "A34_flat_metrics": (
        lambda s, d: events(s, d).select("event_id", F.explode(J.metrics_of(F.concat(F.lit('{"a": {"kind": "x", "list": [1], "in": '), "props", F.lit(', "none": null}}')))).alias("name", "value")),
        "SELECT event_id, 'a.kind' AS name, 'x' AS value FROM events UNION ALL SELECT event_id, 'a.in.' || k, props->>k FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    ),
    "N3_search_terms": (
        lambda s, d: part(s, d).select("p_partkey", N.search_term(F.concat_ws("/", "p_brand", F.translate("p_name", " ", "_"))).alias("term")),
        "SELECT p_partkey, p_name AS term FROM part",
    ),
    "N4_representative_terms": (
        lambda s, d: pages(s, d).select("page_id", N.representative(F.array("url", F.concat(F.lit("PAGE_"), "page_id"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" my page "), "page_id")), F.lit("")), F.lit("none")).alias("term")),
        "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'my page ' || page_id WHEN length(url) < length('PAGE_' || page_id) THEN url ELSE 'PAGE_' || page_id END AS term FROM pages",
    ),
    "A32_merge_rank": (items, ITEMS),
    "A31_merged_terms": (
        lambda s, d: L.merged_terms(part(s, d).select(F.when(F.col("p_size") > 25, F.concat(F.lit("urn:"), "p_name")).otherwise("").alias("iri"), F.lit("p").alias("prefix"), F.col("p_brand").alias("short_form"), F.col("p_type").alias("label"), F.col("p_partkey").alias("seq"))).select("iri", "short_form", "label", "seq"),
        "SELECT iri, short_form, label, seq FROM (SELECT CASE WHEN p_size > 25 THEN 'urn:' || p_name ELSE '' END AS iri, p_brand AS short_form, p_type AS label, p_partkey AS seq, row_number() OVER (PARTITION BY CASE WHEN p_size > 25 THEN p_name ELSE p_brand || chr(1) || p_type END ORDER BY p_partkey) AS r FROM part) WHERE r = 1",
    ),
    "F5_signature_overlap": (
        lambda s, d: A.indexed(documents(s, d), "doc_id").select("doc_id", F.col("shingles").alias("q"), T.shingles(F.slice("words", F.lit(11), F.size("words"))).alias("a")).select("doc_id", F.round(T.overlap(F.col("q"), F.col("a")), 6).alias("overlap")),
        f"WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(trim(regexp_replace(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s+', ' ', 'g'), ' ?.!'), '{T.WORD}'), lambda x: NOT list_contains([{', '.join(repr(x) for x in T.STOP)}], x)) AS w FROM documents), s AS (SELECT doc_id, {RUNS} AS q, {RUNS.replace('w[i', 'w[10 + i').replace('len(w) - 1', 'len(w) - 11')} AS a FROM w) SELECT doc_id, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, a)) / len(q) END, 6) AS overlap FROM s",
    ),
    "F7_correct_one": (
        lambda s, d: s.sql("SELECT * FROM VALUES (1, 'heart and kidny', 'heart and kidney'), (2, 'heart and lunk', 'heart and lung'), (3, 'hearts and kidny', 'heart and kidney'), (4, 'spleen cells', 'spleens spleel cells'), (5, 'liver', 'liver') AS t(id, q, a)").select("id", F.array_join(T.corrected(F.split("q", " "), F.split("a", " ")), " ").alias("fixed")),
        "SELECT * FROM (VALUES (1, 'heart and kidney'), (2, NULL), (3, NULL), (4, NULL), (5, NULL)) AS t(id, fixed)",
    ),
    "F8_answer_match": (answer_matches, None),
    "F9_render_pattern": (
        lambda s, d: geo(s, d).where("p = 'broader'").groupBy("o").agg(F.array_sort(F.collect_set("s")).alias("nations"), F.array_sort(F.collect_set(F.struct(F.col("s").alias("src"), F.lit("urn:sub").alias("pred"), F.col("o").alias("tgt")))).alias("edges")).select("o", T.rendered_pattern(F.concat(F.array("o"), F.col("nations")), F.col("edges"), "urn:c:").alias("pattern")),
        f"WITH n AS (SELECT DISTINCT s, o FROM {GEO} WHERE p = 'broader'), r AS (SELECT o, s, row_number() OVER (PARTITION BY o ORDER BY s) AS i FROM n) SELECT o, '?c0 a <urn:c:' || o || '> .' || chr(10) || string_agg('?c' || i || ' a <urn:c:' || s || '> .', chr(10) ORDER BY i) || chr(10) || string_agg('?c' || i || ' <urn:sub> ?c0 .', chr(10) ORDER BY i) AS pattern FROM r GROUP BY o",
    ),
    "F11_first_sentence": (
        lambda s, d: documents(s, d).select("doc_id", T.first_sentence(F.col("text"), 80).alias("sentence")),
        "SELECT doc_id, coalesce(nullif(regexp_extract(trim(text, ' '), '(?s)^(.*?[.!?])\\s', 1), ''), trim(text, ' '))[1:80] AS sentence FROM documents",
    ),
    "F33_variables": (
        lambda s, d: s.range(1).select(F.array_join(F.array(*map(F.lit, T.variables("{b} and {{ a }} or { b }, not {9}"))), ",").alias("names")),
        "SELECT 'a,b' AS names",
    ),
    "Z52_default_prefixes": (
        lambda s, d: s.sql("SELECT * FROM VALUES ('rdfs:label'), ('<http://www.w3.org/2002/07/owl#Class>'), ('_:b'), ('nope:x'), ('http://purl.obolibrary.org/obo/GO_1') AS t(n)").select("n", N.expanded(F.col("n")).alias("full")).select("n", "full", N.compacted(F.col("full")).alias("short")),
        "SELECT * FROM (VALUES ('rdfs:label', 'http://www.w3.org/2000/01/rdf-schema#label', 'rdfs:label'), ('<http://www.w3.org/2002/07/owl#Class>', 'http://www.w3.org/2002/07/owl#Class', 'owl:Class'), ('_:b', '_:b', '_:b'), ('nope:x', 'nope:x', '<nope:x>'), ('http://purl.obolibrary.org/obo/GO_1', 'http://purl.obolibrary.org/obo/GO_1', 'obo:GO_1')) AS t(n, \"full\", short)",
    ),
    "C1_search": (
        lambda s, d: X.fused_search(V.table(s, d, "embeddings").where("label IN (3, 4)").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), V.table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10, "mean").select("id", F.round("score", 6).alias("score")),
        "WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT id, label, v, sqrt(list_dot_product(v, v)) + 1e-9 AS n FROM e), c AS (SELECT x.id, avg(list_dot_product(x.v, q.v) / (x.n * q.n)) AS score FROM n x, n q WHERE q.id % 20 = 0 AND x.label IN (3, 4) GROUP BY x.id) SELECT id, round(score, 6) AS score FROM c ORDER BY c.score DESC, id LIMIT 10",
    ),
    "J9_path_edges": (
        lambda s, d: G.path_edges(geo(s, d).select(F.col("s").alias("src"), F.col("o").alias("tgt"), F.when(F.col("p") == "is_a", 1.0).otherwise(2.0).alias("score")), geo(s, d).where("o IN ('n1', 'n2', 'r1')").select(F.col("s").alias("id")).union(s.sql("SELECT * FROM VALUES ('n1'), ('n2'), ('r1')")), 50),
        f"WITH k AS (SELECT s AS id FROM {GEO} WHERE o IN ('n1', 'n2', 'r1') UNION SELECT * FROM (VALUES ('n1'), ('n2'), ('r1'))) SELECT DISTINCT s AS src, CASE WHEN p = 'is_a' THEN 'related' ELSE 'subClassOf' END AS predicate, o AS tgt FROM {GEO} WHERE s IN (SELECT id FROM k) AND o IN (SELECT id FROM k) ORDER BY 1, 3, 2 LIMIT 50",
    ),
    "P1_extract_triples": (
        lambda s, d: R.extract(geo(s, d).select("s", "p", "o", F.when(F.col("p") == "is_a", "literal").when(F.col("s").like("s%"), "bnode").otherwise("iri").alias("kind")), literals=False, blank=False),
        f"SELECT s, p, o FROM {GEO} WHERE p <> 'is_a' AND NOT s LIKE 's%'",
    ),
    "S7_config_formats": (
        lambda s, d: s.createDataFrame([(p, S.format_of(p), S.select_config([{"pattern": "*.owl", "namespaces": {"a": "1"}}, {"pattern": "*", "namespaces": {"a": "2"}}], p, common={"b": "3"})["namespaces"]["a"]) for p in ("x.ttl", "y.owl.gz", "z.trig", "w.jsonld")], "path string, form string, a string"),
        "SELECT * FROM (VALUES ('x.ttl', 'turtle', '2'), ('y.owl.gz', 'xml', '2'), ('z.trig', 'trig', '2'), ('w.jsonld', 'json-ld', '2')) AS t(path, form, a)",
    ),
}
