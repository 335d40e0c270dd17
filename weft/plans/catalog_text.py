"""Queries on texts, conversations, runs and caches, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import tables as B
from weft.plans import refine as R
from weft.plans import views as V

TH = V.plain(V.THOUGHTS)


def documents(s, d):
    return V.table(s, d, "documents")


def conversations(s, d):
    return V.table(s, d, "conversations")


def events(s, d):
    return V.table(s, d, "events")


def thoughts(s, d):
    return V.view(s, d, V.THOUGHTS)


def cache(s, d):
    """Users as cache entries in tiers by event type: how often and when they were last used."""
    return events(s, d).groupBy(F.col("event_type").alias("tier"), F.col("user_id").alias("key")).agg(F.count("*").alias("frequency"), F.max("event_id").alias("last_used"), F.min("event_id").alias("ord")).withColumn("queue", F.when(F.col("frequency") < 12, "a1").otherwise("am"))


CACHE = "(SELECT event_type AS tier, user_id AS key, count(*) AS frequency, max(event_id) AS last_used, min(event_id) AS ord, CASE WHEN count(*) < 12 THEN 'a1' ELSE 'am' END AS queue FROM events GROUP BY ALL)"


def eviction(policy, order):
    return (
        lambda s, d: B.evicted(cache(s, d), 100, policy).select("tier", "key"),
        f"SELECT tier, key FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY {order}) AS n, count(*) OVER (PARTITION BY tier) AS size FROM {CACHE}) WHERE n <= size - 100",
    )


SAID = "VALUES (1, 'YES, they match.'), (2, '<Answer>no</Answer> yes'), (3, 'yesterday'), (4, 'YES or NO'), (5, '{\"answer\": \"yes\", \"confidence\": 0.7}'), (6, 'No.'), (7, '<Confidence>7.5</Confidence> YES')"
OPS = "VALUES ('x >= y'), ('a/b c'), ('50% & more'), (' (odd) '), ('a<-b->c'), ('p != q'), ('m@n+o')"
ASK = "VALUES ('What are the body systems?'), ('List the Body System'), ('which  glasses are there!'), ('How do arteries branch'), ('Tell me of the two-way valves ')"
PROSE = "VALUES (1, 'The heart (cor, cardiac pump) is also known as the ticker, or pump.', 'heart'), (2, 'Kidney aka ren; other names include nephros/ren.', 'kidney'), (3, 'Nothing here.', 'liver')"
PYCONTENT = "list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({q}, '[a-z0-9]+(?:-[a-z0-9]+)*'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in T.FRAME) + "], w)), lambda w: CASE WHEN length(w) > 5 AND ends_with(w, 'ies') THEN w[1:length(w) - 3] || 'y' WHEN length(w) > 4 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[1:length(w) - 1] ELSE w END)))"
QKEY = "trim(regexp_replace(trim(lower({0})), '\\s+', ' ', 'g'), ' ?.!')"
URI = "replace(" * 15 + "v" + "".join(f", '{a}', '{b}')" for a, b in T.URI_REPLACEMENTS)

QUERIES = {
    "F1_uri_component": (
        lambda s, d: s.sql(f"SELECT * FROM {OPS} AS t(v)").select("v", T.uri_component(F.col("v")).alias("uri")),
        f"SELECT v, trim(regexp_replace(regexp_replace({URI}, '[()\\[\\]{{}}?# !$,;:''\".]', '', 'g'), '_+', '_', 'g'), '_') AS uri FROM ({OPS}) AS t(v)",
    ),
    "F2_question_key": (
        lambda s, d: conversations(s, d).where("role = 'user'").select("conv_id", "turn", T.question_key(F.col("text")).alias("key")),
        f"SELECT conv_id, turn, {QKEY.format('text')} AS key FROM conversations WHERE role = 'user'",
    ),
    "F3_content_key": (
        lambda s, d: s.sql(f"SELECT * FROM {ASK} AS t(q)").select("q", F.array_join(T.content_key(F.col("q")), ",").alias("key")),
        f"SELECT q, array_to_string({PYCONTENT.format(q=QKEY.format('q'))}, ',') AS key FROM ({ASK}) AS t(q)",
    ),
    "F4_shingle_counts": (
        lambda s, d: documents(s, d).select("doc_id", F.size(T.shingles(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("n")),
        "SELECT doc_id, CAST(len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS INTEGER) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)",
    ),
    "F6_bounded_edit_distance": (
        lambda s, d: V.table(s, d, "part").select("p_partkey", T.bounded_distance(F.col("p_name"), F.concat("p_name", F.substring("p_brand", -1, 1))).alias("near"), T.bounded_distance(F.col("p_name"), F.col("p_type")).alias("far")),
        "SELECT p_partkey, CAST(1 AS INTEGER) AS near, CAST(CASE WHEN levenshtein(p_name, p_type) > 1 THEN 2 ELSE levenshtein(p_name, p_type) END AS INTEGER) AS far FROM part",
    ),
    "F12_synonyms": (
        lambda s, d: s.sql(f"SELECT * FROM {PROSE} AS t(id, text, term)").select("id", F.array_join(T.synonyms(F.col("text"), F.col("term")), "|").alias("names")),
        "SELECT * FROM (VALUES (1, 'the ticker|pump|cor|cardiac pump'), (2, 'ren|nephros'), (3, '')) AS t(id, names)",
    ),
    "F13_coerce_terms": (
        lambda s, d: s.sql("SELECT * FROM VALUES ('[\"a\", \" b \"]'), ('x| y,z;; w'), ('one\ntwo'), ('') AS t(v)").select("v", F.array_join(T.terms(F.col("v")), "+").alias("terms")),
        "SELECT * FROM (VALUES ('[\"a\", \" b \"]', 'a+b'), ('x| y,z;; w', 'x+y+z+w'), ('one' || chr(10) || 'two', 'one+two'), ('', '')) AS t(v, terms)",
    ),
    "F14_first_given": (
        lambda s, d: documents(s, d).select("doc_id", T.first_given(F.when(F.col("doc_id") % 3 == 0, " "), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("source")).alias("picked")),
        "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS picked FROM documents",
    ),
    "F19_yes_no": (
        lambda s, d: s.sql(f"SELECT * FROM {SAID} AS t(id, said)").select("id", T.yes_no(F.col("said")).alias("yes")),
        "SELECT * FROM (VALUES (1, true), (2, false), (3, NULL), (4, NULL), (5, true), (6, false), (7, true)) AS t(id, yes)",
    ),
    "F20_stated_confidence": (
        lambda s, d: s.sql(f"SELECT * FROM {SAID} AS t(id, said)").select("id", T.stated_confidence(F.col("said")).alias("confidence")),
        "SELECT id, CASE WHEN id = 7 THEN 7.5 ELSE -1.0 END AS confidence FROM (SELECT unnest(range(1, 8)) AS id)",
    ),
    "F21_clamp": (
        lambda s, d: events(s, d).select("event_id", T.clamp(F.col("value") / 100).alias("score")),
        "SELECT event_id, greatest(0, least(1, value / 100)) AS score FROM events",
    ),
    "F23_price": (
        lambda s, d: B.usage(V.table(s, d, "events").selectExpr("CASE event_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'local' END AS model", "user_id AS input_tokens", "CAST(value AS BIGINT) AS output_tokens"), s.sql("SELECT * FROM VALUES ('gpt-4o', 2.5D, 10.0D), ('gpt-4o-mini', 0.15D, 0.6D) AS t(model, input, output)")),
        "WITH c AS (SELECT CASE event_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'local' END AS model, user_id AS i, CAST(trunc(value) AS BIGINT) AS o FROM events), p AS (SELECT *, CASE model WHEN 'gpt-4o' THEN (i * 2.5 + o * 10) / 1e6 WHEN 'gpt-4o-mini' THEN (i * 0.15 + o * 0.6) / 1e6 END AS cost FROM c) SELECT count(*) AS calls, sum(i) AS input_tokens, sum(o) AS output_tokens, round(sum(cost), 6) AS cost, count(*) FILTER (cost IS NULL) AS unpriced, 'gpt-4o,gpt-4o-mini,local' AS models FROM p",
    ),
    "F24_byte_lengths": (lambda s, d: documents(s, d).select("doc_id", F.octet_length("text").alias("bytes"), F.length("text").alias("chars")), "SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS bytes, CAST(length(text) AS INTEGER) AS chars FROM documents"),
    "F28_match_score": (
        lambda s, d: V.table(s, d, "nation").select("n_name", T.match_score(F.col("n_name"), F.lit("an")).alias("score")),
        "SELECT n_name, CAST(CASE WHEN lower(n_name) = 'an' THEN 10 WHEN starts_with(lower(n_name), 'an') THEN 6 WHEN contains(lower(n_name), 'an') THEN 3 ELSE 0 END AS DOUBLE) AS score FROM nation",
    ),
    "F29_fingerprint": (
        lambda s, d: V.table(s, d, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", "n_name", "n_regionkey"), 256).alias("digest")),
        "SELECT n_nationkey, sha256(n_name || '|' || n_regionkey) AS digest FROM nation",
    ),
    "F32_prompts": (
        lambda s, d: V.table(s, d, "nation").select("n_nationkey", T.rendered("Is {name} in region {region}? {unknown}", {"name": F.col("n_name"), "region": F.col("n_regionkey")}).alias("prompt")),
        "SELECT n_nationkey, 'Is ' || n_name || ' in region ' || n_regionkey || '? {unknown}' AS prompt FROM nation",
    ),
    "F34_human_join": (
        lambda s, d: V.table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names")).select("n_regionkey", T.human_join(F.col("names")).alias("names")),
        "SELECT n_regionkey, array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] AS names FROM (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY 1)",
    ),
    "A16_duplicate_labels": (
        lambda s, d: B.duplicate_labels(V.table(s, d, "part").select(F.col("p_partkey").alias("subject"), F.concat_ws(" ", "p_name", "p_brand").alias("label"))),
        "SELECT p_name || ' ' || p_brand AS label, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    ),
    "A17_coverage": (
        lambda s, d: B.coverage(documents(s, d).select(F.col("doc_id").alias("id")), V.table(s, d, "labels").select(F.col("doc_id").alias("id"))),
        "SELECT round(100.0 * (SELECT count(*) FROM labels SEMI JOIN documents USING (doc_id)) / count(*), 1) AS coverage FROM documents",
    ),
    "A21_top_terms": (
        lambda s, d: B.top_terms(documents(s, d), 8, ["lang"], ["and"]),
        f"SELECT lang, term, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS r FROM (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z][a-z-]{{2,}}')) AS term FROM documents) WHERE term NOT IN ({', '.join(repr(w) for w in B.STOP_WORDS)}) GROUP BY ALL)) WHERE r <= 8",
    ),
    "A22_thought_statistics": (
        lambda s, d: thoughts(s, d).groupBy("role").agg(F.count("*").alias("n"), F.max("turn").alias("deepest"), F.round(F.avg("turn"), 6).alias("mean_depth")),
        f"SELECT role, count(*) AS n, max(turn) AS deepest, round(avg(turn), 6) AS mean_depth FROM {TH} GROUP BY role",
    ),
    "A23_content_lengths": (lambda s, d: conversations(s, d).agg(F.sum(F.length("text")).alias("chars"), F.round(F.avg(F.length("text")), 6).alias("mean")), "SELECT CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 6) AS mean FROM conversations"),
    "A24_conversation_patterns": (
        lambda s, d: B.patterns(conversations(s, d).select(F.col("conv_id").alias("conversation"), F.col("role").alias("kind"))).withColumns({"mean": F.round("mean", 6), "kinds": F.array_join("kinds", ",")}),
        "SELECT count(*) AS conversations, CAST(sum(n) AS BIGINT) AS turns, round(avg(n), 6) AS mean, max(n) AS longest, min(n) AS shortest, (SELECT string_agg(DISTINCT role, ',' ORDER BY role) FROM conversations) AS kinds FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)",
    ),
    "A26_majority": (
        lambda s, d: B.majority(V.table(s, d, "events").selectExpr("user_id AS id", "CASE WHEN value < 5 THEN NULL ELSE value > 30 END AS said")).select("id", "answer", F.round("agreement", 6).alias("agreement")),
        "SELECT user_id AS id, count(*) FILTER (value > 30) > count(*) FILTER (value <= 30) AS answer, round(greatest(count(*) FILTER (value > 30), count(*) FILTER (value <= 30)) / count(*), 6) AS agreement FROM events WHERE value >= 5 GROUP BY user_id",
    ),
    "A27_ensemble": (
        lambda s, d: B.ensemble(events(s, d).selectExpr("user_id AS id", "value / 60 AS score", "CAST(event_id % 4 + 1 AS DOUBLE) AS weight")).select("id", F.round("score", 6).alias("score")),
        "SELECT user_id AS id, round(sum(greatest(0, least(1, value / 60)) * (event_id % 4 + 1)) / sum(event_id % 4 + 1), 6) AS score FROM events GROUP BY 1",
    ),
    "A31_merge_rows": (
        lambda s, d: B.merged(events(s, d).selectExpr("user_id", "event_id", "CASE WHEN value > 40 THEN value END AS high", "CASE WHEN event_type = 'click' THEN event_id END AS click"), ["user_id"], "event_id"),
        "SELECT user_id, arg_min(value, event_id) FILTER (value > 40) AS high, min(event_id) FILTER (event_type = 'click') AS click FROM events GROUP BY user_id",
    ),
    "A33_answer_recall": (
        lambda s, d: B.recall(V.table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.explode(F.slice(F.split("text", " "), 1, 5)).alias("label"), F.lit("THE answer is a word of the kind that people say in an answer to questions").alias("answer"))).withColumn("recall", F.round("recall", 6)),
        "SELECT id, round(avg(CASE WHEN contains('the answer is a word of the kind that people say in an answer to questions', lower(l)) THEN 1.0 ELSE 0 END), 6) AS recall FROM (SELECT item_id AS id, unnest(string_split(text, ' ')[1:5]) AS l FROM benchmark) GROUP BY id",
    ),
    "W2_newest_runs": (
        lambda s, d: B.newest(events(s, d), 15, "ts", "event_id").select("event_id", "user_id"),
        "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 15",
    ),
    "W3_latest_per_run": (
        lambda s, d: B.first_per(events(s, d), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id"),
        "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    ),
    "W4_run_endpoints": (
        lambda s, d: B.run_endpoints(conversations(s, d).select("conv_id", F.col("turn").alias("id"), "turn", F.array(F.when(F.col("role") == "user", "user_query").when(F.col("role") == "assistant", "final_result").otherwise("")).alias("tags")), "conv_id", "turn"),
        "SELECT conv_id, coalesce(min(turn) FILTER (role = 'user'), min(turn)) AS start, coalesce(max(turn) FILTER (role = 'assistant'), max(turn)) AS \"end\" FROM conversations GROUP BY conv_id",
    ),
    "W5_compare_previous": (
        lambda s, d: B.compared_previous(events(s, d).select("user_id", F.col("event_id").alias("run_id"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("passed").alias("status"), F.col("event_type").alias("fingerprint")), ["user_id"]).select("run_id", "previous", "reproducible"),
        "WITH p AS (SELECT *, last_value(CASE WHEN event_id % 3 <> 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events) SELECT p.event_id AS run_id, previous, p.event_type = e.event_type AS reproducible FROM p JOIN events e ON e.event_id = previous",
    ),
    "W6_node_index": (
        lambda s, d: R.numbered(V.table(s, d, "customer"), "c_name"),
        "SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS i FROM (SELECT DISTINCT c_name FROM customer)",
    ),
    "W8_evict_lru": eviction("lru", "last_used, ord"),
    "X12_evict_lfu": eviction("lfu", "frequency, last_used, ord"),
    "X12_evict_2q": eviction("2q", "queue <> 'a1', CASE WHEN queue = 'a1' THEN ord END, last_used, ord"),
    "K7_keep_latest": (
        lambda s, d: B.first_per(events(s, d).select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.desc("event_id")]),
        "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
    ),
    "S9_load_run": (lambda s, d: B.load_run(conversations(s, d), 7, "conv_id").select("turn", "role"), "SELECT turn, role FROM conversations WHERE conv_id = 7"),
    "S11_latest_run_ids": (
        lambda s, d: B.latest_ids(events(s, d).withColumn("updated", F.when(F.col("event_id") % 2 == 0, F.col("event_id") + 5)), 20, ["updated", "event_id"], "user_id"),
        "SELECT user_id FROM events GROUP BY user_id ORDER BY max(CASE WHEN event_id % 2 = 0 THEN event_id + 5 ELSE event_id END) DESC, user_id DESC LIMIT 20",
    ),
    "T12_hot_answers": (lambda s, d: B.hottest(cache(s, d), 10).select("tier", "key", "frequency"), f"SELECT tier, key, frequency FROM {CACHE} ORDER BY frequency DESC, tier, key LIMIT 10"),
    "T13_sampled_questions": (
        lambda s, d: B.sampled_parents(V.table(s, d, "part").select(F.col("p_name").alias("parent"), F.col("p_brand").alias("child")), 5, 3, 30),
        "WITH q AS (SELECT p_name AS parent, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) BETWEEN 3 AND 30), r AS (SELECT *, row_number() OVER (ORDER BY parent) - 1 AS i, greatest(1, (SELECT count(*) FROM q) // 5) AS step FROM q) SELECT parent, n FROM r WHERE i % step = 0 ORDER BY i LIMIT 5",
    ),
    "X2_low_confidence": (
        lambda s, d: events(s, d).withColumn("confidence", F.when(F.col("event_id") % 10 != 0, F.least(F.col("value") / 49, F.lit(10.0)))).select("event_id", F.when(F.col("confidence") < 8.5, "LOW_CONFIDENCE").otherwise("accepted").alias("lane")),
        "SELECT event_id, CASE WHEN event_id % 10 <> 0 AND least(value / 49, 10) < 8.5 THEN 'LOW_CONFIDENCE' ELSE 'accepted' END AS lane FROM events",
    ),
}
