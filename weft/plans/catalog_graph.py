"""Queries on triples and graphs, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import registry as Y
from weft.functions import predicates as P
from weft.functions import tuples as T
from weft.operators import graph as G
from weft.operators import tables as B
from weft.plans import refine as R
from weft.plans import views as V

GEO, ORDER, SAME = V.plain(V.TRIPLES_GEO), V.plain(V.TRIPLES_ORDER), V.plain(V.SAME_PART)
SUPPLY, INCIDENCE, TUPLES = V.plain(V.SUPPLY), V.plain(V.INCIDENCE), V.plain(V.TUPLES)

CANON = "regexp_replace(regexp_replace(lower(regexp_replace(trim(coalesce({0}, '')), '^[<>]+|[<>]+$', '', 'g')), '^.*[#/]', ''), '^[^:]*:', '')"
GEO_EDGES = f"SELECT DISTINCT s AS src, o AS tgt FROM {GEO}"
CLOSED = f"edge AS ({GEO_EDGES}), tc(src, tgt) AS (SELECT src, tgt FROM edge UNION SELECT tc.src, edge.tgt FROM tc JOIN edge ON tc.tgt = edge.src)"
RANKED = f"edge AS ({GEO_EDGES}), down(id, d) AS (SELECT tgt, 0 FROM edge WHERE tgt NOT IN (SELECT src FROM edge) UNION SELECT edge.src, d + 1 FROM down JOIN edge ON edge.tgt = down.id), rk AS (SELECT id, CAST(max(d) AS INTEGER) AS rank FROM down GROUP BY id)"
SAME_LABEL = f"link AS (SELECT s AS a, o AS b FROM {SAME} UNION SELECT o, s FROM {SAME}), walk(id, root) AS (SELECT a, a FROM link UNION SELECT walk.id, link.b FROM walk JOIN link ON walk.root = link.a), comp AS (SELECT id, min(root) AS component FROM walk GROUP BY id)"


def geo(spark, d):
    return V.view(spark, d, V.TRIPLES_GEO)


def geo_edges(spark, d):
    return geo(spark, d).select(F.col("s").alias("src"), F.col("o").alias("tgt")).distinct()


def same_edges(spark, d):
    return V.view(spark, d, V.SAME_PART).select(F.col("s").alias("src"), F.col("o").alias("tgt"))


def supply_classes(spark, d):
    parts = V.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("T_"), "p_type").alias("component"))
    sup = V.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("N_"), "s_nationkey").alias("component"))
    return parts.union(sup)


CLASSES = "(SELECT concat('p', p_partkey) AS id, concat('T_', p_type) AS component FROM part UNION ALL SELECT concat('s', s_suppkey), concat('N_', s_nationkey) FROM supplier)"
NAMES = "('<http://x.org/onto#SubClassOf>'), ('rdfs:subClassOf'), ('http://x.org/a/b#c/d'), ('obo:part_of'), ('disallows'), ('IS-A'), (' owl:sameAs '), ('skos:broader'), ('plain'), (''), ('skos:exactMatch'), (NULL)"


def names(spark):
    return spark.sql(f"SELECT * FROM VALUES {NAMES} AS t(p)")


def sample_seeds(spark, d):
    return V.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id")).where("id IN ('n1', 'n2')")


QUERIES = {
    "P3_canonical_predicate": (
        lambda s, d: names(s).select("p", P.canonical(F.col("p")).alias("name")),
        f"SELECT p, {CANON.format('p')} AS name FROM (VALUES {NAMES}) AS t(p)",
    ),
    "P4_hierarchy_predicate": (
        lambda s, d: names(s).select("p", P.is_hierarchy(F.col("p")).alias("hierarchy"), P.is_equivalence(F.col("p")).alias("equivalence")),
        f"SELECT p, regexp_matches({CANON.format('p')}, 'subclassof|broader|isa|is-a') OR {CANON.format('p')} = 'is_a' AS hierarchy, {CANON.format('p')} IN ('equivalentclass', 'sameas', 'exactmatch', 'equivalentto') AS equivalence FROM (VALUES {NAMES}) AS t(p)",
    ),
    "P6_local_part": (
        lambda s, d: V.table(s, d, "pages").select("page_id", P.local_part(F.col("url")).alias("local")),
        "SELECT page_id, regexp_extract(url, '([^#/]*)$', 1) AS local FROM pages",
    ),
    "P9_normalize_triples": (
        lambda s, d: P.normalized(V.view(s, d, V.TRIPLES_ORDER)).select("s", "p", "o"),
        f"SELECT CASE WHEN p = 'has_part' THEN o ELSE s END AS s, 'part_of' AS p, CASE WHEN p = 'has_part' THEN s ELSE o END AS o FROM {ORDER}",
    ),
    "P10_passive_flip": (
        lambda s, d: P.normalized(V.table(s, d, "nation").selectExpr("n_name AS s", "CASE WHEN n_nationkey % 2 = 0 THEN 'was_led_by' ELSE 'leads' END AS p", "concat('r', n_regionkey) AS o")).select("s", "p", "o"),
        "SELECT CASE WHEN n_nationkey % 2 = 0 THEN concat('r', n_regionkey) ELSE n_name END AS s, CASE WHEN n_nationkey % 2 = 0 THEN 'was_led_by' ELSE 'leads' END AS p, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE concat('r', n_regionkey) END AS o FROM nation",
    ),
    "P11_domain_range": (
        lambda s, d: R.domain_valid(V.view(s, d, V.TRIPLES_ORDER), V.table(s, d, "orders").selectExpr("concat('o', o_orderkey) AS id", "array(o_orderstatus) AS types"), {"obo:part_of": (frozenset({"F", "O"}), frozenset()), "has_part": (frozenset({"P"}), frozenset())}).select("s", "p", "o"),
        f"SELECT s, p, o FROM {ORDER} t LEFT JOIN (SELECT concat('o', o_orderkey) AS id, o_orderstatus AS st FROM orders) x ON x.id = t.s WHERE st IS NULL OR (p = 'obo:part_of' AND st IN ('F', 'O')) OR (p = 'has_part' AND st = 'P')",
    ),
    "P12_fact_check": (
        lambda s, d: R.fact_checked(geo(s, d).select("s", "p", "o").distinct(), V.table(s, d, "customer").selectExpr("concat('c', c_custkey) AS s", "'is_a' AS p", "concat('n', c_nationkey) AS o", "CASE WHEN c_acctbal < 0 THEN false WHEN c_acctbal < 1000 THEN NULL ELSE true END AS verdict")),
        f"SELECT DISTINCT s, p, o FROM {GEO} EXCEPT SELECT concat('c', c_custkey), 'is_a', concat('n', c_nationkey) FROM customer WHERE c_acctbal < 0",
    ),
    "P13_normalize_tuples": (
        lambda s, d: T.normalized(V.view(s, d, V.TUPLES)),
        f"SELECT p_partkey, list_aggregate(list_transform(string_split(source, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS source, CASE relation WHEN 'is_a' THEN 'isA' WHEN 'same_as' THEN 'sameAs' WHEN 'has_property' THEN 'hasProperty' ELSE relation END AS relation, list_aggregate(list_transform(regexp_split_to_array(trim(replace(target, '_', ' ')), ' +'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS target FROM {TUPLES}",
    ),
    "P16_semantic_similarity": (
        lambda s, d: V.view(s, d, V.TUPLES).select("p_partkey", F.round(T.semantic_similarity(F.col("source"), F.translate("target", "_", " ")), 6).alias("score")),
        f"WITH t AS (SELECT p_partkey, lower(source) AS a, lower(replace(target, '_', ' ')) AS b FROM {TUPLES}), w AS (SELECT *, list_distinct(regexp_split_to_array(trim(a), ' +')) AS u, list_distinct(regexp_split_to_array(trim(b), ' +')) AS v FROM t) SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 ELSE least(1.0, len(list_intersect(u, v)) / CAST(len(list_distinct(list_concat(u, v))) AS DOUBLE) + CASE WHEN contains(a, b) OR contains(b, a) THEN 0.3 ELSE 0 END) END, 6) AS score FROM w",
    ),
    "P17_evaluate_tuples": (
        lambda s, d: T.evaluated(T.normalized(V.view(s, d, V.TUPLES))).select("p_partkey", *(F.round(c, 6).alias(c) for c in ("semantic", "graph", "confidence", "overall"))),
        (EVALUATED := f"""WITH t AS (SELECT p_partkey, source AS a0, replace(target, '_', ' ') AS b0, CASE relation WHEN 'is_a' THEN 'isa' WHEN 'same_as' THEN 'sameas' WHEN 'has_property' THEN 'hasproperty' ELSE lower(relation) END AS rel FROM {TUPLES}),
n AS (SELECT *, lower(a0) AS a, lower(b0) AS b, list_distinct(string_split(lower(a0), ' ')) AS u, list_distinct(string_split(lower(b0), ' ')) AS v FROM t),
sem AS (SELECT *, CASE WHEN a = b THEN 1.0 ELSE least(1.0, len(list_intersect(u, v)) / CAST(len(list_distinct(list_concat(u, v))) AS DOUBLE) + CASE WHEN contains(a, b) OR contains(b, a) THEN 0.3 ELSE 0 END) END AS semantic, CASE rel WHEN 'isa' THEN 0.9 WHEN 'sameas' THEN 0.95 WHEN 'hasproperty' THEN 0.7 WHEN 'relatedto' THEN 0.6 ELSE 0.5 END AS w FROM n),
g AS (SELECT *, CASE WHEN rel = 'sameas' AND semantic > 0.8 THEN least(1.0, w + 0.1) WHEN rel = 'isa' AND semantic > 0.5 THEN w ELSE w * 0.8 END AS graph FROM sem),
c AS (SELECT *, least(1.0, ((semantic + graph) / 2 + greatest(0.0, 1 - abs(semantic - graph)) + least(1.0, (length(a) + length(b)) / 20.0)) / 3) AS confidence FROM g),
ev AS (SELECT p_partkey, semantic, graph, confidence, least(1.0, (0.6 * semantic + 0.4 * graph) * (0.5 + 0.5 * confidence)) AS overall FROM c)
""") + "SELECT p_partkey, round(semantic, 6) AS semantic, round(CAST(graph AS DOUBLE), 6) AS graph, round(CAST(confidence AS DOUBLE), 6) AS confidence, round(CAST(overall AS DOUBLE), 6) AS overall FROM ev",
    ),
    "A14_tuple_statistics": (
        lambda s, d: T.statistics(T.evaluated(T.normalized(V.view(s, d, V.TUPLES)))).select("n", *(F.round(c, 6).alias(c) for c in ("mean_score", "score_stddev", "mean_confidence", "high_confidence_ratio", "high_score_ratio"))),
        EVALUATED + "SELECT count(*) AS n, round(avg(overall), 6) AS mean_score, round(stddev_pop(overall), 6) AS score_stddev, round(avg(confidence), 6) AS mean_confidence, round(avg(CASE WHEN confidence > 0.7 THEN 1.0 ELSE 0 END), 6) AS high_confidence_ratio, round(avg(CASE WHEN overall > 0.8 THEN 1.0 ELSE 0 END), 6) AS high_score_ratio FROM ev",
    ),
    "A30_dedup_first": (
        lambda s, d: B.first_occurrences(V.view(s, d, V.SUPPLY).withColumn("seq", F.substring("tgt", 2, 9).cast("long") * 1000 + F.col("score").cast("long")), ["src", "pred"], "seq"),
        f"SELECT src, pred, min(CAST(tgt[2:] AS BIGINT) * 1000 + CAST(score AS BIGINT)) AS seq FROM {SUPPLY} GROUP BY ALL",
    ),
    "A15_duplicate_matches": (
        lambda s, d: Y.checked(geo(s, d)).select(F.col("offending").alias("duplicates")),
        f"SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM {GEO})) AS duplicates FROM {GEO}",
    ),
    "G1_build_ontology": (
        lambda s, d: R.concepts(geo(s, d)),
        f"WITH t AS (SELECT DISTINCT s, p, o FROM {GEO}), n AS (SELECT s AS name FROM t UNION SELECT o FROM t) SELECT name, 'N' || md5(name) AS nodeid, (SELECT count(*) FROM t WHERE t.s = n.name) AS n_out, (SELECT count(*) FROM t WHERE t.o = n.name) AS n_in FROM n",
    ),
    "G2_equivalence_classes": (
        lambda s, d: G.components(same_edges(s, d)),
        f"WITH RECURSIVE {SAME_LABEL} SELECT id, component FROM comp",
    ),
    "A18_component_count": (
        lambda s, d: G.components(same_edges(s, d)).agg(F.count_distinct("component").alias("n")),
        "SELECT count(*) AS n FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)",
    ),
    "G3_concept_graph": (
        lambda s, d: R.concept_graph(same_edges(s, d), V.view(s, d, V.SUPPLY)).select("src", "tgt", "n", F.round("score", 2).alias("score")),
        f"WITH RECURSIVE {SAME_LABEL} SELECT src, coalesce(component, tgt) AS tgt, count(*) AS n, round(max(score), 2) AS score FROM {SUPPLY} LEFT JOIN comp ON tgt = id GROUP BY 1, 2",
    ),
    "G4_ranks": (lambda s, d: G.ranks(geo_edges(s, d)), f"WITH RECURSIVE {RANKED} SELECT id, rank FROM rk"),
    "G20_source_ranks": (
        lambda s, d: G.ranks(geo_edges(s, d).select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))),
        f"WITH RECURSIVE edge AS ({GEO_EDGES}), up(id, d) AS (SELECT src, 0 FROM edge WHERE src NOT IN (SELECT tgt FROM edge) UNION SELECT edge.tgt, d + 1 FROM up JOIN edge ON edge.src = up.id) SELECT id, CAST(max(d) AS INTEGER) AS rank FROM up GROUP BY id",
    ),
    "G6_has_cycle": (
        lambda s, d: s.range(1).select(F.lit(G.has_cycle(geo_edges(s, d))).alias("acyclic_graph"), F.lit(G.has_cycle(geo_edges(s, d).union(s.sql("SELECT 'r0', 'c1'")).union(s.sql("SELECT 'r1', 'c1'")).union(s.sql("SELECT 'r2', 'c1'")).union(s.sql("SELECT 'r3', 'c1'")).union(s.sql("SELECT 'r4', 'c1'")))).alias("with_back_edges")),
        "SELECT false AS acyclic_graph, true AS with_back_edges",
    ),
    "G7_project_pairwise": (
        lambda s, d: G.pairwise(G.hyperedges(V.view(s, d, V.SUPPLY))).select("src", "tgt", F.round("score", 6).alias("score")),
        f"SELECT src, tgt, round(max(m) / max(k), 6) AS score FROM (SELECT src, tgt, max(score) OVER (PARTITION BY src) AS m, (SELECT count(DISTINCT tgt) FROM {SUPPLY} y WHERE y.src = x.src) AS k FROM {SUPPLY} x) GROUP BY src, tgt",
    ),
    "G5_hyper_ranks": (
        lambda s, d: G.ranks(G.pairwise(G.hyperedges(geo_edges(s, d).withColumns({"pred": F.lit("subclassof"), "score": F.lit(2.0)})), by_head=False).where("score >= 2").select("src", "tgt")),
        f"WITH RECURSIVE {RANKED} SELECT id, rank FROM rk",
    ),
    "J2_hyperedges": (
        lambda s, d: G.hyperedges(V.view(s, d, V.SUPPLY)).select(F.col("tail")[0].alias("src"), F.size("head").alias("n_heads"), F.array_join("head", ",").alias("heads")),
        f"SELECT src, CAST(count(DISTINCT tgt) AS INTEGER) AS n_heads, string_agg(tgt, ',' ORDER BY tgt) AS heads FROM (SELECT DISTINCT src, tgt FROM {SUPPLY}) GROUP BY src",
    ),
    "G8_transitive_closure": (lambda s, d: G.closure(geo_edges(s, d)), f"WITH RECURSIVE {CLOSED} SELECT src, tgt FROM tc"),
    "G9_transitive_reduction": (
        lambda s, d: G.reduction(geo_edges(s, d)),
        f"WITH RECURSIVE {CLOSED} SELECT src, tgt FROM edge WHERE NOT EXISTS (SELECT 1 FROM edge e JOIN tc ON e.tgt = tc.src WHERE e.src = edge.src AND tc.tgt = edge.tgt)",
    ),
    "G10_refine_geo": (
        lambda s, d: R.refine(geo(s, d)).triples.select("s", "p", "o"),
        f"WITH RECURSIVE {CLOSED} SELECT src AS s, 'subclassof' AS p, tgt AS o FROM edge WHERE NOT EXISTS (SELECT 1 FROM edge e JOIN tc ON e.tgt = tc.src WHERE e.src = edge.src AND tc.tgt = edge.tgt)",
    ),
    "G11_refine_fallback": (
        lambda s, d: R.refine_unless_grown(geo(s, d)).triples.agg(F.count("*").alias("n")),
        "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS n",
    ),
    "G12_bisimulation": (
        lambda s, d: G.bisimulation(V.table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("key")).union(V.table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("nation "), "n_nationkey"))), geo(s, d).where("s LIKE 'c%' AND o LIKE 'n%'").select(F.col("s").alias("src"), F.col("o").alias("tgt"), F.col("p").alias("relation"))).where("id LIKE 'c%'"),
        "SELECT concat('c', c_custkey) AS id, min(concat('c', c_custkey)) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component FROM customer",
    ),
    "G15_collapse": (
        lambda s, d: G.collapsed(V.view(s, d, V.SUPPLY).withColumnRenamed("pred", "relation"), supply_classes(s, d)),
        f"SELECT a.component AS src, b.component AS tgt, pred AS relation, max(score) AS score FROM {SUPPLY} JOIN {CLASSES} a ON a.id = src JOIN {CLASSES} b ON b.id = tgt WHERE a.component <> b.component GROUP BY ALL",
    ),
    "A35_collapse_max": (
        lambda s, d: G.collapsed(V.view(s, d, V.SUPPLY).withColumnRenamed("pred", "relation"), V.table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("p"), "p_partkey").alias("component")).union(V.table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("s"), "s_suppkey")))),
        f"SELECT src, tgt, pred AS relation, max(score) AS score FROM {SUPPLY} GROUP BY ALL",
    ),
    "J1_mapped_edges": (
        lambda s, d: G.mapped(V.view(s, d, V.SUPPLY), supply_classes(s, d)).groupBy("src", "tgt").agg(F.count("*").alias("n")),
        f"SELECT a.component AS src, b.component AS tgt, count(*) AS n FROM {SUPPLY} JOIN {CLASSES} a ON a.id = src JOIN {CLASSES} b ON b.id = tgt WHERE a.component <> b.component GROUP BY ALL",
    ),
    "J8_induced_subgraph": (
        lambda s, d: G.induced(geo_edges(s, d), V.table(s, d, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("c"), "c_custkey").alias("id")).union(V.table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey")))),
        f"SELECT src, tgt FROM ({GEO_EDGES}) WHERE src IN (SELECT concat('c', c_custkey) FROM customer WHERE c_acctbal > 5000) AND tgt LIKE 'n%'",
    ),
    "J13_siblings": (
        lambda s, d: G.siblings(V.table(s, d, "nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("tgt"))),
        "SELECT a.n_nationkey AS src, b.n_nationkey AS tgt FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    ),
    "G16_neighbourhood": (
        lambda s, d: G.neighbourhood(geo_edges(s, d), sample_seeds(s, d), 2),
        f"""WITH RECURSIVE edge AS (SELECT * FROM ({GEO_EDGES})), step AS (SELECT src AS a, tgt AS b FROM edge UNION SELECT tgt, src FROM edge UNION SELECT x.tgt, y.tgt FROM edge x JOIN edge y ON x.src = y.src AND x.tgt <> y.tgt),
walk(seed, id, hop) AS (SELECT id, id, 0 FROM (VALUES ('n1'), ('n2')) AS t(id) UNION SELECT seed, b, hop + 1 FROM walk JOIN step ON a = id WHERE hop < 2) SELECT seed, id, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY seed, id""",
    ),
    "G17_path_exists": (
        lambda s, d: G.closure(geo_edges(s, d)).where("src LIKE 's%' AND tgt LIKE 'r%'"),
        f"WITH RECURSIVE {CLOSED} SELECT src, tgt FROM tc WHERE src LIKE 's%' AND tgt LIKE 'r%'",
    ),
    "G19_ancestors_descendants": (
        lambda s, d: R.closure_sizes(geo_edges(s, d)),
        f"WITH RECURSIVE {CLOSED} SELECT id, sum(up) AS n_up, sum(down) AS n_down FROM (SELECT src AS id, 1 AS up, 0 AS down FROM tc UNION ALL SELECT tgt, 0, 1 FROM tc) GROUP BY id",
    ),
    "A1_degrees": (
        lambda s, d: G.degrees(geo_edges(s, d)),
        f"SELECT id, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT src AS id, 1 AS o, 0 AS i FROM ({GEO_EDGES}) UNION ALL SELECT tgt, 0, 1 FROM ({GEO_EDGES})) GROUP BY id",
    ),
    "A3_two_section": (
        lambda s, d: G.two_section(V.view(s, d, V.INCIDENCE)).where("n > 1"),
        f"SELECT x.vid AS a, y.vid AS b, count(*) AS n FROM {INCIDENCE} x JOIN {INCIDENCE} y ON x.eid = y.eid AND x.vid < y.vid GROUP BY ALL HAVING count(*) > 1",
    ),
    "A4_incidence_matrix": (
        lambda s, d: R.incidence_matrix(V.view(s, d, V.INCIDENCE)),
        f"SELECT v.i AS row, e.i AS col, 1.0 AS value FROM {INCIDENCE} x JOIN (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS i FROM (SELECT DISTINCT vid FROM {INCIDENCE})) v USING (vid) JOIN (SELECT eid, row_number() OVER (ORDER BY eid) - 1 AS i FROM (SELECT DISTINCT eid FROM {INCIDENCE})) e USING (eid)",
    ),
    "A5_parallel_weights": (
        lambda s, d: B.parallel_sums(V.view(s, d, V.SUPPLY)).withColumn("score", F.round("score", 2)),
        f"SELECT src, tgt, round(sum(score), 2) AS score, count(*) AS n FROM {SUPPLY} GROUP BY ALL",
    ),
    "A6_multigraph_counts": (
        lambda s, d: B.multigraph_counts(V.view(s, d, V.SUPPLY)),
        f"SELECT count(*) AS edges, count(DISTINCT (src, tgt)) AS pairs, (SELECT count(*) FROM (SELECT src FROM {SUPPLY} UNION SELECT tgt FROM {SUPPLY})) AS nodes FROM {SUPPLY}",
    ),
    "W7_strongest_edges": (
        lambda s, d: G.strongest(V.view(s, d, V.SUPPLY).groupBy("src", "tgt").agg(F.max("score").alias("score")), 2),
        f"WITH p AS (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, max(score) AS score FROM {SUPPLY} GROUP BY 1, 2), m AS (SELECT *, src AS u, tgt AS v FROM p UNION ALL SELECT *, tgt, src FROM p) SELECT DISTINCT src, tgt, score FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, v) AS r FROM m) WHERE r <= 2",
    ),
    "T9_dense_subgraph": (
        lambda s, d: G.dense_subgraph(geo_edges(s, d), 40).select("id", "n_out", "n_in"),
        f"SELECT id, n_out, n_in FROM (SELECT id, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT src AS id, 1 AS o, 0 AS i FROM ({GEO_EDGES}) UNION ALL SELECT tgt, 0, 1 FROM ({GEO_EDGES})) GROUP BY id) ORDER BY n_out + n_in DESC, n_out DESC, id DESC LIMIT 40",
    ),
    "T10_dense_random": (lambda s, d: G.dense_subgraph(geo_edges(s, d), 40, noise=0.5, seed=3).select("id", "n_out", "n_in"), None),
    "U1_union_ontologies": (
        lambda s, d: geo(s, d).unionByName(V.view(s, d, V.TRIPLES_ORDER)).distinct(),
        f"SELECT * FROM {GEO} UNION SELECT * FROM {ORDER}",
    ),
    "U2_insert_absent": (
        lambda s, d: R.inserted(geo(s, d).where("s LIKE 'c%'").distinct(), geo(s, d)),
        f"SELECT DISTINCT s, p, o FROM {GEO}",
    ),
    "U5_subtract_closure": (
        lambda s, d: G.ranks(geo_edges(s, d)).select("id").join(G.closure(geo_edges(s, d)).where("tgt = 'r1'").select(F.col("src").alias("id")), "id", "left_anti"),
        f"WITH RECURSIVE {CLOSED} SELECT id FROM (SELECT src AS id FROM edge UNION SELECT tgt FROM edge) WHERE id NOT IN (SELECT src FROM tc WHERE tgt = 'r1')",
    ),
    "A19_lint": (
        lambda s, d: R.lint(geo(s, d), V.view(s, d, V.SAME_PART)),
        f"SELECT 'isolated_classes' AS check, CAST(0 AS DOUBLE) AS value, 'PASS' AS status UNION ALL SELECT 'connected_components', CAST((SELECT count(DISTINCT n_regionkey) FROM nation) AS DOUBLE), 'WARN' UNION ALL SELECT 'duplicate_labels', CAST((SELECT count(*) FROM (SELECT s, p, o FROM {GEO} GROUP BY ALL HAVING count(*) > 1)) AS DOUBLE), 'WARN' UNION ALL SELECT 'missing_domain_range', CAST(1 AS DOUBLE), 'FAIL'",
    ),
}
