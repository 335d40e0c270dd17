"""Queries on joins, set operations, paths, signatures, caches and noise, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import learning as L
from weft.plans import views as V
from weft.plans.catalog_graph import GEO, geo
from weft.plans.catalog_text import documents, events

QUERIES = {
    "J15_optional": (
        lambda s, d: V.table(s, d, "pages").select("page_id").join(V.table(s, d, "labels").select(F.col("doc_id").alias("page_id"), "quality"), "page_id", "left"),
        "SELECT page_id, quality FROM pages LEFT JOIN labels ON page_id = doc_id",
    ),
    "S25_select_relation": (lambda s, d: geo(s, d).where("p = 'broader'").select("s", "o"), f"SELECT s, o FROM {GEO} WHERE p = 'broader'"),
    "F22_to_json": (
        lambda s, d: V.table(s, d, "nation").select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("json")),
        "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation",
    ),
    "G21_cluster_vectors": (lambda s, d: L.clustered(V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10), None),
    "N9_text_vectors": (lambda s, d: L.hashed_text(documents(s, d).select("doc_id", "text"), 32), None),
    "A25_usage_by_user": (
        lambda s, d: events(s, d).groupBy("user_id").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("seconds"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")),
        "SELECT user_id, count(*) AS calls, round(sum(value), 2) AS seconds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id",
    ),
}
