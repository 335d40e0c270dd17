"""Queries on streamed updates and on readers and sinks, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weft.lineage import shared_dir
from weft.plans import views as V
from weft.sources import readers, writers
from weft.streaming import online as O


def streamed_windows(s, d):
    """The events as a stream, through a watermarked window to a table."""
    name = f"windows_{uuid.uuid4().hex}"
    rows = s.readStream.schema(V.table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    query = O.windowed(rows).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(s)}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.table(name)  # an in-memory sink: seven rows a day at most


def round_trip(s, d):
    path = f"{shared_dir(s)}/triples-{uuid.uuid4().hex}"
    writers.write_ntriples(V.view(s, d, V.TRIPLES_GEO), path, "urn:g:")
    return readers.ntriples(s, path).select("s", "p", "o")


def runs(s, d):
    path = f"{shared_dir(s)}/runs-{uuid.uuid4().hex}"
    rows = V.table(s, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("created_at"), "event_type")
    writers.save_runs(rows.where("created_at < 500"), rows.where("created_at >= 500"), path)
    return s.read.parquet(path)


QUERIES = {
    "X2_stream_windows": (
        streamed_windows,
        "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    ),
    "X_sessions": (
        lambda s, d: O.sessions(V.table(s, d, "events")),
        "SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g",
    ),
    "K1_write_read_ntriples": (
        round_trip,
        f"SELECT DISTINCT 'urn:g:' || s AS s, 'http://www.w3.org/2000/01/rdf-schema#subClassOf' AS p, 'urn:g:' || o AS o FROM {V.plain(V.TRIPLES_GEO)}",
    ),
    "K7_save_runs": (runs, "SELECT run_id, created_at, event_type FROM (SELECT user_id AS run_id, event_id AS created_at, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1"),
}
