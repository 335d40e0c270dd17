"""All queries of the library proper: name -> (query(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from weft.plans import catalog_flow, catalog_graph, catalog_lookup, catalog_more, catalog_state, catalog_text, catalog_vectors

QUERIES = {**catalog_graph.QUERIES, **catalog_vectors.QUERIES, **catalog_text.QUERIES, **catalog_flow.QUERIES, **catalog_more.QUERIES, **catalog_lookup.QUERIES, **catalog_state.QUERIES}
