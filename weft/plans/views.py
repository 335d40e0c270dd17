"""The fixture tables seen as triples, edges, tuples and pairs; each view beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, query: str, *tables: str) -> DataFrame:
    """A Spark SQL query over fixture tables, named by their paths: nothing is registered in the session."""
    return spark.sql(query.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in tables}))


# Classes of places: customers and suppliers (twice) below nations below regions, with a shortcut.
TRIPLES_GEO = """
SELECT concat('c', c_custkey) AS s, 'is_a' AS p, concat('n', c_nationkey) AS o FROM {customer}
UNION ALL SELECT concat('s', s_suppkey), 'rdfs:subClassOf', concat('n', s_nationkey) FROM {supplier}
UNION ALL SELECT concat('s', s_suppkey), 'rdfs:subClassOf', concat('n', s_nationkey) FROM {supplier}
UNION ALL SELECT concat('n', n_nationkey), 'broader', concat('r', n_regionkey) FROM {nation}
UNION ALL SELECT concat('c', c_custkey), 'is_a', concat('r', n_regionkey) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""
# Orders as wholes and parts, in both spellings.
TRIPLES_ORDER = """
SELECT concat('o', l_orderkey) AS s, 'has_part' AS p, concat('l', l_orderkey, '_', l_linenumber) AS o FROM {lineitem}
UNION ALL SELECT concat('o', o_orderkey), 'obo:part_of', concat('c', o_custkey) FROM {orders}
"""
# Parts of one name are the same thing, each said of the next.
SAME_PART = """
SELECT s, 'owl:sameAs' AS p, o FROM (SELECT concat('p', p_partkey) AS s, concat('p', lead(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey)) AS o,
  lead(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS nxt FROM {part}) WHERE nxt IS NOT NULL
"""
# Orders as hyperedges over parts.
INCIDENCE = "SELECT DISTINCT concat('p', l_partkey) AS vid, concat('o', l_orderkey) AS eid FROM {lineitem}"
# Suppliers to parts, with a score.
SUPPLY = "SELECT concat('s', l_suppkey) AS src, 'supplies' AS pred, concat('p', l_partkey) AS tgt, CAST(l_quantity AS DOUBLE) AS score FROM {lineitem}"
# Tuples of words, for lexical scores.
TUPLES = """
SELECT p_name AS source, CASE p_size % 4 WHEN 0 THEN 'is_a' WHEN 1 THEN 'same_as' WHEN 2 THEN 'has_property' ELSE 'relatedTo' END AS relation,
  concat(p_type, '_', p_brand) AS target, p_partkey FROM {part}
"""
# Conversations as nodes, each turn after the one before.
THOUGHTS = """
SELECT concat(conv_id, '_', turn) AS id, concat(conv_id, '_', lag(turn) OVER (PARTITION BY conv_id ORDER BY turn)) AS parent_id,
  lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS root, conv_id, turn, role, text FROM {conversations}
"""


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """One of the views above."""
    import re

    return sql(spark, sf_dir, text, *set(re.findall(r"{(\w+)}", text)))


def plain(text: str) -> str:
    """The view for DuckDB, where tables have their own names (concat of a null stays as in Spark)."""
    import re

    return "(" + re.sub(r"{(\w+)}", r"\1", text) + ")"
