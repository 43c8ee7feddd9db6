"""Queries of the general operators: p4 (packed values) and p5 (hierarchies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.hierarchy import descendant_pairs, latest_links, nested_sets
from paperloom.operators.packed_values import NAMES, REFERENCES, unpack
from paperloom.runtime import table


def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"authors": NAMES, "raw_content": REFERENCES}
    return unpack(table(spark, sf, "bib_entries"), "entry_id", fields)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_values(spark, sf).where("n_values > 1").select("entry_id", "field_name", "pos")


def _tree(spark: SparkSession, sf: str, with_path: bool = True) -> DataFrame:
    nodes = table(spark, sf, "hierarchy_nodes")
    return nested_sets(latest_links(nodes, "node_id", "parent", F.col("parsed_at")), with_path)


def p5_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf).select("node_id", "parent", "root_id", "depth", F.array_join("path", "/").alias("path"), "lft", "rgt", "n_descendants", "in_cycle")


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return descendant_pairs(_tree(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf, with_path=False).where("depth > 6 or depth = -1").select("node_id", "root_id", "depth")


QUERIES = {f.__name__: f for f in (p4_found, p4_values, p5_found, p5_hierarchy, p5_descendants)}

_P5 = """
WITH RECURSIVE latest AS (
  SELECT node_id, CASE WHEN trim(p) <> '' THEN p END AS parent
  FROM (SELECT node_id, parent AS p, row_number() OVER (PARTITION BY node_id ORDER BY parsed_at DESC NULLS LAST, CASE WHEN trim(parent) <> '' THEN parent END DESC NULLS LAST) AS rn
        FROM hierarchy_nodes WHERE node_id IS NOT NULL) x WHERE rn = 1),
links AS (SELECT l.node_id, l.parent AS given_parent, k.node_id AS parent FROM latest l LEFT JOIN latest k ON l.parent = k.node_id),
down AS (
  SELECT node_id, node_id AS root_id, 0 AS depth, node_id AS path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.node_id, d.root_id, d.depth + 1, d.path || '/' || l.node_id FROM links l JOIN down d ON l.parent = d.node_id),
stuck AS (SELECT node_id, parent FROM links WHERE node_id NOT IN (SELECT node_id FROM down)),
walk AS (
  SELECT node_id AS start_id, node_id, parent FROM stuck
  UNION
  SELECT w.start_id, s.node_id, s.parent FROM walk w JOIN stuck s ON w.parent = s.node_id),
on_cycle AS (SELECT DISTINCT w.start_id AS node_id FROM walk w WHERE w.parent = w.start_id),
cyclic AS (SELECT w.start_id AS node_id, min(w.node_id) AS root_id FROM walk w JOIN on_cycle c ON c.node_id = w.node_id GROUP BY 1)
"""

ORACLES = {
    "p5_found": _P5 + "SELECT node_id, root_id, CAST(depth AS INT) AS depth FROM down WHERE depth > 6 UNION ALL SELECT node_id, root_id, CAST(-1 AS INT) AS depth FROM cyclic",
    "p5_hierarchy": _P5.rstrip() + """,
pre AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY string_split(path, '/')) - 1 AS lft FROM down),
sub AS (SELECT a AS node_id, count(*) AS size FROM (SELECT unnest(string_split(path, '/')) AS a FROM down) x GROUP BY 1)
SELECT p.node_id, l.given_parent AS parent, p.root_id, CAST(p.depth AS INT) AS depth, p.path, p.lft, p.lft + s.size - 1 AS rgt, s.size - 1 AS n_descendants, false AS in_cycle
FROM pre p JOIN links l ON l.node_id = p.node_id JOIN sub s ON s.node_id = p.node_id
UNION ALL
SELECT c.node_id, l.given_parent, c.root_id, CAST(-1 AS INT), NULL, NULL, NULL, NULL, c.node_id IN (SELECT node_id FROM on_cycle) FROM cyclic c JOIN links l ON l.node_id = c.node_id""",
    "p5_descendants": _P5.rstrip() + """,
above AS (
  SELECT d.node_id AS descendant_id, l.parent AS node_id, 1 AS steps FROM down d JOIN links l ON l.node_id = d.node_id WHERE l.parent IS NOT NULL
  UNION ALL
  SELECT a.descendant_id, l.parent, a.steps + 1 FROM above a JOIN links l ON l.node_id = a.node_id WHERE l.parent IS NOT NULL)
SELECT node_id, descendant_id, CAST(steps AS INT) AS steps FROM above""",
}
