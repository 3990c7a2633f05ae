"""Problem 5: references of an order as trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.operators.branches import with_root_document
from lexloom.operators.hierarchy import all_descendants, hierarchy
from lexloom.plans.registry import query
from lexloom.runtime import table

_WALK = r"""
WITH RECURSIVE refs AS (
  SELECT doc_id, id, arg_max(parent, detected_at) AS parent FROM (
    SELECT doc_id, detected_at,
      ltrim(regexp_extract(element_id, '(\d+)', 1), '0') AS id,
      nullif(ltrim(regexp_extract(coalesce(parent_reference, ''), '(\d+)', 1), '0'), '') AS parent
    FROM section_references)
  GROUP BY ALL HAVING true
), one AS (
  SELECT doc_id, id, max(parent) AS parent FROM refs GROUP BY 1, 2
), edges AS (
  SELECT c.doc_id, c.id, p.id AS parent FROM one c LEFT JOIN one p ON p.doc_id = c.doc_id AND p.id = c.parent
), walk AS (
  SELECT doc_id, id, id AS cur, [id] AS path, false AS looped FROM edges
  UNION ALL
  SELECT w.doc_id, w.id, e.parent, list_prepend(e.parent, w.path), list_contains(w.path, e.parent)
  FROM walk w JOIN edges e ON e.doc_id = w.doc_id AND e.id = w.cur
  WHERE e.parent IS NOT NULL AND NOT w.looped
)
"""
_WALK = _WALK.replace("GROUP BY ALL HAVING true", "GROUP BY doc_id, id")

FOUND_SQL = _WALK + "SELECT DISTINCT doc_id, id AS element_id FROM walk WHERE looped"
TREES_SQL = (
    _WALK
    + """, placed AS (
  SELECT w.doc_id, w.id, w.path, w.cur FROM walk w JOIN edges e ON e.doc_id = w.doc_id AND e.id = w.cur
  WHERE e.parent IS NULL
), below AS (
  SELECT doc_id, cur AS id, count(DISTINCT id) AS n FROM walk WHERE cur <> id GROUP BY 1, 2
)
SELECT e.doc_id, e.id AS element_id, p.cur AS root, CAST(len(p.path) - 1 AS BIGINT) AS depth,
  array_to_string(p.path, '/') AS path, p.id IS NULL AS in_cycle, CAST(coalesce(b.n, 0) AS BIGINT) AS n_descendants
FROM edges e LEFT JOIN placed p ON p.doc_id = e.doc_id AND p.id = e.id
LEFT JOIN below b ON b.doc_id = e.doc_id AND b.id = e.id"""
)

BELOW_SQL = _WALK + """SELECT doc_id, cur AS element_id, id AS descendant, CAST(min(len(path) - 1) AS BIGINT) AS distance
FROM walk WHERE cur <> id GROUP BY 1, 2, 3"""


def _trees(spark: SparkSession, sf_dir: str, with_paths: bool) -> DataFrame:
    return hierarchy(
        table(spark, sf_dir, "section_references"), "doc_id", "element_id", "parent_reference", "detected_at", with_paths
    )


@query("p5_found", FOUND_SQL)
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir, with_paths=False).where("in_cycle").select("doc_id", "element_id")


@query("p5_hierarchy", TREES_SQL)
def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir, with_paths=True).selectExpr(
        "doc_id", "element_id", "root", "depth", "array_join(path, '/') AS path", "in_cycle", "n_descendants"
    )


@query("p5_descendants", BELOW_SQL)
def below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of each reference, those on and below loops included."""
    return all_descendants(table(spark, sf_dir, "section_references"), "doc_id", "element_id", "parent_reference", "detected_at")


@query("reference_branches", TREES_SQL.replace("SELECT e.doc_id, e.id AS element_id, p.cur AS root, CAST(len(p.path) - 1 AS BIGINT) AS depth,", "SELECT e.doc_id, e.id AS element_id, p.cur AS root, u.uri AS root_uri,").replace("array_to_string(p.path, '/') AS path, p.id IS NULL AS in_cycle, CAST(coalesce(b.n, 0) AS BIGINT) AS n_descendants", "array_to_string(p.path, '/') AS path") + " LEFT JOIN (SELECT doc_id, ltrim(regexp_extract(element_id, '(\\d+)', 1), '0') AS id, max(uri) AS uri FROM section_references GROUP BY 1, 2) u ON u.doc_id = e.doc_id AND u.id = p.cur")
def reference_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference with its chain up to the root and the root's identifier."""
    out = with_root_document(table(spark, sf_dir, "section_references"), "doc_id", "element_id", "parent_reference", "detected_at")
    return out.selectExpr("doc_id", "element_id", "root", "root_uri", "array_join(path, '/') AS path")
