"""The pN_ queries of the general problems, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.text import key
from lodestrata.operators.hierarchy import descendants, hierarchy, paths
from lodestrata.operators.nested import artifacts_table, edges_table, latest_reports, leaves, objects, results_table
from lodestrata.operators.snapshots import changed_values, finding_changes
from lodestrata.storage import table


def _edges(spark, d):
    rows = table(spark, d, "relationships").select(key("child_id").alias("child"), key("parent_id").alias("parent"), F.col("recorded_at").alias("version"))
    return rows.where("child is not null or parent is not null"), table(spark, d, "occurrences").select(key("id").alias("node"))


def p1_found(spark, d):
    return hierarchy(*_edges(spark, d)).select("node_id", "root_id", "depth")


def p1_hierarchy(spark, d):
    """Also how many descendants each node has; the interval itself depends on the order of siblings."""
    return hierarchy(*_edges(spark, d)).select("node_id", "root_id", "depth", "n_descendants")


def p1_paths(spark, d):
    return paths(*_edges(spark, d)).select("node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"))


def p1_descendants(spark, d):
    return descendants(paths(*_edges(spark, d)))


def p2_found(spark, d):
    return finding_changes(table(spark, d, "findings"), table(spark, d, "scan_records"))


def p2_values(spark, d):
    """Severity and category of every changed finding before and after."""
    findings, scans = table(spark, d, "findings"), table(spark, d, "scan_records")
    values = changed_values(findings, scans, finding_changes(findings, scans), ["severity", "category"])
    return values.select("scan_id", "finding_id", "change", *[F.col(f"{w}.{c}").alias(f"{w}_{c}") for w in ("old", "new") for c in ("severity", "category")])


def p4_found(spark, d):
    return leaves(objects(latest_reports(table(spark, d, "raw_reports"))))


def p4_artifacts(spark, d):
    return artifacts_table(objects(latest_reports(table(spark, d, "raw_reports"))))


def p4_results(spark, d):
    return results_table(objects(latest_reports(table(spark, d, "raw_reports"))))


def p4_edges(spark, d):
    return edges_table(latest_reports(table(spark, d, "raw_reports")))


QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_paths": p1_paths, "p1_descendants": p1_descendants, "p2_found": p2_found, "p2_values": p2_values, "p4_found": p4_found, "p4_artifacts": p4_artifacts, "p4_results": p4_results, "p4_edges": p4_edges}
ORACLES: dict[str, str] = {}

#: One step at a time down from the roots; then up from what was not reached, to the smallest id of its loop.
_WALK = r"""
WITH RECURSIVE k AS (
  SELECT nullif(lower(trim(child_id, E' \t\r\n\x0b\x0c')), '') AS child, nullif(lower(trim(parent_id, E' \t\r\n\x0b\x0c')), '') AS parent, recorded_at FROM relationships),
par AS (SELECT child, parent FROM k WHERE child IS NOT NULL QUALIFY row_number() OVER (PARTITION BY child ORDER BY recorded_at DESC, parent DESC NULLS LAST) = 1),
node AS (SELECT child AS id FROM k WHERE child IS NOT NULL UNION SELECT parent FROM k WHERE parent IS NOT NULL
  UNION SELECT nullif(lower(trim(id, E' \t\r\n\x0b\x0c')), '') FROM occurrences WHERE nullif(lower(trim(id, E' \t\r\n\x0b\x0c')), '') IS NOT NULL),
down AS (
  SELECT id AS node_id, id AS root_id, 0 AS depth, [id] AS path FROM node LEFT JOIN par ON child = id WHERE parent IS NULL
  UNION ALL SELECT child, root_id, depth + 1, list_append(path, child) FROM down JOIN par ON parent = node_id),
stuck AS (SELECT child, parent FROM par WHERE parent IS NOT NULL AND child NOT IN (SELECT node_id FROM down)),
up AS (SELECT child AS id, parent AS at FROM stuck UNION SELECT up.id, stuck.parent FROM up JOIN stuck ON up.at = stuck.child),
loops AS (SELECT a.id, min(a.at) AS root_id FROM up a JOIN up b ON b.id = a.at AND b.at = a.at GROUP BY a.id)
"""
ORACLES["p1_found"] = _WALK + "SELECT node_id, root_id, depth FROM down UNION ALL SELECT id, root_id, -1 FROM loops"
ORACLES["p1_hierarchy"] = (
    _WALK
    + """, under AS (SELECT unnest(path) AS id, count(*) - 1 AS n FROM down GROUP BY 1)
SELECT node_id, root_id, depth, n AS n_descendants FROM down JOIN under ON node_id = id UNION ALL SELECT id, root_id, -1, NULL FROM loops"""
)
ORACLES["p1_paths"] = (
    _WALK + "SELECT node_id, root_id, depth, array_to_string(path, ' > ') AS path FROM down UNION ALL SELECT id, root_id, -1, '' FROM loops"
)
ORACLES["p1_descendants"] = (
    _WALK
    + """SELECT ancestor_id, node_id AS descendant_id, len(path) - i AS distance
FROM (SELECT node_id, path, unnest(path) AS ancestor_id, generate_subscripts(path, 1) AS i FROM down) WHERE i < len(path)"""
)

#: The same by window functions, from the raw columns; DuckDB's regular expressions are RE2.
_DIFF = r"""
WITH raw AS (
  SELECT scan_id, ingested_at, severity, category,
    coalesce(nullif(lower(trim(finding_id, E' \t\r\n\x0b\x0c')), ''),
      sha256(coalesce(rule_id,'') || ':' || regexp_replace(regexp_replace(replace(coalesce(file,''), '\', '/'), '^(\./)+', ''), '^/src/', '') || ':' || coalesce(cast(line AS VARCHAR), '0'))) AS finding_id,
    coalesce(lower(trim(trend, E' \t\r\n\x0b\x0c')), '') AS trend,
    coalesce(lower(trim(severity, E' \t\r\n\x0b\x0c')), '') AS sev, coalesce(lower(trim(category, E' \t\r\n\x0b\x0c')), '') AS cat,
    payload->>'$.message' AS m, payload->>'$.fix_type' AS f, payload->>'$.effort_mins' AS e
  FROM findings WHERE scan_id IS NOT NULL),
last AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY scan_id, finding_id ORDER BY ingested_at DESC) = 1),
live AS (SELECT * FROM last WHERE trend <> 'resolved'),
ord AS (
  SELECT scan_id, lag(scan_id) OVER w AS prev, lead(scan_id) OVER w AS nxt
  FROM (SELECT DISTINCT scan_id, lower(trim(project, E' \t\r\n\x0b\x0c')) AS project, scan_timestamp FROM scan_records)
  WINDOW w AS (PARTITION BY project ORDER BY scan_timestamp, scan_id)),
n AS (SELECT live.*, prev FROM live JOIN ord USING (scan_id) WHERE prev IS NOT NULL),
o AS (SELECT live.*, nxt FROM live JOIN ord USING (scan_id) WHERE nxt IS NOT NULL)
SELECT coalesce(n.scan_id, o.nxt) AS scan_id, coalesce(n.finding_id, o.finding_id) AS finding_id,
  CASE WHEN o.scan_id IS NULL THEN 'added' WHEN n.scan_id IS NULL THEN 'removed' ELSE 'changed' END AS change{values}
FROM n FULL OUTER JOIN o ON n.scan_id = o.nxt AND n.finding_id = o.finding_id
WHERE o.scan_id IS NULL OR n.scan_id IS NULL OR n.sev <> o.sev OR n.cat <> o.cat
  OR n.m IS DISTINCT FROM o.m OR n.f IS DISTINCT FROM o.f OR n.e IS DISTINCT FROM o.e
"""
ORACLES["p2_found"] = _DIFF.replace("{values}", "")
ORACLES["p2_values"] = _DIFF.replace("{values}", ", o.severity AS old_severity, o.category AS old_category, n.severity AS new_severity, n.category AS new_category")
