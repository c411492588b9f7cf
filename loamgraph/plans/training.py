"""Queries p4 and p7, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators import hierarchy, references
from loamgraph.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchies(hierarchy.parent_child(table(spark, d, "edges"))).select("node", "root", "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """p4_found with each node's path, its names joined by '/'."""
    rows = hierarchy.hierarchies(hierarchy.parent_child(table(spark, d, "edges")), "paths")
    return rows.select("node", "root", "depth", F.coalesce(F.array_join("path", "/"), F.lit("")).alias("path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.parent_child(table(spark, d, "edges")))


def _p7_orphans(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("edges", "links", "nodes", "shared_nodes", "knowledge", "forgotten")}
    changes = references.reference_changes(t["edges"], t["links"]).unionByName(references.record_changes(t["nodes"], t["shared_nodes"], t["knowledge"], t["forgotten"]))
    return references.orphans(references.fold(references.deltas(changes)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7_orphans(spark, d).select("ref_table", "ref_field", "ref_key", "ref_month", "kind")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_p7_orphans(spark, d))


QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p7_found": p7_found, "p7_report": p7_report}

_NORM = r"lower(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"
_FOLD = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"

_PAIRS = f"""WITH RECURSIVE pairs AS (
  SELECT DISTINCT p, c FROM (SELECT {_NORM.format('source')} AS p, {_NORM.format('target')} AS c FROM edges WHERE {_FOLD.format('relation')} IN ('contains', 'method'))
  WHERE p <> '' AND c <> ''),
reach AS (SELECT p, c FROM pairs UNION SELECT reach.p, pairs.c FROM reach JOIN pairs ON reach.c = pairs.p),
loops AS (SELECT DISTINCT p AS v FROM reach WHERE p = c),
bad AS (SELECT v FROM loops UNION SELECT reach.c FROM reach JOIN loops ON reach.p = loops.v),
"""

# A reference is a row; of forgotten keys, known keys and first times there is a table each, as TESTDATA states them.
_P7 = f"""WITH refs AS (
  SELECT 'edges' AS ref_table, 'source' AS ref_field, {_NORM.format('source')} AS ref_key, 'node id' AS entity, seen_at AS ref_at FROM (SELECT DISTINCT source, target, relation, confidence, source_file, source_location, weight, seen_at FROM edges)
  UNION ALL SELECT 'edges', 'target', {_NORM.format('target')}, 'node id', seen_at FROM (SELECT DISTINCT source, target, relation, confidence, source_file, source_location, weight, seen_at FROM edges)
  UNION ALL SELECT 'links', 'knowledge_uuid', {_FOLD.format('knowledge_uuid')}, 'knowledge', make_timestamp(created_at * 1000000) FROM (SELECT DISTINCT knowledge_uuid, node_uuid, relation, target_type, created_at FROM links)
  UNION ALL SELECT 'links', 'node_uuid', {_FOLD.format('node_uuid')}, if({_FOLD.format("coalesce(target_type, '')")} = 'knowledge', 'knowledge', 'node uuid'), make_timestamp(created_at * 1000000) FROM (SELECT DISTINCT knowledge_uuid, node_uuid, relation, target_type, created_at FROM links)),
deleted AS (SELECT DISTINCT 'node id' AS entity, {_NORM.format('node_id')} AS k FROM forgotten WHERE entity = 'node'
  UNION SELECT if(entity = 'node', 'node uuid', 'knowledge'), {_FOLD.format('item_uuid')} FROM forgotten),
known AS (SELECT entity, k, min(known_at) AS first_at FROM (
  SELECT 'node id' AS entity, {_NORM.format('id')} AS k, seen_at AS known_at FROM nodes UNION ALL SELECT 'node uuid', {_FOLD.format('uuid')}, seen_at FROM nodes
  UNION ALL SELECT 'node id', {_NORM.format('id')}, seen_at FROM shared_nodes UNION ALL SELECT 'node uuid', {_FOLD.format('uuid')}, seen_at FROM shared_nodes
  UNION ALL SELECT 'knowledge', {_FOLD.format('uuid')}, make_timestamp(created_at * 1000000) FROM knowledge) GROUP BY entity, k),
judged AS (
  SELECT ref_table, ref_field, ref_key, ref_at, refs.entity, coalesce(strftime(ref_at, '%Y-%m'), '') AS ref_month,
    EXISTS (FROM deleted WHERE deleted.entity = refs.entity AND deleted.k = ref_key) AS is_deleted, known.k IS NULL AS is_missing, coalesce(known.first_at > ref_at, false) AS is_late
  FROM refs LEFT JOIN known ON known.entity = refs.entity AND known.k = ref_key WHERE ref_key <> ''),
found AS (SELECT *, CASE WHEN is_deleted THEN 'deleted' WHEN is_missing THEN 'missing' WHEN bool_or(is_late) OVER (PARTITION BY ref_table, ref_field, ref_key, entity, ref_month) THEN 'late' END AS kind FROM judged)
"""

SQL = {
    "p4_found": _PAIRS + """ways AS (
  SELECT DISTINCT p AS node, p AS root, 0 AS depth FROM pairs WHERE p NOT IN (SELECT c FROM pairs)
  UNION SELECT pairs.c, ways.root, ways.depth + 1 FROM ways JOIN pairs ON ways.node = pairs.p WHERE pairs.c NOT IN (SELECT v FROM bad))
SELECT node, root, depth FROM ways UNION ALL SELECT v, '', -1 FROM bad""",
    "p4_paths": _PAIRS + """ways AS (
  SELECT DISTINCT p AS node, p AS root, 0 AS depth, p AS path FROM pairs WHERE p NOT IN (SELECT c FROM pairs)
  UNION SELECT pairs.c, ways.root, ways.depth + 1, ways.path || '/' || pairs.c FROM ways JOIN pairs ON ways.node = pairs.p WHERE pairs.c NOT IN (SELECT v FROM bad))
SELECT node, root, depth, array_to_string(min(string_split(path, '/')), '/') AS path FROM ways GROUP BY node, root, depth UNION ALL SELECT v, '', -1, '' FROM bad""",
    "p4_descendants": _PAIRS + """steps AS (
  SELECT p, c, 1 AS d FROM pairs WHERE c NOT IN (SELECT v FROM bad)
  UNION SELECT steps.p, pairs.c, steps.d + 1 FROM steps JOIN pairs ON steps.c = pairs.p WHERE pairs.c NOT IN (SELECT v FROM bad))
SELECT p AS ancestor, c AS node, min(d) AS distance FROM steps WHERE p NOT IN (SELECT v FROM bad) GROUP BY p, c""",
    "p7_found": _P7 + "SELECT DISTINCT ref_table, ref_field, ref_key, ref_month, kind FROM found WHERE kind IS NOT NULL",
    "p7_report": _P7 + "SELECT ref_table, ref_field, ref_month, kind, count(DISTINCT ref_key) AS ref_keys, count(*) AS refs FROM found WHERE kind IS NOT NULL GROUP BY ALL",
}
