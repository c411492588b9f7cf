"""The engine's relations, read from a folder of Parquet tables and brought to one row per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions.ids import folded, normal_id
from loamgraph.session import table


def pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in ``order``; each task keeps one row per key before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and shared nodes, the last row of an id."""
    own = table(spark, d, "nodes").unionByName(table(spark, d, "shared_nodes"), allowMissingColumns=True)
    own = own.where("id IS NOT NULL AND id != ''")
    return pick(own, ["id"], [F.col("seen_at").desc()]).withColumn("source_file", F.coalesce("source_file", F.lit("")))


def resolve_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between known nodes: endpoints in normal form, relations folded, repeated rows once, dangling edges dropped."""
    own = edges.select(normal_id(F.col("source")).alias("source"), normal_id(F.col("target")).alias("target"), folded(F.col("relation")).alias("relation"), "confidence", "source_file", "source_location", "weight").where("source != '' AND target != ''").distinct()
    known = ids.select("id").distinct()
    return own.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve_edges(table(spark, d, "edges"), nodes(spark, d))


def knowledge(spark: SparkSession, d: str, short: int | None = None) -> DataFrame:
    """Entries, the last state of a uuid; nulls of optional texts as empty. With ``short``, of descriptions only so many first characters, in lower case, are shuffled."""
    own = table(spark, d, "knowledge").where("uuid IS NOT NULL")
    if short is not None:
        own = own.withColumn("description", F.left(F.lower("description"), F.lit(short)))
    own = pick(own, ["uuid"], [F.col("updated_at").desc_nulls_last(), F.col("fetch_count").desc_nulls_last(), F.col("last_fetched").desc_nulls_last()])
    texts = {c: F.coalesce(c, F.lit("")) for c in ("title", "description", "knowledge_type", "scope", "status", "applies_when", "supersedes", "superseded_by", "evidence")}
    numbers = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("created_at", "updated_at", "last_validated_at", "last_fetched")}
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("observations", "fetch_count")}
    return own.withColumns(texts | numbers | counts | {"uuid": folded(F.col("uuid")), "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def links(spark: SparkSession, d: str) -> DataFrame:
    """Links, the first row per (knowledge_uuid, node_uuid, relation); is_knowledge tells what node_uuid is."""
    own = table(spark, d, "links").select(
        folded(F.col("knowledge_uuid")).alias("knowledge_uuid"), folded(F.col("node_uuid")).alias("node_uuid"), folded(F.col("relation")).alias("relation"),
        (folded(F.coalesce("target_type", F.lit(""))) == "knowledge").alias("is_knowledge"), "confidence", "created_at",
        F.coalesce("linked_body_hash", F.lit("")).alias("linked_body_hash"), F.coalesce("linked_logical_key", F.lit("")).alias("linked_logical_key"), F.coalesce("reason", F.lit("")).alias("reason"), "source", "loaded_at",
    ).where("knowledge_uuid != '' AND node_uuid != ''")
    order = ["loaded_at", "created_at", "linked_body_hash", "linked_logical_key", "reason", "confidence", "is_knowledge"]
    return pick(own, ["knowledge_uuid", "node_uuid", "relation"], [F.col(c).asc_nulls_first() for c in order])


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return pick(table(spark, d, "chunks").where("id IS NOT NULL"), ["id"], [F.col("updated_at").desc()])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


_NORM = r"lower(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"
_FOLD = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"

#: The same relations for the SQL: n nodes, e edges, k knowledge, l links, c chunks.
SQL = {
    "n": """n AS (SELECT id, label, file_type, coalesce(source_file, '') AS source_file, source_location, confidence, lower(trim(uuid)) AS uuid, fingerprint, logical_key, body_hash, community, seen_at FROM (
  SELECT id, label, file_type, source_file, source_location, confidence, uuid, fingerprint, logical_key, body_hash, community, seen_at FROM nodes
  UNION ALL SELECT id, label, file_type, source_file, NULL, NULL, uuid, NULL, NULL, NULL, NULL, seen_at FROM shared_nodes) WHERE id <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at DESC) = 1)""",
    "e": f"""e AS (SELECT * FROM (SELECT DISTINCT {_NORM.format('source')} AS source, {_NORM.format('target')} AS target, {_FOLD.format('relation')} AS relation, confidence, source_file, source_location, weight FROM edges) x
  WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n))""",
    "k": f"""k AS (SELECT {_FOLD.format('uuid')} AS uuid, coalesce(title, '') AS title, coalesce(knowledge_type, '') AS knowledge_type, coalesce(description, '') AS description, confidence, coalesce(observations, 0) AS observations,
  coalesce(tags, []::VARCHAR[]) AS tags, coalesce(scope, '') AS scope, coalesce(status, '') AS status, source, coalesce(last_validated_at, 0) AS last_validated_at, coalesce(applies_when, '') AS applies_when, coalesce(supersedes, '') AS supersedes,
  coalesce(superseded_by, '') AS superseded_by, coalesce(evidence, '') AS evidence, coalesce(created_at, 0) AS created_at, coalesce(updated_at, 0) AS updated_at, author, coalesce(fetch_count, 0) AS fetch_count, coalesce(last_fetched, 0) AS last_fetched
  FROM (SELECT * FROM knowledge WHERE uuid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY updated_at DESC NULLS LAST, fetch_count DESC NULLS LAST, last_fetched DESC NULLS LAST) = 1))""",
    "l": f"""l AS (SELECT * FROM (SELECT {_FOLD.format('knowledge_uuid')} AS knowledge_uuid, {_FOLD.format('node_uuid')} AS node_uuid, {_FOLD.format('relation')} AS relation, {_FOLD.format("coalesce(target_type, '')")} = 'knowledge' AS is_knowledge,
  confidence, created_at, coalesce(linked_body_hash, '') AS linked_body_hash, coalesce(linked_logical_key, '') AS linked_logical_key, coalesce(reason, '') AS reason, source, loaded_at FROM links)
  WHERE knowledge_uuid <> '' AND node_uuid <> '' QUALIFY row_number() OVER (PARTITION BY knowledge_uuid, node_uuid, relation ORDER BY loaded_at NULLS FIRST, created_at NULLS FIRST, linked_body_hash, linked_logical_key, reason, confidence NULLS FIRST, is_knowledge) = 1)""",
    "c": "c AS (SELECT * FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)",
}


_HEX = "substr(h, 8 * i + {0}, 2)"
_BITS = "CAST('0x' || " + " || ".join(_HEX.format(k) for k in (7, 5, 3, 1)) + " AS BIGINT)"
#: Rows fl of node_embeddings (first row per node and model) with their float32 bytes as numbers v, nan where not finite.
FLOATS = f"""WITH hx AS (SELECT *, hex(vec) AS h FROM node_embeddings),
fl AS (SELECT node_id, model, dim, vec, updated_at, list_transform(list_transform(range(0, octet_length(vec) // 4), lambda i: {_BITS}),
  lambda b: CASE WHEN (b >> 23) & 255 = 255 THEN 'nan'::DOUBLE ELSE CASE WHEN b >= 2147483648 THEN -1 ELSE 1 END * CASE WHEN (b >> 23) & 255 = 0 THEN (b & 8388607) * power(2.0, -149) ELSE ((b & 8388607) + 8388608) * power(2.0, ((b >> 23) & 255) - 150) END END) AS v FROM hx)
"""


def with_(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in names)
