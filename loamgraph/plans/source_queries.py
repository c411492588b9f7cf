"""Queries of sources, sinks, extraction and event streams (over tables at rest), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.operators import extract, search
from loamgraph.plans import graph_queries as G
from loamgraph.sources import files, sinks
from loamgraph.sources import relations as R
from loamgraph.sources.relations import with_
from loamgraph.streaming import streams


def _code(spark: SparkSession, d: str) -> DataFrame:
    return R.chunks(spark, d).select(F.format_string("%s#%d", "file_path", "start_line").alias("path"), "content", "language")


def extracted(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, edges and calls found in the chunks, by kind and relation."""
    return extract.extract(_code(spark, d)).groupBy("kind", F.coalesce("relation", F.lit("")).alias("relation")).agg(F.count("*").alias("rows"))


def graphml(spark: SparkSession, d: str) -> DataFrame:
    return sinks.graphml_lines(R.nodes(spark, d), R.edges(spark, d))


def cypher(spark: SparkSession, d: str) -> DataFrame:
    return sinks.cypher_lines(R.nodes(spark, d), R.edges(spark, d))


def note_names(spark: SparkSession, d: str) -> DataFrame:
    return sinks.note_files(R.nodes(spark, d), R.edges(spark, d)).select("file", F.sha2("text", 256).alias("hash"))


def canvas(spark: SparkSession, d: str) -> DataFrame:
    return sinks.canvas_cells(R.nodes(spark, d), 20)


def wiki(spark: SparkSession, d: str) -> DataFrame:
    return sinks.wiki_pages(R.nodes(spark, d), R.edges(spark, d))


def invalid_rows(spark: SparkSession, d: str) -> DataFrame:
    return files.invalid_rows(R.nodes(spark, d), R.edges(spark, d).withColumn("confidence", F.when(F.col("relation") == "linked", "GUESSED").otherwise(F.col("confidence"))))


def readme_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    docs = R.table(spark, d, "documents").where("lower(trim(source)) = 'readme'")
    return files.readme_entries(docs.select(F.col("doc_id").cast("string").alias("path"), "text"))


def commit_messages(spark: SparkSession, d: str) -> DataFrame:
    docs = R.table(spark, d, "documents").where("lower(trim(source)) = 'commit_message' AND text != ''")
    return files.commit_entries(docs.select(F.col("doc_id").cast("string").alias("hash"), F.col("text").alias("message"))).select("uuid", "title", "knowledge_type")


def file_projects(spark: SparkSession, d: str) -> DataFrame:
    """Each file with the folder, among those of two parts, that holds it."""
    own = R.nodes(spark, d).where("source_file != ''").select(F.col("source_file").alias("path")).distinct()
    folders = own.where("size(split(path, '/')) > 2").select(F.substring_index("path", "/", 2).alias("folder")).distinct().withColumn("name", F.col("folder"))
    top = own.select(F.substring_index("path", "/", 1).alias("folder")).distinct().withColumn("name", F.col("folder"))
    return files.owning_project(own, folders.unionByName(top))


def embedding_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by model: all, readable, and of the model's length."""
    v = search.unpack(R.table(spark, d, "node_embeddings").select("node_id", "model", "dim", "vec"))
    return v.groupBy("model").agg(F.count("*").alias("rows"), F.count_if(F.octet_length("vec") == 4 * F.col("dim")).alias("of_length"), F.count("v").alias("readable"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = R.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = streams.event_windows(e, "1 day")
    return w.select(F.unix_seconds("begun").alias("begun"), "event_type", "events", F.round("value", 2).alias("value"))


def event_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of a user's events that a pause of an hour ends."""
    e = R.table(spark, d, "events").select(F.col("user_id").cast("string").alias("project"), F.lit("a.py").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    b = streams.debounced(e, "1 hour")
    return b.select("project", F.unix_micros("begun").alias("begun"), F.unix_micros("ended").alias("ended"), "changes")


QUERIES = {f.__name__: f for f in (extracted, graphml, cypher, note_names, canvas, wiki, invalid_rows, readme_paragraphs, commit_messages, file_projects, embedding_sizes, event_windows, event_bursts)}

_X = "replace(replace(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_Q = "replace(replace(coalesce({0}, ''), '\\', '\\\\'), '''', '\\''')"
_HEAD = "<?xml version=\"1.0\" encoding=\"UTF-8\"?><graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\">" + "".join(f'<key id="{k}" for="{w}" attr.name="{k}" attr.type="{t}"/>' for k, w, t in sinks.GRAPHML_KEYS) + '<graph edgedefault="directed">'

SQL = {
    "graphml": with_("n", "e") + f""" SELECT 0 AS part, '{_HEAD}' AS value UNION ALL SELECT 3, '</graph></graphml>'
UNION ALL SELECT 1, '<node id="' || {_X.format('id')} || '"><data key="label">' || {_X.format('label')} || '</data><data key="file_type">' || {_X.format('file_type')} || '</data><data key="source_file">' || {_X.format('source_file')} || '</data>' || coalesce('<data key="community">' || community || '</data>', '') || '</node>' FROM n
UNION ALL SELECT 2, '<edge source="' || {_X.format('source')} || '" target="' || {_X.format('target')} || '"><data key="relation">' || {_X.format('relation')} || '</data><data key="confidence">' || {_X.format('confidence')} || '</data></edge>' FROM e""",
    "cypher": with_("n", "e") + f""" SELECT 1 AS part, 'MERGE (n:Node {{id: ''' || {_Q.format('id')} || '''}}) SET n.label = ''' || {_Q.format('label')} || ''', n.file = ''' || {_Q.format('source_file')} || ''';' AS value FROM n
UNION ALL SELECT 2, 'MATCH (a:Node {{id: ''' || {_Q.format('source')} || '''}}), (b:Node {{id: ''' || {_Q.format('target')} || '''}}) MERGE (a)-[:' || CASE WHEN regexp_matches(upper(relation), '[A-Z0-9]') THEN regexp_replace(upper(relation), '[^A-Z0-9_]', '_', 'g') ELSE 'RELATES_TO' END || ']->(b);' FROM e""",
    "canvas": with_("n") + " SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) % 20 * 600 AS BIGINT) AS x, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 20) * 80 AS BIGINT) AS y FROM n",
    "invalid_rows": with_("n", "e") + " SELECT 'nodes' AS \"table\", id AS key, CASE WHEN label IS NULL THEN 'no label' ELSE 'unknown file_type' END AS problem FROM n WHERE label IS NULL OR NOT coalesce(file_type IN ('code', 'document', 'paper', 'image', 'video', 'rationale'), false) UNION ALL SELECT 'edges', source || '>' || target, CASE WHEN relation IS NULL THEN 'no relation' ELSE 'unknown confidence' END FROM e WHERE relation IS NULL OR relation = 'linked' OR NOT coalesce(confidence IN ('EXTRACTED', 'INFERRED', 'AMBIGUOUS'), false)",
    "embedding_sizes": R.FLOATS + "SELECT model, count(*) AS rows, count_if(octet_length(vec) = 4 * dim) AS of_length, count_if(octet_length(vec) = 4 * dim AND dim > 0 AND len(list_filter(v, lambda x: isnan(x))) = 0) AS readable FROM fl GROUP BY model",
    "readme_paragraphs": r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: NOT regexp_matches(p, '^\s*(#|!|\[|<|```)') AND length(trim(p, ' ')) > 20) AS ps FROM documents WHERE lower(trim(source)) = 'readme' AND length(text) >= 50)
SELECT path, left(trim(ps[1], ' '), 500) AS description FROM d WHERE len(ps) > 0""",
    "note_names": with_("n", "e") + r""", b AS (SELECT *, regexp_replace(coalesce(label, id), '[\\/:*?"<>|#^\[\]]', '_', 'g') AS base FROM n),
f AS (SELECT *, CASE WHEN base <> '' THEN base ELSE id END AS base2 FROM b),
g AS (SELECT *, row_number() OVER (PARTITION BY lower(base2) ORDER BY id) AS place FROM f),
h AS (SELECT id, label, file_type, source_file, base2 || CASE WHEN place > 1 THEN '_' || place ELSE '' END AS file FROM g),
c AS (SELECT source AS id, list_sort(list(DISTINCT '- [[' || file || ']] (' || coalesce(relation, 'null') || ')')) AS links FROM e JOIN h ON e.target = h.id GROUP BY source)
SELECT file, sha256('---' || chr(10) || 'id: ' || h.id || chr(10) || 'file_type: ' || coalesce(file_type, '') || chr(10) || 'source_file: ' || source_file || chr(10) || '---' || chr(10) || '# ' || coalesce(label, '') || chr(10)
  || CASE WHEN len(links) > 0 THEN chr(10) || '## Connections' || chr(10) || array_to_string(links, chr(10)) || chr(10) ELSE '' END) AS hash FROM h LEFT JOIN c ON h.id = c.id""",
    "wiki": with_("n", "e") + ",\n" + G._DEG + f""", o AS (SELECT id, label, source_file, coalesce(community, 0) AS community FROM n), s AS (SELECT community, count(*) AS size FROM o GROUP BY 1),
h AS (SELECT o.community, o.id, row_number() OVER (PARTITION BY o.community ORDER BY coalesce(degree, 0) DESC, o.id) AS place FROM o LEFT JOIN deg ON o.id = deg.id WHERE {G._PLAIN} QUALIFY place <= 5),
t AS (SELECT community, source_file, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, source_file) AS place FROM o WHERE source_file <> '' GROUP BY community, source_file QUALIFY place <= 5),
hs AS (SELECT community, string_agg('- ' || id, chr(10) ORDER BY place) AS hubs FROM h GROUP BY community), ts AS (SELECT community, string_agg('- ' || source_file, chr(10) ORDER BY place) AS files FROM t GROUP BY community),
p AS (SELECT 'community_' || s.community AS page, '# Community ' || s.community || chr(10) || chr(10) || size || ' nodes' || chr(10) || chr(10) || '## Hubs' || chr(10) || hubs || chr(10) || chr(10) || '## Files' || chr(10) || coalesce(files, '') || chr(10) AS text, size FROM s JOIN hs ON s.community = hs.community LEFT JOIN ts ON s.community = ts.community)
SELECT page, text FROM p UNION ALL SELECT 'index', '# Index' || chr(10) || chr(10) || string_agg('- [[' || page || ']] ' || size || ' nodes', chr(10) ORDER BY size DESC, page) FROM (SELECT * FROM p ORDER BY size DESC, page LIMIT 20)""",
    "file_projects": with_("n") + ", p AS (SELECT DISTINCT source_file AS path FROM n WHERE source_file <> '') SELECT path, CASE WHEN len(string_split(path, '/')) > 2 THEN array_to_string(string_split(path, '/')[1:2], '/') WHEN path IN (SELECT array_to_string(string_split(q.path, '/')[1:2], '/') FROM p q WHERE len(string_split(q.path, '/')) > 2) THEN path ELSE split_part(path, '/', 1) END AS name FROM p",
    "event_windows": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS begun, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "event_bursts": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT CAST(user_id AS VARCHAR) AS project, epoch_us(min(ts)) AS begun, epoch_us(max(ts)) + 3600000000 AS ended, count(*) AS changes FROM s GROUP BY user_id, s""",
    "commit_messages": r"WITH d AS (SELECT doc_id, text AS t, lower(text) AS m FROM documents WHERE lower(trim(source)) = 'commit_message' AND text <> '') SELECT uuid, title, knowledge_type FROM (SELECT sha256(CAST(doc_id AS VARCHAR)) AS uuid, split_part(t, chr(10), 1) AS title, CASE WHEN regexp_matches(m, '^(merge|wip|chore)') OR strlen(m) < 15 THEN NULL WHEN regexp_matches(m, 'fix|bug|crash') THEN 'bug_pattern' WHEN regexp_matches(m, 'refactor|cleanup|simplif') THEN 'decision' WHEN regexp_matches(m, 'add') AND regexp_matches(m, 'feature|support') THEN 'architecture' WHEN regexp_matches(m, 'critical|breaking|important') THEN 'lesson' WHEN regexp_matches(m, 'convention|style|format') THEN 'convention' WHEN regexp_matches(m, 'perf|optim|speed') THEN 'performance' END AS knowledge_type FROM d) WHERE knowledge_type IS NOT NULL",
}
SQL = {k: v for k, v in SQL.items() if v}

#: Columns of doubles, which queries and SQL both give rounded.
DOUBLES = {
    "event_windows": ["value"],
}
