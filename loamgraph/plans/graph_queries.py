"""Queries over nodes and edges, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import ids as I
from loamgraph.functions import text as T
from loamgraph.operators import analyze, community, graph
from loamgraph.session import cut
from loamgraph.sources import relations as R
from loamgraph.sources.relations import with_

SEEDS = ["runtime_log_event"]
HUB = 50
LEFT, RIGHT, PUBLIC = "corlaph-gate-00000/", "torline-facade-00001/", "hook"
BENCHMARK = ("cache lookup", "json parser", "lock guard")
SINCE = "2025-09-01 00:00:00"


def _ne(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = R.nodes(spark, d)
    return n, R.edges(spark, d)


def _starts(e: DataFrame, most: int = 2) -> list[str]:
    """The nodes that call most."""
    own = e.where("relation = 'calls'").groupBy("source").agg(F.count("*").alias("n"))
    return [r.source for r in own.orderBy(F.col("n").desc(), "source").limit(most).collect()]


def god_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.god_nodes(*_ne(spark, d), 20)


def god_nodes_filtered(spark: SparkSession, d: str) -> DataFrame:
    return graph.god_nodes(*_ne(spark, d), 20, label="cache", source="/", min_degree=2)


def degree_fan_in(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    return graph.with_degrees(n.select("id"), e)


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    return n.agg(F.count("*").alias("nodes"), F.countDistinct(F.coalesce("community", F.lit(0))).alias("communities")).crossJoin(e.agg(F.count("*").alias("edges")))  # one row each


def edge_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Edges, mean weight and mean score per confidence."""
    score = F.when(F.col("confidence") == "EXTRACTED", 1.0).when(F.col("confidence") == "INFERRED", 0.5).otherwise(0.2)
    return R.edges(spark, d).groupBy("confidence").agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 6).alias("mean_weight"), F.avg(score).alias("score"))


def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.edges(spark, d).groupBy("relation").agg(F.count("*").alias("edges"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    raw = R.table(spark, d, "edges").select(I.normal_id(F.col("source")).alias("source"), I.normal_id(F.col("target")).alias("target"), I.folded(F.col("relation")).alias("relation")).where("source != '' AND target != ''")
    return graph.dangling(raw, R.nodes(spark, d))


def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_parallel(R.edges(spark, d)).select("source", "target", "relation", "sure", "edges")


def build_merged(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of two deliveries, the later one of an id winning, and the edges between them, as rows of one form."""
    n, e = _ne(spark, d)
    none = F.lit(None).cast("string")
    nodes = n.select(F.lit("node").alias("part"), "id", "label", "file_type", "source_file", none.alias("target"), none.alias("relation"))
    return nodes.unionByName(e.select(F.lit("edge").alias("part"), F.col("source").alias("id"), none.alias("label"), none.alias("file_type"), "source_file", "target", "relation"))


def graph_diff(spark: SparkSession, d: str) -> DataFrame:
    """Node ids that came or went between what had arrived by a time and the nodes with a body hash after it."""
    n = R.nodes(spark, d)
    return graph.difference(n.where(F.col("seen_at") < F.lit(SINCE).cast("timestamp_ntz")), n.where(F.col("body_hash").isNotNull()), ["id"])


def label_forms(spark: SparkSession, d: str) -> DataFrame:
    label = F.coalesce("label", F.lit(""))
    return R.nodes(spark, d).select("id", T.label_norm(label).alias("norm"), F.array_join(T.label_tokens(label), ",").alias("tokens"), T.logical_key(F.col("source_file"), label).alias("logical_key"), T.file_kind(F.col("source_file")).alias("kind"), T.line_number(F.col("source_location")).alias("line"))


def sensitive_paths(spark: SparkSession, d: str) -> DataFrame:
    files = R.chunks(spark, d).select("file_path").distinct()
    return files.select("file_path", T.is_sensitive(F.col("file_path")).alias("sensitive"), T.file_kind(F.col("file_path")).alias("kind"))


def community_nodes(spark: SparkSession, d: str) -> DataFrame:
    return community.top_nodes(*_ne(spark, d), 5, 3)


def community_files(spark: SparkSession, d: str) -> DataFrame:
    return community.top_files(R.nodes(spark, d), 3, 3)


def community_labels(spark: SparkSession, d: str) -> DataFrame:
    return community.community_labels(R.nodes(spark, d))


def community_links(spark: SparkSession, d: str) -> DataFrame:
    return community.neighbours_across(*_ne(spark, d))


def cohesion(spark: SparkSession, d: str) -> DataFrame:
    return graph.cohesion(*_ne(spark, d))


def surprising(spark: SparkSession, d: str) -> DataFrame:
    return graph.surprising(*_ne(spark, d), 100)


def suggest_questions(spark: SparkSession, d: str) -> DataFrame:
    return graph.questions(*_ne(spark, d), 400)


def shared_labels(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_labels(R.nodes(spark, d), F.substring_index("source_file", "/", 1)).select("source", "target", "label")


def bfs_depth3(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    return graph.bfs(n, e, _starts(e), 3, source="-0000")


def bfs_hub(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    return graph.bfs(n, e, _starts(e), 3, hub=HUB)


def callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers(*_ne(spark, d), SEEDS, 3)


def callees(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    return graph.callers(n, e, _starts(e), 3, callees=True)


def call_paths(spark: SparkSession, d: str) -> DataFrame:
    e = R.edges(spark, d)
    ends = [r.target for r in e.where("relation = 'calls'").groupBy("target").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "target").limit(5).collect()]
    return graph.shortest_paths(e, _starts(e), ends, 5)


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    e = R.edges(spark, d)
    return graph.shortest_paths(e, _starts(e, 5), SEEDS, 4, relations=None)


def cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycles(*_ne(spark, d))


def query_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.query_graph(*_ne(spark, d), "json lock cache", 2, hub=HUB)


def dfs_order(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    e = cut(e.select("source", "target"))
    seeds = [r.id for r in graph.god_nodes(n, e, 3).collect()]
    return graph.dfs_rows(e, seeds, 3)


def file_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Folders as nodes, packages marked, and what each contains, as rows of one form; folders whose paths have a multiple of ten letters hold a package's file."""
    n = R.nodes(spark, d)
    marked = n.where("source_file != ''").select(F.concat(F.regexp_replace("source_file", "/[^/]*$", ""), F.lit("/"), F.when(F.char_length(F.regexp_replace("source_file", "/[^/]*$", "")) % 10 == 0, "setup.py").otherwise("x.txt")).alias("source_file"))
    made, edges = graph.hierarchy(n, marked)
    none = F.lit(None).cast("string")
    return made.select(F.lit("node").alias("part"), "id", "label", "file_type", "norm_label", none.alias("target")).unionByName(edges.select(F.lit("edge").alias("part"), F.col("source").alias("id"), none.alias("label"), none.alias("file_type"), none.alias("norm_label"), "target"))


def query_graph_filtered(spark: SparkSession, d: str) -> DataFrame:
    """A question that names nothing in its scope: the best connected nodes there are the seeds."""
    return graph.query_graph(*_ne(spark, d), "zzzz", 2, hub=HUB, source=LEFT)


def call_receivers(spark: SparkSession, d: str) -> DataFrame:
    """Calls with receivers: by the length of the callee's name its own class, an ancestor, the class of the target by name, or none."""
    n, e = _ne(spark, d)
    label = F.lower(F.regexp_replace(F.coalesce("label", F.lit("")), r"^\.|\(\)$", ""))
    names = n.select(F.col("id").alias("target"), label.alias("callee")).where("callee != ''")
    owner = e.where("relation = 'method'").groupBy("target").agg(F.min("source").alias("id")).join(n.select("id", label.alias("class")), "id").select("target", "class")
    calls = e.where("relation = 'calls'").select(F.col("source").alias("caller"), "target").distinct().join(names, "target").join(owner, "target", "left")
    kind = F.char_length("callee") % 4
    return analyze.resolve_calls(n, e, calls.select("caller", "callee", F.when(kind == 0, "self").when(kind == 1, "super").when(kind == 2, F.col("class")).alias("receiver")))


def compare_options(spark: SparkSession, d: str) -> DataFrame:
    return analyze.gaps(*_ne(spark, d), LEFT, RIGHT, public=PUBLIC, top=200, file_type="code", label="e", min_degree=2, skip_file_nodes=False, public_only=True).select("norm", "label", "source_file", "degree")


def louvain(spark: SparkSession, d: str) -> DataFrame:
    return community.clusters(*_ne(spark, d))


def node_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of a node with relation and direction."""
    e = R.edges(spark, d)
    out = e.where(F.col("source") == SEEDS[0]).select(F.col("target").alias("id"), "relation", F.lit("out").alias("direction"))
    return out.unionByName(e.where(F.col("target") == SEEDS[0]).select(F.col("source").alias("id"), "relation", F.lit("in").alias("direction"))).distinct()


def compare_gaps(spark: SparkSession, d: str) -> DataFrame:
    return analyze.gaps(*_ne(spark, d), LEFT, RIGHT, public=PUBLIC, top=200).select("norm", "label", "source_file", "degree", "is_public")


def compare_priority(spark: SparkSession, d: str) -> DataFrame:
    return analyze.gaps(*_ne(spark, d), LEFT, RIGHT, public=PUBLIC, compose=True, top=200).select("norm", "label", "fan_in", "priority")


def compare_semantic(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    return analyze.gap_candidates(analyze.gaps(n, e, LEFT, RIGHT, public=PUBLIC, top=200), n, RIGHT, 0.5, 3)


def renames(spark: SparkSession, d: str) -> DataFrame:
    return analyze.renames(R.nodes(spark, d), R.links(spark, d), 0.4, 3)


def co_changes(spark: SparkSession, d: str) -> DataFrame:
    return analyze.co_changes(R.table(spark, d, "commit_files"))


def call_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Calls to a label, resolved to the node meant by the caller's class and its ancestors."""
    n, e = _ne(spark, d)
    return analyze.resolve_calls(n, e)


def token_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return analyze.token_benchmark(*_ne(spark, d), BENCHMARK)


QUERIES = {f.__name__: f for f in (
    god_nodes, god_nodes_filtered, degree_fan_in, graph_stats, edge_confidence, relation_counts, dangling_edges, merged_edges, build_merged, graph_diff, label_forms, sensitive_paths,
    community_nodes, community_files, community_labels, community_links, cohesion, surprising, suggest_questions, shared_labels, bfs_depth3, bfs_hub, callers, callees, call_paths, shortest_path, cycles,
    query_graph, dfs_order, file_hierarchy, louvain, node_neighbors, compare_gaps, compare_priority, compare_semantic, renames, co_changes, call_resolution, token_benchmark, query_graph_filtered, call_receivers, compare_options,
)}

_STEM = r"regexp_replace(regexp_extract(source_file, '[^/]*$'), '(.)\.[^.]*$', '\1')"
_PLAIN = rf"NOT (({_STEM} <> '' AND coalesce(label, '') = {_STEM}) OR (starts_with(coalesce(label, ''), '.') AND ends_with(coalesce(label, ''), '()'))) AND NOT (source_file = '' OR (NOT contains(regexp_extract(source_file, '[^/]*$'), '.') AND NOT contains(source_file, '/') AND NOT contains(source_file, chr(92))))"
_DEG = "deg AS (SELECT id, count(*) AS degree, CAST(sum(i) AS BIGINT) AS fan_in FROM (SELECT source AS id, 0 AS i FROM e UNION ALL SELECT target, 1 FROM e) GROUP BY id)"
_NE, _NED = with_("n", "e"), with_("n", "e") + ",\n" + _DEG
_STARTS = "starts AS (SELECT source AS id FROM e WHERE relation = 'calls' GROUP BY source ORDER BY count(*) DESC, source LIMIT 2)"
_ADJ = "adj AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e)"
_NORMED = r"nullif(lower(regexp_replace(label, '[^\p{L}\p{N}]', '', 'g')), '')"
_TOKENS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(label, ''), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '[^\p{L}\p{N}]+'), lambda t: lower(t)), lambda t: strlen(t) > 1)"
_KIND = "CASE " + " ".join(f"WHEN lower(regexp_extract({{0}}, '\\.([^./]+)$', 1)) IN ({', '.join(repr(x) for x in names)}) THEN '{kind}'" for kind, names in T.FILE_KINDS.items()) + " END"


def _levels(steps: str, seeds: str, depth: int, more: str = "", go: str = "") -> str:
    return f"""lv AS (SELECT id, 0 AS depth FROM n WHERE id IN ({seeds})
  UNION SELECT s.b, lv.depth + 1 FROM lv JOIN ({steps}) s ON lv.id = s.a WHERE lv.depth < {depth} {go} {more})
"""


_GAPS = with_("n", "e") + ",\n" + _DEG + rf""",
w AS (SELECT n.id, label, {_NORMED} AS norm, source_file, coalesce(degree, 0) AS degree, coalesce(fan_in, 0) AS fan_in, contains(lower(source_file), '{PUBLIC}') AS is_public, {_PLAIN} AS plain, {_TOKENS} AS toks FROM n LEFT JOIN deg ON n.id = deg.id),
best AS (SELECT * FROM w WHERE strlen(norm) >= 3 AND contains(lower(source_file), '{LEFT}') AND plain QUALIFY row_number() OVER (PARTITION BY norm ORDER BY is_public DESC, degree DESC, id) = 1),
g AS (SELECT *, (fan_in + 1) * CASE WHEN is_public THEN 2.0 ELSE 1.0 END AS priority FROM best WHERE norm NOT IN (SELECT norm FROM w WHERE strlen(norm) >= 3 AND contains(lower(source_file), '{RIGHT}')))
"""

SQL = {
    "god_nodes": _NED + f"SELECT n.id, label, source_file, degree FROM n JOIN deg ON n.id = deg.id WHERE {_PLAIN} ORDER BY degree DESC, n.id LIMIT 20",
    "god_nodes_filtered": _NED + f"SELECT n.id, label, source_file, degree FROM n JOIN deg ON n.id = deg.id WHERE {_PLAIN} AND contains(lower(label), 'cache') AND contains(source_file, '/') AND degree >= 2 ORDER BY degree DESC, n.id LIMIT 20",
    "degree_fan_in": _NED + "SELECT n.id, coalesce(degree, 0) AS degree, coalesce(fan_in, 0) AS fan_in FROM n LEFT JOIN deg ON n.id = deg.id",
    "graph_stats": _NE + "SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(DISTINCT coalesce(community, 0)) FROM n) AS communities, (SELECT count(*) FROM e) AS edges",
    "edge_confidence": _NE + "SELECT confidence, count(*) AS edges, round(avg(weight), 6) AS mean_weight, avg(CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.5 ELSE 0.2 END) AS score FROM e GROUP BY confidence",
    "relation_counts": _NE + "SELECT relation, count(*) AS edges, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM e GROUP BY relation",
    "dangling_edges": with_("n") + f" SELECT DISTINCT * FROM (SELECT {R._NORM.format('source')} AS source, {R._NORM.format('target')} AS target, {R._FOLD.format('relation')} AS relation FROM edges) WHERE source <> '' AND target <> '' AND (source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n))",
    "merged_edges": _NE + "SELECT source, target, relation, max(CASE confidence WHEN 'EXTRACTED' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END) AS sure, count(*) AS edges FROM e GROUP BY ALL",
    "build_merged": _NE + "SELECT 'node' AS part, id, label, file_type, source_file, NULL AS target, NULL AS relation FROM n UNION ALL SELECT 'edge', source, NULL, NULL, source_file, target, relation FROM e",
    "graph_diff": with_("n") + f", a AS (SELECT DISTINCT id FROM n WHERE seen_at < TIMESTAMP '{SINCE}'), b AS (SELECT DISTINCT id FROM n WHERE body_hash IS NOT NULL) SELECT id, 'added' AS change FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, 'removed' FROM a WHERE id NOT IN (SELECT id FROM b)",
    "label_forms": with_("n") + rf"SELECT id, nullif(lower(regexp_replace(coalesce(label, ''), '[^\p{{L}}\p{{N}}]', '', 'g')), '') AS norm, array_to_string({_TOKENS}, ',') AS tokens, array_to_string(list_slice(string_split(source_file, '/'), -2, -1), '/') || '::' || regexp_replace(coalesce(label, ''), '\(\)$', '') AS logical_key, {_KIND.format('source_file')} AS kind, TRY_CAST(regexp_extract(source_location, '^L*(\d+)', 1) AS INTEGER) AS line FROM n",
    "sensitive_paths": with_("c") + "SELECT DISTINCT file_path, " + " OR ".join(f"regexp_matches(file_path, '(?i){p}')" for p in T.SENSITIVE) + f" AS sensitive, {_KIND.format('file_path')} AS kind FROM c",
    "community_nodes": _NED + f", s AS (SELECT coalesce(community, 0) AS community, count(*) AS size FROM n GROUP BY 1 HAVING count(*) >= 3) SELECT s.community, size, row_number() OVER (PARTITION BY s.community ORDER BY coalesce(degree, 0) DESC, n.id) AS place, n.id, coalesce(degree, 0) AS degree FROM n JOIN s ON coalesce(n.community, 0) = s.community LEFT JOIN deg ON n.id = deg.id WHERE {_PLAIN} QUALIFY place <= 5",
    "community_files": with_("n") + ", s AS (SELECT coalesce(community, 0) AS community, count(*) AS size FROM n GROUP BY 1 HAVING count(*) >= 3), f AS (SELECT coalesce(community, 0) AS community, source_file, count(*) AS nodes FROM n WHERE source_file <> '' GROUP BY 1, 2) SELECT s.community, size, row_number() OVER (PARTITION BY s.community ORDER BY nodes DESC, source_file) AS place, source_file, nodes FROM f JOIN s ON f.community = s.community QUALIFY place <= 3",
    "community_labels": with_("n") + "SELECT coalesce(community, 0) AS community, arg_min_null(label, id) AS label FROM n GROUP BY 1",
    "community_links": _NE + "," + _ADJ + " SELECT least(x.c, y.c) AS community_a, greatest(x.c, y.c) AS community_b, count(*) AS pairs FROM adj JOIN (SELECT id, coalesce(community, 0) AS c FROM n) x ON a = x.id JOIN (SELECT id, coalesce(community, 0) AS c FROM n) y ON b = y.id WHERE a < b AND x.c <> y.c GROUP BY 1, 2",
    "cohesion": _NE + ", c AS (SELECT id, coalesce(community, 0) AS community FROM n), p AS (SELECT x.community, count(*) AS pairs FROM (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM e) JOIN c x ON a = x.id JOIN c y ON b = y.id WHERE x.community = y.community GROUP BY 1), s AS (SELECT community, count(*) AS size FROM c GROUP BY 1) SELECT s.community, size, CASE WHEN size < 2 THEN 1.0 ELSE coalesce(pairs, 0) / (size * (size - 1) / 2) END AS cohesion FROM s LEFT JOIN p ON s.community = p.community",
    "surprising": _NE + f""", p AS (SELECT id, source_file AS f, community AS c FROM n WHERE {_PLAIN}),
x AS (SELECT e.*, CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN s.f <> t.f THEN 2 ELSE 0 END + CASE WHEN s.c <> t.c THEN 1 ELSE 0 END AS score,
  concat_ws('; ', CASE confidence WHEN 'AMBIGUOUS' THEN 'AMBIGUOUS confidence' WHEN 'INFERRED' THEN 'INFERRED confidence' END, CASE WHEN s.f <> t.f THEN 'cross-file' END, CASE WHEN s.c <> t.c THEN 'cross-community' END) AS reasons
  FROM e JOIN p s ON source = s.id JOIN p t ON target = t.id)
SELECT source, target, relation, confidence, score, reasons FROM x WHERE score >= 2 ORDER BY score DESC, source, target, relation, source_location NULLS FIRST, confidence NULLS FIRST, weight NULLS FIRST LIMIT 100""",
    "suggest_questions": _NED + f""", gods AS (SELECT n.id, label FROM n JOIN deg ON n.id = deg.id WHERE {_PLAIN} ORDER BY degree DESC, n.id LIMIT 5),
q AS (SELECT 1 AS branch, 'Is the ' || relation || ' relationship between ' || coalesce(s.label, 'null') || ' and ' || coalesce(t.label, 'null') || ' correct?' AS question, 'ambiguous_edge' AS question_type, source AS node_id FROM e JOIN n s ON source = s.id JOIN n t ON target = t.id WHERE e.confidence = 'AMBIGUOUS'
UNION ALL SELECT 2, 'How does ' || coalesce(any_value(label), 'null') || ' connect to ' || count(*) || ' other entities (via inferred edges)?', 'verify_inferred', gods.id FROM gods JOIN e ON (source = gods.id OR target = gods.id) AND confidence = 'INFERRED' GROUP BY gods.id HAVING count(*) >= 3
UNION ALL SELECT 3, 'Why is ' || coalesce(label, 'null') || ' isolated? Is it missing connections?', 'isolated_nodes', n.id FROM n LEFT JOIN deg ON n.id = deg.id WHERE coalesce(degree, 0) <= 1)
SELECT * FROM q ORDER BY branch, node_id, question LIMIT 400""",
    "shared_labels": with_("n") + ", p AS (SELECT id, label, split_part(source_file, '/', 1) AS project FROM n WHERE label <> ''), f AS (SELECT label, min({'p': project, 'i': id}) AS f FROM p GROUP BY label) SELECT f.f.i AS source, p.id AS target, p.label FROM p JOIN f ON p.label = f.label WHERE p.project <> f.f.p",
    "bfs_depth3": with_("n", "e", recursive=True) + "," + _ADJ + "," + _STARTS + ",\n" + _levels("SELECT a, b FROM adj JOIN n ON b = n.id WHERE contains(source_file, '-0000')", "SELECT id FROM starts", 3) + "SELECT id, min(depth) AS depth FROM lv GROUP BY id",
    "bfs_hub": with_("n", "e", recursive=True) + "," + _ADJ + "," + _DEG + "," + _STARTS + ",\n" + _levels(f"SELECT a, b FROM adj JOIN deg ON a = deg.id WHERE degree <= {HUB} OR a IN (SELECT id FROM starts)", "SELECT id FROM starts", 3) + "SELECT id, min(depth) AS depth FROM lv GROUP BY id",
    "callers": with_("n", "e", recursive=True) + ",\n" + _levels("SELECT DISTINCT target AS a, source AS b FROM e WHERE relation = 'calls'", "'runtime_log_event'", 3) + "SELECT id, min(depth) AS depth FROM lv GROUP BY id HAVING min(depth) > 0",
    "callees": with_("n", "e", recursive=True) + "," + _STARTS + ",\n" + _levels("SELECT DISTINCT source AS a, target AS b FROM e WHERE relation = 'calls'", "SELECT id FROM starts", 3) + "SELECT id, min(depth) AS depth FROM lv GROUP BY id HAVING min(depth) > 0",
    "call_paths": with_("n", "e", recursive=True) + "," + _STARTS + """, s AS (SELECT DISTINCT source AS a, target AS b FROM e WHERE relation = 'calls'), ends AS (SELECT target AS id FROM e WHERE relation = 'calls' GROUP BY target ORDER BY count(*) DESC, target LIMIT 5),
w AS (SELECT id, [id] AS p, 0 AS l FROM starts UNION ALL SELECT b, list_append(p, b), l + 1 FROM w JOIN s ON w.id = s.a WHERE l < 5 AND (l = 0 OR w.id NOT IN (SELECT id FROM ends)) AND NOT list_contains(p, b))
SELECT id AS target, l AS length, array_to_string(p, ' > ') AS path FROM w WHERE id IN (SELECT id FROM ends) AND id NOT IN (SELECT id FROM starts) QUALIFY row_number() OVER (PARTITION BY id ORDER BY l, p) = 1 ORDER BY length, target LIMIT 20""",
    "shortest_path": with_("n", "e", recursive=True) + """, starts AS (SELECT source AS id FROM e WHERE relation = 'calls' GROUP BY source ORDER BY count(*) DESC, source LIMIT 5), s AS (SELECT DISTINCT source AS a, target AS b FROM e),
w AS (SELECT id, [id] AS p, 0 AS l FROM starts UNION ALL SELECT b, list_append(p, b), l + 1 FROM w JOIN s ON w.id = s.a WHERE l < 4 AND (l = 0 OR w.id <> 'runtime_log_event') AND NOT list_contains(p, b))
SELECT id AS target, l AS length, array_to_string(p, ' > ') AS path FROM w WHERE id = 'runtime_log_event' AND l > 0 AND id NOT IN (SELECT id FROM starts) QUALIFY row_number() OVER (PARTITION BY id ORDER BY l, p) = 1""",
    "token_benchmark": with_("n", "e", recursive=True) + "," + _ADJ + "," + _DEG + ", q(question) AS (VALUES " + ", ".join(f"('{q}')" for q in BENCHMARK) + """),
t AS (SELECT question, unnest(string_split(question, ' ')) AS t FROM q),
sc AS (SELECT question, n.id, sum(CASE WHEN contains(lower(label), t) THEN 2 ELSE 0 END + CASE WHEN contains(lower(source_file), t) THEN 1 ELSE 0 END) AS score FROM t CROSS JOIN n GROUP BY ALL HAVING score > 0),
best AS (SELECT question, id FROM sc QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, id) <= 3),
lv AS (SELECT question, id, 0 AS depth FROM best UNION SELECT question, b, depth + 1 FROM lv JOIN adj ON lv.id = a LEFT JOIN deg ON deg.id = a WHERE depth < 3 AND (depth = 0 OR degree <= 50)),
r AS (SELECT DISTINCT question, lv.id FROM lv),
z AS (SELECT q.question, (SELECT count(*) FROM n) * 5000 // 75 AS corpus_tokens, greatest(1, coalesce(sum(strlen(label) + strlen(source_file)), 0) // 4) AS query_tokens FROM q LEFT JOIN r ON q.question = r.question LEFT JOIN n ON r.id = n.id GROUP BY q.question)
SELECT question, corpus_tokens, CAST(query_tokens AS BIGINT) AS query_tokens, round(corpus_tokens / query_tokens, 1) AS ratio FROM z""",
    "call_receivers": with_("n", "e", recursive=True) + r""", named AS (SELECT id AS target, lower(regexp_replace(coalesce(label, ''), '^\.|\(\)$', '', 'g')) AS callee FROM n WHERE callee <> ''),
owner AS (SELECT target AS id, min(source) AS class FROM e WHERE relation = 'method' GROUP BY target),
raw AS (SELECT DISTINCT source AS caller, x.callee, CASE length(x.callee) % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'super' WHEN 2 THEN c.callee END AS receiver FROM e JOIN named x ON e.target = x.target LEFT JOIN owner ON owner.id = e.target LEFT JOIN (SELECT id, lower(regexp_replace(coalesce(label, ''), '^\.|\(\)$', '', 'g')) AS callee FROM n) c ON c.id = owner.class WHERE relation = 'calls'),
up AS (SELECT DISTINCT source AS c, target AS p FROM e WHERE relation = 'extends'),
chain AS (SELECT class, class AS ancestor, 0 AS distance FROM (SELECT class FROM owner UNION SELECT c FROM up) UNION SELECT class, p, distance + 1 FROM chain JOIN up ON ancestor = c WHERE distance < 60),
many AS (SELECT callee FROM named GROUP BY callee HAVING count(*) > 1),
st AS (SELECT caller, callee, class, CASE receiver WHEN 'super' THEN 1 ELSE 0 END AS least FROM raw JOIN owner ON caller = id WHERE receiver IN ('self', 'super') AND callee IN (FROM many)
  UNION SELECT caller, raw.callee, named.target, 0 FROM raw JOIN named ON named.callee = receiver WHERE receiver NOT IN ('self', 'super') AND raw.callee IN (FROM many) AND (named.target IN (SELECT class FROM owner) OR named.target IN (SELECT c FROM up))),
dist AS (SELECT class, ancestor, min(distance) AS distance FROM chain GROUP BY 1, 2),
hits AS (SELECT caller, st.callee, named.target, distance FROM st JOIN dist ON st.class = dist.class AND distance >= least JOIN owner o ON o.class = ancestor JOIN named ON named.target = o.id AND named.callee = st.callee)
SELECT DISTINCT caller, callee, target FROM (SELECT caller, callee, arg_min(target, (distance, target)) AS target FROM hits GROUP BY caller, callee
  UNION ALL SELECT caller, raw.callee, named.target FROM raw JOIN named ON named.callee = raw.callee WHERE raw.callee NOT IN (FROM many)) WHERE caller <> target""",
    "call_resolution": with_("n", "e", recursive=True) + r""", named AS (SELECT id AS target, lower(regexp_replace(coalesce(label, ''), '^\.|\(\)$', '', 'g')) AS callee FROM n WHERE callee <> ''),
raw AS (SELECT DISTINCT source AS caller, callee FROM e JOIN named ON e.target = named.target WHERE relation = 'calls'),
owner AS (SELECT target AS id, min(source) AS class FROM e WHERE relation = 'method' GROUP BY target),
up AS (SELECT DISTINCT source AS c, target AS p FROM e WHERE relation = 'extends'),
chain AS (SELECT DISTINCT class, class AS ancestor, 0 AS distance FROM owner UNION SELECT class, p, distance + 1 FROM chain JOIN up ON ancestor = c WHERE distance < 60),
several AS (SELECT caller, callee, class FROM raw JOIN owner ON caller = id WHERE callee IN (SELECT callee FROM named GROUP BY callee HAVING count(*) > 1)),
hits AS (SELECT caller, s.callee, named.target, distance FROM several s JOIN chain ON s.class = chain.class JOIN owner o ON o.class = ancestor JOIN named ON named.target = o.id AND named.callee = s.callee)
SELECT caller, callee, target FROM (SELECT caller, callee, arg_min(target, (distance, target)) AS target FROM hits GROUP BY caller, callee
  UNION ALL SELECT caller, callee, (SELECT target FROM named WHERE named.callee = raw.callee) FROM raw WHERE callee IN (SELECT callee FROM named GROUP BY callee HAVING count(*) = 1)) WHERE caller <> target""",
    "query_graph": with_("n", "e", recursive=True) + "," + _ADJ + "," + _DEG + """, q AS (SELECT id, """ + " + ".join(f"CASE WHEN contains(lower(label), '{t}') THEN 2 ELSE 0 END + CASE WHEN contains(lower(source_file), '{t}') THEN 1 ELSE 0 END" for t in ("json", "lock", "cache")) + " AS score FROM n), best AS (SELECT id FROM q WHERE score > 0 ORDER BY score DESC, id LIMIT 3),\n" + _levels(f"SELECT a, b FROM adj JOIN deg ON a = deg.id WHERE degree <= {HUB} OR a IN (SELECT id FROM best)", "SELECT id FROM best", 2) + "SELECT x.id, depth, label, source_file FROM (SELECT id, min(depth) AS depth FROM lv GROUP BY id) x JOIN n ON x.id = n.id",
    "cycles": with_("n", "e", recursive=True) + ", s AS (SELECT DISTINCT source AS a, target AS b FROM e WHERE relation IN ('calls', 'imports') AND source <> target), r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a), m AS (SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT component, count(*) AS size, array_to_string(list_sort(list(label)), ', ') AS members FROM m JOIN n ON m.id = n.id GROUP BY component",
    "file_hierarchy": with_("n") + f""", w AS (SELECT DISTINCT source_file AS f, string_split(source_file, '/') AS p FROM n WHERE source_file <> ''),
s AS (SELECT f, p, i, array_to_string(p[1:i], '/') AS path FROM (SELECT f, p, unnest(range(1, len(p))) AS i FROM w) WHERE p[i] <> 'src'),
v AS (SELECT *, lag(path) OVER (PARTITION BY f ORDER BY i) AS above, i = max(i) OVER (PARTITION BY f) AS last FROM s),
u AS (SELECT DISTINCT path, above, p[i] AS label, i FROM v),
m AS (SELECT DISTINCT regexp_replace(f, '/[^/]*$', '') AS path FROM w WHERE length(regexp_replace(f, '/[^/]*$', '')) % 10 = 0),
x AS (SELECT {R._NORM.format('u.path')} AS id, min(row(u.path, label, CASE WHEN i = 1 THEN 'document' ELSE 'code' END, CASE WHEN m.path IS NOT NULL THEN 'crate' ELSE 'module' END)) AS r FROM u LEFT JOIN m ON u.path = m.path GROUP BY 1),
z AS (SELECT {R._NORM.format('above')} AS id, {R._NORM.format('path')} AS target FROM u WHERE above IS NOT NULL
  UNION SELECT {R._NORM.format('s.path')}, n.id FROM v s JOIN n ON n.source_file = s.f AND n.source_location = 'L1' WHERE s.last)
SELECT 'node' AS part, id, r[2] AS label, r[3] AS file_type, r[4] AS norm_label, NULL AS target FROM x UNION ALL SELECT 'edge', id, NULL, NULL, NULL, target FROM z WHERE id <> target""",
    "node_neighbors": _NE + "SELECT DISTINCT target AS id, relation, 'out' AS direction FROM e WHERE source = 'runtime_log_event' UNION SELECT source, relation, 'in' FROM e WHERE target = 'runtime_log_event'",
    "compare_gaps": _GAPS + "SELECT norm, label, source_file, degree, is_public FROM g ORDER BY is_public DESC, degree DESC, norm LIMIT 200",
    "compare_priority": _GAPS + "SELECT norm, label, fan_in, priority FROM g ORDER BY is_public DESC, priority DESC, norm LIMIT 200",
    "compare_semantic": _GAPS + f""", t AS (SELECT * FROM g ORDER BY is_public DESC, degree DESC, norm LIMIT 200),
r AS (SELECT id, label, source_file, toks FROM w WHERE contains(lower(source_file), '{RIGHT}') AND len(toks) > 0),
j AS (SELECT t.norm, r.id, r.label, r.source_file, len(list_intersect(t.toks, r.toks)) / len(list_distinct(list_concat(t.toks, r.toks))) AS jaccard FROM t JOIN r ON list_has_any(t.toks, r.toks))
SELECT norm, id, label, source_file, jaccard, row_number() OVER (PARTITION BY norm ORDER BY jaccard DESC, id) AS place FROM j WHERE jaccard >= 0.5 QUALIFY place <= 3""",
    "renames": with_("n", "l") + rf""", o AS (SELECT DISTINCT linked_logical_key AS k, linked_body_hash AS h, knowledge_uuid, node_uuid FROM l WHERE NOT is_knowledge AND linked_logical_key <> '' AND node_uuid NOT IN (SELECT uuid FROM n WHERE uuid IS NOT NULL)),
p AS (SELECT *, split_part(k, '::', 1) AS f, split_part(k, '::', 2) AS lb FROM o),
m AS (SELECT id, label, body_hash, array_to_string(list_slice(string_split(source_file, '/'), -2, -1), '/') AS f FROM n),
x AS (SELECT p.knowledge_uuid, p.node_uuid, m.id, 0.4 + 0.4 * coalesce(len(list_intersect({_TOKENS.replace('label', 'p.lb')}, {_TOKENS.replace('label', 'm.label')})) / nullif(len(list_distinct(list_concat({_TOKENS.replace('label', 'p.lb')}, {_TOKENS.replace('label', 'm.label')}))), 0), 0) AS s, coalesce(p.h <> '' AND p.h = m.body_hash, false) AS b FROM p JOIN m ON p.f = m.f
  UNION ALL SELECT p.knowledge_uuid, p.node_uuid, m.id, 0.9, false FROM p JOIN m ON p.h = m.body_hash AND p.h <> '' AND p.f <> m.f),
y AS (SELECT knowledge_uuid, node_uuid, id, max(CASE WHEN b THEN greatest(s, 0.95) ELSE s END) AS score FROM x GROUP BY ALL)
SELECT knowledge_uuid, node_uuid, id, score, row_number() OVER (PARTITION BY knowledge_uuid, node_uuid ORDER BY score DESC, id) AS place FROM y WHERE score >= 0.4 QUALIFY place <= 3""",
    "query_graph_filtered": with_("n", "e", recursive=True) + "," + _ADJ + "," + _DEG + f""", sc AS (SELECT id FROM n WHERE contains(lower(source_file), '{LEFT}')), best AS (SELECT sc.id FROM sc JOIN deg ON sc.id = deg.id ORDER BY degree DESC, sc.id LIMIT 3),
lv AS (SELECT id, 0 AS depth FROM best UNION SELECT b, depth + 1 FROM lv JOIN adj ON lv.id = a JOIN deg ON deg.id = a WHERE depth < 2 AND (degree <= {HUB} OR a IN (SELECT id FROM best)) AND b IN (SELECT id FROM sc))
SELECT lv.id, min(depth) AS depth, any_value(label) AS label, any_value(source_file) AS source_file FROM lv JOIN n ON lv.id = n.id GROUP BY lv.id""",
    "compare_options": _GAPS.replace("FROM n LEFT JOIN deg", "FROM (SELECT * FROM n WHERE lower(file_type) = 'code') n LEFT JOIN deg").replace(" AND plain QUALIFY", " AND contains(lower(label), 'e') QUALIFY") + "SELECT norm, label, source_file, degree FROM g WHERE is_public AND degree >= 2 ORDER BY degree DESC, norm LIMIT 200",
    "co_changes": r"""WITH c AS (SELECT DISTINCT repo, commit_id, regexp_replace(replace(file, '\', '/'), '^(\./)+', '') AS f FROM commit_files WHERE file <> ''),
t AS (SELECT repo, f FROM (SELECT repo, f, count(*) AS n FROM c WHERE f <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, f) = 1),
m AS (SELECT *, count(*) OVER (PARTITION BY repo) AS n FROM (SELECT DISTINCT t.repo, t.f AS target, commit_id FROM t JOIN c ON t.repo = c.repo AND regexp_extract(t.f, '[^/]*$') = regexp_extract(c.f, '[^/]*$')))
SELECT m.repo, target, c.f AS file, count(*) AS commits, count(*) / any_value(n) AS weight, any_value(n) AS target_commits FROM m JOIN c ON m.repo = c.repo AND m.commit_id = c.commit_id WHERE c.f <> target AND c.f <> '' GROUP BY ALL""",
}

#: Columns of doubles, which queries and SQL both give rounded.
DOUBLES = {
    "edge_confidence": ["mean_weight", "score"],
    "cohesion": ["cohesion"],
    "compare_priority": ["priority"],
    "compare_semantic": ["jaccard"],
    "renames": ["score"],
    "co_changes": ["weight"],
    "token_benchmark": ["ratio"],
}
