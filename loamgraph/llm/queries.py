"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.ids import folded, path_form
from loamgraph.llm import bpe, cooccurrence, mixing, near_duplicates, neighbors, rank_fusion, secrets, splitting
from loamgraph.session import table
from loamgraph.sources import relations as R

SCORES = {"confidence": 1.0, "recency": 1.0, "keyword_match": 1.0, "retrievals": 1.0}
INDIFFERENCE, PREFERENCE = 0.1, 0.5


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.net_flows(table(spark, d, "score_breakdown"), "query_id", "knowledge_uuid", SCORES, "scored_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.top(p1_ranking(spark, d), "query_id", "knowledge_uuid", 10).select("query_id", "knowledge_uuid")


def p1_outranking(spark: SparkSession, d: str) -> DataFrame:
    """The flows where a tenth of the percentiles' range makes no difference and half of it a full preference."""
    return rank_fusion.net_flows(table(spark, d, "score_breakdown"), "query_id", "knowledge_uuid", SCORES, "scored_at", INDIFFERENCE, PREFERENCE).withColumns({c: F.round(c, 9) for c in ("positive", "negative", "flow")})


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = near_duplicates.similar_pairs(table(spark, d, "knowledge"), "uuid", ["title", "description"], 0.6, 12, "updated_at")
    return found.select(F.col("key_a").alias("uuid_a"), F.col("key_b").alias("uuid_b"), "similarity")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pairs(spark, d).select("uuid_a", "uuid_b")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each entry with the least uuid of its group, and the links of its text to other texts."""
    return near_duplicates.components(table(spark, d, "knowledge"), "uuid", ["title", "description"], 0.6, 12, "updated_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_credentials(table(spark, d, "chunks")).select("id", "line_no").distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact_credentials(table(spark, d, "chunks"))


def p5_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every node."""
    return neighbors.neighbors(table(spark, d, "node_embeddings"), 5)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbors.neighbors(table(spark, d, "node_embeddings"), 5, 0.9)
    return near.select(F.least("node_id", "other").alias("node_a"), F.greatest("node_id", "other").alias("node_b")).distinct()


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = cooccurrence.together(table(spark, d, "commit_files"), "repo", "commit_id", path_form(F.col("file")))
    return found.withColumnsRenamed({"item_a": "file_a", "item_b": "file_b", "together": "commits", "records_a": "commits_a", "records_b": "commits_b", "records": "repo_commits"})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).select("repo", "file_a", "file_b")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def _targets(spark: SparkSession, d: str) -> dict[str, mixing.Target]:
    # A small table given by hand: a row per source.
    rows = table(spark, d, "mix_targets").select(folded(F.col("source")).alias("s"), "target_share", "max_repeats").collect()
    return mixing.read_targets([tuple(r) for r in rows])


def _p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), folded(F.col("source")).alias("source"), "text").where("source IS NOT NULL AND text != ''")


def _p9(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, mixing.Target]]:
    counted = bpe.count_tokens(_p9_documents(spark, d), "text").withColumn("members", F.array("source"))
    targets = _targets(spark, d)
    return mixing.mix(counted, targets), targets


def p9_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Each text once, under its least doc_id, as a member of all sources that hold a copy of it."""
    docs = _p9_documents(spark, d).select("id", "source", "text", F.xxhash64("text").alias("a"), F.xxhash64(F.reverse("text")).alias("b"))
    texts = docs.groupBy("a", "b").agg(F.min("id").alias("id"), F.collect_set("source").alias("members"))
    counted = bpe.count_tokens(docs.select("id", "text").join(texts.select("id", "members"), "id"), "text")
    return mixing.mix(counted, _targets(spark, d)).withColumnRenamed("id", "doc_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_p9(spark, d))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(table(spark, d, "documents"), table(spark, d, "split_limits"))


QUERIES = {"p1_found": p1_found, "p1_ranking": p1_ranking, "p1_outranking": p1_outranking, "p2_found": p2_found, "p2_pairs": p2_pairs, "p2_groups": p2_groups, "p3_found": p3_found, "p3_redacted": p3_redacted, "p5_found": p5_found, "p5_neighbors": p5_neighbors, "p6_found": p6_found, "p6_pairs": p6_pairs, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_overlaps": p9_overlaps, "p9_shares": p9_shares, "p10_pieces": p10_pieces}

_P1 = """WITH c AS (SELECT query_id, knowledge_uuid, min(scored_at), any_value(confidence) AS a, any_value(recency) AS b, any_value(keyword_match) AS k, any_value(retrievals) AS r
  FROM score_breakdown GROUP BY ALL),
w AS (SELECT query_id, knowledge_uuid, count(*) OVER (PARTITION BY query_id) AS n, """ + ", ".join(f"rank() OVER (PARTITION BY query_id ORDER BY {s} NULLS FIRST) - 1 AS {s}, count(*) OVER (PARTITION BY query_id, {s}) AS c{s}" for s in "abkr") + """ FROM c),
t AS (SELECT *, """ + ", ".join(f"sum({s}) OVER (PARTITION BY query_id ORDER BY {s}) - c{s} * {s} AS l{s}, sum({s}) OVER (PARTITION BY query_id) AS t{s}" for s in "abkr") + """ FROM w),
f AS (SELECT query_id, knowledge_uuid, CASE WHEN n > 1 THEN 4.0 * (n - 1) * (n - 1) ELSE 1 END AS scale,
  """ + " + ".join(f"{s} * {s} - l{s}" for s in "abkr") + """ AS plus,
  """ + " + ".join(f"t{s} - l{s} - c{s} * {s} - {s} * (n - {s} - c{s})" for s in "abkr") + """ AS minus FROM t)
"""
# All pairs of a query's candidates, compared one by one.
_FULL = f"least(1, greatest(0, (d - {INDIFFERENCE}) / {PREFERENCE - INDIFFERENCE}))"
_P1_PAIRS = """WITH c AS (SELECT query_id, knowledge_uuid, min(scored_at), any_value(confidence) AS a, any_value(recency) AS b, any_value(keyword_match) AS k, any_value(retrievals) AS r
  FROM score_breakdown GROUP BY ALL),
w AS (SELECT query_id, knowledge_uuid, count(*) OVER (PARTITION BY query_id) AS n, """ + ", ".join(f"rank() OVER (PARTITION BY query_id ORDER BY {s} NULLS FIRST) - 1 AS {s}" for s in "abkr") + """ FROM c),
p AS (SELECT query_id, knowledge_uuid, """ + ", ".join(f"{s} / greatest(1, n - 1) AS {s}" for s in "abkr") + """, n FROM w),
d AS (SELECT x.query_id, x.knowledge_uuid, x.n, unnest([""" + ", ".join(f"x.{s} - y.{s}" for s in "abkr") + """]) AS d FROM p x JOIN p y ON x.query_id = y.query_id AND x.knowledge_uuid <> y.knowledge_uuid),
f AS (SELECT query_id, knowledge_uuid, sum(""" + _FULL + ") / (4 * (any_value(n) - 1)) AS positive, sum(" + _FULL.replace("(d -", "(-d -") + """) / (4 * (any_value(n) - 1)) AS negative FROM d GROUP BY query_id, knowledge_uuid)
"""
_P2 = r"""WITH k AS (SELECT uuid, list_sort(list_distinct(regexp_extract_all(lower(coalesce(any_value(title), '') || ' ' || coalesce(any_value(description), '')), '[\p{L}\p{N}]+'))) AS w
  FROM knowledge WHERE uuid IS NOT NULL GROUP BY uuid),
s AS (SELECT * FROM k WHERE len(w) >= 12),
x AS (SELECT a.uuid AS uuid_a, b.uuid AS uuid_b, len(list_intersect(a.w, b.w)) AS shared, len(a.w) + len(b.w) AS total FROM s a JOIN s b ON a.uuid < b.uuid)
"""
_P6 = r"""WITH c AS (SELECT DISTINCT repo, commit_id, regexp_replace(replace(file, '\', '/'), '^(\./)+', '') AS f FROM commit_files WHERE repo IS NOT NULL AND commit_id IS NOT NULL),
d AS (SELECT * FROM c WHERE f <> ''),
n AS (SELECT repo, count(DISTINCT commit_id) AS n FROM d GROUP BY repo),
i AS (SELECT repo, f, count(*) AS k FROM d GROUP BY repo, f),
p AS (SELECT a.repo, a.f AS file_a, b.f AS file_b, count(*) AS t FROM d a JOIN d b ON a.repo = b.repo AND a.commit_id = b.commit_id AND a.f < b.f GROUP BY ALL HAVING count(*) >= 5),
x AS (SELECT p.*, ia.k AS ka, ib.k AS kb, n.n FROM p JOIN i ia ON p.repo = ia.repo AND file_a = ia.f JOIN i ib ON p.repo = ib.repo AND file_b = ib.f JOIN n ON p.repo = n.repo
  WHERE t * n.n >= 3 * ia.k * ib.k AND greatest(t / ia.k, t / ib.k) >= 0.4)
"""
_P2_GROUPS = _P2.replace("WITH k", "WITH RECURSIVE k") + """, near AS (SELECT uuid_a AS a, uuid_b AS b FROM x WHERE shared / (total - shared) >= 0.6 UNION SELECT uuid_b, uuid_a FROM x WHERE shared / (total - shared) >= 0.6),
reach AS (SELECT uuid AS a, uuid AS b FROM s UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
links AS (SELECT s.uuid, count(DISTINCT o.w) AS links FROM s JOIN near ON s.uuid = near.a JOIN s o ON o.uuid = near.b WHERE o.w <> s.w GROUP BY s.uuid)
SELECT s.uuid, g.group_key, coalesce(links, 0) AS links FROM s JOIN (SELECT a, min(b) AS group_key FROM reach GROUP BY a) g ON s.uuid = g.a LEFT JOIN links ON s.uuid = links.uuid"""
# All pairs of vectors of a model and length; the first readable row of a node counts, and its model is told apart by length.
_P5 = R.FLOATS + """, ok AS (SELECT node_id, model, dim, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT * FROM fl WHERE node_id IS NOT NULL AND model IS NOT NULL AND dim > 0 AND octet_length(vec) = 4 * dim
  AND len(list_filter(v, lambda x: isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 QUALIFY row_number() OVER (PARTITION BY node_id, model ORDER BY updated_at) = 1)),
near AS (SELECT a.node_id, a.model, b.node_id AS other, least(1, list_dot_product(a.v, b.v)) AS similarity FROM ok a JOIN ok b ON a.model = b.model AND a.dim = b.dim AND a.node_id <> b.node_id),
best AS (SELECT *, row_number() OVER (PARTITION BY model, node_id ORDER BY round(similarity, 12) DESC, other) AS place FROM near QUALIFY place <= 5)
"""
SQL = {
    "p2_groups": _P2_GROUPS,
    "p5_found": _P5 + "SELECT DISTINCT least(node_id, other) AS node_a, greatest(node_id, other) AS node_b FROM best WHERE similarity >= 0.9",
    "p5_neighbors": _P5 + "SELECT node_id, model, other, similarity, place FROM best",
    "p6_found": _P6 + "SELECT repo, file_a, file_b FROM x",
    "p6_pairs": _P6 + """SELECT repo, file_a, file_b, t AS commits, ka AS commits_a, kb AS commits_b, n AS repo_commits, t / ka AS weight_a, t / kb AS weight_b, t * n / (ka * kb) AS lift,
  (t + 0.5) * (n - ka - kb + t + 0.5) / ((ka - t + 0.5) * (kb - t + 0.5)) AS odds_ratio FROM x""",
    "p2_found": _P2 + "SELECT uuid_a, uuid_b FROM x WHERE shared / (total - shared) >= 0.6",
    "p2_pairs": _P2 + "SELECT uuid_a, uuid_b, shared / (total - shared) AS similarity FROM x WHERE shared / (total - shared) >= 0.6",
    "p1_ranking": _P1 + "SELECT query_id, knowledge_uuid, plus / scale AS positive, minus / scale AS negative, (plus - minus) / scale AS flow FROM f",
    "p1_outranking": _P1_PAIRS + "SELECT query_id, knowledge_uuid, round(positive, 9) AS positive, round(negative, 9) AS negative, round(positive - negative, 9) AS flow FROM f UNION ALL SELECT query_id, knowledge_uuid, 0, 0, 0 FROM p WHERE n = 1",
    "p1_found": _P1 + "SELECT query_id, knowledge_uuid FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (plus - minus) / scale DESC, knowledge_uuid) <= 10",
}

#: Columns of doubles, which queries and SQL both give rounded.
DOUBLES = {"p5_neighbors": ["similarity"], "p1_ranking": ["positive", "negative", "flow"], "p1_outranking": ["positive", "negative", "flow"], "p2_pairs": ["similarity"], "p6_pairs": ["weight_a", "weight_b", "lift", "odds_ratio"]}
