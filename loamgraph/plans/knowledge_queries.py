"""Queries over knowledge, links, chunks and embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.operators import chunking, diffing, graph, identity, lifecycle, recall, search
from loamgraph.session import cut, micros
from loamgraph.sources import relations as R
from loamgraph.sources.relations import with_

NOW = 1_775_000_000
QUESTION = "how does the cache overflow when a client disconnects"
FILES = ["corlaph-gate-00000/hook/a.py"]
DIFF = "--- a/x/old.py\n+++ b/x/new.py\n@@ -10,3 +10,5 @@ f\n+a\n@@ -30 +33,200 @@\n+b\n--- a/gone.rs\n+++ /dev/null\n@@ -1,900 +0,0 @@\n-c\n"


def _kl(spark: SparkSession, d: str, short: int | None = None) -> tuple[DataFrame, DataFrame]:
    return R.knowledge(spark, d, short), R.links(spark, d)


def _seeds(links: DataFrame, most: int = 5) -> DataFrame:
    """The most linked nodes."""
    own = links.where("NOT is_knowledge").groupBy(F.col("node_uuid").alias("uuid")).agg(F.count("*").alias("n"))
    return own.orderBy(F.col("n").desc(), "uuid").limit(most).select("uuid")


def recall_keyword(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall(R.knowledge(spark, d), "cache overflow").select("uuid", "score")


def recall_kind(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall(R.knowledge(spark, d), "deadlock retry", "bug_pattern").select("uuid", "score")


def recall_short(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall(R.knowledge(spark, d), "mb").select("uuid")


def reason(spark: SparkSession, d: str) -> DataFrame:
    k, l = _kl(spark, d)  # noqa: E741
    return recall.propagate(k, l, recall.seed_entries(l, _seeds(l)), 3)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    k, l = _kl(spark, d)  # noqa: E741
    return recall.task_scores(k, l, QUESTION, FILES, _seeds(l), NOW)


def recall_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("uuid", "s_confidence", "s_observations", "s_retrievals", "s_nodes", "s_files", "s_scope", "s_applies", "s_keywords", "s_type", "s_recency", "total")


def recall_for_task(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    return recall.diverse(scored, 20).join(recall.reason_in_words(scored).select("uuid", "reasons"), "uuid")


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    k, l = _kl(spark, d)  # noqa: E741
    return recall.recommendations(k.where("status = 'active'"), "review", lifecycle.conflicts(k, l))


def knowledge_types(spark: SparkSession, d: str) -> DataFrame:
    return recall.type_counts(R.knowledge(spark, d))


def knowledge_context(spark: SparkSession, d: str) -> DataFrame:
    return recall.context_sections(R.knowledge(spark, d), NOW, 10)


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.duplicates(R.knowledge(spark, d), 0.6)


def similar_to(spark: SparkSession, d: str) -> DataFrame:
    k = R.knowledge(spark, d)
    return lifecycle.similar_to(k, k.agg(F.min("uuid")).first()[0], 0.35)


def conflicts(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.conflicts(*_kl(spark, d))


def stale(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.stale(*_kl(spark, d), R.nodes(spark, d), NOW)


def health(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.health(*_kl(spark, d, lifecycle.SHORT), R.nodes(spark, d), NOW)


def orphan_links(spark: SparkSession, d: str) -> DataFrame:
    k, l = _kl(spark, d)  # noqa: E741
    return lifecycle.orphans(l, R.nodes(spark, d), k)


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """What is to be reviewed, without the entries of one scope, which are pending already."""
    k, l = _kl(spark, d, lifecycle.SHORT)  # noqa: E741
    pending = k.where("scope = 'module'").select(F.col("uuid").alias("knowledge_uuid"), F.lit(False).alias("completed"))
    return lifecycle.review_queue(k, l, R.nodes(spark, d), NOW, pending)


def knowledge_neighbors(spark: SparkSession, d: str) -> DataFrame:
    l = R.links(spark, d)  # noqa: E741
    first = l.where("is_knowledge").groupBy("knowledge_uuid").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "knowledge_uuid").first()
    return lifecycle.neighbors(l, first[0])


def thought_chain(spark: SparkSession, d: str) -> DataFrame:
    k, l = _kl(spark, d)  # noqa: E741
    own = l.where("is_knowledge").where(F.col("relation").isin(*lifecycle.CHAIN))
    return lifecycle.thought_chain(k, l, own.agg(F.min("knowledge_uuid")).first()[0])


def knowledge_bfs(spark: SparkSession, d: str) -> DataFrame:
    """(id, depth) of the entries within three links, either way, of the five entries linked most."""
    l = R.links(spark, d).where("is_knowledge")  # noqa: E741
    starts = l.groupBy(F.col("knowledge_uuid").alias("id")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "id").limit(5).select("id")
    steps = graph.adjacency(l.select(F.col("knowledge_uuid").alias("source"), F.col("node_uuid").alias("target")))
    return graph.levels(steps, starts, 3)


def auto_link_nodes(spark: SparkSession, d: str) -> DataFrame:
    k, l = _kl(spark, d)  # noqa: E741
    return lifecycle.auto_link_nodes(k, R.nodes(spark, d), l)


def auto_link_entries(spark: SparkSession, d: str) -> DataFrame:
    k, l = _kl(spark, d)  # noqa: E741
    return lifecycle.auto_link_entries(k, l, k.where("status = 'tentative'"))


def _twins(k: DataFrame) -> DataFrame:
    """Pairs of entries of the same title, each uuid once."""
    own = k.where("title != ''").groupBy("title").agg(F.min("uuid").alias("keep"), F.max("uuid").alias("absorb"))
    return own.where("keep != absorb").select("keep", "absorb")


def merged_entries(spark: SparkSession, d: str) -> DataFrame:
    k, l = _kl(spark, d)  # noqa: E741
    return lifecycle.merge(k, l, _twins(k), NOW)[0].select("uuid", "observations", "confidence", F.array_join("tags", ",").alias("tags"), "description", "evidence", "applies_when", "scope", "status", "superseded_by")


def merged_links(spark: SparkSession, d: str) -> DataFrame:
    k, l = _kl(spark, d)  # noqa: E741
    return lifecycle.merge(k, l, _twins(k), NOW)[1].select("knowledge_uuid", "node_uuid", "relation", "is_knowledge")


def fetch_bump(spark: SparkSession, d: str) -> DataFrame:
    k = R.knowledge(spark, d)
    return lifecycle.record_fetch(k, k.where("status = 'active'"), NOW).select("uuid", "fetch_count", "last_fetched", "confidence")


def reinforced(spark: SparkSession, d: str) -> DataFrame:
    k = R.knowledge(spark, d)
    return lifecycle.learn(k, k.where("knowledge_type = 'lesson'").select("uuid", "title", "knowledge_type", F.lit("again").alias("description"), F.array(F.lit("seen")).alias("tags")), NOW).select("uuid", "observations", "confidence", "description", F.array_join("tags", ",").alias("tags"))


def forgotten_kind(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.forget(*_kl(spark, d), kind="ops", below=0.7)[0].select("uuid")


def new_links(spark: SparkSession, d: str) -> DataFrame:
    """Links after each active entry of a scope was made to support the first of that scope."""
    k, l = _kl(spark, d)  # noqa: E741
    first = k.where("status = 'active' AND scope != ''").groupBy("scope").agg(F.min("uuid").alias("node_uuid"))
    news = k.where("status = 'active'").join(first, "scope").where("uuid != node_uuid").select(F.col("uuid").alias("knowledge_uuid"), "node_uuid", F.lit("supports").alias("relation"))
    return lifecycle.add_links(l, k, news).select("knowledge_uuid", "node_uuid", "relation", "is_knowledge")


def parse_diff(spark: SparkSession, d: str) -> DataFrame:
    return diffing.hunks(diffing.diffs_of(spark, [DIFF]))


def _node_diff(n: DataFrame) -> DataFrame:
    """A diff per file that has nodes: a hunk of 40 lines from its first node on."""
    own = n.where("source_file != ''").groupBy("source_file").agg(F.min(T.line_number(F.col("source_location"))).alias("a")).where("a IS NOT NULL")
    text = F.format_string("--- a/%s\n+++ b/%s\n@@ -%d,40 +%d,40 @@ x\n+y\n", "source_file", "source_file", "a", "a")
    return own.select(F.col("source_file").alias("diff"), text.alias("text"))


def diff_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = R.nodes(spark, d)
    return diffing.touched_nodes(diffing.hunks(_node_diff(n)), n)


def diff_entries(spark: SparkSession, d: str) -> DataFrame:
    return diffing.affected_entries(diff_nodes(spark, d), R.links(spark, d))


def recall_for_diff(spark: SparkSession, d: str) -> DataFrame:
    """Scores for a diff: those of its nodes and files, and 20 more for the entries about them."""
    k, l = _kl(spark, d)  # noqa: E741
    n = R.nodes(spark, d)
    file = n.where("source_file != ''").agg(F.min("source_file")).first()[0]
    touched = diffing.touched_nodes(diffing.hunks(_node_diff(n.where(F.col("source_file") == file))), n)
    return recall.for_diff(k, l, touched, [file], NOW, 20).select("uuid", "total", "affected")


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    """Of every model the 25 vectors most like that of its first node."""
    own = R.pick(R.table(spark, d, "node_embeddings").where("node_id IS NOT NULL AND model IS NOT NULL"), ["node_id", "model"], [F.col("updated_at").asc()])
    v = cut(search.unpack(own.select(F.col("node_id").alias("id"), "model", "dim", "vec")).where("v IS NOT NULL").select("id", "model", "v"))
    firsts = v.groupBy("model").agg(F.min_by("v", "id").alias("v")).collect()  # a row per model
    parts = [search.nearest(v.where(F.col("model") == r.model), r.v, 25) for r in sorted(firsts, key=lambda r: r.model)]
    return R.union_all(parts).select("model", "id", "similarity")


def attach_knowledge(spark: SparkSession, d: str) -> DataFrame:
    k, l = _kl(spark, d)  # noqa: E741
    return search.attached(semantic_topk(spark, d), R.nodes(spark, d), l, k)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of lines."""
    return R.table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.col("text").alias("content"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.windows(_files(spark, d)).select("file_path", "start_line", "end_line", "content_hash", "language")


def chunk_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The first node in each of a file's windows; the last window is that of the file's largest line."""
    n = R.nodes(spark, d)
    last = n.where("source_file != ''").groupBy(F.col("source_file").alias("file_path")).agg(F.max(T.line_number(F.col("source_location"))).alias("line")).where("line > 0")
    spans = last.select("file_path", F.explode(F.sequence(F.lit(0), F.floor((F.col("line") - 1) / 45).cast("int"))).alias("i"))
    chunks = spans.select(F.concat_ws(":", "file_path", "i").alias("id"), "file_path", (F.col("i") * 45 + 1).cast("long").alias("start_line"), (F.col("i") * 45 + 50).cast("long").alias("end_line"))
    return chunking.first_nodes(chunks, n)


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return R.nodes(spark, d).select("id", T.fingerprint(F.col("file_type"), F.col("source_file"), F.col("source_location"), F.col("body_hash")).alias("print"))


def identity_match(spark: SparkSession, d: str) -> DataFrame:
    """New nodes are the old ones with another id for methods, as after a rename of their class, and without fingerprint."""
    n = R.nodes(spark, d).withColumn("uuid", F.lower(F.trim("uuid")))
    moved = n.select(F.when(F.startswith("label", F.lit(".")), F.concat("id", F.lit("_moved"))).otherwise(F.col("id")).alias("id"), "label", "file_type", "source_file", "source_location", F.lit(None).cast("string").alias("fingerprint"), "body_hash")
    return identity.assign(n, moved)


def merge_project(spark: SparkSession, d: str) -> DataFrame:
    n = R.nodes(spark, d).select("id", "label", "source_file")
    new = n.where(F.startswith("source_file", F.lit("corlaph-gate-00000/"))).withColumn("label", F.upper("label"))
    return identity.merge_project(n, new, "corlaph-gate-00000")


def pruned_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = R.chunks(spark, d)
    return identity.prune(c, c.where("node_id IS NOT NULL"), "id", "corlaph-gate-00000").select("id")


def upserted_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = R.table(spark, d, "node_embeddings").select("node_id", "model", "dim", "updated_at")
    return identity.upsert(R.pick(e, ["node_id", "model"], [F.col("updated_at").asc()]), e, ["node_id", "model"], "updated_at")


def document_signs(spark: SparkSession, d: str) -> DataFrame:
    """Words, paper signs and the kind of knowledge of a commit message, of every document."""
    text = F.coalesce("text", F.lit(""))
    return R.table(spark, d, "documents").select("doc_id", T.word_count(text).alias("words"), T.paper_signs(text).alias("paper_signs"), T.commit_kind(F.substring_index(text, "\n", 1)).alias("commit_kind"))


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the forms of every document's text: safe label, without tags, title, without symbols, escaped for scripts and charts, as text to embed; and its date."""
    t, none = F.coalesce("text", F.lit("")), F.lit(None).cast("string")
    forms = {"safe": T.safe_label(t), "bare": T.strip_tags(t), "title": T.html_title(t), "plain": T.strip_symbols(t), "js": T.js_escaped(t), "chart": T.mermaid_escaped(t), "to_embed": search.embedding_text(F.col("lang"), none, F.col("source"), t), "site": T.url_kind(t)}
    docs = R.table(spark, d, "documents")
    return docs.select("doc_id", *(F.sha2(c, 256).alias(n) for n, c in forms.items()), T.civil_date(F.floor(micros(docs, "updated_at") / 1_000_000)).alias("day"))


def knowledge_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Entries per token of the recall index."""
    return recall.token_index(R.knowledge(spark, d)).groupBy("token").agg(F.count("*").alias("entries"))


QUERIES = {f.__name__: f for f in (
    text_forms, knowledge_tokens,
    recall_keyword, recall_kind, recall_short, reason, recall_scores, recall_for_task, recommendations, knowledge_types, knowledge_context, duplicates, similar_to, conflicts, stale, health, orphan_links, review_queue,
    knowledge_neighbors, thought_chain, knowledge_bfs, auto_link_nodes, auto_link_entries, merged_entries, merged_links, fetch_bump, reinforced, forgotten_kind, new_links, parse_diff, diff_nodes, diff_entries, recall_for_diff,
    semantic_topk, attach_knowledge, chunk_windows, chunk_nodes, fingerprints, identity_match, merge_project, pruned_chunks, upserted_embeddings, document_signs,
)}


def _w(c: str, least: int, extra: str = "") -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}{extra}]+'), lambda t: strlen(t) > {least})"


def _ov(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_filter({a}, lambda t: list_contains({b}, t))) / greatest(len({a}), len({b})) ELSE 0 END)"


def _recall(query: str, kind: str | None = None) -> str:
    words = recall.query_words(query)
    points = " + ".join(f"CASE WHEN contains(lower(title), '{w}') THEN 2 ELSE 0 END + CASE WHEN contains(lower(description), '{w}') THEN 1 ELSE 0 END + CASE WHEN len(list_filter(tags, lambda t: contains(lower(t), '{w}'))) > 0 THEN 2 ELSE 0 END" for w in words)
    hit = f"list_has_any(list_concat({_w('title', 2)}, {_w('description', 2)}, list_transform(tags, lambda t: lower(t)), [lower(knowledge_type)]), {words!r})"
    where = f" AND knowledge_type = '{kind}'" if kind else ""
    return with_("k") + f", h AS (SELECT *, {hit} AS hit FROM k), s AS (SELECT *, {points} AS score FROM h WHERE hit OR NOT (SELECT max(hit) FROM h)) SELECT uuid, score FROM s WHERE score > 0{where}"


_LIKE = f"(40.0 * {_ov('a.tw', 'b.tw')} + CASE WHEN a.knowledge_type = b.knowledge_type THEN 20.0 ELSE 0 END + 30.0 * {_ov('a.dw', 'b.dw')} + 10.0 * {_ov('a.tags', 'b.tags')}) / 100.0"
_F = f"f AS (SELECT *, {_w('title', 1)} AS tw, {_w('left(lower(description), 200)', 2)} AS dw FROM k)"
_SIM = f"sim AS (SELECT a.uuid AS uuid_a, b.uuid AS uuid_b, {_LIKE} AS similarity, a.status AS sa, b.status AS sb, a.scope AS ca, b.scope AS cb, a.knowledge_type AS ta, b.knowledge_type AS tb, lower(a.title) AS na, lower(b.title) AS nb FROM f a JOIN f b ON a.uuid < b.uuid)"
_CONFLICTS = """conf AS (SELECT uuid AS uuid_a, lower(superseded_by) AS uuid_b, 'superseded_not_obsolete' AS conflict_type FROM k WHERE superseded_by <> '' AND status <> 'obsolete' AND lower(superseded_by) IN (SELECT uuid FROM k)
UNION ALL SELECT knowledge_uuid, node_uuid, 'contradiction' FROM l WHERE is_knowledge AND relation = 'contradicts' AND knowledge_uuid IN (SELECT uuid FROM k WHERE status = 'active') AND node_uuid IN (SELECT uuid FROM k WHERE status = 'active')
UNION ALL SELECT uuid_a, uuid_b, 'scope_overlap' FROM sim WHERE sa = 'active' AND sb = 'active' AND ca <> '' AND ca = cb AND ta = tb AND ta IN ('decision', 'pattern') AND similarity > 0.4 AND similarity < 0.8)"""
_STALE = f"""v AS (SELECT uuid, min(body_hash) AS body FROM n WHERE uuid IS NOT NULL GROUP BY uuid),
s AS (SELECT knowledge_uuid AS uuid, count(*) AS total, count(v.uuid) AS alive, count_if(linked_body_hash <> '') AS checked, count_if(linked_body_hash <> '' AND coalesce(body <> linked_body_hash, false)) AS drifted FROM l LEFT JOIN v ON l.node_uuid = v.uuid WHERE NOT is_knowledge GROUP BY 1),
x AS (SELECT k.*, coalesce(total, 0) AS total, coalesce(alive, 0) AS alive, coalesce(checked, 0) AS checked, coalesce(drifted, 0) AS drifted FROM k LEFT JOIN s ON k.uuid = s.uuid WHERE status <> 'obsolete'),
y AS (SELECT *, total = 0 AND last_validated_at > 0 AND floor(({NOW} - last_validated_at) / 86400) > 90 AND status <> 'needs_review' AS aged, total > 0 AND alive = 0 AND status <> 'needs_review' AS dead,
  alive > 0 AND total > alive AND (total - alive) / total > 0.5 AND status = 'active' AS partly, total > 0 AND alive = total AND status = 'active' AND drifted > 0 AS drift, 0.2 + 0.3 * drifted / greatest(checked, 1) AS dl, CASE WHEN last_fetched > 0 THEN last_fetched ELSE created_at END AS seen FROM x),
z AS (SELECT *, aged OR dead OR partly OR (drift AND dl > 0.4) AS moved, confidence * CASE WHEN dead THEN 0.9 WHEN partly OR (drift AND dl > 0.4) THEN 0.95 ELSE 1.0 END AS new_confidence FROM y),
w AS (SELECT *, total > 0 AND status = 'active' AND NOT moved AND seen > 0 AND {NOW} > seen AND floor(({NOW} - seen) / 86400) >= 90 AS idle FROM z),
stale AS (SELECT uuid, CASE WHEN aged THEN 'not validated' WHEN dead THEN 'all nodes gone' WHEN partly THEN 'nodes gone' ELSE 'bodies changed' END AS reason, CASE WHEN aged THEN 0.3 WHEN dead THEN 1.0 WHEN partly THEN 0.7 * (total - alive) / total ELSE dl END AS staleness,
  CASE WHEN moved OR idle THEN 'needs_review' ELSE status END AS new_status, new_confidence FROM w WHERE aged OR dead OR partly OR drift UNION ALL SELECT uuid, 'not retrieved', 0.4, 'needs_review', new_confidence FROM w WHERE idle)"""
_ORPHANS = "orph AS (SELECT knowledge_uuid, node_uuid, relation, is_knowledge FROM l WHERE NOT is_knowledge AND node_uuid NOT IN (SELECT uuid FROM n WHERE uuid IS NOT NULL) UNION ALL SELECT knowledge_uuid, node_uuid, relation, is_knowledge FROM l WHERE is_knowledge AND (knowledge_uuid NOT IN (SELECT uuid FROM k) OR node_uuid NOT IN (SELECT uuid FROM k)))"
_TWINS = "tw AS (SELECT min(uuid) AS keep, max(uuid) AS absorb FROM k WHERE title <> '' GROUP BY title HAVING min(uuid) <> max(uuid))"
_EFFECT = "CASE WHEN s.relation = 'depends_on' THEN CASE WHEN coalesce(b.confidence, 0.5) < 0.5 THEN -(0.5 - coalesce(b.confidence, 0.5)) * {f} ELSE 0 END ELSE coalesce(coalesce(a.confidence, 0.5) * {f} * CASE s.relation " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in recall.EFFECTS.items()) + " END, 0) END"
_REASON = (
    "st AS (SELECT knowledge_uuid AS a, node_uuid AS b, relation FROM l WHERE is_knowledge), sn AS (SELECT node_uuid AS uuid FROM l WHERE NOT is_knowledge GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5), f0 AS (SELECT DISTINCT knowledge_uuid AS id FROM l WHERE NOT is_knowledge AND node_uuid IN (SELECT uuid FROM sn) AND knowledge_uuid IN (SELECT uuid FROM k)),\n"
    + "".join(f"e{i} AS (SELECT s.b, {_EFFECT.format(f=0.7 ** (i + 1))} AS e FROM f{i} JOIN st s ON f{i}.id = s.a LEFT JOIN k a ON s.a = a.uuid LEFT JOIN k b ON s.b = b.uuid),\nf{i + 1} AS (SELECT DISTINCT b AS id FROM e{i} WHERE " + " AND ".join(f"b NOT IN (SELECT id FROM f{j})" for j in range(i + 1)) + "),\n" for i in range(3))
    + "adj AS (SELECT b AS uuid, greatest(-0.3, least(0.3, sum(e))) AS adjustment FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2) WHERE abs(e) > 0.01 GROUP BY b)"
)
_QW = recall.query_words(QUESTION)
_PART = lambda test: "(" + " + ".join(f"CASE WHEN {test.format(w=w)} THEN 1 ELSE 0 END" for w in _QW) + f") / {len(_QW)}"
_TYPE = "CASE knowledge_type " + " ".join(f"WHEN '{t}' THEN {p}" for t, p in recall.TYPE_POINTS.items()) + " ELSE 0.0 END"
_AGE = f"floor(({NOW} - greatest(last_validated_at, updated_at, created_at)) / 86400)"
_RECENCY = f"CASE WHEN greatest(last_validated_at, updated_at, created_at) > 0 AND greatest(last_validated_at, updated_at, created_at) <= {NOW} THEN CASE WHEN {_AGE} < 7 THEN 10.0 WHEN {_AGE} < 30 THEN 5.0 WHEN {_AGE} < 90 THEN 0.0 WHEN {_AGE} < 180 THEN -5.0 ELSE -10.0 END ELSE 0.0 END"

_TOPK = R.FLOATS + """, ok AS (SELECT node_id AS id, model, v FROM (SELECT * FROM fl WHERE node_id IS NOT NULL AND model IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id, model ORDER BY updated_at) = 1) WHERE octet_length(vec) = 4 * dim AND dim > 0 AND len(list_filter(v, lambda x: isnan(x))) = 0),
q AS (SELECT model, arg_min(v, id) AS q FROM ok GROUP BY model),
sm AS (SELECT ok.model, id, CASE WHEN len(v) = len(q) AND list_dot_product(v, v) > 0 AND list_dot_product(q, q) > 0 THEN list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)) ELSE 0 END AS similarity FROM ok JOIN q ON ok.model = q.model),
top AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(similarity, 12) DESC, id) <= 25)
"""
# Scores of the change of the first file's nodes: recall_scores without words, for the touched nodes and that file.
_FOR_DIFF = (
    with_("n", "k", "l") + r""", fn AS (SELECT min(source_file) AS f FROM n WHERE source_file <> ''), m AS (SELECT uuid, source_file, regexp_extract(source_file, '[^/]*$') AS b, TRY_CAST(regexp_extract(source_location, '^L*(\d+)', 1) AS INTEGER) AS line FROM n),
h AS (SELECT regexp_extract(f, '[^/]*$') AS b, min(line) AS a FROM fn JOIN m ON source_file = f GROUP BY f), tn AS (SELECT DISTINCT m.uuid FROM h JOIN m ON h.b = m.b WHERE m.uuid IS NOT NULL AND m.b <> '' AND line BETWEEN a AND a + 44),
fx AS (SELECT regexp_extract(f, '[^/]*$') AS name, split_part(f, '/', 1) AS project FROM fn),
hit AS (SELECT DISTINCT knowledge_uuid AS uuid FROM l WHERE NOT is_knowledge AND node_uuid IN (SELECT uuid FROM tn)),
""" + _REASON.replace("sn AS (SELECT node_uuid AS uuid FROM l WHERE NOT is_knowledge GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)", "sn AS (SELECT uuid FROM tn)") + f""", met AS (SELECT knowledge_uuid AS uuid, count(DISTINCT node_uuid) AS met FROM l WHERE NOT is_knowledge AND node_uuid IN (SELECT uuid FROM sn) GROUP BY 1),
p AS (SELECT k.uuid, status, coalesce(adjustment, 0) AS adj, coalesce(confidence, 0) * 20.0 + least(ln(greatest(observations, 1)), 3.0) * 3.3 + least(ln(1 + fetch_count), 3.0) * 3.3 + coalesce(met * 30.0 / greatest(1, (SELECT count(*) FROM sn)), 0)
  + CASE WHEN contains(title, name) OR contains(description, name) OR len(list_filter(tags, lambda t: contains(t, name))) > 0 THEN 20.0 ELSE 0.0 END
  + CASE WHEN scope IN ('file', 'node') THEN 10.0 WHEN scope = 'module' THEN 5.0 ELSE 0.0 END + CASE WHEN list_contains(tags, 'project:' || project) OR contains(description, project) OR contains(lower(title), lower(project)) THEN 15.0 ELSE 0.0 END + {_TYPE} + {_RECENCY} AS s
  FROM k CROSS JOIN fx LEFT JOIN met ON k.uuid = met.uuid LEFT JOIN adj ON k.uuid = adj.uuid WHERE status <> 'obsolete'),
z AS (SELECT p.uuid, s * CASE WHEN status = 'needs_review' THEN 0.5 ELSE 1.0 END + adj * 33.0 + CASE WHEN hit.uuid IS NOT NULL THEN 20.0 ELSE 0.0 END AS total, hit.uuid IS NOT NULL AS affected FROM p LEFT JOIN hit ON p.uuid = hit.uuid)
SELECT * FROM z ORDER BY round(total, 9) DESC, uuid LIMIT 20"""
)
_PARTS = r"list_filter(regexp_split_to_array(coalesce({0}.label, ''), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_BOTH = "(m.body_hash IS NOT NULL AND o.body_hash IS NOT NULL)"
# All pairs of what neither fingerprint nor id settles, scored one by one.
_IDENTITY = with_("n") + r""", o AS (SELECT *, TRY_CAST(regexp_extract(source_location, '^L*(\d+)', 1) AS INTEGER) AS line, regexp_extract(source_file, '[^/]*$') AS base FROM n WHERE uuid IS NOT NULL),
m AS (SELECT CASE WHEN starts_with(label, '.') THEN id || '_moved' ELSE id END AS id, label, file_type, source_file, source_location, body_hash, TRY_CAST(regexp_extract(source_location, '^L*(\d+)', 1) AS INTEGER) AS line, regexp_extract(source_file, '[^/]*$') AS base FROM n),
""" + f"""by_id AS (SELECT m.id, o.uuid FROM m JOIN o ON m.id = o.id), rest AS (SELECT * FROM m WHERE id NOT IN (SELECT id FROM by_id)),
s AS (SELECT m.id, o.id AS oid, o.uuid, (CASE WHEN m.source_file = o.source_file THEN 25.0 WHEN o.base <> '' AND o.base = m.base THEN 15.0 ELSE 0 END
  + CASE WHEN m.source_location IS NULL OR o.source_location IS NULL THEN 0 WHEN abs(coalesce(m.line, 0) - coalesce(o.line, 0)) = 0 THEN 15.0 WHEN abs(coalesce(m.line, 0) - coalesce(o.line, 0)) <= 5 THEN 12.0 WHEN abs(coalesce(m.line, 0) - coalesce(o.line, 0)) <= 20 THEN 6.0 ELSE 0 END
  + CASE WHEN m.file_type = o.file_type THEN 10.0 ELSE 0 END + 15.0 * {_ov(_PARTS.format('o'), _PARTS.format('m'))} + CASE WHEN m.label = o.label THEN 10.0 ELSE 0 END
  + CASE WHEN {_BOTH} THEN CASE WHEN m.body_hash = o.body_hash THEN 25.0 ELSE -15.0 END ELSE 0 END) / CASE WHEN {_BOTH} THEN 140.0 ELSE 115.0 END AS score FROM rest m CROSS JOIN o),
b AS (SELECT id, arg_max(uuid, row(round(score, 9), oid)) AS uuid FROM s WHERE score >= 0.4 GROUP BY id)
SELECT id, uuid, 'id' AS how FROM by_id UNION ALL SELECT id, uuid, 'score' FROM b UNION ALL SELECT id, sha256(id), 'new' FROM rest WHERE id NOT IN (SELECT id FROM b)"""

SQL = {
    "recall_keyword": _recall("cache overflow"),
    "recall_kind": _recall("deadlock retry", "bug_pattern"),
    "recall_short": with_("k") + "SELECT uuid FROM k WHERE contains(lower(title), 'mb') OR contains(lower(description), 'mb') OR len(list_filter(tags, lambda t: contains(lower(t), 'mb'))) > 0",
    "reason": with_("k", "l") + "," + _REASON + " SELECT uuid, adjustment FROM adj",
    "recall_scores": with_("k", "l") + "," + _REASON + f""", met AS (SELECT knowledge_uuid AS uuid, count(DISTINCT node_uuid) AS met FROM l WHERE NOT is_knowledge AND node_uuid IN (SELECT uuid FROM sn) GROUP BY 1),
p AS (SELECT k.uuid, status, coalesce(adjustment, 0) AS adj, coalesce(confidence, 0) * 20.0 AS s_confidence, least(ln(greatest(observations, 1)), 3.0) * 3.3 AS s_observations, least(ln(1 + fetch_count), 3.0) * 3.3 AS s_retrievals, coalesce(met * 30.0 / (SELECT count(*) FROM sn), 0) AS s_nodes,
  CASE WHEN contains(title, 'a.py') OR contains(description, 'a.py') OR len(list_filter(tags, lambda t: contains(t, 'a.py'))) > 0 THEN 20.0 ELSE 0.0 END AS s_files,
  CASE WHEN scope IN ('file', 'node') THEN 10.0 WHEN scope = 'module' THEN 5.0 ELSE 0.0 END + CASE WHEN list_contains(tags, 'project:corlaph-gate-00000') OR contains(description, 'corlaph-gate-00000') OR contains(lower(title), 'corlaph-gate-00000') THEN 15.0 ELSE 0.0 END AS s_scope,
  CASE WHEN applies_when <> '' THEN 15.0 * {_PART("contains(lower(applies_when), '{w}')")} ELSE 0.0 END AS s_applies, 10.0 * {_PART("contains(lower(title), '{w}') OR contains(lower(description), '{w}')")} AS s_keywords, {_TYPE} AS s_type, {_RECENCY} AS s_recency
  FROM k LEFT JOIN met ON k.uuid = met.uuid LEFT JOIN adj ON k.uuid = adj.uuid WHERE status <> 'obsolete')
SELECT * EXCLUDE (status, adj), (s_confidence + s_observations + s_retrievals + s_nodes + s_files + s_scope + s_applies + s_keywords + s_type + s_recency) * CASE WHEN status = 'needs_review' THEN 0.5 ELSE 1.0 END + adj * 33.0 AS total FROM p""",
    "recommendations": with_("k", "l") + "," + _F + "," + _SIM + "," + _CONFLICTS + ", r(t, p, a, b, c) AS (VALUES " + ", ".join(f"('{t}', '{p}', {a}, {b}, '{c}')" for t, task, p, a, b, c in recall.ADVICE if task in (None, "review")) + ") SELECT uuid AS knowledge_uuid, p || title AS action, CASE WHEN floor(confidence * 100) > 80 THEN b ELSE a END AS priority, c AS category FROM k JOIN r ON knowledge_type = t WHERE status = 'active' UNION ALL SELECT uuid_a, 'Resolve conflict: ' || conflict_type || ' with ' || uuid_b, 10, 'conflict' FROM conf",
    "knowledge_types": with_("k") + "SELECT knowledge_type, count(*) AS entries, count_if(status = 'needs_review') AS needs_review FROM k WHERE status <> 'obsolete' GROUP BY 1",
    "knowledge_context": with_("k") + f", a AS (SELECT * FROM k WHERE status <> 'obsolete') (SELECT 'established' AS section, uuid, title, confidence FROM a WHERE confidence > 0.8 ORDER BY confidence DESC, uuid LIMIT 10) UNION ALL (SELECT 'recent', uuid, title, confidence FROM a WHERE updated_at > {NOW - 7 * 86400} ORDER BY updated_at DESC, uuid LIMIT 10) UNION ALL (SELECT 'inline', uuid, title, confidence FROM a ORDER BY confidence DESC NULLS LAST, updated_at DESC, uuid LIMIT 10)",
    "duplicates": with_("k") + "," + _F + "," + _SIM + " SELECT uuid_a, uuid_b, similarity, CASE WHEN na = nb THEN 'identical title' ELSE 'similar content (' || CAST(round(round(similarity * 100, 6)) AS INTEGER) || '%)' || CASE WHEN ta = tb THEN ', same type' ELSE '' END END AS reason FROM sim WHERE similarity >= 0.6 AND sa <> 'obsolete' AND sb <> 'obsolete'",
    "similar_to": with_("k") + "," + _F + f" SELECT b.uuid, {_LIKE} AS similarity FROM f a JOIN f b ON a.uuid <> b.uuid WHERE a.uuid = (SELECT min(uuid) FROM k) AND {_LIKE} >= 0.35 AND b.status <> 'obsolete'",
    "conflicts": with_("k", "l") + "," + _F + "," + _SIM + "," + _CONFLICTS + " SELECT * FROM conf",
    "stale": with_("n", "k", "l") + "," + _STALE + " SELECT * FROM stale",
    "health": with_("n", "k", "l") + "," + _ORPHANS + "," + _F + "," + _SIM + "," + _CONFLICTS + f""" SELECT count(*) AS total, count_if(status NOT IN ('tentative', 'needs_review', 'obsolete')) AS active, count_if(status = 'tentative') AS tentative, count_if(status = 'needs_review') AS needs_review, count_if(status = 'obsolete') AS obsolete,
  coalesce(sum(confidence), 0) / greatest(count(*), 1) AS avg_confidence, coalesce(sum(observations), 0) / greatest(count(*), 1) AS avg_observations, count_if(status = 'active' AND last_validated_at > 0 AND last_validated_at < {NOW} AND floor(({NOW} - last_validated_at) / 86400) > 90) AS validation_overdue,
  count_if(updated_at > 0 AND updated_at < {NOW} AND floor(({NOW} - updated_at) / 86400) < 7) AS changed_7d, count_if(updated_at > 0 AND updated_at < {NOW} AND floor(({NOW} - updated_at) / 86400) < 30) AS changed_30d,
  (SELECT count(*) FROM l) AS links, (SELECT count_if(NOT is_knowledge) FROM l) AS node_links, (SELECT count(*) FROM sim WHERE similarity >= 0.6 AND sa <> 'obsolete' AND sb <> 'obsolete') AS duplicate_candidates, (SELECT count(*) FROM conf) AS conflicts, (SELECT count_if(is_knowledge) FROM l) AS knowledge_links, (SELECT count_if(NOT is_knowledge) FROM orph) AS orphan_node_links, (SELECT count_if(is_knowledge) FROM orph) AS orphan_knowledge_links, (SELECT count(*) FROM n) AS nodes FROM k""",
    "orphan_links": with_("n", "k", "l") + "," + _ORPHANS + " SELECT * FROM orph",
    "review_queue": with_("n", "k", "l") + "," + _STALE + "," + _F.replace("FROM k)", "FROM k)") + "," + _SIM + "," + _CONFLICTS + ", q AS (SELECT uuid AS u, 1 AS o, 'stale: ' || reason AS reason, 7 AS priority FROM stale UNION ALL SELECT uuid_a, 2, 'conflict: ' || conflict_type, 8 FROM conf UNION ALL SELECT uuid_a, 3, 'duplicate', 5 FROM sim WHERE similarity >= 0.6 AND sa <> 'obsolete' AND sb <> 'obsolete') SELECT u AS knowledge_uuid, reason, priority FROM q WHERE u NOT IN (SELECT uuid FROM k WHERE scope = 'module') QUALIFY row_number() OVER (PARTITION BY u ORDER BY o, reason, priority) = 1",
    "knowledge_neighbors": with_("l") + ", f AS (SELECT knowledge_uuid AS u FROM l WHERE is_knowledge GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT node_uuid AS uuid, relation, 'out' AS direction FROM l WHERE is_knowledge AND knowledge_uuid = (SELECT u FROM f) UNION ALL SELECT knowledge_uuid, relation, 'in' FROM l WHERE is_knowledge AND node_uuid = (SELECT u FROM f)",
    "knowledge_bfs": with_("l", recursive=True) + ", lk AS (SELECT * FROM l WHERE is_knowledge), ad AS (SELECT knowledge_uuid AS a, node_uuid AS b FROM lk UNION SELECT node_uuid, knowledge_uuid FROM lk), st AS (SELECT knowledge_uuid AS id FROM lk GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5), lv AS (SELECT id, 0 AS depth FROM st UNION SELECT b, depth + 1 FROM lv JOIN ad ON id = a WHERE depth < 3) SELECT id, min(depth) AS depth FROM lv GROUP BY id",
    "auto_link_nodes": with_("n", "k", "l") + f", w AS (SELECT DISTINCT uuid AS u, unnest(list_concat({_w('title', 3, '_')}, {_w(chr(39).join(['split_part(description, chr(10), 1)']), 3, '_')})) AS t FROM k), m AS (SELECT DISTINCT w.u, n.id, n.uuid FROM w JOIN n ON contains(lower(label), t) WHERE uuid IS NOT NULL AND length(t) > 3), r AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM l WHERE knowledge_uuid = u AND node_uuid = uuid)) SELECT u AS knowledge_uuid, uuid AS node_uuid, row_number() OVER (PARTITION BY u ORDER BY id) AS place FROM r QUALIFY place <= 5",
    "auto_link_entries": with_("k", "l") + f""", g AS (SELECT uuid, knowledge_type, status, list_distinct({_w('title', 2, '_')}) AS tw, list_distinct({_w('left(lower(split_part(description, chr(10), 1)), 200)', 2, '_')}) AS dw, list_distinct(list_transform(tags, lambda t: lower(t))) AS gs FROM k),
x AS (SELECT a.uuid AS ka, b.uuid AS kb, """ + " + ".join(f"{w} * len(list_intersect(a.{c}, b.{c})) / greatest(len(a.{c}), len(b.{c}), 1)" for c, w in (("tw", 0.5), ("dw", 0.3), ("gs", 0.2))) + """ + CASE WHEN a.knowledge_type = b.knowledge_type THEN 0.1 ELSE 0.0 END AS score FROM g a JOIN g b ON a.uuid <> b.uuid WHERE a.status = 'tentative' AND len(a.tw) > 0 AND b.status <> 'obsolete'),
y AS (SELECT *, row_number() OVER (PARTITION BY ka ORDER BY round(score, 9) DESC, kb) AS place FROM x WHERE score >= 0.5 - 1e-9 QUALIFY place <= 3)
SELECT ka AS knowledge_uuid, kb AS node_uuid, score, place FROM y WHERE NOT EXISTS (SELECT 1 FROM l WHERE is_knowledge AND knowledge_uuid = ka AND node_uuid = kb)""",
    "merged_entries": with_("k") + "," + _TWINS + """ SELECT a.uuid, CASE WHEN b.uuid IS NOT NULL THEN a.observations + b.observations ELSE a.observations END AS observations, CASE WHEN b.uuid IS NOT NULL THEN 1 - (1 - a.confidence) * power(0.8, b.observations) ELSE a.confidence END AS confidence,
  array_to_string(CASE WHEN b.uuid IS NOT NULL THEN list_concat(a.tags, list_filter(b.tags, lambda t: NOT list_contains(a.tags, t))) ELSE a.tags END, ',') AS tags, CASE WHEN b.uuid IS NULL OR b.description = '' OR a.description = b.description THEN a.description ELSE a.description || chr(10) || '---' || chr(10) || b.description END AS description,
  CASE WHEN b.uuid IS NULL OR b.evidence = '' THEN a.evidence WHEN a.evidence = '' THEN b.evidence ELSE a.evidence || chr(10) || b.evidence END AS evidence, CASE WHEN b.uuid IS NULL OR b.applies_when = '' OR a.applies_when = b.applies_when THEN a.applies_when WHEN a.applies_when = '' THEN b.applies_when ELSE a.applies_when || ', ' || b.applies_when END AS applies_when,
  CASE WHEN b.uuid IS NOT NULL AND coalesce(list_position(['repo', 'project', 'module', 'file', 'node'], b.scope), 0) > coalesce(list_position(['repo', 'project', 'module', 'file', 'node'], a.scope), 0) THEN b.scope ELSE a.scope END AS scope, CASE WHEN h.keep IS NOT NULL THEN 'obsolete' ELSE a.status END AS status, coalesce(h.keep, a.superseded_by) AS superseded_by
FROM k a LEFT JOIN tw ON a.uuid = tw.keep LEFT JOIN k b ON tw.absorb = b.uuid LEFT JOIN tw h ON a.uuid = h.absorb""",
    "merged_links": with_("k", "l") + "," + _TWINS + ", m AS (SELECT coalesce(x.keep, knowledge_uuid) AS knowledge_uuid, CASE WHEN is_knowledge THEN coalesce(y.keep, node_uuid) ELSE node_uuid END AS node_uuid, relation, is_knowledge FROM l LEFT JOIN tw x ON knowledge_uuid = x.absorb LEFT JOIN tw y ON node_uuid = y.absorb UNION ALL SELECT keep, absorb, 'supersedes', true FROM tw) SELECT knowledge_uuid, node_uuid, relation, max(is_knowledge) AS is_knowledge FROM m WHERE NOT (is_knowledge AND knowledge_uuid = node_uuid) GROUP BY 1, 2, 3",
    "knowledge_tokens": with_("k") + f"SELECT token, count(*) AS entries FROM (SELECT uuid, unnest(list_distinct(list_concat({_w('title', 2)}, {_w('description', 2)}, list_transform(tags, lambda t: lower(t)), [lower(knowledge_type)]))) AS token FROM k) GROUP BY token",
    "text_forms": r"""WITH d AS (SELECT *, coalesce(text, '') AS t FROM documents)
SELECT doc_id, sha256(left(regexp_replace(t, '[\x00-\x1f\x7f]', '', 'g'), 256)) AS safe, sha256(trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS bare, sha256(trim(regexp_extract(t, '(?is)<title[^>]*>(.*?)</title>', 1), ' ')) AS title, sha256(regexp_replace(t, '[^\x00-\x7F\p{L}\p{N}]', '', 'g')) AS plain,
  sha256(replace(replace(replace(replace(replace(replace(t, '\', '\\'), chr(39), '\' || chr(39)), '"', '\"'), chr(10), '\n'), chr(13), '\r'), '</', '<\/')) AS js, sha256(regexp_replace(replace(t, '"', '#quot;'), '[\n\r\[\]{}|<>]', ' ', 'g')) AS chart,
  sha256(array_to_string(list_filter([trim(coalesce(lang, ''), ' '), trim(coalesce(source, ''), ' '), trim(t, ' ')], lambda x: x <> ''), chr(10))) AS to_embed,
  sha256(CASE WHEN regexp_matches(lower(t), 'twitter\.com|x\.com') THEN 'tweet' WHEN contains(lower(t), 'arxiv.org') THEN 'arxiv' WHEN contains(lower(t), 'github.com') THEN 'github' WHEN regexp_matches(lower(t), 'youtube\.com|youtu\.be') THEN 'youtube' WHEN ends_with(lower(t), '.pdf') THEN 'pdf' WHEN regexp_matches(lower(t), '\.(png|jpg|jpeg|gif|webp)$') THEN 'image' ELSE 'webpage' END) AS site,
  strftime(updated_at, '%Y-%m-%d') AS day FROM d""",
    "fetch_bump": with_("k") + f"SELECT uuid, CASE WHEN status = 'active' THEN fetch_count + 1 ELSE fetch_count END AS fetch_count, CASE WHEN status = 'active' THEN {NOW} ELSE last_fetched END AS last_fetched, CASE WHEN status = 'active' THEN least(0.95, confidence + 0.005) ELSE confidence END AS confidence FROM k",
    "reinforced": with_("k") + "SELECT uuid, CASE WHEN knowledge_type = 'lesson' THEN observations + 1 ELSE observations END AS observations, CASE WHEN knowledge_type = 'lesson' THEN 1 - (1 - confidence) * 0.8 ELSE confidence END AS confidence, CASE WHEN knowledge_type = 'lesson' THEN description || chr(10) || '---' || chr(10) || 'again' ELSE description END AS description, array_to_string(CASE WHEN knowledge_type = 'lesson' AND NOT list_contains(tags, 'seen') THEN list_append(tags, 'seen') ELSE tags END, ',') AS tags FROM k",
    "forgotten_kind": with_("k") + "SELECT uuid FROM k WHERE NOT coalesce(knowledge_type = 'ops' AND confidence < 0.7, false)",
    "new_links": with_("k", "l") + ", f AS (SELECT scope, min(uuid) AS t FROM k WHERE status = 'active' AND scope <> '' GROUP BY scope), a AS (SELECT uuid AS x, t AS y FROM k JOIN f ON k.scope = f.scope WHERE status = 'active' AND uuid <> t), n AS (SELECT x AS knowledge_uuid, y AS node_uuid, 'supports' AS relation FROM a UNION SELECT y, x, 'supported_by' FROM a) SELECT knowledge_uuid, node_uuid, relation, is_knowledge FROM l UNION ALL SELECT *, true FROM n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.knowledge_uuid = n.knowledge_uuid AND l.node_uuid = n.node_uuid AND l.relation = n.relation)",
    "parse_diff": "SELECT * FROM (VALUES (0, 'x/new.py', 'x/old.py', 10, 14, 10, 12), (0, 'x/new.py', 'x/old.py', 33, 232, 30, 30), (0, 'gone.rs', 'gone.rs', 0, 0, 1, 900)) t(diff, file, old_file, start_line, end_line, old_start_line, old_end_line)",
    "diff_nodes": with_("n") + r", m AS (SELECT id, uuid, source_file, regexp_extract(source_file, '[^/]*$') AS b, TRY_CAST(regexp_extract(source_location, '^L*(\d+)', 1) AS INTEGER) AS line FROM n), h AS (SELECT source_file AS diff, regexp_extract(source_file, '[^/]*$') AS b, min(line) AS a FROM m WHERE source_file <> '' GROUP BY 1 HAVING min(line) IS NOT NULL) SELECT DISTINCT diff, m.id, m.uuid FROM h JOIN m ON h.b = m.b WHERE m.uuid IS NOT NULL AND m.b <> '' AND line BETWEEN a AND a + 39 + 5",
    "semantic_topk": _TOPK + "SELECT model, id, similarity FROM top",
    "attach_knowledge": _TOPK.replace("WITH hx", with_("n", "k", "l") + ", hx") + "SELECT top_id.id, k.uuid, title, knowledge_type, k.confidence, relation FROM (SELECT DISTINCT id FROM top) top_id JOIN n ON n.id = top_id.id JOIN l ON l.node_uuid = n.uuid AND NOT is_knowledge JOIN k ON k.uuid = l.knowledge_uuid WHERE lower(status) <> 'obsolete'",
    "thought_chain": with_("k", "l", recursive=True) + f""", o AS (SELECT *, row(coalesce(created_at, 0), knowledge_uuid, node_uuid, relation) AS r FROM l WHERE is_knowledge AND relation IN {lifecycle.CHAIN!r}),
fw AS (SELECT knowledge_uuid AS a, arg_max(node_uuid, r) AS b, arg_max(relation, r) AS rel FROM o GROUP BY 1), bw AS (SELECT node_uuid AS b, arg_min(knowledge_uuid, r) AS a FROM o GROUP BY 1),
back AS (SELECT min(knowledge_uuid) AS u, [min(knowledge_uuid)] AS seen FROM o UNION ALL SELECT a, list_append(seen, a) FROM back JOIN bw ON u = b WHERE NOT list_contains(seen, a)),
root AS (SELECT arg_max(u, len(seen)) AS u FROM back),
go AS (SELECT 0 AS step, u, [u] AS seen FROM root UNION ALL SELECT step + 1, b, list_append(seen, b) FROM go JOIN fw ON u = a WHERE NOT list_contains(seen, b))
SELECT step, u AS uuid, coalesce(title, '') AS title, rel AS relation_to_next FROM go LEFT JOIN fw ON u = a LEFT JOIN k ON k.uuid = u""",
    "recall_for_diff": _FOR_DIFF,
    "identity_match": _IDENTITY,
    "recall_for_task": None,
    "chunk_windows": r"""WITH f AS (SELECT 'doc/' || doc_id || '.md' AS file_path, regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS ls FROM documents WHERE text <> ''),
s AS (SELECT *, unnest(range(0, greatest(CAST(ceil((len(ls) - 50) / 45) AS BIGINT), 0) + 1)) * 45 AS s FROM f), w AS (SELECT file_path, s + 1 AS start_line, least(s + 50, len(ls)) AS end_line, array_to_string(ls[s + 1:s + 50], chr(10)) AS content FROM s)
SELECT file_path, start_line, end_line, sha256(content) AS content_hash, 'markdown' AS language FROM w WHERE strlen(regexp_replace(content, '^\s+|\s+$', '', 'g')) >= 1""",
    "chunk_nodes": with_("n") + r", f AS (SELECT DISTINCT source_file AS p FROM n WHERE source_file <> ''), m AS (SELECT id, source_file, TRY_CAST(regexp_extract(source_location, '^L*(\d+)', 1) AS INTEGER) AS line FROM n), g AS (SELECT source_file AS p, max(line) AS last FROM m WHERE source_file <> '' GROUP BY 1 HAVING max(line) > 0), c AS (SELECT p, i, i * 45 + 1 AS a, i * 45 + 50 AS b FROM (SELECT p, unnest(range(0, (last - 1) // 45 + 1)) AS i FROM g)) SELECT p || ':' || i AS id, m.id AS node_id FROM c JOIN m ON p = source_file AND line BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY p, i ORDER BY line, m.id) = 1",
    "fingerprints": with_("n") + r"SELECT id, left(sha256(concat_ws('|', file_type, regexp_extract(source_file, '[^/]*$'), coalesce(source_location, ''), regexp_replace(coalesce(body_hash, ''), '\s+', '', 'g'))), 16) AS print FROM n",
    "merge_project": with_("n") + "SELECT id, CASE WHEN starts_with(source_file, 'corlaph-gate-00000/') THEN upper(label) ELSE label END AS label, source_file FROM n",
    "pruned_chunks": with_("c") + "SELECT id FROM c WHERE NOT starts_with(file_path, 'corlaph-gate-00000/') OR node_id IS NOT NULL",
    "upserted_embeddings": "SELECT node_id, model, max(dim) AS dim, max(updated_at) AS updated_at FROM node_embeddings GROUP BY node_id, model",
    "document_signs": r"WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lower(split_part(coalesce(text, ''), chr(10), 1)) AS m FROM documents) SELECT doc_id, CASE WHEN regexp_replace(t, '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\s+')) END AS words, " + " + ".join(f"CAST(regexp_matches(t, '{p}') AS INTEGER)" for p in T.PAPER_SIGNS) + " AS paper_signs, CASE WHEN regexp_matches(m, '^(merge|wip|chore)') OR strlen(m) < 15 THEN NULL WHEN regexp_matches(m, 'fix|bug|crash') THEN 'bug_pattern' WHEN regexp_matches(m, 'refactor|cleanup|simplif') THEN 'decision' WHEN regexp_matches(m, 'add') AND regexp_matches(m, 'feature|support') THEN 'architecture' WHEN regexp_matches(m, 'critical|breaking|important') THEN 'lesson' WHEN regexp_matches(m, 'convention|style|format') THEN 'convention' WHEN regexp_matches(m, 'perf|optim|speed') THEN 'performance' END AS commit_kind FROM d",
}
# The best 20, of which none shares over 0.6 of its title's words with a better one: row by row down the ranking.
SQL["recall_for_task"] = SQL["recall_scores"].replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT * EXCLUDE (status, adj), (s_conf", "SELECT * EXCLUDE (status), (s_conf").replace(",\np AS (SELECT k.uuid,", ",\np AS (SELECT k.uuid, title, fetch_count,").rsplit("\nSELECT ", 1)[0] + ",\nz AS (SELECT " + SQL["recall_scores"].rsplit("\nSELECT ", 1)[1].replace("* EXCLUDE (status, adj)", "*") + r"""),
r AS (SELECT *, row_number() OVER (ORDER BY round(total, 9) DESC, uuid) AS i, list_filter(regexp_split_to_array(lower(title), '\s+'), lambda t: t <> '') AS ws FROM z),
g AS (SELECT CAST(0 AS BIGINT) AS i, []::VARCHAR[] AS kept, []::VARCHAR[][] AS titles
  UNION ALL SELECT r.i, CASE WHEN near THEN kept ELSE list_append(kept, r.uuid) END, CASE WHEN near THEN titles ELSE list_append(titles, r.ws) END
  FROM (SELECT g.*, r2.uuid, r2.ws, r2.i AS ri, len(list_filter(titles, lambda t: len(t) > 0 AND len(r2.ws) > 0 AND len(list_filter(t, lambda w: list_contains(r2.ws, w))) / greatest(len(t), len(r2.ws)) > 0.6)) > 0 AS near FROM g JOIN r r2 ON r2.i = g.i + 1 WHERE len(kept) < 20) x JOIN r ON r.i = x.ri),
best AS (SELECT unnest(kept) AS uuid, unnest(range(0, len(kept))) AS place FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1)),
w AS (SELECT best.place, z.*, list_filter([CASE WHEN fetch_count > 5 THEN 'retrieved ' || fetch_count || 'x before' END, CASE WHEN s_nodes > 0 THEN 'linked to code in scope' END, CASE WHEN s_files > 0 THEN 'mentions touched file' END, CASE WHEN s_applies > 0 THEN 'applies_when match' END, CASE WHEN s_keywords > 0 THEN 'matches query' END,
  CASE WHEN s_recency > 0 THEN 'recently active' WHEN s_recency < 0 THEN 'stale' END, CASE WHEN status = 'needs_review' THEN 'needs_review penalty' END, CASE WHEN abs(adj * 33) > 0.5 THEN 'graph reasoning: ' || printf('%+.1f', adj * 33) END], lambda x: x IS NOT NULL) AS why FROM best JOIN z ON best.uuid = z.uuid)
SELECT place, uuid, total, CASE WHEN len(why) > 0 THEN array_to_string(why, '; ') ELSE 'high confidence' END AS reasons FROM w"""
SQL["diff_entries"] = SQL["diff_nodes"].replace(" SELECT DISTINCT diff, m.id, m.uuid", ", t AS (SELECT DISTINCT diff, m.id, m.uuid").replace("WITH n AS", with_("l") + ",\nn AS", 1) + ") SELECT DISTINCT diff, knowledge_uuid AS uuid FROM t JOIN l ON t.uuid = l.node_uuid WHERE NOT is_knowledge"
SQL = {k: v for k, v in SQL.items() if v}

#: Columns of doubles, which queries and SQL both give rounded.
DOUBLES = {
    "semantic_topk": ["similarity"],
    "attach_knowledge": ["confidence"],
    "recall_for_diff": ["total"],
    "recall_for_task": ["total"],
    "reason": ["adjustment"],
    "recall_scores": ["s_confidence", "s_observations", "s_retrievals", "s_nodes", "s_files", "s_scope", "s_applies", "s_keywords", "s_type", "s_recency", "total"],
    "knowledge_context": ["confidence"],
    "duplicates": ["similarity"],
    "similar_to": ["similarity"],
    "stale": ["staleness", "new_confidence"],
    "health": ["avg_confidence", "avg_observations"],
    "auto_link_entries": ["score"],
    "merged_entries": ["confidence"],
    "fetch_bump": ["confidence"],
    "reinforced": ["confidence"],
}

#: Columns of counts, which the SQL gives wider than the queries.
COUNTS = {
    "knowledge_types": ["needs_review"],
    "health": ["active", "tentative", "needs_review", "obsolete", "validation_overdue", "changed_7d", "changed_30d", "node_links", "duplicate_candidates", "conflicts", "knowledge_links", "orphan_node_links", "orphan_knowledge_links"],
}
