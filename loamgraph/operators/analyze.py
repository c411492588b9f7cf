"""Comparisons of two corpora, renames, co-change of a file, call resolution and the token benchmark."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.functions.ids import path_form
from loamgraph.operators.graph import plain_node, query_graph, with_degrees
from loamgraph.session import cut


def gaps(nodes: DataFrame, edges: DataFrame, left: str, right: str, public: str = "", least: int = 3, compose: bool = False, top: int = 50, internal_weight: float = 1.0, file_type: str = "", label: str = "", min_degree: int = 0, skip_file_nodes: bool = True, public_only: bool = False) -> DataFrame:
    """Names of the left corpus that the right one lacks.

    Of several nodes of a name a public one stands for it, then the best connected. Public ones come first, then by
    degree, or with ``compose`` by incoming edges, public ones twice. ``file_type`` restricts both sides; ``label`` (a part of
    it), ``min_degree``, ``public_only`` and ``skip_file_nodes`` (nodes of files and concepts) restrict what is reported.
    """
    if file_type:
        nodes = nodes.where(F.lower("file_type") == file_type.lower())
    own = with_degrees(nodes, edges).withColumns({"norm": T.label_norm(F.col("label")), "is_public": F.contains(F.lower("source_file"), F.lit(public.lower())) if public else F.lit(False), "path": F.lower("source_file")}).where(F.octet_length("norm") >= least)
    right_norms = own.where(F.contains("path", F.lit(right.lower()))).select("norm").distinct()
    pick = F.row_number().over(W.partitionBy("norm").orderBy(F.col("is_public").desc(), F.col("degree").desc(), "id"))
    mine = own.where(F.contains("path", F.lit(left.lower())))
    if skip_file_nodes:
        mine = mine.where(plain_node())
    if label:
        mine = mine.where(F.contains(F.lower("label"), F.lit(label.lower())))
    found = mine.withColumn("_n", pick).where("_n = 1").join(right_norms, "norm", "left_anti")
    if public_only and public:
        found = found.where("is_public")
    found = found.where(F.col("degree") >= min_degree).withColumn("priority", (F.col("fan_in") + 1) * F.when(F.col("is_public"), 2.0).otherwise(1.0))
    score = F.col("priority") if compose else F.col("degree") * F.when(F.col("is_public") | F.lit(not public), 1.0).otherwise(internal_weight)
    return found.orderBy(F.col("is_public").desc(), score.desc(), "norm").limit(top).select("norm", "label", "id", "source_file", "source_location", "degree", "fan_in", "is_public", "priority")


def gap_candidates(found: DataFrame, nodes: DataFrame, right: str, threshold: float, k: int) -> DataFrame:
    """(norm, id, label, source_file, jaccard, place): right nodes that share enough words with a gap.

    Words are joined, so only pairs that share one are formed.
    """
    a = found.select("norm", F.array_distinct(T.label_tokens(F.coalesce("label", F.lit("")))).alias("ta"))
    b = nodes.where(F.contains(F.lower("source_file"), F.lit(right.lower()))).select("id", "label", "source_file", F.array_distinct(T.label_tokens(F.coalesce("label", F.lit("")))).alias("tb"))
    n = a.select("norm", F.size("ta").alias("na"), F.explode("ta").alias("t")).join(b.select("id", F.size("tb").alias("nb"), F.explode("tb").alias("t")), "t").groupBy("norm", "id").agg(F.count("*").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    scored = n.withColumn("jaccard", F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).where(F.col("jaccard") >= threshold)
    place = F.row_number().over(W.partitionBy("norm").orderBy(F.col("jaccard").desc(), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= k).join(b.select("id", "label", "source_file"), "id").select("norm", "id", "label", "source_file", "jaccard", "place")


def renames(nodes: DataFrame, links: DataFrame, least: float, k: int) -> DataFrame:
    """(knowledge_uuid, node_uuid, id, score, place): nodes that a link to a missing node may mean now.

    In the file of the link's logical key by words of the name, 0.4 to 0.8, and with the same body 0.95 or more; in other files with the
    same body 0.9.
    """
    alive = nodes.where("uuid IS NOT NULL").select(F.lower(F.trim("uuid")).alias("node_uuid"))
    lost = links.where("NOT is_knowledge AND linked_logical_key != ''").join(alive, "node_uuid", "left_anti").select("knowledge_uuid", "node_uuid", F.substring_index("linked_logical_key", "::", 1).alias("file"), F.split_part("linked_logical_key", F.lit("::"), F.lit(2)).alias("name"), F.col("linked_body_hash").alias("hash")).distinct()
    now = nodes.select("id", "label", "body_hash", F.substring_index("source_file", "/", -2).alias("file"))
    words = T.jaccard(T.label_tokens(F.coalesce("name", F.lit(""))), T.label_tokens(F.coalesce("label", F.lit(""))))
    same = lost.join(now, "file").select("knowledge_uuid", "node_uuid", "id", (F.lit(0.4) + 0.4 * words).alias("s"), ((F.col("hash") != "") & F.coalesce(F.col("hash") == F.col("body_hash"), F.lit(False))).alias("body"))
    moved = lost.where("hash != ''").alias("l").join(now.alias("m"), (F.col("l.hash") == F.col("m.body_hash")) & (F.col("l.file") != F.col("m.file"))).select("knowledge_uuid", "node_uuid", "id", F.lit(0.9).alias("s"), F.lit(False).alias("body"))
    scored = same.unionByName(moved).groupBy("knowledge_uuid", "node_uuid", "id").agg(F.max(F.when(F.col("body"), F.greatest("s", F.lit(0.95))).otherwise(F.col("s"))).alias("score")).where(F.col("score") >= least)
    place = F.row_number().over(W.partitionBy("knowledge_uuid", "node_uuid").orderBy(F.col("score").desc(), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def co_changes(commit_files: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(repo, target, file, commits, weight, target_commits): files in the commits of each target; by default a repo's busiest file.

    A commit is the target's if it holds a file of the same base name, as after a move or under another root; the target itself
    is not listed, the other forms are.
    """
    c = commit_files.select("repo", "commit_id", path_form(F.col("file")).alias("file")).where("file != ''").distinct()
    if targets is None:
        n = c.groupBy("repo", "file").agg(F.count("*").alias("n"))
        targets = n.withColumn("_n", F.row_number().over(W.partitionBy("repo").orderBy(F.col("n").desc(), "file"))).where("_n = 1").select("repo", F.col("file").alias("target"))
    own = targets.select("repo", path_form(F.col("target")).alias("target")).where("target != ''").distinct()
    named = own.withColumn("base", T.base_name(F.col("target")))
    hit = c.select("repo", "commit_id", T.base_name(F.col("file")).alias("base")).join(named, ["repo", "base"]).select("repo", "target", "commit_id").distinct()
    totals = hit.groupBy("repo", "target").agg(F.count("*").alias("target_commits"))
    both = hit.join(c, ["repo", "commit_id"]).where("file != target").groupBy("repo", "target", "file").agg(F.count("*").alias("commits"))
    return both.join(totals, ["repo", "target"]).select("repo", "target", "file", "commits", (F.col("commits") / F.greatest("target_commits", F.lit(1))).alias("weight"), "target_commits")


def class_ancestors(edges: DataFrame) -> DataFrame:
    """(class, ancestor, distance) along extends; the class itself at 0."""
    up = cut(edges.where("relation = 'extends'").select(F.col("source").alias("c"), F.col("target").alias("p")).distinct())
    found = cut(up.select(F.explode(F.array("c", "p")).alias("class")).distinct().select("class", F.col("class").alias("ancestor"), F.lit(0).alias("distance")))
    frontier = found
    for n in count(1):
        nxt = frontier.join(up, F.col("ancestor") == F.col("c")).select("class", F.col("p").alias("ancestor"), F.lit(n).alias("distance")).distinct().join(found, ["class", "ancestor"], "left_anti")
        frontier = cut(nxt)
        if frontier.isEmpty():
            break
        # Deep hierarchies must not leave a plan of a part per level.
        found = found.unionByName(frontier) if n % 16 else cut(found.unionByName(frontier))
    return found


#: Receivers that mean the caller's own class, and its ancestors.
OWN, ABOVE = ("self", "this", "Self"), ("super", "super()")


def resolve_calls(nodes: DataFrame, edges: DataFrame, raw_calls: DataFrame | None = None) -> DataFrame:
    """(caller, callee, target): the node a call to a label means.

    A lone candidate is taken. Of several, the receiver decides: its own class means the caller's class or its nearest
    ancestor, super an ancestor only, another name the class of that label or its nearest ancestor; without a receiver, none.
    ``raw_calls`` has caller, callee (a label) and receiver; by default, and where it has no such column, calls are taken
    as of the caller's own class: the calls of ``edges``, by their target's label.
    """
    edges = cut(edges.where("relation IN ('calls', 'method', 'extends')").select("source", "target", "relation").distinct())
    named = nodes.select(F.col("id").alias("target"), F.lower(F.regexp_replace(F.coalesce("label", F.lit("")), r"^\.|\(\)$", "")).alias("callee")).where("callee != ''")
    named = cut(named)
    if raw_calls is None:
        raw_calls = edges.where("relation = 'calls'").join(named, "target").select(F.col("source").alias("caller"), "callee").distinct()
    owner = edges.where("relation = 'method'").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("class"))
    if "receiver" not in raw_calls.columns:
        raw_calls = raw_calls.withColumn("receiver", F.lit(OWN[0]))
    raw_calls = raw_calls.select("caller", F.lower("callee").alias("callee"), F.trim("receiver").alias("receiver")).distinct()
    sizes = named.groupBy("callee").agg(F.count("*").alias("n"), F.min("target").alias("only"))
    lone = raw_calls.join(sizes.where("n = 1"), "callee").select("caller", "callee", F.col("only").alias("target"))
    several = raw_calls.join(sizes.where("n > 1").select("callee"), "callee").where("receiver IS NOT NULL")
    inner = F.col("receiver").isin(*OWN, *ABOVE)
    by_owner = several.where(inner).join(owner.withColumnRenamed("id", "caller"), "caller").select("caller", "callee", "class", F.when(F.col("receiver").isin(*ABOVE), 1).otherwise(0).alias("from"))
    classes = owner.select("class").distinct().unionByName(edges.where("relation = 'extends'").select(F.col("source").alias("class"))).distinct()
    labels = classes.join(named.withColumnsRenamed({"target": "class", "callee": "receiver"}), "class")
    by_name = several.where(~inner).withColumn("receiver", F.lower("receiver")).join(labels, "receiver").select("caller", "callee", "class", F.lit(0).alias("from"))
    chain = class_ancestors(edges)
    known = by_owner.unionByName(by_name).join(chain, "class", "left").select("caller", "callee", F.coalesce("ancestor", "class").alias("holder"), F.coalesce("distance", F.lit(0)).alias("distance"), "from").where(F.col("distance") >= F.col("from"))
    methods = named.join(owner.withColumnRenamed("id", "target"), "target").select("target", "callee", F.col("class").alias("holder"))
    best = known.join(methods, ["callee", "holder"]).groupBy("caller", "callee").agg(F.min_by("target", F.struct("distance", "target")).alias("target"))
    return lone.unionByName(best).where("caller != target").distinct()


def token_benchmark(nodes: DataFrame, edges: DataFrame, questions: Sequence[str], words_per_node: int = 50) -> DataFrame:
    """(question, corpus_tokens, query_tokens, ratio): size of the corpus against that of what a question reads."""
    corpus = nodes.count() * words_per_node * 100 // 75
    rows = []
    for q in questions:
        sizes = query_graph(nodes, edges, q).agg(F.sum(F.octet_length("label") + F.octet_length("source_file"))).first()[0] or 0
        tokens = max(1, int(sizes) // 4)
        rows.append((q, corpus, tokens, round(corpus / tokens, 1)))
    return nodes.sparkSession.createDataFrame(rows, "question string, corpus_tokens long, query_tokens long, ratio double")
