"""Recall of knowledge: keyword search, scoring for a task, reasoning along links, and what comes of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.session import cut

#: Points by type, effects of link relations, damping per link, least effect, largest adjustment.
TYPE_POINTS = {"bug_pattern": 5.0, "convention": 5.0, "coupling": 5.0, "pattern": 3.0, "decision": 3.0, "lesson": 3.0, "architecture": 2.0, "domain": 2.0}
EFFECTS = {"supports": 0.3, "supported_by": 0.3, "contradicts": -0.4, "supersedes": -0.5, "superseded_by": 0.2}
DAMPING, LEAST_EFFECT, MOST_EFFECT = 0.7, 0.01, 0.3
#: Advice by type: (type, task or None, prefix, priority, priority above 0.8, category).
ADVICE = (("convention", None, "Follow: ", 7, 9, "rule"), ("bug_pattern", None, "Watch for: ", 9, 9, "hazard"), ("bug_pattern", "bugfix", "Add test for: ", 8, 8, "test"), ("bug_pattern", "review", "Add test for: ", 8, 8, "test"), ("coupling", None, "Check coupling: ", 8, 8, "coupling"), ("decision", "refactor", "Respect decision: ", 7, 7, "constraint"), ("architecture", None, "Architecture: ", 6, 6, "constraint"), ("tech_debt", "refactor", "Opportunity: address ", 5, 5, "opportunity"), ("performance", None, "Perf: watch ", 6, 6, "hazard"))


#: Titles that come to the driver at most.
MOST_TITLES = 200_000


def query_words(text: str) -> list[str]:
    return [t for t in "".join(c if c.isalnum() else " " for c in text.lower()).split() if len(t.encode()) > 2]


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + p
    return out


def recall(k: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Entries with any word of the query, title and tags counting 2, description 1.

    Entries with one of the words as a whole are the candidates; where no entry has one, all are. A query without words is
    looked for as it is; an empty query gives all.
    """
    words, low = query_words(query), query.lower()
    tags = F.transform("tags", F.lower)
    title, desc = F.lower("title"), F.lower("description")
    own = k
    if words:
        index = F.array_union(F.array_union(T.words(F.col("title"), 2), T.words(F.col("description"), 2)), F.array_union(tags, F.array(F.lower("knowledge_type"))))
        hit = F.arrays_overlap(index, F.array(*(F.lit(w) for w in words)))
        flagged = own.withColumn("_hit", F.coalesce(hit, F.lit(False)))
        any_hit = flagged.agg(F.max("_hit").alias("_any"))
        own = flagged.crossJoin(F.broadcast(any_hit)).where("_hit OR NOT _any").drop("_hit", "_any")  # one row
    if kind is not None:
        own = own.where(F.col("knowledge_type") == kind)
    if not query:
        return own.withColumn("score", F.lit(0))
    if not words:
        return own.where(F.contains(title, F.lit(low)) | F.contains(desc, F.lit(low)) | F.exists(tags, lambda t: F.contains(t, F.lit(low)))).withColumn("score", F.lit(0))
    tagged = lambda w: F.exists(tags, lambda t: F.contains(t, F.lit(w)))
    points = [F.when(F.contains(title, F.lit(w)), 2).otherwise(0) + F.when(F.contains(desc, F.lit(w)), 1).otherwise(0) + F.when(tagged(w), 2).otherwise(0) for w in words]
    return own.withColumn("score", _sum(points)).where("score > 0")


def propagate(k: DataFrame, links: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(uuid, adjustment): effects along links from the seeds, damped per step, summed and bounded."""
    conf = k.select("uuid", F.col("confidence").alias("conf"))
    steps = cut(links.where("is_knowledge").select(F.col("knowledge_uuid").alias("a"), F.col("node_uuid").alias("b"), "relation"))
    frontier = cut(seeds.select("uuid").distinct().join(conf.select("uuid"), "uuid", "left_semi"))
    seen, effects = frontier, None
    for d in range(depth):
        out = frontier.withColumnRenamed("uuid", "a").join(steps, "a").join(conf.withColumnsRenamed({"uuid": "a", "conf": "ca"}), "a", "left").join(conf.withColumnsRenamed({"uuid": "b", "conf": "cb"}), "b", "left")
        force = DAMPING ** (d + 1)
        factor = F.element_at(F.create_map(*(F.lit(x) for kv in EFFECTS.items() for x in kv)), F.col("relation"))
        weak = F.coalesce("cb", F.lit(0.5))
        effect = F.when(F.col("relation") == "depends_on", F.when(weak < 0.5, -(0.5 - weak) * force).otherwise(0.0)).otherwise(F.coalesce(F.coalesce("ca", F.lit(0.5)) * force * factor, F.lit(0.0)))
        level = cut(out.select("b", effect.alias("e")))
        own = level.where(F.abs("e") > LEAST_EFFECT).select(F.col("b").alias("uuid"), "e")
        effects = own if effects is None else effects.unionByName(own)
        frontier = cut(level.select(F.col("b").alias("uuid")).distinct().join(seen, "uuid", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    if effects is None:
        return seeds.select("uuid", F.lit(0.0).alias("adjustment")).limit(0)
    return effects.groupBy("uuid").agg(F.greatest(F.lit(-MOST_EFFECT), F.least(F.lit(MOST_EFFECT), F.sum("e"))).alias("adjustment"))


def seed_entries(links: DataFrame, node_uuids: DataFrame) -> DataFrame:
    """Entries linked to the nodes."""
    return links.where("NOT is_knowledge").join(node_uuids.select(F.col("uuid").alias("node_uuid")).distinct(), "node_uuid", "left_semi").select(F.col("knowledge_uuid").alias("uuid")).distinct()


def task_scores(k: DataFrame, links: DataFrame, question: str, files: Sequence[str], node_uuids: DataFrame, now: int, kind: str | None = None, depth: int = 3) -> DataFrame:
    """Every entry not obsolete with its eleven scores, their total, and the total after penalty and reasoning."""
    words = query_words(question)
    seeds = cut(node_uuids.select("uuid").distinct())
    n_seeds = seeds.count()
    names = [f.rsplit("/", 1)[-1] for f in files]
    project = files[0].split("/", 1)[0] if files else ""
    own = k.where("status != 'obsolete'")
    if kind is not None:
        own = own.where(F.lower("knowledge_type") == kind.lower())
    met = links.where("NOT is_knowledge").join(seeds.withColumnRenamed("uuid", "node_uuid"), "node_uuid", "left_semi").groupBy(F.col("knowledge_uuid").alias("uuid")).agg(F.countDistinct("node_uuid").alias("met"))
    own = own.join(met, "uuid", "left").join(propagate(k, links, seed_entries(links, seeds), depth), "uuid", "left")
    tagged = lambda n: F.exists("tags", lambda t: F.contains(t, F.lit(n)))
    mentions = F.lit(False)
    for n in names:
        mentions = mentions | F.contains("title", F.lit(n)) | F.contains("description", F.lit(n)) | tagged(n)
    scope = F.when(F.col("scope").isin("file", "node"), 10.0).when(F.col("scope") == "module", 5.0).otherwise(0.0) if files else F.lit(0.0)
    home = F.lit(0.0)
    if project:
        home = F.when(F.array_contains("tags", f"project:{project}") | F.contains("description", F.lit(project)) | F.contains(F.lower("title"), F.lit(project.lower())), 15.0).otherwise(0.0)
    part = lambda test: _sum([F.when(test(w), 1).otherwise(0) for w in words]) / max(1, len(words)) if words else F.lit(0.0)
    title, desc, when = F.lower("title"), F.lower("description"), F.lower("applies_when")
    kinds = F.lit(0.0)
    for t, p in TYPE_POINTS.items():
        kinds = F.when(F.col("knowledge_type") == t, p).otherwise(kinds)
    scores = {
        "s_confidence": F.coalesce("confidence", F.lit(0.0)) * 20.0,
        "s_observations": F.least(F.log(F.greatest("observations", F.lit(1)).cast("double")), F.lit(3.0)) * 3.3,
        "s_retrievals": F.least(F.log1p(F.col("fetch_count").cast("double")), F.lit(3.0)) * 3.3,
        "s_nodes": F.coalesce(F.col("met") * 30.0 / max(1, n_seeds), F.lit(0.0)),
        "s_files": F.when(mentions, 20.0).otherwise(0.0),
        "s_scope": scope + home,
        "s_applies": F.when(F.col("applies_when") != "", part(lambda w: F.contains(when, F.lit(w))) * 15.0).otherwise(0.0),
        "s_keywords": part(lambda w: F.contains(title, F.lit(w)) | F.contains(desc, F.lit(w))) * 10.0,
        "s_type": kinds,
        "s_recency": T.recency_points(now, F.greatest("last_validated_at", "updated_at", "created_at")),
    }
    own = own.withColumns(scores)
    total = _sum([F.col(c) for c in scores])
    halved = F.when(F.col("status") == "needs_review", total * 0.5).otherwise(total)
    return own.withColumns({"total": halved + F.coalesce(F.col("adjustment") * 33.0, F.lit(0.0)), "adjustment": F.coalesce("adjustment", F.lit(0.0))}).drop("met")


def diverse(scored: DataFrame, most: int, order: str = "total") -> DataFrame:
    """The best rows, without those whose title shares over 0.6 of its words with a better one kept.

    Keeping depends on all kept before, so it runs on the driver, over the best 4 x most rows, then four times as many, until
    enough are kept. Of equal titles only the best row comes there; more than MOST_TITLES other titles before enough are
    kept is an error.
    """
    spark, taken = scored.sparkSession, 4 * most
    rows = scored.select("uuid", "title", F.col(order).alias("total"))
    same = F.when(F.trim("title") != "", F.lower("title")).otherwise(F.col("uuid"))
    ranked = cut(rows.groupBy(same.alias("same")).agg(F.min(F.struct((-F.round("total", 9)).alias("o"), "uuid", "title", "total")).alias("x")).select("x.uuid", "x.title", "x.total"))
    while True:
        rows = ranked.orderBy(F.round("total", 9).desc(), "uuid").limit(taken).collect()
        kept, titles = [], []
        for r in rows:
            words = r.title.lower().split()
            close = any(words and t and sum(x in words for x in t) / max(len(t), len(words)) > 0.6 for t in titles)
            if not close:
                titles.append(words)
                kept.append((len(kept), r.uuid, r.total))
            if len(kept) == most:
                break
        if len(kept) == most or len(rows) < taken:
            return spark.createDataFrame(kept, "place int, uuid string, total double")
        taken *= 4
        if taken > MOST_TITLES:
            raise ValueError(f"fewer than {most} distinct titles among {MOST_TITLES}")


def recommendations(entries: DataFrame, task: str, conflicts: DataFrame | None = None) -> DataFrame:
    """(knowledge_uuid, action, priority, category) that follow from entries (uuid, title, knowledge_type, confidence) and conflicts."""
    rules = entries.sparkSession.createDataFrame([r for r in ADVICE if r[1] in (None, task)], "knowledge_type string, task string, prefix string, priority int, above int, category string")
    own = entries.join(F.broadcast(rules), "knowledge_type").select(F.col("uuid").alias("knowledge_uuid"), F.concat("prefix", "title").alias("action"), F.when(F.floor(F.col("confidence") * 100) > 80, F.col("above")).otherwise(F.col("priority")).alias("priority"), "category")
    if conflicts is None:
        return own
    return own.unionByName(conflicts.select(F.col("uuid_a").alias("knowledge_uuid"), F.concat(F.lit("Resolve conflict: "), "conflict_type", F.lit(" with "), "uuid_b").alias("action"), F.lit(10).alias("priority"), F.lit("conflict").alias("category")))


def context_sections(k: DataFrame, now: int, most: int) -> DataFrame:
    """(section, place, uuid): established entries, those changed within seven days, and the best of all."""
    active = k.where("status != 'obsolete'")
    number = lambda df, section, *order: df.orderBy(*order).limit(most).select(F.lit(section).alias("section"), "uuid", "title", "confidence")
    a = number(active.where("confidence > 0.8"), "established", F.col("confidence").desc(), "uuid")
    b = number(active.where(F.col("updated_at") > now - 7 * 86_400), "recent", F.col("updated_at").desc(), "uuid")
    c = number(active, "inline", F.col("confidence").desc_nulls_last(), F.col("updated_at").desc(), "uuid")
    return a.unionByName(b).unionByName(c)


def type_counts(k: DataFrame) -> DataFrame:
    return k.where("status != 'obsolete'").groupBy("knowledge_type").agg(F.count("*").alias("entries"), F.count_if(F.col("status") == "needs_review").alias("needs_review"))


def reason_in_words(scored: DataFrame) -> DataFrame:
    """Adds why an entry scores as it does."""
    parts = F.array_compact(F.array(F.when(F.col("fetch_count") > 5, F.concat(F.lit("retrieved "), F.col("fetch_count").cast("string"), F.lit("x before"))), F.when(F.col("s_nodes") > 0, "linked to code in scope"), F.when(F.col("s_files") > 0, "mentions touched file"), F.when(F.col("s_applies") > 0, "applies_when match"), F.when(F.col("s_keywords") > 0, "matches query"), F.when(F.col("s_recency") > 0, "recently active").when(F.col("s_recency") < 0, "stale"), F.when(F.col("status") == "needs_review", "needs_review penalty"), F.when(F.abs(F.col("adjustment") * 33) > 0.5, F.format_string("graph reasoning: %+.1f", F.col("adjustment") * 33))))
    return scored.withColumn("reasons", F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("high confidence"))


def token_index(k: DataFrame) -> DataFrame:
    """(token, uuid): words of title and description, tags and type; to be stored by token where recall is frequent."""
    words = F.array_union(F.array_union(T.words(F.col("title"), 2), T.words(F.col("description"), 2)), F.array_union(F.transform("tags", F.lower), F.array(F.lower("knowledge_type"))))
    return k.select(F.explode(F.array_distinct(words)).alias("token"), "uuid")


def nodes_of_files(nodes: DataFrame, files: Sequence[str]) -> DataFrame:
    """(uuid) of the nodes in files whose path holds one of the given names."""
    hit = F.lit(False)
    for f in files:
        hit = hit | F.contains("source_file", F.lit(f.rsplit("/", 1)[-1]))
    return nodes.where(hit & F.col("uuid").isNotNull()).select(F.lower(F.trim("uuid")).alias("uuid")).distinct()


def for_diff(k: DataFrame, links: DataFrame, touched: DataFrame, files: Sequence[str], now: int, most: int = 20) -> DataFrame:
    """(uuid, total, affected): scores for a change of ``files``, 20 more for entries about touched nodes (uuid)."""
    hit = seed_entries(links, touched).withColumn("bonus", F.lit(20.0))
    scored = task_scores(k, links, "", files, touched.select("uuid"), now)
    return scored.join(hit, "uuid", "left").select("uuid", "title", (F.col("total") + F.coalesce("bonus", F.lit(0.0))).alias("total"), F.col("bonus").isNotNull().alias("affected")).orderBy(F.round("total", 9).desc(), "uuid").limit(most)


def task_context(k: DataFrame, links: DataFrame, nodes: DataFrame, conflicts: DataFrame, question: str, files: Sequence[str], task: str, now: int, most: int = 10) -> dict[str, DataFrame]:
    """What to know for a task: entries, warnings about them, conflicts among them, and advice."""
    scored = cut(task_scores(k, links, question, files, nodes_of_files(nodes, files), now))
    best = cut(diverse(scored, most))
    own = scored.join(best.select("uuid"), "uuid", "left_semi")
    warnings = own.where("status = 'needs_review' OR confidence < 0.4").select("uuid", F.when(F.col("status") == "needs_review", "needs review").otherwise("low confidence").alias("warning"))
    ends = conflicts.select("uuid_a", "uuid_b", "conflict_type", F.explode(F.array("uuid_a", "uuid_b")).alias("uuid"))
    relevant = ends.join(best.select("uuid"), "uuid", "left_semi").select("uuid_a", "uuid_b", "conflict_type").distinct()
    return {"entries": best, "warnings": warnings, "conflicts": relevant, "recommendations": recommendations(own, task, relevant)}
