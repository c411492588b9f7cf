"""Knowledge entries over time: likeness, conflicts, staleness, health, review, links and changes.

Operators take the relations of loamgraph.sources.relations; the time of day is a parameter. What the store would
change in place is a new DataFrame here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.operators import alike
from loamgraph.session import cut, keep

DAY = 86_400
#: Relations with a counterpart, chain relations, widths of scopes from wide to narrow.
COUNTERPARTS = {"supersedes": "superseded_by", "superseded_by": "supersedes", "depends_on": "depended_by", "depended_by": "depends_on", "supports": "supported_by", "supported_by": "supports", "contradicts": "contradicts"}
CHAIN = ("leads_to", "because", "resolved_by", "therefore", "implies")
SCOPES = ("repo", "project", "module", "file", "node")
#: First characters of a description, in lower case, that likeness looks at.
SHORT = 200


def _short() -> Column:
    return F.left(F.lower("description"), F.lit(SHORT))


def _features(k: DataFrame) -> DataFrame:
    return k.withColumns({"tw": T.words(F.col("title"), 1), "dw": T.words(_short(), 2)})


def _likeness(a: str, b: str) -> Column:
    """0.4 title + 0.2 same type + 0.3 description + 0.1 tags, by shared words."""
    c = lambda s, n: F.col(f"{s}.{n}")
    same = F.when(c(a, "knowledge_type") == c(b, "knowledge_type"), 20.0).otherwise(0.0)
    return (40.0 * T.overlap(c(a, "tw"), c(b, "tw")) + same + 30.0 * T.overlap(c(a, "dw"), c(b, "dw")) + 10.0 * T.overlap(c(a, "tags"), c(b, "tags"))) / 100.0


def similar_entries(k: DataFrame, least: float, blocks: Sequence[str] = ()) -> DataFrame:
    """(uuid_a, uuid_b, similarity), uuid_a < uuid_b, at ``least`` or more; with ``blocks``, pairs that agree in these columns.

    All pairs are bounded, in matrices of packed entries (operators/alike.py): on few words nearly all pairs share some, so
    no row is made of a pair before its likeness is known. ``least`` must be above 0.3, the most of pairs that share no word.
    """
    if least <= 0.3:
        raise ValueError("least must be above 0.3")
    own = k.select("uuid", "title", _short().alias("description"), "tags", "knowledge_type", *(b for b in blocks if b != "knowledge_type"))
    lists = lambda df: _features(df).withColumnsRenamed({"tw": "t", "dw": "d", "tags": "g", "knowledge_type": "k"})
    chunks = alike.pack(own, F.to_json(F.struct(*blocks)) if blocks else None, lists)
    return alike.meet(chunks, chunks, (0.4, 0.3, 0.1, 0.2), least, lambda s: (40.0 * s[0] + 20.0 * s[3] + 30.0 * s[1] + 10.0 * s[2]) / 100.0, ordered=True)


def duplicates(k: DataFrame, least: float = 0.6) -> DataFrame:
    """(uuid_a, uuid_b, similarity, reason) of the entries, obsolete ones left out, that say much the same."""
    own = k.where("status != 'obsolete'")
    what = lambda s: own.select(F.col("uuid").alias(f"uuid_{s}"), F.lower("title").alias(f"title_{s}"), F.col("knowledge_type").alias(f"type_{s}"))
    found = similar_entries(own, least).join(what("a"), "uuid_a").join(what("b"), "uuid_b")
    share = F.round(F.round(F.col("similarity") * 100, 6)).cast("int")
    content = F.format_string("similar content (%d%%)%s", share, F.when(F.col("type_a") == F.col("type_b"), ", same type").otherwise(""))
    return found.select("uuid_a", "uuid_b", "similarity", F.when(F.col("title_a") == F.col("title_b"), "identical title").otherwise(content).alias("reason"))


def similar_to(k: DataFrame, uuid: str, least: float) -> DataFrame:
    """(uuid, similarity) of the entries like one; the one is a single broadcast row."""
    own = _features(k.where((F.col("status") != "obsolete") | (F.col("uuid") == uuid)))
    return own.alias("b").crossJoin(F.broadcast(own.where(F.col("uuid") == uuid).limit(1)).alias("a")).where("a.uuid != b.uuid").select(F.col("b.uuid").alias("uuid"), _likeness("a", "b").alias("similarity")).where(F.col("similarity") >= least)


def _judged(k: DataFrame) -> DataFrame:
    """What likeness, conflicts, staleness and health read of entries."""
    return k.select("uuid", "title", _short().alias("description"), "tags", "knowledge_type", "scope", "status", "superseded_by", "confidence", "observations", "created_at", "updated_at", "last_validated_at", "last_fetched")


def conflicts(k: DataFrame, links: DataFrame) -> DataFrame:
    """(uuid_a, uuid_b, conflict_type): superseded but not obsolete; contradicting and both active; alike within type and scope."""
    first = k.where("superseded_by != '' AND status != 'obsolete'").select(F.col("uuid").alias("uuid_a"), F.lower("superseded_by").alias("uuid_b")).join(k.select(F.col("uuid").alias("uuid_b")), "uuid_b", "left_semi").select("uuid_a", "uuid_b", F.lit("superseded_not_obsolete").alias("conflict_type"))
    active = k.where("status = 'active'").select("uuid")
    second = links.where("is_knowledge AND relation = 'contradicts'").select(F.col("knowledge_uuid").alias("uuid_a"), F.col("node_uuid").alias("uuid_b"))
    second = second.join(active.withColumnRenamed("uuid", "uuid_a"), "uuid_a", "left_semi").join(active.withColumnRenamed("uuid", "uuid_b"), "uuid_b", "left_semi").select("uuid_a", "uuid_b", F.lit("contradiction").alias("conflict_type"))
    judged = k.where("status = 'active' AND scope != '' AND knowledge_type IN ('decision', 'pattern')")
    third = similar_entries(judged, 0.4, ["scope", "knowledge_type"]).where("similarity > 0.4 AND similarity < 0.8").select("uuid_a", "uuid_b", F.lit("scope_overlap").alias("conflict_type"))
    return first.unionByName(second).unionByName(third)


def stale(k: DataFrame, links: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """(uuid, reason, staleness, new_status, new_confidence), up to two rows per entry.

    All linked nodes gone 1.0; more than half 0.7 of the share; changed bodies 0.2 to 0.5; without links not validated
    for 90 days 0.3; with links not retrieved for 90 days 0.4.
    """
    alive = nodes.where("uuid IS NOT NULL").groupBy(F.lower(F.trim("uuid")).alias("node_uuid")).agg(F.min("body_hash").alias("body"))
    l = links.where("NOT is_knowledge").join(alive.withColumn("there", F.lit(1)), "node_uuid", "left")  # noqa: E741
    checked = F.col("linked_body_hash") != ""
    sums = l.groupBy(F.col("knowledge_uuid").alias("uuid")).agg(F.count("*").alias("total"), F.count("there").alias("alive"), F.count_if(checked).alias("checked"), F.count_if(checked & F.coalesce(F.col("body") != F.col("linked_body_hash"), F.lit(False))).alias("drifted"))
    e = k.where("status != 'obsolete'").join(sums, "uuid", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total", "alive", "checked", "drifted")})
    gone, active = F.col("total") - F.col("alive"), F.col("status") == "active"
    review = F.col("status") != "needs_review"
    aged = (F.col("total") == 0) & (F.col("last_validated_at") > 0) & (F.floor((F.lit(now) - F.col("last_validated_at")) / DAY) > 90) & review
    ratio = gone / F.greatest("total", F.lit(1))
    drift = 0.2 + 0.3 * F.col("drifted") / F.greatest("checked", F.lit(1))
    all_gone = (F.col("total") > 0) & (gone == F.col("total")) & review
    partly = (F.col("alive") > 0) & (gone > 0) & (ratio > 0.5) & active
    drifted = (F.col("total") > 0) & (gone == 0) & active & (F.col("drifted") > 0)
    reason = F.when(aged, "not validated").when(all_gone, "all nodes gone").when(partly, "nodes gone").when(drifted, "bodies changed")
    level = F.when(aged, 0.3).when(all_gone, 1.0).when(partly, ratio * 0.7).when(drifted, drift)
    promoted = aged | all_gone | partly | (drifted & (drift > 0.4))
    factor = F.when(all_gone, 0.9).when(partly | (drifted & (drift > 0.4)), 0.95).otherwise(1.0)
    e = e.withColumns({"reason": reason, "staleness": level, "moved": F.coalesce(promoted, F.lit(False)), "new_confidence": F.col("confidence") * factor})
    seen = F.when(F.col("last_fetched") > 0, F.col("last_fetched")).otherwise(F.col("created_at"))
    idle = (F.col("total") > 0) & active & ~F.col("moved") & (seen > 0) & (F.lit(now) > seen) & (F.floor((F.lit(now) - seen) / DAY) >= 90)
    status = F.when(F.col("moved") | idle, "needs_review").otherwise(F.col("status")).alias("new_status")
    one = e.where("reason IS NOT NULL").select("uuid", "reason", "staleness", status, "new_confidence")
    return one.unionByName(e.where(idle).select("uuid", F.lit("not retrieved").alias("reason"), F.lit(0.4).alias("staleness"), status, "new_confidence"))


def health(k: DataFrame, links: DataFrame, nodes: DataFrame, now: int, least: float = 0.6) -> DataFrame:
    """One row of counts and means; unknown states count as active, pairs of a likeness of ``least`` as duplicates."""
    k = keep(_judged(k))
    st, days = F.col("status"), lambda c: F.floor((F.lit(now) - F.col(c)) / DAY)
    since = lambda n: F.count_if((F.col("updated_at") > 0) & (F.col("updated_at") < now) & (days("updated_at") < n))
    overdue = (st == "active") & (F.col("last_validated_at") > 0) & (F.col("last_validated_at") < now) & (days("last_validated_at") > 90)
    own = k.agg(
        F.count("*").alias("total"), F.count_if(~st.isin("tentative", "needs_review", "obsolete")).alias("active"), F.count_if(st == "tentative").alias("tentative"), F.count_if(st == "needs_review").alias("needs_review"), F.count_if(st == "obsolete").alias("obsolete"),
        (F.coalesce(F.sum("confidence"), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_confidence"), (F.coalesce(F.sum("observations"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_observations"),
        F.count_if(overdue).alias("validation_overdue"), since(7).alias("changed_7d"), since(30).alias("changed_30d"),
    )
    counts = links.agg(F.count("*").alias("links"), F.count_if(~F.col("is_knowledge")).alias("node_links"), F.count_if("is_knowledge").alias("knowledge_links"))
    likeness = similar_entries(k.where("status != 'obsolete'"), least).agg(F.count("*").alias("duplicate_candidates")).crossJoin(conflicts(k, links).agg(F.count("*").alias("conflicts")))
    lost = orphans(links, nodes, k).agg(F.count_if(~F.col("is_knowledge")).alias("orphan_node_links"), F.count_if("is_knowledge").alias("orphan_knowledge_links"))
    every = nodes.agg((F.count("uuid") + F.count_if(F.col("uuid").isNull())).alias("nodes"))  # by uuid: so it reads the shuffle of orphans
    return own.crossJoin(counts).crossJoin(lost).crossJoin(likeness).crossJoin(every)  # one row each


def orphans(links: DataFrame, nodes: DataFrame, k: DataFrame) -> DataFrame:
    """Links to nodes that are missing, and links between entries of which one is."""
    alive = nodes.where("uuid IS NOT NULL").select(F.lower(F.trim("uuid")).alias("node_uuid"))
    a = links.where("NOT is_knowledge").join(alive, "node_uuid", "left_anti")
    known = k.select(F.col("uuid").alias("u")).withColumn("there", F.lit(1))
    b = links.where("is_knowledge").join(known.withColumnsRenamed({"u": "knowledge_uuid", "there": "x"}), "knowledge_uuid", "left").join(known.withColumnsRenamed({"u": "node_uuid", "there": "y"}), "node_uuid", "left").where("x IS NULL OR y IS NULL")
    columns = ["knowledge_uuid", "node_uuid", "relation", "is_knowledge"]
    return a.select(*columns).unionByName(b.select(*columns))


def review_queue(k: DataFrame, links: DataFrame, nodes: DataFrame, now: int, pending: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """(knowledge_uuid, reason, priority): one new item per entry, of staleness before conflicts before likeness, without those pending."""
    k = keep(_judged(k))
    s = stale(k, links, nodes, now).select(F.col("uuid").alias("knowledge_uuid"), F.concat(F.lit("stale: "), "reason").alias("reason"), F.lit(7).alias("priority"), F.lit(1).alias("o"))
    c = conflicts(k, links).select(F.col("uuid_a").alias("knowledge_uuid"), F.concat(F.lit("conflict: "), "conflict_type").alias("reason"), F.lit(8).alias("priority"), F.lit(2).alias("o"))
    d = similar_entries(k.where("status != 'obsolete'"), least).select(F.col("uuid_a").alias("knowledge_uuid"), F.lit("duplicate").alias("reason"), F.lit(5).alias("priority"), F.lit(3).alias("o"))
    first = s.unionByName(c).unionByName(d).groupBy("knowledge_uuid").agg(F.min(F.struct("o", "reason", "priority")).alias("x")).select("knowledge_uuid", "x.reason", "x.priority")
    return first if pending is None else first.join(pending.where("NOT completed").select("knowledge_uuid"), "knowledge_uuid", "left_anti")


def neighbors(links: DataFrame, uuid: str) -> DataFrame:
    """(uuid, relation, direction) one link away."""
    own = links.where("is_knowledge")
    out = own.where(F.col("knowledge_uuid") == uuid).select(F.col("node_uuid").alias("uuid"), "relation", F.lit("out").alias("direction"))
    return out.unionByName(own.where(F.col("node_uuid") == uuid).select(F.col("knowledge_uuid").alias("uuid"), "relation", F.lit("in").alias("direction")))


def thought_chain(k: DataFrame, links: DataFrame, uuid: str) -> DataFrame:
    """(step, uuid, title, relation_to_next) of the chain through an entry: back along first links to its root, then along last ones.

    Links are ordered by time and key. Each step is a point lookup; a chain ends where it has no link or comes to an entry again.
    """
    own = links.where("is_knowledge").where(F.col("relation").isin(*CHAIN))
    order = F.struct(F.coalesce("created_at", F.lit(0)), "knowledge_uuid", "node_uuid", "relation")
    forward = cut(own.groupBy("knowledge_uuid").agg(F.max_by(F.struct("node_uuid", "relation"), order).alias("n")))
    backward = cut(own.groupBy("node_uuid").agg(F.min_by("knowledge_uuid", order).alias("p")))
    root, seen = uuid, {uuid}
    while (r := backward.where(F.col("node_uuid") == root).first()) and r.p not in seen:
        root = r.p
        seen.add(root)
    chain, at, seen = [], root, set()
    while at and at not in seen:
        seen.add(at)
        r = forward.where(F.col("knowledge_uuid") == at).first()
        chain.append((len(chain), at, r.n.relation if r else None))
        at = r.n.node_uuid if r else None
    steps = k.sparkSession.createDataFrame(chain, "step int, uuid string, relation_to_next string")
    return steps.join(k.select("uuid", "title"), "uuid", "left").select("step", "uuid", F.coalesce("title", F.lit("")).alias("title"), "relation_to_next")


def auto_link_nodes(k: DataFrame, nodes: DataFrame, links: DataFrame, most: int = 5) -> DataFrame:
    """(knowledge_uuid, node_uuid, place): the first nodes whose label holds a word of an entry's title or first line.

    A label holds a word that equals one of its parts, or any piece of it; the pieces of a label are indexed, so that
    words meet labels in an equality join.
    """
    first_line = F.substring_index(F.col("description"), "\n", 1)
    own = k.select("uuid", F.array_distinct(F.concat(T.words(F.col("title"), 3, "_"), T.words(first_line, 3, "_"))).alias("ws"))
    words = own.select(F.col("uuid").alias("knowledge_uuid"), F.explode("ws").alias("w"))
    # A word is bounded in length, so is the number of pieces of a label.
    vocabulary = words.select("w").distinct()
    labels = nodes.where("uuid IS NOT NULL AND label IS NOT NULL").select("id", F.lower(F.trim("uuid")).alias("node_uuid"), F.lower("label").alias("lb")).withColumn("n", F.length("lb"))
    starts = labels.where("n > 3").select("id", "node_uuid", "lb", "n", F.explode(F.sequence(F.lit(1), F.col("n") - 3)).alias("i"))
    grams = starts.select("id", "node_uuid", "lb", F.substring("lb", F.col("i"), F.lit(4)).alias("g")).distinct()
    candidates = vocabulary.where("char_length(w) > 3").select("w", F.left("w", F.lit(4)).alias("g")).join(grams, "g").where(F.contains("lb", F.col("w"))).select("w", "id", "node_uuid").distinct()
    # Of a word's nodes, an entry needs no more than ``most`` beside those it is linked to already.
    ranked = candidates.withColumn("r", F.row_number().over(W.partitionBy("w").orderBy("id")))
    linked = links.groupBy("knowledge_uuid").agg(F.countDistinct("node_uuid").alias("c"))
    wanted = words.join(linked, "knowledge_uuid", "left").withColumn("c", F.coalesce("c", F.lit(0)) + most)
    hits = wanted.join(ranked, (wanted.w == ranked.w) & (ranked.r <= wanted.c)).select("knowledge_uuid", "id", "node_uuid").distinct().join(links.select("knowledge_uuid", "node_uuid").distinct(), ["knowledge_uuid", "node_uuid"], "left_anti")
    place = F.row_number().over(W.partitionBy("knowledge_uuid").orderBy("id"))
    return hits.withColumn("place", place).where(F.col("place") <= most).select("knowledge_uuid", "node_uuid", "place")


def auto_link_entries(k: DataFrame, links: DataFrame, news: DataFrame, most: int = 3, least: float = 0.5) -> DataFrame:
    """(knowledge_uuid, node_uuid, score, place): for each new entry the most alike of those not obsolete.

    0.5 title + 0.3 first line + 0.2 tags + 0.1 same type, on sets of words. All pairs of the new and the others are
    bounded, in matrices of packed entries (operators/alike.py); a row is made of those of ``least`` only.
    """
    line = F.left(F.lower(F.substring_index(F.col("description"), "\n", 1)), F.lit(200))
    shape = lambda df: df.select("uuid", F.array_distinct(T.words(F.col("title"), 2, "_")).alias("t"), F.array_distinct(T.words(line, 2, "_")).alias("d"), F.array_distinct(F.filter(F.transform("tags", F.lower), F.isnotnull)).alias("g"), F.col("knowledge_type").alias("k"))
    a, b = alike.pack(shape(news).where("size(t) > 0")), alike.pack(shape(k.where("status != 'obsolete'")))
    scored = alike.meet(a, b, (0.5, 0.3, 0.2, 0.1), least - 1e-9, lambda s: 0.5 * s[0] + 0.3 * s[1] + 0.2 * s[2] + 0.1 * s[3], ordered=False)
    scored = scored.select(F.col("uuid_a").alias("knowledge_uuid"), F.col("uuid_b").alias("node_uuid"), F.col("similarity").alias("score"))
    place = F.row_number().over(W.partitionBy("knowledge_uuid").orderBy(F.round("score", 9).desc(), "node_uuid"))
    ranked = scored.withColumn("place", place).where(F.col("place") <= most)
    return ranked.join(links.where("is_knowledge").select("knowledge_uuid", "node_uuid").distinct(), ["knowledge_uuid", "node_uuid"], "left_anti")


def _ordered_union(a: Column, b: Column) -> Column:
    return F.concat(a, F.filter(b, lambda t: ~F.array_contains(a, t)))


def merge(k: DataFrame, links: DataFrame, pairs: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Entries and links after each (keep, absorb) of ``pairs`` (each uuid at most once); the absorbed become obsolete."""
    both = pairs.join(k.withColumnRenamed("uuid", "absorb").alias("b"), "absorb").select("keep", "absorb", F.struct("b.observations", "b.tags", "b.description", "b.evidence", "b.applies_when", "b.scope").alias("b"))
    o = k.join(both.select(F.col("keep").alias("uuid"), "b"), "uuid", "left").join(both.select(F.col("absorb").alias("uuid"), F.col("keep").alias("heir")), "uuid", "left")
    grown = F.col("b").isNotNull()
    rank = lambda c: F.array_position(F.array(*(F.lit(s) for s in SCOPES)), c)
    joined = lambda c, sep: F.when(F.col(f"b.{c}") == "", F.col(c)).when(F.col(c) == "", F.col(f"b.{c}")).when((F.col(c) == F.col(f"b.{c}")) & F.lit(c != "evidence"), F.col(c)).otherwise(F.concat(c, F.lit(sep), F.col(f"b.{c}")))
    description = F.when((F.col("b.description") == "") | (F.col("description") == F.col("b.description")), F.col("description")).otherwise(F.concat("description", F.lit("\n---\n"), F.col("b.description")))
    new = {
        "observations": F.when(grown, F.col("observations") + F.col("b.observations")).otherwise(F.col("observations")),
        "confidence": F.when(grown, T.reinforced(F.col("confidence"), F.col("b.observations"))).otherwise(F.col("confidence")),
        "tags": F.when(grown, _ordered_union(F.col("tags"), F.col("b.tags"))).otherwise(F.col("tags")),
        "description": F.when(grown, description).otherwise(F.col("description")),
        "evidence": F.when(grown, joined("evidence", "\n")).otherwise(F.col("evidence")),
        "applies_when": F.when(grown, joined("applies_when", ", ")).otherwise(F.col("applies_when")),
        "scope": F.when(grown & (rank(F.col("b.scope")) > rank(F.col("scope"))), F.col("b.scope")).otherwise(F.col("scope")),
        "updated_at": F.when(grown, F.lit(now).cast("long")).otherwise(F.col("updated_at")),
        "status": F.when(F.col("heir").isNotNull(), "obsolete").otherwise(F.col("status")),
        "superseded_by": F.coalesce("heir", "superseded_by"),
    }
    heirs = pairs.select(F.col("absorb").alias("x"), F.col("keep").alias("y"))
    moved = links.join(heirs.select(F.col("x").alias("knowledge_uuid"), F.col("y").alias("to_a")), "knowledge_uuid", "left").join(heirs.select(F.col("x").alias("node_uuid"), F.col("y").alias("to_b")), "node_uuid", "left")
    target = F.when(F.col("is_knowledge"), F.coalesce("to_b", "node_uuid")).otherwise(F.col("node_uuid"))
    source = F.coalesce("to_a", "knowledge_uuid")
    out = moved.select(source.alias("knowledge_uuid"), target.alias("node_uuid"), "relation", "is_knowledge", "created_at").where("NOT (is_knowledge AND knowledge_uuid = node_uuid)")
    extra = pairs.select(F.col("keep").alias("knowledge_uuid"), F.col("absorb").alias("node_uuid"), F.lit("supersedes").alias("relation"), F.lit(True).alias("is_knowledge"), F.lit(now).cast("long").alias("created_at"))
    return o.withColumns(new).drop("b", "heir"), out.unionByName(extra).groupBy("knowledge_uuid", "node_uuid", "relation").agg(F.max("is_knowledge").alias("is_knowledge"), F.min("created_at").alias("created_at"))


def record_fetch(k: DataFrame, uuids: DataFrame, now: int) -> DataFrame:
    """Entries after being returned by a search; a confidence above 0.95 falls to it."""
    hit = k.join(uuids.select("uuid").distinct().withColumn("hit", F.lit(True)), "uuid", "left")
    when = lambda new, c: F.when(F.col("hit"), new).otherwise(F.col(c))
    return hit.withColumns({"fetch_count": when(F.col("fetch_count") + 1, "fetch_count"), "last_fetched": when(F.lit(now).cast("long"), "last_fetched"), "confidence": when(F.least(F.lit(0.95), F.col("confidence") + 0.005), "confidence")}).drop("hit")


def learn(k: DataFrame, news: DataFrame, now: int) -> DataFrame:
    """Entries after ``news`` (uuid, title, knowledge_type, description, tags): a known uuid is reinforced, another added at 0.6."""
    n = news.select("uuid", F.struct("title", "knowledge_type", F.left("description", F.lit(2000)).alias("description"), "tags").alias("n"))
    old = k.join(n, "uuid", "left")
    grown = F.col("n").isNotNull()
    appended = F.when((F.col("n.description") == "") | (F.col("n.description") == F.col("description")), F.col("description")).otherwise(F.concat("description", F.lit("\n---\n"), F.col("n.description")))
    new = {
        "observations": F.when(grown, F.col("observations") + 1).otherwise(F.col("observations")), "confidence": F.when(grown, T.reinforced(F.col("confidence"))).otherwise(F.col("confidence")),
        "description": F.when(grown, appended).otherwise(F.col("description")), "tags": F.when(grown, _ordered_union(F.col("tags"), F.col("n.tags"))).otherwise(F.col("tags")), "updated_at": F.when(grown, F.lit(now).cast("long")).otherwise(F.col("updated_at")),
    }
    added = n.join(k.select("uuid"), "uuid", "left_anti").select("uuid", "n.*", F.lit(0.6).alias("confidence"), F.lit(1).alias("observations"), F.lit("active").alias("status"), F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"))
    return old.withColumns(new).drop("n").unionByName(added, allowMissingColumns=True)


def supersede(k: DataFrame, pairs: DataFrame, now: int) -> DataFrame:
    """Entries after (uuid, superseded) pairs: the superseded are obsolete at 0.7 of their confidence, and name their successor."""
    old = k.join(pairs.select(F.col("superseded").alias("uuid"), F.col("uuid").alias("heir")), "uuid", "left")
    hit = F.col("heir").isNotNull()
    return old.withColumns({"status": F.when(hit, "obsolete").otherwise(F.col("status")), "confidence": F.when(hit, F.col("confidence") * 0.7).otherwise(F.col("confidence")), "superseded_by": F.when(hit & (F.col("superseded_by") == ""), F.col("heir")).otherwise(F.col("superseded_by")), "updated_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))}).drop("heir")


def validate(k: DataFrame, uuids: DataFrame, now: int, note: str = "") -> DataFrame:
    hit = k.join(uuids.select("uuid").distinct().withColumn("hit", F.lit(True)), "uuid", "left")
    when = lambda new, c: F.when(F.col("hit"), new).otherwise(F.col(c))
    evidence = F.when(F.col("evidence") == "", F.lit(note)).otherwise(F.concat("evidence", F.lit("\n" + note))) if note else F.col("evidence")
    return hit.withColumns({"status": when(F.lit("active"), "status"), "last_validated_at": when(F.lit(now).cast("long"), "last_validated_at"), "updated_at": when(F.lit(now).cast("long"), "updated_at"), "evidence": when(evidence, "evidence")}).drop("hit")


def mark_obsolete(k: DataFrame, uuids: DataFrame, now: int) -> DataFrame:
    hit = k.join(uuids.select("uuid").distinct().withColumn("hit", F.lit(True)), "uuid", "left")
    return hit.withColumns({"status": F.when(F.col("hit"), "obsolete").otherwise(F.col("status")), "updated_at": F.when(F.col("hit"), F.lit(now).cast("long")).otherwise(F.col("updated_at"))}).drop("hit")


def set_evidence(k: DataFrame, given: Mapping[str, str]) -> DataFrame:
    """Evidence for entries that have none."""
    if not given:
        return k
    m = F.element_at(F.create_map(*(F.lit(x) for kv in given.items() for x in kv)), F.col("uuid"))
    return k.withColumn("evidence", F.when(F.coalesce("evidence", F.lit("")) == "", F.coalesce(m, "evidence")).otherwise(F.col("evidence")))


def add_links(links: DataFrame, k: DataFrame, news: DataFrame, both_ways: bool = True) -> DataFrame:
    """Links between entries after ``news`` (knowledge_uuid, node_uuid, relation): both must exist, known ones stay, counterparts are added."""
    known = k.select("uuid")
    own = news.join(known.withColumnRenamed("uuid", "knowledge_uuid"), "knowledge_uuid", "left_semi").join(known.withColumnRenamed("uuid", "node_uuid"), "node_uuid", "left_semi").select("knowledge_uuid", "node_uuid", "relation")
    back = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in COUNTERPARTS.items() for x in kv)), F.col("relation")), F.col("relation"))
    if both_ways:
        own = own.unionByName(own.select(F.col("node_uuid").alias("knowledge_uuid"), F.col("knowledge_uuid").alias("node_uuid"), back.alias("relation")))
    fresh = own.distinct().join(links.select("knowledge_uuid", "node_uuid", "relation"), ["knowledge_uuid", "node_uuid", "relation"], "left_anti")
    return links.unionByName(fresh.withColumn("is_knowledge", F.lit(True)), allowMissingColumns=True)


def remove_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone.select("knowledge_uuid", "node_uuid").distinct(), ["knowledge_uuid", "node_uuid"], "left_anti")


def forget(k: DataFrame, links: DataFrame, title: str = "", kind: str = "", project: str = "", below: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries and links without the entries that meet all given tests; without a test nothing goes."""
    tests = [F.contains(F.lower("title"), F.lit(title.lower()))] * bool(title) + [F.col("knowledge_type") == kind] * bool(kind) + [F.contains("description", F.lit(project))] * bool(project) + ([F.col("confidence") < below] if below is not None else [])
    if not tests:
        return k, links
    hit = tests[0]
    for t in tests[1:]:
        hit = hit & t
    hit = F.coalesce(hit, F.lit(False))
    gone = k.where(hit).select("uuid")
    return k.where(~hit), links.join(gone.withColumnRenamed("uuid", "knowledge_uuid"), "knowledge_uuid", "left_anti").join(gone.select(F.col("uuid").alias("node_uuid"), F.lit(True).alias("is_knowledge")), ["node_uuid", "is_knowledge"], "left_anti")


def knowledge_graph(k: DataFrame, links: DataFrame, start: str | None = None, depth: int = 2) -> DataFrame:
    """(uuid, title, depth, outgoing, incoming, nodes): entries within ``depth`` links of one, or all, with their links."""
    from loamgraph.operators.graph import adjacency, levels

    own = links.where("is_knowledge")
    if start is None:
        reached = k.select("uuid", F.lit(0).alias("depth"))
    else:
        steps = adjacency(own.select(F.col("knowledge_uuid").alias("source"), F.col("node_uuid").alias("target")))
        reached = levels(steps, k.where(F.col("uuid") == start).select(F.col("uuid").alias("id")), depth).withColumnRenamed("id", "uuid")
    listed = lambda df, key, other, name: df.groupBy(F.col(key).alias("uuid")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "relation", other))), "; ").alias(name))
    out = reached.join(k.select("uuid", "title"), "uuid")
    for df, key, other, name in ((own, "knowledge_uuid", "node_uuid", "outgoing"), (own, "node_uuid", "knowledge_uuid", "incoming"), (links.where("NOT is_knowledge"), "knowledge_uuid", "node_uuid", "nodes")):
        out = out.join(listed(df, key, other, name), "uuid", "left")
    return out.select("uuid", "title", "depth", *(F.coalesce(c, F.lit("")).alias(c) for c in ("outgoing", "incoming", "nodes")))


def update(k: DataFrame, uuid: str, now: int, **fields: object) -> DataFrame:
    """Entries with fields of one changed."""
    hit = F.col("uuid") == uuid
    return k.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in fields.items()} | {"updated_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))})


def link_nodes(links: DataFrame, nodes: DataFrame, uuid: str, node_uuids: Sequence[str], relation: str = "related_to", now: int = 0) -> DataFrame:
    """Links of an entry to nodes, with what the nodes are now; known ones stay."""
    own = nodes.where(F.lower(F.trim("uuid")).isin(*node_uuids)).select(F.lit(uuid).alias("knowledge_uuid"), F.lower(F.trim("uuid")).alias("node_uuid"), F.lit(relation).alias("relation"), F.lit(False).alias("is_knowledge"), F.coalesce("body_hash", F.lit("")).alias("linked_body_hash"), F.coalesce("logical_key", F.lit("")).alias("linked_logical_key"), F.lit(now).cast("long").alias("created_at"))
    fresh = own.join(links.select("knowledge_uuid", "node_uuid", "relation"), ["knowledge_uuid", "node_uuid", "relation"], "left_anti")
    return links.unionByName(fresh, allowMissingColumns=True)


def enqueue(queue: DataFrame, uuid: str, reason: str, priority: int, now: int) -> DataFrame:
    """The queue with an item, unless one of the entry is pending."""
    new = queue.sparkSession.createDataFrame([(uuid, reason, now, priority, False)], "knowledge_uuid string, reason string, created_at long, priority int, completed boolean")
    return queue.unionByName(new.join(queue.where("NOT completed").select("knowledge_uuid"), "knowledge_uuid", "left_anti").select(*new.columns))


def pending(queue: DataFrame) -> DataFrame:
    return queue.where("NOT completed").orderBy(F.col("priority").desc(), "created_at", "knowledge_uuid")


def complete(queue: DataFrame, uuid: str) -> DataFrame:
    return queue.withColumn("completed", F.col("completed") | (F.col("knowledge_uuid") == uuid))
