"""References to records that do not exist, from signed counts per key.

A change is a row of a table that came (+1) or was taken back (-1), with the version it belongs to. `settle` keeps a
ledger of facts, one per row content, each with its last operation: a fact that comes again changes nothing, one that
was removed can come again in a later version, and an older version that arrives late changes nothing either. `deltas`
says what a batch of changes does to the ledger, as rows of +1 and -1 per key, `fold` adds them to the counts: signed
numbers of references, records and deletions per key and time. As the times stay apart, no count has to be undone by
reading rows again, and changes may come in any order and number of batches. `orphans` reads the report off the counts:
keys with references that are deleted, have no record, or whose first record came after the reference.

Every row of edges with another content or time is a reference of its own, at its seen_at, and every link with another
content or created_at; exact repetitions count once (the later loaded_at of a link's repetition isn't read).

Nulls, ties and odd input: null and empty keys (also those empty in normal form) are no reference; a reference
without time has month '' and is never late; a record without time makes nothing late; of two operations on a fact in
one version, the removal holds; empty tables give no rows or change nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions.ids import folded, normal_id
from loamgraph.session import micros, month_of

KEY = ["space", "key"]
#: Columns of a fact: its kind, the two keys it holds, its time, and 128 bits of hash over its content.
FACT = ["kind", "one", "two", "us", "hash_a", "hash_b"]
#: What the two keys of each kind of fact are: space, and the field of a reference or the side of a record.
SLOTS = {
    "edge": (("node_id", "source"), ("node_id", "target")),
    "link": (("knowledge", "knowledge_uuid"), ("node_uuid", "node_uuid")),
    "entry link": (("knowledge", "knowledge_uuid"), ("knowledge", "node_uuid")),
    "node": (("node_id", ""), ("node_uuid", "")),
    "entry": (("knowledge", ""), ("knowledge", "")),
    "gone node": (("node_id", ""), ("node_uuid", "")),
    "gone entry": (("knowledge", ""), ("knowledge", "")),
}


def _facts(df: DataFrame, kind: Column, one: Column, two: Column, time: str | None, content: list[str], version: int, removed: bool) -> DataFrame:
    """Changes in their one form; a null in the content is told from any value and place."""
    us = micros(df, time) if time else F.lit(None).cast("long")
    parts = [p for c in content for p in (F.col(c).isNull(), F.col(c))]
    a, b = F.xxhash64(F.lit(1), kind, us.isNull(), us, *parts), F.xxhash64(F.lit(2), *reversed(parts), kind, us.isNull(), us)
    # The last operation is the largest; at the same version a removal is larger.
    return df.select(kind.alias("kind"), one.alias("one"), two.alias("two"), us.alias("us"), a.alias("hash_a"), b.alias("hash_b"), F.lit(2 * version + removed).cast("long").alias("op"))


def reference_changes(edges: DataFrame, links: DataFrame, version: int = 0, removed: bool = False) -> DataFrame:
    """Changes of the referring tables: their rows came, or with ``removed`` were taken back, in ``version``."""
    content = ["source", "target", "relation", "confidence", "source_file", "source_location", "weight"]
    from_edges = _facts(edges, F.lit("edge"), normal_id(F.col("source")), normal_id(F.col("target")), "seen_at", content, version, removed)
    kind = F.when(folded(F.coalesce("target_type", F.lit(""))) == "knowledge", "entry link").otherwise("link")
    return from_edges.unionByName(_facts(links, kind, folded(F.col("knowledge_uuid")), folded(F.col("node_uuid")), "created_at", ["knowledge_uuid", "node_uuid", "relation", "target_type"], version, removed))


def record_changes(nodes: DataFrame, shared_nodes: DataFrame, knowledge: DataFrame, forgotten: DataFrame, version: int = 0, removed: bool = False) -> DataFrame:
    """Changes of the tables referred to and of the log of deletions; a row taken back from the log undoes a deletion."""
    none, given = F.lit(None).cast("string"), (version, removed)
    out = _facts(knowledge, F.lit("entry"), folded(F.col("uuid")), none, "created_at", ["uuid"], *given)
    for df in (nodes, shared_nodes):
        out = out.unionByName(_facts(df, F.lit("node"), normal_id(F.col("id")), folded(F.col("uuid")), "seen_at", ["id", "uuid"], *given))
    entity = folded(F.col("entity"))
    gone = forgotten.where(entity.isin("node", "knowledge"))
    kind, of_node = F.concat(F.lit("gone "), F.when(entity == "node", "node").otherwise("entry")), entity == "node"
    return out.unionByName(_facts(gone, kind, F.when(of_node, normal_id(F.col("node_id"))), folded(F.col("item_uuid")), None, ["entity", "node_id", "item_uuid"], *given))


def settle(changes: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger after ``changes``: every fact once, with its last operation."""
    rows = changes if ledger is None else ledger.unionByName(changes)
    return rows.groupBy(*FACT).agg(F.max("op").alias("op"))


def _present(op: Column) -> Column:
    return F.coalesce((op % 2 == 0).cast("int"), F.lit(0))


def deltas(changes: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """(space, key, side, ref_field, us, n): what ``changes`` do to a ledger, +1 for what came and -1 for what went."""
    last = settle(changes)
    if ledger is None:
        moved = last.withColumn("n", _present(F.col("op")))
    else:
        before = ledger.select("hash_a", "hash_b", F.col("op").alias("was"))
        moved = last.join(before, ["hash_a", "hash_b"], "left").withColumn("n", _present(F.greatest("op", "was")) - _present(F.col("was")))
    side = F.when(F.col("kind") == "edge", "edges").when(F.col("kind").isin("link", "entry link"), "links").when(F.col("kind").startswith("gone"), "gone").otherwise("known")
    slot = lambda i, k: F.struct(F.element_at(F.create_map(*(F.lit(x) for kind, s in SLOTS.items() for x in (kind, s[i][0]))), F.col("kind")).alias("space"), F.element_at(F.create_map(*(F.lit(x) for kind, s in SLOTS.items() for x in (kind, s[i][1]))), F.col("kind")).alias("ref_field"), F.col(k).alias("key"))
    both = moved.where("n != 0").select(side.alias("side"), "us", "n", F.explode(F.array(slot(0, "one"), slot(1, "two"))).alias("r"))
    return both.where("r.key != ''").select("r.space", "r.key", "side", "r.ref_field", "us", "n")


def fold(moved: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The counts after the deltas: a signed number per key, side and time. Without earlier counts there is nothing to cancel."""
    if counts is None:
        return moved
    rows = counts.unionByName(moved)
    return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").cast("int").alias("n")).where("n != 0")


def orphans(counts: DataFrame) -> DataFrame:
    """(ref_table, ref_field, ref_key, ref_month, kind, refs), distinct; kind is deleted, missing or late.

    Partial sums are formed before the shuffle, so a key with a third of all rows arrives as a row per task and month;
    after it a key has a row per field and month at most, which bounds its window.
    """
    of_ref = F.col("side").isin("edges", "links")
    month = F.when(of_ref, F.coalesce(month_of(F.col("us")), F.lit("")))
    amount = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    place = [F.when(of_ref, F.col("side")).alias("ref_table"), F.when(of_ref, F.col("ref_field")).alias("ref_field"), month.alias("ref_month")]
    rows = counts.groupBy(*KEY, *place).agg(F.sum(F.when(of_ref, F.col("n")).otherwise(0)).alias("refs"), F.min(F.when(of_ref, F.col("us"))).alias("ref_us"), amount("known").alias("known"), amount("gone").alias("gone"), F.min(F.when(F.col("side") == "known", F.col("us"))).alias("first_us"))
    w = W.partitionBy(*KEY)
    s = rows.select(*KEY, "ref_table", "ref_field", "ref_month", "refs", "ref_us", F.sum("known").over(w).alias("known"), F.sum("gone").over(w).alias("gone"), F.min("first_us").over(w).alias("first_us")).where("refs > 0")
    kind = F.when(F.col("gone") > 0, "deleted").when(F.col("known") <= 0, "missing").when(F.col("first_us") > F.col("ref_us"), "late")
    # A key may be missing both as a node's and as an entry's.
    found = s.select("ref_table", "ref_field", F.col("key").alias("ref_key"), "ref_month", kind.alias("kind"), "refs").where("kind IS NOT NULL")
    return found.groupBy("ref_table", "ref_field", "ref_key", "ref_month", "kind").agg(F.sum("refs").alias("refs"))


def orphan_report(found: DataFrame) -> DataFrame:
    """References and distinct keys per table, field, month and kind."""
    return found.groupBy("ref_table", "ref_field", "ref_month", "kind").agg(F.count("*").alias("ref_keys"), F.sum("refs").alias("refs"))
