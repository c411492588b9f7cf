"""Stable identities of nodes over snapshots, project merges and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.session import cut
from loamgraph.sources.relations import pick

LEAST_MATCH = 0.4
#: A merge is refused from more than SHRINK_FROM nodes to less than SHRINK_TO of them.
SHRINK_FROM, SHRINK_TO = 50, 0.5


def _score(o: str, n: str) -> Column:
    c = lambda s, x: F.col(f"{s}.{x}")
    same = lambda x: F.coalesce(c(o, x) == c(n, x), F.lit(False))
    base = lambda s: T.base_name(c(s, "source_file"))
    gap = F.abs(F.coalesce(T.line_number(c(o, "source_location")), F.lit(0)) - F.coalesce(T.line_number(c(n, "source_location")), F.lit(0)))
    near = F.when(c(o, "source_location").isNull() | c(n, "source_location").isNull(), 0.0).when(gap == 0, 15.0).when(gap <= 5, 12.0).when(gap <= 20, 6.0).otherwise(0.0)
    parts = lambda s: F.filter(F.split(F.coalesce(c(s, "label"), F.lit("")), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    bodies = c(o, "body_hash").isNotNull() & c(n, "body_hash").isNotNull()
    points = (
        F.when(same("fingerprint"), 40.0).otherwise(0.0) + F.when(same("source_file"), 25.0).when((base(o) != "") & (base(o) == base(n)), 15.0).otherwise(0.0) + near + F.when(same("file_type"), 10.0).otherwise(0.0)
        + 15.0 * T.overlap(parts(o), parts(n)) + F.when(same("label"), 10.0).otherwise(0.0) + F.when(bodies, F.when(same("body_hash"), 25.0).otherwise(-15.0)).otherwise(0.0)
    )
    return points / F.when(bodies, 140.0).otherwise(115.0)


def assign(old: DataFrame, new: DataFrame, least: float = LEAST_MATCH) -> DataFrame:
    """(id, uuid, how) for every new node: by fingerprint, then id, then the best score, else fresh (a hash of the id).

    A score of LEAST_MATCH without a common fingerprint needs one of: the same body; the same file name and a common word of
    the label; the same file within five lines; the same label and type within five lines. Only nodes that agree in one of
    these are compared, so neither a word nor a file name alone is a key. ``least`` must not be lower.
    """
    if least < LEAST_MATCH:
        raise ValueError(f"least must be {LEAST_MATCH} or more")
    columns = ["id", "label", "file_type", "source_file", "source_location", "fingerprint", "body_hash"]
    o, n = cut(old.where("uuid IS NOT NULL").select(*columns, "uuid")), cut(new.select(*columns))
    by_print = n.join(o.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.max_by("uuid", "id").alias("uuid")), "fingerprint").select("id", "uuid", F.lit("fingerprint").alias("how"))
    left = n.join(by_print.select("id"), "id", "left_anti")
    by_id = left.join(o.select("id", "uuid"), "id").select("id", "uuid", F.lit("id").alias("how"))
    left = cut(left.join(by_id.select("id"), "id", "left_anti"))
    words = F.array_distinct(F.filter(F.split(F.coalesce("label", F.lit("")), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    words = F.when(F.size(words) > 0, words).otherwise(F.array("label"))
    base = T.base_name(F.col("source_file"))
    place = F.when(base != "", F.concat(F.lit("/"), base)).otherwise(F.col("source_file"))
    stretch = F.floor(F.when(F.col("source_location").isNotNull(), F.coalesce(T.line_number(F.col("source_location")), F.lit(0))) / 6)

    def blocks(beside: tuple[int, ...]) -> Column:
        """Lines within five of each other lie in one stretch of six or in neighbouring ones, which one side looks into."""
        joined = lambda kind, *parts: F.concat(F.lit(kind), *(p for x in parts for p in (x, F.lit("|"))))
        keys = [joined("b", F.col("body_hash")), *(joined(k, *p, (stretch + s).cast("string")) for s in beside for k, p in (("l", [F.col("source_file")]), ("n", [F.col("label"), F.col("file_type")])))]
        return F.explode(F.array_compact(F.concat(F.array(*keys), F.transform(words, lambda t: joined("w", place, t))))).alias("block")

    pairs = left.select(F.col("id").alias("n"), blocks((-1, 0, 1))).join(o.select(F.col("id").alias("o"), blocks((0,))), "block").select("n", "o").distinct()
    scored = pairs.join(left.alias("new"), F.col("n") == F.col("new.id")).join(o.alias("old"), F.col("o") == F.col("old.id")).select("n", "o", "old.uuid", _score("old", "new").alias("score")).where(F.col("score") >= least)
    by_score = scored.groupBy(F.col("n").alias("id")).agg(F.max_by("uuid", F.struct(F.round("score", 9), F.col("o"))).alias("uuid")).select("id", "uuid", F.lit("score").alias("how"))
    fresh = left.join(by_score.select("id"), "id", "left_anti").select("id", F.sha2("id", 256).alias("uuid"), F.lit("new").alias("how"))
    return by_print.unionByName(by_id).unionByName(by_score).unionByName(fresh)


def may_shrink(old: int, new: int, forced: bool = False) -> bool:
    """Whether a project of ``old`` nodes may be replaced by one of ``new``."""
    return forced or old <= SHRINK_FROM or new / old >= SHRINK_TO


def merge_project(all_nodes: DataFrame, new: DataFrame, project: str, forced: bool = False) -> DataFrame:
    """All nodes with those of ``project`` replaced; refused if it would shrink too much."""
    inside = F.startswith("source_file", F.lit(project.rstrip("/") + "/"))
    before, after = all_nodes.where(inside).count(), new.count()
    if not may_shrink(before, after, forced):
        raise ValueError(f"{project} would shrink from {before} to {after} nodes")
    return all_nodes.where(~inside).unionByName(new, allowMissingColumns=True)


def forget_project(nodes: DataFrame, project: str) -> DataFrame:
    return nodes.where(~F.startswith("source_file", F.lit(project.rstrip("/") + "/")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``new`` over those of ``old`` with the same keys; of several new ones the last by ``order``."""
    if order:
        new = pick(new, keys, [F.col(order).desc()])
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def prune(rows: DataFrame, keep: DataFrame, key: str = "id", prefix: str | None = None, path: str = "file_path") -> DataFrame:
    """Rows that are in ``keep``; with ``prefix``, only rows under that folder are tested."""
    if prefix is None:
        return rows.join(keep.select(key).distinct(), key, "left_semi")
    inside = F.startswith(path, F.lit(prefix.rstrip("/") + "/"))
    return rows.where(~inside).unionByName(rows.where(inside).join(keep.select(key).distinct(), key, "left_semi"))
