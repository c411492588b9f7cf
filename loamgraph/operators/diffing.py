"""Diffs: hunks of a unified diff, the nodes they touch, and the knowledge about these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions import text as T

#: Lines below a hunk in which a node still counts as touched.
BELOW = 5


def hunks(diffs: DataFrame) -> DataFrame:
    """(diff, file, old_file, start_line, end_line, old_start_line, old_end_line) of (diff, text)."""
    lines = diffs.select("diff", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    old = F.when(F.startswith("line", F.lit("--- a/")), F.substr("line", F.lit(7)))
    new = F.when(F.startswith("line", F.lit("+++ b/")), F.substr("line", F.lit(7))).when(F.col("line") == "+++ /dev/null", F.lit(""))
    w = W.partitionBy("diff").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    seen = lines.withColumns({"old_file": F.last(old, ignorenulls=True).over(w), "new_file": F.last(new, ignorenulls=True).over(w)})
    part = lambda i: F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? ", i)
    count = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(1))
    heads = seen.where(F.col("line").rlike(r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? "))
    old_file = F.coalesce("old_file", F.lit(""))
    file = F.when(F.coalesce("new_file", F.lit("")) == "", old_file).otherwise(F.col("new_file"))
    end = lambda i: part(i).cast("int") + F.greatest(count(i + 1) - 1, F.lit(0))
    out = heads.select("diff", file.alias("file"), old_file.alias("old_file"), part(3).cast("int").alias("start_line"), end(3).alias("end_line"), part(1).cast("int").alias("old_start_line"), end(1).alias("old_end_line"))
    return out.where("file != ''")


def touched_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(diff, id, uuid) of the nodes that begin in a hunk or a few lines below, on either side of the diff.

    Files meet by their last part, which holds for equal names and for paths that end alike; a missing old file
    matches nothing.
    """
    sides = found.select("diff", F.explode(F.array(F.struct(F.col("file").alias("f"), F.col("start_line").alias("a"), F.col("end_line").alias("b")), F.struct(F.col("old_file").alias("f"), F.col("old_start_line").alias("a"), F.col("old_end_line").alias("b")))).alias("s")).select("diff", "s.*").where("f != ''")
    sides = sides.select("diff", T.base_name(F.col("f")).alias("name"), "a", "b").distinct()
    own = nodes.select("id", F.lower(F.trim("uuid")).alias("uuid"), T.base_name(F.col("source_file")).alias("name"), T.line_number(F.col("source_location")).alias("line")).where("uuid IS NOT NULL AND line IS NOT NULL AND name != ''")
    return sides.join(own, "name").where((F.col("line") >= F.col("a")) & (F.col("line") <= F.col("b") + BELOW)).select("diff", "id", "uuid").distinct()


def affected_entries(touched: DataFrame, links: DataFrame) -> DataFrame:
    return touched.join(links.where("NOT is_knowledge").select("knowledge_uuid", F.col("node_uuid").alias("uuid")), "uuid").select("diff", F.col("knowledge_uuid").alias("uuid")).distinct()


def diffs_of(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "diff int, text string")
