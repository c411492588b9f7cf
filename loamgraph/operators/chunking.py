"""Windows of lines over files, and the nodes that begin in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import text as T

#: Lines of a window, lines it shares with the next, least bytes of its text.
LINES, SHARED, LEAST_BYTES = 50, 5, 1


def windows(files: DataFrame) -> DataFrame:
    """(file_path, id, start_line, end_line, language, content, content_hash) of (file_path, content)."""
    lines = F.split(F.regexp_replace("content", r"\r?\n\z", ""), r"\r?\n")
    own = files.where("content IS NOT NULL AND content != ''").select("file_path", lines.alias("ls")).withColumn("n", F.size("ls"))
    last = F.greatest(F.ceil((F.col("n") - LINES) / (LINES - SHARED)), F.lit(0)).cast("int")
    starts = own.select("file_path", "ls", "n", F.explode(F.sequence(F.lit(0), last)).alias("i")).withColumn("s", F.col("i") * (LINES - SHARED))
    cut = starts.select("file_path", (F.col("s") + 1).cast("long").alias("start_line"), F.least(F.col("s") + LINES, F.col("n")).cast("long").alias("end_line"), F.array_join(F.slice("ls", F.col("s") + 1, F.lit(LINES)), "\n").alias("content"))
    full = cut.where(F.octet_length(F.regexp_replace("content", r"^\s+|\s+$", "")) >= LEAST_BYTES).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    key = F.format_string("%s|%d-%d|%s", "file_path", "start_line", "end_line", "content_hash")
    return full.select("file_path", F.sha2(key.cast("binary"), 256).alias("id"), "start_line", "end_line", T.language(F.col("file_path")).alias("language"), "content", "content_hash")


def first_nodes(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node_id): the first node, by line and id, that begins in a chunk's lines. Lines are binned, so this is an equality join."""
    own = nodes.select(F.col("source_file").alias("file_path"), F.col("id").alias("node_id"), T.line_number(F.col("source_location")).alias("line")).where("line IS NOT NULL").withColumn("bin", F.floor(F.col("line") / LINES))
    binned = chunks.select("id", "file_path", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / LINES), F.floor(F.col("end_line") / LINES))).alias("bin"))
    met = binned.join(own, ["file_path", "bin"]).where("line BETWEEN start_line AND end_line")
    return met.groupBy("id").agg(F.min_by("node_id", F.struct("line", "node_id")).alias("node_id"))


def snippets(lines: DataFrame, wanted: DataFrame, above: int = 2, below: int = 10) -> DataFrame:
    """(id, text): lines (file, n, text) around the line of each (id, file, line)."""
    near = wanted.join(lines, "file").where((F.col("n") >= F.col("line") - above) & (F.col("n") <= F.col("line") + below))
    return near.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("text"))
