"""Files as tables: directory scans, notes, memory files, readmes, commit logs, registries, and new-file detection."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.functions.ids import normal_id

#: Folders that are never read (the last are our own output), and sizes of a corpus that call for a word.
NOISE = ("node_modules", "__pycache__", ".git", ".hg", ".svn", "target", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "venv", ".venv", "loamgraph-out", ".loamgraph-out")
SMALL_WORDS, LARGE_WORDS, MANY_FILES = 50_000, 500_000, 200
#: Types of memory files and of entries.
MEMORY_TYPES = {"feedback": "preference", "user": "preference", "project": "context", "reference": "api"}


def glob_pattern(glob: str) -> str:
    """A regular expression of an ignore file's line."""
    own = glob.strip().rstrip("/")
    inner = fnmatch.translate(own.lstrip("/")).replace("(?s:", "").replace(")\\Z", "").replace(")\\z", "")
    return rf"(?:^|/){inner}(?:/|$)"


def ignore_lines(text: str) -> list[str]:
    return [line.strip() for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]


def scan(spark: SparkSession, root: str, ignored: Sequence[str] = ()) -> DataFrame:
    """(path, modified, size, content, category, words) of the files under ``root`` that are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace("path", rf"^.*?{re.escape(base)}/", "")
    own = raw.select(rel.alias("path"), F.unix_micros("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    hidden = F.exists(folders, lambda p: p.startswith(".") | p.isin(*NOISE))
    own = own.where(~hidden & ~T.is_sensitive(F.col("path")))
    for g in ignored:
        own = own.where(~F.col("path").rlike(glob_pattern(g)))
    kind = T.file_kind(F.col("path"))
    text = F.when(kind.isin("code", "document"), F.decode("content", "UTF-8"))
    return own.withColumn("category", kind).where("category IS NOT NULL").withColumn("words", F.coalesce(T.word_count(text), F.lit(0)))


def corpus_report(files: DataFrame) -> DataFrame:
    """One row: files, words and what they call for."""
    sums = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    advice = F.when(F.col("words") < SMALL_WORDS, "small: may fit a single context").when(F.col("words") > LARGE_WORDS, "large: semantic extraction will be expensive").when(F.col("files") > MANY_FILES, "many files")
    return sums.withColumn("advice", advice)


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or of another time than in ``manifest`` (path, modified)."""
    return files.join(manifest.select("path", "modified"), ["path", "modified"], "left_anti")


def uncached(files: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Files whose content, name and extractor version are not in ``cache`` (key), with their key; a note's head does not count."""
    body = F.when(F.col("path").endswith(".md"), F.regexp_replace(F.decode("content", "UTF-8"), r"(?s)\A---\n.*?\n---\n", "")).otherwise(F.decode("content", "UTF-8"))
    return files.withColumn("key", F.sha2(F.concat_ws("|", F.lit(version), body, "path").cast("binary"), 256)).join(cache.select("key"), "key", "left_anti")


def front_matter(text: Column) -> Column:
    """The head of a note as a map."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[^:\s][^:]*:"))
    unquoted = lambda c: F.regexp_replace(F.trim(c), r"""^["']|["']$""", "")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), unquoted(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    return F.map_from_entries(F.array_distinct(pairs))


def notes(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, text, head) of the Markdown files under ``root``."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.withColumns({"name": F.regexp_replace(T.base_name(F.col("path")), r"\.md$", ""), "head": front_matter(F.col("text"))})


def vault(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of notes: listed connections where there are some, else the links of the text."""
    label = F.coalesce(F.col("head")["label"], F.col("head")["title"], F.col("name"))
    nodes = own.select(normal_id(F.coalesce(F.col("head")["id"], F.col("name"))).alias("id"), label.alias("label"), F.coalesce(F.col("head")["file_type"], F.lit("document")).alias("file_type"), F.coalesce(F.col("head")["source_file"], F.col("path")).alias("source_file"), "name")
    section = F.regexp_extract("text", r"(?s)## Connections\s*\n(.*?)(?:\n## |\z)", 1)
    listed = F.regexp_extract_all(section, F.lit(r"(?m)^[-*] \[\[([^\]|#]+)"), 1)
    free = F.regexp_extract_all(F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", ""), F.lit(r"\[\[([^\]|#]+)"), 1)
    linked = own.select("name", F.explode(F.array_distinct(F.when(F.size(listed) > 0, listed).otherwise(free))).alias("to"))
    ids = nodes.select("id", "name")
    edges = linked.join(ids.withColumnRenamed("id", "source"), "name").join(ids.select(F.col("id").alias("target"), F.col("name").alias("to")), "to").where("source != target")
    return nodes.drop("name"), edges.select("source", "target", F.lit("linked").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight"))


def memory_entries(own: DataFrame) -> DataFrame:
    """Memory notes as entries of 0.7."""
    kind = F.col("head")["type"]
    mapped = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in MEMORY_TYPES.items() for x in kv)), kind), F.lit("context"))
    body = F.trim(F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n?", ""))
    return own.select(F.sha2("path", 256).alias("uuid"), F.coalesce(F.col("head")["name"], F.col("name")).alias("title"), mapped.alias("knowledge_type"), body.alias("description"), F.array(F.lit("imported"), F.lit("memory"), F.coalesce(kind, F.lit("note"))).alias("tags"), F.lit(0.7).alias("confidence"))


def readme_entries(own: DataFrame) -> DataFrame:
    """The first paragraph of readmes that say enough, at most 500 characters."""
    paragraphs = F.filter(F.split("text", r"\n\s*\n"), lambda p: ~p.rlike(r"^\s*(#|!|\[|<|```)") & (F.char_length(F.trim(p)) > 20))
    first = F.left(F.trim(F.try_element_at(paragraphs, F.lit(1))), F.lit(500))
    return own.where(F.char_length("text") >= 50).select("path", first.alias("description")).where("description IS NOT NULL")


def commit_entries(commits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Entries of (hash, message) rows that say something, without those whose tag is known."""
    own = commits.withColumn("knowledge_type", T.commit_kind(F.col("message"))).where("knowledge_type IS NOT NULL")
    own = own.select(F.sha2("hash", 256).alias("uuid"), F.substring_index("message", "\n", 1).alias("title"), F.col("message").alias("description"), "knowledge_type", F.concat(F.lit("commit:"), "hash").alias("tag")).dropDuplicates(["tag"])
    if known is not None:
        own = own.join(known.select(F.explode("tags").alias("tag")), "tag", "left_anti")
    return own.withColumn("tags", F.array("tag")).drop("tag")


def page_entries(pages: DataFrame) -> DataFrame:
    """(url, kind, title, text) of fetched pages; addresses inside a network and other schemes are left out."""
    host = F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.|\[?::1|metadata\.)") | (host == "")
    return pages.where(~private).select("url", T.url_kind(F.col("url")).alias("kind"), T.html_title(F.col("html")).alias("title"), T.strip_tags(F.col("html")).alias("text"))


def owning_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Each (path) with the project (name, folder) of the longest folder it lies in; a file meets its own folders only."""
    parts = F.split("path", "/")
    folders = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("folder"))
    return folders.join(projects.select("name", F.regexp_replace("folder", "/+$", "").alias("folder")), "folder").groupBy("path").agg(F.max_by("name", F.char_length("folder")).alias("name"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a node-link JSON file, its edges under ``links`` or ``edges``; rows without ids are skipped."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = lambda name: raw.select(F.explode(name).alias("x")).select("x.*")
    return rows("nodes").where("id IS NOT NULL"), rows("links" if "links" in raw.columns else "edges").where("source IS NOT NULL AND target IS NOT NULL")


def inside(path: str, base: str) -> str:
    """The real path of ``path``, which must exist and lie in the folder ``base``, links resolved; else an error."""
    real, home = os.path.realpath(path), os.path.realpath(base)
    if not os.path.isdir(home):
        raise FileNotFoundError(f"no folder {base}")
    if not os.path.exists(real):
        raise FileNotFoundError(f"no file {path}")
    if os.path.commonpath([real, home]) != home:
        raise PermissionError(f"{path} is outside of {base}")
    return real


def provenance(folder: str) -> str | None:
    """commit:<short hash>@<folder> of a folder under version control, cwd:<folder> of any other, None if there is none."""
    if not os.path.isdir(folder):
        return None
    name = os.path.basename(os.path.abspath(folder))
    try:
        done = subprocess.run(["git", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return f"cwd:{name}"
    head = done.stdout.strip() if done.returncode == 0 else ""
    return f"commit:{head}@{name}" if head else f"cwd:{name}"


def commit_log(spark: SparkSession, repo: str, limit: int = 2000) -> DataFrame:
    """(repo, commit_id, file, committed_at, author) of the last ``limit`` commits of a folder under git, merges left out."""
    done = subprocess.run(["git", "-C", repo, "log", f"-n{limit}", "--no-merges", "--name-only", "--format=%x01%H%x02%ct%x02%an"], capture_output=True, text=True, check=True)
    return parse_log(spark, os.path.basename(os.path.abspath(repo)), done.stdout)


def parse_log(spark: SparkSession, repo: str, text: str) -> DataFrame:
    """commit_files of a log in the form that commit_log asks for: a head marked by 0x01 with parts marked by 0x02, then a file a line."""
    blocks = spark.createDataFrame([(b,) for b in text.split("\x01") if b.strip()], "block string")
    head = F.split(F.substring_index("block", "\n", 1), "\x02")
    files = F.explode(F.array_distinct(F.filter(F.transform(F.slice(F.split("block", "\n"), 2, 1 << 30), F.trim), lambda f: f != ""))).alias("file")
    return blocks.select(F.lit(repo).alias("repo"), head[0].alias("commit_id"), head[1].cast("long").cast("timestamp").alias("committed_at"), head[2].alias("author"), files)


def read_diff(repo: str, since: str = "HEAD") -> str:
    """The unified diff of a folder under git against a commit or over a range, for diffing.hunks."""
    return subprocess.run(["git", "-C", repo, "diff", "--no-color", since], capture_output=True, text=True, check=True).stdout


def moved_on(spark: SparkSession, folder: str, built_from: str) -> str | None:
    """A warning if a folder's commit is another than the one its graph was built from."""
    now = provenance(folder)
    if not now or not now.startswith("commit:") or not built_from or now.split(":")[1].split("@")[0] == built_from[: len(now.split(":")[1].split("@")[0])]:
        return None
    return f"built from {built_from}, now at {now.split(':')[1].split('@')[0]}"


def open_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of what ``path`` is: a store of ours, a node-link JSON file, a folder with graph.json, or a folder of notes."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at) and not fs.getFileStatus(at).isDirectory():
        return read_graph(spark, path)
    if fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/pointer-*.json")):
        from loamgraph.sources.store import Store

        store = Store(spark, path)
        return store.table("nodes"), store.table("edges")
    if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/graph.json")):
        return read_graph(spark, f"{path}/graph.json")
    return vault(notes(spark, path))


def invalid_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(table, key, problem) of rows that break the model."""
    kinds = ("code", "document", "paper", "image", "video", "rationale")
    missing = F.when(F.coalesce("id", F.lit("")) == "", "no id").when(F.col("label").isNull(), "no label").when(~F.coalesce(F.col("file_type").isin(*kinds), F.lit(False)), "unknown file_type")
    a = nodes.select(F.lit("nodes").alias("table"), F.col("id").alias("key"), missing.alias("problem"))
    known = nodes.select(F.col("id").alias("k")).distinct().withColumn("there", F.lit(1))
    e = edges.join(known.withColumnsRenamed({"k": "source", "there": "x"}), "source", "left").join(known.withColumnsRenamed({"k": "target", "there": "y"}), "target", "left")
    problem = F.when(F.col("relation").isNull(), "no relation").when(~F.coalesce(F.col("confidence").isin("EXTRACTED", "INFERRED", "AMBIGUOUS"), F.lit(False)), "unknown confidence").when(F.col("x").isNull() | F.col("y").isNull(), "dangling")
    b = e.select(F.lit("edges").alias("table"), F.concat_ws(">", "source", "target").alias("key"), problem.alias("problem"))
    return a.unionByName(b).where("problem IS NOT NULL")
