"""A store of Parquet snapshots: each table's current folder is named by a small pointer file, written last.

Pointers are numbered and never replaced; the last is current, so a reader sees a whole snapshot at any time, also after a
writer that died. A commit names the snapshot it began from and takes the next number; where another writer has taken it, the
commit is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators import identity, lifecycle

#: Tables and the keys of their rows.
KEYS = {"nodes": ["id"], "edges": ["source", "target", "relation"], "hyperedges": ["id"], "knowledge": ["uuid"], "links": ["knowledge_uuid", "node_uuid", "relation"], "review_queue": ["knowledge_uuid"], "chunks": ["id"], "node_embeddings": ["node_id"], "chunk_embeddings": ["chunk_id"]}
KNOWLEDGE_TABLES = ("knowledge", "links", "review_queue")
VERSION = 2


class Store:
    """Tables under ``root``, any path that Hadoop's file systems know."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self) -> dict:
        names = [f.getPath().getName() for f in self._fs.globStatus(self._path(f"{self.root}/pointer-*.json")) or ()]
        if not names:
            return {"version": VERSION, "commit": "", "number": 0, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.root}/{max(names)}", wholetext=True).first()[0])

    @property
    def commit_id(self) -> str:
        return self._read()["commit"]

    def tables(self) -> list[str]:
        return sorted(self._read()["tables"])

    def table(self, name: str) -> DataFrame:
        """A table of the current snapshot; reading one never touches another."""
        return self.spark.read.parquet(f"{self.root}/{self._read()['tables'][name]}")

    def commit(self, tables: Mapping[str, DataFrame], since: str | None = None) -> str:
        """Writes new versions of ``tables``, then the pointer; the others stay. ``since`` guards against another writer."""
        state = self._read()
        if since is not None and since != state["commit"]:
            raise RuntimeError(f"the store has moved on from {since or 'its start'} to {state['commit']}")
        own = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.mode("error").parquet(f"{self.root}/{name}/{own}")
            state["tables"][name] = f"{name}/{own}"
        state |= {"commit": own, "version": VERSION, "number": state["number"] + 1}
        fresh, pointer = self._path(f"{self.root}/.{own}.json"), self._path(f"{self.root}/pointer-{state['number']:012d}.json")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        # Taking the number is what decides between two writers; the pointer appears whole.
        if self._fs.exists(pointer) or not self._fs.rename(fresh, pointer):
            self._fs.delete(fresh, False)
            raise RuntimeError(f"another writer has made snapshot {state['number']}")
        return own

    def upsert(self, name: str, rows: DataFrame, order: str | None = None) -> str:
        """Rows over those of the same key."""
        since = self.commit_id
        old = self.table(name) if name in self.tables() else rows.limit(0)
        return self.commit({name: identity.upsert(old, rows, KEYS[name], order)}, since)

    def prune(self, name: str, keep: DataFrame, prefix: str | None = None) -> str:
        since = self.commit_id
        return self.commit({name: identity.prune(self.table(name), keep, KEYS[name][0], prefix)}, since)

    def merge_project(self, project: str, nodes: DataFrame, edges: DataFrame, forced: bool = False) -> str:
        """Replaces a project's nodes and edges, unless it would shrink too much; links to nodes that are gone go too."""
        since, inside = self.commit_id, F.startswith("source_file", F.lit(project.rstrip("/") + "/"))
        merged = identity.merge_project(self.table("nodes"), nodes, project, forced)
        out = {"nodes": merged, "edges": self.table("edges").where(~inside).unionByName(edges, allowMissingColumns=True)}
        if "links" in self.tables():
            alive = merged.where("uuid IS NOT NULL").select(F.col("uuid").alias("node_uuid"))
            links = self.table("links")
            out["links"] = links.where("is_knowledge").unionByName(links.where("NOT is_knowledge").join(alive, "node_uuid", "left_semi"))
        return self.commit(out, since)

    def record_fetch(self, uuids: DataFrame, now: int) -> str:
        """The write that follows a recall."""
        since = self.commit_id
        return self.commit({"knowledge": lifecycle.record_fetch(self.table("knowledge"), uuids, now)}, since)
