"""A project's folder into a store: scan, extract, resolve, give identities, merge; and that for all projects of a workspace."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.operators import analyze, extract, graph, identity
from loamgraph.session import cut
from loamgraph.sources import files
from loamgraph.sources.store import Store

NODE = "id string, label string, file_type string, source_file string, source_location string, confidence string, community long, uuid string, fingerprint string, logical_key string, body_hash string"


def graph_of(store: Store, root: str, name: str, ignored: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes (with folders and fingerprints, without uuid) and edges of the files under ``root``; paths begin with the project's name."""
    own = files.scan(store.spark, root, ignored).where("category = 'code'")
    path = F.concat(F.lit(f"{name}/"), "path")
    rows = cut(extract.extract(own.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), T.language(F.col("path")).alias("language"))))
    nodes, edges, calls = extract.tables(rows)
    called = analyze.resolve_calls(nodes, edges, calls).select(F.col("caller").alias("source"), "target", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("weight"))
    folders, held = graph.hierarchy(nodes, files.scan(store.spark, root, ignored).select(path.alias("source_file")))
    made = nodes.unionByName(folders.drop("norm_label").join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)
    made = made.withColumn("fingerprint", T.fingerprint(F.col("file_type"), F.col("source_file"), F.col("source_location"), F.lit(None).cast("string")))
    held = held.select("source", "target", F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight"))
    return made, edges.unionByName(called, allowMissingColumns=True).unionByName(held, allowMissingColumns=True)


def run_project(store: Store, root: str, name: str, ignored: Sequence[str] = (), forced: bool = False) -> str:
    """Replaces a project in the store by what its folder holds now; nodes keep their uuid where they are recognised."""
    made, edges = graph_of(store, root, name, ignored)
    empty = store.spark.createDataFrame([], NODE)
    old = store.table("nodes") if "nodes" in store.tables() else empty
    before = old.where(F.startswith("source_file", F.lit(f"{name}/"))).unionByName(empty, allowMissingColumns=True)
    given = empty.unionByName(made, allowMissingColumns=True)
    uuids = cut(identity.assign(before, given).select("id", F.col("uuid").alias("given")))
    nodes = cut(given.join(uuids, "id").withColumn("uuid", F.col("given")).drop("given"))
    if "nodes" not in store.tables():
        return store.commit({"nodes": nodes, "edges": edges})
    return store.merge_project(name, nodes, edges, forced)


def run_workspace(store: Store, projects: Mapping[str, str], ignored: Sequence[str] = ()) -> dict[str, str]:
    """``run_project`` for each name and folder; a project that fails leaves the others' snapshots as they are and is named with its error."""
    done = {}
    for name, root in sorted(projects.items()):
        try:
            done[name] = run_project(store, root, name, ignored)
        except (ValueError, RuntimeError) as e:
            done[name] = f"failed: {e}"
    return done
