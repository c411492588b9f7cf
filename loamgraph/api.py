"""The engine's methods by name over a store: `Engine(store).call("recall", query="cache")`.

Reading methods give a DataFrame (or a dict of them), changing ones commit a snapshot and give its name. The time of
day is a parameter of the engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators import analyze, community, diffing, graph, lifecycle, recall, search
from loamgraph.sources.store import Store

_QUEUE = "knowledge_uuid string, reason string, created_at long, priority int, completed boolean"


class Engine:
    def __init__(self, store: Store, now: int) -> None:
        self.store, self.now, self.spark = store, now, store.spark

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("nodes", "edges", "knowledge", "links", "chunks", "node_embeddings"):
            return self.store.table(name)
        raise AttributeError(name)

    @property
    def queue(self) -> DataFrame:
        return self.store.table("review_queue") if "review_queue" in self.store.tables() else self.spark.createDataFrame([], _QUEUE)

    def call(self, method: str, **given: object) -> object:
        if method.startswith("_") or method not in METHODS:
            raise ValueError(f"no method {method}")
        return getattr(self, method)(**given)

    def _uuids(self, uuids: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame([(u,) for u in uuids], "uuid string")

    # graph
    def query_graph(self, question: str, depth: int = 3, hub: int | None = 50, source: str = "", community: int | None = None, fuzzy: bool = False, token_budget: int | None = None) -> DataFrame | str:
        """The nodes found; with a token budget, they and their edges as lines."""
        found = graph.query_graph(self.nodes, self.edges, question, depth, hub=hub, source=source, community=community, fuzzy=fuzzy)
        return found if token_budget is None else graph.rendered(found, self.edges, token_budget)

    def get_node(self, query: str, expand: str = "", top: int = 5) -> DataFrame:
        return graph.node_details(self.nodes, self.edges, query, expand, top)

    def explain(self, query: str) -> DataFrame:
        return graph.explain(self.nodes, self.edges, query)

    def find_callers(self, ids: Sequence[str], depth: int = 1, source: str = "") -> DataFrame:
        return graph.callers(self.nodes, self.edges, ids, depth, source)

    def find_callees(self, ids: Sequence[str], depth: int = 1, source: str = "") -> DataFrame:
        return graph.callers(self.nodes, self.edges, ids, depth, source, callees=True)

    def trace_call_path(self, starts: Sequence[str], ends: Sequence[str], depth: int = 8) -> DataFrame:
        return graph.shortest_paths(self.edges, starts, ends, depth)

    def detect_cycles(self, relations: Sequence[str] = ("calls", "imports"), source: str = "") -> DataFrame:
        return graph.cycles(self.nodes, self.edges, relations, source)

    def god_nodes(self, top: int = 10, label: str = "", source: str = "", min_degree: int = 1) -> DataFrame:
        return graph.god_nodes(self.nodes, self.edges, top, label, source, min_degree)

    def compare_graphs(self, left: str, right: str, threshold: float = 0.0, **given: object) -> DataFrame | dict[str, DataFrame]:
        found = analyze.gaps(self.nodes, self.edges, left, right, **given)
        return found if threshold <= 0 else {"gaps": found, "candidates": analyze.gap_candidates(found, self.nodes, right, threshold, 3)}

    def semantic_search(self, vector: Sequence[float], top: int = 10, model: str | None = None, path: str = "", language: str = "") -> dict[str, DataFrame]:
        """Hits and what is attached to them; ``path`` (a part of it) and ``language`` restrict the nodes, and where there are chunks a hit's content is joined last."""
        own = self.node_embeddings if model is None else self.node_embeddings.where(F.col("model") == model)
        nodes = self.nodes
        if path:
            own = own.join(nodes.where(F.contains(F.lower("source_file"), F.lit(path.lower()))).select(F.col("id").alias("node_id")), "node_id", "left_semi")
        chunks = self.chunks if "chunks" in self.store.tables() else None
        if language:
            if chunks is None:
                raise ValueError("the store has no chunks")
            own = own.join(chunks.where(F.lower("language") == language.lower()).select("node_id").distinct(), "node_id", "left_semi")
        hits = search.nearest(search.unpack(own.select(F.col("node_id").alias("id"), "dim", "vec")), vector, top).select("id", "similarity")
        out = {"hits": hits, "knowledge": search.attached(hits, nodes, self.links, self.knowledge)}
        if chunks is not None:
            out["content"] = hits.join(chunks.select(F.col("node_id").alias("id"), "file_path", "start_line", "end_line", "content"), "id")
        return out

    def analyze_change(self, diff: str, commit_files: DataFrame | None = None, most: int = 20) -> dict[str, DataFrame]:
        """Entries that a diff concerns, and the files that usually change with its first five."""
        hunks = diffing.hunks(diffing.diffs_of(self.spark, [diff]))
        files = [r.file for r in hunks.select("file").distinct().orderBy("file").limit(5).collect()]
        out = {"hunks": hunks, "knowledge": self.recall_for_diff(diff, most)}
        if commit_files is not None:
            targets = commit_files.select("repo").distinct().withColumn("target", F.explode(F.array(*(F.lit(f) for f in files))) if files else F.lit(""))
            out["co_changes"] = analyze.co_changes(commit_files, targets)
        return out

    def detect_renames(self, least: float = 0.4, top: int = 3) -> DataFrame:
        return analyze.renames(self.nodes, self.links, least, top)

    def co_changes(self, commit_files: DataFrame, targets: DataFrame | None = None) -> DataFrame:
        return analyze.co_changes(commit_files, targets)

    def list_communities(self, top: int = 5, min_size: int = 3) -> dict[str, DataFrame]:
        return {"nodes": community.top_nodes(self.nodes, self.edges, top, min_size), "files": community.top_files(self.nodes, top, min_size), "labels": community.community_labels(self.nodes)}

    def graph_stats(self) -> dict[str, int]:
        return {"nodes": self.nodes.count(), "edges": self.edges.count(), "communities": self.nodes.select(F.countDistinct(F.coalesce("community", F.lit(0)))).first()[0]}

    def add_edge(self, source: str, target: str, relation: str) -> str:
        new = self.spark.createDataFrame([(source, target, relation, "EXTRACTED", 1.0)], "source string, target string, relation string, confidence string, weight double")
        return self.store.upsert("edges", new)

    # knowledge: reading
    def recall(self, query: str = "", kind: str | None = None) -> DataFrame:
        return recall.recall(self.knowledge, query, kind).orderBy(F.col("score").desc(), "uuid")

    def recall_for_task_structured(self, question: str = "", files: Sequence[str] = (), node_uuids: Sequence[str] = (), most: int = 10, kind: str | None = None) -> DataFrame:
        scored = recall.reason_in_words(recall.task_scores(self.knowledge, self.links, question, files, self._uuids(node_uuids), self.now, kind))
        return recall.diverse(scored, most).join(scored.drop("total"), "uuid").orderBy("place")

    def recall_for_task(self, **given: object) -> DataFrame:
        return self.recall_for_task_structured(**given).select("place", "uuid", "title", "description", "confidence")

    def recall_for_diff(self, diff: str, most: int = 20) -> DataFrame:
        hunks = diffing.hunks(diffing.diffs_of(self.spark, [diff]))
        files = [r.f for r in hunks.select(F.explode(F.array_distinct(F.array("file", "old_file"))).alias("f")).where("f != ''").distinct().orderBy("f").collect()]  # those of one text
        return recall.for_diff(self.knowledge, self.links, diffing.touched_nodes(hunks, self.nodes).select("uuid"), files, self.now, most)

    def get_task_context(self, question: str = "", files: Sequence[str] = (), task: str = "", most: int = 10) -> dict[str, DataFrame]:
        return recall.task_context(self.knowledge, self.links, self.nodes, self.detect_conflicts(), question, files, task, self.now, most)

    def knowledge_context(self, most: int = 10) -> dict[str, DataFrame]:
        return {"sections": recall.context_sections(self.knowledge, self.now, most), "types": recall.type_counts(self.knowledge)}

    def knowledge_neighbors(self, uuid: str) -> DataFrame:
        return lifecycle.neighbors(self.links, uuid)

    def thought_chain(self, uuid: str) -> DataFrame:
        return lifecycle.thought_chain(self.knowledge, self.links, uuid)

    def knowledge_graph(self, start: str | None = None, depth: int = 2) -> DataFrame:
        return lifecycle.knowledge_graph(self.knowledge, self.links, start, depth)

    def detect_stale(self) -> DataFrame:
        return lifecycle.stale(self.knowledge, self.links, self.nodes, self.now)

    def find_duplicates(self, least: float = 0.6) -> DataFrame:
        return lifecycle.duplicates(self.knowledge, least)

    def detect_conflicts(self) -> DataFrame:
        return lifecycle.conflicts(self.knowledge, self.links)

    def knowledge_health(self) -> DataFrame:
        return lifecycle.health(self.knowledge, self.links, self.nodes, self.now)

    def get_review_queue(self) -> DataFrame:
        return lifecycle.pending(self.queue)

    def reason(self, uuids: Sequence[str], depth: int = 3) -> DataFrame:
        return recall.propagate(self.knowledge, self.links, self._uuids(uuids), depth)

    # knowledge: changing
    def learn(self, news: DataFrame) -> str:
        return self.store.commit({"knowledge": lifecycle.learn(self.knowledge, news, self.now)})

    def record_fetch(self, uuids: Sequence[str]) -> str:
        return self.store.record_fetch(self._uuids(uuids), self.now)

    def forget(self, **tests: object) -> str:
        k, links = lifecycle.forget(self.knowledge, self.links, **tests)
        return self.store.commit({"knowledge": k, "links": links})

    def validate_knowledge(self, uuids: Sequence[str], note: str = "") -> str:
        return self.store.commit({"knowledge": lifecycle.validate(self.knowledge, self._uuids(uuids), self.now, note)})

    def mark_obsolete(self, uuids: Sequence[str]) -> str:
        return self.store.commit({"knowledge": lifecycle.mark_obsolete(self.knowledge, self._uuids(uuids), self.now)})

    def update_knowledge(self, uuid: str, **fields: object) -> str:
        return self.store.commit({"knowledge": lifecycle.update(self.knowledge, uuid, self.now, **fields)})

    def supersede(self, uuid: str, superseded: str) -> str:
        pairs = self.spark.createDataFrame([(uuid, superseded)], "uuid string, superseded string")
        return self.store.commit({"knowledge": lifecycle.supersede(self.knowledge, pairs, self.now)})

    def link_knowledge_to_nodes(self, uuid: str, node_uuids: Sequence[str], relation: str = "related_to") -> str:
        return self.store.commit({"links": lifecycle.link_nodes(self.links, self.nodes, uuid, [u.strip().lower() for u in node_uuids], relation, self.now)})

    def clear_knowledge_links(self, uuid: str) -> str:
        return self.store.commit({"links": self.links.where((F.col("knowledge_uuid") != uuid) | F.col("is_knowledge"))})

    def link_knowledge(self, source: str, target: str, relation: str, both_ways: bool = False) -> str:
        news = self.spark.createDataFrame([(source, target, relation)], "knowledge_uuid string, node_uuid string, relation string")
        return self.store.commit({"links": lifecycle.add_links(self.links, self.knowledge, news, both_ways)})

    def remove_link(self, source: str, target: str) -> str:
        gone = self.spark.createDataFrame([(source, target)], "knowledge_uuid string, node_uuid string")
        return self.store.commit({"links": lifecycle.remove_links(self.links, gone)})

    def merge_knowledge(self, keep: str, absorb: str) -> str:
        pairs = self.spark.createDataFrame([(keep, absorb)], "keep string, absorb string")
        k, links = lifecycle.merge(self.knowledge, self.links, pairs, self.now)
        return self.store.commit({"knowledge": k, "links": links})

    def complete_review(self, uuid: str) -> str:
        return self.store.commit({"review_queue": lifecycle.complete(self.queue, uuid)})

    def refresh_review_queue(self, least: float = 0.6) -> str:
        new = lifecycle.review_queue(self.knowledge, self.links, self.nodes, self.now, self.queue, least)
        return self.store.commit({"review_queue": self.queue.unionByName(new.select("knowledge_uuid", "reason", F.lit(self.now).cast("long").alias("created_at"), "priority", F.lit(False).alias("completed")))})

    def save_insight(self, title: str, text: str, tags: Sequence[str] = (), folder: str | None = None) -> str:
        """A note, kept as an entry of context; with ``folder``, on this machine, also as a Markdown file there."""
        import hashlib
        import os
        import re

        if folder is not None:
            os.makedirs(folder, exist_ok=True)
            name = re.sub(r'[\\/:*?"<>|#^\[\]]', "_", title) or "note"
            with open(os.path.join(folder, f"{name}.md"), "w", encoding="utf-8") as f:
                f.write(f"---\ntitle: {title}\ntags: [{', '.join(tags)}]\n---\n\n# {title}\n\n{text}\n")
        news = self.spark.createDataFrame([(hashlib.sha256(f"{title}|{text}".encode()).hexdigest(), title, "context", text, list(tags))], "uuid string, title string, knowledge_type string, description string, tags array<string>")
        return self.learn(news)

    save_note = save_insight


METHODS = frozenset(n for n in vars(Engine) if not n.startswith("_") and n not in ("call", "queue"))
