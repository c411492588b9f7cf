"""Graph operators on nodes (id ...) and edges (source, target, relation ...).

Traversals are loops over levels: a frontier joined to the edges, and an anti join against what was visited. Nothing
but the emptiness of a frontier comes to the driver; each level is cut with a checkpoint.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.functions.ids import normal_id
from loamgraph.operators.prefix import dense_ids
from loamgraph.session import cut

#: Rows of a depth-first order that a task gives at once.
BATCH = 1 << 16


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, fan_in): parallel edges count, a loop counts twice."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.count("*").alias("degree"), F.sum("e.i").alias("fan_in"))


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return nodes.join(degrees(edges), "id", "left").withColumns({"degree": F.coalesce("degree", zero), "fan_in": F.coalesce("fan_in", zero)})


def plain_node() -> Column:
    """Neither a file's own node nor a concept."""
    return ~T.is_file_node(F.col("label"), F.col("source_file")) & ~T.is_concept_node(F.col("source_file"))


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int, label: str = "", source: str = "", min_degree: int = 1) -> DataFrame:
    """The nodes of highest degree, files and concepts left out."""
    own = nodes.where(plain_node())
    if label:
        own = own.where(F.contains(F.lower("label"), F.lit(label.lower())))
    if source:
        own = own.where(F.contains(F.lower("source_file"), F.lit(source.lower())))
    rows = own.join(degrees(edges), "id").where(F.col("degree") >= max(1, min_degree))
    return rows.select("id", "label", "source_file", "degree").orderBy(F.col("degree").desc(), "id").limit(top)


def dangling(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an endpoint that is no node."""
    known = ids.select(F.col("id").alias("k"))
    a = edges.join(known, F.col("source") == F.col("k"), "left_anti")
    return a.unionByName(edges.join(known, F.col("target") == F.col("k"), "left_anti")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) both ways."""
    return edges.select(F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))).alias("e")).select("e.a", "e.b").distinct()


def levels(steps: DataFrame, seeds: DataFrame, depth: int, visible: DataFrame | None = None, expands: DataFrame | None = None) -> DataFrame:
    """(id, depth): least number of steps (a, b) from the seeds, up to ``depth``.

    ``visible`` bounds what may be entered (seeds always are), ``expands`` what is gone on from.
    """
    found = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    # Every level reads these again, so they are written once.
    visible, expands = (df if df is None else cut(df.select("id")) for df in (visible, expands))
    steps, frontier = cut(steps.select("a", "b")), found
    for level in range(1, depth + 1):
        source = frontier if expands is None or level == 1 else frontier.join(expands, "id", "left_semi")
        reached = source.join(steps, source.id == steps.a).select(F.col("b").alias("id")).distinct().join(found, "id", "left_anti")
        if visible is not None:
            reached = reached.join(visible, "id", "left_semi")
        frontier = cut(reached.withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def bfs(nodes: DataFrame, edges: DataFrame, seeds: Sequence[str], depth: int, source: str = "", community: int | None = None, hub: int | None = None) -> DataFrame:
    """Undirected levels; nodes of more than ``hub`` edges are visited but not gone on from, unless they are seeds."""
    visible = None
    if source or community is not None:
        visible = nodes.where((F.contains(F.lower("source_file"), F.lit(source.lower())) if source else F.lit(True)) & ((F.col("community") == community) if community is not None else F.lit(True)))
    expands = None if hub is None else with_degrees(nodes.select("id"), edges).where(F.col("degree") <= hub)
    first = nodes.where(F.col("id").isin(*seeds)).select("id")
    return levels(adjacency(edges), first, depth, visible, expands)


def callers(nodes: DataFrame, edges: DataFrame, seeds: Sequence[str], depth: int, source: str = "", callees: bool = False) -> DataFrame:
    """(id, depth) of what calls the seeds, or with ``callees`` what they call, at least depth; seeds themselves left out."""
    calls = edges.where("relation = 'calls'").select("source", "target").distinct()
    steps = calls.select(F.col("source").alias("a"), F.col("target").alias("b")) if callees else calls.select(F.col("target").alias("a"), F.col("source").alias("b"))
    visible = nodes.where(F.contains(F.lower("source_file"), F.lit(source.lower()))) if source else None
    return levels(steps, nodes.where(F.col("id").isin(*seeds)).select("id"), depth, visible).where("depth > 0")


def shortest_paths(edges: DataFrame, starts: Sequence[str], ends: Sequence[str], depth: int, relations: Sequence[str] | None = ("calls",), most: int = 20) -> DataFrame:
    """(target, length, path): a shortest directed path to each of ``ends``, the least by name; at most ``most``."""
    own = edges.where(F.col("relation").isin(*relations)) if relations else edges
    steps = cut(own.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    found = cut(steps.sparkSession.createDataFrame([(s, [s]) for s in sorted(set(starts))], "id string, path array<string>").withColumn("length", F.lit(0)))
    frontier = found
    for level in range(1, depth + 1):
        going = frontier.where(~F.col("id").isin(*ends)) if level > 1 else frontier
        reached = going.join(steps, going.id == steps.a).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        reached = reached.groupBy("id").agg(F.min("path").alias("path")).join(found.select("id"), "id", "left_anti")
        frontier = cut(reached.withColumn("length", F.lit(level)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    hits = found.where(F.col("id").isin(*ends) & (F.col("length") > 0))
    return hits.select(F.col("id").alias("target"), "length", F.array_join("path", " > ").alias("path")).orderBy("length", "target").limit(most)


def dfs_rows(edges: DataFrame, seeds: Sequence[str], depth: int) -> DataFrame:
    """(place, id, depth): preorder with one visited set over all seeds, neighbours by name.

    The order of a depth-first walk is sequential, so one task walks the part of the graph within ``depth`` of the seeds:
    over nodes numbered in order of name, in arrays of 4 bytes a step, and with a stack no longer than ``depth``.
    """
    seeds = list(dict.fromkeys(seeds))
    starting = edges.sparkSession.createDataFrame([(s,) for s in seeds], "id string")
    ids = edges.select(F.explode(F.array("source", "target")).alias("id")).unionByName(starting).distinct()
    names = cut(dense_ids(ids.repartitionByRange("id").sortWithinPartitions("id"), "n"))
    # From here on numbers stand for names: they are a fraction of the room.
    pairs = edges.join(names.withColumnsRenamed({"id": "source", "n": "u"}), "source").select("u", "target").join(names.withColumnsRenamed({"id": "target", "n": "v"}), "target")
    steps = cut(adjacency(pairs.select(F.col("u").alias("source"), F.col("v").alias("target"))))
    number = {r.id: r.n for r in names.where(F.col("id").isin(*seeds)).select("id", "n").collect()}
    starts, count = [number[s] for s in seeds], names.count()
    going = levels(steps, names.where(F.col("id").isin(*seeds)).select(F.col("n").alias("id")), depth - 1).select(F.col("id").alias("a"))
    inside = steps.join(going, "a", "left_semi").select(F.col("a").alias("u"), F.col("b").alias("v"))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b["u"].to_numpy().astype(np.int32), b["v"].to_numpy().astype(np.int32)) for b in batches]
        u, v = (np.concatenate([x[i] for x in ends]) for i in (0, 1))
        del ends
        order = np.lexsort((v, u))
        first = memoryview(np.searchsorted(u, np.arange(count + 1), sorter=order))
        targets, seen = memoryview(v[order]), bytearray(count)
        del u, v, order
        ids, depths, place = [], [], 0
        for start in starts:
            stack = []
            found = None if seen[start] else start
            while found is not None or stack:
                if found is not None:
                    seen[found] = 1
                    ids.append(found)
                    depths.append(len(stack))
                    stack.append([first[found], first[found + 1] if len(stack) < depth else first[found]])
                    if len(ids) == BATCH:
                        yield pa.record_batch([pa.array(range(place, place + BATCH), pa.int32()), pa.array(ids, pa.int64()), pa.array(depths, pa.int32())], names=["place", "n", "depth"])
                        ids, depths, place = [], [], place + BATCH
                top, found = stack[-1], None
                while top[0] < top[1] and found is None:
                    w = targets[top[0]]
                    top[0] += 1
                    found = None if seen[w] else w
                if found is None:
                    stack.pop()
        yield pa.record_batch([pa.array(range(place, place + len(ids)), pa.int32()), pa.array(ids, pa.int64()), pa.array(depths, pa.int32())], names=["place", "n", "depth"])

    # The row of no node makes a task even where there is no step.
    none = edges.sparkSession.createDataFrame([(-1, -1)], "u long, v long")
    rows = cut(inside.unionByName(none)).coalesce(1).mapInArrow(walked, "place int, n long, depth int")
    return rows.join(names.select("id", "n"), "n").select("place", "id", "depth")


def dfs(edges: DataFrame, seeds: Sequence[str], depth: int) -> list[tuple[str, int]]:
    """The rows of ``dfs_rows`` as a list of (id, depth) in order."""
    return [(r.id, r.depth) for r in dfs_rows(edges, seeds, depth).orderBy("place").collect()]


#: Edges up to which what is left after trimming is finished in one task.
ONE_TASK = 500_000


def _strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of the strongly connected components of two nodes or more, by two depth-first walks without recursion."""
    edges = [(a, b) for batch in batches for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)]
    there, back = defaultdict(list), defaultdict(list)
    for a, b in edges:
        there[a].append(b)
        back[b].append(a)
    order, seen = [], set()
    for start in list(there):
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(there[start]))]
        while stack:
            v, rest = stack[-1]
            w = next((w for w in rest if w not in seen), None)
            if w is None:
                order.append(v)
                stack.pop()
            else:
                seen.add(w)
                stack.append((w, iter(there.get(w, ()))))
    ids, names, done = [], [], set()
    for start in reversed(order):
        if start in done:
            continue
        done.add(start)
        part, todo = [], [start]
        while todo:
            v = todo.pop()
            part.append(v)
            for w in back.get(v, ()):
                if w not in done:
                    done.add(w)
                    todo.append(w)
        if len(part) > 1:
            ids += part
            names += [min(part)] * len(part)
    yield pa.record_batch([pa.array(ids, pa.string()), pa.array(names, pa.string())], names=["id", "component"])


def components_of(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): strongly connected components of two nodes or more, named by their least member.

    Nodes without a way in or out are trimmed again and again. What is left then is finished in one task if it has no
    more than ``one_task`` edges. Else each node takes the least name that reaches it (a colour); what a colour's node reaches
    backwards within its own colour is its component, and the rest goes round again.
    """
    steps = cut(edges.where("source != target").select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    out = []
    left = steps.count()
    while left:
        while left:
            alive = steps.select(F.col("a").alias("id")).distinct().join(steps.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
            kept = cut(steps.join(alive.withColumnRenamed("id", "a"), "a", "left_semi").join(alive.withColumnRenamed("id", "b"), "b", "left_semi"))
            now = kept.count()
            steps, same, left = kept, now == left, now
            if same or left <= one_task:
                break
        if not left:
            break
        if left <= one_task:
            out.append(cut(steps.coalesce(1).mapInArrow(_strong, "id string, component string")))
            break
        colours = cut(steps.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("colour", F.col("id")))
        while True:
            came = steps.join(colours.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("colour").alias("new"))
            nxt = cut(colours.join(came, "id", "left").select("id", F.least("colour", F.coalesce("new", "colour")).alias("colour"), F.col("colour").alias("old")))
            colours = nxt.select("id", "colour")
            if nxt.where("colour < old").isEmpty():
                break
        inside = cut(steps.join(colours.select(F.col("id").alias("a"), F.col("colour").alias("ca")), "a").join(colours.select(F.col("id").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb").select("a", "b"))
        roots = colours.where("id = colour").select("id")
        back = levels(inside.select(F.col("b").alias("a"), F.col("a").alias("b")), roots, 1 << 30).select("id")
        found = cut(back.join(colours, "id").withColumnRenamed("colour", "component"))
        sizes = found.groupBy("component").count().where("count > 1").select("component")
        out.append(cut(found.join(sizes, "component", "left_semi").select("id", "component")))
        steps = cut(steps.join(back.withColumnRenamed("id", "a"), "a", "left_anti").join(back.withColumnRenamed("id", "b"), "b", "left_anti"))
        left = steps.count()
    empty = edges.select(F.col("source").alias("id"), F.col("target").alias("component")).limit(0)
    for o in out:
        empty = empty.unionByName(o)
    return empty


def cycles(nodes: DataFrame, edges: DataFrame, relations: Sequence[str] = ("calls", "imports"), source: str = "") -> DataFrame:
    """(component, size, members): loops among the edges of ``relations``; members are labels in order."""
    own = edges.where(F.col("relation").isin(*relations)) if relations else edges.limit(0)
    if source:
        inside = nodes.where(F.contains(F.lower("source_file"), F.lit(source.lower()))).select("id")
        own = own.join(inside.withColumnRenamed("id", "source"), "source", "left_semi").join(inside.withColumnRenamed("id", "target"), "target", "left_semi")
    return components_of(own).join(nodes.select("id", "label"), "id").groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("members"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def difference(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys that came or went, as change 'added' or 'removed'."""
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    return b.join(a, list(keys), "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, list(keys), "left_anti").withColumn("change", F.lit("removed")))


def cohesion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, size, cohesion): distinct undirected pairs inside, by all possible ones; 1 below two members."""
    c = nodes.select("id", F.coalesce("community", F.lit(0)).alias("community"))
    pairs = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    inside = pairs.join(c.withColumnsRenamed({"id": "a", "community": "ca"}), "a").join(c.withColumnsRenamed({"id": "b", "community": "cb"}), "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("pairs"))
    sizes = c.groupBy("community").agg(F.count("*").alias("size"))
    n = F.col("size")
    return sizes.join(inside, "community", "left").select("community", "size", F.when(n < 2, 1.0).otherwise(F.coalesce("pairs", F.lit(0)) / (n * (n - 1) / 2)).alias("cohesion"))


def surprising(nodes: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    """Edges between plain nodes scored by doubt (3, 2, 1), across files (2) and across communities (1); 2 and more."""
    plain = nodes.where(plain_node()).select("id", "source_file", "community")
    rows = edges.join(plain.withColumnsRenamed({"id": "source", "source_file": "fa", "community": "ca"}).withColumnRenamed("fa", "file_a"), "source").join(plain.withColumnsRenamed({"id": "target", "source_file": "file_b", "community": "cb"}), "target")
    cross_file, cross = F.col("file_a") != F.col("file_b"), F.coalesce(F.col("ca") != F.col("cb"), F.lit(False))
    score = F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1) + F.when(cross_file, 2).otherwise(0) + F.when(cross, 1).otherwise(0)
    reasons = F.array_join(F.array_compact(F.array(F.when(F.col("confidence") == "AMBIGUOUS", "AMBIGUOUS confidence").when(F.col("confidence") == "INFERRED", "INFERRED confidence"), F.when(cross_file, "cross-file"), F.when(cross, "cross-community"))), "; ")
    order = [F.col("score").desc(), "source", "target", "relation", "source_location", "confidence", "weight"]
    return rows.withColumns({"score": score, "reasons": reasons}).where("score >= 2").orderBy(*order).limit(top).select("source", "target", "relation", "confidence", "score", "reasons")


def questions(nodes: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    """Questions a graph raises: doubtful edges, then hubs of many inferred edges, then isolated nodes."""
    name = nodes.select("id", "label")
    doubtful = edges.where("confidence = 'AMBIGUOUS'").join(name.withColumnsRenamed({"id": "source", "label": "la"}), "source").join(name.withColumnsRenamed({"id": "target", "label": "lb"}), "target")
    first = doubtful.select(F.lit(1).alias("branch"), F.format_string("Is the %s relationship between %s and %s correct?", "relation", "la", "lb").alias("question"), F.lit("ambiguous_edge").alias("question_type"), F.col("source").alias("node_id"))
    inferred = edges.where("confidence = 'INFERRED'").select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    second = god_nodes(nodes, edges, 5).join(inferred, "id").where("n >= 3").select(F.lit(2).alias("branch"), F.format_string("How does %s connect to %d other entities (via inferred edges)?", "label", "n").alias("question"), F.lit("verify_inferred").alias("question_type"), F.col("id").alias("node_id"))
    third = with_degrees(name, edges).where("degree <= 1").select(F.lit(3).alias("branch"), F.format_string("Why is %s isolated? Is it missing connections?", "label").alias("question"), F.lit("isolated_nodes").alias("question_type"), F.col("id").alias("node_id"))
    return first.unionByName(second).unionByName(third).orderBy("branch", "node_id", "question").limit(top)


def merge_parallel(edges: DataFrame) -> DataFrame:
    """Of parallel edges of one relation the surest."""
    sure = F.when(F.col("confidence") == "EXTRACTED", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    return edges.groupBy("source", "target", "relation").agg(F.max(sure).alias("sure"), F.max("weight").alias("weight"), F.count("*").alias("edges"))


def shared_labels(nodes: DataFrame, project: Column) -> DataFrame:
    """Edges from the first node of a label to nodes of that label in other projects, weight 0.7."""
    own = nodes.where("label != ''").select("id", "label", project.alias("project"))
    first = own.groupBy("label").agg(F.min(F.struct("project", "id")).alias("f"))
    return own.join(first, "label").where("project != f.project").select(F.col("f.id").alias("source"), F.col("id").alias("target"), F.lit("shared_across_projects").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.7).alias("weight"), "label")


def substring_scores(nodes: DataFrame, question: str) -> DataFrame:
    """(id, label, score) of the nodes that hold words of the question: in the label 2 each, in the path 1."""
    terms = [t for t in dict.fromkeys("".join(c if c.isalnum() else " " for c in question.lower()).split()) if len(t.encode()) > 2]
    score = F.lit(0)
    for t in terms:
        score = score + F.when(F.contains(F.lower("label"), F.lit(t)), 2).otherwise(0) + F.when(F.contains(F.lower("source_file"), F.lit(t)), 1).otherwise(0)
    return nodes.select("id", "label", "source_file", score.alias("score")).where("score > 0")


def query_graph(nodes: DataFrame, edges: DataFrame, question: str, depth: int = 3, seeds: int = 3, hub: int | None = 50, source: str = "", community: int | None = None, fuzzy: bool = False) -> DataFrame:
    """(id, depth, label, source_file) of the graph around what a question names: best nodes, then levels without going on from hubs.

    ``source`` (a part of the path) and ``community`` filter seeds and what is entered. Where the question names nothing that
    passes them, the best connected nodes that do are the seeds. ``fuzzy`` scores by subsequences instead of words.
    """
    scope = nodes
    if source:
        scope = scope.where(F.contains(F.lower("source_file"), F.lit(source.lower())))
    if community is not None:
        scope = scope.where(F.col("community") == community)
    if fuzzy:
        from loamgraph.operators.search import fuzzy_scores

        scored = fuzzy_scores(scope, question)
    else:
        scored = substring_scores(scope, question)
    best = [r.id for r in scored.orderBy(F.col("score").desc(), "id").limit(seeds).collect()]
    if not best and (source or community is not None):
        best = [r.id for r in with_degrees(scope.select("id"), edges).where("degree > 0").orderBy(F.col("degree").desc(), "id").limit(seeds).collect()]
    return bfs(nodes, edges, best, depth, source, community, hub).join(nodes.select("id", "label", "source_file"), "id")


def rendered(found: DataFrame, edges: DataFrame, tokens: int = 2000) -> str:
    """The nodes of ``query_graph``, nearest first, then the edges between them, as lines, as many as fit at four bytes a token."""
    from loamgraph.sources.sinks import within_budget

    node = F.format_string("NODE %s [%s]", F.coalesce("label", "id"), "source_file")
    names = found.select("id", F.coalesce("label", "id").alias("name"))
    ends = induced(edges, found).join(names.withColumnsRenamed({"id": "source", "name": "a"}), "source").join(names.withColumnsRenamed({"id": "target", "name": "b"}), "target")
    lines = found.select(F.col("depth").alias("o"), node.alias("t")).unionByName(ends.select(F.lit(1 << 30).alias("o"), F.format_string("EDGE %s --%s--> %s", "a", "relation", "b").alias("t")).distinct())
    return within_budget(lines, F.col("t"), F.col("o"), tokens)


#: Files that make a folder a package.
PACKAGE_FILES = ("Cargo.toml", "pyproject.toml", "setup.py", "setup.cfg", "package.json", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "Gemfile", "composer.json", "mix.exs", "Package.swift", "pubspec.yaml", "__init__.py")


def hierarchy(nodes: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, file_type, source_file, norm_label) of the folders of all nodes' paths, and contains edges (source, target).

    The first part of a path is its project. Folders named src are passed over: what lies in them belongs to the folder above.
    A folder of ``files`` (source_file; by default the nodes' own) with a package's file is a crate, any other a module. A
    folder contains the node of a file, which is the one at its line L1.
    """
    own = nodes.select("source_file").where("source_file != ''").distinct().select("source_file", F.split("source_file", "/").alias("p")).where("size(p) > 1")
    at = own.select("source_file", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("n")).where("element_at(p, n) != 'src'")
    path = F.array_join(F.slice("p", F.lit(1), F.col("n")), "/")
    # The nearest folder above that isn't passed over.
    above = F.array_max(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (F.get(F.col("p"), i - 1) != "src")))
    folders = at.select(path.alias("path"), F.element_at("p", F.col("n")).alias("label"), F.col("n"), F.array_join(F.slice("p", F.lit(1), above), "/").alias("above")).distinct()
    listed = (nodes if files is None else files).select("source_file").distinct()
    base = T.base_name(F.col("source_file"))
    packages = listed.where(base.isin(*PACKAGE_FILES) | F.endswith("source_file", F.lit(".csproj"))).select(F.regexp_replace("source_file", "/?[^/]*$", "").alias("path")).distinct().withColumn("package", F.lit(True))
    made = folders.join(packages, "path", "left").select(normal_id(F.col("path")).alias("id"), "label", F.when(F.col("n") == 1, "document").otherwise("code").alias("file_type"), F.col("path").alias("source_file"), F.when(F.col("package"), "crate").otherwise("module").alias("norm_label"))
    made = made.groupBy("id").agg(F.min(F.struct("source_file", "label", "file_type", "norm_label")).alias("x")).select("id", "x.label", "x.file_type", "x.source_file", "x.norm_label")
    inner = folders.where("above != ''").select(normal_id(F.col("above")).alias("source"), normal_id(F.col("path")).alias("target"))
    last = F.array_max(F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i == 0) | (F.get(F.col("p"), i - 1) != "src")))
    held = own.select("source_file", F.array_join(F.slice("p", F.lit(1), last), "/").alias("folder")).where("folder != ''")
    of_files = held.join(nodes.where("source_location = 'L1'").select("source_file", F.col("id").alias("target")), "source_file").select(normal_id(F.col("folder")).alias("source"), "target")
    return made, inner.unionByName(of_files).where("source != target").distinct()


def node_details(nodes: DataFrame, edges: DataFrame, query: str, expand: str = "", top: int = 5) -> DataFrame:
    """(id, label, score, degree, members): best matches; with ``expand``, the ids at the other end of that relation, best connected first."""
    best = substring_scores(nodes, query).orderBy(F.col("score").desc(), "id").limit(top)
    degree = degrees(edges)
    rows = best.join(degree, "id", "left").select("id", "label", "score", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    own = edges.where(F.col("relation") == expand).join(best.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("id"), F.col("target").alias("m")).distinct()
    ranked = own.join(degree.select(F.col("id").alias("m"), F.col("degree").alias("d")), "m", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("d", F.lit(0))).alias("d"), "m"))).alias("ms"))
    return rows.join(ranked, "id", "left").select("id", "label", "score", "degree", F.array_join(F.transform(F.coalesce("ms", F.array().cast("array<struct<d:bigint,m:string>>")), lambda x: x["m"]), ",").alias("members"))


def explain(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """(id, neighbour, label, relation, direction) around the best match."""
    best = [r.id for r in substring_scores(nodes, query).orderBy(F.col("score").desc(), "id").limit(1).collect()]
    out = edges.where(F.col("source").isin(*best)).select(F.col("source").alias("id"), F.col("target").alias("neighbour"), "relation", F.lit("out").alias("direction"))
    both = out.unionByName(edges.where(F.col("target").isin(*best)).select(F.col("target").alias("id"), F.col("source").alias("neighbour"), "relation", F.lit("in").alias("direction"))).distinct()
    return both.join(nodes.select(F.col("id").alias("neighbour"), "label"), "neighbour").select("id", "neighbour", "label", "relation", "direction")
