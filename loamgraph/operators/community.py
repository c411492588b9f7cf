"""Communities: local moving by modularity, splitting of oversized ones, summaries and labels."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.operators.graph import adjacency, plain_node, with_degrees
from loamgraph.operators.prefix import dense_ids
from loamgraph.session import cut

#: Half rounds at most, as 50 sweeps.
ROUNDS = 100


#: Edges up to which one task moves all nodes, one after the other.
ONE_TASK = 4_000_000


def _swept(batches: Iterator[pa.RecordBatch], sweeps: int = ROUNDS // 2) -> Iterator[pa.RecordBatch]:
    """(a, c) of the undirected (x, y, w): sweeps over the nodes by name, each moving to the community of the largest gain, until none moves."""
    number: dict[str, int] = {}
    ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for b in batches:
        own = []
        for c in ("x", "y"):
            coded = b[c].dictionary_encode()
            known = np.array([number.setdefault(v, len(number)) for v in coded.dictionary.to_pylist()], np.int32)
            own.append(known[coded.indices.to_numpy()])
        ends.append((*own, b["w"].to_numpy()))
    names = sorted(number)
    rank = np.empty(len(names), np.int32)
    rank[[number[v] for v in names]] = np.arange(len(names), dtype=np.int32)
    x, y, w = (np.concatenate([e[i] for e in ends]) if ends else np.empty(0, np.int32) for i in range(3))
    del number, ends
    x, y = rank[x], rank[y]
    source, near, weight = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([w, w])
    order = np.argsort(source, kind="stable")
    near, weight, first = near[order], weight[order], np.searchsorted(source, np.arange(len(names) + 1), sorter=order).tolist()
    strength = np.bincount(source[order], weight, len(names)).tolist()
    del x, y, w, source, order
    whole, at, sums = sum(strength) or 1.0, list(range(len(names))), list(strength)
    for _ in range(sweeps):
        moved = False
        for v, (k, begin, end) in enumerate(zip(strength, first, first[1:], strict=False)):
            own, into = at[v], {}
            for u, w in zip(near[begin:end].tolist(), weight[begin:end].tolist(), strict=True):
                c = at[u]
                into[c] = into.get(c, 0.0) + w
            sums[own] -= k
            stay = into.pop(own, 0.0) - k * sums[own] / whole
            # The largest rounded gain; of equal ones its own community, else the least by name.
            best, gain, most = own, stay, round(stay, 9)
            for c, inside in into.items():
                g = inside - k * sums[c] / whole
                r = round(g, 9)
                if r > most or (r == most and best != own and c < best):
                    best, gain, most = c, g, r
            if best != own and gain > stay + 1e-9:
                at[v], moved = best, True
            sums[at[v]] += k
        if not moved:
            break
    yield pa.record_batch([pa.array(names, pa.string()), pa.array([names[c] for c in at], pa.string())], names=["a", "c"])


def modularity_labels(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, one_task: int = ONE_TASK) -> DataFrame:
    """(id, community): one level of local moving, in sweeps over the nodes.

    Up to ``one_task`` edges one task does it, a node after the other. Beyond that all nodes decide at once: in each round every node looks at the communities of its neighbours and takes the one of the largest gain in
    modularity. That all move at once would make neighbours swap for ever, so of each round only one half of the
    nodes may move, chosen by a hash of id and round, and ties fall to the least name. Rounds stop when no node, of either
    half, would move; a warning tells when ``rounds`` were not enough for that.
    Degrees and community sums are aggregates, so a hub is a key of a pre-aggregated shuffle, never a task's list.
    """
    weights = cut(edges.where("source != target").select(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y"), F.coalesce("weight", F.lit(1.0)).alias("w")).groupBy("x", "y").agg(F.sum("w").alias("w")))
    if weights.limit(one_task + 1).count() <= one_task:
        labels = weights.coalesce(1).mapInArrow(_swept, "a string, c string")
        return nodes.select("id").join(labels.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("c", "id").alias("community"))
    both = cut(weights.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b"), "w"), F.struct(F.col("y").alias("a"), F.col("x").alias("b"), "w"))).alias("e")).select("e.*"))
    strength = cut(both.groupBy("a").agg(F.sum("w").alias("k")))
    whole = strength.agg(F.sum("k")).first()[0] or 1.0
    labels = cut(strength.select(F.col("a").alias("id"), "k", F.col("a").alias("c")))
    for n in range(rounds):
        sums = labels.groupBy("c").agg(F.sum("k").alias("s"))
        near = both.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("into"))
        own = labels.select(F.col("id").alias("a"), "k", F.col("c").alias("own"))
        options = near.join(own, "a").join(sums, "c")
        rest = F.when(F.col("c") == F.col("own"), F.col("s") - F.col("k")).otherwise(F.col("s"))
        gain = F.col("into") - F.col("k") * rest / whole
        best = options.groupBy("a").agg(F.max_by(F.struct("c", gain.alias("g")), F.struct(F.round(gain, 9), F.col("c") == F.col("own"), F.xxhash64("c"))).alias("t"), F.max(F.when(F.col("c") == F.col("own"), gain)).alias("stay"))
        may = F.pmod(F.xxhash64(F.lit(n), "id"), F.lit(2)) == 0
        alone = F.coalesce("stay", F.lit(0.0))
        wants = F.coalesce((F.col("t.g") > alone + 1e-9) & (F.col("t.g") > 1e-9) & (F.col("t.c") != F.col("c")), F.lit(False))
        moved = cut(labels.join(best.withColumnRenamed("a", "id"), "id", "left").select("id", "k", F.when(may & wants, F.col("t.c")).otherwise(F.col("c")).alias("c"), wants.alias("wants")))
        labels = moved.select("id", "k", "c")
        if moved.where("wants").isEmpty():
            break
    else:
        warnings.warn(f"nodes still move after {rounds} half rounds", stacklevel=2)
    return nodes.select("id").join(labels.select("id", "c"), "id", "left").select("id", F.coalesce("c", "id").alias("community"))


def clusters(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, community): modularity labels, any larger than max(n / 4, 10) cut in halves once, numbered by size."""
    labels = cut(modularity_labels(nodes, edges, rounds))
    most = max(labels.count() / 4, 10)
    sizes = labels.groupBy("community").agg(F.count("*").alias("n"))
    big = labels.join(sizes.where(F.col("n") > most), "community")
    half = big.select("id", F.concat("community", F.lit("/"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("string")).alias("part"))
    parts = labels.join(half, "id", "left").select("id", F.coalesce("part", "community").alias("part"))
    counted = parts.groupBy("part").agg(F.count("*").alias("n"))
    # Every isolated node is a community, so they are sorted in ranges, not in one task.
    order = [F.col("n").desc(), F.col("part").asc()]
    ranked = dense_ids(counted.repartitionByRange(*order).sortWithinPartitions(*order), "number")
    return parts.join(ranked, "part").select("id", F.col("number").cast("long").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Share of weight inside communities above that expected."""
    w = edges.where("source != target").select("source", "target", F.coalesce("weight", F.lit(1.0)).alias("w"))
    l = labels.select("id", "community")  # noqa: E741
    pairs = w.join(l.withColumnsRenamed({"id": "source", "community": "ca"}), "source").join(l.withColumnsRenamed({"id": "target", "community": "cb"}), "target")
    total, inside = pairs.agg(F.sum("w"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")))).first()
    sums = pairs.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "w"), F.struct(F.col("cb").alias("c"), "w"))).alias("e")).groupBy("e.c").agg(F.sum("e.w").alias("s"))
    squares = sums.agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    return (inside or 0.0) / total - squares / (4 * total * total) if total else 0.0


def top_nodes(nodes: DataFrame, edges: DataFrame, k: int, min_size: int) -> DataFrame:
    """(community, size, place, id, degree): the k best connected plain nodes of each community."""
    own = nodes.withColumn("community", F.coalesce("community", F.lit(0)))
    sizes = own.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    rows = with_degrees(own.where(plain_node()).select("id", "community"), edges)
    place = F.row_number().over(W.partitionBy("community").orderBy(F.col("degree").desc(), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= k).join(sizes, "community").select("community", "size", "place", "id", "degree")


def top_files(nodes: DataFrame, k: int, min_size: int) -> DataFrame:
    """(community, size, place, source_file, nodes): the k files with most nodes of each community."""
    own = nodes.withColumn("community", F.coalesce("community", F.lit(0)))
    sizes = own.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    files = own.where("source_file != ''").groupBy("community", "source_file").agg(F.count("*").alias("nodes"))
    place = F.row_number().over(W.partitionBy("community").orderBy(F.col("nodes").desc(), "source_file"))
    return files.withColumn("place", place).where(F.col("place") <= k).join(sizes, "community").select("community", "size", "place", "source_file", "nodes")


def community_labels(nodes: DataFrame) -> DataFrame:
    """(community, label): the label of the first member."""
    return nodes.groupBy(F.coalesce("community", F.lit(0)).alias("community")).agg(F.min_by("label", "id").alias("label"))


def neighbours_across(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(community_a, community_b, pairs): connected pairs of nodes between communities."""
    c = nodes.select("id", F.coalesce("community", F.lit(0)).alias("community"))
    pairs = adjacency(edges).where("a < b").join(c.withColumnsRenamed({"id": "a", "community": "x"}), "a").join(c.withColumnsRenamed({"id": "b", "community": "y"}), "b").where("x != y")
    return pairs.groupBy(F.least("x", "y").alias("community_a"), F.greatest("x", "y").alias("community_b")).agg(F.count("*").alias("pairs"))
