"""The k most similar vectors of every vector: balanced posting lists with replicated borders.

Fit, on a bounded sample per model: balanced bisection (each half cut at the median along the direction between
two far points) down to as many leaves as the collection needs lists; a leaf's mean is a list's centroid, and the
centroids get a graph of their nearest among each other. Centroids and graph are bounded by MOST_LISTS and travel to
every task. Index, over every vector: a walk in the graph finds the nearest centroids; the vector is posted to the
nearest and, near a border, to all whose distance is within ``replicate`` times the nearest; it asks the lists within
``probe`` times, so well inside a list few are asked. Each list meets the queries that ask it as one matrix product
after another; long lists are cut into blocks which each meet these queries. Equal vectors form one class first, so a group of copies
costs one vector. A class takes its k nearest classes; among nodes the copies stand before the others.

Rest: the k-th best similarity so far (or ``least``) is a floor. A list that was not asked is ruled out where the angle
to its centroid less the list's radius is above the floor's angle. All others are met: groups of queries, neighbours by
their lists, stay in memory while the members of the lists that any of them needs pass by. So nothing is lost, and
where bounds rule out little, as in one Gaussian, the work is that of comparing all pairs.

The result equals brute force, in the tests too. Similarities are exact (double precision).

Nulls, ties and odd input: rows without node or model, and vectors that are not 4 x dim bytes, not finite or all zero
take no part; repeated rows of (node, model) count once, at their earliest valid; equal similarities are
ordered by node; a model with one vector has no neighbours; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.session import cut

#: Vectors of the sample per model and list, at most SAMPLE; vectors aimed at per list; most lists of a model.
PER_LIST, SAMPLE, LIST, MOST_LISTS = 32, 65_536, 400, 4096
#: Members of a list that one task takes at once, and queries.
BLOCK, QUERIES = 4096, 32_768
DEGREE, BEAM, ENTRIES, STEPS = 16, 24, 64, 8
#: Of the rest: least queries of a group and groups aimed at per model, members of one task about, error of angles at most.
LEAST_GROUP, GROUPS, MEMBERS, ANGLE = 1024, 24, 262_144, 1e-6


def bisect(x: np.ndarray, leaves: int) -> np.ndarray:
    """Centroids (unit length) of ``leaves`` balanced parts of ``x``."""
    out, todo = [], [(np.arange(len(x)), leaves)]
    while todo:
        own, n = todo.pop()
        if n <= 1 or len(own) < 2:
            mean = x[own].mean(0)
            out.append(mean / (np.linalg.norm(mean) or 1.0))
            continue
        part = x[own]
        a = part[np.argmax(((part - part.mean(0)) ** 2).sum(1))]
        b = part[np.argmax(((part - a) ** 2).sum(1))]
        for _ in range(4):  # two means
            near = part @ (a - b) > (a @ a - b @ b) / 2
            if near.all() or not near.any():
                break
            a, b = part[near].mean(0), part[~near].mean(0)
        left = n // 2
        half = min(len(own) - 1, max(1, round(len(own) * left / n)))
        order = np.argpartition(part @ (b - a), half - 1)
        todo += [(own[order[:half]], left), (own[order[half:]], n - left)]
    return np.asarray(out, np.float32)


class Centroids:
    """The centroids of one model and the graph that is walked to find the nearest of them."""

    def __init__(self, points: np.ndarray) -> None:
        self.points, k = points, len(points)
        degree = min(DEGREE, k - 1)
        self.near = np.zeros((k, degree), np.int64)
        for a in range(0, k, 1024):
            s = points[a : a + 1024] @ points.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
            self.near[a : a + 1024] = np.argpartition(-s, degree - 1, 1)[:, :degree] if degree else self.near[a : a + 1024]
        self.entries = np.random.default_rng(7).permutation(k)[:ENTRIES]

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the nearest centroids of each row, best first."""
        n = len(x)
        s = x @ self.points[self.entries].T
        ids, beam = np.broadcast_to(self.entries, s.shape), min(BEAM, len(self.points))
        done = np.zeros(s.shape, bool)
        for _ in range(STEPS if self.near.shape[1] else 0):
            # The best three that were not visited give their neighbours.
            open_ = np.where(done, -np.inf, s)
            pick = np.argpartition(-open_, min(2, open_.shape[1] - 1), 1)[:, :3]
            rows = np.arange(n)[:, None]
            done = done.copy()
            done[rows, pick] = True
            more = self.near[ids[rows, pick]].reshape(n, -1)
            t = np.matmul(self.points[more], x[:, :, None])[:, :, 0]
            ids, s, done = np.concatenate([ids, more], 1), np.concatenate([s, t], 1), np.concatenate([done, np.zeros(more.shape, bool)], 1)
            # The same centroid once; a visited copy stays.
            order = np.lexsort((~done, ids), axis=1)
            ids, s, done = (np.take_along_axis(v, order, 1) for v in (ids, s, done))
            s = np.where(np.concatenate([np.zeros((n, 1), bool), ids[:, 1:] == ids[:, :-1]], 1), -np.inf, s)
            keep = np.argpartition(-s, min(beam, s.shape[1]) - 1, 1)[:, :beam]
            ids, s, done = (np.take_along_axis(v, keep, 1) for v in (ids, s, done))
        order = np.argsort(-s, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)


def _matrix(vecs: pa.Array, dim: int) -> np.ndarray:
    """Rows of unit length in double precision."""
    x = np.frombuffer(b"".join(vecs.to_pylist()), "<f4").reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid_vectors(rows: DataFrame, node: str = "node_id") -> DataFrame:
    """(node, model, dim, vec), once per node and model; vec is little-endian float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for v in b["vec"].to_pylist():
                x = np.frombuffer(v, "<f4")
                keep.append(bool(np.isfinite(x).all() and x.any()))
            yield b.filter(pa.array(keep, pa.bool_()))

    sized = rows.select(F.col(node).alias("node"), "model", "dim", "vec", "updated_at").where("node IS NOT NULL AND model IS NOT NULL AND dim > 0 AND octet_length(vec) = 4 * dim")
    sound = sized.mapInArrow(run, sized.schema)
    return sound.groupBy("node", "model").agg(F.min(F.struct("updated_at", "dim", "vec")).alias("r")).select("node", F.concat_ws("/", "model", "r.dim").alias("model"), "r.dim", "r.vec")


def fit(classes: DataFrame, sizes: dict[str, tuple[int, int]], list_size: int = LIST) -> dict[str, Centroids]:
    """Centroids per model from a bounded sample: the rows whose hash lies below the share that gives enough of them."""
    out = {}
    for model, (n, dim) in sorted(sizes.items()):
        lists = max(1, min(MOST_LISTS, math.ceil(n / list_size)))
        wanted = min(SAMPLE, lists * PER_LIST)
        # A third more than wanted, so that chance leaves enough; the limit bounds what comes to the driver.
        below = 1.0 if n <= 4 * wanted else 1.33 * wanted / n
        drawn = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 40)) < int(below * (1 << 40))
        sample = classes.where((F.col("model") == model) & drawn).select("vec").limit(wanted).toArrow()
        out[model] = Centroids(bisect(_matrix(sample["vec"].combine_chunks(), dim).astype(np.float32), lists))
    return out


def nearest_classes(classes: DataFrame, k: int, least: float, replicate: float, probe: float, list_size: int, most_posted: int = 2, most_probed: int = 4) -> DataFrame:
    """(id, other, similarity): the k nearest of each of (id, model, dim, vec), of ``least`` or more."""
    spark = classes.sparkSession
    sizes = {r.model: (r.n, r.dim) for r in classes.groupBy("model").agg(F.count("*").alias("n"), F.first("dim").alias("dim")).collect()}
    if not sizes:
        return spark.createDataFrame([], "id long, other long, similarity double")
    shared = spark.sparkContext.broadcast({m: (c.points, c.near, c.entries) for m, c in fit(classes, sizes, list_size).items()})

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Centroids] = {}
        for b in batches:
            models = np.asarray(b["model"].to_pylist(), object)
            for model in sorted(set(models)):
                if model not in known:
                    known[model] = c = Centroids.__new__(Centroids)
                    c.points, c.near, c.entries = shared.value[model]
                own = b.filter(pa.array(models == model))
                x, dim = _matrix(own["vec"], own["dim"][0].as_py()).astype(np.float32), own["dim"][0].as_py()
                for a in range(0, len(x), 1024):
                    part = own.slice(a, 1024)
                    ids, s = known[model].search(x[a : a + 1024])
                    d = np.sqrt(np.maximum(0, 2 - 2 * s.astype(np.float64)))
                    first = d[:, :1] + 1e-9
                    for tag, ratio, most in ((0, replicate, most_posted), (1, probe, most_probed)):
                        row, at = np.nonzero(d[:, :most] <= ratio * first)
                        pick = pa.array(row)
                        yield pa.record_batch([pa.array([model] * len(row)), pa.array(ids[row, at].astype(np.int32)), pa.array(np.full(len(row), tag, np.int32)), pa.array(at.astype(np.int32)), part["id"].take(pick), pa.array(np.full(len(row), dim, np.int32)), part["vec"].take(pick)], names=["model", "list", "tag", "at", "id", "dim", "vec"])

    posted = all_posted = cut(classes.select("id", "model", "dim", "vec").mapInArrow(post, "model string, list int, tag int, at int, id long, dim int, vec binary"))
    # A row per list, of which there are at most MOST_LISTS a model.
    counts = posted.groupBy("model", "list").agg(F.ceil(F.sum(1 - F.col("tag")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.sum("tag") / QUERIES).cast("int").alias("slices"))
    posted = posted.join(F.broadcast(counts), ["model", "list"]).where("blocks > 0")
    member, asks = F.col("tag") == 0, F.col("tag") == 1
    spread = F.pmod(F.xxhash64("id"), F.when(member, F.col("blocks")).otherwise(F.col("slices"))).cast("int")
    # A member goes to its block for each slice of queries, a query to its slice for each block.
    other = F.explode(F.sequence(F.lit(0), F.when(member, F.greatest("slices", F.lit(1))).otherwise(F.col("blocks")) - 1)).alias("other")
    units = posted.withColumn("own", spread).select("*", other).select("model", "list", F.when(asks, F.col("other")).otherwise(F.col("own")).alias("block"), F.when(asks, F.col("own")).otherwise(F.col("other")).alias("slice"), "tag", "id", "dim", "vec")
    keys = ["model", "list", "block", "slice"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, x, gathered = None, np.zeros(0, np.int64), None, []
        for b in batches:
            key = list(zip(*(b[c].to_pylist() for c in keys), strict=True))
            tags, start = b["tag"].to_numpy(), 0
            edges = [i for i in range(1, b.num_rows) if key[i] != key[i - 1] or tags[i] != tags[i - 1]] + [b.num_rows]
            for end in edges:
                part = b.slice(start, end - start)
                if key[start] != current:
                    current, ids, x, gathered = key[start], np.zeros(0, np.int64), None, []
                if tags[start] == 0:
                    gathered.append(part)
                elif gathered or x is not None:
                    dim = part["dim"][0].as_py()
                    if x is None:
                        whole = pa.Table.from_batches(gathered)
                        ids, x, gathered = whole["id"].to_numpy(), _matrix(whole["vec"].combine_chunks(), dim), []
                    asking, own = _matrix(part["vec"], dim), part["id"].to_numpy()
                    for a in range(0, len(own), 512):
                        s = asking[a : a + 512] @ x.T
                        s[own[a : a + 512, None] == ids[None]] = -2
                        m = min(k, s.shape[1])
                        best = np.argpartition(-s, m - 1, 1)[:, :m]
                        values = np.take_along_axis(s, best, 1)
                        row, at = np.nonzero((values >= least) & (values > -2))
                        if len(row):
                            yield pa.record_batch([pa.array(own[a + row]), pa.array(ids[best[row, at]]), pa.array(np.minimum(values[row, at], 1.0))], names=["id", "other", "similarity"])
                start = end

    parts = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = units.repartition(parts, *keys).sortWithinPartitions(*keys, "tag").mapInArrow(meet, "id long, other long, similarity double")
    found = cut(_best(met, k))
    return _best(found.unionByName(_rest(all_posted, found, {m: v[0] for m, v in shared.value.items()}, k, least)), k)


def _best(met: DataFrame, k: int) -> DataFrame:
    """(id, other, similarity): the k best of each id, every pair once."""
    once = met.groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    place = F.row_number().over(W.partitionBy("id").orderBy(F.col("similarity").desc(), "other"))
    return once.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _rest(posted: DataFrame, found: DataFrame, points: dict[str, np.ndarray], k: int, least: float) -> DataFrame:
    """(id, other, similarity) that may still be among the k nearest, from the lists not asked that no bound rules out."""
    spark = posted.sparkSession
    centers = {m: p.astype(np.float64) / np.maximum(np.linalg.norm(p.astype(np.float64), axis=1, keepdims=True), 1e-30) for m, p in points.items()}
    sent = spark.sparkContext.broadcast(centers)

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angle, models = np.zeros(b.num_rows), np.asarray(b["model"].to_pylist(), object)
            for model in sorted(set(models)):
                at = np.nonzero(models == model)[0]
                own = b.take(pa.array(at))
                x = _matrix(own["vec"], own["dim"][0].as_py())
                angle[at] = np.arccos(np.clip((x * sent.value[model][own["list"].to_numpy()]).sum(1), -1, 1))
            yield pa.record_batch([b["model"], b["list"], pa.array(angle)], names=["model", "list", "angle"])

    # Every vector is at home in the list it was posted to first.
    homes = posted.where("tag = 0 AND at = 0").select("model", "list", "id", "dim", "vec")
    # A row per list, of which there are at most MOST_LISTS a model.
    stats = homes.mapInArrow(away, "model string, list int, angle double").groupBy("model", "list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    radius = {m: np.full(len(c), -np.inf) for m, c in centers.items()}
    count = {m: np.zeros(len(c), np.int64) for m, c in centers.items()}
    for r in stats:
        radius[r.model][r.list], count[r.model][r.list] = r.radius, r.n
    before = {m: np.cumsum(n) - n for m, n in count.items()}
    width = {m: min(QUERIES, max(LEAST_GROUP, math.ceil(n.sum() / GROUPS))) for m, n in count.items()}
    layout = spark.sparkContext.broadcast((radius, count, before, width))

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius, count, before, width = layout.value
        for b in batches:
            models = np.asarray(b["model"].to_pylist(), object)
            for model in sorted(set(models)):
                whole = b.filter(pa.array(models == model))
                for a in range(0, whole.num_rows, 1024):
                    own = whole.slice(a, 1024)
                    x, home = _matrix(own["vec"], own["dim"][0].as_py()), own["list"].to_numpy()
                    angle = np.arccos(np.clip(x @ sent.value[model].T, -1, 1)) - radius[model]
                    open_ = angle <= np.arccos(np.clip(own["floor"].to_numpy(), -1, 1))[:, None] + ANGLE
                    asked = own["asked"]
                    open_[np.repeat(np.arange(len(x)), np.diff(asked.offsets.to_numpy())), asked.flatten().to_numpy()] = False
                    group = (before[model][home] + own["spread"].to_numpy() % count[model][home]) // width[model]
                    keep = open_.any(1)
                    pick = pa.array(np.nonzero(keep)[0])
                    bits = [v.tobytes() for v in np.packbits(open_[keep], axis=1, bitorder="little")]
                    yield pa.record_batch([own["model"].take(pick), pa.array(group[keep].astype(np.int32)), own["id"].take(pick), own["dim"].take(pick), own["vec"].take(pick), own["floor"].take(pick), pa.array(bits, pa.binary())], names=["model", "group", "id", "dim", "vec", "floor", "bits"])

    floors = found.groupBy("id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("floor"))
    asked = posted.where("tag = 1").groupBy("id").agg(F.collect_set("list").alias("asked"))
    queries = homes.join(asked, "id").join(floors, "id", "left").withColumn("floor", F.greatest(F.coalesce("floor", F.lit(float(least))), F.lit(float(least)))).withColumn("spread", F.pmod(F.xxhash64("id"), F.lit(1 << 62)))
    queries = cut(queries.select("model", "list", "id", "dim", "vec", "floor", "asked", "spread").mapInArrow(need, "model string, group int, id long, dim int, vec binary, floor double, bits binary"))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple[str, int], int] = {}
            for m, g, bits in zip(b["model"].to_pylist(), b["group"].to_pylist(), b["bits"].to_pylist(), strict=True):
                total[m, g] = total.get((m, g), 0) | int.from_bytes(bits, "little")
            for (m, g), bits in total.items():
                lists = [i for i in range(bits.bit_length()) if bits >> i & 1]
                yield pa.record_batch([pa.array([m] * len(lists)), pa.array([g] * len(lists), pa.int32()), pa.array(lists, pa.int32())], names=["model", "group", "list"])

    pairs = queries.select("model", "group", "bits").mapInArrow(needed, "model string, group int, list int").distinct()
    # A member goes to the groups that need its list, a query to each slice of the lists.
    slices = max(1, math.ceil(max(int(n.sum()) for n in count.values()) / MEMBERS))
    given = homes.join(pairs, ["model", "list"]).select("model", "group", F.pmod(F.xxhash64("list"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("tag"), "list", "id", "dim", "vec", F.lit(0.0).alias("floor"), F.lit(None).cast("binary").alias("bits"))
    asking = queries.select("model", "group", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("tag"), F.lit(0).alias("list"), "id", "dim", "vec", "floor", "bits")
    keys = ["model", "group", "slice"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, gathered, ids, x, x32, floor, open_ = None, [], None, None, None, None, None
        for b in batches:
            key = list(zip(*(b[c].to_pylist() for c in (*keys, "tag", "list")), strict=True))
            edges = [i for i in range(1, b.num_rows) if key[i] != key[i - 1]] + [b.num_rows]
            start = 0
            for end in edges:
                part, (*unit, tag, list_) = b.slice(start, end - start), key[start]
                start = end
                if unit != current:
                    current, gathered, ids = unit, [], None
                if tag == 0:
                    gathered.append(part)
                    continue
                if ids is None and not gathered:
                    continue
                dim = part["dim"][0].as_py()
                if ids is None:
                    whole = pa.Table.from_batches(gathered)
                    ids, x, floor, gathered = whole["id"].to_numpy(), _matrix(whole["vec"].combine_chunks(), dim), whole["floor"].to_numpy().copy(), []
                    x32, open_ = x.astype(np.float32), np.frombuffer(b"".join(whole["bits"].to_pylist()), np.uint8).reshape(len(ids), -1)
                rows = np.nonzero(open_[:, list_ >> 3] >> (list_ & 7) & 1)[0]
                y, others, error = _matrix(part["vec"], dim), part["id"].to_numpy(), (dim + 8) * 1.2e-7
                y32 = y.astype(np.float32).T
                for a in range(0, len(rows), 512):
                    r = rows[a : a + 512]
                    s = x32[r] @ y32
                    # Single precision only leaves out; what it lets through is compared in double.
                    hit = np.nonzero(s.max(1) >= floor[r] - error)[0]
                    if not len(hit):
                        continue
                    s, low = s[hit], floor[r[hit]] - error
                    if s.shape[1] > k:
                        low = np.maximum(low, np.partition(s, s.shape[1] - k, 1)[:, -k] - 2 * error)
                    q, c = np.nonzero(s >= low[:, None])
                    q = r[hit[q]]
                    other = ids[q] != others[c]
                    q, c = q[other], c[other]
                    value = np.concatenate([np.zeros(0), *((x[q[i : i + QUERIES]] * y[c[i : i + QUERIES]]).sum(1) for i in range(0, len(q), QUERIES))])
                    order = np.lexsort((others[c], -value, q))
                    q, c, value = q[order], c[order], np.minimum(value[order], 1.0)
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    last = place == k - 1
                    floor[q[last]] = np.maximum(floor[q[last]], value[last])
                    keep = (place < k) & (value >= least)
                    if keep.any():
                        yield pa.record_batch([pa.array(ids[q[keep]]), pa.array(others[c[keep]]), pa.array(value[keep])], names=["id", "other", "similarity"])

    parts = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return given.unionByName(asking).repartition(parts, *keys).sortWithinPartitions(*keys, "tag", "list").mapInArrow(meet, "id long, other long, similarity double")


def neighbors(rows: DataFrame, k: int = 5, least: float = -1.0, replicate: float = 1.15, probe: float = 1.5, list_size: int = LIST, node: str = "node_id") -> DataFrame:
    """(node, model, other, similarity, place): the k nearest of every node within its model, of ``least`` or more."""
    vectors = cut(valid_vectors(rows, node))
    classes = cut(cut(vectors.groupBy("model", "dim", "vec").agg(F.count("*").alias("size"))).withColumn("id", F.monotonically_increasing_id()))
    members = cut(vectors.join(classes.select("model", "vec", "id"), ["model", "vec"]).select("id", "model", "node"))
    near = nearest_classes(classes, k, least, replicate, probe, list_size)
    # Of a class no more than its first k + 1 nodes can be among the k nearest of any node.
    first = cut(members.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("node"))).where(F.col("n") <= k + 1))
    copies = first.join(classes.where("size > 1").select("id"), "id", "left_semi").select("id", F.col("node").alias("other"), F.lit(1.0).alias("similarity"))
    others = near.join(first.where(F.col("n") <= k).select(F.col("id").alias("other"), F.col("node").alias("name")), "other").select("id", F.col("name").alias("other"), "similarity")
    pool = copies.unionByName(others)
    pool = pool.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(F.col("similarity").desc(), "other"))).where(F.col("n") <= k + 1).drop("n")
    pairs = members.join(pool, "id").where("node != other")
    place = F.row_number().over(W.partitionBy("model", "node").orderBy(F.col("similarity").desc(), "other"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).select(F.col("node").alias(node), F.substring_index("model", "/", 1).alias("model"), "other", "similarity", "place")
