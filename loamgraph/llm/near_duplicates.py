"""Near-duplicate records: an exact set-similarity join on a token-group matrix.

Records become sets of distinct words, equal sets one class. Blocks of classes of similar size are partitioned
into groups of similar classes by balanced bisection, and of each group the union of its tokens is stored: the
matrix of groups by tokens, as bits. The most frequent tokens (counted over all records) have a column each, the
others share hashed columns. A query's bits against a group's bits bound the overlap with every member from
above; only groups whose bound reaches what the threshold asks of their least member are opened, there the
members' own bits bound again, and what is left is compared on its real words. No bound is below the truth, so
no pair is lost, whatever tokens are frequent: there is no posting list to be hot. A query meets only the blocks
whose sizes can qualify, one per block and slice of the queries; each unit of work is a bounded block against a
stream of queries.

Nulls, ties and odd input: null texts are empty; records without key, and records with fewer than ``min_words``
words, are in no pair; repeated rows of a key count once, at their earliest; equal sets are similar at 1; very
long texts are compared whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.session import cut

#: Columns of the matrix: FREQUENT tokens of their own, then HASHED shared ones.
FREQUENT, HASHED = 512, 256
WORDS = (FREQUENT + HASHED) // 64
#: Members of a group, classes of a block, queries of a slice.
GROUP, BLOCK, SLICE = 8, 8192, 65_536
#: Records of a class in one part when its pairs are written out.
PART = 2000
#: A band holds the sizes from STEP**b up to STEP**(b+1).
STEP = 1.15


def word_set(*texts: Column) -> Column:
    """Distinct maximal runs of letters and digits, lower case, in order."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts)))
    return F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)))


def classes(records: DataFrame, key: str, texts: list[str], time: str | None, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(id, tokens, n) per distinct word set, and (id, key) of its records."""
    own = records.select(F.col(key).alias("key"), F.struct(*([F.col(time)] if time else []), *texts).alias("r")).where("key IS NOT NULL").groupBy("key").agg(F.min("r").alias("r"))
    sets = own.select("key", word_set(*(F.col(f"r.{t}") for t in texts)).alias("tokens")).where(F.size("tokens") >= min_words)
    sets = cut(sets.select("key", "tokens", F.xxhash64("tokens").alias("a"), F.xxhash64(F.reverse("tokens")).alias("b")))
    one = cut(sets.groupBy("a", "b").agg(F.first("tokens").alias("tokens"))).withColumn("id", F.monotonically_increasing_id())
    one = cut(one.select("id", "a", "b", "tokens", F.size("tokens").alias("n")))
    return one.select("id", "tokens", "n"), sets.select("key", "a", "b").join(one.select("id", "a", "b"), ["a", "b"]).select("id", "key")


def _bits(rows: DataFrame, frequent: list[str]) -> DataFrame:
    """(id, n, extra, bits): extra is the number of tokens that share a hashed column with another of the class."""
    own = pa.array(frequent, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, hashes = b["tokens"], b["hashes"]
            at = pc.index_in(tokens.flatten(), own).to_numpy(zero_copy_only=False)
            shared = hashes.flatten().to_numpy(zero_copy_only=False)
            column = np.where(np.isnan(at), FREQUENT + shared, at).astype(np.int64) if at.dtype.kind == "f" else at.astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), np.diff(tokens.offsets.to_numpy()))
            bits = np.zeros((b.num_rows, WORDS * 64), np.uint8)
            bits[row, column] = 1
            n = b["n"].to_numpy()
            packed = np.packbits(bits, axis=1, bitorder="little")
            yield pa.record_batch([b["id"], b["n"], pa.array(n - bits.sum(1, dtype=np.int32), pa.int32()), pa.array([x.tobytes() for x in packed], pa.binary())], names=["id", "n", "extra", "bits"])

    hashed = rows.select("id", "n", "tokens", F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(HASHED)).cast("int")).alias("hashes"))
    return hashed.mapInArrow(run, "id long, n int, extra int, bits binary")


def _arrays(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(t.num_rows, WORDS)
    return t["id"].to_numpy(), t["n"].to_numpy(), t["extra"].to_numpy(), bits


def _grouped(bits: np.ndarray) -> np.ndarray:
    """An order in which each GROUP rows are alike: halves again and again, along the direction between two far rows."""
    x = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    order, todo = np.arange(len(x)), [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= GROUP:
            continue
        own = x[order[lo:hi]]
        a = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
        b = own[np.argmax(((own - a) ** 2).sum(1))]
        half = GROUP * max(1, (hi - lo) // (2 * GROUP))
        order[lo:hi] = order[lo:hi][np.argpartition(own @ (a - b), half - 1)]
        todo += [(lo, lo + half), (lo + half, hi)]
    return order


def _build(t: pa.Table) -> pa.Table:
    """One row per block: members in the order of their groups, as bytes."""
    i, n, extra, bits = _arrays(t)
    order = _grouped(bits)
    payload = [i[order].astype(np.int64), n[order].astype(np.int32), extra[order].astype(np.int32), bits[order]]
    return pa.table([t["block"][:1], pa.array([int(n.min())], pa.int32()), pa.array([int(n.max())], pa.int32()), pa.array([b"".join(p.tobytes() for p in payload)], pa.binary())], names=["block", "lo", "hi", "payload"])


class _Block:
    def __init__(self, payload: bytes) -> None:
        size = len(payload) // (16 + 8 * WORDS)
        self.ids = np.frombuffer(payload, np.int64, size)
        self.n, self.extra = np.frombuffer(payload, np.int32, 2 * size, 8 * size).reshape(2, size).astype(np.int64)
        self.bits = np.frombuffer(payload, np.uint64, size * WORDS, 16 * size).reshape(size, WORDS)
        starts = np.arange(0, size, GROUP)
        self.union, self.least = np.bitwise_or.reduceat(self.bits, starts, 0), np.minimum.reduceat(self.n, starts)

    def candidates(self, i: np.ndarray, n: np.ndarray, extra: np.ndarray, bits: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Query and member ids of the pairs the bounds let through, the larger (size, id) as the query."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        first, groups = FREQUENT // 64, len(self.least)
        # Of the frequent tokens the overlap is counted for all groups, the hashed ones may all be shared; then for what is left.
        rest = (n - np.bitwise_count(bits[:, :first]).sum(1, dtype=np.int64)).astype(np.int32)
        kind = np.uint8 if len(n) and n.max() < 256 else np.uint16
        columns = [np.ascontiguousarray(self.union[:, w]) for w in range(first)]
        step = max(1, 65_536 // groups)  # buffers that stay in the processor's cache
        both, count, most = np.empty((step, groups), np.uint64), np.empty((step, groups), np.uint8), np.empty((step, groups), kind)
        needed = lambda r, g: np.ceil(t / (1 + t) * (n[r] + self.least[g]) - 1e-9)
        for s in range(0, len(i), step):
            rows = min(step, len(i) - s)
            x, c, m = both[:rows], count[:rows], most[:rows]
            m[:] = 0
            for w in range(first):
                np.bitwise_and(bits[s : s + rows, w, None], columns[w], out=x)
                np.bitwise_count(x, out=c)
                np.add(m, c, out=m)
            # The least member of all groups asks least.
            r, g = np.nonzero(m >= np.maximum(0, np.ceil(t / (1 + t) * (n[s : s + rows] + self.least.min()) - 1e-9) - rest[s : s + rows])[:, None])
            r += s
            keep = np.bitwise_count(bits[r] & self.union[g]).sum(1, dtype=np.int64) + extra[r] >= needed(r, g)
            r, g = r[keep], g[keep]
            if not len(r):
                continue
            member = (g[:, None] * GROUP + np.arange(GROUP)).ravel()
            r = np.repeat(r, GROUP)
            keep = member < len(self.ids)
            r, member = r[keep], member[keep]
            keep = (self.n[member] < n[r]) | (self.n[member] == n[r]) & (self.ids[member] < i[r])
            r, member = r[keep], member[keep]
            shared = np.bitwise_count(bits[r] & self.bits[member]).sum(1, dtype=np.int64) + np.minimum(extra[r], self.extra[member])
            keep = shared >= np.ceil(t / (1 + t) * (n[r] + self.n[member]) - 1e-9)
            found.append((i[r[keep]], self.ids[member[keep]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def similar_classes(sets: DataFrame, threshold: float, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """(a, b, similarity) of the class pairs at ``threshold`` or more."""
    spark = sets.sparkSession
    counted = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    frequent = [r.t for r in counted.orderBy(F.col("df").desc(), "t").limit(FREQUENT).collect()]
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(STEP)).cast("int")
    rows = cut(_bits(sets, frequent).withColumn("band", band))
    # At most a row per band, of which there are log(longest text) / log(STEP).
    sizes = {r.band: r["count"] for r in rows.groupBy("band").count().collect()}
    if not sizes:
        return spark.createDataFrame([], "a long, b long, similarity double")
    blocks_of = {b: math.ceil(n / block) for b, n in sizes.items()}
    first, at = {}, 0
    for b in sorted(blocks_of):
        first[b], at = at, at + blocks_of[b]
    pick = lambda m: F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), F.col("band"))
    placed = rows.withColumn("block", pick(first) + F.pmod(F.xxhash64("id"), pick(blocks_of)).cast("int"))
    built = cut(placed.groupBy("block").applyInArrow(_build, "block int, lo int, hi int, payload binary"))
    # Slices keep one block from meeting all queries in one task.
    slices = max(1, math.ceil(sum(sizes.values()) / slice_))
    per_band = {b: list(range(first[b], first[b] + blocks_of[b])) for b in first}
    lowest = F.floor(F.log(F.greatest(F.col("n") * threshold - 1e-9, F.lit(1.0))) / math.log(STEP)).cast("int") - 1
    bands = F.explode(F.sequence(F.greatest(lowest, F.lit(min(first))), F.col("band"))).alias("to_band")
    known = F.create_map(*(x for b, ids in per_band.items() for x in (F.lit(b), F.struct(F.lit(ids[0]).alias("from"), F.lit(ids[-1]).alias("to")))))
    asked = rows.select("id", "n", "extra", "bits", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("part"), bands).withColumn("r", F.element_at(known, F.col("to_band"))).where("r IS NOT NULL")
    asked = asked.select(F.explode(F.sequence("r.from", "r.to")).alias("block"), "part", F.lit(1).alias("tag"), "id", "n", "extra", "bits")
    given = built.select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part"), F.lit(0).alias("tag"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("n"), F.lit(0).alias("extra"), F.col("payload").alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for b in batches:
            key = b["block"].to_numpy().astype(np.int64) * slices + b["part"].to_numpy()
            tags, start = b["tag"].to_numpy(), 0
            edges = [*(np.nonzero((np.diff(key) != 0) | (np.diff(tags) != 0))[0] + 1), b.num_rows]
            for end in edges:
                part = b.slice(start, end - start)
                if end > start and tags[start] == 0:
                    current = _Block(part["bits"][0].as_py())
                elif end > start and current is not None:
                    i, n, extra, bits = _arrays(part)
                    x, y = current.candidates(i, n.astype(np.int64), extra.astype(np.int64), bits, threshold)
                    if len(x):
                        yield pa.record_batch([pa.array(x), pa.array(y)], names=["x", "y"])
                start = end

    units = at * slices
    work = given.unionByName(asked).repartition(max(1, min(units, 4 * spark.sparkContext.defaultParallelism + units // 8)), "block", "part").sortWithinPartitions("block", "part", "tag")
    pairs = cut(work.mapInArrow(run, "x long, y long"))
    both = F.size(F.array_intersect("tokens_x", "tokens_y"))
    checked = pairs.join(sets.select(F.col("id").alias("x"), F.col("tokens").alias("tokens_x")), "x").join(sets.select(F.col("id").alias("y"), F.col("tokens").alias("tokens_y")), "y")
    checked = checked.select("x", "y", (both / (F.size("tokens_x") + F.size("tokens_y") - both)).alias("similarity")).where(F.col("similarity") >= threshold)
    return checked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def similar_pairs(records: DataFrame, key: str, texts: list[str], threshold: float = 0.6, min_words: int = 12, time: str | None = None, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """(key_a, key_b, similarity) of all pairs of different keys, key_a < key_b."""
    sets, members = classes(records, key, texts, time, min_words)
    members, links = cut(members), cut(similar_classes(sets, threshold, block, slice_))
    # Records of one class are dealt to parts of about PART, and what meets the class meets each part: no key has them all.
    sizes = members.groupBy("id").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    sizes = cut(sizes)
    dealt = members.join(sizes, "id").select("id", "key", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    named = lambda s: dealt.select(F.col("id").alias(s), F.col("key").alias(f"k{s}"), F.col("part").alias(f"part_{s}"))
    spread = lambda df, s: df.join(sizes.select(F.col("id").alias(s), "parts"), s).withColumn(f"part_{s}", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    across = spread(spread(links, "a").join(named("a"), ["a", "part_a"]).drop("part_a"), "b").join(named("b"), ["b", "part_b"]).select("ka", "kb", "similarity")
    several = dealt.join(sizes.where("size > 1").select("id"), "id", "left_semi")
    twins = spread(several.select(F.col("id").alias("a"), F.col("key").alias("kb")), "a").join(named("a"), ["a", "part_a"])
    within = twins.where("ka < kb").select("ka", "kb", F.lit(1.0).alias("similarity"))
    return across.unionByName(within).select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "similarity")


def components(records: DataFrame, key: str, texts: list[str], threshold: float = 0.6, min_words: int = 12, time: str | None = None) -> DataFrame:
    """(key, group_key, links): per record the least key of its connected group, and the links of its text to other texts."""
    sets, members = classes(records, key, texts, time, min_words)
    members, links = cut(members), cut(similar_classes(sets, threshold))
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        # The least label of the neighbours, then that label's own label: the distance to the least node halves.
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, "a").select("a", F.least("label", "m").alias("m"), "label")
        jump = cut(step.join(labels.select(F.col("a").alias("m"), F.col("label").alias("l")), "m", "left").select("a", F.least("m", F.coalesce("l", "m")).alias("new"), "label"))
        labels = jump.select("a", F.col("new").alias("label"))
        if jump.where("new < label").isEmpty():
            break
    counts = both.groupBy("a").agg(F.count("*").alias("links"))
    out = members.join(labels.join(counts, "a").withColumnRenamed("a", "id"), "id", "left").select("key", F.coalesce("label", "id").alias("label"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    least = out.groupBy("label").agg(F.min("key").alias("group_key"))
    return out.join(least, "label").select(F.col("key").alias(key), "group_key", "links")
