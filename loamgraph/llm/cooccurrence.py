"""Items that appear together: an external sort of packed 64-bit pair codes.

Items get dense 32-bit numbers, a pair is one 64-bit code. Each task packs the codes of its records, sorts and
run-length counts them in runs of bounded size; the runs are shuffled by code, where Spark's sort spills sorted
runs and merges them, and a pass over the sorted codes adds up each code's counts. The counts give weights,
lift and an odds ratio with continuity correction.

Before any pair is formed, items go that can be in no reported pair: with fewer than ``least`` records, or, as
together <= records of the rarer item, with more than total / lift records; this is exact and takes out the items
that occur nearly everywhere. Records of more than ``large`` remaining items are not expanded. They are counted from
the other side: items by the set of large records they are in. Pairs that small records already gave look up how many large
ones they share; pairs in large records only are found between sets that share ``least`` records or more, and
only those sets are expanded that make reported pairs.

Nulls, ties and odd input: rows with a null or empty item, or without group or record, are ignored, and so are
records without items; repeated items of a record count once; a group is counted for itself; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.prefix import dense_ids
from loamgraph.session import cut

#: Items of the largest record whose pairs are formed, and codes of a run.
LARGE, RUN = 2000, 4_000_000


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of (code, n) from lists of ascending numbers."""
    parts: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(parts), return_counts=True)
        parts.clear()
        return pa.record_batch([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    for b in batches:
        values, bounds = b["items"].flatten().to_numpy().astype(np.int64), b["items"].offsets.to_numpy()
        bounds = bounds - bounds[0]
        for i in range(b.num_rows):
            own = values[bounds[i] : bounds[i + 1]]
            x, y = np.triu_indices(len(own), 1)
            parts.append(own[x] << 32 | own[y])
            held += len(x)
            if held >= RUN:
                yield flush()
                held = 0
    if held:
        yield flush()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up runs of equal codes in a sorted stream; the last code of a batch waits for the next."""
    last, carried = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        codes, n = b["code"].to_numpy(), b["n"].to_numpy()
        starts = np.concatenate([[0], np.nonzero(np.diff(codes))[0] + 1])
        keys, sums = codes[starts], np.add.reduceat(n, starts)
        if last is not None:
            if keys[0] == last:
                sums[0] += carried
            else:
                keys, sums = np.concatenate([[last], keys]), np.concatenate([[carried], sums])
        last, carried = keys[-1], sums[-1]
        yield pa.record_batch([pa.array(keys[:-1]), pa.array(sums[:-1])], names=["code", "n"])
    if last is not None:
        yield pa.record_batch([pa.array([last], pa.int64()), pa.array([carried], pa.int64())], names=["code", "n"])


def _pair(a: Column, b: Column) -> Column:
    return F.shiftleft(F.least(a, b), 32).bitwiseOR(F.greatest(a, b))


def _in_large(items: DataFrame, rows: DataFrame, small: DataFrame, least: int, lift: float, weight: float) -> DataFrame:
    """(code, n) of the pairs that share large records: n is all their common records."""
    sets = cut(rows.groupBy("id").agg(F.array_sort(F.collect_set("record")).alias("own")))
    a, b = F.shiftrightunsigned("code", 32), F.col("code").bitwiseAND((1 << 32) - 1)
    known = small.withColumns({"a": a, "b": b}).join(sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    known = known.select("code", F.size(F.array_intersect("x", "y")).cast("long").alias("n"))
    # Items with the same large records and as many records in all are alike for every test.
    members = cut(sets.where(F.size("own") >= least).join(items.select("id", "c", "total"), "id").withColumn("kind", F.xxhash64("own", "c")))
    kinds = cut(members.groupBy("kind").agg(F.first("own").alias("own"), F.first("c").alias("c"), F.first("total").alias("total")))
    first = kinds.select("kind", F.explode(F.slice("own", F.lit(1), F.size("own") - (least - 1))).alias("record"))
    met = first.alias("p").join(first.alias("q"), "record").where("p.kind <= q.kind").select(F.col("p.kind").alias("p"), F.col("q.kind").alias("q")).distinct()
    p, q = (kinds.select(F.col("kind").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("own", "c", "total"))) for k in "pq")
    n = F.size(F.array_intersect("p_own", "q_own"))
    hits = met.join(p, "p").join(q, "q").withColumn("n", n).where((F.col("n") >= least) & (F.col("n") * F.col("p_total") >= lift * F.col("p_c") * F.col("q_c")) & (F.col("n") >= weight * F.least("p_c", "q_c")))
    pairs = hits.join(members.select(F.col("kind").alias("p"), F.col("id").alias("a")), "p").join(members.select(F.col("kind").alias("q"), F.col("id").alias("b")), "q").where("a != b AND (p < q OR a < b)")
    only = pairs.select(_pair(F.col("a"), F.col("b")).alias("code"), F.col("n").cast("long").alias("n")).join(small.select("code"), "code", "left_anti")
    return known.unionByName(only)


def together(rows: DataFrame, group: str, record: str, item: Column, least: int = 5, lift: float = 3.0, weight: float = 0.4, large: int = LARGE) -> DataFrame:
    """(group, item_a, item_b, together, records_a, records_b, records, weight_a, weight_b, lift, odds_ratio).

    Reported are the pairs of a group with ``least`` common records or more, at least ``lift`` times those of chance,
    and at least ``weight`` of the records of one of the two.
    """
    clean = rows.select(F.col(group).alias("group"), F.col(record).alias("record"), item.alias("item")).where("item != '' AND group IS NOT NULL AND record IS NOT NULL").distinct()
    clean = cut(clean)
    totals = clean.groupBy("group", "record").agg(F.lit(1).alias("one")).groupBy("group").agg(F.count("*").alias("total"))
    items = clean.groupBy("group", "item").agg(F.count("*").alias("c")).where(F.col("c") >= least).join(totals, "group").where(F.col("c") * lift <= F.col("total"))
    items = cut(dense_ids(items, "id"))
    if (items.agg(F.max("id")).first()[0] or 0) >= 1 << 31:
        raise ValueError("more items than 31 bits can number")
    kept = cut(clean.join(items.select("group", "item", "id"), ["group", "item"]).select("group", "record", "id"))
    sizes = kept.groupBy("group", "record").agg(F.count("*").alias("n"))
    big = cut(sizes.where(F.col("n") > large).select("group", "record"))
    lists = kept.join(big, ["group", "record"], "left_anti").groupBy("group", "record").agg(F.array_sort(F.collect_list("id")).alias("items")).where(F.size("items") > 1)
    counted = lists.select("items").mapInArrow(_runs, "code long, n long")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = cut(counted.repartition(parts, "code").sortWithinPartitions("code").mapInArrow(_merged, "code long, n long"))
    if not big.isEmpty():
        in_big = kept.join(big, ["group", "record"]).select("id", F.xxhash64("group", "record").alias("record"))
        pairs = pairs.unionByName(_in_large(items, cut(in_big), pairs, least, lift, weight)).groupBy("code").agg(F.sum("n").alias("n"))
    often = pairs.where(F.col("n") >= least).withColumns({"x": F.shiftrightunsigned("code", 32), "y": F.col("code").bitwiseAND((1 << 32) - 1)})
    a = items.select(F.col("id").alias("x"), F.col("group"), F.col("item").alias("i"), F.col("c").alias("ci"), "total")
    b = items.select(F.col("id").alias("y"), F.col("item").alias("j"), F.col("c").alias("cj"))
    both = often.join(a, "x").join(b, "y")
    swap = F.col("i") > F.col("j")
    pick = lambda m, o, name: F.when(swap, F.col(m)).otherwise(F.col(o)).alias(name)
    out = both.select("group", pick("j", "i", "item_a"), pick("i", "j", "item_b"), F.col("n").alias("together"), pick("cj", "ci", "records_a"), pick("ci", "cj", "records_b"), F.col("total").alias("records"))
    t, ca, cb, n = F.col("together"), F.col("records_a"), F.col("records_b"), F.col("records")
    out = out.where((t * n >= lift * ca * cb) & (F.greatest(t / ca, t / cb) >= weight))
    odds = (t + 0.5) * (n - ca - cb + t + 0.5) / ((ca - t + 0.5) * (cb - t + 0.5))
    return out.select(F.col("group").alias(group), "item_a", "item_b", "together", "records_a", "records_b", "records", (t / ca).alias("weight_a"), (t / cb).alias("weight_b"), (t * n / (ca * cb)).alias("lift"), odds.alias("odds_ratio"))
