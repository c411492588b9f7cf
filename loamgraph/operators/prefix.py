"""Prefix sums and dense numbers over groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.session import cut


#: Partitions whose counts are sent to every task.
MOST_TASKS = 1_000_000


def prefix_sums(df: DataFrame, keys: list[str], bin_: str, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds to each row, per name of ``sums``, the sum over the rows of its keys that come before it.

    ``bin_`` must not decrease along ``order`` within the keys. Sorting happens within a bin only; across bins
    go the bins' totals, a row per bin.
    """
    values = {f"_{n}": c for n, c in sums.items()}
    df = df.withColumns(values)
    inner = W.partitionBy(*keys, bin_).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy(bin_).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bin_).agg(*(F.sum(v).alias(v) for v in values))
    before = totals.select(*keys, bin_, *(F.coalesce(F.sum(v).over(across), F.lit(0)).alias(f"{v}_before") for v in values))
    own = df.select(*[c for c in df.columns if c not in values], *(F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"{v}_own") for v in values))
    return own.join(before, [*keys, bin_]).select(*[c for c in df.columns if c not in values], *((F.col(f"_{n}_own") + F.col(f"_{n}_before")).alias(n) for n in sums))


def dense_ids(df: DataFrame, name: str) -> DataFrame:
    """Numbers the rows from 0 without gaps, in order of partitions. Across tasks goes a count per partition, of which there must not be over MOST_TASKS."""
    mask = (1 << 33) - 1
    df = cut(df)
    if df.rdd.getNumPartitions() > MOST_TASKS:
        raise ValueError(f"more than {MOST_TASKS} partitions")
    df = df.withColumn("_at", F.monotonically_increasing_id())
    rows = df.withColumns({"_pid": F.shiftright("_at", 33), "_no": F.col("_at").bitwiseAND(F.lit(mask))}).drop("_at")
    counts = rows.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = counts.select("_pid", F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_pid").withColumn(name, F.col("_before") + F.col("_no")).drop("_pid", "_no", "_before")
