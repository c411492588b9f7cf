"""Session helpers: cutting lineage on shared storage, and epoch times that do not depend on the session's time zone."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder of ``spark.checkpoint.dir`` and forget its lineage.

    A lost executor loses nothing, as the files are shared. A folder of our own is set only where
    the session names none and runs on one machine, as in tests; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loamgraph-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """As ``cut``, in compressed columns: for rows that are read several times, when each reading would shuffle them again."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(b)
            yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b["data"]:
                yield from pa.ipc.open_stream(data.as_py())

    return cut(df.mapInArrow(packed, "data binary")).mapInArrow(rows, df.schema)


def micros(df: DataFrame, name: str) -> Column:
    """Epoch microseconds (UTC) of a timestamp column, or of a column of epoch seconds."""
    kind = dict(df.dtypes)[name]
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    if kind == "timestamp":
        return F.unix_micros(F.col(name))
    return F.col(name).cast("long") * F.lit(1_000_000)


def month_of(us: Column) -> Column:
    """yyyy-MM (UTC) of epoch microseconds."""
    day = F.floor(us / F.lit(86_400_000_000)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
