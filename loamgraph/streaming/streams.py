"""Streams: rebuilds after a pause, commit feeds, new embeddings, retrieval counts, idle timers, and event windows.

All take a streaming DataFrame and give one, or start a query over it with a checkpoint of its own; state is bounded
by watermarks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamgraph.functions import text as T


def debounced(changes: DataFrame, pause: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """(project, kind, begun, ended, changes): bursts of changes (project, path, ts) that a pause ends; code before notes."""
    kind = F.when(T.file_kind(F.col("path")) == "code", "code").otherwise("notes")
    own = changes.withColumn("kind", kind).withWatermark("ts", late)
    return own.groupBy("project", F.session_window("ts", pause).alias("s")).agg(F.count("*").alias("changes"), F.min("kind").alias("kind")).select("project", "kind", F.col("s.start").alias("begun"), F.col("s.end").alias("ended"), "changes")


def rebuild(changes: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "3 seconds"):  # noqa: ANN201
    """Starts a query that hands each batch's distinct projects and paths to ``run``; without ``every``, what is there now."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return changes.writeStream.trigger(**trigger).option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: run(df.select("project", "path").distinct(), n)).start()


def new_commits(commits: DataFrame, late: str = "1 day") -> DataFrame:
    """Commits (hash, message, ts) once each, with their kind of knowledge."""
    return commits.withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash"]).withColumn("knowledge_type", T.commit_kind(F.col("message"))).where("knowledge_type IS NOT NULL")


def not_embedded(rows: DataFrame, embedded: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a stream without a vector of their model yet; the table of vectors is read anew for each batch."""
    return rows.join(embedded.select(F.col(key).alias(key), "model", F.lit(True).alias("known")), [key, "model"], "left").where("known IS NULL").drop("known")


def retrieval_counts(fetches: DataFrame, late: str = "1 day") -> DataFrame:
    """(uuid, fetches, last) so far."""
    return fetches.withWatermark("ts", late).groupBy("uuid").agg(F.count("*").alias("fetches"), F.max("ts").alias("last"))


def _idle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        seen, last = state.get
        state.remove()
        yield pd.DataFrame({"user": [key[0]], "requests": [seen], "last_us": [last]})
        return
    seen, last = state.get if state.exists else (0, 0)
    for b in batches:
        seen, last = seen + len(b), max(last, int(b["us"].max()))
    state.update((seen, last))
    state.setTimeoutTimestamp(last // 1000 + 300_000)


def idle_users(requests: DataFrame, late: str = "1 minute") -> DataFrame:
    """(user, requests, last_us) of users without a request (user, ts) for five minutes."""
    own = requests.withWatermark("ts", late).select("user", "ts", F.unix_micros("ts").alias("us"))
    return own.groupBy("user").applyInPandasWithState(_idle, "user string, requests long, last_us long", "seen long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) per window; an extension for event tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide or length).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("begun"), "event_type", "events", "value")
