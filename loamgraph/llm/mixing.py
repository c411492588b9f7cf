"""Mixing sources to target weights by a min-cost flow.

Documents are aggregated by the set of sources they belong to. A network routes tokens from each such pattern to
the quotas of its sources: the first use of a pattern's tokens costs nothing, each repetition one more than the one
before (so repetitions are spread as evenly as the quotas allow), and no source takes a document more often than its
limit. Without a given total, the largest is taken for which all shares can be met. The flow says how many tokens
each source takes from each pattern; which documents those are follows from a seeded order: the pattern's documents
laid out in that order, again for each repetition, and cut where the flow ends.

What crosses to the driver is a row per pattern and per target, never documents. A source with any share of all rows is
ordered in bins of the seeded hash, so no task sorts a whole source.

Nulls, ties and odd input: documents without a source of the targets, without id or without tokens are left out;
repeated rows of an id count once, with the sources of all of them and the least number of tokens; a source with share 0 or without documents takes nothing, and then the total counts
without its share; equal hashes are ordered by id; an empty table gives no documents and a report of zeros; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.operators.prefix import prefix_sums
from loamgraph.session import cut

BINS = 1024
#: Patterns the driver takes; more is an error, not a cut.
MOST_PATTERNS = 100_000
#: Patterns times sources, which the driver holds as two matrices of 8 bytes a cell; more is an error.
MOST_CELLS = 10_000_000


@dataclass(frozen=True)
class Target:
    share: float
    repeats: int


class Routing:
    """A flow of tokens from patterns to sources, as a matrix; paths through many patterns are augmented at once.

    Only the first arc of a path costs something (the repetition it opens), so the cheapest flow opens one repetition
    after the other and each time sends what it can. A path leads from a pattern with tokens left to a source, and on
    by moving tokens of shared patterns from one source to the next, to a source below its quota. For a move between
    two sources all their patterns count together, so there are as many paths as sources ask for, not as patterns do.
    """

    def __init__(self, patterns: Mapping[tuple[str, ...], int], targets: Mapping[str, Target]) -> None:
        self.names, self.keys = sorted(targets), sorted(patterns)
        at = {s: i for i, s in enumerate(self.names)}
        if len(self.keys) * len(self.names) > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} sets of sources times sources")
        self.n = np.array([patterns[p] for p in self.keys], np.int64)
        repeats = np.array([targets[s].repeats for s in self.names], np.int64)
        self.limit = np.zeros((len(self.names), len(self.keys)), np.int64)  # a row per source
        for i, p in enumerate(self.keys):
            for s in p:
                self.limit[at[s], i] = self.n[i] * targets[s].repeats
        self.most = (self.limit > 0).T.astype(np.int64) * repeats
        self.most = self.most.max(1) if len(self.names) else np.zeros(len(self.keys), np.int64)
        self.shares = [targets[s].share for s in self.names]
        self.start()

    def start(self) -> None:
        self.flow, self.used = np.zeros_like(self.limit), np.zeros_like(self.n)

    def quotas(self, total: int) -> np.ndarray:
        return np.array([int(w * total) for w in self.shares], np.int64)

    def _levels(self, left: np.ndarray) -> tuple[list[int], list[int]]:
        """Of each source its distance from patterns with tokens left, and the source before it on a shortest path (-1 none)."""
        far, before = [-1] * len(self.names), [-1] * len(self.names)
        free = left > 0
        queue = [s for s in range(len(far)) if (free & (self.flow[s] < self.limit[s])).any()]
        for s in queue:
            far[s] = 0
        for s in queue:  # grows while it is read
            held = self.flow[s] > 0
            for t in range(len(far)):
                if far[t] < 0 and (held & (self.flow[t] < self.limit[t])).any():
                    far[t], before[t] = far[s] + 1, s
                    queue.append(t)
        return far, before

    @staticmethod
    def _take(rooms: np.ndarray, amount: int) -> np.ndarray:
        """``amount`` out of the rooms, in their order."""
        ends = np.cumsum(rooms)
        return np.clip(amount - (ends - rooms), 0, rooms)

    def send(self, quota: np.ndarray, repetition: int) -> np.ndarray:
        """Fills the quotas as far as this many uses of each pattern allow; what the sources have then."""
        cap = self.n * np.minimum(self.most, repetition)
        have = self.flow.sum(1)
        while True:
            far, before = self._levels(cap - self.used)
            short = [s for s in range(len(far)) if far[s] >= 0 and have[s] < quota[s]]
            if not short:
                return have
            for s in sorted(short, key=lambda t: far[t]):
                path = [s]
                while before[path[-1]] >= 0:
                    path.append(before[path[-1]])
                path.reverse()
                # What each arc of the path can carry: from the patterns to its first source, then from source to source.
                first = np.minimum(cap - self.used, self.limit[path[0]] - self.flow[path[0]])
                moves = [np.minimum(self.flow[a], self.limit[b] - self.flow[b]) for a, b in zip(path, path[1:])]  # noqa: B905
                amount = int(min(quota[s] - have[s], first.sum(), *(m.sum() for m in moves)))
                if amount <= 0:
                    continue
                # From the end to the beginning, so that no move takes what another has just brought.
                for (a, b), rooms in reversed(list(zip(zip(path, path[1:]), moves, strict=True))):  # noqa: B905
                    moved = self._take(rooms, amount)
                    self.flow[a] -= moved
                    self.flow[b] += moved
                brought = self._take(first, amount)
                self.flow[path[0]] += brought
                self.used += brought
                have[s] += amount

    def unreached(self, repetition: int) -> list[int]:
        far, _ = self._levels(self.n * np.minimum(self.most, repetition) - self.used)
        return [s for s in range(len(far)) if far[s] < 0]


def route(patterns: Mapping[tuple[str, ...], int], targets: Mapping[str, Target], total: int) -> tuple[dict[tuple[str, ...], dict[str, int]], int]:
    """Tokens each source takes of each pattern for quotas share x total at the least repetition, and their sum."""
    r = Routing(patterns, targets)
    quota = r.quotas(total)
    for repetition in range(1, int(r.most.max(initial=0)) + 1):
        if (r.send(quota, repetition) >= quota).all():
            break
    at = {s: i for i, s in enumerate(r.names)}
    return {p: {s: int(r.flow[at[s], i]) for s in p} for i, p in enumerate(r.keys)}, int(r.flow.sum())


def largest_total(patterns: Mapping[tuple[str, ...], int], targets: Mapping[str, Target]) -> int:
    """The largest total of which every source can take its share.

    Begins above it; each time the flow falls short, the sources that no path reaches are a cut: they have all they can
    get, which bounds the total, and the next flow starts from there. A cut comes once only, and few come.
    """
    r = Routing(patterns, targets)
    most = int(r.most.max(initial=0))
    total = int((r.n * r.most).sum()) + len(r.names)
    while total > 0:
        r.start()
        quota = r.quotas(total)
        have = r.send(quota, most)
        if (have >= quota).all():
            return total
        cut_ = r.unreached(most)
        bound, low, high = int(have[cut_].sum()), 0, total - 1
        while low < high:
            middle = (low + high + 1) // 2
            if sum(int(r.shares[s] * middle) for s in cut_) <= bound:
                low = middle
            else:
                high = middle - 1
        total = low
    return 0


def read_targets(rows: Sequence[tuple[str, float, int]]) -> dict[str, Target]:
    out = {s: Target(float(w), int(r)) for s, w, r in rows if s and (w or 0) > 0 and (r or 0) > 0}
    whole = sum(t.share for t in out.values())
    return {s: Target(t.share / whole, t.repeats) for s, t in out.items()}


def mix(docs: DataFrame, targets: Mapping[str, Target], seed: int = 0, total: int | None = None, bins: int = BINS) -> DataFrame:
    """(id, source, uses, tokens) of the documents taken; docs has id, tokens and members (array of sources)."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["id"]
    own = docs.select("id", "tokens", F.filter("members", lambda m: m.isin(*targets) if targets else F.lit(False)).alias("p")).where("id IS NOT NULL AND tokens > 0 AND size(p) > 0")
    # Of a repeated id no more than a row per source comes out of a task.
    own = own.select("id", "tokens", F.explode("p").alias("s")).groupBy("id").agg(F.min("tokens").alias("tokens"), F.collect_set("s").alias("p"))
    own = cut(own.select("id", "tokens", F.array_sort("p").alias("p")))
    found = own.groupBy("p").agg(F.sum("tokens").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources")
    patterns = {tuple(r.p): r.n for r in found}
    there = {s for p in patterns for s in p}
    usable = read_targets([(s, t.share, t.repeats) for s, t in targets.items() if s in there])
    if not usable:
        return spark.createDataFrame([], f"id {kind}, source string, uses long, tokens long")
    taken, _ = route(patterns, usable, total if total is not None else largest_total(patterns, usable))
    # Per pattern its number of tokens, and for each source the stretch of the laid-out documents that it takes.
    rows = []
    for p, by in taken.items():
        start = 0
        for s in sorted(by):
            if by[s]:
                rows.append((list(p), patterns[p], s, start, start + by[s]))
                start += by[s]
    stretches = spark.createDataFrame(rows, "p array<string>, n long, source string, lo long, hi long")
    hashed = own.withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("bin", F.floor((F.col("h").cast("double") + 2.0**63) / (2.0**64 / bins)).cast("int"))
    placed = prefix_sums(hashed, ["p"], "bin", ["h", "id"], {"at": F.col("tokens")})
    # A use of a document starts at `at` plus a multiple of n; of those from lo to hi there are:
    first = lambda x: F.ceil((F.col(x) - F.col("at")) / F.col("n"))
    uses = (F.greatest(first("hi"), F.lit(0)) - F.greatest(first("lo"), F.lit(0))).cast("long")
    # At most MOST_CELLS rows, a row per pattern and source that takes of it; only small ones are broadcast.
    stretches = F.broadcast(stretches) if len(rows) <= 100_000 else stretches
    return placed.join(stretches, "p").withColumn("uses", uses).where("uses > 0").select("id", "source", "uses", "tokens")


def report(mixed: DataFrame, targets: Mapping[str, Target]) -> DataFrame:
    """A row per target: documents, uses, tokens, and the share reached beside the one aimed at."""
    aims = mixed.sparkSession.createDataFrame([(s, t.share, t.repeats) for s, t in sorted(targets.items())], "source string, target_share double, max_repeats int")
    sums = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = aims.join(sums, "source", "left")
    share: Column = F.coalesce(F.col("tokens") / F.sum("tokens").over(W.partitionBy(F.lit(1))), F.lit(0.0))  # a row per target
    return out.select("source", "target_share", share.alias("reached_share"), "max_repeats", zero("documents"), zero("uses"), zero("most_uses"), zero("tokens"))
