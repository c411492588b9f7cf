"""Pairs of entries by weighted shares of common words, without a row per candidate.

Entries are packed into chunks, and chunks meet in a Cartesian product of checkpointed partitions, so candidates are
never shuffled or written. In a task a product of matrices bounds the likeness of all pairs of two chunks from above
(frequent words have columns of their own, others share hashed ones), common hashes bound it closer, and the words
themselves decide. All bounds are from above, so the result is that of comparing all pairs; work grows with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.session import cut

#: Entries of a chunk; columns of the matrices, and those of them that one frequent word has; rows of a tile; pairs looked at closer at once.
CHUNK, WIDTH, OWN, TILE, CLOSE = 4096, 384, 256, 1024, 1 << 14
#: Lists of more words have no closer bound: the words decide at once.
LONG = 64
#: Room for rounding of 32-bit products.
ROOM = 1e-4
LISTS = ("t", "d", "g", "k")


def pack(df: DataFrame, key: Column | None = None, lists: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(key, first, data): chunks of ``df`` (uuid, t, d, g: lists of words, k: type) in order of key and uuid; no uuid lies between those of a chunk.

    ``lists`` makes t, d, g and k of other columns of ``df`` where the chunks are: only texts are shuffled, not their words. Hashes are made of the words of a chunk wherever it is read.
    """
    # As many tasks as there are pairs of parts: no more parts than keep a task worth its start.
    parts = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (CHUNK // 2))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
                w.write_table(whole)
            return pa.record_batch([pa.array([whole["key"][0].as_py()], pa.string()), pa.array([whole["uuid"][0].as_py()], pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["key", "first", "data"])

        for b in batches:
            keys = b["key"].to_pylist()
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            at = 0
            for end in ends:
                if waiting and end > at and waiting[0]["key"][0].as_py() != keys[at]:
                    yield out()
                    waiting = []
                while at < end:
                    part = b.slice(at, min(end - at, CHUNK - sum(w.num_rows for w in waiting)))
                    waiting.append(part)
                    at += part.num_rows
                    if sum(w.num_rows for w in waiting) == CHUNK:
                        yield out()
                        waiting = []
        if waiting:
            yield out()

    texts = df.withColumn("key", F.lit("") if key is None else key).repartitionByRange(parts, "key", "uuid").sortWithinPartitions("key", "uuid")
    own = lists(texts).select("key", "uuid", "t", "d", "g", F.array("k").alias("k"))
    return cut(own.mapInArrow(packed, "key string, first string, data binary"))


def _flat(rows: pa.Table, c: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All hashes of a list of words, row after row; each row's number of them, and where they begin."""
    lists = rows[c].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    own = [*words.dictionary.to_pylist(), ""]  # the last for nulls
    hashes = np.fromiter((crc32((c + w).encode()) for w in own), np.uint32, len(own)).view(np.int32)
    return hashes[words.indices.fill_null(len(own) - 1).to_numpy(zero_copy_only=False)], np.diff(offsets), offsets - offsets[0]


class _Chunk:
    """Entries of a chunk: their words, hashes and, with multiplicities on the one side only, vectors whose products bound likeness."""

    def __init__(self, data: bytes, parts: Sequence[float], columns: np.ndarray) -> None:
        self.rows = pa.ipc.open_stream(data).read_all().combine_chunks()
        n = self.rows.num_rows
        self.many, self.once = np.zeros((n, WIDTH), np.float32), np.zeros((n, WIDTH), np.float32)
        self.ids, self.sizes, self.close, self.words = self.rows["uuid"].to_pylist(), {}, {}, {}
        for c, part in zip(LISTS, parts, strict=True):
            flat, size, offsets = _flat(self.rows, c)
            row = np.repeat(np.arange(n), size)
            at = np.minimum(np.searchsorted(columns, flat), len(columns) - 1) if len(columns) else np.zeros(len(flat), int)
            column = np.where(columns[at] == flat, at, OWN + flat.astype(np.int64) % (WIDTH - OWN)) if len(columns) else OWN + flat.astype(np.int64) % (WIDTH - OWN)
            share = np.sqrt(part / np.maximum(size, 1))[row].astype(np.float32)
            np.add.at(self.many, (row, column), share)
            seen = np.unique(row.astype(np.int64) << 32 | flat.astype(np.int64) & 0xFFFFFFFF, return_index=True)[1]
            np.add.at(self.once, (row[seen], column[seen]), share[seen])
            self.sizes[c] = size
            width = int(min(max(size.max(initial=0), 1), LONG))
            table = np.zeros((n, width), np.int32)
            place = np.arange(len(flat)) - offsets[row]
            kept = place < width
            table[row[kept], place[kept]] = flat[kept]
            self.close[c] = table

    def texts(self, c: str, i: int) -> tuple[list[str], set[str]]:
        if (c, i) not in self.words:
            own = self.rows[c][i].as_py() or []
            self.words[c, i] = own, {*own} - {None}
        return self.words[c, i]


def _closer(a: _Chunk, b: _Chunk, i: np.ndarray, j: np.ndarray, parts: Sequence[float]) -> np.ndarray:
    """Bounds from above of the likeness of pairs of rows, by common hashes."""
    sums = np.zeros(len(i))
    for c, part in zip(LISTS, parts, strict=True):
        na, nb, x, y = a.sizes[c][i], b.sizes[c][j], a.close[c][i], b.close[c][j]
        there = np.arange(y.shape[1])[None, :] < nb[:, None]
        common = np.zeros(len(i), np.int64)
        for k in range(x.shape[1]):
            common += ((x[:, k, None] == y) & there).any(1) & (k < na)
        common = np.where((na > LONG) | (nb > LONG), na, common)
        sums += part * common / np.maximum(np.maximum(na, nb), 1)
    return sums


def meet(left: DataFrame, right: DataFrame, parts: Sequence[float], least: float, likeness: Callable[[Sequence[float]], float], ordered: bool) -> DataFrame:
    """(uuid_a, uuid_b, similarity) at ``least`` or more, of chunks of one key; with ``ordered`` both sides are the same and uuid_a < uuid_b.

    ``parts``: most that common words of t, d and g and a common type add; ``likeness``: of the four shares, exactly.
    """
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b["data"]:
                rows = pa.ipc.open_stream(data.as_py()).read_all()
                for c, part in zip(LISTS, parts, strict=True):
                    flat, size, _ = _flat(rows.combine_chunks(), c)
                    h, at = np.unique(flat, return_inverse=True)
                    w = np.bincount(at, np.repeat(part / np.maximum(size, 1), size), len(h))
                    top = np.argsort(-w, kind="stable")[: 4 * OWN]
                    yield pa.record_batch([pa.array(h[top], pa.int32()), pa.array(w[top], pa.float64())], names=["h", "w"])

    counts = left.mapInArrow(frequent, "h int, w double").groupBy("h").agg(F.sum("w").alias("w")).orderBy(F.col("w").desc(), "h").limit(OWN)
    columns = np.array(sorted(r.h for r in counts.collect()), np.int32)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[tuple, _Chunk] = {}

        def chunk(side: int, batch: pa.RecordBatch, r: int) -> _Chunk:
            name = side, batch["key"][r].as_py(), batch[f"first_{'ab'[side]}"][r].as_py()
            if name not in chunks:
                for old in [k for k in chunks if k[0] == side][: None if side == 0 else -5]:
                    del chunks[old]
                chunks[name] = _Chunk(batch[f"data_{'ab'[side]}"][r].as_py(), parts, columns)
            return chunks[name]

        for batch in batches:
            for r in range(batch.num_rows):
                a, b = chunk(0, batch, r), chunk(1, batch, r)
                same = ordered and batch["first_a"][r].as_py() == batch["first_b"][r].as_py()
                ua, ub, likes = [], [], []
                for at in range(0, len(a.ids), TILE):
                    tile = a.many[at : at + TILE] @ (b.once[at:] if same else b.once).T >= least - ROOM
                    i, j = np.nonzero(tile)
                    i, j = i + at, j + at * same
                    if same:
                        i, j = i[i < j], j[i < j]
                    for k in range(0, len(i), CLOSE):
                        x, y = i[k : k + CLOSE], j[k : k + CLOSE]
                        near = _closer(a, b, x, y, parts) >= least - 1e-9
                        for p, q in zip(x[near].tolist(), y[near].tolist(), strict=True):
                            if a.ids[p] == b.ids[q]:
                                continue
                            shares = []
                            for c in LISTS:
                                (own, _), (others, known) = a.texts(c, p), b.texts(c, q)
                                shares.append(sum(w in known for w in own) / max(len(own), len(others)) if own and others else 0.0)
                            if (s := likeness(shares)) >= least:
                                ua.append(a.ids[p])
                                ub.append(b.ids[q])
                                likes.append(s)
                yield pa.record_batch([pa.array(ua, pa.string()), pa.array(ub, pa.string()), pa.array(likes, pa.float64())], names=["uuid_a", "uuid_b", "similarity"])

    side = lambda df, s: df.select(F.col("key").alias("key" if s == "a" else "key_b"), F.col("first").alias(f"first_{s}"), F.col("data").alias(f"data_{s}"))
    test = (F.col("key") == F.col("key_b")) & (F.col("first_a") <= F.col("first_b") if ordered else F.lit(True))
    pairs = side(left, "a").join(side(right, "b").hint("shuffle_replicate_nl"), test)
    return pairs.mapInArrow(found, "uuid_a string, uuid_b string, similarity double")
