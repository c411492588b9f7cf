"""Vector search over given vectors, and what is attached to its hits."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Gaps that one call compares by vectors.
MOST_GAPS = 2000


def floats(vec: Column, dim: Column) -> Column:
    """Little-endian float32 bytes as array<double>, for expressions over few rows; null if the length is wrong.

    Built from the bits by arithmetic, so that it stays in generated code.
    """
    byte = lambda i, k: F.conv(F.hex(F.substring(vec, i * 4 + 1 + k, F.lit(1))), 16, 10).cast("long")
    bits = lambda i: byte(i, F.lit(0)) + byte(i, F.lit(1)) * 256 + byte(i, F.lit(2)) * 65_536 + byte(i, F.lit(3)) * 16_777_216

    def number(i: Column) -> Column:
        b = bits(i)
        exponent, fraction = F.shiftright(b, 23).bitwiseAND(255), b.bitwiseAND(0x7FFFFF).cast("double")
        size = F.when(exponent == 0, fraction * 2.0**-149).otherwise((fraction + 2.0**23) * F.pow(F.lit(2.0), (exponent - 150).cast("double")))
        return F.when(exponent == 255, F.lit(float("nan"))).otherwise(F.when(b >= 0x80000000, -size).otherwise(size))

    return F.when((F.octet_length(vec) == dim * 4) & (dim > 0), F.transform(F.sequence(F.lit(0), dim - 1), number))


def unpack(rows: DataFrame, name: str = "v") -> DataFrame:
    """Adds the vector as array<float> in batches; null where the bytes do not fit."""
    kept = [c for c in rows.columns]

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        for b in batches:
            values, offsets, valid = [], [0], []
            for v, d in zip(b["vec"].to_pylist(), b["dim"].to_pylist(), strict=True):
                good = v is not None and d is not None and d > 0 and len(v) == 4 * d
                x = np.frombuffer(v, "<f4") if good else np.zeros(0, np.float32)
                good = good and bool(np.isfinite(x).all())
                values.append(x if good else np.zeros(0, np.float32))
                offsets.append(offsets[-1] + len(values[-1]))
                valid.append(good)
            flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.float32), pa.float32())
            arrays = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array([not g for g in valid], pa.bool_()))
            yield pa.record_batch([*(b[c] for c in kept), arrays], names=[*kept, name])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, `{name}` array<float>")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if lengths differ or one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The k rows of (…, v) nearest to one vector, with their similarity; k is at most 500."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("similarity", cosine(F.col("v"), q)).where("v IS NOT NULL").orderBy(F.round("similarity", 12).desc(), "id").limit(min(k, 500))


def attached(hits: DataFrame, nodes: DataFrame, links: DataFrame, k: DataFrame) -> DataFrame:
    """(id, uuid, title, knowledge_type, confidence, relation): entries linked to the hit nodes, none obsolete."""
    own = hits.select("id").distinct().join(nodes.where("uuid IS NOT NULL").select("id", F.lower(F.trim("uuid")).alias("node_uuid")), "id")
    met = own.join(links.where("NOT is_knowledge").select("node_uuid", "knowledge_uuid", "relation"), "node_uuid")
    return met.join(k.where("lower(status) != 'obsolete'").select(F.col("uuid").alias("knowledge_uuid"), "title", "knowledge_type", "confidence"), "knowledge_uuid").select("id", F.col("knowledge_uuid").alias("uuid"), "title", "knowledge_type", "confidence", "relation")


def embedding_text(label: Column, kind: Column, path: Column, content: Column) -> Column:
    """What an embedding model is given of a node: name, kind, path and content, a part a line, empty ones left out."""
    return F.array_join(F.filter(F.array(*(F.trim(F.coalesce(c, F.lit(""))) for c in (label, kind, path, content))), lambda t: t != ""), "\n")


def pack(values: Sequence[float]) -> bytes:
    return struct.pack(f"<{len(values)}f", *values)


#: Points of a fuzzy match: a letter, one that begins a word, one after its predecessor, the first letter again; a gap's begin and length.
LETTER, BEGINS, FOLLOWS, FIRST, GAP, WIDER = 16, 8, 4, 2, 3, 1


def fuzzy_match(text: str, word: str) -> tuple[int, list[int]]:
    """Points and places of the best match of a word's letters, in order, in a text; 0 and none without one.

    A word without capitals ignores case. Letters at the begin of a word (also of a camel-case one) and letters that follow
    each other earn more, gaps inside the match cost. The best is found over all ways, letter by letter.
    """
    own = text if any(map(str.isupper, word)) else text.lower()
    if not word or len(own) != len(text):
        return 0, []
    begins = [not i or not text[i - 1].isalnum() or text[i].isupper() and text[i - 1].islower() or text[i].isdigit() and not text[i - 1].isdigit() for i in range(len(text))]
    points: list[dict[int, tuple[int, int]]] = []
    for k, c in enumerate(word):
        row: dict[int, tuple[int, int]] = {}
        best, best_at = None, -1  # of the letter before, less the gap up to here
        for i, x in enumerate(own):
            if k and i:
                if best is not None:
                    best -= WIDER
                if i >= 2 and i - 2 in points[-1] and (best is None or points[-1][i - 2][0] - GAP > best):
                    best, best_at = points[-1][i - 2][0] - GAP, i - 2
            if x != c:
                continue
            worth = LETTER + BEGINS * begins[i] * (1 if k else FIRST)
            if not k:
                row[i] = (worth, -1)
                continue
            ways = [(best + worth, best_at)] if best is not None else []
            if i - 1 in points[-1]:
                ways.append((points[-1][i - 1][0] + worth + FOLLOWS, i - 1))
            if ways:
                row[i] = max(ways)
        if not row:
            return 0, []
        points.append(row)
    at = max(points[-1], key=lambda i: (points[-1][i][0], -i))
    total, places = points[-1][at][0], []
    for row in reversed(points):
        places.append(at)
        at = row[at][1]
    return max(total, 1), places[::-1]


def fuzzy_points(text: str, query: str) -> int:
    """Points of all words of a query, each of which must match."""
    total = 0
    for word in query.split():
        p, _ = fuzzy_match(text, word)
        if not p:
            return 0
        total += p
    return total


def marked(text: str, query: str) -> str:
    """``text`` with the matched letters of the query's words in brackets; unchanged if one does not match."""
    found: set[int] = set()
    for word in query.split():
        p, places = fuzzy_match(text, word)
        if not p:
            return text
        found.update(places)
    return "".join(("[" if i in found and i - 1 not in found else "") + c + ("]" if i in found and i + 1 not in found else "") for i, c in enumerate(text))


def fuzzy_scores(nodes: DataFrame, query: str) -> DataFrame:
    """(id, label, source_file, score): fuzzy points of the query in a label times four, and those in its path and logical key."""
    @F.pandas_udf("int")
    def points(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        return texts.map(lambda t: known.setdefault(t, fuzzy_points(t, query)) if t else 0).astype("int32")

    key = F.col("logical_key") if "logical_key" in nodes.columns else F.lit("")
    score = 4 * points(F.coalesce("label", F.lit(""))) + points(F.coalesce("source_file", F.lit(""))) + points(F.coalesce(key, F.lit("")))
    return nodes.select("id", "label", "source_file", score.alias("score")).where("score > 0")


def gap_neighbors(gaps: DataFrame, right: DataFrame, vectors: DataFrame, least: float = 0.65, k: int = 3) -> DataFrame:
    """(norm, id, cosine, place): right nodes (id) whose vectors (id, v) are nearest to those of gaps (norm, id).

    Gaps are a report's few hundred rows: they are the broadcast side, checked against MOST_GAPS, and meet every vector of
    their length, as a stated query set does.
    """
    from pyspark.sql import Window as W

    few = gaps.select("norm", "id").limit(MOST_GAPS + 1).join(vectors.select("id", F.col("v").alias("a")), "id").select("norm", "a")
    if few.count() > MOST_GAPS:
        raise ValueError(f"more than {MOST_GAPS} gaps")
    own = right.select("id").join(vectors.select("id", F.col("v").alias("b")), "id").where("b IS NOT NULL")
    scored = own.join(F.broadcast(few), F.size("a") == F.size("b")).select("norm", "id", cosine(F.col("a"), F.col("b")).alias("cosine")).where(F.col("cosine") >= least)
    place = F.row_number().over(W.partitionBy("norm").orderBy(F.round("cosine", 12).desc(), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def merged_candidates(by_words: DataFrame, by_vectors: DataFrame) -> DataFrame:
    """Candidates of both kinds by (norm, id), with either score."""
    return by_words.select("norm", "id", "jaccard").join(by_vectors.select("norm", "id", "cosine"), ["norm", "id"], "full_outer")
