"""Splitting oversized texts at natural boundaries, by lexical cohesion.

A text's units are the words of the tokenizer's pattern, so sizes are sums, and a piece between two units has the
tokens that its units had (blanks at its end are counted anew). Natural boundaries are ends of paragraphs, lines and sentences. At each, the vocabulary
of the words before is compared with that of the words after it; where the similarity falls into a valley the topic
changes. A piece ends at the deepest valley of the last part of the room it has; without any natural boundary there,
at the last one before, then at a word, and inside a word only where the word alone exceeds the room. The next piece begins
``overlap`` tokens before the end of this one, rounded down to whole units.

Nulls, ties and odd input: null, empty and short enough texts give no pieces; equally deep valleys are decided by
the kind of boundary, then the later one; overlap is at most half of the size; a text without
boundaries of any kind is cut between characters; of repeated rows of an id the earliest
(least loaded_at, where there is one) counts; an empty table gives no rows; other
columns are not read. Texts are taken whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.ids import folded
from loamgraph.llm.bpe import FOLDER, Encoder, slices

#: Words compared on each side of a boundary; the part of a piece in which its end is sought; tokens of a part of a long word.
SIDE, ROOM, PART = 40, 0.5, 8
_ENDS = tuple(".!?;:…。！？")
_CLOSERS = "\"'`)]}*_»”’"


def boundaries(units: list[str]) -> np.ndarray:
    """For each unit how natural a cut before it is: 3 paragraph, 2 line, 1 sentence, 0 none."""
    kind = np.zeros(len(units), np.int8)
    lines, last = 0, ""
    for i, u in enumerate(units):
        if u.isspace():
            lines += u.count("\n")
            continue
        if i:
            if lines:
                kind[i] = 3 if lines > 1 else 2
            elif u[0].isspace() and (last.rstrip(_CLOSERS) or last).endswith(_ENDS):
                kind[i] = 1
        last, lines = u, 0
    return kind


def depths(units: list[str], at: np.ndarray) -> np.ndarray:
    """Depth of the valley of lexical similarity at each of the boundaries ``at``.

    Two windows of words slide over the text; their counts, norms and product change by a few words a step.
    """
    numbers: dict[str, int] = {}
    words, position = [], np.zeros(len(units) + 1, np.int64)
    for i, u in enumerate(units):
        position[i] = len(words)
        if len(u) > 2:
            w = u.strip().lower()
            if len(w) > 2 and w.isalpha():
                words.append(numbers.setdefault(w, len(numbers)))
    n = position[len(units)] = len(words)
    left, right = [0] * len(numbers), [0] * len(numbers)
    product = norm_left = norm_right = b = 0
    for w in words[:SIDE]:
        norm_right += 2 * right[w] + 1
        right[w] += 1
    similar = np.ones(len(at))
    for k, target in enumerate(position[at].tolist()):
        while b < target:
            w = words[b]
            norm_right -= 2 * right[w] - 1
            right[w] -= 1
            product += right[w] - left[w]
            norm_left += 2 * left[w] + 1
            left[w] += 1
            if b >= SIDE:
                w = words[b - SIDE]
                product -= right[w]
                norm_left -= 2 * left[w] - 1
                left[w] -= 1
            if b + SIDE < n:
                w = words[b + SIDE]
                product += left[w]
                norm_right += 2 * right[w] + 1
                right[w] += 1
            b += 1
        norm = (norm_left * norm_right) ** 0.5
        similar[k] = product / norm if norm else 0.0
    # From a boundary the similarity is followed as far as it rises, to the left and to the right: each passes its height on.
    values = similar.tolist()
    rise_left, rise_right = values[:], values[:]
    for k in range(1, len(values)):
        if values[k - 1] >= values[k]:
            rise_left[k] = rise_left[k - 1]
    for k in range(len(values) - 2, -1, -1):
        if values[k + 1] >= values[k]:
            rise_right[k] = rise_right[k + 1]
    return np.asarray(rise_left) + np.asarray(rise_right) - 2 * similar


@dataclass(frozen=True)
class Places:
    """The natural boundaries of a text's units: where they are, of what kind and how deep."""

    kind: np.ndarray
    natural: np.ndarray
    depth: np.ndarray

    @classmethod
    def of(cls, units: list[str]) -> Places:
        kind = boundaries(units)
        natural = np.nonzero(kind)[0]
        return cls(kind, natural, np.round(depths(units, natural), 6))


def cuts(units: list[str], before: np.ndarray, places: Places, most: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of units of the pieces; every unit has at most ``most`` - ``overlap`` tokens, ``before`` are their sums."""
    kind, natural, depth = places.kind, places.natural, places.depth
    out, start, end = [], 0, 0
    while True:
        if before[-1] - before[start] <= most:
            return [*out, (start, len(units))]
        last = int(np.searchsorted(before, before[start] + most, "right")) - 1  # the latest end that fits
        lo = int(np.searchsorted(before, before[start] + most * ROOM, "left"))
        a, b = np.searchsorted(natural, [max(lo, end + 1), last + 1])
        if b > a:
            own = natural[a:b]
            stop = int(own[np.lexsort((own, kind[own], depth[a:b]))[-1]])
        else:
            none = b == 0 or natural[b - 1] <= end
            stop = last if none else int(natural[b - 1])
            if none:  # not before blanks, if there are words
                while stop > end + 1 and stop < len(units) and units[stop].isspace():
                    stop -= 1
        stop = max(stop, end + 1)
        out.append((start, stop))
        end = stop
        start = max(start + 1, min(stop, int(np.searchsorted(before, before[stop] - overlap, "left")))) if overlap else stop


def _parts_of(word: str, tokens: int) -> list[str]:
    """A word too long for a piece, in parts of about PART tokens."""
    n = max(1, len(word) * PART // tokens)
    return [word[i : i + n] for i in range(0, len(word), n)]


def split_text(text: str, units: list[str], sizes: np.ndarray, most: int, overlap: int, encoder: Encoder) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, overlap in tokens) of each piece, in characters of ``text``."""
    most, room = max(1, most), max(1, most)
    overlap = max(0, min(overlap, most // 2))
    long = sizes > max(1, most - overlap)
    if long.any():
        units = [p for u, x, n in zip(units, long, sizes, strict=True) for p in (_parts_of(u, int(n)) if x else [u])]
        sizes = encoder.encode(units)[1]
        if (sizes > max(1, most - overlap)).any():  # single characters
            units = [c for u, n in zip(units, sizes, strict=True) for c in (list(u) if n > max(1, most - overlap) else [u])]
            sizes = encoder.encode(units)[1]
    where = np.concatenate([[0], np.cumsum([len(u) for u in units])])
    before, places = np.concatenate([[0], np.cumsum(sizes)]), Places.of(units)
    while True:
        ranges = cuts(units, before, places, room, min(overlap, room // 2))
        counts = before[[b for _, b in ranges]] - before[[a for a, _ in ranges]]
        if long.any():  # parts of words can merge in other ways
            counts = encoder.encode([text[where[a] : where[b]] for a, b in ranges])[1]
        else:  # as can the blanks at a piece's end, which are one unit there
            for k, (a, b) in enumerate(ranges):
                blank = b
                while blank > a and units[blank - 1].isspace():
                    blank -= 1
                if b - blank > 1:
                    counts[k] += int(encoder.encode(["".join(units[blank:b])])[1][0]) - int(before[b] - before[blank])
        if counts.max() <= most or room == 1:
            break
        room = max(1, room - int(counts.max() - most))
    shared = [0, *(int(before[e] - before[max(a, s)]) if a < e else 0 for (s, e), (a, _) in zip(ranges, ranges[1:]))]  # noqa: B905
    return [(int(where[a]), int(where[b]), int(n), o) for (a, b), n, o in zip(ranges, counts, shared, strict=True)]


def split_documents(docs: DataFrame, limits: DataFrame, default: str = "readme", vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, piece, start, end, tokens, overlap, text) of the documents with more than max_tokens of their source.

    ``limits`` is a small table given by hand: a row per source.
    """
    path = f"{folder}/{vocabulary}.tiktoken"
    given = {r.s: (r.max_tokens, r.overlap_tokens or 0) for r in limits.select(folded(F.col("source")).alias("s"), "max_tokens", "overlap_tokens").collect() if r.s and r.max_tokens}
    if not given:
        return docs.sparkSession.createDataFrame([], "doc_id long, piece int, start int, end int, tokens int, overlap int, text string")
    own = F.create_map(*(F.lit(x) for s, v in given.items() for x in (s, v[0])))
    lap = F.create_map(*(F.lit(x) for s, v in given.items() for x in (s, v[1])))
    name = F.when(folded(F.col("source")).isin(*given), folded(F.col("source"))).otherwise(F.lit(default if default in given else min(given)))
    # Of an id its earliest row counts, then the least text: a row of long texts is sent once, after partial minima.
    first = F.min(F.struct(*(c for c in ("loaded_at",) if c in docs.columns), "text", "source"))
    rows = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(first.alias("r")).select("doc_id", "r.text", "r.source")
    # A token has a byte at least, so shorter texts need no encoding.
    rows = rows.select("doc_id", "text", F.element_at(own, name).alias("most"), F.element_at(lap, name).alias("overlap")).where(F.octet_length("text") > F.col("most"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for b in batches:
            texts, ids = b["text"].to_pylist(), b["doc_id"].to_pylist()
            most, overlap = b["most"].to_pylist(), b["overlap"].to_pylist()
            for lo, hi in slices(texts):
                _, counts, per_word, words = encoder.encode(texts[lo:hi])
                ends, units, out = np.cumsum(words), encoder.units, []
                for k in range(lo, hi):
                    if counts[k - lo] > most[k]:
                        sizes = per_word[ends[k - lo] - words[k - lo] : ends[k - lo]]
                        pieces = split_text(texts[k], units[k - lo], sizes, most[k], overlap[k], encoder)
                        out += [(ids[k], i, s, e, n, o, texts[k][s:e]) for i, (s, e, n, o) in enumerate(pieces)]
                if out:
                    columns = list(zip(*out, strict=True))
                    types = [pa.int64(), *[pa.int32()] * 5, pa.string()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "end", "tokens", "overlap", "text"])

    return rows.mapInArrow(run, "doc_id long, piece int, start int, end int, tokens int, overlap int, text string")
