import base64
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from loamgraph.llm import bpe, mixing, splitting

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PATH = f"{bpe.FOLDER}/byte_bpe_50k.tiktoken"
SOME = [None, "", " ", "\n\n \n", "Hello  world's", "a" * 5000, "abab" * 999 + "!", "日本語テキスト" * 50, "x\U0001f600‍�\x00y", "<|endoftext|>", "def f(x):\n    return x\n" * 40, "1234567 89", "ß" * 300 + "é" * 7]


def encoded(texts):
    tokens, counts, _, _ = bpe.Encoder.of(PATH).encode(texts)
    return [p.tolist() for p in np.split(tokens, np.cumsum(counts)[:-1])]


def test_equals_the_library():
    assert encoded(SOME) == [TRUE.encode_ordinary(t or "") for t in SOME]


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=60) | st.text("ab ", max_size=80), max_size=5))
def test_equals_the_library_on_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["end"]
    assert encoded(texts) == [TRUE.encode_ordinary(t) for t in texts]


def test_encoding_forgets_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    e = bpe.Encoder(PATH)
    for _ in range(3):
        assert [t.tolist() for t in (e.encode(["one two three four five six seven"])[0],)] == [TRUE.encode_ordinary("one two three four five six seven")]


def test_encode_table(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(SOME)], "doc_id long, text string, ids int")
    assert {r.doc_id: list(r.ids) for r in bpe.encode_texts(df, "doc_id", "text").collect()} == {i: TRUE.encode_ordinary(t or "") for i, t in enumerate(SOME)}
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0
    counts = {r.doc_id: r.tokens for r in bpe.count_tokens(df, "text").collect()}
    assert counts == {i: len(TRUE.encode_ordinary(t or "")) for i, t in enumerate(SOME)}


# mixing
def test_route_meets_quotas_at_least_repetition():
    targets = {"a": mixing.Target(0.5, 3), "b": mixing.Target(0.5, 1)}
    patterns = {("a",): 100, ("b",): 200, ("a", "b"): 100}
    total = mixing.largest_total(patterns, targets)
    flow, sent = mixing.route(patterns, targets, total)
    assert total in (600, 601) and sent >= 599 and sum(flow[p].get("a", 0) for p in patterns) == 300
    low, _ = mixing.route(patterns, targets, 200)
    assert sum(low["a",].values()) <= 100 and sum(sum(x.values()) for x in low.values()) == 200


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, tokens long, members array<string>, source string, h long")


def test_mix_shares_and_caps(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(1, 40), [rnd.choice(["big"] * 8 + ["mid", "tiny"])], "x", 0) for i in range(4000)]
    rows += [rows[0], (None, 5, ["big"], "x", 0), (9001, 0, ["big"], "x", 0), (9002, 5, [], "x", 0), (9003, 5, ["else"], "x", 0), (9004, None, ["big"], "x", 0)]
    targets = {"big": mixing.Target(0.6, 1), "mid": mixing.Target(0.25, 2), "tiny": mixing.Target(0.15, 3)}
    mixed = mixing.mix(docs(spark, rows), targets, 7)
    out = {r.source: r for r in mixing.report(mixed, targets).collect()}
    for s, t in targets.items():
        assert abs(out[s].reached_share - t.share) < 0.003 and out[s].most_uses <= t.repeats
    again = {tuple(r) for r in mixing.mix(docs(spark, rows), targets, 7).collect()}
    other = {tuple(r) for r in mixing.mix(docs(spark, rows), targets, 8, bins=4).collect()}
    assert again == {tuple(r) for r in mixed.collect()} != other


def test_mix_overlapping_and_missing(spark):
    rows = [(i, 10, ["a", "b"] if i % 2 else ["a"], "x", 0) for i in range(200)]
    targets = {"a": mixing.Target(0.5, 1), "b": mixing.Target(0.5, 1), "none": mixing.Target(0.5, 4)}
    got = mixing.mix(docs(spark, rows), targets, total=1600).collect()
    by = {s: sum(r.uses * r.tokens for r in got if r.source == s) for s in "ab"}
    assert abs(by["a"] - 800) <= 20 and abs(by["b"] - 800) <= 20
    uses = {}
    for r in got:
        uses[r.id] = uses.get(r.id, 0) + r.uses
    assert max(uses.values()) == 1
    empty = mixing.mix(docs(spark, []), targets)
    assert empty.count() == 0 and {r.tokens for r in mixing.report(empty, targets).collect()} == {0}


def cheapest(patterns, targets, total):
    """Flow and cost by augmenting one path after the other, with arcs for each repetition."""
    names, keys = sorted(targets), sorted(patterns)
    room, cost = {}, {}

    def arc(a, b, r, c=0):
        room[a, b], cost[a, b] = room.get((a, b), 0) + r, c
        room.setdefault((b, a), 0)
        cost[b, a] = -c

    for p in keys:
        for k in range(max(targets[s].repeats for s in p)):
            arc("in", (p, k), patterns[p], k)
            arc((p, k), p, patterns[p])
        for s in p:
            arc(p, s, patterns[p] * targets[s].repeats)
    for s in names:
        arc(s, "out", int(targets[s].share * total))
    sent = paid = 0
    while True:
        far, via = {"in": 0}, {}
        for _ in range(3 * len(room)):
            more = [(a, b) for (a, b), r in room.items() if r > 0 and a in far and far[a] + cost[a, b] < far.get(b, 1 << 60)]
            if not more:
                break
            for a, b in more:
                if far[a] + cost[a, b] < far.get(b, 1 << 60):
                    far[b], via[b] = far[a] + cost[a, b], a
        if "out" not in far:
            return sent, paid
        path = ["out"]
        while path[-1] != "in":
            path.append(via[path[-1]])
        path.reverse()
        amount = min(room[e] for e in zip(path, path[1:]))
        for a, b in zip(path, path[1:]):
            room[a, b] -= amount
            room[b, a] += amount
        sent, paid = sent + amount, paid + amount * far["out"]


@pytest.mark.parametrize("seed", range(12))
def test_route_is_the_cheapest_largest_flow(seed):
    rnd = random.Random(seed)
    names = "abcd"[: rnd.randint(1, 4)]
    patterns = {tuple(sorted(rnd.sample(names, rnd.randint(1, len(names))))): rnd.randint(1, 40) for _ in range(6)}
    targets = mixing.read_targets([(s, rnd.random() + 0.05, rnd.randint(1, 4)) for s in names])
    most = mixing.largest_total(patterns, targets)
    for total in (most, most // 2, most * 2, most + 3):
        flow, sent = mixing.route(patterns, targets, total)
        used = {p: sum(x.values()) for p, x in flow.items()}
        paid = sum(k * min(max(0, used[p] - k * n), n) for p, n in patterns.items() for k in range(5))
        assert (sent, paid) == cheapest(patterns, targets, total)
        assert all(flow[p][s] <= n * targets[s].repeats for p, n in patterns.items() for s in p)
    asked = lambda total: sum(int(t.share * total) for t in targets.values())
    assert cheapest(patterns, targets, most)[0] == asked(most)
    assert any(cheapest(patterns, targets, most + k)[0] < asked(most + k) for k in range(1, 30))


def test_many_patterns_route_in_seconds():
    rnd = random.Random(5)
    names = [f"s{i:02d}" for i in range(17)]
    patterns = {}
    while len(patterns) < mixing.MOST_PATTERNS:
        patterns[tuple(sorted(rnd.sample(names, rnd.randint(1, 12))))] = rnd.randint(1, 10**6)
    targets = mixing.read_targets([(s, rnd.random() ** 2 + 0.01, rnd.randint(1, 4)) for s in names])
    began = time.time()
    total = mixing.largest_total(patterns, targets)
    _, sent = mixing.route(patterns, targets, total)
    assert time.time() - began < 20
    assert sent == sum(int(t.share * total) for t in targets.values())


def test_mix_takes_the_sources_of_all_rows_of_an_id(spark):
    rows = [(i, 10, [s], "x", 0) for i in range(100) for s in ("a", "b")] + [(i, 12, ["a"], "x", 0) for i in range(10)]
    got = mixing.mix(docs(spark, rows), {"a": mixing.Target(0.5, 1), "b": mixing.Target(0.5, 1)}).collect()
    assert {r.source for r in got} == {"a", "b"} and len({r.id for r in got}) == len(got) == 100


# splitting
def test_depths_are_linear_on_flat_texts():
    units = [u for i in range(300_000) for u in (str(i), "\n")]
    began = time.time()
    assert not splitting.Places.of(units).depth.any()
    assert time.time() - began < 15


def test_depths_follow_rises_on_both_sides():
    e = bpe.Encoder.of(PATH)
    for text in (LONG["prose"], LONG["code"], "one two three. " * 50):
        units = e.split(text)
        at = np.nonzero(splitting.boundaries(units))[0]
        words = [(i, u.strip().lower()) for i, u in enumerate(units) if len(u.strip()) > 2 and u.strip().isalpha()]
        similar = []
        for b in at:
            left, right = [w for i, w in words if i < b][-splitting.SIDE :], [w for i, w in words if i >= b][: splitting.SIDE]
            x, y = Counter(left), Counter(right)
            norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
            similar.append(sum(x[w] * y[w] for w in x) / norm if norm else 0.0)
        for k, got in enumerate(splitting.depths(units, at)):
            i = j = k
            while i > 0 and similar[i - 1] >= similar[i] - 1e-12:
                i -= 1
            while j + 1 < len(at) and similar[j + 1] >= similar[j] - 1e-12:
                j += 1
            assert abs(got - (similar[i] + similar[j] - 2 * similar[k])) < 1e-6


def pieces(text, most, overlap):
    e = bpe.Encoder.of(PATH)
    _, counts, per_word, _ = e.encode([text])
    return splitting.split_text(text, e.split(text), per_word, most, overlap, e)


LONG = {
    "prose": " ".join(f"Topic {k // 30} has sentence {k} about {'apples and pears' if (k // 30) % 2 else 'motors and wheels'} today." for k in range(200)),
    "paragraphs": "\n\n".join(" ".join(f"word{k} thing." for _ in range(40)) for k in range(12)),
    "one word": "abcdefghij" * 3000,
    "blanks": " " * 5000 + "\n" * 3000 + "x",
    "cjk": "日本語のテキストです。" * 400,
    "code": "def f(x):\n    y = g(x)  # note\n    return y\n\n" * 150,
    "mixed": "a b " * 50 + "Z" * 2000 + " c d" * 50 + "\U0001f600" * 300,
}


@pytest.mark.parametrize("name", LONG)
@pytest.mark.parametrize(("most", "overlap"), [(128, 16), (64, 0), (16, 14), (3, 1)])
def test_pieces_cover_and_fit(name, most, overlap):
    text = LONG[name][:3000] if most < 16 else LONG[name]
    out = pieces(text, most, overlap)
    assert out[0][0] == 0 and out[-1][1] == len(text)
    for k, (a, b, n, o) in enumerate(out):
        assert n == len(TRUE.encode_ordinary(text[a:b])) <= max(most, 3)
        assert o <= overlap
        if k:
            assert out[k - 1][0] < a <= out[k - 1][1] < b


def test_cuts_at_topic_changes():
    text = LONG["prose"]
    out = pieces(text, 700, 0)
    assert all(text[b - 1] == "." for _, b, _, _ in out)
    changes = [text.index(f"Topic {k} ") - 1 for k in range(1, 6)]
    assert sum(any(abs(b - c) <= 60 for c in changes) for _, b, _, _ in out[:-1]) >= len(out[:-1]) - 1


def test_split_table(spark):
    rows = [(1, LONG["prose"], "README ", 0), (1, LONG["prose"], "README ", 0), (2, None, "readme", 0), (3, "", "x", 0), (4, "short", "readme", 0), (5, LONG["paragraphs"], None, 0), (6, LONG["code"], "code", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, piece int")
    limits = spark.createDataFrame([("readme", 256, 32), ("code", 100, 0), (None, 5, 5)], "source string, max_tokens int, overlap_tokens int")
    out = splitting.split_documents(df, limits).collect()
    assert {r.doc_id for r in out} == {1, 5, 6}
    assert len({(r.doc_id, r.piece) for r in out}) == len(out)
    assert all(r.tokens <= (100 if r.doc_id == 6 else 256) for r in out)
    assert splitting.split_documents(df.limit(0), limits).count() == 0
    assert splitting.split_documents(df, limits.limit(0)).count() == 0
