import datetime as dt

from loamgraph.operators import references

T = dt.datetime
EDGE = "source string, target string, relation string, confidence string, source_file string, source_location string, weight double, seen_at timestamp, ref_key string"
LINK = "knowledge_uuid string, node_uuid string, relation string, target_type string, created_at long"


def tables(spark):
    e = lambda a, b, at, r="calls": (a, b, r, "EXTRACTED", "f", "L1", 1.0, at, "clash")
    edges = spark.createDataFrame([e("a", "B--c", T(2025, 1, 2)), e("a", "B--c", T(2025, 2, 2)), e("a", "gone", T(2025, 1, 5)), e("a", "later", T(2025, 1, 5)), e("a", "nowhere", T(2025, 3, 5)), e("a", None, T(2025, 3, 5)), e("", "a", T(2025, 3, 5)), e("a", "shared", T(2025, 1, 1))], EDGE)
    links = spark.createDataFrame([(" K1 ", "U1", "r", "node", 1735700000), ("k9", "u1", "r", None, None), ("k1", "k2", "r", "knowledge", 1735700000), ("k1", "", "r", "", 5), (None, "u7", "r", "", 1735700000)], LINK)
    nodes = spark.createDataFrame([("a", "u1", T(2024, 1, 1)), ("b_c", "u2", T(2024, 1, 1)), ("b_c", "u2", T(2025, 6, 1)), ("later", None, T(2025, 2, 1)), ("gone", "u4", T(2024, 1, 1))], "id string, uuid string, seen_at timestamp")
    shared = spark.createDataFrame([("shared", "u5", T(2024, 1, 1))], "id string, uuid string, seen_at timestamp")
    knowledge = spark.createDataFrame([("k1", 1), ("K2", 1735800000), ("k2", 1735900000)], "uuid string, created_at long")
    forgotten = spark.createDataFrame([("node", "gone", None)], "entity string, node_id string, item_uuid string")
    return edges, links, nodes, shared, knowledge, forgotten


WANT = {
    ("edges", "target", "gone", "2025-01", "deleted"), ("edges", "target", "later", "2025-01", "late"), ("edges", "target", "nowhere", "2025-03", "missing"),
    ("links", "knowledge_uuid", "k9", "", "missing"), ("links", "node_uuid", "k2", "2025-01", "late"), ("links", "node_uuid", "u7", "2025-01", "missing"),
}


def report(counts):
    rows = [tuple(r)[:5] for r in references.orphans(counts).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def at_once(*changes):
    out = changes[0]
    for c in changes[1:]:
        out = out.unionByName(c)
    return references.fold(references.deltas(out))


class Kept:
    """A ledger and counts to which batches are added, as a maintained report would."""

    def __init__(self):
        self.ledger = self.counts = None

    def add(self, changes):
        self.counts = references.fold(references.deltas(changes, self.ledger), self.counts).checkpoint()
        self.ledger = references.settle(changes, self.ledger).checkpoint()
        return report(self.counts)


def test_report(spark):
    e, l, n, s, k, f = tables(spark)  # noqa: E741
    counts = at_once(references.reference_changes(e, l), references.record_changes(n, s, k, f))
    assert report(counts) == WANT
    sums = {tuple(r) for r in references.orphan_report(references.orphans(counts)).collect()}
    assert ("links", "node_uuid", "2025-01", "missing", 1, 1) in sums


def test_batches_in_any_order(spark):
    e, l, n, s, k, f = tables(spark)  # noqa: E741
    refs, records = references.reference_changes(e, l), references.record_changes(n, s, k, f)
    for order in ((refs, records), (records, refs)):
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        kept = Kept()
        kept.add(order[0])
        assert kept.add(order[1]) == WANT
        assert kept.add(order[0]) == WANT  # delivered again


def test_removal_and_creation_again(spark):
    e, l, n, s, k, f = tables(spark)  # noqa: E741
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    none = [t.limit(0) for t in (n, s, k)]
    kept = Kept()
    kept.add(references.reference_changes(e, l).unionByName(references.record_changes(n, s, k, f)))
    # The row of b_c and the shared node go: references to them are missing then, in each month they were made.
    gone = references.record_changes(n.where("id = 'b_c'"), s, k.limit(0), f.limit(0), 1, True)
    more = {("edges", "target", "b_c", "2025-01", "missing"), ("edges", "target", "b_c", "2025-02", "missing"), ("edges", "target", "shared", "2025-01", "missing")}
    assert kept.add(gone) == WANT | more
    assert kept.add(gone) == WANT | more
    # An old delivery changes nothing, a new version does; taking the deletion back makes 'gone' known again.
    assert kept.add(references.record_changes(n, s, k, f)) == WANT | more
    assert kept.add(references.record_changes(n, s, k.limit(0), f.limit(0), 2)) == WANT
    back = references.record_changes(*none, f, 3, True)
    assert kept.add(back) == {w for w in WANT if w[2] != "gone"}
    assert kept.add(references.record_changes(*none, f, 4)) == WANT
    # References taken back count no more; removing what never was is no change.
    less = references.reference_changes(e.where("target = 'nowhere'"), l.where("node_uuid = 'nothing'"), 5, True)
    assert kept.add(less) == {w for w in WANT if w[2] != "nowhere"}
    assert kept.add(references.reference_changes(e.limit(0), l.selectExpr("'kx' knowledge_uuid", "'ux' node_uuid", "relation", "target_type", "created_at"), 5, True)) == {w for w in WANT if w[2] != "nowhere"}


def test_distinct_and_nulls_apart(spark):
    _, _, n, s, k, f = (t.limit(0) for t in tables(spark))
    e = spark.createDataFrame([("a", None, None, "x", None, None, 1.0, None), (None, "a", "x", None, None, None, 1.0, None), ("a", None, None, "x", None, None, 1.0, None)], "source string, target string, relation string, confidence string, source_file string, source_location string, weight double, seen_at timestamp")
    # The same key as a node's and as an entry's.
    l = spark.createDataFrame([("k", "u", "r", "knowledge", None), ("k", "u", "r", "node", None)], LINK)  # noqa: E741
    found = {tuple(r) for r in references.orphans(at_once(references.reference_changes(e, l), references.record_changes(n, s, k, f))).collect()}
    assert found == {("edges", "source", "a", "", "missing", 1), ("edges", "target", "a", "", "missing", 1), ("links", "knowledge_uuid", "k", "", "missing", 2), ("links", "node_uuid", "u", "", "missing", 2)}


def test_empty(spark):
    e, l, n, s, k, f = (t.limit(0) for t in tables(spark))  # noqa: E741
    assert report(at_once(references.reference_changes(e, l), references.record_changes(n, s, k, f))) == set()
