import pytest
from loamgraph.api import METHODS, Engine
from loamgraph.functions import sql
from loamgraph.functions import text as T
from loamgraph.operators import search
from loamgraph.sources.store import Store
from pyspark.sql import functions as F

from test_knowledge import NOW, entry, know, links

NODE = "id string, label string, file_type string, source_file string, source_location string, community long, uuid string, body_hash string, logical_key string"
EDGE = "source string, target string, relation string, confidence string, source_file string, source_location string, weight double"
#: The names of the methods that callers know.
KNOWN = "query_graph get_node find_callers find_callees trace_call_path detect_cycles god_nodes compare_graphs semantic_search analyze_change detect_renames co_changes list_communities graph_stats learn recall knowledge_context forget save_insight save_note add_edge recall_for_task get_task_context recall_for_task_structured validate_knowledge mark_obsolete update_knowledge link_knowledge_to_nodes clear_knowledge_links remove_link link_knowledge knowledge_neighbors thought_chain knowledge_graph detect_stale find_duplicates merge_knowledge detect_conflicts knowledge_health get_review_queue complete_review refresh_review_queue recall_for_diff reason"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("api") / "store"))
    n = spark.createDataFrame([(i, f"{i}()", "code", f"p/{i}.py", "L10", 1, f"u{i}", f"h{i}", f"p/{i}.py::{i}") for i in "abcd"] + [("r1", "aNew()", "code", "r/r.py", "L1", 2, "ur", None, None)], NODE)
    e = spark.createDataFrame([(x, y, "calls", "EXTRACTED", "f", "L1", 1.0) for x, y in ("ab", "bc", "db", "ca")], EDGE)
    k = know(spark, entry("k1", "cache lock order", "decision", "the cache lock must be taken first", scope="repo"), entry("k2", "cache lock order rule", "decision", "the cache lock is taken last", scope="repo"), entry("k3", "other", "ops", "nothing", status="needs_review"))
    l = links(spark, ("k1", "ua", "r", False, "ha"), ("k1", "k2", "contradicts", True), ("k2", "ub", "r"))  # noqa: E741
    v = spark.createDataFrame([(i, "m", 2, search.pack(x)) for i, x in (("a", [1, 0]), ("b", [0, 1]), ("c", [1, 1]))], "node_id string, model string, dim int, vec binary")
    s.commit({"nodes": n, "edges": e, "knowledge": k, "links": l, "node_embeddings": v})
    return Engine(s, NOW)


def test_all_methods_are_there(engine):
    assert set(KNOWN.split()) <= METHODS
    with pytest.raises(ValueError, match="no method"):
        engine.call("_uuids", uuids=[])


def test_graph_methods(engine, spark):
    ids = lambda df, c="id": {r[c] for r in df.collect()}
    assert ids(engine.call("find_callers", ids=["c"], depth=1)) == {"b"} and ids(engine.call("find_callees", ids=["a"])) == {"b"}
    assert engine.call("trace_call_path", starts=["a"], ends=["c"]).first().path == "a > b > c"
    assert engine.call("detect_cycles").first().size == 3 and engine.call("god_nodes", top=1).first().id == "b"
    assert engine.call("graph_stats") == {"nodes": 5, "edges": 4, "communities": 2}
    assert ids(engine.call("query_graph", question="anew", depth=1)) == {"r1"} and engine.call("query_graph", question="nothing").count() == 0
    hit = engine.call("get_node", query="anew", expand="calls").first()
    assert (hit.id, hit.score, hit.degree, hit.members) == ("r1", 2, 0, "") and engine.call("explain", query="anew").count() == 0
    gaps = engine.call("compare_graphs", left="p/", right="r/", least=1, threshold=0.3)
    assert ids(gaps["gaps"], "label") == {"a()", "b()", "c()", "d()"}
    hits = engine.call("semantic_search", vector=[1.0, 0.0], top=2)
    assert [r.id for r in hits["hits"].collect()] == ["a", "c"] and ids(hits["knowledge"], "uuid") == {"k1"}
    assert set(engine.call("list_communities", min_size=1)) == {"nodes", "files", "labels"}
    diff = "--- a/p/a.py\n+++ b/p/a.py\n@@ -9,3 +9,3 @@ x\n"
    change = engine.call("analyze_change", diff=diff, commit_files=spark.createDataFrame([("r", "1", "p/a.py"), ("r", "1", "p/z.py")], "repo string, commit_id string, file string"))
    assert change["knowledge"].first().uuid == "k1" and ids(change["co_changes"], "file") == {"p/z.py"}
    assert engine.call("detect_renames").count() == 0


def test_knowledge_methods(engine, spark):
    uuids = lambda df: {r.uuid for r in df.collect()}
    assert uuids(engine.call("recall", query="cache")) == {"k1", "k2"}
    assert engine.call("recall_for_task", question="cache lock", files=["p/a.py"], node_uuids=["ua"], most=1).first().uuid == "k1"
    context = engine.call("get_task_context", question="cache", files=["p/a.py"], task="refactor")
    assert {r.conflict_type for r in context["conflicts"].collect()} >= {"contradiction"} and context["recommendations"].where("priority = 10").count() >= 1 and uuids(context["warnings"]) == {"k3"}
    assert uuids(engine.call("reason", uuids=["k1"])) == {"k2"} and uuids(engine.call("knowledge_neighbors", uuid="k1")) == {"k2"}
    assert {r.uuid: r.outgoing for r in engine.call("knowledge_graph", start="k1").collect()} == {"k1": "contradicts k2", "k2": ""}
    assert engine.call("knowledge_graph").count() == 3 and engine.call("knowledge_health").first().total == 3
    engine.call("refresh_review_queue")
    first = {r.knowledge_uuid for r in engine.call("get_review_queue").collect()}
    assert "k1" in first
    engine.call("complete_review", uuid="k1")
    assert "k1" not in {r.knowledge_uuid for r in engine.call("get_review_queue").collect()}
    engine.call("update_knowledge", uuid="k3", status="active", title="renamed")
    assert engine.knowledge.where("uuid = 'k3'").first().title == "renamed"
    engine.call("link_knowledge", source="k3", target="k1", relation="supports", both_ways=True)
    assert engine.links.where("knowledge_uuid = 'k1' AND node_uuid = 'k3' AND relation = 'supported_by'").count() == 1
    engine.call("link_knowledge_to_nodes", uuid="k3", node_uuids=["UC", "nope"])
    assert engine.links.where("knowledge_uuid = 'k3' AND NOT is_knowledge").first().linked_body_hash == "hc"
    engine.call("clear_knowledge_links", uuid="k3")
    assert engine.links.where("knowledge_uuid = 'k3' AND NOT is_knowledge").count() == 0
    engine.call("remove_link", source="k3", target="k1")
    engine.call("merge_knowledge", keep="k1", absorb="k2")
    assert engine.knowledge.where("uuid = 'k2'").first().status == "obsolete"
    engine.call("save_insight", title="seen", text="a thing")
    engine.call("mark_obsolete", uuids=["k3"])
    engine.call("forget", title="renamed")
    engine.call("record_fetch", uuids=["k1"])
    engine.call("add_edge", source="a", target="d", relation="uses")
    assert engine.edges.count() == 5 and engine.knowledge.count() == 3 and engine.knowledge.where("uuid = 'k1'").first().fetch_count == 1


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT normal_id('--A.b c_') a, label_norm('hurry_Up()') b, label_norm('()') c, label_tokens('tickSearchX_y2') d, token_jaccard(array('a', 'b'), array('b', 'c')) e, logical_key('a/b/c.rs', 'f()') f, line_number('L12-L15') g, reinforced(0.6D, 2) h, cosine(array(1D, 0D), array(1D, 1D)) i, recency_points(1000000, 999999) j, path_form('.\\\\\\\\a\\\\\\\\b') k").first()
    assert (r.a, r.b, r.c, r.d) == ("a_b_c", "hurryup", None, ["tick", "search", "y2"])
    assert abs(r.e - 1 / 3) < 1e-12 and (r.f, r.g, r.j) == ("b/c.rs::f", 12, 10.0) and abs(r.h - 0.744) < 1e-9 and abs(r.i - 0.5**0.5) < 1e-12


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.body_form(F.lit("a = 1 // c\n/* x\ny */ b # d\n"))) == "a=1b" and one(T.body_hash(F.lit("a  b"))) == one(T.body_hash(F.lit("ab")))
    assert one(T.highlighted(F.lit("tickSearch"), "search")) == "tick[Search]" and one(T.civil_date(F.lit(86_400 * 59))) == "1970-03-01"
    assert one(T.label_norm(F.lit("Server::close"))) == "serverclose" and one(T.url_kind(F.lit("https://h/x.PDF"))) == "pdf"
    assert one(T.safe_filename(F.lit("a/b:c"))) == "a_b_c" and one(T.safe_label(F.lit("a\x00b" + "c" * 300))) == "ab" + "c" * 254


def test_vectors_of_gaps(spark):
    v = search.unpack(spark.createDataFrame([(i, 2, search.pack(x)) for i, x in (("g", [1, 0]), ("r1", [1, 0.1]), ("r2", [0, 1]), ("r3", [1, 1]))], "id string, dim int, vec binary"))
    gaps, right = spark.createDataFrame([("n", "g")], "norm string, id string"), spark.createDataFrame([("r1",), ("r2",), ("r3",)], "id string")
    near = search.gap_neighbors(gaps, right, v)
    assert [(r.id, r.place) for r in near.orderBy("place").collect()] == [("r1", 1), ("r3", 2)]
    words = spark.createDataFrame([("n", "r2", 0.5)], "norm string, id string, jaccard double")
    assert {(r.id, r.jaccard is None, r.cosine is None) for r in search.merged_candidates(words, near).collect()} == {("r1", True, False), ("r3", True, False), ("r2", False, True)}
