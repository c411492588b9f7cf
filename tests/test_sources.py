import datetime as dt

import pytest
from loamgraph.sources import files, sinks
from loamgraph.sources.store import Store
from loamgraph.streaming import streams
from pyspark.sql import functions as F


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.tables() == [] and s.commit_id == ""
    n = "id string, label string, source_file string, uuid string"
    first = s.commit({"nodes": spark.createDataFrame([(f"p{i}", "x", "p/a.py", f"u{i}") for i in range(60)] + [("q", "x", "pq/a.py", "uq")], n), "edges": spark.createDataFrame([("p0", "p1", "calls", "p/a.py")], "source string, target string, relation string, source_file string")})
    s.commit({"links": spark.createDataFrame([("k", "u1", "r", False), ("k", "k2", "r", True), ("k", "u0", "r", False)], "knowledge_uuid string, node_uuid string, relation string, is_knowledge boolean")}, since=first)
    with pytest.raises(RuntimeError, match="moved on"):
        s.commit({"edges": s.table("edges")}, since=first)
    with pytest.raises(ValueError, match="shrink"):
        s.merge_project("p", spark.createDataFrame([("p0", "y", "p/a.py", "u0")], n), s.table("edges").limit(0))
    s.merge_project("p", spark.createDataFrame([("p0", "y", "p/a.py", "u0")], n), s.table("edges").limit(0), forced=True)
    assert {(r.id, r.label) for r in s.table("nodes").collect()} == {("p0", "y"), ("q", "x")} and s.table("edges").count() == 0
    assert {r.node_uuid for r in s.table("links").collect()} == {"u0", "k2"}
    s.upsert("nodes", spark.createDataFrame([("q", "new", "pq/a.py", "uq"), ("r", "r", "r", "r")], n))
    assert {(r.id, r.label) for r in s.table("nodes").collect()} == {("p0", "y"), ("q", "new"), ("r", "r")}
    s.prune("nodes", spark.createDataFrame([("q",)], "id string"))
    assert [r.id for r in s.table("nodes").collect()] == ["q"]


def test_scan(spark, tmp_path):
    for p, t in {"src/a.py": "x = 1 + 2", "src/.hidden/b.py": "x", "node_modules/c.js": "x", "docs/d.md": "one two three", "secrets/password.txt": "x", "img/e.png": "z", "skip/f.py": "x", "g.unknown": "x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    found = files.scan(spark, str(tmp_path), files.ignore_lines("# no\n\nskip/\n"))
    assert {(r.path, r.category, r.words) for r in found.collect()} == {("src/a.py", "code", 5), ("docs/d.md", "document", 3), ("img/e.png", "image", 0)}
    assert files.corpus_report(found).first().advice.startswith("small")
    assert files.changed(found, found.where("path = 'src/a.py'")).count() == 2
    keys = files.uncached(found.where("category != 'image'"), spark.createDataFrame([], "key string"), "1")
    assert files.uncached(found.where("category != 'image'"), keys, "1").count() == 0 and files.uncached(found.where("category != 'image'"), keys, "2").count() == 2


def test_notes(spark, tmp_path):
    (tmp_path / "One.md").write_text("---\nid: one\ntype: feedback\nname: 'A: b'\n---\n# One\ntext [[Two]] and [[None]]\n")
    (tmp_path / "Two.md").write_text("---\nlabel: Second\n---\n## Connections\n- [[One]] (calls)\n\n## More\n[[Two]]\n")
    own = files.notes(spark, str(tmp_path))
    n, e = files.vault(own)
    assert {(r.id, r.label) for r in n.collect()} == {("one", "One"), ("two", "Second")}
    assert {(r.source, r.target) for r in e.collect()} == {("one", "two"), ("two", "one")}
    m = {r.title: r.knowledge_type for r in files.memory_entries(own).collect()}
    assert m == {"A: b": "preference", "Two": "context"}


def test_texts(spark):
    readme = spark.createDataFrame([("r", "# Title\n\n![badge](x)\n\nThis tool does a number of useful things.\n\nMore."), ("s", "short")], "path string, text string")
    assert [r.description for r in files.readme_entries(readme).collect()] == ["This tool does a number of useful things."]
    commits = spark.createDataFrame([("h1", "fix crash in the parser"), ("h1", "fix crash in the parser"), ("h2", "merge branch main into x"), ("h3", "fix"), ("h4", "improve speed of lookups")], "hash string, message string")
    assert {(r.title, r.knowledge_type) for r in files.commit_entries(commits).collect()} == {("fix crash in the parser", "bug_pattern"), ("improve speed of lookups", "performance")}
    assert files.commit_entries(commits, spark.createDataFrame([(["commit:h1"],)], "tags array<string>")).count() == 1
    pages = spark.createDataFrame([("https://arxiv.org/x", "<html><title> T </title><p>a<b>b</b></p>"), ("http://127.0.0.1/x", ""), ("ftp://a/b", ""), ("https://h.test/a.pdf", "")], "url string, html string")
    assert {(r.url, r.kind) for r in files.page_entries(pages).collect()} == {("https://arxiv.org/x", "arxiv"), ("https://h.test/a.pdf", "pdf")}
    paths = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("z/q.py",)], "path string")
    projects = spark.createDataFrame([("outer", "a/"), ("inner", "a/b")], "name string, folder string")
    assert {r.path: r.name for r in files.owning_project(paths, projects).collect()} == {"a/b/c.py": "inner", "a/x.py": "outer"}


def graph(spark):
    n = spark.createDataFrame([("a", "Al<pha", "code", "f/a.py", 1), ("b", "Beta", "code", "f/b.py", 1), ("c", "beta", "code", "f/c.py", 2), ("d", None, "odd", "", None)], "id string, label string, file_type string, source_file string, community long")
    e = spark.createDataFrame([("a", "b", "imports", "EXTRACTED", None, 1.0), ("b", "c", "re-lates", "GUESS", None, 1.0), ("b", "zz", "calls", "EXTRACTED", None, 1.0)], "source string, target string, relation string, confidence string, source_location string, weight double")
    return n, e


def test_sinks(spark, tmp_path):
    n, e = graph(spark)
    sinks.graph_json(n, e, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/nodes")).count() == 4 and spark.read.json(str(tmp_path / "json/links")).count() == 3
    sinks.write_lines(sinks.graphml_lines(n, e), str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    assert text.startswith("<?xml") and text.rstrip().endswith("</graphml>") and "Al&lt;pha" in text and text.index("<node") < text.index("<edge")
    assert any("[:RE_LATES]" in r.value for r in sinks.cypher_lines(n, e).collect())
    notes = {r.file: r.text for r in sinks.note_files(n, e).collect()}
    assert set(notes) == {"Al_pha", "Beta", "beta_2", "d"} and "- [[Beta]] (imports)" in notes["Al_pha"]
    assert {(r.id, r.x, r.y) for r in sinks.canvas_cells(n, 2).collect()} == {("a", 0, 0), ("b", 600, 0), ("c", 0, 80), ("d", 600, 80)}
    assert "Beta" in sinks.picture(n, e) and "a -->|imports| b" in sinks.mermaid(n, e)
    assert "## Hubs" in sinks.report(n, e) and sinks.wiki_pages(n, e).where("page = 'index'").count() == 1
    assert sinks.within_budget(n, F.col("id"), F.col("id"), 1) == "a\nb"
    assert {(r.table, r.problem) for r in files.invalid_rows(n, e).collect()} == {("nodes", "no label"), ("edges", "unknown confidence"), ("edges", "dangling")}
    k = spark.createDataFrame([("u" * 9, "T", "api", "d", ["x"]), ("v", "U", "api", "d", ["imported"])], "uuid string, title string, knowledge_type string, description string, tags array<string>")
    assert [r.text for r in sinks.memory_files(k).collect()] == ["---\nname: T\ntype: reference\n---\n\nd\n"]


def test_graph_file(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "label": "A"}, {"label": "no id"}], "links": [{"source": "a", "target": "b"}, {"source": "a"}]}')
    n, e = files.read_graph(spark, str(tmp_path / "g.json"))
    assert n.count() == 1 and e.count() == 1


def run(df, path, mode="append"):
    q = df.writeStream.format("memory").queryName(f"q{abs(hash(path))}").outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(f"q{abs(hash(path))}").collect()


T = lambda m, s=0: dt.datetime(2025, 1, 1, 10 + m // 60, m % 60, s)


def source(spark, tmp_path, rows, schema):
    for i, r in enumerate(rows):  # a file per batch of rows, read in order
        spark.createDataFrame(r, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def test_debounce(spark, tmp_path):
    rows = [[("p", "a.py", T(0, 0)), ("p", "b.md", T(0, 2)), ("p", "c.py", T(0, 9))], [("p", "z.py", T(60))]]
    out = run(streams.debounced(source(spark, tmp_path, rows, "project string, path string, ts timestamp")), str(tmp_path / "c"))
    assert {(r.kind, r.changes) for r in out} == {("code", 2), ("code", 1)}


def test_rebuild_commits_counts_and_idle(spark, tmp_path):
    seen = []
    changes = source(spark, tmp_path / "a", [[("p", "a.py"), ("p", "a.py")], [("q", "b.py")]], "project string, path string")
    streams.rebuild(changes, lambda df, n: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "ca"), every=None).awaitTermination()
    assert sorted(seen) == [("p", "a.py"), ("q", "b.py")]
    commits = source(spark, tmp_path / "b", [[("h", "fix crash in parser", T(0))], [("h", "fix crash in parser", T(1)), ("i", "wip", T(1))]], "hash string, message string, ts timestamp")
    assert [r.hash for r in run(streams.new_commits(commits), str(tmp_path / "cb"))] == ["h"]
    fetches = source(spark, tmp_path / "d", [[("u", T(0))], [("u", T(3)), ("v", T(3))]], "uuid string, ts timestamp")
    assert {(r.uuid, r.fetches) for r in run(streams.retrieval_counts(fetches), str(tmp_path / "cd"), "complete")} == {("u", 2), ("v", 1)}
    requests = source(spark, tmp_path / "e", [[("x", T(0)), ("y", T(0))], [("y", T(20))], [("y", T(40))]], "user string, ts timestamp")
    assert ("x", 1) in {(r.user, r.requests) for r in run(streams.idle_users(requests), str(tmp_path / "ce"))}
    rows = spark.createDataFrame([("a", "m"), ("b", "m")], "id string, model string")
    assert [r.id for r in streams.not_embedded(rows, rows.where("id = 'a'")).collect()] == ["b"]


def test_paths_and_provenance(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("{}")
    (tmp_path / "b.json").write_text("{}")
    (tmp_path / "in/link").symlink_to(tmp_path / "b.json")
    assert files.inside(str(tmp_path / "in/a.json"), str(tmp_path / "in")).endswith("a.json")
    for name in ("in/../b.json", "in/link"):
        with pytest.raises(PermissionError):
            files.inside(str(tmp_path / name), str(tmp_path / "in"))
    for path, base in (("in/none", "in"), ("b.json", "none")):
        with pytest.raises(FileNotFoundError):
            files.inside(str(tmp_path / path), str(tmp_path / base))
    assert files.provenance(str(tmp_path / "in")) in ("cwd:in",) or files.provenance(str(tmp_path / "in")).startswith("commit:")
    assert files.provenance(str(tmp_path / "none")) is None


def test_open_by_kind(spark, tmp_path):
    n, e = graph(spark)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/graph.json").write_text('{"nodes": [{"id": "a", "label": "A"}], "links": [{"source": "a", "target": "a"}]}')
    assert [r.id for r in files.open_graph(spark, str(tmp_path / "d"))[0].collect()] == ["a"] and files.open_graph(spark, str(tmp_path / "d/graph.json"))[1].count() == 1
    s = Store(spark, str(tmp_path / "s"))
    s.commit({"nodes": n, "edges": e})
    assert files.open_graph(spark, str(tmp_path / "s"))[0].count() == 4


def test_two_writers(spark, tmp_path):
    n, _ = graph(spark)
    s = Store(spark, str(tmp_path))
    first = s.commit({"nodes": n})
    s.commit({"nodes": n.limit(1)}, first)
    with pytest.raises(RuntimeError, match="moved on"):
        s.commit({"nodes": n}, first)
    state = s._read()
    s._read = lambda: dict(state, number=state["number"] - 1)  # a writer that has not seen the last snapshot
    with pytest.raises(RuntimeError, match="another writer"):
        s.commit({"nodes": n})
    assert Store(spark, str(tmp_path)).table("nodes").count() == 1


def test_escapes_and_marks(spark):
    from loamgraph.functions import text as X
    from loamgraph.operators import search

    df = spark.createDataFrame([("a'b\n</c>\u2603\u00e9", 'x["y"]|{z}')], "a string, b string")
    r = df.select(X.js_escaped("a").alias("js"), X.strip_symbols(F.col("a")).alias("plain"), X.mermaid_escaped(F.col("b")).alias("m"), X.highlighted(F.lit("Server::handle_request"), "hreq").alias("h")).first()
    assert r.js == "a\\'b\\n<\\/c>\u2603\u00e9" and r.plain == "a'b\n</c>\u00e9" and r.m == "x #quot;y#quot;   z " and r.h == "Server::[h]andle_[req]uest"
    assert search.fuzzy_match("process_search_queue", "psq")[1] == [0, 8, 15] and search.fuzzy_match("abc", "B") == (0, [])
    assert search.fuzzy_points("tickSearch", "search") > search.fuzzy_points("some_arch_each", "search") and search.fuzzy_points("tick", "tick no") == 0


def test_charts_say_what_they_cut(spark):
    n, e = graph(spark)
    assert "%% cut: 2 of 4 nodes" in sinks.mermaid(n, e, 2) and "%%" not in sinks.mermaid(n, e)


def test_log_of_commits(spark):
    log = "\x01abc\x021735700000\x02Ann\n\na/b.py\nc.py\n\x01def\x021735700001\x02Bo\n\na/b.py\n"
    assert {(r.commit_id, r.file, r.author) for r in files.parse_log(spark, "r", log).collect()} == {("abc", "a/b.py", "Ann"), ("abc", "c.py", "Ann"), ("def", "a/b.py", "Bo")}
    assert files.parse_log(spark, "r", "").count() == 0


def test_project_into_a_store(spark, tmp_path):
    from loamgraph.plans import pipeline

    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "setup.py").write_text("")
    (root / "src/a.py").write_text("class A:\n    def run(self):\n        return helper()\n\ndef helper():\n    pass\n")
    s = Store(spark, str(tmp_path / "s"))
    pipeline.run_project(s, str(root), "proj")
    first = {r.label: r.uuid for r in s.table("nodes").collect()}
    assert {"A", ".run()", "helper()", "proj"} <= set(first) and len(set(first.values())) == len(first)
    assert {("calls", "INFERRED")} <= {(r.relation, r.confidence) for r in s.table("edges").collect()}
    (root / "src/a.py").write_text("import os\n\nclass A:\n    def run(self):\n        return helper()\n\ndef helper():\n    pass\n")
    (tmp_path / "q").mkdir()
    (tmp_path / "q/b.py").write_text("def other():\n    pass\n")
    assert set(pipeline.run_workspace(s, {"proj": str(root), "q": str(tmp_path / "q")})) == {"proj", "q"}
    again = {r.label: r.uuid for r in s.table("nodes").collect()}
    assert again["A"] == first["A"] and again["helper()"] == first["helper()"] and "other()" in again
