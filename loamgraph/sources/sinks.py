"""Writers of graphs, reports and notes. Lines are made by expressions and written by tasks; only summaries are made on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.operators import community, graph

#: Nodes of the largest picture, colours of communities, spacing of a canvas.
MOST_DRAWN, COLOURS, ROW, COLUMN = 5000, ("#4E79A7", "#F28E2B", "#E15759", "#76B7B2", "#59A14F", "#EDC948", "#B07AA1", "#FF9DA7", "#9C755F", "#BAB0AC"), 80, 600


#: Keys of a graph file, what they are for, and their types.
GRAPHML_KEYS = (("label", "node", "string"), ("file_type", "node", "string"), ("source_file", "node", "string"), ("community", "node", "int"), ("relation", "edge", "string"), ("confidence", "edge", "string"))


def graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two folders of JSON lines, nodes and links, for any size."""
    nodes.withColumn("norm_label", T.label_norm(F.coalesce("label", F.lit("")))).write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/links")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): parts in order are head, nodes, edges and foot."""
    e = lambda c: T.xml_escaped(F.coalesce(c, F.lit("")))
    part = F.coalesce(F.format_string('<data key="community">%d</data>', "community"), F.lit(""))
    part = F.when(F.col("community").isNotNull(), part).otherwise("")
    n = nodes.select(F.lit(1).alias("part"), F.format_string('<node id="%s"><data key="label">%s</data><data key="file_type">%s</data><data key="source_file">%s</data>%s</node>', e("id"), e("label"), e("file_type"), e("source_file"), part).alias("value"))
    m = edges.select(F.lit(2).alias("part"), F.format_string('<edge source="%s" target="%s"><data key="relation">%s</data><data key="confidence">%s</data></edge>', e("source"), e("target"), e("relation"), e("confidence")).alias("value"))
    keys = "".join(f'<key id="{k}" for="{w}" attr.name="{k}" attr.type="{t}"/>' for k, w, t in GRAPHML_KEYS)
    ends = nodes.sparkSession.createDataFrame([(0, f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, value string")
    return ends.unionByName(n).unionByName(m)


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    quoted = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    name = F.upper(F.regexp_replace(F.coalesce("relation", F.lit("")), "[^A-Za-z0-9_]", "_"))
    n = nodes.select(F.format_string("MERGE (n:Node {id: '%s'}) SET n.label = '%s', n.file = '%s';", quoted("id"), quoted("label"), quoted("source_file")).alias("value"))
    m = edges.select(F.format_string("MATCH (a:Node {id: '%s'}), (b:Node {id: '%s'}) MERGE (a)-[:%s]->(b);", quoted("source"), quoted("target"), F.when(name.rlike("[A-Z0-9]"), name).otherwise("RELATES_TO")).alias("value"))
    return n.withColumn("part", F.lit(1)).unionByName(m.withColumn("part", F.lit(2)))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files whose names sort as their parts."""
    lines.repartitionByRange("part").sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)


def note_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, text): a note per node with its connections; names that would meet get a number."""
    base = T.safe_filename(F.coalesce("label", "id"))
    own = nodes.withColumn("base", F.when(base != "", base).otherwise(F.col("id")))
    place = F.row_number().over(W.partitionBy(F.lower("base")).orderBy("id"))
    named = own.withColumn("file", F.concat("base", F.when(place > 1, F.concat(F.lit("_"), place.cast("string"))).otherwise("")))
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("o"), "relation").join(named.select(F.col("id").alias("o"), F.col("file").alias("to")), "o")
    listed = ends.groupBy("id").agg(F.array_sort(F.collect_set(F.format_string("- [[%s]] (%s)", "to", "relation"))).alias("links"))
    head = F.format_string("---\nid: %s\nfile_type: %s\nsource_file: %s\n---\n# %s\n", "id", F.coalesce("file_type", F.lit("")), "source_file", F.coalesce("label", F.lit("")))
    text = F.concat(head, F.when(F.size("links") > 0, F.concat(F.lit("\n## Connections\n"), F.array_join("links", "\n"), F.lit("\n"))).otherwise(""))
    return named.join(listed, "id", "left").select("file", text.alias("text"))


def canvas_cells(nodes: DataFrame, columns: int) -> DataFrame:
    """(id, x, y) on a grid, in order of id."""
    from loamgraph.operators.prefix import dense_ids

    own = dense_ids(nodes.select("id").repartitionByRange("id").sortWithinPartitions("id"), "n")
    return own.select("id", (F.col("n") % columns * COLUMN).alias("x"), (F.floor(F.col("n") / columns) * ROW).alias("y"))


#: A page's script: nodes are laid out by springs and drawn, edges under them; a click names a node.
_DRAW = """
const c=document.getElementById('c'),x=c.getContext('2d'),N=data.nodes,E=data.edges,at={};c.width=innerWidth;c.height=innerHeight;
N.forEach((n,i)=>{const r=20*Math.sqrt(i+1),a=2.4*i;n.x=c.width/2+r*Math.cos(a);n.y=c.height/2+r*Math.sin(a);at[n.id]=n});
for(let t=0;t<60;t++){for(const e of E){const p=at[e.from],q=at[e.to];if(!p||!q||p===q)continue;const dx=q.x-p.x,dy=q.y-p.y,d=Math.hypot(dx,dy)||1,f=(d-60)/d*.02;p.x+=dx*f;p.y+=dy*f;q.x-=dx*f;q.y-=dy*f}
const g={};for(const n of N){const k=(n.x/40|0)+','+(n.y/40|0);(g[k]=g[k]||[]).push(n)}for(const k in g)for(const p of g[k])for(const q of g[k])if(p!==q){const dx=p.x-q.x,dy=p.y-q.y,d=Math.hypot(dx,dy)||1;p.x+=dx/d*.5;p.y+=dy/d*.5}}
x.strokeStyle='#ccc';for(const e of E){const p=at[e.from],q=at[e.to];if(p&&q){x.beginPath();x.moveTo(p.x,p.y);x.lineTo(q.x,q.y);x.stroke()}}
for(const n of N){x.fillStyle=n.color;x.beginPath();x.arc(n.x,n.y,n.size/4,0,7);x.fill();if(n.size>25){x.fillStyle='#222';x.fillText(n.label,n.x+n.size/4,n.y)}}
c.onclick=v=>{for(const n of N)if(Math.hypot(n.x-v.pageX,n.y-v.pageY)<n.size/4+2)alert(n.label)};
"""


def picture(nodes: DataFrame, edges: DataFrame) -> str:
    """A page that draws the graph; more nodes than MOST_DRAWN, or edges than 20 times that, are refused."""
    import json

    rows = graph.with_degrees(nodes.select("id", "label", "community"), edges).limit(MOST_DRAWN + 1).collect()
    lines = edges.select("source", "target", "relation").limit(20 * MOST_DRAWN + 1).collect()
    if len(rows) > MOST_DRAWN or len(lines) > 20 * MOST_DRAWN:
        raise ValueError(f"more than {MOST_DRAWN} nodes or {20 * MOST_DRAWN} edges")
    most = max([1, *(r.degree for r in rows)])
    points = [{"id": r.id, "label": r.label or r.id, "size": 10 + 30 * r.degree / most, "color": COLOURS[(r.community or 0) % len(COLOURS)]} for r in sorted(rows, key=lambda r: (-r.degree, r.id))]
    drawn = [{"from": r.source, "to": r.target, "title": r.relation} for r in lines]
    data = json.dumps({"nodes": points, "edges": drawn}).replace("</", "<\\/")
    return f"<!doctype html><meta charset=utf-8><title>graph</title><canvas id=c></canvas><script>const data={data};{_DRAW}</script>"


def mermaid(nodes: DataFrame, edges: DataFrame, most: int = 200) -> str:
    """A flow chart of a small part of a graph; a comment says how much of a larger one is left out."""
    clean = lambda s: "".join(c if c.isalnum() else "_" for c in s)
    rows = nodes.select("id", T.mermaid_escaped(F.coalesce("label", "id")).alias("label")).orderBy("id").limit(most + 1).collect()
    more, rows = rows[most:], rows[:most]
    known = {r.id for r in rows}
    own = edges.where(F.col("source").isin(*known) & F.col("target").isin(*known)).select("source", "target", "relation").distinct()
    lines = own.orderBy("source", "target", "relation").limit(5 * most + 1).collect()
    out = ["graph TD"] + [f'  {clean(r.id)}["{r.label}"]' for r in rows] + [f"  {clean(r.source)} -->|{r.relation}| {clean(r.target)}" for r in lines[: 5 * most]]
    if more or len(lines) > 5 * most:
        out.append(f"  %% cut: {len(rows)} of {nodes.count()} nodes, {min(len(lines), 5 * most)} of {own.count()} edges between them")
    return "\n".join(out)


def within_budget(lines: DataFrame, text: Column, order: Column, tokens: int) -> str:
    """Lines in order, cut at four bytes a token."""
    room, out = tokens * 4, []
    for r in lines.select(order.alias("o"), text.alias("t")).orderBy("o", "t").limit(max(1, room)).collect():
        room -= len(r.t.encode()) + 1
        if room < 0:
            break
        out.append(r.t)
    return "\n".join(out)


def report(nodes: DataFrame, edges: DataFrame, top: int = 10, corpus: DataFrame | None = None, hyperedges: DataFrame | None = None) -> str:
    """A report in Markdown: corpus, sizes and confidence, hubs of communities, hubs, surprises, hyperedges, communities, doubtful edges, gaps, questions.

    ``corpus`` is the row of files.corpus_report; ``hyperedges`` have label, relation and nodes.
    """
    n, e = nodes.count(), edges.count()
    out = ["# Graph report", "", "## Corpus", ""]
    out += [f"- {r.files} files, {r.words} words{': ' + r.advice if r.advice else ''}" for r in corpus.collect()] if corpus is not None else ["- not scanned"]
    kinds = {r.confidence: r["count"] for r in edges.groupBy("confidence").count().collect()}
    out += ["", "## Summary", "", f"{n} nodes, {e} edges", *(f"- {k}: {c} ({100 * c // max(1, e)}%)" for k, c in sorted(kinds.items(), key=lambda x: str(x[0])))]
    degree = graph.with_degrees(nodes.select("id", "label"), edges)
    isolated, thin = degree.where("degree <= 1"), community.top_nodes(nodes, edges, 1, 1).where("size < 3")
    gaps = isolated.orderBy("id").limit(top).select(F.format_string("%s has one connection or none", F.coalesce("label", "id")).alias("t")).unionByName(thin.orderBy("community").limit(top).select(F.format_string("community %d has %d nodes", "community", "size").alias("t")))
    doubtful = edges.where("confidence = 'AMBIGUOUS'").select("source", "relation", "target").distinct().orderBy("source", "target", "relation").limit(top)
    sections = (
        ("Community hubs", community.top_nodes(nodes, edges, 3, 3).orderBy(F.col("size").desc(), "community", "place").limit(3 * top), lambda r: f"{r.community}: {r.id} ({r.degree})"),
        ("Hubs", graph.god_nodes(nodes, edges, top), lambda r: f"{r.label} ({r.degree})"),
        ("Surprising connections", graph.surprising(nodes, edges, top), lambda r: f"{r.source} {r.relation} {r.target}: {r.reasons}"),
        ("Hyperedges", hyperedges.orderBy("label").limit(top) if hyperedges is not None else None, lambda r: f"{r.label} ({r.relation}): {', '.join(r.nodes)}"),
        ("Communities", community.top_nodes(nodes, edges, 1, 3).orderBy(F.col("size").desc(), "community").limit(top), lambda r: f"{r.community}: {r.size} nodes, {r.id}"),
        ("Ambiguous edges", doubtful, lambda r: f"{r.source} {r.relation} {r.target}"),
        ("Knowledge gaps", gaps, lambda r: r.t),
        ("Questions", graph.questions(nodes, edges, top), lambda r: r.question),
    )
    for title, df, line in sections:
        rows = df.collect() if df is not None else []
        if rows:
            out += ["", f"## {title}", "", *(f"- {line(r)}" for r in rows)]
    return "\n".join(out) + "\n"


def wiki_pages(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """(page, text): an index, and a page per community with its hubs and files."""
    hubs = community.top_nodes(nodes, edges, 5, 1).groupBy("community").agg(F.max("size").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: F.concat(F.lit("- "), x["id"])), "\n").alias("hubs"))
    files = community.top_files(nodes, 5, 1).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "source_file"))), lambda x: F.concat(F.lit("- "), x["source_file"])), "\n").alias("files"))
    pages = hubs.join(files, "community", "left").select(F.format_string("community_%d", "community").alias("page"), F.format_string("# Community %d\n\n%d nodes\n\n## Hubs\n%s\n\n## Files\n%s\n", "community", "size", "hubs", F.coalesce("files", F.lit(""))).alias("text"), "size")
    index = pages.orderBy(F.col("size").desc(), "page").limit(top).agg(F.lit("index").alias("page"), F.concat(F.lit("# Index\n\n"), F.array_join(F.collect_list(F.format_string("- [[%s]] %d nodes", "page", "size")), "\n")).alias("text"))
    return index.unionByName(pages.select("page", "text"))


def memory_files(entries: DataFrame) -> DataFrame:
    """(file, text) of entries that did not come from memory files."""
    back = {"preference": "feedback", "context": "project", "api": "reference"}
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in back.items() for x in kv)), F.col("knowledge_type")), F.lit("project"))
    own = entries.where(~F.arrays_overlap("tags", F.array(F.lit("imported"), F.lit("memory"))))
    return own.select(T.safe_filename(F.concat("title", F.lit("_"), F.left("uuid", F.lit(8)))).alias("file"), F.format_string("---\nname: %s\ntype: %s\n---\n\n%s\n", "title", kind, "description").alias("text"))
