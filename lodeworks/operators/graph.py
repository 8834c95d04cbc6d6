"""Dependency-graph analytics over edges(src, dst). Loops over rounds write each round to the checkpoint folder."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.sources.scratch import scratch_dir


def _cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) from pages(page_id, html): a page's links, each once."""
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    return pages.select(F.col("page_id").cast("string").alias("src"), links.alias("dst")).distinct()


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): imports(path, module) resolved against files(path, module): the module itself or its nearest parent.

    Prefixes are exploded, so resolution is an equality join.
    """
    parts = F.split("module", r"\.")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("m")))
    wanted = imports.select("path", "module", F.explode(prefix).alias("p")).select("path", "module", F.col("p.n").alias("n"), F.col("p.m").alias("m"))
    known = files.select(F.col("path").alias("dst"), F.col("module").alias("m"))
    best = wanted.join(known, "m").groupBy("path", "module").agg(F.max(F.struct("n", "dst")).alias("best"))
    return best.select(F.col("path").alias("src"), F.col("best.dst").alias("dst")).filter("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, n_total) in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    rows = ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))
    return rows.withColumn("n_total", F.col("n_in") + F.col("n_out"))


def graph_metrics(edges: DataFrame) -> DataFrame:
    n = degrees(edges).agg(F.count("*").alias("n_nodes"))
    m = edges.agg(F.count("*").alias("n_edges"))
    rows = n.crossJoin(m)  # one row each
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return rows.select(
        "n_nodes", "n_edges", (2 * F.col("n_edges") / F.nullif(F.col("n_nodes"), F.lit(0))).alias("avg_degree"), (F.col("n_edges") / F.nullif(pairs, F.lit(0))).alias("density")
    )


def most_connected(edges: DataFrame, k: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("n_total"), "node").limit(k)


def top_subgraph(edges: DataFrame, k: int = 100) -> DataFrame:
    """Edges between the k nodes of the highest degree."""
    top = F.broadcast(most_connected(edges, k).select("node"))  # k rows
    return edges.join(top.withColumnRenamed("node", "src"), "src", "left_semi").join(top.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def bfs_depths(edges: DataFrame, start) -> DataFrame:
    """(node, depth) of all nodes reachable from start: a round for each depth that there is."""
    seen = _cut(edges.sparkSession.createDataFrame([(start, 0)], f"node {edges.schema['src'].dataType.simpleString()}, depth int"))
    front = seen
    for depth in itertools.count(1):
        reached = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = _cut(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = _cut(seen.unionByName(front))
    return seen


def core(edges: DataFrame) -> DataFrame:
    """What is left when nodes without an edge in or without an edge out are taken away, again and again: empty if acyclic."""
    now, before = _cut(edges.filter("src <> dst").distinct()), -1
    count = now.count()
    while count != before and count:
        kept = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = kept.join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        now, before = _cut(kept), count
        count = now.count()
    return now


def has_cycle(edges: DataFrame) -> DataFrame:
    loops = edges.filter("src = dst").limit(1).count() > 0
    return edges.sparkSession.createDataFrame([(loops or not core(edges).isEmpty(),)], "has_cycle boolean")


def longest_path(edges: DataFrame) -> DataFrame:
    """Edges on the longest path of an acyclic graph, 0 if there is a cycle: layers of nodes are peeled off the front."""
    left, length = _cut(edges.filter("src <> dst").distinct()), 0
    cyclic = edges.filter("src = dst").limit(1).count() > 0
    count = left.count()
    while count:
        rest = _cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        rows = rest.count()
        if rows == count:
            cyclic = True
            break
        left, count, length = rest, rows, length + 1
    return edges.sparkSession.createDataFrame([(0 if cyclic else length,)], "longest_path int")


def simple_cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(cycle, length, severity): simple cycles, of up to `most` nodes if that is given, each from its smallest node on."""
    edges = core(edges)
    paths = edges.filter("src < dst").select(F.array("src", "dst").alias("path"))
    found = edges.sparkSession.createDataFrame([], f"cycle array<{edges.schema['src'].dataType.simpleString()}>")
    for length in itertools.count(2):
        last = F.element_at("path", -1)
        closed = paths.join(edges, (last == F.col("src")) & (F.element_at("path", 1) == F.col("dst"))).select(F.col("path").alias("cycle"))
        found = found.unionByName(closed)
        if length == most or paths.isEmpty():
            break
        longer = paths.join(edges, (last == F.col("src")) & (F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst")))
        paths = _cut(longer.select(F.concat("path", F.array("dst")).alias("path")))
    n = F.size("cycle")
    return found.select("cycle", n.alias("length"), F.when(n >= 5, "high").when(n >= 3, "medium").otherwise("low").alias("severity"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on cycles: smallest node that reaches and is reached, by rounds over the cyclic core.

    Forward and backward smallest labels; nodes that agree with a label's own node on both are one component and leave.
    """
    left = core(edges)
    kind = edges.schema["src"].dataType.simpleString()
    done = edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        labels = _cut(nodes.select("node", F.col("node").alias("f"), F.col("node").alias("b")))
        while True:
            f = left.join(labels.select(F.col("node").alias("src"), "f"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("f").alias("nf"))
            b = left.join(labels.select(F.col("node").alias("dst"), "b"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("b").alias("nb"))
            new = labels.join(f, "node", "left").join(b, "node", "left")
            new = _cut(new.select("node", F.least("f", F.coalesce("nf", "f")).alias("f"), F.least("b", F.coalesce("nb", "b")).alias("b"), "f", "b").toDF("node", "f", "b", "of", "ob"))
            changed = not new.filter("f <> of OR b <> ob").isEmpty()
            labels = new.select("node", "f", "b")
            if not changed:
                break
        ready = _cut(labels.filter("f = b").select("node", F.col("f").alias("component")))
        done = done.unionByName(ready)
        rest = left.join(ready.select(F.col("node").alias("src")), "src", "left_anti").join(ready.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = core(rest.select("src", "dst"))
    return done.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").join(done, "component").select("node", "component")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, needs, needed): sorted nodes that each node points to, and those that point to it."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("needs"))
    back = edges.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("needed"))
    none = F.array().cast(f"array<{edges.schema['src'].dataType.simpleString()}>")
    return out.join(back, "node", "full").select("node", F.coalesce("needs", none).alias("needs"), F.coalesce("needed", none).alias("needed"))
