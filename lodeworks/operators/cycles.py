"""All simple cycles of a directed graph, and reports on them.

Cycles lie inside strong components, so each component's edges are one row, and its start nodes are dealt out in parts. A task
walks from a start over the nodes that come after it, with the blocking of Johnson's algorithm: a node that led nowhere stays shut
until one that it waits for is on no path any more. Cycles leave in batches; what a task holds is one component's edges and one
path. The number of cycles may grow exponentially with a component; nothing bounds their length or their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.operators.graph import strong_components

BATCH = 5000
STARTS = 16  # start nodes of a part
TOP = 10

# From how many nodes on a cycle is of a severity, and their order.
SEVERITIES = (("high", 5), ("medium", 3), ("low", 1))


def cycles_from(start, follow: dict) -> Iterator[list]:
    """Simple cycles whose smallest node is start; follow: nodes after each node, in one strong component."""
    within = _around(start, follow)
    if start not in within:
        return
    shut, waiting = {start}, {}
    path, branches, closed = [start], [iter(within[start])], [False]

    def open_again(node) -> None:
        todo = [node]
        while todo:
            one = todo.pop()
            if one in shut:
                shut.discard(one)
                todo.extend(waiting.pop(one, ()))

    while path:
        for node in branches[-1]:
            if node == start:
                yield list(path)
                closed[-1] = True
            elif node not in shut:
                path.append(node)
                shut.add(node)
                branches.append(iter(within[node]))
                closed.append(False)
                break
        else:
            last, found = path.pop(), closed.pop()
            branches.pop()
            if found:
                open_again(last)
                if closed:
                    closed[-1] = True
            else:
                for node in within[last]:
                    waiting.setdefault(node, set()).add(last)


def _around(start, follow: dict) -> dict:
    """Edges between the nodes from start on that start reaches and that reach start."""

    def reach(edges: dict) -> set:
        seen, todo = set(), [start]
        while todo:
            for node in edges.get(todo.pop(), ()):
                if node >= start and node not in seen:
                    seen.add(node)
                    todo.append(node)
        return seen

    back: dict = {}
    for a, own in follow.items():
        for b in own:
            back.setdefault(b, []).append(a)
    both = reach(follow) & reach(back)
    return {a: [b for b in follow.get(a, ()) if b in both] for a in both}


def severity(length: Column) -> Column:
    made = F.when(length >= SEVERITIES[0][1], SEVERITIES[0][0])
    for name, least in SEVERITIES[1:-1]:
        made = made.when(length >= least, name)
    return made.otherwise(SEVERITIES[-1][0])


def description(cycle: Column) -> Column:
    pair = F.concat(F.lit("Direct circular dependency between "), cycle[0].cast("string"), F.lit(" and "), F.element_at(cycle, 2).cast("string"))
    chain = F.concat(F.lit("Circular dependency chain: "), F.array_join(F.concat(cycle, F.slice(cycle, 1, 1)).cast("array<string>"), " → "))
    return F.when(F.size(cycle) == 2, pair).otherwise(chain)


def all_cycles(edges: DataFrame, starts: int = STARTS) -> DataFrame:
    """(cycle, length, severity, description) of every simple cycle of edges(src, dst), each from its smallest node on.

    Nodes of null are no nodes; repeated edges count once; an edge from a node to itself is a cycle of one.
    """
    kind = edges.schema["src"].dataType.simpleString()
    edges = edges.select("src", F.col("dst").cast(kind).alias("dst")).dropna().distinct()
    member = strong_components(edges)
    own = edges.join(member.withColumnsRenamed({"node": "src", "component": "c"}), "src").join(member.withColumnsRenamed({"node": "dst"}), "dst").filter("c = component AND src <> dst")
    graphs = own.groupBy("component").agg(F.collect_list("src").alias("src"), F.collect_list("dst").alias("dst"))
    place = F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1
    parts = member.withColumn("part", F.floor(place / starts)).groupBy("component", "part").agg(F.sort_array(F.collect_list("node")).alias("starts"))
    work = graphs.join(parts, "component").repartition("component", "part")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                follow: dict = {}
                for a, b in zip(row.src, row.dst, strict=True):
                    follow.setdefault(a, []).append(b)
                batch: list[list] = []
                for start in row.starts:
                    for cycle in cycles_from(start, follow):
                        batch.append(cycle)
                        if len(batch) == BATCH:
                            yield pd.DataFrame({"cycle": batch})
                            batch = []
                if batch:
                    yield pd.DataFrame({"cycle": batch})

    found = work.select("src", "dst", "starts").mapInPandas(walk, f"cycle array<{kind}>")
    found = found.unionByName(edges.filter("src = dst").select(F.array("src").alias("cycle")))
    n = F.size("cycle")
    return found.select("cycle", n.alias("length"), severity(n).alias("severity"), description(F.col("cycle")).alias("description"))


def cycle_summary(cycles: DataFrame) -> DataFrame:
    """(dimension, value, n): cycles of each severity, of which none is missing, and of each length."""
    known = cycles.sparkSession.createDataFrame([(name,) for name, _ in SEVERITIES], "value string")
    counts = cycles.groupBy(F.col("severity").alias("value")).agg(F.count("*").alias("n"))
    kinds = known.join(counts, "value", "left").select(F.lit("severity").alias("dimension"), "value", F.coalesce("n", F.lit(0)).alias("n"))
    return kinds.unionByName(cycles.groupBy(F.col("length").cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit("length").alias("dimension"), "value", "n"))


def top_cycles(cycles: DataFrame, k: int = TOP) -> DataFrame:
    """(severity, length, shown) of the k worst: by severity, then length, then their nodes; three nodes are shown."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    rows = cycles.orderBy(rank.desc(), F.desc("length"), "cycle").limit(k)
    shown = F.concat(F.array_join(F.slice("cycle", 1, 3).cast("array<string>"), " → "), F.when(F.col("length") > 3, "...").otherwise(""))
    return rows.select("severity", "length", shown.alias("shown"))


def dashboard(edges: DataFrame, k: int = TOP) -> DataFrame:
    """(panel, label, value): what a dashboard of a dependency graph shows: size, hotspots by file name, component sizes, density."""
    from lodeworks.operators.graph import degrees, graph_metrics, most_connected

    panel = lambda rows, name, label, value: rows.select(F.lit(name).alias("panel"), label.alias("label"), value.cast("double").alias("value"))
    measures = graph_metrics(edges)
    sizes = strong_components(edges).groupBy("component").agg(F.count("*").alias("n"))
    parts = [
        panel(measures, "overview", F.lit("Total Files"), F.col("n_nodes")),
        panel(most_connected(edges, k), "hotspots", F.regexp_extract(F.col("node").cast("string"), r"([^/]*)$", 1), F.col("n_total")),
        panel(sizes, "components", F.col("component").cast("string"), F.col("n")),
        panel(measures, "metrics", F.lit("Density"), F.col("density")),
        panel(degrees(edges).groupBy("n_total").count(), "degrees", F.col("n_total").cast("string"), F.col("count")),
    ]
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return made
