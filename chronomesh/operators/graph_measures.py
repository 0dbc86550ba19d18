"""Graph measures that are joins and aggregates of edge tables (Graph in graph_prep)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.functions.stats import ratio
from chronomesh.operators.edges import mirrored
from chronomesh.operators.graph_prep import Graph
from chronomesh.sources.shared import shared_folder


def _present(g: Graph) -> DataFrame:
    return mirrored(g.edges.filter("w <> 0").select(*g.keys, "i", "j", "w"))


def _fill(g: Graph, found: DataFrame, *columns: str) -> DataFrame:
    """found over every node, with zeros where a node is missing."""
    return g.cells().join(found, [*g.keys, "i"], "left").select(*g.keys, "i", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def degrees(g: Graph) -> DataFrame:
    """(keys.., i, degree): nonzero edges at each node."""
    n = _present(g).groupBy(*g.keys, "i").agg(F.count("*").alias("degree"))
    return g.cells().join(n, [*g.keys, "i"], "left").select(*g.keys, "i", F.coalesce("degree", F.lit(0)).alias("degree"))


def density(g: Graph) -> DataFrame:
    """(keys.., density, n, k): edges over pairs, nodes, edges."""
    n = g.nodes.agg(F.count("*").alias("n"))
    k = g.edges.groupBy(*g.keys).agg(F.sum((F.col("w") != 0).cast("long")).alias("k")) if g.keys else g.edges.agg(F.sum((F.col("w") != 0).cast("long")).alias("k"))
    return k.crossJoin(F.broadcast(n)).select(*g.keys, ratio(F.col("k") * 2.0, F.col("n") * (F.col("n") - 1.0)).alias("density"), "n", "k")


def triangles(g: Graph, power: float | None = None) -> DataFrame:
    """(keys.., i, cycles): twice the (weighted) triangles at each node.

    Each triangle is found once from its edges in order of nodes, so the join works on i < j alone; with power, a
    triangle counts the product of its weights to that power.
    """
    e = g.edges.filter("w <> 0").select(*g.keys, "i", "j", (F.pow(F.abs("w"), F.lit(power)) * F.signum("w") if power else F.lit(1.0)).alias("w"))
    ab = e.select(*g.keys, F.col("i").alias("a"), F.col("j").alias("b"), F.col("w").alias("w1"))
    bc = e.select(*g.keys, F.col("i").alias("b"), F.col("j").alias("c"), F.col("w").alias("w2"))
    ac = e.select(*g.keys, F.col("i").alias("a"), F.col("j").alias("c"), F.col("w").alias("w3"))
    found = ab.join(bc, [*g.keys, "b"]).join(ac, [*g.keys, "a", "c"]).select(*g.keys, (F.col("w1") * F.col("w2") * F.col("w3")).alias("v"), F.explode(F.array("a", "b", "c")).alias("i"))
    return found.groupBy(*g.keys, "i").agg((2 * F.sum("v")).alias("cycles"))


def _node_table(g: Graph, power: float | None) -> DataFrame:
    k = _present(g).groupBy(*g.keys, "i").agg(F.count("*").cast("double").alias("k"))
    both = k.join(triangles(g, power), [*g.keys, "i"], "left")
    return _fill(g, both, "k", "cycles")


def clustering(g: Graph, weighted: bool = False) -> DataFrame:
    """(keys.., i, clustering): closed share of each node's pairs of neighbours; weighted: by cube roots of weights."""
    c = ratio(F.col("cycles"), F.col("k") * (F.col("k") - 1))
    return _node_table(g, 1 / 3 if weighted else None).select(*g.keys, "i", F.coalesce(c, F.lit(0.0)).alias("clustering"))


def onnela(g: Graph) -> DataFrame:
    """(keys.., clustering): mean weighted clustering over all nodes, weights divided by the largest."""
    scaled = Graph(g.with_w(F.col("w") / F.max("w").over(g.over())), g.nodes, g.keys)
    return clustering(scaled, True).groupBy(*g.keys).agg(F.avg("clustering").alias("clustering"))


def transitivity(g: Graph, weighted: bool = False) -> DataFrame:
    """(keys.., transitivity): closed triples over all triples; 0 if there is none."""
    t = _node_table(g, 1 / 3 if weighted else None).groupBy(*g.keys)
    return t.agg(F.coalesce(ratio(F.sum("cycles"), F.sum(F.col("k") * (F.col("k") - 1))), F.lit(0.0)).alias("transitivity"))


def matching_index(g: Graph) -> DataFrame:
    """(keys.., i, j, matching): for pairs of nodes with a common neighbour, twice their number over the pair's degrees.

    An edge within the pair doesn't count to the degrees. Pairs without a common neighbour have 0 and no row.
    """
    e = _present(g).filter("w > 0")
    k = e.groupBy(*g.keys, "i").agg(F.count("*").alias("k"))
    common = e.select(*g.keys, "j", F.col("i").alias("a")).join(e.select(*g.keys, "j", F.col("i").alias("b")), [*g.keys, "j"]).filter("a < b").groupBy(*g.keys, "a", "b").agg(F.count("*").alias("n"))
    linked = g.edges.filter("w > 0").select(*g.keys, F.col("i").alias("a"), F.col("j").alias("b"), F.lit(1).alias("edge"))
    ka, kb = k.select(*g.keys, F.col("i").alias("a"), F.col("k").alias("ka")), k.select(*g.keys, F.col("i").alias("b"), F.col("k").alias("kb"))
    at = common.join(ka, [*g.keys, "a"]).join(kb, [*g.keys, "b"]).join(linked, [*g.keys, "a", "b"], "left")
    total = F.col("ka") + F.col("kb") - 2 * F.coalesce("edge", F.lit(0))
    alone = (total <= 2) & (F.col("n") != 1)
    value = F.coalesce(ratio(2.0 * F.col("n"), F.when(alone, F.lit(1.0)).otherwise(total.cast("double"))), F.lit(0.0))
    return at.select(*g.keys, F.col("a").alias("i"), F.col("b").alias("j"), value.alias("matching"))


def participation(g: Graph, labels: DataFrame) -> DataFrame:
    """(keys.., i, participation): 1 less the squared shares of a node's strength by module; labels: (i, module)."""
    ends = labels.select(F.col("i").alias("j"), "module")
    by = _present(g).join(ends, "j").groupBy(*g.keys, "i", "module").agg(F.sum("w").alias("s"))
    total = F.sum("s").over(Window.partitionBy(*g.keys, "i"))
    p = by.withColumn("q", ratio(F.col("s"), total)).groupBy(*g.keys, "i").agg((1 - F.sum(F.col("q") * F.col("q"))).alias("participation"))
    return _fill(g, p, "participation")


def participation_directed(directed: DataFrame, nodes: DataFrame, labels: DataFrame, keys: list[str], direction: str = "out") -> DataFrame:
    """participation() over directed edges (keys.., i, j, w): of the edges that leave (out) or reach (in) a node."""
    if direction not in ("in", "out"):
        raise ValueError("direction must be in or out")
    own, other = ("i", "j") if direction == "out" else ("j", "i")
    ends = labels.select(F.col("i").alias("_end"), "module")
    rows = directed.filter("w <> 0").select(*keys, F.col(own).alias("i"), F.col(other).alias("_end"), "w").join(ends, "_end")
    by = rows.groupBy(*keys, "i", "module").agg(F.sum("w").alias("s"))
    q = ratio(F.col("s"), F.sum("s").over(Window.partitionBy(*keys, "i")))
    found = by.withColumn("q", q).groupBy(*keys, "i").agg((1 - F.sum(F.col("q") * F.col("q"))).alias("participation"))
    return _fill(Graph(directed, nodes, keys), found, "participation")


def border_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, j) of mesh edges, each once with i < j, whose ends have different labels; labels: (i, label)."""
    each = edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).filter("i <> j").distinct()
    a, b = labels.select("i", F.col("label").alias("la")), labels.select(F.col("i").alias("j"), F.col("label").alias("lb"))
    return each.join(a, "i").join(b, "j").filter("la <> lb").select("i", "j")


def polylines(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., line, place, i): undirected edges (keys.., i, j) as lines that each pass an edge once.

    Lines end where other than two edges meet; what has no such end is a ring, which starts and ends at its smallest node.
    Lines are numbered by their first edge. A key's edges are one kernel's; repeated edges and loops count once or not.
    """
    kind = edges.schema["i"].dataType.simpleString()
    types = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        beside: dict = {}
        for i, j in sorted({(min(a, b), max(a, b)) for a, b in zip(rows["i"], rows["j"]) if a != b}):
            beside.setdefault(i, []).append(j)
            beside.setdefault(j, []).append(i)
        open_ = {(a, b) for a, near in beside.items() for b in near}
        ends = [n for n in sorted(beside) if len(beside[n]) != 2]
        lines = []
        for start in [*ends, *sorted(beside)]:  # rings have no end and come last
            for nxt in sorted(beside[start]):
                if (start, nxt) not in open_:
                    continue
                line = [start]
                while (line[-1], nxt) in open_:
                    open_ -= {(line[-1], nxt), (nxt, line[-1])}
                    line.append(nxt)
                    if len(beside[nxt]) != 2:
                        break
                    nxt = next(n for n in beside[nxt] if n != line[-2])
                lines.append(line)
        out = pd.DataFrame([(k, p, n) for k, line in enumerate(lines) for p, n in enumerate(line)], columns=["line", "place", "i"])
        for place, k in enumerate(keys):
            out.insert(place, k, rows[k].iloc[0])
        return out

    by = edges.groupBy(*keys) if keys else edges.withColumn("_all", F.lit(0)).groupBy("_all")
    return by.applyInPandas(walk, f"{types}{', ' * bool(types)}line int, place int, i {kind}")


def participation_signed(g: Graph, labels: DataFrame) -> DataFrame:
    """(keys.., i, positive, negative): participation over the positive and over the negative weights."""
    parts = []
    for name, kept in (("positive", F.greatest(F.col("w"), F.lit(0.0))), ("negative", F.greatest(-F.col("w"), F.lit(0.0)))):
        part = participation(Graph(g.with_w(kept), g.nodes, g.keys), labels)
        parts.append(part.withColumnRenamed("participation", name))
    return parts[0].join(parts[1], [*g.keys, "i"])


def two_core(g: Graph) -> DataFrame:
    """Edges left after nodes with one edge are taken away again and again, until none is left to take.

    Each round is a job whose result goes to the checkpoint folder; a dangling chain takes as many as it has nodes.
    """
    edges = g.edges.filter("w <> 0").select(*g.keys, "i", "j", "w")
    shared_folder(edges.sparkSession)
    before = edges.count()
    while True:
        k = mirrored(edges).groupBy(*g.keys, "i").agg(F.count("*").alias("k")).filter("k > 1").select(*g.keys, "i")
        edges = edges.join(k, [*g.keys, "i"], "left_semi").join(k.withColumnRenamed("i", "j"), [*g.keys, "j"], "left_semi").select(*g.keys, "i", "j", "w").checkpoint()
        after = edges.count()
        if after == before:
            return edges
        before = after
