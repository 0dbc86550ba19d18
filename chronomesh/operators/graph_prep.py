"""Preparation of graphs: edge tables (keys.., i, j, w) with i < j. keys name the columns that tell graphs apart."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["subject", "t"]


class Graph:
    """Edges with the nodes they connect, so that isolated nodes count; operators chain by pipe()."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, keys: list[str] | None = None):
        self.edges, self.nodes, self.keys = edges, nodes, KEYS if keys is None else keys

    def pipe(self, op: Callable[..., DataFrame], *args, **params) -> Graph:
        return Graph(op(self, *args, **params), self.nodes, self.keys)

    def graphs(self) -> DataFrame:
        return self.edges.select(*self.keys).distinct()

    def cells(self) -> DataFrame:
        """(keys.., i): every node of every graph."""
        return self.graphs().crossJoin(self.nodes.select("i"))

    def all_pairs(self) -> DataFrame:
        """(keys.., i, j, w): all pairs of nodes i < j, absent edges with weight 0."""
        a, b = self.nodes.select("i"), self.nodes.select(F.col("i").alias("j"))
        cells = self.graphs().crossJoin(a.crossJoin(b).filter("i < j"))
        return cells.join(self.edges, [*self.keys, "i", "j"], "left").select(*self.keys, "i", "j", F.coalesce("w", F.lit(0.0)).alias("w"))

    def over(self) -> Window:
        return Window.partitionBy(*self.keys)

    def with_w(self, w) -> DataFrame:
        return self.edges.withColumn("w", w)


def from_matrix(matrix: np.ndarray, spark, subject: int = 0) -> Graph:
    """A graph from a square array (P, P) or (P, P, T); raises ValueError if it isn't square."""
    m = matrix[:, :, None] if matrix.ndim == 2 else matrix
    if m.shape[0] != m.shape[1]:
        raise ValueError("a graph's matrix must be square")
    a, b = np.triu_indices(m.shape[0], 1)
    rows = [(subject, t, int(i), int(j), float(m[i, j, t])) for t in range(m.shape[2]) for i, j in zip(a, b) if m[i, j, t] != 0]
    edges = spark.createDataFrame(rows, "subject long, t long, i long, j long, w double")
    return Graph(edges, spark.createDataFrame([(int(i),) for i in range(m.shape[0])], "i long"))


def handle_negative_weights(g: Graph, kind: str = "absolute") -> DataFrame:
    if kind not in ("absolute", "discard"):
        raise ValueError(f"unknown kind {kind}")
    return g.with_w(F.abs("w") if kind == "absolute" else F.greatest(F.col("w"), F.lit(0.0)))


def threshold_absolute(g: Graph, threshold: float) -> DataFrame:
    """Weights below the threshold (signed) become 0 and leave the edge table."""
    return g.edges.filter((F.col("w") >= threshold) & (F.col("w") != 0))


def threshold_density(g: Graph, density: float = 0.2) -> DataFrame:
    """The round-half-up share of all pairs of nodes with the largest signed weights; ties by descending i, then j.

    The number of pairs follows from the node table; only stored edges are ranked, and the zeros of absent pairs are
    placed by counting, so no pair is made.
    """
    if not 0 <= density <= 1:
        raise ValueError("density must lie in 0..1")
    n = g.nodes.agg(F.count("*").alias("n"))
    by = g.over().orderBy(F.desc("w"), F.desc("i"), F.desc("j"))
    ranked = g.edges.filter("w <> 0").withColumn("place", F.row_number().over(by)).crossJoin(F.broadcast(n))
    held = F.count("*").over(g.over())
    # negative edges rank behind the pairs that have no edge
    behind = F.when(F.col("w") < 0, F.col("n") * (F.col("n") - 1) / 2 - held).otherwise(0)
    most = F.floor(F.col("n") * (F.col("n") - 1) / 2 * density + 0.5 + 1e-10)
    return ranked.withColumn("behind", behind).filter(F.col("place") + F.col("behind") <= most).select(*g.keys, "i", "j", "w")


def threshold(g: Graph, kind: str = "density", threshold: float | None = None, density: float = 0.2) -> DataFrame:
    if kind == "absolute":
        return threshold_absolute(g, threshold or 0.0)
    if kind == "density":
        return threshold_density(g, density)
    raise ValueError(f"unknown kind {kind}")


def binarise(g: Graph) -> DataFrame:
    return g.with_w((F.col("w") != 0).cast("double"))


def normalise(g: Graph) -> DataFrame:
    """Divided by each graph's largest absolute weight; a graph of zeros raises an error."""
    top = F.max(F.abs("w")).over(g.over())
    return g.with_w(F.col("w") / F.when(top > 0, top).otherwise(F.raise_error(F.lit("all weights are zero")).cast("double")))


def minmax_scale(g: Graph, low: float = 0.0, high: float = 1.0, diagonal: float | None = None) -> DataFrame:
    """Finite weights of all pairs scaled into low..high; a constant graph becomes low. Absent pairs take part as zeros.

    diagonal: the diagonal's value, if it is to take part in the least and the largest weight.
    """
    if not high > low:
        raise ValueError("high must lie above low")
    full = Graph(g.all_pairs(), g.nodes, g.keys)
    finite = F.when(~F.isnan("w") & (F.abs("w") != float("inf")), F.col("w"))
    a, b = F.min(finite).over(g.over()), F.max(finite).over(g.over())
    if diagonal is not None:
        a, b = F.least(a, F.lit(float(diagonal))), F.greatest(b, F.lit(float(diagonal)))
    scaled = F.when(a == b, F.lit(low)).otherwise(F.lit(low) + (F.col("w") - a) / F.when(a == b, F.lit(1.0)).otherwise(b - a) * (high - low))
    return full.with_w(F.when(finite.isNotNull(), scaled).otherwise(F.col("w")))


def invert(g: Graph) -> DataFrame:
    """1 / w; zeros stay."""
    return g.with_w(F.when(F.col("w") == 0, F.lit(0.0)).otherwise(1 / F.when(F.col("w") == 0, F.lit(1.0)).otherwise(F.col("w"))))


def log_transform(g: Graph, epsilon: float = 1e-10) -> DataFrame:
    """-ln(max(w, epsilon)); weights outside (0, 1] raise an error."""
    inside = (F.col("w") > 0) & (F.col("w") <= 1)
    return g.with_w(F.when(inside, -F.ln(F.greatest(F.col("w"), F.lit(epsilon)))).otherwise(F.raise_error(F.lit("weights must lie in (0, 1]")).cast("double")))


def symmetrise(directed: DataFrame, keys: list[str], binary: bool = False) -> DataFrame:
    """(keys.., i, j, w) with i < j from both directions of directed edges: their mean, or 1 if either is there."""
    w = F.lit(1.0) if binary else F.sum("w") / 2
    folded = directed.filter("i <> j and w <> 0").select(*keys, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "w")
    return folded.groupBy(*keys, F.col("a").alias("i"), F.col("b").alias("j")).agg(w.alias("w"))


def randomise(g: Graph, seed: int = 0) -> DataFrame:
    """Each graph's weights dealt anew to its pairs of nodes: pairs and weights are ranked by seeded hashes and joined."""
    full = g.all_pairs()
    one = g.over().orderBy(F.xxhash64(F.lit(seed), "i", "j"), "i", "j")
    two = g.over().orderBy(F.xxhash64(F.lit(seed + 7_919), F.lit("w"), "i", "j"), "i", "j")
    places = full.select(*g.keys, "i", "j", F.row_number().over(one).alias("place"))
    weights = full.select(*g.keys, "w", F.row_number().over(two).alias("place"))
    return places.join(weights, [*g.keys, "place"]).filter("w <> 0").select(*g.keys, "i", "j", "w")


def from_directed(directed: DataFrame, keys: list[str], tolerance: float = 1e-8) -> DataFrame:
    """(keys.., i, j, w) with i < j of a matrix whose both triangles are given; one that isn't symmetric raises an error.

    Loops are left out, absent and NaN entries count as 0. Weights of both directions may differ by the tolerance, and by
    1e-5 of their size.
    """
    clean = F.when(F.isnan("w") | F.col("w").isNull() | (F.abs("w") == float("inf")), F.lit(0.0)).otherwise(F.col("w"))
    upper = F.col("i") < F.col("j")
    folded = directed.filter("i <> j").select(*keys, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.when(upper, clean).otherwise(0.0).alias("up"), F.when(upper, 0.0).otherwise(clean).alias("down"))
    both = folded.groupBy(*keys, F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    same = F.abs(F.col("up") - F.col("down")) <= tolerance + 1e-5 * F.abs("down")
    return both.select(*keys, "i", "j", F.when(same, F.col("up")).otherwise(F.raise_error(F.lit("the matrix is not symmetric")).cast("double")).alias("w"))


def postprocess(g: Graph, digits: int = 6) -> DataFrame:
    """NaN and infinite weights become 0, others are rounded."""
    bad = F.isnan("w") | (F.abs("w") == float("inf")) | F.col("w").isNull()
    return g.with_w(F.when(bad, F.lit(0.0)).otherwise(F.round("w", digits)))


def per_graph(g: Graph, kernel: Callable[[np.ndarray, list], pd.DataFrame], schema: str) -> DataFrame:
    """Run kernel(matrix, names) on each graph's symmetric matrix over all nodes; its columns follow the keys.

    Graphs are spread over the cluster by their keys; one graph's matrix is the unit of memory.
    """
    names = g.nodes.groupBy().agg(F.array_sort(F.collect_set("i")).alias("names"))  # one row: the node set
    keys = list(g.keys)
    types = ", ".join(f"{k} {g.edges.schema[k].dataType.simpleString()}" for k in g.keys)

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                at = {n: k for k, n in enumerate(r.names)}
                m = np.zeros((len(at), len(at)))
                for i, j, w in zip(r.a, r.b, r.v):
                    m[at[i], at[j]] = m[at[j], at[i]] = w
                out = kernel(m, list(r.names))
                for place, k in enumerate(keys):
                    out.insert(place, k, getattr(r, k))
                yield out

    packed = g.edges.groupBy(*g.keys).agg(F.collect_list(F.struct("i", "j", "w")).alias("e")).select(*g.keys, F.col("e.i").alias("a"), F.col("e.j").alias("b"), F.col("e.w").alias("v"))
    return packed.crossJoin(F.broadcast(names)).mapInPandas(run, f"{types}{', ' * bool(types)}{schema}")
