"""Connected components of a graph whose edges are a DataFrame, without gathering links or labels anywhere.

Rounds of large-star and small-star (Kiveris et al., 2014). Before each round every partition replaces its own edges by
a spanning star of each local component, which keeps a component of any size at one edge per node and partition. The
minimum over a hub's neighbours is partially aggregated, and the joins that return it are plain equi-joins, so that
adaptive execution can split a hub. Each round ends in a table in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, release

EDGE = "a long, b long"


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index in the component of each of n nodes, given links between indexes."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        m = np.minimum(la, lb)
        np.minimum.at(lab, la, m)
        np.minimum.at(lab, lb, m)
        while True:
            nxt = lab[lab]
            if np.array_equal(nxt, lab):
                break
            lab = nxt
        rest = lab[a] != lab[b]
        a, b = a[rest], b[rest]
    return lab


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    lab = local_labels(len(nodes), inverse[: len(a)], inverse[len(a) :])
    own = lab != np.arange(len(nodes))
    return nodes[own], nodes[lab[own]]


def _contract(batches):
    """Spanning stars of what a task holds; folded whenever a million edges have come in, so memory stays bounded by the nodes met."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        held.append((a, b))
        size += len(a)
        if size > 1_000_000:
            f = _forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if len(f[0]) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(f[0]), pa.array(f[1])], ["a", "b"])
                held, size = [], 0
            else:
                held, size = [f], len(f[0])
    if size:
        f = _forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(f[0]), pa.array(f[1])], ["a", "b"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (its first two columns, longs, in any order and direction).

    ``component`` is the smallest node reachable. Repeated edges and loops are harmless, rows with a null end are not
    links, and no edges give no rows.
    """
    x, y = edges.columns[:2]
    e = edges.select(F.col(x).cast("long").alias("a"), F.col(y).cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    cur = cut(e.mapInArrow(_contract, EDGE), "cc")
    for _ in range(max_rounds):
        ends = cur.select("a", F.lit(1).alias("out")).unionByName(cur.select(F.col("b").alias("a"), F.lit(None).cast("int").alias("out")))
        per_node = ends.groupBy("a").agg(F.count("out").alias("out"), F.count("*").alias("n"))
        if per_node.filter("out > 1 or (out = 1 and n > 1)").limit(1).count() == 0:
            break  # every edge leads from a node with no other edge to a root: all components are stars
        sym = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        nxt = cut(small.filter("a <> b").distinct(), "cc")
        release(cur)
        cur = nxt
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    roots = cur.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
