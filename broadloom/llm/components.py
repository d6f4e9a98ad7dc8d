"""Connected components of a link table, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.session import discard, materialize, small_side


#: A counted table of at most this many links (1 MB) is worked on as one partition, without shuffles.
FEW_LINKS = 50_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the smallest node reached.

    Each turn hangs the larger neighbours of a node below its smallest neighbour, then all
    neighbours below that one, until the table is a set of stars. The number of turns grows with
    the logarithm of the component size. Links are shuffled by node with map-side minima; state
    is a stored table per turn.
    """
    edges = materialize(_down(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    few = edges.count() <= FEW_LINKS
    together = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    print_of = None
    while True:
        edges = together(edges)
        both = together(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = together(materialize(_down(large), "large-star"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, materialize(
            _down(together(small.unionByName(least.select("u", F.col("m").alias("v"))))), "small-star"
        )
        discard(last)
        discard(down)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == print_of:
            break
        print_of = tuple(now)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``roots`` (node, root) with more ``links`` (a, b) between nodes, stored.

    Only the links between roots are worked on. Nodes that ``roots`` does not list stand alone.
    """
    for side in ("a", "b"):
        own = roots.select(F.col("node").alias(side), F.col("root").alias("to"))
        links = links.join(own, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    between = materialize(links.filter("a <> b").distinct(), "between")
    if between.isEmpty():
        return roots
    new = materialize(components(between), "merged")
    side = small_side(new.select(F.col("node").alias("root"), F.col("root").alias("to")), new.count())
    known = roots.join(side, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(known.unionByName(new.join(roots.select("node"), "node", "left_anti")), "components")


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
