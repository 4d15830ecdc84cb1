"""Connected components by alternating large and small stars, on DataFrames alone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colpack.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least.withColumnRenamed("a", "c"), F.col("a") == F.col("c")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node that has an edge and is not the least of its component, with the least one.

    edges has the two columns a and b of one ordered type; loops, repeated edges, both directions and
    nulls (ignored) are fine, and no edge gives no row.  Hubs are joined under Spark's skew splitting and
    aggregated map-side.  Each round is written to the shared folder; the number of rounds grows as
    the logarithm of the longest path.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if found == state or not found[0]:
            return now
        state = found
        new = materialize(_small_star(_large_star(now)), "edges")
        discard(now)
        now = new
