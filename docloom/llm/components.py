"""Connected components of a graph that is only known as rows of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize


def _pairs(df: DataFrame) -> DataFrame:
    return df.where(F.col("u") != F.col("v")).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """(node, component) of every linked node, the component being the smallest node that links reach.

    Alternates between linking every node's larger neighbours, and then its smaller ones, with its smallest neighbour
    (large-star and small-star), until nothing changes: a number of rounds that grows with the logarithm of the graph,
    each of three shuffles. A node with many neighbours is a minimum that is combined before the shuffle and a join that
    adaptive execution can split. Every round is written to the shared folder; the driver sees a count and a hash.
    Links with a null end and links of a node with itself count for nothing.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = materialize(_pairs(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), name)
    seen = _mark(edges)
    while seen.n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = _pairs(both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = materialize(large, name)
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(_pairs(small.unionByName(smallest.select("u", F.col("m").alias("v")))), name)
        before, seen = seen, _mark(edges)
        if seen == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
