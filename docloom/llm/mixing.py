"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source that should make up the share w of an output of N rows, and has n rows, is to be repeated N * w / n times on
average. Each document draws its own number of copies: a number in [0, 1) from a hash of seed and document is put through
the inverse of the Poisson distribution with that mean. No draw needs to know of another, so documents are decided where
they are, a hot source like any other; only the counts of the sources are aggregated, and combined before their shuffle.
Copies get a position from a hash as well, and the output is range-partitioned and sorted by it: a global shuffle that is
the same whenever it is run.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize

#: A draw of larger mean is the sum of several, so that exp(-mean) does not vanish.
PART = 64.0
#: 52 bits of a hash.
BITS = 52


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, nulls included."""
    said = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(said), 1, BITS // 4), 16, 10).cast("double") / float(1 << BITS)


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to where they no longer grow, as an array; for means up to PART."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def add(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(s["sums"], F.element_at(s["sums"], -1) + p).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda s: s["sums"])


def rates(df: DataFrame, source: str, weights: DataFrame | None, temperature: float, size: float) -> DataFrame:
    """(source, n, rate) of each source. `weights` has (source, weight); without it, weights are n to the power `temperature`."""
    s = F.col("`" + source.replace("`", "``") + "`").alias("source")
    n = df.select(s).groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.pow("n", F.lit(temperature)))
    else:
        given = weights.select("source", F.col("weight").cast("double")).groupBy("source").agg(F.sum("weight").alias("weight"))
        n = n.join(given.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        n = n.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    totals = n.agg(F.sum("n").alias("total"), F.sum("weight").alias("weights")).first()
    total, sums = float(totals.total or 0), float(totals.weights or 0)
    rate = F.col("weight") * size * total / (F.lit(sums) * F.col("n")) if sums > 0 else F.lit(0.0)
    return n.select("source", "n", rate.alias("rate"))


def mix(
    df: DataFrame, doc: str = "doc_id", source: str = "source", weights: DataFrame | None = None, temperature: float = 0.7, size: float = 1.0, seed: int = 17
) -> DataFrame:
    """The rows of df, each as often as it draws, in a random but fixed order; columns `replica` (from 0) and `position` at the end.

    The output has about `size` times the input's rows. A source without a weight is not drawn; null is a source of its own.
    Rows of one id draw alike, as repeated rows should; a row without id draws as the id null does. Columns named `replica`
    or `position` are replaced. An empty table gives an empty one.
    """
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kept = [c for c in df.columns if c not in ("replica", "position")]
    per_part = F.ceil(F.greatest(F.col("rate") / PART, F.lit(1.0)))
    tables = rates(df, source, weights, temperature, size).where("rate > 0")
    tables = tables.select(F.col("source").alias("s"), per_part.cast("int").alias("parts"), poisson_table(F.col("rate") / per_part).alias("sums"))
    # Written, so that the join knows how small it is and leaves the rows where they are.
    tables = materialize(tables, "mixing-rates")
    rows = df.select(F.struct(*map(name, kept)).alias("row"), name(doc).alias("id"), name(source).alias("s0"))
    drawn = rows.join(tables, F.col("s0").eqNullSafe(F.col("s")))

    def draw(part: Column) -> Column:
        u = uniform(F.lit(seed), F.col("id"), part)
        return F.size(F.filter("sums", lambda c: u >= c))

    copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), draw), F.lit(0), lambda a, b: a + b)
    drawn = drawn.select("row", "id", copies.alias("copies")).where("copies > 0")
    drawn = drawn.select("row", "id", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("replica"))
    position = uniform(F.lit(seed), F.lit("position"), F.col("id"), F.col("replica"))
    placed = drawn.select("row", "replica", position.alias("position")).orderBy("position", "replica")
    return placed.select(*[F.col("row")[c].alias(c) for c in kept], "replica", "position")

