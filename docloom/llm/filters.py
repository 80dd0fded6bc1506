"""A filter that keeps most of what a join would drop out of its shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map. Its words are at most 262,144 rows of two longs, 4 MB, whatever the input: that is what is broadcast.
BITS = 1 << 24


def possible_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key may be among members: none that is gets lost, most others do.

    Keys are hashed into a bitmap of fixed size, which is made and joined in the JVM, so that rows that go never leave it.
    With as many members as bits it lets most rows pass, and the join that must follow does all the work; the result is the
    same. Rows with a null key are dropped.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BITS))
    words = members.where(F.col(key).isNotNull()).select(place.alias("p"))
    words = words.groupBy(F.shiftright("p", 6).alias("_at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_word"))
    placed = df.where(F.col(key).isNotNull()).withColumn("_place", place)
    found = placed.join(F.broadcast(words), F.shiftright("_place", 6) == F.col("_at"))
    return found.where("shiftrightunsigned(_word, cast(_place % 64 as int)) % 2 <> 0").select(df.columns)


def exact_members(rows: DataFrame, key: str) -> DataFrame:
    """(_at, _word): the bits of all keys, 64 neighbours to a row; for keys that are dense numbers."""
    return rows.groupBy(F.shiftright(key, 6).alias("_at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int))")).alias("_word"))


def members(df: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is among the bits; the join is on 64th parts of the keys, so its small side is small."""
    found = df.join(words, F.shiftright(key, 6) == F.col("_at"))
    return found.where(f"shiftrightunsigned(_word, cast(`{key}` & 63 as int)) % 2 <> 0").select(df.columns)
