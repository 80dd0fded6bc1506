"""A filter of fixed size that keeps most of what a join would drop out of its shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map. Its words are at most 262,144 rows of two longs, 4 MB, whatever the input: that is what is broadcast.
BITS = 1 << 24


def possible_members(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df whose keys may be among members: none that is gets lost, of others one in 16 million for each member.

    The keys' hashes are a bitmap, made and joined in the JVM where the rows are scanned. The join that must follow has to move
    what is left. Rows with a null key are dropped, as that join would drop them.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    some = members.dropna(subset=keys).select(place.alias("p"))
    words = some.groupBy(F.shiftright("p", 6).alias("_at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("_word"))
    placed = df.dropna(subset=keys).withColumn("_place", place)
    found = placed.join(F.broadcast(words), F.shiftright("_place", 6) == F.col("_at"))
    return found.where("shiftrightunsigned(_word, cast(_place & 63 as int)) % 2 <> 0").select(df.columns)
