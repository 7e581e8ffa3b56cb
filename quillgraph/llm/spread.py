"""Joins whose frequent keys are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.runtime import unclash

#: A key is frequent when at least one in PART of the counted rows have it: so there are at most PART such keys.
PART = 512


def frequent(counted: DataFrame, key: str | list[str]) -> list[tuple]:
    """(key values..., tasks) of the frequent keys of a stored table: at most PART rows, whatever its size.

    ``tasks`` is the number of shares of one PARTth of all rows that the key's rows make up.
    """
    keys = [key] if isinstance(key, str) else key
    total = counted.count()
    if total <= PART:
        return []
    many = counted.groupBy(*keys).count().filter((F.col("count") > 1) & (F.col("count") * PART >= total) & F.col(keys[0]).isNotNull())
    return [(*(r[k] for k in keys), -(-r["count"] * PART // total)) for r in many.collect()]


def spread_join(big: DataFrame, small: DataFrame, key: str | list[str], counted: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small`` on ``key`` (null keys match nothing), by a shuffle of both.

    ``counted`` is a stored table whose keys stand for those of ``big``.  Rows of ``big`` with a frequent
    key are dealt by the column ``by`` over as many shares as they need, and the rows of ``small`` with
    that key are repeated for each share; ``how`` is inner or left.  The list of frequent keys has a
    proven bound, so it is broadcast.  Both sides are shuffled at every size: what is broadcast at a
    small size would be shuffled at a large one.
    """
    keys = [key] if isinstance(key, str) else key
    hot = frequent(counted, keys)
    if not hot:
        return big.join(small.hint("merge"), keys, how)
    shares, salt = unclash([*big.columns, *small.columns], "shares_", "salt_")
    kinds = [f"`{k}` {big.schema[k].dataType.simpleString()}" for k in keys]
    listed = F.broadcast(big.sparkSession.createDataFrame(hot, ", ".join([*kinds, f"`{shares}` int"])))
    dealt = big.join(listed, keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(by), F.col(shares)), F.lit(0)).cast("int")).drop(shares)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(shares), F.lit(1)) - 1))
    repeated = small.join(listed, keys, "left").withColumn(salt, copies).drop(shares)
    return dealt.join(repeated.hint("merge"), [*keys, salt], how).drop(salt)
