"""Joins that a few heavy keys can't bring to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy with more than one of so many rows, and more than LEAST of them; so there are fewer than SHARE heavy keys.
SHARE, LEAST = 1024, 64
_SALT = "__salt"


class Heavy(dict):
    """Heavy keys, fewer than SHARE, and the power of two of parts that each one's rows are dealt into."""

    def holds(self, key: str) -> Column:
        return F.coalesce(F.col(key).isin(list(self)), F.lit(False)) if self else F.lit(False)

    def parts(self, key: str) -> Column:
        """How many parts a row's key has: a few sets of numbers, looked up by hash, and no join."""
        out = F.lit(1).cast("long")
        for n in sorted(set(self.values())):
            out = F.when(F.col(key).isin([k for k, m in self.items() if m == n]), F.lit(n).cast("long")).otherwise(out)
        return out


def heavy_of(counted: DataFrame, total: int) -> Heavy:
    """The heavy keys of (key, n): those with more than one of SHARE of all rows, which can't be more than SHARE."""
    most = max(LEAST, total // SHARE)
    return Heavy((k, 1 << (n // most).bit_length()) for k, n in counted.where(F.col("n") > most).collect())


def heavy_keys(rows: DataFrame, key: str) -> Heavy:
    """Heavy keys of rows, which are read twice and counted where they lie; rows should be a written table."""
    return heavy_of(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")), rows.count())


def spread_join(left: DataFrame, right: DataFrame, key: str, by: Column, also: tuple[str, ...] = (), heavy: Heavy | None = None) -> DataFrame:
    """left joined with right on key (and the columns `also`): inner, and null keys match nothing.

    Rows of left that share a heavy key are dealt by a hash of `by` into parts; right's rows of such a key are repeated for
    each of them. Without heavy keys it is the ordinary join. left should be a written table, or heavy be given.
    """
    heavy = heavy_keys(left, key) if heavy is None else heavy
    if not heavy:
        return left.join(right, [key, *also])
    dealt = left.withColumn(_SALT, F.pmod(F.xxhash64(by), heavy.parts(key)))
    repeated = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0).cast("long"), heavy.parts(key) - 1)))
    return dealt.join(repeated, [key, *also, _SALT]).drop(_SALT)
