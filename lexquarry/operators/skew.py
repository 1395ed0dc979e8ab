"""Heavy keys and two-stage salted aggregation.

Heavy keys are those that hold more than a given share of the rows. At most ``1 / min_share`` keys
can, so their list has a proven bound and may be broadcast whatever the input's size. Salts are taken
from a hash of another column, not from ``rand()``: a task that is run again after an executor was
lost then sends every row to the same place, and rows that must meet (the repeats of one document)
get the same salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of all rows from which a key counts as heavy where the caller names none.
HEAVY_SHARE = 1 / 500


def heavy_keys(df: DataFrame, key: str, min_share: float = HEAVY_SHARE, rows_per_salt: int | None = None) -> DataFrame:
    """(key, n_salts): keys with more than ``min_share`` of the rows with a key, fewer than ``1 / min_share`` of them.

    ``n_salts`` is the key's rows divided by the threshold (or by ``rows_per_salt``), rounded up, so that
    a salted part is about as large as the largest key that is not heavy. Null keys are left out.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return heavy_of(counts, key, "n_rows", min_share, rows_per_salt)


def heavy_of(counts: DataFrame, key: str, n: str, min_share: float = HEAVY_SHARE, rows_per_salt: int | None = None) -> DataFrame:
    """``heavy_keys`` from the rows ``n`` of each key. The total is the sum of the same counts, so the rows are read once."""
    total = counts.agg(F.sum(n)).scalar()
    unit = F.lit(rows_per_salt) if rows_per_salt else F.greatest(F.lit(1), total * F.lit(float(min_share)))
    return counts.where(F.col(n) > total * F.lit(float(min_share))).select(key, F.ceil(F.col(n) / unit).cast("int").alias("n_salts"))


def with_salt(df: DataFrame, key: str, spread: Column, heavy: DataFrame, salt: str = "salt") -> DataFrame:
    """``df`` with a salt in [0, n_salts) for rows of heavy keys and 0 for the rest. ``spread``: what the salt hashes."""
    h = heavy.select(F.col(key).alias("__heavy_key"), F.col("n_salts").alias("__n_salts"))
    joined = df.join(F.broadcast(h), F.col(key) == F.col("__heavy_key"), "left")
    value = F.when(F.col("__n_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("__n_salts").cast("bigint")))
    return joined.withColumn(salt, value.cast("int")).drop("__heavy_key", "__n_salts")


def salted_group_stats(
    df: DataFrame, key: str = "term_id", member: str = "doc_id", value: str = "hit_count", min_share: float = HEAVY_SHARE
) -> DataFrame:
    """Per key: ``n_rows`` (all rows), ``n_members`` (distinct members) and ``total`` (sum of the value).

    Stage one works per (key, salt): members are spread over a heavy key's salts by hash, so a member
    lies in one salt only and the distinct counts of the salts add up. Repeats of a member are combined in each task before
    they move. Stage two adds the parts by the original key, at most ``n_salts`` rows for each. No task ever holds a whole heavy key,
    nor the repeats of one member.

    Rows with a null key are left out; null members count as rows, not as members; null values add
    nothing, and a key without any value has the total 0. Repeated rows count again in ``n_rows`` and
    ``total``. An empty table gives no rows. Other columns are ignored.
    """
    rows = df.select(F.col(key).alias("__k"), F.col(member).alias("__m"), F.col(value).cast("bigint").alias("__v")).where(
        F.col("__k").isNotNull()
    )
    salted = with_salt(rows, "__k", F.col("__m"), heavy_keys(rows, "__k", min_share), "__salt")
    members = salted.groupBy("__k", "__salt", "__m").agg(F.count(F.lit(1)).alias("r"), F.sum("__v").alias("v"))
    parts = members.groupBy("__k", "__salt").agg(F.sum("r").alias("r"), F.count("__m").alias("m"), F.sum("v").alias("v"))
    return parts.groupBy("__k").agg(
        F.sum("r").alias("n_rows"), F.sum("m").alias("n_members"), F.coalesce(F.sum("v"), F.lit(0)).cast("bigint").alias("total")
    ).withColumnRenamed("__k", key)


def dominant_keys(stats: DataFrame, key: str, share: float) -> DataFrame:
    """Rows of ``salted_group_stats`` whose key holds more than ``share`` of all rows."""
    return stats.where(F.col("n_rows") > stats.agg(F.sum("n_rows")).scalar() * F.lit(float(share)))


def salted_lookup(df: DataFrame, key: str, spread: Column, dim: DataFrame, dim_key: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """``df`` joined with ``dim`` on ``key = dim_key``, a heavy key's rows spread over its salts.

    Only the rows of ``dim`` with a heavy key are repeated, once for each salt. ``df`` leaves partitioned
    by (key, salt) and keeps its ``salt`` column; ``dim`` may have any size. ``dim_key`` leaves the result.
    """
    salted = with_salt(df, key, spread, heavy)
    h = heavy.select(F.col(key).alias("__hk"), F.col("n_salts").alias("__n"))
    each = F.sequence(F.lit(0), F.coalesce(F.col("__n"), F.lit(1)) - 1)
    wide = (
        dim.join(F.broadcast(h), F.col(dim_key) == F.col("__hk"), "left")
        .withColumn("__dim_salt", F.explode(each))
        .withColumnRenamed(dim_key, "__dim_key")
        .drop("__hk", "__n")
    )
    on = (F.col(key) == F.col("__dim_key")) & (F.col("salt") == F.col("__dim_salt"))
    return salted.join(wide, on, how).drop("__dim_key", "__dim_salt")


def lookup(
    df: DataFrame, key: str, spread: Column, dim: DataFrame, dim_key: str, most: int, min_share: float = HEAVY_SHARE, how: str = "inner"
) -> DataFrame:
    """``df`` joined with ``dim`` on ``key = dim_key``: where ``dim`` is counted to have at most ``most`` rows it is broadcast, else the join is ``salted_lookup``.

    For ``dim`` of narrow rows. ``dim_key`` leaves the result.
    """
    if dim.limit(most + 1).count() <= most:
        return df.join(F.broadcast(dim), F.col(key) == F.col(dim_key), how).drop(dim_key)
    return salted_lookup(df, key, spread, dim, dim_key, heavy_keys(df, key, min_share), how).drop("salt")
