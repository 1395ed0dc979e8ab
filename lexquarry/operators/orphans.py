"""References to records that do not exist, found with bitmaps per key range and period.

Keys are integers (other types get dense codes from ``dictionary_encode``). A bitmap is kept as its
non-zero 64-bit words: the row ``(key >> 6, period, word)`` stands for 64 neighbouring keys, and
ranges or periods without a reference have no row at all. ``bit_or`` builds the words with map-side
combine, ``refs & ~parents`` is the AND-NOT, and the surviving bits are decoded to keys.

For a period, a parent's bit is set only where the record existed, undeleted, for the whole period, so
the AND-NOT removes references that cannot be broken. What survives - missing parents, and parents
that came or went within the period or later - is judged exactly from the earliest and the latest
reference of the key in that period, which is all that "too early" and "too late" depend on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.plans.session import cut

_NO_END = 999_999


def _month_no(c):
    return F.year(c) * 12 + F.month(c) - 1


def dictionary_encode(keys: DataFrame, column: str) -> DataFrame:
    """(column, code): a dense integer for every distinct non-null value, for keys that are no integers.

    Codes are a value's place within its range partition plus a per-partition base, so they are built
    without sorting everything in one task; the caller must ``cut`` the result before using it twice.
    """
    distinct = keys.select(column).where(F.col(column).isNotNull()).distinct()
    return distinct.repartitionByRange(F.col(column)).sortWithinPartitions(column).withColumn("code", F.monotonically_increasing_id())


def _is_integer(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def _words(df: DataFrame, key: str, *by: str) -> DataFrame:
    bit = F.expr(f"shiftleft(1L, cast({key} & 63 as int))")
    return df.groupBy(F.shiftright(F.col(key), 6).alias("w"), *by).agg(F.bit_or(bit).alias("bits"))


def _decode(df: DataFrame) -> DataFrame:
    """Keys of the set bits of ``bits``, beside the other columns."""
    set_bits = F.expr("filter(sequence(0, 63), i -> (shiftrightunsigned(bits, i) & 1) = 1)")
    return (
        df.withColumn("__i", F.explode(set_bits))
        .withColumn("k", F.shiftleft(F.col("w"), 6) + F.col("__i"))
        .drop("w", "bits", "__i")
    )


def broken_references(
    refs: DataFrame,
    ref_key: str,
    ref_time: str,
    parents: DataFrame,
    parent_key: str,
    parent_time: str,
    deleted_time: str | None = None,
    field_name: str = "",
) -> DataFrame:
    """One row per distinct broken reference: ``ref_field, ref_id, written_month, reason``.

    ``missing``: no parent has the key. ``late``: the parent's earliest time is after a reference of that
    month. ``deleted``: its deletion (the earliest, if its rows differ) is at or before a reference of
    that month. Both reasons may hold for one key and month. Null keys are no references; a reference
    without a time belongs to the null month and can only be missing; a parent without a time is never late. Repeated
    rows change nothing; empty tables give no rows, or only missing parents. Extra columns are ignored.
    """
    r = refs.select(F.col(ref_key).alias("k"), F.col(ref_time).alias("t")).where(F.col("k").isNotNull())
    gone = F.col(deleted_time) if deleted_time else F.lit(None).cast("timestamp_ntz")
    p = parents.select(F.col(parent_key).alias("k"), F.col(parent_time).alias("a"), gone.alias("d")).where(F.col("k").isNotNull())
    codes = None
    if not (_is_integer(r, "k") and _is_integer(p, "k")):
        codes = cut(dictionary_encode(r.select("k").union(p.select("k")), "k"))
        named = lambda df: df.join(codes, "k").drop("k").withColumnRenamed("code", "k")
        r, p = named(r), named(p)
    r = r.withColumn("k", F.col("k").cast("bigint"))
    p = p.withColumn("k", F.col("k").cast("bigint"))

    # Partial aggregation first: one row per key and month leaves each map task, however hot the key. The
    # result is used for the bitmaps and for judging what they leave, so it is kept: the references are read once.
    used = cut(r.groupBy("k", _month_no(F.col("t")).alias("m")).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t")))
    known = p.groupBy("k").agg(F.min("a").alias("a"), F.min("d").alias("d"))

    month = F.coalesce(F.col("m"), F.lit(-1))
    ref_words = _words(used.select("k", month.alias("m")), "k", "m")
    # A parent is safe in whole months: after the month it came in, before the month it was deleted in.
    since = F.coalesce(_month_no(F.col("a")) + 1, F.lit(0))
    until = F.coalesce(_month_no(F.col("d")) - 1, F.lit(_NO_END))
    parent_words = _words(known.select("k", since.alias("m_from"), until.alias("m_to")), "k", "m_from", "m_to")
    per_word = parent_words.groupBy("w").agg(F.collect_list(F.struct("m_from", "m_to", "bits")).alias("spans"))
    safe = F.expr("aggregate(spans, 0L, (acc, s) -> acc | if(m < 0 or (s.m_from <= m and m <= s.m_to), s.bits, 0L))")
    surviving = (
        ref_words.join(per_word, "w", "left")
        .select("w", "m", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(safe, F.lit(0).cast("bigint")))).alias("bits"))
        .where(F.col("bits") != 0)
    )
    suspects = _decode(surviving)

    judged = (
        suspects.join(used.withColumn("m", month), ["k", "m"])
        .join(known.withColumn("there", F.lit(True)), "k", "left")
        .select(
            "k",
            "m",
            F.explode(
                F.filter(
                    F.array(
                        F.when(F.col("there").isNull(), F.lit("missing")),
                        F.when(F.col("d") <= F.col("last_t"), F.lit("deleted")),
                        F.when(F.col("a") > F.col("first_t"), F.lit("late")),
                    ),
                    lambda x: x.isNotNull(),
                )
            ).alias("reason"),
        )
    )
    if codes is not None:
        judged = judged.withColumnRenamed("k", "code").join(codes, "code").drop("code")
    year, mon = F.floor(F.col("m") / 12), F.col("m") % 12 + 1
    return judged.select(
        F.lit(field_name).alias("ref_field"),
        F.col("k").alias("ref_id"),
        F.when(F.col("m") >= 0, F.format_string("%04d-%02d", year, mon)).alias("written_month"),
        "reason",
    )
