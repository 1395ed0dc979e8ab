"""One mix of several sources with target shares of the tokens, by tempered weights and block permutations.

Weights are shares raised to an exponent and normalised. There is one exponent for all sources, found by bisection:

* with a target entropy, the wanted shares are the sources' token shares raised to the largest exponent in [0, 1] that
  reaches the entropy, normalised; without one they are the plan's targets;
* a source whose wanted share is beyond its repetition limit is held at the limit, and what all such sources leave is
  shared among the others in proportion to ``room * (wanted / room) ** exponent``, where ``room`` is the share that a
  source's limit leaves unused. At exponent 1 everyone grows in proportion to the wanted share, at 0 in proportion
  to the room. The exponent is the largest in [0, 1] that keeps every source within its limit; at 0 all are, if the limits leave room at all.

So a source has its target or more wherever its limit allows, nothing is repeated too often, and the mix is as
large as all planned documents together unless all sources are at their limits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.sizes import token_count
from lexquarry.plans.session import cut, local_table

#: A plan is a list of sources that someone wrote; larger ones are refused rather than gathered.
MAX_SOURCES = 100_000
#: Documents of a source that are permuted in one block, about.
BLOCK_ROWS = 50_000

_BUDGETS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("target_share", T.DoubleType()),
        T.StructField("max_repeats", T.LongType()),
        T.StructField("source_tokens", T.LongType()),
        T.StructField("source_docs", T.LongType()),
        T.StructField("exponent", T.DoubleType()),
        T.StructField("budget", T.DoubleType()),
        T.StructField("n_blocks", T.LongType()),
    ]
)


def _bisect(ok, lo: float, hi: float, steps: int = 60) -> float:
    """The largest x in [lo, hi] with ok(x), where ok holds below a point and not above; lo if nowhere."""
    if ok(hi):
        return hi
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    return lo


def tempered_shares(tokens: list[float], exponent: float) -> list[float]:
    """Shares proportional to the token shares raised to ``exponent``; sources without tokens get none."""
    total = sum(tokens)
    w = [(n / total) ** exponent if n > 0 else 0.0 for n in tokens]
    return [x / sum(w) for x in w] if total else w


def entropy_shares(tokens: list[float], entropy: float) -> list[float]:
    """``tempered_shares`` at the largest exponent in [0, 1] whose shares have the entropy (in nats), or at 0 if none has."""

    def enough(a: float) -> bool:
        return -sum(p * math.log(p) for p in tempered_shares(tokens, a) if p > 0) >= entropy

    return tempered_shares(tokens, _bisect(enough, 0.0, 1.0))


def spare_weights(room: list[float], wanted: list[float], exponent: float) -> list[float]:
    """Weights ``room * (wanted / room) ** exponent``, normalised; no room gives no weight."""
    w = [r * (t / r) ** exponent if r > 0 else 0.0 for r, t in zip(room, wanted)]
    return [x / sum(w) for x in w] if sum(w) else w


def source_budgets(wanted: list[float], limits: list[int], size: float, exponent: float | None = None) -> tuple[list[float], float]:
    """(tokens to take of each source, the exponent) for wanted tokens, limits in tokens and the size of the mix.

    ``exponent`` bounds the exponent from above; None leaves it to the repetition limits alone.
    """
    base = [min(w, c) for w, c in zip(wanted, limits)]
    room = [c - b for c, b in zip(limits, base)]
    spare = size - sum(base)
    if spare <= 0:
        return base, 1.0 if exponent is None else exponent
    if spare >= sum(room):
        return [float(c) for c in limits], 0.0

    def within(a: float) -> bool:
        p = spare_weights(room, wanted, a)
        return sum(p) > 0 and all(spare * x <= r for x, r in zip(p, room))

    a = _bisect(within, 0.0, 1.0 if exponent is None else exponent)
    return [min(c, b + spare * x) for b, c, x in zip(base, limits, spare_weights(room, wanted, a))], a


class Mix:
    """``budgets``: one row per planned source. ``rows``: the mix, one row per use of a document."""

    def __init__(self, budgets: DataFrame, rows: DataFrame):
        self.budgets, self.rows = budgets, rows

    def report(self) -> DataFrame:
        """Per planned source: the target, what the finished mix holds, as a share of the planned size and of the mix, and whether the target is reachable.

        It isn't where the mix holds all the uses that the source has and still misses the target.
        """
        used = self.rows.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.max("epoch").alias("last_epoch"))
        of = self.budgets.agg(F.sum("source_tokens")).scalar()
        got = F.coalesce("mix_tokens", F.lit(0))
        spent = got >= F.col("max_repeats").cast("double") * F.col("source_tokens")
        return self.budgets.join(used, "source", "left").select(
            "source",
            "target_share",
            "max_repeats",
            "source_tokens",
            F.round("exponent", 6).alias("exponent"),
            got.cast("bigint").alias("mix_tokens"),
            F.round(F.coalesce(F.col("mix_tokens") / of, F.lit(0.0)), 6).alias("reached_share"),
            F.round(F.coalesce(F.col("mix_tokens") / used.agg(F.sum("mix_tokens")).scalar(), F.lit(0.0)), 6).alias("mix_share"),
            F.coalesce(F.col("last_epoch") + 1, F.lit(0)).cast("bigint").alias("most_uses"),
            (~(spent & (got < F.col("target_share") * of))).alias("reachable"),
        )


def mix_documents(
    documents: DataFrame, plan: DataFrame, size: str | None = None, seed: int = 7, entropy: float | None = None, exponent: float | None = None
) -> Mix:
    """A mix as large as all documents of planned sources together; rows ``source, doc_id, epoch, n_tokens, mix_pos``.

    The budgets come from ``source_budgets``; with ``entropy`` the wanted shares are ``entropy_shares`` and the plan's targets serve
    for the report only. ``exponent`` bounds the exponent from above (1 unless given).
    A source is taken in epochs: whole ones, then a part of one. The part is a budgeted block permutation: a source's
    documents in the order of a hash, cut into blocks by ranges of the hash, as long as more than half of the document fits
    in the budget, so a source misses its budget by less than one document. ``mix_pos`` in [0, 1] is a use's place in its
    source's budget; sorting by it interleaves the sources in their shares.

    Sizes are the tokens of ``text``, or the column ``size``; null texts have none. Rows with a null
    source or doc_id, or a source that isn't planned, take no part; rows repeated with the same source and doc_id count
    once, with the largest size. Repeated plan rows count once (largest target). Null targets and null or negative repeats count as 0. A planned source without documents
    gets nothing and is reported. Targets that sum to more than 1 make a mix larger by as much. Empty tables give an empty mix.
    A plan of more than ``MAX_SOURCES`` sources is an error. Other columns are ignored.
    """
    tokens = F.coalesce(F.col(size), F.lit(0)).cast("bigint") if size else token_count(F.col("text"))
    wanted = (
        plan.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).cast("bigint").alias("max_repeats"))
    )
    planned = sorted(wanted.limit(MAX_SOURCES + 1).collect())
    if len(planned) > MAX_SOURCES:
        raise ValueError(f"a plan may name at most {MAX_SOURCES} sources")
    spark = documents.sparkSession
    items = cut(
        documents.where(F.col("doc_id").isNotNull())
        .select("source", "doc_id", tokens.alias("n_tokens"))
        .join(F.broadcast(wanted.select("source")), "source")  # at most MAX_SOURCES rows
        .groupBy("source", "doc_id")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    have = {r[0]: (r[1], r[2]) for r in items.groupBy("source").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()}
    own = [have.get(r["source"], (0, 0)) for r in planned]
    all_tokens = sum(t for t, _ in own)
    shares = [r["target_share"] for r in planned] if entropy is None else entropy_shares([t for t, _ in own], entropy)
    takes, a = source_budgets([s * all_tokens for s in shares], [r["max_repeats"] * t for r, (t, _) in zip(planned, own)], all_tokens, exponent)
    rows = [
        (r["source"], float(r["target_share"]), r["max_repeats"], t, n, float(a), float(take), n // BLOCK_ROWS + 1)
        for r, (t, n), take in zip(planned, own, takes)
    ]
    budgets = local_table(spark, rows, _BUDGETS)

    per = budgets.where((F.col("budget") > 0) & (F.col("source_tokens") > 0)).select(
        "source",
        "budget",
        "source_tokens",
        "n_blocks",
        F.floor(F.col("budget") / F.col("source_tokens")).cast("int").alias("whole"),
    )
    # Blocks are ranges of the hash's first 32 bits, so the order by block and hash is the order by hash.
    first_bits = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint")
    hashed = items.join(F.broadcast(per), "source").withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))).withColumn(
        "block", F.shiftright(first_bits * F.col("n_blocks"), 32)
    )
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy("source", "block")
        .agg(F.sum("n_tokens").alias("t"))
        .withColumn("block_start", F.coalesce(F.sum("t").over(earlier), F.lit(0)))
        .drop("t")
    )
    inside = Window.partitionBy("source", "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.join(starts, ["source", "block"]).withColumn(
        "start", F.col("block_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    )
    left = F.col("budget") - F.col("whole") * F.col("source_tokens")
    uses = F.col("whole") + F.when((left > 0) & (F.col("start") + F.col("n_tokens") / 2 < left), 1).otherwise(0)
    mix = placed.withColumn("uses", uses).where(F.col("uses") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    return Mix(
        budgets,
        mix.select(
            "source",
            "doc_id",
            "epoch",
            "n_tokens",
            F.round(F.least(F.lit(1.0), (F.col("epoch") * F.col("source_tokens") + F.col("start")) / F.col("budget")), 9).alias("mix_pos"),
        ),
    )
