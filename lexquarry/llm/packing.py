"""Documents packed into containers of fixed capacity, by bulk-synchronous best fit.

Every source has containers with gaps and documents to place. A superstep does this for all of them at once:

1. *Range sort.* Gaps and documents are sorted together by source and falling size, gaps before documents of the same size,
   and cut into blocks by ranges (ties by id, so that a size which most documents have is cut like any other).
2. *Successor sweep.* Read in that order, a gap opens a bracket and a document closes the latest one open, which is the
   smallest gap left that holds it. Matching brackets have the same depth, and the depth is a running sum, held
   at 0 from below: blocks compute theirs side by side, one small table carries the sums from block to block, and the partner of
   a document is the row before it among those of its depth.
3. *Conflicts* are resolved by that rank: larger documents choose first, a document that finds every bracket closed waits for the next superstep.
4. *Gaps are updated*, containers are opened for documents larger than every gap, and it is repeated until all are placed.

A gap takes as many documents in one superstep as it holds of the source's largest unplaced size. So a gap at least halves
or is filled, and the supersteps are few (about ten) whatever the number of documents, of sizes, or of documents in a container.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.sizes import token_count
from lexquarry.plans.session import cut, local_table

#: A plan is a list of sources that someone wrote; larger ones are refused rather than gathered.
MAX_SOURCES = 100_000
#: Containers of a source that are opened by one task.
OPENED_TOGETHER = 10_000
#: Documents that one container takes in one superstep at most; the rest follow in the next.
MOST_UNITS = 1_000_000

_GAP, _DOCUMENT = 0, 1


def _falling() -> list[Column]:
    return [F.col("size").desc(), F.col("kind"), F.col("id")]


def successor_sweep(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events as kept, documents with their ``bin`` or null) of one superstep.

    ``events``: ``source, size, kind, id, units, tokens``; of kind 0 gaps (id: the container, units: documents it
    takes at most), of kind 1 documents.
    """
    ranged = events.repartitionByRange("source", *_falling()).withColumn("block", F.spark_partition_id())
    kept = cut(ranged)  # blocks must not move between the uses below
    step = F.when(F.col("kind") == _GAP, F.col("units")).otherwise(-1)
    row = Window.partitionBy("block", "source").orderBy(*_falling())
    walk = kept.withColumn("s", F.sum(step).over(row.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "low", F.min("s").over(row.rowsBetween(Window.unboundedPreceding, -1))
    )
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        walk.groupBy("block", "source")
        .agg(F.sum(step).alias("t"), F.min("s").alias("lowest"))
        .withColumn("offset", F.coalesce(F.sum("t").over(earlier), F.lit(0)))
        .withColumn("held", F.least(F.lit(0), F.min(F.col("offset") + F.col("lowest")).over(earlier)))
        .select("block", "source", (F.col("offset") - F.coalesce("held", F.lit(0))).alias("at_start"))
    )
    # One row for each block, and one more for each source that begins within a block.
    here = F.col("at_start") + F.col("s") - step
    depth = here - F.least(F.lit(0), F.col("at_start") + F.coalesce("low", F.lit(0)))
    levels = walk.join(F.broadcast(starts), ["block", "source"]).withColumn("depth", depth).withColumn(
        "level",
        F.explode(F.when(F.col("kind") == _GAP, F.sequence(F.col("depth") + 1, F.col("depth") + F.col("units"))).otherwise(F.array("depth"))),
    )
    own = Window.partitionBy("block", "source", "level").orderBy(*_falling())
    paired = levels.withColumn("bin", F.when((F.col("kind") == _DOCUMENT) & (F.col("level") > 0), F.lag("id").over(own))).withColumn(
        "last", F.lead("id").over(own).isNull()
    )
    # What a block leaves open serves the blocks after it: at most one gap and one document of a depth and block.
    is_document, across = F.col("kind") == _DOCUMENT, (F.col("level") > 0) & F.col("bin").isNull()
    over = Window.partitionBy("source", "level").orderBy("block", F.col("kind").desc())
    crossing = paired.where(across & (is_document | F.col("last"))).withColumn("bin", F.lag("id").over(over)).where(is_document)
    columns = ["source", "id", "size", "tokens", "bin"]
    return kept, cut(paired.where(is_document & ~across).select(columns).unionByName(crossing.select(columns)))


def _opened(spark, rows: list[tuple]) -> DataFrame:
    """Empty containers ``source, size, kind, id`` for rows ``source, capacity, first, count``."""
    wide = local_table(spark, rows, "source string, size bigint, first bigint, n bigint")
    lots = wide.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / OPENED_TOGETHER))))
    df = lots.repartition("source", "i").select(
        "source", "size", (F.col("first") + F.col("i") * OPENED_TOGETHER).alias("first"), F.least(F.lit(OPENED_TOGETHER), F.col("n") - F.col("i") * OPENED_TOGETHER).alias("n")
    )
    return df.select("source", "size", F.lit(_GAP).alias("kind"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("id"))


def best_fit(sized: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """``source, id, size, tokens, bin`` for ``source, id, size, tokens`` with sizes from 1 to the source's capacity; the bin of each."""
    spark = sized.sparkSession
    waiting, gaps, placed = sized.withColumn("bin", F.lit(None).cast("bigint")), None, []
    bins = dict.fromkeys(capacities, 0)
    while True:
        sizes = waiting.select("source", "size", F.lit(_DOCUMENT).alias("kind"))
        if gaps is not None:
            sizes = sizes.unionByName(gaps.select("source", "size", "kind"))
        document, gap = F.when(F.col("kind") == _DOCUMENT, F.col("size")), F.when(F.col("kind") == _GAP, F.col("size"))
        found = sizes.groupBy("source").agg(
            F.max(document).alias("largest"), F.min(document).alias("smallest"), F.count(document).alias("waiting"), F.max(gap).alias("widest"), F.count(gap).alias("open")
        )
        state = {r["source"]: r for r in found.where("waiting > 0").collect()}
        if not state:
            break
        # Containers for what is larger than every gap: as many as its sizes fill, or as it has documents above half the capacity.
        short = [(s, r["widest"] or 0, capacities[s]) for s, r in state.items() if r["largest"] > (r["widest"] or 0)]
        opened = []
        if short:
            above = waiting.join(F.broadcast(local_table(spark, short, "source string, widest bigint, capacity bigint")), "source").where("size > widest")
            big = F.count(F.when(F.col("size") * 2 > F.col("capacity"), 1))
            for s, total, n in above.groupBy("source").agg(F.sum("size"), big).collect():
                count = max(math.ceil(total / capacities[s]), n)
                opened.append((s, capacities[s], bins[s], count))
                bins[s] += count
        new = {s: n for s, _, _, n in opened}
        known = local_table(spark, [(s, r["largest"], r["smallest"], max(1, -(-2 * r["waiting"] // max(1, (r["open"] or 0) + new.get(s, 0))))) for s, r in state.items()],
            "source string, largest bigint, smallest bigint, most bigint",
        )
        live = [x for x in (gaps, _opened(spark, opened) if opened else None) if x is not None]
        units = F.greatest(F.lit(1), F.least("most", F.floor(F.col("size") / F.col("largest")), F.lit(MOST_UNITS)))
        events = (
            reduce(DataFrame.unionByName, live)
            .join(F.broadcast(known), "source")
            .where("size >= smallest")
            .select("source", "size", "kind", "id", units.cast("bigint").alias("units"), F.lit(0).cast("bigint").alias("tokens"))
            .unionByName(waiting.select("source", "size", F.lit(_DOCUMENT).alias("kind"), "id", F.lit(1).cast("bigint").alias("units"), "tokens"))
        )
        kept, swept = successor_sweep(events)
        matched, waiting = swept.where(F.col("bin").isNotNull()), swept.where(F.col("bin").isNull())
        placed.append(matched)
        taken = matched.groupBy("source", F.col("bin").alias("id")).agg(F.sum("size").alias("taken"))
        gaps = cut(
            kept.where(F.col("kind") == _GAP)
            .join(taken, ["source", "id"], "left")
            .select("source", (F.col("size") - F.coalesce("taken", F.lit(0))).alias("size"), "kind", "id")
            .where("size > 0")
        )
    return reduce(DataFrame.unionByName, placed) if placed else waiting


def pack_documents(documents: DataFrame, plan: DataFrame, size: str | None = None) -> DataFrame:
    """``source, container_id, doc_id, piece_no, n_pieces, n_tokens, capacity``: every document of a planned source in its container(s).

    Sizes are the tokens of ``text``, or the column ``size``. A document within the capacity is one piece; a larger one
    fills containers of its own and its remainder is packed like a document.

    Null text has size 0 and lies in the source's first container; rows with a null source or doc_id, or
    a source that the plan doesn't name, are left out, as are plan rows without a source or with a capacity that is null or below 1.
    Rows repeated with the same source and doc_id count once, with the largest size; of a source planned twice the larger capacity counts.
    Ties in size go by doc_id. Empty tables give no rows; other columns are ignored. A plan of more than ``MAX_SOURCES`` sources is an error.
    """
    tokens = F.coalesce(F.col(size), F.lit(0)).cast("bigint") if size else token_count(F.col("text"))
    wanted = plan.where(F.col("source").isNotNull() & (F.col("capacity") >= 1)).groupBy("source").agg(F.max("capacity").cast("bigint").alias("capacity"))
    capacities = {r["source"]: r["capacity"] for r in wanted.limit(MAX_SOURCES + 1).collect()}
    if len(capacities) > MAX_SOURCES:
        raise ValueError(f"a plan may name at most {MAX_SOURCES} sources")
    spark = documents.sparkSession
    known = F.broadcast(local_table(spark, list(capacities.items()), "source string, capacity bigint"))  # at most MAX_SOURCES rows
    items = cut(
        documents.where(F.col("doc_id").isNotNull())
        .select("source", F.col("doc_id").alias("id"), tokens.alias("tokens"))
        .join(known, "source")
        .groupBy("source", "capacity", "id")
        .agg(F.max("tokens").alias("tokens"))
        # A multiple of the capacity leaves nothing to pack; an empty document is a piece of size 0.
        .withColumn("size", F.col("tokens") % F.col("capacity") + F.when((F.col("tokens") == F.col("capacity")), F.col("capacity")).otherwise(0))
    )
    n_full = F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(0).cast("int")
    n_pieces = n_full + F.when((F.col("size") > 0) | (F.col("tokens") == 0), 1).otherwise(0)
    fitted = best_fit(items.where("size > 0").select("source", "id", "size", "tokens"), capacities).join(known, "source")
    empty = items.where("tokens = 0").withColumn("bin", F.lit(0).cast("bigint"))
    columns = ["source", "capacity", "id", "tokens", "size", "bin"]
    bins = fitted.select(columns).unionByName(empty.select(columns)).select(
        "source",
        F.concat_ws("/", "source", F.lit("mixed"), F.col("bin").cast("string")).alias("container_id"),
        F.col("id").alias("doc_id"),
        n_full.alias("piece_no"),
        n_pieces.alias("n_pieces"),
        F.col("size").alias("n_tokens"),
        "capacity",
    )
    whole = items.where("tokens > capacity").withColumn("n_full", n_full).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("n_full") - 1))).select(
        "source",
        F.concat_ws("/", "source", F.lit("full"), F.col("id").cast("string"), F.col("piece_no").cast("string")).alias("container_id"),
        F.col("id").alias("doc_id"),
        "piece_no",
        n_pieces.alias("n_pieces"),
        F.col("capacity").alias("n_tokens"),
        "capacity",
    )
    return bins.unionByName(whole)


def split_by_packing(packed: DataFrame) -> DataFrame:
    """Documents that ``pack_documents`` had to split because they exceed the capacity: those that lie in several containers."""
    lies = packed.groupBy("source", "doc_id").agg(F.count_distinct("container_id").alias("n"))
    return lies.where(F.col("n") > 1).select("doc_id")


def container_report(packed: DataFrame) -> DataFrame:
    """Per source: containers, tokens, and the share of the room that is used."""
    per = packed.groupBy("source", "container_id", "capacity").agg(F.sum("n_tokens").alias("used"))
    return per.groupBy("source", "capacity").agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("used").alias("n_tokens"),
        F.max("used").alias("fullest"),
        (F.sum("used") / (F.count(F.lit(1)) * F.col("capacity"))).alias("fill"),
    )


def container_check(packed: DataFrame) -> DataFrame:
    """Per source, what a right packing has to hold: documents, pieces and tokens, containers above their capacity, documents split
    without need, documents whose pieces don't number from 0, and whether there are at most 2 % and two more containers than the tokens fill."""
    bins = packed.groupBy("source", "container_id", "capacity").agg(F.sum("n_tokens").alias("used"))
    bins = bins.groupBy("source").agg(
        F.count(F.when(F.col("used") > F.col("capacity"), 1)).alias("overfull"),
        (F.count(F.lit(1)) <= F.ceil(F.sum("used") / F.max("capacity")) * 1.02 + 2).alias("tight"),
    )
    docs = packed.groupBy("source", "doc_id", "capacity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.count_distinct("piece_no").alias("k"), F.max("piece_no").alias("last"), F.max("n_pieces").alias("said")
    )
    docs = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum("n").alias("n_pieces"),
        F.sum("t").alias("n_tokens"),
        F.count(F.when((F.col("n") > 1) & (F.col("t") <= F.col("capacity")), 1)).alias("split_small"),
        F.count(F.when((F.col("k") != F.col("n")) | (F.col("last") + 1 != F.col("n")) | (F.col("said") != F.col("n")), 1)).alias("misnumbered"),
    )
    return docs.join(bins, "source")
