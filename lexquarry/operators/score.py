"""Okapi BM25 with a proximity factor, for any number of queries in one plan."""

from __future__ import annotations

from dataclasses import replace
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.config import Config
from lexquarry.operators.build import IndexTables
from lexquarry.plans.session import bounded, cut

#: Scores are ranked as rounded to so many decimals, so that summation order can't change a rank.
DECIMALS = 6


def fetch(index: IndexTables, terms: DataFrame, config: Config, fuzzy: bool, no_limit: bool = False) -> DataFrame:
    """``query_id, kw_idx, term, doc_id, hit_count, df`` (and ``length`` if postings have it): of each keyword's postings the ``max_docs`` with most hits.

    A keyword can use no more than ``max_docs`` postings of a term, so terms are capped first, once for all
    queries that share them, and only then meet the keywords. Either ranking starts on each task's own rows:
    of a frequent term no more than ``max_docs`` rows of a task are moved. With ``fuzzy`` closer terms come first.
    With ``no_limit`` every posting is kept, whatever ``max_docs``.
    """
    by_kw = Window.partitionBy("query_id", "kw_idx")
    wanted = terms.withColumn("df", F.sum("num_docs").over(by_kw)).select("query_id", "kw_idx", "term", "rnk", "df")
    if no_limit:
        return index.postings.join(wanted.drop("rnk"), "term")
    by_term = Window.partitionBy("term").orderBy(F.col("hit_count").desc(), "doc_id")
    best = (
        index.postings.join(terms.select("term").distinct(), "term", "left_semi")
        .withColumn("r", F.row_number().over(by_term))
        .where(F.col("r") <= config.max_docs)
        .drop("r")
    )
    order = [F.col("hit_count").desc(), F.col("rnk"), F.col("doc_id")]
    if fuzzy:
        order = [order[1], order[0], order[2]]
    # A query has at most max_docs rows of each of its terms, so it fits a task; by query alone, no later step moves its rows again.
    hits = best.join(wanted, "term").repartition("query_id")
    return hits.withColumn("r", F.row_number().over(by_kw.orderBy(*order))).where(F.col("r") <= config.max_docs).drop("r", "rnk")


def bm25(index: IndexTables, fetched: DataFrame, config: Config) -> DataFrame:
    """``query_id, doc_id, score``. The inverse document frequency is not clamped, so expansions may weigh negatively."""
    stats = index.stats.select(F.col("total_documents").alias("n"), F.greatest(F.lit(1.0), F.col("avg_doc_length")).alias("avgdl"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf, k1, b = F.col("hit_count"), config.k1, config.b
    part = idf * (k1 + 1) * tf / (F.lit(k1 * (1 - b)) + F.lit(k1 * b) / F.col("avgdl") * F.col("length") + tf)
    sized = fetched if "length" in fetched.columns else fetched.join(index.doc_lengths, "doc_id")
    return (
        sized.join(F.broadcast(stats))  # one row
        .groupBy("query_id", "doc_id")
        .agg(F.sum(part).alias("score"))
    )


def half_up(x: float) -> float:
    """A score as it is ranked."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-DECIMALS), ROUND_HALF_UP))


def bm25_of(postings: list[list], df: list[int], n: int, avgdl: float, config: Config) -> dict[int, float]:
    """``bm25`` for one query whose postings, at most ``max_docs`` for each keyword, are at hand."""
    k1, b, scores = config.k1, config.b, {}
    for rows, found in zip(postings, df):
        idf = log(1 + (n - found + 0.5) / (found + 0.5)) if rows else 0.0
        for r in rows:
            tf = r["hit_count"]
            part = idf * (k1 + 1) * tf / (k1 * (1 - b) + k1 * b / max(1.0, avgdl) * r["length"] + tf)
            scores[r["doc_id"]] = scores.get(r["doc_id"], 0.0) + part
    return scores


def span_rows(rows: DataFrame, keys: list[str], groups: list[int], needed: Column | None = None) -> DataFrame:
    """``keys, min_span`` for ``rows`` of ``keys, position, g``: the smallest window that holds a position of every group, or of ``needed`` groups.

    For each position the latest position so far of every group is known from a running maximum; the
    window ends here and begins at the earliest of these.
    """
    so_far = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.max(F.when(F.col("g") == g, F.col("position"))).over(so_far).alias(f"l{i}") for i, g in enumerate(groups)]
    seen = reduce(lambda x, y: x + y, [F.col(f"l{i}").isNotNull().cast("int") for i in range(len(groups))])
    first = F.least(*[F.col(f"l{i}") for i in range(len(groups))]) if len(groups) > 1 else F.col("l0")
    whole = (F.lit(len(groups)) if needed is None else needed).alias("needed")
    return rows.select(*keys, "position", whole, *last).where(seen == F.col("needed")).groupBy(*keys).agg(F.min(F.col("position") - first).alias("min_span"))


def narrowed(index: IndexTables, fetched: DataFrame) -> IndexTables:
    """``index`` with the positions of the documents of ``fetched`` alone, if a count shows that these are few; else as it is.

    ``fetched`` should have been written, as it is counted. The other documents are not taken apart again.
    """
    if index.positions_in is None:
        return index
    docs = fetched.select("doc_id").distinct()
    few = bounded(docs)
    return index if few is docs else replace(index, positions=index.positions_in(few))


def min_spans(index: IndexTables, fetched: DataFrame, docs: DataFrame, n_groups: int) -> DataFrame:
    """``query_id, doc_id, min_span``: the smallest window of positions that holds a term of every keyword that was found.

    A term of two keywords belongs to the last. Queries with one keyword, and documents without one of them, have no
    row. ``n_groups``: keywords of the longest query; queries of about as many keywords are worked on together (2-4, 5-8, 9-16, ...), so short ones don't
    pay for long ones.
    """
    found = fetched.select("query_id", "kw_idx").distinct()
    of_query = Window.partitionBy("query_id")
    numbered = found.select(
        "query_id", "kw_idx", (F.row_number().over(of_query.orderBy("kw_idx")) - 1).alias("g"), F.count(F.lit(1)).over(of_query).alias("needed")
    ).where(F.col("needed") > 1)
    last_of = fetched.groupBy("query_id", "term").agg(F.max("kw_idx").alias("kw_idx"))
    wanted = last_of.join(numbered, ["query_id", "kw_idx"]).drop("kw_idx").join(docs.select("query_id", "doc_id"), "query_id")
    parts, few, most = [], 1, 4
    while few < max(2, n_groups):
        own = wanted.where(F.col("needed").between(few + 1, most))
        if index.located is None:
            # Spark takes positions for as small as the texts they are made of; without a hint it broadcasts all of them.
            rows = index.positions.hint("merge").join(own, ["term", "doc_id"])
        else:  # of a frequent term only the postings of ranked documents are taken apart
            rows = index.located.join(own, ["term", "doc_id"]).withColumn("position", F.explode(F.col("positions").cast("array<bigint>")))
        parts.append(span_rows(rows, ["query_id", "doc_id"], list(range(min(most, max(2, n_groups)))), F.col("needed")))
        few, most = most, most * 2
    return reduce(DataFrame.unionByName, parts)


def search(
    index: IndexTables,
    terms: DataFrame,
    config: Config = Config(),
    fuzzy: bool = False,
    limit: int = 100,
    offset: int = 0,
    n_groups: int = 1,
    fetched: DataFrame | None = None,
) -> DataFrame:
    """``query_id, doc_id, score, rank, hits``: the page of each query; ``hits`` counts all its scored documents.

    ``terms`` comes from ``resolve``. ``n_groups`` is the number of keywords of the longest query; with at least two,
    the proximity factor applies to the best ``max((offset + limit) * 5, 200)`` documents of a query. Then the fetched
    postings, at most ``max_docs`` for each keyword, are needed several times and written once. ``fetched``: those of
    ``fetch``, if the caller has them.
    """
    near = n_groups >= 2 and config.proximity_boost > 0
    if fetched is None:
        fetched = fetch(index, terms, config, fuzzy)
        fetched = cut(fetched) if near else fetched
    scores = bm25(index, fetched, config)
    ranked = Window.partitionBy("query_id").orderBy(F.round("score", DECIMALS).desc(), "doc_id")
    if near:
        top = scores.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= max((offset + limit) * 5, 200))
        spans = min_spans(narrowed(index, fetched), fetched, top, n_groups)
        factor = F.coalesce(1 / (1 + F.lit(float(config.proximity_boost)) * F.col("min_span")), F.lit(1.0))
        scores = scores.join(spans, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.col("score") * factor).alias("score"))
    hits = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    page = scores.withColumn("hits", hits).withColumn("rank", F.row_number().over(ranked))
    return page.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).select(
        "query_id", "doc_id", F.round("score", DECIMALS).alias("score"), "rank", "hits"
    )
