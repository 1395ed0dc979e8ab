"""Top N items within every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.termstats import latest_postings
from lexquarry.operators.skew import HEAVY_SHARE, heavy_keys, with_salt


def top_postings(postings: DataFrame, n: int = 3, min_share: float = HEAVY_SHARE) -> DataFrame:
    """``term_id, doc_id, hit_count, rnk``: the ``n`` postings of each term with the most hits, ties to the smaller doc_id.

    Stage one hashes a heavy term's documents into subgroups, keeps the latest of repeated postings and
    ranks within the subgroup; at most ``n`` rows of each subgroup go on. Stage two ranks these
    survivors by hits and document, so the result doesn't depend on the salts.

    Rows with a null term, document or hit count are dropped first. A posting without a time is
    older than any other. A term with fewer postings gives as many rows as it has. ``n`` below 1 and
    empty tables give no rows. Other columns are ignored.
    """
    rows = postings.select("term_id", "doc_id", "hit_count", "written_at").dropna(subset=["term_id", "doc_id", "hit_count"])
    salted = with_salt(rows, "term_id", F.col("doc_id"), heavy_keys(rows, "term_id", min_share))
    latest = latest_postings(salted, "term_id", "salt", "doc_id")
    order = (F.col("hit_count").desc(), F.col("doc_id").asc())
    within = latest.withColumn("r", F.row_number().over(Window.partitionBy("term_id", "salt").orderBy(*order))).where(F.col("r") <= n)
    ranked = within.withColumn("rnk", F.row_number().over(Window.partitionBy("term_id").orderBy(*order))).where(F.col("rnk") <= n)
    return ranked.select("term_id", "doc_id", "hit_count", "rnk")
