"""Frequency of every distinct term, and marks for terms too rare or too common to help a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.operators.skew import HEAVY_SHARE, heavy_keys, lookup, salted_lookup

#: A term in at most so many documents is rare; one in more than this share of all documents is common.
RARE_DOCS = 2
COMMON_SHARE = 0.2
#: Ids of strings with several ids that are broadcast at most, with a digest of their string each.
MOST_SHARED = 200_000


def latest_postings(postings: DataFrame, *keys: str) -> DataFrame:
    """(keys, hit_count): of repeated postings the latest, at the same time the one with more hits.

    One aggregation that combines before its shuffle, so a posting that was sent again any number of times travels once from each task.
    A posting without a time is older than any other, one without hits lower than any other.
    """
    newest = F.max(F.struct("written_at", "hit_count")).alias("newest")
    return postings.groupBy(*keys).agg(newest).select(*keys, "newest.hit_count")


def term_statistics(
    postings: DataFrame, lexicon: DataFrame, rare_docs: int = RARE_DOCS, common_share: float = COMMON_SHARE, min_share: float = HEAVY_SHARE
) -> DataFrame:
    """``term, n_ids, num_hits, num_docs, mark`` for every distinct string of ``lexicon.term``.

    Postings are combined to one row per (term, document) before and after their one shuffle by hash, which spreads a heavy
    term by its documents; these are added up per term id in each task, so what is shuffled next, and meets the lexicon, is
    partial counts. Only ids of strings that several ids share keep their documents, as those may overlap; they are counted by string and document.
    ``mark``: ``rare`` (at most ``rare_docs`` documents, also none), ``common`` (more than
    ``common_share`` of all distinct documents of the postings, orphans included), else null.

    Postings with a null term or document, or whose term is no lexicon id, count nowhere (the latter's
    documents do count among all documents); repeated postings count once, with the hits written last;
    null hits are 0. A null term is no term; the empty string is one. Repeated lexicon rows count once.
    An empty lexicon gives no rows, empty postings make every term rare. Other columns are ignored.
    """
    posts = postings.select("term_id", "doc_id", "hit_count", "written_at").where(
        F.col("term_id").isNotNull() & F.col("doc_id").isNotNull()
    )
    n_documents = postings.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().agg(F.count("doc_id")).scalar()
    ids = lexicon.select("id", "term").where(F.col("term").isNotNull() & F.col("id").isNotNull()).distinct()
    terms = ids.groupBy("term").agg(F.count("id").alias("n_ids"))
    shared = terms.where(F.col("n_ids") > 1).select(F.col("term").alias("shared_term"), F.md5("term").alias("string_id"))
    named = salted_lookup(ids, "term", F.col("id"), shared, "shared_term", heavy_keys(ids, "term", min_share), "left")

    once = latest_postings(posts, "term_id", "doc_id")
    per_id = once.groupBy("term_id").agg(F.sum("hit_count").alias("hits"), F.count(F.lit(1)).alias("docs"))
    alone = named.where("string_id is null").join(per_id, F.col("id") == F.col("term_id")).select("term", "hits", "docs")
    # Where a count shows the shared ids to be few, their postings are picked out before anything moves.
    shared_ids = named.where("string_id is not null").select("id", "string_id")
    several = (
        lookup(once, "term_id", F.col("doc_id"), shared_ids, "id", MOST_SHARED, min_share)
        .groupBy("string_id", "doc_id")
        .agg(F.sum("hit_count").alias("hits"))
        .groupBy("string_id")
        .agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("docs"))
        .join(shared, "string_id")
        .select(F.col("shared_term").alias("term"), "hits", "docs")
    )
    counted = alone.unionByName(several)
    num_docs = F.coalesce("docs", F.lit(0)).cast("bigint")
    return terms.join(counted, "term", "left").select(
        "term",
        "n_ids",
        F.coalesce("hits", F.lit(0)).cast("bigint").alias("num_hits"),
        num_docs.alias("num_docs"),
        F.when(num_docs <= rare_docs, F.lit("rare")).when(num_docs > n_documents * F.lit(common_share), F.lit("common")).alias("mark"),
    )
