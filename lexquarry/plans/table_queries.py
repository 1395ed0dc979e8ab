"""Queries of the general table operators (p2, p3) and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.operators.orphans import broken_references
from lexquarry.operators.skew import dominant_keys, salted_group_stats
from lexquarry.plans.session import table

#: Share of the postings above which a term counts as one of the few that hold most rows.
DOMINANT_SHARE = 0.01


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    words, postings, lengths, store = (table(spark, d, t) for t in ("wordlist", "doclist", "doc_lengths", "docstore"))
    parts = [
        broken_references(postings, "term_id", "written_at", words, "id", "added_at", field_name="doclist.term_id"),
        broken_references(postings, "doc_id", "written_at", lengths, "doc_id", "written_at", field_name="doclist.doc_id"),
        broken_references(lengths, "doc_id", "written_at", store, "doc_id", "added_at", "deleted_at", field_name="doc_lengths.doc_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Broken references per field, month and reason."""
    return _orphans(spark, d).groupBy("ref_field", "written_month", "reason").agg(F.count(F.lit(1)).alias("n_refs"))


def p3_stats(spark: SparkSession, d: str) -> DataFrame:
    return salted_group_stats(table(spark, d, "doclist")).withColumnsRenamed({"n_members": "n_docs", "total": "n_hits"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return dominant_keys(salted_group_stats(table(spark, d, "doclist")), "term_id", DOMINANT_SHARE).select("term_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_stats)}

_REFS = """
with refs as (
  select 'doclist.term_id' ref_field, term_id ref_id, written_at t from doclist where term_id is not null
  union all select 'doclist.doc_id', doc_id, written_at from doclist where doc_id is not null
  union all select 'doc_lengths.doc_id', doc_id, written_at from doc_lengths where doc_id is not null),
parents as (
  select 'doclist.term_id' ref_field, id ref_id, min(added_at) a, cast(null as timestamp) d from wordlist group by 2
  union all select 'doclist.doc_id', doc_id, min(written_at), cast(null as timestamp) from doc_lengths group by 2
  union all select 'doc_lengths.doc_id', doc_id, min(added_at), min(deleted_at) from docstore group by 2),
judged as (
  select r.ref_field, r.ref_id, strftime(r.t, '%Y-%m') written_month,
         unnest([case when p.ref_id is null then 'missing' end,
                 case when p.d <= r.t then 'deleted' end,
                 case when p.a > r.t then 'late' end]) reason
  from refs r left join parents p on p.ref_field = r.ref_field and p.ref_id = r.ref_id),
found as (select distinct ref_field, ref_id, written_month, reason from judged where reason is not null)
"""

SQL = {
    "p2_found": _REFS + "select * from found",
    "p2_report": _REFS + "select ref_field, written_month, reason, count(*) n_refs from found group by 1, 2, 3",
    "p3_found": """
select term_id from doclist where term_id is not null group by 1
having count(*) > 0.01 * (select count(term_id) from doclist)""",
    "p3_stats": """
select term_id, count(*) n_rows, count(distinct doc_id) n_docs, cast(coalesce(sum(hit_count), 0) as bigint) n_hits
from doclist where term_id is not null group by 1""",
}
