"""What a query turns into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.config import Config
from lexquarry.operators.boolean import to_postfix
from lexquarry.operators.build import IndexTables
from lexquarry.operators.resolve import analyze_phrase, keyword_table, resolve
from lexquarry.plans.session import local_table


def explain_table(index: IndexTables, phrase: str, config: Config = Config(), fuzzy: bool = False, as_you_type: bool = True) -> DataFrame:
    """``tok_idx, raw, processed, is_last, match_type, term, num_hits, num_docs, distance, rnk``; a keyword without a term has one row with null terms.

    ``match_type`` is ``none``; ``fuzzy``; ``prefix`` if the last keyword's first term differs from it; else ``exact``.
    """
    spark = index.lexicon.sparkSession
    said = analyze_phrase(phrase, index.analyzer)
    keywords = keyword_table(spark, [phrase], index.analyzer, as_you_type)
    rows = resolve(keywords, index.lexicon, config, fuzzy, index.analyzer.language).drop("is_last", "kw")
    raw = local_table(spark, list(enumerate(said["surviving_raw"])), "tok_idx int, raw string")
    first = F.first_value("term").over(_by_keyword())
    kind = (
        F.when(F.col("term").isNull(), "none")
        .when(F.col("distance").isNotNull(), "fuzzy")
        .when(F.col("is_last") & (first != F.col("kw")), "prefix")
        .otherwise("exact")
    )
    return (
        keywords.join(rows, ["query_id", "kw_idx"], "left")
        .join(raw, F.col("kw_idx") == F.col("tok_idx"))
        .select("tok_idx", "raw", F.col("kw").alias("processed"), "is_last", kind.alias("match_type"), "term", "num_hits", "num_docs", "distance", "rnk")
    )


def _by_keyword():
    from pyspark.sql import Window

    return Window.partitionBy("query_id", "kw_idx").orderBy("rnk")


def inspect_query(index: IndexTables, phrase: str, config: Config = Config(), fuzzy: bool = False, as_you_type: bool = True) -> dict:
    """The same as a nested record, with the corpus statistics and the phrase as a boolean expression in postfix order."""
    said = analyze_phrase(phrase, index.analyzer)
    rows = explain_table(index, phrase, config, fuzzy, as_you_type).orderBy("tok_idx", "rnk").collect()
    tokens = []
    for i, processed in enumerate(said["filtered"]):
        own = [r for r in rows if r["tok_idx"] == i]
        terms = [{k: r[k] for k in ("term", "num_hits", "num_docs", "distance")} for r in own if r["term"] is not None]
        tokens.append(
            {
                "raw": said["surviving_raw"][i],
                "processed": processed,
                "is_last": as_you_type and i == len(said["filtered"]) - 1,
                "found": bool(terms),
                "match_type": own[0]["match_type"] if own else "none",
                "wordlist_rows": terms,
                "num_hits": sum(t["num_hits"] for t in terms),
                "num_docs": sum(t["num_docs"] for t in terms),
            }
        )
    stats = index.stats.first()
    return {
        "raw_tokens": said["raw_tokens"],
        "filtered_tokens": said["filtered"],
        "stopwords_active": bool(index.analyzer.stopwords),
        "stemmer_active": index.analyzer.stem,
        "all_stripped": said["all_stripped"],
        "index_info": stats.asDict() if stats else {},
        "tokens": tokens,
        "boolean_postfix": to_postfix(phrase)[0],
    }
