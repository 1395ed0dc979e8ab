"""From phrases to keywords and from keywords to terms of the lexicon.

Keywords travel as a table ``query_id, kw_idx, kw, is_last``, so one plan answers any number of
queries. Prefix and fuzzy matching are hash joins: on the term's own first letters (as many as the
keywords have, up to six), and on the first characters that a fuzzy match must share together with its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.config import Config
from lexquarry.functions.analysis import py_split, py_tokenize, tokenize
from lexquarry.functions.languages import ngram_size
from lexquarry.functions.stopwords import remove_stopwords
from lexquarry.operators.build import Analyzer
from lexquarry.plans.session import local_table

#: First letters by which beginnings and terms are joined, at most.
PREFIX_KEY = 6
KEYWORDS = "query_id bigint, kw_idx int, kw string, is_last boolean"


def analyze_phrase(phrase: str, analyzer: Analyzer = Analyzer()) -> dict:
    """Raw tokens, tokens that survive the stopwords (all, if none would or there is only one), and their stems."""
    tokens = py_tokenize(phrase, analyzer.language)
    stopped = False
    if analyzer.stopwords and len(tokens) > 1:
        left = [t for t in tokens if t not in set(analyzer.stopwords)]
        stopped = not left
        tokens = left or tokens
    return {"raw_tokens": py_split(phrase), "surviving_raw": tokens, "filtered": analyzer.py_stem(tokens), "all_stripped": stopped}


def keyword_table(spark: SparkSession, phrases: list[str], analyzer: Analyzer = Analyzer(), as_you_type: bool = True) -> DataFrame:
    """Keywords of phrases given as strings; query_id is the phrase's place."""
    rows = []
    for q, phrase in enumerate(phrases):
        kws = analyze_phrase(phrase, analyzer)["filtered"]
        rows += [(q, i, kw, as_you_type and i == len(kws) - 1) for i, kw in enumerate(kws)]
    return local_table(spark, rows, KEYWORDS)


def analyze_queries(queries: DataFrame, analyzer: Analyzer = Analyzer(), as_you_type: bool = True) -> DataFrame:
    """Keywords of a table ``query_id, phrase``, by the same rules, in the JVM but for stems."""
    tokens = tokenize(F.col("phrase"), analyzer.language)
    left = remove_stopwords(F.col("t"), analyzer.stopwords)
    kept = F.when((F.size("t") > 1) & (F.size(left) > 0), left).otherwise(F.col("t"))
    rows = (
        queries.select(F.col("query_id").cast("bigint").alias("query_id"), tokens.alias("t"))
        .select("query_id", kept.alias("k"))
        .select("query_id", F.size("k").alias("n"), F.posexplode("k").alias("kw_idx", "kw"))
    )
    if analyzer.stem:
        from lexquarry.functions.stemmers import stem_column

        rows = rows.withColumn("kw", stem_column(F.col("kw"), analyzer.language))
    return rows.select("query_id", "kw_idx", "kw", (F.lit(as_you_type) & (F.col("kw_idx") == F.col("n") - 1)).alias("is_last"))


def resolve(
    keywords: DataFrame, lexicon: DataFrame, config: Config = Config(), fuzzy: bool = False, language: str | None = None
) -> DataFrame:
    """``query_id, kw_idx, kw, is_last, term, num_hits, num_docs, distance, rnk``: the terms each keyword stands for.

    A keyword stands for the equal term; as the last one (but in n-gram languages) for at most
    ``fuzzy_max_expansions`` terms it begins, shorter and more frequent first. With ``fuzzy``, a keyword without a term
    stands for the terms within the edit distance among the most frequent ones that share its first characters.
    """
    cap = config.fuzzy_max_expansions
    kws = keywords.withColumn("kw_len", F.char_length("kw"))
    lex = lexicon.select("term", "num_hits", "num_docs")
    none = F.lit(None).cast("int").alias("distance")
    as_prefix = F.col("is_last") if not ngram_size(language) else F.lit(False)

    exact = kws.where(~as_prefix).join(lex, F.col("kw") == F.col("term")).select(
        *KEY_COLUMNS, "term", "num_hits", "num_docs", none, F.lit(1).alias("rnk")
    )
    # Each beginning once; it meets the terms that share its first letters, up to PREFIX_KEY of them, so a term is looked up by as many starts at most.
    beginnings = kws.where(as_prefix).select("kw").distinct().withColumn("start", F.substring("kw", 1, PREFIX_KEY))
    lengths = beginnings.agg(F.sort_array(F.collect_set(F.char_length("start"))).alias("lengths"))
    starts = (
        lex.join(F.broadcast(lengths))  # one row of at most PREFIX_KEY lengths
        .withColumn("n", F.explode("lengths"))
        .where(F.char_length("term") >= F.col("n"))
        .withColumn("start", F.expr("substring(term, 1, n)"))
        .drop("n", "lengths")
    )
    shortest = Window.partitionBy("kw").orderBy(F.char_length("term"), F.col("num_hits").desc(), "term")
    begun = (
        beginnings.join(starts, "start")
        .where(F.col("term").startswith(F.col("kw")))
        .withColumn("rnk", F.row_number().over(shortest))
        .where(F.col("rnk") <= cap)
        .select("kw", "term", "num_hits", "num_docs", "rnk")
    )
    prefixed = kws.where(as_prefix).join(begun, "kw").select(*KEY_COLUMNS, "term", "num_hits", "num_docs", none, "rnk")
    found = exact.unionByName(prefixed)
    if not fuzzy:
        return found
    unknown = kws.join(found.select("query_id", "kw_idx").distinct(), ["query_id", "kw_idx"], "left_anti")
    d = config.fuzzy_distance
    most_used = Window.partitionBy("kw").orderBy(F.col("num_hits").desc(), "term")
    near = Window.partitionBy("kw").orderBy("distance", F.col("num_hits").desc(), "term")
    # Each keyword once, with the start that terms must share and every length they may have: the join's key. A keyword shorter than
    # the shared start is itself the start.
    words = unknown.select("kw", "kw_len").distinct().withColumn("head", F.substring("kw", 1, config.fuzzy_prefix_length)).withColumn(
        "size", F.explode(F.sequence(F.greatest(F.lit(1), F.col("kw_len") - d), F.col("kw_len") + d))
    )
    head_lengths = words.agg(F.sort_array(F.collect_set(F.char_length("head"))).alias("lengths"))
    heads = (
        lex.join(F.broadcast(head_lengths))  # one row, of as many lengths as a shared start may have
        .withColumn("size", F.char_length("term"))
        .withColumn("n", F.explode("lengths"))
        # A start shorter than usual is a whole keyword, so its terms are short too.
        .where((F.col("size") >= F.col("n")) & ((F.col("n") == config.fuzzy_prefix_length) | (F.col("size") <= F.col("n") + d)))
        .select("term", "num_hits", "num_docs", "size", F.expr("substring(term, 1, n)").alias("head"))
    )
    close = (
        words.join(heads, ["head", "size"])
        .withColumn("r", F.row_number().over(most_used))
        .where(F.col("r") <= cap)
        .withColumn("distance", F.levenshtein("term", "kw"))
        .where(F.col("distance") <= d)
        .withColumn("rnk", F.row_number().over(near))
    )
    fuzzed = unknown.join(close.select("kw", "term", "num_hits", "num_docs", "distance", "rnk"), "kw").select(
        *KEY_COLUMNS, "term", "num_hits", "num_docs", "distance", "rnk"
    )
    return found.unionByName(fuzzed)


KEY_COLUMNS = ["query_id", "kw_idx", "kw", "is_last"]
