"""The inverted index of a table of documents, as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.functions.analysis import tokenize
from lexquarry.functions.stopwords import remove_stopwords
from lexquarry.plans.session import cut


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms: n-grams by language, then stopwords, then stems."""

    language: str | None = None
    stopwords: tuple[str, ...] = ()
    stem: bool = False

    def filtered(self, text: Column) -> Column:
        return remove_stopwords(tokenize(text, self.language), self.stopwords)

    def py_stem(self, tokens: list[str]) -> list[str]:
        if not self.stem:
            return tokens
        from lexquarry.functions.stemmers import stem_word

        return [stem_word(t, self.language) for t in tokens]


@dataclass(frozen=True)
class IndexTables:
    """``postings(term, doc_id, hit_count)``, perhaps with the document's ``length``, ``positions(term, doc_id, position)``, ``lexicon(term, num_hits, num_docs)``,
    ``doc_lengths(doc_id, length)``, ``stats(total_documents, avg_doc_length)`` in one row."""

    postings: DataFrame
    positions: DataFrame
    lexicon: DataFrame
    doc_lengths: DataFrame
    stats: DataFrame
    analyzer: Analyzer = field(default_factory=Analyzer)
    #: ``term, doc_id, positions``: the positions as lists, where they are kept so.
    located: DataFrame | None = None
    #: ``positions`` of the documents in a broadcast table of ``doc_id``, where documents are at hand.
    positions_in: Callable[[DataFrame], DataFrame] | None = None


def field_text(df: DataFrame, name: str) -> Column:
    """A field as trimmed text; null is blank, true is 1 and false blank."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        c = F.when(c, F.lit("1")).otherwise(F.lit(""))
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def document_tokens(docs: DataFrame, id_col: str, text_cols: Iterable[str], analyzer: Analyzer = Analyzer()) -> DataFrame:
    """``doc_id, tokens``: the terms of all fields in the order given, with one counter of positions.

    Null ids are left out. A document without a term has an empty list.
    """
    parts = [analyzer.filtered(field_text(docs, c)) for c in text_cols]
    tokens = F.concat(*parts) if len(parts) > 1 else parts[0]
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), tokens.alias("tokens"))


def token_rows(tokens: DataFrame, analyzer: Analyzer = Analyzer(), with_length: bool = False) -> DataFrame:
    """``doc_id, position, term`` (and the document's ``length``), one row per token. Whole lists are stemmed before they are taken apart."""
    kept = ["doc_id", "length"] if with_length else ["doc_id"]
    rows = tokens.select("doc_id", F.size("tokens").cast("bigint").alias("length"), "tokens")
    if analyzer.stem:
        from lexquarry.functions.stemmers import stem_tokens

        rows = rows.withColumn("tokens", stem_tokens(F.col("tokens"), analyzer.language))
        # From posexplode Spark infers a filter on the list's size, for which it stems each list once more.
        return rows.select(*kept, F.posexplode_outer("tokens").alias("position", "term")).where(F.col("position").isNotNull())
    return rows.select(*kept, F.posexplode("tokens").alias("position", "term"))


def postings_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("hit_count"))


def lexicon_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.sum("hit_count").alias("num_hits"), F.count(F.lit(1)).alias("num_docs"))


def stats_of(doc_lengths: DataFrame) -> DataFrame:
    return doc_lengths.agg(F.count(F.lit(1)).alias("total_documents"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_doc_length"))


def build_index(docs: DataFrame, id_col: str, text_cols: Iterable[str], analyzer: Analyzer = Analyzer(), keep: bool = False) -> IndexTables:
    """The index of ``docs``. Lazy: each table is its own plan over the documents.

    With ``keep`` the postings, with their documents' lengths, and the lexicon are computed now and written once to the checkpoint folder;
    ranking then reads them instead of the documents.
    """
    text_cols = list(text_cols)
    tokens = document_tokens(docs, id_col, text_cols, analyzer)
    rows = token_rows(tokens, analyzer, with_length=keep)
    if keep:
        postings = cut(rows.groupBy("term", "doc_id", "length").agg(F.count(F.lit(1)).alias("hit_count")))
    else:
        postings = postings_of(rows)
    lexicon = lexicon_of(postings)

    def positions_of(rows: DataFrame) -> DataFrame:
        return rows.select("term", "doc_id", F.col("position").cast("bigint").alias("position"))

    def positions_in(ids: DataFrame) -> DataFrame:
        few = docs.join(ids.toDF("kept_id"), F.col(id_col).cast("bigint") == F.col("kept_id"), "left_semi")
        return positions_of(token_rows(document_tokens(few, id_col, text_cols, analyzer), analyzer))

    lengths = tokens.select("doc_id", F.size("tokens").cast("bigint").alias("length"))
    return IndexTables(
        postings,
        positions_of(rows),
        cut(lexicon) if keep else lexicon,
        lengths,
        stats_of(lengths),
        analyzer,
        positions_in=positions_in,
    )
