"""Oversized texts cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.sizes import TOKEN_PYTHON, token_count

LIMIT = 400
OVERLAP = 40
SECTION, PARAGRAPH, SENTENCE, WORD, CHARACTER = range(5)

_SPANS = "array<struct<piece_no:int,char_start:int,char_end:int,n_tokens:int,overlap_tokens:int>>"


def _levels(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """For each token but the first, the strongest boundary between it and the token before."""
    out = [SECTION]
    for (_, end), (start, _) in zip(spans, spans[1:]):
        gap = text[end:start]
        if not gap:
            out.append(CHARACTER)
        elif "\n" in gap and gap[gap.rindex("\n") + 1 :].lstrip().startswith("#"):
            out.append(SECTION)
        elif "\n" in gap and any(not line.strip() for line in gap.split("\n")[1:-1]):
            out.append(PARAGRAPH)
        elif "\n" in gap or any(c in gap for c in "。！？") or any(c in ".!?…" and gap[i + 1 : i + 2].isspace() for i, c in enumerate(gap)):
            out.append(SENTENCE)
        elif any(c.isspace() or c in "、，；：,;:" for c in gap):
            out.append(WORD)
        else:
            out.append(CHARACTER)
    return out


def _units(levels: list[int], lo: int, hi: int, level: int, most: int) -> Iterator[int]:
    """Ends of the coarsest units of at most ``most`` tokens that make up tokens lo..hi."""
    if hi - lo <= most:
        yield hi
        return
    if level == CHARACTER:
        yield from range(lo + 1, hi + 1)
        return
    edges = [i for i in range(lo + 1, hi) if levels[i] <= level]
    for a, b in zip([lo, *edges], [*edges, hi]):
        yield from _units(levels, a, b, level + 1, most)


def split_spans(text: str, spans: list[tuple[int, int]], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """(piece_no, char_start, char_end, n_tokens, overlap_tokens) for each piece of a text with these token spans.

    Sections too long are split into paragraphs, those into sentences, words and characters, until a
    unit fits beside the overlap; units are then packed greedily. A piece starts with the last
    ``overlap`` tokens of the one before, or with fewer where a sentence starts among them.
    """
    n = len(spans)
    if n <= limit:
        return [(0, 0, len(text), n, 0)]
    levels = _levels(text, spans)
    ends = list(_units(levels, 0, n, SECTION, limit - overlap))
    start, fresh, pieces, k = 0, 0, [], 0
    while fresh < n:
        end = ends[k]
        while k + 1 < len(ends) and ends[k + 1] - start <= limit:
            k += 1
            end = ends[k]
        pieces.append((start, fresh, end))
        fresh, k = end, k + 1
        back = max(start, end - overlap)
        start = next((i for i in range(back, end) if levels[i] <= SENTENCE), back)
    at = lambda i: 0 if i == 0 else len(text) if i == n else spans[i][0]
    return [(i, at(s), at(e), e - s, f - s) for i, (s, f, e) in enumerate(pieces)]


def split_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, piece_no, n_pieces, n_tokens, overlap_tokens, char_start, char_end, piece`` for texts of more than ``limit`` tokens.

    Sizes are counted in the JVM, so only texts over the limit reach Python, and of those only offsets
    come back. Pieces without their overlaps, put together, give the text. Null and empty texts and
    texts within the limit give no rows; a single token is never cut, whatever its length. Repeated
    rows are split each by itself; other columns are ignored. ``overlap`` must be below ``limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")

    @F.pandas_udf(_SPANS)
    def cut_up(texts: pd.Series) -> pd.Series:
        import regex

        token = regex.compile(TOKEN_PYTHON)
        return pd.Series([split_spans(t, [m.span() for m in token.finditer(t)], limit, overlap) for t in texts])

    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))
    large = rows.where((F.length("__text") > limit) & (token_count(F.col("__text")) > limit))
    # Called non-deterministic so that the plan does not evaluate it once for each use of its result.
    pieces = large.withColumn("p", cut_up.asNondeterministic()("__text")).select("doc_id", "__text", F.size("p").alias("n_pieces"), F.explode("p").alias("p"))
    return pieces.select(
        "doc_id",
        "p.piece_no",
        "n_pieces",
        "p.n_tokens",
        "p.overlap_tokens",
        "p.char_start",
        "p.char_end",
        F.substring(F.col("__text"), F.col("p.char_start") + 1, F.col("p.char_end") - F.col("p.char_start")).alias("piece"),
    )


def split_check(pieces: DataFrame) -> DataFrame:
    """Per split document what right pieces have: the tokens they add up to without their overlaps, the characters they reach, and whether
    they are numbered from 0, begin where the text begins, follow each other without a gap, move on, and stay within the limits."""
    before = Window.partitionBy("doc_id").orderBy("piece_no")
    seen = pieces.select(
        "*",
        F.lag("char_end", 1, 0).over(before).alias("reached"),
        F.lag("char_start", 1, -1).over(before).alias("from"),
        F.row_number().over(before).alias("no"),
    )
    every = lambda c: F.min(c.cast("int")) == 1
    return seen.groupBy("doc_id").agg(
        F.sum(F.col("n_tokens") - F.col("overlap_tokens")).alias("n_tokens"),
        F.max("char_end").cast("bigint").alias("n_chars"),
        every(F.col("piece_no") == F.col("no") - 1).alias("numbered"),
        every((F.col("char_start") <= F.col("reached")) & (F.col("char_start") > F.col("from")) & (F.col("char_end") > F.col("reached"))).alias("covering"),
        every((F.col("n_tokens") <= LIMIT) & (F.col("overlap_tokens") <= OVERLAP) & (F.char_length("piece") == F.col("char_end") - F.col("char_start"))).alias("limited"),
    )
