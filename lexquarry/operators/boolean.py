"""Boolean queries: parsed on the driver, evaluated in one pass over the postings of their words.

Grammar: words, ``or``, a leading ``-`` or ``~`` for "not", parentheses; a space or ``&`` is "and". "Not"
binds tightest, then "and", then "or". Spaces around ``&`` and repeated spaces mean one "and" unless
``strict_compat`` keeps them apart (then they find nothing, as an operator without an operand).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.config import Config
from lexquarry.errors import QueryError
from lexquarry.functions.analysis import py_tokenize
from lexquarry.functions.languages import ngram_size
from lexquarry.operators.build import Analyzer, IndexTables
from lexquarry.operators.resolve import KEYWORDS, resolve
from lexquarry.plans.session import local_table

OR, AND, NOT = "|", "&", "~"
_BINDS = {OR: 1, AND: 2}

# What a run of characters means where it stands; the first that fits. "or" needs space on both sides, and a parenthesis takes the
# space around it, but leaves a minus the space before it.
_COMMON = r"(?P<open>\s*\(\s*)|(?P<close>\s*\)(?:\s*+(?!-)|\s*(?=\s-))?)|"
_LOOSE = re.compile(_COMMON + r"(?P<or>\s+or\s++(?![()&|]))|(?P<minus>\s+-)|(?P<sign>\s*[&|]\s*)|(?P<not>~)|(?P<and>\s+)|(?P<word>[^\s()&|~]+)")
_STRICT = re.compile(_COMMON + r"(?P<or> or (?!\s*[()]))|(?P<minus> -)|(?P<sign>[&|])|(?P<not>~)|(?P<and> )|(?P<word>[^ ()&|~]+)")
_MEANING = {"open": ("(",), "close": (")",), "or": (OR,), "minus": (AND, NOT), "not": (NOT,), "and": (AND,)}


@dataclass(frozen=True)
class Leaf:
    word: str
    prefix: bool


@dataclass(frozen=True)
class Node:
    """``op``: and, or, minus. An operand that is missing is None and finds nothing."""

    op: str
    left: "Leaf | Node | None"
    right: "Leaf | Node | None"


@dataclass(frozen=True)
class _Not:
    of: "Leaf | Node | None"


def scan(expression: str, strict_compat: bool = False) -> list[str]:
    """Words and signs of an expression."""
    out: list[str] = []
    text = expression.lower() if strict_compat else expression.lower().strip()
    for m in (_STRICT if strict_compat else _LOOSE).finditer(text):
        for t in _MEANING.get(m.lastgroup, (m[0].strip(),)):
            if strict_compat or t != AND or out[-1:] != [AND]:
                out.append(t)
    return out


class _Reader:
    """Precedence climbing. ``values`` are trees and words that wait for a partner, ``postfix`` is noted as they find one.

    An "or" before the expression joins what stands side by side without a sign: the next sign to its left takes the last two that wait.
    """

    def __init__(self, expression: str, as_you_type: bool, strict_compat: bool):
        self.tokens = [OR, *scan(expression, strict_compat)]
        self.at, self.values, self.postfix, self.as_you_type = 0, [], [], as_you_type
        self.last = next((t for t in reversed(self.tokens) if t not in (OR, AND, NOT, "(", ")")), None)
        while self.at < len(self.tokens):
            self.climb(1)
            self.at += 1  # a closing parenthesis that closes nothing

    def ahead(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def climb(self, weakest: int) -> None:
        self.operands()
        while (sign := self.ahead()) in _BINDS and _BINDS[sign] >= weakest:
            self.at += 1
            self.climb(_BINDS[sign] + 1)
            self.join(sign)

    def operands(self) -> None:
        while (t := self.ahead()) is not None and t != ")" and t not in _BINDS:
            self.at += 1
            if t == "(":
                self.climb(1)
                self.at += 1
            elif t == NOT:
                self.operands()
                self.postfix.append(NOT)
                x = self.values.pop() if self.values else None
                self.values.append(_Not(Leaf(x, x == self.last) if isinstance(x, str) else self.found(x)))
            else:
                self.postfix.append(t)
                self.values.append(t)

    def found(self, x) -> "Leaf | Node | None":
        if isinstance(x, _Not):
            raise QueryError("a word to leave out needs a word to find before it")
        return Leaf(x, self.as_you_type and x == self.last) if isinstance(x, str) else x

    def join(self, sign: str) -> None:
        self.postfix.append(sign)
        right = self.values.pop() if self.values else None
        left = self.values.pop() if self.values else None
        if sign == AND and isinstance(right, _Not):
            tree = Node("minus", self.found(left), right.of)
        elif sign == AND:
            tree = Node("and", self.found(left), self.found(right))
        else:
            parts = [x for x in (self.found(left), self.found(right)) if x]
            tree = Node("or", *parts) if len(parts) == 2 else parts[0] if parts else None
        self.values.append(tree)


def to_postfix(expression: str, strict_compat: bool = False) -> tuple[list[str], str | None]:
    """(operands and operators in postfix order, with the "or" before the expression; the last operand)."""
    read = _Reader(expression, True, strict_compat)
    return read.postfix, read.last


def parse(expression: str, as_you_type: bool = True, strict_compat: bool = False) -> Leaf | Node | None:
    """The tree of an expression, None if it has no operand.

    The operand equal to the last one is a prefix if ``as_you_type``; after "not" it always is.
    """
    return _Reader(expression, as_you_type, strict_compat).values[-1]


def leaves(tree) -> list[Leaf]:
    """Distinct leaves, left to right."""
    if tree is None:
        return []
    if isinstance(tree, Leaf):
        return [tree]
    return list(dict.fromkeys(leaves(tree.left) + leaves(tree.right)))


def evaluate(tree, found: dict[Leaf, set]) -> set:
    """The tree over sets of ids, for tests."""
    if tree is None:
        return set()
    if isinstance(tree, Leaf):
        return found.get(tree, set())
    a, b = evaluate(tree.left, found), evaluate(tree.right, found)
    return a & b if tree.op == "and" else a | b if tree.op == "or" else a - b


def places(tree, found: dict[Leaf, dict[int, float]]) -> dict[int, float]:
    """``_place`` for the postings of one expression, which are few: document -> place, from each leaf's documents and ranks."""
    if tree is None:
        return {}
    if isinstance(tree, Leaf):
        return found[tree]
    a, b = places(tree.left, found), places(tree.right, found)
    if tree.op == "or":
        return {d: p + float(_NEXT_LEAF * len(leaves(tree.left))) for d, p in b.items()} | a
    return {d: p for d, p in a.items() if (d in b) == (tree.op == "and")}


def leaf_words(leaf: Leaf, analyzer: Analyzer, language: str | None) -> list[tuple[str, bool]]:
    """(word, whether it is a beginning) for the tokens of a leaf; any of them makes a document match, only the last is a beginning."""
    tokens = analyzer.py_stem(py_tokenize(leaf.word, language))
    return [(t, leaf.prefix and k == len(tokens) - 1 and not ngram_size(language)) for k, t in enumerate(tokens)]


_NEXT_LEAF = 1 << 32


def _place(tree, places: dict[Leaf, Column]) -> Column:
    """Where a document stands in the result of ``tree``; null if it isn't in it.

    "And" and "minus" keep the left side's order; "or" puts the right side's documents after the left side's.
    """
    if tree is None:
        return F.lit(None).cast("double")
    if isinstance(tree, Leaf):
        return places[tree]
    a, b = _place(tree.left, places), _place(tree.right, places)
    if tree.op == "and":
        return F.when(b.isNotNull(), a)
    if tree.op == "minus":
        return F.when(b.isNull(), a)
    return F.coalesce(a, b + float(_NEXT_LEAF * len(leaves(tree.left))))


def leaf_keywords(spark: SparkSession, tree, analyzer: Analyzer) -> tuple[DataFrame, dict[Leaf, int]]:
    """Keywords of all leaves: ``query_id`` is the leaf's number. A word of several tokens is any of them; only its last is a prefix."""
    no = {leaf: i for i, leaf in enumerate(leaves(tree))}
    rows = []
    for leaf, i in no.items():
        tokens = analyzer.py_stem(py_tokenize(leaf.word, analyzer.language))
        rows += [(i, k, t, leaf.prefix and k == len(tokens) - 1) for k, t in enumerate(tokens)]
    return local_table(spark, rows, KEYWORDS), no


def search_boolean(
    index: IndexTables,
    expression: str,
    config: Config = Config(),
    as_you_type: bool = True,
    limit: int = 100,
    offset: int = 0,
    strict_compat: bool = False,
) -> DataFrame:
    """``doc_id, rank, hits``: the documents of an expression. Of each word the ``max_docs`` postings with most hits take part.

    The postings of all words are read once; a document's flags decide by the expression as one Column.
    """
    spark = index.postings.sparkSession
    tree = parse(expression, as_you_type, strict_compat)
    keywords, no = leaf_keywords(spark, tree, index.analyzer)
    terms = resolve(keywords, index.lexicon, config, language=index.analyzer.language).select(F.col("query_id").alias("leaf"), "term").distinct()
    capped = Window.partitionBy("leaf").orderBy(F.col("hit_count").desc(), "doc_id", "term")
    rows = index.postings.join(terms, "term").withColumn("r", F.row_number().over(capped)).where(F.col("r") <= config.max_docs)
    firsts = [F.min(F.when(F.col("leaf") == i, F.col("r"))).cast("double").alias(f"p{i}") for i in no.values()]
    docs = rows.groupBy("doc_id").agg(*(firsts or [F.lit(None).cast("double").alias("p0")]))
    place = _place(tree, {leaf: F.col(f"p{i}") for leaf, i in no.items()})
    found = docs.select("doc_id", place.alias("place")).where(F.col("place").isNotNull())
    whole = Window.partitionBy(F.lit(1))  # at most max_docs rows for each word
    ranked = found.withColumn("rank", F.row_number().over(whole.orderBy("place", "doc_id"))).withColumn("hits", F.count(F.lit(1)).over(whole))
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).select("doc_id", "rank", "hits")
