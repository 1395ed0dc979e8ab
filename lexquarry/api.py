"""The index as an object: build, change, look up, search."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.config import Config
from lexquarry.errors import IndexIOError, QueryError
from lexquarry.functions.analysis import edit_distance
from lexquarry.functions.languages import has_stemmer, ngram_size, supports
from lexquarry.functions.stopwords import default_stopwords
from lexquarry.operators import boolean, explain
from lexquarry.operators.build import IndexTables, field_text
from lexquarry.operators.highlight import Highlighter
from lexquarry.operators.resolve import analyze_phrase, analyze_queries, resolve
from lexquarry.operators.score import bm25_of, half_up, span_rows
from lexquarry.operators.score import search as ranked_search
from lexquarry.operators.snippet import Snippeter
from lexquarry.plans.session import cut, local_table, ship
from lexquarry.sources.store import Manifest, Store

_ID = re.compile(r"-?\d+")
_PREPARED = "doc_id bigint, texts array<string>, data string"


@dataclass(frozen=True)
class SearchResult:
    """``ids`` in rank order; ``hits`` of all pages together; ``scores`` of all hits, best first, None for boolean queries; ``documents`` None without a store."""

    ids: list[int]
    hits: int
    scores: dict[int, float] | None = None
    documents: dict[int, dict] | None = None
    df: DataFrame | None = field(default=None, repr=False, compare=False)

    @property
    def has_scores(self) -> bool:
        return self.scores is not None

    @property
    def has_documents(self) -> bool:
        return self.documents is not None

    def score(self, doc_id: int) -> float | None:
        return (self.scores or {}).get(doc_id)

    def document(self, doc_id: int) -> dict | None:
        return (self.documents or {}).get(doc_id)


def _id_of(value: Any) -> int:
    if isinstance(value, bool) or not (isinstance(value, int) or isinstance(value, str) and _ID.fullmatch(value)):
        raise QueryError(f"an id must be an integer, not {value!r}")
    return int(value)


def _text_of(value: Any) -> str:
    if value is None or value is False:
        return ""
    return "1" if value is True else str(value).strip()


class SearchIndex:
    """An index at ``path``; opened if it exists (its own language, store and analysis then hold), else created.

    Documents are dicts with ``id``, or DataFrames with a column ``id``; every other field but ``_meta`` is text, in order.
    ``stopwords`` and ``stem`` default to what the language has; give ``()`` and False to go without.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        language: str | None = None,
        force: bool = False,
        config: Config | None = None,
        readonly: bool = False,
        store: bool = False,
        stopwords: Iterable[str] | None = None,
        stem: bool | None = None,
    ):
        if readonly and force:
            raise QueryError("an index can't be opened read-only and overwritten")
        if language is not None and not supports(language):
            raise QueryError(f"unsupported language {language!r}")
        ship(spark)
        self.spark, self.path, self.config, self.readonly = spark, path, config or Config(), readonly
        self._store = Store(spark, path)
        self._staged = False
        self._tables: IndexTables | None = None
        if force:
            self._store.erase()
        if self._store.version():
            self._manifest = self._store.manifest()
        elif readonly:
            raise IndexIOError(f"no index at {path}")
        else:
            if self._store.files.exists() and (not self._store.files.is_directory() or self._store.files.names()):
                raise IndexIOError(f"{path} holds something that is no index")
            words = tuple(stopwords) if stopwords is not None else tuple(default_stopwords(language) if language else ())
            stems = has_stemmer(language) if stem is None else stem
            self._manifest = self._store.publish(Manifest(language, store, words, stems), 0)
        self._version = self._store.version()

    # --- lifecycle ---

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        try:
            s = Store(spark, path)
            return bool(s.version()) and bool(s.manifest())
        except Exception:  # noqa: BLE001 - whatever is there, it is no index
            return False

    @staticmethod
    def last_modified(spark: SparkSession, path: str) -> int:
        """Seconds since 1970, 0 if there is no index."""
        return Store(spark, path).manifest().modified_ms // 1000 if SearchIndex.exists(spark, path) else 0

    @classmethod
    def rebuild(
        cls, spark: SparkSession, path: str, fill: Callable[["SearchIndex"], None], language: str | None | bool = False, store: bool | None = None
    ) -> "SearchIndex":
        """Calls ``fill`` with an empty index at the same path and publishes it in one step; a failure leaves the old version.

        ``language`` False and ``store`` None keep what the old version had.
        """
        if not cls.exists(spark, path):
            index = cls(spark, path, None if language is False else language, store=bool(store))
        else:
            index = cls(spark, path)
        old = index._manifest
        if language is not False:
            if language is not None and not supports(language):
                raise QueryError(f"unsupported language {language!r}")
            words = tuple(default_stopwords(language)) if language else ()
            old = replace(old, language=language, stopwords=words, stem=has_stemmer(language))
        index._manifest = Manifest(old.language, old.store if store is None else store, old.stopwords, old.stem)
        index._tables, index._staged = None, True
        fill(index)
        index._staged = False
        index._commit(index._manifest)
        return index

    def snapshot_to(self, path: str) -> None:
        """Copies the current version to ``path``; its readers see it only when it is whole."""
        other = Store(self.spark, path)
        if other.files.exists() and not other.version() and (not other.files.is_directory() or other.files.names()):
            raise IndexIOError(f"{path} holds something that is no index")
        self._store.copy_to(self._manifest, other)
        other.publish(self._manifest, other.version())

    def close(self) -> None:
        self._tables = None

    def optimize(self) -> None:
        """Merges all segments into one."""
        self._writable()
        self._commit(self._store.compact(self._manifest))

    @property
    def segments(self) -> int:
        """Segments of the current version; each write adds one, ``optimize`` merges them."""
        return len(self._manifest.segments)

    @property
    def language(self) -> str | None:
        return self._manifest.language

    @property
    def document_store_enabled(self) -> bool:
        return self._manifest.store

    @property
    def tables(self) -> IndexTables:
        if self._tables is None:
            self._tables = self._store.tables(self._manifest)
        return self._tables

    def _writable(self) -> None:
        if self.readonly:
            raise IndexIOError("the index is read-only")

    def _commit(self, manifest: Manifest) -> None:
        if not self._staged:
            manifest = self._store.publish(manifest, self._version)
            self._version += 1
        self._manifest, self._tables = manifest, None

    # --- writing ---

    def _prepare(self, docs: DataFrame | list[dict], progress: Callable[[int, int], None] | None = None) -> DataFrame:
        if isinstance(docs, DataFrame):
            if "id" not in docs.columns:
                raise QueryError("documents need an id")
            texts = [field_text(docs, c) for c in docs.columns if c not in ("id", "_meta")]
            plain = F.trim(F.col("id").cast("string"))
            rows = docs.select(
                F.when(plain.rlike(r"^-?\d+$"), plain.cast("bigint")).alias("doc_id"),
                F.filter(F.array(*texts), lambda t: t != "").alias("texts") if texts else F.array().cast("array<string>").alias("texts"),
                F.to_json(F.struct(*[F.col(c) for c in docs.columns])).alias("data"),
            )
            return rows
        out = []
        for d in docs:
            if "id" not in d:
                raise QueryError("documents need an id")
            texts = [t for k, v in d.items() if k not in ("id", "_meta") and (t := _text_of(v))]
            out.append((_id_of(d["id"]), texts, json.dumps(d, ensure_ascii=False)))
            if progress:
                progress(len(out), len(docs))
        return local_table(self.spark, out, _PREPARED)

    def _known(self, ids: DataFrame) -> DataFrame:
        if not self._manifest.total_documents:
            return ids.limit(0)
        return ids.join(self._store.documents(self._manifest).select("doc_id"), "doc_id", "left_semi")

    @staticmethod
    def _some(ids: DataFrame, n: int = 10) -> str:
        return ", ".join(str(r[0]) for r in ids.orderBy("doc_id").limit(n).collect())

    def insert(self, doc: dict) -> None:
        self.insert_many([doc])

    def insert_many(self, docs: DataFrame | Iterable[dict], progress: Callable[[int, int], None] | None = None) -> None:
        """Adds documents; fails as a whole if an id is missing, repeated or already there.

        ``progress(done, total)`` is called for each document of a list as it is prepared, for a DataFrame once, when all are written.
        """
        self._writable()
        if not isinstance(docs, DataFrame):
            docs = list(docs)
        rows = self._prepare(docs, progress)
        bad = rows.groupBy("doc_id").count().where("doc_id is null or count > 1").orderBy("doc_id").limit(10).collect()
        if bad and bad[0]["doc_id"] is None:
            raise QueryError("every document needs an integer id")
        if bad:
            raise QueryError("ids given twice: " + ", ".join(str(r["doc_id"]) for r in bad))
        if self._manifest.total_documents and (s := self._some(self._known(rows.select("doc_id")))):
            raise QueryError(f"ids already there: {s}")
        before = self._manifest.total_documents
        self._commit(self._store.write_segment(self._manifest, rows, None))
        n = self._manifest.total_documents - before
        if progress and n and isinstance(docs, DataFrame):
            progress(n, n)

    def update(self, doc: dict) -> None:
        self.update_many([doc])

    def update_many(self, docs: DataFrame | Iterable[dict]) -> None:
        """Replaces documents; fails as a whole, naming them, if some don't exist."""
        self._replace(docs, must_exist=True)

    def upsert(self, doc: dict) -> None:
        self.upsert_many([doc])

    def upsert_many(self, docs: DataFrame | Iterable[dict]) -> None:
        """Adds or replaces documents. Of a repeated id one document is kept: the last of a list, the one with the greatest content of a DataFrame."""
        self._replace(docs, must_exist=False)

    def _replace(self, docs: DataFrame | Iterable[dict], must_exist: bool) -> None:
        self._writable()
        if not isinstance(docs, DataFrame):
            docs = list({str(d.get("id", f"missing-{i}")): d for i, d in enumerate(docs)}.values())
        rows = self._prepare(docs)
        if isinstance(docs, DataFrame) and not rows.where(F.col("doc_id").isNull()).isEmpty():
            raise QueryError("every document needs an integer id")
        rows = rows.groupBy("doc_id").agg(F.max(F.struct("data", "texts")).alias("d")).select("doc_id", "d.texts", "d.data")
        if must_exist:
            missing = rows.join(self._store.documents(self._manifest).select("doc_id"), "doc_id", "left_anti").select("doc_id")
            if s := self._some(missing):
                raise QueryError(f"no such ids: {s}")
        self._commit(self._store.write_segment(self._manifest, rows, self._known(rows.select("doc_id"))))

    def delete(self, doc_id: int) -> None:
        self.delete_many([doc_id])

    def delete_many(self, ids: DataFrame | Iterable[int]) -> None:
        """Deletes documents; ids that don't exist are ignored. A DataFrame has a column ``doc_id`` or ``id``."""
        self._writable()
        self._commit(self._store.write_segment(self._manifest, None, self._known(self._ids(ids).distinct())))

    def clear(self) -> None:
        """Deletes all documents; language, store and analysis stay."""
        self._writable()
        self._commit(replace(self._manifest, segments=(), deletes={}, total_documents=0, total_length=0))

    # --- lookups ---

    def _ids(self, ids: DataFrame | Iterable[int]) -> DataFrame:
        if isinstance(ids, DataFrame):
            name = "doc_id" if "doc_id" in ids.columns else "id"
            return ids.select(F.col(name).cast("bigint").alias("doc_id")).where(F.col("doc_id").isNotNull())
        return local_table(self.spark, [(_id_of(i),) for i in ids], "doc_id bigint")

    def has(self, doc_id: int) -> bool:
        return self.has_many([doc_id])[doc_id]

    def has_many(self, ids: Iterable[int]) -> dict[int, bool]:
        wanted = [_id_of(i) for i in ids]
        there = {r[0] for r in self._known(self._ids(wanted)).collect()} if wanted else set()
        return {i: i in there for i in wanted}

    def has_table(self, ids: DataFrame) -> DataFrame:
        """``doc_id, found`` for a table of ids."""
        there = self._store.documents(self._manifest).select("doc_id").withColumn("found", F.lit(True))
        return self._ids(ids).join(there, "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(False)).alias("found"))

    def count(self) -> int:
        return self._manifest.total_documents

    def _stored(self) -> DataFrame:
        if not self._manifest.store:
            raise QueryError("the index keeps no documents")
        return self._store.documents(self._manifest).select("doc_id", "data")

    def get(self, doc_id: int) -> dict | None:
        return self.get_many([doc_id]).get(doc_id)

    def get_many(self, ids: Iterable[int]) -> dict[int, dict]:
        """Documents by id; ids that don't exist are left out."""
        wanted = [_id_of(i) for i in ids]
        found = {r[0]: json.loads(r[1]) for r in self.get_table(self._ids(wanted)).collect()}
        return {i: found[i] for i in wanted if i in found}

    def get_table(self, ids: DataFrame) -> DataFrame:
        """``doc_id, data`` for a table of ids."""
        return self._stored().join(self._ids(ids), "doc_id", "left_semi")

    def _hydrate(self, ids: list[int]) -> dict[int, dict] | None:
        if not self._manifest.store:
            return None
        return self.get_many(ids) if ids else {}

    # --- searching ---

    def _lexicon_near(self, words: list[str], starts: list[str]) -> IndexTables:
        """The tables with a lexicon of these words and of the terms with these beginnings, both filters that Parquet can use."""
        term = F.col("term")
        wanted = term.isin(words)
        for s in starts:
            wanted = wanted | term.startswith(s)
        return replace(self.tables, lexicon=self.tables.lexicon.where(wanted))

    def _starts(self, kws: list[str], as_you_type: bool, fuzzy: bool) -> list[str]:
        last = kws[-1:] if as_you_type and not ngram_size(self.language) else []
        return last + ([kw[: self.config.fuzzy_prefix_length] for kw in kws] if fuzzy else [])

    def _terms_of(self, words: list[tuple[str, bool]], fuzzy: bool = False) -> list[list]:
        """The terms of each (word, whether it is a beginning), as ``resolve`` finds them, by one job, or by two with fuzzy matches.

        Filters that Parquet can use; what comes to the driver is at most ``fuzzy_max_expansions`` terms for each word.
        """
        lex, cap, term = self.tables.lexicon, self.config.fuzzy_max_expansions, F.col("term")
        whole = sorted({w for w, start in words if not start})
        starts = sorted({w for w, start in words if start})
        columns = ["term", "num_hits", "num_docs"]

        def rows(parts: list[tuple[str, DataFrame]]) -> dict[str, list]:
            found: dict[str, list] = {}
            tagged = [df.select(F.lit(tag).alias("of"), *columns) for tag, df in parts]
            for r in reduce(DataFrame.unionByName, tagged).collect() if tagged else []:
                found.setdefault(r["of"], []).append(r)
            return found

        parts = [("=", lex.where(term.isin(whole)))] if whole else []
        for w in starts:
            parts.append(("<" + w, lex.where(term.startswith(w)).orderBy(F.char_length("term"), F.col("num_hits").desc(), "term").limit(cap)))
        found = rows(parts)
        exact = {r["term"]: r for r in found.get("=", [])}
        by_length = lambda r: (len(r["term"]), -r["num_hits"], r["term"])
        out = [sorted(found.get("<" + w, []), key=by_length) if start else [exact[w]] if w in exact else [] for w, start in words]
        unknown = sorted({w for (w, _), own in zip(words, out) if not own}) if fuzzy else []
        d, size = self.config.fuzzy_distance, F.char_length("term")
        near = rows(
            [
                (w, lex.where(term.startswith(w[: self.config.fuzzy_prefix_length]) & size.between(max(1, len(w) - d), len(w) + d)).orderBy(F.col("num_hits").desc(), "term").limit(cap))
                for w in unknown
            ]
        )
        for i, (w, _) in enumerate(words):
            if w in near:
                close = [(edit_distance(r["term"], w), r) for r in near[w]]
                out[i] = [r for k, r in sorted(((k, r) for k, r in close if k <= d), key=lambda x: (x[0], -x[1]["num_hits"], x[1]["term"]))]
        return out

    def _postings_of(self, terms: list[list], close_first: bool = False) -> list[list]:
        """The ``max_docs`` best postings of each list of terms, best first, by one job; at most that many for each come to the driver."""
        rows = [(i, r["term"], k) for i, own in enumerate(terms) for k, r in enumerate(own)]
        out: list[list] = [[] for _ in terms]
        if rows:
            wanted = F.broadcast(local_table(self.spark, rows, "of int, term string, rnk int"))  # fuzzy_max_expansions for each word
            order = [F.col("hit_count").desc(), F.col("rnk"), F.col("doc_id")]
            best = Window.partitionBy("of").orderBy(*([order[1], order[0], order[2]] if close_first else order))
            hits = self.tables.postings.where(F.col("term").isin(sorted({r[1] for r in rows}))).join(wanted, "term")
            for r in sorted(hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= self.config.max_docs).collect(), key=lambda r: r["r"]):
                out[r["of"]].append(r)
        return out

    def search(self, phrase: str, fuzzy: bool = False, as_you_type: bool = True, limit: int = 100, offset: int = 0) -> SearchResult:
        """One phrase, by few small jobs: its terms, their best postings and, for several keywords, the positions in the best documents.

        The lists that come to the driver are bounded by the configuration whatever the index's size; ``search_batch`` answers tables of queries.
        """
        kws = analyze_phrase(phrase, self.tables.analyzer)["filtered"]
        prefixed = as_you_type and not ngram_size(self.language)
        terms = self._terms_of([(kw, prefixed and i == len(kws) - 1) for i, kw in enumerate(kws)], fuzzy)
        postings = self._postings_of(terms, fuzzy)
        n = self._manifest.total_documents
        scores = bm25_of(postings, [sum(r["num_docs"] for r in own) for own in terms], n, self._manifest.total_length / n if n else 0.0, self.config)
        ranked = sorted(scores, key=lambda d: (-half_up(scores[d]), d))
        groups = {r["term"]: i for i, own in enumerate(postings) for r in own}
        if self.config.proximity_boost > 0 and sum(map(bool, postings)) > 1:
            for d, span in self._spans(groups, sum(map(bool, postings)), ranked[: max((offset + max(limit, 1)) * 5, 200)]).items():
                scores[d] /= 1 + self.config.proximity_boost * span
        scores = {d: half_up(x) for d, x in scores.items()}
        ranked = sorted(scores, key=lambda d: (-scores[d], d))
        ids = ranked[offset : offset + limit]
        page = [(d, scores[d], offset + i + 1, len(scores)) for i, d in enumerate(ids)]
        df = local_table(self.spark, page, "doc_id bigint, score double, rank int, hits bigint")
        return SearchResult(ids, len(scores), {d: scores[d] for d in ranked}, self._hydrate(ids), df)

    def _spans(self, groups: dict[str, int], needed: int, ids: list[int]) -> dict[int, int]:
        """The smallest window of all keywords in each of the documents that hold them all."""
        if len(set(groups.values())) < needed or not ids:
            return {}
        rows = self.tables.positions.where(F.col("term").isin(sorted(groups)) & F.col("doc_id").isin(ids))
        of = F.broadcast(local_table(self.spark, list(groups.items()), "term string, g int"))  # the terms of one phrase
        return {r["doc_id"]: r["min_span"] for r in span_rows(rows.join(of, "term"), ["doc_id"], sorted(set(groups.values()))).collect()}

    def search_batch(self, queries: DataFrame, fuzzy: bool = False, as_you_type: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
        """``query_id, doc_id, score, rank, hits`` for a table ``query_id, phrase``, in one plan."""
        t = self.tables
        keywords = analyze_queries(queries, t.analyzer, as_you_type)
        longest = keywords.agg(F.max("kw_idx")).first()[0]
        terms = cut(resolve(keywords, t.lexicon, self.config, fuzzy, t.analyzer.language))  # needed several times, at most fuzzy_max_expansions for each keyword
        return ranked_search(t, terms, self.config, fuzzy, limit, offset, (longest or 0) + 1)

    def search_boolean(
        self, phrase: str, as_you_type: bool = True, limit: int = 100, offset: int = 0, strict_compat: bool = False
    ) -> SearchResult:
        tree = boolean.parse(phrase, as_you_type, strict_compat)
        leaves = boolean.leaves(tree)
        words = [(i, w) for i, leaf in enumerate(leaves) for w in boolean.leaf_words(leaf, self.tables.analyzer, self.language)]
        terms = self._terms_of([w for _, w in words])
        of_leaf = [list({r["term"]: r for (j, _), own in zip(words, terms) if j == i for r in own}.values()) for i in range(len(leaves))]
        for own in of_leaf:  # of equal hits in one document, the term's spelling decides which posting is cut
            own.sort(key=lambda r: r["term"])
        found = {}
        for leaf, rows in zip(leaves, self._postings_of(of_leaf)):
            found[leaf] = {}
            for r in sorted(rows, key=lambda r: r["r"]):
                found[leaf].setdefault(r["doc_id"], float(r["r"]))
        places = boolean.places(tree, found)
        ranked = sorted(places, key=lambda d: (places[d], d))
        ids = ranked[offset : offset + limit]
        page = [(d, offset + i + 1, len(ranked)) for i, d in enumerate(ids)]
        return SearchResult(ids, len(ranked), None, self._hydrate(ids), local_table(self.spark, page, "doc_id bigint, rank int, hits bigint"))

    def inspect_query(self, phrase: str, fuzzy: bool = False, as_you_type: bool = True) -> dict:
        kws = analyze_phrase(phrase, self.tables.analyzer)["filtered"]
        return explain.inspect_query(self._lexicon_near(kws, self._starts(kws, as_you_type, fuzzy)), phrase, self.config, fuzzy, as_you_type)

    def snippeter(self, window_size: int = 200, max_snippets: int = 1, ellipsis: str = "…") -> Snippeter:
        return Snippeter(window_size, max_snippets, ellipsis, self.language)

    def highlighter(self, open: str = "<mark>", close: str = "</mark>", as_you_type: bool = True) -> Highlighter:
        return Highlighter(open, close, as_you_type, self.language)
