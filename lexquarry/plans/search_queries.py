"""Queries of the search engine over the whole tables documents and part, and their SQL."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.config import Config
from lexquarry.errors import IndexIOError, QueryError
from lexquarry.functions import languages as lang
from lexquarry.functions.analysis import ngrams, token_offsets, tokenize
from lexquarry.functions.stopwords import remove_stopwords
from lexquarry.operators.boolean import search_boolean
from lexquarry.operators.build import Analyzer, IndexTables, build_index, document_tokens, token_rows
from lexquarry.operators.explain import explain_table
from lexquarry.operators.highlight import Highlighter
from lexquarry.operators.resolve import analyze_queries, keyword_table, resolve
from lexquarry.operators.score import bm25, fetch, min_spans, search
from lexquarry.operators.snippet import Snippeter, beginning_column
from lexquarry.plans.session import cut, ensure_checkpoint_dir, local_table, table

#: Stopwords of the queries that have a fixed list on both sides.
STOPWORDS = ("the", "of", "a", "and", "de", "la", "der", "die", "le", "les", "el", "il", "het", "een", "o", "in")
PHRASES = ("cold engine", "the final race", "young director mechanic", "engine", "lettre disparue", "race race")
BATCH = tuple(enumerate(PHRASES))


def _index(spark: SparkSession, d: str, analyzer: Analyzer = Analyzer(), keep: bool = False) -> IndexTables:
    return build_index(table(spark, d, "documents"), "doc_id", ["text"], analyzer, keep)


def _parts(spark: SparkSession, d: str) -> IndexTables:
    return build_index(table(spark, d, "part"), "p_partkey", ["p_name", "p_type"])


def _rows(df: DataFrame, column) -> DataFrame:
    return df.select("doc_id", F.posexplode(column).alias("position", "term"))


# --- analysis ---


def tokens(spark, d):
    return _rows(table(spark, d, "documents"), tokenize(F.col("text")))


def ngram_tokens(spark, d):
    return _rows(table(spark, d, "documents"), tokenize(F.col("text"), "ja"))


def ngram_tokens_zh(spark, d):
    return _rows(table(spark, d, "documents"), tokenize(F.col("text"), "zh"))


def ngram_tokens_ko(spark, d):
    return _rows(table(spark, d, "documents"), tokenize(F.col("text"), "ko"))


def ngram_tokens_th(spark, d):
    """Trigrams without single characters."""
    return _rows(table(spark, d, "documents"), tokenize(F.col("text"), "th"))


def _with_offsets(df: DataFrame, column) -> DataFrame:
    return df.select("doc_id", F.posexplode(column).alias("position", "t")).select("doc_id", "position", "t.token", "t.offset")


def tokens_with_offsets(spark, d):
    return _with_offsets(table(spark, d, "documents"), token_offsets(F.col("text")))


def ngrams_with_offsets(spark, d):
    return _with_offsets(table(spark, d, "documents"), token_offsets(F.col("title"), "ja"))


def ngrams_and_characters_with_offsets(spark, d):
    return _with_offsets(table(spark, d, "documents"), token_offsets(F.col("title"), "ja", True))


def title_bigrams(spark, d):
    return _rows(table(spark, d, "documents"), ngrams(F.lower("title"), 2))


def title_trigrams(spark, d):
    return _rows(table(spark, d, "documents"), ngrams(F.lower("title"), 3))


def stopword_filter(spark, d):
    return _rows(table(spark, d, "documents"), remove_stopwords(tokenize(F.col("text")), STOPWORDS))


def query_analysis(spark, d):
    queries = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("title").alias("phrase"))
    return analyze_queries(queries, Analyzer(stopwords=STOPWORDS))


# --- index ---


def postings(spark, d):
    return _index(spark, d).postings


def lexicon(spark, d):
    return _index(spark, d).lexicon


def doc_lengths(spark, d):
    return _index(spark, d).doc_lengths


def corpus_stats(spark, d):
    s = _index(spark, d).stats
    return s.select("total_documents", F.round("avg_doc_length", 6).alias("avg_doc_length"))


def positions(spark, d):
    return _index(spark, d).positions


def multi_field_positions(spark, d):
    return _parts(spark, d).positions


# --- terms of keywords ---


def _terms(spark, d, phrases, fuzzy=False, config=Config()) -> DataFrame:
    return resolve(keyword_table(spark, list(phrases)), _index(spark, d).lexicon, config, fuzzy)


def exact_terms(spark, d):
    keywords = keyword_table(spark, ["engine race letter nosuchword"], as_you_type=False)
    return resolve(keywords, _index(spark, d).lexicon)


def prefix_terms(spark, d):
    return _terms(spark, d, ["eng", "the ra", "sto"])


def fuzzy_terms(spark, d):
    return _terms(spark, d, ["enginne", "mecanic racce", "dirrector"], True)


def levenshtein_terms(spark, d):
    """The distance of every term, in code points."""
    return _index(spark, d).lexicon.select("term", F.levenshtein("term", F.lit("engine")).alias("distance"))


# --- ranking ---


def _ranked(spark, d, phrases=PHRASES[:1], fuzzy=False, as_you_type=False, config=Config(proximity_boost=0.0), limit=100, offset=0, index=None):
    index = index or _index(spark, d, keep=True)
    keywords = keyword_table(spark, list(phrases), index.analyzer, as_you_type)
    terms = resolve(keywords, index.lexicon, config, fuzzy)
    return search(index, terms, config, fuzzy, limit, offset, max(len(p.split()) for p in phrases))


def bm25_exact(spark, d):
    return _ranked(spark, d, ["engine"])


def bm25_multi(spark, d):
    return _ranked(spark, d, ["young director mechanic"])


def bm25_prefix(spark, d):
    return _ranked(spark, d, ["cold eng"], as_you_type=True)


def bm25_fuzzy(spark, d):
    return _ranked(spark, d, ["cold enginne"], fuzzy=True)


def bm25_maxdocs(spark, d):
    return _ranked(spark, d, ["cold engine"], config=Config(max_docs=20, proximity_boost=0.0))


def bm25_page(spark, d):
    return _ranked(spark, d, ["cold engine"], limit=10, offset=20)


def bm25_tuned(spark, d):
    return _ranked(spark, d, ["cold engine"], config=Config(k1=2.0, b=0.3, proximity_boost=0.0))


def bm25_proximity(spark, d):
    return _ranked(spark, d, ["cold engine"], config=Config())


def bm25_batch(spark, d):
    """All phrases at once, from a table, the last word of each as a beginning, with proximity."""
    index = _index(spark, d, keep=True)
    queries = local_table(spark, list(BATCH), "query_id bigint, phrase string")
    keywords = analyze_queries(queries)
    return search(index, resolve(keywords, index.lexicon), Config(), False, 10, 0, 3)


def part_search(spark, d):
    """The name of every part as a query over all parts, the best three for each.

    Every part that shares a word with a name is scored, without a cap. Equal names have equal answers, so a name is searched once.
    """
    parts = _parts(spark, d)
    named = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("query_id"), F.col("p_name").alias("phrase"))
    names = named.groupBy("phrase").agg(F.min("query_id").alias("first"))
    terms = resolve(analyze_queries(names.select(F.col("first").alias("query_id"), "phrase"), as_you_type=False), parts.lexicon)
    fetched = cut(fetch(parts, terms, Config(), False, no_limit=True))
    longest = fetched.agg(F.max("kw_idx")).first()[0] or 0
    page = search(parts, terms, Config(), False, 3, 0, longest + 1, fetched)
    asked = named.join(names, "phrase").join(page.withColumnRenamed("query_id", "first"), "first")
    return asked.select("query_id", "doc_id", "score", "rank", "hits")


def proximity_spans(spark, d):
    index = _index(spark, d)
    terms = resolve(keyword_table(spark, ["cold engine"], as_you_type=False), index.lexicon)
    fetched = fetch(index, terms, Config(), False)
    docs = bm25(index, fetched, Config())
    return min_spans(index, fetched, docs, 2)


# --- boolean ---


def _boolean(expression, as_you_type, limit, offset, spark, d):
    return search_boolean(_index(spark, d), expression, Config(), as_you_type, limit, offset)


#: name -> (expression, last word as a beginning, limit, offset)
BOOLEANS = {
    "bool_and": ("cold engine", False, 100, 0),
    "bool_or": ("engine or race", False, 1000, 0),
    "bool_not": ("engine -race", False, 1000, 0),
    "bool_group": ("(engine or race)&letter -promise", False, 1000, 0),
    "bool_prefix": ("cold eng", True, 1000, 0),
    "bool_page": ("engine or race", False, 10, 15),
}


# --- explain and presentation ---


def inspect_query(spark, d):
    return explain_table(_index(spark, d), "cold enginne rac", Config(), True)


def highlight(spark, d):
    return table(spark, d, "documents").select("doc_id", Highlighter().column("cold eng", F.col("text")).alias("marked"))


def snippet_beginning(spark, d):
    return table(spark, d, "documents").select("doc_id", beginning_column(F.col("text"), 120).alias("snippet"))


def snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", Snippeter(120, 2).column("cold engine", F.col("text")).alias("snippet"))


def snippet_one(spark, d):
    """One excerpt of each text, by a whole word's hits."""
    return table(spark, d, "documents").select("doc_id", Snippeter(120).column("cold engine", F.col("text")).alias("snippet"))


def stems(spark, d):
    """The English stem of every distinct term."""
    from lexquarry.functions.stemmers import stem_column

    return _index(spark, d).lexicon.select("term", stem_column(F.col("term"), "en").alias("stem"))


def bm25_stemmed(spark, d):
    index = _index(spark, d, Analyzer("en", STOPWORDS, True), keep=True)
    return _ranked(spark, d, ["racing engines"], index=index, as_you_type=True, config=Config())


def language_table(spark, d):
    return local_table(spark, lang.table_rows(), "tag string, name string, has_stopwords boolean, has_stemmer boolean, ngram_size int")


def language_tags(spark, d):
    """Every language and the length of its n-grams."""
    return local_table(spark, [(r[0], r[4]) for r in lang.table_rows()], "tag string, ngram_size int")


def stemmed_positions(spark, d):
    a = Analyzer("en", STOPWORDS, True)
    return token_rows(document_tokens(table(spark, d, "documents"), "doc_id", ["title", "body"], a), a)


# --- an index on disk ---


def _stored(spark: SparkSession):
    """A new index with a document store in the session's shared folder."""
    from lexquarry.api import SearchIndex

    return SearchIndex(spark, f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", store=True)


def _fields(spark, d, *columns: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), *columns)


def _refuses(act) -> int:
    try:
        act()
    except (IndexIOError, QueryError):
        return 1
    return 0


def lifecycle(spark, d):
    """What an index says after each step of its life: created, opened, written, read only, rebuilt, copied, cleared, overwritten."""
    from lexquarry.api import SearchIndex

    home = f"{ensure_checkpoint_dir(spark)}/life-{uuid.uuid4().hex}"
    path, docs, seen = f"{home}/index", _fields(spark, d, "title", "source"), []
    say = lambda step, value: seen.append((step, int(value)))
    say("exists before", SearchIndex.exists(spark, path))
    say("modified before", SearchIndex.last_modified(spark, path))
    say("read only without an index", _refuses(lambda: SearchIndex(spark, path, readonly=True)))
    index = SearchIndex(spark, path, language="ja", store=True, stopwords=())
    say("exists after", SearchIndex.exists(spark, path))
    say("modified after", SearchIndex.last_modified(spark, path) > 1_000_000_000)
    index.insert_many(docs)
    say("count", index.count())
    index.insert({"id": -1, "title": "one more engine"})
    say("count after insert", index.count())
    say("same id again", _refuses(lambda: index.insert_many([{"id": -2, "title": "x"}, {"id": -1, "title": "y"}])))
    say("without an id", _refuses(lambda: index.insert({"title": "x"})))
    say("update of none", _refuses(lambda: index.update({"id": -3, "title": "x"})))
    say("count after failures", index.count())
    say("version after failures", SearchIndex(spark, path).count())
    index.close()
    again = SearchIndex(spark, path, readonly=True)
    say("language kept", again.language == "ja")
    say("store kept", again.document_store_enabled)
    say("write when read only", _refuses(lambda: again.insert({"id": -4, "title": "x"})))
    say("stored title", again.get(-1)["title"] == "one more engine")
    index.snapshot_to(f"{home}/copy")
    index.delete_many([-1])
    say("count after delete", index.count())
    say("copy", SearchIndex(spark, f"{home}/copy", readonly=True).count())
    say("copy's lexicon", SearchIndex(spark, f"{home}/copy", readonly=True).tables.lexicon.agg(F.sum("num_hits")).first()[0])
    rebuilt = SearchIndex.rebuild(spark, path, lambda i: i.insert_many(docs.where("source = 'reelnotes'")))
    say("rebuilt", rebuilt.count())
    say("language after rebuild", rebuilt.language == "ja")

    def fail(i):
        i.insert({"id": -5, "title": "x"})
        raise QueryError("on purpose")

    say("rebuild that fails", _refuses(lambda: SearchIndex.rebuild(spark, path, fail)))
    say("kept after it", SearchIndex(spark, path).count())
    rebuilt = SearchIndex(spark, path)
    rebuilt.clear()
    say("cleared", rebuilt.count())
    say("terms of nothing", rebuilt.tables.lexicon.count())
    say("language after clear", rebuilt.language == "ja")
    say("overwritten", SearchIndex(spark, f"{home}/copy", force=True).count())
    docs.limit(1).write.parquet(f"{home}/other")
    say("no index to overwrite", _refuses(lambda: SearchIndex(spark, f"{home}/other", force=True)))
    return local_table(spark, seen, "step string, value bigint")


def single_searches(spark, d):
    """Phrases one by one: every hit with its score, and how many there are."""
    index = _stored(spark)
    index.insert_many(_fields(spark, d, "title", "body"))
    rows = []
    for q, phrase in BATCH:
        found = index.search(phrase, as_you_type=False, limit=5)
        rows += [(q, doc, score, found.hits, doc in found.ids) for doc, score in found.scores.items()]
    return local_table(spark, rows, "query_id bigint, doc_id bigint, score double, hits bigint, shown boolean")


def single_boolean(spark, d):
    index = _stored(spark)
    index.insert_many(_fields(spark, d, "title", "body"))
    rows = []
    for q, (expression, as_you_type, limit, offset) in enumerate(BOOLEANS.values()):
        found = index.search_boolean(expression, as_you_type, limit, offset)
        rows += [(q, doc, offset + i + 1, found.hits) for i, doc in enumerate(found.ids)]
    return local_table(spark, rows, "query_id int, doc_id bigint, rank int, hits bigint")


def inspect_nested(spark, d):
    """The nested record of a query, token by token."""
    index = _stored(spark)
    index.insert_many(_fields(spark, d, "title", "body"))
    said = index.inspect_query("cold enginne rac", True)
    rows = [(t["raw"], t["processed"], t["is_last"], t["match_type"], t["num_hits"], t["num_docs"], len(t["wordlist_rows"])) for t in said["tokens"]]
    rows.append((" ".join(said["boolean_postfix"]), " ".join(said["raw_tokens"]), said["stemmer_active"], "query", said["index_info"]["total_documents"], 0, 0))
    return local_table(spark, rows, "raw string, processed string, is_last boolean, match_type string, num_hits bigint, num_docs bigint, n_terms int")


def insert_many(spark, d):
    index = _stored(spark)
    index.insert_many(_fields(spark, d, "title", "body"))
    return index.tables.lexicon


def upsert_many(spark, d):
    """Titles first, then all documents again with their bodies, and the parts as further documents."""
    index = _stored(spark)
    index.insert_many(_fields(spark, d, "title"))
    parts = table(spark, d, "part").select((-F.col("p_partkey")).alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("body"))
    index.upsert_many(_fields(spark, d, "title", "body").unionByName(parts))
    return index.tables.lexicon


def update_many(spark, d):
    """The documents without a label of their language lose their bodies."""
    index = _stored(spark)
    index.insert_many(_fields(spark, d, "title", "body"))
    index.update_many(_fields(spark, d, "title", "lang").where(F.col("lang").isNull()).select("id", "title"))
    return index.tables.lexicon


def delete_many(spark, d):
    """Without the documents of one source; ids that don't exist are ignored."""
    index = _stored(spark)
    index.insert_many(_fields(spark, d, "title", "body"))
    gone = table(spark, d, "documents").where("source = 'reelnotes'").select("doc_id")
    index.delete_many(gone.union(gone.select(-F.col("doc_id"))))
    s = index.tables.stats.select(F.lit("").alias("term"), F.lit(0).cast("bigint").alias("num_hits"), F.col("total_documents").alias("num_docs"))
    return index.tables.lexicon.unionByName(s)


def has_many(spark, d):
    index = _stored(spark)
    index.insert_many(_fields(spark, d, "title"))
    return index.has_table(table(spark, d, "docstore").select("doc_id").distinct())


def get_many(spark, d):
    index = _stored(spark)
    index.insert_many(_fields(spark, d, "title", "source"))
    found = index.get_table(table(spark, d, "docstore").select("doc_id").distinct())
    return found.select("doc_id", F.get_json_object("data", "$.title").alias("title"), F.get_json_object("data", "$.source").alias("source"))


def hydrated_search(spark, d):
    index = _stored(spark)
    index.insert_many(_fields(spark, d, "title", "body"))
    queries = local_table(spark, list(BATCH), "query_id bigint, phrase string")
    page = index.search_batch(queries, as_you_type=False, limit=5)
    stored = index.get_table(page.select("doc_id").distinct())
    return page.join(stored, "doc_id").select("query_id", "doc_id", "rank", "hits", F.get_json_object("data", "$.title").alias("title"))


def metadata_kept(spark, d):
    """Metadata are stored and not indexed."""
    index = _stored(spark)
    docs = _fields(spark, d, "title", "source").select("id", "title", F.struct("source").alias("_meta"))
    index.insert_many(docs)
    found = index.tables.doc_lengths.join(index.get_table(docs.select("id")), "doc_id")
    return found.select("doc_id", "length", F.get_json_object("data", "$._meta.source").alias("source"))


QUERIES = {
    f.__name__: f
    for f in (
        tokens, ngram_tokens, ngram_tokens_zh, ngram_tokens_ko, ngram_tokens_th, tokens_with_offsets, ngrams_with_offsets,
        ngrams_and_characters_with_offsets, title_bigrams, title_trigrams, stopword_filter, query_analysis, postings, lexicon, doc_lengths, corpus_stats,
        positions, multi_field_positions, exact_terms, prefix_terms, fuzzy_terms, levenshtein_terms, bm25_exact, bm25_multi, bm25_prefix,
        bm25_fuzzy, bm25_maxdocs, bm25_page, bm25_tuned, bm25_proximity, bm25_batch, part_search, proximity_spans, inspect_query, highlight,
        snippet_beginning, snippet, snippet_one, lifecycle, single_searches, single_boolean, inspect_nested, stems, bm25_stemmed, language_table, language_tags, stemmed_positions, insert_many,
        upsert_many, update_many, delete_many, has_many, get_many, hydrated_search, metadata_kept,
    )
} | {name: partial(_boolean, *args) for name, args in BOOLEANS.items()}


# --- SQL ---

_BOTH = "coalesce(title, '') || ' ' || coalesce(body, '')"

_RE = r"[\p{L}\p{N}\p{Pc}@]+"


def _listed(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _tok(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""
tl as (select {key} doc_id, regexp_extract_all(lower(coalesce({text}, '')), '{_RE}') l from {source}),
tok as (select doc_id, cast(unnest(range(len(l))) as integer) p, unnest(l) term from tl)"""


def _built(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""{_tok(source, key, text)},
post as (select term, doc_id, count(*) hit_count from tok group by 1, 2),
lex as (select term, cast(sum(hit_count) as bigint) num_hits, count(*) num_docs from post group by 1),
len as (select doc_id, cast(len(l) as bigint) length from tl),
st as (select count(*) total_documents, avg(length) avg_doc_length from len)"""


def _grams(n: int) -> str:
    return f"""
with t as (select doc_id, lower(title) x from documents where title is not null),
g as (select doc_id, x, cast(unnest(range(greatest(0, length(x) - {n - 1}))) as integer) position from t)
select doc_id, position, substr(x, position + 1, {n}) term from g"""


def _keywords(phrases, as_you_type: bool) -> str:
    rows = []
    for q, p in enumerate(phrases):
        words = p.split()
        rows += [f"({q}, {i}, '{w}', {as_you_type and i == len(words) - 1})" for i, w in enumerate(words)]
    return f"kws as (select cast(a as bigint) query_id, cast(b as integer) kw_idx, c kw, d is_last from (values {', '.join(rows)}) v(a, b, c, d))"


def _expanded(fuzzy: bool, cap: int = 50, dist: int = 2, head: int = 3) -> str:
    """Keywords are ASCII; other letters of terms count as one that no keyword has, as DuckDB's distance counts bytes."""
    found = f"""
ex as (select kws.*, term, num_hits, num_docs, cast(null as integer) distance, 1 rnk from kws join lex on lex.term = kws.kw where not is_last),
pre as (select kws.*, term, num_hits, num_docs, cast(null as integer) distance,
          cast(row_number() over (partition by query_id, kw_idx order by length(term), num_hits desc, term) as integer) rnk
        from kws join lex on starts_with(lex.term, kws.kw) where is_last qualify rnk <= {cap}),
fnd as (select * from ex union all select * from pre)"""
    if not fuzzy:
        return found + ", exp as (select * from fnd)"
    return (
        found
        + f""",
unk as (select * from kws where not exists (select 1 from fnd where fnd.query_id = kws.query_id and fnd.kw_idx = kws.kw_idx)),
near as (select unk.*, term, num_hits, num_docs from unk join lex
         on substr(term, 1, {head}) = substr(kw, 1, {head}) and length(term) between greatest(1, length(kw) - {dist}) and length(kw) + {dist}
         qualify row_number() over (partition by query_id, kw_idx order by num_hits desc, term) <= {cap}),
fzd as (select *, cast(levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '?', 'g'), kw) as integer) distance from near),
fz as (select * from fzd where distance <= {dist}),
fzr as (select query_id, kw_idx, kw, is_last, term, num_hits, num_docs, distance,
          cast(row_number() over (partition by query_id, kw_idx order by distance, num_hits desc, term) as integer) rnk from fz),
exp as (select * from fnd union all select * from fzr)"""
    )


def _scored(fuzzy: bool, max_docs: int = 500, k1: float = 1.2, b: float = 0.75) -> str:
    order = "rnk, hit_count desc, doc_id" if fuzzy else "hit_count desc, rnk, doc_id"
    return f""",
expd as (select *, sum(num_docs) over (partition by query_id, kw_idx) df from exp),
cand as (select query_id, kw_idx, term, doc_id, hit_count, df from post join expd using (term)
         qualify row_number() over (partition by query_id, kw_idx order by {order}) <= {max_docs}),
score as (select query_id, doc_id,
            sum(ln(1 + (total_documents - df + 0.5) / (df + 0.5)) * ({k1} + 1) * hit_count
                / ({k1} * (1 - {b}) + {k1} * {b} / greatest(1, avg_doc_length) * length + hit_count)) score
          from cand join len using (doc_id), st group by 1, 2)"""


def _spans(n: int, top: int) -> str:
    last = ", ".join(f"max(case when g = {i} then p end) over w l{i}" for i in range(n))
    seen = " + ".join(f"(l{i} is not null)::int" for i in range(n))
    first = "least(" + ", ".join(f"l{i}" for i in range(n)) + ")"
    return f""",
grp as (select query_id, term, max(kw_idx) g from cand group by 1, 2),
need as (select query_id, count(distinct kw_idx) needed from cand group by 1 having count(distinct kw_idx) > 1),
tops as (select query_id, doc_id from score qualify row_number() over (partition by query_id order by round(score, 6) desc, doc_id) <= {top}),
walk as (select query_id, doc_id, p, needed, {last} from tok join grp using (term) join need using (query_id) join tops using (query_id, doc_id)
         window w as (partition by query_id, doc_id order by p rows between unbounded preceding and current row)),
span as (select query_id, doc_id, cast(min(p - {first}) as bigint) min_span from walk where {seen} = needed group by 1, 2)"""


def _page(limit: int, offset: int, boost: float) -> str:
    score = f"score / (1 + coalesce({boost} * min_span, 0))" if boost else "score"
    join = "left join span using (query_id, doc_id)" if boost else ""
    return f""",
fin as (select query_id, doc_id, {score} score from score {join}),
pg as (select query_id, doc_id, round(score, 6) score,
         cast(row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as integer) rank,
         count(*) over (partition by query_id) hits from fin)
select * from pg where rank > {offset} and rank <= {offset + limit}"""


def _bm25(phrases, fuzzy=False, as_you_type=False, limit=100, offset=0, boost=0.0, max_docs=500, k1=1.2, b=0.75) -> str:
    n = max(len(p.split()) for p in phrases)
    spans = _spans(n, max((offset + limit) * 5, 200)) if boost else ""
    return (
        f"with {_built()}, {_keywords(phrases, as_you_type)}, {_expanded(fuzzy)} {_scored(fuzzy, max_docs, k1, b)} {spans} {_page(limit, offset, boost)}"
    )


def _leaf(word: str, prefix: bool = False) -> str:
    """Documents of a word and their places."""
    terms = f"(select term from lex where starts_with(term, '{word}') order by length(term), num_hits desc, term limit 50)" if prefix else f"('{word}')"
    return f"""(select doc_id, min(r) p from (select doc_id, row_number() over (order by hit_count desc, doc_id, term) r from post
              where term in {terms}) where r <= 500 group by 1)"""


def _bool_page(docs: str, limit: int, offset: int) -> str:
    return f"""
with {_built()}, d as ({docs}),
pg as (select doc_id, cast(row_number() over (order by place, doc_id) as integer) rank, count(*) over () hits from d where place is not null)
select * from pg where rank > {offset} and rank <= {offset + limit}"""


_OR = f"select doc_id, coalesce(a.p, b.p + 4294967296) place from {_leaf('engine')} a full join {_leaf('race')} b using (doc_id)"

_SHOWN = "query_id, kw_idx, kw, is_last, term, num_hits, num_docs, distance, rnk"

_BOOLEAN_SQL = {
    "bool_and": _bool_page(f"select doc_id, a.p place from {_leaf('cold')} a join {_leaf('engine')} b using (doc_id)", 100, 0),
    "bool_or": _bool_page(_OR, 1000, 0),
    "bool_not": _bool_page(f"select a.doc_id, a.p place from {_leaf('engine')} a left join {_leaf('race', True)} b using (doc_id) where b.p is null", 1000, 0),
    "bool_group": _bool_page(
        f"""select o.doc_id, o.place from ({_OR}) o join {_leaf('letter')} l on l.doc_id = o.doc_id
            left join {_leaf('promise', True)} n on n.doc_id = o.doc_id where n.p is null""",
        1000,
        0,
    ),
    "bool_prefix": _bool_page(f"select doc_id, a.p place from {_leaf('cold')} a join {_leaf('eng', True)} b using (doc_id)", 1000, 0),
    "bool_page": _bool_page(_OR, 10, 15),
}

_NGRAM = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{0E00}-\x{0E7F}]"


def _cut_tokens(n: int, single: bool) -> str:
    """Tokens with such characters in n-grams, then perhaps in characters."""
    one = "union all select doc_id, p, 1, i, substr(term, i + 1, 1) from (select *, cast(unnest(range(length(term))) as integer) i from parts where g)" if single else ""
    return f"""
with {_tok()},
parts as (select doc_id, p, term, regexp_matches(term, '{_NGRAM}') g from tok),
cut as (select doc_id, p, 0 k, 0 i, term from parts where not g
        union all select doc_id, p, 0, i, substr(term, i + 1, {n}) from (select *, cast(unnest(range(greatest(0, length(term) - {n - 1}))) as integer) i from parts where g)
        {one})
select doc_id, cast(row_number() over (partition by doc_id order by p, k, i) - 1 as integer) position, term from cut"""


def _stems(source: str) -> str:
    """English stems of the lower-case words ``term`` of ``source``, without apostrophes, as ``stm(term, stem)``: one column for each step."""
    short = "(regexp_matches({0}, 'past$') or regexp_matches({0}, '^[aeiouy][^aeiouy]$') or regexp_matches({0}, '[^aeiouy][aeiouy][^aeiouywxY]$'))"
    cut = lambda w, n: f"left({w}, length({w}) - {n})"
    second = {
        "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
        "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "ogist": "og", "enci": "ence",
        "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
    }
    third = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
    mapped = lambda end, table: f"case {end} " + " ".join(f"when '{a}' then '{b}'" for a, b in table.items()) + " end"
    return f"""
s0 as (select term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') w from (select distinct term from {source})),
s1 as (select *, regexp_extract(w, '^(arsen|commun|emerg|gener|inter|later|organ|past|univers)') pre, regexp_extract(w, '^[^aeiouy]*[aeiouy]+[^aeiouy]') vc from s0),
s2 as (select *, case when pre <> '' then length(pre) when vc <> '' then length(vc) else length(w) end r1 from s1),
s3 as (select *, regexp_extract(substr(w, r1 + 1), '^[^aeiouy]*[aeiouy]+[^aeiouy]') vc2 from s2),
s4 as (select term, r1, case when vc2 <> '' then r1 + length(vc2) else length(w) end r2,
         case when regexp_matches(w, 'sses$') then {cut("w", 2)}
              when regexp_matches(w, '(ied|ies)$') then case when length(w) > 4 then {cut("w", 2)} else {cut("w", 1)} end
              when regexp_matches(w, '(us|ss)$') then w
              when regexp_matches(w, 's$') and regexp_matches({cut("w", 2)}, '[aeiouy]') then {cut("w", 1)} else w end a from s3),
s5 as (select *, regexp_extract(a, '(eedly|ingly|edly|eed|ing|ed)$') e, left(a, length(a) - length(regexp_extract(a, '(eedly|ingly|edly|eed|ing|ed)$'))) st from s4),
s6 as (select term, r1, r2,
         case when e = '' then a
              when e in ('eed', 'eedly') then case when length(st) >= r1 and st not in ('succ', 'proc', 'exc') then st || 'ee' else a end
              when e = 'ing' and regexp_matches(st, '^[^aeiouy]y$') then left(st, 1) || 'ie'
              when e = 'ing' and st in ('even', 'cann', 'inn', 'earr', 'herr', 'out') then a
              when not regexp_matches(st, '[aeiouy]') then a
              when regexp_matches(st, '(at|bl|iz)$') then st || 'e'
              when regexp_matches(st, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') then case when regexp_matches(st, '^[aeo]..$') then st else {cut("st", 1)} end
              when length(st) = r1 and {short.format("st")} then st || 'e' else st end b from s5),
s7 as (select term, r1, r2, case when length(b) > 2 and regexp_matches(b, '[^aeiouy][yY]$') then {cut("b", 1)} || 'i' else b end c from s6),
s8 as (select *, regexp_extract(c, '({"|".join(second)}|ogi|li)$') e from s7),
s9 as (select term, r1, r2, case when e = '' or length(c) - length(e) < r1 then c
         when e = 'ogi' then case when regexp_matches(c, 'logi$') then {cut("c", 1)} else c end
         when e = 'li' then case when regexp_matches(c, '[cdeghkmnrt]li$') then {cut("c", 2)} else c end
         else left(c, length(c) - length(e)) || {mapped("e", second)} end d from s8),
s10 as (select *, regexp_extract(d, '({"|".join(third)})$') e from s9),
s11 as (select term, r1, r2, case when e = '' or length(d) - length(e) < case when e = 'ative' then r2 else r1 end then d
          else left(d, length(d) - length(e)) || {mapped("e", third)} end f from s10),
s12 as (select *, regexp_extract(f, '(ement|ance|ence|able|ible|ment|ant|ent|ism|ate|iti|ous|ive|ize|ion|al|er|ic)$') e from s11),
s13 as (select term, r1, r2, case when e = '' or length(f) - length(e) < r2 or e = 'ion' and not regexp_matches(f, '[st]ion$') then f
          else left(f, length(f) - length(e)) end g from s12),
stm as (select term, case when length(term) < 3 then term
          when term in ('andes', 'atlas', 'bias', 'cosmos', 'howe', 'news', 'sky') then term
          when term in ('skis', 'idly', 'gently', 'singly') then {cut("term", 1)} when term = 'skies' then 'sky'
          when term in ('ugly', 'early', 'only') then {cut("term", 1)} || 'i'
          when regexp_matches(g, 'e$') and (length(g) > r2 or length(g) > r1 and not {short.format(cut("g", 1))}) then replace({cut("g", 1)}, 'Y', 'y')
          when regexp_matches(g, 'll$') and length(g) > r2 then replace({cut("g", 1)}, 'Y', 'y') else replace(g, 'Y', 'y') end stem from s13)"""


def _built_stemmed() -> str:
    return f"""
tl0 as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_RE}') l from documents),
tok0 as (select doc_id, unnest(range(len(l))) p, unnest(l) term from tl0), {_stems("tok0")},
tok as (select doc_id, cast(row_number() over (partition by doc_id order by p) - 1 as integer) p, stem term from tok0 join stm using (term) where term not in {_listed(STOPWORDS)}),
post as (select term, doc_id, count(*) hit_count from tok group by 1, 2),
lex as (select term, cast(sum(hit_count) as bigint) num_hits, count(*) num_docs from post group by 1),
len as (select tl0.doc_id, count(tok.doc_id) length from tl0 left join tok on tok.doc_id = tl0.doc_id group by 1),
st as (select count(*) total_documents, avg(length) avg_doc_length from len)"""


#: Each token of documents.text with its place and the characters before it.
_PLACED = f"""
low as (select doc_id, text, lower(text) x from documents where text is not null),
cutup as (select doc_id, regexp_split_to_array(x, '{_RE}') seps, regexp_extract_all(x, '{_RE}') toks from low),
each as (select doc_id, unnest(toks) token, unnest(seps[1:len(toks)]) sep, unnest(range(len(toks))) i from cutup),
placed as (select doc_id, i, token, sum(length(sep) + length(token)) over (partition by doc_id order by i) - length(token) start from each)"""


def _title_grams(single: bool) -> str:
    one = "union all select doc_id, i, 1, substr(x, i + 1, 1) from (select *, cast(unnest(range(length(x))) as integer) i from t)" if single else ""
    return f"""
with t as (select doc_id, lower(title) x from documents where title is not null),
g as (select doc_id, i, 0 k, substr(x, i + 1, 2) token from (select *, cast(unnest(range(greatest(0, length(x) - 1))) as integer) i from t) {one})
select doc_id, cast(row_number() over (partition by doc_id order by i, k) - 1 as integer) "position", token, i "offset" from g"""


def _steps() -> str:
    n, one, of = "(select count(*) from documents)", "(select count(*) + 1 from documents)", "(select count(*) from documents where source = 'reelnotes')"
    hits = f"(select count(*) + 3 from ({_cut_tokens(2, True).replace('documents', 'fields')}))"
    said = {
        "exists before": 0, "modified before": 0, "read only without an index": 1, "exists after": 1, "modified after": 1, "count": n, "count after insert": one,
        "same id again": 1, "without an id": 1, "update of none": 1, "count after failures": one, "version after failures": one, "language kept": 1,
        "store kept": 1, "write when read only": 1, "stored title": 1, "count after delete": n, "copy": one, "copy's lexicon": hits, "rebuilt": of,
        "language after rebuild": 1, "rebuild that fails": 1, "kept after it": of, "cleared": 0, "terms of nothing": 0, "language after clear": 1, "overwritten": 0,
        "no index to overwrite": 1,
    }
    rows = " union all ".join("select '" + k.replace("'", "''") + f"' step, cast({v} as bigint) \"value\"" for k, v in said.items())
    return f"with fields as (select doc_id, coalesce(title, '') || ' ' || coalesce(source, '') text from documents) {rows}"


SQL = {
    "ngram_tokens_zh": _cut_tokens(2, True),
    "ngram_tokens_ko": _cut_tokens(2, True),
    "ngram_tokens_th": _cut_tokens(3, False),
    "tokens_with_offsets": f"""with {_PLACED} select doc_id, cast(i as integer) "position", token, cast(start as integer) "offset" from placed""",
    "ngrams_with_offsets": _title_grams(False),
    "ngrams_and_characters_with_offsets": _title_grams(True),
    "highlight": r"""
with t as (select doc_id, text, regexp_split_to_array(text, '[\p{L}\p{N}\p{Pc}]+') s, regexp_extract_all(text, '[\p{L}\p{N}\p{Pc}]+') w from documents)
select doc_id, case when text is null then null else array_to_string(list_transform(range(len(s)), lambda i: s[i + 1] || coalesce(
  case when lower(w[i + 1]) = 'cold' or starts_with(lower(w[i + 1]), 'eng') then '<mark>' || w[i + 1] || '</mark>' else w[i + 1] end, '')), '') end marked from t""",
    "snippet_one": rf"""
with {_PLACED},
n as (select doc_id, count(*) n, avg(length(token)) mean from placed group by 1),
w as (select doc_id, least(greatest(3, floor(120 / (mean + 1) + 0.5)), n) width from n),
c as (select *, sum(case when token in ('cold', 'engine') then 1 else 0 end) over (partition by doc_id order by i) c from placed),
best as (
  select a.doc_id, a.start, e.start + length(e.token) stop from c a join w using (doc_id) join c e on e.doc_id = a.doc_id and e.i = a.i + width - 1
  left join c b on b.doc_id = a.doc_id and b.i = a.i - 1 where e.c - coalesce(b.c, 0) > 0
  qualify row_number() over (partition by a.doc_id order by e.c - coalesce(b.c, 0) desc, a.i) = 1),
wide as (
  select doc_id, text, start - length(regexp_extract(substr(text, 1, cast(start as bigint)), '[^ \t\n\r]*$')) a,
         stop + length(regexp_extract(substr(text, cast(stop as bigint) + 1), '^[^ \t\n\r]*')) z from best join documents using (doc_id)),
piece as (select *, substr(text, cast(a as bigint) + 1, cast(z - a as bigint)) piece from wide),
head as (select *, substr(piece, 1, 120) head, 120 - instr(reverse(substr(piece, 1, 120)), ' ') space, instr(substr(piece, 1, 120), ' ') > 0 has from piece),
shown as (
  select doc_id, case when a > 0 then '… ' else '' end
    || regexp_replace(case when length(piece) <= 120 then piece when has and space > 60 then substr(head, 1, space) else head end, '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g')
    || case when z < length(text) or length(piece) > 120 then ' …' else '' end snippet from head),
h as (select doc_id, text, substr(text, 1, 120) head from documents),
b as (select *, 120 - instr(reverse(head), ' ') space, instr(head, ' ') > 0 has from h),
beginning as (select doc_id, case when length(text) <= 120 then text
  else regexp_replace(case when has and space > 60 then substr(head, 1, space) else head end, '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g') || ' …' end snippet from b)
select doc_id, coalesce(s.snippet, g.snippet) snippet from beginning g left join shown s using (doc_id)""",
    "language_tags": """
select tag, case when tag in ('zh', 'ja', 'ko') then 2 when tag = 'th' then 3 else 0 end ngram_size from (select unnest(string_split(
  'af ar bg bn br ca cs da de el en eo es et eu fa fi fr ga gl gu ha he hi hr hu hy id it ja ko ku la lt lv mr ms ne nl no pl pt ro ru sk sl so sr st sv sw ta th tl tr uk ur vi yi yo zh zu', ' ')) tag)""",
    "stems": f"with {_built()}, {_stems('lex')} select term, stem from stm",
    "bm25_stemmed": f"with {_built_stemmed()}, {_keywords(['race engin'], True)}, {_expanded(False)} {_scored(False)} {_spans(2, 500)} {_page(100, 0, 1.0)}",
    "stemmed_positions": f"""
with fields as (select doc_id, 0 f, title x from documents union all select doc_id, 1, body from documents),
tl0 as (select doc_id, f, regexp_extract_all(lower(coalesce(x, '')), '{_RE}') l from fields),
tok0 as (select doc_id, f, unnest(range(len(l))) p, unnest(l) term from tl0), {_stems("tok0")}
select doc_id, cast(row_number() over (partition by doc_id order by f, p) - 1 as integer) "position", stem term
from tok0 join stm using (term) where term not in {_listed(STOPWORDS)}""",
    "lifecycle": _steps(),
    "single_searches": f"""
with u as (select doc_id k, {_BOTH} x from documents), {_built("u", "k", "x")}, {_keywords(PHRASES, False)}, {_expanded(False)} {_scored(False)}
{_spans(3, 200)} {_page(10**9, 0, 1.0).replace("select * from pg", ", top as (select * from pg")})
select query_id, doc_id, score, hits, rank <= 5 shown from top""",
    "single_boolean": f"with fields as (select doc_id, {_BOTH} text from documents) select * from ("
    + " union all ".join(f"select {q} query_id, * from ({_BOOLEAN_SQL[k].replace('documents', 'fields')})" for q, k in enumerate(BOOLEANS))
    + ")",
    "inspect_nested": f"""
with u as (select doc_id k, {_BOTH} x from documents), {_built("u", "k", "x")}, {_keywords(['cold enginne rac'], True)}, {_expanded(True)},
m as (select k.kw_idx, k.kw, k.is_last, e.term, num_hits, num_docs,
         case when e.term is null then 'none' when distance is not null then 'fuzzy'
              when k.is_last and first_value(e.term) over (partition by k.kw_idx order by rnk) <> k.kw then 'prefix' else 'exact' end match_type
      from kws k left join exp e on e.kw_idx = k.kw_idx)
select kw raw, kw processed, is_last, match_type, cast(coalesce(sum(num_hits), 0) as bigint) num_hits, cast(coalesce(sum(num_docs), 0) as bigint) num_docs,
       cast(count(term) as integer) n_terms from m group by kw_idx, 1, 2, 3, 4
union all select 'cold enginne & rac & |', 'cold enginne rac', false, 'query', (select count(*) from documents), 0, 0""",
    "tokens": f"with {_tok()} select doc_id, p position, term from tok",
    "ngram_tokens": rf"""
with {_tok()},
parts as (select doc_id, p, term, regexp_matches(term, '[\x{{4E00}}-\x{{9FFF}}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}\x{{0E00}}-\x{{0E7F}}]') g from tok),
cut as (select doc_id, p, 0 k, 0 i, term from parts where not g
        union all select doc_id, p, 0, i, substr(term, i + 1, 2) from (select *, cast(unnest(range(greatest(0, length(term) - 1))) as integer) i from parts where g)
        union all select doc_id, p, 1, i, substr(term, i + 1, 1) from (select *, cast(unnest(range(length(term))) as integer) i from parts where g))
select doc_id, cast(row_number() over (partition by doc_id order by p, k, i) - 1 as integer) position, term from cut""",
    "title_bigrams": _grams(2),
    "title_trigrams": _grams(3),
    "stopword_filter": f"""with {_tok()}
select doc_id, cast(row_number() over (partition by doc_id order by p) - 1 as integer) position, term from tok where term not in {_listed(STOPWORDS)}""",
    "query_analysis": f"""with {_tok(text="title")},
n as (select doc_id, count(*) filter (term not in {_listed(STOPWORDS)}) kept, count(*) c from tok group by 1),
k as (select doc_id, p, term from tok join n using (doc_id) where c = 1 or kept = 0 or term not in {_listed(STOPWORDS)})
select doc_id query_id, cast(row_number() over (partition by doc_id order by p) - 1 as integer) kw_idx, term kw,
       p = max(p) over (partition by doc_id) is_last from k""",
    "postings": f"with {_built()} select * from post",
    "lexicon": f"with {_built()} select * from lex",
    "doc_lengths": f"with {_built()} select * from len",
    "corpus_stats": f"with {_built()} select total_documents, round(avg_doc_length, 6) avg_doc_length from st",
    "positions": f"with {_tok()} select term, doc_id, cast(p as bigint) \"position\" from tok",
    "multi_field_positions": f"""with {_tok("part", "p_partkey", "p_name || ' ' || p_type")} select term, doc_id, cast(p as bigint) "position" from tok""",
    "exact_terms": f"with {_built()}, {_keywords(['engine race letter nosuchword'], False)}, {_expanded(False)} select {_SHOWN} from exp",
    "prefix_terms": f"with {_built()}, {_keywords(['eng', 'the ra', 'sto'], True)}, {_expanded(False)} select {_SHOWN} from exp",
    "fuzzy_terms": f"with {_built()}, {_keywords(['enginne', 'mecanic racce', 'dirrector'], True)}, {_expanded(True)} select {_SHOWN} from exp",
    "levenshtein_terms": f"with {_built()} select term, cast(levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '?', 'g'), 'engine') as integer) distance from lex",
    "bm25_exact": _bm25(["engine"]),
    "bm25_multi": _bm25(["young director mechanic"]),
    "bm25_prefix": _bm25(["cold eng"], as_you_type=True),
    "bm25_fuzzy": _bm25(["cold enginne"], fuzzy=True),
    "bm25_maxdocs": _bm25(["cold engine"], max_docs=20),
    "bm25_page": _bm25(["cold engine"], limit=10, offset=20),
    "bm25_tuned": _bm25(["cold engine"], k1=2.0, b=0.3),
    "bm25_proximity": _bm25(["cold engine"], boost=1.0),
    "bm25_batch": _bm25(PHRASES, as_you_type=True, limit=10, boost=1.0),
    "part_search": f"""with {_built("part", "p_partkey", "p_name || ' ' || p_type")},
ql as (select p_partkey query_id, regexp_extract_all(lower(p_name), '{_RE}') l from part),
kws as (select query_id, cast(unnest(range(len(l))) as integer) kw_idx, unnest(l) kw, false is_last from ql),
{_expanded(False)} {_scored(False, 10**12)} {_spans(2, 200)} {_page(3, 0, 1.0)}""",
    "proximity_spans": f"with {_built()}, {_keywords(['cold engine'], False)}, {_expanded(False)} {_scored(False)} {_spans(2, 1_000_000)} select * from span",
    "inspect_query": f"""with {_built()}, {_keywords(['cold enginne rac'], True)}, {_expanded(True)}
select k.kw_idx tok_idx, k.kw raw, k.kw processed, k.is_last,
       case when e.term is null then 'none' when distance is not null then 'fuzzy'
            when k.is_last and first_value(e.term) over (partition by k.kw_idx order by rnk) <> k.kw then 'prefix' else 'exact' end match_type,
       e.term, num_hits, num_docs, distance, rnk
from kws k left join exp e on e.kw_idx = k.kw_idx""",
    "snippet_beginning": r"""
with h as (select doc_id, text, substr(text, 1, 120) head from documents),
w as (select *, 120 - instr(reverse(head), ' ') space, instr(head, ' ') > 0 has from h)
select doc_id, case when length(text) <= 120 then text
  else regexp_replace(case when has and space > 60 then substr(head, 1, space) else head end, '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g') || ' …' end snippet
from w""",
    "insert_many": f"with {_built(text=_BOTH)} select * from lex",
    "upsert_many": f"""
with u as (select doc_id k, {_BOTH} x from documents union all select -p_partkey, p_name || ' ' || p_type from part),
{_built("u", "k", "x")} select * from lex""",
    "update_many": f"""
with u as (select doc_id k, case when lang is null then title else {_BOTH} end x from documents), {_built("u", "k", "x")} select * from lex""",
    "delete_many": f"""
with u as (select doc_id k, {_BOTH} x from documents where source is distinct from 'reelnotes'), {_built("u", "k", "x")}
select * from lex union all select '', 0, total_documents from st""",
    "has_many": "select distinct s.doc_id, exists (select 1 from documents d where d.doc_id = s.doc_id) found from docstore s",
    "get_many": "select doc_id, title, source from documents where doc_id in (select doc_id from docstore)",
    "hydrated_search": f"""
with u as (select doc_id k, {_BOTH} x from documents), {_built("u", "k", "x")}, {_keywords(PHRASES, False)}, {_expanded(False)} {_scored(False)}
{_spans(3, 200)} {_page(5, 0, 1.0).replace("select * from pg", ", top as (select * from pg")})
select query_id, doc_id, rank, hits, title from top join documents using (doc_id)""",
    "metadata_kept": f"with {_built(text='title')} select doc_id, length, source from len join documents using (doc_id)",
} | _BOOLEAN_SQL
