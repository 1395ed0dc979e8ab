import math
import random

import pytest

from lexquarry.config import Config
from lexquarry.errors import QueryError
from lexquarry.operators import boolean as B
from lexquarry.operators.build import Analyzer, build_index
from lexquarry.operators.explain import inspect_query
from lexquarry.operators.resolve import analyze_phrase, keyword_table, resolve
from lexquarry.operators.score import search


def index_of(spark, texts, analyzer=Analyzer()):
    return build_index(spark.createDataFrame(list(enumerate(texts, 1)), "id bigint, title string"), "id", ["title"], analyzer)


def ids(spark, texts, phrase, fuzzy=False, as_you_type=False, config=Config(), limit=100, offset=0, analyzer=Analyzer()):
    index = index_of(spark, texts, analyzer)
    kws = analyze_phrase(phrase, analyzer)["filtered"]
    terms = resolve(keyword_table(spark, [phrase], analyzer, as_you_type), index.lexicon, config, fuzzy, analyzer.language)
    return [r["doc_id"] for r in search(index, terms, config, fuzzy, limit, offset, len(kws)).orderBy("rank").collect()]


def test_more_hits_win(spark):
    assert ids(spark, ["sedan", "sedan sedan sedan"], "sedan") == [2, 1]


def test_short_documents_win(spark):
    assert ids(spark, ["sedan", "sedan " * 3 + "filler " * 97], "sedan")[0] == 1


def test_two_words_beat_one(spark):
    assert ids(spark, ["car sedan", "sedan " * 10], "car sedan")[0] == 1


def test_cap(spark):
    assert len(ids(spark, ["sedan"] * 5, "sedan", config=Config(max_docs=2))) == 2


def test_pages(spark):
    texts = ["sedan " * i for i in range(1, 6)]
    pages = [ids(spark, texts, "sedan", limit=2, offset=o) for o in (0, 2, 4)]
    assert [len(p) for p in pages] == [2, 2, 1] and pages[0][0] == 5


def test_proximity(spark):
    assert ids(spark, ["fast car review test drive", "fast review test drive car"], "fast car") == [1, 2]


def test_proximity_factor_is_exact(spark):
    texts = ["fast x car", "fast car", "car", "y"]
    index = index_of(spark, texts)
    kws = keyword_table(spark, ["fast car"], as_you_type=False)
    terms = resolve(kws, index.lexicon)
    with_it = {r["doc_id"]: r["score"] for r in search(index, terms, Config(), n_groups=2).collect()}
    without = {r["doc_id"]: r["score"] for r in search(index, terms, Config(proximity_boost=0.0), n_groups=2).collect()}
    assert math.isclose(with_it[1], without[1] / 3, abs_tol=2e-6) and math.isclose(with_it[2], without[2] / 2, abs_tol=2e-6) and with_it[3] == without[3]


def test_fuzzy(spark):
    assert ids(spark, ["dragon", "draagon"], "drago", fuzzy=True) == [1, 2]
    assert ids(spark, ["dragon " * 5, "drage"], "drako", fuzzy=True)[0] == 1
    assert ids(spark, ["sedan"], "seddaan", fuzzy=True, config=Config(fuzzy_distance=1)) == []
    assert ids(spark, ["sedan"], "sedaan", fuzzy=False) == []


def test_prefix(spark):
    assert set(ids(spark, ["mercedes", "mercury", "bmw"], "merc", as_you_type=True)) == {1, 2}
    assert ids(spark, ["mercedes"], "merc", as_you_type=False) == []


def test_nothing(spark):
    assert ids(spark, ["sedan"], "") == [] and ids(spark, ["", "", ""], "sedan") == []


def test_ngram_language(spark):
    a = Analyzer("zh")
    assert ids(spark, ["这是一辆轿车测试", "飞机"], "轿车", analyzer=a, as_you_type=True) == [1]
    assert ids(spark, ["这是一辆轿车测试", "飞机"], "车", analyzer=a, as_you_type=True) == [1]


def test_stopwords_of_queries():
    a = Analyzer(stopwords=("the", "of"))
    assert analyze_phrase("the car", a)["filtered"] == ["car"]
    assert analyze_phrase("the", a)["filtered"] == ["the"]
    said = analyze_phrase("the of", a)
    assert said["filtered"] == ["the", "of"] and said["all_stripped"]


def test_fields_nulls_and_booleans(spark):
    docs = spark.createDataFrame(
        [(1, "city car", "fast sedan", True), (2, None, None, None), (None, "lost", None, None), (3, " ", "x", False)],
        "id bigint, title string, body string, flag boolean",
    )
    index = build_index(docs, "id", ["title", "body", "flag"])
    got = {(r["doc_id"], r["term"]): r["position"] for r in index.positions.collect()}
    assert got == {(1, "city"): 0, (1, "car"): 1, (1, "fast"): 2, (1, "sedan"): 3, (1, "1"): 4, (3, "x"): 0}
    assert {r["doc_id"]: r["length"] for r in index.doc_lengths.collect()} == {1: 5, 2: 0, 3: 1}
    empty = build_index(docs.limit(0), "id", ["title"])
    assert empty.stats.first()["total_documents"] == 0 and empty.lexicon.count() == 0


# --- boolean ---

CASES = [
    ("sedan or coupe truck", ["sedan", "coupe truck", "coupe"], {1, 2}),
    ("php -laravel", ["php laravel", "php symfony"], {2}),
    ("php&(laravel or nodejs)", ["php laravel", "php nodejs", "laravel nodejs"], {1, 2}),
    ("(sedan or coupe) -electric", ["sedan coupe", "sedan electric", "coupe electric", "suv"], {1}),
    ("alpha&(beta or gamma)&delta", ["alpha beta delta", "alpha gamma delta", "alpha beta", "beta delta"], {1, 2}),
    ("( café or latté )", ["café", "latté", "tea"], {1, 2}),
    ("fast & comfortable", ["fast comfortable", "fast"], {1}),
    ("fast  comfortable", ["fast comfortable", "fast"], {1}),
    ("foo-bar", ["foo", "bar", "baz"], {1, 2}),
    ("suv (a or b)", ["suv", "a", "c"], {1, 2}),
    ("", ["a"], set()),
]


@pytest.mark.parametrize("expression,texts,want", CASES)
def test_boolean(spark, expression, texts, want):
    got = B.search_boolean(index_of(spark, texts), expression, as_you_type=False).collect()
    assert {r["doc_id"] for r in got} == want
    assert all(r["hits"] == len(want) for r in got)


def test_boolean_compat(spark):
    assert B.search_boolean(index_of(spark, ["fast comfortable"]), "fast & comfortable", as_you_type=False, strict_compat=True).count() == 0


def test_boolean_chinese(spark):
    index = index_of(spark, ["轿车测试", "轿车和飞机"], Analyzer("zh"))
    assert [r["doc_id"] for r in B.search_boolean(index, "轿车 -飞机").collect()] == [1]


@pytest.mark.parametrize("bad", ["~x", "a or ~b"])
def test_not_alone(bad):
    with pytest.raises(QueryError):
        B.parse(bad)


def test_random_expressions_against_sets(spark):
    rng = random.Random(3)
    words = "ant bee cat dog".split()
    texts = [" ".join(w for w in words if rng.random() < 0.5) for _ in range(30)]
    index = index_of(spark, texts)
    found = {B.Leaf(w, False): {i for i, t in enumerate(texts, 1) if w in t.split()} for w in words}
    found |= {B.Leaf(w, True): found[B.Leaf(w, False)] for w in words}

    def expression(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(words)
        a, b = expression(depth - 1), expression(depth - 1)
        return rng.choice((f"{a} or {b}", f"({a} or {b})", f"({a})&({b})", f"{a} -{rng.choice(words)}"))

    for _ in range(8):
        e = expression(2)
        got = {r["doc_id"] for r in B.search_boolean(index, e, as_you_type=False).collect()}
        assert got == B.evaluate(B.parse(e, False), found), e


def test_order_of_or_and_and(spark):
    texts = ["b", "a a b", "a", "b b b"]
    got = [r["doc_id"] for r in B.search_boolean(index_of(spark, texts), "a or b", as_you_type=False).orderBy("rank").collect()]
    assert got == [2, 3, 4, 1]


def test_inspect(spark):
    index = index_of(spark, ["dragon fire", "dragon drag"], Analyzer(stopwords=("the",)))
    said = inspect_query(index, "the dragon drak dra", fuzzy=True)
    assert said["filtered_tokens"] == ["dragon", "drak", "dra"] and said["raw_tokens"][0] == "the"
    assert [t["match_type"] for t in said["tokens"]] == ["exact", "fuzzy", "prefix"]
    assert said["tokens"][0]["num_docs"] == 2 and said["index_info"]["total_documents"] == 2 and said["boolean_postfix"]
    assert inspect_query(index, "zzz")["tokens"][0]["match_type"] == "none"
