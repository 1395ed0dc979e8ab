"""Language identification: held-out accuracy, mixed texts, labels, odd rows."""

import os

import pytest
from pyspark.sql import functions as F

from lexquarry.llm import langid as L

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(SAMPLES), reason="no samples")


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["lang"], r["sample_text"]) for r in spark.read.parquet(SAMPLES).orderBy("sample_id").collect()]


@pytest.fixture(scope="module")
def model(rows):
    return L.fit(rows)


def runs(model, *texts):
    return [[(r["lang"], r["n_letters"]) for r in x] for x in L._detect(list(texts), L._Words(model))]


def test_held_out(rows):
    own = L.fit([r for i, r in enumerate(rows) if i % 4])
    got = runs(own, *[t for i, (_, t) in enumerate(rows) if i % 4 == 0])
    right = sum(len(g) == 1 and g[0][0] == lang for g, lang in zip(got, [lang for i, (lang, _) in enumerate(rows) if i % 4 == 0]))
    assert right >= 0.93 * len(got)
    assert own.held_out > 0.95 and 0.5 <= own.threshold <= 0.95


def test_same_model_each_time(rows, model):
    assert (L.fit(rows).table == model.table).all()


def test_mixed_texts(rows, model):
    of = {lang: [t for x, t in rows if x == lang] for lang in model.langs}
    for a, b in (("en", "ru"), ("fr", "ja"), ("de", "zh"), ("en", "de")):
        text = " ".join(of[a][:5]) + "\n\n" + " ".join(of[b][:5])
        (got,) = L._detect([text], L._Words(model))
        assert [r["lang"] for r in got] == [a, b]
        assert got[0]["char_start"] == 0 and got[-1]["char_end"] == len(text) and got[0]["char_end"] == got[1]["char_start"]
        assert abs(got[0]["char_end"] - text.index("\n\n")) <= 2


def test_disguised_letters(rows, model):
    of = {lang: [t for x, t in rows if x == lang] for lang in ("en", "ru")}
    wide = " ".join(of["en"][:3]).translate({c: c + 0xFEE0 for c in range(0x21, 0x7F)})
    mixed = " ".join(of["ru"][:3]).translate(str.maketrans("аеорс", "aeopc"))
    assert [x[0][0] for x in runs(model, wide, mixed)] == ["en", "ru"]


def test_odd_texts(spark, model):
    texts = [None, "", " \n ", "1234 -- ...", "x", "the " * 50_000, "。" * 10]
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in enumerate(texts)] + [(None, "the engine", "c", "d")], "doc_id bigint, body string, segments string, langs string")
    got = {r["doc_id"]: r["segments"] for r in L.detect_languages(df, model).collect()}
    assert [len(got[i]) for i in range(7)] == [0, 0, 0, 0, 1, 1, 0] and len(got[None]) == 1
    assert got[5][0]["n_letters"] == 150_000
    langs = {r["doc_id"] for r in L.languages_of(L.detect_languages(df, model)).collect()}
    assert langs == {4, 5, None}
    assert L.detect_languages(df.limit(0), model).count() == 0


def test_shares(spark, rows, model):
    of = {lang: [t for x, t in rows if x == lang] for lang in ("en", "nl", "ja")}
    quote = " ".join(of["en"][:12]) + " « " + of["nl"][0][:20] + " »"
    half = " ".join(of["en"][:4]) + "\n" + " ".join(of["ja"][:8])
    df = spark.createDataFrame([(1, quote), (2, half)], "doc_id bigint, body string")
    got = {r["doc_id"]: [(x["lang"], x["share"]) for x in r["langs"]] for r in L.languages_of(L.detect_languages(df, model)).collect()}
    assert [x for x, _ in got[1]] == ["en"]
    assert {x for x, _ in got[2]} == {"en", "ja"} and abs(sum(s for _, s in got[2]) - 1) < 1e-9 and got[2][0][1] >= got[2][1][1]


LABELS = [
    ("en", "en"), ("EN", "en"), ("en-US", "en"), ("en_GB", "en"), ("eng", "en"), ("English", "en"), (" italian ", "it"), ("ger", "de"), ("deu", "de"),
    ("zh_TW", "zh"), ("zh-Hans-CN", "zh"), ("chi", "zh"), ("Dutch", "nl"), ("sv", "sv"), (None, None), ("", None), ("  ", None), ("xx", None),
    ("und", None), ("mul", None), ("??", None), ("unknown", None), ("en/fr", None),
]


def test_labels(spark):
    df = spark.createDataFrame([(a,) for a, _ in LABELS], "x string")
    assert [r[0] for r in df.select(L.label_language(F.col("x"))).collect()] == [b for _, b in LABELS]


def test_label_of_the_source(spark):
    docs = spark.createDataFrame(
        [(1, "fr", "s", "x"), (2, None, "s", "x"), (3, "??", "two", "x"), (4, None, "none", "x"), (5, None, None, "x"), (6, "", "same", "x")],
        "doc_id bigint, lang string, source string, label string",
    )
    info = spark.createDataFrame(
        [("s", "language", "EN"), ("s", "total_documents", "5"), ("two", "language", "en"), ("two", "language", "de"), ("none", "language", "und"),
         (None, "language", "en"), ("same", "language", "spa"), ("same", "language", "ES"), ("same", "language", None)],
        "index_name string, info_key string, value string",
    )
    assert {r["doc_id"]: r["label"] for r in L.labelled(docs, info).collect()} == {1: "fr", 2: "en", 3: None, 4: None, 5: None, 6: "es"}


def test_wrong_labels(spark):
    rows = [(1, "en", ["en"]), (2, "de", ["en"]), (3, None, ["en"]), (4, "en", ["en", "fr"]), (5, "en", [])]
    df = spark.createDataFrame([(i, x, [{"share": 0.5, "lang": y, "confidence": 1.0} for y in ls]) for i, x, ls in rows],
                               "doc_id bigint, label string, langs array<struct<share:double,lang:string,confidence:double>>")
    assert sorted(tuple(r) for r in L.wrong_labels(df).collect()) == [(2, "en"), (3, "en"), (4, "en"), (4, "fr")]


def test_no_samples():
    with pytest.raises(ValueError):
        L.fit([(None, "x"), ("en", None), ("en", "12")])


FOREIGN = [
    "Regeringen beslutade igår att höja skatten på bensin och diesel från och med nästa år, vilket många bilägare ogillar.",
    "Hükümet dün akşam aldığı kararla önümüzdeki yıldan itibaren akaryakıt vergilerini artıracağını açıkladı ve halk buna karşı çıktı.",
    "Η κυβέρνηση αποφάσισε χθες να αυξήσει τους φόρους στα καύσιμα από το επόμενο έτος και πολλοί οδηγοί αντέδρασαν.",
]


def test_languages_it_was_not_taught_are_unknown(model):
    """They are rejected as a whole and keep the likeliest language as a guess; sentences of the samples' languages are not."""
    for runs in L._detect(FOREIGN, L._Words(model)):
        assert [r["lang"] for r in runs] == [L.UNKNOWN] and runs[0]["guess"] in model.langs and runs[0]["confidence"] < 0.95


def test_rejection_is_rare_among_known_languages(model, spark):
    own = [(r["lang"], r["sample_text"]) for r in spark.read.parquet(SAMPLES).collect()]
    found = L._detect([t for _, t in own], L._Words(model))
    assert sum(runs[0]["lang"] == L.UNKNOWN for runs in found) <= len(own) // 20
    assert sum(runs[0]["guess"] == lang for (lang, _), runs in zip(own, found)) >= 0.97 * len(own)
