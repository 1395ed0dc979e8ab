import random

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import analysis as A
from lexquarry.functions import languages as L
from lexquarry.functions.stemmers import stem_word
from lexquarry.functions.stopwords import default_stopwords, frequent_terms, remove_stopwords

SPLITS = [
    ("Hello World", ["hello", "world"]),
    ("foo, bar! baz.", ["foo", "bar", "baz"]),
    ("user@example.com", ["user@example", "com"]),
    ("e-mail", ["e", "mail"]),
    ("3 series", ["3", "series"]),
    ("café, résumé!", ["café", "résumé"]),
    ("Ünïcödé", ["ünïcödé"]),
    ("snake_case", ["snake_case"]),
    ("", []),
    (" .,; ", []),
]


def test_split_in_both_engines(spark):
    df = spark.createDataFrame([(t,) for t, _ in SPLITS] + [(None,)], "t string")
    rows = df.select("t", A.split_tokens(F.col("t")).alias("x")).collect()
    for (text, want), row in zip(SPLITS, rows):
        assert row["x"] == want == A.py_split(text)
    assert rows[-1]["x"] == []


def test_ngrams(spark):
    df = spark.createDataFrame([("轿车测试",), ("京",), ("",)], "t string")
    rows = df.select(A.ngrams(F.col("t"), 2).alias("a"), A.ngrams(F.col("t"), 2, True).alias("b"), A.ngrams(F.col("t"), 3).alias("c")).collect()
    assert rows[0]["a"] == ["轿车", "车测", "测试"] and rows[0]["c"] == ["轿车测", "车测试"]
    assert rows[1]["a"] == [] and rows[1]["b"] == ["京"] and rows[2]["b"] == []
    assert A.py_ngrams("กรุงเทพ", 3)[0] == "กรุ" and len(A.py_ngrams("กรุงเทพ", 3)) == 5


@pytest.mark.parametrize("language", [None, "en", "zh", "ja", "ko", "th"])
def test_tokenize_agrees_with_python(spark, language):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab 轿车ทดがカ한글é_@-1Z") for _ in range(rng.randint(0, 20))) for _ in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(A.tokenize(F.col("t"), language)).collect()]
    assert got == [A.py_tokenize(t, language) for t in texts]


def test_offsets():
    assert A.py_offsets("Größe, über") == [("größe", 0), ("über", 7)]
    assert A.py_offsets("轿车测", "zh") == [("轿车", 0), ("车测", 1)]
    assert A.py_offsets("轿车", "zh", True) == [("轿车", 0), ("轿", 0), ("车", 1)]


def test_stopwords(spark):
    df = spark.createDataFrame([(["the", "a", "fox", "the", "10"],)], "t array<string>")
    assert df.select(remove_stopwords(F.col("t"), ["the", "10"])).first()[0] == ["a", "fox"]
    assert df.select(remove_stopwords(F.col("t"), [])).first()[0] == ["the", "a", "fox", "the", "10"]
    assert "the" in default_stopwords("en") and default_stopwords("zh") == []
    for language, word in {"ja": "これ", "he": "אבל", "uk": "чи", "hr": "ali", "ga": "agus", "da": "ikke", "th": "ที่", "zu": "futhi"}.items():
        assert word in default_stopwords(language) and L.has_stopwords(language)
    assert sum(map(L.has_stopwords, L.NAMES)) == 37
    lex = spark.createDataFrame([("a", 9, 9), ("b", 2, 2)], "term string, num_hits bigint, num_docs bigint")
    assert frequent_terms(lex, 10) == ["a"]


def test_languages():
    assert len(L.NAMES) == 62 and L.supports("de") and not L.supports("xx") and not L.supports(None)
    assert L.ngram_size("th") == 3 and L.ngram_size("en") == 0 and L.has_stemmer("en") and not L.has_stemmer("zh")


STEMS = {
    "en": "running run connection connect connections connect connected connect generously generous dying die evening evening succeed succeed "
    "hopping hop hoped hope falling fall happy happi skies sky relational relat agreed agre caresses caress ponies poni ties tie gas gas this this",
    "fr": "chanter chant chantait chant continuellement continuel chevaux cheval beaux beau bijoux bijou femmes femm",
    "de": "aufeinander aufeinand häuser haus häusern haus kategorien kategori verständnisses verstandnis jahrhunderts jahrhundert größe gross",
    "es": "chicas chic torneado torn canciones cancion rápidamente rapid felicidad felic pague pag",
    "it": "abbandonata abbandon propaganda propagand libertà libert velocemente veloc",
    "pt": "boataria boat felizmente feliz bonita bonit cidades cidad",
    "ru": "вазоватые вазоват важная важн книгами книг красивейшая красив",
    "sv": "jaktkarlarne jaktkarl klostergården klostergård flickorna flick",
    "no": "havnedistriktene havnedistrikt husene hus",
    "da": "indtage indtag begivenheden begiven",
    "nl": "lichaamsdelen lichaamsdeel opheffende ophef boeken boek huizen huis bomen boom gewerkt werk jongetje jong snelheid snel katten kat",
    "lt": "knygose knyg žodžiai žod gražiausias graž",
    "eo": "hundoj hund min mi kiujn kiu unujn unu l' la ank' ankaŭ 5n 5 parolas parol",
    "ar": "المعلمون معلم الكتاب كتاب مدرسة مدرس يستخدمون استخدم",
    "fi": "edeltäjiinsä edeltäj taloissa talo kirjastossa kirjasto asuntoihin asunto",
    "hu": "babakocsi babakocs házakban ház kalappal kalap könyvek könyv",
    "ro": "abruptă abrupt accelerare acceler vorbesc vorb cântând cânt",
    "pl": "samochodach samochod piękniejszy piękn koń kon",
    "ga": "bhfuil fuil dtithe tithe",
    "id": "bukunya buku membaca baca pertandingan tanding berlari lari",
    "tr": "adamlar adam evlerimizde ev kitaplarımızdan kitap arabalarındaki araba gelirken gelir istanbul'da istanbul güzeldir güzel ad ad soyad soyad "
    "kalemler kalem okuldan okul masasındaki masas kanadı kanadı öğretmenlerinin öğretmen",
    "hy": "ընկերներ ընկեր",
    "hi": "किताबें किताब लड़कियाँ लड़क जीती जीत बनाइए बन करना कर जाना ज आना आन ना न",
    "ne": "घरहरूमा घर गरेको गर गएकी ग",
}


@pytest.mark.parametrize("language", STEMS)
def test_stems(language):
    words = STEMS[language].split()
    for word, stem in zip(words[::2], words[1::2]):
        assert stem_word(word, language) == stem


@pytest.mark.parametrize("language", sorted(__import__("lexquarry.functions.stemmers", fromlist=["STEMMERS"]).STEMMERS))
def test_any_word_has_a_stem(language):
    rng = random.Random(7)
    for _ in range(3000):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéèçñãõêîïëáíóúåæøаеиоуывшнлтсямйь'") for _ in range(rng.randint(0, 12)))
        stem = stem_word(word, language)
        assert isinstance(stem, str) and len(stem) <= len(word) + word.count("ß") + 2


def test_no_stemmer(spark):
    from lexquarry.errors import QueryError
    from lexquarry.functions.stemmers import stem_column

    assert stem_word("轿车", "zh") == "轿车"
    with pytest.raises(QueryError):
        stem_column(F.col("x"), "zh")
