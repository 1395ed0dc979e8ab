import pytest
from pyspark.sql import functions as F

from lexquarry.operators.highlight import Highlighter
from lexquarry.operators.snippet import Snippeter, beginning_column

MARKED = [
    ("merc", "Mercedes Benz", "<mark>Mercedes</mark> Benz", None),
    ("fast sed", "A fast sedan.", "A <mark>fast</mark> <mark>sedan</mark>.", None),
    ("car", "scarce", "scarce", None),
    ("轿车", "这是一辆轿车测试", "这是一辆<mark>轿车</mark>测试", "zh"),
    ("轿车", "轿 车", "轿 车", "zh"),
    ("", "text", "text", None),
    ("é", "É é e", "<mark>É</mark> <mark>é</mark> e", None),
]


@pytest.mark.parametrize("phrase,text,want,language", MARKED)
def test_highlight(spark, phrase, text, want, language):
    h = Highlighter(language=language)
    assert h.highlight(phrase, text) == want
    assert spark.createDataFrame([(text,)], "t string").select(h.column(phrase, F.col("t"))).first()[0] == want


def test_highlight_tags_are_literal(spark):
    h = Highlighter("$1\\", "$", False)
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    assert [r[0] for r in df.select(h.column("a", F.col("t"))).collect()] == ["$1\\a$ b", None]
    assert h.highlight_many("a", {"x": "a", "y": ""}) == {"x": "$1\\a$", "y": ""}


CUT = [
    (Snippeter(12, 2, "..."), "fox", "fox " + "gap " * 10 + "fox", "fox gap gap ... ... ... gap gap fox"),
    (Snippeter(10), "zzz", "aaaaaa bbbbb cccc", "aaaaaa …"),
    (Snippeter(10), "zzz", "aaaaa bbbbb cccc", "aaaaa bbbb …"),
    (Snippeter(10), "zzz", "aaaa bbbbb cccc", "aaaa bbbbb …"),
    (Snippeter(2), "éàèé", "éàèé", "éà …"),
    (Snippeter(6), "fox", "éàèé bx fox", "éàèé …"),
    (Snippeter(6), "fox", "abc defgh fox", "abc de …"),
    (Snippeter(), "x", "", ""),
    (Snippeter(), "", "short", "short"),
]


@pytest.mark.parametrize("snippeter,query,text,want", CUT)
def test_snippet(snippeter, query, text, want):
    assert snippeter.snippet(query, text) == want


def test_snippet_columns(spark):
    text = "word " * 100 + "needle needle " + "word " * 100
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    a, b, c = (r[0] for r in df.select(Snippeter(60).column("needle", F.col("t"))).collect())
    assert a.startswith("… word") and "needle" in a and a.endswith("…") and b is None and c == ""
    d = [r[0] for r in df.select(beginning_column(F.col("t"), 30)).collect()]
    assert d == [Snippeter(30).beginning(text), None, ""]
    assert Snippeter(language="en").snippet_many("running", {"x": "they run far"}) == {"x": "they run far"}
