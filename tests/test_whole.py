"""Queries do the whole job: what a cap or a filter once left out."""

from dataclasses import replace

import duckdb

import __spark_entry__ as entry
from lexquarry.config import Config
from lexquarry.operators.build import build_index
from lexquarry.operators.resolve import keyword_table, resolve
from lexquarry.operators.score import fetch, narrowed, search
from tests.oracle import compare


def test_part_search_finds_parts_beyond_any_cap(spark, tmp_path):
    names = ["red bolt"] * 600 + ["old gear"] * 600 + ["red gear"] * 3
    parts = [(i, name, "PROMO") for i, name in enumerate(names, 1)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    rows = entry.queries()["part_search"](spark, str(tmp_path)).collect()
    assert len(rows) == 3 * len(parts)
    # The proximity factor halves parts with both words side by side, so it is the SQL that says which come first.
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    _, why = compare(spark.createDataFrame(rows), con, entry.oracle_sql()["part_search"])
    assert not why, why
    assert {r["hits"] for r in rows if r["query_id"] > 1200} == {1203} and {r["hits"] for r in rows if r["query_id"] <= 600} == {603}


def test_levenshtein_terms_has_the_whole_lexicon(spark, tmp_path):
    docs = [(1, "engine enginé éngine"), (2, "двигатель 工程 がぎ 𠀀ngine")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["term"]: r["distance"] for r in entry.queries()["levenshtein_terms"](spark, str(tmp_path)).collect()}
    assert found == {"engine": 0, "enginé": 1, "éngine": 1, "двигатель": 9, "工程": 6, "がぎ": 6, "𠀀ngine": 1}


def _broadcast(plan):
    """The parts of a plan's text that are broadcast."""
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_bm25_stemmed_broadcasts_no_positions_and_stems_once(spark, tmp_path):
    words = "racing engines engine engineer the race racer cold film letters".split()
    docs = [(i, " ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 9))) for i in range(900)] + [(900, None), (901, "the"), (902, "")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["bm25_stemmed"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    parts = list(_broadcast(plan))
    assert parts and not [p for p in parts if "posexplode" in p]
    assert plan.count("ArrowEvalPython") == 1
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rows, why = compare(found, con, entry.oracle_sql()["bm25_stemmed"])
    assert rows == 100 and not why, why


def test_proximity_is_the_same_whether_few_or_many_documents_are_found(spark):
    texts = ["fast car", "fast review car", "car test drive fast", "fast", "car"] * 2_200
    for n in (50, len(texts)):  # the second more than are counted to be broadcast
        index = build_index(spark.createDataFrame(list(enumerate(texts[:n], 1)), "id bigint, title string"), "id", ["title"], keep=True)
        terms = resolve(keyword_table(spark, ["fast car"], as_you_type=False), index.lexicon)
        config = Config(max_docs=20_000)
        fetched = fetch(index, terms, config, False)
        assert (narrowed(index, fetched) is index) == (n > 10_000)
        ours, whole = (search(i, terms, config, False, 20, 0, 2).collect() for i in (index, replace(index, positions_in=None)))
        assert sorted(ours) == sorted(whole) and {r["hits"] for r in ours} == {n}
