import json

import pytest

from lexquarry.api import SearchIndex
from lexquarry.errors import IndexIOError, QueryError
from lexquarry.streaming.ingest import upsert_stream


def lexicon(index):
    return {r["term"]: (r["num_hits"], r["num_docs"]) for r in index.tables.lexicon.collect()}


def average(index):
    return index.tables.stats.first()["avg_doc_length"]


def test_a_life(spark, tmp_path):
    path = str(tmp_path / "index")
    assert not SearchIndex.exists(spark, path) and SearchIndex.last_modified(spark, path) == 0
    index = SearchIndex(spark, path, store=True)
    index.insert_many([{"id": 1, "title": "fast sedan", "_meta": {"k": "secret"}}, {"id": "2", "title": "fast fast coupe", "note": None, "new": True}])
    assert index.count() == 2 and lexicon(index) == {"fast": (3, 2), "sedan": (1, 1), "coupe": (1, 1), "1": (1, 1)}
    assert index.has_many([1, 2, 3]) == {1: True, 2: True, 3: False}
    assert index.get(1) == {"id": 1, "title": "fast sedan", "_meta": {"k": "secret"}} and index.get(9) is None
    with pytest.raises(QueryError, match="already there: 2"):
        index.insert_many([{"id": 5, "title": "x"}, {"id": 2, "title": "y"}])
    with pytest.raises(QueryError, match="twice: 7"):
        index.insert_many([{"id": 7, "title": "x"}, {"id": 7, "title": "y"}])
    for bad in ({"title": "x"}, {"id": "x1", "title": "x"}, {"id": True, "title": "x"}, {"id": 1.5, "title": "x"}):
        with pytest.raises(QueryError):
            index.insert(bad)
    with pytest.raises(QueryError, match="no such ids: 8, 9"):
        index.update_many([{"id": 1, "title": "x"}, {"id": 9, "title": "x"}, {"id": 8, "title": "x"}])
    assert index.count() == 2

    index.update({"id": 1, "title": "slow suv"})
    assert lexicon(index) == {"fast": (2, 1), "coupe": (1, 1), "1": (1, 1), "slow": (1, 1), "suv": (1, 1)}
    index.upsert_many([{"id": 1, "title": "first"}, {"id": 3, "title": "three words here"}, {"id": 1, "title": "last wins"}])
    assert index.count() == 3 and index.get(1)["title"] == "last wins" and "first" not in lexicon(index)
    again = SearchIndex(spark, path, readonly=True)
    assert again.document_store_enabled and again.search("words").ids == [3]
    with pytest.raises(IndexIOError):
        again.insert({"id": 4, "title": "x"})

    index.snapshot_to(str(tmp_path / "copy"))
    index.delete_many([2, 3, 77])
    assert index.count() == 1 and average(index) == 2.0 and set(lexicon(index)) == {"last", "wins"}
    index.optimize()
    index._store.vacuum()
    assert set(lexicon(index)) == {"last", "wins"} and index.search("wins").documents == {1: {"id": 1, "title": "last wins"}}
    assert SearchIndex(spark, str(tmp_path / "copy")).count() == 3
    index.clear()
    assert index.count() == 0 and average(index) == 0.0 and index.search("wins").ids == [] and index.search("wins").documents == {}
    assert SearchIndex.last_modified(spark, path) > 0


def test_rebuild(spark, tmp_path):
    path = str(tmp_path / "index")
    index = SearchIndex(spark, path, store=True)
    index.insert({"id": 1, "title": "old"})

    def fails(i):
        i.insert({"id": 2, "title": "new"})
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError):
        SearchIndex.rebuild(spark, path, fails)
    assert SearchIndex(spark, path).search("old").ids == [1]
    new = SearchIndex.rebuild(spark, path, lambda i: i.insert({"id": 2, "title": "new"}))
    assert new.document_store_enabled and new.search("old").hits == 0 and SearchIndex(spark, path).search("new").ids == [2]


def test_opening(spark, tmp_path):
    with pytest.raises(QueryError):
        SearchIndex(spark, str(tmp_path / "a"), language="klingon")
    with pytest.raises(QueryError):
        SearchIndex(spark, str(tmp_path / "a"), readonly=True, force=True)
    with pytest.raises(IndexIOError):
        SearchIndex(spark, str(tmp_path / "a"), readonly=True)
    other = tmp_path / "other"
    other.mkdir()
    (other / "precious.txt").write_text("x")
    for force in (False, True):
        with pytest.raises(IndexIOError):
            SearchIndex(spark, str(other), force=force)
    assert (other / "precious.txt").exists() and not SearchIndex.exists(spark, str(other))
    index = SearchIndex(spark, str(tmp_path / "en"), language="en")
    index.insert_many([{"id": 1, "body": "the running man"}, {"id": 2, "body": "a connection"}])
    assert index.search("connected").ids == [2] and index.search("runs").ids == [1] and index.language == "en"
    with pytest.raises(QueryError):
        index.get(1)
    assert index.search("man").documents is None and not index.search("man").has_documents
    assert SearchIndex(spark, str(tmp_path / "en"), force=True).count() == 0


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "index")
    a = SearchIndex(spark, path)
    b = SearchIndex(spark, path)
    a.insert({"id": 1, "title": "x"})
    with pytest.raises(IndexIOError):
        b.insert({"id": 2, "title": "y"})
    assert SearchIndex(spark, path).count() == 1


def test_tables_in_and_out(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"), store=True)
    docs = spark.createDataFrame([(i, f"word{i % 3} common", i % 2 == 0) for i in range(30)], "id int, title string, flag boolean")
    index.insert_many(docs)
    queries = spark.createDataFrame([(1, "word1 common"), (2, "nothing"), (3, "word2")], "query_id int, phrase string")
    got = index.search_batch(queries, as_you_type=False, limit=5).collect()
    assert {r["query_id"] for r in got} == {1, 3} and {r["hits"] for r in got if r["query_id"] == 3} == {10}
    assert index.search("word1 common", as_you_type=False, limit=0).ids == [] and index.search("word1", as_you_type=False, limit=0).hits == 10
    assert index.search("word1", as_you_type=False, offset=50).hits == 10
    assert json.loads(index.get_table(spark.createDataFrame([(4,)], "id int")).first()["data"])["title"] == "word1 common"
    assert {r["doc_id"]: r["found"] for r in index.has_table(spark.createDataFrame([(1,), (99,)], "id int")).collect()} == {1: True, 99: False}
    r = index.search_boolean("common -word1", as_you_type=False, limit=3)
    assert r.hits == 20 and len(r.ids) == 3 and not r.has_scores and len(r.documents) == 3
    for write in (index.insert_many, index.upsert_many):
        with pytest.raises(QueryError, match="integer id"):
            write(spark.createDataFrame([("x1", "a")], "id string, title string"))
    index.delete_many(docs.where("id < 10").select("id"))
    assert index.count() == 20


def test_stream(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"))
    spark.createDataFrame([(1, "one"), (2, "two")], "id bigint, title string").write.json(str(tmp_path / "in/a"))
    stream = spark.readStream.schema("id bigint, title string").json(str(tmp_path / "in/*"))
    upsert_stream(index, stream, str(tmp_path / "cp")).awaitTermination()
    assert index.count() == 2
    spark.createDataFrame([(2, "zwei"), (3, "drei")], "id bigint, title string").write.json(str(tmp_path / "in/b"))
    upsert_stream(index, stream, str(tmp_path / "cp"), most_segments=1).awaitTermination()
    assert index.segments == 1
    assert index.count() == 3 and index.search("zwei").ids == [2] and index.search("two").ids == []


def test_progress(spark, tmp_path):
    """Each document of a list, a DataFrame as a whole, nothing of nothing."""
    index, calls = SearchIndex(spark, str(tmp_path / "index")), []
    say = lambda done, total: calls.append((done, total))
    index.insert_many([{"id": i, "title": "x"} for i in (1, 2, 3)], say)
    assert calls == [(1, 3), (2, 3), (3, 3)]
    index.insert_many([], say)
    index.insert_many(spark.createDataFrame([(4, "x"), (5, "y")], "id bigint, title string"), say)
    assert calls[3:] == [(2, 2)]


def test_scores_of_all_hits(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"))
    index.insert_many([{"id": i, "title": "sedan " * i} for i in range(1, 6)])
    none, page = index.search("sedan", limit=0), index.search("sedan", limit=2, offset=1)
    assert none.ids == [] and none.hits == 5 and len(none.scores) == 5
    assert len(page.scores) == 5 and page.ids == list(page.scores)[1:3] and page.df.count() == 2
    assert index.search_boolean("sedan -nothing", limit=0).hits == 5


def test_a_cluster_must_name_a_shared_folder(monkeypatch):
    from lexquarry.plans.session import ensure_checkpoint_dir

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        ensure_checkpoint_dir(Session())
