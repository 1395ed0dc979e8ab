"""The queries of results run the method that they are results of."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexquarry.llm import packing
from lexquarry.llm.lookalike import fold_token, look, normalise
from lexquarry.llm.mixing import Mix, mix_documents
from lexquarry.llm.packing import pack_documents, split_by_packing

SF = "/root/testdata/sf0.001"
DOCS, PLAN = "doc_id bigint, source string, text string", "source string, target_share double, max_repeats int, capacity int"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mix_decides_what_is_reachable(spark):
    docs = [(i, "big" if i < 30 else "small", "w " * (1 + i % 5)) for i in range(36)]
    plan = [("big", 0.5, 1, 1), ("small", 0.5, 2, 1), ("none", 0.1, 3, 1), ("idle", 0.0, 1, 1)]
    mix = mix_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(plan, PLAN))
    unknown = Mix(mix.budgets.withColumn("reachable", F.lit(None).cast("boolean")), mix.rows)
    assert {r["source"]: r["reachable"] for r in unknown.report().collect()} == {"big": True, "small": False, "none": False, "idle": True}


def test_p8_found_runs_the_mix(spark):
    assert "Window" in plan_of(entry.queries()["p8_found"](spark, SF))


def test_containers_decide_what_is_split(spark):
    docs = [(i, "a", "w " * i) for i in range(1, 13)] + [(100, "a", "w " * 20)]
    packed = pack_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 1.0, 1, 10)], PLAN))
    untold = packed.withColumn("n_pieces", F.lit(None).cast("int"))
    assert sorted(r[0] for r in split_by_packing(untold).collect()) == [11, 12, 100]


def test_p7_found_runs_the_packing(spark, monkeypatch):
    """Its plan reads the documents with the containers that the supersteps gave them."""
    steps, sweep = [], packing.successor_sweep
    monkeypatch.setattr(packing, "successor_sweep", lambda e: (steps.append(1), sweep(e))[1])
    found = entry.queries()["p7_found"](spark, SF)
    assert len(steps) > 1 and plan_of(found).count("LogicalRDD") > len(steps)


@pytest.mark.parametrize(
    "a,b",
    [("c\u043e\u0301p", "c\u00f3p"), ("\u03bf\u0302", "\u00f4"), ("a\U000e0001b\U000e0061", "ab"), ("\u845b\U000e0100", "\u845b"), ("\u2f00\u2fd5", "\u4e00\u9fa0")],
)
def test_rare_look_alikes(a, b):
    assert look(normalise(a)) == look(normalise(b)) == look(look(normalise(a)))


def test_folding_keeps_separate_accents():
    folded = "\u0436\u0435\u0301"
    assert fold_token("\u0436e\u0301") == fold_token("\u0436\u00e9") == fold_token(folded) == folded and look(folded) == "\u0436\u00e9"
