"""Orphan references and salted group statistics against brute force, with odd rows."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from lexquarry.operators.orphans import broken_references
from lexquarry.operators.skew import dominant_keys, heavy_keys, lookup, salted_group_stats, salted_lookup

T0 = dt.datetime(2024, 1, 1)
REFS = "k bigint, t timestamp_ntz, w string, bits string"
PARENTS = "id bigint, a timestamp_ntz, d timestamp_ntz, there string"


def brute(refs, parents):
    known = {}
    for k, a, d in parents:
        if k is not None:
            a0, d0 = known.get(k, (None, None))
            known[k] = (min(x for x in (a0, a) if x is not None) if a0 or a else None, min((x for x in (d0, d) if x), default=None))
    out = set()
    for k, t in refs:
        if k is None:
            continue
        month = t and t.strftime("%Y-%m")
        if k not in known:
            out.add((k, month, "missing"))
            continue
        a, d = known[k]
        if t and a and a > t:
            out.add((k, month, "late"))
        if t and d and d <= t:
            out.add((k, month, "deleted"))
    return out


def found(spark, refs, parents, ref_type=REFS, parent_type=PARENTS):
    r = spark.createDataFrame([(k, t, "x", "y") for k, t in refs], ref_type)
    p = spark.createDataFrame([(k, a, d, "z") for k, a, d in parents], parent_type)
    rows = broken_references(r, "k", "t", p, "id", "a", "d", "f").collect()
    assert len(rows) == len(set(rows)) and all(x["ref_field"] == "f" for x in rows)
    return {(x["ref_id"], x["written_month"], x["reason"]) for x in rows}


def test_orphans_at_random(spark):
    rng = random.Random(5)
    when = lambda: T0 + dt.timedelta(hours=rng.randint(0, 24 * 120))
    parents = [(k, when(), when() + dt.timedelta(days=30) if rng.random() < 0.3 else None) for k in range(-70, 130) if rng.random() < 0.8]
    parents += rng.sample(parents, 20) + [(None, T0, None), (5, None, None)]
    refs = [(rng.randint(-90, 150), when()) for _ in range(1500)] + [(3, when()) for _ in range(800)] + [(None, T0), (7, None), (9999, None)]
    refs += refs[:50]
    assert found(spark, refs, parents) == brute(refs, parents)


def test_orphans_at_the_edges(spark):
    t = dt.datetime(2024, 2, 1)
    parents = [(1, t, None), (2, T0, t), (3, t - dt.timedelta(microseconds=1), None)]
    refs = [(1, t), (1, t - dt.timedelta(microseconds=1)), (2, t), (2, t - dt.timedelta(microseconds=1)), (3, t)]
    assert found(spark, refs, parents) == {(1, "2024-01", "late"), (2, "2024-02", "deleted")}


def test_orphans_of_empty_tables(spark):
    assert found(spark, [], [(1, T0, None)]) == set()
    assert found(spark, [(1, T0)], []) == {(1, "2024-01", "missing")}


def test_orphans_with_string_keys(spark):
    got = found(spark, [("a", T0), ("b", T0), ("c", T0)], [("b", T0, None)], REFS.replace("k bigint", "k string"), PARENTS.replace("id bigint", "id string"))
    assert got == {("a", "2024-01", "missing"), ("c", "2024-01", "missing")}


SCHEMA = "term_id bigint, doc_id bigint, hit_count bigint, salt string, n_rows string, __x int"


def test_group_stats(spark):
    rng = random.Random(9)
    rows = [(1, rng.choice([*range(40), None]), rng.choice([1, 2, None])) for _ in range(3000)]
    rows += [(rng.randint(2, 300), rng.randint(0, 50), 1) for _ in range(3000)] + [(None, 1, 1)] * 500
    df = spark.createDataFrame([(*r, "s", "n", 1) for r in rows], SCHEMA)
    want = defaultdict(lambda: [0, set(), 0])
    for t, d, h in rows:
        if t is not None:
            want[t][0] += 1
            want[t][2] += h or 0
            if d is not None:
                want[t][1].add(d)
    stats = salted_group_stats(df, min_share=0.05)
    assert {r["term_id"]: (r["n_rows"], r["n_members"], r["total"]) for r in stats.collect()} == {k: (n, len(m), v) for k, (n, m, v) in want.items()}
    assert [r["term_id"] for r in dominant_keys(stats, "term_id", 0.1).collect()] == [1]
    assert salted_group_stats(df.limit(0)).count() == 0
    assert salted_group_stats(df.where("term_id is null")).count() == 0


def test_heavy_keys_are_few(spark):
    df = spark.createDataFrame([(i % 7,) for i in range(700)], "k bigint")
    assert heavy_keys(df, "k", 0.5).count() == 0
    heavy = {r["k"]: r["n_salts"] for r in heavy_keys(df, "k", 0.1).collect()}
    assert heavy == {i: 2 for i in range(7)}


def test_salted_lookup_is_a_join(spark):
    df = spark.createDataFrame([(1, i) for i in range(500)] + [(i, i) for i in range(2, 50)] + [(None, 1)], "k bigint, v bigint")
    dim = spark.createDataFrame([(i, f"n{i}") for i in range(0, 40)], "id bigint, name string")
    heavy = heavy_keys(df, "k", 0.2)
    inner = salted_lookup(df, "k", F.col("v"), dim, "id", heavy)
    assert sorted(inner.select("k", "v", "name").collect()) == sorted(df.join(dim, F.col("k") == F.col("id")).select("k", "v", "name").collect())
    assert salted_lookup(df, "k", F.col("v"), dim, "id", heavy, "left").count() == df.count()
    assert inner.where("k = 1").select("salt").distinct().count() > 1


def test_lookup_gives_the_same_by_either_way(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, 3, None, 4]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k bigint, i bigint")
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (9, "z")], "d bigint, name string")
    for how in ("inner", "left"):
        few, many = (lookup(df, "k", F.col("i"), dim, "d", most, how=how).select("k", "i", "name").collect() for most in (10, 1))
        key = lambda r: (r[1], r[2] or "")
        assert sorted(map(tuple, few), key=key) == sorted(map(tuple, many), key=key) and len(few) > 300


def test_repeats_of_one_member_are_combined_before_they_move(spark):
    df = spark.createDataFrame([(7, 7, 1)] * 2000 + [(1, i, None) for i in range(5)], "term_id bigint, doc_id bigint, hit_count bigint")
    stats = salted_group_stats(df)
    assert {tuple(r) for r in stats.collect()} == {(7, 2000, 1, 2000), (1, 5, 5, 0)}
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan
