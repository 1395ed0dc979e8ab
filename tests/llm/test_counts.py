"""Term statistics and top postings against brute force, with odd rows."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from lexquarry.llm.termstats import term_statistics
from lexquarry.llm.topn import top_postings

T0 = dt.datetime(2024, 1, 1)
POSTINGS = "term_id bigint, doc_id bigint, hit_count bigint, written_at timestamp_ntz, salt string, term string, n_salts int, at string, h int"
LEXICON = "id bigint, term string, num_hits bigint, salt string, n_ids int, mark string"


def postings_frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "t", 1, "a", 1) for r in rows], POSTINGS)


def lexicon_frame(spark, rows):
    return spark.createDataFrame([(*r, None, "s", 1, "m") for r in rows], LEXICON)


def random_postings(seed, hot=3000):
    rng = random.Random(seed)
    when = lambda: T0 + dt.timedelta(hours=rng.randint(0, 20))
    rows = [(1, rng.randint(1, 60), rng.choice([1, 2, 3, None]), when()) for _ in range(hot)]
    rows += [(rng.randint(2, 200), rng.randint(1, 60), rng.randint(1, 5), when()) for _ in range(2000)]
    rows += [(None, 1, 1, T0), (3, None, 2, T0), (4, 1, None, T0), (5, 5, 5, None), (5, 5, 9, None), (999, 61, 1, T0)]
    return rows + rows[:200]


def latest(rows):
    best = {}
    for t, d, h, at in rows:
        order = (at or dt.datetime.min, -1 if h is None else h)
        if t is not None and d is not None and order >= best.get((t, d), ((dt.datetime.min, -2), None))[0]:
            best[t, d] = (order, h)
    return {k: h for k, (_, h) in best.items()}


def test_term_statistics(spark):
    rows = random_postings(1)
    lex = [(i, f"t{i % 40}" if i > 100 else f"u{i}") for i in range(1, 190)] + [(500, None), (None, "x"), (501, ""), (502, "never"), (1, "u1")]
    docs = defaultdict(set)
    hits = defaultdict(int)
    ids = defaultdict(set)
    for i, s in lex:
        if i is not None and s is not None:
            ids[s].add(i)
    once = latest(rows)
    for (t, d), h in once.items():
        for s in ids:
            if t in ids[s]:
                docs[s].add(d)
                hits[s] += h or 0
    n = len({d for _, d, _, _ in rows if d is not None})
    want = {
        s: (len(ids[s]), hits[s], len(docs[s]), "rare" if len(docs[s]) <= 2 else "common" if len(docs[s]) > 0.2 * n else None) for s in ids
    }
    got = term_statistics(postings_frame(spark, rows), lexicon_frame(spark, lex), min_share=0.05).collect()
    assert {r["term"]: (r["n_ids"], r["num_hits"], r["num_docs"], r["mark"]) for r in got} == want and len(got) == len(want)
    assert want["u1"][3] == "common" and want["never"] == (1, 0, 0, "rare")


def test_term_statistics_of_nothing(spark):
    none, words = postings_frame(spark, []), lexicon_frame(spark, [(1, "a"), (2, "a")])
    assert [tuple(r) for r in term_statistics(none, words).collect()] == [("a", 2, 0, 0, "rare")]
    assert term_statistics(postings_frame(spark, [(1, 1, 1, T0)]), lexicon_frame(spark, [])).count() == 0


def test_a_string_under_many_ids(spark):
    """A third of the lexicon is one string, and its documents overlap."""
    lex = [(i, "same" if i % 3 == 0 else f"w{i}") for i in range(300)]
    rows = [(i, i % 7, 1, T0) for i in range(300)]
    got = {r["term"]: r["num_docs"] for r in term_statistics(postings_frame(spark, rows), lexicon_frame(spark, lex), min_share=0.1).collect()}
    assert got["same"] == 7 and got["w1"] == 1 and len(got) == 201


@pytest.mark.parametrize("n", [1, 3, 10])
def test_top_postings(spark, n):
    rows = random_postings(2)
    by_term = defaultdict(list)
    for (t, d), h in latest([r for r in rows if None not in r[:3]]).items():
        by_term[t].append((-h, d))
    want = {(t, d, -h, i) for t, items in by_term.items() for i, (h, d) in enumerate(sorted(items)[:n], 1)}
    got = top_postings(postings_frame(spark, rows), n, min_share=0.05).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_postings_of_nothing_and_ties(spark):
    assert top_postings(postings_frame(spark, [])).count() == 0
    assert top_postings(postings_frame(spark, [(1, 1, 1, T0)]), 0).count() == 0
    rows = [(1, d, 7, T0) for d in range(1000, 0, -1)]
    assert [r["doc_id"] for r in top_postings(postings_frame(spark, rows), 3, min_share=0.001).orderBy("rnk").collect()] == [1, 2, 3]
