"""Sizes, splitting, packing and mixing: round trips and invariants, with odd rows."""

import math
import random

import pytest
import regex
from pyspark.sql import functions as F

from lexquarry.llm.mixing import entropy_shares, mix_documents, source_budgets, tempered_shares
from lexquarry.llm import packing
from lexquarry.llm.packing import container_report, pack_documents, split_by_packing, successor_sweep
from lexquarry.llm.sizes import TOKEN_PYTHON, token_count
from lexquarry.llm.splitting import split_documents, split_spans

TOKEN = regex.compile(TOKEN_PYTHON)


def test_sizes(spark):
    texts = ["one two", "", None, "轿车 test", "ab轿c", "éa", "a_b@c-d", "・ー々", "１２ 3"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"))).collect()]
    assert got == [2, 0, 0, 3, 3, 2, 2, 3, 2] == [len(TOKEN.findall(t or "")) for t in texts]


# --- splitting ---


def long_text(rng, n):
    out = []
    while len(TOKEN.findall("".join(out))) < n:
        kind = rng.random()
        sentence = " ".join(rng.choice(["alpha", "be", "gamma_x", "Δelta", "é", "12"]) for _ in range(rng.randint(1, 30)))
        out.append(sentence + rng.choice([". ", "! ", " ", ".\n", ".\n\n", "\n## 3\n", ", "]) if kind < 0.9 else "轿车测试，" * rng.randint(1, 40))
    return "".join(out)


@pytest.mark.parametrize("limit,overlap", [(400, 40), (50, 10), (10, 0), (5, 4)])
def test_pieces(limit, overlap):
    rng = random.Random(limit)
    for n in (limit + 1, limit * 2, limit * 7):
        text = long_text(rng, n)
        spans = [m.span() for m in TOKEN.finditer(text)]
        pieces = split_spans(text, spans, limit, overlap)
        rebuilt, last = "", None
        for no, start, end, tokens, shared in pieces:
            piece = text[start:end]
            assert len(TOKEN.findall(piece)) == tokens <= limit
            own = TOKEN.findall(piece)
            if last is None:
                assert (no, start, shared) == (0, 0, 0)
            else:
                assert 0 <= shared <= overlap and (not shared or own[:shared] == last[-shared:])
                assert shared < tokens
            seen = [m.span() for m in TOKEN.finditer(text, start, end)]
            rebuilt += text[seen[shared][0] if no else start : end]
            last = own
        assert rebuilt == text and pieces[-1][2] == len(text)


def test_cuts_at_natural_places():
    text = "x " * 30 + ".\n\n" + "y " * 30 + "\n## 2\n" + "z " * 30
    pieces = [text[a:b] for _, a, b, _, _ in split_spans(text, [m.span() for m in TOKEN.finditer(text)], 40, 5)]
    assert [set(p) & set("xyz") for p in pieces] == [{"x"}, {"x", "y"}, {"y", "z"}] or len(pieces) >= 3
    assert pieces[0].rstrip().endswith(".") and all(len(TOKEN.findall(p)) <= 40 for p in pieces)


def test_split_documents(spark):
    texts = {1: "a " * 401, 2: "a " * 400, 3: None, 4: "", 5: "轿" * 900, 6: "x" * 50_000, 7: "word, " * 20_000, 8: "..." * 9000}
    df = spark.createDataFrame([(k, v, "clash", 1) for k, v in texts.items()], "doc_id bigint, text string, piece string, p int")
    rows = split_documents(df).collect()
    assert {r["doc_id"] for r in rows} == {1, 5, 7}
    for k in (1, 5, 7):
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece_no"])
        assert [r["piece_no"] for r in own] == list(range(own[0]["n_pieces"]))
        assert all(r["piece"] == texts[k][r["char_start"] : r["char_end"]] and r["n_tokens"] <= 400 for r in own)
        assert all(r["overlap_tokens"] == 40 for r in own[1:])
    assert split_documents(df.limit(0)).count() == 0
    assert split_documents(df.union(df)).count() == 2 * len(rows)
    with pytest.raises(ValueError):
        split_documents(df, limit=10, overlap=10)


# --- packing ---


def brute_best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits)[1]] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


@pytest.mark.parametrize("blocks", [1, 3])
def test_sweep_takes_successors(spark, blocks):
    """A superstep against brackets on a stack, with ties, in one block and in several."""
    rng = random.Random(blocks)
    events = [(s, rng.randint(1, 30), kind, i, rng.randint(1, 3) if not kind else 1, 0) for s in ("a", "b", "c") for kind in (0, 1) for i in range(rng.choice([0, 60, 200]))]
    events += [("hot", 5, kind, i, 1, 0) for kind in (0, 1) for i in range(300)]
    df = spark.createDataFrame(events, "source string, size bigint, kind int, id bigint, units bigint, tokens bigint")
    spark.conf.set("spark.sql.shuffle.partitions", str(blocks))
    try:
        kept, swept = successor_sweep(df)
        assert kept.select("block").distinct().count() <= blocks and kept.count() == len(events)
        got = {(r["source"], r["id"]): r["bin"] for r in swept.collect()}
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
    want = {}
    for s in {e[0] for e in events}:
        open_ = []
        for _, size, kind, i, units, _ in sorted((e for e in events if e[0] == s), key=lambda e: (-e[1], e[2], e[3])):
            if kind:
                want[s, i] = open_.pop() if open_ else None
            else:
                open_ += [i] * units
    assert got == want


def shapes(rng):
    return {
        "even": (10**6, lambda: rng.randint(1, 10**6)),
        "tiny": (1024, lambda: rng.randint(1, 5)),
        "falling": (1024, lambda: min(1024, 1 + int(rng.expovariate(1 / 60)))),
        "middle": (1000, lambda: rng.randint(250, 500)),
        "heavy": (10**6, lambda: min(10**6, int(rng.paretovariate(0.7)))),
        "same": (1000, lambda: 300),
        "half": (1000, lambda: 501),
        "full": (10, lambda: 10),
        "ones": (1, lambda: 1),
    }


def test_supersteps_fill_like_best_fit(spark, monkeypatch):
    """Containers within a hundredth and one of exact best fit, in few supersteps, whatever the sizes."""
    rng, steps = random.Random(6), []
    sweep = packing.successor_sweep
    monkeypatch.setattr(packing, "successor_sweep", lambda e: (steps.append(1), sweep(e))[1])
    sizes = {k: [draw() for _ in range(700)] for k, (_, draw) in shapes(rng).items()}
    capacity = {k: c for k, (c, _) in shapes(rng).items()}
    docs = spark.createDataFrame([(i, k, n) for k, own in sizes.items() for i, n in enumerate(own)], "doc_id bigint, source string, n bigint")
    plan = spark.createDataFrame(list(capacity.items()), "source string, capacity int")
    rows = pack_documents(docs, plan, "n").collect()
    assert len(rows) == sum(map(len, sizes.values())) and len(steps) <= 12
    load = {}
    for r in rows:
        assert r["n_tokens"] == sizes[r["source"]][r["doc_id"]]
        load[r["source"], r["container_id"]] = load.get((r["source"], r["container_id"]), 0) + r["n_tokens"]
    for k, own in sizes.items():
        bins = [n for (s, _), n in load.items() if s == k]
        assert max(bins) <= capacity[k] and len(bins) <= 1.01 * brute_best_fit(own, capacity[k]) + 1


PLAN = "source string, target_share double, max_repeats int, capacity int"
DOCS = "doc_id bigint, source string, text string, capacity int, tokens int, n_pieces int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, 2, 3) for i, s, t in rows], DOCS)


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b"]), "w " * rng.choice([1, 3, 5, 9, 10, 11, 25, 30])) for i in range(400)]
    odd = [(1000, "a", None), (1001, "b", ""), (1002, None, "w"), (None, "a", "w"), (1003, "zzz", "w"), (5, rows[5][1], rows[5][2]), (1004, "a", "w " * 5000)]
    plan = spark.createDataFrame([("a", 0.5, 1, 10), ("b", 0.5, 1, 25), ("c", 0.0, 1, 5), (None, 0.0, 1, 5), ("bad", 0.0, 1, 0), ("bad2", 0.0, 1, None)], PLAN)
    packed = pack_documents(docs_frame(spark, rows + odd), plan).collect()
    cap = {"a": 10, "b": 25}
    size = {i: len((t or "").split()) for i, s, t in rows + odd if i is not None and s in cap}
    of = {i: s for i, s, t in rows + odd if i is not None and s in cap}
    got = {}
    for r in packed:
        got.setdefault(r["doc_id"], []).append(r)
        assert r["source"] == of[r["doc_id"]] and r["capacity"] == cap[r["source"]] and r["container_id"].startswith(r["source"] + "/")
    assert set(got) == set(size)
    for i, parts in got.items():
        assert sum(p["n_tokens"] for p in parts) == size[i]
        assert sorted(p["piece_no"] for p in parts) == list(range(parts[0]["n_pieces"])) and len(parts) == parts[0]["n_pieces"]
        assert (len(parts) > 1) == (size[i] > cap[of[i]])
    load = {}
    for r in packed:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
        assert load[r["container_id"]] <= r["capacity"]
    bins = {s: len({r["container_id"] for r in packed if r["source"] == s}) for s in cap}
    for s, c in cap.items():
        whole = sum(n // c if n > c else 0 for i, n in size.items() if of[i] == s)
        rest = [n % c if n > c else n for i, n in size.items() if of[i] == s and not (n > c and n % c == 0)]
        assert whole + math.ceil(sum(rest) / c) <= bins[s] <= whole + 1.01 * brute_best_fit(rest, c) + 1
    df = spark.createDataFrame(packed)
    assert {r["doc_id"] for r in split_by_packing(df).collect()} == {i for i, n in size.items() if n > cap[of[i]]}
    assert {r["source"] for r in container_report(df).collect()} == {"a", "b"}


def test_pack_nothing(spark):
    plan = spark.createDataFrame([("a", 1.0, 1, 10)], PLAN)
    assert pack_documents(docs_frame(spark, []), plan).count() == 0
    assert pack_documents(docs_frame(spark, [(1, "a", "w")]), plan.limit(0)).count() == 0


# --- mixing ---


def test_budgets():
    # Within the limits the targets themselves.
    assert source_budgets([150, 100, 50], [200, 100, 60], 300) == ([150, 100, 50], 1.0)
    # What the first leaves goes to the others in proportion to their targets.
    takes, a = source_budgets([200, 60, 40], [100, 500, 400], 300)
    assert a == 1.0 and takes == pytest.approx([100, 120, 80])
    # ... and where that would repeat one too often, the exponent gives way, for all alike.
    takes, a = source_budgets([200, 60, 40], [100, 90, 400], 300)
    assert 0 < a < 1 and sum(takes) == pytest.approx(300) and takes[0] == 100 and takes[1] == pytest.approx(90) and takes[2] == pytest.approx(110)
    assert source_budgets([200, 60, 40], [100, 90, 70], 300) == ([100, 90, 70], 0.0)
    assert source_budgets([0, 0], [10, 10], 5)[0] == pytest.approx([2.5, 2.5]) and source_budgets([], [], 0) == ([], 1.0)


@pytest.mark.parametrize("seed", range(200))
def test_budgets_keep_limits_and_targets(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    tokens = [rng.choice([0, 1, 10, 1000, 10**6]) * rng.randint(1, 9) for _ in range(n)]
    limits = [rng.randint(0, 4) * t for t in tokens]
    t = [rng.random() * rng.choice([0, 1, 1]) for _ in range(n)]
    wanted = [x / (sum(t) or 1) * sum(tokens) for x in t]
    takes, a = source_budgets(wanted, limits, sum(tokens))
    for take, want, limit in zip(takes, wanted, limits):
        assert min(want, limit) <= take * (1 + 1e-9) + 1e-9 and take <= limit
    assert sum(takes) == pytest.approx(min(sum(limits), max(sum(tokens), sum(map(min, wanted, limits)))), rel=1e-6, abs=1e-6)


def test_exponent_decides_the_mix(spark):
    rows = [(i, s, "w " * 10) for i, s in enumerate(["a"] * 10 + ["b"] * 40 + ["c"] * 150)]
    plan = spark.createDataFrame([("a", 0.5, 2, 1), ("b", 0.3, 4, 1), ("c", 0.2, 2, 1)], PLAN)
    of = lambda **k: {r["source"]: r["mix_tokens"] for r in mix_documents(docs_frame(spark, rows), plan, **k).report().collect()}
    free, natural = of(), of(exponent=0.0)
    assert free["a"] == natural["a"] == 200 and sum(free.values()) == sum(natural.values()) == 2000
    assert free["b"] == 1080 and natural["b"] < 900 and natural["c"] > free["c"]
    flat = of(entropy=10.0)
    assert flat["a"] == 200 and abs(flat["b"] - flat["c"]) <= 20


def test_tempered_shares():
    t = [700, 200, 100, 0]
    h = lambda s: -sum(p * math.log(p) for p in s if p > 0)
    assert tempered_shares(t, 1.0) == pytest.approx([0.7, 0.2, 0.1, 0]) and tempered_shares(t, 0.0) == pytest.approx([1 / 3] * 3 + [0])
    assert h(entropy_shares(t, 1.0)) == pytest.approx(1.0) and entropy_shares(t, 0.1) == pytest.approx([0.7, 0.2, 0.1, 0])
    assert entropy_shares(t, 5.0) == pytest.approx([1 / 3] * 3 + [0]) and tempered_shares([], 1) == [] and tempered_shares([0, 0], 1) == [0, 0]


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, s, "w " * rng.randint(1, 40)) for i, s in enumerate(["big"] * 600 + ["mid"] * 150 + ["small"] * 20)]
    odd = [(9000, "big", None), (9001, None, "w"), (None, "mid", "w"), (9002, "other", "w w"), (3, "big", rows[3][2])]
    plan = spark.createDataFrame([("big", 0.3, 1, 1), ("mid", 0.4, 3, 1), ("small", 0.3, 4, 1), ("gone", 0.0, 2, 1), ("void", 0.1, None, 1), (None, 0.1, 1, 1)], PLAN)
    mix = mix_documents(docs_frame(spark, rows + odd), plan)
    used = mix.rows.collect()
    size = {i: len((t or "").split()) for i, s, t in rows + odd if i is not None and s in ("big", "mid", "small")}
    total = {s: sum(size[i] for i, x, _ in rows if x == s) for s in ("big", "mid", "small")}
    everything = sum(total.values())
    uses, tokens = {}, {}
    for r in used:
        assert r["n_tokens"] == size[r["doc_id"]] and 0 <= r["mix_pos"] <= 1
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n_tokens"]
    assert len({(r["doc_id"], r["epoch"]) for r in used}) == len(used)
    limit = {"big": 1, "mid": 3, "small": 4}
    assert all(n <= limit[s] for i, s, _ in rows if (n := uses.get(i, 0)))
    report = {r["source"]: r for r in mix.report().collect()}
    for s, share in (("big", 0.3), ("mid", 0.4), ("small", 0.3)):
        want = min(share * everything, limit[s] * total[s])
        assert tokens[s] >= want - 40 and report[s]["mix_tokens"] == tokens[s] <= limit[s] * total[s]
        assert report[s]["reachable"] == (limit[s] * total[s] >= share * everything)
        assert math.isclose(report[s]["reached_share"], tokens[s] / everything, abs_tol=1e-6)
    assert abs(sum(tokens.values()) - min(everything, sum(limit[s] * total[s] for s in limit))) <= 120
    assert report["gone"]["reachable"] and not report["void"]["reachable"] and report["void"]["mix_tokens"] == 0
    again = mix_documents(docs_frame(spark, (rows + odd)[::-1]).repartition(5), plan).rows.collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in used}


def test_mix_of_nothing(spark):
    plan = spark.createDataFrame([("a", 1.0, 1, 10)], PLAN)
    mix = mix_documents(docs_frame(spark, []), plan)
    assert mix.rows.count() == 0 and mix.report().count() == 1
    assert mix_documents(docs_frame(spark, [(1, "a", "w")]), plan.limit(0)).report().count() == 0
