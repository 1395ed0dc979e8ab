"""Look-alike texts: forms, and pairs against brute force."""

import itertools
import random

import pytest

from lexquarry.llm.lookalike import (
    _LETTERS as LETTERS,
    LOOK,
    canonical_token,
    canonical_texts,
    fold_token,
    latin_look,
    look,
    lookalike_classes,
    lookalike_pairs,
    mixed_tokens,
    normalise,
    repair,
    settle,
    settle_kana,
)

SAME = [
    ("ａｂｃ１", "abc1"),
    ("ﬁlm", "film"),
    ("café", "café"),
    ("a​b­c﻿", "abc"),
    ("a b c　d", "a b c d"),
    ("ｶﾞｷﾞ", "ガギ"),
    ("が", "が"),
    ("pаssаt", "passat"),
    ("οmega", "omega"),
    ("օne", "one"),
    ("ɡas", "gas"),
    ("кapтинe", "картине"),
    ("сор", "cop"),
    ("ёж", "ëж"),
    ("ÅΩ", "ÅΩ"),
    ("エ", "工"),
    ("ꓓꓳꓖ", "DOG"),
    ("ᎪᏟᎬ", "ACE"),
    ("ⲣⲟⲣ", "pop"),
    ("ᴄᴏᴡ", "cow"),
    ("𝖼𝖺𝗋 𝟸𝟶", "car 20"),
    ("a\u180bb\u2800c", "ab c"),
    ("x\U000e0041y", "xy"),
]
DIFFERENT = [("cafe", "café"), ("A", "a"), ("o", "0"), ("l", "1"), ("x²", "x2"), ("ab", "a b"), ("ß", "ss"), ("rn", "m"), ("a-b", "a b"), ("ñ", "n"), ("\u0600a", "a"), ("𝐚", "a"), ("ι", "i")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert look(normalise(a)) == look(normalise(b))


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert look(normalise(a)) != look(normalise(b))


def test_normalising_twice_changes_nothing():
    rng = random.Random(2)
    letters = "abcé ｱﾞﾊﾟﬁﬀ‍゙́̈か가각가①²½㎞Ⅷ \t\n\x07퟿"
    for _ in range(3000):
        once = normalise("".join(rng.choice(letters) for _ in range(rng.randint(0, 10))))
        assert normalise(once) == once and look(look(once)) == look(once)


def test_folding_depends_on_the_look_alone():
    rng = random.Random(3)
    for _ in range(2000):
        base = "".join(rng.choice("aeopcxyktmщжпgvn") for _ in range(rng.randint(1, 8)))
        swap = str.maketrans("aeopcxy", "аеорсху")
        a, b = ("".join(c.translate(swap) if rng.random() < 0.5 else c for c in base) for _ in range(2))
        assert fold_token(a) == fold_token(b) and look(fold_token(a)) == look(a)
    assert mixed_tokens("plain text") == [] and mixed_tokens("чистый текст") == [] and mixed_tokens("В кapтинe Zifo") == ["кapтинe"]


TEXTS = "field_name string, key bigint, text string, look string, raw string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], TEXTS)


def test_repair_uses_the_vocabulary(spark):
    rows = [("f", 1, "картине мира"), ("f", 2, "кapтинe мира"), ("f", 3, "passat"), ("f", 4, "pаssаt"), ("f", 5, "unknоwn"), ("f", 6, "unknοwn"), ("f", 7, "ab")]
    form = {r["key"]: r["form"] for r in canonical_texts(frame(spark, rows)).collect()}
    assert form[2] == "картине мира" and form[4] == "passat" and form[5] == form[6] == "unknown" and form[7] == "ab"


def test_vocabulary_decides_between_scripts(spark):
    rows = [("f", 1, "сор сор"), ("f", 2, "сoр")]
    form = {r["key"]: r["form"] for r in canonical_texts(frame(spark, rows)).collect()}
    assert form == {1: "сор сор", 2: "сор"}
    form = {r["key"]: r["form"] for r in canonical_texts(frame(spark, [*rows, ("f", 3, "cop")])).collect()}
    assert form == {1: "cop cop", 2: "cop", 3: "cop"}


def test_the_text_decides_where_letters_do_not(spark):
    rows = [("f", 1, "в дом a не cop"), ("f", 2, "в дом а не сор"), ("f", 3, "good cop"), ("f", 4, "good сор"), ("f", 5, "スター"), ("f", 6, "スタ一"), ("f", 7, "二人"), ("f", 8, "ニ人")]
    form = {r["key"]: r["form"] for r in canonical_texts(frame(spark, rows)).collect()}
    assert form[1] == form[2] == "в дом а не сор" and form[3] == form[4] == "good cop" and form[5] == form[6] == "スター" and form[7] == form[8] == "二人"


def forms_by_hand(texts):
    """Forms of texts that are the whole corpus, one after the other."""
    plain = [settle_kana(normalise(t)) for t in texts]
    known = {}
    for t in sorted({t for f in plain for t in LETTERS.findall(f)}):
        if canonical_token(t):
            n = sum(LETTERS.findall(f).count(t) for f in plain)
            known.setdefault(latin_look(t), []).append((t != latin_look(t), -n, t))
    told = {b: min(v)[2] for b, v in known.items()}
    return [repair(f, {t: told.get(latin_look(t), fold_token(t)) for t in ask}) for f, ask in map(settle, plain)]


def test_equal_forms_are_equal_looks():
    """Texts whose look-alikes were swapped at random get one form, others don't, and a form looks like its text."""
    rng = random.Random(11)
    twins = {}
    for c, b in LOOK.items():
        if len(b) == 1:
            twins.setdefault(b, []).append(chr(c))
    letters, rest = list(twins), list("dfgkmtжщилбωλπաբⲁᏀꓛスメ字の1 ., é\u0301")
    for _ in range(1500):
        base = [rng.choice(letters if rng.random() < 0.6 else rest) for _ in range(rng.randint(1, 14))]
        made = ["".join(rng.choice(twins[c]) if c in twins and rng.random() < 0.4 else c for c in base) for _ in range(3)]
        made.append(made[0][:-1] + rng.choice(letters))
        forms, looks = forms_by_hand(made), [look(normalise(m)) for m in made]
        for f, lk in zip(forms, looks):
            assert look(f) == lk and (f == forms[0]) == (lk == looks[0])


def test_without_repair_pairs_are_lost(spark):
    rows = frame(spark, [("f", 1, "картине"), ("f", 2, "кapтинe"), ("f", 3, "passat"), ("f", 4, "pаssаt"), ("f", 5, "abc"), ("f", 6, "a\u200bbc")])
    pairs = lambda **k: {tuple(r)[1:] for r in lookalike_pairs(canonical_texts(rows, keep_text=False, **k)).collect()}
    assert pairs() == {(1, 2), (3, 4), (5, 6)} and pairs(repaired=False) == {(5, 6)}


def test_classes(spark):
    rows = [("f", i, t) for i, t in enumerate(["passat", "pаssat", "passat", "pаssаt", "other", "PASSAT"])] + [("g", 9, "pаssat")]
    got = {(r["field_name"], r["key"]): (r["class_id"], r["n_texts"], r["n_links"]) for r in lookalike_classes(canonical_texts(frame(spark, rows))).collect()}
    assert got == {("f", 0): (0, 3, 2), ("f", 1): (0, 3, 3), ("f", 2): (0, 3, 2), ("f", 3): (0, 3, 3)}
    assert lookalike_classes(canonical_texts(frame(spark, []))).count() == 0


def test_pairs(spark):
    rng = random.Random(6)
    bases = ["passat", "gamuvelon city", "картина", "cop", "café", "x" * 40_000 + "o", "", " "]
    odd = {"a": "а", "o": "ο", "p": "р", "c": "с", " ": " ", "g": "ɡ", "é": "é"}

    def disguised(t):
        t = "".join(odd.get(c, c) if rng.random() < 0.3 else c for c in t[:60]) + t[60:]
        return t if rng.random() < 0.5 else t[:1] + "​" + t[1:]

    rows = [("f", i, disguised(rng.choice(bases))) for i in range(120)] + [("g", i, disguised("passat")) for i in range(5)]
    rows += [("f", 900, None), ("f", None, "passat"), rows[0], rows[1], ("f", 901, "Passat"), ("f", 902, "cafe")]
    want = set()
    for (fa, ka, ta), (fb, kb, tb) in itertools.combinations([r for r in dict.fromkeys(rows) if None not in r], 2):
        if fa == fb and ta != tb and look(normalise(ta)) == look(normalise(tb)):
            want.add((fa, min(ka, kb), max(ka, kb)))
    got = lookalike_pairs(canonical_texts(frame(spark, rows), keep_text=False)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_pairs_of_nothing(spark):
    assert lookalike_pairs(canonical_texts(frame(spark, []))).count() == 0


def test_many_copies_are_not_paired(spark):
    rows = [("f", i, "passat") for i in range(2000)] + [("f", 5000, "pаssat")]
    assert lookalike_pairs(canonical_texts(frame(spark, rows))).count() == 2000
