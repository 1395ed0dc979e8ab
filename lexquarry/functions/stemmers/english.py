"""English (the second Porter stemmer, as published in its current revision)."""

from __future__ import annotations

from lexquarry.functions.stemmers.regions import after_vowel_consonant, longest, sets

# Fixed values of the algorithm.
VOWELS = "aeiouy"
NOT_SHORT = "aeiouywxY"
LI_ENDINGS = "cdeghkmnrt"
DOUBLES = set("bb dd ff gg mm nn pp rr tt".split())
R1_PREFIXES = "arsen commun emerg gener inter later organ past univers".split()
WHOLE_WORDS = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {
    w: w for w in "andes atlas bias cosmos howe news sky".split()
}
KEEP_EED = ("succ", "proc", "exc")
KEEP_ING = set("even cann inn earr herr out".split())
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogist": "og", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = set("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())
STEP_1A = sets(double="sses", ie="ied ies", s="s", keep="us ss")
STEP_1B = sets(eed="eed eedly", ed="ed edly ingly", ing="ing")


def _short_end(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    if w.endswith("past"):
        return True
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in NOT_SHORT and w[-2] in VOWELS and w[-3] not in VOWELS


def _plurals(w: str) -> str:
    for mark in ("'s'", "'s", "'"):
        if w.endswith(mark):
            w = w[: -len(mark)]
            break
    end = longest(w, STEP_1A)
    kind = STEP_1A.get(end or "")
    if kind == "double":
        return w[:-2]
    if kind == "ie":
        return w[:-2] if len(w) > 4 else w[:-1]
    if kind == "s" and any(c in VOWELS for c in w[:-2]):
        return w[:-1]
    return w


def _past_and_ing(w: str, r1: int) -> str:
    end = longest(w, STEP_1B)
    kind = STEP_1B.get(end or "")
    if not kind:
        return w
    stem = w[: -len(end)]
    if kind == "eed":
        return stem + "ee" if len(stem) >= r1 and stem not in KEEP_EED else w
    if kind == "ing":
        if len(stem) == 2 and stem[1] == "y" and stem[0] not in VOWELS:
            return stem[0] + "ie"
        if stem in KEEP_ING:
            return w
    if not any(c in VOWELS for c in stem):
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem[-2:] in DOUBLES:
        return stem if len(stem) == 3 and stem[0] in "aeo" else stem[:-1]
    return stem + "e" if len(stem) == r1 and _short_end(stem) else stem


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    w = word.removeprefix("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS and w[i - 1] != "y") else c for i, c in enumerate(w))
    prefix = next((p for p in R1_PREFIXES if w.startswith(p)), None)
    r1 = len(prefix) if prefix else after_vowel_consonant(w, VOWELS)
    r2 = after_vowel_consonant(w, VOWELS, r1)

    w = _past_and_ing(_plurals(w), r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    end = longest(w, STEP_2)
    if end and len(w) - len(end) >= r1:
        left = w[: -len(end)]
        if end == "ogi":
            w = left + "og" if left.endswith("l") else w
        elif end == "li":
            w = left if left and left[-1] in LI_ENDINGS else w
        else:
            w = left + STEP_2[end]
    end = longest(w, STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP_3[end]
    end = longest(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")
