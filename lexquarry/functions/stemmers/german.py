"""German, with ae, oe, ue and the sharp s as in the published current revision."""

from __future__ import annotations

import re

from lexquarry.functions.stemmers.regions import after_vowel_consonant, longest, sets

# Fixed values of the algorithm.
VOWELS = "aeiouyäöü"
S_ENDINGS = "bdfghklmnrt"
ST_ENDINGS = "bdfghklmnt"
ET_ENDINGS = "dfgklmnrstUzä"
KEEP_ET = ("geordn", "intern", "plan", "tick", "tr")
STEP_1 = sets(em="em", er="ern er erin erinnen", e="e en es", s="s", ln="ln lns")
STEP_2 = sets(plain="en er est", st="st", et="et")
STEP_2["est"] = "plain"
STEP_3 = sets(ung="end ung", ig="ig ik isch", lich="lich heit", keit="keit")
SPELLED = {"ß": "ss", "ae": "ä", "oe": "ö", "ue": "ü", "qu": "qu"}
PLAIN = str.maketrans({"U": "u", "Y": "y", "ä": "a", "ö": "o", "ü": "u"})


def stem(word: str) -> str:
    w = re.sub(f"(?<=[{VOWELS}])([uy])(?=[{VOWELS}])", lambda m: m[0].upper(), word)
    w = re.sub("ß|ae|oe|qu|ue", lambda m: SPELLED[m[0]], w)
    if len(w) < 3:
        return w.translate(PLAIN)
    first = after_vowel_consonant(w, VOWELS)
    r1, r2 = max(first, 3), after_vowel_consonant(w, VOWELS, first)
    if first == len(w) and w[-1] in VOWELS:
        r1 = r2 = len(w)

    end = longest(w, STEP_1)
    if end and len(w) - len(end) >= r1:
        left, kind = w[: -len(end)], STEP_1[end]
        if kind == "em":
            w = w if left.endswith("syst") else left
        elif kind == "er":
            w = left
        elif kind == "e":
            w = left[:-1] if left.endswith("niss") else left
        elif kind == "ln":
            w = left + "l"
        elif left and left[-1] in S_ENDINGS:
            w = left
    end = longest(w, STEP_2)
    if end and len(w) - len(end) >= r1:
        left, kind = w[: -len(end)], STEP_2[end]
        if kind == "plain":
            w = left
        elif kind == "st":
            w = left if len(left) >= 4 and left[-1] in ST_ENDINGS else w
        elif left and left[-1] in ET_ENDINGS and not left.endswith(KEEP_ET):
            w = left
    end = longest(w, STEP_3)
    if end and len(w) - len(end) >= r2:
        left, kind = w[: -len(end)], STEP_3[end]
        if kind == "ung":
            w = left
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif kind == "ig":
            w = w if left.endswith("e") else left
        elif kind == "lich":
            w = left
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = left
            more = longest(w, ("lich", "ig"))
            if more and len(w) - len(more) >= r2:
                w = w[: -len(more)]
    return w.translate(PLAIN)
