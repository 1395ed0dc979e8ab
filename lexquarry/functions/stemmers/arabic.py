"""Arabic: endings by whether the word may be a verb or a noun, then beginnings."""

from __future__ import annotations

import re
import unicodedata

from lexquarry.functions.stemmers.regions import longest

# Fixed values of the algorithm: endings and beginnings with the least length of the word that may lose them.
MARKS = re.compile("[ـًٌٍَُِّْ]")
DIGITS = {ord("٠") + i: str(i) for i in range(10)}
ARTICLES = {"ال": 4, "لل": 4, "بال": 5, "كال": 5}
VERB_OBJECTS = {"ك": 4, "ه": 4, "كم": 5, "كن": 5, "نا": 5, "ني": 5, "ها": 5, "هم": 5, "هن": 5, "كما": 6, "كمو": 6, "هما": 6}
VERB_PERSONS = {"ا": 4, "ت": 4, "ن": 4, "ي": 4, "تا": 5, "تن": 5, "نا": 5, "ان": 6, "ون": 6, "ين": 6, "تما": 6}
VERB_PLURALS = {"تم": 5, "وا": 5}
VERB_LINKS = {"و": 4, "تمو": 6}
NOUN_OWNERS = {"ك": 4, "ه": 4, "ي": 4, "كم": 5, "نا": 5, "ها": 5, "هم": 5, "هن": 5, "كما": 6, "هما": 6}
NOUN_CASES = {"ا": 5, "و": 5, "ي": 5}
HAMZA_STARTS = {"أأ": "أ", "أؤ": "أ", "أآ": "آ", "أا": "ا", "أإ": "إ"}
VERB_STARTS = {"سي": "ي", "ست": "ت", "سن": "ن", "سأ": "أ"}
ASKING_STARTS = ("يست", "نست", "تست")


class _Word:
    def __init__(self, text: str):
        self.text = text

    def cut(self, ends: dict[str, int]) -> bool:
        """Cuts the longest of the endings if the word is long enough for it."""
        end = longest(self.text, ends)
        if not end or len(self.text) < ends[end]:
            return False
        self.text = self.text[: -len(end)]
        return True

    def verb_ending(self) -> bool:
        found = False
        while self.cut(VERB_OBJECTS):
            found = True
        if found and (self.cut(VERB_PERSONS) or self.cut(VERB_LINKS) or self.text):
            return True
        return self.cut(VERB_PLURALS) or self.cut(VERB_PERSONS)

    def noun_ending(self, defined: bool) -> bool:
        def plural() -> bool:
            return self.cut(NOUN_CASES) or self.cut({"ات": 5}) or self.cut({"ت": 4})

        if not self.cut({"ة": 4}):
            if not defined and self.cut(NOUN_OWNERS):
                plural()
            elif not (self.cut({"ن": 6}) and plural()):
                (not defined and self.cut(NOUN_CASES)) or self.cut({"ات": 5})
        return self.cut({"ي": 3})


def _beginning(w: str, noun: bool, verb: bool) -> str:
    if len(w) > 3 and w[:2] in HAMZA_STARTS:
        w = HAMZA_STARTS[w[:2]] + w[2:]
    if len(w) > 3 and w[0] in "فو" and w[1] != "ا":
        w = w[1:]
    for start in ("بال", "كال", "ال", "لل"):
        if w.startswith(start):
            if len(w) > ARTICLES[start]:
                return w[len(start) :]
            break
    if noun:
        if w.startswith("با"):
            return w
        if len(w) > 3 and (w[:2] in ("بب", "كك") or w[0] == "ب"):
            return w[1:]
    if verb:
        if len(w) > 4 and w[:2] in VERB_STARTS:
            w = VERB_STARTS[w[:2]] + w[2:]
        if len(w) > 4 and w.startswith(ASKING_STARTS):
            w = "است" + w[3:]
    return w


def stem(word: str) -> str:
    noun = verb = True
    defined = False
    for start in ("بال", "كال", "ال", "لل"):
        if word.startswith(start):
            if len(word) >= ARTICLES[start]:
                verb, defined = False, True
            break
    text = MARKS.sub("", word).translate(DIGITS)
    w = _Word("".join(unicodedata.normalize("NFKC", c) if "ﹰ" <= c <= "ﻼ" else c for c in text))
    if not (verb and w.verb_ending() or noun and w.noun_ending(defined)) and w.text.endswith("ى"):
        w.text = w.text[:-1] + "ي"
    out = _beginning(w.text, noun, verb) if w.text else w.text
    if out and out[-1] in "آأؤإئ":
        out = out[:-1] + "ء"
    return out.translate({ord("آ"): "ا", ord("أ"): "ا", ord("إ"): "ا", ord("ؤ"): "و", ord("ئ"): "ي"})
