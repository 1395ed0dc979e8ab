"""Polish."""

from __future__ import annotations

from lexquarry.functions.stemmers.regions import after_vowel_consonant, longest, sets

# Fixed values of the algorithm.
VOWELS = "aeiouyóąę"
CONDITIONAL = set("by bym byś byśmy byście".split())
ENDINGS = sets(
    cut="a ia ą ią ę e ie u iu i o om iom em iem am ów owi iowi ach iach ami iami ąc ając ąca ająca ące ające ącą ającą sza iejsza sze iejsze "
    "iejszą cie acie ecie icie ajcie aj amy emy imy asz esz isz ają ać ieć ić ąć aść eść ał iał ił ała iała iła ało iało iło ały iały iły "
    "ali ieli ili ałam iałam iłam ałem iałem iłem ałaś iałaś iłaś ałeś iałeś iłeś aliśmy ieliśmy iliśmy ałyśmy iałyśmy iłyśmy aliście "
    "ieliście iliście ałyście iałyście iłyście",
    s="sząca szące szącą szę",
    szą="szą",
    ł="łaś łeś liśmy łyśmy liście łyście",
    adjective="y ej iej ego iego emu iemu ym im ich ych imi ymi",
)
COMPARATIVE = sets(cut="ąc ając sz iejsz", s="sząc")
SOFT = {"ć": "c", "ń": "n", "ś": "s", "ź": "z"}


def stem(word: str) -> str:
    w = word
    if len(w) >= 2:
        r1 = after_vowel_consonant(w, VOWELS)
        end = longest(w, CONDITIONAL, max(r1, 2))
        left = w[: -len(end)] if end else w
        end = longest(left, ENDINGS, 2)
        if end:
            stem_, rule = left[: -len(end)], ENDINGS[end]
            if rule == "s" or rule == "szą" and len(stem_) < r1:
                return stem_ + "s"
            if rule == "ł":
                return stem_ + "ł"
            if rule == "adjective" and (more := longest(stem_, COMPARATIVE, 2)):
                return stem_[: -len(more)] + ("s" if COMPARATIVE[more] == "s" else "")
            return stem_
        w = left
    if len(w) > 1 and w[-1] in SOFT:
        return w[:-1] + SOFT[w[-1]]
    return w
