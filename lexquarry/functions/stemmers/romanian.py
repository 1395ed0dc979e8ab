"""Romanian."""

from __future__ import annotations

import re

from lexquarry.functions.stemmers.regions import longest, r1_r2, sets

# Fixed values of the algorithm. The first tables give what replaces an ending.
VOWELS = "aeiouâîă"
PLURALS = {
    "ul": "", "ului": "", "aua": "a", "ea": "e", "ele": "e", "elor": "e", "ii": "i", "iua": "i", "iei": "i", "iile": "i", "iilor": "i",
    "ilor": "i", "ile": "i", "atei": "at", "ație": "ați", "ația": "ați",
}
COMBINED = sets(
    abil="abilitate abilitati abilităi abilități",
    ibil="ibilitate",
    iv="ivitate ivitati ivităi ivități",
    ic="icitate icitati icităi icități icator icatori iciv iciva icive icivi icivă ical icala icale icali icală",
    at="ativ ativa ative ativi ativă ațiune atoare ator atori ătoare ător ători",
    it="itiv itiva itive itivi itivă ițiune itoare itor itori",
)
STANDARD = sets(
    cut="at ata ată ati ate ut uta ută uti ute it ita ită iti ite ic ica ice ici ică abil abila abile abili abilă ibil ibila ibile ibili ibilă "
    "oasa oasă oase os osi oși ant anta ante anti antă ator atori itate itati ităi ități iv iva ive ivi ivă",
    t="iune iuni",
    ist="ism isme ist ista iste isti istă iști",
)
VERBS = sets(
    after="are ere ire âre ind ând indu ându eze ească ez ezi ează esc ești ește ăsc ăști ăște am ai au eam eai ea eați eau iam iai ia iați iau ui "
    "ași arăm arăți ară uși urăm urăți ură iși irăm irăți iră âi âși ârăm ârăți âră asem aseși ase aserăm aserăți aseră isem iseși ise iserăm "
    "iserăți iseră âsem âseși âse âserăm âserăți âseră usem useși use userăm userăți useră",
    cut="ăm ați em eți im iți âm âți seși serăm serăți seră sei se sesem seseși sese seserăm seserăți seseră",
)


def stem(word: str) -> str:
    w = word.replace("ş", "ș").replace("ţ", "ț")
    w = re.sub(f"(?<=[{VOWELS}])([ui])(?=[{VOWELS}])", lambda m: m[0].upper(), w)
    r1, r2 = r1_r2(w, VOWELS)
    rv = _rv(w)
    end = longest(w, PLURALS)
    if end and len(w) - len(end) >= r1 and not (end == "ile" and w.endswith("abile")):
        w = w[: -len(end)] + PLURALS[end]
    removed = False
    while (end := longest(w, COMBINED)) and len(w) - len(end) >= r1:
        w, removed = w[: -len(end)] + COMBINED[end], True
    end = longest(w, STANDARD)
    if end and len(w) - len(end) >= r2:
        left, rule = w[: -len(end)], STANDARD[end]
        if rule != "t":
            w, removed = left + ("ist" if rule == "ist" else ""), True
        elif left.endswith("ț"):
            w, removed = left[:-1] + "t", True
    if not removed and (end := longest(w, VERBS, rv)):
        left = w[: -len(end)]
        if VERBS[end] == "cut" or len(left) > rv and (left[-1] not in VOWELS or left[-1] == "u"):
            w = left
    end = longest(w, ("a", "e", "i", "ie", "ă"))
    if end and len(w) - len(end) >= rv:
        w = w[: -len(end)]
    return w.replace("I", "i").replace("U", "u")


def _rv(w: str) -> int:
    n = len(w)
    if n < 2:
        return n
    first, second = w[0] in VOWELS, w[1] in VOWELS
    if not first and second:
        return min(3, n)
    stop = not (first and second)  # seek a vowel, or after two vowels a consonant
    i = next((i for i in range(2, n) if (w[i] in VOWELS) == stop), None)
    return n if i is None else i + 1
