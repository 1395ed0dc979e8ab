"""Swedish, Norwegian and Danish."""

from __future__ import annotations

from lexquarry.functions.stemmers.regions import after_vowel_consonant, longest, sets


def _r1(word: str, vowels: str) -> int:
    """The region's start, at least the fourth letter; the end if no consonant follows a vowel or the word is short."""
    if len(word) < 3:
        return len(word)
    i = after_vowel_consonant(word, vowels)
    if i == len(word) and word[-1] in vowels:
        return len(word)
    return max(i, 3)


# Swedish.
SV_VOWELS = "aeiouyäåö"
SV_S = "bcdfghjklmnoprtvy"
SV_OST = "iklnprtuv"
SV_KEEP_ET = set("alit cit dit fab h iet ilit ivit kom kvit mit nit pak pit rak rit sit stak tit uit xit".split())
SV_MAIN = sets(
    cut="a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas "
    "es ades andes ens arens hetens erns at andet het ast",
    s="s",
    et="et",
)
SV_PAIRS = set("dd gd nn dt gt kt tt".split())
SV_OTHER = sets(cut="ig lig els", ost="öst", full="fullt")


def swedish(word: str) -> str:
    w, r1 = word, _r1(word, SV_VOWELS)

    def et_may_go(left: str) -> bool:
        return len(left) > 2 and left[-1] not in SV_VOWELS and left[-2] in SV_VOWELS and not longest(left, SV_KEEP_ET)

    end = longest(w, SV_MAIN, r1)
    if end:
        left, kind = w[: -len(end)], SV_MAIN[end]
        if kind == "cut" or kind == "et" and et_may_go(left):
            w = left
        elif kind == "s":
            if left.endswith("et") and et_may_go(left[:-2]):
                w = left[:-2]
            elif left and left[-1] in SV_S:
                w = left
    if longest(w, SV_PAIRS, r1):
        w = w[:-1]
    end = longest(w, SV_OTHER, r1)
    if end:
        left, kind = w[: -len(end)], SV_OTHER[end]
        if kind == "cut":
            w = left
        elif kind == "full":
            w = left + "full"
        elif left and left[-1] in SV_OST:
            w = left + "ös"
    return w


# Norwegian.
NO_VOWELS = "aeiouyåæêòóôø"
NO_S = "bcdfghjlmnoptvyz"
NO_MAIN = sets(
    cut="a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ets et het ast",
    ers="ers",
    s="s",
    ert="erte ert",
)
NO_KEEP_ERS = set("amm ast ind kap kk lt nk omm pp v øst".split())
NO_CUT_ERS = set("giv hav skap".split())
NO_OTHER = set("leg eleg ig eig lig elig els lov elov slov hetslov".split())


def norwegian(word: str) -> str:
    w, r1 = word, _r1(word, NO_VOWELS)
    end = longest(w, NO_MAIN, r1)
    if end:
        left, kind = w[: -len(end)], NO_MAIN[end]
        if kind == "cut":
            w = left
        elif kind == "ert":
            w = left + "er"
        elif kind == "ers":
            w = left if (longest(left, NO_KEEP_ERS | NO_CUT_ERS) or "skap") in NO_CUT_ERS else w
        elif left and (left[-1] in NO_S or left[-1] == "r" and left[-2:-1] != "e" or left[-1] == "k" and len(left) > 1 and left[-2] not in NO_VOWELS):
            w = left
    if longest(w, ("dt", "vt"), r1):
        w = w[:-1]
    end = longest(w, NO_OTHER, r1)
    return w[: -len(end)] if end else w


# Danish.
DA_VOWELS = "aeiouyåæø"
DA_CONSONANTS = "bcdfghjklmnpqrstvwxz"
DA_S = "abcdfghjklmnoprtvyzå"
DA_MAIN = sets(
    cut="hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres "
    "ens hedens erens ers ets erets et eret",
    s="s",
)
DA_PAIRS = set("gd dt gt kt".split())
DA_OTHER = sets(cut="ig lig elig els", st="løst")


def danish(word: str) -> str:
    w, r1 = word, _r1(word, DA_VOWELS)
    pair = lambda x: x[:-1] if longest(x, DA_PAIRS, r1) else x
    end = longest(w, DA_MAIN, r1)
    if end and (DA_MAIN[end] == "cut" or w[-2:-1] and w[-2] in DA_S):
        w = w[: -len(end)]
    w = pair(w)
    if w.endswith("igst"):
        w = w[:-2]
    end = longest(w, DA_OTHER, r1)
    if end:
        w = w[:-1] if DA_OTHER[end] == "st" else pair(w[: -len(end)])
    if len(w) > max(r1, 1) and w[-1] == w[-2] and w[-1] in DA_CONSONANTS:
        w = w[:-1]
    return w
