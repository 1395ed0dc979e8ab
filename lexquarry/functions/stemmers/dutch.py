"""Dutch, after Kraaij and Pohlmann."""

from __future__ import annotations

from lexquarry.functions.stemmers.regions import longest, sets

# Fixed values of the algorithm.
VOWELS = "aeiouyàáâäèéêëìíîïòóôöùúûü"
AEIOU = "aeiouàáâäèéêëìíîïòóôöùúûü"
AIOU = "aiouàáâäìíîïòóôöùúûü"
E = "eèéêë"
DOUBLED = "aouàáâäòóôöùúûü"
STEP_1 = sets(apostrophe="'s", s="s", ies="ies", es="es", és="és", aus="aus", en="en", nde="nde")
STEP_2 = sets(je="je", ge="ge", lijke="lijke", ische="ische", de="de", te="te", se="se", re="re", le="le", ene="ene", ieve="ieve")
STEP_3 = sets(
    atie="atie", iteit="iteit", cut="heid sel ster", rder="rder", ing="ing isme erij", arij="arij", fie="fie", gie="gie", tst="tst", dst="dst"
)
STEP_4 = sets(
    ioneel="ioneel", atief="atief", cut="baar achtig achtiger achtigst", naar="naar", laar="laar", raar="raar", tant="tant", lijk="lijker lijkst",
    erig="end erig eriger erigst",
)
IG = ("ig", "iger", "igst")
KEEP_GE = ("eft", "vaa", "val", "vare")


def _c(w: str) -> bool:
    """Whether the word ends in a consonant."""
    return bool(w) and not w.endswith("ij") and w[-1] not in VOWELS


def _v(w: str) -> bool:
    return w.endswith("ij") or w[-1:] != "" and w[-1] in VOWELS


def _lengthened(w: str) -> str:
    """Writes the long vowel before the last consonant as two letters where spelling needs it."""
    if len(w) < 2 or w[-1] in VOWELS or w[-1] in "wx":
        return w
    head, last = w[:-1], w[-1]
    if head.endswith("eë"):
        return head + "e" + last
    if head.endswith("ië"):
        return head[:-1] + "ee" + last
    vowel, before = head[-1], head[:-1]
    if vowel not in DOUBLED and vowel not in "eèéê" or before and before[-1] in AEIOU:
        return w
    if vowel in "eèéê":
        back = before[:-1]
        if back and (back[-1] in AIOU or back[-1] in E and len(back) == 1):
            return w
        further = back[:-1]
        if len(further) > 1 and further[-1] in AIOU and further[-2] not in AEIOU:
            return w
    return before + vowel + vowel + last


def _after_v_c(w: str, start: int) -> int | None:
    """The place after the first consonant that follows vowels, None if there is none."""
    i, n = start, len(w)
    while i < n and w[i] not in VOWELS:
        i += 1
    begun = i
    while i < n:
        if w[i : i + 2] == "ij":
            i += 2
        elif w[i] in VOWELS:
            i += 1
        else:
            break
    return i + 1 if begun < i < n else None


def _measure(w: str) -> tuple[int, int]:
    r1 = _after_v_c(w, 0)
    if r1 is None:
        return len(w), len(w)
    r2 = _after_v_c(w, r1)
    return r1, len(w) if r2 is None else r2


def _step_1(w: str, r1: int) -> str | None:
    end = longest(w, STEP_1)
    if not end:
        return None
    left, rule = w[: -len(end)], STEP_1[end]
    inside = len(left) >= r1
    if rule == "apostrophe":
        return left
    if rule == "nde":
        return left + "nd"
    if rule == "s":
        if not inside or left.endswith("t") and len(left) - 1 >= r1 or not _c(left):
            return None
        return left
    if rule == "ies":
        return left + "ie" if inside else None
    if rule == "és":
        return left + "é" if inside else None
    if rule == "aus":
        return left + "au" if inside and _v(left) else None
    if rule == "es":
        if left.endswith(("ar", "er")) and len(left) - 2 >= r1 and _c(left[:-2]):
            return _lengthened(left) if left.endswith("ar") else left
        return left + "e" if inside and _c(left) else None
    if left.endswith("hed") and len(left) - 3 >= r1:
        return left[:-3] + "heid"
    if left.endswith("nd"):
        return left
    if left.endswith("d") and len(left) - 1 >= r1 and _c(left[:-1]):
        return left[:-1]
    if left.endswith(("i", "j")) and _v(left[:-1]):
        return left
    return _lengthened(left) if inside and _c(left) else None


def _diminutive(left: str, r1: int) -> str | None:
    if left.endswith("'t"):
        return left[:-2]
    if left.endswith("et") and len(left) - 2 >= r1 and _c(left[:-2]):
        return left[:-2]
    if left.endswith("rnt"):
        return left[:-1]
    if left.endswith("t") and len(left) - 1 >= r1 and len(left) > 1 and _v(left[:-2]):
        return left[:-1]
    if left.endswith("ink"):
        return left[:-1] + "g"
    if left.endswith("mp"):
        return left[:-1]
    if left.endswith("'") and len(left) - 1 >= r1:
        return left[:-1]
    return left if len(left) >= r1 and _c(left) else None


def _step_2(w: str, r1: int) -> str | None:
    end = longest(w, STEP_2)
    if not end:
        return None
    left, rule = w[: -len(end)], STEP_2[end]
    if rule == "je":
        return _diminutive(left, r1)
    if len(left) < r1 or rule in ("de", "ene", "ieve") and not _c(left):
        return None
    if rule == "de":
        return left
    if rule == "le":
        return _lengthened(left + "l")
    if rule == "ene":
        return _lengthened(left + "en")
    return left + {"ge": "g", "lijke": "lijk", "ische": "isch", "te": "t", "se": "s", "re": "r", "ieve": "ief"}[rule]


def _step_3(w: str, r1: int, r2: int) -> str | None:
    end = longest(w, STEP_3)
    if not end:
        return None
    left, rule = w[: -len(end)], STEP_3[end]
    if rule == "rder":
        return left + "r"
    if rule == "ing" and left.endswith("ild"):
        return left + "er"
    if len(left) < (r2 if rule in ("fie", "gie") else r1) or rule in ("arij", "tst", "dst") and not _c(left):
        return None
    if rule in ("iteit", "ing"):
        return _lengthened(left)
    if rule in ("fie", "gie"):
        return _lengthened(left + rule[0])
    return left + {"atie": "eer", "cut": "", "arij": "aar", "tst": "t", "dst": "d"}[rule]


def _step_4(w: str, r1: int) -> str | None:
    end = longest(w, STEP_4)
    if end and len(w) - len(end) >= r1:
        left, rule = w[: -len(end)], STEP_4[end]
        if rule == "erig":
            if _c(left):
                return _lengthened(left)
        elif rule in ("naar", "laar", "raar"):
            if _v(left):
                return left + rule[0]
        else:
            return left + {"ioneel": "ie", "atief": "eer", "cut": "", "tant": "teer", "lijk": "lijk"}[rule]
    end = longest(w, IG)
    if not end:
        return None
    left = w[: -len(end)]
    return _lengthened(left) if len(left) >= r1 and left != "inn" and _c(left) else None


def _without_ge(w: str, at: int) -> str | None:
    """The word without the ``ge`` at that place, if enough of a word follows it."""
    rest = w[at + 2 :]
    if len(rest) < 3 or _after_v_c(rest, 0) is None:
        return None
    return w[:at] + {"ë": "e", "ï": "i"}.get(rest[0], rest[0]) + rest[1:]


def _participle_end(w: str, r1: int) -> str:
    left = w[:-1]
    if w[-1:] not in ("d", "t") or len(left) < r1 or not _c(left):
        return w
    if w[-1] == "d":
        if left.endswith("n") and len(left) - 1 >= r1:
            return w
        return "inn" if left == "in" else left
    if left.endswith("h") and len(left) - 1 >= r1 or left == "en":
        return w
    return left


def stem(word: str) -> str:
    w, stemmed = word, False
    r1, r2 = _measure(w)
    for step in (lambda x: _step_1(x, r1), lambda x: _step_2(x, r1), lambda x: _step_3(x, r1, r2), lambda x: _step_4(x, r1)):
        new = step(w)
        if new is not None:
            w, stemmed = new, True
    if w.startswith("ge"):
        rest = w[2:]
        keeps = rest.startswith(KEEP_GE) and not rest.startswith("vali")
        new = None if keeps else _without_ge(w, 0)
        if new is not None:
            r1, r2 = _measure(new)
            w, stemmed = _participle_end(new, r1), True
    at = w.find("ge", 1)
    if at > 0 and (new := _without_ge(w, at)) is not None:
        r1, r2 = _measure(new)
        w, stemmed = _participle_end(new, r1), True
    if w.endswith(("kt", "ft", "pt")):
        w, stemmed = w[:-1], True
    if stemmed and w:
        if w[-1] in "vz":
            w = w[:-1] + ("f" if w[-1] == "v" else "s")
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bcdfghjklmnpqrstvwxz" and w != "inn":
            w = w[:-1]
    return w
