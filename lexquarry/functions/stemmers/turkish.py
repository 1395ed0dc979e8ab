"""Turkish: endings are peeled off the end, verbal ones first, then those of nouns."""

from __future__ import annotations

# Vowels, and for a word's last vowel those of which one must stand somewhere before it.
VOWELS = "aeıioöuü"
BEFORE = {"a": "aouı", "e": "eiöü", "ı": "aı", "i": "ei", "o": "ou", "ö": "öü", "u": "ou", "ü": "öü"}
#: A final d or g gets the close vowel of its kind.
CLOSE = {"a": "ı", "ı": "ı", "e": "i", "i": "i", "o": "u", "u": "u", "ö": "ü", "ü": "ü"}
LAST = {"b": "p", "c": "ç", "d": "t", "ğ": "k"}

# The endings by name; a capital stands for the vowels and consonants it varies between.
PLAIN = {  # must agree with the word's vowels
    "nU": "ni nu nı nü", "nA": "na ne", "DA": "da ta de te", "ndA": "nda nde", "DAn": "dan tan den ten", "ndAn": "ndan nden",
    "sUn": "sin sun sın sün", "lAr": "lar ler", "nUz": "niz nuz nız nüz", "DUr": "dir tir dur tur dır tır dür tür",
}
FREE = {"lArI": "leri ları", "ki": "ki", "sUnUz": "siniz sunuz sınız sünüz", "cAsInA": "casına cesine"}
LINKED = {  # agree, and may have the consonant named before them
    "sU": ("s", "i u ü ı"), "yU": ("y", "i u ü ı"), "nUn": ("n", "in un ın ün"), "yA": ("y", "a e"), "ylA": ("y", "la le"), "ncA": ("n", "ca ce"),
    "yUm": ("y", "im um ım üm"), "yUz": ("y", "iz uz ız üz"), "ymUş": ("y", "miş muş mış müş"),
    "yDU": ("y", "di ti dik tik duk tuk dık tık dük tük dim tim dum tum dım tım düm tüm din tin dun tun dın tın dün tün du tu dı tı dü tü"),
}
FREE_LINKED = {"ysA": ("y", "sa se sak sek sam sem san sen"), "yken": ("y", "ken")}
POSSESSIVES = "m n miz niz muz nuz mız nız müz nüz"


def _agrees(word: str) -> bool:
    at = max((i for i, c in enumerate(word) if c in VOWELS), default=-1)
    return at >= 0 and any(c in BEFORE[word[at]] for c in word[:at])


def _linked(word: str, link: str, after: bool) -> str | None:
    """``word`` without a linking letter, which stands after a vowel (``after``) or a consonant; None if its absence doesn't fit either."""
    fits = len(word) > 1 and (word[-2] in VOWELS) == after
    if word and word[-1] in link:
        return word[:-1] if fits else None
    return word if fits else None


def _make():
    known = {k: (True, None, v) for k, v in PLAIN.items()} | {k: (False, None, v) for k, v in FREE.items()}
    known |= {k: (True, c, v) for k, (c, v) in LINKED.items()} | {k: (False, c, v) for k, (c, v) in FREE_LINKED.items()}
    return {k: (agree, link, sorted(v.split(), key=len, reverse=True)) for k, (agree, link, v) in known.items()}


_ENDINGS = _make()
_OWN = sorted(POSSESSIVES.split(), key=len, reverse=True)


def _cut(word: str, *names: str) -> str | None:
    """``word`` without the first of the named endings that it has; None if it has none."""
    for name in names:
        if name == "own":
            end = next((e for e in _OWN if word.endswith(e)), None)
            rest = None if end is None else _linked(word[: -len(end)], "iuüı", False)
        else:
            agree, link, ends = _ENDINGS[name]
            end = next((e for e in ends if word.endswith(e)), None)
            if end is None or agree and not _agrees(word):
                continue
            rest = word[: -len(end)]
            rest = rest if link is None else _linked(rest, link, True)
        if rest is not None:
            return rest
    return None


_PERSON = ("sUnUz", "lAr", "yUm", "sUn", "yUz")


def _verbal(word: str) -> tuple[str, bool]:
    """(word without its verbal endings, whether it may have endings of nouns)."""
    rest = _cut(word, "ymUş", "yDU", "ysA", "yken")
    if rest is not None:
        return rest, True
    if (rest := _cut(word, "cAsInA")) is not None:
        person = _cut(rest, *_PERSON)
        if (rest := _cut(rest if person is None else person, "ymUş")) is not None:
            return rest, True
    if (rest := _cut(word, "lAr")) is not None:
        more = _cut(rest, "DUr", "yDU", "ysA", "ymUş")
        return rest if more is None else more, False
    if (rest := _cut(word, "nUz")) is not None and (rest := _cut(rest, "yDU", "ysA")) is not None:
        return rest, True
    if (rest := _cut(word, "sUnUz", "yUz", "sUn", "yUm")) is not None:
        more = _cut(rest, "ymUş")
        return rest if more is None else more, True
    if (rest := _cut(word, "DUr")) is not None:
        person = _cut(rest, *_PERSON)
        more = _cut(rest if person is None else person, "ymUş")
        return rest if more is None else more, True
    return word, True


# What follows works on (head, kept): endings are read off the head, ``kept`` stays after it. An ending before "ki" may go while one after it stays.


def _ki(head: str, kept: str) -> tuple[str, str] | None:
    """Without "ki" and the endings before it; None if there is none."""
    before = _cut(head, "ki")
    if before is None:
        return None
    if (rest := _cut(before, "DA")) is not None:
        if (plural := _cut(rest, "lAr")) is not None:
            return _ki(plural, kept) or (plural, kept)
        own = _cut(rest, "own")
        return (rest, kept) if own is None else _plural(own, kept)
    if (rest := _cut(before, "nUn")) is not None:
        return _owned(rest, kept) or _ki(rest, kept) or (rest, kept)
    if (rest := _cut(before, "ndA")) is not None:
        if (bare := _cut(rest, "lArI")) is not None:
            return bare, kept
        if (bare := _cut(rest, "sU")) is not None:
            return _plural(bare, kept)
        return _ki(rest, head[len(rest) :] + kept)
    return None


def _plural(head: str, kept: str) -> tuple[str, str]:
    rest = _cut(head, "lAr")
    return (head, kept) if rest is None else _ki(rest, kept) or (rest, kept)


def _owned(head: str, kept: str) -> tuple[str, str] | None:
    """Without an ending of a possessor, and a plural before it; None if there is none."""
    if (rest := _cut(head, "lArI")) is not None:
        return rest, kept
    rest = _cut(head, "own", "sU")
    return None if rest is None else _plural(rest, kept)


def _nominal(word: str) -> tuple[str, str]:
    if (rest := _cut(word, "lAr")) is not None:
        return _ki(rest, "") or (rest, "")
    if (rest := _cut(word, "ncA")) is not None:
        return _owned(rest, "") or _plural(rest, "")
    if (rest := _cut(word, "ndA", "nA")) is not None:
        if (bare := _cut(rest, "lArI")) is not None:
            return bare, ""
        if (bare := _cut(rest, "sU")) is not None:
            return _plural(bare, "")
        if found := _ki(rest, word[len(rest) :]):
            return found
    if (rest := _cut(word, "ndAn", "nU")) is not None:
        if (bare := _cut(rest, "sU")) is not None:
            return _plural(bare, "")
        if _cut(rest, "lArI") is not None:
            return word, ""
    if (rest := _cut(word, "DAn")) is not None:
        if (own := _cut(rest, "own")) is not None:
            return _plural(own, "")
        return _plural(rest, "") if _cut(rest, "lAr") is not None else _ki(rest, "") or (rest, "")
    if (rest := _cut(word, "nUn", "ylA")) is not None:
        if (plural := _cut(rest, "lAr")) is not None:
            if found := _ki(plural, ""):
                return found
            rest = plural
        own = _cut(rest, "own", "sU")
        return _plural(own, "") if own is not None else _ki(rest, "") or (rest, "")
    if (rest := _cut(word, "lArI")) is not None:
        return rest, ""
    if found := _ki(word, ""):
        return found
    if (rest := _cut(word, "DA", "yU", "yA")) is not None:
        own = _cut(rest, "own")
        if own is None and _cut(rest, "lAr") is None:
            return rest, ""
        head = rest if own is None else own
        plural = _cut(head, "lAr")
        head = head if plural is None else plural
        return _ki(head, "") or (head, "")
    rest = _cut(word, "own", "sU")
    return (word, "") if rest is None else _plural(rest, "")


def stem(word: str) -> str:
    w = word.lstrip("'")
    if (at := w.find("'", 2)) >= 0:
        w = w[:at]
    if sum(c in VOWELS for c in w) < 2:
        return w
    w, noun = _verbal(w)
    if not noun:
        return w
    w = "".join(_nominal(w))
    if w in ("ad", "soyad"):
        return w
    if w.endswith(("d", "g")) and (vowels := [c for c in w if c in VOWELS]):
        w += CLOSE[vowels[-1]]
    return w[:-1] + LAST.get(w[-1:], w[-1:])
