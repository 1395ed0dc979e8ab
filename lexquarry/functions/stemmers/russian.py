"""Russian."""

from __future__ import annotations

from lexquarry.functions.stemmers.regions import after_vowel_consonant, longest

# Fixed values of the algorithm; of the first lists only endings after а or я count.
VOWELS = "аеиоуыэюя"
GERUND_AYA = set("в вши вшись".split())
GERUND = set("ив ивши ившись ыв ывши ывшись".split())
ADJECTIVE = set("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split())
PARTICIPLE_AYA = set("ем нн вш ющ щ".split())
PARTICIPLE = set("ивш ывш ующ".split())
VERB_AYA = set("ла на ете йте ли й л ем н ло но нно ет ют ны ть ешь".split())
VERB = set("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())
NOUN = set("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split())


def _cut(w: str, rv: int, free: set[str], after_aya: set[str]) -> str | None:
    end = longest(w, free | after_aya, rv)
    if not end:
        return None
    if end in free:
        return w[: -len(end)]
    left = w[: -len(end)]
    return left if len(left) > rv and left[-1] in "ая" else None


def stem(word: str) -> str:
    w = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in VOWELS), None)
    if rv is None:
        return w
    r1 = after_vowel_consonant(w, VOWELS)
    r2 = after_vowel_consonant(w, VOWELS, r1)

    gerund = _cut(w, rv, GERUND, GERUND_AYA)
    if gerund is not None:
        w = gerund
    else:
        end = longest(w, ("ся", "сь"), rv)
        w = w[: -len(end)] if end else w
        end = longest(w, ADJECTIVE, rv)
        if end:
            w = w[: -len(end)]
            w = _cut(w, rv, PARTICIPLE, PARTICIPLE_AYA) or w
        else:
            verb = _cut(w, rv, VERB, VERB_AYA)
            if verb is not None:
                w = verb
            else:
                end = longest(w, NOUN, rv)
                w = w[: -len(end)] if end else w
    if len(w) > rv and w.endswith("и"):
        w = w[:-1]
    end = longest(w, ("ост", "ость"), rv)
    if end and len(w) - len(end) >= r2:
        w = w[: -len(end)]
    end = longest(w, ("ейш", "ейше", "н", "ь"), rv)
    if end in ("ейш", "ейше"):
        w = w[: -len(end)]
        end = "н" if len(w) > rv and w.endswith("н") else None
    if end == "н" and w.endswith("нн") and len(w) - 2 >= rv:
        w = w[:-1]
    elif end == "ь":
        w = w[:-1]
    return w
