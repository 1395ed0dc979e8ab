"""Irish, Indonesian, Armenian, Hindi and Nepali."""

from __future__ import annotations

from lexquarry.functions.stemmers.regions import after_vowel_consonant, longest, sets

# Irish. The first table gives what replaces a mutated beginning.
GA_VOWELS = "aeiouáéíóú"
GA_STARTS = {
    "h-": "", "n-": "", "t-": "", "b'": "", "d'": "", "m'": "", "bhf": "f", "d'fh": "f", "fh": "f", "mb": "b", "bh": "b", "gc": "c", "ch": "c",
    "nd": "d", "dh": "d", "ng": "g", "gh": "g", "bp": "p", "ph": "p", "ts": "s", "sh": "s", "dt": "t", "th": "t", "mh": "m",
}
GA_NOUNS = sets(r1="abh aibh amh aimh eabh eamh ibh imh íocht íochta aíocht aíochta", r2="ire airí irí aire")
GA_DERIVED = sets(
    cut="acht achta achtúil ach each eacht eachta eachtúil",
    arc="arcacht arcachta arcachtaí",
    gin="gineach gineas ginis",
    graf="grafaíoch grafaíocht grafaíochta grafaíochtaí",
    paite="paite patach pataigh patacha",
    óid="óideach óideacha óidigh",
)
GA_VERBS = sets(rv="imid aimid ímid aímid faidh fidh", r1="adh eadh ain áil tar tear")


def irish(word: str) -> str:
    w = word
    for n in (4, 3, 2):
        if w[:n] in GA_STARTS:
            w = GA_STARTS[w[:n]] + w[n:]
            break
    rv = next((i + 1 for i, c in enumerate(w) if c in GA_VOWELS), len(w))
    r1 = after_vowel_consonant(w, GA_VOWELS)
    r2 = after_vowel_consonant(w, GA_VOWELS, r1)
    at = {"r1": r1, "r2": r2, "rv": rv}
    end = longest(w, GA_NOUNS)
    if end and len(w) - len(end) >= at[GA_NOUNS[end]]:
        w = w[: -len(end)]
    end = longest(w, GA_DERIVED)
    if end:
        rule = GA_DERIVED[end]
        if rule != "cut":
            w = w[: -len(end)] + rule
        elif len(w) - len(end) >= r2:
            w = w[: -len(end)]
    end = longest(w, GA_VERBS)
    if end and len(w) - len(end) >= at[GA_VERBS[end]]:
        w = w[: -len(end)]
    return w


# Indonesian. A word keeps at least two vowels; prefixes are of four classes.
ID_VOWELS = "aeiou"
ID_PREFIXES = {"di": 1, "me": 1, "men": 1, "meng": 1, "mem": 1, "ter": 1, "ke": 3, "peng": 3, "pen": 3, "pem": 3}


def indonesian(word: str) -> str:
    w, left, kind = word, sum(c in ID_VOWELS for c in word), 0

    def ending(*ends: str) -> None:
        nonlocal w, left
        if left > 2 and (end := longest(w, ends)):
            w, left = w[: -len(end)], left - 1

    def suffix() -> bool:
        nonlocal w, left
        if left <= 2:
            return False
        if w.endswith("an"):
            if kind not in (2, 3) and w.endswith("kan"):
                w = w[:-3]
            elif kind == 1:
                return False
            else:
                w = w[:-2]
        elif w.endswith("i") and kind <= 2 and not w.endswith("si"):
            w = w[:-1]
        else:
            return False
        left -= 1
        return True

    def first() -> bool:
        nonlocal w, left, kind
        start = max((p for p in ID_PREFIXES if w.startswith(p)), key=len, default=None)
        if not start:
            return False
        rest = w[len(start) :]
        vowel = rest[:1] and rest[0] in ID_VOWELS
        if start in ("men", "pen") and rest[:1] == "y" and rest[1:2] and rest[1] in ID_VOWELS:
            rest = "s" + rest[1:]
        elif start in ("mem", "pem") and vowel:
            rest = "p" + rest
        w, left, kind = rest, left - 1, ID_PREFIXES[start]
        return True

    def second() -> bool:
        nonlocal w, left, kind
        if w[:2] not in ("pe", "be"):
            return False
        ber = w[:2] == "be"
        if w[2:3] == "r":
            rest = w[3:]
        elif w[2:7] == "lajar":
            w, left, kind = w[3:], left - 1, 4 if ber else kind
            return True
        elif ber and not (w[2:3] and w[2] not in ID_VOWELS and w[3:5] == "er"):
            return False
        else:
            rest = w[2:]
        w, left, kind = rest, left - 1, 4 if ber else 2
        return True

    ending("kah", "lah", "pun")
    ending("nya", "ku", "mu")
    if left <= 2:
        return w
    if first():
        if suffix() and left > 2:
            second()
    else:
        second()
        suffix()
    return w


# Armenian.
HY_VOWELS = "աեէըիուօ"
HY_ENDINGS = set(
    "եր ներ ց ուց ից երից ներից ցից վանից ոջից վից ոց սա վա ամբ դ երդ ներդ ուդ անդ ությանդ վանդ ոջդ ը երը ները անը ությանը վանը ոջը ի երի ների վի "
    "երում ներում անում ն երն ներն ուն ան ության վան ին երին ներին ությանն ոջ ությանս վանս ոջս ով երով ներով անով վով".split()
)
HY_VERBS = set(
    "ար ացար եցար ացրիր ացիր եցիր վեցիր ալուց ելուց աց եց ացրեց ալու ելու աք ցաք ացաք ացրիք ացիք եցիք վեցիք անք ցանք ացանք ացրինք ացինք եցինք "
    "վեցինք ա ացա եցա վե ացրի ացի եցի վեցի ալ ըալ ացնալ անալ ենալ ել ըել նել ցնել եցնել չել վել ացվել եցվել տել ատել ոտել կոտել ված ում վում ան "
    "ցան ացան ացրին ացին եցին վեցին ալիս ելիս ավ ացավ եցավ ալով ելով".split()
)
HY_ADJECTIVES = set("բար րորդ երորդ ալի ակի որակ եղ վուն արան ական են երեն եկեն որէն ին գին ովին լայն պես իվ ատ ավետ կոտ".split())
HY_NOUNS = set(
    "գար վոր ավոր անօց ոց ու ք արք չեք իք ալիք անիք վածք ույք ունք մունք ենք ոնք իչք որդ ույթ ցի ուհի իլ ուկ ակ յակ անակ իկ յուն ություն ան արան "
    "պան ստան եղէն ածո իչ ուս ուստ".split()
)


def armenian(word: str) -> str:
    w = word
    rv = next((i + 1 for i, c in enumerate(w) if c in HY_VOWELS), len(w))
    r2 = after_vowel_consonant(w, HY_VOWELS, after_vowel_consonant(w, HY_VOWELS))
    end = longest(w, HY_ENDINGS, rv)
    if end and len(w) - len(end) >= r2:
        w = w[: -len(end)]
    for ends in (HY_VERBS, HY_ADJECTIVES, HY_NOUNS):
        end = longest(w, ends, rv)
        if end:
            w = w[: -len(end)]
    return w


# Hindi, flat. Endings that go wherever they stand, and endings that go after a consonant only.
HI_ENDINGS = set(
    "ी ूंगी ेंगी ऊंगी आऊंगी ाऊंगी एंगी आएंगी ाएंगी ेगी ोगी एगी आएगी ाएगी ओगी आओगी ाओगी अती आती ाती अनी आँ ाँ इयाँ आइयाँ ाइयाँ ियाँ ु ीं अतीं आतीं ातीं "
    "आं ुआं उआं ें ईं आईं ाईं ों इयों आइयों ाइयों ियों एं ुएं आएं उएं ाएं अताएं अनाएं ओं ुओं आओं उओं ाओं अताओं अनाओं ां इयां आइयां ाइयां ियां ू अ आ इ े "
    "ेंगे एंगे आएंगे ाएंगे ोगे ओगे आओगे ाओगे अते आते ाते अने आने ाने ई आई ाई उ ऊ ो ् ए आए इए आइए ाइए ाए िए ओ आओ ाओ अकर आकर ाकर ा ूंगा ऊंगा आऊंगा ाऊंगा "
    "ेगा एगा आएगा ाएगा अता आता ाता अना आना ाना आया ाया ि".split()
)
HI_AFTER_CONSONANT = set("ती नी तीं ताएं नाएं ताओं नाओं ते ने कर ता ना".split())
HI_CONSONANTS = {*map(chr, range(0x915, 0x93A)), "\u093c", *map(chr, range(0x958, 0x960))}


def hindi(word: str) -> str:
    """The longest ending goes that may go; the first letter always stays, and isn't looked at."""
    for n in range(min(len(word) - 1, 6), 0, -1):
        end, before = word[-n:], word[1:-n]
        if end in HI_ENDINGS or end in HI_AFTER_CONSONANT and before and before[-1] in HI_CONSONANTS:
            return word[:-n]
    return word


# Nepali.
NE_CASES = sets(cut="लाइ लाई ले मा मै संग सँग सँगै पछि रत द्वारा मार्फत", k="का की को कै कि")
NE_NASAL = ("ँ", "ं")
NE_BEFORE_NASAL = ("यौ", "छौ", "नौ", "थे")
NE_ENDINGS = set(
    "थिए छ इछ एछ िछ ेछ नेछ हुनेछ हुन्छ इन्छ िन्छ छन् इछन् एछन् िछन् ेछन् नेछन् छिन् लान् थिन् पर् छस् इछस् एछस् िछस् ेछस् नेछस् छेस् होस् इस् िस् थिस् "
    "थिइस् छौ इछौ एछौ िछौ ेछौ नेछौ यौ छ्यौ थ्यौ थियौ छु एछु ेछु नेछु नु हरु हरू छे थे ने थी दी दै इदै िदै दा इदा िदा दो इदो िदो एको इएको िएको ेको नेको एका "
    "इएका िएका ेका नेका एकी इएकी िएकी ेकी एकै ेकै नेकै यो इयो ियो थियो थ्यो दियो भयो देखि देखी माथि".split()
)


def nepali(word: str) -> str:
    w = word
    end = longest(w, NE_CASES)
    if end and not (NE_CASES[end] == "k" and w[: -len(end)].endswith(("ए", "े"))):
        w = w[: -len(end)]
    while True:
        if w.endswith(NE_NASAL):
            if w[:-1].endswith(NE_BEFORE_NASAL):
                w = w[:-1]
        elif w.endswith("त्रै"):
            w = w[:-1]
        end = longest(w, NE_ENDINGS)
        if not end:
            return w
        w = w[: -len(end)]
