"""Finnish and Hungarian."""

from __future__ import annotations

from lexquarry.functions.stemmers.regions import longest, r1_r2, sets

# Finnish.
FI_VOWELS = "aeiouyäö"
FI_STRONG = "aeiouäö"
FI_CONSONANTS = "bcdfghjklmnpqrstvwxz"
FI_PARTICLE_AFTER = "aeinotuyäö"
FI_LONG = set("aa ee ii oo uu ää öö".split())
FI_PARTICLES = sets(cut="kaan kin kään han hän ko kö pa pä", sti="sti")
FI_POSSESSIVES = sets(cut="mme nne nsa nsä", ni="ni", si="si", an="an", än="än", en="en")
FI_BEFORE = {"an": set("ta ssa sta lla lta na".split()), "än": set("tä ssä stä llä ltä nä".split()), "en": {"lle", "ine"}}
FI_CASES = sets(
    cut="ksi ine lla llä lle lta ltä na nä ssa ssä sta stä", hVn="han hen hin hon hän hön", sVn="siin den seen tten", tta="tta ttä", n="n", a="a ä"
)
FI_OTHER = sets(mp="mma mmi mmä mpa mpi mpä", cut="eja ejä imma immi immä impa impi impä")


def _long(w: str) -> bool:
    return longest(w, FI_LONG) is not None


def _fi_case(w: str, r1: int) -> str | None:
    """The word without its case ending, None if it has none."""
    end = longest(w, FI_CASES, r1)
    if not end:
        return None
    left, rule = w[: -len(end)], FI_CASES[end]
    if rule == "hVn" and not left.endswith(end[1]):
        return None
    if rule == "sVn" and not (_long(left) if end == "seen" else len(left) > 1 and left[-1] == "i" and left[-2] in FI_STRONG):
        return None
    if rule == "tta" and not left.endswith("e"):
        return None
    if rule == "a" and not (len(left) > 1 and left[-1] in FI_VOWELS and left[-2] in FI_CONSONANTS):
        return None
    if rule == "n" and left and (_long(left) or left.endswith("ie")):
        left = left[:-1]
    return left


def finnish(word: str) -> str:
    w = word
    r1, r2 = r1_r2(w, FI_VOWELS)
    end = longest(w, FI_PARTICLES, r1)
    if end:
        left = w[: -len(end)]
        if (len(left) >= r2) if end == "sti" else (left and left[-1] in FI_PARTICLE_AFTER):
            w = left
    end = longest(w, FI_POSSESSIVES, r1)
    if end:
        left, rule = w[: -len(end)], FI_POSSESSIVES[end]
        if rule == "si":
            w = w if left.endswith("k") else left
        elif rule == "ni":
            w = left[:-1] + "i" if left.endswith("kse") else left
        elif rule == "cut" or longest(left, FI_BEFORE[rule]):
            w = left
    without = _fi_case(w, r1)
    w = w if without is None else without
    end = longest(w, FI_OTHER, r2)
    if end and not (FI_OTHER[end] == "mp" and w[: -len(end)].endswith("po")):
        w = w[: -len(end)]
    if without is not None:
        if len(w) > r1 and w[-1:] in ("i", "j"):
            w = w[:-1]
    elif len(w) > r1 and w.endswith("t") and w[-2:-1] and len(w) - 2 >= r1 and w[-2] in FI_VOWELS:
        w = w[:-1]
        end = longest(w, ("mma", "imma"), r2)
        if end and not (end == "mma" and w[: -len(end)].endswith("po")):
            w = w[: -len(end)]
    if len(w) - 2 >= r1 and _long(w):
        w = w[:-1]
    if len(w) - 2 >= r1 and w[-1] in "aeiä" and w[-2] in FI_CONSONANTS:
        w = w[:-1]
    if len(w) - 2 >= r1 and w[-2:] in ("oj", "uj"):
        w = w[:-1]
    if len(w) - 2 >= r1 and w[-2:] == "jo":
        w = w[:-1]
    i = len(w)
    while i and w[i - 1] in FI_VOWELS:
        i -= 1
    if i > 1 and w[i - 1] in FI_CONSONANTS and w[i - 1] == w[i - 2]:
        w = w[: i - 1] + w[i:]
    return w


# Hungarian.
HU_VOWELS = "aeiouáéíóöúüőű"
HU_DOUBLES = set("bb cc ccs dd ff gg ggy jj kk ll lly mm nn nny pp rr ss ssz tt tty vv zz zzs".split())
HU_CASES = set(
    "ba be ra re ig nak nek val vel ul ül ban ben ból ből tól től ról ről nál nél hoz hez höz ért képp képpen kor ként anként enként onként "
    "t at et ot öt n an en on ön vá vé".split()
)
HU_SPECIAL = {"án": "a", "ánként": "a", "én": "e"}
HU_OTHER = {"stul": "", "astul": "", "stül": "", "estül": "", "ástul": "a", "éstül": "e"}
HU_OWNED = sets(cut="é éi aké ké eké oké öké", e="éé ééi éké", a="áéi áké")
HU_ONE_OWNER = sets(
    cut="a ja e je m am em om d ad ed od öd nk unk ünk juk jük uk ük o", a="á ám ád ánk ájuk", e="é ém éd énk éjük"
)
HU_MANY_OWNED = sets(
    cut="i ai ei jai jei im aim eim jaim jeim id aid eid jaid jeid ik aik eik jaik jeik ink aink eink jaink jeink aitok eitek itek jaitok jeitek",
    a="ái áim áid áink áitok áik",
    e="éi éim éid éink éitek éik",
)
HU_PLURAL = sets(cut="k ak ek ok ök", a="ák", e="ék")


def hungarian(word: str) -> str:
    w = word
    if w[:1] and w[0] in HU_VOWELS:
        i = next((i for i, c in enumerate(w) if c not in HU_VOWELS), None)
        r1 = len(w) if i is None else i + 1
    else:
        r1 = next((i + 1 for i, c in enumerate(w) if c in HU_VOWELS), len(w))

    def cut(ends: dict[str, str] | set[str]) -> bool:
        """Cuts the longest ending in the region; a group named by a vowel leaves that vowel."""
        nonlocal w
        end = longest(w, ends)
        if not end or len(w) - len(end) < r1:
            return False
        kept = ends[end] if isinstance(ends, dict) else ""
        w = w[: -len(end)] + (kept if kept in ("a", "e") else "")
        return True

    def cut_doubled(ends: set[str]) -> None:
        """Cuts an ending that doubled the consonant before it, and undoes the doubling."""
        nonlocal w
        end = longest(w, ends)
        if end and len(w) - len(end) >= r1 and longest(w[: -len(end)], HU_DOUBLES):
            left = w[: -len(end)]
            w = left[:-2] + left[-1]

    cut_doubled({"al", "el"})
    if cut(HU_CASES):
        cut({"á": "a", "é": "e"})
    cut(HU_SPECIAL)
    cut(HU_OTHER)
    cut_doubled({"á", "é"})
    for ends in (HU_OWNED, HU_ONE_OWNER, HU_MANY_OWNED, HU_PLURAL):
        cut(ends)
    return w
