"""Lithuanian and Esperanto."""

from __future__ import annotations

import re

from lexquarry.functions.stemmers.regions import after_vowel_consonant, longest

# Lithuanian. Words that would lose too much are first put into another case.
LT_VOWELS = "aeiouyąėęįųū"
LT_CONFLICTS = {
    "aite": "aitė", "aitės": "aitė", "uote": "uotė", "uotės": "uotė", "ėjime": "ėjimas", "esiu": "esys", "asius": "asys", "avime": "avimas",
    "ojime": "ojimas", "okate": "okatė", "okatės": "okatė",
}
LT_ENDINGS = set(
    "a ai ais aisi am ame ams amės an as asi asis at ate atės au aus ausi auti e ei eisi enie enimis enims enio enis eniu eniui ens enti enyje enys "
    "enyse enį es esi i ia iai iais iam iame iams iamės ias iasi iat iate iatės iau iaus iauti ie iem iems ies iesi im imi imis ims imės inti inėti "
    "io ioje iomis ioms ion ios iose iosna ioti is isi it ite iu iui iuje iumi iun iuos iuose iuosi iuosna iuoti ius ią iąs ių k ki kimės kite o oj "
    "oje om ome omis oms omės on os ose osi osna ot ote oti otės s si siesi sim sime simės sit site sitės siu siuosi telėti terėti ti tum tumei "
    "tumeis tumeisi tumėm tumėme tumėmės tumėt tumėte tumėtės tute tųs tųsi u ui uisi uje umi umis ums un uo uos uose uosi uosna uoti us usi y yje "
    "ys yse ysis ysna yti ą ąs ąsi čiau čiausi ė ėj ėje ėjo ėjosi ėm ėme ėmis ėms ėmės ėn ės ėse ėsi ėsna ėt ėte ėti ėtės ę į įs ūs ų ųsi".split()
)
LT_SUFFIXES = set(
    "ain ais aj am ant auj aus dam dav esn iais iaj iant ias iau iaus iej ies ing int ioj iok iop ios iuk iul iuoj iuos iuot iąj iąs išk iųj jam oj "
    "ok op os ot siant sv uliuk uoj uos uot utėait učiuk ykšt ykšč yl yt zgan ąj ąs ėj ėję ėl ėt ę ęs šv ųj".split()
)


def _lt_soft(w: str) -> str:
    return w[:-2] + "d" if w.endswith("dž") else w[:-1] + "t" if w.endswith("č") else w


def lithuanian(word: str) -> str:
    r1 = after_vowel_consonant(word, LT_VOWELS, 1 if word.startswith("a") and len(word) > 6 else 0)
    w = word
    end = longest(w, LT_CONFLICTS)
    if end:
        w = w[: -len(end)] + LT_CONFLICTS[end]
    end = longest(w, LT_ENDINGS, r1)
    w = _lt_soft(w[: -len(end)] if end else w)
    while end := longest(w, LT_SUFFIXES, r1):
        w = w[: -len(end)]
    w = _lt_soft(w)
    return w[:-1] if w.endswith("gd") else w


# Esperanto.
EO_SPELLED = {"cx": "ĉ", "gx": "ĝ", "hx": "ĥ", "jx": "ĵ", "sx": "ŝ", "ux": "ŭ", "á": "a", "é": "e", "í": "i", "ó": "o", "ú": "u"}
EO_VOWELS = "aeiou"
EO_PRONOUNS = "mi ni vi li ŝi ĝi ili oni ri si ci gi hi ŝli iŝi malŝi ivi".split()
EO_ADVERBS = "adi almen amb ank ankor anstat antaŭhier apen bald ĉirk hier hodi kontr kvaz malbald malgr morg postmorg presk tutĉirk".split()
EO_UNINFLECTED = (
    "aha amen dirlididi disde ehe ekde elde haha haleluja hola hosana hura ĥaĥa malĉi malkaj malpli maltra maltre maltro minus muu oho tamen uhu"
).split()
_EO_ALONE = r"(?:^|(?<=-))"
_EO_CORRELATIVE = re.compile(_EO_ALONE + "(?:k|t|ĉ|nen|kelk|mult|samt)?i(?:(?P<a>en?)|(?P<b>[aou]j?n?))$")
_EO_PRONOUN = re.compile(_EO_ALONE + "(?P<stem>" + "|".join(sorted(EO_PRONOUNS, key=len, reverse=True)) + ")n?$")
_EO_FIXED = re.compile(_EO_ALONE + "(?:" + "|".join(EO_UNINFLECTED) + ")$")
_EO_UJN = re.compile(_EO_ALONE + "(?:aliu|unu)(j?n?)$")
_EO_NUMERAL = re.compile("(?:dek|cent)(?:unu|du|tri)$")
_EO_ENDING = re.compile("-?(?:a|e|i|o|aj|oj|an|en|on|ajn|ojn|as|is|os|us|u)$")
_EO_AFTER_DIGIT = re.compile("(?<=[0-9-])(?:j|n|jn)$")


def esperanto(word: str) -> str:
    w = re.sub("[cghjsu]x|[áéíóú]", lambda m: EO_SPELLED[m[0]], word)
    w = re.sub("^'(?=st(?:[aiou]s|[iu])$)", "e", w)
    if m := _EO_PRONOUN.search(w):
        return w[: m.end("stem")]
    if w.endswith("'"):
        head = w[:-1]
        if head == "l":
            w = "la"
        elif head == "un":
            w = "unu"
        elif any(head == a or head.endswith("-" + a) for a in EO_ADVERBS):
            w = head + "aŭ"
        else:
            w = head + "o"
    if m := _EO_CORRELATIVE.search(w):
        cut = m.end() - (1 if m["a"] == "en" else len(m["b"]) - 1 if m["b"] else 0)
        return w[:cut]
    if _EO_FIXED.search(w) or _EO_NUMERAL.search(w):
        return w
    if m := _EO_UJN.search(w):
        return w[: m.start(1)] if m[1] else w
    long_enough = sum(c in EO_VOWELS for c in w) >= 2 or "-" in w[1:] or any(c.isdigit() for c in w)
    if not long_enough:
        return w
    for ending in (_EO_ENDING, _EO_AFTER_DIGIT):
        if m := ending.search(w):
            return w[: m.start()]
    return w
