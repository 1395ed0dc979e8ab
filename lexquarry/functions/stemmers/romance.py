"""Spanish, Italian, Portuguese and French.

The first three share their shape: a longest suffix decides a rule, the rule names the region the
suffix must lie in, what replaces it, and which endings may go after it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from lexquarry.functions.stemmers.regions import longest, r1_r2, rv_romance, sets


@dataclass
class Word:
    text: str
    r1: int
    r2: int
    rv: int

    def cut(self, end: str, start: int, new: str = "") -> bool:
        """Replaces ``end`` if the word ends in it at or beyond ``start``."""
        at = len(self.text) - len(end)
        if not self.text.endswith(end) or at < start:
            return False
        self.text = self.text[:at] + new
        return True

    def cut_any(self, ends, start: int) -> str | None:
        """Cuts the longest of the endings if it lies at or beyond ``start``."""
        end = longest(self.text, ends)
        return end if end and self.cut(end, start) else None


_ACUTE = str.maketrans("áéíóú", "aeiou")

# Spanish.
ES_VOWELS = "aeiouáéíóúü"
ES_PRONOUNS = set("la las le les lo los me nos se sela selas selo selos".split())
ES_BEFORE_PRONOUN = set("ando iendo yendo ándo iéndo ar er ir ár ér ír".split())
ES_SUFFIXES = sets(
    cut="anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos",
    ic="adora adoras ador adores acion ación aciones ante antes ancia ancias",
    log="logía logías",
    u="ucion ución uciones",
    ente="encia encias",
    amente="amente",
    mente="mente",
    idad="idad idades",
    ivo="iva ivo ivas ivos",
)
ES_Y_VERBS = set("ya yas ye yes yo yó yan yen yeron yendo yais yamos".split())
ES_VERBS_U = set("en es éis emos".split())
ES_VERBS = set(
    "aba ada ida ara iera ía aría ería iría ad ed id ase iese aste iste an aban aran ieran ían arían erían irían asen iesen aron ieron "
    "arán erán irán ado ido ando iendo ar er ir as abas adas idas aras ieras ías arías erías irías ases ieses abais arais ierais íais "
    "aríais eríais iríais aseis ieseis asteis isteis áis aréis eréis iréis ados idos amos ábamos áramos iéramos íamos aríamos eríamos "
    "iríamos aremos eremos iremos ásemos iésemos imos arás erás irás ís ará erá irá aré eré iré ió".split()
)


def _es_suffix(w: Word) -> bool:
    end = longest(w.text, ES_SUFFIXES)
    rule = ES_SUFFIXES.get(end or "")
    if not rule:
        return False
    new = {"log": "log", "u": "u", "ente": "ente"}.get(rule, "")
    if not w.cut(end, w.r1 if rule == "amente" else w.r2, new):
        return False
    if rule == "ic":
        w.cut("ic", w.r2)
    elif rule == "amente" and (more := longest(w.text, ("ic", "ad", "os", "iv"))):
        if w.cut(more, w.r2) and more == "iv":
            w.cut("at", w.r2)
    elif rule == "mente":
        w.cut_any(("able", "ible", "ante"), w.r2)
    elif rule == "idad":
        w.cut_any(("abil", "ic", "iv"), w.r2)
    elif rule == "ivo":
        w.cut("at", w.r2)
    return True


def _es_verb(w: Word) -> bool:
    end = longest(w.text, ES_Y_VERBS, w.rv)
    if end and w.text[: -len(end)].endswith("u"):
        return w.cut(end, w.rv)
    end = longest(w.text, ES_VERBS | ES_VERBS_U, w.rv)
    if not end:
        return False
    w.cut(end, w.rv)
    if end in ES_VERBS_U and w.text.endswith("gu"):
        w.text = w.text[:-1]
    return True


def spanish(word: str) -> str:
    r1, r2 = r1_r2(word, ES_VOWELS)
    w = Word(word, r1, r2, rv_romance(word, ES_VOWELS))
    pronoun = longest(w.text, ES_PRONOUNS)
    if pronoun:
        left = w.text[: -len(pronoun)]
        end = longest(left, ES_BEFORE_PRONOUN)
        if end and len(left) - len(end) >= w.rv and (end != "yendo" or left.endswith("uyendo")):
            w.text = left[: -len(end)] + end.translate(_ACUTE)
    _es_suffix(w) or _es_verb(w)
    end = longest(w.text, ("os", "a", "o", "á", "í", "ó", "e", "é"), w.rv)
    if end:
        w.cut(end, w.rv)
        if end in "eé" and w.text.endswith("gu"):
            w.cut("u", w.rv)
    return w.text.translate(_ACUTE)


# Italian.
IT_VOWELS = "aeiouàèìòù"
IT_PRONOUNS = set(
    "la cela gliela mela tela vela le cele gliele mele tele vele ne cene gliene mene sene tene vene ci li celi glieli meli teli veli gli mi "
    "si ti vi lo celo glielo melo telo velo".split()
)
IT_SUFFIXES = sets(
    cut="anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente "
    "atrice atrici ante anti",
    ic="azione azioni atore atori",
    log="logia logie",
    u="uzione uzioni usione usioni",
    ente="enza enze",
    rv="amento amenti imento imenti",
    amente="amente",
    ita="ità",
    ivo="ivo ivi iva ive",
)
IT_VERBS = set(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno "
    "ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai "
    "iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito "
    "iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir".split()
)


def italian(word: str) -> str:
    s = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    s = re.sub(f"(?<=[{IT_VOWELS}])([ui])(?=[{IT_VOWELS}])", lambda m: m[0].upper(), s)
    r1, r2 = r1_r2(s, IT_VOWELS)
    w = Word(s, r1, r2, rv_romance(s, IT_VOWELS))
    pronoun = longest(w.text, IT_PRONOUNS)
    if pronoun:
        left = w.text[: -len(pronoun)]
        end = longest(left, ("ando", "endo", "ar", "er", "ir"))
        if end and len(left) - len(end) >= w.rv:
            w.text = left if end.endswith("ndo") else left + "e"
    end = longest(w.text, IT_SUFFIXES)
    rule = IT_SUFFIXES.get(end or "")
    start = {"rv": w.rv, "amente": w.r1}.get(rule or "", w.r2)
    if rule and w.cut(end, start, {"log": "log", "u": "u", "ente": "ente"}.get(rule, "")):
        if rule == "ic":
            w.cut("ic", w.r2)
        elif rule == "amente":
            if w.cut_any(("iv", "os", "ic", "abil"), w.r2) == "iv":
                w.cut("at", w.r2)
        elif rule == "ita":
            w.cut_any(("abil", "ic", "iv"), w.r2)
        elif rule == "ivo" and w.cut("at", w.r2):
            w.cut("ic", w.r2)
    else:
        w.cut_any([v for v in IT_VERBS if w.text.endswith(v) and len(w.text) - len(v) >= w.rv], w.rv)
    if w.text and w.text[-1] in "aeioàèìò" and len(w.text) > w.rv:
        w.text = w.text[:-1]
        w.cut("i", w.rv)
    if w.text[-2:] in ("ch", "gh"):
        w.cut("h", w.rv)
    return w.text.replace("I", "i").replace("U", "u")


# Portuguese.
PT_VOWELS = "aeiouáéíóúâêô"
PT_SUFFIXES = sets(
    cut="eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o "
    "adoras adores aço~es ante antes ância",
    log="logia logias",
    u="uça~o uço~es",
    ente="ência ências",
    amente="amente",
    mente="mente",
    idade="idade idades",
    ivo="iva ivo ivas ivos",
    ira="ira iras",
)
PT_VERBS = set(
    "ada ida ia aria eria iria ara era ira ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam "
    "em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias aras eras iras "
    "avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis "
    "ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos "
    "eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou arás erás irás ará erá irá".split()
)


def _pt_suffix(w: Word) -> bool:
    end = longest(w.text, PT_SUFFIXES)
    rule = PT_SUFFIXES.get(end or "")
    if not rule:
        return False
    if rule == "ira":
        return w.text[: -len(end)].endswith("e") and w.cut(end, w.rv, "ir")
    if not w.cut(end, w.r1 if rule == "amente" else w.r2, {"log": "log", "u": "u", "ente": "ente"}.get(rule, "")):
        return False
    if rule == "amente":
        if w.cut_any(("iv", "os", "ic", "ad"), w.r2) == "iv":
            w.cut("at", w.r2)
    elif rule == "mente":
        w.cut_any(("ante", "avel", "ível"), w.r2)
    elif rule == "idade":
        w.cut_any(("abil", "ic", "iv"), w.r2)
    elif rule == "ivo":
        w.cut("at", w.r2)
    return True


def portuguese(word: str) -> str:
    s = word.replace("ã", "a~").replace("õ", "o~")
    r1, r2 = r1_r2(s, PT_VOWELS)
    w = Word(s, r1, r2, rv_romance(s, PT_VOWELS))
    done = _pt_suffix(w)
    if not done and (end := longest(w.text, PT_VERBS, w.rv)):
        done = w.cut(end, w.rv)
    if done:
        if w.text.endswith("ci"):
            w.cut("i", w.rv)
    elif end := longest(w.text, ("os", "a", "i", "o", "á", "í", "ó"), w.rv):
        w.cut(end, w.rv)
    if w.text and w.text[-1] in "eéê" and len(w.text) > w.rv:
        w.text = w.text[:-1]
        if w.text.endswith("gu"):
            w.cut("u", w.rv)
        elif w.text.endswith("ci"):
            w.cut("i", w.rv)
    elif w.text.endswith("ç"):
        w.text = w.text[:-1] + "c"
    return w.text.replace("a~", "ã").replace("o~", "õ")


# French. Capitals stand for letters that count as consonants; He and Hi for e and i under a diaeresis.
FR_VOWELS = "aeiouyâàëéêèïîôûù"
FR_RV_STARTS = re.compile(f"par|col|tap|ni[{FR_VOWELS}]")
FR_SUFFIXES = sets(
    cut="ance ances iqUe iqUes isme ismes able ables iste istes eux",
    ic="atrice atrices ateur ateurs ation ations",
    log="logie logies",
    u="usion usions ution utions",
    ent="ence ences",
    ement="ement ements",
    ite="ité ités",
    if_="if ifs ive ives",
    eau="eaux",
    al="aux",
    oux="oux",
    euse="euse euses",
    issement="issement issements",
    amment="amment",
    emment="emment",
    ment="ment ments",
)
FR_I_VERBS = set(
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante "
    "issantes issants isse issent isses issez issiez issions issons it".split()
)
FR_VERBS = sets(
    ions="ions",
    cut="é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez eais",
    a="âmes ât âtes a ai aIent ait ant ante antes ants as asse assent asses assiez assions",
    ais="ais aise aises",
)


def _fr_suffix(w: Word) -> bool:
    """Whether an ending was changed that ends the matter; adverbs leave room for a verb ending."""
    end = longest(w.text, FR_SUFFIXES)
    rule = FR_SUFFIXES.get(end or "")
    if not rule:
        return False
    left = w.text[: -len(end)]

    def ic() -> None:
        if w.text.endswith("ic") and not w.cut("ic", w.r2):
            w.text = w.text[:-2] + "iqU"

    if rule in ("cut", "log", "u", "ent"):
        return w.cut(end, w.r2, {"cut": ""}.get(rule, rule))
    if rule == "ic":
        if not w.cut(end, w.r2):
            return False
        ic()
    elif rule == "ement":
        if not w.cut(end, w.rv):
            return False
        more = longest(w.text, ("iv", "eus", "abl", "iqU", "ièr", "Ièr"))
        if more == "iv":
            if w.cut("iv", w.r2):
                w.cut("at", w.r2)
        elif more == "eus":
            w.cut("eus", w.r2) or w.cut("eus", w.r1, "eux")
        elif more in ("abl", "iqU"):
            w.cut(more, w.r2)
        elif more:
            w.cut(more, w.rv, "i")
    elif rule == "ite":
        if not w.cut(end, w.r2):
            return False
        more = longest(w.text, ("abil", "ic", "iv"))
        if more == "abil":
            w.cut("abil", w.r2) or w.cut("abil", 0, "abl")
        elif more == "ic":
            ic()
        elif more:
            w.cut("iv", w.r2)
    elif rule == "if_":
        if not w.cut(end, w.r2):
            return False
        if w.cut("at", w.r2):
            ic()
    elif rule == "eau":
        w.text = left + "eau"
    elif rule == "al":
        return w.cut(end, w.r1, "al")
    elif rule == "oux":
        if not left or left[-1] not in "bhjlnp":
            return False
        w.text = left + "ou"
    elif rule == "euse":
        return w.cut(end, w.r2) or w.cut(end, w.r1, "eux")
    elif rule == "issement":
        return bool(left) and left[-1] not in FR_VOWELS and w.cut(end, w.r1)
    elif rule in ("amment", "emment"):
        w.cut(end, w.rv, "ant" if rule == "amment" else "ent")
        return False
    else:
        if left and left[-1] in FR_VOWELS and len(left) - 1 >= w.rv:
            w.text = left
        return False
    return True


def _fr_verb(w: Word) -> bool:
    end = longest(w.text, FR_I_VERBS, w.rv)
    if end:
        at = len(w.text) - len(end)
        if at > w.rv and w.text[at - 1] != "H" and w.text[at - 1] not in FR_VOWELS:
            return w.cut(end, w.rv)
    end = longest(w.text, FR_VERBS, w.rv)
    if not end:
        return False
    left, rule = w.text[: -len(end)], FR_VERBS[end]
    if rule == "ions":
        return w.cut(end, w.r2)
    if rule == "ais" and (left.endswith(("épl", "auv")) or len(left) == 3 and left.endswith("al")):
        return False
    w.text = left
    if rule == "a":
        w.cut("e", w.rv)
    return True


def french(word: str) -> str:
    s = re.sub("^(?:[cdjlmnst]|qu)'(?=.)", "", word)
    v = FR_VOWELS
    s = re.sub(f"(?<=[{v}])u(?=[{v}])|(?<=q)u", "U", s)
    s = re.sub(f"(?<=[{v}])i(?=[{v}])", "I", s)
    s = re.sub(f"(?<=[{v}])y|y(?=[{v}])", "Y", s)
    s = s.replace("ë", "He").replace("ï", "Hi")
    r1, r2 = r1_r2(s, v)
    if len(s) > 2 and s[0] in v and s[1] in v:
        rv = 3
    elif m := FR_RV_STARTS.match(s):
        rv = m.end()
    else:
        rv = next((i + 1 for i in range(1, len(s)) if s[i] in v), len(s))
    w = Word(s, r1, r2, rv)
    if _fr_suffix(w) or _fr_verb(w):
        if w.text.endswith("Y"):
            w.text = w.text[:-1] + "i"
        elif w.text.endswith("ç"):
            w.text = w.text[:-1] + "c"
    else:
        t = w.text
        if t.endswith("s") and (t.endswith("His") or len(t) > 1 and t[-2] not in "aiosuè"):
            w.text = t[:-1]
        end = longest(w.text, ("e", "ion", "ier", "ière", "Ier", "Ière"), w.rv)
        if end == "ion":
            if w.text[:-3].endswith(("s", "t")) and len(w.text) - 4 >= w.rv:
                w.cut("ion", w.r2)
        elif end:
            w.cut(end, w.rv, "" if end == "e" else "i")
    if w.text.endswith(("enn", "onn", "ett", "ell", "eill")):
        w.text = w.text[:-1]
    w.text = re.sub(f"[éè](?=[^{v}]+$)", "e", w.text)
    return w.text.replace("He", "ë").replace("Hi", "ï").replace("H", "").lower()
