"""Texts that look the same brought to one form, by script-aware repair.

``normalise`` undoes what is invisible by definition: width, joined letters, the encoding of accents,
invisible characters, the kind of a space. What is left are look-alike letters of other scripts. A table of twins
proposes them; which script a token is then written in is decided by

* its own unmistakable letters, those without a twin: a token that mixes them with look-alikes is repaired to the spelling in
  their script that the corpus vocabulary has, or to the one the table gives where the corpus has none;
* if it has none, the dominant script of its text: the script of most of the text's unmistakable letters, if the token can be written in it;
* if the text has none either (a term, a name), the corpus vocabulary: the Latin spelling if it occurs, else the most frequent one in a single script.

Kana drawn like Han characters are katakana beside unmistakable katakana, else Han. All of this depends on what
can be seen alone, so texts that look the same get the same ``form``, and ``form`` is what texts are compared by.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.operators.skew import heavy_keys, salted_lookup
from lexquarry.plans.session import cut

# Letters drawn alike, each alphabet's letters above their twins.
_TWINS = [
    # Cyrillic
    ("аеорсухіјѕһԁԛԝӏѵ", "aeopcyxijshdqwlv"),
    ("АВЕКМНОРСТУХІЈЅԚԜӀҮԌ", "ABEKMHOPCTYXIJSQWIYG"),
    # Greek
    ("ονρϲϳ", "ovpcj"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    # Armenian
    ("օսհոց", "ouhng"),
    # Latin letters of phonetic alphabets, and small capitals of letters whose capitals have the shape of the small ones
    ("ɡᴄᴏꜱᴠᴡᴢ", "gcosvwz"),
    # Coptic
    ("ⲞⲢⲤⲎⲔⲘⲚⲦⲬⲟⲣⲥ", "OPCHKMNTXopc"),
    # Cherokee
    ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏚᏙᏔᏃ", "ABCDEHJKLMPSVWZ"),
    # Lisu
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    # Kana and the Han characters or other kana drawn like them
    ("カエロニタトハー", "力工口二夕卜八一"),
    ("ヘベペ", "へべぺ"),
]
_BASE = {ord(a): b for row, twins in _TWINS for a, b in zip(row, twins, strict=True)}


def _with_accents() -> dict[int, str]:
    """The twins of the letters above and of the same letters under accents."""
    table = dict(_BASE)
    for c in [*range(0x370, 0x590), *range(0x1F00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and ord(parts[0]) in _BASE:
            table[c] = unicodedata.normalize("NFC", _BASE[ord(parts[0])] + parts[1:])
    return table


LOOK = _with_accents()


# Unicode's default-ignorable code points, with the three anchors of interlinear notes.
INVISIBLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
#: Mathematical letters and digits drawn like plain ones: without serifs, and of one width.
_PLAINLY_DRAWN = [(0x1D5A0, 0x1D5D3), (0x1D670, 0x1D6A3), (0x1D7E2, 0x1D7EB), (0x1D7F6, 0x1D7FF)]


def _plain_forms() -> dict[int, str]:
    """What width, joined letters, invisible characters and kinds of spaces become."""
    table: dict[int, str] = {}
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        kind, way = unicodedata.category(ch), unicodedata.decomposition(ch)
        if kind == "Zs":
            table[c] = " "
        elif c == 0x2800:
            table[c] = " "
        elif any(a <= c <= b for a, b in INVISIBLE):
            table[c] = ""
        elif kind == "Cc" and ch not in "\t\n":
            table[c] = "\n" if c == 0x85 else ""
        elif kind in ("Zl", "Zp"):
            table[c] = "\n"
        elif way.startswith(("<wide>", "<narrow>")):
            table[c] = unicodedata.normalize("NFKC", ch)
        elif way.startswith(("<compat>", "<square>")):
            plain = unicodedata.normalize("NFKC", ch)
            if plain.isalpha() and (len(plain) > 1 or 0x2160 <= c < 0x2180 or c == 0xB5):
                table[c] = plain
    table[0xFF9E], table[0xFF9F] = "゙", "゚"  # half-width voicing marks join the kana before
    table.pop(0x20, None)
    return table


_PLAIN = (
    _plain_forms()
    | {c: "" for a, b in INVISIBLE if a > 0xFFFF for c in range(a, b + 1)}
    | {c: unicodedata.normalize("NFKC", chr(c)) for a, b in [(0x2F00, 0x2FD5), *_PLAINLY_DRAWN] for c in range(a, b + 1)}
)
# Ranges, as each single character beyond U+FFFF is compared with every character of a text.
_ANY_PLAIN = re.compile(
    "["
    + "".join(re.escape(chr(c)) for c in _PLAIN if c < 0x10000)
    + "".join(f"{chr(a)}-{chr(b)}" for a, b in [*INVISIBLE, *_PLAINLY_DRAWN] if a > 0xFFFF)
    + "]"
)
_LATIN_LOOK = {c: b for c, b in LOOK.items() if not 0x3000 <= c < 0x3100}
_ANY_LOOK = re.compile("[" + "".join(map(chr, LOOK)) + "]")
#: Alphabets that have look-alike letters, and the letters that have or are twins.
_ANY_FOREIGN = re.compile("[\u0250-\u02af\u0370-\u058f\u13a0-\u13ff\u1d00-\u1d7f\u1f00-\u1fff\u2c80-\u2cff\ua4d0-\ua4ff\ua731]")
_ANY_TWIN = re.compile("[" + "".join(sorted({x for c, b in LOOK.items() if not 0x3000 <= c < 0x3100 for x in (chr(c), b[0])})) + "]")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_SCRIPTS = {
    "latin": regex.compile(r"[\p{Script=Latin}--[\p{Block=IPA_Extensions}\p{Block=Phonetic_Extensions}\uA731]]", regex.V1),
    "cyrillic": regex.compile(r"\p{Script=Cyrillic}"),
    "greek": regex.compile(r"\p{Script=Greek}"),
    "armenian": regex.compile(r"\p{Script=Armenian}"),
    "coptic": regex.compile(r"\p{Script=Coptic}"),
    "cherokee": regex.compile(r"\p{Script=Cherokee}"),
    "lisu": regex.compile(r"\p{Script=Lisu}"),
    "phonetic": regex.compile(r"[\p{Block=IPA_Extensions}\p{Block=Phonetic_Extensions}\uA731]"),
}
#: Latin letter -> its twin, for scripts in which a token can be written; the first of several.
_INTO = {
    s: {ord(b): chr(a) for a, b in reversed(LOOK.items()) if len(b) == 1 and _SCRIPTS[s].match(chr(a))}
    for s in ("cyrillic", "greek", "armenian", "coptic", "cherokee", "lisu")
}
#: Latin letters that are no letter's twin, and the unmistakable letters of the other alphabets.
_UNMISTAKABLE = {"latin": re.compile("[" + "".join(c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and c not in {b[0] for b in LOOK.values()}) + "]")} | {
    s: re.compile(
        "[" + "".join(map(chr, (c for a, b in spans for c in range(a, b) if c not in LOOK and unicodedata.category(chr(c))[0] == "L"))) + "]"
    )
    for s, spans in {
        "cyrillic": [(0x400, 0x530)], "greek": [(0x370, 0x400), (0x1F00, 0x2000)], "armenian": [(0x531, 0x588)],
        "coptic": [(0x2C80, 0x2CE4)], "cherokee": [(0x13A0, 0x13F6)], "lisu": [(0xA4D0, 0xA4F8)],
    }.items()
}
_KANA, _HAN = "カエロニタトハー", "力工口二夕卜八一"
# The katakana that no other character is drawn like.
_OWN_KATAKANA = "ァアィイゥウェォオガキギクグケゲコゴサザシジスズセゼソゾダチヂッツヅテデドナヌネノバパヒビピフブプホボポマミムメモャヤュユョヨラリルレヮワヰヱヲンヴヵヶヷヸヹヺ"
_TO_KANA = str.maketrans(_HAN + "へべぺ", _KANA + "ヘベペ")
_BESIDE_KATAKANA = re.compile(f"(?<=[{_OWN_KATAKANA}])[{_HAN}へべぺ]+|[{_HAN}へべぺ]+(?=[{_OWN_KATAKANA}])")
_TO_HAN = {c: b for c, b in LOOK.items() if 0x3000 <= c < 0x3100}
_ANY_KANA_TWIN = re.compile("[" + "".join(map(chr, _TO_HAN)) + _HAN + "へべぺ]")


def normalise(text: str) -> str:
    """``text`` without what can't be seen: see the module's docstring. A text of plain ASCII comes back as it is."""
    if _ANY_PLAIN.search(text):
        text = text.translate(_PLAIN)
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def look(text: str) -> str:
    """Every look-alike letter of a normalised text as its twin, composed with the accents that follow it."""
    return unicodedata.normalize("NFC", text.translate(LOOK)) if not text.isascii() and _ANY_LOOK.search(text) else text


def latin_look(token: str) -> str:
    """``look`` of the alphabets alone, kana as they are."""
    return unicodedata.normalize("NFC", token.translate(_LATIN_LOOK)) if not token.isascii() and _ANY_FOREIGN.search(token) else token


@lru_cache(100_000)
def scripts_of(token: str) -> frozenset[str]:
    return frozenset(s for s, p in _SCRIPTS.items() if p.search(token))


def mixed_tokens(text: str) -> list[str]:
    """Distinct tokens of a normalised text that mix alphabets and hold a look-alike letter."""
    if text.isascii() or not _ANY_FOREIGN.search(text):
        return []
    return [t for t in dict.fromkeys(_LETTERS.findall(text)) if not t.isascii() and len(scripts_of(t)) > 1 and _ANY_TWIN.search(t)]


@lru_cache(100_000)
def fold_token(token: str) -> str:
    """``token`` in the one script its letters without a twin belong to; in Latin if all have twins; its look if they belong to several.

    The same for all tokens with the same look.
    """
    base = latin_look(token)
    own = scripts_of(base) - {"latin"}
    if len(own) != 1:
        return base
    (script,) = own
    into = _INTO.get(script)
    if not into:
        return base
    # A script may have the letter under an accent only as two characters.
    apart = "".join(c if ord(c) in into or not _SCRIPTS["latin"].match(c) else unicodedata.normalize("NFD", c) for c in base)
    if any(_SCRIPTS["latin"].match(c) and ord(c) not in into for c in apart):
        return base
    return unicodedata.normalize("NFC", apart.translate(into))


def fold_mixed(text: str) -> str:
    """A normalised text with its mixed tokens folded, without a vocabulary."""
    return repair(text, {t: fold_token(t) for t in mixed_tokens(text)})


@lru_cache(100_000)
def spelling(token: str, script: str | None) -> tuple[str, bool]:
    """(the form of a token in a text dominated by ``script``, whether the vocabulary is to be asked for a better one)."""
    base = latin_look(token)
    if scripts_of(base) - {"latin"}:
        own = fold_token(token)
        return own, own != token
    if script in _INTO and all(ord(c) in _INTO[script] or not _SCRIPTS["latin"].match(c) for c in unicodedata.normalize("NFD", base)):
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", base).translate(_INTO[script])), False
    return base, base != token


def dominant_script(seen: str) -> str | None:
    """The script of most unmistakable letters of a text written in twins; None if it has no such letter."""
    counts = {s: len(p.findall(seen)) for s, p in _UNMISTAKABLE.items()}
    best = max(counts, key=counts.get)  # Latin comes first
    return best if counts[best] else None


def settle_kana(text: str) -> str:
    """A normalised text with its kana and Han characters that are drawn alike in their scripts."""
    if text.isascii() or not _ANY_KANA_TWIN.search(text):
        return text
    return _BESIDE_KATAKANA.sub(lambda m: m[0].translate(_TO_KANA), text.translate(_TO_HAN))


def settle(text: str) -> tuple[str, list[str]]:
    """(such a text with its look-alike letters in their scripts, its tokens for which the vocabulary is to be asked)."""
    if text.isascii() or not _ANY_FOREIGN.search(text):
        return text, []
    script = dominant_script(look(text))
    targets, ask = {}, []
    for t in set(_LETTERS.findall(text)):
        if (not t.isascii() or script in _INTO) and _ANY_TWIN.search(unicodedata.normalize("NFD", t)):
            form, unsure = spelling(t, script)
            if unsure:
                ask.append(t)
            elif form != t:
                targets[t] = form
    return repair(text, targets), sorted(ask)


def canonical_token(token: str) -> bool:
    """Whether a token may stand in the vocabulary: written in one script, and the way that script writes its look."""
    return len(scripts_of(token)) == 1 and (not scripts_of(latin_look(token)) - {"latin"} or fold_token(token) == token)


def repair(text: str, targets: dict[str, str]) -> str:
    return _LETTERS.sub(lambda m: targets.get(m[0], m[0]), text) if targets else text


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_SCAN = (
    "field_name string, key bigint, raw binary, form string, form_id binary, asks array<string>, token string, token_look string, n bigint"
)
#: Distinct tokens counted within a task before they are handed on.
_TOKENS_HELD = 200_000


def _scan(keep_text: bool):
    """One pass over the texts: a row per text, and rows for the distinct tokens of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        types = [pa.string(), pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in _SCAN.split(", ")]

        def batch(size: int, **columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns.get(k, [None] * size), t) for k, t in zip(names, types)], names)

        def tokens() -> pa.RecordBatch:
            own = [(t, n) for t, n in seen.items() if canonical_token(t)]
            seen.clear()
            return batch(len(own), token=[t for t, _ in own], token_look=[latin_look(t) for t, _ in own], n=[n for _, n in own])

        for b in batches:
            texts = b.column(2).to_pylist()
            plain = [settle_kana(normalise(t)) for t in texts]
            for f in plain:
                seen.update(_LETTERS.findall(f))
            forms, asks = zip(*map(settle, plain)) if plain else ([], [])
            yield batch(
                len(texts),
                field_name=b.column(0).to_pylist(),
                key=b.column(1).to_pylist(),
                raw=[_digest(t) for t in texts],
                form=[f if a or keep_text else None for f, a in zip(forms, asks)],
                form_id=[None if a else _digest(f) for f, a in zip(forms, asks)],
                asks=list(asks),
            )
            if len(seen) > _TOKENS_HELD:
                yield tokens()
        yield tokens()

    return run


def canonical_texts(texts: DataFrame, keep_text: bool = True, repaired: bool = True) -> DataFrame:
    """``field_name, key, raw, form, form_id``: the one form of every text, with digests of the text and of its form.

    ``texts`` has ``field_name, key, text``; vocabulary is every token of these texts that is written in
    one script. Texts look the same if, and only if, their ``form_id`` is equal (128-bit digests). With
    ``keep_text`` false, ``form`` is null where nothing had to be asked. ``repaired`` false leaves out the repair of tokens, for comparison.

    Null texts and null keys give no rows; empty and blank texts are texts like others. Repeated rows with the same key
    and text come out once; different texts under one key each come out. Empty tables give no rows; other columns are ignored.
    """
    rows = texts.select("field_name", F.col("key").cast("bigint").alias("key"), "text").where(F.col("key").isNotNull() & F.col("text").isNotNull())
    scanned = cut(rows.mapInArrow(_scan(keep_text), _SCAN))
    found = scanned.where(F.col("raw").isNotNull())
    asking = found.where(F.size("asks") > 0).dropDuplicates(["field_name", "key", "raw"])
    uses = asking.select("field_name", "key", "raw", F.explode("asks").alias("asked"))

    as_look = F.pandas_udf(_looks, "string")
    wanted = uses.select("asked").distinct().withColumn("wanted_look", as_look("asked"))
    spelled = (
        scanned.where(F.col("token").isNotNull())
        .join(wanted.select(F.col("wanted_look").alias("token_look")).distinct(), "token_look", "left_semi")
        .groupBy("token_look", "token")
        .agg(F.sum("n").alias("n"))
        .groupBy("token_look")
        # The Latin spelling is the look itself.
        .agg(F.min(F.struct((F.col("token") != F.col("token_look")).alias("other"), (-F.col("n")).alias("m"), "token")).alias("best"))
    )
    fold = F.pandas_udf(_folds, "string")
    target = F.coalesce("best.token", fold("asked")) if repaired else F.col("asked")
    targets = wanted.join(spelled, wanted["wanted_look"] == spelled["token_look"], "left").select(F.col("asked").alias("from_token"), target.alias("target"))
    spread = F.col("raw")
    told = salted_lookup(uses, "asked", spread, targets, "from_token", heavy_keys(uses, "asked"))
    # A text's list of asked tokens is no longer than the text itself.
    per_text = told.groupBy("field_name", "key", "raw").agg(F.map_from_entries(F.collect_list(F.struct("asked", "target"))).alias("targets"))
    # Called non-deterministic so that the plan does not evaluate it once for each use of its result.
    mend = F.pandas_udf(_mend, "struct<form:string,form_id:binary>").asNondeterministic()
    mended = asking.join(per_text, ["field_name", "key", "raw"]).withColumn("m", mend("form", F.map_keys("targets"), F.map_values("targets")))
    plain = found.where(F.size("asks") == 0).select("field_name", "key", "raw", "form", "form_id")
    return plain.dropDuplicates(["field_name", "key", "raw"]).unionByName(
        mended.select("field_name", "key", "raw", "m.form", "m.form_id")
    )


def _looks(tokens: pd.Series) -> pd.Series:
    return tokens.map(latin_look)


_looks.__annotations__ = {"tokens": pd.Series, "return": pd.Series}


def _folds(tokens: pd.Series) -> pd.Series:
    return tokens.map(fold_token)


_folds.__annotations__ = {"tokens": pd.Series, "return": pd.Series}


def _mend(forms: pd.Series, sources: pd.Series, targets: pd.Series) -> pd.DataFrame:
    out = [repair(f, dict(zip(s, t))) for f, s, t in zip(forms, sources, targets)]
    return pd.DataFrame({"form": out, "form_id": [_digest(f) for f in out]})


_mend.__annotations__ = {"forms": pd.Series, "sources": pd.Series, "targets": pd.Series, "return": pd.DataFrame}


def _variants(canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the keys with their forms and texts, the distinct texts of forms that have several)."""
    text_id = F.concat(F.encode("field_name", "utf-8"), F.col("raw"))
    form_id = F.concat(F.encode("field_name", "utf-8"), F.col("form_id"))
    keyed = cut(canonical.select("field_name", form_id.alias("form_id"), text_id.alias("text_id"), "key"))
    texts = keyed.groupBy("field_name", "form_id", "text_id").agg(F.count(F.lit(1)).alias("n_keys"), F.min("key").alias("first_key"))
    several = texts.groupBy("form_id").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum("n_keys").alias("class_keys"), F.min("first_key").alias("class_id")
    ).where(F.col("n_texts") > 1)
    return keyed, cut(texts.join(several, "form_id"))


def lookalike_classes(canonical: DataFrame) -> DataFrame:
    """``field_name, key, class_id, n_texts, n_links`` for every key whose text has others that look the same, from ``canonical_texts``.

    ``class_id`` is the smallest key of the class, ``n_texts`` its distinct texts, ``n_links`` the keys with another text than
    this one's. One row for each key, however large a class is; ``lookalike_pairs`` lists what it stands for.
    """
    keyed, variants = _variants(canonical)
    own = variants.select("text_id", "n_texts", "class_id", (F.col("class_keys") - F.col("n_keys")).alias("n_links"))
    keys = keyed.select("field_name", "text_id", "key")
    told = salted_lookup(keys, "text_id", F.col("key"), own.withColumnRenamed("text_id", "own_text"), "own_text", heavy_keys(keys, "text_id"))
    return told.select("field_name", "key", "class_id", "n_texts", "n_links")


def lookalike_pairs(canonical: DataFrame) -> DataFrame:
    """``field_name, key_a, key_b`` (key_a < key_b): keys of different texts with the same form, from ``canonical_texts``.

    Pairs are formed between the distinct texts of a form, those of a frequent form spread over salts, then between the keys that
    hold them, so copies of one text are never compared with each other.
    """
    keyed, variants = _variants(canonical)
    a = variants.select("field_name", "form_id", F.col("text_id").alias("text_a"))
    b = variants.select(F.col("form_id").alias("form_b"), F.col("text_id").alias("text_b"))
    pairs = salted_lookup(a, "form_id", F.col("text_a"), b, "form_b", heavy_keys(a, "form_id")).where(F.col("text_a") < F.col("text_b")).drop("form_id", "salt")
    # A text that many keys hold is spread over salts in either join.
    keys = keyed.select("text_id", "key")
    heavy = heavy_keys(keys, "text_id")
    with_a = salted_lookup(keys, "text_id", F.col("key"), pairs, "text_a", heavy).select("field_name", "text_b", F.col("key").alias("x"))
    both = salted_lookup(keys, "text_id", F.col("key"), with_a, "text_b", heavy)
    return both.where(F.col("x") != F.col("key")).select("field_name", F.least("x", "key").alias("key_a"), F.greatest("x", "key").alias("key_b"))
