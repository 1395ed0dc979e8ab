"""Queries of the operators for training data and the SQL of those that SQL can express."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm.langid import detect_languages, fit_with_documents, labelled, languages_of, wrong_labels
from lexquarry.llm.lookalike import canonical_texts, lookalike_classes, lookalike_pairs
from lexquarry.llm.mixing import mix_documents
from lexquarry.llm.packing import container_check, container_report, pack_documents, split_by_packing
from lexquarry.llm.splitting import split_check, split_documents
from lexquarry.llm.termstats import term_statistics
from lexquarry.llm.topn import top_postings
from lexquarry.plans.session import table

#: Entropy in nats of the shares of p8_tempered; 12 equal shares have 2.485.
ENTROPY = 2.4


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return term_statistics(table(spark, d, "doclist"), table(spark, d, "wordlist"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where(F.col("mark").isNotNull()).select("term", "mark")


def p1_stats(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return top_postings(table(spark, d, "doclist")).select("term_id", "doc_id", "rnk")


def _languages(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    documents = labelled(table(spark, d, "documents"), table(spark, d, "info"))
    return detect_languages(documents, fit_with_documents(table(spark, d, "lang_samples"), documents), keep=keep)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # A code of two letters is wanted of every text, so the likeliest language where the model rejects.
    return wrong_labels(languages_of(_languages(spark, d, "label"), keep=("label",), by="guess"))


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language with its confidence."""
    return _languages(spark, d).select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", "s.*")


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    """The languages of every document with shares and confidences, largest first."""
    langs = languages_of(_languages(spark, d, "label"), keep=("label",))
    return langs.select("doc_id", "label", F.posexplode("langs").alias("place", "l")).select("doc_id", "label", "place", "l.*")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "wordlist").select(F.lit("wordlist.term").alias("field_name"), F.col("id").alias("key"), F.col("term").alias("text"))
    bodies = table(spark, d, "documents").select(F.lit("documents.body").alias("field_name"), F.col("doc_id").alias("key"), F.col("body").alias("text"))
    return words.unionByName(bodies.where(F.trim("text") != ""))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(canonical_texts(_texts(spark, d), keep_text=False))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return canonical_texts(_texts(spark, d)).select("field_name", "key", "form", F.hex("form_id").alias("form_id"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every text that has others that look the same, with its class; one row for each key."""
    return lookalike_classes(canonical_texts(_texts(spark, d), keep_text=False))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), table(spark, d, "source_plan"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return split_by_packing(_packed(spark, d))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return container_report(_packed(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    return container_check(_packed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).where(~F.col("reachable")).select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_documents(table(spark, d, "documents"), table(spark, d, "source_plan")).rows


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_documents(table(spark, d, "documents"), table(spark, d, "source_plan")).report()


def p8_tempered(spark: SparkSession, d: str) -> DataFrame:
    """A mix by token shares alone, raised to the exponent that gives them the entropy ENTROPY."""
    return mix_documents(table(spark, d, "documents"), table(spark, d, "source_plan"), entropy=ENTROPY).report()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents")).where(F.col("piece_no") == 0).select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents"))


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    return split_check(split_documents(table(spark, d, "documents")))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_stats, p4_found, p5_found, p5_segments, p5_languages, p6_found, p6_forms, p6_classes, p7_found, p7_pack, p7_report, p7_check, p8_found, p8_mix, p8_report, p8_tempered, p9_found, p9_pieces, p9_check)
}

_TERMS = """
with latest as (
  select term_id, doc_id, hit_count from (
    select *, row_number() over (partition by term_id, doc_id order by written_at desc nulls last, hit_count desc nulls last) r
    from doclist where term_id is not null and doc_id is not null) where r = 1),
stats as (
  select w.term, count(distinct w.id) n_ids, cast(coalesce(sum(l.hit_count), 0) as bigint) num_hits, count(distinct l.doc_id) num_docs
  from (select distinct id, term from wordlist where term is not null) w left join latest l on l.term_id = w.id group by 1),
terms as (
  select *, case when num_docs <= 2 then 'rare'
                 when num_docs > 0.2 * (select count(distinct doc_id) from doclist) then 'common' end mark from stats)
"""

_SIZES = r"""
with sizes as (
  select *, len(regexp_extract_all(text, '[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]'))
          + len(regexp_extract_all(regexp_replace(text, '[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]', ' ', 'g'), '[\p{L}\p{N}\p{Pc}@]+')) tokens
  from documents)
"""

# Budgets as in source_budgets, then every use of a document in the order of its hash.
_MIX = (
    _SIZES
    + """,
items as (select source, doc_id, max(tokens) n from sizes join source_plan using (source) where doc_id is not null group by 1, 2),
have as (select p.source, p.target_share t, p.max_repeats m, cast(coalesce(sum(n), 0) as bigint) tokens from source_plan p left join items using (source) group by 1, 2, 3),
total as (select cast(sum(tokens) as bigint) of_all from have), $shares
wanted as (select *, share * of_all want, m * tokens most, least(want, most) base, most - base room from shares, total),
spare as (select max(of_all) - sum(base) spare, sum(room) rooms, list({'r': room, 'w': want}) filter (room > 0) free from wanted),
bisected as (
  select *, list_reduce(range(61), lambda b, i: case
      when list_bool_and(list_transform(free, lambda x: spare * x.r * pow(x.w / x.r, b.try)
           <= x.r * list_sum(list_transform(free, lambda y: y.r * pow(y.w / y.r, b.try)))))
      then {'lo': b.try, 'hi': b.hi, 'try': (b.try + b.hi) / 2} else {'lo': b.lo, 'hi': b.try, 'try': (b.lo + b.try) / 2} end,
      {'lo': 0.0::double, 'hi': 1.0::double, 'try': 1.0::double}).lo a
  from spare),
budgets as (
  select *, case when spare <= 0 then 1.0 when spare >= rooms then 0.0 else a end exponent,
         case when spare <= 0 then base when spare >= rooms then most
              else least(most, base + spare * room * pow(want / nullif(room, 0), a)
                   / list_sum(list_transform(free, lambda y: y.r * pow(y.w / y.r, a)))) end budget
  from wanted, bisected),
placed as (
  select *, floor(budget / tokens) whole, budget - floor(budget / tokens) * tokens remains,
         coalesce(sum(n) over (partition by source order by md5('7:' || doc_id), doc_id rows between unbounded preceding and 1 preceding), 0) start
  from items join budgets using (source) where budget > 0 and tokens > 0),
mix as (
  select *, unnest(range(cast(whole + case when remains > 0 and start + n / 2 < remains then 1 else 0 end as integer))) epoch from placed)
"""
)
_TARGETS = "shares as (select *, t share from have),"
_TEMPERED = """
tokens as (select list(tokens / of_all) filter (tokens > 0) q from have, total),
heat as (
  select list_reduce(range(61), lambda b, i: case
      when -list_sum(list_transform(q, lambda x: pow(x, b.try) / list_sum(list_transform(q, lambda y: pow(y, b.try)))
           * ln(pow(x, b.try) / list_sum(list_transform(q, lambda y: pow(y, b.try)))))) >= $entropy
      then {'lo': b.try, 'hi': b.hi, 'try': (b.try + b.hi) / 2} else {'lo': b.lo, 'hi': b.try, 'try': (b.lo + b.try) / 2} end,
      {'lo': 0.0::double, 'hi': 1.0::double, 'try': 1.0::double}).lo heat, q from tokens),
shares as (
  select have.*, case when tokens > 0 then pow(tokens / of_all, heat) / list_sum(list_transform(q, lambda y: pow(y, heat))) else 0 end share
  from have, total, heat),"""
_REPORT = """
, held as (select source, cast(sum(n) as bigint) got, max(epoch) + 1 uses from mix group by 1)
select source, t target_share, m max_repeats, tokens source_tokens, round(exponent, 6) exponent, coalesce(got, 0) mix_tokens,
       round(coalesce(got, 0) / of_all, 6) reached_share, round(coalesce(got, 0) / (select sum(got) from held), 6) mix_share,
       coalesce(uses, 0) most_uses, not (coalesce(got, 0) >= most and coalesce(got, 0) < t * of_all) reachable
from budgets left join held using (source)"""


# Fixed values of the SQL of p6_found, written for it alone: what the operator derives from Unicode's data or keeps in its own
# table stands here as plain text, so that a wrong or missing letter on either side shows.
_GONE = r"[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{E0000}-\x{E0FFF}]"
_SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_HALF_KANA = "｡｢｣､･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
_KANA = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン\u3099\u309a"
_LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")]
_ALIKE = [
    ("аАВеЕКМНоОрРсСТуУхХіІјЈѕЅԁһԛԚԝԜӏӀѵҮԌ", "aABeEKMHoOpPcCTyYxXiIjJsSdhqQwWlIvYG"),
    ("ΑΒΕΖΗΙΚΜΝΟοΡρΤΥΧνϲϳ", "ABEZHIKMNOoPpTYXvcj"),
    ("օսհոց", "ouhng"),
    ("ɡ", "g"),
    ("力工口二夕卜八一へべぺ", "カエロニタトハーヘベペ"),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _look_sql() -> str:
    """One spelling of x for all texts that look like it, by DuckDB's own string functions; accented letters one by one."""
    x = f"regexp_replace(x, '{_GONE}', '', 'g')"
    for a, b in _LIGATURES:
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    narrow = "".join(map(chr, range(0x21, 0x7F)))
    pairs = [(wide, narrow), (_SPACES, " " * len(_SPACES)), (_HALF_KANA, _KANA)]
    x = f"nfc_normalize(translate({x}, {_quoted(''.join(a for a, _ in pairs))}, {_quoted(''.join(b for _, b in pairs))}))"
    for letters, twins in _ALIKE:
        x = f"translate({x}, {_quoted(letters)}, {_quoted(twins)})"
    for accent in "\u0300\u0301\u0302\u0306\u0308":
        for letters, twins in _ALIKE[:2]:
            for a, b in zip(letters, twins):
                one = unicodedata.normalize("NFC", a + accent)
                if len(one) == 1:
                    x = f"replace({x}, {_quoted(one)}, {_quoted(unicodedata.normalize('NFC', b + accent))})"
    return f"nfc_normalize({x})"


_LOOKS = """
with t as (select 'wordlist.term' field_name, id k, term x from wordlist where term is not null
           union all select 'documents.body', doc_id, body from documents where trim(body) <> ''),
l as (select field_name, k, x, {look} look from t)"""


SQL = {
    "p1_found": _TERMS + "select term, mark from terms where mark is not null",
    "p1_stats": _TERMS + "select * from terms",
    "p4_found": """
with latest as (
  select term_id, doc_id, hit_count,
         row_number() over (partition by term_id, doc_id order by written_at desc nulls last, hit_count desc) r
  from doclist where term_id is not null and doc_id is not null and hit_count is not null),
ranked as (
  select term_id, doc_id, cast(row_number() over (partition by term_id order by hit_count desc, doc_id) as integer) rnk from latest where r = 1)
select * from ranked where rnk <= 3""",
    "p6_found": _LOOKS.format(look=_look_sql())
    + """
select a.field_name, least(a.k, b.k) key_a, greatest(a.k, b.k) key_b from l a join l b on a.field_name = b.field_name and a.look = b.look and a.k < b.k
where a.x <> b.x""",
    "p6_classes": _LOOKS.format(look=_look_sql())
    + """,
texts as (select field_name, look, x, count(*) n, min(k) k from l group by 1, 2, 3),
classes as (select field_name, look, min(k) class_id, count(*) n_texts, sum(n) n_keys from texts group by 1, 2 having count(*) > 1)
select field_name, l.k "key", class_id, n_texts, cast(n_keys - n as bigint) n_links
from l join classes using (field_name, look) join texts using (field_name, look, x)""",
    "p7_found": _SIZES + "select doc_id from sizes join source_plan using (source) where tokens > capacity",
    # What every right packing has; which documents share a container is best fit's own choice.
    "p7_check": _SIZES
    + """
select source, count(*) n_documents, cast(sum(greatest(1, ceil(tokens / capacity))) as bigint) n_pieces, cast(sum(tokens) as bigint) n_tokens,
       0 overfull, 0 split_small, 0 misnumbered, true tight
from sizes join source_plan using (source) where doc_id is not null group by 1""",
    "p8_found": _SIZES
    + """, have as (select source, sum(tokens) tokens from sizes join source_plan using (source) group by 1)
select p.source from source_plan p left join have h using (source)
where p.max_repeats * coalesce(h.tokens, 0) < p.target_share * (select sum(tokens) from have)""",
    "p8_mix": _MIX.replace("$shares", _TARGETS)
    + "select source, doc_id, cast(epoch as integer) epoch, n n_tokens, round(least(1.0, (epoch * tokens + start) / budget), 9) mix_pos from mix",
    "p8_report": _MIX.replace("$shares", _TARGETS) + _REPORT,
    "p8_tempered": _MIX.replace("$shares", _TEMPERED.replace("$entropy", str(ENTROPY))) + _REPORT,
    "p9_check": _SIZES
    + "select doc_id, cast(tokens as bigint) n_tokens, length(text) n_chars, true numbered, true covering, true limited from sizes where tokens > 400",
    "p9_found": _SIZES + "select doc_id from sizes where tokens > 400",
}
