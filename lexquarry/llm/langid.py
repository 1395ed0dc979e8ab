"""The language of every text and of every stretch of a mixed text, with a confidence.

The model is the averaged hashed subword embedding with a linear softmax: a word is its character
n-grams (with word ends) and itself, each hashed to a bucket with a vector; a stretch is the mean of
its vectors; a linear layer gives the languages' logits. It is trained here, by stochastic gradient
descent in numpy, on labelled sentences, cropped, misspelt and stripped of accents at random. As mean
and layer are both linear, a bucket's vector times the layer is its share of the logits, and that
table is all that the workers get. On sentences held out, a temperature is fitted so that
confidences are probabilities, and the confidence below which a stretch is rejected.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.lookalike import _ANY_FOREIGN, _ANY_PLAIN, fold_mixed, normalise
from lexquarry.operators.skew import lookup

#: Labelled sentences that training uses at most, by smallest sample_id; the fit is on the driver.
MAX_SAMPLES = 20_000
#: Labelled documents that training uses at most, the characters each has at most, and sentences per language.
MAX_DOCUMENTS, MAX_BODY, MAX_TAUGHT = 4_000, 5_000, 800
BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
#: A language is one of a text's if at least this share of the letters stand in it.
LEAST_SHARE = 0.1
#: Words of a stretch; longer sentences are classified in stretches of about this many.
STRETCH = 16
#: Share of the held-out stretches above the rejection threshold that must be right.
WANTED_PRECISION = 0.998

_HAN_KANA = "぀-ヿ㐀-鿿々"
_TOKEN = re.compile(rf"[{_HAN_KANA}]|[^\W\d_{_HAN_KANA}]+")
#: Where a stretch may end: after a sentence or line, or after a comma before a word with a
#: capital that could begin a sentence, but not within capitals.
_END = regex.compile(rf"[.!?。！？…\n]+|[,;:]\s+(?=\p{{Lu}}(?:['’]?\p{{Ll}}|\s+\p{{Ll}})|[{_HAN_KANA}])")


_WIDE = re.compile(f"[{_HAN_KANA}]")


def _features(word: str) -> list[int]:
    if len(word) == 1 and _WIDE.match(word):
        kind = "kana" if word < "㐀" else "han"
        return [zlib.crc32(word.encode()) % BUCKETS, zlib.crc32(kind.encode()) % BUCKETS]
    w = f"<{word}>"
    grams = [w] + [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _plain_word(word: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", word) if not "̀" <= c <= "ͯ"))


def _misspelt(word: str, rng: random.Random) -> str:
    if len(word) < 4 or rng.random() > 0.06:
        return word
    i = rng.randrange(len(word) - 1)
    return rng.choice((word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + word[i + 1 :]))


def _invented(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) + rng.choice(("", "n", "s", "um", "ark", "os", "ez"))


def _crop(words: list[str], rng: random.Random) -> list[str]:
    n = min(len(words), rng.randint(3, STRETCH))
    i = rng.randrange(len(words) - n + 1)
    out = [_misspelt(w, rng) for w in words[i : i + n]]
    if rng.random() < 0.25:
        out = [_plain_word(w) if w.isascii() or w[0] < "ɐ" else w for w in out]
    if rng.random() < 0.5:
        out.insert(rng.randrange(len(out) + 1), _invented(rng))
    return out


@dataclass(frozen=True)
class Model:
    """``table``: every bucket's share of the logits. ``threshold``: the least confidence that isn't rejected."""

    langs: tuple[str, ...]
    table: np.ndarray
    temperature: float
    threshold: float
    held_out: float

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = sums / np.maximum(counts, 1)[:, None] / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _batch(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    ids = [[i for w in d for i in _cached_features(w)] or [0] for d in docs]
    return np.fromiter((i for x in ids for i in x), np.int64), np.array([len(x) for x in ids])


@lru_cache(200_000)
def _cached_features(word: str) -> tuple[int, ...]:
    return tuple(_features(word))


def fit(samples: list[tuple[str, str]], epochs: int = 30, rate: float = 4.0, batch: int = 64, seed: int = 7) -> Model:
    """The model of (language, sentence) rows; a fifth of them is held out to calibrate.

    Rows without a language or without words are left out. Needs at least one sentence of one language.
    """
    rng, nrng = random.Random(seed), np.random.default_rng(seed)
    data = [(lang, w) for lang, text in samples if lang and text and (w := words_of(normalise(text)))]
    if not data:
        raise ValueError("no labelled sentence")
    langs = tuple(sorted({lang for lang, _ in data}))
    no = {lang: i for i, lang in enumerate(langs)}
    rng.shuffle(data)
    seen: dict[str, int] = {}
    train, held = [], []
    for lang, w in data:
        seen[lang] = seen.get(lang, 0) + 1
        (held if seen[lang] % 5 == 0 else train).append((lang, w))
    emb = np.zeros((BUCKETS, DIM), np.float32)
    out = nrng.normal(0, 1, (DIM, len(langs))).astype(np.float32)
    for epoch in range(epochs):
        rng.shuffle(train)
        lr = rate * (1 - epoch / epochs)
        for i in range(0, len(train), batch):
            part = train[i : i + batch]
            ids, counts = _batch([_crop(w, rng) for _, w in part])
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
            h = np.add.reduceat(emb[ids], starts, axis=0) / counts[:, None]
            z = h @ out
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), [no[lang] for lang, _ in part]] -= 1
            dh = (p @ out.T) / counts[:, None]
            out -= (lr / 8) * (h.T @ p) / len(part)
            np.add.at(emb, ids, np.repeat(-lr * dh, counts, axis=0).astype(np.float32))
    table = (emb @ out).astype(np.float32)

    crops = [(no[lang], _crop(w, rng)) for lang, w in (held or train) for _ in range(20)]
    ids, counts = _batch([w for _, w in crops])
    z = np.add.reduceat(table[ids], np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0) / counts[:, None]
    y = np.array([i for i, _ in crops])

    def loss(t: float) -> float:
        s = z / t
        m = s.max(axis=1)
        return float((m + np.log(np.exp(s - m[:, None]).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    temperature = min(np.geomspace(0.02, 20, 60), key=loss)
    model = Model(langs, table, float(temperature), 0.0, float((z.argmax(axis=1) == y).mean()))
    p = model.probabilities(z, np.ones(len(y)))
    conf, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-conf)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= WANTED_PRECISION)
    threshold = float(conf[order[good[-1]]]) if len(good) else 1.0
    return Model(langs, table, model.temperature, min(max(threshold, 0.5), 0.95), model.held_out)


def fit_on(samples: DataFrame, max_samples: int = MAX_SAMPLES) -> Model:
    """The model of a table ``sample_id, lang, sample_text``: its first ``max_samples`` rows by sample_id."""
    rows = samples.where(F.col("lang").isNotNull() & F.col("sample_text").isNotNull()).orderBy("sample_id", "lang", "sample_text").limit(max_samples).collect()
    return fit([(r["lang"], r["sample_text"]) for r in rows])


def fit_with_documents(samples: DataFrame, documents: DataFrame, max_samples: int = MAX_SAMPLES, max_documents: int = MAX_DOCUMENTS) -> Model:
    """The model of the samples, fitted again with sentences of at most ``max_documents`` labelled documents.

    Of ``documents`` (with ``label`` from ``labelled``), those whose hashed doc_id lies below the share that gives nine tenths of
    ``max_documents`` take part, if they have at most ``MAX_BODY`` characters. A document teaches only if its label agrees with the first model about
    nearly all of its letters; then all its sentences do, also those that the first model takes for another language.
    """
    first = fit_on(samples, max_samples)
    # A tenth below the bound, which a hashed share then doesn't pass; which documents teach depends on their ids alone.
    share = min(1.0, 0.9 * max_documents / max(1, documents.count()))
    of = 1 << 30
    rows = (
        documents.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(of)) < int(share * of))
        .where(F.col("label").isin(list(first.langs)) & F.col("body").isNotNull() & (F.length("body") <= MAX_BODY))
        .select("doc_id", "label", "body")
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["label"], r["body"]))
    words = _Words(first)
    taught: dict[str, list[str]] = {}
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        for r, runs in zip(part, _detect([r["body"] for r in part], words)):
            total = sum(x["n_letters"] for x in runs)
            if total and sum(x["n_letters"] for x in runs if x["lang"] == r["label"]) >= 0.7 * total:
                taught.setdefault(r["label"], []).extend(" ".join(w) for _, _, w in stretches(r["body"]) if len(w) >= 3)
    own = samples.where(F.col("lang").isNotNull() & F.col("sample_text").isNotNull()).orderBy("sample_id", "lang", "sample_text").limit(max_samples).collect()
    data = [(r["lang"], r["sample_text"]) for r in own]
    for lang in sorted(taught):
        distinct = sorted(set(taught[lang]), key=lambda t: zlib.crc32(t.encode()))
        data += [(lang, t) for t in distinct[:MAX_TAUGHT]]
    return fit(data, epochs=6)


class _Words:
    """Sums of logits of the words met so far; forgotten when there are too many."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.langs)), np.float32)
        self.counts = np.zeros(1024, np.int32)

    def add(self, word: str) -> int:
        i = self.index[word] = len(self.index)
        if i == len(self.counts):
            self.sums = np.concatenate((self.sums, np.zeros_like(self.sums)))
            self.counts = np.concatenate((self.counts, np.zeros_like(self.counts)))
        ids = _features(word)
        self.sums[i] = self.model.table[ids].sum(axis=0)
        self.counts[i] = len(ids)
        return i


def stretches(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words): the sentences of a text, long ones in stretches; together they cover the text."""
    odd = bool(_ANY_PLAIN.search(text)) or not text.isascii() and (bool(_ANY_FOREIGN.search(text)) or not unicodedata.is_normalized("NFC", text))
    out: list[tuple[int, int, list[str]]] = []
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for start, end in zip([0, *ends], ends):
        s = text[start:end]
        w = words_of(fold_mixed(normalise(s)) if odd else s)
        if len(w) <= STRETCH * 3 // 2:
            out.append((start, end, w))
            continue
        # Words are found again in the text as it is, to know where they stand.
        spots = [t.start() + start for t in _TOKEN.finditer(s)]
        parts = max(1, round(len(w) / STRETCH))
        cuts = [start, *(spots[len(spots) * i // parts] for i in range(1, parts)), end]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                piece = text[a:b]
                out.append((a, b, words_of(fold_mixed(normalise(piece)) if odd else piece)))
    return out


def _runs(spans, p: np.ndarray, letters: np.ndarray, model: Model) -> list[tuple[int, int, int, float, int]]:
    """(start, end, language, confidence, letters) of the runs of one text.

    A stretch is rejected below the threshold (0.9 at least for fewer than 40 letters, 8 in Han and kana) and
    with fewer than ten letters (4 in Han and kana); it then belongs to the run it stands in or, at the
    start, to the next. A text of which all is rejected is one run of no language (-1 minus the language of its mean, with that one's probability). A run too short to be more than
    a quotation keeps its language; it just doesn't count as one of the text's.
    """
    best, conf = p.argmax(axis=1), p.max(axis=1)
    wide = np.isin(best, model_wide(model))
    short = letters < np.where(wide, 8, 40)
    sure = (conf >= np.where(short, max(0.9, model.threshold), model.threshold)) & (letters >= np.where(wide, 4, 10))
    total = int(letters.sum())
    if not sure.any():
        mean = (p * letters[:, None]).sum(axis=0) / max(total, 1)
        k = int(mean.argmax())
        return [(spans[0][0], spans[-1][1], -1 - k, float(mean[k]), total)]
    out: list[list] = []
    for (start, end, _), k, c, s, n in zip(spans, best.tolist(), conf.tolist(), sure.tolist(), letters.tolist()):
        if out and (not s or out[-1][2] in (k, None)):
            run = out[-1]
            run[1] = end
            run[4] += n
            if s:
                run[2] = k
                run[5].append((c, n))
        else:
            out.append([start, end, k if s else None, 0.0, n, [(c, n)] if s else []])
    return [(a, b, k, sum(c * n for c, n in cs) / sum(n for _, n in cs), n) for a, b, k, _, n, cs in out]


@lru_cache(8)
def _wide(langs: tuple[str, ...]) -> list[int]:
    return [i for i, lang in enumerate(langs) if lang in ("ja", "zh")]


def model_wide(model: Model) -> list[int]:
    return _wide(model.langs)


#: Languages of indexes that are broadcast at most; beyond, the documents of frequent sources are salted.
MOST_INDEXES = 10_000
#: What a text is said to be written in if the model rejects all of it.
UNKNOWN = "und"
_OUT = "array<struct<char_start:int,char_end:int,lang:string,confidence:double,n_letters:int,guess:string>>"


def _detector(model_of):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of.value
        words = _Words(model)
        kind = pa.list_(
            pa.struct([("char_start", pa.int32()), ("char_end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_letters", pa.int32()), ("guess", pa.string())])
        )
        for b in batches:
            results: list[list | None] = []
            texts = b.to_pylist()
            for at in range(0, len(texts), 256):
                if len(words.index) > words.most:
                    words.clear()
                results += _detect(texts[at : at + 256], words)
            yield pa.array(results, kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def _detect(texts: list[str | None], words: _Words) -> list[list | None]:
    model, get = words.model, words.index.get
    ids: list[int] = []
    starts, letters, docs = [], [], []
    for text in texts:
        spans = [] if text is None else stretches(text)
        kept = [x for x in spans if x[2]]
        docs.append(kept)
        for _, _, ws in kept:
            starts.append(len(ids))
            letters.append(sum(map(len, ws)))
            for w in ws:
                i = get(w)
                ids.append(words.add(w) if i is None else i)
    if ids:
        ix = np.array(ids)
        p = model.probabilities(np.add.reduceat(words.sums[ix], starts, axis=0), np.add.reduceat(words.counts[ix], starts))
        size = np.array(letters)
    out: list[list | None] = []
    at = 0
    for kept in docs:
        n = len(kept)
        if not n:
            out.append([])
            continue
        runs = _runs(kept, p[at : at + n], size[at : at + n], model)
        at += n
        said = lambda k: (model.langs[k], model.langs[k]) if k >= 0 else (UNKNOWN, model.langs[-1 - k])
        out.append([{"char_start": a, "char_end": b, "lang": said(k)[0], "confidence": c, "n_letters": m, "guess": said(k)[1]} for a, b, k, c, m in runs])
    return out


def detect_languages(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, segments`` and the columns in ``keep``: the stretches of one language of every text, with confidence and letters.

    A text that the model rejects as a whole is ``und``, with the probability of the language in ``guess``; elsewhere ``guess`` is ``lang``.
    Positions count code points of the text as it is. Null and blank texts and texts without a letter
    have no segments; every other text has at least one. Repeated rows come out as often as they went in; an empty
    table gives no rows. Columns not named are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    # Called non-deterministic so that the plan does not evaluate it once for each use of its result.
    detector = F.arrow_udf(_detector(shared), _OUT).asNondeterministic()
    return documents.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"), *keep).select("doc_id", detector("__text").alias("segments"), *keep)


def languages_of(detected: DataFrame, least_share: float = LEAST_SHARE, keep: tuple[str, ...] = (), by: str = "lang") -> DataFrame:
    """``doc_id, langs``: languages with at least ``least_share`` of the letters, each with share and confidence, largest first.

    ``by`` is ``lang``, or ``guess`` to name the likeliest language of a rejected text too.
    """
    total = F.expr("aggregate(segments, 0, (a, s) -> a + s.n_letters)")
    names = F.expr(f"array_distinct(transform(segments, s -> s.{by}))")
    per = F.expr(
        f"""transform(__names, l -> aggregate(filter(segments, s -> s.{by} = l), struct(0 as n, 0D as c),
             (a, s) -> struct(a.n + s.n_letters as n, a.c + s.confidence * s.n_letters as c),
             a -> struct(a.n / __total as share, l as lang, a.c / a.n as confidence)))"""
    )
    langs = F.sort_array(F.filter(per, lambda x: x["share"] >= least_share), asc=False)
    return detected.withColumn("__total", total).withColumn("__names", names).where(F.col("__total") > 0).select("doc_id", langs.alias("langs"), *keep)


# Code, three-letter codes and English name of the languages that labels may name exactly.
_NAMES = {
    "en": "eng english",
    "fr": "fra fre french",
    "de": "deu ger german",
    "es": "spa spanish castilian",
    "it": "ita italian",
    "pt": "por portuguese",
    "nl": "nld dut dutch flemish",
    "ru": "rus russian",
    "ja": "jpn japanese",
    "zh": "zho chi cmn chinese mandarin",
}
#: Labels of two or three letters that name no single language.
_NO_LANGUAGE = "xx xxx zz zzz mul und mis zxx unk na nan nil non"


def label_language(label) -> object:
    """The language that a label names, as a two-letter code where it is one of ours, else the lower-case code; null if none.

    A label is a code of two or three letters, perhaps with a region, or an English name, in any case. Placeholders
    and words that are no name known here name none.
    """
    plain = F.lower(F.trim(label))
    head = F.regexp_extract(plain, r"^([a-z]{2,3})([-_][a-z0-9_-]+)?$", 1)
    known = {name: code for code, names in _NAMES.items() for name in (code, *names.split())}
    mapping = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    code = F.when(head == "", F.lit(None)).when(head.isin(_NO_LANGUAGE.split()), F.lit(None)).otherwise(F.coalesce(mapping[head], head))
    return F.coalesce(mapping[plain], code)


def labelled(documents: DataFrame, info: DataFrame) -> DataFrame:
    """``documents`` with ``label``: the language named by ``lang`` or else by the info value ``language`` of its source.

    Info rows that name different languages for one index name none.
    """
    named = (
        info.where((F.col("info_key") == "language") & F.col("index_name").isNotNull())
        .select(F.col("index_name").alias("__index"), label_language(F.col("value")).alias("__named"))
        .where(F.col("__named").isNotNull())
        .groupBy("__index")
        .agg(F.min("__named").alias("__named"), F.max("__named").alias("__last"))
        .where(F.col("__named") == F.col("__last"))
        .drop("__last")
    )
    joined = lookup(documents, "source", F.col("doc_id"), named, "__index", MOST_INDEXES, how="left")
    return joined.withColumn("label", F.coalesce(label_language(F.col("lang")), F.col("__named"))).drop("__named")


def wrong_labels(languages: DataFrame) -> DataFrame:
    """``doc_id, lang`` for every language of the texts whose label isn't exactly the one language of the text."""
    right = (F.size("langs") == 1) & F.coalesce(F.col("label") == F.col("langs")[0]["lang"], F.lit(False))
    return languages.where(~right).select("doc_id", F.explode("langs.lang").alias("lang"))
