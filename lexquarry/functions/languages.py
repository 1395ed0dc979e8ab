"""Languages the engine knows: tags, names, and what exists for them."""

from __future__ import annotations

# Language tags and English names.
NAMES = {
    "af": "Afrikaans", "ar": "Arabic", "bg": "Bulgarian", "bn": "Bengali", "br": "Breton", "ca": "Catalan", "cs": "Czech",
    "da": "Danish", "de": "German", "el": "Greek", "en": "English", "eo": "Esperanto", "es": "Spanish", "et": "Estonian",
    "eu": "Basque", "fa": "Persian", "fi": "Finnish", "fr": "French", "ga": "Irish", "gl": "Galician", "gu": "Gujarati",
    "ha": "Hausa", "he": "Hebrew", "hi": "Hindi", "hr": "Croatian", "hu": "Hungarian", "hy": "Armenian", "id": "Indonesian",
    "it": "Italian", "ja": "Japanese", "ko": "Korean", "ku": "Kurdish", "la": "Latin", "lt": "Lithuanian", "lv": "Latvian",
    "mr": "Marathi", "ms": "Malay", "ne": "Nepali", "nl": "Dutch", "no": "Norwegian", "pl": "Polish", "pt": "Portuguese",
    "ro": "Romanian", "ru": "Russian", "sk": "Slovak", "sl": "Slovenian", "so": "Somali", "sr": "Serbian", "st": "Sotho",
    "sv": "Swedish", "sw": "Swahili", "ta": "Tamil", "th": "Thai", "tl": "Tagalog", "tr": "Turkish", "uk": "Ukrainian",
    "ur": "Urdu", "vi": "Vietnamese", "yi": "Yiddish", "yo": "Yoruba", "zh": "Chinese", "zu": "Zulu",
}

#: Languages written without spaces between words, and the length of their character n-grams.
NGRAM_SIZES = {"zh": 2, "ja": 2, "ko": 2, "th": 3}


def supports(language: str | None) -> bool:
    return language in NAMES


def ngram_size(language: str | None) -> int:
    return NGRAM_SIZES.get(language or "", 0)


def has_stemmer(language: str | None) -> bool:
    from lexquarry.functions.stemmers import STEMMERS

    return language in STEMMERS


def has_stopwords(language: str | None) -> bool:
    from lexquarry.functions.stopwords import DEFAULT_LISTS, LISTS

    return language in LISTS or language in DEFAULT_LISTS


def table_rows() -> list[tuple[str, str, bool, bool, int]]:
    """(tag, name, has a default stopword list, has a stemmer, n-gram length or 0) of every language."""
    return [(t, n, has_stopwords(t), has_stemmer(t), ngram_size(t)) for t, n in NAMES.items()]
