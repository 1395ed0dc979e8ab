"""What the stemmers share: regions of a word and longest suffixes."""

from __future__ import annotations

from collections.abc import Iterable


def after_vowel_consonant(word: str, vowels: str, start: int = 0) -> int:
    """The place after the first non-vowel that follows a vowel, at or beyond ``start``; the word's end if there is none."""
    i, n = start, len(word)
    while i < n and word[i] not in vowels:
        i += 1
    while i < n and word[i] in vowels:
        i += 1
    return min(i + 1, n)


def r1_r2(word: str, vowels: str) -> tuple[int, int]:
    r1 = after_vowel_consonant(word, vowels)
    return r1, after_vowel_consonant(word, vowels, r1)


def rv_romance(word: str, vowels: str) -> int:
    """Where the verb region of Spanish, Italian and Portuguese begins.

    With a consonant second: after the next vowel. With two vowels first: after the next consonant. Else after the third letter.
    """
    n = len(word)
    if n < 2:
        return n
    if word[1] not in vowels:
        stop, i = True, 2
    elif word[0] in vowels:
        stop, i = False, 2
    else:
        return min(3, n)
    while i < n and (word[i] in vowels) != stop:
        i += 1
    return min(i + 1, n)


def longest(word: str, suffixes: Iterable[str], start: int = 0) -> str | None:
    """The longest of the suffixes that ends ``word`` and begins at or after ``start``."""
    known = suffixes if isinstance(suffixes, (set, frozenset, dict)) else set(suffixes)
    for i in range(start, len(word) + 1):
        if word[i:] in known:
            return word[i:]
    return None


def sets(**groups: str) -> dict[str, str]:
    """suffix -> group, from blank-separated lists."""
    return {s: g for g, words in groups.items() for s in words.split()}
