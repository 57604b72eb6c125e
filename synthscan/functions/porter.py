"""Porter's stemmer with the usual later refinements (irregular forms, -ies and -ied of four letters, -logi, -fulli)."""

from __future__ import annotations

from functools import lru_cache

# Irregular forms and the suffix tables of the published algorithm.
IRREGULAR = {form: stem for stem, forms in {
    "sky": "sky skies", "die": "dying", "lie": "lying", "tie": "tying", "news": "news", "inning": "innings inning",
    "outing": "outings outing", "canning": "cannings canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}.items() for form in forms.split()}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or (word[i] == "y" and i > 0 and not _vowel(word, i - 1))


def _measure(stem: str) -> int:
    kinds = [_vowel(stem, i) for i in range(len(stem))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowel(word, len(word) - 1)


def _short_end(word: str) -> bool:
    """consonant, vowel, consonant other than w, x, y; or a two-letter vowel, consonant."""
    n = len(word)
    if n == 2:
        return _vowel(word, 0) and not _vowel(word, 1)
    return n > 2 and not _vowel(word, n - 3) and _vowel(word, n - 2) and not _vowel(word, n - 1) and word[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str], least: int) -> str:
    for size in range(7, 1, -1):
        if word[-size:] in table and len(word) > size:
            stem = word[:-size]
            return stem + table[word[-size:]] if _measure(stem) > least else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    elif word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((n for end, n in (("ed", 2), ("ing", 3)) if word.endswith(end) and _has_vowel(word[:-n])), 0)
        if cut:
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _doubled(word):
                word = word if word[-1] in "lsz" else word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and len(word) > 2 and not _vowel(word, len(word) - 2):
        word = word[:-1] + "i"
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = _replaced(word[:-2], STEP_2, 0)
    elif word.endswith("logi"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        word = _replaced(word, STEP_2, 0)
    word = _replaced(word, STEP_3, 0)
    if word.endswith(("sion", "tion")):
        word = word[:-3] if _measure(word[:-3]) > 1 else word
    else:
        end = max((x for x in STEP_4 if word.endswith(x)), key=len, default="")
        word = word[: -len(end)] if end and _measure(word[: -len(end)]) > 1 else word
    if word.endswith("e"):
        bare = word[:-1]
        if _measure(bare) > 1 or _measure(bare) == 1 and not _short_end(bare):
            word = bare
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
