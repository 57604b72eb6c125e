"""Text normalisation for the long-text classifier: line breaks, special tokens, punctuation, cleaning, allowed characters.

Each step is one expression of replacements. A pattern is tried only on texts that have what any match of it holds, as finding
that takes a fraction of the time. Cleaning approximates a third-party library that is not available: text
read in the wrong encoding is mended, letters are transliterated or decomposed and what is left beyond ASCII dropped;
links, addresses and phone numbers are removed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACE, let, strip

# The punctuation rules of the Moses normaliser, in order, as (pattern, replacement) for Java.
N = "\u00a0"
SPACES = [("\\r", ""), ("\\(", " ("), ("\\)", ") "), (" +", " "), ("\\) ([.!:?;,])", ")$1"), ("\\( ", "("), (" \\)", ")"), ("(\\p{Nd}) %", "$1%"), (" :", ":"), (" ;", ";")]
PENN = [("`", "'"), ("''", ' " ')]
UNICODE = [
    ("„", '"'), ("“", '"'), ("”", '"'), ("–", "-"), ("—", " - "), (" +", " "), ("´", "'"),
    ("([a-zA-Z])‘([a-zA-Z])", "$1'$2"), ("([a-zA-Z])’([a-zA-Z])", "$1'$2"), ("‘", "'"), ("‚", "'"), ("’", "'"), ("''", '"'), ("´´", '"'), ("…", "..."),
]
FRENCH = [(f"{N}«{N}", '"'), (f"«{N}", '"'), ("«", '"'), (f"{N}»{N}", '"'), (f"{N}»", '"'), ("»", '"')]
PSEUDO = [(f"{N}%", "%"), (f"nº{N}", "nº "), (f"{N}:", ":"), (f"{N}ºC", " ºC"), (f"{N}cm", " cm"), (f"{N}\\?", "?"), (f"{N}!", "!"), (f"{N};", ";"), (f",{N}", ", "), (" +", " ")]
COMMAS = {"en": [('"([,.]+)', '$1"')]} | dict.fromkeys(("de", "es", "fr"), [(',"', '",'), (f'(\\.+)"([{SPACE}]*[^<])', '"$1$2')])
# What any match of a pattern holds.
NEEDS = {
    " +": "  ", "\\) ([.!:?;,])": ") ", "(\\p{Nd}) %": " %", "([a-zA-Z])‘([a-zA-Z])": "‘", "([a-zA-Z])’([a-zA-Z])": "’", '"([,.]+)': '"',
    f'(\\.+)"([{SPACE}]*[^<])': '."', f"(\\p{{Nd}}){N}(\\p{{Nd}})": N,
}
DECIMAL, POINT = [(f"(\\p{{Nd}}){N}(\\p{{Nd}})", "$1,$2")], [(f"(\\p{{Nd}}){N}(\\p{{Nd}})", "$1.$2")]
# Literal replacements after tokenisation, in order.
DETOKENISED = [
    (" ,", ","), (" .", "."), (" ?", "?"), (" !", "!"), (" ;", ";"), (" '", "'"), (" ’ ", "'"), (" :", ":"), ("<newline>", "\n"), ("`` ", '"'),
    (" ''", '"'), ("''", '"'), (".. ", "... "), (" )", ")"), ("( ", "("), (" n't", "n't"), (" i ", " I "), (" i'", " I'"), ("\\'", "'"), ("\n ", "\n"),
]
SPECIAL = r"<pad>|<s>|</s>|<unk>|<\|endoftext\|>"
FORBIDDEN, RUNS = r"""[^ A-Za-z0-9.?!,:;\-\[\]{}()'"]""", r"""[-\[\]{}()'"]{2,}"""
LINK = r"(?i)\b(?:https?://|ftp://|www\.)[^\x20\x09-\x0d<>\"]+"
ADDRESS = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PHONE = r"(?<![A-Za-z0-9])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![A-Za-z0-9])"


def where(text: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """change(text) where the test holds; other texts as they are."""
    return let(text, lambda x: F.when(test(x), change(x)).otherwise(x))


def has(*some: str) -> Callable[[Column], Column]:
    """Whether a text has one of some strings."""

    def test(text: Column) -> Column:
        out = text.contains(some[0])
        for x in some[1:]:
            out = out | text.contains(x)
        return out

    return test


def without_line_breaks(text: Column) -> Column:
    """Line breaks, or a backslash and n, become spaces; runs count once; a start of up to 3 characters before one goes."""
    text = F.replace(text, F.lit("\n"), F.lit("\\n"))
    text = F.regexp_replace(text, r"(?:\\n)+", r"\\n")
    text = F.regexp_replace(text, r"(?d)^.{0,3}\\n", "")
    return F.replace(text, F.lit("\\n"), F.lit(" "))


def without_special_tokens(text: Column) -> Column:
    return where(text, has("<"), lambda x: F.regexp_replace(x, SPECIAL, ""))


def moses_rules(lang: str = "en", penn: bool = True, quote_commas: bool = True, numbers: bool = True) -> list[tuple[str, str]]:
    rules = SPACES + (PENN if penn else []) + UNICODE + FRENCH + PSEUDO
    if quote_commas:
        rules = rules + COMMAS.get(lang, [])
    if numbers:
        rules = rules + (DECIMAL if lang in ("de", "es", "cz", "cs", "fr") else POINT)
    return rules


def _literal(pattern: str) -> str | None:
    """The text that a pattern stands for, if it is one without any operator."""
    bare = re.sub(r"\\([^A-Za-z0-9])", "", pattern)
    return None if re.search(r"[][\\()*+?.^$|{}]", bare) else re.sub(r"\\(.)", r"\1", pattern)


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal (old, new) pairs in order; neighbours of one character each, none of which makes another, are one pass."""
    i = 0
    while i < len(rules):
        j = i
        while j < len(rules) and len(rules[j][0]) == len(rules[j][1]) == 1 and not any(new == rules[j][0] or old == rules[j][0] for old, new in rules[i:j]):
            j += 1
        if j - i > 1:
            text = F.translate(text, "".join(x for x, _ in rules[i:j]), "".join(x for _, x in rules[i:j]))
            i = j
        else:
            text = F.replace(text, F.lit(rules[i][0]), F.lit(rules[i][1]))
            i += 1
    return text


def punctuation(text: Column, lang: str = "en", penn: bool = True, quote_commas: bool = True, numbers: bool = True) -> Column:
    """The rules in order: literal ones as plain replacements, the others as regular expressions."""
    waiting: list[tuple[str, str]] = []
    for pattern, replacement in moses_rules(lang, penn, quote_commas, numbers):
        plain = None if "$" in replacement else _literal({"\\r": "\r"}.get(pattern, pattern))
        if plain is not None:
            waiting.append((plain, replacement))
            continue
        pattern, need = {" +": "  +"}.get(pattern, pattern), NEEDS[pattern]  # single spaces stay as they are
        text, waiting = where(replaced(text, waiting), has(need), lambda x, p=pattern, r=replacement: F.regexp_replace(x, p, r)), []
    return strip(replaced(text, waiting))


def detokenised(text: Column) -> Column:
    return strip(replaced(text, DETOKENISED))


# Letters that no decomposition makes ASCII, as they are commonly written in it.
LETTERS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ŋ": "ng", "ħ": "h", "ŧ": "t", "ĸ": "k",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r",
    "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "–": "-", "—": "-", "‐": "-", "‑": "-", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "«": "<<", "»": ">>", "…": "...", "•": "*", "€": "EUR", "£": "PS", "¥": "Y=",
    "©": "(c)", "®": "(r)", "°": "deg", "±": "+-", "×": "x", "÷": "/", "¿": "?", "¡": "!", "¦": "|", "§": "SS", "¶": "P", "·": "*", "´": "'", "¨": '"', "¬": "!", "¯": "-",
}
_TABLE = {ord(k): v for k, v in LETTERS.items()} | {ord(k.upper()): v.capitalize() for k, v in LETTERS.items() if len(k.upper()) == 1 and k.upper() != k}
_BROKEN = re.compile("[ÃÂâ][\u0080-\u00bf\u20ac\u201a-\u2122\u0152-\u0192\u02c6\u02dc]")


def mended(text: str) -> str:
    """Text that was read in a one-byte encoding though it is UTF-8, read anew; any other as it is."""
    if _BROKEN.search(text):
        for encoding in ("cp1252", "latin-1"):
            try:
                return text.encode(encoding).decode()
            except UnicodeError:
                continue
    return text


def transliterated(text: str) -> str:
    """In ASCII: mended, letters as LETTERS has them, others decomposed; what is left beyond ASCII goes."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKD", mended(text).translate(_TABLE)).encode("ascii", "ignore").decode()


@F.arrow_udf(T.StringType())
def ascii_only(text: pa.Array) -> pa.Array:
    other = pc.invert(pc.fill_null(pc.string_is_ascii(text), True))
    found = [transliterated(x) for x in text.filter(other).to_pylist()]
    return pc.replace_with_mask(text, other, pa.array(found, text.type)) if found else text


#: What a match of a pattern holds: its scheme or `www.`, @, the last digits of a phone number.
CLEANED = (
    (LINK, lambda x: x.contains("://") | F.lower(x).contains("www.")),
    (ADDRESS, has("@")),
    (PHONE, lambda x: x.rlike("[0-9]{3}[ .-]?[0-9]{4}")),
)


def cleaned(text: Column) -> Column:
    text = F.regexp_replace(ascii_only(text), r"[\r\n]+", " ")
    for pattern, test in CLEANED:
        text = where(text, test, lambda x, p=pattern: F.regexp_replace(x, p, ""))
    return strip(where(text, has("\t", "  "), lambda x: F.regexp_replace(x, r"\t[ \t]*| [ \t]+", " ")))


_BAD = "".join(x for x in map(chr, range(128)) if re.match(FORBIDDEN, x))


def allowed(text: Column) -> Column:
    """Only allowed characters, no runs of brackets, quotes and dashes, single spaces."""
    text = where(F.translate(text, _BAD, ""), lambda x: F.octet_length(x) > F.char_length(x), lambda x: F.regexp_replace(x, f"{FORBIDDEN}+", ""))
    return strip(where(F.regexp_replace(text, RUNS, ""), has("  "), lambda x: F.regexp_replace(x, "  +", " ")))


def normalised(text: Column) -> Column:
    """All steps."""
    return allowed(cleaned(detokenised(punctuation(without_special_tokens(without_line_breaks(text))))))
