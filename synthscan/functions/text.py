"""White space, blank texts, words and prefixes, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that Unicode calls white space, and the separators U+001C..U+001F.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: The same, one by one.
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nonblank(text: Column) -> Column:
    """Whether a text has a character that is no white space; null has none."""
    return F.coalesce(text.rlike(f"[^{SPACE}]"), F.lit(False))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Runs of other characters than white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")


def truncated(text: Column, ratio: float) -> Column:
    """struct(prefix, remainder): the words before and after the cut, joined by single spaces.

    The cut is after ratio of the words, rounded down, but leaves a word on either side. A text of fewer than two words
    is its own prefix, unchanged.
    """
    def cut(all_: Column) -> Column:
        n = F.size(all_)
        at = F.greatest(F.lit(1), F.least((F.lit(float(ratio)) * n).cast("int"), n - 1))
        prefix = F.when(n < 2, text).otherwise(F.concat_ws(" ", F.slice(all_, F.lit(1), at)))
        rest = F.when(n < 2, F.lit("")).otherwise(F.concat_ws(" ", F.slice(all_, at + 1, F.greatest(n - at, F.lit(0)))))
        return F.struct(prefix.alias("prefix"), rest.alias("remainder"))

    return let(words(text), cut)


def with_prompt(prompt: Column, prefix: Column) -> Column:
    """The prompt, a newline and the prefix; the prefix alone where there is no prompt."""
    prompt = F.coalesce(prompt.cast("string"), F.lit(""))
    return F.when(prompt != "", F.concat(prompt, F.lit("\n"), prefix)).otherwise(prefix)


def or_original(revised: Column, text: Column) -> Column:
    """The stripped revision, or the text where the revision is blank."""
    bare = strip(F.coalesce(revised, F.lit("")))
    return F.when(bare == "", text).otherwise(bare)


def continuation_key(prefix: Column, ratio: float, k: int) -> Column:
    """SHA-256 of prefix, ratio and number of continuations, separated by NUL; numbers written as Python does."""
    return F.sha2(F.concat(prefix, F.lit("\0"), F.lit(repr(float(ratio))), F.lit("\0"), F.lit(str(k))), 256)


def revision_key(text: Column) -> Column:
    return F.sha2(text, 256)


def shard_name(model: Column) -> Column:
    """A model's identifier as a file name: other characters than letters, digits, dot, underscore and dash become _."""
    return F.regexp_replace(model, "[^A-Za-z0-9._-]+", "_")


def token_budget(prompt_tokens: Column, ceiling: int = 1024, context: int | None = None) -> Column:
    """Tokens to generate for a revision: twice the prompt, within the ceiling and what the context leaves."""
    budget = F.least(2 * prompt_tokens, F.lit(ceiling))
    if context is not None:
        budget = F.least(budget, F.greatest(F.lit(1), F.lit(context) - prompt_tokens))
    return F.greatest(F.lit(1), budget)
