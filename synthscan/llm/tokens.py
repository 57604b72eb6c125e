"""Byte-level BPE ids of many texts.

The vocabulary is read as ranks by the faster of two public libraries, whose ids are the same; texts that hold the
vocabulary's special token are encoded by the tokenizers library itself, which gives it its own id, and so are those with
a run of LONG_SPACE white-space characters or more, for which the faster one's pattern runs out of its stack.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np

VOCABULARY, RANKS, SPECIAL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<|endoftext|>"
LONG_SPACE = 100_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")


class Encoder:
    """Ids of the vocabulary at `vocabulary`; `ranks` names the same vocabulary for the faster library."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
        with open(ranks or public_tokenizers.path(RANKS), "rb") as file:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.slow = self.plain = None

    def encode(self, text: str) -> np.ndarray:
        if SPECIAL not in text and (len(text) < LONG_SPACE or not _LONG_SPACE.search(text)):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.vocabulary)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_plain(self, text: str) -> list[int]:
        """Ids with the special token's string read as any other text."""
        if len(text) < LONG_SPACE or not _LONG_SPACE.search(text):
            return self.fast.encode_ordinary(text)
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.vocabulary)
            self.plain.encode_special_tokens = True
        return self.plain.encode(text, add_special_tokens=False).ids


@cache
def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    """One for each Python worker."""
    return Encoder(vocabulary, ranks)
