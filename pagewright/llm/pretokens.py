"""The byte-level vocabulary: its pre-tokens, and ids exactly as the tokenizer library gives them.

A byte-level BPE never merges across pre-tokens, so whatever is computed for one pre-token holds
wherever it occurs.  :class:`PreTokens` splits texts as the library does and keeps one value for each
distinct pre-token; :class:`FastIds` encodes whole texts.  Both run the vocabulary's merges on a faster
encoder, and go back to the library for texts with characters that the two class differently.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

from .bpe import LONGEST_KEPT, byte_alphabet

#: Fixed value: below this code point the pattern engine and the library put every character into
#: the same classes (checked for all code points); newer characters are compared one by one.
FIRST_ODD = "՘"


def rank_encoder(path: str) -> tiktoken.Encoding:
    """An encoder with the vocabulary file's own tokens; in it a token's id is also the rank of its merge."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    return tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks={bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items()},
        special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]},
    )


class FastIds:
    """Ids of whole texts, as the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.encoder = rank_encoder(path)
        self.odd = regex.compile(f"[^\\x00-{chr(ord(FIRST_ODD) - 1)}]").search
        self.agreed: dict[str, bool] = {}

    def _agrees(self, char: str) -> bool:
        known = self.agreed.get(char)
        if known is None:
            probe = f"a{char}{char}1 {char} !{char}"
            known = self.encoder.encode_ordinary(probe) == self.library.encode(probe, add_special_tokens=False).ids
            self.agreed[char] = known
        return known

    def ids(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids."""
        if not self.odd(text) or all(self._agrees(c) for c in set(text) if c >= FIRST_ODD):
            try:
                return self.encoder.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except (ValueError, RuntimeError):  # the encoder's pattern engine gives up on extreme runs
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


class PreTokens:
    """Splits texts into pre-tokens and maps each distinct pre-token to a value.

    ``value`` turns the ids of one pre-token into the value to remember.  ``keep`` bounds the table,
    which costs time but never changes a result.
    """

    def __init__(self, path: str, value: Callable[[list[int]], object], keep: int = 300_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.encoder = rank_encoder(path)
        self.value = value
        self.keep = keep
        self.table: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.odd = regex.compile(f"[^\\x00-{chr(ord(FIRST_ODD) - 1)}]").search
        self.agreed: dict[str, bool] = {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        specials = sorted((t.content for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def agrees(self, char: str) -> bool:
        """Whether pattern and library class ``char`` alike (checked once for each character)."""
        known = self.agreed.get(char)
        if known is None:
            probe = f"a{char}{char}1 {char} !{char}"
            known = self.find(probe) == self._library(probe)
            self.agreed[char] = known
        return known

    def _library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _plain(self, text: str) -> list[str]:
        if self.odd(text) and not all(self.agrees(c) for c in set(text) if c >= FIRST_ODD):
            return self._library(text)
        return self.find(text)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of ``text`` in order; special strings stand as themselves, as in the library."""
        if self.special is None or not (found := list(self.special.finditer(text))):
            return self._plain(text)
        out, at = [], 0
        for m in found:
            out += self._plain(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._plain(text[at:])

    def values(self, wanted: Iterable[str]) -> dict[str, object]:
        """A table that has a value for every string of ``wanted``; each one is encoded at most once.

        Two generations bound it: when the young one holds half of what may be kept it becomes the old one,
        and pre-tokens that still occur move over.
        """
        wanted = set(wanted)
        if len(self.table) > self.keep // 2:
            self.table, self.old = {}, self.table
        table, old = self.table, self.old
        missing = [w for w in wanted if w not in table]
        for w in missing:
            if w in old:
                table[w] = old[w]
        missing = [w for w in missing if w not in table]
        if not missing:
            return table
        encode = self.encoder.encode
        values = [self.value(encode(w, allowed_special="all")) for w in missing]
        if max(map(len, missing)) <= LONGEST_KEPT:
            table.update(zip(missing, values))
            return table
        table.update((w, v) for w, v in zip(missing, values) if len(w) <= LONGEST_KEPT)
        return {w: table[w] for w in wanted if w in table} | dict(zip(missing, values))
