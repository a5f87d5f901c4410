"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

Encoding a word: an Aho-Corasick automaton over the vocabulary gives the longest token at every
position.  Tokens are laid from left to right; a token may follow another only if the pair is
compatible, that is if the merges would not have joined them differently.  Where no token of a
position is compatible, the encoder steps back.  The result is exactly what applying the merges in
order gives, in time linear in the word.

Decoding: all token strings lie in one block of bytes with a table of offsets; a text is decoded by
gathering the byte ranges of its ids.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_rows, prepare, text_of

#: Stands for the end of a word while matching; the byte alphabet has no such character.
WORD_END = "\n"
#: Longer words are not remembered: they hardly repeat and would fill the table.
LONGEST_KEPT = 48


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class MergeTable:
    """Vocabulary, merges, automaton and pair compatibility of one BPE model with word ends."""

    def __init__(self, model: dict):
        suffix = model.get("end_of_word_suffix") or ""
        self.ends = bool(suffix)

        def written(token: str) -> str:
            return token[: -len(suffix)] + WORD_END if suffix and token.endswith(suffix) else token

        self.vocab = {written(t): i for t, i in model["vocab"].items()}
        size = max(self.vocab.values()) + 1
        self.merged: dict[int, int] = {}  # pair (left * size + right) -> token
        self.size = size
        self.rank = [-1] * size
        self.halves: list[tuple[int, int] | None] = [None] * size
        for rank, (a, b) in enumerate(model["merges"]):
            left, right = self.vocab[a], self.vocab[written(b)]
            whole = self.vocab[written(a + b)]
            if self.halves[whole] is None:
                self.halves[whole] = (left, right)
                self.rank[whole] = rank
            self.merged[left * size + right] = whole
        self.length = [0] * size
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            self.length[i] = len(token)
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.shorter = self._next_shorter()
        self.compatible: dict[int, bool] = {}

    def _next_shorter(self) -> list[int]:
        """For each token the longest other token that is a proper prefix of it, or -1."""
        out = [-1] * self.size
        for token, i in self.vocab.items():
            out[i] = next((self.vocab[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.vocab), -1)
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may directly follow ``left`` in an encoding; remembered for each pair."""
        key = left * self.size + right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 1_000_000:
                self.compatible = {}
            known = self.compatible[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens from the last one back.

        As long as the symbols that face each other have no merge that would have come before the one
        just undone, the boundary between the tokens stayed untouched.  On equal ranks the merge
        further left came first.
        """
        bound, after_left = None, False  # rank of the merge undone last; whether it was on the left side
        while True:
            whole = self.merged.get(left * self.size + right)
            if whole is not None:
                rank = self.rank[whole]
                # A merge across the boundary of the same rank as one just undone to its right came first.
                if bound is None or rank < bound or (rank == bound and not after_left):
                    return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            # Of equal ranks the left one was merged first, so the right one is undone first.
            if a > b:
                bound, after_left = a, True
                left = self.halves[left][1]
            else:
                bound, after_left = b, False
                right = self.halves[right][0]

    def encode(self, word: str) -> list[int] | None:
        """Ids of one word in the byte alphabet; None if a symbol is not in the vocabulary."""
        text = word + WORD_END if self.ends else word
        size, length, compatible = self.size, self.length, self.compatible
        end = len(text)
        longest = [-1] * end
        for last, token in self.automaton.iter(text):
            longest[last + 1 - length[token]] = token  # matches come by their ends, so longer ones overwrite
        out: list[int] = []
        at, before = 0, -1
        while at < end:  # the longest tokens alone, which nearly always fit
            token = longest[at]
            if token < 0 or (before >= 0 and not (compatible.get(before * size + token) or self.fits(before, token))):
                return self._backtrack(text, longest)
            out.append(token)
            at += length[token]
            before = token
        return out

    def _backtrack(self, text: str, longest: list[int]) -> list[int] | None:
        end = len(text)
        open_at = [True] * (end + 1)  # positions from which the rest may still be encoded
        for i in range(1, end):
            open_at[i] = longest[i] >= 0
        if self.ends and end > 1:
            open_at[end - 1] = False  # the end mark belongs to its last symbol
        out: list[int] = []
        at, token = 0, longest[0]
        while at < end:
            before = out[-1] if out else -1
            while token >= 0:
                to = at + self.length[token]
                if open_at[to] and (before < 0 or self.fits(before, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = to
                token = longest[at] if at < end else -1
            elif out:
                open_at[at] = False
                token = out.pop()
                at -= self.length[token]
            else:
                return None
        return out


class WordBpe:
    """The whole tokenizer: normalisation, split into words, encoding and decoding, as its file says."""

    def __init__(self, path: str, keep: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.common = regex.compile(r"[^\x00-ͯ]").search
        self.bpe = MergeTable(spec["model"])
        self.letters = byte_alphabet()
        self.plain_bytes = str.maketrans({chr(b): self.letters[b] for b in range(256)})
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True))))
        self._offsets(spec, added)
        self.binary = [i.to_bytes(4, "little") for i in range(len(self.offsets) - 1)]
        self.decimal = [str(i).encode() for i in range(len(self.offsets) - 1)]
        # Two generations of remembered words: when the young one holds half of what may be kept, it becomes
        # the old one, and words that still occur move over.
        self.keep = keep
        self.fixed = {t: self._entry([i]) for t, i in added.items()}
        self.table: dict[str, tuple[bytes, bytes]] = dict(self.fixed)
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.agreed: dict[str, bool] = {}

    def _offsets(self, spec: dict, added: dict[str, int]) -> None:
        strings = {i: t for t, i in [*spec["model"]["vocab"].items(), *added.items()]}
        rows = [(strings.get(i, "") + " ").encode() for i in range(max(strings) + 1)]
        self.block = np.frombuffer(b"".join(rows), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])

    def _entry(self, ids: list[int]) -> tuple[bytes, bytes]:
        binary, decimal = self.binary, self.decimal
        return b"".join([binary[i] for i in ids]), b" ".join([decimal[i] for i in ids])

    def _normal(self, text: str) -> str:
        if self.common(text):
            return self.library.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).lower()

    def _agrees(self, char: str) -> bool:
        known = self.agreed.get(char)
        if known is None:
            probe = f"a{char}{char}1 {char} !{char}"
            known = self.agreed[char] = self.find(probe) == self._library_words(probe)
        return known

    def _library_words(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _words_of(self, text: str) -> list[str]:
        text = self._normal(text)
        if self.common(text) and not all(self._agrees(c) for c in set(text) if c > "ͯ"):
            return self._library_words(text)
        return self.find(text)

    def words(self, text: str) -> list[str]:
        """Normalised words in order; special strings stand as themselves."""
        if "<|" not in text or not (found := list(self.special.finditer(text))):
            return self._words_of(text)
        out, at = [], 0
        for m in found:
            out += self._words_of(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._words_of(text[at:])

    def _shown(self, word: str) -> str:
        if word.isascii():
            return word.translate(self.plain_bytes)
        return "".join([self.letters[b] for b in word.encode()])

    def _encode_word(self, word: str) -> tuple[bytes, bytes]:
        ids = self.bpe.encode(self._shown(word))
        return self._entry(ids if ids is not None else [])

    def entries(self, wanted: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """(little-endian ids, ids as decimal text) for each word, from a table of bounded size."""
        if len(self.table) > self.keep // 2:
            self.table, self.old = dict(self.fixed), self.table
        table, old = self.table, self.old
        passing = {}
        for w in wanted:
            if w not in table:
                if w in old:
                    table[w] = old[w]
                else:
                    (table if len(w) <= LONGEST_KEPT else passing)[w] = self._encode_word(w)
        return {**{w: table[w] for w in wanted if w in table}, **passing} if passing else table

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        found = self.entries(set(words))
        return np.frombuffer(b"".join([found[w][0] for w in words]), "<u4").tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the token strings with one space between them."""
        if not len(ids):
            return b""
        # Gathered in bounded steps: the index array is several times as large as the text.
        return b"".join(self._gather(ids[i : i + 65536]) for i in range(0, len(ids), 65536))[:-1]

    def _gather(self, ids: np.ndarray) -> bytes:
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        end = np.cumsum(size)
        where = np.repeat(start - (end - size), size) + np.arange(end[-1])
        return self.block[where].tobytes()


@lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encode every whole text and decode it again.

    One row for each document: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``with_ids``,
    ``ids array<int>`` and ``decoded string``.  Null text is empty: no ids, and the hashes of the empty
    string.  An empty table gives no rows; repeated rows are kept; other columns are ignored.
    """
    prepare(docs.sparkSession)
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")

    def make():
        bpe = word_bpe(path)

        def work(batch):
            out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
            for text in batch["text"]:
                words = bpe.words(text)
                found = bpe.entries(set(words))
                own = [found[w] for w in words]
                ids = np.frombuffer(b"".join([e[0] for e in own]), "<u4")
                decoded = bpe.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(b" ".join([e[1] for e in own if e[1]])).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    out["ids"].append(ids.tolist())
                    out["decoded"].append(decoded.decode())
            return {"doc_id": batch["doc_id"], **out}

        return work

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(docs, text_column).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(rows, make, schema + (", ids array<int>, decoded string" if with_ids else ""), rows=256)


def decode_documents(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>`` to ``doc_id, text``: the offset table alone.  Null ids give the empty text."""
    prepare(encoded.sparkSession)
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")

    def make():
        bpe = word_bpe(path)
        return lambda batch: {
            "doc_id": batch["doc_id"],
            "text": [bpe.decode(np.array(ids or [], "<u4")).decode() for ids in batch["ids"]],
        }

    return map_rows(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), make, "doc_id long, text string")
