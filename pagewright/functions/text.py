"""Text scalars: clean-up, scripts, expected characters, tokens and edit distances."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as white space, and the control characters that are deleted.
SPACES = "\\x{09}-\\x{0A}\\x{0D}\\x{20}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
CONTROLS = "\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}"

# Script families by code point range, in the order in which they are tried.
SCRIPTS = (
    ("latin", 0x0000, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x04FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("oriya", 0x0B00, 0x0B7F),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("cjk", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
    ("japanese", 0x3040, 0x30FF),
)
# Scripts that the primary recogniser reads.
PRIMARY_SCRIPTS = ("latin", "devanagari", "gujarati")
# Expected letters of a language.
LANGUAGE_RANGES = {
    "en": "\\x{41}-\\x{5A}\\x{61}-\\x{7A}",
    "hi": "\\x{900}-\\x{97F}",
    "mr": "\\x{900}-\\x{97F}",
    "gu": "\\x{A80}-\\x{AFF}",
}


def digit_class() -> str:
    """All characters with a digit value, superscripts and circled digits included, as a character class."""
    out, start = [], None
    for c in range(0x110001):
        # Decimal digits have a property of their own; ranges are needed for the others alone.
        other = c < 0x110000 and chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"
        if other and start is None:
            start = c
        elif not other and start is not None:
            out.append(f"\\x{{{start:X}}}-\\x{{{c - 1:X}}}")
            start = None
    return "\\p{Nd}" + "".join(out)


DIGITS = digit_class()


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition.  Python, as Spark has no such function."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """The text in composed form.  Below U+0300 every text is composed already, so such texts stay in the JVM."""
    return F.coalesce(nfc(F.when(text.rlike("[^\\x{00}-\\x{2FF}]"), text)), text)


def clean_text(text: Column, compose: bool = True) -> Column:
    """Compose, delete replacement and control characters, collapse white space, strip.

    Null and empty texts pass unchanged.  ``compose=False`` skips the only step that needs Python.
    """
    t = composed(text) if compose else text
    t = F.regexp_replace(t, f"[\\x{{FFFD}}{CONTROLS}]", "")
    t = F.regexp_replace(t, f"[{SPACES}]+", " ")
    return F.trim(t)


def strip(text: Column) -> Column:
    """Without white space at both ends (white space that controls count as included)."""
    own = f"[{SPACES}\\x{{0B}}\\x{{0C}}\\x{{1C}}-\\x{{1F}}\\x{{85}}]+"
    return F.regexp_replace(text, f"^{own}|{own}$", "")


def tokens(text: Column) -> Column:
    """White-space separated tokens."""
    own = f"[{SPACES}\\x{{0B}}\\x{{0C}}\\x{{1C}}-\\x{{1F}}\\x{{85}}]+"
    return F.filter(F.split(text, own), lambda t: t != "")


def count_of(text: Column, members: str) -> Column:
    """Number of characters of a class.

    Runs are taken out and the lengths compared: one match for each run costs far less than one for each character.
    """
    return F.length(text) - F.length(F.regexp_replace(text, f"[{members}]+", ""))


def letters(text: Column) -> Column:
    """Number of letters."""
    return count_of(text, "\\p{L}")


def script_letters(text: Column, name: str) -> Column:
    """Number of letters of one script family."""
    low, high = next((a, b) for n, a, b in SCRIPTS if n == name)
    return count_of(text, f"\\p{{L}}&&[\\x{{{low:X}}}-\\x{{{high:X}}}]")


#: White space, decimal digits and punctuation among the ASCII characters.
ASCII_COMMON = "\\x{09}-\\x{0D}\\x{1C}-\\x{20}0-9!-#%-*,-/:;?@\\[-\\]_{}"


def expected_characters(text: Column, language: Column, ranges: dict[str, str] | None = None) -> Column:
    """Number of characters that are white space, digits, punctuation or letters of the language.

    Texts are mostly ASCII, so what is expected there goes first, by a class that the pattern engine answers with
    a table; the general class, with its Unicode properties, runs on the rest, and only if that is not all ASCII.
    """
    common = f"\\x{{20}}\\p{{P}}\\p{{Nd}}{SPACES}\\x{{0B}}\\x{{0C}}\\x{{1C}}-\\x{{1F}}\\x{{85}}{DIGITS}"
    known = LANGUAGE_RANGES if ranges is None else ranges

    def by_language(of: Callable[[str], Column]) -> Column:
        chain = None
        for name, own in known.items():
            chain = F.when(language == name, of(own)) if chain is None else chain.when(language == name, of(own))
        return of("") if chain is None else chain.otherwise(of(""))

    def without_ascii(own: str) -> Column:
        return F.regexp_replace(text, f"[{ASCII_COMMON}{'A-Za-z' if own == LANGUAGE_RANGES['en'] else ''}]+", "")

    def further(rest: Column) -> Column:
        more = by_language(lambda own: count_of(rest, own + common))
        if ranges is None:  # nothing else that is ASCII is expected in any of these languages
            more = F.when(rest.rlike("[^\\x{00}-\\x{7F}]"), more).otherwise(0)
        return F.length(text) - F.length(rest) + more

    return _let(by_language(without_ascii), further)


def checkable_token(token: Column) -> Column:
    """Whether a token may be spell-checked: three characters or more, no digit, at least one letter."""
    numeric = token.rlike("\\p{Nd}") | ~token.rlike("[\\p{L}\\p{N}_]")
    return (F.length(token) >= 3) & ~numeric


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _common_start(a: Column, b: Column) -> Column:
    """Length of the common beginning, by halving steps; texts of up to 2^22 characters."""
    steps = F.array(*(F.lit(1 << k) for k in range(21, -1, -1)))
    shorter = F.least(F.length(a), F.length(b))

    def step(n: Column, k: Column) -> Column:
        same = F.substring(a, F.lit(1), n + k) == F.substring(b, F.lit(1), n + k)
        return F.when((n + k <= shorter) & same, n + k).otherwise(n)

    return F.aggregate(steps, F.lit(0), step)


def edit_distance(a: Column, b: Column, long: int = 256) -> Column:
    """Edit distance in code points.

    Long texts lose their common beginning and end first, which does not change the distance: what is left of
    a text and its correction is short, and the quadratic part runs on that alone.
    """
    def rest(t: Column, n: Column) -> Column:
        return F.substring(t, n + 1, F.length(t))

    def turned(p: Column, n: Column) -> Column:
        return F.struct(F.reverse(rest(p.a, n)).alias("a"), F.reverse(rest(p.b, n)).alias("b"))

    def middle(p: Column, n: Column) -> Column:
        return F.levenshtein(rest(p.a, n), rest(p.b, n))

    both = F.struct(a.alias("a"), b.alias("b"))
    back = _let(both, lambda p: _let(_common_start(p.a, p.b), lambda n: turned(p, n)))
    cut = _let(back, lambda p: _let(_common_start(p.a, p.b), lambda n: middle(p, n)))
    return F.when(F.greatest(F.length(a), F.length(b)) > long, cut).otherwise(F.levenshtein(a, b))


def edit_ratio(a: Column, b: Column) -> Column:
    """Edit distance over the longer length: 0 for equal texts, 1 if one is empty."""
    return (
        F.when(a == b, 0.0)
        .when((F.length(a) == 0) | (F.length(b) == 0), 1.0)
        .otherwise(edit_distance(a, b) / F.greatest(F.length(a), F.length(b)))
    )


def similarity_udf(autojunk: bool = True):
    """Gestalt similarity of two stripped texts; null reads as empty, and two empty texts are equal."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [difflib.SequenceMatcher(None, (x or "").strip(), (y or "").strip(), autojunk).ratio() for x, y in zip(a, b)],
            dtype="float64",
        )

    return ratio


def gestalt_similarity(a: Column, b: Column, least: float = 0.0, autojunk: bool = True) -> Column:
    """Gestalt similarity of two stripped texts; what surely is below ``least`` counts as 0.

    Equal texts, and texts whose lengths alone keep them below, are decided natively; the rest goes to Python.
    """
    x, y = (strip(F.coalesce(c, F.lit(""))) for c in (a, b))
    n, m = F.length(x), F.length(y)
    known = F.when(x == y, 1.0).when(2 * F.least(n, m) < least * (n + m), 0.0)
    return F.coalesce(known, similarity_udf(autojunk)(F.when(known.isNull(), x), F.when(known.isNull(), y)))


def word_distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Edit distance of two sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        diagonal, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, diagonal + (x != y))
    return row[-1]


def opcodes(before: Sequence[str], after: Sequence[str]) -> list[tuple[str, str, int]]:
    """Changed spans of two token lists: (before, after, edit distance of the spans)."""
    out = []
    for tag, a0, a1, b0, b1 in difflib.SequenceMatcher(a=before, b=after, autojunk=False).get_opcodes():
        if tag != "equal":
            x, y = " ".join(before[a0:a1]), " ".join(after[b0:b1])
            out.append((x, y, word_distance(x, y)))
    return out
