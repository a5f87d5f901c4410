"""Language of a line of text, restricted to the languages that the recognisers support."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

# Supported languages by script.
BY_SCRIPT = {
    "latin": "en",
    "gujarati": "gu",
    "tamil": "ta",
    "telugu": "te",
    "bengali": "bn",
    "kannada": "kn",
}
# Frequent Marathi words and word ends that Hindi does not have.
MARATHI = "(^|\\P{L})(आहे|आहेत|आणि|नाही|होते|होता|होती|च्या|मध्ये|साठी|तो|ती|ते|हे|हा|ही|काय|म्हणून)(\\P{L}|$)|ळ|\\p{L}(च्या|मध्ये|साठी|ाचे|ाची|ाचा)"
LATIN_ENGLISH = "(?i)(^|\\P{L})(the|of|and|to|in|is|that|for|it|was|with|as|on|are|this|be|by|at|from|or|an)(\\P{L}|$)"


def detect_language(text: Column, least: int = 4) -> Column:
    """Language code, or ``und`` for short texts, texts without letters and scripts out of scope.

    A declared substitute for a statistical detector: the script with the most letters decides, and of the
    two languages in Devanagari the marker words.  Latin text counts as English if it is plain ASCII or
    has a frequent English word.
    """
    t = F.coalesce(text, F.lit(""))
    counts = [F.struct(X.script_letters(t, n).alias("n"), F.lit(n).alias("script")) for n in (*BY_SCRIPT, "devanagari")]
    top = F.array_max(F.array(*counts))
    out = F.when(X.strip(t) == "", "und").when(F.length(X.strip(t)) < least, "und").when(top.n == 0, "und")
    out = out.when(top.script == "devanagari", F.when(t.rlike(MARATHI), "mr").otherwise("hi"))
    for script, lang in BY_SCRIPT.items():
        if script == "latin":
            plain = t.rlike(LATIN_ENGLISH) | ~t.rlike("[\\p{L}&&[^\\x{00}-\\x{7F}]]")
            out = out.when(top.script == script, F.when(plain, lang).otherwise("und"))
        else:
            out = out.when(top.script == script, lang)
    return out.otherwise("und")
