"""Tables of code points, and what is made from them: regular-expression classes, column tests, a dimension table."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Carriers by code point, with the names that evidence gives them.
ZERO_WIDTH = {0x200B: "ZERO WIDTH SPACE", 0x200C: "ZERO WIDTH NON-JOINER", 0x200D: "ZERO WIDTH JOINER", 0xFEFF: "ZERO WIDTH NO-BREAK SPACE"}
BIDI = {
    0x202A: "LEFT-TO-RIGHT EMBEDDING", 0x202B: "RIGHT-TO-LEFT EMBEDDING", 0x202C: "POP DIRECTIONAL FORMATTING",
    0x202D: "LEFT-TO-RIGHT OVERRIDE", 0x202E: "RIGHT-TO-LEFT OVERRIDE", 0x2066: "LEFT-TO-RIGHT ISOLATE",
    0x2067: "RIGHT-TO-LEFT ISOLATE", 0x2068: "FIRST STRONG ISOLATE", 0x2069: "POP DIRECTIONAL ISOLATE",
}
INVISIBLE = {
    0x00AD: "SOFT HYPHEN", 0x034F: "COMBINING GRAPHEME JOINER", 0x061C: "ARABIC LETTER MARK", 0x115F: "HANGUL CHOSEONG FILLER",
    0x1160: "HANGUL JUNGSEONG FILLER", 0x3164: "HANGUL FILLER", 0x2800: "BRAILLE PATTERN BLANK",
}
SPACES = {
    0x00A0: "NO-BREAK SPACE", 0x2000: "EN QUAD", 0x2001: "EM QUAD", 0x2002: "EN SPACE", 0x2003: "EM SPACE", 0x2004: "THREE-PER-EM SPACE",
    0x2005: "FOUR-PER-EM SPACE", 0x2006: "SIX-PER-EM SPACE", 0x2007: "FIGURE SPACE", 0x2008: "PUNCTUATION SPACE", 0x2009: "THIN SPACE",
    0x200A: "HAIR SPACE", 0x202F: "NARROW NO-BREAK SPACE", 0x205F: "MEDIUM MATHEMATICAL SPACE", 0x3000: "IDEOGRAPHIC SPACE",
}
TAGS = (0xE0000, 0xE007F)
EXPLICIT_OVERRIDES = (0x202D, 0x202E)
# Letters that look like Latin ones. The first table is also rewritten, the second only detected.
REWRITTEN = {
    0x0430: "a", 0x0435: "e", 0x0456: "i", 0x043E: "o", 0x0440: "p", 0x0441: "c", 0x0445: "x", 0x0443: "y", 0x0410: "A", 0x0412: "B",
    0x0415: "E", 0x041A: "K", 0x041C: "M", 0x041D: "H", 0x041E: "O", 0x0420: "P", 0x0421: "C", 0x0422: "T", 0x0425: "X",
    0x03B1: "a", 0x03B5: "e", 0x03B9: "i", 0x03BA: "k", 0x03BD: "v", 0x03BF: "o", 0x03C1: "p", 0x03C4: "t", 0x03C7: "x", 0x03B6: "z",
    0x0391: "A", 0x0392: "B", 0x0395: "E", 0x0397: "H", 0x0399: "I", 0x039A: "K", 0x039C: "M", 0x039D: "N", 0x039F: "O", 0x03A1: "P",
    0x03A4: "T", 0x03A7: "X", 0x0396: "Z",
}
DETECTED_ONLY = {
    0x054D: "S", 0x054F: "S", 0x0555: "O", 0x0561: "w", 0x0563: "q", 0x0566: "q", 0x0570: "h", 0x0575: "j", 0x0578: "n", 0x057C: "n",
    0x057D: "u", 0x0581: "g", 0x0582: "i", 0x0584: "f", 0x0585: "o", 0x0627: "l", 0x0647: "o", 0x06BE: "o", 0x06C1: "o", 0x06D5: "o",
    0x4E05: "T", 0x4E2B: "Y",
}
# Scripts by range; the foreign ones are those whose letters are counted.
SCRIPTS = {
    "ASCII": [(0x0000, 0x007F)], "Latin": [(0x0080, 0x024F)], "Greek": [(0x0370, 0x03FF)], "Cyrillic": [(0x0400, 0x052F)],
    "Armenian": [(0x0530, 0x058F)], "Hebrew": [(0x0590, 0x05FF)], "Arabic": [(0x0600, 0x06FF)], "Han": [(0x4E00, 0x9FFF), (0x3400, 0x4DBF)],
}
FOREIGN = ("Cyrillic", "Greek", "Armenian", "Arabic", "Han")
CATEGORIES = ("BIDI_OVERRIDE", "INVISIBLE_FORMAT", "MIXED_SCRIPT", "SUSPICIOUS_WHITESPACE", "TAG_CHARACTER", "ZERO_WIDTH")
CLUSTER = 4

CONFUSABLE = REWRITTEN | DETECTED_ONLY
NAMES = ZERO_WIDTH | BIDI | INVISIBLE | SPACES


def runs(points) -> list[tuple[int, int]]:
    """Sorted code points as inclusive ranges."""
    out: list[list[int]] = []
    for p in sorted(points):
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def pattern(ranges) -> str:
    """A Java character class of ranges, by number."""
    one = lambda p: f"\\x{{{p:X}}}"
    return "[" + "".join(one(a) if a == b else f"{one(a)}-{one(b)}" for a, b in ranges) + "]"


@cache
def letters(script: str | None = None) -> tuple[tuple[int, int], ...]:
    """Ranges of alphabetic code points of one script, or of all, by this Python's Unicode data."""
    spans = SCRIPTS[script] if script else [(0, sys.maxunicode)]
    return tuple(runs(p for a, b in spans for p in range(a, b + 1) if chr(p).isalpha()))


@cache
def marks() -> tuple[tuple[int, int], ...]:
    """Ranges of code points that combine with what is before them."""
    return tuple(runs(p for p in range(sys.maxunicode + 1) if unicodedata.combining(chr(p))))


#: Any code point of a foreign script's ranges: the first look before letters are counted.
FOREIGN_RANGES = [r for s in FOREIGN for r in SCRIPTS[s]]


def within(cp: Column, ranges) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | ((cp == a) if a == b else cp.between(a, b))
    return out


def script(cp: Column) -> Column:
    """The script bucket of a code point."""
    out = None
    for name, spans in SCRIPTS.items():
        out = F.when(within(cp, spans), F.lit(name)) if out is None else out.when(within(cp, spans), F.lit(name))
    return out.otherwise(F.lit("Other"))


def lookup(table: dict[int, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def carrier(cp: Column) -> Column:
    """The category of an invisible, direction, tag or space carrier; null for other code points."""
    return (
        F.when(cp < 0xA0, F.lit(None))
        .when(cp.isin(*ZERO_WIDTH), F.lit("ZERO_WIDTH"))
        .when(cp.isin(*BIDI), F.lit("BIDI_OVERRIDE"))
        .when(cp.isin(*INVISIBLE), F.lit("INVISIBLE_FORMAT"))
        .when(cp.between(*TAGS), F.lit("TAG_CHARACTER"))
        .when(cp.isin(*SPACES), F.lit("SUSPICIOUS_WHITESPACE"))
    )


def label(cp: Column) -> Column:
    digits = F.hex(cp)
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def dimension(spark: SparkSession) -> DataFrame:
    """All carriers and lookalikes: cp, ch, category, name, severity, script, confusable. A fixed number of rows."""
    rows = []
    for table, category, severity in ((ZERO_WIDTH, "ZERO_WIDTH", "medium"), (BIDI, "BIDI_OVERRIDE", "high"), (INVISIBLE, "INVISIBLE_FORMAT", "medium"), (SPACES, "SUSPICIOUS_WHITESPACE", "low")):
        rows += [(p, chr(p), category, name, severity, None) for p, name in table.items()]
    rows += [(p, chr(p), "TAG_CHARACTER", None, "high", None) for p in range(TAGS[0], TAGS[1] + 1)]
    rows += [(p, chr(p), "MIXED_SCRIPT", None, "high", t) for p, t in CONFUSABLE.items()]
    out = spark.createDataFrame(rows, "cp int, ch string, category string, name string, severity string, confusable string")
    return out.withColumn("script", script(F.col("cp")))
