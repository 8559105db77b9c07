"""Narrow contexts in which joiners, tags and isolates are ordinary writing.

Emoji sequences are matched longest first, one character on after a failure. Without a sequence file the table holds the
three subdivision flags and the joiner sequences that rules below generate from the public structure of emoji. Table and
file must have the expected number of sequences.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from carrierlens import codepoints as C
from carrierlens.functions.scan import non_ascii

CONTEXT = "struct<recognized_zero_width:int,recognized_tags:int,recognized_bidi:int,unrecognized_zwj:int>"
#: Sequences of a whole table of Emoji 18.
WHOLE = 1617
ZWNJ, ZWJ, VS16 = "‌", "‍", "️"
TONES = ["", *map(chr, range(0x1F3FB, 0x1F400))]
NEIGHBOURS = re.compile("[‌‍︎️\U000e0000-\U000e007f]")
OPENERS, RTL_OPENERS, CLOSER = "⁦⁧⁨", "⁧⁨", "⁩"


@lru_cache(maxsize=1)
def generated() -> frozenset[str]:
    """Tag flags and joiner sequences by rule."""
    man, woman, person = "\U0001f468", "\U0001f469", "\U0001f9d1"
    tag = lambda s: "\U0001f3f4" + "".join(chr(0xE0000 + ord(c)) for c in s) + "\U000e007f"
    out = {tag(s) for s in ("gbeng", "gbsct", "gbwls")}
    join = lambda *parts: ZWJ.join(parts)
    # people with a role, an object or hair; signs take a variation selector
    roles = ["⚕️", "⚖️", "✈️", *"\U0001f33e\U0001f373\U0001f37c\U0001f393\U0001f3a4\U0001f3a8\U0001f3eb\U0001f3ed\U0001f4bb\U0001f4bc\U0001f527\U0001f52c\U0001f680\U0001f692\U0001f9af\U0001f9bc\U0001f9bd\U0001f9b0\U0001f9b1\U0001f9b2\U0001f9b3"]
    out |= {join(p + t, r) for p, t, r in product((man, woman, person), TONES, roles)} | {join(person + t, "\U0001f384") for t in TONES}
    # activities and fantasy figures with a gender sign
    acts = "\U0001f3c3\U0001f3c4\U0001f3ca\U0001f46e\U0001f470\U0001f471\U0001f473\U0001f477\U0001f481\U0001f482\U0001f486\U0001f487\U0001f645\U0001f646\U0001f647\U0001f64b\U0001f64d\U0001f64e\U0001f6a3\U0001f6b4\U0001f6b5\U0001f6b6\U0001f926\U0001f935\U0001f937\U0001f938\U0001f939\U0001f93d\U0001f93e\U0001f9b8\U0001f9b9\U0001f9cd\U0001f9ce\U0001f9cf\U0001f9d4\U0001f9d6\U0001f9d7\U0001f9d8\U0001f9d9\U0001f9da\U0001f9db\U0001f9dc\U0001f9dd"
    signs = ("♀️", "♂️")
    out |= {join(a + t, s) for a, t, s in product(acts, TONES, signs)}
    out |= {join(a + v, s) for a in ("⛹", "\U0001f3cb", "\U0001f3cc", "\U0001f575") for v in (VS16, *TONES[1:]) for s in signs}
    out |= {join(a, s) for a in "\U0001f46f\U0001f93c\U0001f9de\U0001f9df" for s in signs}
    # couples, with every pair of tones or none
    heart, kiss = "❤️", "\U0001f48b"
    tones = [("", ""), *product(TONES[1:], TONES[1:])]
    for a, b in ((man, man), (woman, man), (woman, woman)):
        out |= {join(a + s, heart, b + t) for s, t in tones} | {join(a + s, heart, kiss, b + t) for s, t in tones}
    out |= {join(person + s, "\U0001f91d", person + t) for s, t in tones}
    # pairs of unlike tones; of like tones there are single characters
    unlike = [(s, t) for s, t in tones if s != t]
    out |= {join(person + s, *mid, person + t) for mid in ((heart,), (heart, kiss)) for s, t in unlike}
    out |= {join(a + s, "\U0001f91d", b + t) for a, b in ((man, man), (woman, man), (woman, woman)) for s, t in unlike}
    out |= {join(a + s, sign, a + t) for a in (man, woman, person) for sign in ("\U0001f430", "\U0001faef") for s, t in unlike}
    out |= {join("\U0001faf1" + s, "\U0001faf2" + t) for s, t in unlike}
    out |= {join(a + t, s) for a in "\U0001f46f\U0001f93c" for t in TONES[1:] for s in signs}
    out |= {join(person + t, "\U0001fa70") for t in TONES}
    # walkers, runners, kneelers and those with a cane or a wheelchair, facing right
    right = "➡️"
    out |= {join(a + t, *s, right) for a in "\U0001f6b6\U0001f3c3\U0001f9ce" for t in TONES for s in ((), *[(x,) for x in signs])}
    out |= {join(a + t, aid, right) for a in (man, woman, person) for t in TONES for aid in "\U0001f9af\U0001f9bc\U0001f9bd"}
    # families of one or two adults and one or two children
    adults = [(man,), (woman,), (man, woman), (man, man), (woman, woman)]
    boy, girl = "\U0001f466", "\U0001f467"
    out |= {join(*a, *c) for a in adults for c in ((boy,), (girl,), (girl, boy), (boy, boy), (girl, girl))}
    child = "\U0001f9d2"
    out |= {join(*[person] * a, *[child] * c) for a in (1, 2) for c in (1, 2)}
    # single signs
    out |= {
        join("\U0001f3f3️", "\U0001f308"), join("\U0001f3f3️", "⚧️"), join("\U0001f3f4", "☠️"),
        join("\U0001f415", "\U0001f9ba"), join("\U0001f408", "⬛"), join("\U0001f43b", "❄️"), join("\U0001f426", "⬛"),
        join("\U0001f426", "\U0001f525"), join("\U0001f34b", "\U0001f7e9"), join("\U0001f344", "\U0001f7eb"), join("⛓️", "\U0001f4a5"),
        join("❤️", "\U0001f525"), join("❤️", "\U0001fa79"), join("\U0001f441️", "\U0001f5e8️"),
        join("\U0001f62e", "\U0001f4a8"), join("\U0001f635", "\U0001f4ab"), join("\U0001f636", "\U0001f32b️"),
        join("\U0001f642", "↔️"), join("\U0001f642", "↕️"),
    }
    if len(out) != WHOLE:
        raise ValueError(f"{len(out)} sequences, not {WHOLE}")
    return frozenset(out)


def read_sequences(path: str) -> frozenset[str]:
    """Sequences of a file: code points in hexadecimal, a sequence a line, # for comments. Fails unless it is whole."""
    with open(path, encoding="ascii") as f:
        out = frozenset("".join(chr(int(x, 16)) for x in line.split()) for line in f if line.strip() and not line.startswith("#"))
    if len(out) != WHOLE:
        raise ValueError(f"{path} has {len(out)} sequences, not {WHOLE}")
    return out


@lru_cache(maxsize=4)
def _lookup(sequences: frozenset[str]) -> tuple[re.Pattern, tuple[int, ...]]:
    """A class of the characters that begin sequences, and the sequences' lengths, longest first."""
    starts = "".join(re.escape(c) for c in sorted({s[0] for s in sequences}))
    return re.compile(f"[{starts}]"), tuple(sorted({len(s) for s in sequences}, reverse=True))


def emoji(text: str, sequences: frozenset[str]) -> tuple[int, int]:
    """Joiners and tags inside recognised sequences whose neighbours are no carriers."""
    joiners = tags = at = 0
    start, lengths = _lookup(sequences)
    while m := start.search(text, at):
        a = m.start()
        found = next((s for n in lengths if (s := text[a : a + n]) in sequences), "")
        b = a + len(found)
        if not found or (a and NEIGHBOURS.match(text, a - 1)) or NEIGHBOURS.match(text, b):
            at = a + 1
            continue
        joiners += found.count(ZWJ)
        tags += sum(C.TAGS[0] <= ord(c) <= C.TAGS[1] for c in found)
        at = b
    return joiners, tags


def joining(text: str) -> tuple[int, int]:
    """Non-joiners between Arabic letters, joiners after a virama before a Devanagari letter."""
    arabic = sum(x.isalpha() and y.isalpha() for x, y in re.findall("(?<=([؀-ۿ]))‌(?=([؀-ۿ]))", text))
    indic = sum(y.isalpha() for y in re.findall("(?<=्)‍(?=([ऀ-ॿ]))", text))
    return arabic, indic


_BARRED = frozenset(map(chr, [*C.BIDI, *C.ZERO_WIDTH, *C.INVISIBLE, *range(C.TAGS[0], C.TAGS[1] + 1), 0x200C, 0x200D, 0xFE0E, 0xFE0F, 0x0A, 0x0D]))


@lru_cache(maxsize=4096)
def _in_rtl(char: str) -> int:
    """2 for a strong right-to-left character, 1 for one that may stand beside it, 0 for any other."""
    kind = unicodedata.bidirectional(char)
    if char in _BARRED:
        return 0
    if kind in ("R", "AL"):
        return 2
    neutral = kind in ("AN", "NSM", "WS", "CS", "ES", "ET") or (kind == "ON" and unicodedata.category(char)[0] == "P")
    return int(neutral)


def isolates(text: str) -> int:
    """Openers and closers of outermost, un-nested right-to-left isolates around simple right-to-left text."""
    found, depth, opened, nested = 0, 0, -1, False
    for m in re.finditer("[⁦-⁩]", text):
        if m.group() != CLOSER:
            opened, nested = (m.start(), False) if depth == 0 else (opened, True)
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0 and not nested and text[opened] in RTL_OPENERS:
                kinds = set(map(_in_rtl, text[opened + 1 : m.start()]))
                found += 2 * (2 in kinds and 0 not in kinds)
    return found


def recognise(text: str, sequences: frozenset[str]) -> tuple[int, int, int, int]:
    emoji_joiners, tags = emoji(text, sequences)
    arabic, indic = joining(text)
    return emoji_joiners + indic + arabic, tags, isolates(text), text.count(ZWJ) - emoji_joiners - indic


def context(text: Column, sequences: frozenset[str] | None = None) -> Column:
    """What is recognised in a text; only texts that hold a joiner, tag or isolate reach Python."""
    table = generated() if sequences is None else sequences

    @F.arrow_udf(CONTEXT)
    def count(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            try:
                rows.append(None if t is None else dict(zip(("recognized_zero_width", "recognized_tags", "recognized_bidi", "unrecognized_zwj"), recognise(t, table), strict=True)))
            except Exception:  # fails closed: the decision sees context it cannot hold with
                rows.append({"recognized_zero_width": -1, "recognized_tags": -1, "recognized_bidi": -1, "unrecognized_zwj": -1})
        fields = [pa.field(n, pa.int32()) for n in ("recognized_zero_width", "recognized_tags", "recognized_bidi", "unrecognized_zwj")]
        return pa.array(rows, pa.struct(fields))

    asks = non_ascii(text) & text.rlike(C.pattern([(0x200C, 0x200D), (0x2066, 0x2069), C.TAGS]))
    nothing = F.struct(*[F.lit(0).alias(n) for n in ("recognized_zero_width", "recognized_tags", "recognized_bidi", "unrecognized_zwj")]).cast(CONTEXT)
    return F.when(asks, count(F.when(asks, text))).otherwise(nothing)
