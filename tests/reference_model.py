"""The rules of the scan, once more and plainly, one character at a time. Tests hold the engine against this."""

import unicodedata
from collections import Counter

from carrierlens import codepoints as C

SEVERITY = {"BIDI_OVERRIDE": "high", "TAG_CHARACTER": "high", "MIXED_SCRIPT": "high", "INVISIBLE_FORMAT": "medium", "SUSPICIOUS_WHITESPACE": "low"}


def script(cp):
    for name, spans in C.SCRIPTS.items():
        if any(a <= cp <= b for a, b in spans):
            return name
    return "Other"


def scan(text):
    """(offset, category, severity, label) of every finding."""
    cps = [ord(c) for c in text]
    letters = [p for p in cps if chr(p).isalpha()]
    by_script = Counter(script(p) for p in letters)
    foreign = sum(by_script[s] for s in C.FOREIGN)
    alike = sum(p in C.CONFUSABLE for p in letters)
    dense = foreign and alike / foreign >= 0.9
    whole = dense and foreign >= 8 and max(by_script[s] for s in C.FOREIGN) / len(letters) >= 0.7
    single = dense and not whole and by_script["ASCII"] + by_script["Latin"] > 0
    cluster = sum(p in C.ZERO_WIDTH for p in cps) >= 4
    out = []
    for k, p in enumerate(cps):
        if p in C.ZERO_WIDTH:
            out.append((k, "ZERO_WIDTH", "high" if cluster else "medium", f"U+{p:04X}"))
            continue
        category = None
        if p in C.BIDI:
            category = "BIDI_OVERRIDE"
        elif p in C.INVISIBLE:
            category = "INVISIBLE_FORMAT"
        elif C.TAGS[0] <= p <= C.TAGS[1]:
            category = "TAG_CHARACTER"
        elif p in C.SPACES:
            category = "SUSPICIOUS_WHITESPACE"
        elif chr(p).isalpha() and script(p) in C.FOREIGN and (whole or (single and p in C.CONFUSABLE)):
            category = "MIXED_SCRIPT"
        if category:
            out.append((k, category, SEVERITY[category], f"U+{p:04X}"))
    return out


def verdict(found):
    return "malicious" if any(s == "high" for _, _, s, _ in found) else "suspicious" if found else "clean"


def action(text, found):
    if any(text[k] in "‭‮" for k, *_ in found):
        return "block"
    review = {c for _, c, s, _ in found if c in ("BIDI_OVERRIDE", "TAG_CHARACTER", "MIXED_SCRIPT") or (c == "ZERO_WIDTH" and s == "high")}
    return "review" if review else "allow"


def canonical(text):
    table = {ord(k) if isinstance(k, str) else k: v for k, v in C.REWRITTEN.items()}
    table |= dict.fromkeys([*C.ZERO_WIDTH, *C.BIDI, *C.INVISIBLE, *range(0xE0000, 0xE0080)], "") | dict.fromkeys(C.SPACES, " ")
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).translate(table))
