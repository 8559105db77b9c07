"""Decisions from whole-document counts, never from the evidence that is kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carrierlens import codepoints as C
from carrierlens.functions import scan
from carrierlens.settings import Policy

# What reason codes mean.
REASONS = {
    "NO_FINDINGS": "No configured Unicode carrier was found.",
    "INFORMATIONAL_CARRIER": "Only informational carrier evidence was found.",
    "RECOGNIZED_CONTEXT": "Carrier evidence matches a narrow recognized Unicode context.",
    "BIDI_EXPLICIT_OVERRIDE": "An explicit direction override can change displayed order.",
    "BIDI_CONTROL": "A direction control needs review.",
    "TAG_CHARACTER": "A Unicode tag sequence needs review.",
    "MIXED_SCRIPT": "Mixed-script evidence needs review.",
    "ZERO_WIDTH_CLUSTER": "An unexplained zero-width cluster needs review.",
    "UNRECOGNIZED_JOINER": "A joiner lacks a recognized context.",
    "INPUT_CHAR_LIMIT": "Input exceeds the configured character limit.",
    "INPUT_BYTE_LIMIT": "Input exceeds the configured byte limit.",
    "OUTPUT_BYTE_LIMIT": "The report exceeds the configured output limit.",
    "EVIDENCE_LIMIT": "Required decision evidence could not be retained.",
    "INVALID_UTF8": "Input is not valid UTF-8.",
    "INVALID_JSON": "The batch record is not valid UTF-8 JSON.",
    "INVALID_TYPE": "The input has the wrong type.",
    "INVALID_UNICODE": "Input contains a lone surrogate.",
    "INPUT_IO_ERROR": "The input could not be read.",
    "SCAN_ERROR": "Inspection failed; no text may be forwarded.",
    "UNCLASSIFIED_EVIDENCE": "An unclassified carrier needs review.",
    "LEGACY_HIGH_FINDING": "The legacy mapping found high-severity evidence.",
    "LEGACY_FINDING": "The legacy mapping found carrier evidence.",
}


def _first(*cases: tuple[Column | None, str, Column | str]) -> Column:
    """struct(action, reason_codes) of the first case that holds; reasons are one code or an array of them."""
    out = None
    for when, action, reasons in cases:
        s = F.struct(F.lit(action).alias("action"), (F.array(F.lit(reasons)) if isinstance(reasons, str) else reasons).alias("reason_codes"))
        out = (out.otherwise(s) if when is None else out.when(when, s)) if out is not None else F.when(when, s)
    return out


def _codes(**when: Column) -> Column:
    """The codes whose condition holds, sorted."""
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in sorted(when.items())]), lambda c: c.isNotNull())


def decide(n: Column, policy: Policy, context: Column | None = None) -> Column:
    """struct(action, reason_codes); null action where recognised context exceeds what was counted."""
    if policy is Policy.LEGACY_VERDICT:
        return _first((scan.has_high(n), "block", "LEGACY_HIGH_FINDING"), (scan.total(n) > 0, "review", "LEGACY_FINDING"), (None, "allow", "NO_FINDINGS"))
    rest = [(scan.total(n) > 0, "allow", "INFORMATIONAL_CARRIER"), (None, "allow", "NO_FINDINGS")]
    if policy is Policy.BALANCED:
        review = _codes(BIDI_CONTROL=n["bidi"] > 0, MIXED_SCRIPT=n["mixed"] > 0, TAG_CHARACTER=n["tags"] > 0, ZERO_WIDTH_CLUSTER=n["zero_width"] >= C.CLUSTER)
        return _first((n["explicit"] > 0, "block", "BIDI_EXPLICIT_OVERRIDE"), (F.size(review) > 0, "review", review), *rest)
    c = context
    review = _codes(
        BIDI_CONTROL=n["bidi"] > c["recognized_bidi"],
        MIXED_SCRIPT=n["mixed"] > 0,
        TAG_CHARACTER=n["tags"] > c["recognized_tags"],
        UNRECOGNIZED_JOINER=c["unrecognized_zwj"] != 0,
        ZERO_WIDTH_CLUSTER=n["zero_width"] - c["recognized_zero_width"] >= C.CLUSTER,
    )
    wrong = c.isNull() | (c["recognized_zero_width"] > n["zero_width"]) | (c["recognized_tags"] > n["tags"]) | (c["recognized_bidi"] > n["bidi"]) | (c["unrecognized_zwj"] < 0)
    recognized = c["recognized_zero_width"] + c["recognized_tags"] + c["recognized_bidi"] > 0
    decided = _first((F.size(review) > 0, "review", review), (recognized, "allow", "RECOGNIZED_CONTEXT"), *rest)
    failed = F.struct(F.lit(None).cast("string").alias("action"), F.array(F.lit("SCAN_ERROR")).alias("reason_codes"))
    blocked = _first((n["explicit"] > 0, "block", "BIDI_EXPLICIT_OVERRIDE"), (None, "block", "BIDI_EXPLICIT_OVERRIDE"))
    return F.when(n["explicit"] > 0, blocked).when(wrong, failed).otherwise(decided)


def explanation(codes: Column) -> Column:
    """Reason codes in words; a code that is not known in lower case."""
    known = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.array_join(F.transform(codes, lambda c: F.coalesce(F.element_at(known, c), F.lower(F.replace(c, F.lit("_"), F.lit(" "))))), "; ")
