"""Carriers put into texts, to build corpora of known attacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carrierlens import codepoints as C

# What is swapped for what.
CYRILLIC = dict(zip("aeiopcxyABEKMHOPCT", "аеіорсхуАВЕКМНОРСТ", strict=True))
GREEK = dict(zip("aeiokvptxzAEIOKNPTZ", "αειοκνρτχζΑΕΙΟΚΝΡΤΖ", strict=True))
COVERS = {"zero_width": "Please summarize this document.", "bidi": "Click here for details", "tags": "Invoice #1042 attached."}


def zero_width_encode(payload: Column, cover: Column | None = None) -> Column:
    """The payload's code points in binary, eight digits or more each, as zero-width characters after the cover."""
    one = lambda c: F.lpad(F.bin(F.ascii(c)), F.greatest(F.lit(8), F.length(F.bin(F.ascii(c)))), F.lit("0"))
    bits = F.array_join(F.transform(F.filter(F.split(payload, ""), lambda c: c != ""), one), "")
    return F.concat(F.lit(COVERS["zero_width"]) if cover is None else cover, F.translate(bits, "01", "​‌"))


def homoglyph_swap(text: Column) -> Column:
    return F.translate(text, "".join(CYRILLIC), "".join(CYRILLIC.values()))


def greek_homoglyph_swap(text: Column) -> Column:
    return F.translate(text, "".join(GREEK), "".join(GREEK.values()))


def invisible_format_embed(text: Column, marker: str = "­") -> Column:
    """The marker in the middle of the text."""
    if len(marker) != 1 or ord(marker) not in C.INVISIBLE:
        raise ValueError("marker must be one of the invisible formatting characters")
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), half), F.lit(marker), F.substring(text, half + 1, F.length(text)))


def suspicious_whitespace_replace(text: Column, marker: str = " ") -> Column:
    """The marker for the first space; null for a text without a space."""
    if len(marker) != 1 or ord(marker) not in C.SPACES:
        raise ValueError("marker must be one of the unusual spaces")
    at = F.locate(" ", text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(marker), F.substring(text, at + 1, F.length(text))))


def bidi_wrap(payload: Column, cover: Column | None = None) -> Column:
    return F.concat(F.lit(COVERS["bidi"]) if cover is None else cover, F.lit(" ‮"), payload, F.lit("‬"))


def tag_encode(payload: Column, cover: Column | None = None) -> Column:
    """An ASCII payload as tags after the cover."""
    plain = "".join(map(chr, range(128)))
    return F.concat(F.lit(COVERS["tags"]) if cover is None else cover, F.translate(payload, plain, "".join(chr(C.TAGS[0] + k) for k in range(128))))
