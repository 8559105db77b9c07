"""Canonical text: NFKC, carriers stripped, lookalikes and spaces mapped, NFKC again.

Spark has no normalisation, so the whole of it is one Arrow function; texts of ASCII only are their own canonical form
and never reach Python.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from carrierlens import codepoints as C
from carrierlens.functions.scan import non_ascii

#: Marks in a row beyond which the library's reordering, quadratic in the run, is not used.
LONG_RUN = 32
TABLE = dict.fromkeys([*C.ZERO_WIDTH, *C.BIDI, *C.INVISIBLE, *range(C.TAGS[0], C.TAGS[1] + 1)], "") | C.REWRITTEN | dict.fromkeys(C.SPACES, " ")


@cache
def _long_run() -> re.Pattern:
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in C.marks()) + f"]{{{LONG_RUN},}}")


def nfkc(text: str) -> str:
    """NFKC in time near linear in the text, however its marks are arranged."""
    if text.isascii():
        return text
    if not _long_run().search(text):
        return unicodedata.normalize("NFKC", text)
    flat = "".join(unicodedata.normalize("NFKD", c) for c in text)
    ordered = []
    for is_mark, run in groupby(flat, key=lambda c: unicodedata.combining(c) > 0):
        ordered += sorted(run, key=unicodedata.combining) if is_mark else run
    return unicodedata.normalize("NFC", "".join(ordered))


def canonical_text(text: str) -> str:
    return nfkc(nfkc(text).translate(TABLE))


def _canonical(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else canonical_text(t) for t in texts.to_pylist()], pa.string())


def canonicalize(text: Column) -> Column:
    return F.coalesce(F.arrow_udf(_canonical, StringType())(F.when(non_ascii(text), text)), text)
