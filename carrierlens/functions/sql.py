"""The operators as SQL functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from carrierlens import codepoints as C


def _category(cp: int, shape: int) -> str | None:
    for table, name in ((C.ZERO_WIDTH, "ZERO_WIDTH"), (C.BIDI, "BIDI_OVERRIDE"), (C.INVISIBLE, "INVISIBLE_FORMAT"), (C.SPACES, "SUSPICIOUS_WHITESPACE")):
        if cp in table:
            return name
    if C.TAGS[0] <= cp <= C.TAGS[1]:
        return "TAG_CHARACTER"
    return "MIXED_SCRIPT" if shape and _foreign(cp) and (shape == 2 or cp in C.CONFUSABLE) else None


def _foreign(cp: int) -> bool:
    return any(a <= cp <= b for s in C.FOREIGN for a, b in C.SCRIPTS[s]) and chr(cp).isalpha()


def _shape(text: str) -> int:
    letters = [ord(c) for c in text if c.isalpha()]
    foreign = [p for p in letters if _foreign(p)]
    lookalikes = sum(p in C.CONFUSABLE for p in foreign)
    if not foreign or 10 * lookalikes < 9 * len(foreign):
        return 0
    most = max(sum(any(a <= p <= b for a, b in C.SCRIPTS[s]) for p in foreign) for s in C.FOREIGN)
    if len(foreign) >= 8 and 10 * most >= 7 * len(letters):
        return 2
    return int(any(p <= 0x24F for p in letters))


def rows_of(text: str | None) -> Iterator[tuple[int, str, str]]:
    """offset, category and label of every carrier of a text."""
    if text and not text.isascii():
        shape = _shape(text)
        for k, c in enumerate(text):
            if category := _category(ord(c), shape):
                yield k, category, f"U+{ord(c):04X}"


class CarrierFindings:
    def eval(self, text: str):
        yield from rows_of(text)


def register(spark: SparkSession) -> None:
    """carrier_findings(text): a table function; canonicalize(text) and inspect_action(text) as functions of a text."""
    from carrierlens.functions.canonical import _canonical

    spark.udtf.register("carrier_findings", F.udtf(CarrierFindings, returnType="offset int, category string, codepoints string"))
    spark.udf.register("canonicalize", F.arrow_udf(_canonical, StringType()))
    spark.udf.register("inspect_action", F.arrow_udf(_actions, StringType()))


def _actions(texts: pa.Array) -> pa.Array:
    def one(text):
        if text is None:
            return None
        found = list(rows_of(text))
        kinds = {c for _, c, _ in found}
        if any(label in ("U+202D", "U+202E") for _, _, label in found):
            return "block"
        clustered = sum(c == "ZERO_WIDTH" for _, c, _ in found) >= C.CLUSTER
        return "review" if kinds & {"BIDI_OVERRIDE", "TAG_CHARACTER", "MIXED_SCRIPT"} or clustered else "allow"

    return pa.array([one(t) for t in texts.to_pylist()], pa.string())
