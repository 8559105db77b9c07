"""Views of a text that are safe to show: escaped previews, UTF-16 offsets, snippets around findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREVIEW, SNIPPETS, AROUND = 160, 32, 3


def escaped(text: Column, limit: int = PREVIEW) -> Column:
    """ASCII only: printable ASCII but the backslash HTML-escaped, all else as \\u{XXXX}; cut at limit code points."""
    safe = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}

    def one(c):
        cp = F.ascii(c)
        out = F.when((c == "") | c.isNull(), F.lit(""))
        for k, v in safe.items():
            out = out.when(c == k, F.lit(v))
        return out.when(cp.between(0x20, 0x7E) & (cp != 0x5C), c).otherwise(F.format_string("\\u{%04X}", cp))

    body = F.array_join(F.transform(F.split(F.substring(text, 1, limit), ""), one), "")
    return F.concat(body, F.when(F.length(text) > limit, F.lit(" ... [preview truncated]")).otherwise(F.lit("")))


def utf16_offset(text: Column, offset: Column) -> Column:
    """The UTF-16 offset of a code-point offset: astral code points before it take two units."""
    before = F.substring(text, F.lit(1), offset)
    return offset + F.regexp_count(before, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def snippet_offsets(text: Column, findings: Column) -> Column:
    """Offsets to show, in order: three on either side of the first findings, or the first ones of a text without any."""
    near = lambda f: F.sequence(F.greatest(F.lit(0), f["offset"] - AROUND), F.least(F.length(text) - 1, f["offset"] + AROUND))
    around = F.array_sort(F.array_distinct(F.flatten(F.transform(F.slice(findings, 1, SNIPPETS), near))))
    start = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.least(F.length(text), F.lit(PREVIEW)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(findings) > 0, around).otherwise(start)


def snippets(docs: DataFrame, key: str, text: str = "text", findings: str = "findings") -> DataFrame:
    """key, offset, ch, utf16, omitted: the cells of each document's snippet and the code points left out before each."""
    t = F.col(text)
    cells = docs.select(F.col(key), t.alias("_t"), F.explode_outer(snippet_offsets(t, F.col(findings))).alias("offset")).where("offset IS NOT NULL")
    last = F.coalesce(F.lag("offset").over(Window.partitionBy(key).orderBy("offset")), F.lit(-1))
    return cells.select(key, "offset", F.substring("_t", F.col("offset") + 1, F.lit(1)).alias("ch"), utf16_offset(F.col("_t"), F.col("offset")).alias("utf16"), (F.col("offset") - last - 1).alias("omitted"))
