"""Where reports go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierlens.functions.policy import explanation
from carrierlens.operators.inspect import REPORT, report_json


def verdict_json(pretty: bool = True) -> Column:
    """A verdict report as JSON, non-ASCII kept."""
    return F.to_json(F.struct("verdict", "findings", "sanitized", "stats"), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"})


def explained(record: Column | None = None) -> Column:
    """A report in one ASCII line."""
    label = F.lit("") if record is None else F.concat(F.lit("record "), record.cast("string"), F.lit(": "))
    candidate = F.when(F.col("candidate_text").isNotNull(), F.lit("candidate available")).otherwise(F.lit("no forwarding candidate"))
    return F.concat(label, F.col("status"), F.lit(" / "), F.coalesce("action", F.lit("held")), F.lit(": "), explanation(F.col("reason_codes")), F.lit(" ("), F.col("finding_count_total").cast("string"), F.lit(" findings; "), candidate, F.lit(")"))


def write_reports(reports: DataFrame, path: str, order: str | None = None) -> None:
    """Reports as JSON lines, in the order of a column if one is named. Refuses a path that exists."""
    out = reports.select(report_json(REPORT).alias("value"), *([order] if order else []))
    (out.orderBy(order) if order else out).select("value").write.mode("errorifexists").text(path)


def write_sanitized(reports: DataFrame, path: str) -> None:
    reports.select(F.col("sanitized").alias("value")).write.mode("errorifexists").text(path)


#: An event of a replay: never a text.
EVENT = ["record_index", "source_id", "status", "action", "reason_codes", "finding_count_total", "category_counts", "elapsed_ms", "input_bytes"]


def write_events(events: DataFrame, path: str) -> None:
    events.select(*EVENT).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Evidence pages, one a row. Refuses a path that exists."""
    pages.select("html").write.mode("errorifexists").option("lineSep", "\x00").text(path)
