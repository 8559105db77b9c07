"""Command line over a local session: verdict reports, policy reports, JSON-lines batches, pages and replays."""

from __future__ import annotations

import argparse
import json
import re
import sys
from collections.abc import Iterator
from contextlib import nullcontext
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierlens.settings import Limits, Policy


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="carrierlens", description=__doc__)
    p.add_argument("text", nargs="?", help="a literal text, or - for standard input, which is also read where it is piped and nothing else is named")
    p.add_argument("-f", "--file", help="a file instead of a text")
    p.add_argument("--stdin", action="store_true", help="standard input instead of a text")
    p.add_argument("--inspect", action="store_true", help="a policy report")
    p.add_argument("--contextual", action="store_true", help="with the contextual policy")
    p.add_argument("--jsonl", action="store_true", help="the file is a batch of JSON strings, one a line")
    p.add_argument("--max-records", type=int, default=1000)
    p.add_argument("--explain", action="store_true", help="a line in words on standard error")
    p.add_argument("--sanitize", action="store_true", help="the canonical text only")
    p.add_argument("--page", help="write an evidence page to this new file")
    p.add_argument("--replay", metavar="PIPELINE_ID", help="the file is a replay of {source_id, text} records")
    p.add_argument("--events", help="write the events of a replay to this new file")
    return p


def arguments(argv: list[str], piped: bool = False) -> argparse.Namespace:
    p = parser()
    a = p.parse_args(argv)
    needs = a.contextual or a.jsonl or a.explain or a.max_records != 1000
    if needs and not (a.inspect or a.replay):
        p.error("--contextual, --jsonl, --explain and --max-records need --inspect")
    if a.sanitize and (a.inspect or a.page or a.replay):
        p.error("--sanitize gives no report")
    if a.max_records < 1:
        p.error("--max-records must be positive")
    if a.events and not a.replay:
        p.error("--events needs --replay")
    if a.replay and not re.fullmatch("[A-Za-z0-9_-]{1,64}", a.replay):
        p.error("a pipeline id is 1 to 64 ASCII letters, digits, _ and -")
    if a.text == "-":
        a.text, a.stdin = None, True
    if a.text is None and not a.file and not a.stdin:
        a.stdin = piped
    if (a.jsonl or a.replay) and not (a.file or a.stdin):
        p.error("a batch needs --file or standard input")
    if sum((a.text is not None, bool(a.file), a.stdin)) != 1:
        p.error("one of a text, --file and standard input is needed")
    if a.text == "" and not a.inspect:
        p.error("the text is empty")
    return a


def _input(spark: SparkSession, a: argparse.Namespace, limits: Limits) -> DataFrame:
    if a.text is not None:
        return spark.createDataFrame([(bytearray(a.text.encode("utf-8", "surrogatepass")),)], "content binary").withColumn("length", F.octet_length("content").cast("long"))
    try:
        if a.file:
            with open(a.file, "rb") as f:
                data = f.read(limits.max_input_bytes + 1)
        else:
            data = sys.stdin.buffer.read(limits.max_input_bytes + 1)
    except OSError:
        return spark.createDataFrame([(None, -1)], "content binary, length long")
    return spark.createDataFrame([(bytearray(data), len(data))], "content binary, length long")


def _lines(source: BinaryIO, line_bytes: int, batch_bytes: int, records: int) -> Iterator[tuple[str, int, bytearray, int]]:
    """Rows of a batch. Reads no more than its limits: of a line two bytes past the limit, of records one past theirs."""
    read = 0
    for k in range(1, records + 2):
        raw = source.readline(line_bytes + 2)
        if not raw:
            return
        line = raw.removesuffix(b"\n")
        yield "batch", k, bytearray(line), len(raw)
        read += len(raw)
        if read > batch_bytes or len(line) > line_bytes:
            return


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv, not sys.stdin.isatty())
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    from carrierlens.operators import batch, inspect, viewer
    from carrierlens.ship import ship
    from carrierlens.sources import sinks

    ship(spark)
    limits, policy = Limits(), Policy.CONTEXTUAL if a.contextual else Policy.BALANCED
    if a.jsonl or a.replay:
        bounds = (batch.REPLAY_LINE, batch.REPLAY_BYTES, batch.REPLAY_RECORDS) if a.replay else (limits.max_input_bytes, batch.BATCH_BYTES, a.max_records)
        try:
            with nullcontext(sys.stdin.buffer) if a.stdin else open(a.file, "rb") as f:
                rows = list(_lines(f, *bounds))
        except OSError:
            if a.replay:
                print("the replay could not be read", file=sys.stderr)
                return 4
            failed = spark.createDataFrame([(None, -1)], "content binary, length long")
            r = inspect.inspect_binary(failed, "content", policy, limits, "length").select(inspect.report_json().alias("j"), sinks.explained().alias("x")).first()
            print(r["j"])
            if a.explain:
                print(r["x"], file=sys.stderr)
            return 4
        lines = spark.createDataFrame(rows, "batch_id string, ord long, line binary, size long")
        if a.replay:
            events, summary = batch.replay(lines, policy, pipeline_id=a.replay)
            if a.events:
                with open(a.events, "x", encoding="ascii") as f:
                    for (event,) in events.orderBy("record_index").select(inspect.report_json(sinks.EVENT)).toLocalIterator():
                        f.write(event + "\n")
            found = summary.select(F.to_json(F.struct(*[c for c in summary.columns if c != "batch_id"]), {"ignoreNullFields": "false"})).first()
            nothing = {"schema_version": 1, "kind": "local_shadow_replay", "pipeline_id": a.replay, "policy_id": policy.value, "status": "incomplete", "incomplete_reason": "EMPTY_REPLAY", "processed_records": 0, "input_bytes_read": 0}
            print(found[0] if found else json.dumps(nothing, separators=(",", ":")))
            return 0 if found and '"status":"replay_complete"' in found[0] else 4
        reports, batches = batch.inspect_jsonl(lines, policy, limits, a.max_records)
        for r in reports.orderBy("ord").select(inspect.report_json().alias("j"), sinks.explained(F.col("ord")).alias("x")).collect():
            print(r["j"])
            if a.explain:
                print(r["x"], file=sys.stderr)
        ended = batches.collect()
        return ended[0]["exit_code"] if ended else 4
    rows = _input(spark, a, limits)
    if a.inspect or a.page:
        out = inspect.inspect_binary(rows, "content", policy, limits, "length")
        out = out.withColumn("text", F.when(F.col("status") == "complete", F.col("content").cast("string")))
        pages = viewer.render(out) if a.page else out.withColumn("html", F.lit(None).cast("string"))
        r = pages.select(inspect.report_json().alias("j"), sinks.explained().alias("x"), inspect.exit_code().alias("code"), "html").first()
        if a.page:
            with open(a.page, "x", encoding="utf-8") as f:
                f.write(r["html"])
        if a.inspect:
            print(r["j"])
        if a.explain:
            print(r["x"], file=sys.stderr)
        return r["code"]
    if rows.where("length < 0").count():
        print("the input could not be read", file=sys.stderr)
        return 2
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n") if a.file else F.col("content").cast("string")
    out = inspect.analyze(rows.select(text.alias("text")), limits=limits)
    r = out.select(sinks.verdict_json().alias("j"), "sanitized", "verdict", "error").first()
    if r["error"]:
        print(r["error"], file=sys.stderr)
        return 2
    print(r["sanitized"] if a.sanitize else r["j"])
    return 0 if r["verdict"] == "clean" else 2


if __name__ == "__main__":
    sys.exit(main())
