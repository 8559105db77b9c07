"""Batches: JSON-lines records, replays, and gates over whole groups of documents.

Record order is a column (ord), numbered within a batch. What a batch does at a limit follows from running sums over
that order, one window a batch; a batch is bounded by its own limits, so no window is larger than they allow.
"""

from __future__ import annotations

import json
import re
import time

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carrierlens.operators.inspect import REPORT, exit_code, inspect, json_length, report_json
from carrierlens.settings import Limits, Policy

NESTING = 200
BATCH_BYTES, BATCH_RECORDS = 64 << 20, 1000
REPLAY_BYTES, REPLAY_LINE, REPLAY_RECORDS = 512 << 20, 16 << 20, 10_000
OPAQUE_ID = r"\A[A-Za-z0-9_-]{1,64}\z"


def nested_too_deep(value, most: int = NESTING) -> bool:
    """Whether lists and objects nest deeper than most; one level of the value at a time, never by recursion."""
    level, depth = [value], 0
    while level := [v for v in level if isinstance(v, (list, dict))]:
        depth += 1
        if depth > most:
            return True
        level = [x for v in level for x in (v if isinstance(v, list) else v.values())]
    return False


def decoded(line: bytes) -> tuple[object, str | None]:
    """The JSON value of a line, or the reason why there is none."""
    try:
        value = json.loads(line.decode("utf-8", "strict"))
    except (UnicodeDecodeError, ValueError, RecursionError):
        return None, "INVALID_JSON"
    return (None, "INVALID_JSON") if nested_too_deep(value) else (value, None)


def _surrogates(text: str) -> bool:
    return any(0xD800 <= ord(c) <= 0xDFFF for c in text)


def _strings(max_bytes: int):
    """Lines that hold one JSON string each: text or held."""

    def one(line: bytes) -> tuple[str | None, str | None]:
        if len(line) > max_bytes:
            return None, "INPUT_BYTE_LIMIT"
        value, problem = decoded(line)
        if problem:
            return None, problem
        if not isinstance(value, str):
            return None, "INVALID_TYPE"
        return (None, "INVALID_UNICODE") if _surrogates(value) else (value, None)

    def run(batches):
        for batch in batches:
            got = [one(x) for x in batch["line"].to_pylist()]
            cols = {n: batch[n] for n in batch.schema.names if n != "line"}
            cols |= {"text": pa.array([g[0] for g in got], pa.string()), "held": pa.array([g[1] for g in got], pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def inspect_jsonl(lines: DataFrame, policy: Policy = Policy.BALANCED, limits: Limits | None = None, max_records: int = BATCH_RECORDS, input_bytes: int = BATCH_BYTES, output_bytes: int = BATCH_BYTES) -> tuple[DataFrame, DataFrame]:
    """Reports (batch_id, ord, report columns, exit_code) that each batch emits, and batches (batch_id, stopped, exit_code).

    lines: batch_id, ord, line, size. A batch stops before the record that breaks its byte limits, after a line that
    is too long, and at its record limit; stopped says why. Batches without records: give their ids nowhere, see empty().
    """
    limits = Limits() if limits is None else limits
    by = Window.partitionBy("batch_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    # records past the limit only tell that there are more; a line is read up to two bytes past its limit
    kept = lines.where(F.col("ord") <= max_records + 1).withColumn("_in", F.sum(F.least("size", F.lit(limits.max_input_bytes + 2))).over(by))
    schema = StructType.fromDDL("batch_id string, ord long, size long, _in long, text string, held string")
    texts = kept.select("batch_id", "ord", "size", "_in", "line").mapInArrow(_strings(limits.max_input_bytes), schema)
    reports = inspect(texts, "text", policy, limits, held=F.col("held"))
    reports = reports.withColumn("_payload", json_length(report_json(REPORT), F.col("candidate_text")) + 1).withColumn("_out", F.sum("_payload").over(by)).withColumn("exit_code", exit_code())
    # what ends the batch at a record: before it is emitted, or with it
    before = F.when(F.col("ord") > max_records, F.lit("RECORD_LIMIT")).when(F.col("_in") > input_bytes, F.lit("INPUT_BYTES")).when(F.col("_out") > output_bytes, F.lit("OUTPUT_BYTES"))
    reports = reports.withColumn("_before", before).withColumn("_with", F.when(F.col("held") == "INPUT_BYTE_LIMIT", F.lit("LINE_BYTES")))
    whole = Window.partitionBy("batch_id")
    stop = F.min(F.when(F.col("_before").isNotNull(), F.struct("ord", F.col("_before").alias("why"))).when(F.col("_with").isNotNull(), F.struct((F.col("ord") + 1).alias("ord"), F.col("_with").alias("why")))).over(whole)
    reports = reports.withColumn("_stop", stop)
    emitted = F.col("_stop").isNull() | (F.col("ord") < F.col("_stop.ord"))
    batches = reports.groupBy("batch_id").agg(F.first("_stop.why").alias("stopped"), F.max(F.when(emitted, F.col("exit_code"))).alias("_most"))
    batches = batches.select("batch_id", "stopped", F.when(F.col("stopped").isNotNull(), F.lit(4)).otherwise(F.col("_most")).alias("exit_code"))
    return reports.where(emitted).select("batch_id", "ord", *REPORT, "exit_code"), batches


def empty(batches: DataFrame, ids: DataFrame) -> DataFrame:
    """batches with those of ids(batch_id) that have no record: stopped EMPTY, exit code 4."""
    none = ids.select("batch_id").join(batches, "batch_id", "left_anti")
    return batches.unionByName(none.select("batch_id", F.lit("EMPTY").alias("stopped"), F.lit(4).alias("exit_code")))


def rag_gate(documents: DataFrame, questions: DataFrame, policy: Policy = Policy.BALANCED, max_documents: int = 16, max_prompt_chars: int = 1_048_576) -> DataFrame:
    """batch_id, status (sent or held), reason, prompt: a group of documents goes to a model as a whole or not at all.

    documents: batch_id, ord, source_id, text; questions: batch_id, question. Ids never enter the prompt. Checks in
    order: BATCH_LIMIT, DOCUMENT_HELD, PROMPT_CHAR_LIMIT. Groups are bounded before texts are gathered.
    """
    if max_documents < 1 or max_prompt_chars < 1:
        raise ValueError("trusted batch limits must be positive")
    sizes = documents.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_docs"))
    groups = questions.join(sizes, "batch_id", "left").withColumn("_docs", F.coalesce("_docs", F.lit(0)))
    groups = groups.withColumn("_over", (F.col("_docs") > max_documents) | (F.length("question") > max_prompt_chars))
    inside = documents.join(groups.where(~F.col("_over")).select("batch_id"), "batch_id", "left_semi")
    reports = inspect(inside, "text", policy).select("batch_id", "ord", "source_id", "action", "candidate_text")
    verdicts = reports.groupBy("batch_id").agg(F.bool_and(F.coalesce(F.col("action") == "allow", F.lit(False))).alias("_all"), F.sum(F.length("candidate_text")).alias("_chars"), F.sort_array(F.collect_list(F.struct("ord", F.col("candidate_text").alias("text")))).alias("_texts"))
    out = groups.join(verdicts, "batch_id", "left")
    # The parts of a prompt.
    intro = F.lit("\n\nRetrieved documents:\n")
    heads = F.transform("_texts", lambda d, i: F.concat(F.lit("\nDocument "), (i + 1).cast("string"), F.lit(":\n"), d["text"]))
    size = F.length("question") + F.length(intro) + F.coalesce(F.aggregate(heads, F.lit(0), lambda a, h: a + F.length(h)), F.lit(0))
    reason = F.when(F.col("_over"), F.lit("BATCH_LIMIT")).when(~F.coalesce("_all", F.lit(True)), F.lit("DOCUMENT_HELD")).when(size > max_prompt_chars, F.lit("PROMPT_CHAR_LIMIT"))
    prompt = F.concat("question", intro, F.coalesce(F.array_join(heads, ""), F.lit("")))
    out = out.withColumn("reason", reason)
    return out.select("batch_id", F.when(F.col("reason").isNull(), F.lit("sent")).otherwise(F.lit("held")).alias("status"), "reason", F.when(F.col("reason").isNull(), prompt).alias("prompt"))


def tool_result_gate(results: DataFrame, text: str = "text", policy: Policy = Policy.BALANCED) -> DataFrame:
    """results with status (sent or held) and, where sent, the text as candidate_text; and the report columns."""
    out = inspect(results, text, policy)
    return out.withColumn("status_of_gate", F.when(F.col("candidate_text").isNotNull(), F.lit("sent")).otherwise(F.lit("held")))


def _records(batches):
    """Replay lines to source_id, text or the problem; `registers`: whether the id counts as seen from here on."""
    kinds = {"source_id": pa.string(), "text": pa.string(), "problem": pa.string(), "input_bytes": pa.int64(), "elapsed_ms": pa.float64()}
    for batch in batches:
        out = {k: [] for k in kinds}
        for line in batch["line"].to_pylist():
            began = time.perf_counter_ns()
            source = text = problem = None
            try:
                value = json.loads(line.decode("utf-8", "strict"))
            except (UnicodeDecodeError, ValueError, RecursionError):
                problem = "INVALID_JSON"
            else:
                if not isinstance(value, dict) or set(value) != {"source_id", "text"}:
                    problem = "INVALID_RECORD"
                elif not isinstance(value["source_id"], str) or _surrogates(value["source_id"]):
                    problem = "INVALID_SOURCE_ID"
                else:
                    source, text = value["source_id"], value["text"]
                    if not isinstance(text, str):
                        text, problem = None, "INVALID_TEXT"
                    elif _surrogates(text):
                        text, problem = None, "INVALID_UNICODE"
            for k, v in (("source_id", source), ("text", text), ("problem", problem), ("input_bytes", None if text is None else len(text.encode())), ("elapsed_ms", (time.perf_counter_ns() - began) / 1e6)):
                out[k].append(v)
        cols = {n: batch[n] for n in batch.schema.names if n != "line"} | {k: pa.array(out[k], t) for k, t in kinds.items()}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def replay(lines: DataFrame, policy: Policy = Policy.BALANCED, max_records: int = REPLAY_RECORDS, max_total_bytes: int = REPLAY_BYTES, max_line_bytes: int = REPLAY_LINE, pipeline_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Events (batch_id, record_index, ... never a text) and one summary row a batch, of lines(batch_id, ord, line, size).

    pipeline_id: an opaque id of the caller that the summary names; none: null.
    """
    if pipeline_id is not None and not re.search(OPAQUE_ID.replace(r"\z", r"\Z"), pipeline_id):
        raise ValueError("pipeline_id must be an opaque ASCII id")
    if min(max_records, max_total_bytes, max_line_bytes) < 1:
        raise ValueError("trusted limits must be positive")
    by = Window.partitionBy("batch_id").orderBy("ord")
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(F.col("ord") <= max_records + 1).withColumn("_in", F.sum("size").over(running))
    stop = F.when(F.col("ord") > max_records, F.lit("BATCH_RECORD_LIMIT")).when(F.col("_in") > max_total_bytes, F.lit("BATCH_INPUT_LIMIT")).when(F.octet_length("line") > max_line_bytes, F.lit("RECORD_BYTE_LIMIT"))
    rows = rows.withColumn("_why", stop)
    first = F.min(F.when(F.col("_why").isNotNull(), F.struct("ord", F.col("_why").alias("why")))).over(Window.partitionBy("batch_id"))
    rows = rows.withColumn("_stop", first)
    # bytes are counted up to the record that stops a batch, with it unless it is past the record limit
    read = F.max(F.when(F.col("_stop").isNull() | (F.col("ord") <= F.when(F.col("_stop.why") == "BATCH_RECORD_LIMIT", F.col("_stop.ord") - 1).otherwise(F.col("_stop.ord"))), F.col("_in")))
    totals = rows.groupBy("batch_id").agg(F.first("_stop.why").alias("_why"), read.alias("input_bytes_read"))
    rows = rows.where(F.col("_stop").isNull() | (F.col("ord") < F.col("_stop.ord")))
    schema = StructType.fromDDL("batch_id string, ord long, source_id string, text string, problem string, input_bytes long, elapsed_ms double")
    parsed = rows.select("batch_id", "ord", "line").mapInArrow(_records, schema)
    parsed = parsed.withColumn("problem", F.when(F.col("source_id").isNotNull() & ~F.col("source_id").rlike(OPAQUE_ID), F.lit("INVALID_SOURCE_ID")).otherwise(F.col("problem")))
    # an id counts as seen once a record that has it held a text; later records with it are duplicates, whatever else they are
    known = F.coalesce(F.col("problem") == "INVALID_UNICODE", F.col("problem").isNull())
    seen = F.min(F.when(known, F.col("ord"))).over(Window.partitionBy("batch_id", "source_id"))
    twice = F.col("source_id").isNotNull() & (F.coalesce(F.col("problem"), F.lit("")) != "INVALID_SOURCE_ID") & (seen < F.col("ord"))
    parsed = parsed.withColumn("problem", F.when(twice, F.lit("DUPLICATE_SOURCE_ID")).otherwise(F.col("problem")))
    reports = inspect(parsed, "text", policy, held=F.col("problem"))
    measured = F.col("problem").isNull()
    named = measured | (F.col("problem") == "INVALID_UNICODE")
    events = reports.select("batch_id", F.col("ord").cast("int").alias("record_index"), F.when(named, F.col("source_id")).alias("source_id"), F.when(measured, F.col("status")).otherwise(F.lit("invalid_input")).alias("status"), "action", "reason_codes", "finding_count_total", "category_counts", F.when(measured, F.round("elapsed_ms", 6)).alias("elapsed_ms"), F.when(measured, F.col("input_bytes")).alias("input_bytes"))
    each = events.groupBy("batch_id", F.coalesce("action", "status").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("batch_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("action_or_status_counts"))
    some = events.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("processed_records"),
        F.bool_or(F.col("action").isNull()).alias("_held"),
        F.count("elapsed_ms").alias("sample_count"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY elapsed_ms)").alias("median_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY elapsed_ms)").alias("p95_ms"),
    )
    summary = totals.join(some, "batch_id", "left").join(each, "batch_id", "left")
    reason = F.coalesce(F.col("_why"), F.when(F.col("_held"), F.lit("INCOMPLETE_INSPECTION")), F.when(F.coalesce("processed_records", F.lit(0)) == 0, F.lit("EMPTY_REPLAY")))
    summary = summary.withColumn("incomplete_reason", reason)
    # Version and kind of a summary, and what it never claims.
    facts = [F.lit(1).alias("schema_version"), F.lit("local_shadow_replay").alias("kind"), F.lit(pipeline_id).cast("string").alias("pipeline_id")]
    claims = [F.lit(0).alias("labels_reviewed"), F.lit(0).alias("independent_users"), F.lit(False).alias("production_pipeline_verified"), F.lit(False).alias("release_claim_supported")]
    summary = summary.select("batch_id", *facts, F.lit(policy.value).alias("policy_id"), F.when(F.col("incomplete_reason").isNull(), F.lit("replay_complete")).otherwise(F.lit("incomplete")).alias("status"), "incomplete_reason", F.coalesce("processed_records", F.lit(0)).alias("processed_records"), "input_bytes_read", "action_or_status_counts", F.coalesce("sample_count", F.lit(0)).alias("sample_count"), "median_ms", "p95_ms", *claims)
    return events, summary
