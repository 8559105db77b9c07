import json

import pytest
from pyspark.sql import functions as F

from carrierlens import Policy
from carrierlens.functions.policy import explanation
from carrierlens.operators import batch
from carrierlens.sources import documents, sinks


def lines(spark, raws, batch_id="b"):
    rows = [(batch_id, k, bytearray(x), len(x) + 1) for k, x in enumerate(raws, 1)]
    return spark.createDataFrame(rows, "batch_id string, ord long, line binary, size long")


def run(spark, raws, **more):
    reports, batches = batch.inspect_jsonl(lines(spark, raws), **more)
    return [(r.ord, r.status, r.reason_codes[0]) for r in reports.orderBy("ord").collect()], [(r.stopped, r.exit_code) for r in batches.collect()]


def test_jsonl_records(spark):
    deep = b"[" * 1200 + b"]" * 1200
    got, ended = run(spark, [b'"ok"', b"{bad}", b"17", b"", b'"\\ud800"', deep, b'"a\\u202e"', b'"x" y', b"null"])
    assert [g[2] for g in got] == ["NO_FINDINGS", "INVALID_JSON", "INVALID_TYPE", "INVALID_JSON", "INVALID_UNICODE", "INVALID_JSON", "BIDI_EXPLICIT_OVERRIDE", "INVALID_JSON", "INVALID_TYPE"]
    assert ended == [(None, 4)]
    assert run(spark, [b'"ok"', b'"a\\u202e"'])[1] == [(None, 3)] and run(spark, [b'"ok"\r'])[1] == [(None, 0)]


def test_jsonl_limits(spark):
    got, ended = run(spark, [b'"a"', b'"b"', b'"c"'], max_records=2)
    assert len(got) == 2 and ended == [("RECORD_LIMIT", 4)]
    got, ended = run(spark, [b'"a"', b'"b"', b'"c"'], input_bytes=8)
    assert len(got) == 2 and ended == [("INPUT_BYTES", 4)]
    from carrierlens import Limits

    got, ended = run(spark, [b'"a"', b'"' + b"b" * 20 + b'"', b'"c"'], limits=Limits(max_input_bytes=10))
    assert [g[2] for g in got] == ["NO_FINDINGS", "INPUT_BYTE_LIMIT"] and ended == [("LINE_BYTES", 4)]
    got, ended = run(spark, [b'"a"', b'"b"'], output_bytes=400)
    assert len(got) == 1 and ended == [("OUTPUT_BYTES", 4)]


def test_empty_batches(spark):
    _, batches = batch.inspect_jsonl(lines(spark, [b'"a"']))
    ids = spark.createDataFrame([("b",), ("none",)], "batch_id string")
    assert {r.batch_id: (r.stopped, r.exit_code) for r in batch.empty(batches, ids).collect()} == {"b": (None, 0), "none": ("EMPTY", 4)}


def test_nesting():
    value = []
    for _ in range(199):
        value = [value]
    assert not batch.nested_too_deep(value) and batch.nested_too_deep([value]) and not batch.nested_too_deep("x")


def test_jsonl_source_keeps_bom_and_returns(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'"\xef\xbb\xbfa"\r\n"b"')
    rows = documents.jsonl(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, bytes(r.line), r.size) for r in rows] == [(1, b'"\xef\xbb\xbfa"\r', 8), (2, b'"b"', 3)]


def gate(spark, docs, question="q", **more):
    d = spark.createDataFrame([("g", k, f"id{k}", t) for k, t in enumerate(docs)], "batch_id string, ord long, source_id string, text string")
    q = spark.createDataFrame([("g", question)], "batch_id string, question string")
    return batch.rag_gate(d, q, **more).first()


def test_rag_gate(spark):
    r = gate(spark, ["one", "two"])
    assert (r.status, r.prompt) == ("sent", "q\n\nRetrieved documents:\n\nDocument 1:\none\nDocument 2:\ntwo") and "id0" not in r.prompt
    assert gate(spark, ["one", "a‮"])[1:3] == ("held", "DOCUMENT_HELD")
    assert gate(spark, ["one", None]).reason == "DOCUMENT_HELD"
    assert gate(spark, ["one"] * 3, max_documents=2).reason == "BATCH_LIMIT" and gate(spark, ["x"], question="long", max_prompt_chars=3).reason == "BATCH_LIMIT"
    size = len(r.prompt)
    assert gate(spark, ["one", "two"], max_prompt_chars=size).status == "sent" and gate(spark, ["one", "two"], max_prompt_chars=size - 1).reason == "PROMPT_CHAR_LIMIT"
    assert gate(spark, []).status == "sent"
    with pytest.raises(ValueError):
        gate(spark, [], max_documents=0)


def test_tool_gate(spark):
    df = spark.createDataFrame([("fine",), ("a‮",), (None,)], "text string")
    assert [r.status_of_gate for r in batch.tool_result_gate(df).collect()] == ["sent", "held", "held"]


def record(source, text):
    return json.dumps({"source_id": source, "text": text}).encode()


def test_replay(spark):
    raws = [record("a", "fine"), b"{bad}", record("a", "again"), record("b", 5), record("b", "now"), record("c", "x\ud800"), record("c", "y"), b'{"source_id":"d"}', record("bad id", "z"), record("a", 7)]
    events, summary = batch.replay(lines(spark, raws))
    got = [(r.source_id, r.status, r.reason_codes[0]) for r in events.orderBy("record_index").collect()]
    assert got == [
        ("a", "complete", "NO_FINDINGS"), (None, "invalid_input", "INVALID_JSON"), (None, "invalid_input", "DUPLICATE_SOURCE_ID"), (None, "invalid_input", "INVALID_TEXT"), ("b", "complete", "NO_FINDINGS"),
        ("c", "invalid_input", "INVALID_UNICODE"), (None, "invalid_input", "DUPLICATE_SOURCE_ID"), (None, "invalid_input", "INVALID_RECORD"), (None, "invalid_input", "INVALID_SOURCE_ID"), (None, "invalid_input", "DUPLICATE_SOURCE_ID"),
    ]
    s = summary.first()
    assert (s.status, s.incomplete_reason, s.processed_records, s.sample_count, s.action_or_status_counts) == ("incomplete", "INCOMPLETE_INSPECTION", 10, 2, {"allow": 2, "invalid_input": 8})
    assert "text" not in events.columns and "candidate_text" not in events.columns


def test_replay_limits(spark):
    raws = [record(f"s{k}", "fine") for k in range(4)]
    size = len(raws[0]) + 1
    for more, why, n, read in (({}, None, 4, 4 * size), ({"max_records": 3}, "BATCH_RECORD_LIMIT", 3, 3 * size), ({"max_total_bytes": 2 * size}, "BATCH_INPUT_LIMIT", 2, 3 * size), ({"max_line_bytes": 5}, "RECORD_BYTE_LIMIT", 0, size)):
        s = batch.replay(lines(spark, raws), **more)[1].first()
        assert (s.incomplete_reason, s.processed_records, s.input_bytes_read, s.status) == (why, n, read, "replay_complete" if why is None else "incomplete")
    with pytest.raises(ValueError):
        batch.replay(lines(spark, raws), max_records=0)


def test_sinks(spark, tmp_path):
    from carrierlens import inspect

    df = inspect(documents.from_texts(spark, ["a", "b‮"]))
    said = [r.x for r in df.orderBy("ord").select(sinks.explained(F.col("ord")).alias("x")).collect()]
    assert said == ["record 1: complete / allow: No configured Unicode carrier was found. (0 findings; candidate available)", "record 2: complete / block: An explicit direction override can change displayed order. (1 findings; no forwarding candidate)"]
    sinks.write_reports(df, str(tmp_path / "out"), "ord")
    got = [json.loads(r.value)["action"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(got) == ["allow", "block"]
    with pytest.raises(Exception, match="exists"):
        sinks.write_reports(df, str(tmp_path / "out"), "ord")
    odd = spark.range(1).select(explanation(F.array(F.lit("ODD_CODE"))).alias("x")).first().x
    assert odd == "odd code"


def test_contextual_policy_runs_in_batches(spark):
    reports, _ = batch.inspect_jsonl(lines(spark, ['"م‌م"'.encode()]), policy=Policy.CONTEXTUAL)
    assert reports.first().reason_codes == ["RECOGNIZED_CONTEXT"]
