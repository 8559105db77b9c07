import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from carrierlens import Limits, Policy, analyze, inspect, inspect_binary
from carrierlens.functions.canonical import canonical_text, nfkc
from carrierlens.functions.context import WHOLE, generated, read_sequences, recognise
from carrierlens.operators.inspect import REPORT, exit_code, report_json


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, text string")


def test_limits_are_checked():
    for bad in ({"max_findings": 5}, {"max_chars": -1}, {"max_output_bytes": 511}, {"max_input_bytes": 0}):
        with pytest.raises(ValueError):
            Limits(**bad)
    with pytest.raises(TypeError):
        Limits(max_chars=True)


def test_policy_and_limits_are_the_callers(spark):
    with pytest.raises(TypeError):
        inspect(texts(spark, ["a"]), policy="balanced-v1")
    with pytest.raises(TypeError):
        inspect(texts(spark, ["a"]), limits={})


def test_admission(spark):
    rows = inspect(texts(spark, [None, "abcd", "abc"]), limits=Limits(max_chars=3)).orderBy("i").collect()
    assert [(r.status, r.reason_codes, r.action, r.scan_complete) for r in rows] == [("invalid_input", ["INVALID_TYPE"], None, False), ("limit_exceeded", ["INPUT_CHAR_LIMIT"], None, False), ("complete", ["NO_FINDINGS"], "allow", True)]
    got = analyze(texts(spark, [None, "abcd"]), limits=Limits(max_chars=3)).orderBy("i").collect()
    assert [(r.verdict, r.error) for r in got] == [(None, "INVALID_TYPE"), (None, "INPUT_CHAR_LIMIT")]


def test_bytes(spark):
    df = spark.createDataFrame([(0, bytearray(b"ok")), (1, bytearray(b"\xff")), (2, bytearray(b"\xed\xa0\x80")), (3, bytearray(b"abcde")), (4, None), (5, bytearray(b"\xef\xbb\xbfx"))], "i int, content binary")
    rows = inspect_binary(df, limits=Limits(max_input_bytes=4)).orderBy("i").collect()
    assert [(r.status, r.reason_codes[0]) for r in rows] == [("complete", "NO_FINDINGS"), ("invalid_input", "INVALID_UTF8"), ("invalid_input", "INVALID_UTF8"), ("limit_exceeded", "INPUT_BYTE_LIMIT"), ("invalid_input", "INVALID_TYPE"), ("complete", "INFORMATIONAL_CARRIER")]


def test_report_invariants(spark):
    values = ["", "plain", "a​b", "‮", "⁧א⁩", None, "x" * 50, "pаy\x7f"]
    for policy in Policy:
        for r in inspect(texts(spark, values), policy=policy, limits=Limits(max_chars=40)).withColumn("code", exit_code()).collect():
            assert (r.action is None) == (r.status != "complete") and (r.candidate_text is not None) == (r.action == "allow")
            assert r.finding_count_total == sum(r.category_counts.values()) and r.schema_version == (4 if policy is Policy.CONTEXTUAL else 3)
            assert r.code == {"allow": 0}.get(r.action, 3 if r.status == "complete" else 4) and r.transformation == "preserve"
            assert all(f.rule_id == f"unicode.{f.category.lower()}.v1" and f.length == 1 for f in r.findings)


def test_json(spark):
    row = inspect(texts(spark, ["a​é\U0001f600\"\\"])).select(report_json().alias("j"), *REPORT).first()
    parsed = json.loads(row.j)
    assert row.j.isascii() and list(parsed) == REPORT and parsed["candidate_text"] == "a​é\U0001f600\"\\" and parsed["findings"][0]["offset"] == 1


def test_output_limit_is_exact(spark):
    df = texts(spark, ["a" * 500])
    size = len(inspect(df).select(report_json().alias("j")).first().j)
    assert inspect(df, limits=Limits(max_output_bytes=size)).first().action == "allow"
    r = inspect(df, limits=Limits(max_output_bytes=size - 1)).first()
    assert (r.status, r.reason_codes, r.scan_complete, r.candidate_text) == ("limit_exceeded", ["OUTPUT_BYTE_LIMIT"], True, None)
    r = inspect(texts(spark, ["\x7f" * 500]), limits=Limits(max_output_bytes=2000)).first()
    assert r.status == "limit_exceeded"  # DEL is escaped elsewhere


def test_nfkc_is_the_standard_one():
    for p in range(0x110000):
        if not 0xD800 <= p <= 0xDFFF:
            c = chr(p)
            assert nfkc(c) == unicodedata.normalize("NFKC", c)
    hostile = "a" + "̣́̂" * 200 + "ﬁ" + "̣́" * 60
    assert nfkc(hostile) == unicodedata.normalize("NFKC", hostile)
    assert canonical_text(canonical_text("а́")) == canonical_text("а́") == "á"


def test_hostile_marks_take_little_time():
    import time

    began = time.perf_counter()
    nfkc("a" + "̣́" * 150_000)
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("می‌رو", (1, 0, 0, 0)),
        ("a‌b", (0, 0, 0, 0)),
        ("क्‍ष", (1, 0, 0, 0)),
        ("क‍ष", (0, 0, 0, 1)),
        ("\U0001f468‍\U0001f469‍\U0001f467‍\U0001f466", (3, 0, 0, 0)),
        ("\U0001f468‍\U0001f469‍\U0001f467‍\U0001f466‍", (0, 0, 0, 4)),
        ("\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", (0, 6, 0, 0)),
        ("\U0001f3f4\U000e0067\U000e0062\U000e007f", (0, 0, 0, 0)),
        ("\U0001f9d1\U0001f3fb‍❤️‍\U0001f9d1\U0001f3fc", (2, 0, 0, 0)),
        ("\U0001f6b6\U0001f3fd‍♀️‍➡️", (2, 0, 0, 0)),
        ("\U0001f9d1‍\U0001f9d1‍\U0001f9d2", (2, 0, 0, 0)),
        ("⁧של⁩", (0, 0, 2, 0)),
        ("⁦של⁩", (0, 0, 0, 0)),
        ("⁧ש a⁩", (0, 0, 0, 0)),
        ("⁧ .⁩", (0, 0, 0, 0)),
        ("⁧⁧ש⁩⁩", (0, 0, 0, 0)),
        ("⁩⁧ש⁩", (0, 0, 2, 0)),
        ("⁧" * 20_000 + "⁩" * 20_000, (0, 0, 0, 0)),
    ],
)
def test_contexts(text, want):
    assert len(generated()) == WHOLE
    assert recognise(text, generated()) == want


def test_contextual_decisions(spark):
    rows = inspect(texts(spark, ["a‍", "⁧" * 300 + "⁩" * 300, "‮⁧ש⁩", "م‌م" * 6]), policy=Policy.CONTEXTUAL).orderBy("i").collect()
    assert [(r.action, r.reason_codes) for r in rows] == [("review", ["UNRECOGNIZED_JOINER"]), ("review", ["BIDI_CONTROL"]), ("block", ["BIDI_EXPLICIT_OVERRIDE"]), ("allow", ["RECOGNIZED_CONTEXT"])]


def test_sequence_file_must_be_whole(tmp_path):
    p = tmp_path / "s.txt"
    p.write_text("# one\n1F468 200D 1F469\n")
    with pytest.raises(ValueError):
        read_sequences(str(p))


def test_extra_columns_stay(spark):
    df = texts(spark, ["a"]).withColumn("status", F.lit("mine")).withColumn("other", F.lit(1))
    r = inspect(df).first()
    assert (r.status, r.other) == ("complete", 1)
