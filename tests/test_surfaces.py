import io
import json
import sys

import pytest
from pyspark.sql import functions as F

from carrierlens import Limits, analyze, cli, inspect
from carrierlens.functions import generators as G
from carrierlens.functions import preview
from carrierlens.functions.sql import register
from carrierlens.operators import evaluate, viewer
from carrierlens.sources import documents
from carrierlens.streaming import inspection


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_generators(spark):
    bits = "".join(f"{ord(c):08b}" for c in "hа")
    assert one(spark, G.zero_width_encode(F.lit("hа"))) == "Please summarize this document." + bits.translate({48: "​", 49: "‌"})
    assert one(spark, G.homoglyph_swap(F.lit("paypal"))) == "раураl"
    assert one(spark, G.greek_homoglyph_swap(F.lit("toxik"))) == "τοχικ"
    assert one(spark, G.invisible_format_embed(F.lit("abcde"))) == "ab­cde"
    assert one(spark, G.suspicious_whitespace_replace(F.lit("a b c"))) == "a b c" and one(spark, G.suspicious_whitespace_replace(F.lit("abc"))) is None
    assert one(spark, G.bidi_wrap(F.lit("x"))) == "Click here for details ‮x‬"
    assert one(spark, G.tag_encode(F.lit("hi"))) == "Invoice #1042 attached.\U000e0068\U000e0069"
    for f in (G.invisible_format_embed, G.suspicious_whitespace_replace):
        with pytest.raises(ValueError):
            f(F.lit("a b"), "x")


def test_attacks_of_a_seeded_corpus_are_found(spark):
    import random

    rng = random.Random(20261001)
    rows = [("".join(rng.choice("aeiopcx") for _ in range(rng.randint(1, 128))),) for _ in range(50)]
    df = spark.createDataFrame(rows, "p string")
    cover = F.lit("Please summarize this report. ")
    attacks = [G.zero_width_encode(F.col("p"), cover), G.bidi_wrap(F.col("p"), cover), G.tag_encode(F.col("p"), cover), F.concat(F.lit("Latin "), G.homoglyph_swap(F.col("p")))]
    for a in attacks:
        assert analyze(df.select(a.alias("text"))).where("verdict != 'malicious'").count() == 0


def test_previews(spark):
    df = spark.createDataFrame([("A\U0001f600‮<\\&\"",)], "text string")
    assert df.select(preview.escaped(F.col("text")).alias("x")).first().x == "A\\u{1F600}\\u{202E}&lt;\\u{005C}&amp;&quot;" == viewer.preview("A\U0001f600‮<\\&\"")
    assert one(spark, preview.escaped(F.lit("x" * 161))).endswith(" ... [preview truncated]")
    assert df.select(preview.utf16_offset(F.col("text"), F.lit(2)).alias("x")).first().x == 3
    docs = analyze(spark.createDataFrame([(1, "a" * 20 + "​" + "b" * 20), (2, "plain"), (3, "")], "i int, text string"))
    cells = [(r.i, r.offset, r.omitted) for r in preview.snippets(docs, "i").orderBy("i", "offset").collect()]
    assert cells == [(1, k, 17 if k == 17 else 0) for k in range(17, 24)] + [(2, k, 0) for k in range(5)]


def test_pages(spark):
    df = inspect(spark.createDataFrame([(0, "A\U0001f600‮<script>"), (1, "fine"), (2, None), (3, "")], "i int, text string"))
    pages = {r.i: r.html for r in viewer.render(df).collect()}
    assert "<script>" not in pages[0] and "‮" not in pages[0] and "cp 2 / UTF-16 3" in pages[0] and "No forwarding candidate" in pages[0]
    assert "forwarding candidate is the input" in pages[1] and "No source is shown" in pages[2] and "Empty document." in pages[3]
    with pytest.raises(ValueError):
        viewer.page("​", {"policy_id": "p", "status": "complete", "action": "allow", "reason_codes": [], "findings": [{"offset": 0, "length": 1, "codepoints": "U+200B", "category": "x", "severity": "y" * 3_000_000, "detail": ""}]})


def test_evaluation(spark):
    rows = spark.createDataFrame([("benign", "allow"), ("benign", "review"), ("attack", "block")], "intent string, action string")
    got = {r.intent: (r.allow, r.review, r.block) for r in evaluate.confusion(rows, "intent", labels=["benign", "attack", "unknown"]).collect()}
    assert got == {"benign": (1, 1, 0), "attack": (0, 0, 1), "unknown": (0, 0, 0)}
    f = spark.createDataFrame([("a", "g1", "dev", "x"), ("b", "g1", "holdout", "x"), ("b", "g3", "dev", "y")], "id string, g string, split string, text string")
    assert [r.id for r in evaluate.duplicates(f, "id").collect()] == ["b"] and [r.g for r in evaluate.crossing(f, "g").collect()] == ["g1"]
    assert [r.g for r in evaluate.orphans(f, spark.createDataFrame([("g1",)], "g string"), "g").collect()] == ["g3"]
    gold = spark.createDataFrame([("a", "allow"), ("c", "block")], "id string, action string")
    seen = spark.createDataFrame([("a", "review"), ("c", "block"), ("d", "allow")], "id string, action string")
    assert sorted(r.id for r in evaluate.differing(seen, gold, "id", "action").collect()) == ["a", "d"]
    assert evaluate.same_rows(gold, gold) and not evaluate.same_rows(gold, seen)
    tested = spark.createDataFrame([("ZERO_WIDTH",), ("ODD",)], "category string")
    assert {(r.category, r.side) for r in evaluate.rule_coverage(tested).collect()} >= {("ODD", "unknown"), ("MIXED_SCRIPT", "untested")}
    counts = {(r.dimension, r.value): r.n for r in evaluate.strata(rows, "intent", "action").collect()}
    assert counts == {("intent", "benign"): 2, ("intent", "attack"): 1, ("action", "allow"): 1, ("action", "review"): 1, ("action", "block"): 1}


def test_protected_files(spark):
    import hashlib

    files = spark.createDataFrame([("p", bytearray(b"a\r\nb")), ("q", bytearray(b"\xff"))], "path string, content binary")
    want = spark.createDataFrame([("p", hashlib.sha256(b"a\nb").hexdigest()), ("q", "0")], "path string, sha256 string")
    assert [r.path for r in evaluate.protected(files, want).collect()] == ["q"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfa\r\nb\rc")
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    from carrierlens import Limits, inspect_binary

    got = inspect_binary(documents.files(spark, str(tmp_path), Limits(max_input_bytes=50)), limits=Limits(max_input_bytes=50), length="length")
    assert {(r.path.rsplit("/")[-1], r.reason_codes[0]) for r in got.collect()} == {("a.txt", "INFORMATIONAL_CARRIER"), ("big.txt", "INPUT_BYTE_LIMIT")}
    assert documents.text_files(spark, str(tmp_path / "a.txt")).first().text == "﻿a\nb\nc"
    data = spark.createDataFrame([("# c",), ("1F468 200D 1F469 ; ZWJ # x",), ("0023..0039 ; ZWJ",), ("1F600 ; Basic",)], "value string")
    assert [(r.sequence, r.error) for r in documents.emoji_extract(data, "ZWJ").collect()] == [("1F468 200D 1F469", None), ("0023..0039", "RANGE")]


def test_sql(spark):
    register(spark)
    rows = spark.sql("SELECT f.* FROM VALUES ('a​pаy') AS t(x), LATERAL carrier_findings(x) AS f").collect()
    assert [(r.offset, r.category) for r in rows] == [(1, "ZERO_WIDTH"), (3, "MIXED_SCRIPT")]
    r = spark.sql("SELECT canonicalize('pаy') AS c, inspect_action('pаy') AS a, inspect_action('‮') AS b, inspect_action('x') AS d").first()
    assert (r.c, r.a, r.b, r.d) == ("pay", "review", "block", "allow")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "fine", "k1"), (2, "a‮", "k2"), (3, "again", "k1")], "i int, text string, k string").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00"))).coalesce(1).write.parquet(src)
    stream = inspection.documents(spark, src, "i int, text string, k string, ts timestamp")
    inspection.to_table(inspection.reports(stream).select("i", "action"), "acts", str(tmp_path / "c1"))
    assert {(r.i, r.action) for r in spark.table("acts").collect()} == {(1, "allow"), (2, "block"), (3, "allow")}
    inspection.to_table(inspection.first_of_each(inspection.documents(spark, src, "i int, text string, k string, ts timestamp"), "k", "ts"), "firsts", str(tmp_path / "c2"))
    assert sorted(r.k for r in spark.table("firsts").collect()) == ["k1", "k2"]
    seen = []
    inspection.each_batch(inspection.reports(inspection.documents(spark, src, "i int, text string, k string, ts timestamp")), lambda df, n: seen.append(df.count()), str(tmp_path / "c3"))
    assert seen == [3]
    q = inspection.actions_by_window(inspection.reports(inspection.documents(spark, src, "i int, text string, k string, ts timestamp")), "ts")
    assert q.isStreaming and "outcome" in q.columns


def test_cli(spark, tmp_path, capsys):
    def run(*argv):
        code = cli.main(list(argv), spark)
        got = capsys.readouterr()
        return code, got.out, got.err

    code, out, _ = run("pаypal")
    assert code == 2 and json.loads(out)["verdict"] == "malicious"
    assert run("pаypal", "--sanitize")[:2] == (2, "paypal\n") and run("plain")[0] == 0
    code, out, err = run("a‮", "--inspect", "--explain")
    assert code == 3 and json.loads(out)["action"] == "block" and err.startswith("complete / block")
    p = tmp_path / "b.jsonl"
    p.write_bytes(b'"ok"\n{bad}\n17\n')
    code, out, _ = run("--inspect", "--jsonl", "--file", str(p))
    assert code == 4 and [json.loads(x)["reason_codes"][0] for x in out.splitlines()] == ["NO_FINDINGS", "INVALID_JSON", "INVALID_TYPE"]
    p.write_bytes(b'{"source_id":"a","text":"fine"}\n')
    assert run("--replay", "pipe", "--file", str(p))[0] == 0
    assert run("--inspect", "--file", str(tmp_path / "none"))[0] == 4
    page = tmp_path / "page.html"
    assert run("fine", "--inspect", "--page", str(page))[0] == 0 and page.read_text().startswith("<!DOCTYPE html>")
    with pytest.raises(FileExistsError):
        cli.main(["fine", "--page", str(page)], spark)
    for bad in (["x", "--jsonl"], ["x", "--sanitize", "--inspect"], [], ["x", "--explain"]):
        with pytest.raises(SystemExit):
            cli.arguments(bad)


def test_stress_texts(spark):
    rows = inspect(evaluate.stress(spark, 4096)).select("family", "action", "finding_count_total").collect()
    got = {r.family: (r.action, r.finding_count_total) for r in rows}
    assert got["zero_width"] == ("review", 4096) and got["late_override"] == ("block", 1) and got["ascii"] == ("allow", 0) and got["mixed_script"] == ("review", 2048)


def test_cli_input(spark, tmp_path, capsys, monkeypatch):
    def run(*argv, piped=b""):
        monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(piped)))
        code = cli.main(list(argv), spark)
        return code, capsys.readouterr().out

    none = str(tmp_path / "none")
    for more in ([], ["--jsonl"]):
        code, out = run("--inspect", *more, "-f", none)
        assert code == 4 and (json.loads(out)["status"], json.loads(out)["reason_codes"]) == ("error", ["INPUT_IO_ERROR"])
    assert run("-f", none)[0] == 2
    for argv in (["-"], []):
        code, out = run(*argv, piped="pаypal".encode())
        assert code == 2 and json.loads(out)["verdict"] == "malicious"
    code, out = run("--inspect", "--jsonl", "--max-records", "2", piped=b'"a"\n"b"\n"c"\n')
    assert code == 4 and len(out.splitlines()) == 2
    events = tmp_path / "events.jsonl"
    code, out = run("--replay", "pipe", "--events", str(events), piped=b'{"source_id":"a","text":"fine"}\n')
    summary, event = json.loads(out), json.loads(events.read_text())
    assert code == 0 and (summary["schema_version"], summary["kind"], summary["pipeline_id"], summary["processed_records"]) == (1, "local_shadow_replay", "pipe", 1)
    assert summary["independent_users"] == 0 and summary["production_pipeline_verified"] is False and event["source_id"] == "a" and "text" not in event
    for bad in ([""], ["x", "--inspect", "--max-records", "0"], ["--replay", "no id", "-f", "x"], ["x", "--events", "y"]):
        with pytest.raises(SystemExit):
            cli.arguments(bad)


def test_lines_are_read_within_limits():
    source = io.BytesIO(b"x" * 50 + b"\n1\n")
    assert [(k, len(line), size) for _, k, line, size in cli._lines(source, 10, 1000, 5)] == [(1, 12, 12)] and source.tell() == 12
    assert [k for _, k, *_ in cli._lines(io.BytesIO(b"1\n2\n3\n4\n"), 10, 3, 5)] == [1, 2]
    assert [k for _, k, *_ in cli._lines(io.BytesIO(b"1\n2\n3\n4\n"), 10, 100, 2)] == [1, 2, 3]


def test_columns_of_the_caller_stay(spark):
    docs = spark.createDataFrame([("a\u200bb", 1, 2, 3, 4)], "text string, _t int, _n int, _F int, __h int")
    for out in (analyze(docs), inspect(docs)):
        row = out.first()
        assert [row[c] for c in docs.columns] == list(docs.first())


def test_page_counts_and_truncation(spark):
    docs = spark.createDataFrame([("a" + "\u200b" * 9,)], "text string")
    html = viewer.render(inspect(docs, limits=Limits(max_findings=6))).first()["html"]
    assert "9 findings, 6 listed" in html and "ZERO_WIDTH 9" in html and "the counts are of all" in html and 'role="status"' in html


def test_repeated_sequences(spark):
    data = spark.createDataFrame([("1F468 200D 1F469 ; ZWJ # x",), ("1F600 200D ; ZWJ",), ("1F600 200D ; ZWJ",)], "value string")
    assert [tuple(r) for r in documents.repeats(documents.emoji_extract(data, "ZWJ")).collect()] == [("1F600 200D", 2)]
