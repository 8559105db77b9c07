import random

import pytest
import reference_model as model
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carrierlens import Limits, Policy, analyze, inspect
from carrierlens import codepoints as C
from carrierlens.functions import scan
from carrierlens.functions.sql import rows_of

# text, verdict, categories, findings, sanitized, actions: balanced, legacy, contextual
GOLDENS = [
    ("", "clean", [], 0, "", "allow allow allow"),
    ("Please summarize this document.", "clean", [], 0, "Please summarize this document.", "allow allow allow"),
    ("می‌روم", "suspicious", ["ZERO_WIDTH"], 1, "میروم", "allow review allow"),
    ("क्‍ष", "suspicious", ["ZERO_WIDTH"], 1, "क्ष", "allow review allow"),
    ("\U0001f468‍\U0001f469‍\U0001f467‍\U0001f466", "suspicious", ["ZERO_WIDTH"], 3, "\U0001f468\U0001f469\U0001f467\U0001f466", "allow review allow"),
    ("\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", "malicious", ["TAG_CHARACTER"], 6, "\U0001f3f4", "review block allow"),
    ("Label: ⁧שלום⁩", "malicious", ["BIDI_OVERRIDE"], 2, "Label: שלום", "review block allow"),
    ("שלום", "clean", [], 0, "שלום", "allow allow allow"),
    ("Click ‮payload‬", "malicious", ["BIDI_OVERRIDE"], 2, "Click payload", "block block block"),
    ("Total:\xa0100", "suspicious", ["SUSPICIOUS_WHITESPACE"], 1, "Total: 100", "allow review allow"),
    ("3 kg", "suspicious", ["SUSPICIOUS_WHITESPACE"], 1, "3 kg", "allow review allow"),
    ("hy\xadphen", "suspicious", ["INVISIBLE_FORMAT"], 1, "hyphen", "allow review allow"),
    ("aㅤb", "suspicious", ["INVISIBLE_FORMAT"], 1, "ab", "allow review allow"),
    ("pаypal", "malicious", ["MIXED_SCRIPT"], 1, "paypal", "review block review"),
    ("please νote the chαnge", "malicious", ["MIXED_SCRIPT"], 2, "please vote the change", "review block review"),
    ("τοχικ ριζζα", "malicious", ["MIXED_SCRIPT"], 10, "toxik pizza", "review block review"),
    ("Привет world", "clean", [], 0, "Пpивeт world", "allow allow allow"),
    ("рaypаl ш", "clean", [], 0, "paypal ш", "allow allow allow"),
    ("你好，世界？", "clean", [], 0, "你好,世界?", "allow allow allow"),
    ("x\xb2", "clean", [], 0, "x2", "allow allow allow"),
    ("❤️", "clean", [], 0, "❤️", "allow allow allow"),
    ("note￹hint￺end￻", "clean", [], 0, "note￹hint￺end￻", "allow allow allow"),
    ("a​́", "suspicious", ["ZERO_WIDTH"], 1, "\xe1", "allow review allow"),
    ("а́", "clean", [], 0, "\xe1", "allow allow allow"),
    ("hello​​​", "suspicious", ["ZERO_WIDTH"], 3, "hello", "allow review allow"),
    ("hello​​​​", "malicious", ["ZERO_WIDTH"], 4, "hello", "review block review"),
    ("abc‮", "malicious", ["BIDI_OVERRIDE"], 1, "abc", "block block block"),
    ("gօօgle", "malicious", ["MIXED_SCRIPT"], 2, "gօօgle", "review block review"),
    ("H丫ML", "malicious", ["MIXED_SCRIPT"], 1, "H丫ML", "review block review"),
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def test_goldens(spark):
    df = frame(spark, [g[0] for g in GOLDENS])
    got = {r.i: r for r in analyze(df).collect()}
    for i, (text, verdict, categories, n, sanitized, _) in enumerate(GOLDENS):
        r = got[i]
        assert (r.verdict, sorted(r.stats.by_category), r.stats.finding_count, r.sanitized) == (verdict, categories, n, sanitized), text
        assert len(r.findings) == n and r.stats.chars_removed == len(text) - len(sanitized)
    for k, policy in enumerate((Policy.BALANCED, Policy.LEGACY_VERDICT, Policy.CONTEXTUAL)):
        actions = {r.i: r.action for r in inspect(df, policy=policy).select("i", "action").collect()}
        assert [actions[i] for i in range(len(GOLDENS))] == [g[5].split()[k] for g in GOLDENS]


def test_clean_texts_of_many_scripts(spark):
    texts = ["مرحبا بالعالم", "こんにちは世界", "안녕하세요", "สวัสดี", "Gr\xfc\xdfe aus M\xfcnchen", "Caf\xe9", "Привет, как дела", "x ∈ R → ∑"]
    assert analyze(frame(spark, texts)).where("verdict != 'clean'").count() == 0


ALPHABET = [*map(chr, [*C.ZERO_WIDTH, *C.BIDI, *C.INVISIBLE, *C.SPACES, 0xE0041, 0x430, 0x448, 0x3B1, 0x3C9, 0x585, 0x627, 0x628, 0x4E05, 0x4E2D, 0x5D0, 0x1F600, 0xE9]), *"abe oZ1."]


def held_against_model(spark, texts):
    df = frame(spark, texts)
    got = {r.i: r for r in analyze(df).collect()}
    acts = {r.i: r for r in inspect(df).collect()}
    for i, t in enumerate(texts):
        want = model.scan(t)
        assert [(f.offset, f.category, f.severity, f.codepoints) for f in got[i].findings] == want, ascii(t)
        assert got[i].verdict == model.verdict(want) and got[i].sanitized == model.canonical(t), ascii(t)
        assert got[i].stats.residual_categories == sorted({c for _, c, _, _ in model.scan(model.canonical(t))})
        assert acts[i].action == model.action(t, want) and acts[i].finding_count_total == len(want)
        assert (acts[i].candidate_text == t) if acts[i].action == "allow" else acts[i].candidate_text is None
        assert [(k, c) for k, c, _ in rows_of(t)] == [(k, c) for k, c, _, _ in want]


@settings(max_examples=6, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=40), min_size=30, max_size=60))
def test_random_texts(spark, texts):
    held_against_model(spark, texts)


def test_long_and_dense_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(3000)), "а" * 500, "aа" * 400, "x" * 5000 + "‮", "​" * 1000]
    held_against_model(spark, texts)


@pytest.mark.parametrize("n", range(1, 9))
def test_density_below_nine_tenths_is_silent(n):
    assert model.scan("Latin " + "а" * n + "ш") == []


def test_percent_is_rounded_half_even(spark):
    # 37 of 40 foreign letters: 92.5 percent
    r = analyze(frame(spark, ["а" * 37 + "ш" * 3])).first()
    assert r.findings[0].detail == "Full-alphabet confusable substitution: Cyrillic-dominant text where 92% of letters are Latin lookalikes."


def test_details(spark):
    text = "pаy​­ ⁦\U000e0041l"
    found = {f.category: f.detail for f in analyze(frame(spark, [text])).first().findings}
    assert found == {
        "MIXED_SCRIPT": "Homoglyph: Cyrillic 'а' visually mimics Latin 'a'.",
        "ZERO_WIDTH": "Invisible character: ZERO WIDTH SPACE",
        "INVISIBLE_FORMAT": "Invisible formatting character: SOFT HYPHEN",
        "SUSPICIOUS_WHITESPACE": "Non-standard space: THIN SPACE",
        "BIDI_OVERRIDE": "Bidirectional control: LEFT-TO-RIGHT ISOLATE. Displayed order may differ from logical order.",
        "TAG_CHARACTER": "Unicode tag character (U+E0000 block). Invisible and a known covert-channel carrier.",
    }


def kept(spark, text, most):
    r = inspect(frame(spark, [text]), limits=Limits(max_findings=most)).first()
    return r, [f.offset for f in r.findings]


def test_retention(spark):
    r, at = kept(spark, "\xa0" * 256 + "‮", 6)
    assert (r.action, r.finding_count_total, r.findings_truncated, at) == ("block", 257, True, [0, 1, 2, 3, 4, 256])
    r, at = kept(spark, "⁧" + "\xa0" * 256 + "‮", 6)
    assert (r.action, at) == ("block", [0, 1, 2, 3, 4, 257])
    r, at = kept(spark, "​" * 10_000, 6)
    assert (r.action, r.finding_count_total, at) == ("review", 10_000, list(range(6)))
    r, at = kept(spark, "​" * 6, 6)
    assert (r.findings_truncated, len(at)) == (False, 6)


def test_counts_do_not_build_evidence(spark):
    df = frame(spark, ["a​"])
    plan = inspect(df).select("i", "action")._jdf.queryExecution().optimizedPlan().toString()
    assert "Invisible character" not in plan and "ArrowEvalPython" not in plan


def test_dimension(spark):
    rows = C.dimension(spark)
    assert rows.count() == len(C.NAMES) + 128 + len(C.CONFUSABLE) == 35 + 128 + 64
    assert rows.groupBy("cp").count().where("count > 1").count() == 0


def test_letters_are_those_of_python():
    assert sum(b - a + 1 for a, b in C.letters()) == sum(chr(p).isalpha() for p in range(0x110000))


def test_counts_of_a_null_text(spark):
    n = spark.createDataFrame([(None,)], "text string").select(scan.counts(F.col("text")).alias("n")).first().n
    assert n.zero_width == 0 and n.shape == 0
