"""Queries over the driver's tables, one for each operator of the engine.

Texts of the tables hold no carriers, so most queries read documents with a carrier put into each by doc_id.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carrierlens import codepoints as C
from carrierlens.functions import generators as G
from carrierlens.functions import preview, scan
from carrierlens.functions.canonical import canonicalize
from carrierlens.functions.context import context
from carrierlens.functions.sql import register
from carrierlens.operators import batch, evaluate, viewer
from carrierlens.operators.inspect import FINDING, analyze, exit_code, explode_findings, inspect, inspect_binary
from carrierlens.plans.oracle import CONTEXTS
from carrierlens.settings import Limits, Policy
from carrierlens.sources.sinks import explained
from carrierlens.streaming import inspection


#: Tables up to this size are dealt to all cores after reading: a small file may be a single row group.
SMALL = 512 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL
    return df.repartition(spark.sparkContext.defaultParallelism) if small and name in ("documents", "conversations") else df


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.injected(table(spark, sf_dir, "documents"))


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n", scan.counts(F.col("text")))


def found(docs: DataFrame) -> DataFrame:
    """doc_id and one row a finding."""
    rows = counted(docs).select("doc_id", scan.evidence(scan.hits(F.col("text"), F.col("n")), F.col("n")).alias("f"))
    return explode_findings(rows, "f").select("doc_id", *FINDING)


def carrier_counts_by_category(spark, d):
    rows = counted(injected(spark, d)).select(F.explode_outer(scan.by_category(F.col("n"))).alias("category", "k"))
    return rows.where("category IS NOT NULL").groupBy("category").agg(F.sum("k").alias("n"))


def carrier_counts_by_severity(spark, d):
    rows = counted(injected(spark, d)).select(F.explode_outer(scan.by_severity(F.col("n"))).alias("severity", "k"))
    return rows.where("severity IS NOT NULL").groupBy("severity").agg(F.sum("k").alias("n"))


def findings_total(spark, d):
    rows = counted(injected(spark, d)).select(scan.total(F.col("n")).alias("t"))
    return rows.agg(F.sum("t").alias("findings"), F.count_if(F.col("t") > 0).alias("documents"))


def zero_width_cluster_upgrade(spark, d):
    return found(injected(spark, d)).where("category = 'ZERO_WIDTH'").groupBy("doc_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def findings_detail(spark, d):
    return found(injected(spark, d)).select("doc_id", "offset", "category", "severity", "detail", "codepoints")


def script_histogram(spark, d):
    scripts = [s for s in C.SCRIPTS if s in ("ASCII", "Latin", "Greek", "Cyrillic")]
    sums = injected(spark, d).agg(*[F.sum(F.regexp_count("text", F.lit(C.pattern(C.letters(s))))).alias(s) for s in scripts])
    return sums.unpivot([], scripts, "script", "letters")


def foreign_density(spark, d):
    rows = counted(injected(spark, d)).where("n.foreign > 0")
    return rows.select("doc_id", F.col("n.foreign").alias("foreign_letters"), "n.confusable", "n.density")


def dominant_script(spark, d):
    return counted(injected(spark, d)).where("n.foreign > 0").groupBy(F.col("n.dominant").alias("dominant")).agg(F.count(F.lit(1)).alias("n"))


def mixed_script_isolated(spark, d):
    return found(injected(spark, d)).where("category = 'MIXED_SCRIPT'").select("doc_id", "offset", "codepoints", "detail")


def mixed_script_full(spark, d):
    docs = table(spark, d, "documents").select("doc_id", G.greek_homoglyph_swap(F.regexp_replace(F.lower("text"), "[^aeiokvptxz]", "")).alias("text"))
    rows = found(docs).where("category = 'MIXED_SCRIPT'")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("detail").alias("detail"))


def legacy_verdict(spark, d):
    return analyze(injected(spark, d)).select("doc_id", "verdict", F.col("stats.finding_count").alias("finding_count"))


def verdict_by_source(spark, d):
    return analyze(injected(spark, d)).groupBy("source", "verdict").agg(F.count(F.lit(1)).alias("n"))


def verdict_grouping_sets(spark, d):
    rows = analyze(injected(spark, d)).select("source", "verdict")
    return rows.groupingSets([["source"], ["verdict"], []], "source", "verdict").agg(F.count(F.lit(1)).alias("n"))


def sanitize_text(spark, d):
    return analyze(injected(spark, d)).select("doc_id", "sanitized")


def sanitize_stats(spark, d):
    return analyze(injected(spark, d)).select("doc_id", "stats.input_chars", "stats.sanitized_chars", "stats.chars_removed")


def residual_categories(spark, d):
    return analyze(injected(spark, d)).select("doc_id", F.array_join("stats.residual_categories", ",").alias("residual"))


def _actions(policy):
    return lambda spark, d: inspect(injected(spark, d), policy=policy).select("doc_id", "action")


def reason_codes(spark, d):
    return inspect(injected(spark, d)).select(F.explode_outer("reason_codes").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _with_contexts(spark, d):
    at = F.element_at(F.array(*[F.lit(c) for c in CONTEXTS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" "), at).alias("text"))


def context_summary(spark, d):
    return _with_contexts(spark, d).select("doc_id", context(F.col("text")).alias("c")).select("doc_id", "c.*")


def context_decisions(spark, d):
    return inspect(_with_contexts(spark, d), policy=Policy.CONTEXTUAL).select("doc_id", "action", F.col("reason_codes")[0].alias("reason"))


def retained_evidence_top6(spark, d):
    docs = table(spark, d, "documents")
    text = F.concat("text", F.repeat(F.lit(chr(0xA0)), (F.lit(5) + F.col("doc_id") % 7).cast("int")), F.lit("".join(map(chr, (0x200B, 0x2067, 0x202E, 0x78, 0xAD)))))
    rows = inspect(docs.select("doc_id", text.alias("text")), limits=Limits(max_findings=6))
    rows = explode_findings(rows.select("doc_id", F.col("finding_count_total").alias("total"), "findings"), "findings")
    return rows.select("doc_id", "offset", "category", "codepoints", "total")


def _reasons(rows):
    return rows.groupBy("status", F.col("reason_codes")[0].alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def admission_status(spark, d):
    return _reasons(inspect(table(spark, d, "documents"), limits=Limits(max_chars=2000)))


def binary_admission(spark, d):
    raw = F.when(F.col("doc_id") % 10 == 3, F.concat(F.col("text").cast("binary"), F.lit(b"\xff"))).otherwise(F.col("text").cast("binary"))
    docs = table(spark, d, "documents").select("doc_id", raw.alias("content"))
    return _reasons(inspect_binary(docs, limits=Limits(max_input_bytes=3000)))


def output_size_limit(spark, d):
    return _reasons(inspect(injected(spark, d), limits=Limits(max_output_bytes=4096)))


def _lines(spark, d):
    line = F.when(F.col("doc_id") % 50 == 7, F.lit("{bad}")).when(F.col("doc_id") % 50 == 8, F.lit("17")).otherwise(F.concat(F.lit('"'), F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit('"')))
    rows = table(spark, d, "documents").select(F.col("source").alias("batch_id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("ord"), line.cast("binary").alias("line"))
    return rows.withColumn("size", (F.octet_length("line") + 1).cast("long"))


def jsonl_batch_exit(spark, d):
    reports, batches = batch.inspect_jsonl(_lines(spark, d), max_records=40, input_bytes=60_000)
    emitted = reports.groupBy("batch_id").agg(F.count(F.lit(1)).alias("emitted"))
    return batches.join(emitted, "batch_id", "left").select("batch_id", "exit_code", F.coalesce("emitted", F.lit(0)).alias("emitted"))


def batch_stop_point(spark, d):
    return batch.inspect_jsonl(_lines(spark, d), max_records=40, input_bytes=60_000)[1].select("batch_id", "stopped")


def rag_gate_by_conversation(spark, d):
    turns = table(spark, d, "conversations").withColumn("text", F.when((F.col("conv_id") % 5 == 2) & (F.col("turn") == 1), F.concat("text", F.lit(chr(0x202E)))).otherwise(F.col("text")))
    docs = turns.where("turn > 0").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("ord"), F.col("role").alias("source_id"), "text")
    asked = turns.where("turn = 0").select(F.col("conv_id").alias("batch_id"), F.col("text").alias("question"))
    out = batch.rag_gate(docs, asked, max_documents=6, max_prompt_chars=3000)
    return out.select(F.col("batch_id").alias("conv_id"), "status", "reason", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


def tool_result_gate(spark, d):
    turns = table(spark, d, "conversations").withColumn("text", F.when(F.col("conv_id") % 3 == 1, G.tag_encode(F.lit("hi"), F.col("text"))).otherwise(F.col("text")))
    return batch.tool_result_gate(turns).groupBy("role", F.col("status_of_gate").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _replayed(spark, d):
    """Replay of batches of a thousand ids each; every fortieth record has no text but a number."""
    line = F.when(F.col("doc_id") % 40 == 9, F.to_json(F.struct(F.col("source").alias("source_id"), F.lit(5).alias("text")))).otherwise(F.to_json(F.struct(F.col("source").alias("source_id"), "text")))
    number = F.floor(F.col("doc_id") / 1000).cast("string")
    rows = table(spark, d, "documents").select(number.alias("batch_id"), F.row_number().over(Window.partitionBy(number).orderBy("doc_id")).cast("long").alias("ord"), line.cast("binary").alias("line"))
    return batch.replay(rows.withColumn("size", (F.octet_length("line") + 1).cast("long")))


def replay_dedupe(spark, d):
    return _replayed(spark, d)[0].select("batch_id", "record_index", "source_id", F.col("reason_codes")[0].alias("reason"))


def replay_summary(spark, d):
    counts = F.col("action_or_status_counts")
    return _replayed(spark, d)[1].select("batch_id", "status", "incomplete_reason", "processed_records", F.coalesce(counts["allow"], F.lit(0)).alias("allowed"), F.coalesce(counts["invalid_input"], F.lit(0)).alias("invalid"))


def input_size_percentiles(spark, d):
    size = "octet_length(text)"
    return table(spark, d, "documents").groupBy("source").agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {size})").cast("int").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {size})").cast("int").alias("p95"), F.count(F.lit(1)).alias("n"))


def action_vs_label_confusion(spark, d):
    rows = inspect(injected(spark, d)).select("doc_id", "action").join(table(spark, d, "labels"), "doc_id")
    return evaluate.confusion(rows, "toxic")


def clean_documents_semi(spark, d):
    clean = counted(injected(spark, d)).where(scan.verdict(F.col("n")) == "clean").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(clean, "doc_id", "left_semi")


def held_documents_anti(spark, d):
    allowed = inspect(injected(spark, d)).where("action = 'allow'").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(allowed, "doc_id", "left_anti")


def duplicate_text_hash(spark, d):
    return evaluate.duplicates(table(spark, d, "documents").select(evaluate.text_hash().alias("hash")), "hash")


def cross_split_leak(spark, d):
    rows = table(spark, d, "documents").select(evaluate.text_hash().alias("hash"), (F.col("doc_id") % 2).alias("split"))
    return evaluate.crossing(rows, "hash")


def attack_family_misses(spark, d):
    return evaluate.misses(counted(injected(spark, d)).select("family", scan.verdict(F.col("n")).alias("verdict")))


def stratum_counts(spark, d):
    return evaluate.strata(injected(spark, d).select("family", "lang"), "family", "lang")


def utf16_offsets(spark, d):
    face = chr(0x1F600)
    text = F.concat(F.repeat(F.lit(face), (F.col("doc_id") % 5).cast("int")), "text", F.lit(face + chr(0x200B) + "z"))
    docs = table(spark, d, "documents").select("doc_id", text.alias("text"))
    return found(docs).join(docs, "doc_id").select("doc_id", "offset", preview.utf16_offset(F.col("text"), F.col("offset")).alias("utf16"))


def _snippets(spark, d):
    rows = counted(injected(spark, d))
    rows = rows.where(scan.total(F.col("n")) > 0)
    return preview.snippets(rows.withColumn("findings", scan.evidence(scan.hits(F.col("text"), F.col("n")), F.col("n"))), "doc_id")


def snippet_windows(spark, d):
    return _snippets(spark, d).select("doc_id", "offset")


def omitted_gaps(spark, d):
    return _snippets(spark, d).where("omitted > 0").select("doc_id", "offset", "omitted")


def html_page(spark, d):
    return viewer.render(inspect(injected(spark, d))).select("doc_id", F.length("html").alias("chars"), F.md5(F.col("html").cast("binary")).alias("html_md5"))


def streaming_actions(spark, d):
    """Counts of actions of a stream of documents, by way of foreachBatch; each micro-batch adds its own counts."""
    schema = table(spark, d, "documents").schema
    stream = evaluate.injected(spark.readStream.schema(schema).parquet(f"{d}/documents.parquet" if _is_folder(spark, f"{d}/documents.parquet") else f"{d}/documents*.parquet"))
    parts: list = []

    def keep(rows: DataFrame, number: int) -> None:
        parts.extend(rows.groupBy("action").count().collect())  # three rows a micro-batch

    inspection.each_batch(inspection.reports(stream), keep, tempfile.mkdtemp(prefix="carrierlens-stream-"))
    return spark.createDataFrame([(r["action"], r["count"]) for r in parts], "action string, k long").groupBy("action").agg(F.sum("k").alias("n"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def sql_table_function(spark, d):
    register(spark)
    injected(spark, d).createOrReplaceTempView("_injected")
    return spark.sql("SELECT f.category, count(*) AS n FROM _injected, LATERAL carrier_findings(text) AS f GROUP BY f.category")


def explanations(spark, d):
    rows = inspect(injected(spark, d)).select("action", "finding_count_total", explained().alias("line"), exit_code().alias("code"))
    return rows.groupBy("action").agg(F.count("line").alias("n"), F.sum("finding_count_total").alias("findings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        carrier_counts_by_category, carrier_counts_by_severity, findings_total, zero_width_cluster_upgrade, findings_detail, script_histogram, foreign_density, dominant_script,
        mixed_script_isolated, mixed_script_full, legacy_verdict, verdict_by_source, verdict_grouping_sets, sanitize_text, sanitize_stats, residual_categories, reason_codes,
        context_summary, context_decisions, retained_evidence_top6, admission_status, binary_admission, output_size_limit, jsonl_batch_exit, batch_stop_point, rag_gate_by_conversation,
        tool_result_gate, replay_dedupe, replay_summary, input_size_percentiles, action_vs_label_confusion, clean_documents_semi, held_documents_anti, duplicate_text_hash,
        cross_split_leak, attack_family_misses, stratum_counts, utf16_offsets, snippet_windows, omitted_gaps, html_page, streaming_actions, sql_table_function, explanations,
    )
} | {"balanced_action": _actions(Policy.BALANCED), "legacy_policy_action": _actions(Policy.LEGACY_VERDICT), "contextual_action": _actions(Policy.CONTEXTUAL)}
