"""Reports, one row a document: the verdict report (analyze) and the policy report (inspect, inspect_binary).

All is a projection of the row; nothing is shuffled. Columns that a query does not select are not computed: actions come
from counts, evidence is built only where findings are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierlens.functions import scan
from carrierlens.functions.canonical import canonicalize
from carrierlens.functions.context import context
from carrierlens.functions.policy import decide
from carrierlens.settings import Limits, Policy, checked

REPORT = ["schema_version", "policy_id", "status", "action", "reason_codes", "findings", "finding_count_total", "category_counts", "findings_truncated", "scan_complete", "candidate_text", "transformation"]
EVIDENCE = "array<struct<rule_id:string,category:string,severity:string,offset:int,length:int,detail:string,codepoints:string>>"
#: Bytes of JSON that one finding takes at most, and the rest of a report beside its text.
FINDING_BYTES, REST_BYTES = 400, 1_200


def _apart(docs: DataFrame) -> str:
    """A beginning of names that no column of docs has."""
    at = "_"
    while any(c.lower().startswith(at) for c in docs.columns):
        at += "_"
    return at


def analyze(docs: DataFrame, text: str = "text", limits: Limits | None = None) -> DataFrame:
    """docs with verdict, findings, sanitized, stats and error: the verdict report over the whole text.

    Null text: error INVALID_TYPE. More characters than the limit: error INPUT_CHAR_LIMIT. Such rows have no verdict.
    """
    limits = Limits() if limits is None else limits
    at = _apart(docs)
    t = F.col(f"`{text}`")
    error = F.when(t.isNull(), F.lit("INVALID_TYPE")).when(F.length(t) > limits.max_chars, F.lit("INPUT_CHAR_LIMIT"))
    out = docs.withColumn(f"{at}t", F.when(error.isNull(), t)).withColumn(f"{at}n", scan.counts(F.col(f"{at}t")))
    out = out.withColumn(f"{at}s", canonicalize(F.col(f"{at}t"))).withColumn(f"{at}r", scan.counts(F.col(f"{at}s")))
    n, fine = F.col(f"{at}n"), F.col(f"{at}t").isNotNull()
    stats = F.struct(
        F.length(f"{at}t").alias("input_chars"),
        F.length(f"{at}s").alias("sanitized_chars"),
        (F.length(f"{at}t") - F.length(f"{at}s")).alias("chars_removed"),
        scan.total(n).alias("finding_count"),
        scan.by_category(n).alias("by_category"),
        scan.by_severity(n).alias("by_severity"),
        F.map_keys(scan.by_category(F.col(f"{at}r"))).alias("residual_categories"),
    )
    out = out.withColumn(f"{at}h", scan.hits(F.col(f"{at}t"), n))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(fine, scan.verdict(n)).alias("verdict"),
        F.when(fine, scan.evidence(F.col(f"{at}h"), n)).alias("findings"),
        F.col(f"{at}s").alias("sanitized"),
        F.when(fine, stats).alias("stats"),
        error.alias("error"),
    )


def _with_rules(findings: Column) -> Column:
    rule = lambda f: F.concat(F.lit("unicode."), F.lower(f["category"]), F.lit(".v1"))
    return F.transform(findings, lambda f: F.struct(rule(f).alias("rule_id"), *[f[k].alias(k) for k in ("category", "severity", "offset", "length", "detail", "codepoints")])).cast(EVIDENCE)


def report_json(report: list[str] | None = None) -> Column:
    """The report columns as compact ASCII JSON. Escapes are upper-case; their length is that of other writers."""
    return F.to_json(F.struct(*(report or REPORT)), {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})


def json_length(json: Column, text: Column) -> Column:
    """The bytes of a report in JSON that also escapes DEL."""
    return F.length(json) + 5 * F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\x7f"), F.lit(""))), F.lit(0))


def inspect(docs: DataFrame, text: str = "text", policy: Policy = Policy.BALANCED, limits: Limits | None = None, held: Column | None = None, sequences: frozenset[str] | None = None) -> DataFrame:
    """docs with the report columns of REPORT beside (ours replace columns of these names).

    held: a reason code where the row was turned down before (its text is not scanned). A null text without one is
    INVALID_TYPE. Only action allow comes with candidate_text, the text as it was.
    """
    limits = Limits() if limits is None else limits
    checked(policy, limits)
    at = _apart(docs)
    t = F.col(f"`{text}`")
    early = F.when(t.isNull(), F.lit("INVALID_TYPE")).when(F.length(t) > limits.max_chars, F.lit("INPUT_CHAR_LIMIT"))
    early = early if held is None else F.coalesce(held, early)
    out = docs.withColumn(f"{at}early", early).withColumn(f"{at}t", F.when(F.col(f"{at}early").isNull(), t)).withColumn(f"{at}n", scan.counts(F.col(f"{at}t")))
    n = F.col(f"{at}n")
    around = None
    if policy is Policy.CONTEXTUAL:
        out = out.withColumn(f"{at}c", context(F.col(f"{at}t"), sequences))
        around = F.col(f"{at}c")
    out = out.withColumn(f"{at}d", decide(n, policy, around))
    scanned, error = F.col(f"{at}t").isNotNull(), F.col(f"{at}d.action").isNull()
    fine = scanned & ~error
    kept = scan.retained(scan.hits(F.col(f"{at}t"), n), limits.max_findings)
    out = out.withColumn(f"{at}f", F.when(fine, _with_rules(scan.evidence(kept, n))).otherwise(F.array().cast(EVIDENCE)))
    counted = F.when(fine, scan.total(n)).otherwise(0)
    columns = {
        "schema_version": F.lit(policy.schema_version),
        "policy_id": F.lit(policy.value),
        "status": F.when(fine, F.lit("complete")).when(scanned, F.lit("error")).when(F.col(f"{at}early").endswith("LIMIT"), F.lit("limit_exceeded")).when(F.col(f"{at}early") == "INPUT_IO_ERROR", F.lit("error")).otherwise(F.lit("invalid_input")),
        "action": F.when(fine, F.col(f"{at}d.action")),
        "reason_codes": F.when(scanned, F.col(f"{at}d.reason_codes")).otherwise(F.array(f"{at}early")),
        "findings": F.col(f"{at}f"),
        "finding_count_total": counted,
        "category_counts": F.when(fine, scan.by_category(n)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))),
        "findings_truncated": counted > limits.max_findings,
        "scan_complete": fine,
        "candidate_text": F.when(F.col(f"{at}d.action") == "allow", F.col(f"{at}t")),
        "transformation": F.lit("preserve"),
    }
    mine = [c for c in docs.columns if c not in columns]
    out = out.select(*[F.col(f"`{c}`") for c in mine], *[v.alias(k) for k, v in columns.items()], F.col(f"{at}t"))
    # six bytes a character's escape, twelve a pair's: with limits that no report can reach there is nothing to check
    if 12 * limits.max_chars + FINDING_BYTES * limits.max_findings + REST_BYTES <= limits.max_output_bytes:
        return out.drop(f"{at}t")
    worst = 12 * F.length(F.coalesce("candidate_text", F.lit(""))) + FINDING_BYTES * F.size("findings") + REST_BYTES
    long = F.when((F.col("status") == "complete") & (worst > limits.max_output_bytes), json_length(report_json(), F.col("candidate_text")) > limits.max_output_bytes).otherwise(F.lit(False))
    out = out.withColumn(f"{at}long", long)
    cut = {
        "status": F.lit("limit_exceeded"), "action": F.lit(None).cast("string"), "reason_codes": F.array(F.lit("OUTPUT_BYTE_LIMIT")),
        "findings": F.array().cast(EVIDENCE), "findings_truncated": F.col("finding_count_total") > 0, "candidate_text": F.lit(None).cast("string"),
    }
    return out.select(*[F.col(f"`{c}`") for c in mine], *[(F.when(F.col(f"{at}long"), cut[c]).otherwise(F.col(c)).alias(c) if c in cut else F.col(c)) for c in REPORT])


def inspect_binary(docs: DataFrame, content: str = "content", policy: Policy = Policy.BALANCED, limits: Limits | None = None, length: str | None = None, sequences: frozenset[str] | None = None) -> DataFrame:
    """inspect() of a binary column: a byte limit, then strict UTF-8, then the text.

    length: a column that knows the bytes; below zero where the input could not be read (INPUT_IO_ERROR).
    """
    limits = Limits() if limits is None else limits
    checked(policy, limits)
    at = _apart(docs)
    raw = F.col(f"`{content}`")
    size = F.col(f"`{length}`") if length else F.octet_length(raw)
    text = raw.cast("string")
    held = F.when(F.lit(length is not None) & (size < 0), F.lit("INPUT_IO_ERROR")).when(raw.isNull() & (F.lit(length is None) | (size <= limits.max_input_bytes)), F.lit("INVALID_TYPE")).when(size > limits.max_input_bytes, F.lit("INPUT_BYTE_LIMIT")).when(~F.is_valid_utf8(text), F.lit("INVALID_UTF8"))
    rows = docs.withColumn(f"{at}held", held).withColumn(f"{at}text", F.when(F.col(f"{at}held").isNull(), text))
    return inspect(rows, f"{at}text", policy, limits, held=F.col(f"{at}held"), sequences=sequences).drop(f"{at}held", f"{at}text")


#: Fields of a finding.
FINDING = ["category", "severity", "offset", "length", "detail", "codepoints"]


def explode_findings(rows: DataFrame, findings: str = "findings") -> DataFrame:
    """A row for each finding, with its fields; rows without findings are left out.

    The outer form is used on purpose: for the inner one the optimizer infers a filter on the array's size and moves a
    second copy of the whole scan below it.
    """
    out = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != findings], F.inline_outer(findings))
    return out.where(F.col("category").isNotNull())


def exit_code() -> Column:
    """0 for allow, 3 for a complete report that is held, 4 for a failure."""
    return F.when(F.col("action") == "allow", F.lit(0)).when(F.col("status") == "complete", F.lit(3)).otherwise(F.lit(4))
