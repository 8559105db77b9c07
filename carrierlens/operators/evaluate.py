"""Evaluation over relations: confusion counts, strata, misses by attack, and the checks of a fixture set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlens import codepoints as C
from carrierlens.functions import generators as G

ACTIONS = ["allow", "review", "block"]


def confusion(rows: DataFrame, label: str, action: str = "action", labels: list | None = None) -> DataFrame:
    """label and a count for each action, zero-filled over a fixed domain of labels if one is given."""
    out = rows.groupBy(label).pivot(action, ACTIONS).count()
    if labels:
        kind = dict(rows.dtypes)[label]
        domain = rows.sparkSession.createDataFrame([(x,) for x in labels], f"{label} {kind}")
        out = F.broadcast(domain).join(out, label, "left")
    return out.na.fill(0, ACTIONS)


def strata(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by each single column: dimension, value, n."""
    sets = ", ".join(f"({b})" for b in by)
    rows.createOrReplaceTempView("_strata")
    counted = rows.sparkSession.sql(f"SELECT {', '.join(by)}, count(*) AS n, grouping_id({', '.join(by)}) AS g FROM _strata GROUP BY GROUPING SETS ({sets})")
    bit = lambda k: 1 << (len(by) - 1 - k)
    name = value = None
    for k, b in enumerate(by):
        own = F.col("g").bitwiseAND(bit(k)) == 0
        name = F.when(own, F.lit(b)) if name is None else name.when(own, F.lit(b))
        value = F.when(own, F.col(b).cast("string")) if value is None else value.when(own, F.col(b).cast("string"))
    return counted.select(name.alias("dimension"), value.alias("value"), "n")


def misses(rows: DataFrame, family: str = "family", verdict: str = "verdict") -> DataFrame:
    """family, n, missed: attacks whose verdict is not malicious."""
    return rows.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(verdict) != "malicious").cast("long")).alias("missed"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def crossing(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def orphans(rows: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    return rows.join(sources, key, "left_anti")


def text_hash(text: str = "text"):
    return F.sha2(F.col(text), 256)


def differing(rows: DataFrame, goldens: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows whose golden is missing or says otherwise, and goldens without a row."""
    joined = rows.alias("a").join(goldens.alias("b"), key, "full")
    wrong = F.lit(False)
    for c in columns:
        wrong = wrong | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return joined.where(wrong).select(key)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def protected(files: DataFrame, expected: DataFrame) -> DataFrame:
    """path of files(path, content) whose SHA-256, with \\n line ends, is not the expected(path, sha256)."""
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n")
    found = files.select("path", F.sha2(F.encode(text, "ISO-8859-1"), 256).alias("sha256"))
    return differing(found, expected, "path", "sha256")


#: The attack families that rows can be given, by their number.
FAMILIES = ["clean", "zero_width", "bidi", "tags", "cyrillic", "greek", "soft_hyphen", "no_break_space"]


def injected(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a carrier put into each text by key modulo the number of families, and the family's name."""
    t, k = F.col(text), F.pmod(F.col(key), F.lit(len(FAMILIES)))
    head, rest = F.substring(t, 1, 20), F.expr(f"substring({text}, 21)")
    made = [
        t,
        G.zero_width_encode(F.lit("hi"), t),
        G.bidi_wrap(F.lit("payload"), t),
        G.tag_encode(F.lit("hi"), t),
        F.concat(G.homoglyph_swap(head), rest),
        F.concat(G.greek_homoglyph_swap(head), rest),
        G.invisible_format_embed(t),
        F.coalesce(G.suspicious_whitespace_replace(t), t),
    ]
    family = out = None
    for n, (name, value) in enumerate(zip(FAMILIES, made, strict=True)):
        out = F.when(k == n, value) if out is None else out.when(k == n, value)
        family = F.when(k == n, F.lit(name)) if family is None else family.when(k == n, F.lit(name))
    return docs.withColumn(text, out).withColumn("family", family)


def stress(spark, codepoints: int = 1_048_576) -> DataFrame:
    """family, text: pathological texts of one size."""
    def fill(unit: str) -> str:
        return (unit * (codepoints // len(unit) + 1))[:codepoints]

    units = {
        "ascii": "a", "surrogates": "\U0001f600", "nested_bidi": "⁧", "mixed_script": "aа", "combining": "a" + "́̂" * 64, "compatibility_combining": "ﬁ" + "̣́" * 32,
        "zero_width": "​", "tags": "\U000e0041", "ordinary": "plain words in a row, ", "family": "\U0001f468‍\U0001f469‍\U0001f467‍\U0001f466 ", "persian": "می‌روم ", "rtl": "⁧שלום⁩ ", "stray_joiner": "a‍b",
    }
    return spark.createDataFrame([(k, fill(u)) for k, u in units.items()] + [("late_override", fill("x")[:-1] + "‮")], "family string, text string").repartition(len(units) + 1)


def rule_coverage(tested: DataFrame) -> DataFrame:
    """Categories without an entry in tested(category), and entries of no category: category, side."""
    domain = tested.sparkSession.createDataFrame([(c, True) for c in C.CATEGORIES], "category string, known boolean")
    both = domain.join(tested.select("category").distinct().withColumn("covered", F.lit(True)), "category", "full")
    return both.where("known IS NULL OR covered IS NULL").select("category", F.when(F.col("known").isNull(), F.lit("unknown")).otherwise(F.lit("untested")).alias("side"))
