"""The carrier scan as column expressions over one text: no explode, no shuffle, nothing of Python at run time.

counts() holds all that verdicts and policies need, so a query that asks for these only never builds evidence. Pure
ASCII texts hold no carrier and are told by their length in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carrierlens import codepoints as C

COUNTS = "struct<zero_width:int,bidi:int,explicit:int,invisible:int,tags:int,spaces:int,foreign:int,confusable:int,shape:int,mixed:int,density:double,dominant:string>"
FINDINGS = "array<struct<category:string,severity:string,offset:int,length:int,detail:string,codepoints:string>>"
HITS = "array<struct<offset:int,cp:int,category:string>>"


def non_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def _many(text: Column, ranges) -> Column:
    return F.regexp_count(text, F.lit(C.pattern(ranges)))


def foreign_letters(text: Column) -> Column:
    """Letters of each foreign script: struct of their counts."""
    return F.struct(*[_many(text, C.letters(s)).alias(s) for s in C.FOREIGN])


#: Every code point that can be evidence: carriers, and the ranges of foreign scripts.
INTEREST = C.runs({*C.NAMES, *range(C.TAGS[0], C.TAGS[1] + 1), *(p for a, b in C.FOREIGN_RANGES for p in range(a, b + 1))})
#: Texts with at most so many code points of interest are taken apart at these; others character by character.
SPARSE = 128
#: Different carriers of a text that are put into words once each.
FEW = 48
_CLASSES = {"zero_width": C.runs(C.ZERO_WIDTH), "bidi": C.runs(C.BIDI), "explicit": C.runs(C.EXPLICIT_OVERRIDES), "invisible": C.runs(C.INVISIBLE), "tags": [C.TAGS], "spaces": C.runs(C.SPACES)}


def counts(text: Column) -> Column:
    """Carriers of each class and the shape of mixed scripts: 0 none, 1 single lookalikes, 2 a whole alphabet.

    One pass drops all that is of no interest; classes are counted in what is left, which for most texts is nothing.
    The struct is held back from the optimizer, which would else copy the whole scan into every use of a field.
    """
    zero = F.struct(*[F.lit(0).alias(k) for k in (*_CLASSES, "foreign", "confusable", "shape", "mixed")], F.lit(0.0).alias("density"), F.lit(None).cast("string").alias("dominant"))

    def of_rest(rest):
        plain = {k: _many(rest, ranges).alias(k) for k, ranges in _CLASSES.items()}
        return F.when(F.length(rest) > 0, _let(F.struct(*plain.values(), _mixed(text, rest).alias("m")), flat)).otherwise(zero)

    def flat(w):
        m = w["m"]
        mixed = F.when(m["shape"] == 2, m["foreign"]).when(m["shape"] == 1, m["confusable"]).otherwise(F.lit(0))
        return F.struct(*[w[k].alias(k) for k in _CLASSES], *[m[k].alias(k) for k in ("foreign", "confusable", "shape")], mixed.alias("mixed"), m["density"].alias("density"), m["dominant"].alias("dominant"))

    rest = F.regexp_replace(text, "[^" + C.pattern(INTEREST)[1:-1] + "]+", "")
    own = F.when(non_ascii(text), _let(rest, of_rest)).otherwise(zero).cast(COUNTS)
    return F.when(F.spark_partition_id() >= 0, own)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _mixed(text: Column, rest: Column) -> Column:
    none = F.struct(F.lit(0).alias("foreign"), F.lit(0).alias("confusable"), F.lit(0).alias("shape"), F.lit(0.0).alias("density"), F.lit(None).cast("string").alias("dominant"))

    def by_script(s):
        foreign = sum((s[x] for x in C.FOREIGN), F.lit(0))
        return _let(F.struct(s.alias("s"), foreign.alias("foreign"), _many(rest, C.runs(C.CONFUSABLE)).alias("confusable")), judged)

    def judged(v):
        dense = (v["foreign"] > 0) & (10 * v["confusable"] >= 9 * v["foreign"])
        most = F.greatest(*[v["s"][x] for x in C.FOREIGN])
        # all letters are counted only where the rest of the rule holds, and ASCII letters do not rule it out
        possible = dense & (v["foreign"] >= 8)
        full = F.when(possible, F.when(10 * most >= 7 * (v["foreign"] + _many(text, C.letters("ASCII"))), 10 * most >= 7 * _many(text, C.letters())).otherwise(F.lit(False))).otherwise(F.lit(False))
        latin = text.rlike(C.pattern([*C.letters("ASCII"), *C.letters("Latin")]))
        dominant = F.coalesce(*[F.when(v["s"][x] == most, F.lit(x)) for x in C.FOREIGN])
        shape = F.when(full, F.lit(2)).when(dense & latin, F.lit(1)).otherwise(F.lit(0))
        density = F.when(v["foreign"] > 0, v["confusable"] / v["foreign"]).otherwise(F.lit(0.0))
        return F.struct(v["foreign"].alias("foreign"), v["confusable"].alias("confusable"), shape.alias("shape"), density.alias("density"), F.when(v["foreign"] > 0, dominant).alias("dominant"))

    return F.when(rest.rlike(C.pattern(C.FOREIGN_RANGES)), _let(foreign_letters(rest), by_script)).otherwise(none)


def total(n: Column) -> Column:
    return n["zero_width"] + n["bidi"] + n["invisible"] + n["tags"] + n["spaces"] + n["mixed"]


def by_category(n: Column) -> Column:
    """Map of the categories that occur to their counts, keys in order."""
    pairs = [("BIDI_OVERRIDE", "bidi"), ("INVISIBLE_FORMAT", "invisible"), ("MIXED_SCRIPT", "mixed"), ("SUSPICIOUS_WHITESPACE", "spaces"), ("TAG_CHARACTER", "tags"), ("ZERO_WIDTH", "zero_width")]
    entries = F.array(*[F.struct(F.lit(c).alias("key"), n[k].alias("value")) for c, k in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def by_severity(n: Column) -> Column:
    clustered = n["zero_width"] >= C.CLUSTER
    high = n["bidi"] + n["tags"] + n["mixed"] + F.when(clustered, n["zero_width"]).otherwise(0)
    medium = n["invisible"] + F.when(clustered, 0).otherwise(n["zero_width"])
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("high", high), ("low", n["spaces"]), ("medium", medium))])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def has_high(n: Column) -> Column:
    return (n["bidi"] + n["tags"] + n["mixed"] > 0) | (n["zero_width"] >= C.CLUSTER)


def verdict(n: Column) -> Column:
    return F.when(has_high(n), F.lit("malicious")).when(total(n) > 0, F.lit("suspicious")).otherwise(F.lit("clean"))


def hits(text: Column, n: Column) -> Column:
    """Offset, code point and category of every carrier, by offset; the evidence before it is put into words."""
    interest = C.pattern(INTEREST)

    def category(cp):
        foreign = C.within(cp, [r for s in C.FOREIGN for r in C.letters(s)])
        mixed = F.when(n["shape"] == 2, foreign).when(n["shape"] == 1, cp.isin(*C.CONFUSABLE)).otherwise(F.lit(False))
        return F.coalesce(C.carrier(cp), F.when((cp >= 0x370) & mixed, F.lit("MIXED_SCRIPT")))

    def hit(offset, cp):
        return F.struct(offset.alias("offset"), cp.alias("cp"), category(cp).alias("category"))

    def apart(chars):
        # the k-th code point of interest lies behind k gaps and the ones before it
        sizes = F.transform(F.split(text, interest, -1), lambda g: F.length(g))
        return _let(sizes, lambda g: F.transform(chars, lambda c, i: hit(F.aggregate(F.slice(g, F.lit(1), i + 1), i, lambda a, x: a + x), F.ascii(c))))

    one_by_one = F.transform(F.split(text, ""), lambda c, i: hit(i, F.ascii(c)))
    every = _let(F.regexp_extract_all(text, F.lit(interest), F.lit(0)), lambda chars: F.when(F.size(chars) <= SPARSE, apart(chars)).otherwise(one_by_one))
    return F.when(total(n) > 0, F.filter(every, lambda h: h["category"].isNotNull())).otherwise(F.array()).cast(HITS)


def evidence(found: Column, n: Column) -> Column:
    """Findings of hits: category, severity, offset, length, detail, codepoints."""
    clustered = n["zero_width"] >= C.CLUSTER
    # What evidence says.
    cluster = F.concat(F.lit(" Cluster of "), n["zero_width"].cast("string"), F.lit(" zero-width characters suggests a bit-encoded hidden payload."))
    whole = F.concat(F.lit("Full-alphabet confusable substitution: "), n["dominant"], F.lit("-dominant text where "), F.bround(100 * n["density"]).cast("int").cast("string"), F.lit("% of letters are Latin lookalikes."))

    def finding(h):
        cp, category = h["cp"], h["category"]
        char = C.lookup({p: chr(p) for p in C.CONFUSABLE}, cp)
        single = F.concat(F.lit("Homoglyph: "), C.script(cp), F.lit(" '"), char, F.lit("' visually mimics Latin '"), C.lookup(C.CONFUSABLE, cp), F.lit("'."))
        detail = (
            F.when(category == "ZERO_WIDTH", F.concat(F.lit("Invisible character: "), C.lookup(C.ZERO_WIDTH, cp), F.when(clustered, cluster).otherwise(F.lit(""))))
            .when(category == "BIDI_OVERRIDE", F.concat(F.lit("Bidirectional control: "), C.lookup(C.BIDI, cp), F.lit(". Displayed order may differ from logical order.")))
            .when(category == "INVISIBLE_FORMAT", F.concat(F.lit("Invisible formatting character: "), C.lookup(C.INVISIBLE, cp)))
            .when(category == "TAG_CHARACTER", F.lit("Unicode tag character (U+E0000 block). Invisible and a known covert-channel carrier."))
            .when(category == "SUSPICIOUS_WHITESPACE", F.concat(F.lit("Non-standard space: "), C.lookup(C.SPACES, cp)))
            .otherwise(F.when(n["shape"] == 2, whole).otherwise(single))
        )
        severity = F.when(category == "SUSPICIOUS_WHITESPACE", F.lit("low")).when((category == "INVISIBLE_FORMAT") | ((category == "ZERO_WIDTH") & ~clustered), F.lit("medium")).otherwise(F.lit("high"))
        return F.struct(category.alias("category"), severity.alias("severity"), h["offset"].alias("offset"), F.lit(1).alias("length"), detail.alias("detail"), C.label(cp).alias("codepoints"))

    # a text has few different carriers: each is put into words once, however often it occurs
    def worded(kinds):
        words = F.map_from_arrays(F.transform(kinds, lambda k: k["cp"]), F.transform(kinds, finding))
        return _let(words, lambda w: F.transform(found, lambda h: _let(F.element_at(w, h["cp"]), lambda f: F.struct(f["category"].alias("category"), f["severity"].alias("severity"), h["offset"].alias("offset"), f["length"].alias("length"), f["detail"].alias("detail"), f["codepoints"].alias("codepoints")))))

    kinds = F.array_distinct(F.transform(found, lambda h: F.struct(F.lit(0).alias("offset"), h["cp"].alias("cp"), h["category"].alias("category"))))
    many = _let(kinds, lambda k: F.when(F.size(k) <= FEW, worded(k)).otherwise(F.transform(found, finding)))
    return F.when(F.size(found) <= FEW, F.transform(found, finding)).otherwise(many).cast(FINDINGS)


def retained(found: Column, most: int) -> Column:
    """At most `most` hits: one of each category (of direction controls an override, if there is one), then the first; by offset."""

    def chosen(all_):
        firsts = []
        of = lambda c: F.filter(all_, lambda h: h["category"] == F.lit(c))
        for c in C.CATEGORIES:
            own = of(c)
            if c == "BIDI_OVERRIDE":
                hard = F.filter(own, lambda h: h["cp"].isin(*C.EXPLICIT_OVERRIDES))
                own = F.when(F.size(hard) > 0, hard).otherwise(own)
            firsts.append(F.slice(own, 1, 1))
        # inside a lambda an expression is computed for every element: what stays the same is bound first
        return _let(F.concat(*firsts), lambda few: _let(F.transform(few, lambda h: h["offset"]), lambda at: filled(all_, few, at)))

    def filled(all_, few, at):
        others = F.filter(F.slice(all_, 1, most + len(C.CATEGORIES)), lambda h: ~F.array_contains(at, h["offset"]))
        return F.array_sort(F.concat(few, F.slice(others, F.lit(1), F.lit(most) - F.size(few))))

    return _let(found, lambda all_: F.when(F.size(all_) <= most, all_).otherwise(chosen(all_))).cast(HITS)
