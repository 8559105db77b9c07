"""The same answers in SQL, written apart from the engine: texts are unnested into characters and joined to inline tables.

Code points are given by number, so no invisible character hides in the text of a query.
"""

from __future__ import annotations

from carrierlens import codepoints as C
from carrierlens.functions import generators as G


def _chars(points) -> str:
    return " || ".join(f"chr({p})" for p in points)


def _in(points) -> str:
    return "(" + ", ".join(str(p) for p in points) + ")"


def _values(table: dict) -> str:
    return ", ".join(f"({p}, '{n}')" for p, n in table.items())


def _swap(expr: str, table: dict[str, str]) -> str:
    return f"translate({expr}, '{''.join(table)}', {_chars(map(ord, table.values()))})"


INJECTED = f"""inj AS (SELECT doc_id, lang, source, (doc_id % 8) AS k,
  ['clean', 'zero_width', 'bidi', 'tags', 'cyrillic', 'greek', 'soft_hyphen', 'no_break_space'][(doc_id % 8 + 1)::INT] AS family,
  CASE doc_id % 8 WHEN 0 THEN text
    WHEN 1 THEN text || translate('0110100001101001', '01', chr(8203) || chr(8204))
    WHEN 2 THEN text || ' ' || chr(8238) || 'payload' || chr(8236)
    WHEN 3 THEN text || chr({0xE0000 + 104}) || chr({0xE0000 + 105})
    WHEN 4 THEN {_swap("substr(text, 1, 20)", G.CYRILLIC)} || substr(text, 21)
    WHEN 5 THEN {_swap("substr(text, 1, 20)", G.GREEK)} || substr(text, 21)
    WHEN 6 THEN substr(text, 1, length(text) // 2) || chr(173) || substr(text, length(text) // 2 + 1)
    ELSE CASE WHEN position(' ' IN text) > 0 THEN substr(text, 1, position(' ' IN text) - 1) || chr(160) || substr(text, position(' ' IN text) + 1) ELSE text END END AS text
  FROM documents)"""


def scanned(source: str) -> str:
    """CTEs over source(doc_id, text): c (characters of interest), n (counts and shape), f (findings)."""
    return f"""ch AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(len(string_split(text, '')))) AS off FROM {source}),
names(cp, name) AS (VALUES {_values(C.NAMES)}),
conf(cp, latin) AS (VALUES {_values(C.CONFUSABLE)}),
c AS (SELECT doc_id, off::INT AS off, ch, ord(ch) AS cp, names.name, conf.latin,
  CASE WHEN ord(ch) IN {_in(C.ZERO_WIDTH)} THEN 'ZERO_WIDTH' WHEN ord(ch) IN {_in(C.BIDI)} THEN 'BIDI_OVERRIDE' WHEN ord(ch) IN {_in(C.INVISIBLE)} THEN 'INVISIBLE_FORMAT'
    WHEN ord(ch) BETWEEN {C.TAGS[0]} AND {C.TAGS[1]} THEN 'TAG_CHARACTER' WHEN ord(ch) IN {_in(C.SPACES)} THEN 'SUSPICIOUS_WHITESPACE' END AS carrier,
  CASE WHEN ord(ch) BETWEEN 880 AND 1023 THEN 'Greek' WHEN ord(ch) BETWEEN 1024 AND 1327 THEN 'Cyrillic' WHEN ord(ch) BETWEEN 1328 AND 1423 THEN 'Armenian'
    WHEN ord(ch) BETWEEN 1536 AND 1791 THEN 'Arabic' WHEN ord(ch) BETWEEN 19968 AND 40959 OR ord(ch) BETWEEN 13312 AND 19903 THEN 'Han' END AS script,
  regexp_matches(ch, '\\p{{L}}') AS letter
  FROM ch LEFT JOIN names ON names.cp = ord(ch) LEFT JOIN conf ON conf.cp = ord(ch)),
n0 AS (SELECT doc_id, count(*) FILTER (carrier = 'ZERO_WIDTH') AS zw, count(*) FILTER (carrier = 'BIDI_OVERRIDE') AS bidi, count(*) FILTER (cp IN (8237, 8238)) AS explicit,
  count(*) FILTER (carrier = 'INVISIBLE_FORMAT') AS invisible, count(*) FILTER (carrier = 'TAG_CHARACTER') AS tags, count(*) FILTER (carrier = 'SUSPICIOUS_WHITESPACE') AS spaces,
  count(*) FILTER (letter) AS letters, count(*) FILTER (letter AND script IS NOT NULL) AS foreigners, count(*) FILTER (letter AND latin IS NOT NULL) AS lookalikes,
  bool_or(letter AND cp < 592) AS has_latin, greatest(count(*) FILTER (letter AND script = 'Greek'), count(*) FILTER (letter AND script = 'Cyrillic'), count(*) FILTER (letter AND script = 'Armenian'), count(*) FILTER (letter AND script = 'Arabic'), count(*) FILTER (letter AND script = 'Han')) AS most,
  mode(script) FILTER (letter AND script IS NOT NULL) AS dominant
  FROM c GROUP BY doc_id),
n1 AS (SELECT *, CASE WHEN foreigners >= 8 AND lookalikes >= 0.9 * foreigners AND most >= 0.7 * letters THEN 2 WHEN foreigners > 0 AND lookalikes >= 0.9 * foreigners AND has_latin THEN 1 ELSE 0 END AS shape FROM n0),
n AS (SELECT *, CASE shape WHEN 2 THEN foreigners WHEN 1 THEN lookalikes ELSE 0 END AS mixed, zw + bidi + invisible + tags + spaces + CASE shape WHEN 2 THEN foreigners WHEN 1 THEN lookalikes ELSE 0 END AS total,
  CASE WHEN bidi + tags + CASE shape WHEN 2 THEN foreigners WHEN 1 THEN lookalikes ELSE 0 END > 0 OR zw >= 4 THEN 'malicious' WHEN zw + invisible + spaces > 0 THEN 'suspicious' ELSE 'clean' END AS verdict,
  CASE WHEN explicit > 0 THEN 'block' WHEN bidi + tags + CASE shape WHEN 2 THEN foreigners WHEN 1 THEN lookalikes ELSE 0 END > 0 OR zw >= 4 THEN 'review' ELSE 'allow' END AS action FROM n1),
f0 AS (SELECT c.*, n.zw, n.shape, n.dominant, n.lookalikes, n.foreigners, coalesce(carrier, CASE WHEN letter AND script IS NOT NULL AND (shape = 2 OR (shape = 1 AND latin IS NOT NULL)) THEN 'MIXED_SCRIPT' END) AS category FROM c JOIN n USING (doc_id)),
f AS (SELECT doc_id, off AS "offset", category,
  CASE WHEN category = 'SUSPICIOUS_WHITESPACE' THEN 'low' WHEN category = 'INVISIBLE_FORMAT' OR (category = 'ZERO_WIDTH' AND zw < 4) THEN 'medium' ELSE 'high' END AS severity,
  CASE category WHEN 'ZERO_WIDTH' THEN 'Invisible character: ' || name || CASE WHEN zw >= 4 THEN ' Cluster of ' || zw || ' zero-width characters suggests a bit-encoded hidden payload.' ELSE '' END
    WHEN 'BIDI_OVERRIDE' THEN 'Bidirectional control: ' || name || '. Displayed order may differ from logical order.'
    WHEN 'INVISIBLE_FORMAT' THEN 'Invisible formatting character: ' || name
    WHEN 'TAG_CHARACTER' THEN 'Unicode tag character (U+E0000 block). Invisible and a known covert-channel carrier.'
    WHEN 'SUSPICIOUS_WHITESPACE' THEN 'Non-standard space: ' || name
    WHEN 'MIXED_SCRIPT' THEN CASE shape WHEN 2 THEN 'Full-alphabet confusable substitution: ' || dominant || '-dominant text where ' || round_even(100.0 * lookalikes / foreigners, 0)::INT || '% of letters are Latin lookalikes.' ELSE 'Homoglyph: ' || script || ' ''' || ch || ''' visually mimics Latin ''' || latin || '''.' END END AS detail,
  'U+' || CASE WHEN cp < 4096 THEN lpad(printf('%X', cp), 4, '0') ELSE printf('%X', cp) END AS codepoints, cp
  FROM f0 WHERE category IS NOT NULL)"""


BASE = f"WITH {INJECTED}, {scanned('inj')}"
GREEK_ONLY = f"""swapped AS (SELECT doc_id, {_swap("regexp_replace(lower(text), '[^aeiokvptxz]', '', 'g')", G.GREEK)} AS text FROM documents)"""
_REASON_ROWS = """r AS (SELECT doc_id, unnest(CASE WHEN explicit > 0 THEN ['BIDI_EXPLICIT_OVERRIDE'] WHEN action = 'review' THEN list_filter(list_sort([CASE WHEN bidi > 0 THEN 'BIDI_CONTROL' END, CASE WHEN mixed > 0 THEN 'MIXED_SCRIPT' END, CASE WHEN tags > 0 THEN 'TAG_CHARACTER' END, CASE WHEN zw >= 4 THEN 'ZERO_WIDTH_CLUSTER' END]), lambda x: x IS NOT NULL)
  WHEN total > 0 THEN ['INFORMATIONAL_CARRIER'] ELSE ['NO_FINDINGS'] END) AS reason FROM n)"""
_STRIP = [*C.ZERO_WIDTH, *C.BIDI, *C.INVISIBLE, 0xE0000 + 104, 0xE0000 + 105]
SANITIZED = f"""san AS (SELECT doc_id, text, nfc_normalize(translate(translate(text, {_chars([*C.REWRITTEN, *C.SPACES])}, '{"".join(C.REWRITTEN.values())}{" " * len(C.SPACES)}'), {_chars(_STRIP)}, '')) AS sanitized FROM inj)"""
CONTEXTS = ["می‌روم", "क्‍ष", "\U0001f468‍\U0001f469‍\U0001f467‍\U0001f466", "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", "⁧שלום⁩", "a‍b"]
#: What is recognised in CONTEXTS: zero-width, tags, directions; joiners that are not.
CONTEXT_COUNTS = [(1, 0, 0, 0), (1, 0, 0, 0), (3, 0, 0, 0), (0, 6, 0, 0), (0, 0, 2, 0), (0, 0, 0, 1)]
_context = " ".join(f"WHEN {k} THEN [{', '.join(map(str, v))}]" for k, v in enumerate(CONTEXT_COUNTS))
MANY = f"""many AS (SELECT doc_id, text || repeat(chr(160), (5 + doc_id % 7)::INT) || chr(8203) || chr(8295) || chr(8238) || 'x' || chr(173) AS text FROM documents)"""
_LINES = """lines AS (SELECT source AS batch_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord, doc_id,
  CASE WHEN doc_id % 50 = 7 THEN '{bad}' WHEN doc_id % 50 = 8 THEN '17' ELSE '"' || regexp_replace(text, '[^A-Za-z ]', '', 'g') || '"' END AS line FROM documents)"""

SQL = {
    "carrier_counts_by_category": f"{BASE} SELECT category, count(*) AS n FROM f GROUP BY category",
    "carrier_counts_by_severity": f"{BASE} SELECT severity, count(*) AS n FROM f GROUP BY severity",
    "findings_total": f"{BASE} SELECT count(*) AS findings, count(DISTINCT doc_id) AS documents FROM f",
    "zero_width_cluster_upgrade": f"{BASE} SELECT doc_id, severity, count(*) AS n FROM f WHERE category = 'ZERO_WIDTH' GROUP BY doc_id, severity",
    "findings_detail": f"{BASE} SELECT doc_id, \"offset\", category, severity, detail, codepoints FROM f",
    "script_histogram": f"""{BASE} SELECT CASE WHEN cp < 128 THEN 'ASCII' WHEN cp < 592 THEN 'Latin' ELSE script END AS script, count(*) AS letters FROM c WHERE letter GROUP BY 1""",
    "foreign_density": f"{BASE} SELECT doc_id, foreigners::INT AS foreign_letters, lookalikes::INT AS confusable, lookalikes / foreigners AS density FROM n WHERE foreigners > 0",
    "dominant_script": f"{BASE} SELECT dominant, count(*) AS n FROM n WHERE foreigners > 0 GROUP BY dominant",
    "mixed_script_isolated": f"{BASE} SELECT doc_id, \"offset\", codepoints, detail FROM f WHERE category = 'MIXED_SCRIPT'",
    "mixed_script_full": f"WITH {GREEK_ONLY}, {scanned('swapped')} SELECT doc_id, count(*) AS n, min(detail) AS detail FROM f WHERE category = 'MIXED_SCRIPT' GROUP BY doc_id",
    "legacy_verdict": f"{BASE} SELECT doc_id, verdict, total::INT AS finding_count FROM n",
    "verdict_by_source": f"{BASE} SELECT source, verdict, count(*) AS n FROM n JOIN inj USING (doc_id) GROUP BY source, verdict",
    "verdict_grouping_sets": f"{BASE} SELECT source, verdict, count(*) AS n FROM n JOIN inj USING (doc_id) GROUP BY GROUPING SETS ((source), (verdict), ())",
    "sanitize_text": f"WITH {INJECTED}, {SANITIZED} SELECT doc_id, sanitized FROM san",
    "sanitize_stats": f"WITH {INJECTED}, {SANITIZED} SELECT doc_id, length(text)::INT AS input_chars, length(sanitized)::INT AS sanitized_chars, (length(text) - length(sanitized))::INT AS chars_removed FROM san",
    "residual_categories": f"WITH {INJECTED}, {SANITIZED}, clean AS (SELECT doc_id, sanitized AS text FROM san), {scanned('clean')} SELECT d.doc_id, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS residual FROM clean d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id",
    "balanced_action": f"{BASE} SELECT doc_id, action FROM n",
    "legacy_policy_action": f"{BASE} SELECT doc_id, CASE verdict WHEN 'malicious' THEN 'block' WHEN 'suspicious' THEN 'review' ELSE 'allow' END AS action FROM n",
    "reason_codes": f"{BASE}, {_REASON_ROWS} SELECT reason, count(*) AS n FROM r GROUP BY reason",
    "contextual_action": f"{BASE} SELECT doc_id, action FROM n",
    "context_summary": f"SELECT doc_id, v[1]::INT AS recognized_zero_width, v[2]::INT AS recognized_tags, v[3]::INT AS recognized_bidi, v[4]::INT AS unrecognized_zwj FROM (SELECT doc_id, CASE doc_id % 6 {_context} END AS v FROM documents)",
    "context_decisions": "SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'review' ELSE 'allow' END AS action, CASE WHEN doc_id % 6 = 5 THEN 'UNRECOGNIZED_JOINER' ELSE 'RECOGNIZED_CONTEXT' END AS reason FROM documents",
    "retained_evidence_top6": f"""WITH {MANY}, {scanned("many")}, rep AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY cp IN (8237, 8238) DESC, "offset") = 1 AS first FROM f),
  keep AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first DESC, "offset") AS r, count(*) OVER (PARTITION BY doc_id) AS total FROM rep)
  SELECT doc_id, "offset", category, codepoints, total::INT AS total FROM keep WHERE r <= 6""",
    "admission_status": "SELECT CASE WHEN length(text) > 2000 THEN 'limit_exceeded' ELSE 'complete' END AS status, CASE WHEN length(text) > 2000 THEN 'INPUT_CHAR_LIMIT' ELSE 'NO_FINDINGS' END AS reason, count(*) AS n FROM documents GROUP BY 1, 2",
    "binary_admission": """WITH b AS (SELECT strlen(text) + (doc_id % 10 = 3)::INT AS bytes, doc_id % 10 = 3 AS broken FROM documents)
  SELECT CASE WHEN bytes > 3000 THEN 'limit_exceeded' WHEN broken THEN 'invalid_input' ELSE 'complete' END AS status, CASE WHEN bytes > 3000 THEN 'INPUT_BYTE_LIMIT' WHEN broken THEN 'INVALID_UTF8' ELSE 'NO_FINDINGS' END AS reason, count(*) AS n FROM b GROUP BY 1, 2""",
    "jsonl_batch_exit": f"""WITH {_LINES}, t AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY batch_id ORDER BY ord) AS cum FROM lines),
  stop AS (SELECT batch_id, min(ord) AS stop_at FROM t WHERE cum > 60000 OR ord > 40 GROUP BY batch_id),
  e AS (SELECT t.* FROM t LEFT JOIN stop USING (batch_id) WHERE stop_at IS NULL OR ord < stop_at)
  SELECT b.batch_id, CASE WHEN stop_at IS NOT NULL THEN 4 ELSE max(CASE WHEN line IN ('{{bad}}', '17') THEN 4 ELSE 0 END) END::INT AS exit_code, count(e.ord) AS emitted
  FROM (SELECT DISTINCT batch_id FROM lines) b LEFT JOIN stop USING (batch_id) LEFT JOIN e USING (batch_id) GROUP BY b.batch_id, stop_at""",
    "batch_stop_point": f"""WITH {_LINES}, t AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY batch_id ORDER BY ord) AS cum FROM lines)
  SELECT batch_id, CASE WHEN min(ord) FILTER (ord > 40) = min(ord) FILTER (cum > 60000 OR ord > 40) THEN 'RECORD_LIMIT' WHEN min(ord) FILTER (cum > 60000) IS NOT NULL THEN 'INPUT_BYTES' END AS stopped FROM t GROUP BY batch_id""",
    "rag_gate_by_conversation": """WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 2 AND turn = 1 THEN text || chr(8238) ELSE text END AS text FROM conversations),
  d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text FROM c WHERE turn > 0),
  g AS (SELECT conv_id, count(*) AS n, bool_or(text LIKE '%' || chr(8238) || '%') AS held, string_agg(chr(10) || 'Document ' || i || ':' || chr(10) || text, '' ORDER BY i) AS docs FROM d GROUP BY conv_id),
  q AS (SELECT conv_id, text AS question FROM c WHERE turn = 0),
  j AS (SELECT conv_id, coalesce(n, 0) AS n, coalesce(held, false) AS held, question, question || chr(10) || chr(10) || 'Retrieved documents:' || chr(10) || coalesce(docs, '') AS prompt FROM q LEFT JOIN g USING (conv_id)),
  r AS (SELECT conv_id, prompt, CASE WHEN n > 6 OR length(question) > 3000 THEN 'BATCH_LIMIT' WHEN held THEN 'DOCUMENT_HELD' WHEN length(prompt) > 3000 THEN 'PROMPT_CHAR_LIMIT' END AS reason FROM j)
  SELECT conv_id, CASE WHEN reason IS NULL THEN 'sent' ELSE 'held' END AS status, reason, CASE WHEN reason IS NULL THEN md5(prompt) END AS prompt_md5 FROM r""",
    "tool_result_gate": "SELECT role, CASE WHEN conv_id % 3 = 1 THEN 'held' ELSE 'sent' END AS status, count(*) AS n FROM conversations GROUP BY 1, 2",
    "replay_dedupe": """WITH r AS (SELECT (doc_id // 1000)::VARCHAR AS batch_id, source, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS ord, doc_id % 40 = 9 AS bad FROM documents),
  s AS (SELECT *, min(ord) FILTER (NOT bad) OVER (PARTITION BY batch_id, source) AS first FROM r)
  SELECT batch_id, ord::INT AS record_index, CASE WHEN first < ord THEN NULL WHEN bad THEN NULL ELSE source END AS source_id, CASE WHEN first < ord THEN 'DUPLICATE_SOURCE_ID' WHEN bad THEN 'INVALID_TEXT' ELSE 'NO_FINDINGS' END AS reason FROM s""",
    "replay_summary": """WITH r AS (SELECT (doc_id // 1000)::VARCHAR AS batch_id, source, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS ord, doc_id % 40 = 9 AS bad FROM documents),
  s AS (SELECT *, min(ord) FILTER (NOT bad) OVER (PARTITION BY batch_id, source) AS first FROM r),
  e AS (SELECT batch_id, CASE WHEN first < ord OR bad THEN 'invalid_input' ELSE 'allow' END AS k FROM s)
  SELECT batch_id, CASE WHEN bool_or(k <> 'allow') THEN 'incomplete' ELSE 'replay_complete' END AS status, CASE WHEN bool_or(k <> 'allow') THEN 'INCOMPLETE_INSPECTION' END AS incomplete_reason, count(*) AS processed_records, count(*) FILTER (k = 'allow') AS allowed, count(*) FILTER (k = 'invalid_input') AS invalid FROM e GROUP BY batch_id""",
    "input_size_percentiles": "SELECT source, quantile_disc(strlen(text), 0.5)::INT AS p50, quantile_disc(strlen(text), 0.95)::INT AS p95, count(*) AS n FROM documents GROUP BY source",
    "action_vs_label_confusion": f"{BASE} SELECT toxic, count(*) FILTER (action = 'allow') AS allow, count(*) FILTER (action = 'review') AS review, count(*) FILTER (action = 'block') AS block FROM n JOIN labels USING (doc_id) GROUP BY toxic",
    "clean_documents_semi": f"{BASE} SELECT d.doc_id, d.source FROM documents d SEMI JOIN (SELECT doc_id FROM n WHERE verdict = 'clean') USING (doc_id)",
    "held_documents_anti": f"{BASE} SELECT d.doc_id, d.source FROM documents d ANTI JOIN (SELECT doc_id FROM n WHERE action = 'allow') USING (doc_id)",
    "duplicate_text_hash": "SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "cross_split_leak": "SELECT sha256(text) AS hash, count(DISTINCT doc_id % 2) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 2) > 1",
    "attack_family_misses": f"{BASE} SELECT family, count(*) AS n, count(*) FILTER (verdict <> 'malicious') AS missed FROM n JOIN inj USING (doc_id) GROUP BY family",
    "stratum_counts": f"{BASE} SELECT 'family' AS dimension, family AS value, count(*) AS n FROM inj GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM inj GROUP BY 2",
    "utf16_offsets": """WITH e AS (SELECT doc_id, repeat(chr(128512), (doc_id % 5)::INT) || text || chr(128512) || chr(8203) || 'z' AS text FROM documents)
  SELECT doc_id, (length(text) - 2)::INT AS "offset", (length(text) - 2 + doc_id % 5 + 1)::INT AS utf16 FROM e""",
    "snippet_windows": f"""{BASE}, len AS (SELECT doc_id, length(text) AS l FROM inj), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "offset") AS r FROM f) WHERE r <= 32),
  w AS (SELECT DISTINCT doc_id, unnest(range(greatest(0, "offset" - 3), least(l - 1, "offset" + 3) + 1)) AS o FROM top JOIN len USING (doc_id))
  SELECT doc_id, o::INT AS "offset" FROM w""",
    "omitted_gaps": f"""{BASE}, len AS (SELECT doc_id, length(text) AS l FROM inj), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "offset") AS r FROM f) WHERE r <= 32),
  w AS (SELECT DISTINCT doc_id, unnest(range(greatest(0, "offset" - 3), least(l - 1, "offset" + 3) + 1)) AS o FROM top JOIN len USING (doc_id)),
  g AS (SELECT doc_id, o, o - coalesce(lag(o) OVER (PARTITION BY doc_id ORDER BY o), -1) - 1 AS omitted FROM w)
  SELECT doc_id, o::INT AS "offset", omitted::INT AS omitted FROM g WHERE omitted > 0""",
    "streaming_actions": f"{BASE} SELECT action, count(*) AS n FROM n GROUP BY action",
    "sql_table_function": f"{BASE} SELECT category, count(*) AS n FROM f GROUP BY category",
    "explanations": f"""{BASE} SELECT action, count(*) AS n, sum(total)::BIGINT AS findings FROM n GROUP BY action""",
}
