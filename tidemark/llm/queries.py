"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversations, decontaminate, filter_audit, frequent_lines, language, lines, long_matches, packing, pii, simhash, toxicity, url_rules, vector_links
from tidemark.llm.common import LOWER, UPPER, read

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


#: Host, path and verdict of each rule.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(read(spark, sf_dir, "pages"), rules)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER).drop("ids")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_long_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = long_matches.without_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "spans")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.near_duplicates(read(spark, sf_dir, "embeddings"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x.kind == kind)).cast("long")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read(spark, sf_dir, "documents"))
    counts = [_count(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.repaired_blocks(read(spark, sf_dir, "conversations")))


def op13_frequent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frequent_lines.without_frequent_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
found AS (SELECT doc_id, item_id, pos, n FROM places JOIN windows USING (n, phrase)),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit
         FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM found) GROUP BY doc_id),
kinds AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN kinds USING (doc_id)
"""

_PLAIN = f"trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[ \\t\\r\\f\\v]+', ' ', 'g'), ' ')"

LINES_SQL = f"""
WITH parted AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, parts, unnest(range(len(parts))) AS unit FROM parted),
placed AS (
  SELECT doc_id, unit, parts[unit + 1] AS line,
    CAST(coalesce(list_sum(list_transform(parts[1:unit], lambda x: length(x) + 1)), 0) AS INTEGER) AS start
  FROM numbered
),
plain AS (SELECT *, {_PLAIN} AS norm FROM placed),
texts AS (
  SELECT doc_id, CAST(unit AS INTEGER) AS unit, start, CAST(start + length(line) AS INTEGER) AS "end", norm,
    len(string_split(norm, ' ')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS place,
    unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS paragraph
  FROM plain WHERE norm <> ''
),
units AS (
  SELECT doc_id, 'line' AS kind, unit, 1 AS lines, start, "end", place, place AS final, w AS n_words, norm FROM texts
  UNION ALL
  SELECT doc_id, 'paragraph', min(unit), CAST(count(*) AS INTEGER), min(start), max("end"), min(place), max(place), sum(w), string_agg(norm, ' ' ORDER BY unit)
  FROM texts GROUP BY doc_id, paragraph HAVING count(*) > 1
),
ranked AS (
  SELECT *, first_value(doc_id) OVER earliest AS kept_doc_id, first_value(start) OVER earliest AS kept_start
  FROM units WINDOW earliest AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, start)
),
gone AS (SELECT * FROM ranked WHERE doc_id <> kept_doc_id OR start <> kept_start),
runs AS (
  SELECT doc_id, place, w, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM texts t
  WHERE EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = t.doc_id AND t.place BETWEEN g.place AND g.final)
),
stretches AS (SELECT doc_id, place, sum(w) OVER (PARTITION BY doc_id, run) AS words FROM runs)
SELECT doc_id, kind, unit, lines, start, "end", kept_doc_id, kept_start, CAST(n_words AS BIGINT) AS n_words,
  CAST(words AS BIGINT) AS stretch_words, CAST(longest AS BIGINT) AS longest_words
FROM gone JOIN stretches USING (doc_id, place) JOIN (SELECT doc_id, max(words) AS longest FROM stretches GROUP BY doc_id) USING (doc_id)
"""

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

URL_SQL = f"""
WITH urls AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fits USING (page_id)
"""

AUDIT_SQL = f"""
WITH facts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
),
marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INTEGER)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS mask
  FROM facts LEFT JOIN marks USING (doc_id)
),
sums AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, mask),
letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps AS (
  SELECT filter_order, step, bit, (SELECT coalesce(sum(p.bit), 0) FROM letters p WHERE strpos(filter_order, p.f) < step) AS before
  FROM orders, range(1, 6) AS s(step), letters WHERE f = filter_order[step]
),
done AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
    sum(n) FILTER (mask & (before | bit) = 0) AS kept,
    sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
    sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost,
    sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
  FROM sums, (SELECT filter_order, step, bit, CAST(before AS INTEGER) AS before FROM steps) GROUP BY ALL
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM done
"""

_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

#: From each grammar state: state after a kept row with that initial, and after the next row.
_KEPT = {"su": "CASE initial WHEN 's' THEN f1 WHEN 'u' THEN f2 END", "u": "CASE initial WHEN 'u' THEN f2 END", "a": "CASE initial WHEN 'a' THEN f3 END"}


def _row_edits(state: int, kept: str, after: int) -> str:
    """Cheapest of delete, keep and rerole from the state: cost in nine digits, then the edits."""
    add = lambda f, cost, edit: f"(lpad(CAST(CAST({f}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{edit}' || {f}[10:])"
    stays = f"CASE WHEN must_go THEN NULL ELSE least({add(f'({kept})', 'cut', 'K')}, {add(f'f{after}', '3 + cut', 'R')}) END"
    return f"least({add(f'f{state}', 4, 'D')}, {stays})"


def _insert(f: str) -> str:
    return f"(lpad(CAST(CAST({f}[1:9] AS BIGINT) + 3 AS VARCHAR), 9, '0') || 'I' || {f}[10:])"


CONVERSATIONS_SQL = f"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place
  FROM conversations
),
bits(place, crc, rest) AS (
  SELECT DISTINCT place, CAST(4294967295 AS BIGINT), place FROM marked
  UNION ALL
  SELECT place, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(crc, CAST(ascii(rest[1]) AS BIGINT))), rest[2:]
  FROM bits WHERE rest <> ''
),
kinds AS (SELECT place, xor(crc, 4294967295) % 20 AS kind FROM bits WHERE rest = ''),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM marked JOIN kinds USING (place), range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM hurt),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, role[1] AS initial,
    trim(text, {_BLANKS}) AS core, lead(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS following
  FROM placed
),
faults AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(core, '[.!?]$') THEN 'truncated' END AS fault FROM seen
),
symbols AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS must_go, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM faults),
backward AS (
  SELECT conv_id, max(n) + 1 AS i, '000000000' AS f0, '000000006II' AS f1, '000000003I' AS f2, '000000000' AS f3 FROM symbols GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(p0, {_insert("g2")}), least(p1, {_insert("g2")}), g2, g3 FROM (
    SELECT *, least(p2, {_insert("p3")}) AS g2, least(p3, {_insert("p2")}) AS g3 FROM (
      SELECT b.conv_id, s.i, {_row_edits(0, _KEPT["su"], 2)} AS p0, {_row_edits(1, _KEPT["u"], 2)} AS p1,
        {_row_edits(2, _KEPT["a"], 3)} AS p2, {_row_edits(3, _KEPT["u"], 2)} AS p3
      FROM backward b JOIN symbols s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i - 1
    )
  )
),
plans AS (SELECT conv_id, CAST(f0[1:9] AS BIGINT) AS cost, f0[10:] AS audit FROM backward WHERE i = 1),
edits AS (SELECT conv_id, audit, k, audit[k] AS edit, length(replace(audit[1:k], 'I', '')) AS i FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM plans)),
kept AS (
  SELECT e.*, s.role, s.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY k) AS spot,
    max(CASE WHEN edit = 'K' AND s.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN symbols s ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND s.i = e.i WHERE edit <> 'D'
),
repaired AS (
  SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role ELSE CASE WHEN (spot - led) % 2 = 1 THEN 'user' ELSE 'assistant' END END
    || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole
  FROM kept GROUP BY conv_id
),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i < n AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal
  FROM symbols GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN figures f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN plans p ON c.conv_id IS NOT DISTINCT FROM p.conv_id
LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""

FREQUENT_SQL = f"""
WITH parted AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS unit FROM parted),
keyed AS (SELECT doc_id, unit, parts[unit] AS line, translate(trim(parts[unit], {_BLANKS}), '{UPPER}', '{LOWER}') AS key FROM numbered),
often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY unit) FILTER (last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (key) GROUP BY doc_id
"""

QUERIES = {
    "op1_lines": op1_lines,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_rules": op3_url_rules,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_long_matches": op6_long_matches,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_vectors": op9_vectors,
    "op10_pii": op10_pii,
    "op11_filter_audit": op11_filter_audit,
    "op12_conversations": op12_conversations,
    "op13_frequent_lines": op13_frequent_lines,
}

ORACLES: dict[str, str] = {
    "op1_lines": LINES_SQL,
    "op2_decontaminate": DECONTAMINATE_SQL,
    "op3_url_rules": URL_SQL,
    "op11_filter_audit": AUDIT_SQL,
    "op12_conversations": CONVERSATIONS_SQL,
    "op13_frequent_lines": FREQUENT_SQL,
}
