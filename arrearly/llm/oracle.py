"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from arrearly.llm.quality_rules import RULES, STOP_WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


def _removed(pattern: str) -> str:
    return f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))"


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} ELSE 0 END"


def _fails() -> str:
    tests = []
    for r in RULES:
        outside = [f"{r.measure} < {r.least}"] * (r.least is not None)
        outside += [f"{r.measure} > {r.most}"] * (r.most is not None)
        enough = f"n_words >= {r.min_words} AND n_lines >= {r.min_lines}"
        tests.append(f"(({' OR '.join(outside)}) AND {enough})")
    return " OR ".join(tests)


_STOPS = ", ".join(f"'{f}'" for x in dict.fromkeys(STOP_WORDS) for f in (x, x.capitalize()))
_DASH = r"regexp_matches(x, '^[ ]*[-*•]')"
_DOTS = r"regexp_matches(x, '(\.\.\.|…)[ ]*$')"

OP1 = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
windows AS (SELECT r, i, list_extract(w, i) AS a, list_extract(w, i + 1) AS b,
                   list_extract(w, i + 2) AS c
            FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
repeated AS (SELECT r, i FROM windows
             QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM repeated) GROUP BY r),
counts AS (
    SELECT texts.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           {_removed('[#*$%&|<>]')} AS n_symbols, len(lines) AS n_lines,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words,
           len(list_distinct(list_filter(w, lambda x: x IN ({_STOPS})))) AS n_stop_words,
           {_removed(chr(92) + 'p{L}')} AS n_letters, {_removed(chr(92) + 'p{Lu}')} AS n_upper,
           {_removed('!')} AS n_exclamations,
           len(list_filter(lines, lambda x: {_DASH})) AS n_bullet_lines,
           len(list_filter(lines, lambda x: {_DOTS})) AS n_ellipsis_lines
    FROM texts LEFT JOIN covered USING (r)),
measures AS (
    SELECT *, {_share('word_chars', 'n_words')} AS mean_word_length,
           {_share('n_symbols', 'n_words')} AS symbol_ratio,
           {_share('n_exclamations', 'n_words')} AS exclamation_ratio,
           {_share('n_letters', 'word_chars')} AS letter_ratio,
           {_share('n_upper', 'word_chars')} AS upper_ratio,
           {_share('n_dup_lines', 'n_lines')} AS dup_line_ratio,
           {_share('n_bullet_lines', 'n_lines')} AS bullet_line_ratio,
           {_share('n_ellipsis_lines', 'n_lines')} AS ellipsis_line_ratio,
           {_share('n_repeat_words', 'n_words')} AS repeat_ratio,
           (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed
    FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {_fails()}) AS kept
FROM measures"""

_HEX = "sha1(coalesce(html, ''))"
_FIVE = "CAST('0x' || substr(h, 5 * i + 1, 5) AS INTEGER)"
_FOUR = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_FIVE} >> {s}) & 31) + 1, 1)"
    for s in (15, 10, 5, 0)
)
OP7 = f"""
WITH stored AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
           array_to_string(list_transform(range(8), lambda i: {_FOUR}), '') AS payload_digest
    FROM (SELECT *, {_HEX} AS h FROM pages)),
first AS (SELECT payload_digest, min(page_id) AS first_id FROM stored GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END
           AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM stored JOIN first USING (payload_digest)"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP9 = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id,
                      regexp_extract_all({_lower('text')}, '{_WORD}') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item,
                 regexp_extract_all({_lower('text')}, '{_WORD}') AS w FROM benchmark),
sized AS (SELECT *, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
                 FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
doc_windows AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
                FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
                      FROM texts, (SELECT DISTINCT n FROM sized))),
hits AS (SELECT r, n, i, item FROM doc_windows JOIN item_windows USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit
          FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items,
                 string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""

ORACLE_SQL = {
    "op1_quality_rules": OP1,
    "op7_warc_round_trip": OP7,
    "op9_benchmark_decontamination": OP9,
}
