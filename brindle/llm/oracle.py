"""What SQL can say of the operators' results, independently of how they are computed."""

from __future__ import annotations

from brindle.llm.license_scan import PHRASES, TEMPLATES
from brindle.llm.quality_rules import RULES, STOP_WORDS, SYMBOLS

WORD = r"[^\x20\x09-\x0D]+"
_quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def _warc() -> str:
    """Base 32 of a digest: its bits in groups of five."""
    bits = "list_reduce(list_transform(range(1, 41), lambda k: lpad(bin(instr('0123456789abcdef', substr(h, k, 1)) - 1), 4, '0')), lambda a, b: a || b)"
    base = "list_reduce(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: CAST(substr(b, 5 * k + j, 1) AS INTEGER) * CAST(pow(2, 5 - j) AS INTEGER)))::INTEGER, 1)), lambda a, c: a || c)"
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
    e AS (SELECT *, {bits} AS b FROM d)
    SELECT page_id, payload_bytes, {base} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
    FROM e"""


def _substring(n: int = 20) -> str:
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
    w AS (SELECT doc_id, k, array_to_string(ws[k:k + {n - 1}], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS k FROM d WHERE len(ws) >= {n})),
    again AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS r FROM w) WHERE r > 1),
    gone AS (SELECT DISTINCT doc_id, k + j AS p FROM again, range({n}) t(j)),
    words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
    kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY 1)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def _license(threshold: float = 0.9) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = lambda c: f"regexp_extract_all(translate({c}, '{upper}', '{lower}'), '{word}')"
    templates = ", ".join(f"({k}, '{label}', '" + t.replace("'", "''") + "')" for k, (label, t) in enumerate(TEMPLATES))
    phrases = ", ".join("('" + "', '".join((p.split() + [""])[:3] + [label]) + f"', {len(p.split())})" for p, label in PHRASES.items())
    return f"""
    WITH d AS (SELECT doc_id, {split("coalesce(text, '')")} AS ws FROM documents),
    phrase(a, b, c, label, n) AS (VALUES {phrases}),
    base AS (SELECT doc_id, k - 1 AS place, label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM d) JOIN phrase ON ws[k] = a AND ws[k + 1] = b AND (n = 2 OR ws[k + 2] = c)),
    template AS (SELECT t, label, unnest(list_distinct({split("s")})) AS word, len(list_distinct({split("s")})) AS size FROM (VALUES {templates}) v(t, label, s)),
    line AS (SELECT doc_id, l, list_distinct({split("x")}) AS ws FROM (SELECT doc_id, unnest(range(len(xs))) AS l, unnest(xs) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents WHERE text IS NOT NULL))),
    cell AS (SELECT doc_id, l, unnest(ws) AS word FROM line),
    hit AS (SELECT doc_id, l, t, any_value(label) AS label, count(*) / any_value(size) AS part FROM cell JOIN template USING (word) GROUP BY doc_id, l, t HAVING count(*) >= ceil({threshold} * any_value(size) - 1e-9)),
    named AS (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM hit),
    b AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, array_to_string(list_sort(list_distinct(list(label))), ',') AS own FROM base GROUP BY doc_id),
    h AS (SELECT doc_id, max(part) AS part FROM hit GROUP BY doc_id),
    n AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS every FROM named GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
           coalesce(own, '') AS base_labels, coalesce(every, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0)::DOUBLE END AS score
    FROM d LEFT JOIN b USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)"""


def _quality() -> str:
    ratio = {
        "symbols_per_word": "n_symbols / n_words",
        "mean_word_chars": "word_chars / n_words",
        "dup_line_ratio": "n_dup_lines / n_lines",
        "stop_word_ratio": "n_stop / n_words",
        "upper_ratio": "n_upper / word_chars",
    }
    fails = []
    for r in RULES:
        value = f"coalesce(CASE WHEN isfinite({ratio[r.measure]}) THEN {ratio[r.measure]} END, 0)"
        fails += [f"{value} < {r.least}"] * (r.least is not None) + [f"{value} > {r.most}"] * (r.most is not None)
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    l AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    win AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, ws[k], ws[k + 1], ws[k + 2]) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM l WHERE len(ws) >= 3)),
    rep AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM win, range(3) g(j) WHERE n > 1 GROUP BY doc_id),
    m AS (SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                 CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(ws, lambda w: lower(w) IN ({_quoted(sorted(set(STOP_WORDS)))}))) AS n_stop, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
          FROM l LEFT JOIN rep ON rep.doc_id = l.doc_id),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {" OR ".join(fails)} AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT failed AS kept FROM f"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _warc(), "op2_substring_dedup": _substring(), "op4_license_scan": _license(), "op10_quality_rules": _quality()}
