"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from pitgrid.llm.rules import BITS, MEASURES, PRIOR, SPREAD

#: A base32 digit is 5 bits, so five hex digits hold four of them.
WARC = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""

_bucket = lambda v: f"(CASE WHEN {v} < {1 << BITS} THEN {v} ELSE ({v} >> CAST(length(bin({v})) - {BITS} AS INTEGER)) << CAST(length(bin({v})) - {BITS} AS INTEGER) END)"
_long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {_bucket('m_' + m)} AS bucket FROM m WHERE n_words >= 10" for m in MEASURES)
_slack = " ".join(f"WHEN '{m}' THEN {n}" for m, n in MEASURES.items())
_drawn = lambda m: f"(o.docs * o.t_{m} + {PRIOR} * ((l.docs * l.t_{m} + {PRIOR} * g.t_{m}) // (l.docs + {PRIOR}))) // (o.docs + {PRIOR})"
_fits = " AND ".join(f"coalesce({_bucket('m.m_' + m)} <= {_drawn(m)}, true)" for m in MEASURES)
RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, sum(least(5, coalesce(next - i, 5))) AS n FROM twice GROUP BY r),
c AS (SELECT r, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x))) AS capitals FROM w LEFT JOIN rep USING (r)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS m_symbols, CASE WHEN n_words > 0 THEN 1000 * capitals // n_words ELSE 0 END AS m_capitals,
  CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS m_repeated_lines, CASE WHEN n_words > 0 THEN 10 * word_chars // n_words ELSE 0 END AS m_word_length FROM c),
long AS ({_long}),
levels AS (SELECT 0 AS level, lang, source, measure, bucket FROM long UNION ALL SELECT 1, lang, NULL, measure, bucket FROM long UNION ALL SELECT 2, NULL, NULL, measure, bucket FROM long),
q AS (SELECT level, lang, source, measure, count(*) AS docs, quantile_disc(bucket, 0.5) AS q50, quantile_disc(bucket, 0.1) AS q10 FROM levels GROUP BY ALL),
t AS (SELECT level, lang, source, max(docs) AS docs, {', '.join(f"max(q50 + {SPREAD} * (q50 - q10) + CASE measure {_slack} END) FILTER (measure = '{m}') AS t_{m}" for m in MEASURES)} FROM q GROUP BY level, lang, source)
SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, NOT m.base_failed AND {_fits} AS kept
FROM m LEFT JOIN t o ON o.level = 0 AND o.lang IS NOT DISTINCT FROM m.lang AND o.source IS NOT DISTINCT FROM m.source
LEFT JOIN t l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM m.lang LEFT JOIN t g ON g.level = 2
"""

_lower = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format  # noqa: UP032
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all({_lower('text')}, '{_TERM}') AS ts FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_lower('text')}, '{_TERM}')) AS t FROM (SELECT CAST(item_id AS BIGINT) AS item_id, text FROM benchmark)),
p AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY t), s),
c AS (SELECT p.r, p.t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * CAST(len(ts) AS BIGINT) * docs) // l))) AS c FROM p JOIN w USING (t) JOIN d USING (r), s),
g AS (SELECT item_id, r, CAST(sum(c) AS BIGINT) AS score FROM q JOIN c USING (t) GROUP BY item_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM g JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""

_grams = " UNION ALL ".join(f"SELECT lang, {k} AS size, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM p WHERE len(ws) >= {k})" for k in range(1, 6))
COLLOCATIONS = f"""
WITH x AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_lower('text')}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda v: v <> '') AS ws FROM x),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, size, phrase, CAST(count(*) AS BIGINT) AS a FROM ({_grams}) GROUP BY ALL HAVING count(*) >= 100),
b AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
inner_ AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(ws[1:size - 1], ' '), array_to_string(ws[2:size], ' ')]) AS phrase FROM b WHERE size > 2) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.most IS NULL OR 100 * i.most < 100 * b.a),
c AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS front, array_to_string(ws[k + 1:size], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM o)),
z AS (SELECT c.lang, c.phrase, c.a, c.k, y.a AS l, e.a AS r, n.n, (CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(y.a AS HUGEINT) * e.a) AS score
  FROM c JOIN f y ON y.lang = c.lang AND y.phrase = c.front JOIN f e ON e.lang = c.lang AND e.phrase = c.rest JOIN n ON n.lang = c.lang),
m AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM t WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op9_warc": WARC, "op10_quality_rules": RULES, "op11_ranked_search": SEARCH, "op12_collocations": COLLOCATIONS}
