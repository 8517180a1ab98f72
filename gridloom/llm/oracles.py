"""SQL for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

from gridloom.llm import lexical_search, licenses, line_dedup, urls


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def license_scan() -> str:
    phrases = ", ".join(f"({_quoted(p)}, string_split({_quoted(p)}, ' '), {_quoted(label)})" for p, label in licenses.BASE_PHRASES.items())
    rows, sets = [], [(licenses.class_of(len(t.split())), set(t.split())) for t in licenses.TEMPLATES]
    for k, ((c, _), (t, label)) in enumerate(zip(sets, licenses.TEMPLATES.items(), strict=True)):
        rows.append(f"({k}, {_quoted(label)}, {c}, list_distinct(string_split({_quoted(t)}, ' ')))")
    against = ", ".join(f"({k}, {j})" for k, found in licenses.rivals(sets, licenses.THRESHOLD).items() for j in found)
    return f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
phrases(p, pw, label) AS (VALUES {phrases}), templates(k, label, c, ts) AS (VALUES {', '.join(rows)}), rivals(k, j) AS (VALUES {against}),
base AS (SELECT r, i - 1 AS place, label FROM (SELECT r, ws, label, pw, p, unnest(range(1, len(ws) + 1)) AS i FROM w, phrases WHERE list_has_all(ws, pw)) WHERE array_to_string(list_slice(ws, i, i + len(pw) - 1), ' ') = p),
b AS (SELECT r, count(*) AS n, min(place) AS lo, max(place) AS hi, list_sort(list(DISTINCT label)) AS ls FROM base GROUP BY r),
able AS (SELECT r, ws, k, label, c, ts FROM w, templates WHERE len(list_intersect(list_distinct(ws), ts)) >= {licenses.THRESHOLD} * len(ts)),
hit AS (SELECT *, len(ts) AS z, len(list_intersect(list_distinct(said), ts)) / len(ts)::DOUBLE AS s FROM (SELECT *, list_slice(ws, i, i + 2 * c - 1) AS said FROM (SELECT *, unnest(range(1, len(ws) + 1, c)) AS i FROM able))),
beaten AS (SELECT DISTINCT a.r, a.k, a.i FROM hit a JOIN rivals USING (k) JOIN hit o ON o.r = a.r AND o.i = a.i AND o.k = j WHERE (o.s > a.s OR (o.s = a.s AND o.z > a.z)) AND o.s >= {licenses.THRESHOLD}
 AND len(list_filter(a.ts, lambda x: len(list_filter(a.said, lambda y: y = x)) > CASE WHEN list_contains(o.ts, x) THEN 1 ELSE 0 END)) < {licenses.THRESHOLD} * len(a.ts)),
m AS (SELECT r, list(DISTINCT label) AS ls, max(s) AS s FROM hit ANTI JOIN beaten USING (r, k, i) WHERE s >= {licenses.THRESHOLD} GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(b.n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(array_to_string(b.ls, ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(m.ls, [])))), ','), '') AS labels, greatest(coalesce(m.s, 0.0::DOUBLE), CASE WHEN b.n > 0 THEN 1.0 ELSE 0.0 END) AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""


_SAID = "'<|im_end|><|im_start|>assistant ok'"
_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID}),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
 sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + length('<|im_start|>') + 1 + length('<|im_end|>') + 1) AS n FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM g"""


def url_filter() -> str:
    rules = ", ".join(
        f"({rank}, {_quoted(r)}, {_quoted(v)}, {_quoted(r.split('/', 1)[0])}, {_quoted(r[r.index('/'):])})" for rank, listed in ((1, urls.BASE_RULES), (0, urls.OWN_RULES)) for r, v in listed
    )
    return f"""WITH rules(rank, rule, v, h, p) AS (VALUES {rules}),
t AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
u AS (SELECT r, page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
best AS (SELECT r, max((rank, length(rule), rule, v)) AS b FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, CASE WHEN b[1] = 1 THEN b[3] END AS rule, coalesce(b[4], 'allow') AS verdict FROM u LEFT JOIN best USING (r)"""


_NOISE = r"#$%&*@^~|<>{}[]\_="
#: The targets are found by filling sources in turn; keys are ordered in one window a source here.
MIX = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
k AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER o AS place
 FROM k WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST)),
level AS (SELECT arg_min((total - filled) / rest, place) AS level FROM f WHERE 3 * source_size >= (total - filled) / rest * w),
g AS (SELECT source, source_size, round(coalesce(least(3 * source_size, level * w), 3 * source_size), 6) AS target FROM f LEFT JOIN level ON true),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM g),
q AS (SELECT r, doc_id, d.source, size, source_size, target, epochs, floor(target - epochs * source_size) AS left_over,
 -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/' || coalesce(d.source, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
 / coalesce(greatest(0.1, 1 - 8 * ((length(text) - length(translate(text, {_quoted(_NOISE)}, ''))) / greatest(length(text), 1)::DOUBLE)) * least(1.0, 0.5 + size / 100.0::DOUBLE), 0.05) AS key
 FROM d JOIN h ON h.source IS NOT DISTINCT FROM d.source),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM q)
SELECT doc_id, source, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(epochs * size + greatest(0, least(size, left_over - sofar)) AS BIGINT) AS taken FROM c"""

_BLANK = " || ".join(f"chr({ord(c)})" for c in line_dedup.BLANK)
LINES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, line, translate(trim(line, {_BLANK}), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key FROM (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= {line_dedup.LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.LEAST_DOCS}),
m AS (SELECT r, any_value(l.doc_id) AS doc_id, i, any_value(line) AS line, bool_or(last IS NOT NULL AND l.doc_id IS DISTINCT FROM last) AS gone FROM l LEFT JOIN k USING (key) GROUP BY r, i)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents), i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ws FROM benchmark),
g AS (SELECT count(*) FILTER (len(ws) > 0) AS big_n, CAST(sum(len(ws)) AS BIGINT) AS big_l FROM d),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS t FROM d) GROUP BY ALL),
v AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, g GROUP BY t),
a AS (SELECT q, item_id, t, count(*) AS c FROM (SELECT q, item_id, unnest(ws) AS t FROM i) GROUP BY ALL),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score FROM a JOIN v USING (t) JOIN p USING (t), g GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= {lexical_search.TOP}"""

ORACLES = {
    "op3_license_scan": license_scan(),
    "op4_chat_format": CHAT,
    "op5_url_filter": url_filter(),
    "op6_mix_sources": MIX,
    "op11_line_dedup": LINES,
    "op12_lexical_search": SEARCH,
}
