"""SQL of what SQL can say about the operators: all of near duplicates, and the exact columns of others."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Sets of shingles, one class for equal ones, links by shared shingles, least class that is reachable.
NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i:i + 4], ' ')))) WHEN len(ws) > 0 THEN [hash(array_to_string(ws, ' '))] ELSE [] END AS sh FROM w),
d AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), ' ')) AS digest, sh FROM s),
c AS (SELECT digest, min(doc_id) AS rep, min(n) AS n, any_value(sh) AS sh FROM d WHERE n > 0 GROUP BY digest),
x AS (SELECT rep, n, unnest(sh) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS n_both FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * n_both >= 75 * (na + nb - n_both)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS rep, min(b) AS component FROM r GROUP BY a)
SELECT d.doc_id, d.n AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, d.doc_id = coalesce(m.component, d.doc_id) AS kept FROM d LEFT JOIN c ON d.digest = c.digest AND d.n > 0 LEFT JOIN m ON m.rep = c.rep"""

#: Sizes and targets of the mix: the level at which capped sources leave the rest.
MIX_TARGETS = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0 * sum(size) AS cap, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
t AS (SELECT sum(source_size) AS total FROM s), f AS (SELECT a.source, a.cap, a.w, sum(least(b.cap, a.cap / a.w * b.w)) AS filled FROM s a, s b GROUP BY a.source, a.cap, a.w),
r AS (SELECT (any_value(total) - coalesce(sum(cap) FILTER (filled <= total), 0)) / sum(w) FILTER (filled > total) AS rate FROM f, t)
SELECT d.doc_id, d.size::BIGINT AS size, s.source_size, round(coalesce(least(cap, rate * w), cap), 3) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, r"""

#: The edited texts of the fingerprints.
EDITED_TEXTS = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nxt FROM documents WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(nxt, 1, length(t) // 2)) AS edited_sha256 FROM d"""

#: Counts of the base spans.
BASE_SPANS = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i, list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS c, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS p FROM d)
SELECT doc_id, len(e)::BIGINT AS n_email, len(list_filter(i, lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(try_cast(y AS HUGEINT), 999) > 255)) = 0))::BIGINT AS n_ip,
len(list_filter(c, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(x)), lambda j: CASE WHEN j % 2 = 0 THEN substr(x, length(x) - j, 1)::INT ELSE 2 * substr(x, length(x) - j, 1)::INT - CASE WHEN substr(x, length(x) - j, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0))::BIGINT AS n_card,
len(list_filter(p, lambda x: length(x) BETWEEN 9 AND 15))::BIGINT AS n_phone FROM f"""

#: CRC-32 of doc_id as text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: unicode(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

#: Counts and base scores of the language model.
BASE_SCORES = f"""WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append({_WORDS}, NULL) AS ts FROM documents), k AS (SELECT doc_id, held_out, unnest(ts) AS tok FROM d),
c AS (SELECT tok, count(*) AS c FROM k WHERE NOT held_out GROUP BY tok), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT k.doc_id, k.held_out, count(*)::BIGINT AS n_tokens, count(c.c)::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (n + v + 1))), 3) AS base_score FROM k LEFT JOIN c ON k.tok IS NOT DISTINCT FROM c.tok, n GROUP BY k.doc_id, k.held_out"""
