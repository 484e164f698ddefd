"""The corpus queries in SQL, where SQL can express them.

The fitted fields (op1, op4), the neural scores (op6), the classifier (op7), edit-distance classes
(op5), XXH64 fingerprints (op8) and the secret network (op12) have no SQL form.
"""

from __future__ import annotations

#: Fixed patterns: words between blanks, and line rules as in the operators.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LINE_WORDS = r"len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))"
_STRIPPED = r"regexp_replace({}, '[\x20\x09-\x0D]', '', 'g')"

OP2 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  trim(coalesce(url, '')) AS url FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least,
  list_reverse(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.')) AS labels,
  string_split(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#')[1] AS rest FROM p),
k AS (SELECT *, lower(array_to_string(labels, ',') || ')' || CASE WHEN rest = '' OR rest[1] = '?' THEN '/' ELSE '' END
  || CASE WHEN rest[-1] = '?' THEN rest[:-2] ELSE rest END) AS urlkey,
  strftime(make_timestamp((946684800 + coalesce(page_id, 0) % 700000000) * 1000000), '%Y%m%d%H%M%S') AS capture_time FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to, urlkey, capture_time,
  row_number() OVER (ORDER BY urlkey, capture_time, page_id NULLS LAST) AS place FROM k
"""

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY r),
l AS (SELECT r, xs[i] AS x, xs[i + 1] AS following FROM
  (SELECT r, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT r, string_split(text, chr(10)) AS xs FROM d))),
lines AS (SELECT r, x, following, length({_STRIPPED.format('x')}) AS chars, {_LINE_WORDS} AS n FROM l),
judged AS (SELECT *, (regexp_matches(x, '[.!?\x{{2026}}:;]["''\x{{201D}}\x{{2019}}\x{{00BB}})\]]*[\x20\x09-\x0D]*\z') OR n > 12 OR (length(x) >= 40
    AND coalesce((length(following) >= 40 OR regexp_matches(following, '[.!?\x{{2026}}:;]["''\x{{201D}}\x{{2019}}\x{{00BB}})\]]*[\x20\x09-\x0D]*\z')) AND length({_STRIPPED.format('following')}) > 0, false)))
  AND len(regexp_extract_all(x, '(?:[#*$%&|<>]|!!|\?\?)[.,]?(?:[\x20\x09-\x0D]|\z)')) <= n * 0.30::DOUBLE
  AND len(regexp_extract_all(x, '[|›»•·>]')) * 3 < n
  AND NOT regexp_matches(x, '(?i)javascript|cookie|all rights reserved|terms of (use|service)|privacy policy|sign (in|up)|log ?in|click here|read more|subscribe|share (this|on)|skip to (main )?content|lorem ipsum|powered by') AS good
  FROM lines WHERE chars > 0),
s AS (SELECT r, count(*) - count(DISTINCT x) AS dups, coalesce(sum(chars) FILTER (good), 0) AS stays FROM judged GROUP BY r),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length({_STRIPPED.format('text')})::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
  coalesce(hit.n, 0)::BIGINT AS n_repeat_words, coalesce(stays, 0) AS stays FROM d LEFT JOIN hit USING (r) LEFT JOIN s USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(1 - stays::DOUBLE / nullif(word_chars, 0), 0) <= 0.5 AS kept FROM f
"""

_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_ITEM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS run FROM
  (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS run FROM
  (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT r, s, n, item FROM runs JOIN win USING (n, run)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM met)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""


def _place(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8))::BIGINT"


_WEIGHTS = "list_transform(ts, lambda t: pow(t / list_max(ts), {a}) / list_sum(list_transform(ts, lambda u: pow(u / list_max(ts), {a}))))"


def _flat(a: str) -> str:
    w = _WEIGHTS.format(a=a)
    entropy = f"list_sum(list_transform({w}, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0 END))"
    most = f"list_max(list_transform(range(1, len(ts) + 1), lambda i: ({w})[i] * list_sum(ts) / ts[i]))"
    return f"({entropy} > 0.97 * ln(len(ts)) OR {most} > 4.0)"


OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '~') AS source, coalesce(text, '') AS text, len({_WORDS})::BIGINT AS n_tokens,
  md5(coalesce(text, '')) AS t FROM documents),
e AS (SELECT *, {_place("'doc'", "source", "coalesce(doc_id::VARCHAR, '')", "t")} AS spot FROM d),
sizes AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0),
one AS (SELECT list(source ORDER BY source) AS names, list(tokens::DOUBLE ORDER BY source) AS ts FROM sizes),
halves AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, ts FROM one UNION ALL
  SELECT step + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END, ts
  FROM (SELECT *, (lo + hi) / 2 AS mid, {_flat("((lo + hi) / 2)")} AS flat FROM halves WHERE step < 40)),
solved AS (SELECT CASE WHEN NOT {_flat("0.0")} THEN 0.0 ELSE round(hi, 9) END AS alpha, ts, names FROM halves JOIN one USING (ts) WHERE step = 40),
v AS (SELECT names[i] AS source, alpha, round(({_WEIGHTS.format(a='alpha')})[i], 9) AS weight, list_sum(ts) AS total, ts[i]::BIGINT AS tokens
  FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM solved)),
w AS (SELECT source, alpha, weight, tokens, floor(weight * total)::BIGINT AS budget, (tokens + 19999) // 20000 AS blocks,
  ((tokens + 19999) // 20000 + 199) // 200 AS groups FROM v),
p AS (SELECT e.*, alpha, weight, tokens, budget, groups, CASE WHEN blocks IS NULL THEN 0 ELSE spot % blocks END AS block FROM e LEFT JOIN w USING (source)),
b AS (SELECT source, block, groups, block % groups AS grp, sum(n_tokens)::BIGINT AS size FROM p WHERE n_tokens > 0 GROUP BY ALL),
g AS (SELECT source, grp, sum(size) AS size FROM b GROUP BY ALL),
g2 AS (SELECT source, grp, sum(size) OVER (PARTITION BY source ORDER BY {_place("'group'", "source", "grp::VARCHAR")}, grp) - size AS first FROM g),
b2 AS (SELECT source, block, first + sum(size) OVER (PARTITION BY source, grp ORDER BY {_place("'block'", "source", "block::VARCHAR")}, block) - size AS start
  FROM b JOIN g2 USING (source, grp)),
o AS (SELECT p.*, sum(n_tokens) OVER (PARTITION BY source, block ORDER BY spot, doc_id, t ROWS UNBOUNDED PRECEDING) - n_tokens AS within FROM p)
SELECT doc_id, o.source, n_tokens, coalesce(alpha, 1.0)::DOUBLE AS alpha, coalesce(weight, 0.0)::DOUBLE AS weight, o.block::BIGINT AS block,
  coalesce(budget // tokens + CASE WHEN n_tokens > 0 AND start + within < budget - budget // tokens * tokens THEN 1 ELSE 0 END, 0)::BIGINT AS copies
FROM o LEFT JOIN b2 ON o.source = b2.source AND o.block = b2.block
"""

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
inside AS (
  SELECT lang, part, max(a) AS longest
  FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM cand WHERE k = 3) GROUP BY lang, part),
kept AS (SELECT c.* FROM cand c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.part WHERE longest IS NULL OR 100 * longest < 50 * a),
cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, c, x.n AS l, y.n AS r,
    (1000000::HUGEINT * a * a // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS place FROM scored)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n, score
  FROM best JOIN total USING (lang) WHERE place = 1)
WHERE rank <= 2000
"""

OP13 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
asked AS (
  SELECT row_number() OVER () AS item_row, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
query AS (SELECT item_row, item_id, term, count(*) AS repeats FROM (SELECT item_row, item_id, unnest(terms) AS term FROM asked) GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM texts WHERE len(terms) > 0),
posting AS (
  SELECT row, doc_id, term, count(*) AS tf, any_value(n) AS n
  FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM texts) WHERE term IN (SELECT term FROM query) GROUP BY row, doc_id, term),
weighted AS (
  SELECT term, floor(1000 * ln((2.0 * any_value(n_docs) + 2) / (2.0 * count(*) + 1)))::BIGINT AS w
  FROM posting, total GROUP BY term),
scored AS (
  SELECT item_row, item_id, row, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM query JOIN weighted USING (term) JOIN posting USING (term), total GROUP BY item_row, item_id, row, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
WHERE rank <= 20
"""

ORACLE: dict[str, str] = {
    "op2_warc_merge": OP2, "op3_line_quality": OP3, "op9_winnow_decontaminate": OP9, "op10_temperature_mix": OP10,
    "op11_debruijn_collocations": OP11,
    "op13_best_position_search": OP13,
}
