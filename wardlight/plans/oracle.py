"""The registered queries again, as plain SQL over the driver's tables.

Written from the meaning of each operator, not from its Spark code. `{name}` of another
building block in a body makes it a common table expression.
"""

from __future__ import annotations

import re

from wardlight import fixed
from wardlight.functions.text import BLANKS
from wardlight.plans.roles import LEXICON, PLANTED, PREFIXES, SUFFIXES

_TRIM = "'" + BLANKS + "'"
_RUN = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in BLANKS) + "]+"
_EDGE_L, _EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_ACTIVITY = ("CASE event_type WHEN 'signup' THEN 'Logon' WHEN 'error' THEN 'Logoff' "
             "WHEN 'click' THEN 'Connect' WHEN 'view' THEN 'Disconnect' ELSE 'File Write' END")
_DAY30 = "CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE)"


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values, index: str) -> str:
    return f"{quoted(values)}[CAST({index} % {len(values)} AS INTEGER) + 1]"


def matches(text: str, patterns) -> str:
    """OR of regular expressions; word boundaries are spelled out with Unicode classes."""
    loose, words = [], []
    for pattern in patterns:
        for alt in pattern.split("|"):
            body = alt.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\d", r"\p{Nd}")
            whole = body.startswith(r"\b") and body.endswith(r"\b")
            (words if whole else loose).append(body[2:-2] if whole else body)
    parts = loose + ([f"{_EDGE_L}(?:{'|'.join(words)}){_EDGE_R}"] if words else [])
    return f"regexp_matches({text}, '{'|'.join(parts)}')"


def keyword(text: str, rules) -> str:
    tiers = sorted({t for t, _ in rules}, reverse=True)
    whens = " ".join(f"WHEN {matches(f'lower({text})', [p for t, p in rules if t == tier])} THEN {tier}"
                     for tier in tiers)
    return f"(CASE {whens} ELSE 0 END)"


def extension(name: str) -> str:
    ext = f"regexp_extract(lower({name}), '{fixed.EXTENSION_PATTERN}', 1)"
    whens = " ".join(f"WHEN '{e}' THEN {t}" for e, t in fixed.EXTENSION_TIERS.items())
    return f"(CASE {ext} {whens} ELSE {fixed.EXTENSION_DEFAULT} END)"


def signature(content: str) -> str:
    hits = {3: [], 2: []}
    for prefix, tier in fixed.SIGNATURE_TIERS.items():
        hits[tier].append(f"starts_with({content}, '{prefix}')")
    return f"(CASE WHEN {' OR '.join(hits[3])} THEN 3 WHEN {' OR '.join(hits[2])} THEN 2 ELSE 0 END)"


def file_score(ext: str, other: str) -> str:
    base = f"greatest({ext}, {other})"
    return (f"(CASE WHEN to_removable_media = 1 AND is_write = 1 AND {ext} >= 3 THEN 3 "
            f"WHEN to_removable_media = 1 AND is_write = 1 THEN greatest({base}, 2) "
            f"WHEN to_removable_media = 1 OR from_removable_media = 1 THEN greatest({base}, 1) ELSE {base} END)")


def items(text: str) -> str:
    return f"CAST(coalesce(len(list_filter(string_split({text}, ';'), lambda x: trim(x, {_TRIM}) <> '')), 0) AS INTEGER)"


def split(user: str = '"user"', day: str = "email_day") -> str:
    pos = f"row_number() OVER (PARTITION BY {user} ORDER BY {day}) - 1"
    n = f"count(*) OVER (PARTITION BY {user})"
    return (f"CASE WHEN {pos} < floor({n} * CAST(0.7 AS DOUBLE)) THEN 'train' "
            f"WHEN {pos} < floor({n} * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END")


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


PARTS: dict[str, str] = {}

PARTS["acts"] = f"""
SELECT event_id AS id, ts AS date, user_id AS "user", regexp_extract(props, '"k": ([0-9]+)', 1) AS pc,
  {_ACTIVITY} AS activity, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour,
  CASE WHEN hour(ts) < 7 OR hour(ts) > 20 THEN 1 ELSE 0 END AS is_after_hours,
  CAST(round(value * 100) AS BIGINT) AS cents,
  CASE WHEN value > 50 THEN 1 ELSE 0 END AS to_removable_media,
  CASE WHEN value <= 10 THEN 1 ELSE 0 END AS from_removable_media FROM events"""

PARTS["mails"] = """
SELECT o_orderkey AS id, o_custkey // 10 AS "user",
  CAST(DATE '2024-01-01' + CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) % 30 AS INTEGER) AS DATE) AS email_day,
  CASE WHEN o_orderkey % 24 < 7 OR o_orderkey % 24 > 20 THEN 1 ELSE 0 END AS is_after_hours,
  o_orderpriority AS pc, round(o_totalprice * 100) AS size, coalesce(attachments, 0) AS attachments,
  coalesce(recipients, 0) AS recipients, CASE WHEN cc > 0 THEN 1 ELSE 0 END AS has_cc,
  CASE WHEN bcc > 0 THEN 1 ELSE 0 END AS has_bcc, coalesce(words, 0) AS words
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS recipients, count(*) FILTER (l_returnflag = 'A') AS cc,
  count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS bcc, count(*) FILTER (l_quantity > 40) AS attachments,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS words FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""

PARTS["email_ud"] = """
SELECT "user", email_day, count(*) AS email_count, count(DISTINCT pc) AS unique_pcs, sum(size) AS total_size,
  sum(size) / count(*) AS avg_size, CAST(sum(attachments) AS BIGINT) AS total_attachments,
  count(*) FILTER (attachments > 0) AS emails_with_attachments, CAST(sum(is_after_hours) AS BIGINT) AS after_hours_emails,
  CAST(sum(recipients) AS DOUBLE) / count(*) AS avg_recipients, max(recipients) AS max_recipients,
  CAST(sum(words) AS DOUBLE) / count(*) AS avg_content_words, max(words) AS max_content_words,
  CAST(sum(has_bcc) AS BIGINT) AS bcc_email_count, CAST(sum(has_cc) AS BIGINT) AS cc_email_count,
  count(*) FILTER (attachments > 0) / count(*) AS attachment_email_ratio,
  sum(is_after_hours) / count(*) AS after_hours_ratio, sum(has_bcc) / count(*) AS bcc_ratio
FROM {mails} GROUP BY 1, 2"""

PARTS["logon_ud"] = """
SELECT "user", day AS email_day, count(*) FILTER (activity = 'Logon') AS logon_count,
  count(*) FILTER (activity = 'Logoff') AS logoff_count,
  count(*) FILTER (activity = 'Logon' AND is_after_hours = 1) AS after_hours_logons,
  count(DISTINCT pc) AS unique_logon_pcs
FROM {acts} WHERE activity IN ('Logon', 'Logoff') GROUP BY 1, 2"""

PARTS["device_ud"] = """
SELECT "user", day AS email_day, count(*) FILTER (activity = 'Connect') AS usb_connect_count,
  count(*) FILTER (activity = 'Disconnect') AS usb_disconnect_count
FROM {acts} WHERE activity IN ('Connect', 'Disconnect') GROUP BY 1, 2"""

PARTS["file_ud"] = """
SELECT "user", day AS email_day, count(*) AS file_total, CAST(sum(to_removable_media) AS BIGINT) AS file_to_removable,
  CAST(sum(from_removable_media) AS BIGINT) AS file_from_removable, count(*) AS file_write_count,
  CAST(sum(is_after_hours) AS BIGINT) AS file_after_hours
FROM {acts} WHERE activity = 'File Write' GROUP BY 1, 2"""

_OTHERS = fixed.LOGON_FEATURES + fixed.DEVICE_FEATURES + fixed.FILE_FEATURES
_FILLED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in _OTHERS)

PARTS["people"] = """
SELECT c_name AS employee_name, c_custkey AS user_id, {cols} FROM customer WHERE c_acctbal >= 0""".replace(
    "{cols}", ", ".join(f"CAST((c_custkey * {m} + c_nationkey) % 50 AS DOUBLE) AS {t}"
                        for t, m in zip(fixed.TRAITS, (1, 3, 7, 11, 13))))

PARTS["uds"] = f"""
SELECT e.*, {_FILLED}, {split('e."user"', 'e.email_day')} AS dataset_split,
  coalesce(p.employee_name, CAST(e."user" AS VARCHAR)) AS employee_name, e."user" AS user_id,
  {', '.join(f'p.{t}' for t in fixed.TRAITS)}
FROM {{email_ud}} e LEFT JOIN {{logon_ud}} l ON e."user" = l."user" AND e.email_day = l.email_day
LEFT JOIN {{device_ud}} d ON e."user" = d."user" AND e.email_day = d.email_day
LEFT JOIN {{file_ud}} f ON e."user" = f."user" AND e.email_day = f.email_day
LEFT JOIN {{people}} p ON e."user" = p.user_id"""

PARTS["dv"] = f"""
SELECT "user", email_day, cents, {split()} AS dataset_split FROM (
  SELECT "user", day AS email_day, CAST(sum(cents) AS DOUBLE) AS cents FROM {{acts}} GROUP BY 1, 2)"""

PARTS["ds0"] = """
SELECT *, least(greatest((cents - lo) / (hi - lo), 0.0), 1.0) AS score FROM {dv},
  (SELECT min(cents) AS lo, max(cents) AS hi FROM {dv} WHERE dataset_split = 'train')"""

PARTS["ds"] = """
SELECT "user", email_day, cents, dataset_split, score, CASE WHEN score >= q95 THEN 1 ELSE 0 END AS flag,
  CASE WHEN score >= q99 THEN 'high' WHEN score >= q95 THEN 'suspicious' ELSE 'normal' END AS severity
FROM {ds0}, (SELECT quantile_cont(score, 0.95) AS q95, quantile_cont(score, 0.99) AS q99
             FROM {ds0} WHERE dataset_split = 'train')"""

PARTS["ws0"] = """
SELECT *, CASE WHEN count(*) OVER w = 7 THEN sum(cents * cents) OVER w / 7.0 END AS error FROM {dv}
WINDOW w AS (PARTITION BY "user" ORDER BY email_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""

PARTS["ws1"] = """
SELECT *, CASE WHEN error IS NOT NULL THEN
  least(greatest((error - q95 * 0.5) / (q99 - q95 * 0.5 + 1e-9), 0.0), 1.0) END AS score
FROM {ws0}, (SELECT quantile_cont(error, 0.95) AS q95, quantile_cont(error, 0.99) AS q99
             FROM {ws0} WHERE dataset_split = 'train' AND error IS NOT NULL)"""

PARTS["ws"] = """
SELECT "user", email_day, cents, dataset_split, error, score,
  CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS flag,
  CASE WHEN error IS NULL THEN 'undetermined' WHEN error >= q99 THEN 'high'
       WHEN error >= q95 THEN 'suspicious' ELSE 'normal' END AS severity FROM {ws1}"""

PARTS["ins"] = """SELECT DISTINCT user_id AS "user" FROM events WHERE event_type = 'error' AND value > 200"""


def _user_scores(source: str) -> str:
    return f"""
SELECT "user", max(score) AS score_max, avg(score) AS score_mean, coalesce(quantile_cont(score, 0.95), 0) AS score_p95,
  (array_agg(dataset_split ORDER BY cnt DESC, dataset_split))[1] AS dataset_split,
  CASE WHEN "user" IN (SELECT "user" FROM {{ins}}) THEN 1 ELSE 0 END AS is_insider
FROM (SELECT *, count(*) OVER (PARTITION BY "user", dataset_split) AS cnt FROM {source}) GROUP BY "user" """


PARTS["us_window"] = _user_scores("(SELECT * FROM {ws} WHERE severity <> 'undetermined')")
PARTS["us_day"] = _user_scores("{ds}")
PARTS["models"] = "SELECT 'window' AS model, * FROM {us_window} UNION ALL SELECT 'day', * FROM {us_day}"

PARTS["beh"] = """
SELECT "user", avg(after_hours_ratio) AS after_hours_rate, avg(bcc_ratio) AS bcc_rate,
  CAST(sum(file_to_removable) AS BIGINT) AS total_file_exfil, CAST(sum(file_total) AS BIGINT) AS total_file_ops,
  CAST(sum(usb_connect_count) AS BIGINT) AS total_usb, CAST(sum(after_hours_logons) AS BIGINT) AS total_ah_logons,
  CAST(sum(logon_count) AS BIGINT) AS total_logons, max(unique_logon_pcs) AS max_unique_pcs,
  (array_agg(dataset_split ORDER BY cnt DESC, dataset_split))[1] AS dataset_split, min(employee_name) AS employee_name,
  CAST(sum(file_to_removable) AS DOUBLE) / (sum(file_total) + 1) AS file_exfil_rate,
  CAST(sum(after_hours_logons) AS DOUBLE) / (sum(logon_count) + 1) AS ah_logon_rate
FROM (SELECT *, count(*) OVER (PARTITION BY "user", dataset_split) AS cnt FROM {uds}) GROUP BY "user" """

PARTS["act_sens"] = f"""
SELECT "user", avg(m) AS content_sensitivity_rate FROM (SELECT "user", day, max(s) AS m FROM (
  SELECT "user", day, {file_score(extension('filename'), '0')} AS s FROM (
    SELECT *, 'f' || {pick(SUFFIXES, 'id')} AS filename, CASE WHEN activity = 'File Write' THEN 1 ELSE 0 END AS is_write
    FROM {{acts}})) WHERE s > 0 GROUP BY 1, 2) GROUP BY 1"""

_RAW = ("score_p95", "after_hours_rate", "bcc_rate", "file_exfil_rate", "total_usb", "max_unique_pcs", "share")
_NORMS = tuple(f"{s}_norm" for s in fixed.SIGNALS)
PARTS["sig"] = """
SELECT s."user", s.score_p95, s.dataset_split, s.is_insider, coalesce(b.employee_name, CAST(s."user" AS VARCHAR)) AS employee_name,
  coalesce(after_hours_rate, 0) AS after_hours_rate, coalesce(bcc_rate, 0) AS bcc_rate,
  coalesce(file_exfil_rate, 0) AS file_exfil_rate, coalesce(total_usb, 0) AS total_usb,
  coalesce(max_unique_pcs, 0) AS max_unique_pcs, coalesce(content_sensitivity_rate, 0) AS content_sensitivity_rate,
  least(greatest(coalesce(content_sensitivity_rate, 0) / 3.0, 0), 1) AS share
FROM {us_window} s LEFT JOIN {beh} b ON s."user" = b."user" LEFT JOIN {act_sens} a ON s."user" = a."user" """
PARTS["norm"] = "SELECT sig.*, " + ", ".join(
    f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0 ELSE CAST({c} - min({c}) OVER () AS DOUBLE) / "
    f"(max({c}) OVER () - min({c}) OVER ()) END AS {n}" for c, n in zip(_RAW, _NORMS)) + " FROM {sig} sig"
PARTS["risk"] = "SELECT *, " + " + ".join(
    f"CAST({fixed.WEIGHTS[s]} AS DOUBLE) * {s}_norm" for s in fixed.SIGNALS) + " AS risk_score, " + (
    "coalesce(nullif(concat_ws('; ', " + ", ".join(
        f"CASE WHEN {s}_norm >= {fixed.THRESHOLDS[s]} THEN '{fixed.FLAG_TEXTS[s]}' END" for s in fixed.SIGNALS)
    + f"), ''), '{fixed.NO_FLAG_TEXT}') AS explanation FROM {{norm}}")

PARTS["msgs"] = f"""
SELECT source AS "user", {_DAY30} AS email_day, least({keyword('content', fixed.KEYWORD_RULES)} +
  CASE WHEN doc_id % 2 = 1 AND length(text) - length(replace(text, ' ', '')) + 1 > 500 THEN 1 ELSE 0 END, 3) AS event_score
FROM (SELECT *, text || ' ' || {pick(PLANTED, 'doc_id')} AS content FROM documents)"""
PARTS["docfiles"] = f"""
SELECT doc_id, source AS "user", {_DAY30} AS email_day, 'doc_' || doc_id || {pick(SUFFIXES, 'doc_id')} AS filename,
  {pick(PREFIXES, 'doc_id')} || ' ' || text || ' ' || {pick(PLANTED, 'doc_id')} AS content, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS is_write,
  CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS to_removable_media,
  CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS from_removable_media FROM documents"""
PARTS["filescores"] = (
    f"SELECT doc_id, \"user\", email_day, "
    f"{file_score(extension('filename'), 'greatest(' + signature('content') + ', ' + keyword('content', fixed.KEYWORD_RULES) + ')')}"
    " AS event_score FROM {docfiles}")
PARTS["sd"] = """
SELECT "user", email_day, round_even(sum(event_score) / count(*), 4) AS sensitivity_score,
  CAST(max(event_score) AS INTEGER) AS max_sensitivity_score, count(*) FILTER (event_score >= 2) AS sensitive_event_count,
  count(*) FILTER (event_score = 3) AS restricted_event_count,
  ['PUBLIC', 'INTERNAL', 'SENSITIVE', 'RESTRICTED'][max(event_score) + 1] AS top_sensitivity_label
FROM (SELECT "user", email_day, event_score FROM {msgs} UNION ALL SELECT "user", email_day, event_score FROM {filescores})
WHERE event_score > 0 GROUP BY 1, 2"""

PARTS["key"] = """
SELECT user_id AS "user", value, CASE WHEN hour(ts) < 10 THEN '4.2' WHEN hour(ts) < 18 THEN '5.2' ELSE '6' END AS release,
  CASE WHEN value <= 260 THEN CAST(ts AS DATE) END AS first_day,
  CAST(CASE WHEN value > 220 AND value <= 260 THEN ts - INTERVAL 2 DAY ELSE ts + INTERVAL 2 DAY END AS DATE) AS last_day
FROM events WHERE event_type = 'error' AND value > 120"""
PARTS["keyusers"] = """SELECT DISTINCT user_id AS "user" FROM events WHERE event_type = 'purchase' AND value > 60"""
PARTS["rel"] = """
SELECT release, count(DISTINCT "user") AS release_users,
  count(DISTINCT CASE WHEN "user" IN (SELECT "user" FROM {keyusers}) THEN "user" END) AS matches FROM {key} GROUP BY 1"""
PARTS["best"] = "SELECT * FROM {rel} WHERE matches > 0 ORDER BY matches DESC, release_users DESC, release LIMIT 1"

PARTS["days2"] = """
SELECT DISTINCT user_id AS "user", CAST(unnest(generate_series(CAST(ts AS DATE), CAST(ts + INTERVAL 2 DAY AS DATE), INTERVAL 1 DAY)) AS DATE) AS email_day
FROM events WHERE event_type = 'error' AND value > 200"""


def detection(rows: str) -> str:
    """Metrics over rows (y, s, p)."""
    return f"""
SELECT round(pairs / nullif(pos * neg, 0), 4) AS roc_auc, round(area / pos, 4) AS avg_precision,
  round(prec, 4) AS precision, round(rec, 4) AS recall,
  round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END, 4) AS f1,
  tp, fp, neg - fp AS tn, pos - tp AS fn, pos AS n_insiders, pos + neg AS n_total
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS prec, tp / pos AS rec FROM (
  SELECT sum((n - pos) * (found - pos + pos / 2)) AS pairs, sum(pos * found / above) AS area, CAST(sum(pos) AS BIGINT) AS pos,
    CAST(sum(n - pos) AS BIGINT) AS neg, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp FROM (
    SELECT *, sum(n) OVER (ORDER BY s DESC) AS above, sum(pos) OVER (ORDER BY s DESC) AS found FROM (
      SELECT s, count(*) AS n, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 1 AND p = 1) AS tp,
        count(*) FILTER (y = 0 AND p = 1) AS fp FROM ({rows}) GROUP BY s))) WHERE pos > 0)"""


def grid(aggregations, percentiles, ks) -> str:
    long = " UNION ALL ".join(
        f"SELECT model, \"user\", dataset_split, is_insider, '{a}' AS agg, {a} AS value FROM {{models}}" for a in aggregations)
    cuts = " UNION ALL ".join(
        f"SELECT model, agg, {p} AS thresh_pct, quantile_cont(value, {p / 100}) AS cutoff FROM ({long}) "
        "WHERE dataset_split = 'train' GROUP BY model, agg" for p in percentiles)
    return f"""
SELECT model, agg, thresh_pct, k, cutoff, pool, actual_k, tp / actual_k AS precision, tp / labelled AS recall,
  CASE WHEN tp > 0 THEN 2 * (tp / actual_k) * (tp / labelled) / (tp / actual_k + tp / labelled) ELSE 0 END AS f1,
  tp, actual_k - tp AS fp, labelled - tp AS fn FROM (
  SELECT model, agg, thresh_pct, k, cutoff, count(*) AS pool, least(k, count(*)) AS actual_k,
    count(*) FILTER (is_insider = 1 AND pos <= k) AS tp, (SELECT count(*) FROM {{ins}}) AS labelled FROM (
    SELECT l.*, thresh_pct, cutoff, row_number() OVER (PARTITION BY l.model, l.agg, thresh_pct ORDER BY value DESC, "user") AS pos
    FROM ({long}) l JOIN ({cuts}) c ON l.model = c.model AND l.agg = c.agg AND value >= cutoff), (SELECT unnest({list(ks)}) AS k)
  GROUP BY model, agg, thresh_pct, k, cutoff)"""


_FULL = grid(("score_max", "score_mean", "score_p95"), fixed.GRID_PERCENTILES, fixed.GRID_KS)
PARTS["grid"] = _FULL
_GRID_COLUMNS = ("model, agg, thresh_pct, k, pool, actual_k, tp, fp, fn, "
                 + r6("cutoff", "precision", "recall", "f1"))


def uniform(purpose: str, *parts: str) -> str:
    text = " || '|' || ".join([f"'42|{purpose}'", *parts])
    return f"(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) / 281474976710656.0)"


_W = (fixed.SEARCH["weight_low"], fixed.SEARCH["weight_high"])
_T = (fixed.SEARCH["threshold_low"], fixed.SEARCH["threshold_high"])
_START = [fixed.WEIGHTS[s] for s in fixed.SIGNALS] + [fixed.THRESHOLDS[s] for s in fixed.SIGNALS]


def candidates(size: str) -> str:
    low, span = f"CASE WHEN gene < 7 THEN {_W[0]} ELSE {_T[0]} END", f"CASE WHEN gene < 7 THEN {_W[1]} - {_W[0]} ELSE {_T[1]} - {_T[0]} END"
    return f"""
SELECT CAST(cand AS INTEGER) AS cand, CAST(gene AS INTEGER) AS gene, CAST(CASE WHEN cand = 0 THEN {_START}[gene + 1]
  ELSE {low} + ({span}) * {uniform('start', 'cand', 'gene')} END AS DOUBLE) AS value
FROM (SELECT unnest(range({size})) AS cand), (SELECT unnest(range(14)) AS gene)"""


PARTS["first_cands"] = candidates(str(fixed.SEARCH["population"]))
PARTS["cw"] = "SELECT cand, " + ", ".join(
    f"max(value) FILTER (gene = {i}) AS g{i}" for i in range(14)) + " FROM {first_cands} GROUP BY cand"
PARTS["cs"] = "SELECT cand, \"user\", is_insider, (" + " + ".join(
    f"{n} * (g{i} / ({' + '.join(f'g{j}' for j in range(7))}))" for i, n in enumerate(_NORMS)) + ") AS score, " + (
    "CASE WHEN " + " OR ".join(f"{n} >= g{i + 7}" for i, n in enumerate(_NORMS)) + " THEN 1 ELSE 0 END AS flagged FROM {norm}, {cw}")

PARTS["leaders"] = """
SELECT cand, row_number() OVER (PARTITION BY cand ORDER BY score DESC, "user") AS rank, "user", score, is_insider, flagged
FROM {cs} QUALIFY rank <= 50"""
PARTS["fit"] = """
SELECT cand, tp, total, f1, coverage, 0.8 * f1 + 0.2 * coverage AS fitness FROM (
  SELECT *, CASE WHEN tp > 0 THEN 2 * (tp / 50) * (tp / total) / (tp / 50 + tp / total) ELSE 0 END AS f1 FROM (
    SELECT cand, CAST(sum(is_insider) AS BIGINT) AS tp, avg(flagged) AS coverage, (SELECT CAST(sum(is_insider) AS BIGINT) FROM {norm}) AS total
    FROM {leaders} GROUP BY cand))"""
PARTS["ordered"] = """
SELECT cand, row_number() OVER (ORDER BY round(fitness, 6) DESC, cand) - 1 AS pos, round(fitness, 6) AS fitness FROM {fit}"""
PARTS["won"] = f"""
SELECT child, parent, arg_max(o.cand, round(o.fitness * 1000000) * 100 - draw) AS cand FROM (
  SELECT child, draw, draw % 2 AS parent, CAST(floor({uniform('draw', "'1'", 'child', 'draw')} * {fixed.SEARCH['population']}) AS BIGINT) AS drawn
  FROM (SELECT unnest(range(4, {fixed.SEARCH['population']})) AS child), (SELECT unnest(range(10)) AS draw)) d
JOIN {{ordered}} o ON d.drawn = o.cand GROUP BY 1, 2"""


_NAME = re.compile(r"\{([a-z0-9_]+)\}")


def with_parts(body: str) -> str:
    """Expand `{name}` references into a WITH list, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in PARTS and name not in order:
                visit(PARTS[name])
                order.append(name)

    visit(body)
    named = lambda text: _NAME.sub(lambda m: f"{m[1]}_" if m[1] in PARTS else m[0], text)
    ctes = ", ".join(f"{n}_ AS ({named(PARTS[n]).strip()})" for n in order)
    return (f"WITH {ctes} " if ctes else "") + named(body).strip()


_CLOCKED = """'E' || event_id AS id, date_trunc('second', ts) AS date, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour,
  CASE WHEN hour(ts) < 7 OR hour(ts) > 20 THEN 1 ELSE 0 END AS is_after_hours, 'U' || user_id AS "user",
  'PC-' || regexp_extract(props, '"k": ([0-9]+)', 1) AS pc"""
_CONTENT = f"lower(trim(regexp_replace(text, '{_RUN}', ' ', 'g'), ' '))"
_RISK_COLUMNS = ("\"user\", employee_name, " + r6("risk_score", *_NORMS))

BODIES: dict[str, str] = {
    "clean_email": f"""
SELECT CAST(doc_id AS VARCHAR) AS id, make_timestamp(2024, 1, doc_id % 30 + 1, doc_id % 24, 5, 9) AS date,
  CAST(make_date(2024, 1, doc_id % 30 + 1) AS DATE) AS email_day, CAST(doc_id % 24 AS INTEGER) AS email_hour, 1 AS email_month,
  CAST(isodow(make_date(2024, 1, doc_id % 30 + 1)) - 1 AS INTEGER) AS email_weekday,
  CASE WHEN doc_id % 24 < 7 OR doc_id % 24 > 20 THEN 1 ELSE 0 END AS is_after_hours, upper(source) AS "user", upper(lang) AS pc,
  'a@' || lower(source) AS sender, CAST(n_chars AS DOUBLE) AS size, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS attachments,
  CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS has_attachment, a AS to_recipient_count, b AS cc_recipient_count,
  c AS bcc_recipient_count, a + b + c AS total_recipient_count, CASE WHEN b > 0 THEN 1 ELSE 0 END AS has_cc,
  CASE WHEN c > 0 THEN 1 ELSE 0 END AS has_bcc, CAST(length(content) AS INTEGER) AS content_length_chars,
  CAST(CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, ' ', '')) + 1 END AS INTEGER) AS content_length_words,
  content, lower(trim(replace(text, '.', ';'), {_TRIM})) AS "to", lower(trim(replace(text, ',', ';'), {_TRIM})) AS cc,
  CASE WHEN doc_id % 2 = 0 THEN lower(trim(replace(text, '?', ';'), {_TRIM})) ELSE '' END AS bcc
  FROM (SELECT *, {items("replace(text, '.', ';')")} AS a, {items("replace(text, ',', ';')")} AS b,
  CASE WHEN doc_id % 2 = 0 THEN {items("replace(text, '?', ';')")} ELSE 0 END AS c, {_CONTENT} AS content FROM documents)
WHERE n_chars BETWEEN 100 AND 12000""",
    "clean_logon": f"""SELECT {_CLOCKED}, {_ACTIVITY} AS activity,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS is_logon FROM events WHERE value <= 250""",
    "clean_device": f"""SELECT {_CLOCKED}, {_ACTIVITY} AS activity,
  CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_connect, '' AS file_tree FROM events WHERE value <= 250""",
    "clean_file": f"""SELECT {_CLOCKED}, 'c:\\f\\' || event_type || '.ZIP' AS filename, 'File Write' AS activity, 1 AS is_write,
  CASE WHEN value > 20 THEN 1 ELSE 0 END AS to_removable_media, 0 AS from_removable_media, '50-4B ' || props AS content
  FROM events WHERE value <= 250""",
    "clean_traits": """SELECT replace(c_name, '#', ' # ') AS employee_name, 'CUS' || c_custkey AS user_id, round(c_acctbal, 6) AS o,
  CAST(c_nationkey AS DOUBLE) AS c, CAST(c_nationkey * 2 AS DOUBLE) AS e, CAST(c_nationkey * 3 AS DOUBLE) AS a,
  CAST(c_nationkey * 4 AS DOUBLE) AS n FROM customer WHERE c_acctbal >= 0""",
    "clean_users": """SELECT 'U' || c_custkey AS user_id, c_name AS employee_name, lower(c_name) || '@example.com' AS email,
  c_mktsegment AS role, CASE WHEN c_custkey % 3 = 0 THEN 'p1' ELSE '' END AS projects, CAST(c_nationkey AS DOUBLE) AS business_unit,
  'f ' || c_mktsegment AS functional_unit, 'd 1' AS department, 't' AS team, CAST(NULL AS VARCHAR) AS supervisor,
  TIMESTAMP '2010-03-04 00:00:00' AS start_date,
  CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2011-12-31 08:00:00' END AS end_date FROM customer""",
    "decoy_files": """SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS decoy_filename,
  upper(regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1)) AS pc FROM pages""",
    "dedupe_first": "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY props ORDER BY ts, event_id) = 1",
    "recipient_counts": f"""SELECT id, a AS to_count, b AS cc_count, c AS bcc_count, a + b + c AS total_count,
  CASE WHEN c > 0 THEN 1 ELSE 0 END AS has_bcc FROM (SELECT CAST(doc_id AS VARCHAR) AS id, {items("replace(text, '.', ';')")} AS a,
  {items("replace(text, ',', ';')")} AS b, CASE WHEN doc_id % 2 = 0 THEN {items("replace(text, '?', ';')")} ELSE 0 END AS c
  FROM documents)""",
    "scored_users": 'SELECT "user" FROM {acts} UNION SELECT "user" FROM {mails}',
    "run_counters": " UNION ALL ".join(
        f"""SELECT '{s}' AS section, '{m}' AS metric, CAST({e} AS VARCHAR) AS value FROM {{{t}}}"""
        for s, t, d in (("activity", "acts", "day"), ("email", "mails", "email_day"))
        for m, e in (("rows", "count(*)"), ("users", 'count(DISTINCT "user")'), ("first", f"min({d})"), ("last", f"max({d})"))),
    "email_user_day": "SELECT * REPLACE (" + r6("total_size", "avg_size", "avg_recipients", "avg_content_words",
                                                "attachment_email_ratio", "after_hours_ratio", "bcc_ratio") + ") FROM {email_ud}",
    "logon_user_day": "SELECT * FROM {logon_ud}",
    "device_user_day": "SELECT * FROM {device_ud}",
    "file_user_day": "SELECT * FROM {file_ud}",
    "user_day_features": "SELECT * REPLACE (" + r6("total_size", "avg_size", "avg_recipients", "avg_content_words",
                                                   "attachment_email_ratio", "after_hours_ratio", "bcc_ratio") + ") FROM {uds}",
    "user_day_join": f'SELECT "user", email_day, email_count, {", ".join(_OTHERS)} FROM {{uds}}',
    "user_split": "SELECT * FROM {dv}",
    "date_split": """SELECT id, CASE WHEN date < days[CAST(floor(len(days) * CAST(0.7 AS DOUBLE)) AS INTEGER) + 1] THEN 'train'
  WHEN date < days[CAST(floor(len(days) * CAST(0.85 AS DOUBLE)) AS INTEGER) + 1] THEN 'val' ELSE 'test' END AS dataset_split
  FROM {acts}, (SELECT list_sort(list(DISTINCT day)) AS days FROM {acts})""",
    "split_counts": """SELECT dataset_split, count(*) AS rows, min(email_day) AS first_day, max(email_day) AS last_day
  FROM {dv} GROUP BY 1""",
    "keyword_tier": f"SELECT doc_id, {keyword('content', fixed.KEYWORD_RULES)} AS tier FROM ("
                    f"SELECT doc_id, text || ' ' || {pick(PLANTED, 'doc_id')} AS content FROM documents)",
    "keyword_tier_lexicon": f"SELECT doc_id, {keyword('text', LEXICON)} AS tier FROM documents",
    "extension_tier": f"""SELECT *, {extension('filename')} AS tier FROM (SELECT doc_id, filename FROM {{docfiles}}
  UNION ALL SELECT -1 - page_id, url FROM pages)""",
    "signature_tier": f"""SELECT doc_id, {signature('content')} AS tier FROM {{docfiles}}""",
    "email_sensitivity": """SELECT "user", email_day, event_score, count(*) AS events FROM {msgs} GROUP BY 1, 2, 3""",
    "file_sensitivity": "SELECT doc_id, event_score FROM {filescores}",
    "sensitivity_daily": "SELECT * FROM {sd}",
    "sensitivity_user": """SELECT "user", round(avg(max_sensitivity_score), 6) AS content_sensitivity_rate,
  CAST(sum(sensitive_event_count) AS BIGINT) AS total_sensitive_events,
  CAST(sum(restricted_event_count) AS BIGINT) AS total_restricted_events FROM {sd} GROUP BY 1""",
    "label_distribution": """SELECT label, count(top_sensitivity_label) AS user_days,
  round(count(top_sensitivity_label) * 100.0 / (SELECT count(*) FROM {sd}), 6) AS percent
  FROM (SELECT unnest(['PUBLIC', 'INTERNAL', 'SENSITIVE', 'RESTRICTED']) AS label) LEFT JOIN {sd} ON label = top_sensitivity_label
  GROUP BY 1""",
    "window_7row": """SELECT "user", email_day, CASE WHEN count(*) OVER w = 7 THEN
  string_agg(CAST(CAST(cents AS BIGINT) AS VARCHAR), ',') OVER w END AS window_values FROM {dv}
  WINDOW w AS (PARTITION BY "user" ORDER BY email_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "error_to_score": "SELECT * REPLACE (round(error, 2) AS error, " + r6("score") + ") FROM {ws}",
    "minmax_severity": "SELECT * REPLACE (" + r6("score") + ") FROM {ds}",
    "scaled_features": 'SELECT "user", email_day, ' + ", ".join(
        f"round((CAST({c} AS DOUBLE) - (SELECT min({c}) FROM {{uds}} WHERE dataset_split = 'train')) / (SELECT coalesce(nullif("
        f"CAST(max({c}) - min({c}) AS DOUBLE), 0), 1) FROM {{uds}} WHERE dataset_split = 'train'), 6) AS {c}"
        for c in ("email_count", "total_size", "logon_count")) + " FROM {uds}",
    "exact_quantiles": " UNION ALL ".join(
        f"SELECT {t} AS event_type, round(quantile_cont(value, 0.93), 6) AS q0, round(quantile_cont(value, 0.95), 6) AS q1, "
        f"round(quantile_cont(value, 0.99), 6) AS q2 FROM events{g}" for t, g in (("'all'", ""), ("event_type", " GROUP BY event_type"))),
    "user_scores": "SELECT * REPLACE (" + r6("score_max", "score_mean", "score_p95") + ") FROM {us_window}",
    "behavior_signals": "SELECT * REPLACE (" + r6("after_hours_rate", "bcc_rate", "file_exfil_rate", "ah_logon_rate") + ") FROM {beh}",
    "risk_scores": f"""SELECT {_RISK_COLUMNS}, dataset_split, is_insider, total_usb, max_unique_pcs,
  {r6('score_p95', 'after_hours_rate', 'bcc_rate', 'file_exfil_rate', 'content_sensitivity_rate')} FROM {{risk}}""",
    "risk_queue": f"""SELECT CAST(row_number() OVER (ORDER BY risk_score DESC, "user") AS INTEGER) AS priority_rank, {_RISK_COLUMNS}, is_insider,
  explanation FROM (SELECT * FROM {{risk}} ORDER BY risk_score DESC, "user" LIMIT 50)""",
    "explain": 'SELECT "user", explanation FROM {risk}',
    "signal_breakdown": " UNION ALL ".join(
        f"SELECT \"user\", '{s}' AS signal, round({s}_norm, 6) AS value, CAST({fixed.THRESHOLDS[s]} AS DOUBLE) AS threshold, "
        f"CASE WHEN {s}_norm >= {fixed.THRESHOLDS[s]} THEN 1 ELSE 0 END AS over, CAST(0.5 AS DOUBLE) AS median_threshold FROM {{risk}}"
        for s in fixed.SIGNALS),
    "suspicious_users": """SELECT r."user", model_rank, CAST(row_number() OVER (ORDER BY risk_score DESC, r."user") AS INTEGER) AS risk_rank,
  round(risk_score, 6) AS risk_score, round(score_p95, 6) AS score_p95 FROM {risk} r JOIN (
  SELECT "user", CAST(row_number() OVER (ORDER BY score_p95 DESC, "user") AS INTEGER) AS model_rank FROM {us_window}
  WHERE score_p95 >= (SELECT quantile_cont(score_p95, 0.9) FROM {us_window} WHERE dataset_split = 'train')
  QUALIFY model_rank <= 20) t ON r."user" = t."user" """,
    "weight_comparison": "WITH m AS (SELECT " + ", ".join(
        f"avg({s}_norm) AS {s}" for s in fixed.SIGNALS[:-1]) + " FROM {risk}), t AS (SELECT *, (" + " + ".join(
        fixed.SIGNALS[:-1]) + ") * 0.9 + 0.1 AS total FROM m) " + " UNION ALL ".join(
        f"SELECT '{s}' AS signal, CAST({fixed.WEIGHTS[s]} AS DOUBLE) AS default_weight, round({e} / total, 6) AS active_weight, "
        f"round({e} / total - {fixed.WEIGHTS[s]}, 6) AS delta FROM t"
        for s in fixed.SIGNALS for e in [f"{s} * 0.9" if s != fixed.SIGNALS[-1] else "0.1"]),
    "truth_release": """SELECT release, release_users, matches, scored_users, match_counts, 'release ' || release || ' selected (' ||
  matches || '/' || release_users || ' labelled users match ' || scored_users || ' scored users; matches by release: ' ||
  match_counts || ')' AS description FROM {best}, (SELECT count(*) AS scored_users FROM {keyusers}),
  (SELECT string_agg(release || '=' || matches, ', ' ORDER BY release || '=' || matches) AS match_counts FROM {rel})""",
    "truth_users": """SELECT DISTINCT "user" FROM {key} WHERE release = (SELECT release FROM {best})
  AND "user" IN (SELECT "user" FROM {keyusers})""",
    "truth_days": """SELECT DISTINCT "user", CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS email_day,
  1 AS is_insider FROM {key} WHERE release = (SELECT release FROM {best}) AND "user" IN (SELECT "user" FROM {keyusers})
  AND first_day <= last_day""",
    "users_per_release": "SELECT release, release_users AS users FROM {rel}",
    "day_eval": detection("""SELECT CASE WHEN l."user" IS NULL THEN 0 ELSE 1 END AS y, score AS s,
  CASE WHEN severity = 'normal' THEN 0 ELSE 1 END AS p FROM {ds} d LEFT JOIN {days2} l
  ON d."user" = l."user" AND d.email_day = l.email_day WHERE dataset_split = 'test'"""),
    "user_eval": detection("""SELECT CASE WHEN "user" IN (SELECT "user" FROM {ins}) THEN 1 ELSE 0 END AS y, s,
  CASE WHEN s >= (SELECT quantile_cont(score, 0.93) FROM {ws} WHERE score IS NOT NULL) THEN 1 ELSE 0 END AS p
  FROM (SELECT "user", max(score) AS s FROM {ws} WHERE score IS NOT NULL GROUP BY 1)"""),
    "label_eval": detection("""SELECT quality AS y, n_chars AS s, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p
  FROM labels JOIN documents USING (doc_id)"""),
    "threshold_survivors": "SELECT \"user\", dataset_split, is_insider, " + r6("score_max", "score_mean", "score_p95", "cutoff") + """
  FROM {us_window}, (SELECT quantile_cont(score_p95, 0.9) AS cutoff FROM {us_window} WHERE dataset_split = 'train')
  WHERE score_p95 >= cutoff""",
    "eval_grid": f"SELECT {_GRID_COLUMNS} FROM {{grid}}",
    "k_sweep": f"SELECT {_GRID_COLUMNS} FROM ({grid(('score_p95',), (90,), fixed.SWEEP_KS)})",
    "outcome_counts": """SELECT k, outcome, count(*) FILTER ((outcome = 'tp' AND place <= k AND is_insider = 1)
    OR (outcome = 'fp' AND place <= k AND is_insider = 0) OR (outcome = 'fn' AND place > k AND is_insider = 1)) AS users
  FROM (SELECT is_insider, row_number() OVER (ORDER BY risk_score DESC, "user") AS place FROM {risk})
  CROSS JOIN (VALUES ('tp'), ('fp'), ('fn')) o(outcome) CROSS JOIN (VALUES """ + ", ".join(
        f"({k})" for k in fixed.OUTCOME_KS) + ") v(k) GROUP BY 1, 2",
    "model_comparison": "SELECT model, agg, k, " + r6("precision", "recall", "f1") + f""" FROM (
  {grid(('score_max', 'score_p95'), (90,), (20, 50))}) WHERE (model = 'day' AND agg = 'score_max') OR (model = 'window' AND agg = 'score_p95')""",
    "best_config": f"SELECT {_GRID_COLUMNS} FROM (SELECT * FROM {{grid}} ORDER BY f1 DESC, model, agg, thresh_pct, k LIMIT 1)",
    "best_per_aggregation": f"""SELECT {_GRID_COLUMNS} FROM (SELECT * FROM {{grid}}
  QUALIFY row_number() OVER (PARTITION BY model, agg ORDER BY f1 DESC, thresh_pct, k) = 1)""",
    "missed_insiders": """SELECT "user" FROM {ins} WHERE "user" NOT IN (
  SELECT "user" FROM {us_window} ORDER BY score_p95 DESC, "user" LIMIT 20)""",
    "score_histogram": """SELECT s.is_insider, b.bin, round(lo + b.bin * w, 6) AS left_edge, round(lo + (b.bin + 1) * w, 6) AS right_edge,
  coalesce(found, 0) AS count, round(coalesce(found, 0) / (n * w), 6) AS density, round(m, 6) AS class_mean FROM (
  SELECT is_insider, min(score_p95) AS lo, (max(score_p95) - min(score_p95)) / 40 AS w, count(*) AS n, avg(score_p95) AS m
    FROM {us_window} GROUP BY 1) s CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(40)) b LEFT JOIN (
  SELECT u.is_insider, CAST(least(floor((score_p95 - lo) / (hi - lo) * 40), 39) AS INTEGER) AS bin, count(*) AS found
  FROM {us_window} u JOIN (SELECT is_insider, min(score_p95) AS lo, max(score_p95) AS hi FROM {us_window} GROUP BY 1) t
    ON u.is_insider = t.is_insider GROUP BY 1, 2) c ON c.is_insider = s.is_insider AND c.bin = b.bin""",
    "row_histogram": """SELECT b.bin, round(lo + b.bin * w, 6) AS left_edge, round(lo + (b.bin + 1) * w, 6) AS right_edge,
  coalesce(found, 0) AS count, round(coalesce(found, 0) / (n * w), 6) AS density, round(m, 6) AS class_mean FROM (
  SELECT min(score) AS lo, (max(score) - min(score)) / 50 AS w, count(*) AS n, avg(score) AS m FROM {ds}) s
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(50)) b LEFT JOIN (
  SELECT CAST(least(floor((score - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS found
  FROM {ds}, (SELECT min(score) AS lo, max(score) AS hi FROM {ds}) GROUP BY 1) c ON c.bin = b.bin""",
    "severity_summary": """SELECT count(*) AS rows, count(DISTINCT "user") AS users, count(*) FILTER (severity = 'high') AS high_rows,
  count(*) FILTER (severity = 'suspicious') AS suspicious_rows, count(*) FILTER (severity = 'normal') AS normal_rows,
  count(*) FILTER (severity = 'undetermined') AS undetermined_rows, round(min(score), 6) AS score_min,
  round(max(score), 6) AS score_max FROM {ws}""",
    "severity_floors": "SELECT severity, round(min(score), 6) AS min_score, count(*) AS rows FROM {ds} GROUP BY 1",
    "daily_max": "SELECT email_day, round(max(score), 6) AS max_score FROM {ws} WHERE score IS NOT NULL GROUP BY 1",
    "max_per_user": 'SELECT "user", round(max(score), 6) AS max_score FROM {ws} GROUP BY 1',
    "top_users": """SELECT "user", round(mean_score, 6) AS mean_score FROM (SELECT "user", avg(score) AS mean_score FROM {ds}
  GROUP BY 1 ORDER BY mean_score DESC, "user" LIMIT 15)""",
    "top_rows": """SELECT "user", email_day, dataset_split, round(score, 6) AS score, flag, severity FROM (
  SELECT * FROM {ds} ORDER BY score DESC, "user", email_day LIMIT 20)""",
    "timeline": """SELECT "user", email_day, round(score, 6) AS score FROM {ds} WHERE "user" IN (
  SELECT "user" FROM {ds} GROUP BY 1 ORDER BY avg(score) DESC, "user" LIMIT 5)""",
    "sample": """SELECT * FROM {dv} ORDER BY md5('42|' || "user" || '|' || email_day), "user", email_day LIMIT 15000""",
    "random_candidates": 'SELECT cand, CAST(rank AS INTEGER) AS rank, "user", round(score, 6) AS score, flagged FROM {leaders}',
    "candidate_fitness": """SELECT cand, tp, 50 - tp AS fp, total - tp AS fn, round(tp / 50, 6) AS precision, round(tp / total, 6) AS recall,
  round(f1, 6) AS f1, round(coverage, 6) AS coverage, round(fitness, 6) AS fitness FROM {fit}""",
    "bred_generation": f"""SELECT CAST(pos AS INTEGER) AS cand, gene, round(value, 6) AS value FROM {{ordered}} o
  JOIN {{first_cands}} c ON o.cand = c.cand WHERE pos < 4
  UNION ALL SELECT CAST(child AS INTEGER), gene, round(least(greatest(mixed + CASE WHEN {uniform('mutate', "'1'", 'child', 'gene')} < 0.25
    THEN sqrt(-2 * ln(1 - {uniform('radius', "'1'", 'child', 'gene')})) * cos(2 * pi() * {uniform('angle', "'1'", 'child', 'gene')}) * 0.04
    ELSE 0 END, CASE WHEN gene < 7 THEN {_W[0]} ELSE {_T[0]} END), CASE WHEN gene < 7 THEN {_W[1]} ELSE {_T[1]} END), 6) FROM (
    SELECT a.child, x.gene, CASE WHEN {uniform('mix', "'1'", 'a.child', 'x.gene')} < 0.5 THEN x.value ELSE y.value END AS mixed
    FROM (SELECT * FROM {{won}} WHERE parent = 0) a JOIN (SELECT * FROM {{won}} WHERE parent = 1) b ON a.child = b.child
    JOIN {{first_cands}} x ON x.cand = a.cand JOIN {{first_cands}} y ON y.cand = b.cand AND y.gene = x.gene)""",
    "stream_dedupe": 'SELECT id, "user", activity, is_after_hours FROM {acts}',
    "stream_user_day": """SELECT "user", day AS email_day, count(*) FILTER (activity = 'Logon') AS logon_count,
  count(*) FILTER (activity = 'Logoff') AS logoff_count, count(*) FILTER (activity = 'Logon' AND is_after_hours = 1) AS after_hours_logons,
  count(*) FILTER (activity = 'Connect') AS usb_connect_count, count(*) FILTER (activity = 'Disconnect') AS usb_disconnect_count,
  count(*) FILTER (activity = 'File Write') AS file_write_count, count(DISTINCT pc) AS unique_pcs FROM {acts} GROUP BY 1, 2""",
    "stream_sensitivity": """SELECT "user", email_day, CAST(sum(event_score) AS BIGINT) AS sum_score, max(event_score) AS max_score,
  count(*) FILTER (event_score >= 2) AS sensitive_count, count(*) FILTER (event_score = 3) AS restricted_count,
  count(*) AS total_events FROM {msgs} WHERE event_score > 0 GROUP BY 1, 2""",
}


def _merge_with(body: str) -> str:
    """A body that has its own WITH joins the generated list."""
    sql = with_parts(body)
    return re.sub(r"\) WITH m AS", "), m AS", sql, count=1)


def _counters(section: str, source: str, metrics: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{m}' AS metric, CAST({e} AS VARCHAR) AS value FROM {source}" for m, e in metrics.items())


_LOG_SPLIT = """(SELECT *, CASE WHEN date < mail_days[CAST(floor(len(mail_days) * CAST(0.7 AS DOUBLE)) AS INTEGER) + 1] THEN 'train'
  WHEN date < mail_days[CAST(floor(len(mail_days) * CAST(0.85 AS DOUBLE)) AS INTEGER) + 1] THEN 'val' ELSE 'test' END AS dataset_split
  FROM {acts}, (SELECT list_sort(list(DISTINCT email_day)) AS mail_days FROM {mails}) WHERE activity IN (%s))"""
_SPLIT_ROWS = {part: f"count(*) FILTER (dataset_split = '{part}')" for part in ("train", "val", "test")}
_LOG_KINDS = {"logon": "'Logon', 'Logoff'", "device": "'Connect', 'Disconnect'", "file": "'File Write'"}
BODIES["run_summary"] = " UNION ALL ".join([
    _counters("email", "{mails}", {"rows": "count(*)", "first": "min(email_day)", "last": "max(email_day)"}),
    *[_counters(k, _LOG_SPLIT % kinds, {"rows": "count(*)", "first": "min(day)", "last": "max(day)", **_SPLIT_ROWS}) for k, kinds in _LOG_KINDS.items()],
    "SELECT 'psychometric' AS section, 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM customer",
    *[_counters("user_day_totals", "{%s_ud}" % k, {f"{k}_user_days": "count(*)"}) for k in ("email", "logon", "device", "file")],
    _counters("user_days", "{uds}", {"rows": "count(*)", "users": 'count(DISTINCT "user")', "trait_matches": "count(o)", **_SPLIT_ROWS})])
BODIES["stream_user_day_state"] = BODIES["stream_user_day"]
_SHARES = ("0.01", "0.25", "0.5", "0.93", "0.95", "0.99")
BODIES["sketch_quantiles"] = " UNION ALL ".join(
    f"SELECT CAST({q} AS DOUBLE) AS share, count(*) AS rows, true AS within FROM events WHERE value IS NOT NULL" for q in _SHARES)
BODIES["fixed_tree_scores"] = """SELECT event_id, round(pow(2, -(
    CASE WHEN user_id <= 40 THEN CASE WHEN value <= 25 THEN 3.0 ELSE 2.5 END ELSE 1.0 END
  + CASE WHEN value <= 100 THEN 2.0 ELSE CASE WHEN user_id <= 10 THEN 1.5 ELSE CASE WHEN value <= 200 THEN 4.25 ELSE 3.0 END END END)
  / 2 / (2 * (ln(255) + 0.5772156649015329) - 2 * CAST(255 AS DOUBLE) / 256)), 6) AS score FROM events"""
BODIES["csv_round_trip"] = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, 'a "quoted", ' || chr(10) || c_mktsegment AS c_note FROM customer"""
BODIES["csv_tolerant"] = """SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment
  FROM customer WHERE c_custkey % 7 <> 0"""
BODIES["optional_source"] = """SELECT CAST(NULL AS VARCHAR) AS decoy_filename, CAST(NULL AS VARCHAR) AS pc FROM region WHERE false
  UNION ALL SELECT r_name, CAST(r_regionkey AS VARCHAR) FROM region"""
BODIES["day_partitions"] = 'SELECT id, day, "user", activity FROM {acts} WHERE day >= DATE \'2024-01-05\''
BODIES["scored_table"] = "SELECT * REPLACE (" + r6("score") + ") FROM {ds}"
BODIES["report_lines"] = " UNION ALL ".join(_counters("events", "events", {m: e}) for m, e in (
    ("rows", "count(*)"), ("users", "count(DISTINCT user_id)"), ("kinds", "count(DISTINCT event_type)")))
BODIES["late_days"] = 'SELECT id, date, day, "user", activity, cents FROM {acts}'
BODIES["bucketed_user_days"] = BODIES["user_day_join"]
BODIES["carried_ids"] = BODIES["clean_logon"]
BODIES["interval_days"] = """SELECT d."user", d.email_day, CASE WHEN l."user" IS NULL THEN 0 ELSE 1 END AS is_insider FROM {dv} d
  LEFT JOIN {days2} l ON d."user" = l."user" AND d.email_day = l.email_day"""
BODIES["stream_clean"] = BODIES["clean_logon"]

ORACLE: dict[str, str] = {name: _merge_with(body) for name, body in BODIES.items()}
