"""DuckDB SQL for the corpus operators that SQL can express.

The others need what SQL lacks: positions of matches (op4), merges in rank order (op2, op5), nested
markup (op3) and models trained in the session (op9, op10). Tests hold those against
brute-force versions.
"""

from __future__ import annotations

from . import quality, url_filter

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(column: str, pattern: str, lower: bool = True) -> str:
    text = f"coalesce({column}, '')"
    return f"regexp_extract_all({f'translate({text}, {_UPPER!r}, {_LOWER!r})' if lower else text}, '{pattern}')"


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_words('text', _ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_words('text', _ALNUM)} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM bw),
dw AS (SELECT k, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT k, i, n, item_id FROM (SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM dw) JOIN win USING (n, t)),
nh AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT k, item_id::VARCHAR AS s FROM hit) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh USING (k) LEFT JOIN it USING (k)"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, {_words('text', _SPACED)} AS w FROM documents),
s AS (SELECT DISTINCT k, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS i, b.k AS j, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.k <> b.k GROUP BY ALL),
l AS (SELECT i, j FROM p JOIN n a ON a.k = i JOIN n b ON b.k = j WHERE 100 * c >= 85 * (a.n + b.n - c)),
r(k, o) AS (SELECT k, k FROM d UNION SELECT r.k, l.j FROM r JOIN l ON l.i = r.o),
m AS (SELECT r.k, min(d.doc_id) AS component_id FROM r JOIN d ON d.k = r.o GROUP BY r.k)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN m USING (k) LEFT JOIN n USING (k)"""


def _rules() -> str:
    out = []
    for r in quality.RULES:
        ratio = f"({r.count} / greatest({r.per}, 1)::DOUBLE)"
        bounds = [f"{ratio} >= {r.least}"] * (r.least is not None) + [f"{ratio} <= {r.most}"] * (r.most is not None)
        out.append(f"({' AND '.join(bounds)} OR n_words < {r.from_words})")
    return " AND ".join(out)


_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {_words('text', _SPACED, lower=False)} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS lines FROM documents),
win AS (SELECT k, i, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS c FROM win) WHERE c > 1),
nr AS (SELECT k, count(*) AS c FROM (SELECT DISTINCT k, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(list_filter(lines, lambda x: regexp_matches(rtrim(x, ' '), '(\\.\\.\\.|…)$'))) AS n_cut_lines,
len(list_filter(w, lambda x: list_contains([{_STOP}], rtrim(lower(x), '.,;:!?')))) AS n_stop, coalesce(c, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN nr USING (k)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules()} AS kept FROM f"""


def _case(tree) -> str:
    if not isinstance(tree, url_filter.Node):
        return repr(float(tree))
    return f"CASE WHEN f_{url_filter.FEATURES[tree.feature]} <= {tree.cut!r} THEN {_case(tree.low)} ELSE {_case(tree.high)} END"


def _op6() -> str:
    trees, rates = url_filter.default_model()
    score = " + ".join(f"{url_filter.RATE} * ({_case(t)})" for t in trees)
    suffix = "CASE regexp_replace(split_part(host, '.', -1), '^[0-9]+$', '0') " + " ".join(f"WHEN '{s}' THEN {r!r}" for s, r in rates.items()) + " ELSE 0 END"
    rule = "CASE"
    for _, r in sorted(url_filter.RULES, key=lambda x: -len(x[1])):
        host, _, path = r.partition("/")
        rule += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{r}'"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in url_filter.RULES) + " ELSE CASE WHEN score > 0 THEN 'block' ELSE 'allow' END END"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
r AS (SELECT *, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), {_UPPER!r}, {_LOWER!r}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, greatest(length(u), 1)::DOUBLE AS n FROM r),
f AS (SELECT *, length(u)::DOUBLE AS f_length, length(regexp_replace(path, '[^/]+', '', 'g'))::DOUBLE AS f_depth, length(regexp_replace(u, '[^0-9]+', '', 'g')) / n AS f_digits,
coalesce(list_sum(list_transform(list_filter(list_distinct(string_split(u, '')), lambda c: c <> ''), lambda c: (length(replace(u, c, '')) / n - 1) * log2(greatest(1 - length(replace(u, c, '')) / n, 1e-12)))), 0) AS f_entropy,
length(regexp_replace(u, '[^=]+', '', 'g'))::DOUBLE AS f_params, {suffix} AS f_suffix, length(regexp_replace(host, '[^-]+', '', 'g'))::DOUBLE AS f_hyphens FROM p),
s AS (SELECT page_id, host, path, {rule} END AS rule, {score} AS score FROM f)
SELECT page_id, host, path, rule, {verdict} AS verdict FROM s"""


OP6 = _op6()
