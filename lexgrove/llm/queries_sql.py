"""DuckDB SQL for the operators that SQL can express."""

from lexgrove.llm import personal_data

ORACLE: dict[str, str] = {}

ORACLE["op1_url_filter"] = r"""
WITH u AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(regexp_replace(substr(url, strpos(url, '://') + 3), '^[^/?#]*', ''), '^([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(rule, rhost, rpath, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
listed(lhost) AS (SELECT n || '.example.' || t FROM (VALUES ('adult-x'), ('ads-track'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) a(n), (VALUES ('com'), ('net'), ('org')) b(t)),
best AS (
  SELECT u.page_id, u.host, u.path, max(r.rule) FILTER (rk = 1) AS rule, max(r.verdict) FILTER (rk = 1) AS verdict
  FROM (SELECT u.*, r.rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule) DESC) AS rk
        FROM u LEFT JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath)) r
  JOIN u USING (page_id) GROUP BY ALL)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN starts_with(path, '/') AND EXISTS (SELECT 1 FROM listed WHERE host = lhost OR ends_with(host, '.' || lhost)) THEN 'block' ELSE 'allow' END) AS verdict
FROM best"""

ORACLE["op9_vector_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v) q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

ORACLE["op10_line_spread"] = r"""
WITH l AS (
  SELECT doc_id, source, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)))) AS line FROM documents),
b AS (SELECT line, min(doc_id) AS first_id FROM l WHERE length(line) >= 15 GROUP BY line HAVING count(DISTINCT source) >= 10),
gone AS (SELECT DISTINCT l.doc_id, l.line FROM l JOIN b ON l.line = b.line AND l.doc_id > b.first_id),
g AS (SELECT doc_id, list(line) AS lines FROM gone GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(string_split(d.text, chr(10))) AS n,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(g.lines, []), trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)))) AS kept
  FROM documents d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k"""

LOWER_CASED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op11_bag_ranking"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER_CASED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
tf AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, s.n),
m AS (SELECT row, doc_id, CAST(75 + (25 * len(t) * s.n) // s.l AS BIGINT) AS m FROM d, s WHERE len(t) > 0),
q AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all({LOWER_CASED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
r AS (
  SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY item_id, doc_id, row)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 20"""

# Proposals in plain form; the operator's own are written for speed.
PROPOSED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": personal_data.IBAN, "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "birth": r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}", "account": r"[0-9]{8,17}",
}
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LETTERS = "instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1"
DAY, MONTH, YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9][0-9]"
CONFIRMED = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(right(x, 3) AS INTEGER), 0) <= 255))",
    "card": f"length({DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: "
    f"CASE WHEN i % 2 = 1 THEN CAST(reverse({DIGITS})[i] AS INTEGER) ELSE (2 * CAST(reverse({DIGITS})[i] AS INTEGER)) // 10 + (2 * CAST(reverse({DIGITS})[i] AS INTEGER)) % 10 END)) % 10 = 0",
    "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
    "iban": "NOT regexp_matches(c || ' ' || d, '[A-Za-z0-9]') AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || left(replace(m, ' ', ''), 4), ''), "
    f"lambda c: {LETTERS})), lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1",
    "ssn": "NOT regexp_matches(c || ' ' || d, '[0-9-]') AND NOT regexp_matches(m, '^(?:000|666|9)|-00-|0000$')",
    "birth": f"NOT regexp_matches(c || ' ' || d, '[0-9]') AND regexp_matches(m, '^(?:{DAY}[-/.]{MONTH}[-/.]{YEAR}|{MONTH}[-/.]{DAY}[-/.]{YEAR}|{YEAR}[-/.]{MONTH}[-/.]{DAY})$')",
    "account": "NOT regexp_matches(c || ' ' || d, '[0-9]')",
}


def _kind(place: int, k: personal_data.Kind) -> str:
    p = PROPOSED[k.name]
    near = f"translate(right(g, {personal_data.BEFORE}) || chr(10) || left(h, {personal_data.AFTER}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    says = lambda words: f"regexp_matches({near}, '(?:^|[^a-z])(?:{words})(?:[^a-z]|$)')"
    score = f"{k.base} + (CASE WHEN {says(k.good)} THEN {personal_data.RAISE} ELSE 0 END) - (CASE WHEN {says(k.bad)} THEN {personal_data.LOWER} ELSE 0 END)"
    stays = "true" if k.name in personal_data.BASE else f"{score} >= {personal_data.LEAST}"
    return f"""SELECT row, {place} AS place, '{k.name}' AS kind, s + length(g) AS first, s + length(g) + length(m) AS last FROM (
  SELECT row, ms[i] AS m, gs[i] AS g, gs[i + 1] AS h, right(gs[i], 1) AS c, left(gs[i + 1], 1) AS d,
    coalesce(list_sum(list_transform(range(1, i), lambda j: length(gs[j]) + length(ms[j]))), 0) AS s
  FROM (SELECT row, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gs, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM x))
WHERE {CONFIRMED[k.name]} AND {stays}"""


ORACLE["op12_personal_data"] = f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
f AS MATERIALIZED ({" UNION ALL ".join(_kind(i, k) for i, k in enumerate(personal_data.KINDS))}),
g AS (
  SELECT row, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in personal_data.BASE)},
    string_agg(kind || ':' || CAST(first AS BIGINT) || ':' || CAST(last AS BIGINT), ',' ORDER BY place, first) AS spans,
    string_agg(kind || ':' || CAST(first AS BIGINT) || ':' || CAST(last AS BIGINT), ',' ORDER BY place, first) FILTER (place < {len(personal_data.BASE)}) AS base
  FROM f GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in personal_data.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM x LEFT JOIN g USING (row)"""

ORACLE["op13_collocations"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER_CASED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS MATERIALIZED (
  SELECT lang, k, array_to_string(g, ' ') AS phrase, CAST(count(*) AS BIGINT) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS g FROM w, range(1, 5) r(k) WHERE len(w) >= k)
  GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 30),
cuts AS MATERIALIZED (
  SELECT lang, phrase, f AS a, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest FROM c, range(1, 4) r(j) WHERE j < k),
h AS MATERIALIZED (SELECT lang, phrase, f FROM g WHERE k < 4 AND f >= 30),
cut AS (
  SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN h x ON x.lang = cuts.lang AND x.phrase = first JOIN h y ON y.lang = cuts.lang AND y.phrase = rest),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
part AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(f) AS around FROM c, range(2, 4) a(m), range(1, 4) b(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN part USING (lang, phrase) WHERE coalesce(around, 0)::HUGEINT * 100 < a::HUGEINT * 80)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000"""
