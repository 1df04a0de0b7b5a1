"""The registered queries as plain SQL over the same tables; only word lists and id name spaces are taken from the jobs."""

from __future__ import annotations

from lexgrove.functions.text import SPACE_CHARS
from lexgrove.functions.urls import BLOCKED_V4
from lexgrove.operators.catalog import CATALOG_SPACE
from lexgrove.operators.fulltext import STOP_WORDS
from lexgrove.operators.references import NAME_STOP
from lexgrove.operators.register import ID_SPACE

WS = "'" + SPACE_CHARS + "'"
NL = "chr(10)"
STOPS = "(" + ",".join(f"'{w}'" for w in STOP_WORDS) + ")"
NAME_STOPS = "(" + ",".join(f"'{w}'" for w in NAME_STOP) + ")"
REFUSAL = "'Insufficient evidence in available policy sections.'"


def uuid5(space: str, name: str) -> str:
    h = f"sha1(unhex('{space.replace('-', '')}') || encode({name}))"
    variant = f"substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr({h},17,1)), 1)"
    return f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||{variant}||substr({h},18,3)||'-'||substr({h},21,12))"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


POLICIES = """policies AS (
  SELECT source policy_id, idx, 'tenant-'||(idx%2) tenant_id, 'Src S'||idx||' Policy' AS name, idx*5 authority_level,
    (['all','operations','claims_ops','compliance'])[idx%4+1] department_scope, (['general','reference','guide'])[idx%3+1] policy_type
  FROM (SELECT DISTINCT source, CAST(regexp_extract(source,'(\\d+)$',1) AS INT) idx FROM documents))"""
FACTS = """facts AS (
  SELECT d.doc_id, d.source policy_id, 'v'||d.doc_id policy_version_id, DATE '2024-01-01' + CAST(d.doc_id%365 AS INT) effective_date,
    CASE WHEN coalesce(l.toxic,0)=1 THEN 'failed' ELSE 'ready' END parse_status, TIMESTAMP '2024-01-01' + to_minutes(d.n_chars) ready_at,
    'https://docs.example.org/'||d.doc_id public_url
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
NUMBERED = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY doc_id) version_number,
    lag(policy_version_id) OVER (PARTITION BY policy_id ORDER BY doc_id) supersedes FROM facts)"""
CURRENT = """current AS (
  SELECT policy_id, policy_version_id current_version_id FROM (
    SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY ready_at DESC, policy_version_id DESC) rn FROM facts WHERE parse_status='ready') WHERE rn=1)"""


def cleaning(source: str, out: str = "clean") -> str:
    """Line-wise cleaning of ``source`` (doc_id, text) with window functions over exploded lines."""
    hint = "(length(l)<=80 AND regexp_matches(l,'(?i)(copyright|all rights reserved|confidential|department of|policy platform)'))"
    return f"""ln AS (SELECT doc_id, unnest(string_split(t,{NL})) l, generate_subscripts(string_split(t,{NL}),1) i FROM (
    SELECT doc_id, trim(regexp_replace(text, '\\r\\n?', {NL}, 'g'), {WS}) t FROM {source})),
  k1 AS (SELECT doc_id, i, trim(l,{WS}) l FROM ln WHERE NOT regexp_matches(trim(l,{WS}), '(?i)^\\s*(pdf\\s*page|page\\s+\\d+\\s*(of\\s*\\d+)?)\\b')),
  k2 AS (SELECT *, {hint} art, row_number() OVER (PARTITION BY doc_id, {hint}, lower(l) ORDER BY i) rn FROM k1),
  k3 AS (SELECT doc_id, i, l, lag(nullif(l,'') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) p FROM k2 WHERE NOT art OR rn=1),
  mg AS (SELECT doc_id, string_agg(l,{NL} ORDER BY i) t FROM k3 WHERE l='' OR p IS NULL OR l<>p GROUP BY doc_id),
  {out} AS (SELECT d.doc_id, d.source, coalesce(trim(regexp_replace(regexp_replace(mg.t,'[ \\t]+',' ','g'),'\\n{{3,}}',{NL}||{NL},'g'),{WS}),'') t
    FROM documents d LEFT JOIN mg USING (doc_id))"""


SECTIONS = """cut AS (SELECT doc_id, source, t, unnest(generate_series(0, greatest(length(t)-1,0), 4000)) s FROM clean),
  sections AS (SELECT 'v'||doc_id||':'||(s//4000) section_id, 'v'||doc_id policy_version_id, doc_id, source policy_id, s//4000 section_index,
    CASE WHEN length(t)=0 THEN 'main' ELSE 'chunk-'||(s//4000+1) END section_path, CASE WHEN length(t)=0 THEN 'Main' ELSE 'Chunk '||(s//4000+1) END title,
    s start_offset, least(length(t), s+4000) end_offset, substr(t, s+1, 4000) AS text FROM cut)"""
CORPUS = f"""corpus AS (
  SELECT s.*, f.parse_status, f.effective_date, f.public_url, coalesce(c.current_version_id = s.policy_version_id, false) is_current, p.tenant_id, p.name policy_name,
    p.department_scope, p.authority_level, p.policy_type
  FROM sections s JOIN facts f USING (policy_version_id) JOIN policies p ON p.policy_id=s.policy_id LEFT JOIN current c ON c.policy_id=s.policy_id
  WHERE f.parse_status='ready')"""
DOCS = cleaning("documents")
BASE = [POLICIES, FACTS, CURRENT, DOCS, SECTIONS, CORPUS]
VECTORS = """vectors AS (
  SELECT e.vec_id, 'v'||e.vec_id policy_version_id, 'v'||e.vec_id||':0' section_id, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) emb, e.label, f.policy_id, p.tenant_id, p.policy_type,
    coalesce(c.current_version_id = f.policy_version_id, false) is_current
  FROM embeddings e JOIN facts f ON f.doc_id=e.vec_id JOIN policies p USING (policy_id) LEFT JOIN current c ON c.policy_id=f.policy_id WHERE f.parse_status='ready')"""
QUESTIONS = """questions AS (
  SELECT 'q'||item_id question_id, item_id, 'tenant-'||(item_id%2) tenant_id, text question, (['all','operations','claims_ops','compliance'])[(item_id+1)%4+1] department,
    item_id%4=3 only_current, CASE WHEN item_id%5=4 THEN ['general','guide'] END policy_types, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) vec
  FROM benchmark LEFT JOIN embeddings ON vec_id=item_id)"""
SCOPE = "q.tenant_id=c.tenant_id AND (NOT q.only_current OR c.is_current) AND (q.policy_types IS NULL OR list_contains(q.policy_types, c.policy_type))"


def vector_hits(k: int, scope: str, name: str = "vec") -> str:
    return f"""{name} AS (SELECT * FROM (
    SELECT * EXCLUDE (raw), greatest(0.0, least(1.0, raw)) score, row_number() OVER (PARTITION BY question_id ORDER BY raw DESC, section_id) AS rank FROM (
      SELECT q.question_id, c.section_id, c.policy_version_id, c.policy_id, c.label, q.item_id,
        round(list_cosine_similarity(q.vec, c.emb), 9) raw
      FROM questions q JOIN vectors c ON {scope} WHERE q.vec IS NOT NULL)) WHERE rank<={k})"""


FTS = f"""toks AS (SELECT section_id, unnest(tk) tok, generate_subscripts(tk,1) pos FROM (
    SELECT section_id, regexp_extract_all(lower(text),'[\\p{{L}}\\p{{N}}]+') tk FROM corpus)),
  occ AS (SELECT section_id, tok, list(pos ORDER BY pos) ps, count(*) n FROM toks WHERE tok NOT IN {STOPS} GROUP BY ALL),
  qa AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(lower(question),'[\\p{{L}}\\p{{N}}]+')) tok FROM questions),
  qand AS (SELECT *, count(*) OVER (PARTITION BY question_id) size FROM qa WHERE tok NOT IN {STOPS}),
  runs AS (SELECT question_id, list_filter(regexp_extract_all(question,'[A-Za-z0-9]+'), lambda t: length(t)>=3)[1:8] r FROM questions),
  qo AS (SELECT DISTINCT question_id, lower(unnest(r)) tok FROM runs WHERE len(r)>=2),
  qor AS (SELECT *, count(*) OVER (PARTITION BY question_id) size FROM qo WHERE tok NOT IN {STOPS}),
  allowed AS (SELECT q.question_id, c.section_id, c.policy_version_id, c.policy_id FROM questions q JOIN corpus c ON {SCOPE}),
  mand AS (SELECT a.question_id, a.section_id, any_value(size) size, list({{'tok': tok, 'ps': ps, 'n': n}} ORDER BY tok) ws
    FROM qand JOIN occ USING (tok) JOIN allowed a ON a.question_id=qand.question_id AND a.section_id=occ.section_id GROUP BY ALL HAVING count(*)=any_value(size)),
  pairs AS (SELECT question_id, section_id, size, unnest(ws) w1, ws FROM mand),
  pairs2 AS (SELECT question_id, section_id, size, w1, unnest(ws) w2 FROM pairs),
  pairs3 AS (SELECT question_id, section_id, unnest(w1.ps) p1, w2.ps ps2 FROM pairs2 WHERE w1.tok<w2.tok),
  pairs4 AS (SELECT question_id, section_id, abs(p1-p2) d FROM (SELECT question_id, section_id, p1, unnest(ps2) p2 FROM pairs3)),
  andrank AS (SELECT question_id, section_id, 1-product(1-sqrt(0.01*CASE WHEN d>100 THEN 1e-30 ELSE 1/(1.005+0.05*exp(d/1.5-2)) END)) score FROM pairs4 WHERE d>0 GROUP BY ALL),
  h2 AS (SELECT n, list_sum(list_transform(range(1, n+1), lambda j: 1.0::DOUBLE/(j*j))) h FROM (SELECT DISTINCT n FROM occ)),
  orrank AS (SELECT a.question_id, a.section_id, sum(0.1*h/1.64493406685)/any_value(size) score
    FROM qor JOIN occ USING (tok) JOIN h2 USING (n) JOIN allowed a ON a.question_id=qor.question_id AND a.section_id=occ.section_id GROUP BY ALL),
  found AS (
    SELECT m.question_id, m.section_id, coalesce(r.score, 0) score FROM mand m LEFT JOIN andrank r USING (question_id, section_id) WHERE m.size>1
    UNION ALL SELECT question_id, section_id, 0.1*h/1.64493406685 FROM mand JOIN h2 ON h2.n=ws[1].n WHERE size=1
    UNION ALL SELECT * FROM orrank WHERE question_id NOT IN (SELECT question_id FROM mand)),
  fts AS (SELECT * FROM (SELECT question_id, section_id, policy_version_id, policy_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, section_id) AS rank
    FROM (SELECT question_id, section_id, round(score,9) score FROM found) JOIN allowed USING (question_id, section_id)) WHERE rank<=20)"""
HYBRID = f"""{vector_hits(20, SCOPE)},
  v AS (SELECT *, score/max(score) OVER (PARTITION BY question_id) norm FROM vec WHERE score>=0.2),
  f AS (SELECT *, score/max(score) OVER (PARTITION BY question_id) norm FROM fts WHERE score>=0.05),
  m AS (SELECT coalesce(v.question_id,f.question_id) question_id, coalesce(v.section_id,f.section_id) section_id,
      least(1,coalesce(v.norm,0)) vector_score, least(1,coalesce(f.norm,0)) fts_score, coalesce(v.rank, 1000000+f.rank) ord
    FROM v FULL JOIN f ON v.question_id=f.question_id AND v.section_id=f.section_id),
  mc AS (SELECT m.*, c.* EXCLUDE (section_id), q.department user_department, epoch(c.effective_date::TIMESTAMP) ts FROM m JOIN corpus c USING (section_id) JOIN questions q USING (question_id)),
  mw AS (SELECT *, authority_level/greatest(1.0, max(authority_level) OVER w) authority_weight,
      CASE WHEN max(ts) OVER w > min(ts) OVER w THEN (ts-min(ts) OVER w)/(max(ts) OVER w-min(ts) OVER w) ELSE 0 END recency_weight,
      count(*) FILTER (vector_score>0) OVER w vector_candidates, count(*) FILTER (fts_score>0) OVER w fts_candidates, count(*) OVER w merged_candidates
    FROM mc WINDOW w AS (PARTITION BY question_id)),
  ms AS (SELECT *, round(0.45*vector_score+0.35*fts_score+0.15*authority_weight+0.05*recency_weight, 9) score FROM mw),
  mp AS (SELECT *, row_number() OVER (PARTITION BY question_id, policy_id ORDER BY score DESC, ord, section_id) pos FROM ms),
  fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ord, section_id) AS rank FROM mp WHERE pos<=2) WHERE rank<=40)"""
RANKED = """bk AS (SELECT *, CASE WHEN department_scope=user_department THEN 1 WHEN department_scope='all' THEN 2 ELSE 3 END bucket FROM fused),
  bp AS (SELECT *, bucket = min(bucket) OVER (PARTITION BY question_id) is_primary, min(bucket) OVER (PARTITION BY question_id) pb FROM bk),
  bc AS (SELECT *, count(*) FILTER (is_primary) OVER w primary_candidates, count(*) FILTER (NOT is_primary) OVER w secondary_candidates,
    min(bucket) OVER (PARTITION BY question_id, is_primary) fb, CASE WHEN is_current THEN score ELSE score*0.7 END eff FROM bp WINDOW w AS (PARTITION BY question_id)),
  ranked_all AS (SELECT *, row_number() OVER (PARTITION BY question_id, is_primary ORDER BY eff DESC, score DESC, authority_level DESC, effective_date DESC, policy_version_id DESC, section_id DESC) er FROM bc),
  ranked AS (SELECT * EXCLUDE (er), row_number() OVER (PARTITION BY question_id, is_primary ORDER BY er) evidence_rank,
    (['department_specific','org_wide','other'])[pb] selected_bucket FROM ranked_all WHERE bucket=fb)"""


def clipped(size: int, tail: str, c: str = "text") -> str:
    line = f"replace(trim({c},{WS}),{NL},' ')"
    return f"(CASE WHEN length({line})<={size} THEN {line} ELSE rtrim(substr({line},1,{size}),{WS})||'{tail}' END)"


CITE = "'[policy_version_id='||policy_version_id||' section_id='||section_id||']'"
ANSWERS = f"""best AS (SELECT * FROM ranked WHERE is_primary AND evidence_rank=1),
  ev AS (SELECT question_id, count(*) n_evidence, string_agg({CITE},'|' ORDER BY evidence_rank) FILTER (evidence_rank<=3) citations,
      string_agg({clipped(280, '...')},'|' ORDER BY evidence_rank) FILTER (evidence_rank<=5) snippets,
      string_agg(section_path,',' ORDER BY evidence_rank) FILTER (evidence_rank<=4) cites, string_agg(section_id,',' ORDER BY evidence_rank) sections,
      max(authority_level) top_level, bool_or(department_scope=user_department) own
    FROM ranked WHERE is_primary GROUP BY question_id),
  ans AS (SELECT q.question_id, q.question, q.department, b.score, b.department_scope best_dept, b.section_id best_section, coalesce(b.score,0)>=0.5 answered, ev.*  EXCLUDE (question_id), b.selected_bucket, b.merged_candidates,
      (SELECT count(*) FROM ms WHERE ms.question_id=q.question_id) filtered, {clipped(600, '…', 'b.text')}||' '||'[policy_version_id='||b.policy_version_id||' section_id='||b.section_id||']' excerpt, b.question_id IS NOT NULL has_rows
    FROM questions q LEFT JOIN best b USING (question_id) LEFT JOIN ev USING (question_id))"""
ASK = BASE + [VECTORS, QUESTIONS, FTS, HYBRID]
ASKED = ASK + [RANKED, ANSWERS]

STATUS = "(CASE event_type WHEN 'signup' THEN 'received' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'ready' ELSE 'failed' END)"
EVENTS = f"ev AS (SELECT user_id batch_id, CAST(json_extract_string(props,'$.k') AS BIGINT) item_id, ts, event_id seq, {STATUS} AS status FROM events)"
ITEMS = "items AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, item_id ORDER BY ts DESC, seq DESC) rn FROM ev) WHERE rn=1)"
PROGRESS = """SELECT batch_id, count(*) registered, count(*) FILTER (status IN ('received','queued','processing')) processing, count(*) FILTER (status='ready') ready,
  count(*) FILTER (status='failed') failed, count(*) FILTER (status IN ('received','queued','processing')) active,
  count(*) FILTER (status IN ('ready','failed')) >= count(*) is_complete FROM items GROUP BY batch_id"""

META = "sha256('{}')"
POLICY_OF_LANG = uuid5(ID_SPACE, "'policy/tenant-0/'||lang")
INCOMING = f"inc AS (SELECT doc_id, source, lang, text, length(text) n, sha256(text) sha, {META} msha, {POLICY_OF_LANG} policy_id FROM documents)"
VERSION_OF = uuid5(ID_SPACE, "'version/'||policy_id||'/'||sha||'/'||msha")
FIRST = "firsts AS (SELECT *, row_number() OVER (PARTITION BY policy_id, sha ORDER BY doc_id) rn, min(doc_id) OVER (PARTITION BY policy_id, sha) first_doc FROM inc)"

ANCHOR_SQL = "'<a href=\"([^\"]*)\">([^<]*)</a>'"
SCHEME_HOST = "regexp_extract(url,'^(https?://[^/?#]*)',1)"
LINKS = f"""raw AS (SELECT page_id, url, unnest(regexp_extract_all(html,{ANCHOR_SQL},1)) href, unnest(regexp_extract_all(html,{ANCHOR_SQL},2)) anchor_text,
    generate_subscripts(regexp_extract_all(html,{ANCHOR_SQL},1),1)-1 pos FROM pages),
  links AS (SELECT page_id, url, pos, trim(href,{WS}) href, trim(anchor_text,{WS}) anchor_text, regexp_replace({SCHEME_HOST}||trim(href,{WS}),'[?#].*$','') link FROM raw WHERE trim(href,{WS})<>'')"""
RELEVANT = """(regexp_matches(lower(regexp_extract(link,'^https?://[^/]*(.*)$',1)), '(\\.html|\\.pdf)$') OR contains(lower(regexp_extract(link,'^https?://[^/]*(.*)$',1)),'the')
  OR contains(lower(regexp_extract(link,'^https?://[^/]*(.*)$',1)),'policy')) AND contains(lower(regexp_extract(link,'^https?://([^/]*)',1)),'.example.')"""
EXTERNAL = "(coalesce(nullif(substr(trim(regexp_replace(lower({t}),'[^a-z0-9]+','-','g'),'-'),1,48),''),'document')||'-'||substr(sha1({u}),1,12))"
TITLE = "coalesce(nullif(anchor_text,''), nullif(regexp_extract(link,'([^/]*)$',1),''), link)"
MANIFEST = f"""manifest AS (SELECT link source_url, {TITLE} title, CASE WHEN lower(link) LIKE '%.pdf' THEN 'pdf' ELSE 'html' END doc_type, {EXTERNAL.format(t=TITLE, u='link')} external_id, 'DEMO' agency
  FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, pos) rn FROM links WHERE {RELEVANT}) WHERE rn=1)"""
HTML_TEXT = f"regexp_replace(regexp_replace(html,'(?s)<!--.*?-->',' ','g'),'(?is)(<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>)',' ','g')"
UNESCAPED = "replace(replace(replace(replace(replace(replace(replace({c},'&nbsp;',chr(160)),'&copy;','©'),'&middot;','·'),'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&amp;','&')"
DOWN = f"""mp AS (SELECT page_id, regexp_replace(url,'[?#].*$','') source_url, CASE WHEN length(html)%5=0 THEN 'pdf' ELSE 'html' END doc_type, html FROM pages),
  m1 AS (SELECT * EXCLUDE (rn), {EXTERNAL.format(t="'Page'", u='source_url')} external_id FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY page_id) rn FROM mp) WHERE rn=1),
  down AS (SELECT *, CASE WHEN length(html)%4=0 THEN 'cached_unchanged' WHEN strlen(html)%7=0 THEN 'missing' WHEN strlen(html)>12000 THEN 'too_large'
      WHEN doc_type='pdf' AND (lower(trim(substr(html,1,1024),{WS})) LIKE '<!doctype html%' OR lower(trim(substr(html,1,1024),{WS})) LIKE '<html%' OR lower(substr(html,1,1024)) LIKE '%<body%') THEN 'unexpected_html_for_pdf' ELSE 'ok' END AS status,
      CASE WHEN strlen(html)%7<>0 THEN strlen(html) END content_length FROM m1),
  dl AS (SELECT *, status NOT IN ('cached_unchanged','ok') skipped, CASE WHEN status='cached_unchanged' THEN sha256('old') WHEN status='ok' THEN sha256(html) END sha FROM down)"""

SUFFIX = "' See Section '||(doc_id%7+1)||' and pursuant to the Src S'||((doc_id*7+length(text))%40)||' Policy; 45 CFR §164.'||(doc_id%600)||'. HIPAA applies, https://x.example.org/'||doc_id||'.'"
REFS = f"""rt AS (SELECT doc_id, source policy_id, length(text) n, {SUFFIX} sfx, 'v'||doc_id||':0' section_id, (doc_id*7+length(text))%40 other FROM documents),
  refs AS (
    SELECT section_id, policy_id, doc_id, 'internal_section' reference_type, 'Section '||(doc_id%7+1) matched_text, n+5 match_offset, ''||(doc_id%7+1) parsed_section_path, NULL external_uri, NULL external_label, 1.0::DOUBLE confidence FROM rt
    UNION ALL SELECT section_id, policy_id, doc_id, 'internal_section', '§164.'||(doc_id%600), n+strpos(sfx,'§164')-1, '164.'||(doc_id%600), NULL, NULL, 1.0 FROM rt
    UNION ALL SELECT section_id, policy_id, doc_id, 'cross_policy', 'Src S'||other||' Policy', n+strpos(sfx,'Src S')-1, NULL, NULL, NULL, 1.0 FROM rt
    UNION ALL SELECT section_id, policy_id, doc_id, 'external_authority', '45 CFR §164.'||(doc_id%600), n+strpos(sfx,'45 CFR')-1, NULL, NULL, '45 CFR §164.'||(doc_id%600), 1.0 FROM rt
    UNION ALL SELECT section_id, policy_id, doc_id, 'external_authority', 'HIPAA', n+strpos(sfx,'HIPAA')-1, NULL, NULL, 'HIPAA', 0.85 FROM rt
    UNION ALL SELECT section_id, policy_id, doc_id, 'external_authority', 'https://x.example.org/'||doc_id, n+strpos(sfx,'https')-1, NULL, 'https://x.example.org/'||doc_id, 'https://x.example.org/'||doc_id, 1.0 FROM rt)"""
EDGES = """edges AS (
    SELECT r.section_id source_section_id, reference_type, CASE WHEN s.section_id IS NULL THEN 'unresolved' ELSE 'resolved' END resolution_status, matched_text, match_offset, s.section_id target_section_id,
      CASE WHEN s.section_id IS NOT NULL THEN r.policy_id END target_policy_id, NULL target_external_label
    FROM refs r LEFT JOIN sections s ON s.doc_id=r.doc_id AND s.section_path='chunk-'||r.parsed_section_path WHERE reference_type='internal_section' AND s.section_id IS DISTINCT FROM r.section_id
    UNION ALL SELECT r.section_id, reference_type, CASE WHEN p.policy_id IS NULL THEN 'unresolved' ELSE 'resolved' END, matched_text, match_offset, NULL, p.policy_id, NULL
    FROM refs r LEFT JOIN policies p ON p.name=r.matched_text AND p.tenant_id=(SELECT tenant_id FROM policies o WHERE o.policy_id=r.policy_id)
    WHERE reference_type='cross_policy' AND p.policy_id IS DISTINCT FROM r.policy_id
    UNION ALL SELECT section_id, reference_type, 'external', matched_text, match_offset, NULL, NULL, external_label FROM refs WHERE reference_type='external_authority')"""
CATALOG_TEXT = f"'D-'||doc_id||' Document '||doc_id||{NL}||{NL}||'Control:'||{NL}||trim(rtrim('Keep [Assignment: organization-defined '||lang||'] or [organization-defined parameter]: '||text,{WS})||{NL}||'  a. item of '||lang,{WS})||{NL}||{NL}||'Discussion:'||{NL}||'Source '||source"

ORACLE: dict[str, str] = {
    "version_lineage": ctes(FACTS, NUMBERED) + "SELECT policy_id, policy_version_id, version_number, supersedes supersedes_policy_version_id FROM numbered",
    "current_versions": ctes(FACTS, CURRENT) + "SELECT * FROM current",
    "policy_catalog": ctes(POLICIES, FACTS, NUMBERED, CURRENT) + """SELECT p.policy_id, tenant_id, name, CAST(authority_level AS BIGINT) authority_level, department_scope, policy_type, current_version_id,
  max(version_number) latest_number, arg_max(policy_version_id, version_number) latest_version_id FROM policies p JOIN current USING (policy_id) JOIN numbered n ON n.policy_id=p.policy_id GROUP BY ALL""",
    "duplicate_rejects": ctes(INCOMING, FIRST) + f"SELECT doc_id arrival_seq, policy_id, 'duplicate' reason, {VERSION_OF} existing_policy_version_id FROM firsts WHERE rn>1",
    "label_conflicts": ctes(INCOMING) + f"""SELECT doc_id arrival_seq, n::VARCHAR version_label, CASE WHEN sha=first_sha THEN 'duplicate' ELSE 'label_conflict' END reason, CASE WHEN sha=first_sha THEN {VERSION_OF} END existing_policy_version_id
FROM (SELECT *, row_number() OVER w rn, first_value(sha) OVER w first_sha FROM inc WINDOW w AS (PARTITION BY policy_id, n ORDER BY doc_id)) WHERE rn>1""",
    "registered_versions": ctes(INCOMING, FIRST) + f"""SELECT doc_id arrival_seq, policy_id, {VERSION_OF} policy_version_id, row_number() OVER w version_number, lag({VERSION_OF}) OVER w supersedes_policy_version_id,
  sha content_sha256, msha metadata_sha256, 'pending' parse_status FROM firsts WHERE rn=1 WINDOW w AS (PARTITION BY policy_id ORDER BY doc_id)""",
    "registered_items": ctes(INCOMING, FIRST) + "SELECT source batch_id, 'queued' AS status, count(*) n_items, count(DISTINCT policy_id) n_policies FROM firsts WHERE rn=1 GROUP BY source",
    "policy_first_write": f"""WITH won AS (SELECT source, doc_id, length(text) n, row_number() OVER (PARTITION BY source, sha256(text), doc_id%3*(length(text)%2) ORDER BY doc_id) rn FROM documents),
  w AS (SELECT *, CASE WHEN n%3<>0 THEN 'kind'||(n%4) END kind, CASE WHEN n%2<>0 THEN 'dept'||(doc_id%3) END dept, CASE WHEN n%5>0 THEN n%5 END lvl FROM won WHERE rn=1)
SELECT source external_id, {uuid5(ID_SPACE, "'policy/tenant-0/'||source")} policy_id, arg_min(kind, doc_id) FILTER (kind IS NOT NULL) policy_type,
  coalesce(arg_min(dept, doc_id) FILTER (dept IS NOT NULL), 'all') department_scope, coalesce(arg_min(lvl, doc_id) FILTER (lvl IS NOT NULL), 0) authority_level, 'draft' AS status FROM w GROUP BY source""",
    "section_chunks": ctes(DOCS, SECTIONS) + "SELECT section_id, policy_version_id, section_index, section_path, title, start_offset, end_offset, sha256(text) content_sha256 FROM sections",
    "section_page": ctes(DOCS, SECTIONS) + "SELECT policy_version_id, section_index, section_path, title FROM sections ORDER BY policy_version_id, section_index LIMIT 200 OFFSET 200",
    "section_detail": ctes(POLICIES, FACTS, NUMBERED, CURRENT, DOCS, SECTIONS) + """SELECT section_id, n.policy_id, section_path, title, length(text) n_chars, version_number, effective_date, parse_status, c.current_version_id=n.policy_version_id is_current,
  public_url, p.name policy_name, department_scope FROM sections s JOIN numbered n USING (policy_version_id) JOIN policies p ON p.policy_id=n.policy_id JOIN current c ON c.policy_id=n.policy_id""",
    "clean_lines": ctes(
        f"""dirty AS (SELECT doc_id, '  Confidential - '||source||chr(13)||{NL}||'Page '||doc_id||' of 9'||chr(13)||'PDF  page x'||{NL}||text||{NL}||{NL}||{NL}||{NL}||upper('Confidential - '||source)||{NL}||chr(9)||'Same line'||chr(9)||' here'||{NL}||{NL}||
  'Same line'||chr(9)||' here'||{NL}||'All rights reserved {'x' * 80}'||{NL}||'All rights reserved {'x' * 80}'||{NL}||'End  '||{NL}||'Confidential - '||source||{NL}||'paged 3'||{NL}||'  ' AS text FROM documents)""",
        cleaning("dirty"),
    ) + "SELECT doc_id, length(t) n_chars, sha256(t) sha256 FROM clean",
    "extracted_documents": ctes(POLICIES, DOCS, SECTIONS) + """SELECT policy_version_id, count(*) n_sections, 'tenants/'||any_value(tenant_id)||'/policies/'||policy_id||'/versions/'||policy_version_id||'/extracted.json' extracted_blob_name,
  sha256(string_agg(text,'' ORDER BY section_index)) text_sha256, max(end_offset) end_offset FROM sections JOIN policies USING (policy_id) GROUP BY policy_version_id, policy_id""",
    "item_status": ctes(EVENTS, ITEMS) + "SELECT batch_id, item_id, status, ts updated_at FROM items",
    "batch_progress": ctes(EVENTS, ITEMS) + PROGRESS,
    "stream_progress": ctes(EVENTS, ITEMS) + PROGRESS,
    "batch_status": ctes(
        EVENTS, "st AS (SELECT *, CAST(status IN ('received','queued','processing') AS INT) a, lag(CAST(status IN ('received','queued','processing') AS INT), 1, 0) OVER (PARTITION BY batch_id, item_id ORDER BY ts, seq) b FROM ev)",
        "act AS (SELECT *, sum(a-b) OVER (PARTITION BY batch_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) active FROM st)",
        "ch AS (SELECT *, CASE WHEN status='processing' THEN 'processing' WHEN status='ready' AND active=0 THEN 'completed' WHEN status='failed' AND active=0 THEN 'failed' END change FROM act)",
    ) + "SELECT batch_id, coalesce(arg_max(change, (ts, seq)) FILTER (change IS NOT NULL), 'received') batch_status FROM ch GROUP BY batch_id",
    "stream_batch_status": ctes(
        EVENTS, ITEMS, "st AS (SELECT *, CAST(status IN ('received','queued','processing') AS INT) a, lag(CAST(status IN ('received','queued','processing') AS INT), 1, 0) OVER (PARTITION BY batch_id, item_id ORDER BY ts, seq) b FROM ev)",
        "act AS (SELECT *, sum(a-b) OVER (PARTITION BY batch_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) active FROM st)",
        "ch AS (SELECT *, CASE WHEN status='processing' THEN 'processing' WHEN status='ready' AND active=0 THEN 'completed' WHEN status='failed' AND active=0 THEN 'failed' END change FROM act)",
        "left_over AS (SELECT batch_id, count(*) FILTER (status IN ('received','queued','processing')) active FROM items GROUP BY batch_id)",
    ) + """SELECT batch_id, batch_status, active FROM (SELECT batch_id, coalesce(arg_max(change, (ts, seq)) FILTER (change IS NOT NULL), 'received') batch_status FROM ch GROUP BY batch_id) JOIN left_over USING (batch_id)""",
    "stream_sliding": """SELECT start AS window_start, event_type AS status, count(*) AS n FROM (
  SELECT event_type, unnest(list_transform(range(4), lambda i: time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 12 HOUR)) AS start FROM events) GROUP BY ALL""",
    "stream_sessions": ctes(
        "e AS (SELECT user_id, ts, event_id, event_id%97=0 held, max(ts) FILTER (event_id%97<>0) OVER (PARTITION BY user_id) - INTERVAL 3 DAY horizon FROM events)",
        "ok AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR, true) fresh FROM e WHERE NOT held OR ts > horizon OR horizon IS NULL)",
        "island AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) k FROM ok)",
    ) + """SELECT user_id, min(ts) session_start, max(ts) session_end, count(*) n, 'session' kind FROM island GROUP BY user_id, k
UNION ALL SELECT user_id, ts, ts, 1, 'late' FROM e WHERE held AND ts <= horizon""",
    "status_report": ctes(EVENTS, ITEMS) + "SELECT count(*) total, " + ", ".join(f"count(*) FILTER (status='{s}') {s}" for s in ("received", "queued", "processing", "ready", "failed")) + " FROM items",
    "stream_throughput": "SELECT date_trunc('day', ts)::TIMESTAMP window_start, event_type AS status, count(*) n FROM events GROUP BY ALL",
    "tenant_counts": ctes(POLICIES, FACTS, CURRENT, DOCS, SECTIONS, VECTORS) + """SELECT tenant_id, policy_sections, policy_embeddings FROM (SELECT tenant_id, count(*) policy_sections FROM sections JOIN policies USING (policy_id) GROUP BY 1)
  LEFT JOIN (SELECT tenant_id, count(*) policy_embeddings FROM vectors GROUP BY 1) USING (tenant_id)""",
    "embed_backlog": ctes(*BASE) + "SELECT section_id, policy_version_id, policy_id FROM corpus WHERE section_id NOT IN (SELECT 'v'||vec_id||':0' FROM embeddings)",
    "embedding_text": ctes(*BASE) + f"""SELECT section_id, length(t) n_chars, sha256(t) sha256 FROM (SELECT section_id, 'Policy Type: '||policy_type||{NL}||'Department Scope: '||department_scope||{NL}||'Authority Level: '||authority_level||{NL}||
  'Section Title: '||title||{NL}||{NL}||text t FROM corpus)""",
    "vector_topk": ctes(POLICIES, FACTS, CURRENT, VECTORS, QUESTIONS, vector_hits(20, SCOPE)) + "SELECT question_id, section_id, round(score,6) score, rank FROM vec",
    "vector_topk_unscoped": ctes(POLICIES, FACTS, CURRENT, VECTORS, QUESTIONS, vector_hits(40, "q.tenant_id=c.tenant_id")) + "SELECT question_id, section_id, round(score,6) score, rank FROM vec",
    "id_boost": ctes(POLICIES, FACTS, CURRENT, VECTORS, QUESTIONS, vector_hits(20, SCOPE)) + """SELECT question_id, section_id, round(CASE WHEN label=item_id%10 THEN least(0.99, score+0.4) ELSE score END,6) score, 'AC-'||(item_id%10)||',IA-5(1)' AS named FROM vec""",
    "answers_by_id": ctes(*BASE, VECTORS, QUESTIONS, vector_hits(40, "q.tenant_id=c.tenant_id"), """fused AS (
  SELECT v.question_id, c.*, q.department user_department, NULL::BIGINT merged_candidates, CASE WHEN v.label=v.item_id%10 THEN least(0.99, v.score+0.4) ELSE v.score END score
  FROM vec v JOIN corpus c USING (section_id) JOIN questions q USING (question_id) WHERE length(c.text)>0)""", "ms AS (SELECT question_id FROM fused)", RANKED, ANSWERS)
    + f"""SELECT question_id, CASE WHEN answered THEN excerpt ELSE {REFUSAL} END answer, CASE WHEN NOT answered THEN 'insufficient_evidence' END refusal_reason, CASE WHEN answered THEN round(score,6) ELSE 0 END confidence,
  coalesce(n_evidence,0) n_evidence, CASE WHEN answered THEN citations ELSE '' END citations, CASE WHEN answered THEN snippets ELSE '' END snippets, CASE WHEN answered THEN selected_bucket END decision_bucket,
  CASE WHEN answered THEN department END user_department, coalesce(n_evidence,0) merged, coalesce(n_evidence,0) filtered, round(coalesce(score,0),6) primary_score FROM ans""",
    "vector_literals": """SELECT vec_id, '['||array_to_string(list_transform(embedding, lambda x: format('{:.12g}', CAST(x AS DOUBLE))), ',')||']' literal,
  '['||array_to_string(list_transform(embedding, lambda x, i: format('{:.12g}', CAST(x AS DOUBLE) * pow(10.0::DOUBLE, (i-1)%20))), ',')||']' large,
  '['||array_to_string(list_transform(embedding, lambda x, i: format('{:.12g}', CAST(x AS DOUBLE) / pow(10.0::DOUBLE, (i-1)%14))), ',')||']' small FROM embeddings""",
    "fts_rank": ctes(*BASE, QUESTIONS, FTS) + "SELECT question_id, section_id, round(score,6) score, rank FROM fts",
    "postings": ctes(*BASE, QUESTIONS, FTS) + "SELECT section_id, count(*) n_words, CAST(sum(n) AS BIGINT) n_positions, max(ps[-1]) last_position FROM occ GROUP BY section_id",
    "hybrid_fusion": ctes(*ASK) + """SELECT question_id, section_id, policy_id, round(score,6) score, round(vector_score,6) vector_score, round(fts_score,6) fts_score, round(authority_weight,6) authority_weight, round(recency_weight,6) recency_weight,
  CASE WHEN vector_score>=fts_score AND vector_score>0 THEN 'vector' ELSE 'fts' END retriever_source, vector_candidates, fts_candidates, merged_candidates, merged_candidates filtered_candidates, rank FROM fused""",
    "dept_ranked": ctes(*ASK, RANKED) + "SELECT question_id, section_id, selected_bucket, is_primary, CAST(bucket AS BIGINT) bucket, evidence_rank, primary_candidates, secondary_candidates FROM ranked",
    "secondary_all": ctes(*ASK, RANKED) + "SELECT question_id, section_id, CAST(bucket AS BIGINT) bucket, er evidence_rank FROM ranked_all WHERE NOT is_primary",
    "answers": ctes(*ASKED) + f"""SELECT question_id, CASE WHEN answered THEN excerpt ELSE {REFUSAL} END answer, CASE WHEN NOT answered THEN 'insufficient_evidence' END refusal_reason, CASE WHEN answered THEN round(score,6) ELSE 0 END confidence,
  coalesce(n_evidence,0) n_evidence, CASE WHEN answered THEN citations ELSE '' END citations, CASE WHEN answered THEN snippets ELSE '' END snippets, CASE WHEN answered THEN selected_bucket END decision_bucket,
  CASE WHEN answered THEN department END user_department, coalesce(merged_candidates,0) merged, filtered, round(coalesce(score,0),6) primary_score FROM ans""",
    "secondary_evidence": ctes(*ASKED) + """SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY evidence_rank)-1 pos, section_id, score, department_scope FROM (
  SELECT r.question_id, r.evidence_rank, r.section_id, round(r.score,6) score, r.department_scope FROM ranked r JOIN ans a USING (question_id)
  WHERE NOT r.is_primary AND a.answered AND r.department_scope<>a.best_dept AND r.score>=a.score*0.5) QUALIFY pos<3""",
    "prompts": ctes(*ASKED) + f"""SELECT question_id, length(p) n_chars, sha256(p) sha256 FROM (SELECT a.question_id, 'Question: '||any_value(a.question)||{NL}||{NL}||'Evidence:'||{NL}||
  string_agg('['||evidence_rank||'] '||{CITE}||' '||{clipped(600, '…')}, {NL} ORDER BY evidence_rank)||{NL}||{NL}||'Answer (cite using the format [policy_version_id=... section_id=...]):' p
  FROM ans a JOIN ranked r USING (question_id) WHERE a.answered AND r.is_primary AND r.evidence_rank<=5 GROUP BY a.question_id)""",
    "answer_card": ctes(*ASKED) + """SELECT question_id, CASE WHEN coalesce(top_level,0)>0 THEN 'A'||top_level ELSE 'N/A' END top_authority, CASE WHEN own THEN 'Dept-specific' ELSE 'Org-wide' END bucket_label,
  (SELECT section_id FROM ranked r WHERE r.question_id=ans.question_id AND is_primary ORDER BY score DESC, evidence_rank LIMIT 1) best_section_id FROM ans""",
    "evidence_packet": ctes(*ASKED) + "SELECT question_id, coalesce(sections,'') sections FROM ans",
    "model_answers": ctes(*ASKED) + f"""SELECT question_id, CASE WHEN NOT ok THEN {REFUSAL} WHEN no THEN 'Sorry: '||upper({REFUSAL}) ELSE 'Yes. [policy_version_id=x]' END answer, CASE WHEN NOT ok OR no THEN 'insufficient_evidence' END refusal_reason,
  CASE WHEN ok THEN round(score,6) ELSE 0 END confidence, ok AND NOT no cited, CASE WHEN ok AND NOT no THEN least(n_evidence,3) ELSE 0 END n_citations FROM (SELECT *, coalesce(score,0)>=0.3 ok, length(question)%2=0 AS no FROM ans)""",
    "audit_append": """SELECT 'tenant-'||(a.conv_id%2) tenant_id, 'ask' event_type, 'c-'||a.conv_id||'-'||a.turn question_id, sha256(a.text) question_sha256, sha256(b.text) answer_sha256
FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn=a.turn+1 WHERE a.role='user' AND b.role='assistant'""",
    "audit_replay": ctes(*ASKED) + "SELECT question_id, true same, CASE WHEN answered THEN round(score,6) ELSE 0 END old_confidence, CASE WHEN answered THEN round(score,6) ELSE 0 END new_confidence FROM ans",
    "eval_outcomes": ctes(*ASKED, "ex AS (SELECT 'q'||item_id question_id, CASE quality WHEN 1 THEN 'labelled good' WHEN 0 THEN 'labelled bad' ELSE 'unlabelled' END category, CASE WHEN coalesce(quality,1)=1 THEN 'ground' ELSE 'refuse' END expectation FROM benchmark LEFT JOIN labels ON doc_id=item_id)") + """SELECT question_id, category, expectation, CASE WHEN answered THEN 'ANSWERED' ELSE 'REFUSED' END AS status, answered = (expectation='ground') ok, CASE WHEN answered THEN cites ELSE '' END cites FROM ex JOIN ans USING (question_id)""",
    "eval_report": ctes(*ASKED, "ex AS (SELECT 'q'||item_id question_id, CASE quality WHEN 1 THEN 'labelled good' WHEN 0 THEN 'labelled bad' ELSE 'unlabelled' END category, CASE WHEN coalesce(quality,1)=1 THEN 'ground' ELSE 'refuse' END expectation FROM benchmark LEFT JOIN labels ON doc_id=item_id)") + """SELECT category, count(*) FILTER (answered = (expectation='ground')) passed, count(*) total, count(*) FILTER (NOT answered) refused, 0::BIGINT errors FROM ex JOIN ans USING (question_id) GROUP BY ROLLUP (category)""",
    "refs_extracted": ctes(REFS) + "SELECT section_id, reference_type, matched_text, match_offset, parsed_section_path, external_uri, external_label, confidence FROM refs",
    "refs_resolved": ctes(POLICIES, DOCS, SECTIONS, REFS, EDGES) + "SELECT * FROM edges",
    "refs_inbound": ctes(POLICIES, DOCS, SECTIONS, REFS, EDGES) + """SELECT target_policy_id, target_section_id, CASE WHEN target_section_id IS NULL THEN p.name ELSE p.name||' · '||s.title END target_text, count(*) inbound
  FROM edges JOIN policies p ON p.policy_id=target_policy_id LEFT JOIN sections s ON s.section_id=target_section_id GROUP BY ALL""",
    "name_similarity": f"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(list_transform(regexp_extract_all(text,'[A-Za-z0-9]+'), lambda t: lower(t)), lambda t: t NOT IN {NAME_STOPS})) s FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.s)=0 OR len(b.s)=0 THEN 0 ELSE len(list_intersect(a.s,b.s))/greatest(len(a.s),len(b.s)) END,6) score FROM w a JOIN w b ON a.conv_id=b.conv_id AND b.turn=a.turn+1""",
    "reference_backfill": ctes(POLICIES, FACTS, REFS) + """SELECT policy_version_id, CAST(3 + 1 + CASE WHEN p.policy_id=rt.policy_id THEN 0 ELSE 1 END + CASE WHEN doc_id%7=0 THEN 0 ELSE 1 END AS BIGINT) n_edges
  FROM rt JOIN facts USING (doc_id) LEFT JOIN policies o ON o.policy_id=rt.policy_id LEFT JOIN policies p ON p.idx=rt.other AND p.tenant_id=o.tenant_id WHERE parse_status='ready'""",
    "page_text": f"""SELECT page_id, length(t) n_chars, sha256(t) sha256 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(replace({UNESCAPED.format(c="regexp_replace(regexp_replace(regexp_replace(" + HTML_TEXT + ",'(?i)<br\\s*/?>'," + NL + ",'g'),'(?i)</p\\s*>'," + NL + "||" + NL + ",'g'),'<[^>]+>',' ','g')")},chr(13),''),'\\n{{3,}}',{NL}||{NL},'g'),'[ \\t]{{2,}}',' ','g'),{WS}) t FROM pages)""",
    "page_links": ctes(LINKS) + "SELECT page_id, pos, href, anchor_text, link FROM links",
    "link_manifest": ctes(LINKS, MANIFEST) + "SELECT * FROM manifest",
    "link_expansion": ctes(
        LINKS, f"h1 AS (SELECT * FROM (SELECT link, {TITLE} title, 1 hop, row_number() OVER (PARTITION BY link ORDER BY page_id, pos) rn FROM links WHERE {RELEVANT}) WHERE rn=1)",
        f"again AS (SELECT page_id, pos, anchor_text, regexp_replace({SCHEME_HOST},'^http:','https:')||'/the' home, regexp_replace(regexp_replace({SCHEME_HOST},'^http:','https:')||href,'[?#].*$','') link FROM links)",
        f"h2 AS (SELECT * FROM (SELECT link, {TITLE} title, 2 hop, row_number() OVER (PARTITION BY link ORDER BY page_id, pos) rn FROM again WHERE home IN (SELECT link FROM h1 WHERE link LIKE '%/the') AND {RELEVANT}) WHERE rn=1 AND link NOT IN (SELECT link FROM h1))",
    ) + f"SELECT link source_url, {EXTERNAL.format(t='title', u='link')} external_id, hop::BIGINT hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)",
    "download_status": ctes(DOWN) + "SELECT page_id, source_url, doc_type, status, skipped, content_length, sha sha256 FROM dl",
    "download_index": ctes(DOWN) + """SELECT source_url, sha current_sha256, CASE WHEN status='ok' THEN 'external/demo/'||external_id||'/'||substr(sha,1,12)||CASE WHEN doc_type='pdf' THEN '.pdf' ELSE '.html' END ELSE 'old.html' END current_path, 1::BIGINT n_paths FROM dl WHERE status IN ('ok','cached_unchanged')""",
    "resume_report": ctes(DOWN) + """SELECT CASE WHEN skipped THEN 'skipped' WHEN page_id%3<2 THEN 'resumed-skip' ELSE 'pending' END resume, CASE WHEN skipped THEN status WHEN page_id%3=0 THEN 'prior_status=registered' WHEN page_id%3=1 THEN 'prior_status=conflict' END detail, count(*) n FROM dl GROUP BY ALL""",
    "slug_join": """WITH t AS (SELECT page_id, string_split_regex(regexp_replace(regexp_extract(html,'<title>([^<]*)</title>',1),'[^A-Za-z ]','','g'),' +') w FROM pages),
  n AS (SELECT page_id, w[1] w1, concat_ws('-', w[1], w[2], page_id) tail FROM t),
  l AS (SELECT page_id pos, 'https://x.example.org/p/'||tail url, trim(regexp_replace(lower(tail),'[^a-z0-9]+','-','g'),'-') slug FROM n),
  f AS (SELECT page_id, trim(regexp_replace(lower(CASE page_id%3 WHEN 0 THEN tail WHEN 1 THEN 'old_'||tail ELSE w1 END),'[^a-z0-9]+','-','g'),'-') file_slug FROM n)
SELECT page_id, file_slug, coalesce((SELECT arg_min(url,pos) FROM l WHERE slug=file_slug), (SELECT arg_min(url,pos) FROM l WHERE slug<>'' AND (contains(slug,file_slug) OR contains(file_slug,slug)))) source_url FROM f""",
    "url_checks": "WITH u AS (SELECT page_id, 'page' kind, lower(regexp_extract(url,'^[a-z]+://([^/?#:]*)',1)) host, 'http' scheme, NULL::BIGINT n FROM pages UNION ALL SELECT page_id, 'literal', (page_id*37%256)||'.'||(page_id*11%256)||'.'||(page_id%256)||'.7', CASE WHEN page_id%9=0 THEN 'ftp' ELSE 'http' END, (page_id*37%256)*16777216+(page_id*11%256)*65536+(page_id%256)*256+7 FROM pages) SELECT page_id, kind, host, CASE WHEN scheme='ftp' THEN 'scheme' "
    + " ".join(
        "WHEN n BETWEEN {0} AND {1} THEN '{2}'".format(
            sum(int(x) << (24 - 8 * i) for i, x in enumerate(net.split("."))), sum(int(x) << (24 - 8 * i) for i, x in enumerate(net.split("."))) + (1 << (32 - bits)) - 1, name
        )
        for net, bits, name in BLOCKED_V4
    )
    + " END rejection FROM u",
    "metadata_hash": "SELECT event_id, sha256(replace(props,': ',':')) sha256 FROM events",
    "message_guard": f"""SELECT event_id, CASE WHEN event_type IN ('view','purchase') THEN {uuid5(ID_SPACE, "event_id::VARCHAR")} END policy_version_id,
  CASE event_type WHEN 'signup' THEN 'Invalid JSON payload' WHEN 'click' THEN 'Unexpected message type: policy.other' WHEN 'error' THEN 'Invalid UUID for policy_version_id' END error FROM events""",
    "catalog_sections": f"""WITH c AS (SELECT source, doc_id, 0 sub, 'd-'||doc_id cid, 'D-'||doc_id label, 'Document '||doc_id title, {CATALOG_TEXT} t FROM documents WHERE length(text)%3<>0
  UNION ALL SELECT source, doc_id, 1, 'd-'||doc_id||'.1', 'D-'||doc_id||'.1', 'More', 'D-'||doc_id||'.1 More' FROM documents)
SELECT {uuid5(CATALOG_SPACE, "'section/'||upper(source)||'/'||cid")} section_id, {uuid5(CATALOG_SPACE, "'version/'||upper(source)")} policy_version_id, row_number() OVER (PARTITION BY source ORDER BY doc_id, sub)-1 section_index, label section_path, title, length(t) end_offset, sha256(t) content_sha256 FROM c""",
    "catalog_policies": f"""SELECT {uuid5(CATALOG_SPACE, "'policy/'||upper(source)")} policy_id, source external_id, 'Catalog — Family '||source||' ('||upper(source)||')' AS name, {uuid5(CATALOG_SPACE, "'version/'||upper(source)")} current_version_id FROM (SELECT DISTINCT source FROM documents)""",
    "nested_versions": ctes(FACTS, NUMBERED) + "SELECT policy_id, policy_version_id, version_number, parse_status FROM numbered",
    "stream_ingest": ctes(DOCS, SECTIONS) + f"SELECT {uuid5(ID_SPACE, chr(39) + 'doc/' + chr(39) + '||doc_id')} policy_version_id, count(*) n_sections, max(end_offset) n_chars FROM sections GROUP BY doc_id",
    "embed_backfill": ctes(*BASE) + "SELECT policy_id, count(*) inserted, 1.0::DOUBLE avg_norm FROM corpus WHERE section_id NOT IN (SELECT 'v'||vec_id||':0' FROM embeddings) GROUP BY policy_id",
    "sink_commits": ctes(DOCS, SECTIONS) + """SELECT policy_version_id, count(*) n_sections, CAST(sum(length(text)) * (CASE WHEN doc_id%3=0 THEN 2 ELSE 1 END) AS BIGINT) AS n_chars,
  CAST(sum(count(*)) OVER () AS BIGINT) AS before, 4::BIGINT AS left_over FROM sections WHERE doc_id%15<>0 GROUP BY policy_version_id, doc_id""",
    "stream_counts": ctes(DOCS, SECTIONS) + """SELECT count(*) + count(*) FILTER (doc_id%3=0) scanned, count(*) FILTER (doc_id%3=0) skipped, count(*) inserted,
  (SELECT count(*) FROM sections) sections, 0::BIGINT failed FROM documents""",
    "backfill_counts": ctes(*BASE, REFS) + """SELECT 'embeddings' job, 'scanned' AS name, count(*) n FROM corpus
UNION ALL SELECT 'embeddings', 'inserted', count(*) FROM corpus WHERE section_id NOT IN (SELECT 'v'||vec_id||':0' FROM embeddings)
UNION ALL SELECT 'references', 'scanned', count(*) FROM rt JOIN facts USING (doc_id) WHERE parse_status='ready'
UNION ALL SELECT 'references', 'inserted', CAST(sum(3 + 1 + CASE WHEN p.policy_id=rt.policy_id THEN 0 ELSE 1 END + CASE WHEN doc_id%7=0 THEN 0 ELSE 1 END) AS BIGINT)
  FROM rt JOIN facts USING (doc_id) LEFT JOIN policies o ON o.policy_id=rt.policy_id LEFT JOIN policies p ON p.idx=rt.other AND p.tenant_id=o.tenant_id WHERE parse_status='ready'""",
    "stream_redelivery": ctes(DOCS, SECTIONS, """asked AS (
  SELECT doc_id, source, doc_id%3=0 again, (doc_id*7919)%100003 k, row_number() OVER (PARTITION BY source ORDER BY doc_id%3=0 DESC, (doc_id*7919)%100003 DESC, doc_id) rn FROM documents)""",
        "cut_up AS (SELECT doc_id, count(*) n_sections, max(end_offset) n_chars FROM sections GROUP BY doc_id)")
    + f"""SELECT {uuid5(ID_SPACE, chr(39) + 'doc/' + chr(39) + '||doc_id')} policy_version_id, coalesce(n_sections,0) n_sections, n_chars, 'ready' parse_status, rn=1 is_current
FROM asked LEFT JOIN cut_up USING (doc_id)""",
    "process_current": ctes(FACTS) + """SELECT policy_id, policy_version_id current_version_id FROM (
  SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY (doc_id*7919)%100003 DESC, policy_version_id DESC) rn FROM facts WHERE parse_status='ready') WHERE rn=1""",
    "process_items": ctes(FACTS) + """SELECT policy_id batch_id, count(*) items, count(*) FILTER (parse_status='ready') completed, count(*) FILTER (parse_status='failed') failed FROM facts GROUP BY 1""",
    "registration_rejects": """SELECT doc_id arrival_seq, CASE doc_id%6 WHEN 0 THEN 'metadata_json must be a JSON object' WHEN 1 THEN 'metadata_json must be a JSON object' WHEN 2 THEN 'policy_name longer than 512'
  WHEN 3 THEN 'authority_level must not be negative' WHEN 4 THEN 'document has no readable text' END reason FROM documents WHERE doc_id%6<5""",
    "file_plan": """SELECT source||'/doc_'||doc_id||'-2024-01-05.txt' source_file, ext policy_external_id, 'Doc '||doc_id||' 2024 01 05' policy_name, DATE '2024-01-05' effective_date, 'text/plain' content_type, sha256(text) file_sha256,
  'v1-S1-'||substr(sha256(text),1,8) version_label, 'external/demo/'||ext||'/S1-doc_'||doc_id||'-2024-01-05.txt' blob_path FROM (SELECT *, 'docs-demo-'||substr(sha1(source||'/doc_'||doc_id||'-2024-01-05'),1,12) ext FROM documents)""",
    "request_fields": """SELECT conv_id, turn, CASE WHEN turn%2=0 THEN 'tenant-'||(conv_id%2) ELSE 'local' END tenant_id, text question, CASE WHEN turn%2=1 THEN role END department, turn%2=1 only_current FROM conversations""",
    "page_documents": ctes(
        LINKS,
        "byp AS (SELECT page_id, count(*) n_links, string_agg(l, chr(10) ORDER BY l) ls FROM (SELECT DISTINCT page_id, " + SCHEME_HOST + "||regexp_replace(href,'#.*$','') l FROM links) GROUP BY page_id)",
        "body AS (SELECT page_id, url, " + UNESCAPED.format(c="coalesce(nullif(trim(regexp_replace(regexp_extract(html,'(?is)<title[^>]*>(.*?)</title>',1),'\\s+',' ','g')),''),url)") + " title, "
        + UNESCAPED.format(c="regexp_replace(" + HTML_TEXT.replace("' '", "''") + ",'<[^>]+>'," + NL + ",'g')") + " b FROM pages)",
        f"doc AS (SELECT *, trim(list_aggregate(list_transform(string_split(regexp_replace(b,'\\n{{3,}}',{NL}||{NL},'g'),{NL}), lambda x: rtrim(x,{WS})),'string_agg',{NL}),{WS}) t FROM body)",
    ) + f"""SELECT page_id, title, coalesce(n_links,0) n_links, length(trim('TITLE: '||title||{NL}||'URL: '||url||{NL}||{NL}||'===== PAGE TEXT ====='||{NL}||t||{NL}||{NL}||'===== REFERENCES (ALL LINKS) ====='||{NL}||coalesce(ls,''),{WS}))+1 n_chars
FROM doc LEFT JOIN byp USING (page_id)""",
}
