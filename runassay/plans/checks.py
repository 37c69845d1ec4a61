"""The same queries as plain SQL over the test tables, to check results against."""

from __future__ import annotations

from runassay import schema as S
from runassay.operators import judge
from runassay.operators.insight import API_FAILED, BLOCKS, ISSUE_RULES, PARSING_FAILED
from runassay.plans import report as R
from runassay.plans import views as V
from runassay.scale import IDS_PER_LINE

CHECKS: dict[str, str] = {}


def _cols(rules: dict[str, str]) -> str:
    return ", ".join(f"{rule} AS {name}" for name, rule in rules.items())


RESULTS = f"""WITH run AS (SELECT *, {_cols(V.RUN_RULES)} FROM events),
base AS (SELECT *, {_cols(V.EVENT_RULES)},
  event_id % (SELECT count(*) FROM documents) AS doc_id,
  row_number() OVER (PARTITION BY run_date, env ORDER BY ts, event_id) AS label FROM run),
r AS (SELECT b.*, {V.RATING_RULE} AS tester_expectation, d.text AS answer, {_cols(V.LANGUAGE_RULES)},
  lower(timeout_states) LIKE '%yes%' AS is_timeout, crash <> 'No' AS is_crash,
  TRY_CAST(replace(completion_time, 's', '') AS DOUBLE) AS secs
  FROM base b JOIN documents d ON d.doc_id = b.doc_id LEFT JOIN labels l ON l.doc_id = b.doc_id),
f AS (SELECT *, lower(language_status) LIKE '%failed%' AS lang_text,
  (lower(language_status) LIKE '%failed%' OR tester_expectation IN ('Poor', 'Failed', 'Parse Error(Failed)'))
    AND NOT is_timeout AND NOT is_crash AS is_failed,
  lower(language_status) LIKE '%failed%' AND NOT is_timeout AND NOT is_crash AS is_lang_failed,
  lower(reference_link) LIKE '%pass%' AS is_ref, lower(document_contain) LIKE '%pass%' AS is_doc,
  timeout_states LIKE '%总时间超时%' AS is_total, timeout_states LIKE '%生成超时%' AS is_gen,
  NOT is_timeout AND NOT is_crash AND trim(evaluation) NOT IN ('', 'Unknown', 'nan') AS is_evaluable
  FROM r),
m0 AS (SELECT run_date, env, count(*) AS total, count(*) FILTER (is_timeout) AS timeouts,
  count(*) FILTER (is_crash) AS crashes, count(*) FILTER (is_timeout AND is_crash) AS overlap,
  count(*) FILTER (is_failed) AS failed, count(*) FILTER (is_lang_failed) AS lang_failed,
  count(*) FILTER (is_ref) AS ref_passed, count(*) FILTER (is_doc) AS doc_passed,
  count(*) FILTER (is_total) AS total_timeouts, count(*) FILTER (is_gen) AS gen_timeouts,
  count(secs) AS timed, coalesce(min(secs), 0) AS fastest, coalesce(max(secs), 0) AS slowest,
  coalesce(avg(secs), 0) AS mean,
  count(*) FILTER (is_ref AND NOT is_timeout AND NOT is_crash) AS ref_strict,
  count(*) FILTER (is_doc AND NOT is_timeout AND NOT is_crash) AS doc_strict,
  coalesce(avg(secs) FILTER (NOT is_timeout AND NOT is_crash), 0) AS mean_valid
  FROM f GROUP BY run_date, env),
m1 AS (SELECT *, greatest(total - timeouts - crashes, 0) AS valid FROM m0),
m AS (SELECT *, valid - failed AS passed, timeouts + crashes AS invalid, valid - lang_failed AS lang_passed,
  valid - ref_passed AS ref_failed, valid - doc_passed AS doc_none, greatest(valid, 1) AS vb FROM m1)
"""

TASKS = f"""WITH t AS (SELECT conv_id, turn, conv_id % 8 AS task_set,
  row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) - 1 AS idx,
  {_cols(V.TASK_RULES)} FROM conversations WHERE role = 'user'),
c AS (SELECT doc_id, {_cols(V.CORPUS_RULES)} FROM documents)
"""

MATCHED = TASKS + """, full_names AS (SELECT lower(file_name) AS k, min(file_name) AS file FROM c GROUP BY 1),
base_names AS (SELECT lower(regexp_replace(file_name, '[.][^.]*$', '')) AS k, min(file_name) AS file FROM c GROUP BY 1),
mt AS (SELECT t.*, coalesce(x.file, b.file) AS matched_file,
  CASE WHEN x.file IS NOT NULL THEN 'exact' WHEN b.file IS NOT NULL THEN 'base'
    WHEN trim(t.filename) <> '' THEN 'none' ELSE 'blank' END AS match_kind,
  trim(t.request) = '' AS no_request
  FROM t LEFT JOIN full_names x ON trim(t.filename) <> '' AND x.k = lower(trim(t.filename))
  LEFT JOIN base_names b ON x.file IS NULL AND trim(t.filename) <> ''
    AND b.k = regexp_replace(lower(trim(t.filename)), '[.][^.]*$', '')),
md AS (SELECT *, CASE WHEN matched_file IS NULL AND no_request AND match_kind <> 'blank' THEN 'Skipped (No File & No Request)'
  WHEN matched_file IS NULL AND no_request THEN 'Skipped (Empty Request & File)' END AS skip_reason FROM mt)
"""

GRID = """WITH g AS (
SELECT conv_id AS path, 1 AS row_no, 1 AS col_no, 'Notes' AS value FROM conversations WHERE turn = 0
UNION ALL SELECT conv_id, 3, 1 + conv_id % 2, ' Request ' FROM conversations WHERE turn = 0
UNION ALL SELECT conv_id, 3, 3, 'File Name' FROM conversations WHERE turn = 0
UNION ALL SELECT conv_id, 3, 4, 'Target Language' FROM conversations WHERE turn = 0 AND conv_id % 3 <> 0
UNION ALL SELECT conv_id, 4 + turn, 1 + conv_id % 2, text FROM conversations WHERE role = 'user'
UNION ALL SELECT conv_id, 4 + turn, 4, 'ENG' FROM conversations WHERE role = 'assistant'),
w AS (SELECT *, lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) AS cell FROM g),
a AS (SELECT path, min(row_no) AS row_no FROM w
  WHERE cell = 'request' OR cell IN ('filename', 'file name', 'file_name') GROUP BY path),
h AS (SELECT w.path, w.row_no, max(col_no) FILTER (cell = 'request') AS req_col,
  max(col_no) FILTER (cell IN ('filename', 'file name', 'file_name')) AS file_col,
  max(col_no) FILTER (cell = 'selected agent') AS agent_col,
  max(col_no) FILTER (cell LIKE '%language%') AS lang_col
  FROM w JOIN a ON a.path = w.path AND a.row_no = w.row_no GROUP BY w.path, w.row_no),
tc AS (SELECT w.path, w.row_no,
  coalesce(max(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) FILTER (col_no = req_col), '') AS request,
  coalesce(max(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) FILTER (col_no = file_col), '') AS filename,
  coalesce(max(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) FILTER (col_no = agent_col), '') AS agent,
  coalesce(max(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) FILTER (col_no = lang_col), '') AS language
  FROM w JOIN h ON h.path = w.path AND w.row_no > h.row_no GROUP BY w.path, w.row_no)
"""

PARTS = """WITH e AS (SELECT p_brand AS en, max_by([p_name, concat(p_type, ' ', p_name)], p_partkey) AS tc,
  min(p_partkey) AS pos, count(*) AS entries FROM part GROUP BY p_brand),
x AS (SELECT en, pos, unnest(tc) AS name FROM e),
names AS (SELECT en AS name FROM e UNION SELECT name FROM x)
"""

AGENTS = f"""WITH ra AS (SELECT c_custkey AS task_key, {V.AGENT_RULE} AS agent, c_custkey % 2 = 0 AS is_tc,
  CASE WHEN c_custkey % 3 = 0 THEN 'env_a' ELSE 'env_b' END AS env
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
cat AS (SELECT n_name AS en, concat('国', CAST(n_nationkey AS STRING)) AS tc FROM nation),
names AS (SELECT en AS name FROM cat UNION SELECT tc FROM cat),
folded AS (SELECT lower(name) AS k, min(name) AS name FROM names GROUP BY 1),
res AS (SELECT d.raw, CASE WHEN n.name IS NOT NULL THEN d.raw ELSE coalesce(f.name, '') END AS agent,
  CASE WHEN n.name IS NOT NULL THEN 'exact' WHEN f.name IS NOT NULL THEN 'case' ELSE 'none' END AS how
  FROM (SELECT DISTINCT trim(agent) AS raw FROM ra) d
  LEFT JOIN names n ON n.name = d.raw LEFT JOIN folded f ON f.k = lower(d.raw)),
-- On these names the matching-block ratio equals (a + b - edits) / (a + b): one letter is missing.
near AS (SELECT raw, k, name, (length(raw) + length(k) - levenshtein(lower(raw), k))
  / CAST(length(raw) + length(k) AS DOUBLE) AS ratio FROM res, folded WHERE how = 'none'),
best AS (SELECT raw, arg_max(name, (ratio, k)) AS name, max(ratio) AS ratio FROM near WHERE ratio >= 0.6 GROUP BY raw),
rz AS (SELECT res.raw, coalesce(best.name, agent) AS agent, CASE WHEN best.name IS NOT NULL THEN 'fuzzy' ELSE how END AS how,
  best.ratio FROM res LEFT JOIN best ON best.raw = res.raw),
cand AS (SELECT rz.*, CASE WHEN rz.agent = '' THEN '' ELSE coalesce(a.tc, rz.agent) END AS tc_candidates,
  CASE WHEN rz.agent = '' THEN '' ELSE coalesce(b.en, rz.agent) END AS en_candidates
  FROM rz LEFT JOIN cat a ON a.en = rz.agent LEFT JOIN cat b ON b.tc = rz.agent),
rs AS (SELECT ra.*, cand.agent AS final_agent, how, CASE WHEN cand.agent <> '' THEN '4' ELSE '2' END AS state,
  CASE WHEN is_tc THEN tc_candidates ELSE en_candidates END AS candidates
  FROM ra JOIN cand ON cand.raw = trim(ra.agent))
"""

VERDICTS = f"""WITH v0 AS (SELECT event_id, CAST(ts AS DATE) AS run_date, {V.VERDICT_RULE} AS reply FROM events),
v1 AS (SELECT *, regexp_extract(reply, '(?s)(\\{{.*\\}})', 1) AS b FROM v0),
v2 AS (SELECT *, CASE WHEN b <> '' AND json_valid(b) THEN b END AS body FROM v1),
v AS (SELECT event_id, run_date, body,
  CASE WHEN body IS NULL THEN 'Parse Error(Failed)' ELSE coalesce(json_extract_string(body, '$.tester_expectation'), 'Unknown') END AS tester_expectation,
  CASE WHEN body IS NULL THEN 'Parse Error' ELSE coalesce(json_extract_string(body, '$.input_language'), 'Unknown') END AS input_language,
  CASE WHEN body IS NULL THEN 'Parse Error' ELSE coalesce(json_extract_string(body, '$.output_language'), 'Unknown') END AS output_language,
  CASE WHEN body IS NULL THEN 'Failed' ELSE coalesce(json_extract_string(body, '$.language_status'), 'Unknown') END AS language_status,
  CASE WHEN body IS NULL THEN concat('API调用失败。错误: no JSON object in reply。 接口返回: ', reply)
    ELSE coalesce(json_extract_string(body, '$.evaluation'), 'Unknown') END AS evaluation,
  CASE WHEN body IS NULL THEN 'N/A' ELSE coalesce(json_extract_string(body, '$.reference_link'), 'N/A') END AS reference_link,
  CASE WHEN body IS NULL THEN 'None' ELSE coalesce(json_extract_string(body, '$.document_contain_citations'), 'None') END AS document_contain_citations
  FROM v2)
"""


def _language_sql(column: str) -> str:
    from runassay.functions import language as L

    def count(pattern: str) -> str:
        return f"(length({column}) - length(regexp_replace({column}, '{pattern}', '', 'g')))"

    han, latin = count("[一-鿿]"), count("[A-Za-zÀ-ɏ]")
    simple, traditional = count(f"[{L.SIMPLIFIED_ONLY}]"), count(f"[{L.TRADITIONAL_ONLY}]")
    return f"""coalesce(nullif(concat_ws('+',
      CASE WHEN {han} > ({han} + {latin}) * 0.2 AND {traditional} > ({simple} + {traditional}) * 0.2 THEN '{L.TRADITIONAL}' END,
      CASE WHEN {han} > ({han} + {latin}) * 0.2 AND ({simple} > ({simple} + {traditional}) * 0.2 OR {simple} + {traditional} = 0) THEN '{L.SIMPLIFIED}' END,
      CASE WHEN {latin} > ({han} + {latin}) * 0.2 THEN '{L.ENGLISH}' END), ''), 'N/A')"""


REFERENCE = "(?i)(https?://|www\\.|references?:|sources?:|参考|參考|来源|來源)"
ANSWERS = f"""WITH a0 AS (SELECT doc_id, text, {_cols(V.ANSWER_RULES)} FROM documents),
an AS (SELECT doc_id, text AS document, request, answer, {_language_sql('request')} AS input_language,
  {_language_sql('answer')} AS output_language,
  regexp_matches(answer, '\\[\\d+\\]') AS cites, regexp_matches(answer, '{REFERENCE}') AS refers FROM a0)
"""


def _pct(part: str, whole: str) -> str:
    return (
        f"printf('%.2f%%', CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} * 100.0 ELSE 0.0 END)"
    )


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} * 100.0 ELSE 0.0 END"


def _lines(source: str, keys: str, label: str = "label") -> str:
    return (
        f"SELECT {keys}, {label} // {IDS_PER_LINE} AS line, count(*) AS n, "
        f"string_agg(CAST({label} AS STRING), ', ' ORDER BY {label}) AS ids "
        f"FROM (SELECT DISTINCT {keys}, {label} FROM {source}) GROUP BY {keys}, {label} // {IDS_PER_LINE}"
    )


KINDS = """(SELECT run_date, env, 'crash' AS kind, label FROM f WHERE is_crash
 UNION ALL SELECT run_date, env, CASE WHEN is_timeout THEN 'timeout' ELSE 'no_timeout' END, label FROM f
 UNION ALL SELECT run_date, env, 'total_timeout', label FROM f WHERE is_total
 UNION ALL SELECT run_date, env, 'gen_timeout', label FROM f WHERE is_gen)"""

RULE_HITS = " UNION ALL ".join(
    f"SELECT run_date, env, 3 AS section_ord, '{name}' AS issue, label AS id, evaluation FROM f "
    f"WHERE is_evaluable AND regexp_matches(evaluation, '{pattern}')"
    for name, pattern in ISSUE_RULES.items()
)

# ---- sources and sinks ----
CHECKS["s1_header"] = GRID + "SELECT * FROM h"
CHECKS["s2_testcases"] = GRID + "SELECT * FROM tc WHERE request <> '' OR filename <> ''"
CHECKS["w1_label"] = GRID + """SELECT path, row_no, row_number() OVER (PARTITION BY path ORDER BY row_no) - 1 AS idx,
row_number() OVER (PARTITION BY path ORDER BY row_no) AS label FROM tc WHERE request <> '' OR filename <> ''"""
CHECKS["s3_results"] = RESULTS + """SELECT env, run_date, count(*) AS n, CAST(sum(label) AS BIGINT) AS label_sum,
count(*) FILTER (reference_link <> 'N/A' AND env = 'env_a') AS references, count(*) FILTER (document_contain <> 'None') AS citations,
count(*) FILTER (completion_time <> 'N/A') AS times, count(*) FILTER (evaluation <> '') AS evaluations,
CAST(0 AS BIGINT) AS filenames, count(*) AS answers, CAST(sum(length(answer)) AS BIGINT) AS answer_chars,
CAST(sum(10 + least(40, length(answer))) AS BIGINT) AS request_chars FROM f GROUP BY env, run_date"""
CHECKS["s4_corpus"] = """SELECT lang, '.txt' AS ext,
CAST(sum(1 + length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS lines,
CAST(sum(1 + length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang"""
CHECKS["s5_listing"] = """SELECT lang, '.txt' AS ext, CAST(sum(1 + strlen(text)) AS BIGINT) AS bytes
FROM documents GROUP BY lang"""
CHECKS["w2_latest"] = RESULTS + "SELECT run_date, env, label, event_id, evaluation FROM f"
CHECKS["s6_upsert"] = CHECKS["w2_latest"]
CHECKS["s6_merge"] = CHECKS["w2_latest"]
CHECKS["t1_merge"] = CHECKS["w2_latest"]
CHECKS["s8_layout"] = RESULTS + "SELECT env, run_date, count(*) AS n FROM f GROUP BY env, run_date"

# ---- predicates ----
for _name, _flag in {
    "p01_timeout": "is_timeout", "p02_crash": "is_crash", "p03_failed": "is_failed",
    "p04_lang_failed": "is_lang_failed", "p05_ref_pass": "is_ref", "p06_doc_pass": "is_doc",
    "p07_total_timeout": "is_total", "p08_gen_timeout": "is_gen",
}.items():
    CHECKS[_name] = RESULTS + (
        f"SELECT run_date, env, {_flag} AS flag, count(*) AS n FROM f GROUP BY run_date, env, {_flag}"
    )
EVAL_LINE = """concat('[Test ID: ', CAST(label AS STRING), '] Eval: ', trim(evaluation), ' | Ans: ',
replace(substring(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), 1, 300), chr(10), ' '))"""
LANG_LINE = """concat('[Test ID: ', CAST(label AS STRING), '] Input: ', input_language, ', Output: ',
output_language, ' | Answer: ', substring(answer, 1, 300))"""
CHECKS["p09_evaluable"] = RESULTS + """SELECT run_date, env, label, md5(concat('[Test ID: ', CAST(label AS STRING), '] Eval: ',
trim(evaluation), ' | Ans: ', replace(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), chr(10), ' '))) AS text
FROM f WHERE is_evaluable"""
CHECKS["p10_lang_samples"] = RESULTS + f"""SELECT run_date, env, label, {LANG_LINE} AS text FROM (
SELECT *, row_number() OVER (PARTITION BY run_date, env ORDER BY label) AS k FROM f WHERE lang_text AND NOT is_timeout) WHERE k <= 50"""
CHECKS["o1_samples"] = RESULTS + """SELECT run_date, env, label, event_id FROM (
SELECT *, row_number() OVER (PARTITION BY run_date, env ORDER BY label) AS k FROM f WHERE lang_text) WHERE k <= 50"""
CHECKS["j1_j2_file_match"] = MATCHED + "SELECT task_set, idx, matched_file, match_kind FROM md"
CHECKS["p11_skip"] = MATCHED + f"""SELECT task_set, idx, skip_reason AS crash, 'Failed' AS tester_expectation,
'Failed' AS language_status, '{S.SKIP_ANSWER}' AS answer FROM md WHERE skip_reason IS NOT NULL"""
CHECKS["p12_mode"] = MATCHED + """SELECT task_set, CASE WHEN matched_file IS NOT NULL THEN 'file'
WHEN skip_reason IS NOT NULL THEN 'skipped' WHEN match_kind = 'blank' THEN 'text' ELSE 'text_degraded' END AS input_mode,
count(*) AS n FROM md GROUP BY 1, 2"""
CHECKS["a12_reconcile"] = TASKS + """SELECT *, files <> named AS mismatch FROM (SELECT
(SELECT count(*) FROM c WHERE regexp_matches(lower(file_name), '[.](pdf|docx|csv|txt)$')) AS files,
(SELECT count(*) FROM t WHERE trim(filename) <> '') AS named, (SELECT count(*) FROM t) AS tasks)"""
CHECKS["p13_capture"] = RESULTS + f""", cap AS (SELECT run_date, CASE WHEN event_id % 23 <> 0 THEN timeout_states
WHEN timeout_states = 'No' THEN 'yes (生成超时)' ELSE concat(timeout_states, ' & yes (生成超时)') END AS timeout_states FROM f)
SELECT run_date, timeout_states, timeout_states = 'No' AS needs_judge,
CASE WHEN timeout_states <> 'No' THEN 'Failed' END AS tester_expectation,
CASE WHEN timeout_states <> 'No' THEN '{S.TIMEOUT_EVALUATION}' END AS evaluation, count(*) AS n FROM cap GROUP BY ALL"""
ERRORS = f"""WITH er AS (SELECT event_id, event_type, {V.ERROR_RULE} AS error,
CASE WHEN event_id % 2 = 0 THEN '未指定' ELSE 'Chat' END AS agent_used,
CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS agent, event_id % 29 = 0 AS stopped,
CASE WHEN event_id % 31 = 0 THEN 'no input' END AS skip_reason FROM events),
ek AS (SELECT *, CASE WHEN regexp_matches(lower(error), '{'|'.join(S.CLOSED_WINDOW_MESSAGES)}')
THEN 'BROWSER_CLOSED' ELSE 'ERROR' END AS kind FROM er)
"""
CHECKS["p13_errors"] = ERRORS + f"""SELECT event_id, concat('{S.CRASH_PREFIX}', substring(error, 1, 150)) AS crash,
CASE WHEN agent_used = '未指定' AND agent <> '' THEN agent ELSE agent_used END AS agent_used,
'Failed' AS tester_expectation, 'Failed' AS language_status, '{S.CRASH_ANSWER}' AS answer,
concat('{S.CRASH_PREFIX}', substring(error, 1, 150)) AS evaluation, 'Crash (Error)' AS timeout_states
FROM ek WHERE error IS NOT NULL AND kind = 'ERROR'"""
CHECKS["p14_error_kind"] = ERRORS + """SELECT event_type, kind, count(*) AS n FROM ek WHERE error IS NOT NULL
GROUP BY event_type, kind"""
CHECKS["p15_status"] = ERRORS + """SELECT event_type, status, status NOT IN ('STOPPED', 'BROWSER_CLOSED') AS writes_row,
count(*) AS n FROM (SELECT event_type, CASE WHEN stopped THEN 'STOPPED' WHEN skip_reason IS NOT NULL THEN 'SKIPPED'
WHEN error IS NOT NULL THEN kind ELSE 'SUCCESS' END AS status FROM ek) GROUP BY event_type, status"""
CHECKS["p16_route"] = TASKS + f"""SELECT language, regexp_matches(lower(language), '{'|'.join(S.TRADITIONAL_ROUTE_WORDS)}') AS is_tc,
count(*) AS n FROM t GROUP BY 1, 2"""
CHECKS["p17_state"] = TASKS + """SELECT task_set, CASE WHEN trim(agent) <> '' THEN '4' ELSE '2' END AS state,
count(*) AS n FROM t GROUP BY 1, 2"""
CHECKS["p18_defaults"] = TASKS + """SELECT task_set, coalesce(nullif(trim(language), ''), 'N/A') AS selected_language,
coalesce(nullif(trim(agent), ''), '未指定') AS agent_used, count(*) AS n FROM t GROUP BY 1, 2, 3"""

# ---- agents ----
CHECKS["u1_names"] = PARTS + "SELECT name FROM names"
CHECKS["u2_folded"] = PARTS + "SELECT lower(name) AS folded, min(name) AS name FROM names GROUP BY 1"
CHECKS["u3_inverse"] = PARTS + "SELECT name, max_by(en, pos) AS en FROM x GROUP BY name"
CHECKS["a15_duplicates"] = PARTS + """SELECT e.en, e.entries, count(l.name) AS lost_names FROM e LEFT JOIN (
SELECT p_brand AS en, p_name AS name FROM part UNION SELECT p_brand, concat(p_type, ' ', p_name) FROM part
EXCEPT SELECT en, name FROM x) l ON l.en = e.en WHERE e.entries > 1 GROUP BY e.en, e.entries"""
CHECKS["j3_exact"] = AGENTS + "SELECT raw, agent, how FROM res"
CHECKS["j4_fuzzy"] = AGENTS + "SELECT raw, agent, how, ratio FROM rz"
CHECKS["j5_candidates"] = AGENTS + "SELECT raw, agent, tc_candidates, en_candidates FROM cand"
CHECKS["j5_resolved"] = AGENTS + """SELECT agent, is_tc, final_agent, how, state, candidates, count(*) AS n
FROM rs GROUP BY ALL"""
CHECKS["j6_first_available"] = AGENTS + f""", off AS (SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'env_a' ELSE 'env_b' END AS env,
unnest([concat('Add ', n_name), concat('加 国', CAST(n_nationkey AS STRING))]) AS title FROM nation),
hit AS (SELECT *, candidates <> '' AND EXISTS (SELECT 1 FROM off WHERE off.env = rs.env
  AND contains(lower(off.title), lower(rs.candidates))) AS found FROM rs)
SELECT task_key, env, final_agent, CASE WHEN found THEN candidates END AS picked,
CASE WHEN candidates = '' OR found THEN final_agent ELSE concat(final_agent, '{S.AGENT_NOT_OFFERED}') END AS agent_used,
CASE WHEN found THEN '4' ELSE '2' END AS state FROM hit"""

# ---- fan-out and comparison ----
CHECKS["j7_fanout"] = TASKS + "SELECT task_set, idx, r_name AS env FROM t, region"
CLUSTERS = RESULTS + """, cl AS (SELECT DISTINCT run_date, env, event_type AS issue, event_id % 97 AS id
FROM run WHERE value > 150)"""
CHECKS["j9_unknown_ids"] = CLUSTERS + """SELECT c.run_date, c.env, f.label IS NOT NULL AS known, count(*) AS n
FROM (SELECT DISTINCT run_date, env, id FROM cl) c LEFT JOIN f ON f.run_date = c.run_date AND f.env = c.env
AND f.label = c.id GROUP BY ALL"""
CHECKS["j10_compare_envs"] = RESULTS + """, o AS (SELECT run_date, env, label, secs, CASE WHEN is_crash THEN 'crash'
WHEN is_timeout THEN 'timeout' WHEN is_failed THEN 'failed' ELSE 'pass' END AS outcome FROM f),
a AS (SELECT * FROM o WHERE env = 'env_a'), b AS (SELECT * FROM o WHERE env = 'env_b')
SELECT coalesce(a.run_date, b.run_date) AS run_date, coalesce(a.label, b.label) AS label, a.outcome AS outcome_a,
b.outcome AS outcome_b, a.secs AS seconds_a, b.secs AS seconds_b, a.outcome <> b.outcome AS flipped,
round(b.secs - a.secs, 6) AS seconds_delta
FROM a FULL OUTER JOIN b ON a.run_date = b.run_date AND a.label = b.label"""

# ---- aggregates ----
CHECKS["a01_counts"] = RESULTS + "SELECT run_date, env, total, timeouts, crashes, overlap FROM m"
CHECKS["a02_valid"] = RESULTS + "SELECT run_date, env, overlap, valid FROM m"
CHECKS["a03_pass"] = RESULTS + f"""SELECT run_date, env, total, passed, failed, invalid,
{_share('passed', 'total')} AS passed_share, {_pct('passed', 'total')} AS passed_pct,
{_pct('failed', 'total')} AS failed_pct, {_pct('invalid', 'total')} AS invalid_pct FROM m"""
CHECKS["a04_language"] = RESULTS + f"""SELECT run_date, env, valid, lang_passed, lang_failed,
{_share('lang_passed', 'vb')} AS lang_passed_share, {_pct('lang_passed', 'vb')} AS lang_passed_pct,
{_pct('lang_failed', 'vb')} AS lang_failed_pct FROM m"""
CHECKS["a05_reference"] = RESULTS + f"""SELECT run_date, env, valid, ref_passed, ref_failed,
{_share('ref_passed', 'vb')} AS ref_passed_share, {_pct('ref_passed', 'vb')} AS ref_passed_pct,
{_pct('ref_failed', 'vb')} AS ref_failed_pct, ref_strict AS ref_passed_strict FROM m"""
CHECKS["a06_citation"] = RESULTS + f"""SELECT run_date, env, valid, doc_passed, doc_none,
{_share('doc_passed', 'vb')} AS doc_passed_share, {_pct('doc_passed', 'vb')} AS doc_passed_pct,
{_pct('doc_none', 'vb')} AS doc_none_pct, doc_strict AS doc_passed_strict FROM m"""
CHECKS["a07_times"] = RESULTS + """SELECT run_date, env, fastest, slowest, round(mean, 6) AS mean, timed,
round(mean_valid, 6) AS mean_valid FROM m"""
CHECKS["a08_crash_ids"] = RESULTS + f""", li AS ({_lines("(SELECT * FROM f WHERE is_crash)", "run_date, env")})
SELECT m.run_date, m.env, CASE WHEN li.line IS NOT NULL THEN 'crash' END AS kind, li.line, li.n, li.ids, total, crashes,
total - crashes AS no_crashes, {_pct('crashes', 'total')} AS crash_pct, {_pct('total - crashes', 'total')} AS no_crash_pct
FROM m LEFT JOIN li ON li.run_date = m.run_date AND li.env = m.env"""
CHECKS["a09_crash_rows"] = RESULTS + """SELECT run_date, env, label, CAST(1 AS BIGINT) AS n,
replace(crash, ',', ';') AS reason FROM f WHERE is_crash"""
CHECKS["a10_timeout_ids"] = RESULTS + _lines(
    f"(SELECT * FROM {KINDS} WHERE kind <> 'crash')", "run_date, env, kind"
)
CHECKS["a11_clusters"] = CLUSTERS + f""", k AS (SELECT run_date, env, issue, count(*) AS n FROM cl GROUP BY ALL)
SELECT k.run_date, k.env, issue, n, total, {_share('n', 'total')} AS share, {_pct('n', 'total')} AS pct
FROM k JOIN m ON m.run_date = k.run_date AND m.env = k.env"""
CHECKS["o2_cluster_ids"] = CLUSTERS + _lines("cl", "run_date, env, issue", "id")


def _report_sql(hits: str = RULE_HITS, more: list[str] | None = None) -> str:
    def lit(value):
        return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("'", "''") + "'"

    fixed = [(n, 0, t, None, None, None, None) for n, t in R.SECTIONS.items()]
    fixed += [(n, 1, t, None, None, None, None) for n, t in R.SUBTITLES.items()]
    fixed += [(n, 2, *h, R.EXAMPLE_HEADING if n in (3, 5) else None) for n, h in R.HEADINGS.items()]
    fixed += [(n, o, "", None, None, None, None) for n, o in R.BLANK_ROWS]
    fixed += [
        (1, 2, "Login Website", "http://example.org/", None, None, None),
        (1, 3, "Generation Time", "2024-01-31 00:00", None, None, None),
        (6, 6, "Document Citation Status", None, None, None, None),
        (6, 7, "Status", "Count", "Percentage", None, None),
    ]
    values = ", ".join(
        f"({s}, {o}, {lit(i)}, {lit(v)}, {lit(p)}, {lit(d)}, {lit(e)})" for s, o, i, v, p, d, e in fixed
    )
    parts = [
        "SELECT run_date, env, s AS section_ord, o AS ord, '' AS sort_key, CAST(0 AS BIGINT) AS line, i AS item, "
        f"v AS value, p AS pct, d AS ids, e AS example FROM m, (VALUES {values}) AS fx(s, o, i, v, p, d, e)"
    ]

    def row(section, ord_, item, value, pct, ids="NULL", where="true"):
        parts.append(
            f"SELECT run_date, env, {section}, {ord_}, '', CAST(0 AS BIGINT), {lit(item)}, {value}, {pct}, {ids}, NULL "
            f"FROM m WHERE {where}"
        )

    row(7, 3, "Fastest Response", "concat(CASE WHEN timed = 0 THEN '0' ELSE CAST(fastest AS STRING) END, 's')", "NULL")
    row(7, 4, "Slowest Response", "concat(CASE WHEN timed = 0 THEN '0' ELSE CAST(slowest AS STRING) END, 's')", "NULL")
    row(7, 5, "Average Loading Time", "concat('~', printf('%.1f', mean), 's')", "NULL")
    for section, ord_, item, value, base, kind in R.LAYOUT:
        value, base = value.replace("valid_base", "vb"), base and base.replace("valid_base", "vb")
        pct = "'100%'" if item == "Total Tests" else _pct(value, base) if base else "'N/A'"
        text = f"CAST({value} AS STRING)"
        if kind in (None, "none"):
            row(section, ord_, item, text, pct, "'None'" if kind else "NULL")
        else:
            row(section, ord_, item, text, pct, "'None'", where=f"{value} = 0")
            parts.append(
                f"SELECT l.run_date, l.env, {section}, {ord_}, '', l.line, CASE WHEN l.line = l.first THEN {lit(item)} END, "
                f"CASE WHEN l.line = l.first THEN {text} END, CASE WHEN l.line = l.first THEN {pct} END, l.ids, NULL "
                f"FROM li l JOIN m ON m.run_date = l.run_date AND m.env = l.env WHERE l.kind = '{kind}'"
            )
    parts.append(
        "SELECT run_date, env, 8, 5, '', label, concat(' -> Test ID ', CAST(label AS STRING)), '1', 'N/A', "
        "replace(crash, ',', ';'), NULL FROM f WHERE is_crash"
    )
    parts.append(
        "SELECT c.run_date, c.env, c.section_ord, 3, c.issue, c.line, CASE WHEN c.line = c.first THEN c.issue END, "
        "CASE WHEN c.line = c.first THEN CAST(c.all_n AS STRING) END, "
        f"CASE WHEN c.line = c.first THEN {_pct('c.all_n', 'total')} END, c.ids, "
        "CASE WHEN c.line = c.first THEN x.example END "
        "FROM ci c JOIN m ON m.run_date = c.run_date AND m.env = c.env "
        "JOIN ex x ON x.run_date = c.run_date AND x.env = c.env AND x.section_ord = c.section_ord AND x.issue = c.issue"
    )
    parts += more or []
    sections = " ".join(f"WHEN {n} THEN {lit(t)}" for n, t in R.SECTIONS.items())
    return RESULTS + f""", l0 AS ({_lines(KINDS, "run_date, env, kind")}),
li AS (SELECT *, min(line) OVER (PARTITION BY run_date, env, kind) AS first FROM l0),
hits AS ({hits}),
ex AS (SELECT run_date, env, section_ord, issue, arg_min(evaluation, id) AS example FROM hits GROUP BY ALL),
c0 AS ({_lines("hits", "run_date, env, section_ord, issue", "id")}),
ci AS (SELECT *, min(line) OVER (PARTITION BY run_date, env, section_ord, issue) AS first,
  CAST(sum(n) OVER (PARTITION BY run_date, env, section_ord, issue) AS BIGINT) AS all_n FROM c0),
rep AS ({" UNION ALL ".join(parts)}),
report AS (SELECT run_date, env, section_ord, ord, sort_key, line, CASE section_ord {sections} END AS section,
  item, value, pct, ids, example FROM rep)
"""


CHECKS["a13_report"] = _report_sql() + "SELECT * FROM report"
CHECKS["s9_recover"] = CHECKS["a13_report"]
CHECKS["s7_render"] = _report_sql() + """SELECT run_date, env, section_ord, ord, sort_key, line,
concat(CASE WHEN section_ord = 1 AND ord = 0 AND line = 0 THEN chr(65279) ELSE '' END,
concat_ws(',', coalesce(item, ''), coalesce(value, ''), coalesce(pct, ''),
CASE WHEN ids IS NULL THEN '' ELSE concat('"', ids, '"') END,
CASE WHEN example IS NOT NULL THEN concat('"', replace(example, '"', '""'), '"') END)) AS text FROM report"""
CHECKS["s7_written"] = f"SELECT run_date, env, replace(text, chr(65279), '') AS text FROM ({CHECKS['s7_render']})"
CHECKS["a14_env_report"] = CHECKS["a13_report"]
CHECKS["a13_rollup"] = RESULTS + """SELECT concat_ws('+', CASE WHEN grouping(run_date) = 0 THEN 'run_date' END,
  CASE WHEN grouping(env) = 0 THEN 'env' END, CASE WHEN grouping(agent_used) = 0 THEN 'agent_used' END) AS "by",
  run_date, env, agent_used, count(*) AS total, count(*) FILTER (is_timeout) AS timeouts, count(*) FILTER (is_crash) AS crashes,
  count(*) FILTER (is_timeout AND is_crash) AS overlap, count(*) FILTER (is_lang_failed) AS lang_failed,
  count(*) FILTER (is_ref) AS ref_passed, count(*) FILTER (is_doc) AS doc_passed, count(secs) AS timed, min(secs) AS fastest,
  max(secs) AS slowest, round(sum(secs), 2) AS seconds
FROM f GROUP BY GROUPING SETS ((), (run_date), (env), (agent_used), (run_date, env), (run_date, agent_used), (env, agent_used),
  (run_date, env, agent_used))"""

# ---- windows ----
CHECKS["w3_first_match"] = f"""SELECT lang, source, file_name, doc_id FROM (SELECT lang, source, doc_id,
{V.CORPUS_RULES['file_name']} AS file_name, row_number() OVER (PARTITION BY lang, source
ORDER BY {V.CORPUS_RULES['file_name']}) AS k FROM documents) WHERE k = 1"""
STABLE = """WITH v AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS start FROM events),
p0 AS (SELECT user_id AS task_key, ts, event_id, 1 + CAST(floor(value / 60) AS BIGINT) AS len,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM v WHERE ts >= start + INTERVAL 5 SECONDS),
p1 AS (SELECT *, len > 0 AND len = coalesce(lag(len) OVER (PARTITION BY task_key ORDER BY k), 0) AS same FROM p0 WHERE k <= 300),
p2 AS (SELECT *, k - coalesce(max(CASE WHEN NOT same THEN k END) OVER (PARTITION BY task_key ORDER BY k
ROWS UNBOUNDED PRECEDING), 0) AS streak FROM p1),
p3 AS (SELECT task_key, min(CASE WHEN streak >= 5 THEN k END) AS stable_poll, min(CASE WHEN streak >= 5 THEN ts END) AS stable_ts,
count(*) AS polls FROM p2 GROUP BY task_key),
p AS (SELECT t.task_key, stable_poll, stable_ts, coalesce(polls, 0) AS polls FROM (SELECT DISTINCT user_id AS task_key FROM events) t
LEFT JOIN p3 ON p3.task_key = t.task_key),
st AS (SELECT *, CASE WHEN stable_poll IS NOT NULL THEN 'stable' WHEN polls >= 300 THEN 'yes (总时间超时)'
ELSE 'running' END AS state FROM p)
"""
CHECKS["w4_stability"] = STABLE + "SELECT task_key, stable_poll, stable_ts, polls, state FROM st"
BREAKER = f"""WITH s0 AS (SELECT {_cols(V.RUN_RULES)}, ts, event_id, {V.STATUS_RULE} AS status FROM events),
s1 AS (SELECT *, CAST(sum(CASE WHEN status IN ('SUCCESS', 'ERROR') THEN 1 ELSE 0 END) OVER (PARTITION BY run_date, env
ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM s0),
s2 AS (SELECT *, sum(CASE WHEN status = 'BROWSER_CLOSED' THEN 1 ELSE 0 END) OVER (PARTITION BY run_date, env, island
ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM s1),
br AS (SELECT run_date, env, count(*) FILTER (status = 'BROWSER_CLOSED') AS closes,
coalesce(bool_or(streak >= 3), false) AS tripped,
min(ts) FILTER (streak >= 3) AS trip_ts, arg_min(event_id, ts) FILTER (streak >= 3) AS trip_event_id
FROM s2 WHERE status IN ('BROWSER_CLOSED', 'SUCCESS', 'ERROR') GROUP BY run_date, env)
"""
CHECKS["w5_breaker"] = BREAKER + "SELECT * FROM br"
CHECKS["o4_last_text"] = """SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
ORDER BY turn DESC) AS k FROM conversations WHERE trim(text) <> '') WHERE k = 1"""
CHECKS["o5_first_envs"] = "SELECT n_name AS env, n_nationkey AS pos FROM nation ORDER BY n_nationkey LIMIT 3"

# ---- scalar functions ----
CHECKS["f01_cell"] = GRID + "SELECT path, row_no, col_no, cell FROM w"
CHECKS["f02_names"] = TASKS + """SELECT file_name, regexp_replace(file_name, '[.][^.]*$', '') AS base,
regexp_extract(file_name, '([.][^.]*)$', 1) AS ext FROM c"""
CHECKS["f03_excerpt"] = "SELECT doc_id, replace(substring(text, 1, 300), chr(10), ' ') AS excerpt FROM documents"
CHECKS["f04_judge_document"] = """SELECT doc_id, length(d) AS chars, md5(d) AS digest
FROM (SELECT doc_id, substring(concat(text, text), 1, 50000) AS d FROM documents)"""
CHECKS["f05_clean"] = "SELECT doc_id, md5(concat(text, chr(9), 'x')) AS digest FROM documents"
CHECKS["f06_csv_safe"] = RESULTS + "SELECT replace(crash, ',', ';') AS reason, count(*) AS n FROM f GROUP BY 1"
CHECKS["f07_seconds"] = RESULTS + "SELECT event_id, secs AS seconds FROM f"
CHECKS["f08_percent"] = f"""WITH u AS (SELECT CAST(ts AS DATE) AS run_date, user_id, count(*) AS n FROM events GROUP BY 1, 2),
w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY run_date) AS BIGINT) AS total FROM u)
SELECT *, {_share('n', 'total')} AS share, {_pct('n', 'total')} AS pct FROM w"""
CHECKS["f10_json_body"] = VERDICTS + "SELECT event_id, body FROM v"
CHECKS["f11_block"] = """SELECT conv_id, turn, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS first,
CAST(NULL AS STRING) AS second FROM conversations"""
CHECKS["f12_numbers"] = """SELECT event_id, concat(CAST(event_id AS STRING), '|', CAST(user_id AS STRING)) AS numbers,
true AS is_ids, false AS props_is_ids FROM events"""
CHECKS["f13_page_times"] = """SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN concat(CAST(page_id AS STRING), '.5s') ELSE 'N/A' END AS prep_time,
CASE WHEN page_id % 3 = 1 THEN '7.25s' ELSE 'N/A' END AS completion_time FROM pages"""
CHECKS["f14_error_texts"] = f"""SELECT doc_id, concat('{S.JUDGE_ERROR_PREFIX}', substring(text, 1, 100)) AS evaluation,
concat('{S.CRASH_PREFIX}', substring(text, 1, 150)) AS crash FROM documents"""
CHECKS["f15_f16_marks"] = TASKS + f"""SELECT doc_id, regexp_matches(answer, '\\[\\d+\\]') AS cites,
regexp_matches(answer, '{REFERENCE}') AS refers FROM c"""
CHECKS["f17_length"] = "SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS chars FROM documents"
CHECKS["f18_lines"] = RESULTS + f"""SELECT event_id, md5({EVAL_LINE}) AS eval_line, md5({LANG_LINE}) AS lang_line
FROM (SELECT * REPLACE (event_id AS label) FROM f)"""
CHECKS["f19_mix"] = RESULTS + """SELECT language, count(*) AS n FROM (SELECT unnest(string_split(output_language, '+')) AS language
FROM f) GROUP BY language"""

# ---- judge and insight ----
CHECKS["x3_parse"] = VERDICTS + "SELECT * EXCLUDE (body) FROM v"
CHECKS["x4_audit"] = VERDICTS + """SELECT run_date, count(*) AS verdicts,
count(*) FILTER (tester_expectation NOT IN ('Excellent', 'Good', 'Pass', 'Poor', 'Failed')) AS odd_ratings,
count(*) FILTER (language_status = 'Failed' AND tester_expectation IN ('Excellent', 'Good', 'Pass')) AS rated_above_cap,
count(*) FILTER (input_language <> output_language AND language_status = 'Pass') AS unequal_passes FROM v GROUP BY run_date"""
CHECKS["x5_rules"] = ANSWERS + """, st AS (SELECT *, CASE WHEN input_language = output_language THEN 'Pass' ELSE 'Failed' END AS language_status FROM an)
SELECT doc_id, CASE WHEN trim(answer) = '' THEN 'Failed' WHEN language_status = 'Failed' THEN 'Poor'
WHEN cites AND refers THEN 'Excellent' WHEN cites OR refers THEN 'Good' ELSE 'Pass' END AS tester_expectation,
input_language, output_language, language_status, concat('rule check: ', input_language, ' > ', output_language) AS evaluation,
CASE WHEN refers THEN 'Pass' ELSE 'N/A' END AS reference_link,
CASE WHEN cites THEN 'Pass' ELSE 'None' END AS document_contain_citations FROM st"""
CHECKS["x5_languages"] = ANSWERS + """SELECT input_language AS asked, output_language AS given, count(*) AS n
FROM an GROUP BY 1, 2"""
CHECKS["x1_judge"] = CHECKS["x5_rules"] + " WHERE doc_id % 9 <> 0"
CHECKS["x2_retry"] = f"""WITH l AS (SELECT user_id, CAST(ts AS DATE) AS run_date, event_id, {_cols(V.CALL_RULES)},
  event_type NOT IN ('error', 'view') AND event_id % 10 <> 0 AS good,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, run_date, min(k) FILTER (good) AS first_good, max(k) AS made, arg_min(event_id, k) FILTER (good) AS id,
  arg_max(reply, k) FILTER (reply IS NOT NULL) AS last_reply, arg_max(coalesce(error, 'no JSON object in reply'), k) AS last_error
  FROM l WHERE k <= 3 GROUP BY user_id, run_date)
SELECT user_id, run_date, coalesce(first_good, made) AS attempts, CASE WHEN first_good IS NULL THEN last_error END AS error,
  CASE WHEN first_good IS NULL THEN 'Parse Error(Failed)' WHEN id % 6 = 0 THEN 'Great' WHEN id % 2 = 0 THEN 'Good' ELSE 'Poor' END AS tester_expectation,
  CASE WHEN first_good IS NULL THEN concat('{judge.FAILURE_TEXT}', last_error, '{judge.FAILURE_REPLY}', coalesce(last_reply, '{judge.FAILURE_NO_REPLY}'))
    ELSE '{S.VERDICT_FIELDS["evaluation"]}' END AS evaluation FROM s"""
_HEAD = judge.PROMPT_HEAD.replace("\n", "' || chr(10) || '")
CHECKS["x9_prompt"] = ANSWERS + f"""SELECT doc_id, length(p) AS chars, md5(p) AS digest FROM (SELECT doc_id, '{_HEAD}' || request
|| chr(10) || 'Target language:' || chr(10) || chr(10) || 'Document:' || chr(10) || document
|| chr(10) || 'Answer:' || chr(10) || answer AS p FROM an)"""
CHECKS["x6_cluster"] = RESULTS + f", hits AS ({RULE_HITS}) SELECT run_date, env, issue, count(*) AS n FROM hits GROUP BY ALL"
CHECKS["x6_examples"] = RESULTS + f""", hits AS ({RULE_HITS}) SELECT run_date, env, issue, arg_min(evaluation, id) AS example
FROM hits GROUP BY run_date, env, issue"""
CHECKS["x7_blocks"] = RESULTS + """SELECT run_date, env, concat('Score ', substring(evaluation, 7)) AS issue, count(*) AS n
FROM f WHERE is_evaluable GROUP BY ALL"""
CHECKS["x7_table"] = CHECKS["x7_blocks"]
CHECKS["x6_merged"] = CHECKS["x7_blocks"].replace("count(*) AS n", "count(*) AS n, 1 AS lists")
INSIGHT_HITS = """SELECT run_date, env, 3 AS section_ord, concat('Score ', substring(evaluation, 7)) AS issue, label AS id,
  concat('seen Score ', substring(evaluation, 7)) AS evaluation FROM f WHERE is_evaluable
UNION ALL SELECT run_date, env, 5, concat(input_language, ' to ', output_language), label,
  concat('seen ', input_language, ' to ', output_language) FROM f WHERE lang_text AND NOT is_timeout"""
OBSERVED = """SELECT o.run_date, o.env, 10, 4, '000000000000', row_number() OVER (PARTITION BY o.run_date, o.env ORDER BY n, issue),
'Observed', concat(issue, ' ', CAST(n AS STRING), ' of ', CAST(total AS STRING)), NULL, NULL, NULL
FROM (SELECT run_date, env, issue, count(*) AS n FROM hits WHERE section_ord = 3 GROUP BY ALL) o
JOIN m ON m.run_date = o.run_date AND m.env = o.env"""
CHECKS["x6_insight"] = _report_sql(INSIGHT_HITS, [OBSERVED]) + "SELECT * FROM report"
_STAND_INS = " UNION ALL ".join(
    f"SELECT {n} AS block, '{name}' AS name, '{stand_in.format(API_FAILED)}' AS api, "
    f"'{stand_in.format(PARSING_FAILED)}' AS parsing"
    for n, (name, stand_in) in BLOCKS.items()
)
CHECKS["x8_fallback"] = f"""SELECT conv_id, turn, CAST(block AS BIGINT) AS block, name, md5(CASE WHEN role <> 'user' THEN api
WHEN block = 2 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE parsing END) AS digest
FROM conversations, ({_STAND_INS})"""

# ---- whole evaluation ----
EVALUATED = MATCHED + f""", cat AS (SELECT n_name AS en, concat('国', CAST(n_nationkey AS STRING)) AS tc FROM nation),
cp AS (SELECT conv_id, turn - 1 AS turn, {_cols(V.CAPTURE_RULES)} FROM conversations WHERE role = 'assistant'),
j0 AS (SELECT md.*, cat.en, cp.answer, cp.timeout_states AS ts0, cp.shared_link, cp.prep_time, cp.completion_time, cp.error,
  coalesce(cp.stopped, false) AS stopped FROM md LEFT JOIN cat ON lower(cat.en) = lower(trim(md.agent))
  LEFT JOIN cp ON cp.conv_id = md.conv_id AND cp.turn = md.turn),
j1 AS (SELECT *, CASE WHEN stopped THEN 'STOPPED' WHEN skip_reason IS NOT NULL THEN 'SKIPPED'
  WHEN error = 'No such window' THEN 'BROWSER_CLOSED' WHEN error IS NOT NULL THEN 'ERROR' ELSE 'SUCCESS' END AS status,
  CASE WHEN answer = '{S.EMPTY_ANSWER}' THEN CASE WHEN ts0 = 'No' THEN '{S.GENERATION_TIMEOUT}'
    ELSE concat(ts0, ' & {S.GENERATION_TIMEOUT}') END ELSE ts0 END AS state,
  {_language_sql('request')} AS asked, {_language_sql("coalesce(answer, '')")} AS given FROM j0),
j2 AS (SELECT *, status = 'SUCCESS' AND state = 'No' AS judged, status = 'SUCCESS' AND state <> 'No' AS late,
  regexp_matches(answer, '\\[\\d+\\]') AS cites, regexp_matches(answer, '{REFERENCE}') AS refers FROM j1
  WHERE status NOT IN ('STOPPED', 'BROWSER_CLOSED')
    AND (skip_reason IS NOT NULL OR answer IS NOT NULL OR error IS NOT NULL))
"""
CHECKS["j8_unwritten"] = EVALUATED + "SELECT conv_id, turn FROM md EXCEPT SELECT conv_id, turn FROM j2"
CHECKS["e1_evaluate"] = EVALUATED + f"""SELECT conv_id, turn, idx + 1 AS label, md5(request) AS request, coalesce(nullif(trim(filename), ''), '') AS filename,
CASE status WHEN 'SKIPPED' THEN skip_reason WHEN 'ERROR' THEN concat('{S.CRASH_PREFIX}', substring(error, 1, 150)) ELSE 'No' END AS crash,
CASE WHEN NOT judged THEN 'Failed' WHEN trim(answer) = '' THEN 'Failed' WHEN asked <> given THEN 'Poor'
  WHEN cites AND refers THEN 'Excellent' WHEN cites OR refers THEN 'Good' ELSE 'Pass' END AS tester_expectation,
coalesce(nullif(trim(language), ''), 'N/A') AS selected_language,
CASE WHEN judged THEN asked ELSE 'N/A' END AS input_language, CASE WHEN judged THEN given ELSE 'N/A' END AS output_language,
CASE WHEN judged AND asked = given THEN 'Pass' ELSE 'Failed' END AS language_status,
md5(CASE status WHEN 'SKIPPED' THEN '{S.SKIP_ANSWER}' WHEN 'ERROR' THEN '{S.CRASH_ANSWER}' ELSE answer END) AS answer,
CASE WHEN status = 'SUCCESS' OR status = 'ERROR' THEN shared_link ELSE 'N/A' END AS shared_link,
CASE WHEN status = 'ERROR' THEN concat('{S.CRASH_PREFIX}', substring(error, 1, 150)) WHEN late THEN '{S.TIMEOUT_EVALUATION}'
  WHEN judged THEN concat('rule check: ', asked, ' > ', given) ELSE 'Unknown' END AS evaluation,
CASE WHEN status = 'SKIPPED' THEN '未指定' WHEN status = 'ERROR' THEN coalesce(nullif(trim(agent), ''), '未指定')
  ELSE coalesce(en, '未指定') END AS agent_used,
CASE WHEN judged AND refers THEN 'Pass' ELSE 'N/A' END AS reference_link,
CASE WHEN judged AND cites THEN 'Pass' ELSE 'None' END AS document_contain,
CASE WHEN status IN ('SUCCESS', 'ERROR') THEN prep_time ELSE 'N/A' END AS prep_time,
CASE WHEN status IN ('SUCCESS', 'ERROR') THEN completion_time ELSE 'N/A' END AS completion_time,
CASE status WHEN 'ERROR' THEN 'Crash (Error)' WHEN 'SKIPPED' THEN 'No' ELSE state END AS timeout_states FROM j2"""

# ---- streaming: what the batch says over the same rows ----
CHECKS["t1_ingest"] = CHECKS["w2_latest"]
CHECKS["t2_drain"] = CHECKS["a13_report"]
CHECKS["t3_stability"] = STABLE + "SELECT task_key, state, stable_poll, stable_ts FROM st WHERE state <> 'running'"
CHECKS["t5_task_timeout"] = """WITH g AS (SELECT user_id AS task_key, ts, event_id,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 + CAST(floor(value / 60) AS BIGINT) END AS len,
  min(ts) OVER w AS start, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
-- polls before the first silence of over a day
h AS (SELECT *, max(CASE WHEN ts - before > INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY task_key ORDER BY ts, event_id
  ROWS UNBOUNDED PRECEDING) AS cut FROM g),
q AS (SELECT *, row_number() OVER (PARTITION BY task_key ORDER BY ts, event_id) AS k FROM h
  WHERE cut = 0 AND ts >= start + INTERVAL 5 SECONDS),
same AS (SELECT *, len > 0 AND len = coalesce(lag(len) OVER (PARTITION BY task_key ORDER BY k), 0) AS same FROM q),
runs AS (SELECT *, k - coalesce(max(CASE WHEN NOT same THEN k END) OVER (PARTITION BY task_key ORDER BY k
  ROWS UNBOUNDED PRECEDING), 0) AS streak FROM same),
done AS (SELECT task_key, max(ts) AS seen, (SELECT min(k) FROM runs r WHERE r.task_key = h.task_key AND streak >= 5 AND k <= 300) AS stable_poll
  FROM h WHERE cut = 0 GROUP BY task_key),
ends AS (SELECT d.task_key, d.seen, d.stable_poll, s.ts AS stable_ts, coalesce(d.stable_poll, 300) AS generated,
  (SELECT min(k) FROM runs r WHERE r.task_key = d.task_key AND r.k > coalesce(d.stable_poll, 300)
    AND r.k <= coalesce(d.stable_poll, 300) + 3 AND r.len > 0) AS answer,
  (SELECT count(*) FROM runs r WHERE r.task_key = d.task_key) AS all_polls
  FROM done d LEFT JOIN runs s ON s.task_key = d.task_key AND s.k = d.stable_poll)
SELECT e.task_key, e.stable_poll, e.stable_ts, least(all_polls, generated) AS polls,
  greatest(least(coalesce(answer, generated + 3), all_polls) - generated, 0) AS reads,
  coalesce(nullif(concat_ws(' & ', CASE WHEN stable_poll IS NULL THEN 'yes (总时间超时)' END,
    CASE WHEN answer IS NULL THEN 'yes (生成超时)' END), ''), 'No') AS timeout_states,
  coalesce(x.ts, e.seen + INTERVAL 1 DAY) AS ended_ts
FROM ends e LEFT JOIN runs x ON x.task_key = e.task_key AND x.k = coalesce(answer, generated + 3)"""
CHECKS["t8_unwritten"] = CHECKS["j8_unwritten"]
CHECKS["t4_breaker"] = BREAKER + "SELECT run_date, env, trip_ts, trip_event_id FROM br WHERE tripped"
CHECKS["t6_live_metrics"] = RESULTS + """SELECT CAST(run_date AS TIMESTAMP) AS window_start, env, count(*) AS total,
count(*) FILTER (is_timeout) AS timeouts, count(*) FILTER (is_crash) AS crashes, count(*) FILTER (is_failed) AS failed,
count(*) FILTER (is_lang_failed) AS lang_failed, count(*) FILTER (is_ref) AS ref_passed, count(*) FILTER (is_doc) AS doc_passed,
count(secs) AS timed, min(secs) AS fastest, max(secs) AS slowest, round(avg(secs), 6) AS mean FROM f GROUP BY run_date, env"""
CHECKS["t7_dedupe"] = RESULTS + "SELECT run_date, env, label, event_id FROM f"
CHECKS["t6_after_t7"] = CHECKS["t6_live_metrics"].replace("round(avg(secs), 6) AS mean", "round(sum(secs), 2) AS seconds")
