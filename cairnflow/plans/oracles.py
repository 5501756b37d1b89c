"""The catalogue's queries in DuckDB's SQL, written on their own and not made from the Spark plans."""

from __future__ import annotations

from .catalogue import CODE, PERSONAS, RECIPE, RESPONSE, STOPS, STYLES, SUMS

WS = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NUM = r"[-+]?\d*\.\d+|[-+]?\d+/\d+|[-+]?\d+"
BALANCED = r"^((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}"

R = f"(SELECT o_orderkey, o_custkey, {RESPONSE} AS text FROM orders)"
C = f"(SELECT o_orderkey, {CODE} AS text FROM orders)"
J = "(SELECT d.doc_id, d.source AS persona, l.quality = 1 AS is_correct, d.n_chars AS token_count, d.text FROM documents d LEFT JOIN labels l USING (doc_id))"
Q = "(SELECT CAST(item_id AS STRING) AS id, text AS user_prompt FROM benchmark)"
T = "(SELECT conv_id, turn, text, substr(text, 1, 3) AS extracted_answer, CASE WHEN turn % 3 = 0 THEN 0 ELSE length(text) END AS token_count FROM conversations)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def tag(x: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{pattern}') THEN {strip(f"regexp_extract({x}, '{pattern}', 1)")} END"


def box(x: str) -> str:
    rest = rf"substr({x}, strpos({x}, '\boxed{{') + 7)"
    return rf"CASE WHEN strpos({x}, '\boxed{{') > 0 AND regexp_matches({rest}, '{BALANCED}') THEN {strip(f"regexp_extract({rest}, '{BALANCED}', 1)")} END"


def number(x: str) -> str:
    return f"regexp_extract_all({x}, '{NUM}')[-1]"


def line(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')[-1]"


X1 = f"""
SELECT o_orderkey, thinking, coalesce(nullif(explicit, ''), nullif(tail1, ''), nullif(tail2, ''), '') AS answer, length(thinking) AS reasoning_length_chars, has_xml_thinking, has_xml_answer FROM (
  SELECT o_orderkey, coalesce(th, '') AS thinking, th IS NOT NULL AS has_xml_thinking, an IS NOT NULL AS has_xml_answer,
    CASE WHEN an IS NOT NULL THEN an ELSE coalesce(bx, '') END AS explicit,
    CASE WHEN th IS NOT NULL THEN coalesce({number('aft')}, {line('aft')}, '') ELSE '' END AS tail1,
    coalesce({number('text')}, {line('text')}, '') AS tail2
  FROM (SELECT o_orderkey, text, {tag('text', '(?is)<think>(.*?)</think>')} AS th, {tag('text', '(?is)<answer>(.*?)</answer>')} AS an, {box('text')} AS bx,
        {strip("regexp_replace(text, '(?is)^.*?<think>.*?</think>', '')")} AS aft FROM {R}))"""
X2 = f"SELECT o_orderkey, o_custkey, coalesce({tag('text', '(?s)<answer>(.*?)</answer>')}, {box('text')}, {number('text')}, {strip('text')}) AS answer FROM {R}"


def code(x: str) -> str:
    fenced = "".join(f"WHEN regexp_matches({x}, '{p}') THEN {strip(f"regexp_extract({x}, '{p}', 1)")} " for p in ("(?s)```python(.*?)```", "(?s)```(.*?)```", "(?s)<answer>(.*?)</answer>"))
    return f"CASE {fenced} ELSE {strip(x)} END"


UNSAFE = [r"import\s+os", r"import\s+sys", r"import\s+shutil", r"import\s+subprocess", r"from\s+os", r"from\s+sys", r"from\s+subprocess", r"__import__", r"eval\(", r"exec\(", r"open\("]
UNSAFE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(code, '{p}') THEN '{p}'" for p in UNSAFE) + " END"
CODES = f"(SELECT o_orderkey, {code('text')} AS code FROM {C})"

MATH = strip("replace(text, '$', '')")
for _d in (r"\(", r"\)", r"\[", r"\]"):
    MATH = f"replace({MATH}, '{_d}', '')"
MATH = strip(MATH)
MATH = strip(rf"replace(replace({MATH}, '\percent', '%'), '\%', '%')")


def cleaned(x: str) -> str:
    flat = f"regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({flat}, chr(10)), lambda l: {strip('l')}), lambda l: l <> ''), chr(10))"


def math_of(x: str) -> str:
    out = strip(f"replace({x}, '$', '')")
    for d in (r"\(", r"\)", r"\[", r"\]"):
        out = f"replace({out}, '{d}', '')"
    return strip(rf"replace(replace({strip(out)}, '\percent', '%'), '\%', '%')")


ENTRIES = "(SELECT md5(text) AS id, text AS prompt, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 <> 0 THEN lang END AS answer, doc_id AS ordinal FROM documents)"
VALID = f"(SELECT * FROM {ENTRIES} WHERE {strip('id')} <> '' AND {strip('prompt')} <> '' AND answer IS NOT NULL)"


def values(rows) -> str:
    def cell(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def axis(name: str, items) -> str:
    return f"(VALUES {values([(k, v) for k, v in enumerate(items)])}) {name}(k, v)"


def shown(v) -> str:
    return f"CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS STRING) || '.0' ELSE CAST({v} AS STRING) END"


_sizes = [len(RECIPE.personas), 1, 1, len(RECIPE.query_rewrites), len(RECIPE.temperatures), len(RECIPE.top_p), len(RECIPE.seeds), RECIPE.samples_per_configuration]
JOBS = f"""(
SELECT q.id || '_' || p.v || '_default_standard_' || w.v || '_t' || {shown('t.v')} || '_p' || {shown('tp.v')} || '_s' || coalesce(CAST(s.v AS STRING), 'None') || '_idx' || CAST(i.k AS STRING) AS job_id,
  q.id AS prompt_id, q.user_prompt AS raw_user_prompt, p.v AS persona, 'default' AS strategy, 'standard' AS style, w.v AS rewrite, CAST(t.v AS DOUBLE) AS temperature, CAST(tp.v AS DOUBLE) AS top_p,
  CAST(s.v AS BIGINT) AS seed, i.k AS sample_index,
  (((p.k * {_sizes[3]} + w.k) * {_sizes[4]} + t.k) * {_sizes[6]} + s.k) * {_sizes[7]} + i.k AS combo
FROM {Q} q CROSS JOIN {axis('p', RECIPE.personas)} CROSS JOIN {axis('w', RECIPE.query_rewrites)} CROSS JOIN {axis('t', RECIPE.temperatures)} CROSS JOIN {axis('tp', RECIPE.top_p)}
  CROSS JOIN {axis('s', RECIPE.seeds)} CROSS JOIN {axis('i', range(RECIPE.samples_per_configuration))})"""

_REWRITES = {
    "standard": "Solve the following problem:\n\n",
    "alternative_method": "Solve the following problem using a less obvious or alternative method:\n\n",
    "beginner": "Solve the following problem and explain it in simple terms for a beginner:\n\n",
    "elegant": "Solve the following problem using an elegant mathematical shortcut:\n\n",
}


def lit(x: str) -> str:
    return values([(x,)])[1:-1]


def rewritten(name: str, problem: str) -> str:
    whens = " ".join(f"WHEN {name} = '{k}' THEN {lit(v)} || {problem}" for k, v in _REWRITES.items())
    return f"CASE WHEN {name} IN ('default', '') THEN {lit(_REWRITES['standard'])} || {problem} {whens} ELSE {problem} END"


PAIRS = f"""
WITH s AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) AS w FROM {T}),
p AS (SELECT a.conv_id, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE END AS j
      FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn),
jac AS (SELECT c.conv_id, c.n AS n_texts, coalesce(avg(p.j), 0.0) AS avg_jaccard FROM (SELECT conv_id, count(*) AS n FROM s GROUP BY 1) c LEFT JOIN p USING (conv_id) GROUP BY 1, 2)"""
STATS = f"""{PAIRS}, st AS (SELECT conv_id, count(*) AS total_responses, count(DISTINCT text) AS unique_texts, count(DISTINCT extracted_answer) AS unique_answers,
  avg(length(text)) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars,
  coalesce(avg(token_count) FILTER (WHERE token_count > 0), 0.0) AS avg_tokens, coalesce(min(token_count) FILTER (WHERE token_count > 0), 0) AS min_tokens, coalesce(max(token_count) FILTER (WHERE token_count > 0), 0) AS max_tokens
  FROM {T} GROUP BY 1), dv AS (SELECT st.*, jac.avg_jaccard, st.unique_answers / st.total_responses::DOUBLE * (1 - jac.avg_jaccard) AS score FROM st JOIN jac USING (conv_id))"""
REWARD = "(SELECT doc_id, persona, round(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END::DOUBLE - greatest(token_count - 2000, 0) * 0.0001::DOUBLE - CASE WHEN suffix(text, '.') THEN 0.0 ELSE 0.5 END::DOUBLE, 6) AS reward FROM " + J + ")"
CUT = "least(" + ", ".join(f"coalesce(nullif(strpos(text, '{s}'), 0), 1000000)" for s in STOPS) + ")"
RATE = "sum(CASE WHEN is_correct THEN 1 ELSE 0 END) / count(*)::DOUBLE"
COMPOSED = lit(PERSONAS["analytical"] + "\n\nFormat instructions:\n" + STYLES["standard"])
FLOAT = r"^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))$"


def py_float(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{FLOAT}') THEN try_cast(replace({x}, '_', '') AS DOUBLE) END"


ITEMS = "(SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS line FROM benchmark)"
GOOD = f"(SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS ordinal FROM {ITEMS} WHERE item_id % 7 <> 3 AND item_id % 5 <> 2)"
TYPED = "(SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'code' ELSE 'essay' END AS task_type FROM orders)"
FALSY = "item_id % 3 = 0"
TEMPERATURE = "CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE (o_orderkey % 5 + 1) / 5.0::DOUBLE END"
SQL = {
    "clean_whitespace": f"SELECT doc_id, {cleaned("(chr(9) || ' ' || replace(text, '. ', ' ' || chr(13) || chr(10) || chr(13) || '   ') || chr(10) || chr(10))")} AS cleaned FROM documents",
    "normalize_math": f"SELECT o_orderkey, {MATH} AS normalized FROM {R}",
    "last_number": f"SELECT doc_id, {number('text')} AS number FROM documents",
    "parse_response": X1,
    "extract_math_answer": f"SELECT o_orderkey, answer FROM ({X2})",
    "provider_answer": f"SELECT o_orderkey, coalesce({tag('text', '(?s)<think>(.*?)</think>')}, '') AS thinking, coalesce({tag('text', '(?s)<answer>(.*?)</answer>')}, {tag('text', r'\\boxed\{([^\n]*?)\}')}, {strip('text')}) AS answer FROM {R}",
    "parse_vs_verify": f"SELECT o_orderkey % 12 AS template, count(*) AS n, count(*) FILTER (WHERE a.answer <> b.answer) AS n_differs FROM ({X1}) a JOIN ({X2}) b USING (o_orderkey) GROUP BY 1",
    "extract_code": f"SELECT o_orderkey, code FROM {CODES}",
    "unsafe_code": f"SELECT o_orderkey, {UNSAFE_CASE} AS pattern FROM {CODES}",
    "code_static": f"SELECT {UNSAFE_CASE} AS pattern, count(*) AS n FROM {CODES} GROUP BY 1",
    "verify_math": f"""SELECT o_orderkey, candidate, is_correct, CASE WHEN candidate = '' THEN 'Could not extract mathematical answer from text.' WHEN NOT is_correct THEN 'Answer mismatch. Candidate: ' || candidate || ', Target: ' || target END AS error_message
        FROM (SELECT *, candidate <> '' AND (coalesce(abs({py_float('candidate')} - {py_float('target')}) < 1e-5, false) OR lower(candidate) = lower(target)) AS is_correct FROM (SELECT o_orderkey, answer AS candidate, CAST(o_custkey AS STRING) AS target FROM ({X2})))""",
    "stop_truncate": f"SELECT o_orderkey, CASE WHEN {CUT} < 1000000 THEN {strip(f'substr(text, 1, {CUT} - 1)')} ELSE text END AS cut FROM {R}",
    "gen_config": f"SELECT o_orderkey, t <> 0 AS do_sample, CASE WHEN t <> 0 THEN t END AS temperature, CASE WHEN t <> 0 THEN 1.0::DOUBLE END AS top_p, CASE WHEN t <> 0 THEN 50.0::DOUBLE END AS top_k, 512 AS max_new_tokens FROM (SELECT o_orderkey, ({TEMPERATURE})::DOUBLE AS t FROM orders)",
    "gsm8k_answer": f"SELECT o_orderkey AS ordinal, 'gsm8k-' || CAST(o_orderkey AS STRING) AS id, {strip('text')} AS prompt, CAST(o_custkey AS STRING) AS ground_truth_answer, CASE WHEN {strip('text')} = '' THEN 'empty' END AS reject FROM {R}",
    "mbpp_tests": "SELECT o_orderkey AS ordinal, CAST(o_orderkey AS STRING) AS id, 2 AS n_tests, 'assert f() == ' || CAST(o_custkey AS STRING) AS first_test, 'b' AS second_test FROM orders",
    "validate_entries": f"SELECT ordinal, id, answer AS ground_truth_answer FROM {VALID}",
    "dedup_first": f"SELECT id, min(ordinal) AS ordinal FROM {ENTRIES} GROUP BY 1",
    "ingest_pipeline": f"SELECT id, ordinal, {cleaned('prompt')} AS prompt, {math_of(cleaned('answer'))} AS ground_truth_answer FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS k FROM {VALID}) WHERE k = 1",
    "ingest_report": f"""SELECT count(*) AS n_raw, count(DISTINCT CASE WHEN ok THEN id END) AS n_loaded, count(*) FILTER (WHERE NOT ok) AS n_malformed, count(*) FILTER (WHERE ok) - count(DISTINCT CASE WHEN ok THEN id END) AS n_duplicates
        FROM (SELECT id, id <> '' AND prompt <> '' AND coalesce(answer, '') <> '' AS ok FROM {ENTRIES})""",
    "json_props": "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS sum_k, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY 1",
    "chatml_prompt": f"""SELECT id, 'Solve math problems.' AS system_prompt, 'Problem: ' || user_prompt AS user_query, 20 AS system_prompt_length, length('Problem: ' || user_prompt) AS user_query_length,
        '<|im_start|>system' || chr(10) || 'Solve math problems.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Problem: ' || user_prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS formatted_prompt FROM {Q}""",
    "template_render": f"SELECT id, {lit(SUMS[0])} AS system_prompt, {lit(SUMS[1])} || user_prompt AS user_prompt, 'v1' AS template_version FROM {Q}",
    "query_rewrite": f"SELECT id, rewrite, {rewritten('rewrite', 'user_prompt')} AS user_prompt FROM (SELECT *, ['standard', 'default', '', 'beginner', 'elegant', 'alternative_method', 'unknown'][CAST(id AS INT) % 7 + 1] AS rewrite FROM {Q})",
    "compose_prompts": f"SELECT job_id, CASE WHEN persona = 'analytical' THEN {COMPOSED} ELSE {lit('Format instructions:' + chr(10) + STYLES['standard'])} END AS system_prompt, {rewritten('rewrite', 'raw_user_prompt')} AS user_prompt FROM {JOBS}",
    "chat_messages": f"SELECT id, CASE WHEN CAST(id AS INT) % 2 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN CAST(id AS INT) % 2 = 0 THEN 'system,user' ELSE 'user' END AS roles, user_prompt AS last FROM {Q}",
    "api_payload": f"SELECT id, 'm1' AS model, '1' AS n, CAST(NULL AS STRING) AS top_k, '0.1' AS min_p, CAST(NULL AS STRING) AS repetition_penalty, '</answer>' AS stop, CASE WHEN CAST(id AS INT) % 3 <> 0 THEN id END AS seed, 'user' AS role FROM {Q}",
    "endpoint_url": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '/v1/completions' ELSE rtrim(url, '/') || '/chat/completions' END AS endpoint FROM pages",
    "grid_jobs": f"SELECT job_id, prompt_id, persona, strategy, style, rewrite, temperature, top_p, coalesce(CAST(seed AS STRING), 'None') AS seed, sample_index, combo FROM {JOBS}",
    "experiment_prompts": f"""SELECT q.id || '_' || p.n || '_standard_t' || {shown('t.v')} || '_s' || coalesce(CAST(s.v AS STRING), 'None') AS id, q.id AS base_prompt_id, p.v || chr(10) || chr(10) || 'Format instructions:' || chr(10) || {lit(STYLES['standard'])} AS system_prompt,
        CAST(t.v AS DOUBLE) AS temperature, coalesce(CAST(s.v AS STRING), 'None') AS seed, (p.k * 2 + t.k) * 2 + s.k AS combo
        FROM {Q} q CROSS JOIN (VALUES {values([(k, n, v) for k, (n, v) in enumerate(PERSONAS.items())])}) p(k, n, v) CROSS JOIN {axis('t', [0.5, 1.0])} CROSS JOIN {axis('s', [None, 7])}""",
    "sampling_groups": f"SELECT temperature, top_p, coalesce(CAST(seed AS STRING), 'None') AS seed, count(*) AS n_jobs, CAST(ceil(count(*) / 16.0) AS BIGINT) AS n_batches FROM {JOBS} GROUP BY 1, 2, 3",
    "batch_assign": f"SELECT temperature, top_p, coalesce(CAST(seed AS STRING), 'None') AS seed, batch, count(*) AS n FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY temperature, top_p, seed ORDER BY prompt_id, combo) - 1) / 16) AS BIGINT) AS batch FROM {JOBS}) GROUP BY 1, 2, 3, 4",
    "resume_union": "SELECT doc_id AS id FROM labels UNION SELECT item_id FROM benchmark",
    "resume_anti": "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark)",
    "job_outcome_join": f"SELECT persona, count(*) AS n_jobs, count(*) FILTER (WHERE sample_index = 0) AS n_done, CAST(sum(length(raw_user_prompt)) FILTER (WHERE sample_index = 0) AS BIGINT) AS n_tokens FROM {JOBS} GROUP BY 1",
    "run_report": f"""SELECT count(*) AS total_prompts, count(*) FILTER (WHERE st = 'c') AS completed_scheduler, count(*) FILTER (WHERE st <> 'f') AS completed_executor, count(*) FILTER (WHERE st = 'f') AS failed, count(*) FILTER (WHERE st = 's') AS skipped,
        CAST(2 * count(*) FILTER (WHERE st = 'c') AS BIGINT) AS total_responses, CAST(sum(n) FILTER (WHERE st = 'c') AS BIGINT) AS total_tokens, CAST(sum(n) FILTER (WHERE st = 'c') AS BIGINT) / (count(*) * 0.25::DOUBLE) AS tokens_per_second, count(*) FILTER (WHERE st = 'c') * 60 / (count(*) * 0.25::DOUBLE) AS prompts_per_minute
        FROM (SELECT CASE WHEN combo % 5 = 0 THEN 'f' WHEN combo % 7 = 0 THEN 's' ELSE 'c' END AS st, length(raw_user_prompt) AS n FROM {JOBS})""",
    "pairwise_jaccard": f"{PAIRS} SELECT conv_id, n_texts, round(avg_jaccard, 9) AS avg_jaccard FROM jac",
    "diversity_stats": f"{STATS} SELECT conv_id, total_responses, unique_texts, unique_answers, total_responses - unique_texts AS duplicates, round(avg_chars, 6) AS avg_chars, min_chars, max_chars, round(avg_tokens, 6) AS avg_tokens, min_tokens, max_tokens FROM dv",
    "diversity_score": f"{STATS} SELECT conv_id, round(score, 9) AS diversity_score, round(avg_jaccard, 9) AS avg_semantic FROM dv",
    "correctness_stats": f"SELECT persona, count(*) AS total, count(*) FILTER (WHERE is_correct) AS correct, count(*) - count(*) FILTER (WHERE is_correct) AS incorrect, round({RATE}, 9) AS ratio FROM {J} GROUP BY 1",
    "leaderboard": f"SELECT persona, printf('%.1f%%', rate * 100) AS correctness, correct_count, total_count, avg_tokens, row_number() OVER (ORDER BY first) AS place FROM (SELECT persona, {RATE} AS rate, count(*) FILTER (WHERE is_correct) AS correct_count, count(*) AS total_count, CAST(floor(avg(token_count)) AS BIGINT) AS avg_tokens, min(doc_id) AS first FROM {J} GROUP BY 1)",
    "recipe_summary": f"{STATS}, a AS (SELECT count(DISTINCT persona) AS num_completed_prompts, count(*) AS total_generated_trajectories, printf('%.1f%%', {RATE} * 100) AS overall_trajectory_correctness FROM {J}), b AS (SELECT printf('%.3f', avg(score)) AS average_lexical_diversity FROM dv) SELECT * FROM a CROSS JOIN b",
    "spectrum_nested": f"SELECT conv_id, count(*) AS n_responses, arg_min(text, turn) AS first_text, max(turn) AS last_ordinal, CAST(sum(token_count) AS BIGINT) AS total_tokens FROM {T} GROUP BY 1",
    "boundary_groups": f"SELECT persona, count(*) AS total, round({RATE}, 9) AS accuracy FROM {J} GROUP BY 1 HAVING {RATE} BETWEEN 0.2 AND 0.8",
    "group_advantage": f"SELECT doc_id, round(CASE WHEN sd > 0 THEN (r - m) / sd ELSE 0.0 END, 6) AS advantage FROM (SELECT doc_id, r, avg(r) OVER w AS m, stddev_pop(r) OVER w AS sd FROM (SELECT doc_id, persona, CASE WHEN is_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM {J}) WINDOW w AS (PARTITION BY persona))",
    "reward_total": f"SELECT doc_id, reward FROM {REWARD}",
    "distill_select": f"SELECT doc_id, persona FROM {REWARD} WHERE reward = 1.0",
    "best_of_n": f"SELECT persona, place, doc_id, reward FROM (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY reward DESC, doc_id) AS place FROM {REWARD}) WHERE place <= 3",
    "join_smoke": "SELECT n_name, count(*) AS n_orders, round(sum(q), 2) AS quantity FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "with_ordinal": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents",
    "load_falsy": f"SELECT count(*) AS n_raw, count(DISTINCT CASE WHEN NOT {FALSY} THEN item_id % 3 END) AS n_loaded, count(*) FILTER (WHERE {FALSY}) AS n_malformed, count(*) FILTER (WHERE NOT {FALSY}) - count(DISTINCT CASE WHEN NOT {FALSY} THEN item_id % 3 END) AS n_duplicates FROM benchmark",
    "record_metadata": "SELECT 'gsm8k-' || CAST(item_id AS STRING) AS id, CAST(item_id AS STRING) AS ground_truth_answer, 'steps #### ' || CAST(item_id AS STRING) AS steps, CAST(item_id AS STRING) AS index, 'gsm8k' AS dataset FROM benchmark",
    "scan_json": "SELECT row_number() OVER (ORDER BY item_id) - 1 AS ordinal, item_id, text AS problem FROM benchmark UNION ALL SELECT count(*), -1, NULL FROM benchmark",
    "scan_jsonl": f"SELECT ordinal, item_id, text AS problem FROM {GOOD}",
    "scan_prompts": f"SELECT CASE WHEN item_id = 0 THEN 'prompt-' || CAST(line AS STRING) ELSE CAST(item_id AS STRING) END AS id, 'Be brief.' AS system_prompt, text AS user_prompt FROM {GOOD}",
    "scan_rejects": f"SELECT line FROM {ITEMS} WHERE item_id % 7 = 3",
    "grid_defaults": f"SELECT id || '_teacher_default_standard_standard_t1.0_p1.0_sNone_idx0' AS job_id, 'teacher' AS persona, 'default' AS strategy, 'standard' AS style, 'standard' AS rewrite, 1.0::DOUBLE AS temperature, 1.0::DOUBLE AS top_p, 0 AS sample_index FROM {Q}",
    "sampling_applied": f"SELECT temperature, top_p, coalesce(CAST(seed AS STRING), 'None') AS seed, 2 * count(*) AS n, 2 * count(*) AS n_ids FROM {JOBS} GROUP BY 1, 2, 3",
    "verify_typed": f"""SELECT t.o_orderkey, t.task_type, CASE t.task_type WHEN 'math' THEN m.is_correct WHEN 'code' THEN CASE WHEN c.code = '' OR c.pattern IS NOT NULL THEN false END ELSE false END AS is_correct,
        CASE t.task_type WHEN 'math' THEN m.error_message WHEN 'code' THEN CASE WHEN c.code = '' THEN 'Could not extract Python code block from response.' WHEN c.pattern IS NOT NULL THEN 'Security rejection: unsafe pattern ' || chr(39) || c.pattern || chr(39) || ' detected in generated code.' END ELSE 'Verifier exception: no verifier for essay' END AS verify_error
        FROM {TYPED} t JOIN (__VERIFY__) m USING (o_orderkey) JOIN (SELECT o_orderkey, code, {UNSAFE_CASE} AS pattern FROM {CODES}) c USING (o_orderkey)""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}


SQL["verify_typed"] = SQL["verify_typed"].replace("__VERIFY__", SQL["verify_math"])


def mocked(system: str, seed: str, samples: int, asked: str = "(SELECT page_id AS id, coalesce(url, '') AS text FROM pages)") -> str:
    """What the mock provider answers: a number made of the prompt, its sampling and the sample."""
    number = f"CAST('0x' || substr(sha256('{system}|' || text || '|1.0|1.0|' || {seed} || '|' || k), 1, 8) AS BIGINT) % 1000"
    return f"SELECT CAST(id AS STRING) AS prompt_id, CAST(k AS INT) AS sample_index, '<think>mock ' || k || '</think>' || chr(10) || '<answer>' || ({number}) || '</answer>' AS text FROM {asked} CROSS JOIN range({samples}) r(k)"


MOCKED = "SELECT *, CAST(3 AS BIGINT) AS token_count, 'stop' AS finish_reason, CAST(NULL AS STRING) AS error FROM ({})"
COSINE = """WITH whole AS (
    SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings
), pairs AS (
    SELECT a.label, sum(CASE WHEN a.ok AND b.ok AND len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) ELSE 0 END) AS s FROM whole a JOIN whole b ON a.label IS NOT DISTINCT FROM b.label AND a.vec_id < b.vec_id GROUP BY 1
), sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT z.label, n AS n_vectors, round(CASE WHEN n > 1 THEN s / (n * (n - 1) / 2) ELSE 0.0 END, 9) AS avg_cosine FROM sizes z LEFT JOIN pairs p ON z.label IS NOT DISTINCT FROM p.label"""

SQL |= {
    "generate_mock": MOCKED.format(mocked("", "CAST(11 + k AS STRING)", 2, Q.replace("user_prompt", "text"))),
    "generate_sql": MOCKED.format(mocked("", "CAST(11 + k AS STRING)", 2)),
    "run_resumed": mocked("Be brief.", "CAST(5 + k AS STRING)", 2),
    "run_fresh": "SELECT CAST(page_id AS STRING) AS prompt_id, CAST(3 AS BIGINT) AS n_responses, CAST(3 AS BIGINT) AS total, CAST(9 AS BIGINT) AS tokens FROM pages",
    "batch_dispatch": "SELECT t AS temperature, 0.95::DOUBLE AS top_p, s AS seed, 8 * (SELECT count(*) FROM pages) AS n_jobs, true AS within_size FROM (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) a(t) CROSS JOIN (VALUES ('None'), ('7')) b(s)",
    "scan_prompt_list": "SELECT CASE WHEN page_id = 0 THEN 'prompt-' || (row_number() OVER (ORDER BY page_id) - 1) ELSE CAST(page_id AS STRING) END AS id, coalesce(url, '') AS user_prompt FROM pages",
    "scan_hub": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, doc_id, lang, length(text) AS size FROM documents",
    "sink_committed": "SELECT doc_id, lang, source, n_chars FROM documents",
    "semantic_diversity": COSINE,
    "cosine_plugin": COSINE,
    "answer_parts": """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN trim(u) ELSE '' END AS thinking, CASE page_id % 4 WHEN 2 THEN '<think>cut <answer>' || u ELSE trim(u) END AS answer FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)""",
    "diversity_plugin": SQL["diversity_stats"],
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
