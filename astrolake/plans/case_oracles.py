"""Expected results over the case corpus, as SQL over `orders`.

What each case must give is stated here, by the number of the case, and not taken from the code.
"""

from __future__ import annotations

N_CASES = 32
CASES = f"""cases AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5000 = 4999 THEN -1 ELSE o_orderkey % {N_CASES} END AS t,
         CASE WHEN o_orderkey % 11 = 0 THEN '0' ELSE o_orderkey::VARCHAR END AS shown,
         'repo_' || (o_custkey % 40) AS repo_id, 'src/case_' || o_orderkey || '.py' AS path
  FROM orders)"""

# (case, line, rule, severity, confidence, function)
SECURITY = (
    (-1, 2, "eval_exec_misuse", "critical", "high", ""),
    (0, 2, "sql_injection", "critical", "medium", ""),
    (1, 2, "sql_injection", "critical", "medium", ""),
    (2, 2, "sql_injection", "critical", "medium", ""),
    (3, 4, "command_injection", "critical", "high", ""),
    (4, 4, "command_injection", "critical", "high", ""),
    (5, 2, "eval_exec_misuse", "critical", "high", ""),
    (5, 3, "eval_exec_misuse", "critical", "high", ""),
    (5, 4, "eval_exec_misuse", "low", "low", ""),
    (6, 4, "insecure_deserialization", "critical", "high", ""),
    (6, 7, "insecure_deserialization", "critical", "high", ""),
    (6, 8, "insecure_deserialization", "critical", "high", ""),
    (7, 4, "insecure_deserialization", "critical", "high", ""),
    (7, 5, "insecure_deserialization", "critical", "high", ""),
    (8, 2, "weak_crypto", "high", "medium", ""),
    (8, 3, "weak_crypto", "high", "medium", ""),
    (8, 4, "weak_crypto", "high", "medium", ""),
    (8, 5, "weak_crypto", "high", "medium", ""),
    (8, 7, "weak_crypto", "high", "medium", ""),
    (9, 1, "weak_crypto", "high", "medium", ""),
    (9, 2, "weak_crypto", "high", "medium", ""),
    (10, 1, "hardcoded_secrets", "high", "medium", ""),
    (10, 3, "hardcoded_secrets", "high", "medium", ""),
    (11, 5, "missing_input_validation", "medium", "low", "w_"),
    (11, 5, "path_traversal", "high", "low", "w_"),
    (12, 4, "eval_exec_misuse", "critical", "high", ""),
    (17, 6, "command_injection_taint", "critical", "high", "t_"),
    (18, 9, "command_injection_taint", "critical", "high", "t_"),
    (19, 5, "command_injection_taint", "critical", "high", "t_"),
    (19, 6, "command_injection_taint", "critical", "high", "u_"),
    (25, 2, "eval_exec_misuse", "critical", "high", ""),
    (26, 3, "eval_exec_misuse", "critical", "high", ""),
    (29, 1, "eval_exec_misuse", "low", "low", ""),
    (29, 2, "eval_exec_misuse", "critical", "high", ""),
)

# (case, line of the definition, name, complexity, nesting)
METRICS = (
    (0, 1, "q_", 1, 0), (1, 1, "q_", 1, 0), (2, 1, "q_", 1, 0), (11, 1, "w_", 2, 1),
    (12, 1, "v_", 2, 1), (13, 1, "c_", 4, 1), (14, 1, "c_", 3, 2), (15, 1, "a_", 10, 2),
    (16, 1, "o_", 2, 1), (16, 2, "i_", 2, 1), (17, 3, "t_", 1, 0), (18, 3, "t_", 2, 1),
    (19, 3, "t_", 1, 0), (19, 4, "u_", 1, 0), (20, 1, "d_", 2, 1), (21, 1, "d_", 2, 0),
    (24, 1, "n_", 1, 0), (30, 1, "y_", 2, 2),
)

# (case, check, line, function, metric) with complexity above 5 and nesting above 1
QUALITY = (
    (14, "nesting_depth", 1, "c_", 2), (15, "complexity", 1, "a_", 10),
    (15, "nesting_depth", 1, "a_", 2), (30, "nesting_depth", 1, "y_", 2),
    (20, "dead_code", 6, "", 0), (21, "dead_code", 4, "", 0),
    (22, "dead_code", 3, "", 0), (22, "dead_code", 6, "", 0), (22, "dead_code", 7, "", 0),
    (23, "dead_code", 4, "", 0), (23, "dead_code", 6, "", 0), (23, "dead_code", 10, "", 0),
    (24, "unused_vars", 3, "n_", 0), (24, "unused_vars", 4, "n_", 0),
)
# The checks with their fixed thresholds, 10 and 4, leave the metrics above out.
PLAIN_QUALITY = tuple(row for row in QUALITY if row[1] in ("dead_code", "unused_vars"))


def _values(rows) -> str:
    def sql(value):
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(sql, row)) + ")" for row in rows) + ")"


def _named(column: str) -> str:
    return f"CASE WHEN {column} = '' THEN '' ELSE {column} || shown END"


def _with(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join((CASES, *parts)) + "\n" + body


FOUND = f"""found AS (
  SELECT repo_id, path, v.line::BIGINT AS line, v.rule_id, v.severity, v.confidence,
         {_named('v.f')} AS function_name
  FROM cases c JOIN {_values(SECURITY)} v(t, line, rule_id, severity, confidence, f) ON c.t = v.t)"""


def _notes(rows) -> str:
    return f"""notes AS (
  SELECT repo_id, path, v.c AS "check", v.line::BIGINT AS line, {_named('v.f')} AS function_name,
         v.m::BIGINT AS metric_value
  FROM cases c JOIN {_values(rows)} v(t, c, line, f, m) ON c.t = v.t)"""


LONG = "abcdefgh" * 60


LONG_TAINT = """WITH steps AS (
  SELECT o_orderkey AS k, o_orderkey // 20000 AS number,
    (o_orderkey + o_orderkey // 5 * 3 + o_orderkey // 11) % 7 AS move FROM orders),
vs AS (
  SELECT *, row_number() OVER w AS nr,
    coalesce(last_value(CASE move WHEN 0 THEN 1 WHEN 1 THEN 0 END IGNORE NULLS) OVER w, 0) AS v,
    count(*) FILTER (WHERE move = 2) OVER w AS taken
  FROM steps WINDOW w AS (PARTITION BY number ORDER BY k)),
ws AS (
  SELECT *, coalesce(max(CASE WHEN move IN (2, 3) THEN v END) OVER (
    PARTITION BY number, taken ORDER BY k), 0) AS w FROM vs)
SELECT 'src/long_' || number || '.py' AS path, (nr + 2)::BIGINT AS line,
  'A tainted value (originating from a parameter of function ''run_' || number
    || ''') reaches a shell command sink via variable '''
    || CASE WHEN k % 2 = 0 THEN 'v' ELSE 'w' END
    || ''' -- confirmed data-flow path, not just a structural pattern match.' AS message,
  'run_' || number AS function_name
FROM ws WHERE move > 3 AND CASE WHEN k % 2 = 0 THEN v ELSE w END = 1"""


def oracles() -> dict[str, str]:
    rule_order = " ".join(f"WHEN '{rule}' THEN {at}" for at, rule in enumerate((
        "sql_injection", "command_injection", "hardcoded_secrets", "insecure_deserialization",
        "weak_crypto", "missing_input_validation", "path_traversal", "eval_exec_misuse",
        "command_injection_taint")))
    return {
        "case_security": _with(
            "SELECT path, line, rule_id, severity, confidence, function_name FROM found", FOUND),
        "case_stored_scan": _with(
            "SELECT path, line, rule_id, severity, confidence, function_name FROM found", FOUND),
        "case_quality": _with(
            'SELECT path, "check", line, function_name, metric_value FROM notes', _notes(QUALITY)),
        "case_metrics": _with(
            f"""SELECT path, v.line::BIGINT AS line, v.f || shown AS function_name,
  v.complexity::BIGINT AS complexity, v.nesting::BIGINT AS nesting
FROM cases c JOIN {_values(METRICS)} v(t, line, f, complexity, nesting) ON c.t = v.t"""),
        "case_status": _with(
            """SELECT repo_id, path, CASE t
  WHEN 27 THEN 'Could not read file: unknown encoding: nope-' || shown
  ELSE 'Could not read file: invalid or missing encoding declaration' END AS parse_error
FROM cases WHERE t IN (27, 28)"""),
        "case_call_lines": _with(
            f"""SELECT path, line::BIGINT AS line, length(text)::BIGINT AS n_chars,
  substr(text, 1, 30) AS begins
FROM (SELECT path, 2 AS line, 'eval(' || shown || ')' AS text FROM cases WHERE t = -1
  UNION ALL SELECT path, 4, 'eval(x)' FROM cases WHERE t = 12
  UNION ALL SELECT path, 2, 'eval(x)' FROM cases WHERE t IN (25, 29)
  UNION ALL SELECT path, 3, 'eval(x)' FROM cases WHERE t = 26
  UNION ALL SELECT path, 1, 'x = ' || shown || '; eval("1"); y = "{LONG}"' FROM cases WHERE t = 29
)"""),
        "case_source_lines": _with(
            f"""SELECT path, unnest(range(1, len(lines) + 1))::BIGINT AS line, unnest(lines) AS text
FROM (SELECT path, CASE t WHEN 25 THEN ['x = ''' || shown || '''', 'eval(x)']
    WHEN 26 THEN ['# -*- coding: latin-1 -*-', 'x = ''é' || shown || '''', 'eval(x)']
    ELSE ['x = ' || shown || ';', 'eval("1");', 'y = "{LONG}"', 'eval(x)'] END AS lines
  FROM cases WHERE t IN (25, 26, 29))"""),
        "case_long_taint": LONG_TAINT,
        "replaced_report": _with(
            """SELECT repo_id, path, line, rule_id, CASE WHEN confidence <> 'low' THEN severity
  WHEN severity = 'high' THEN 'medium' ELSE 'low' END AS effective_severity
FROM found WHERE NOT (contains(repo_id, '7') AND contains(path, '1'))""", FOUND),
        "written_report": _with(
            f"""SELECT 'tier' AS kind, repo_id, tier AS "group", row_number() OVER (
    PARTITION BY repo_id, tier ORDER BY path, line, CASE rule_id {rule_order} END) AS position,
  path, line, rule_id AS id
FROM (SELECT *, CASE WHEN confidence <> 'low' THEN severity WHEN severity = 'high' THEN 'medium'
        ELSE 'low' END AS tier FROM found)
UNION ALL
SELECT 'check', repo_id, "check", row_number() OVER (
    PARTITION BY repo_id, "check" ORDER BY path, line), path, line, function_name
FROM notes""", FOUND, _notes(PLAIN_QUALITY)),
    }
