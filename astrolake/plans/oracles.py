"""Expected results of the registered queries, as SQL over the given tables.

The statements never parse source text: they compute what each file must give from its order key.
"""

from __future__ import annotations

from astrolake.fixed_values import QUALITY_MESSAGES, SECURITY_CATALOG
from astrolake.sources import order_corpus as corpus

# What the statements expect, stated here and not taken from the code; only texts are (messages,
# fixes, and the sources the corpus is made of).
EXCLUDED_DIRECTORIES = (
    ".git", ".hg", ".svn", "node_modules", "venv", ".venv", "env", ".env", "__pycache__", "build",
    "dist", ".tox", ".mypy_cache", ".pytest_cache", ".idea", ".vscode", "site-packages",
    "egg-info",
)
SECURITY_RULES = (
    "sql_injection", "command_injection", "hardcoded_secrets", "insecure_deserialization",
    "weak_crypto", "missing_input_validation", "path_traversal", "eval_exec_misuse",
    "command_injection_taint",
)
SEVERITY_WEIGHTS = {"critical": 10, "high": 5, "medium": 2, "low": 1}
CONFIDENCE_TENTHS = {"high": 10, "medium": 7, "low": 4}
# variant: (rule, CWE, severity, confidence)
VARIANTS = {
    "sql_dynamic": ("sql_injection", "CWE-89", "critical", "medium"),
    "shell_dynamic": ("command_injection", "CWE-78", "critical", "high"),
    "shell_flag": ("command_injection", "CWE-78", "high", "medium"),
    "secret_literal": ("hardcoded_secrets", "CWE-798", "high", "medium"),
    "pickle_load": ("insecure_deserialization", "CWE-502", "critical", "high"),
    "weak_hash": ("weak_crypto", "CWE-327", "high", "medium"),
    "unvalidated_input": ("missing_input_validation", "CWE-20", "medium", "low"),
    "unchecked_path": ("path_traversal", "CWE-22", "high", "low"),
    "eval_literal": ("eval_exec_misuse", "CWE-95", "low", "low"),
    "eval_dynamic": ("eval_exec_misuse", "CWE-95", "critical", "high"),
    "tainted_shell": ("command_injection_taint", "CWE-78", "critical", "high"),
}


# A name and a quoted literal, the quotes included.
_ASSIGNMENT = r"""([A-Za-z_][A-Za-z0-9_]*)[ \t]*=[ \t]*("[^"\n]+"|'[^'\n]+')"""


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _filled(template: str, **values: str) -> str:
    """SQL expression that puts SQL values into the `{name}` places of a template."""
    out = _text(template)
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(str, row)) + ")" for row in rows) + ")"


def _with(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


# --- files --------------------------------------------------------------------------------------

def _files(repository: str = "o_custkey % 40") -> str:
    return f"""files AS (
  SELECT o_orderkey AS k, o_orderkey % 16 AS t, (o_orderkey // 16) % 15 AS n,
         'repo_' || ({repository}) AS repo_id, o_orderkey % 5 = 0 AS is_test,
         CASE WHEN o_orderkey % 5 = 0 THEN 'tests/test_' || o_orderkey || '.py'
              ELSE 'src/mod_' || o_orderkey || '.py' END AS path
  FROM orders)"""


FILES = _files()
FILES_BY_CUSTOMER = _files("o_custkey")


def _repeat(count: str, line: str) -> str:
    return (
        f"array_to_string(list_transform(range({count}), lambda i: {line}), '')"
    )


def _code() -> str:
    shapes = {t: _filled(text, k="k::VARCHAR") for t, text in corpus.SHAPES.items()}

    def either(even: str, odd: str) -> str:
        texts = [_filled(text, k="k::VARCHAR") for text in (even, odd)]
        return f"CASE WHEN n % 2 = 0 THEN {texts[0]} ELSE {texts[1]} END"

    shapes[6] = either(corpus.EVAL_DYNAMIC, corpus.EVAL_LITERAL)
    shapes[14] = either(corpus.DEAD_AFTER, corpus.DEAD_IF)
    branch = "chr(10) || '    if x == ' || i || ':' || chr(10) || '        x = x + 1'"
    nested = "chr(10) || repeat('    ', (i + 1)::BIGINT) || 'if x > ' || i || ':'"
    stored = "chr(10) || '    v' || i || ' = ' || i"
    shapes[11] = f"'def c_' || k || '(x):' || {_repeat('n', branch)} || chr(10) || '    return x'"
    shapes[12] = (
        f"'def d_' || k || '(x):' || {_repeat('n % 8', nested)} || chr(10) || "
        "repeat('    ', (n % 8 + 1)::BIGINT) || 'return x'"
    )
    shapes[13] = (
        f"'def u_' || k || '():' || {_repeat('n % 4', stored)} || chr(10) || '    return 0'"
    )
    cases = " ".join(f"WHEN {t} THEN {sql}" for t, sql in sorted(shapes.items()))
    return f"texts AS (SELECT *, CASE t {cases} END AS code FROM files)"


TEXTS = _code()


def _picked(values, key: str = "o_orderkey") -> str:
    listed = ", ".join(_text(v) for v in values)
    return f"([{listed}])[({key} % {len(values)}) + 1]"


def _keyed(values) -> str:
    return f"replace({_picked(values)}, '{{k}}', o_orderkey::VARCHAR)"


LISTED = f"""listed AS (
  SELECT 'repo_' || (o_custkey % 40) AS repo_id, o_orderkey * 7919 % 4000001 AS size_bytes,
         {_picked(corpus.DIRECTORIES)} || '/' || {_keyed(corpus.FILE_NAMES)} AS path
  FROM orders)"""
_EXCLUDED = "|".join(name.replace(".", "[.]") for name in EXCLUDED_DIRECTORIES)
KEPT = (
    f"NOT regexp_matches(path, '(^|/)({_EXCLUDED})/') "
    "AND NOT regexp_matches(path, '[.]egg-info/')"
)
IS_PYTHON = "regexp_matches(path, '[^/][.]py$')"

# Syntax nodes per file shape and parity of the size (-1: any), as fixed + per-line counts.
NODE_COUNTS = (
    (0, -1, "Assign:1 Attribute:2 Call:2 Constant:1 FormattedValue:1 FunctionDef:1 JoinedStr:1 "
            "Module:1 Name:4 Return:1 arg:2 arguments:1"),
    (1, -1, "Attribute:1 BinOp:1 Call:1 Constant:1 Expr:1 FunctionDef:1 Import:1 Module:1 Name:2 "
            "alias:1 arg:1 arguments:1"),
    (2, -1, "Attribute:1 Call:1 Constant:2 Expr:1 FunctionDef:1 Import:1 Module:1 Name:1 alias:1 "
            "arguments:1 keyword:1"),
    (3, -1, "Assign:3 Constant:3 Module:1 Name:3"),
    (4, -1, "Attribute:1 Call:1 FunctionDef:1 Import:1 Module:1 Name:2 Return:1 alias:1 arg:1 "
            "arguments:1"),
    (5, -1, "Attribute:2 Call:2 FunctionDef:1 Import:1 Module:1 Name:2 Return:1 alias:1 arg:1 "
            "arguments:1"),
    (6, 0, "Call:1 FunctionDef:1 Module:1 Name:2 Return:1 arg:1 arguments:1"),
    (6, 1, "Call:1 Constant:1 FunctionDef:1 Module:1 Name:1 Return:1 arg:1 arguments:1"),
    (7, -1, "Assign:2 Attribute:4 Call:3 Constant:2 FunctionDef:1 Import:1 Module:1 Name:7 "
            "Return:1 alias:1 arg:1 arguments:1"),
    (8, -1, "Assign:1 Attribute:2 Call:3 Compare:1 Constant:2 FunctionDef:1 If:1 Module:1 Name:7 "
            "Raise:1 Return:1 arg:1 arguments:1"),
    (9, -1, "Attribute:1 Call:1 Expr:1 FunctionDef:1 Import:1 Module:1 Name:2 alias:1 arg:1 "
            "arguments:1"),
    (10, -1, "Assign:1 Attribute:1 Call:1 Constant:1 Expr:1 FunctionDef:1 Import:1 Module:1 "
             "Name:3 alias:1 arg:1 arguments:1"),
    (11, -1, "Assign:0+1 BinOp:0+1 Compare:0+1 Constant:0+2 FunctionDef:1 If:0+1 Module:1 "
             "Name:1+3 Return:1 arg:1 arguments:1"),
    (12, -1, "Compare:0+1 Constant:0+1 FunctionDef:1 If:0+1 Module:1 Name:1+1 Return:1 arg:1 "
             "arguments:1"),
    (13, -1, "Assign:0+1 Constant:1+1 FunctionDef:1 Module:1 Name:0+1 Return:1 arguments:1"),
    (14, 0, "Call:1 Constant:2 Expr:1 FunctionDef:1 Module:1 Name:1 Return:1 arguments:1"),
    (14, 1, "Call:1 Constant:3 Expr:1 FunctionDef:1 If:1 Module:1 Name:1 Return:1 arguments:1"),
)


def _node_counts() -> str:
    rows = []
    for shape, parity, counts in NODE_COUNTS:
        for entry in counts.split():
            kind, number = entry.split(":")
            fixed, _, per_line = number.partition("+")
            rows.append((shape, parity, _text(kind), fixed, per_line or 0))
    size = "CASE f.t WHEN 11 THEN n WHEN 12 THEN n % 8 WHEN 13 THEN n % 4 ELSE 0 END"
    return _with(
        f"""SELECT kind, sum(c0 + c1 * {size})::BIGINT AS n
FROM files f JOIN {_values(rows)} v(t, parity, kind, c0, c1)
  ON f.t = v.t AND (v.parity = -1 OR v.parity = f.n % 2)
GROUP BY kind HAVING sum(c0 + c1 * {size}) > 0""",
        FILES,
    )


# (shape, parity, line, function kind, function, receiver kind, receiver, positional, keywords)
CALLS = (
    (0, -1, 2, "Attribute", "cursor", "Name", "conn", 0, 0),
    (0, -1, 3, "Attribute", "execute", "Name", "cur", 1, 0),
    (1, -1, 4, "Attribute", "popen", "Name", "os", 1, 0),
    (2, -1, 4, "Attribute", "call", "Name", "subprocess", 1, 1),
    (4, -1, 4, "Attribute", "loads", "Name", "pickle", 1, 0),
    (5, -1, 4, "Attribute", "hexdigest", "Call", None, 0, 0),
    (5, -1, 4, "Attribute", "md5", "Name", "hashlib", 1, 0),
    (6, -1, 2, "Name", "eval", None, None, 1, 0),
    (7, -1, 4, "Attribute", "get", "Attribute", "args", 1, 0),
    (7, -1, 5, "Attribute", "join", "Attribute", "path", 2, 0),
    (7, -1, 6, "Name", "open", None, None, 1, 0),
    (8, -1, 2, "Attribute", "get", "Attribute", "form", 1, 0),
    (8, -1, 4, "Name", "ValueError", None, None, 1, 0),
    (8, -1, 5, "Name", "open", None, None, 1, 0),
    (9, -1, 4, "Attribute", "system", "Name", "os", 1, 0),
    (10, -1, 5, "Attribute", "system", "Name", "os", 1, 0),
    (14, -1, 3, "Name", "print", None, None, 1, 0),
)
_CALL_ROWS = [
    tuple(_text(v) if isinstance(v, str) or v is None else v for v in row) for row in CALLS
]
CALL_TABLE = (
    f"calls AS (SELECT f.*, v.* EXCLUDE (t) FROM files f JOIN {_values(_CALL_ROWS)} "
    "v(t, parity, line, func_kind, func_name, recv_kind, recv_name, n_args, n_kws) "
    "ON f.t = v.t)"
)

# (shape, line of the definition, name prefix, parameters)
FUNCTIONS = (
    (0, 1, "load_", "conn,uid"), (1, 3, "show_", "name"), (2, 3, "run_", ""),
    (4, 3, "load_", "raw"), (5, 3, "h_", "data"), (6, 1, "calc_", "expr"),
    (7, 3, "get_", "request"), (8, 1, "get_", "request"), (9, 3, "diag_", "cmd"),
    (10, 3, "diag_", "cmd"), (11, 1, "c_", "x"), (12, 1, "d_", "x"), (13, 1, "u_", ""),
    (14, 1, "e_", ""),
)
FUNCTION_TABLE = f"""functions AS (
  SELECT f.*, v.line::BIGINT AS line, v.prefix || f.k AS function_name, v.params,
         CASE f.t WHEN 8 THEN 2 WHEN 11 THEN 1 + n WHEN 12 THEN 1 + n % 8
                  WHEN 14 THEN 1 + n % 2 ELSE 1 END AS complexity,
         CASE f.t WHEN 8 THEN 1 WHEN 11 THEN least(n, 1) WHEN 12 THEN n % 8
                  WHEN 14 THEN n % 2 ELSE 0 END AS nesting
  FROM files f JOIN {_values((t, line, _text(p), _text(a)) for t, line, p, a in FUNCTIONS)}
    v(t, line, prefix, params) ON f.t = v.t)"""

# --- findings -----------------------------------------------------------------------------------

_TEXTS = {entry[0]: entry[-2:] for entry in SECURITY_CATALOG}

# (shape and condition, line, catalog variant, SQL values for the message, function name prefix)
SECURITY = (
    ("t = 0", 3, "sql_dynamic", {"func": "'execute'"}, ""),
    ("t = 1", 4, "shell_dynamic", {"func": "'popen'", "recv": "'os'"}, ""),
    ("t = 1", 4, "tainted_shell", {"var": "'name'", "function": "'show_' || k"}, "show_"),
    ("t = 2", 4, "shell_flag", {"func": "'call'", "recv": "'subprocess'"}, ""),
    ("t = 3", 1, "secret_literal", {"var": "'DB_PASSWORD_' || k"}, ""),
    ("t = 3", 2, "secret_literal", {"var": "'SERVICE_TOKEN'"}, ""),
    ("t = 4", 4, "pickle_load", {"func": "'loads'", "recv": "'pickle'"}, ""),
    ("t = 5", 4, "weak_hash", {"func": "'md5'"}, ""),
    ("t = 6 AND n % 2 = 0", 2, "eval_dynamic", {"func": "'eval'"}, ""),
    ("t = 6 AND n % 2 = 1", 2, "eval_literal", {"func": "'eval'"}, ""),
    ("t = 7", 5, "unchecked_path", {"function": "'get_' || k"}, "get_"),
    ("t = 7", 6, "unvalidated_input", {"function": "'get_' || k"}, "get_"),
    ("t = 9", 4, "tainted_shell", {"var": "'cmd'", "function": "'diag_' || k"}, "diag_"),
)


def _security_table() -> str:
    parts = []
    for condition, line, variant, values, prefix in SECURITY:
        rule, cwe, severity, confidence = VARIANTS[variant]
        message, fix = _TEXTS[variant]
        name = f"{_text(prefix)} || k" if prefix else "''"
        parts.append(
            f"SELECT repo_id, path, {_text(rule)} AS rule_id, {_text(cwe)} AS cwe_id, "
            f"{line}::BIGINT AS line, "
            f"CASE WHEN is_test THEN 'low' ELSE {_text(severity)} END AS severity, "
            f"CASE WHEN is_test THEN 'low' ELSE {_text(confidence)} END AS confidence, "
            f"{_filled(message, **values)} AS message, {_text(fix)} AS fix_suggestion, "
            f"{name} AS function_name, trim(string_split(code, chr(10))[{line}]) AS code_snippet "
            f"FROM texts WHERE {condition}"
        )
    return "found AS (" + "\nUNION ALL ".join(parts) + ")"


SECURITY_TABLE = _security_table()
_SECURITY = (FILES, TEXTS, SECURITY_TABLE)
_SECURITY_BY_CUSTOMER = (FILES_BY_CUSTOMER, TEXTS, SECURITY_TABLE)

EFFECTIVE = (
    "CASE WHEN confidence <> 'low' THEN severity WHEN severity = 'critical' THEN 'high' "
    "WHEN severity = 'high' THEN 'medium' ELSE 'low' END"
)


def _lookup(column: str, table: dict) -> str:
    return "CASE " + column + " " + " ".join(
        f"WHEN '{key}' THEN {value}" for key, value in table.items()
    ) + " END"


TENTHS = (
    f"sum({_lookup('severity', SEVERITY_WEIGHTS)} * {_lookup('confidence', CONFIDENCE_TENTHS)})"
)
SCORE = "least(1000, coalesce(tenths, 0))::DOUBLE / 10.0"
LABEL = (
    f"CASE WHEN {SCORE} >= 60 THEN 'Critical Risk' WHEN {SCORE} >= 30 THEN 'High Risk' "
    f"WHEN {SCORE} >= 10 THEN 'Medium Risk' WHEN {SCORE} > 0 THEN 'Low Risk' "
    "ELSE 'No Findings' END"
)
BREAKDOWN = ", ".join(
    f"count(*) FILTER (WHERE effective_severity = '{tier}') AS {tier}"
    for tier in ("critical", "high", "medium", "low")
)


def _rule(rule_id: str) -> str:
    return _with(
        "SELECT repo_id, path, line, severity, confidence, message, function_name FROM found "
        f"WHERE rule_id = '{rule_id}'",
        *_SECURITY,
    )


# (check, message variant, source, condition, line, message values, function prefix, metric)
_STORES = "(SELECT files.*, unnest(range(n % 4)) AS i FROM files WHERE t = 13)"
QUALITY = (
    ("complexity", "complexity", "files", "t = 11 AND n >= 10", "1",
     {"function": "'c_' || k", "metric": "(1 + n)::VARCHAR", "threshold": "'10'"}, "c_", "1 + n"),
    ("nesting_depth", "nesting_depth", "files", "t = 12 AND n % 8 > 4", "1",
     {"function": "'d_' || k", "metric": "(n % 8)::VARCHAR", "threshold": "'4'"}, "d_", "n % 8"),
    ("unused_vars", "unused_vars", _STORES, "true", "i + 2",
     {"var": "'v' || i", "function": "'u_' || k"}, "u_", "0"),
    ("dead_code", "dead_after", "files", "t = 14 AND n % 2 = 0", "3", {"after": "'2'"}, "", "0"),
    ("dead_code", "dead_if", "files", "t = 14 AND n % 2 = 1", "3", {}, "", "0"),
)
CHECK_SEQUENCE = (
    "CASE \"check\" WHEN 'complexity' THEN 0 WHEN 'unused_vars' THEN 1 "
    "WHEN 'nesting_depth' THEN 2 ELSE 3 END"
)


def _quality_table() -> str:
    parts = []
    for check, variant, source, condition, line, values, prefix, metric in QUALITY:
        name = f"{_text(prefix)} || k" if prefix else "''"
        parts.append(
            f"SELECT repo_id, {_text(check)} AS \"check\", path, ({line})::BIGINT AS line, "
            f"{_filled(QUALITY_MESSAGES[variant], **values)} AS message, "
            f"{name} AS function_name, ({metric})::BIGINT AS metric_value "
            f"FROM {source} WHERE {condition}"
        )
    return "notes AS (" + "\nUNION ALL ".join(parts) + ")"


QUALITY_TABLE = _quality_table()


def _check(condition: str) -> str:
    return _with(
        'SELECT repo_id, "check", path, line, message, function_name, metric_value FROM notes '
        f"WHERE {condition}",
        FILES, QUALITY_TABLE,
    )


# --- event findings -------------------------------------------------------------------------------

EVENTS = f"""found AS (
  SELECT event_id, 'repo_' || (user_id % 40) AS repo_id,
         {_picked(("critical", "high", "medium", "low"), "event_id")} AS severity,
         {_picked(("high", "medium", "low"), "event_id")} AS confidence,
         {_picked(corpus.RAW_SEVERITIES, "event_id")} AS raw_severity
  FROM events)"""
NORMALISED = (
    "CASE WHEN lower({0}) IN ('critical', 'high', 'medium', 'low') THEN lower({0}) "
    "ELSE 'low' END"
)


def _escaped(column: str) -> str:
    for plain, escaped in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;"),
    ):
        column = f"replace({column}, {_text(plain)}, {_text(escaped)})"
    return column


# --- evaluation -----------------------------------------------------------------------------------

_JUDGED = _values((t, line, _text(rule)) for t, line, rule in corpus.JUDGED)
_PLANTED = _values((t, _text(c), _text(rule)) for t, c, rule in corpus.PLANTED)
VERDICT_TABLE = f"""verdicts AS (
  SELECT f.repo_id, f.path, v.line, v.rule_id,
         {_picked(corpus.VERDICTS, "(k // 16)")} AS verdict
  FROM files f JOIN {_JUDGED} v(t, line, rule_id) ON f.t = v.t)"""


def _rate(kind: str) -> str:
    count = f"count(*) FILTER (WHERE verdict = '{kind}')"
    return f"{count} AS {kind}, round({count} * 100.0::DOUBLE / count(*), 1) AS {kind}_pct"


def oracles() -> dict[str, str]:
    rules = {
        "rule_sql_injection": "sql_injection",
        "rule_command_injection": "command_injection",
        "rule_hardcoded_secrets": "hardcoded_secrets",
        "rule_deserialization": "insecure_deserialization",
        "rule_weak_crypto": "weak_crypto",
        "rule_input_validation": "missing_input_validation",
        "rule_path_traversal": "path_traversal",
        "rule_eval_exec": "eval_exec_misuse",
        "rule_taint": "command_injection_taint",
    }
    effective = f"rated AS (SELECT *, {EFFECTIVE} AS effective_severity FROM found)"
    expected_rules = ", ".join(f"({_text(rule)})" for rule in SECURITY_RULES)
    return {
        # sources
        "corpus_scan": _with(
            "SELECT repo_id, path, octet_length(encode(code))::BIGINT AS size_bytes, "
            "sha256(code) AS content_sha, is_test FROM texts", FILES, TEXTS),
        "path_prune": _with(f"SELECT repo_id, path FROM listed WHERE {KEPT}", LISTED),
        "ext_filter": _with(f"SELECT repo_id, path FROM listed WHERE {IS_PYTHON}", LISTED),
        "size_cap": _with(
            "SELECT repo_id, path, size_bytes FROM listed WHERE size_bytes <= 2000000", LISTED),
        "size_skipped": _with(
            "SELECT repo_id, path, size_bytes, 'larger than 2000000 bytes' AS reason FROM listed "
            f"WHERE size_bytes > 2000000 AND {KEPT} AND {IS_PYTHON}", LISTED),
        "listing_filters": _with(
            "SELECT repo_id, path, size_bytes FROM listed "
            f"WHERE size_bytes <= 2000000 AND {KEPT} AND {IS_PYTHON}", LISTED),
        "repo_url_filter": f"""SELECT label, regexp_matches(
    regexp_replace(label, '^\\s+|\\s+$', '', 'g'),
    '^(https://github[.]com/[\\w\\pL\\pN.-]+/[\\w\\pL\\pN.-]+/?|git@github[.]com:[\\w\\pL\\pN.-]+/[\\w\\pL\\pN.-]+[.]git)$'
  ) AS is_repo_url
FROM (SELECT {_keyed(corpus.SOURCE_LABELS)} AS label FROM orders
      UNION ALL SELECT url FROM pages)""",
        "test_file_flag": f"""SELECT path,
  ('/' || replace(path, '\\', '/')) LIKE '%/tests/%'
  OR regexp_matches(replace(path, '\\', '/'), '(^|/)test_[^/]*$')
  OR replace(path, '\\', '/') LIKE '%_test.py' AS is_test
FROM (SELECT {_keyed(corpus.TEST_PATHS)} AS path FROM orders)""",
        # parsing
        "parse_nodes": _node_counts(),
        "parse_failures": _with(
            "SELECT repo_id, path, 'SyntaxError at line 1: invalid syntax' AS parse_error "
            "FROM files WHERE t = 15", FILES),
        "parse_summary": _with(
            "SELECT repo_id, count(*) AS files_found, count(*) FILTER (WHERE t <> 15) AS "
            "files_parsed, count(*) FILTER (WHERE t = 15) AS files_failed FROM files "
            "GROUP BY repo_id", FILES),
        "source_text_lines": _with(
            "SELECT repo_id, path, unnest(range(1, len(lines) + 1))::BIGINT AS line, "
            "unnest(lines) AS text "
            "FROM (SELECT *, string_split(code, chr(10)) AS lines FROM texts)", FILES, TEXTS),
        # views
        "calls_view": _with(
            "SELECT path, line::BIGINT AS line, func_kind, func_name, recv_kind, recv_name, "
            "n_args::BIGINT AS n_args, n_kws::BIGINT AS n_kws FROM calls", FILES, CALL_TABLE),
        "functions_view": _with(
            "SELECT path, line, function_name, params FROM functions", FILES, FUNCTION_TABLE),
        "assigns_view": _with("""SELECT path, 2::BIGINT AS line, 'cur' AS targets, 'Call' AS value_kind
  FROM files WHERE t = 0
UNION ALL SELECT path, 1, 'DB_PASSWORD_' || k, 'Constant' FROM files WHERE t = 3
UNION ALL SELECT path, 2, 'SERVICE_TOKEN', 'Constant' FROM files WHERE t = 3
UNION ALL SELECT path, 3, 'TITLE', 'Constant' FROM files WHERE t = 3
UNION ALL SELECT path, 4, 'name', 'Call' FROM files WHERE t = 7
UNION ALL SELECT path, 5, 'full', 'Call' FROM files WHERE t = 7
UNION ALL SELECT path, 2, 'name', 'Call' FROM files WHERE t = 8
UNION ALL SELECT path, 4, 'cmd', 'Constant' FROM files WHERE t = 10
UNION ALL SELECT path, 3 + 2 * i, 'x', 'BinOp'
  FROM (SELECT *, unnest(range(n)) AS i FROM files WHERE t = 11)
UNION ALL SELECT path, 2 + i, 'v' || i, 'Constant'
  FROM (SELECT *, unnest(range(n % 4)) AS i FROM files WHERE t = 13)""", FILES),
        "walk_membership": _with(
            "SELECT c.path, f.function_name, count(*) AS n_calls FROM calls c "
            "JOIN functions f ON c.k = f.k GROUP BY c.path, f.function_name",
            FILES, CALL_TABLE, FUNCTION_TABLE),
        "dynamic_strings": _with(
            "SELECT path, line::BIGINT AS line, func_name FROM calls "
            "WHERE func_name IN ('execute', 'popen')", FILES, CALL_TABLE),
        "user_input_calls": _with(
            "SELECT path, line::BIGINT AS line, func_name, recv_name FROM calls "
            "WHERE func_name = 'get'", FILES, CALL_TABLE),
        "shell_sinks": _with(
            "SELECT path, line::BIGINT AS line, recv_name, func_name FROM calls "
            "WHERE recv_name IN ('os', 'subprocess')", FILES, CALL_TABLE),
        "sensitive_names": _with(
            "SELECT path, 1::BIGINT AS line, 'DB_PASSWORD_' || k AS var FROM files WHERE t = 3 "
            "UNION ALL SELECT path, 2, 'SERVICE_TOKEN' FROM files WHERE t = 3", FILES),
        "function_marks": _with(
            """SELECT path, function_name, t IN (7, 8) AS source,
  true AS missing_input_validation_sink, t = 8 AS missing_input_validation_safe,
  t IN (7, 8) AS path_traversal_sink, t = 8 AS path_traversal_safe
FROM functions WHERE t IN (0, 1, 6, 7, 8, 9, 10)""", FILES, FUNCTION_TABLE),
        # security rules
        **{name: _rule(rule) for name, rule in rules.items()},
        "all_security_findings": _with(
            "SELECT repo_id, rule_id, cwe_id, severity, path, line, message, fix_suggestion, "
            "code_snippet, confidence, function_name FROM found", *_SECURITY),
        "finding_snippet": _with(
            "SELECT path, rule_id, line, code_snippet FROM found", *_SECURITY),
        "secret_text_scan": f"""SELECT doc_id, occurrence, var, literal
FROM (SELECT doc_id, unnest(range(len(vars))) AS occurrence, unnest(vars) AS var,
             unnest(literals) AS literal
      FROM (SELECT doc_id, regexp_extract_all(text, {_text(_ASSIGNMENT)}, 1) AS vars,
                   list_transform(regexp_extract_all(text, {_text(_ASSIGNMENT)}, 2),
                     lambda s: s[2:-2]) AS literals
            FROM documents))
WHERE regexp_matches(lower(var), 'token|password|passwd|secret|key|otp|session_id|csrf')""",
        # quality checks
        "complexity_metric": _with(
            "SELECT path, line, function_name, complexity::BIGINT AS complexity FROM functions",
            FILES, FUNCTION_TABLE),
        "nesting_metric": _with(
            "SELECT path, line, function_name, nesting::BIGINT AS nesting FROM functions",
            FILES, FUNCTION_TABLE),
        "complex_functions": _check("\"check\" = 'complexity'"),
        "deep_nesting": _check("\"check\" = 'nesting_depth'"),
        "unused_vars": _check("\"check\" = 'unused_vars'"),
        "dead_code": _check("\"check\" = 'dead_code'"),
        "dead_after_terminal": _check("\"check\" = 'dead_code' AND message LIKE '%line 2%'"),
        "dead_constant_branch": _check("\"check\" = 'dead_code' AND message LIKE '%always%'"),
        "all_quality_findings": _check("true"),
        # scores and report tables
        "effective_severity": _with(
            "SELECT event_id, severity, confidence, effective_severity FROM rated",
            EVENTS, effective),
        "severity_normalise": _with(
            f"SELECT event_id, {NORMALISED.format('raw_severity')} AS severity FROM found",
            EVENTS),
        "event_severity_breakdown": _with(
            f"SELECT repo_id, {BREAKDOWN} FROM rated GROUP BY repo_id", EVENTS, effective),
        "event_risk_score": _with(
            f"SELECT repo_id, {SCORE} AS risk_score FROM scored", EVENTS,
            f"scored AS (SELECT repo_id, {TENTHS} AS tenths FROM found GROUP BY repo_id)"),
        "risk_density": _with(
            """SELECT repo_id, files_scanned, density_score, CASE density_score
  WHEN 0 THEN 'Low Risk' WHEN 100 THEN 'Critical Risk' END AS density_label
FROM (SELECT c.repo_id, c.files_scanned,
        least(100, round_even(coalesce(w.weight, 0)::DOUBLE / c.files_scanned * 20, 0))::BIGINT
          AS density_score
      FROM counts c LEFT JOIN weights w ON c.repo_id = w.repo_id)""",
            FILES, EVENTS,
            "counts AS (SELECT repo_id, count(*) AS files_scanned FROM files GROUP BY repo_id)",
            f"weights AS (SELECT repo_id, sum({_lookup('severity', SEVERITY_WEIGHTS)}) AS weight "
            "FROM found GROUP BY repo_id)"),
        "severity_breakdown": _with(
            f"SELECT repo_id, {BREAKDOWN} FROM rated GROUP BY repo_id", *_SECURITY, effective),
        "risk_score": _with(
            f"SELECT repo_id, {SCORE} AS risk_score FROM scored", *_SECURITY,
            f"scored AS (SELECT repo_id, {TENTHS} AS tenths FROM found GROUP BY repo_id)"),
        "risk_label": _with(
            f"SELECT r.repo_id, {SCORE} AS risk_score, {LABEL} AS risk_label "
            "FROM (SELECT DISTINCT repo_id FROM files) r "
            "LEFT JOIN scored s ON r.repo_id = s.repo_id", *_SECURITY_BY_CUSTOMER,
            f"scored AS (SELECT repo_id, {TENTHS} AS tenths FROM found GROUP BY repo_id)"),
        "findings_by_tier": _with(
            "SELECT repo_id, effective_severity, row_number() OVER (PARTITION BY repo_id, "
            "effective_severity ORDER BY path, line, rule_at) AS position, path, line, rule_id "
            "FROM placed", *_SECURITY, effective,
            f"placed AS (SELECT *, list_position([{', '.join(map(_text, SECURITY_RULES))}], "
            "rule_id) AS rule_at FROM rated)"),
        "category_counts": _with(
            "SELECT repo_id, rule_id, count(*) AS n, row_number() OVER (PARTITION BY repo_id "
            "ORDER BY count(*) DESC, rule_id) AS position FROM found GROUP BY repo_id, rule_id",
            *_SECURITY),
        "category_share": _with(
            "SELECT repo_id, rule_id, round(count(*)::DOUBLE / max(count(*)) OVER "
            "(PARTITION BY repo_id) * 100, 1) AS share FROM found GROUP BY repo_id, rule_id",
            *_SECURITY),
        "quality_by_check": _with(
            'SELECT repo_id, "check", row_number() OVER (PARTITION BY repo_id, "check" '
            'ORDER BY path, line) AS position, path, line FROM notes', FILES, QUALITY_TABLE),
        "check_counts": _with(
            'SELECT repo_id, "check", count(*) AS n FROM notes GROUP BY repo_id, "check"',
            FILES, QUALITY_TABLE),
        "top_findings": _with(
            f"""SELECT repo_id, position, "check", path, line, message
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id
        ORDER BY path, {CHECK_SEQUENCE}, line) AS position FROM notes)
WHERE position <= 15""", FILES, QUALITY_TABLE),
        "message_preview": _with(
            "SELECT path, rule_id, line, CASE WHEN length(message) > 90 "
            "THEN left(message, 90) || '...' ELSE message END AS preview FROM found", *_SECURITY),
        "escape_text": _with(
            f"SELECT path, rule_id, line, {_escaped('message')} AS message, "
            f"{_escaped('code_snippet')} AS code_snippet FROM found", *_SECURITY),
        "scan_dashboard": _with(
            f"""SELECT p.repo_id, files_found, files_parsed, files_failed,
  coalesce(security_findings, 0) AS security_findings,
  coalesce(quality_findings, 0) AS quality_findings,
  coalesce(critical, 0) AS critical, coalesce(high, 0) AS high,
  coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
  {SCORE} AS risk_score, {LABEL} AS risk_label
FROM parsed p LEFT JOIN risk r ON p.repo_id = r.repo_id
  LEFT JOIN noted q ON p.repo_id = q.repo_id""",
            *_SECURITY, effective, QUALITY_TABLE,
            "parsed AS (SELECT repo_id, count(*) AS files_found, count(*) FILTER (WHERE t <> 15) "
            "AS files_parsed, count(*) FILTER (WHERE t = 15) AS files_failed FROM files "
            "GROUP BY repo_id)",
            f"risk AS (SELECT repo_id, count(*) AS security_findings, {TENTHS} AS tenths, "
            f"{BREAKDOWN} FROM rated GROUP BY repo_id)",
            "noted AS (SELECT repo_id, count(*) AS quality_findings FROM notes "
            "GROUP BY repo_id)"),
        # evaluation
        "rule_coverage_gap": _with(
            f"SELECT e.repo_id, e.rule_id FROM (SELECT DISTINCT repo_id, rule_id FROM files, "
            f"(VALUES {expected_rules}) v(rule_id)) e WHERE NOT EXISTS (SELECT 1 FROM found f "
            "WHERE f.repo_id = e.repo_id AND f.rule_id = e.rule_id)", *_SECURITY_BY_CUSTOMER),
        "verdict_rates": _with(
            f"""SELECT repo_id, count(*) AS findings, {_rate('false_positive')},
  {_rate('nuanced')}, {_rate('true_positive')}
FROM found JOIN verdicts USING (repo_id, path, line, rule_id) GROUP BY ROLLUP (repo_id)""",
            *_SECURITY, VERDICT_TABLE),
        "verdict_conflicts": _with(
            f"""SELECT repo_id, count(*) AS findings, {_rate('false_positive')},
  {_rate('nuanced')}, {_rate('true_positive')}
FROM (SELECT f.repo_id, CASE WHEN v.verdict = 'false_positive' AND length(f.path) % 2 = 0
             THEN 'nuanced' ELSE v.verdict END AS verdict
      FROM found f JOIN verdicts v USING (repo_id, path, line, rule_id)) GROUP BY ROLLUP (repo_id)""",
            *_SECURITY, VERDICT_TABLE),
        "review_sample": _with(
            """SELECT repo_id, rule_id, path, line, position, stratum_size FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, rule_id
      ORDER BY md5('r1|' || path || '|' || line), path, line) AS position,
    count(*) OVER (PARTITION BY repo_id, rule_id) AS stratum_size FROM found)
WHERE position <= 2""", *_SECURITY),
        "planted_recall": _with(
            f"""SELECT category, count(*) AS planted, count(f.rule_id) AS caught,
  round(count(f.rule_id) * 100.0::DOUBLE / count(*), 1) AS recall_pct
FROM (SELECT p.repo_id, p.path, v.category, v.rule_id FROM files p
      JOIN {_PLANTED} v(t, category, rule_id) ON p.t = v.t) x
LEFT JOIN (SELECT DISTINCT repo_id, path, rule_id FROM found) f
  ON f.repo_id = x.repo_id AND f.path = x.path AND f.rule_id = x.rule_id
GROUP BY category""", *_SECURITY),
    }
