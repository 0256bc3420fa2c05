"""Word lists, limits, weights and report texts.

Everything in this file is a constant the results depend on.  No logic lives here.
"""

# --- Fixed values: which files are scanned -------------------------------------------------
EXCLUDED_DIRECTORIES = (
    ".git", ".hg", ".svn", "node_modules", "venv", ".venv", "env", ".env", "__pycache__",
    "build", "dist", ".tox", ".mypy_cache", ".pytest_cache", ".idea", ".vscode",
    "site-packages", "egg-info",
)
EXCLUDED_DIRECTORY_SUFFIX = ".egg-info"
SOURCE_EXTENSIONS = (".py",)
MAX_FILE_BYTES = 2_000_000
REPOSITORY_URL_PATTERN = (
    r"^(https://github\.com/[\w.\-]+/[\w.\-]+(\.git)?/?|git@github\.com:[\w.\-]+/[\w.\-]+\.git)$"
)

# --- Fixed values: names the predicates look for --------------------------------------------
REQUEST_INPUT_ATTRIBUTES = (
    "args", "form", "values", "GET", "POST", "json", "query_params", "COOKIES", "headers",
)
SENSITIVE_NAME_MARKERS = (
    "token", "password", "passwd", "secret", "key", "otp", "session_id", "csrf",
)
SQL_METHODS = ("execute", "executemany", "executescript", "raw", "query")
OS_SHELL_FUNCTIONS = ("system", "popen")
SUBPROCESS_FUNCTIONS = ("call", "run", "Popen", "check_call", "check_output")
PICKLE_MODULES = ("pickle", "cPickle", "dill")
PICKLE_FUNCTIONS = ("load", "loads")
YAML_SAFE_LOADERS = ("SafeLoader", "CSafeLoader")
WEAK_HASH_FUNCTIONS = ("md5", "sha1")
WEAK_CIPHER_MODULES = ("DES", "DES3", "ARC4", "RC4")
RANDOM_FUNCTIONS = (
    "random", "randint", "randrange", "choice", "uniform", "getrandbits", "shuffle", "sample",
)
CODE_EXECUTION_FUNCTIONS = ("eval", "exec", "compile")
SENSITIVE_SINK_FUNCTIONS = ("open", "eval", "exec")
SENSITIVE_SINK_METHODS = ("execute", "executemany", "system", "popen")
VALIDATION_FUNCTIONS = ("isinstance", "len")
VALIDATION_METHODS = (
    "match", "fullmatch", "search", "isdigit", "isalpha", "isalnum", "isnumeric",
)
PATH_SINK_FUNCTIONS = ("open", "Path")
PATH_SAFETY_METHODS = (
    "abspath", "realpath", "normpath", "commonpath", "resolve", "startswith",
)

# --- Fixed values: syntax classes -----------------------------------------------------------
FUNCTION_KINDS = ("FunctionDef", "AsyncFunctionDef")
TERMINAL_KINDS = ("Return", "Raise", "Break", "Continue")
BRANCH_KINDS = ("If", "For", "AsyncFor", "While", "ExceptHandler", "IfExp", "Assert")
NESTING_KINDS = ("If", "For", "AsyncFor", "While", "Try", "With", "AsyncWith")
COMPLEXITY_THRESHOLD = 10
NESTING_THRESHOLD = 4

# --- Fixed values: severity model -----------------------------------------------------------
SEVERITIES = ("critical", "high", "medium", "low")
SEVERITY_WEIGHTS = {"critical": 10, "high": 5, "medium": 2, "low": 1}
CONFIDENCE_TENTHS = {"high": 10, "medium": 7, "low": 4}
ONE_TIER_DOWN = {"critical": "high", "high": "medium", "medium": "low", "low": "low"}
RISK_CAP = 100
RISK_LABELS = ((60, "Critical Risk"), (30, "High Risk"), (10, "Medium Risk"))
RISK_LABEL_ABOVE_ZERO = "Low Risk"
RISK_LABEL_ZERO = "No Findings"
DENSITY_FACTOR = 20
PREVIEW_CHARS = 90
TOP_FINDINGS = 15

# --- Fixed values: security rules, in report order ------------------------------------------
SECURITY_RULES = (
    "sql_injection", "command_injection", "hardcoded_secrets", "insecure_deserialization",
    "weak_crypto", "missing_input_validation", "path_traversal", "eval_exec_misuse",
    "command_injection_taint",
)

# --- Fixed values: one entry per kind of security finding ------------------------------------
# (variant, rule, CWE, severity, confidence, message, suggested fix).  {func}, {recv}, {var}
# and {function} stand for the called function, its receiver, a variable, the function's name.
_SHELL_FIX = (
    "Avoid the shell entirely: pass the command as a list of arguments to subprocess.run() "
    "(e.g. subprocess.run([\"ls\", \"-la\", path])) without shell=True, so the OS executes "
    "the program directly and shell metacharacters in any argument can't be interpreted."
)
SECURITY_CATALOG = (
    ("sql_dynamic", "sql_injection", "CWE-89", "critical", "medium",
     "SQL query passed to '.{func}()' is built dynamically (f-string/concatenation/%/"
     "`.format()`) instead of using parameterized placeholders.",
     "Use a parameterized query instead, e.g. cursor.execute(\"SELECT * FROM t WHERE id = %s\", "
     "(user_id,)) so the database driver escapes the value safely, rather than building the "
     "query string yourself."),
    ("shell_dynamic", "command_injection", "CWE-78", "critical", "high",
     "'{recv}.{func}(...)' executes a command through the system shell using a "
     "dynamically-built command string.",
     _SHELL_FIX),
    ("shell_flag", "command_injection", "CWE-78", "high", "medium",
     "'{recv}.{func}(...)' executes a command through the system shell (shell=True).",
     _SHELL_FIX),
    ("secret_literal", "hardcoded_secrets", "CWE-798", "high", "medium",
     "'{var}' looks like a credential and is assigned a string literal.",
     "Read the value from the environment or from a secret store instead of the source code."),
    ("pickle_load", "insecure_deserialization", "CWE-502", "critical", "high",
     "'{recv}.{func}()' deserializes data using pickle, which can execute arbitrary code if the "
     "data is not fully trusted.",
     "Avoid pickle for any data that could come from outside your own process (files, network, "
     "user upload). Use a safe format instead, e.g. json.loads() for plain data, or a "
     "schema-validated format."),
    ("yaml_unsafe_load", "insecure_deserialization", "CWE-502", "critical", "high",
     "'yaml.unsafe_load()' can construct arbitrary Python objects from YAML content.",
     "Use yaml.safe_load() instead, which only builds plain Python data types."),
    ("yaml_load", "insecure_deserialization", "CWE-502", "critical", "high",
     "'yaml.load()' is called without an explicit safe Loader.",
     "Use yaml.safe_load(data) instead of yaml.load(data), or pass Loader=yaml.SafeLoader "
     "explicitly if you need yaml.load()."),
    ("weak_hash", "weak_crypto", "CWE-327", "high", "medium",
     "'hashlib.{func}()' is a cryptographically broken hash algorithm.",
     "Use hashlib.sha256() or hashlib.blake2b() instead. For passwords specifically, use a "
     "dedicated password-hashing function (e.g. bcrypt, scrypt, or argon2) rather than a "
     "general-purpose hash."),
    ("weak_cipher", "weak_crypto", "CWE-327", "high", "medium",
     "'{recv}.new()' uses the {recv} cipher, which is considered broken/weak by modern standards.",
     "Use AES (e.g. AES-256 in GCM mode) instead -- it's the current standard, fast, and has no "
     "known practical break."),
    ("ecb_mode", "weak_crypto", "CWE-327", "high", "medium",
     "Cipher is constructed with ECB mode, which leaks patterns in the plaintext (identical "
     "blocks encrypt to identical ciphertext).",
     "Use GCM or CBC mode with a random IV instead of ECB -- GCM is recommended since it also "
     "provides integrity/authentication."),
    ("random_secret", "weak_crypto", "CWE-327", "high", "medium",
     "'{var}' is generated with 'random.{func}()', which is NOT cryptographically secure, but is "
     "assigned to a security-sensitive-looking variable.",
     "Use the `secrets` module instead (e.g. secrets.token_urlsafe(), secrets.token_hex()) or "
     "os.urandom() for anything security-sensitive -- the `random` module is predictable and "
     "unsuitable for tokens, passwords, or session IDs."),
    ("unvalidated_input", "missing_input_validation", "CWE-20", "medium", "low",
     "Function '{function}' reads raw request/user input and reaches a sensitive operation, with "
     "no validation (type/length/regex/whitelist check) found anywhere in the function.",
     "Validate the input before using it -- check its type, length, and format/content (e.g. a "
     "regex or whitelist check) before passing it to a file, database, or shell operation."),
    ("unchecked_path", "path_traversal", "CWE-22", "high", "low",
     "Function '{function}' reads raw request/user input and passes a path to "
     "open()/os.path.join()/Path(), with no '..' check or path canonicalization found anywhere "
     "in the function.",
     "Canonicalize the path (os.path.realpath() or Path.resolve()) and verify it's still inside "
     "the intended base directory (e.g. with os.path.commonpath([base, resolved]) == base) "
     "before opening it -- don't rely on just rejecting '..' substrings, which can be bypassed."),
    ("eval_literal", "eval_exec_misuse", "CWE-95", "low", "low",
     "'{func}()' is called -- even on a fixed literal, this is generally discouraged.",
     "If this string is truly fixed, consider whether eval/exec is needed at all (most fixed "
     "logic can be written directly in Python). If you need to parse a literal value, use "
     "ast.literal_eval() instead, which never executes code."),
    ("eval_dynamic", "eval_exec_misuse", "CWE-95", "critical", "high",
     "'{func}()' is called on a dynamically-built string, not a fixed literal -- if any part of "
     "it can be influenced by user input, this is arbitrary code execution.",
     "Avoid eval()/exec() on dynamic content entirely. For parsing simple literal data (numbers, "
     "lists, dicts), use ast.literal_eval() instead, which never executes arbitrary code. For "
     "anything more complex, replace the eval'd logic with explicit code paths (e.g. a "
     "dictionary dispatch instead of eval'ing a function name)."),
    ("tainted_shell", "command_injection_taint", "CWE-78", "critical", "high",
     "A tainted value (originating from a parameter of function '{function}') reaches a shell "
     "command sink via variable '{var}' -- confirmed data-flow path, not just a structural "
     "pattern match.",
     "Avoid the shell entirely: pass the command as a list of arguments to subprocess.run() "
     "without shell=True, so the OS executes the program directly and this parameter's value "
     "can't be interpreted as shell syntax."),
)

# --- Fixed values: quality checks, in report order, and their messages -----------------------
QUALITY_CHECKS = ("complexity", "unused_vars", "nesting_depth", "dead_code")
QUALITY_MESSAGES = {
    "complexity": "Function '{function}' has cyclomatic complexity {metric} (threshold: "
                  "{threshold}). Consider splitting it into smaller functions.",
    "unused_vars": "Variable '{var}' is assigned but never used in function '{function}'.",
    "nesting_depth": "Function '{function}' has nesting depth {metric} (threshold: {threshold}). "
                     "Consider extracting inner blocks into helper functions.",
    "dead_after": "Unreachable code: this statement can never execute because line {after} "
                  "unconditionally returns/raises/breaks/continues.",
    "dead_if": "Unreachable code: this 'if' condition is always False.",
    "dead_else": "Unreachable code: this 'else' can never run because the 'if' condition is "
                 "always True.",
}

# --- Fixed values: parse failure texts --------------------------------------------------------
READ_FAILURE = "Could not read file: {error}"
SYNTAX_FAILURE = "SyntaxError at line {line}: {error}"
PARSE_FAILURE = "Could not parse: {error}"
