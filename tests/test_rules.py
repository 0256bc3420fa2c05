"""Each rule on small sources: what fires, what stays silent, severity on test paths."""

import pytest

FIRES = {
    # name: (rule, line, severity, confidence, source)
    "sql_fstring": ("sql_injection", 2, "critical", "medium",
                    'def f(c, u):\n    c.execute(f"SELECT {u}")'),
    "sql_plus": ("sql_injection", 2, "critical", "medium",
                 'def f(c, u):\n    c.executemany("SELECT " + u)'),
    "sql_percent": ("sql_injection", 2, "critical", "medium",
                    'def f(c, u):\n    c.raw("SELECT %s" % u)'),
    "sql_format": ("sql_injection", 2, "critical", "medium",
                   'def f(c, u):\n    c.x.y().query("SELECT {}".format(u))'),
    "sql_numbers_percent": ("sql_injection", 1, "critical", "medium", "c.execute(7 % 2)"),
    "sql_plain_fstring": ("sql_injection", 1, "critical", "medium", 'c.execute(f"SELECT 1")'),
    "cmd_fstring": ("command_injection", 3, "critical", "high",
                    'import os\ndef f():\n    os.system(f"ls {d}")'),
    "cmd_popen": ("command_injection", 1, "critical", "high", 'os.popen("ls " + d)'),
    "cmd_run_dynamic": ("command_injection", 1, "critical", "high",
                        'subprocess.run(f"ls {d}", shell=True)'),
    "cmd_call_flag": ("command_injection", 1, "high", "medium",
                      'subprocess.call("ls", shell=True)'),
    "cmd_flag_only": ("command_injection", 1, "high", "medium",
                      "subprocess.Popen(args=a, shell=True)"),
    "cmd_first_constant_decides": ("command_injection", 1, "high", "medium",
                                   "subprocess.run('ls', **{'shell': 1}, shell=True)"),
    "secret_password": ("hardcoded_secrets", 1, "high", "medium",
                        'ADMIN_PASSWORD = "correct horse battery"'),
    "secret_example": ("hardcoded_secrets", 1, "high", "medium",
                       'MAIL_KEY = "not-a-real-key-for-mail"'),
    "secret_of_four": ("hardcoded_secrets", 1, "high", "medium", 'PASSWORD = "abcd"'),
    "secret_chain": ("hardcoded_secrets", 1, "high", "medium",
                     'USER = PASSWORD = "%!*\'();:@&=+$,/?#[] "'),
    "pickle_loads": ("insecure_deserialization", 1, "critical", "high", "x = pickle.loads(raw)"),
    "dill_load": ("insecure_deserialization", 1, "critical", "high", "dill.load(f)"),
    "yaml_load": ("insecure_deserialization", 1, "critical", "high", "yaml.load(f)"),
    "yaml_positional": ("insecure_deserialization", 1, "critical", "high",
                        "yaml.load(f, yaml.SafeLoader)"),
    "yaml_unsafe": ("insecure_deserialization", 1, "critical", "high", "yaml.unsafe_load(f)"),
    "md5": ("weak_crypto", 1, "high", "medium", "hashlib.md5(b)"),
    "sha1_not_for_security": ("weak_crypto", 1, "high", "medium",
                              "hashlib.sha1(b, usedforsecurity=False)"),
    "des_once": ("weak_crypto", 1, "high", "medium", "DES.new(k, DES.MODE_ECB)"),
    "arc4": ("weak_crypto", 1, "high", "medium", "ARC4.new(k)"),
    "ecb": ("weak_crypto", 1, "high", "medium", "AES.new(k, AES.MODE_ECB)"),
    "ecb_keyword_any_call": ("weak_crypto", 1, "high", "medium", "anything(mode=x.MODE_ECB)"),
    "random_token": ("weak_crypto", 1, "high", "medium", "session_token = random.random()"),
    "random_monkey": ("weak_crypto", 1, "high", "medium", "monkey = random.choice(x)"),
    "eval_input": ("eval_exec_misuse", 1, "critical", "high", "eval(expr)"),
    "exec_fstring": ("eval_exec_misuse", 1, "critical", "high", 'exec(f"{a}")'),
    "compile_var": ("eval_exec_misuse", 1, "critical", "high", 'compile(src, "x", "exec")'),
    "eval_bytes": ("eval_exec_misuse", 1, "critical", "high", 'eval(b"1")'),
    "eval_literal": ("eval_exec_misuse", 1, "low", "low", 'eval("1 + 1")'),
}
SILENT = {
    "sql_parameters": 'c.execute("SELECT %s", (u,))',
    "sql_variable": "c.execute(q)",
    "sql_plain_call": 'execute(f"SELECT {u}")',
    "sql_arithmetic": "c.execute(a + b)",
    "sql_no_args": "c.execute()",
    "format_elsewhere": 'x = "a {}".format(b)',
    "cmd_static": 'os.system("ls")',
    "cmd_list": 'subprocess.run(["ls", "-l"])',
    "cmd_shell_one": 'subprocess.run("ls", shell=1)',
    "cmd_shell_false_first": 'subprocess.run("ls", shell=False)',
    "cmd_alias": "import os as o\no.system(f'{x}')",
    "secret_empty": 'PASSWORD = ""',
    "secret_from_env": 'PASSWORD = os.environ["PW"]',
    "secret_other_name": 'TITLE = "a long enough text"',
    "yaml_safe_load": "yaml.safe_load(f)",
    "yaml_loader": "yaml.load(f, Loader=yaml.SafeLoader)",
    "yaml_loader_name": "yaml.load(f, Loader=CSafeLoader)",
    "json": "json.loads(x)",
    "sha256": "hashlib.sha256(b)",
    "secrets_module": "token = secrets.token_hex()",
    "dice": "dice_roll = random.randint(1, 6)",
    "random_nested": "token = str(random.random())",
    "gcm": "AES.new(k, AES.MODE_GCM)",
    "bare_ecb": "AES.new(k, MODE_ECB)",
    "literal_eval": "ast.literal_eval(x)",
    "eval_method": "model.eval(x)",
    "eval_keyword": "eval(source=x)",
    "broken": "def f(:\n    eval(x)",
}
FUNCTIONS = {
    # name: (expected rule -> line, source)
    "open_request": ({"path_traversal": 3, "missing_input_validation": 3},
                     'def f(request):\n    n = request.args.get("f")\n    return open(n)'),
    "execute_request": ({"missing_input_validation": 3},
                        'def f(r):\n    n = r.form.get("f")\n    db.execute(n)'),
    "input_eval": ({"missing_input_validation": 2, "eval_exec_misuse": 2},
                   "def f():\n    eval(input())"),
    "join_then_open": ({"path_traversal": 3, "missing_input_validation": 4},
                       'def f(r):\n    n = r.GET.get("f")\n    p = os.path.join("/x", n)\n'
                       "    return open(p)"),
    "pathlib": ({"path_traversal": 3}, 'def f(r):\n    n = r.POST.get("f")\n    return Path(n)'),
    "breadth_first": ({"path_traversal": 4, "missing_input_validation": 4},
                      'def f(r):\n    if x:\n        open(r.args.get("a"))\n    open(y)'),
    "nested_counts_twice": ({"path_traversal": 4, "missing_input_validation": 4},
                            'def outer(r):\n    def inner():\n        n = r.args.get("f")\n'
                            "        return open(n)\n    return inner"),
    "decorator_counts": ({"path_traversal": 1, "missing_input_validation": 1},
                         "@d(open(input()))\ndef f():\n    pass"),
    "validated_len": ({"path_traversal": 4},
                      'def f(r):\n    n = r.args.get("f")\n    len(n)\n    return open(n)'),
    "validated_isalnum": ({"path_traversal": 3},
                          'def f(r):\n    n = r.args.get("f")\n'
                          "    return open(n) if n.isalnum() else None"),
    "membership": ({"path_traversal": 4},
                   'def f(r):\n    n = r.args.get("f")\n    if n in OK:\n        return open(n)'),
    "dotdot": ({}, 'def f(r):\n    n = r.args.get("f")\n    if ".." in n:\n        raise E\n'
                   "    return open(n)"),
    "dotdot_equal": ({"path_traversal": 4, "missing_input_validation": 4},
                     'def f(r):\n    n = r.args.get("f")\n    x = n == ".."\n    return open(n)'),
    "realpath": ({"missing_input_validation": 3},
                 'def f(r):\n    n = os.path.realpath(r.args.get("f"))\n    return open(n)'),
    "subscript_is_no_source": ({}, 'def f(request):\n    return open(request.args["x"])'),
    "no_sink": ({}, 'def f(r):\n    return r.args.get("f")'),
    "no_source": ({}, "def f(n):\n    return open(n)"),
    "module_level": ({}, "open(input())"),
}


@pytest.fixture(scope="module")
def scanned(scan_cases):
    cases = {name: case[4] for name, case in FIRES.items()}
    cases |= {f"test_{name}": ("tests/test_some.py", case[4]) for name, case in FIRES.items()}
    cases |= SILENT
    cases |= {name: source for name, (_, source) in FUNCTIONS.items()}
    cases |= {f"test_{name}": ("pkg/test_x.py", source) for name, (_, source) in FUNCTIONS.items()}
    return scan_cases(cases)[0]


@pytest.mark.parametrize("name", FIRES)
def test_fires(scanned, name):
    rule, line, severity, confidence, _ = FIRES[name]
    found = [(f.rule_id, f.line, f.severity, f.confidence) for f in scanned[name]]
    assert found == [(rule, line, severity, confidence)]


@pytest.mark.parametrize("name", FIRES)
def test_low_on_test_paths(scanned, name):
    found = [(f.rule_id, f.severity, f.confidence) for f in scanned[f"test_{name}"]]
    assert found == [(FIRES[name][0], "low", "low")]


@pytest.mark.parametrize("name", SILENT)
def test_silent(scanned, name):
    assert scanned[name] == []


@pytest.mark.parametrize("name", FUNCTIONS)
def test_function_rules(scanned, name):
    expected, source = FUNCTIONS[name]
    times = 2 if name == "nested_counts_twice" else 1
    found = [(f.rule_id, f.line) for f in scanned[name]]
    assert sorted(found) == sorted(times * list(expected.items()))
    for finding in scanned[name]:
        if finding.rule_id in ("path_traversal", "missing_input_validation"):
            assert finding.confidence == "low"
            assert finding.function_name in ("f", "outer", "inner")
    assert {f.severity for f in scanned[f"test_{name}"]} <= {"low"}


def test_texts(scanned):
    (finding,) = scanned["cmd_popen"]
    assert finding.message == (
        "'os.popen(...)' executes a command through the system shell using a "
        "dynamically-built command string."
    )
    assert finding.cwe_id == "CWE-78"
    assert finding.code_snippet == 'os.popen("ls " + d)'
    (finding,) = scanned["random_token"]
    assert finding.message.startswith("'session_token' is generated with 'random.random()'")
    (finding,) = scanned["arc4"]
    assert finding.message.startswith("'ARC4.new()' uses the ARC4 cipher")
    assert {f.cwe_id for f in scanned["open_request"]} == {"CWE-22", "CWE-20"}
