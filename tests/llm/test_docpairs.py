import pytest

from coderill.llm import docpairs as d


@pytest.mark.parametrize(
    "text,name,params",
    [
        ("TODO: write docs", "f", []), ("@param a\n@returns", "f", ["a"]), (":param x:\n:return:", "f", None), ("Index harbor.", "indexHarbor", []),
        ("This is the load grain function, it does load grain.", "load_grain", []), ("x = g(y)\nreturn x", "f", []), ("# ------\n# ----", "f", []),
        ("/**\n * {@inheritDoc}\n */", "f", []), ("Copyright 2020 Foo. All rights reserved.", "f", []), ('"""undocumented"""', "f", []), ("Created by the wizard on 2025-01-01.", "f", []),
        ("eslint-disable-next-line", "f", []), ("Function load_it, takes a and b.", "load_it", ["a", "b"]), ("Parameters\n----------\na : int", "f", ["a"]), ("", "f", None), ("   ", "f", []),
    ],
)
def test_trivial(text, name, params):
    assert d.is_trivial(text, name, params)


@pytest.mark.parametrize("text", ["Minutes until the tide turns.", "/** Renvoie la première valeur libre. */", "# 空の行を取り除く", "Weights are per crate, not per boat.", ":param a: how long to wait before retrying"])
def test_informative(text):
    assert not d.is_trivial(text, "f", ["a"])


def test_capture_protects_strings():
    js = "// says hello\nfunction f(a = '}') {\n  const r = a.replace(/[({]+\\s*/g, \"}\");\n  return `${r}}`; /* } */\n}\nrest"
    got = d.capture("a.js", "", js)
    assert got["comment"].strip() == "// says hello" and got["body"].endswith("/* } */\n}") and got["sig"].startswith("function f")
    py = '@deco("x):")\ndef f(a: dict = {1: ")"}) -> list[str]:\n    # note\n    r"""Does it."""\n    return a'
    got = d.capture("a.py", "", py)
    assert got["literal"] == 'r"""Does it."""' and got["body"].strip() == "return a"


def test_comment_above():
    lines = ["x", "", "# a", "# b", "def f():"]
    assert d.comment_above(lines, 5) == "# a\n# b"
    assert d.comment_above(["/* a", "", "b */", "f() {"], 4) == "/* a\n\nb */"
    assert d.comment_above(["# a", "", "def f():"], 3) == "" and d.comment_above([], 4) == "" and d.comment_above(["a"], 1) == ""


def test_pairs(spark):
    symbols = spark.createDataFrame(
        [
            (1, 7, "a.py", "f", "function", [], None, 3, "def f():\n    return 1", 1, 0),
            (1, 7, "a.py", "f", "function", [], None, 3, "def f():\n    return 1", 1, 0),
            (2, 7, "a.py", "g", "method", None, "Opens the gate at dawn.", None, None, 1, 0),
            (3, None, None, None, "function", None, None, None, None, 1, 0),
            (4, 8, "b.py", "h", "function", [], " ", 1, 'def h():\n    """Closes the gate at dusk."""', 1, 0),
            (5, 7, "a.py", "C", "class", [], "Opens the gate at dawn.", 1, "class C: pass", 1, 0),
            (6, 7, "a.py", "k", "function", [], "TODO", 3, "def f():\n    return 1", 1, 0),
        ],
        "symbol_id long, file_id long, file_path string, symbol_name string, symbol_kind string, param_names array<string>, docstring string, start_line int, snippet string, ingested_at long, file_lines int",
    )
    files = spark.createDataFrame([(7, "a.py", ["import x", "# Counts the boats in the harbour.\r", "def f():\r", "    return 1"], 1)], "file_id long, file_path string, file_lines array<string>, ingested_at long")
    got = {r.symbol_id: r.description for r in d.pair_functions(symbols, files).collect()}
    assert got == {1: "Counts the boats in the harbour.", 2: "Opens the gate at dawn.", 4: "Closes the gate at dusk."}
    assert d.pair_functions(symbols.limit(0), files.limit(0)).count() == 0


def test_long_and_broken_code():
    got = d.capture("a.js", "", "function f() {" + 'if (a) { b("}"); }' * 2000 + "}")
    assert got["body"].endswith("}") and got["sig"].startswith("function f")
    assert d.capture("a.js", "", "function f() {" + '{ "(' * 2000)["body"] == ""


def test_symbols_without_a_body():
    got = d.capture("a.ts", "// Opens the gate at dawn.", "abstract open(x: string): void;")
    assert got["comment"] == "// Opens the gate at dawn." and got["sig"].startswith("abstract open") and got["body"] == ""
    got = d.capture("a.ts", "/** Opens the gate at dawn. */", "const f = (x) => x + 1;")
    assert "dawn" in got["comment"] and got["body"] == ""
    assert d.capture("A.java", "// Opens the gate.", "void f() { if (x) {")["comment"] == "// Opens the gate."


def test_lone_words():
    assert not d.is_trivial("Idempotent.", "f", []) and not d.is_trivial("Réentrante", "f", None)
    assert d.is_trivial("Harbor", "f_harbor", []) and d.is_trivial("TODO", "f", []) and d.is_trivial("Helper", "f", [])


def test_last_delivery_and_shared_start_lines(spark):
    schema = "symbol_id long, file_id long, file_path string, symbol_name string, symbol_kind string, param_names array<string>, docstring string, start_line int, snippet string, ingested_at long"
    rows = [(1, 7, "a.js", "f", "function", [], "Old words about nothing.", 2, "function f() {}", 1), (1, 7, "a.js", "f", "function", [], "Opens the gate at dawn.", 2, "function f() {}", 2)]
    rows += [(k, 7, "a.js", "g", "method", [], None, 2, "g() {}", 1) for k in range(2, 40)] + [(50, 7, "a.js", "g", "method", [], None, 99, "g() {}", 1)]
    files = spark.createDataFrame([(7, "a.js", ["// Counts the boats in the harbour.", "function f() {}"], 1), (8, None, None, 1)], "file_id long, file_path string, file_lines array<string>, ingested_at long")
    got = {r.symbol_id: r.description for r in d.pair_functions(spark.createDataFrame(rows, schema), files).collect()}
    assert got == {1: "Opens the gate at dawn.", **{k: "Counts the boats in the harbour." for k in range(2, 40)}}


def test_unbalanced_code_in_linear_time():
    import time

    for text in ("function f() {" + "{" * 100_000, "function f() {" + '{ "' * 60_000, "f" + "{}" * 60_000 + "(", "(" * 100_000, "/" * 200_000):
        began = time.perf_counter()
        d.capture("a.js", "", text)
        assert time.perf_counter() - began < 4, text[:20]
