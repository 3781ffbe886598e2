"""Operators on code structure: symbols, imports, calls, configuration keys, references between files."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coderill.functions import detect

CODE = ("py", "js", "ts", "java", "go")


def symbols_of(km_symbols: DataFrame) -> DataFrame:
    """The last delivery of every symbol."""
    columns = ["file_id", "repo_id", "file_path", "symbol_name", "symbol_kind", "start_line", "end_line", "param_names", "docstring", "is_exported"]
    one = km_symbols.groupBy("symbol_id").agg(F.max_by(F.struct(*columns), F.col("ingested_at")).alias("s"))
    return one.select("symbol_id", "s.*")


def _is(*ext: str) -> Column:
    return detect.extension("file_path").isin(*ext)


def regex_symbols(lines: DataFrame) -> DataFrame:
    """Symbols found line by line: kind and name; Python classes, functions and collections, script functions, classes,
    interfaces and arrow constants, Go functions and types, Java classes."""
    t = F.col("line_text")
    rules = [
        (_is("py"), r"^class +([A-Za-z_]\w*)", "class"), (_is("py"), r"^(?:async +)?def +([A-Za-z_]\w*)", "function"), (_is("py"), r"^ +(?:async +)?def +([A-Za-z_]\w*)", "method"), (_is("py"), r"^([A-Z][A-Z0-9_]*) *= *[\[{(]", "collection"),
        (_is("js", "ts"), r"^(?:export +)?(?:abstract +)?class +([A-Za-z_]\w*)", "class"), (_is("js", "ts"), r"^(?:export +)?(?:async +)?function +([A-Za-z_]\w*)", "function"),
        (_is("js", "ts"), r"^(?:export +)?const +([A-Za-z_]\w*) *= *(?:async +)?\(", "function"), (_is("ts"), r"^(?:export +)?interface +([A-Za-z_]\w*)", "interface"),
        (_is("go"), r"^func +(?:\([^)]*\) +)?([A-Za-z_]\w*)", "function"), (_is("go"), r"^type +([A-Za-z_]\w*) +struct", "class"), (_is("java"), r"^(?:public +)?(?:final +)?class +([A-Za-z_]\w*)", "class"),
    ]
    # one look at each rule of the line's language, after one look at the line for any of their words
    found = F.coalesce(*[F.when(where & t.rlike(pattern), F.struct(F.lit(what).alias("kind"), F.regexp_extract(t, pattern, 1).alias("name"))) for where, pattern, what in rules])
    likely = lines.filter(_is(*CODE) & t.rlike(r"class|def |function|const|interface|func|type|^[A-Z][A-Z0-9_]* *="))
    return likely.withColumn("_s", found).filter("_s is not null").select("file_id", "repo_id", "file_path", "line_no", F.col("_s.kind").alias("symbol_kind"), F.col("_s.name").alias("symbol_name"))


def imports_naming(imports: DataFrame, names: DataFrame) -> DataFrame:
    """Imports that name what is asked for, as their module (whole, or its last segment after a dot or slash), as the imported name or as
    its alias: repo_id, name, file_id, line_no, matched_by; once an import and name, the module first.  ``names`` has repo_id and
    name (lower case).  Suffixes are exploded, so that all of it is one equi-join."""
    module, last = F.lower("source_module"), F.regexp_extract(F.lower("source_module"), r"([^./]+)$", 1)
    keys = F.array(F.struct(module.alias("name"), F.lit("1 module").alias("how")), F.struct(last.alias("name"), F.lit("2 suffix").alias("how")), F.struct(F.lower("imported_name").alias("name"), F.lit("3 symbol").alias("how")), F.struct(F.lower("alias").alias("name"), F.lit("4 alias").alias("how")))
    rows = imports.select("repo_id", "file_id", "line_no", F.explode(F.filter(keys, lambda k: k["name"] != "")).alias("k")).select("repo_id", "file_id", "line_no", "k.*")
    found = rows.join(names.select("repo_id", "name").distinct(), ["repo_id", "name"], "left_semi").groupBy("repo_id", "name", "file_id", "line_no").agg(F.min("how").alias("how"))
    return found.select("repo_id", "name", "file_id", "line_no", F.substring("how", 3, 6).alias("matched_by"))


def imports_of(lines: DataFrame) -> DataFrame:
    """One row per imported name: source_module, imported_name, import_type."""
    t = F.col("line_text")
    py_from = r"^from +([\w.]+) +import +(.+)$"
    esm = r"^import +\{ *([^}]+?) *\} +from +['\"]([^'\"]+)['\"]"
    plain = r"^import +([\w.]+);?$"
    f = lines.filter((_is("py") & (t.rlike(py_from) | t.rlike(plain))) | (_is("js", "ts") & t.rlike(esm)) | (_is("java") & t.rlike(plain)))
    kind = F.when(t.rlike(esm), "esm").when(t.rlike(py_from), "from").otherwise("module")
    module = F.when(kind == "esm", F.regexp_extract(t, esm, 2)).when(kind == "from", F.regexp_extract(t, py_from, 1)).otherwise(F.regexp_extract(t, plain, 1))
    names = F.when(kind == "esm", F.regexp_extract(t, esm, 1)).when(kind == "from", F.regexp_extract(t, py_from, 2)).otherwise(F.regexp_extract(t, plain, 1))
    return f.select("file_id", "repo_id", "file_path", "line_no", module.alias("source_module"), F.explode(F.split(names, " *, *")).alias("imported_name"), kind.alias("import_type"))


# Patterns of imports: files, pattern, group of the module, group of the names, kind.
IMPORT_RULES = [
    (("py", "pyi"), r"^\s*from\s+([\w.]+)\s+import\s+\(?([^)#]+)", 1, 2, "from"),
    (("py", "pyi"), r"^\s*import\s+([\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*)\s*$", 0, 1, "module"),
    (("js", "jsx", "mjs", "cjs", "ts", "tsx"), r"^\s*import\s+(?:type\s+)?(?:\w+\s*,\s*)?\{([^}]+)\}\s*from\s*['\"]([^'\"]+)['\"]", 2, 1, "named"),
    (("js", "jsx", "mjs", "cjs", "ts", "tsx"), r"^\s*import\s+(\w+)\s*(?:,\s*\{[^}]*\}\s*)?from\s*['\"]([^'\"]+)['\"]", 2, 1, "default"),
    (("js", "jsx", "mjs", "cjs", "ts", "tsx"), r"^\s*import\s+\*\s+as\s+(\w+)\s+from\s*['\"]([^'\"]+)['\"]", 2, 1, "namespace"),
    (("js", "jsx", "mjs", "cjs", "ts", "tsx"), r"(?:const|let|var)\s+\{([^}]+)\}\s*=\s*require\(\s*['\"]([^'\"]+)['\"]", 2, 1, "commonjs"),
    (("js", "jsx", "mjs", "cjs", "ts", "tsx"), r"(?:const|let|var)\s+(\w+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]", 2, 1, "commonjs"),
    (("java",), r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;", 0, 1, "module"),
]


def all_imports(lines: DataFrame) -> DataFrame:
    """One row per imported name: source_module, imported_name, alias, import_type, of Python's and Java's imports, ES modules (named,
    default, namespace) and CommonJS.  A module that is imported as such is its own name; without an alias that is null."""
    t, ext = F.col("line_text"), detect.extension("file_path")
    found = []
    for files, pattern, module, names, kind in IMPORT_RULES:
        part = F.struct(F.regexp_extract(t, pattern, module or names).alias("module"), F.regexp_extract(t, pattern, names).alias("names"), F.lit(kind).alias("kind"), F.lit(not module).alias("whole"))
        found.append(F.when(ext.isin(*files) & t.rlike(pattern), part))
    rows = lines.filter(F.lower(t).rlike("import|require")).select("file_id", "repo_id", "file_path", "line_no", F.explode(F.array_compact(F.array(*found))).alias("r"))
    each = rows.select("file_id", "repo_id", "file_path", "line_no", "r.module", "r.kind", "r.whole", F.explode(F.split("r.names", ",")).alias("part"))
    part = F.regexp_replace(F.regexp_replace("part", r"^\s+|\s+$", ""), r"^type\s+", "")
    name, alias = F.regexp_extract(part, r"^([\w.*$]+)", 1), F.nullif(F.regexp_extract(part, r"(?:\s+as\s+|\s*:\s*)(\w+)$", 1), F.lit(""))
    return each.select("file_id", "repo_id", "file_path", "line_no", F.when(F.col("whole"), name).otherwise(F.col("module")).alias("source_module"), name.alias("imported_name"), alias.alias("alias"), F.col("kind").alias("import_type")).filter("imported_name <> ''")


def exports_of(lines: DataFrame) -> DataFrame:
    """Names that scripts export, by declaration or in a list: file_id, repo_id, line_no, exported_name."""
    declared = r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)"
    listed = r"^\s*export\s*\{([^}]*)\}"
    t = F.col("line_text")
    names = F.concat(F.filter(F.array(F.regexp_extract(t, declared, 1)), lambda x: x != ""), F.transform(F.filter(F.split(F.regexp_extract(t, listed, 1), ","), lambda x: F.trim(x) != ""), lambda x: F.regexp_extract(x, r"(\w+)\s*$", 1)))
    return lines.filter(_is("js", "jsx", "mjs", "ts", "tsx") & t.rlike(r"^\s*export\b")).select("file_id", "repo_id", "line_no", F.explode(names).alias("exported_name"))


def bases_of(lines: DataFrame) -> DataFrame:
    """Classes and the classes or interfaces they extend or implement: file_id, repo_id, line_no, class_name, base_name (the last
    segment of a dotted name)."""
    t = F.col("line_text")
    py, other = r"^\s*class\s+(\w+)\(([^)]*)\)", r"\bclass\s+(\w+)\b[^{]*?\b(?:extends|implements)\s+([\w., ]+)"
    pick = lambda n: F.when(_is("py"), F.regexp_extract(t, py, n)).otherwise(F.regexp_extract(t, other, n))
    rows = lines.filter((_is("py") & t.rlike(py)) | (_is("js", "ts", "java") & t.rlike(other)))
    each = rows.select("file_id", "repo_id", "line_no", pick(1).alias("class_name"), F.explode(F.split(pick(2), r"[,\s]+")).alias("b"))
    base = F.regexp_extract("b", r"(\w+)$", 1)
    return each.select("file_id", "repo_id", "line_no", "class_name", base.alias("base_name")).filter("base_name <> '' and base_name not in ('extends', 'implements') and not contains(b, '=')").distinct()


def class_members(symbols: DataFrame) -> DataFrame:
    """Methods with the class that was last begun above them and has not ended: repo_id, file_id, class_name, symbol_name, symbol_id.

    One sort per file; no method is paired with every class."""
    order = F.struct("start_line", F.when(F.col("symbol_kind") == "class", 0).otherwise(1), "symbol_id")
    w = Window.partitionBy("file_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("symbol_kind") == "class", F.struct("symbol_name", "end_line")), ignorenulls=True).over(w)
    kept = symbols.filter("symbol_kind in ('class', 'method') and start_line is not null").withColumn("_c", opened)
    return kept.filter("symbol_kind = 'method' and _c.end_line >= start_line").select("repo_id", "file_id", F.col("_c.symbol_name").alias("class_name"), "symbol_name", "symbol_id")


_DEFINING = r"\b(?:def|function|func|class|interface)\s"
# What mentions a name: the kind of reference, its priority, files, pattern, kinds of symbols that it may name.
MENTIONS = [
    ("class_instantiation", 1, ("py", "js", "ts", "java", "go"), r"([A-Za-z_]\w*)\(", ("class",)),
    ("function_call", 3, ("py", "js", "ts", "java", "go"), r"([A-Za-z_]\w*)\(", ("function", "method")),
    ("type_hint", 6, ("py", "ts"), r"(?::|->)\s*(?:[A-Za-z_]\w*\[)?([A-Za-z_]\w*)", ("class", "interface")),
    ("variable_usage", 7, ("py", "js", "ts", "java", "go"), r"([A-Za-z_]\w*)", ("collection",)),
    ("attribute_reference", 8, ("py", "js", "ts", "java", "go"), r"\.([A-Za-z_]\w*)(?:[^\w(]|$)", ("function", "method", "class", "collection")),
    ("doc_mention", 9, ("md", "rst", "txt"), r"([A-Za-z_]\w{3,})", ("function", "method", "class", "interface", "collection")),
]


def references(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every reference to a known symbol of the repository: repo_id, name (lower case), file_id, line_no, ref_type, priority.

    Nine kinds from seven branches: calls (of functions, or of classes as instantiations), inheritance, imports, exports, type hints,
    variables and attributes, mentions in documents.  A kind counts once a line and name.  Lines that define something call nothing."""
    columns = ["repo_id", "name", "file_id", "line_no", "ref_type", "priority"]
    t = F.col("line_text")
    found = []
    for kind, priority, files, pattern, _ in MENTIONS:
        where = _is(*files) & ~t.rlike(_DEFINING) if kind in ("class_instantiation", "function_call", "variable_usage") else _is(*files)
        mention = lambda n: F.struct(n.alias("exact"), F.lit(kind).alias("ref_type"), F.lit(priority).alias("priority"))  # noqa: B023, E731
        found.append(F.when(where, F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), 1)), mention)))
    mentioned = lines.select("repo_id", "file_id", "line_no", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("m")).select("repo_id", "file_id", "line_no", "m.*")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("ref_type"), F.array(*[F.lit(x) for x in of]).alias("of")) for k, _, _, _, of in MENTIONS])).alias("k")
    known = symbols.select("repo_id", F.col("symbol_name").alias("exact"), "symbol_kind", kinds).filter("array_contains(k.of, symbol_kind)").select("repo_id", "exact", "k.ref_type").distinct()
    named = mentioned.join(known, ["repo_id", "exact", "ref_type"], "left_semi").select("repo_id", F.lower("exact").alias("name"), "file_id", "line_no", "ref_type", "priority")
    names = symbols.select("repo_id", F.lower("symbol_name").alias("name")).distinct()
    told = [
        (bases_of(lines).withColumnRenamed("base_name", "n"), "class_inheritance", 2), (all_imports(lines).withColumnRenamed("imported_name", "n"), "import", 4), (exports_of(lines).withColumnRenamed("exported_name", "n"), "export", 5),
    ]
    for rows, kind, priority in told:
        rows = rows.select("repo_id", F.lower(F.regexp_extract("n", r"(\w+)$", 1)).alias("name"), "file_id", "line_no", F.lit(kind).alias("ref_type"), F.lit(priority).alias("priority"))
        named = named.unionByName(rows.join(names, ["repo_id", "name"], "left_semi"))
    return named.select(*columns).distinct()


def enclosing_functions(lines: DataFrame) -> DataFrame:
    """Code lines with the name of the function last opened above or on them."""
    t = F.col("line_text")
    named = F.coalesce(F.nullif(F.regexp_extract(t, r"(?:def|function|func) +(?:\([^)]*\) +)?([A-Za-z_]\w*)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"const +([A-Za-z_]\w*) *= *(?:async +)?\(", 1), F.lit("")))
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    code = lines.filter(_is("py", "js", "ts", "go")).withColumn("_opened", named)
    return code.withColumn("caller", F.last("_opened", ignorenulls=True).over(w))


def calls_of(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call sites of known functions and methods: caller, callee, line; calls outside of a function have no caller."""
    sites = enclosing_functions(lines).select("file_id", "repo_id", "line_no", "caller", "_opened", F.explode(F.array_distinct(F.regexp_extract_all("line_text", F.lit(r"([A-Za-z_]\w*)\("), 1))).alias("callee"))
    known = symbols.filter(F.col("symbol_kind").isin("function", "method")).select("repo_id", F.col("symbol_name").alias("callee")).distinct()
    return sites.filter(F.col("_opened").isNull() | (F.col("_opened") != F.col("callee"))).join(known, ["repo_id", "callee"], "left_semi").select("file_id", "repo_id", "line_no", "caller", "callee")


def config_entries(lines: DataFrame) -> DataFrame:
    """Keys and values of YAML, env, TOML and Dockerfile ENV lines, env files by their last extension only, as its SQL has it;
    :func:`all_config_entries` reads every format."""
    t = F.col("line_text")
    yaml, env, docker = r"^\s*([A-Za-z_][\w.-]*): *(.*)$", r"^(?:export +)?([A-Za-z_]\w*)=(.*)$", r"^ENV +(\w+)[ =](.*)$"
    toml = r"^([A-Za-z_][\w.-]*) *= *(.*)$"
    is_docker = F.lower("file_path").endswith("dockerfile")
    pattern = F.when(_is("yaml", "yml"), F.lit(yaml)).when(_is("env"), F.lit(env)).when(_is("toml"), F.lit(toml)).when(is_docker, F.lit(docker))
    rows = lines.withColumn("_p", pattern).filter("_p is not null")
    pick = lambda n: F.when(F.col("_p") == yaml, F.regexp_extract(t, yaml, n)).when(F.col("_p") == env, F.regexp_extract(t, env, n)).when(F.col("_p") == toml, F.regexp_extract(t, toml, n)).otherwise(F.regexp_extract(t, docker, n))
    return rows.select("file_id", "line_no", pick(1).alias("config_key"), F.regexp_replace(F.trim(pick(2)), "^[\"']|[\"']$", "").alias("config_value")).filter("config_key <> ''")


def all_config_entries(lines: DataFrame) -> DataFrame:
    """Keys and values of YAML, TOML, JSON and Dockerfile (ENV, EXPOSE) lines and of files with '.env' in their path, such as
    .env.prod; comments and blank lines give none.  The key of an exposed port is 'port', the value of an empty YAML key '(section)'."""
    t, path = F.trim(F.regexp_replace("line_text", r"^\s+|\s+$", "")), F.lower("file_path")
    docker = path.endswith("dockerfile")
    rules = [
        (_is("yaml", "yml"), r"^([A-Za-z0-9_.-]+)\s*:\s*(.*)$"), (path.contains(".env"), r"^(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*)$"), (_is("toml"), r"^([A-Za-z0-9_.-]+)\s*=\s*(.*)$"),
        (docker, r"(?i)^ENV\s+(\w+)(?:\s*=\s*|\s+)(.*)$"), (_is("json"), r'^[{\s]*"([A-Za-z0-9_.-]+)"\s*:\s*(.*)$'), (docker, r"(?i)^(EXPOSE)\s+([0-9]+)"),
    ]
    key, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for where, pattern in reversed(rules):
        hit = where & t.rlike(pattern)
        key, value = F.when(hit, F.regexp_extract(t, pattern, 1)).otherwise(key), F.when(hit, F.regexp_extract(t, pattern, 2)).otherwise(value)
    value = F.when(_is("json"), F.regexp_replace(value, r"[,}]$", "")).otherwise(value)
    key = F.when(docker & (F.lower(key) == "expose"), "port").otherwise(key)
    value = F.regexp_replace(F.trim(value), "^[\"']|[\"']$", "")
    value = F.when(_is("yaml", "yml") & (value == ""), "(section)").otherwise(value)
    rows = lines.filter(~F.coalesce(t, F.lit("")).rlike("^(?:#|//|$)")).select("file_id", "line_no", key.alias("config_key"), value.alias("config_value"))
    return rows.filter("config_key is not null")


def env_references(lines: DataFrame) -> DataFrame:
    """Environment variables that code reads."""
    pattern = r"(?:process\.env\.|os\.environ\[\"|os\.environ\.get\(\"|os\.getenv\(\"|os\.Getenv\(\"|System\.getenv\(\")([A-Z_][A-Z0-9_]*)"
    return lines.filter(_is(*CODE)).select("file_id", "line_no", F.explode(F.regexp_extract_all("line_text", F.lit(pattern), 1)).alias("env_name"))


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Relative script imports resolved to files of the repository: exact, then with an extension, then as a directory's index;
    external for package names, unresolved otherwise."""
    esm = imports.filter("import_type = 'esm'").select("file_id", "repo_id", "file_path", "line_no", "source_module").distinct()
    base = F.split(F.regexp_replace("file_path", "/[^/]*$", ""), "/")
    steps = F.concat(base, F.split("source_module", "/"))
    empty = F.expr("cast(array() as array<string>)")
    walked = F.aggregate(steps, empty, lambda a, s: F.when(s.isin(".", ""), a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    target = F.array_join(walked, "/")
    ends = ["", ".js", ".ts", ".jsx", ".tsx", ".mjs", "/index.js", "/index.ts"]
    tried = esm.withColumn("_t", target).withColumn("_relative", F.col("source_module").startswith("."))
    cand = tried.select("*", F.posexplode(F.array(*[F.concat("_t", F.lit(e)) for e in ends])).alias("_prio", "candidate"))
    known = files.select("repo_id", F.col("file_path").alias("candidate"), F.lit(True).alias("_found")).distinct()
    hit = cand.join(known, ["repo_id", "candidate"], "left")
    best = hit.groupBy("file_id", "line_no", "source_module", "_relative").agg(F.min_by(F.when(F.col("_found"), F.col("candidate")), F.when(F.col("_found"), F.col("_prio")).otherwise(F.lit(99))).alias("resolved_path"))
    status = F.when(~F.col("_relative"), "external").when(F.col("resolved_path").isNull(), "unresolved").otherwise("resolved")
    return best.select("file_id", "line_no", "source_module", F.when(F.col("_relative"), F.col("resolved_path")).alias("resolved_path"), status.alias("status"))


def callers(calls: DataFrame, names: DataFrame) -> DataFrame:
    """Callers of each asked name, by lower-cased name; one row per file, line and caller."""
    asked = names.select(F.lower("symbol_name").alias("_n")).distinct()
    return calls.withColumn("_n", F.lower("callee")).join(asked, "_n", "left_semi").select("callee", "caller", "file_id", "line_no").distinct()


def first_non_empty(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the rows of ``first``, and of ``second`` only for keys that ``first`` lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


_AST = "file_id long, parse_status string, functions int, methods int, classes int, imports int, calls int"


def python_structure(files: DataFrame) -> DataFrame:
    """Counts of functions, methods, classes, imports and calls per Python file from its syntax tree; a file that does not parse has status
    'error' and zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        warnings.simplefilter("ignore")
        for b in batches:
            rows = []
            for file_id, source in zip(b["file_id"], b["source"]):
                try:
                    tree = ast.parse(source)
                except (SyntaxError, ValueError, RecursionError):
                    rows.append((file_id, "error", 0, 0, 0, 0, 0))
                    continue
                nodes = list(ast.walk(tree))
                functions = [n for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
                methods = {id(m) for n in nodes if isinstance(n, ast.ClassDef) for m in n.body}
                own = sum(id(f) in methods for f in functions)
                count = lambda *kinds: sum(isinstance(n, kinds) for n in nodes)  # noqa: B023, E731
                rows.append((file_id, "ok", len(functions) - own, own, count(ast.ClassDef), count(ast.Import, ast.ImportFrom), count(ast.Call)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _AST.split(", ")])

    return files.filter(_is("py")).select("file_id", F.array_join("file_lines", "\n", "").alias("source")).mapInPandas(run, _AST)
