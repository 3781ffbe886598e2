"""The queries of the core and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coderill.functions import detect, text
from coderill.operators import evaluate, graph, lines, retrieval, structure
from coderill.plans import route
from coderill.sources.ingest import parse_repository_url
from coderill.sources.tables import table
from coderill.streaming import update

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FILES = """files AS (SELECT file_id, repo_id, file_path, list_transform(file_lines, lambda x: regexp_replace(x, '\\r$', '')) AS file_lines
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC, line_count DESC) AS rn FROM km_files) WHERE rn = 1),
exts AS (SELECT *, lower(regexp_extract(list_extract(string_split(file_path, '/'), -1), '\\.([^.]+)$', 1)) AS ext FROM files)"""
PATHS = """paths AS (SELECT file_id, repo_id, file_path FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC, line_count DESC) AS rn FROM km_files) WHERE rn = 1)"""
LINES = FILES + """, lines AS (SELECT file_id, repo_id, file_path, ext, unnest(file_lines) AS line_text, generate_subscripts(file_lines, 1)::INT AS line_no FROM exts)"""
SYMBOLS = """symbols AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY ingested_at DESC) AS rn FROM km_symbols) WHERE rn = 1)"""


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _files(s, d):
    return lines.files_of(table(s, d, "km_files"))


def _paths(s, d):
    return lines.paths_of(table(s, d, "km_files"))


def _lines(s, d):
    return lines.lines_of(_files(s, d))


def _line_counts(s, d):
    return lines.latest_files(table(s, d, "km_files"), n_lines=F.size("file_lines"))


def _symbols(s, d):
    return structure.symbols_of(table(s, d, "km_symbols"))


# --------------------------------------------------------------------------------------------- sources


@query(f"WITH {LINES} SELECT file_id, count(*) AS n_lines, sum(length(line_text))::BIGINT AS n_chars FROM lines GROUP BY 1")
def src_lines(s, d):
    chars = F.aggregate(lines.clean_lines(), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.length(x), F.lit(0)))
    counted = lines.latest_files(table(s, d, "km_files"), n_lines=F.size("file_lines").cast("long"), n_chars=chars)
    return counted.filter("n_lines > 0")


@query(f"WITH {FILES} SELECT file_id, array_to_string(file_lines[10:20], chr(10)) AS slice_text FROM files")
def src_line_slice(s, d):
    part = F.slice("file_lines", 10, 11)
    return lines.latest_files(table(s, d, "km_files"), slice_text=F.array_join(F.transform(part, lambda x: F.regexp_replace(x, "\r$", "")), "\n"))


@query("""SELECT file_id, CASE WHEN file_path = '' OR regexp_matches(file_path, '^([A-Za-z]:)?[/\\\\]') OR list_contains(string_split(file_path, '/'), '..') THEN NULL
  ELSE array_to_string(list_filter(string_split(file_path, '/'), lambda x: x <> '' AND x <> '.'), '/') END AS safe_path FROM km_files""")
def src_safe_path(s, d):
    return table(s, d, "km_files").select("file_id", detect.safe_path("file_path").alias("safe_path"))


_NAME_SQL = "list_extract(string_split(file_path, '/'), -1)"
_EXT_SQL = f"lower(regexp_extract({_NAME_SQL}, '^.+\\.([^.]*)$', 1))"
_IGNORED_SQL = f"""(list_has_any(string_split(lower(file_path), '/')[1:-2], ['.git', '.github', 'node_modules', '__pycache__', '.venv', 'venv', 'env', '.env', 'dist', 'build', 'coverage', '.pytest_cache', '.mypy_cache', '.tox', '.idea', '.vscode', '.cache', 'eggs', '.eggs'])
  OR {_NAME_SQL} IN ('.DS_Store', 'Thumbs.db') OR starts_with({_NAME_SQL}, '._') OR {_EXT_SQL} IN ('pyc', 'pyo', 'pyd', 'so', 'dll', 'dylib', 'exe', 'bin', 'png', 'jpg', 'jpeg', 'gif', 'ico', 'webp', 'bmp', 'tiff', 'mp4', 'webm', 'mov', 'mp3', 'wav', 'ogg',
  'zip', 'tar', 'gz', 'bz2', 'xz', '7z', 'rar', 'whl', 'woff', 'woff2', 'ttf', 'otf', 'eot', 'db', 'sqlite', 'sqlite3', 'pdf', 'parquet', 'pickle', 'pkl'))"""
_READABLE_SQL = f"""({_EXT_SQL} IN ('py', 'pyi', 'pyw', 'ts', 'tsx', 'js', 'mjs', 'cjs', 'jsx', 'java', 'c', 'h', 'cpp', 'cc', 'cxx', 'hpp', 'hh', 'cs', 'go', 'rs', 'html', 'htm', 'css', 'scss', 'sass', 'sql', 'sh', 'bash', 'zsh', 'json', 'yaml', 'yml', 'xml', 'svg', 'toml', 'ini', 'cfg', 'txt',
  'md', 'markdown', 'csv', 'tsv', 'ipynb', 'dockerfile') OR lower({_NAME_SQL}) = 'dockerfile')"""


@query(f"SELECT file_id, {_IGNORED_SQL} AS ignored FROM file_metadata")
def src_ignore_filter(s, d):
    return table(s, d, "file_metadata").select("file_id", detect.is_ignored("file_path").alias("ignored"))


@query(f"SELECT file_id, {_EXT_SQL} AS ext, {_READABLE_SQL} AS readable FROM file_metadata")
def src_extension_readable(s, d):
    return table(s, d, "file_metadata").select("file_id", detect.file_extension("file_path").alias("ext"), detect.is_readable("file_path").alias("readable"))


@query("""WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC, line_count DESC) rn FROM file_metadata) WHERE rn = 1),
  r AS (SELECT file_id, repo_id, sum(coalesce(byte_size, 0)) OVER (PARTITION BY repo_id ORDER BY file_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total_bytes FROM m)
  SELECT file_id, repo_id, total_bytes, total_bytes > 100000 AS over_limit FROM r""")
def src_running_bytes(s, d):
    return lines.running_bytes(table(s, d, "file_metadata"), 100_000)


@query(f"""WITH {PATHS}, p AS (SELECT repo_id, string_split(file_path, '/') AS s FROM paths), e AS (SELECT repo_id, s, unnest(generate_series(1, len(s)))::INT AS depth FROM p)
  SELECT DISTINCT repo_id, array_to_string(s[1:depth], '/') AS path, array_to_string(s[1:depth-1], '/') AS parent, s[depth] AS name, CASE WHEN depth = len(s) THEN 'file' ELSE 'directory' END AS node_type, depth FROM e""")
def src_tree(s, d):
    return lines.tree_of(_paths(s, d))


@query("""SELECT repo_id, nullif(regexp_extract(u, '^(?:https?://)?(?:www\\.)?[\\w.-]+/([\\w.-]+)/([\\w.-]+?)(?:\\.git)?(?:/.*)?$', 1), '') AS owner,
  nullif(regexp_extract(u, '^(?:https?://)?(?:www\\.)?[\\w.-]+/([\\w.-]+)/([\\w.-]+?)(?:\\.git)?(?:/.*)?$', 2), '') AS name
  FROM (SELECT repo_id, concat('https://forge.example/', file_type, '/', filename, '.git') AS u FROM km_files)""")
def src_url_parse(s, d):
    u = table(s, d, "km_files").select("repo_id", F.concat(F.lit("https://forge.example/"), "file_type", F.lit("/"), "filename", F.lit(".git")).alias("u"))
    return u.select("repo_id", parse_repository_url("u").alias("p")).select("repo_id", "p.owner", "p.name")


# --------------------------------------------------------------------------------- projections and filters


@query(f"WITH {LINES} SELECT file_id, line_no, instr(lower(line_text), 'returns')::INT AS column_no FROM lines WHERE contains(lower(line_text), 'returns')")
def prj_grep(s, d):
    return lines.grep_files(table(s, d, "km_files"), "Returns")


@query(f"""WITH {LINES}, h AS (SELECT repo_id, file_id, line_no, row_number() OVER (PARTITION BY repo_id ORDER BY file_id, line_no) AS r FROM lines
  WHERE regexp_matches(line_text, 'raise [A-Z]\\w+|throw new \\w+|except |catch \\(')) SELECT repo_id, file_id, line_no FROM h WHERE r <= 3""")
def prj_error_sites(s, d):
    hits = _lines(s, d).filter(F.col("line_text").rlike(r"raise [A-Z]\w+|throw new \w+|except |catch \("))
    return lines.first_hits(hits.select("repo_id", "file_id", "line_no"), "repo_id", 3, ["file_id", "line_no"])


_REGISTRY_SQL = """(VALUES ('py', 'Python', 'source'), ('pyi', 'Python', 'source'), ('pyw', 'Python', 'source'), ('ts', 'TypeScript', 'source'), ('tsx', 'TSX', 'source'), ('js', 'JavaScript', 'source'), ('mjs', 'JavaScript', 'source'), ('cjs', 'JavaScript', 'source'),
  ('jsx', 'JavaScript', 'source'), ('java', 'Java', 'source'), ('c', 'C', 'source'), ('h', 'C', 'source'), ('cpp', 'C++', 'source'), ('cc', 'C++', 'source'), ('cxx', 'C++', 'source'), ('hpp', 'C++', 'source'), ('hh', 'C++', 'source'), ('cs', 'C#', 'source'), ('go', 'Go', 'source'),
  ('rs', 'Rust', 'source'), ('html', 'HTML', 'source'), ('htm', 'HTML', 'source'), ('css', 'CSS', 'source'), ('scss', 'SCSS', 'source'), ('sass', 'SCSS', 'source'), ('sql', 'SQL', 'source'), ('sh', 'Shell', 'source'), ('bash', 'Shell', 'source'), ('zsh', 'Shell', 'source'),
  ('csv', 'CSV', 'data'), ('tsv', 'CSV', 'data'), ('ipynb', 'Jupyter Notebook', 'data'), ('md', 'Markdown', 'documentation'), ('markdown', 'Markdown', 'documentation'), ('yaml', 'YAML', 'configuration'), ('yml', 'YAML', 'configuration'), ('json', 'JSON', 'configuration'),
  ('xml', 'XML', 'configuration'), ('svg', 'XML', 'configuration')) AS g(ext, language, category)"""
_BINARY_SQL = "('png', 'jpg', 'jpeg', 'gif', 'ico', 'webp', 'pdf', 'zip', 'tar', 'gz', 'exe', 'dll', 'so', 'dylib', 'bin', 'pyc', 'pyo', 'pyd', 'db', 'sqlite', 'woff', 'woff2', 'ttf', 'eot', 'wasm', 'parquet', 'feather')"
_DETECTED = f"""det AS (SELECT f.*, CASE WHEN lower({_NAME_SQL}) = 'dockerfile' THEN 'Dockerfile' ELSE coalesce(g.language, CASE WHEN {_EXT_SQL} IN {_BINARY_SQL} THEN 'Binary' ELSE 'Text' END) END AS detected,
  CASE WHEN lower({_NAME_SQL}) = 'dockerfile' THEN 'configuration' WHEN {_EXT_SQL} = 'json' AND regexp_matches(file_path, '/(data|datasets|records)/|\\.(dataset|records)\\.json$') THEN 'data' ELSE coalesce(g.category, CASE WHEN {_EXT_SQL} IN {_BINARY_SQL} THEN 'binary' ELSE 'unknown' END) END AS category,
  {_EXT_SQL} IN {_BINARY_SQL} AS is_binary FROM {{0}} f LEFT JOIN {_REGISTRY_SQL} ON {_EXT_SQL} = g.ext)"""


@query(f"WITH {PATHS}, {_DETECTED.format('paths')} SELECT file_id, detected, category, is_binary FROM det")
def prj_language(s, d):
    return detect.detect_language("file_path", detect.registry(s), _paths(s, d)).select("file_id", "detected", "category", "is_binary")


_KIND_SQL = """CASE WHEN ext IN ('png','jpg','jpeg','gif','svg','ico','woff','woff2','ttf') THEN 'asset' WHEN regexp_matches(lower(file_path), '(^|/)(tests?|__tests__|spec)/|(^|/)test_|_test\\.|\\.test\\.|\\.spec\\.') THEN 'test'
  WHEN ext IN ('json','yaml','yml','toml','env','ini','cfg') OR lower(file_path) LIKE '%dockerfile' THEN 'config' WHEN ext IN ('md','rst','txt') THEN 'documentation' WHEN ext IN ('csv','tsv','parquet') THEN 'data'
  WHEN regexp_matches(lower(file_path), '(^|/)(main|index|app|server|cli)\\.[a-z]+$') THEN 'entry_point' ELSE 'source' END"""


@query(f"WITH {FILES} SELECT file_id, {_KIND_SQL} AS file_kind FROM exts")
def prj_file_type(s, d):
    return _paths(s, d).select("file_id", detect.knowledge_type("file_path").alias("file_kind"))


@query(f"""WITH {FILES}, k AS (SELECT *, {_KIND_SQL} AS kind FROM exts) SELECT repo_id, sum((kind = 'asset')::INT)::BIGINT AS is_asset, sum((kind = 'documentation')::INT)::BIGINT AS is_doc, sum((kind = 'config')::INT)::BIGINT AS is_config,
  sum(regexp_matches(lower(file_path), '(^|/)tests?/|_test\\.|\\.test\\.')::INT)::BIGINT AS is_test, sum(regexp_matches(lower(file_path), '(^|/)(main|index|app|server|cli)\\.[a-z]+$')::INT)::BIGINT AS is_entry_point,
  sum((ext IN ('py','js','ts','java','go'))::INT)::BIGINT AS is_source FROM k GROUP BY 1""")
def prj_modal_flags(s, d):
    flags = _paths(s, d).select("repo_id", *detect.modal_flags("file_path"))
    return flags.groupBy("repo_id").agg(*[F.count_if(c).alias(c) for c in flags.columns[1:]])


_CLEAN_SQL = """regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({0}, '["''`?]', '', 'g')), '\\(\\)$', ''), '^(?i:the|a|an) ', ''), '(?i: (function|method|class|module|file|symbol))$', '')"""


@query(f"WITH {SYMBOLS} SELECT symbol_id, {_CLEAN_SQL.format("concat('the `', symbol_name, '()` ', symbol_kind)")} AS cleaned FROM symbols")
def prj_clean_symbol(s, d):
    return _symbols(s, d).select("symbol_id", text.clean_symbol(F.concat(F.lit("the `"), "symbol_name", F.lit("()` "), "symbol_kind")).alias("cleaned"))


_SINGULAR_SQL = """CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN substr(w, 1, length(w) - 3) || 'y' WHEN w LIKE '%sses' OR w LIKE '%ches' OR w LIKE '%shes' OR w LIKE '%xes' THEN substr(w, 1, length(w) - 2)
  WHEN length(w) > 2 AND w LIKE '%s' AND w NOT LIKE '%ss' AND w NOT LIKE '%us' AND w NOT LIKE '%is' THEN substr(w, 1, length(w) - 1) ELSE w END"""


@query(f"WITH {SYMBOLS}, n AS (SELECT DISTINCT lower(symbol_name) AS w FROM symbols WHERE symbol_kind = 'collection') SELECT w AS noun, {_SINGULAR_SQL} AS singular_noun FROM n")
def prj_singular(s, d):
    w = _symbols(s, d).filter("symbol_kind = 'collection'").select(F.lower("symbol_name").alias("noun")).distinct()
    return w.select("noun", text.singular("noun").alias("singular_noun"))


@query(f"""WITH {SYMBOLS}, r AS (SELECT *, row_number() OVER (PARTITION BY lower(symbol_name) ORDER BY CASE symbol_kind WHEN 'function' THEN 0 WHEN 'method' THEN 1 ELSE 2 END, symbol_id) AS k FROM symbols)
  SELECT lower(symbol_name) AS name, symbol_id, file_id, start_line FROM r WHERE k = 1""")
def prj_primary_definition(s, d):
    prio = F.when(F.col("symbol_kind") == "function", 0).when(F.col("symbol_kind") == "method", 1).otherwise(2)
    w = Window.partitionBy(F.lower("symbol_name")).orderBy(prio, "symbol_id")
    return _symbols(s, d).withColumn("k", F.row_number().over(w)).filter("k = 1").select(F.lower("symbol_name").alias("name"), "symbol_id", "file_id", "start_line")


@query(f"""WITH {SYMBOLS}, n AS (SELECT symbol_id, lower(symbol_name) AS w, repo_id FROM symbols WHERE symbol_kind = 'collection'), c AS (SELECT symbol_id, repo_id, {_SINGULAR_SQL} AS noun FROM n),
  k AS (SELECT DISTINCT repo_id, lower(symbol_name) AS noun FROM symbols WHERE symbol_kind = 'class') SELECT c.symbol_id, c.noun, k.noun IS NOT NULL AS has_class FROM c LEFT JOIN k USING (repo_id, noun)""")
def prj_collections(s, d):
    sy = _symbols(s, d)
    c = sy.filter("symbol_kind = 'collection'").select("symbol_id", "repo_id", text.singular("symbol_name").alias("noun"))
    k = sy.filter("symbol_kind = 'class'").select("repo_id", F.lower("symbol_name").alias("noun"), F.lit(True).alias("h")).distinct()
    return c.join(k, ["repo_id", "noun"], "left").select("symbol_id", "noun", F.coalesce("h", F.lit(False)).alias("has_class"))


@query(f"""WITH {FILES}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) AS rn FROM chunks) WHERE rn = 1)
  SELECT chunk_id, CASE WHEN f.file_lines IS NULL THEN 'no_file' WHEN start_line IS NULL OR end_line IS NULL THEN 'no_range' WHEN start_line < 1 THEN 'start' WHEN end_line < start_line THEN 'order' WHEN end_line > len(f.file_lines) THEN 'beyond'
  WHEN array_to_string(f.file_lines[start_line:end_line], chr(10)) <> replace(source_text, chr(13), '') THEN 'text' ELSE 'valid' END AS verdict FROM c LEFT JOIN files f USING (file_id)""")
def prj_chunk_valid(s, d):
    return lines.chunk_validity(table(s, d, "chunks"), _files(s, d))


@query(f"""WITH {LINES}, m AS (SELECT repo_id, file_id, bool_or(contains(lower(line_text), 'http')) AS mentions, bool_or(regexp_matches(line_text, '(requests|axios|fetch|http)\\.?\\w*\\(')) AS runs FROM lines GROUP BY 1, 2)
  SELECT repo_id, file_id FROM m WHERE mentions AND NOT runs""")
def prj_mention_not_execute(s, d):
    m = _lines(s, d).groupBy("repo_id", "file_id").agg(F.bool_or(F.lower("line_text").contains("http")).alias("mentions"), F.bool_or(F.col("line_text").rlike(r"(requests|axios|fetch|http)\.?\w*\(")).alias("runs"))
    return m.filter("mentions and not runs").select("repo_id", "file_id")


_ROLE_SQL = """CASE WHEN ext IN ('md', 'rst') THEN 'documentation' WHEN regexp_matches(lower(file_path), '(^|/)tests?/|_test\\.|\\.test\\.') THEN 'test' WHEN regexp_matches(line_text, '^\\s*(#|//|\\*|/\\*)') THEN 'reference_only'
  WHEN regexp_matches(line_text, '^\\s*(export )?(class|interface) ') THEN 'model_definition' ELSE 'caller' END"""


@query(f"WITH {LINES}, h AS (SELECT *, {_ROLE_SQL} AS code_role FROM lines WHERE contains(lower(line_text), 'cargo')) SELECT repo_id, code_role, count(*) AS n_lines, count(DISTINCT file_id) AS n_files FROM h GROUP BY 1, 2")
def prj_roles(s, d):
    t = F.col("line_text")
    role = (
        F.when(detect.extension("file_path").isin("md", "rst"), "documentation").when(F.lower("file_path").rlike(r"(^|/)tests?/|_test\.|\.test\."), "test").when(t.rlike(r"^\s*(#|//|\*|/\*)"), "reference_only")
        .when(t.rlike(r"^\s*(export )?(class|interface) "), "model_definition").otherwise("caller")
    )
    hits = _lines(s, d).filter(F.lower(t).contains("cargo")).withColumn("code_role", role)
    return hits.groupBy("repo_id", "code_role").agg(F.count("*").alias("n_lines"), F.countDistinct("file_id").alias("n_files"))


@query("""SELECT config_id, regexp_replace(regexp_replace(regexp_replace(config_value, '(?i)(bearer|basic|token) [A-Za-z0-9+/=._-]{12,}', '\\1 [REDACTED_SECRET]', 'g'), '([a-z]{2,6}_[a-z]*_?)[A-Za-z0-9]{20,}', '\\1[REDACTED_SECRET]', 'g'), 'AIza[A-Za-z0-9_-]{20,}', '[REDACTED_SECRET]', 'g') AS redacted FROM km_configs""")
def prj_redact(s, d):
    return table(s, d, "km_configs").select("config_id", text.redact("config_value").alias("redacted"))


@query(f"WITH {SYMBOLS} SELECT DISTINCT symbol_kind, lower(symbol_name) AS name FROM symbols")
def prj_distinct_names(s, d):
    return _symbols(s, d).select("symbol_kind", F.lower("symbol_name").alias("name")).distinct()


# ------------------------------------------------------------------------------------------- extraction

_SYMBOL_RULES = [
    ("ext = 'py'", r"^class +([A-Za-z_]\w*)", "class"), ("ext = 'py'", r"^(?:async +)?def +([A-Za-z_]\w*)", "function"), ("ext = 'py'", r"^ +(?:async +)?def +([A-Za-z_]\w*)", "method"), ("ext = 'py'", r"^([A-Z][A-Z0-9_]*) *= *[\[{(]", "collection"),
    ("ext IN ('js', 'ts')", r"^(?:export +)?(?:abstract +)?class +([A-Za-z_]\w*)", "class"), ("ext IN ('js', 'ts')", r"^(?:export +)?(?:async +)?function +([A-Za-z_]\w*)", "function"), ("ext IN ('js', 'ts')", r"^(?:export +)?const +([A-Za-z_]\w*) *= *(?:async +)?\(", "function"),
    ("ext = 'ts'", r"^(?:export +)?interface +([A-Za-z_]\w*)", "interface"), ("ext = 'go'", r"^func +(?:\([^)]*\) +)?([A-Za-z_]\w*)", "function"), ("ext = 'go'", r"^type +([A-Za-z_]\w*) +struct", "class"), ("ext = 'java'", r"^(?:public +)?(?:final +)?class +([A-Za-z_]\w*)", "class"),
]
_KINDS = " ".join(f"WHEN {w} AND regexp_matches(line_text, '{p}') THEN '{k}'" for w, p, k in _SYMBOL_RULES)
_NAMES = " ".join(f"WHEN {w} AND regexp_matches(line_text, '{p}') THEN regexp_extract(line_text, '{p}', 1)" for w, p, k in _SYMBOL_RULES)


@query(f"WITH {LINES}, x AS (SELECT file_id, line_no, CASE {_KINDS} END AS symbol_kind, CASE {_NAMES} END AS symbol_name FROM lines) SELECT * FROM x WHERE symbol_kind IS NOT NULL")
def ext_symbols(s, d):
    return structure.regex_symbols(_lines(s, d)).select("file_id", "line_no", "symbol_kind", "symbol_name")


IMPORTS = LINES + r""", raw AS (SELECT *, CASE WHEN ext IN ('js','ts') AND regexp_matches(line_text, '^import +\{ *([^}]+?) *\} +from +[''"]([^''"]+)[''"]') THEN 'esm' WHEN ext = 'py' AND regexp_matches(line_text, '^from +([\w.]+) +import +(.+)$') THEN 'from'
  WHEN ext IN ('py', 'java') AND regexp_matches(line_text, '^import +([\w.]+);?$') THEN 'module' END AS import_type FROM lines),
imports AS (SELECT file_id, repo_id, file_path, line_no, import_type, CASE import_type WHEN 'esm' THEN regexp_extract(line_text, '^import +\{ *([^}]+?) *\} +from +[''"]([^''"]+)[''"]', 2) WHEN 'from' THEN regexp_extract(line_text, '^from +([\w.]+) +import +(.+)$', 1) ELSE regexp_extract(line_text, '^import +([\w.]+);?$', 1) END AS source_module,
  unnest(regexp_split_to_array(CASE import_type WHEN 'esm' THEN regexp_extract(line_text, '^import +\{ *([^}]+?) *\} +from +[''"]([^''"]+)[''"]', 1) WHEN 'from' THEN regexp_extract(line_text, '^from +([\w.]+) +import +(.+)$', 2) ELSE regexp_extract(line_text, '^import +([\w.]+);?$', 1) END, ' *, *')) AS imported_name FROM raw WHERE import_type IS NOT NULL)"""


@query(f"WITH {IMPORTS} SELECT file_id, line_no, source_module, imported_name, import_type FROM imports")
def ext_imports(s, d):
    return structure.imports_of(_lines(s, d)).select("file_id", "line_no", "source_module", "imported_name", "import_type")


CALLS = LINES + ", " + SYMBOLS + r""", op AS (SELECT *, coalesce(nullif(regexp_extract(line_text, '(?:def|function|func) +(?:\([^)]*\) +)?([A-Za-z_]\w*)', 1), ''), nullif(regexp_extract(line_text, 'const +([A-Za-z_]\w*) *= *(?:async +)?\(', 1), '')) AS opened FROM lines WHERE ext IN ('py','js','ts','go')),
enc AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS caller FROM op),
site AS (SELECT file_id, repo_id, line_no, caller, opened, unnest(list_distinct(regexp_extract_all(line_text, '([A-Za-z_]\w*)\(', 1))) AS callee FROM enc),
calls AS (SELECT file_id, repo_id, line_no, caller, callee FROM site s WHERE (opened IS NULL OR opened <> callee) AND EXISTS (SELECT 1 FROM symbols k WHERE k.symbol_kind IN ('function', 'method') AND k.repo_id = s.repo_id AND k.symbol_name = s.callee))"""


def _calls(s, d):
    return structure.calls_of(_lines(s, d), _symbols(s, d))


@query(f"WITH {CALLS} SELECT file_id, line_no, caller, callee FROM calls")
def ext_calls_enclosing(s, d):
    return _calls(s, d).select("file_id", "line_no", "caller", "callee")


_CFG = [("ext IN ('yaml', 'yml')", r"^\s*([A-Za-z_][\w.-]*): *(.*)$"), ("ext = 'env'", r"^(?:export +)?([A-Za-z_]\w*)=(.*)$"), ("ext = 'toml'", r"^([A-Za-z_][\w.-]*) *= *(.*)$"), ("lower(file_path) LIKE '%dockerfile'", r"^ENV +(\w+)[ =](.*)$")]
_CFG_SQL = {n: "CASE " + " ".join(f"WHEN {w} THEN regexp_extract(line_text, '{p}', {n})" for w, p in _CFG) + " END" for n in (1, 2)}


@query(f"""WITH {LINES}, x AS (SELECT file_id, line_no, {_CFG_SQL[1]} AS config_key, regexp_replace(trim({_CFG_SQL[2]}), '^["'']|["'']$', '', 'g') AS config_value FROM lines) SELECT * FROM x WHERE config_key <> ''""")
def ext_config_keys(s, d):
    return structure.config_entries(_lines(s, d))


_ENTRY_RULES = [
    ("ext IN ('yaml', 'yml')", r"^([A-Za-z0-9_.-]+)\s*:\s*(.*)$"), ("contains(lower(file_path), '.env')", r"^(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*)$"), ("ext = 'toml'", r"^([A-Za-z0-9_.-]+)\s*=\s*(.*)$"),
    ("lower(file_path) LIKE '%dockerfile'", r"(?i)^ENV\s+(\w+)(?:\s*=\s*|\s+)(.*)$"), ("ext = 'json'", r'^[{\s]*"([A-Za-z0-9_.-]+)"\s*:\s*(.*)$'), ("lower(file_path) LIKE '%dockerfile'", r"(?i)^(EXPOSE)\s+([0-9]+)"),
]
_ENTRY = {n: "CASE " + " ".join(f"WHEN {w} AND regexp_matches(t, '{p}') THEN regexp_extract(t, '{p}', {n})" for w, p in _ENTRY_RULES) + " END" for n in (1, 2)}


@query(rf"""WITH {LINES}, tr AS (SELECT *, trim(regexp_replace(line_text, '^\s+|\s+$', '', 'g')) AS t FROM lines WHERE line_text IS NOT NULL), kv AS (SELECT file_id, file_path, ext, line_no, {_ENTRY[1]} AS k, {_ENTRY[2]} AS v FROM tr WHERE NOT regexp_matches(t, '^(?:#|//|$)')),
  cl AS (SELECT file_id, line_no, ext, CASE WHEN lower(file_path) LIKE '%dockerfile' AND lower(k) = 'expose' THEN 'port' ELSE k END AS config_key, regexp_replace(trim(CASE WHEN ext = 'json' THEN regexp_replace(v, '[,}}]$', '') ELSE v END), '^["'']|["'']$', '', 'g') AS v FROM kv WHERE k IS NOT NULL)
  SELECT file_id, line_no, config_key, CASE WHEN ext IN ('yaml', 'yml') AND v = '' THEN '(section)' ELSE v END AS config_value FROM cl""")
def ext_config_entries(s, d):
    """The entries of every format; ``ext_config_keys`` stays at what its SQL states."""
    return structure.all_config_entries(_lines(s, d))


@query(f"""WITH {LINES} SELECT file_id, line_no, unnest(regexp_extract_all(line_text, '(?:process\\.env\\.|os\\.environ\\["|os\\.environ\\.get\\("|os\\.getenv\\("|os\\.Getenv\\("|System\\.getenv\\(")([A-Z_][A-Z0-9_]*)', 1)) AS env_name FROM lines WHERE ext IN ('py','js','ts','java','go')""")
def ext_env_refs(s, d):
    return structure.env_references(_lines(s, d))


SECTIONS = LINES + r""", mk AS (SELECT *, regexp_matches(line_text, '^#{1,6} +[^ ]') AS h FROM lines WHERE ext = 'md'), nu AS (SELECT *, sum(h::INT) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::INT AS section_no FROM mk),
sec AS (SELECT file_id, section_no, min(line_no) AS start_line, max(line_no) AS end_line, max(CASE WHEN h THEN line_text END) AS heading_text FROM nu WHERE section_no > 0 GROUP BY 1, 2)"""


@query(f"""WITH {SECTIONS} SELECT file_id, section_no, start_line, end_line, regexp_replace(heading_text, '^#+ +', '') AS title, length(regexp_extract(heading_text, '^(#+)', 1))::INT AS heading_level,
  array_to_string(list(regexp_replace(heading_text, '^#+ +', '')) OVER (PARTITION BY file_id ORDER BY section_no ROWS UNBOUNDED PRECEDING), ' > ') AS trail FROM sec""")
def ext_doc_sections(s, d):
    return lines.doc_sections(_lines(s, d))


@query(f"""WITH {IMPORTS}, esm AS (SELECT DISTINCT file_id, repo_id, file_path, line_no, source_module FROM imports WHERE import_type = 'esm'),
  st AS (SELECT *, list_concat(string_split(regexp_replace(file_path, '/[^/]*$', ''), '/'), string_split(source_module, '/')) AS steps FROM esm),
  ta AS (SELECT *, array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(steps, lambda x: [x])), lambda a, x: CASE WHEN x[1] IN ('.', '') THEN a WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] ELSE list_concat(a, x) END), '/') AS t FROM st),
  ca AS (SELECT ta.*, e.prio, ta.t || e.suffix AS candidate FROM ta JOIN (VALUES (0, ''), (1, '.js'), (2, '.ts'), (3, '.jsx'), (4, '.tsx'), (5, '.mjs'), (6, '/index.js'), (7, '/index.ts')) AS e(prio, suffix) ON true),
  hi AS (SELECT ca.*, f.file_path IS NOT NULL AS found FROM ca LEFT JOIN (SELECT DISTINCT repo_id, file_path FROM files) f ON f.repo_id = ca.repo_id AND f.file_path = ca.candidate),
  be AS (SELECT file_id, line_no, source_module, arg_min(CASE WHEN found THEN candidate END, CASE WHEN found THEN prio ELSE 99 END) FILTER (WHERE found) AS r FROM hi GROUP BY 1, 2, 3)
  SELECT file_id, line_no, source_module, CASE WHEN starts_with(source_module, '.') THEN r END AS resolved_path, CASE WHEN NOT starts_with(source_module, '.') THEN 'external' WHEN r IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM be""")
def ext_module_resolve(s, d):
    return structure.resolve_modules(structure.imports_of(_lines(s, d)), _paths(s, d))


@query(f"""WITH {LINES}, k AS (SELECT *, length(line_text) - length(regexp_replace(line_text, '^[ \\t]+', '')) AS i, max(line_no) OVER (PARTITION BY file_id) AS last_line FROM lines WHERE ext = 'py' AND regexp_matches(line_text, '\\S')),
  st AS (SELECT * FROM k WHERE regexp_matches(line_text, '^ *(?:async +)?def |^ *class '))
  SELECT st.file_id, st.line_no AS start_line, coalesce((SELECT min(k.line_no) - 1 FROM k WHERE k.file_id = st.file_id AND k.line_no > st.line_no AND k.i <= st.i), st.last_line)::INT AS end_line FROM st""")
def ext_block_end(s, d):
    py = _lines(s, d).filter(detect.extension("file_path") == "py")
    return lines.block_ends(py, F.col("line_text").rlike(r"^ *(?:async +)?def |^ *class "))


@query()
def ext_python_ast(s, d):
    return structure.python_structure(_files(s, d))


# --------------------------------------------------------------------------------------------- chunking


@query(f"""WITH {FILES}, b AS (SELECT file_id, file_lines, unnest(generate_series(0, len(file_lines) - 1, 30)) AS i FROM files WHERE len(file_lines) > 0)
  SELECT file_id, (i + 1)::INT AS start_line, least(i + 35, len(file_lines))::INT AS end_line, array_to_string(file_lines[i + 1:i + 35], chr(10)) AS block_text FROM b""")
def chk_blocks(s, d):
    return lines.blocks_of(_files(s, d))


@query(LINES.join(["WITH ", ""]) + r""", mk AS (SELECT *, regexp_matches(line_text, '^#{1,4} +[^ ]') AS h FROM lines WHERE ext = 'md'), nu AS (SELECT *, sum(h::INT) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::INT AS section_no FROM mk)
  SELECT file_id, section_no, min(line_no) AS start_line, max(line_no) AS end_line, max(CASE WHEN h THEN line_text END) AS heading_text FROM nu GROUP BY 1, 2""")
def chk_sections(s, d):
    return lines.sections_of(_lines(s, d).filter(detect.extension("file_path") == "md"), lines.heading(4))


@query(f"""WITH {LINES}, c AS (SELECT *, regexp_replace(line_text, '"[^"]*"', '', 'g') AS bare FROM lines WHERE ext = 'css'),
  w AS (SELECT *, min(CASE WHEN contains(bare, '}}') THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS closing, max(line_no) OVER (PARTITION BY file_id) AS last_line FROM c)
  SELECT file_id, line_no AS start_line, coalesce(closing, last_line)::INT AS end_line, trim(regexp_extract(line_text, '^([^{{]*)\\{{', 1)) AS selector FROM w WHERE contains(bare, '{{')""")
def chk_css_rules(s, d):
    return lines.css_rules(_lines(s, d))


@query(LINES.join(["WITH ", ""]) + r""", mk AS (SELECT *, regexp_matches(line_text, '^[A-Za-z_][\w.-]*:') AS h FROM lines WHERE ext IN ('yaml', 'yml')), nu AS (SELECT *, sum(h::INT) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::INT AS section_no FROM mk)
  SELECT file_id, section_no, min(line_no) AS start_line, max(line_no) AS end_line, max(CASE WHEN h THEN line_text END) AS heading_text FROM nu WHERE section_no > 0 GROUP BY 1, 2""")
def chk_config_blocks(s, d):
    return lines.config_blocks(_lines(s, d))


@query(f"WITH {FILES} SELECT file_id, file_lines[1] AS header_line, (len(file_lines) - 1)::INT AS row_count, array_to_string(file_lines[1:50], chr(10)) AS sample_text FROM exts WHERE ext = 'csv' AND len(file_lines) > 0")
def chk_csv_sample(s, d):
    return lines.csv_sample(_files(s, d))


_BARE = """regexp_replace(x, '"(?:\\\\.|[^"\\\\])*"|''[^'']*''|//.*$', '', 'g')"""


@query(f"""WITH {FILES}, el AS (SELECT file_id, list_transform(file_lines, lambda x, i: {{'o': (length({_BARE}) - length(replace({_BARE}, '{{', '')))::INT, 'c': (length({_BARE}) - length(replace({_BARE}, '}}', '')))::INT, 'i': i::INT, 'depth': 0, 'begin': 0, 'out': []::STRUCT(s INT, e INT)[]}}) AS l FROM exts WHERE ext IN ('java', 'go')),
  fo AS (SELECT file_id, list_reduce(list_prepend({{'o': 0, 'c': 0, 'i': 0, 'depth': 0, 'begin': 0, 'out': []::STRUCT(s INT, e INT)[]}}, l), lambda a, x: {{'o': 0, 'c': 0, 'i': x.i, 'depth': greatest(a.depth + x.o - x.c, 0), 'begin': CASE WHEN a.depth = 0 AND x.o > 0 THEN x.i ELSE a.begin END,
    'out': CASE WHEN greatest(a.depth + x.o - x.c, 0) = 0 AND (a.depth > 0 OR x.o > 0) THEN list_append(a.out, {{'s': CASE WHEN a.depth = 0 AND x.o > 0 THEN x.i ELSE a.begin END, 'e': x.i}}) ELSE a.out END}}) AS r FROM el), un AS (SELECT file_id, unnest(r.out) AS b FROM fo) SELECT file_id, b.s AS start_line, b.e AS end_line FROM un""")
def chk_brace_blocks(s, d):
    return lines.brace_chunks(_files(s, d))


# ------------------------------------------------------------------------------------------------- joins


@query(f"""WITH {CALLS}, a AS (SELECT DISTINCT lower(symbol_name) AS n FROM symbols WHERE symbol_id % 20 = 0) SELECT DISTINCT callee, caller, file_id, line_no FROM calls WHERE lower(callee) IN (SELECT n FROM a)""")
def join_callers(s, d):
    """A search, not the whole join: callers of the stated query set, the names of every 20th symbol (symbol_id % 20 = 0)."""
    return structure.callers(_calls(s, d), _symbols(s, d).filter("symbol_id % 20 = 0"))


@query(f"""WITH {CALLS}, a AS (SELECT DISTINCT repo_id, symbol_name AS asked FROM symbols WHERE symbol_kind IN ('function', 'method') AND symbol_id % 20 = 0),
  ex AS (SELECT DISTINCT a.repo_id, a.asked, c.callee, 'exact' AS how FROM a JOIN calls c ON c.repo_id = a.repo_id AND c.caller = a.asked),
  lo AS (SELECT DISTINCT a.repo_id, a.asked, c.callee, 'folded' AS how FROM a JOIN calls c ON c.repo_id = a.repo_id AND lower(c.caller) = lower(a.asked))
  SELECT * FROM ex UNION ALL SELECT * FROM lo WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.repo_id = lo.repo_id AND ex.asked = lo.asked)""")
def join_callees_fallback(s, d):
    """A search, not the whole join: callees of the stated query set, every 20th symbol (symbol_id % 20 = 0)."""
    calls = _calls(s, d).select("repo_id", "caller", "callee").distinct()
    asked = _symbols(s, d).filter("symbol_kind in ('function', 'method') and symbol_id % 20 = 0").select("repo_id", F.col("symbol_name").alias("asked")).distinct()
    exact = asked.join(calls.withColumnRenamed("caller", "asked"), ["repo_id", "asked"]).select("repo_id", "asked", "callee", F.lit("exact").alias("how")).distinct()
    folded = asked.withColumn("_n", F.lower("asked")).join(calls.withColumn("_n", F.lower("caller")), ["repo_id", "_n"]).select("repo_id", "asked", "callee", F.lit("folded").alias("how")).distinct()
    return structure.first_non_empty(exact, folded, ["repo_id", "asked"])


@query(f"""WITH {IMPORTS}, t AS (SELECT DISTINCT repo_id, file_id AS target_id, regexp_replace(list_extract(string_split(file_path, '/'), -1), '\\.[^.]+$', '') AS stem FROM files),
  i AS (SELECT DISTINCT repo_id, file_id, regexp_extract(source_module, '([^./]+)$', 1) AS stem FROM imports) SELECT t.target_id, count(DISTINCT i.file_id) AS n_importers FROM t JOIN i USING (repo_id, stem) GROUP BY 1""")
def join_imported_by(s, d):
    stem = F.regexp_replace(detect.basename("file_path"), r"\.[^.]+$", "")
    t = _paths(s, d).select("repo_id", F.col("file_id").alias("target_id"), stem.alias("stem")).distinct()
    i = structure.imports_of(_lines(s, d)).select("repo_id", "file_id", F.regexp_extract("source_module", r"([^./]+)$", 1).alias("stem")).distinct()
    return t.join(i, ["repo_id", "stem"]).groupBy("target_id").agg(F.countDistinct("file_id").alias("n_importers"))


@query(f"""WITH {CALLS}, {IMPORTS.split(LINES + ', ')[1]}, u AS (SELECT repo_id, lower(callee) AS name, file_id, line_no, 'call' AS ref_type, 2 AS prio FROM calls UNION ALL SELECT repo_id, lower(imported_name), file_id, line_no, 'import', 3 FROM imports
  UNION ALL SELECT repo_id, lower(symbol_name), file_id, start_line, 'definition', 1 FROM symbols), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, name, file_id, line_no ORDER BY prio) AS k FROM u) SELECT repo_id, name, file_id, line_no, ref_type FROM r WHERE k = 1""")
def join_references_union(s, d):
    """Definitions, calls and imports only; the README lists the branches that are missing."""
    cols = ["repo_id", "name", "file_id", "line_no", "ref_type", "prio"]
    calls = _calls(s, d).select("repo_id", F.lower("callee").alias("name"), "file_id", "line_no", F.lit("call").alias("ref_type"), F.lit(2).alias("prio"))
    brought = structure.imports_of(_lines(s, d)).select("repo_id", F.lower("imported_name").alias("name"), "file_id", "line_no", F.lit("import").alias("ref_type"), F.lit(3).alias("prio"))
    defined = _symbols(s, d).select("repo_id", F.lower("symbol_name").alias("name"), "file_id", F.col("start_line").alias("line_no"), F.lit("definition").alias("ref_type"), F.lit(1).alias("prio"))
    every = calls.unionByName(brought).unionByName(defined)
    return every.groupBy(*cols[:4]).agg(F.min_by("ref_type", "prio").alias("ref_type"))


_SCRIPTS = "ext IN ('js', 'jsx', 'mjs', 'cjs', 'ts', 'tsx')"
_IMPORT_RULES = [
    ("ext IN ('py', 'pyi')", r"^\s*from\s+([\w.]+)\s+import\s+\(?([^)#]+)", 1, 2, "from"), ("ext IN ('py', 'pyi')", r"^\s*import\s+([\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*)\s*$", 0, 1, "module"),
    (_SCRIPTS, r"^\s*import\s+(?:type\s+)?(?:\w+\s*,\s*)?\{([^}]+)\}\s*from\s*[''\"]([^''\"]+)[''\"]", 2, 1, "named"), (_SCRIPTS, r"^\s*import\s+(\w+)\s*(?:,\s*\{[^}]*\}\s*)?from\s*[''\"]([^''\"]+)[''\"]", 2, 1, "default"),
    (_SCRIPTS, r"^\s*import\s+\*\s+as\s+(\w+)\s+from\s*[''\"]([^''\"]+)[''\"]", 2, 1, "namespace"), (_SCRIPTS, r"(?:const|let|var)\s+\{([^}]+)\}\s*=\s*require\(\s*[''\"]([^''\"]+)[''\"]", 2, 1, "commonjs"),
    (_SCRIPTS, r"(?:const|let|var)\s+(\w+)\s*=\s*require\(\s*[''\"]([^''\"]+)[''\"]", 2, 1, "commonjs"), ("ext = 'java'", r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;", 0, 1, "module"),
]
_IMPORTED = "im AS (" + " UNION ALL ".join(
    f"SELECT file_id, repo_id, file_path, line_no, '{kind}' AS import_type, {str(not module).lower()} AS whole, regexp_extract(line_text, '{p}', {module or names}) AS module, unnest(string_split(regexp_extract(line_text, '{p}', {names}), ',')) AS part FROM lines WHERE {where} AND regexp_matches(line_text, '{p}')"
    for where, p, module, names, kind in _IMPORT_RULES
) + r"""), ip AS (SELECT *, regexp_replace(regexp_replace(part, '^\s+|\s+$', '', 'g'), '^type\s+', '') AS p FROM im),
allimports AS (SELECT file_id, repo_id, file_path, line_no, CASE WHEN whole THEN regexp_extract(p, '^([\w.*$]+)', 1) ELSE module END AS source_module, regexp_extract(p, '^([\w.*$]+)', 1) AS imported_name, nullif(regexp_extract(p, '(?:\s+as\s+|\s*:\s*)(\w+)$', 1), '') AS alias, import_type FROM ip WHERE regexp_extract(p, '^([\w.*$]+)', 1) <> '')"""
_EXPORTED = r"""ex AS (SELECT *, regexp_extract(line_text, '^\s*export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)', 1) AS one, regexp_extract(line_text, '^\s*export\s*\{([^}]*)\}', 1) AS listed FROM lines WHERE ext IN ('js', 'jsx', 'mjs', 'ts', 'tsx') AND regexp_matches(line_text, '^\s*export\b')),
exported AS (SELECT file_id, repo_id, line_no, one AS exported_name FROM ex WHERE one <> '' UNION ALL SELECT file_id, repo_id, line_no, regexp_extract(x, '(\w+)\s*$', 1) FROM (SELECT *, unnest(string_split(listed, ',')) AS x FROM ex) WHERE trim(x) <> '')"""
_BASES = r"""ba AS (SELECT file_id, repo_id, line_no, CASE WHEN ext = 'py' THEN regexp_extract(line_text, '^\s*class\s+(\w+)\(([^)]*)\)', 1) ELSE regexp_extract(line_text, '\bclass\s+(\w+)\b[^{]*?\b(?:extends|implements)\s+([\w., ]+)', 1) END AS class_name,
  unnest(regexp_split_to_array(CASE WHEN ext = 'py' THEN regexp_extract(line_text, '^\s*class\s+(\w+)\(([^)]*)\)', 2) ELSE regexp_extract(line_text, '\bclass\s+(\w+)\b[^{]*?\b(?:extends|implements)\s+([\w., ]+)', 2) END, '[,\s]+')) AS b FROM lines
  WHERE (ext = 'py' AND regexp_matches(line_text, '^\s*class\s+(\w+)\(([^)]*)\)')) OR (ext IN ('js', 'ts', 'java') AND regexp_matches(line_text, '\bclass\s+(\w+)\b[^{]*?\b(?:extends|implements)\s+([\w., ]+)'))),
bases AS (SELECT DISTINCT file_id, repo_id, line_no, class_name, regexp_extract(b, '(\w+)$', 1) AS base_name FROM ba WHERE regexp_extract(b, '(\w+)$', 1) NOT IN ('', 'extends', 'implements') AND NOT contains(b, '='))"""
_MEMBERS = """mo AS (SELECT *, last_value(CASE WHEN symbol_kind = 'class' THEN symbol_name END IGNORE NULLS) OVER w AS class_name, last_value(CASE WHEN symbol_kind = 'class' THEN end_line END IGNORE NULLS) OVER w AS class_end FROM symbols WHERE symbol_kind IN ('class', 'method') AND start_line IS NOT NULL
  WINDOW w AS (PARTITION BY file_id ORDER BY start_line, CASE WHEN symbol_kind = 'class' THEN 0 ELSE 1 END, symbol_id ROWS UNBOUNDED PRECEDING)), members AS (SELECT repo_id, file_id, class_name, symbol_name, symbol_id FROM mo WHERE symbol_kind = 'method' AND class_end >= start_line)"""


@query(f"WITH {LINES}, {_IMPORTED} SELECT file_id, line_no, source_module, imported_name, alias, import_type FROM allimports")
def ext_imports_all(s, d):
    """Imports of every form; ``ext_imports`` stays at what its SQL states."""
    return structure.all_imports(_lines(s, d)).select("file_id", "line_no", "source_module", "imported_name", "alias", "import_type")


@query(f"""WITH {LINES}, {SYMBOLS}, {_IMPORTED}, na AS (SELECT DISTINCT repo_id, lower(symbol_name) AS name FROM symbols UNION SELECT DISTINCT repo_id, lower(regexp_replace({_NAME_SQL}, '\\.[^.]+$', '')) FROM files),
  ke AS (SELECT repo_id, file_id, line_no, lower(source_module) AS name, 1 AS p FROM allimports UNION ALL SELECT repo_id, file_id, line_no, regexp_extract(lower(source_module), '([^./]+)$', 1), 2 FROM allimports UNION ALL SELECT repo_id, file_id, line_no, lower(imported_name), 3 FROM allimports UNION ALL SELECT repo_id, file_id, line_no, lower(alias), 4 FROM allimports WHERE alias IS NOT NULL),
  be AS (SELECT ke.repo_id, ke.name, file_id, line_no, min(p) AS p FROM ke JOIN na ON na.repo_id = ke.repo_id AND na.name = ke.name WHERE ke.name <> '' GROUP BY 1, 2, 3, 4) SELECT repo_id, name, file_id, line_no, CASE p WHEN 1 THEN 'module' WHEN 2 THEN 'suffix' WHEN 3 THEN 'symbol' ELSE 'alias' END AS matched_by FROM be""")
def join_imports_naming(s, d):
    """Imports that name a symbol or a file of their repository."""
    symbols = _symbols(s, d).select("repo_id", F.lower("symbol_name").alias("name"))
    stems = _paths(s, d).select("repo_id", F.lower(F.regexp_replace(detect.basename("file_path"), r"\.[^.]+$", "")).alias("name"))
    return structure.imports_naming(structure.all_imports(_lines(s, d)), symbols.unionByName(stems))


@query(f"WITH {LINES}, {_EXPORTED} SELECT file_id, line_no, exported_name FROM exported")
def ext_exports(s, d):
    return structure.exports_of(_lines(s, d)).select("file_id", "line_no", "exported_name")


@query(f"WITH {LINES}, {_BASES} SELECT file_id, line_no, class_name, base_name FROM bases")
def join_inheritance(s, d):
    """Classes and what they extend or implement."""
    return structure.bases_of(_lines(s, d)).select("file_id", "line_no", "class_name", "base_name")


@query(f"WITH {SYMBOLS}, {_MEMBERS} SELECT file_id, class_name, symbol_id FROM members")
def join_class_members(s, d):
    """Methods and their class."""
    return structure.class_members(_symbols(s, d)).select("file_id", "class_name", "symbol_id")


_CODE_SQL = "ext IN ('py', 'js', 'ts', 'java', 'go')"
_DEFINING = r"NOT regexp_matches(line_text, '\b(?:def|function|func|class|interface)\s')"
_MENTION_RULES = [
    ("class_instantiation", 1, f"{_CODE_SQL} AND {_DEFINING}", r"([A-Za-z_]\w*)\(", "'class'"), ("function_call", 3, f"{_CODE_SQL} AND {_DEFINING}", r"([A-Za-z_]\w*)\(", "'function', 'method'"),
    ("type_hint", 6, "ext IN ('py', 'ts')", r"(?::|->)\s*(?:[A-Za-z_]\w*\[)?([A-Za-z_]\w*)", "'class', 'interface'"), ("variable_usage", 7, f"{_CODE_SQL} AND {_DEFINING}", r"([A-Za-z_]\w*)", "'collection'"),
    ("attribute_reference", 8, _CODE_SQL, r"\.([A-Za-z_]\w*)(?:[^\w(]|$)", "'function', 'method', 'class', 'collection'"), ("doc_mention", 9, "ext IN ('md', 'rst', 'txt')", r"([A-Za-z_]\w{3,})", "'function', 'method', 'class', 'interface', 'collection'"),
]
_REFERENCES = "un AS (" + " UNION ALL ".join(
    f"SELECT m.repo_id, lower(m.n) AS name, file_id, line_no, '{kind}' AS ref_type, {priority} AS priority FROM (SELECT repo_id, file_id, line_no, unnest(list_distinct(regexp_extract_all(line_text, '{p}', 1))) AS n FROM lines WHERE {where}) m WHERE EXISTS (SELECT 1 FROM symbols k WHERE k.repo_id = m.repo_id AND k.symbol_name = m.n AND k.symbol_kind IN ({kinds}))"
    for kind, priority, where, p, kinds in _MENTION_RULES
) + "".join(
    f" UNION ALL SELECT t.repo_id, lower(regexp_extract({c}, '(\\w+)$', 1)), file_id, line_no, '{kind}', {priority} FROM {source} t WHERE EXISTS (SELECT 1 FROM symbols k WHERE k.repo_id = t.repo_id AND lower(k.symbol_name) = lower(regexp_extract({c}, '(\\w+)$', 1)))"
    for source, c, kind, priority in (("bases", "base_name", "class_inheritance", 2), ("allimports", "imported_name", "import", 4), ("exported", "exported_name", "export", 5))
) + ")"


@query(f"WITH {LINES}, {SYMBOLS}, {_IMPORTED}, {_EXPORTED}, {_BASES}, {_REFERENCES} SELECT DISTINCT repo_id, name, file_id, line_no, ref_type, priority FROM un")
def join_references(s, d):
    """References of all kinds to every symbol; ``join_references_union`` stays at what its SQL states."""
    return structure.references(_lines(s, d), _symbols(s, d))


@query(f"WITH {LINES}, {SYMBOLS}, {_IMPORTED}, {_EXPORTED}, {_BASES}, {_REFERENCES}, r AS (SELECT DISTINCT repo_id, name, file_id, line_no, ref_type FROM un) SELECT repo_id, ref_type, count(*) AS n_references, count(DISTINCT file_id) AS n_files FROM r GROUP BY 1, 2")
def agg_references_by_type(s, d):
    r = structure.references(_lines(s, d), _symbols(s, d))
    return r.groupBy("repo_id", "ref_type").agg(F.count("*").alias("n_references"), F.countDistinct("file_id").alias("n_files"))


_QUALIFIED = """qn AS (SELECT DISTINCT file_id, symbol_name, min(class_name) AS class_name FROM members GROUP BY 1, 2), qc AS (SELECT c.repo_id, coalesce(q.class_name || '.' || c.caller, c.caller) AS caller, c.callee FROM calls c LEFT JOIN qn q ON q.file_id = c.file_id AND q.symbol_name = c.caller WHERE c.caller IS NOT NULL)"""


@query(f"""WITH {CALLS}, {_MEMBERS}, {_QUALIFIED}, a AS (SELECT DISTINCT repo_id, symbol_name AS asked FROM symbols WHERE symbol_kind IN ('function', 'method')), x AS (SELECT DISTINCT a.repo_id, asked, callee, 'exact' AS how FROM a JOIN qc ON qc.repo_id = a.repo_id AND lower(qc.caller) = lower(asked)),
  f AS (SELECT DISTINCT a.repo_id, asked, callee, 'suffix' AS how FROM a JOIN qc ON qc.repo_id = a.repo_id AND lower(regexp_extract(qc.caller, '([^.]+)$', 1)) = lower(asked) AND contains(qc.caller, '.')) SELECT * FROM x UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.repo_id = f.repo_id AND x.asked = f.asked)""")
def join_callees_suffix(s, d):
    """Callees of every function and method: those of the caller of that name, or where there are none, of callers that are methods of
    that name (``Class.name``)."""
    sy = _symbols(s, d)
    classes = structure.class_members(sy).groupBy("file_id", F.col("symbol_name").alias("caller")).agg(F.min("class_name").alias("class_name"))
    calls = _calls(s, d).filter("caller is not null").join(classes, ["file_id", "caller"], "left")
    calls = calls.select("repo_id", F.lower(F.when(F.col("class_name").isNull(), F.col("caller"))).alias("exact"), F.lower("caller").alias("last"), "class_name", "callee").distinct()
    asked = sy.filter("symbol_kind in ('function', 'method')").select("repo_id", F.col("symbol_name").alias("asked"), F.lower("symbol_name").alias("_n")).distinct()
    exact = asked.join(calls.withColumn("_n", F.col("exact")), ["repo_id", "_n"]).select("repo_id", "asked", "callee", F.lit("exact").alias("how")).distinct()
    suffix = asked.join(calls.filter("class_name is not null").withColumn("_n", F.col("last")), ["repo_id", "_n"]).select("repo_id", "asked", "callee", F.lit("suffix").alias("how")).distinct()
    return structure.first_non_empty(exact, suffix, ["repo_id", "asked"])


@query(f"""WITH {CALLS}, {_IMPORTED}, {_EXPORTED}, {_BASES}, {_MEMBERS}, e AS (SELECT repo_id, 'DEFINES' AS edge_kind, concat('file:', file_id) AS src, concat('sym:', symbol_name) AS dst FROM symbols UNION SELECT repo_id, 'CONTAINS', concat('sym:', class_name), concat('sym:', symbol_name) FROM members
  UNION SELECT repo_id, 'INHERITS', concat('sym:', class_name), concat('sym:', base_name) FROM bases UNION SELECT repo_id, 'IMPORTS', concat('file:', file_id), concat('mod:', source_module) FROM allimports UNION SELECT repo_id, 'EXPORTS', concat('file:', file_id), concat('sym:', exported_name) FROM exported
  UNION SELECT repo_id, 'CALLS', concat('sym:', caller), concat('sym:', callee) FROM calls WHERE caller IS NOT NULL) SELECT repo_id, edge_kind, count(*) AS n_edges, count(DISTINCT src) AS n_sources FROM e GROUP BY 1, 2""")
def gra_edges(s, d):
    """Edges of all six kinds; ``gra_edge_counts`` stays at what its SQL states."""
    y, x = _symbols(s, d), _lines(s, d)
    e = graph.typed_edges(y, structure.class_members(y), structure.bases_of(x), structure.all_imports(x), structure.exports_of(x), _calls(s, d))
    return e.groupBy("repo_id", "edge_kind").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_sources"))


@query(f"""WITH {LINES}, {SYMBOLS}, h AS (SELECT file_id, line_no FROM lines WHERE regexp_matches(line_text, '\\b(raise|throw|return)\\b')), j AS (SELECT h.file_id, h.line_no, arg_max(s.symbol_name, s.start_line * 1000000 - s.symbol_id % 1000000) AS scope_name FROM h JOIN symbols s ON s.file_id = h.file_id AND h.line_no BETWEEN s.start_line AND s.end_line AND s.symbol_kind IN ('function', 'method') GROUP BY 1, 2)
  SELECT file_id, scope_name, count(*) AS n_lines FROM j GROUP BY 1, 2""")
def join_enclosing_scope(s, d):
    hits = _lines(s, d).filter(F.col("line_text").rlike(r"\b(raise|throw|return)\b")).select("file_id", "line_no")
    sy = _symbols(s, d).filter("symbol_kind in ('function', 'method') and start_line is not null").select("file_id", "start_line", "end_line", "symbol_name", "symbol_id")
    inside = hits.join(sy, (hits.file_id == sy.file_id) & hits.line_no.between(sy.start_line, sy.end_line)).select(hits.file_id, "line_no", "start_line", "symbol_name", "symbol_id")
    one = inside.groupBy("file_id", "line_no").agg(F.max_by("symbol_name", F.col("start_line").cast("long") * 1_000_000 - F.col("symbol_id") % 1_000_000).alias("scope_name"))
    return one.groupBy("file_id", "scope_name").agg(F.count("*").alias("n_lines"))


@query(f"""WITH {LINES}, {SYMBOLS}, x AS (SELECT file_id, line_no, CASE {_KINDS} END AS symbol_kind, CASE {_NAMES} END AS symbol_name FROM lines)
  SELECT DISTINCT file_id, symbol_kind, symbol_name FROM x WHERE symbol_kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.file_id = x.file_id AND s.symbol_name = x.symbol_name)""")
def join_enrich_anti(s, d):
    found = structure.regex_symbols(_lines(s, d)).select("file_id", "symbol_kind", "symbol_name").distinct()
    return found.join(_symbols(s, d).select("file_id", "symbol_name"), ["file_id", "symbol_name"], "left_anti").select("file_id", "symbol_kind", "symbol_name")


@query(f"""WITH {FILES}, c AS (SELECT DISTINCT chunk_id, file_id, start_line, end_line FROM chunks) SELECT chunk_id, CASE WHEN f.file_lines IS NULL THEN 'fabricated' WHEN start_line < 1 OR end_line < start_line OR end_line > len(f.file_lines) THEN 'unsupported' ELSE 'grounded' END AS status FROM c LEFT JOIN files f USING (file_id)""")
def join_grounding(s, d):
    c = table(s, d, "chunks").select("chunk_id", "file_id", "start_line", "end_line").distinct()
    return evaluate.grounding(c, _line_counts(s, d)).select("chunk_id", "status")


@query(f"""WITH {FILES}, {SYMBOLS}, b AS (SELECT file_id, len(file_lines) AS n, unnest(generate_series(0, len(file_lines) - 1, 30)) AS i FROM files WHERE len(file_lines) > 0), r AS (SELECT file_id, i + 1 AS s, least(i + 35, n) AS e FROM b)
  SELECT y.symbol_id, count(*) AS n_blocks, min(greatest(r.s, y.start_line))::INT AS first_line, max(least(r.e, y.end_line))::INT AS last_line FROM symbols y JOIN r ON r.file_id = y.file_id AND greatest(r.s, y.start_line) <= least(r.e, y.end_line) GROUP BY 1""")
def join_relevance_range(s, d):
    b = lines.blocks_of(_files(s, d)).select("file_id", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    y = _symbols(s, d).select("symbol_id", "file_id", "start_line", "end_line")
    j = y.join(b, (y.file_id == b.file_id) & (F.greatest("s", "start_line") <= F.least("e", "end_line")))
    return j.groupBy("symbol_id").agg(F.count("*").alias("n_blocks"), F.min(F.greatest("s", "start_line")).alias("first_line"), F.max(F.least("e", "end_line")).alias("last_line"))


# ------------------------------------------------------------------------------------------- aggregates


_TRIMMED = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
_FOLD = """list_reduce(list_prepend({'t': '', 'close': '', 'comment': 0, 'code': 0}, list_transform(t, lambda x: {'t': x, 'close': '', 'comment': 0, 'code': 0})), lambda a, x: CASE
  WHEN x.t = '' THEN {'t': '', 'close': a.close, 'comment': a.comment, 'code': a.code}
  WHEN a.close <> '' THEN {'t': '', 'close': CASE WHEN contains(x.t, a.close) THEN '' ELSE a.close END, 'comment': a.comment + 1, 'code': a.code}
  WHEN len(list_filter(marks, lambda m: starts_with(x.t, m))) > 0 THEN {'t': '', 'close': '', 'comment': a.comment + 1, 'code': a.code}
  WHEN len(list_filter(pairs, lambda p: starts_with(x.t, p[1]))) > 0 THEN {'t': '', 'close': CASE WHEN contains(substr(x.t, length(list_filter(pairs, lambda p: starts_with(x.t, p[1]))[1][1]) + 1), list_filter(pairs, lambda p: starts_with(x.t, p[1]))[1][2]) THEN ''
    ELSE list_filter(pairs, lambda p: starts_with(x.t, p[1]))[1][2] END, 'comment': a.comment + 1, 'code': a.code}
  ELSE {'t': '', 'close': '', 'comment': a.comment, 'code': a.code + 1} END)"""


@query(f"""WITH {FILES}, {_DETECTED.format('files')}, mk AS (SELECT file_id, repo_id, detected, category, list_transform(file_lines, lambda x: {_TRIMMED}) AS t,
  CASE WHEN detected IN ('Python', 'Shell', 'YAML', 'Dockerfile') THEN ['#'] WHEN detected IN ('TypeScript', 'TSX', 'JavaScript', 'Java', 'C', 'C++', 'C#', 'Go', 'Rust', 'SCSS') THEN ['//'] WHEN detected = 'SQL' THEN ['--'] ELSE []::VARCHAR[] END AS marks,
  CASE WHEN detected = 'Python' THEN [['\"\"\"', '\"\"\"'], ['\'\'\'\'\'\'', '\'\'\'\'\'\'']] WHEN detected = 'TSX' THEN [['/*', '*/'], ['{{/*', '*/}}']] WHEN detected IN ('TypeScript', 'JavaScript', 'Java', 'C', 'C++', 'C#', 'Go', 'Rust', 'CSS', 'SCSS', 'SQL') THEN [['/*', '*/']]
  WHEN detected IN ('HTML', 'XML') THEN [['<!--', '-->']] ELSE []::VARCHAR[][] END AS pairs FROM det),
  fo AS (SELECT *, len(list_filter(t, lambda x: x = ''))::INT AS blank_lines, CASE WHEN category = 'source' THEN {_FOLD} ELSE {{'t': '', 'close': '', 'comment': len(list_filter(t, lambda x: len(list_filter(marks, lambda m: starts_with(x, m))) > 0)), 'code': 0}} END AS c FROM mk)
  SELECT file_id, repo_id, detected, blank_lines, c.comment::INT AS comment_lines, c.code::INT AS code_lines, (CASE WHEN category = 'data' THEN len(t) - blank_lines - c.comment ELSE 0 END)::INT AS data_lines,
  (CASE WHEN category = 'configuration' THEN len(t) - blank_lines - c.comment ELSE 0 END)::INT AS config_lines, (CASE WHEN category IN ('documentation', 'unknown', 'binary') THEN len(t) - blank_lines - c.comment ELSE 0 END)::INT AS documentation_lines FROM fo""")
def agg_line_categories(s, d):
    return lines.line_categories(_files(s, d))


@query(f"""WITH {LINES} SELECT file_id, count_if(regexp_matches(line_text, '^\\s*$'))::BIGINT AS blank_lines, count_if(regexp_matches(line_text, '^\\s*#'))::BIGINT AS comment_lines, count_if(NOT regexp_matches(line_text, '^\\s*$') AND NOT regexp_matches(line_text, '^\\s*#'))::BIGINT AS other_lines FROM lines WHERE ext IN ('py','sh','yaml','yml','toml','env') GROUP BY 1""")
def agg_line_categories_hash(s, d):
    k = table(s, d, "km_files").filter(detect.extension("file_path").isin("py", "sh", "yaml", "yml", "toml", "env") & (F.size("file_lines") > 0))
    of = lambda pattern: F.size(F.filter("file_lines", lambda x: x.rlike(pattern))).cast("long")
    blank, comment = of(r"^\s*$"), of(r"^\s*#")
    return lines.latest_files(k, blank_lines=blank, comment_lines=comment, other_lines=F.size("file_lines") - blank - comment)


_META = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC, line_count DESC) AS rn FROM file_metadata) WHERE rn = 1)"


def _meta(s, d):
    m = table(s, d, "file_metadata")
    return m.groupBy("file_id").agg(F.max_by(F.struct(*[c for c in m.columns if c != "file_id"]), F.struct("ingested_at", "line_count")).alias("m")).select("file_id", "m.*")


@query(f"""WITH {_META} SELECT repo_id, count(*) AS n_files, sum(line_count)::BIGINT AS n_lines, sum(byte_size)::BIGINT AS n_bytes, count_if(is_source_code)::BIGINT AS n_source, count_if(is_documentation)::BIGINT AS n_docs, count_if(is_configuration)::BIGINT AS n_config, count_if(is_data)::BIGINT AS n_data, sum(code_lines)::BIGINT AS code_lines FROM m GROUP BY 1""")
def agg_repo_stats(s, d):
    return _meta(s, d).groupBy("repo_id").agg(F.count("*").alias("n_files"), F.sum("line_count").alias("n_lines"), F.sum("byte_size").alias("n_bytes"), *[F.count_if(c).alias(n) for c, n in (("is_source_code", "n_source"), ("is_documentation", "n_docs"), ("is_configuration", "n_config"), ("is_data", "n_data"))], F.sum("code_lines").alias("code_lines"))


@query(f"""WITH {_META} SELECT lower(detected_language) AS language, count(*) AS n_files, sum(line_count)::BIGINT AS n_lines, sum(code_lines)::BIGINT AS code_lines, sum(comment_lines)::BIGINT AS comment_lines, sum(blank_lines)::BIGINT AS blank_lines FROM m GROUP BY 1""")
def agg_language_stats(s, d):
    return _meta(s, d).groupBy(F.lower("detected_language").alias("language")).agg(F.count("*").alias("n_files"), *[F.sum(c).alias(n) for c, n in (("line_count", "n_lines"), ("code_lines", "code_lines"), ("comment_lines", "comment_lines"), ("blank_lines", "blank_lines"))])


@query(f"""WITH {_META}, c AS (SELECT repo_id, lower(detected_language) AS l, count(*) AS n FROM m WHERE detected_language IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, l) AS k FROM c) SELECT repo_id, l AS main_language, n AS n_main FROM r WHERE k = 1""")
def agg_repo_summary(s, d):
    c = _meta(s, d).filter("detected_language is not null").groupBy("repo_id", F.lower("detected_language").alias("main_language")).agg(F.count("*").alias("n_main"))
    w = Window.partitionBy("repo_id").orderBy(F.desc("n_main"), "main_language")
    return c.withColumn("k", F.row_number().over(w)).filter("k = 1").select("repo_id", "main_language", "n_main")


@query(f"WITH {SYMBOLS} SELECT coalesce(symbol_kind, '(all)') AS symbol_kind, count(*) AS n, count(DISTINCT lower(symbol_name)) AS n_names, count(DISTINCT file_id) AS n_files FROM symbols GROUP BY ROLLUP (symbol_kind)")
def agg_structure_stats(s, d):
    return _symbols(s, d).rollup("symbol_kind").agg(F.count("*").alias("n"), F.countDistinct(F.lower("symbol_name")).alias("n_names"), F.countDistinct("file_id").alias("n_files")).withColumn("symbol_kind", F.coalesce("symbol_kind", F.lit("(all)")))


@query(f"WITH {SYMBOLS}, k AS (SELECT file_id, symbol_name, start_line, end_line, repo_id FROM symbols WHERE symbol_kind = 'class') SELECT k.file_id, k.symbol_name AS class_name, count(*) AS n_methods FROM k JOIN symbols m ON m.file_id = k.file_id AND m.symbol_kind = 'method' AND m.start_line BETWEEN k.start_line AND k.end_line GROUP BY 1, 2")
def agg_class_methods(s, d):
    sy = _symbols(s, d)
    k = sy.filter("symbol_kind = 'class'").select("file_id", F.col("symbol_name").alias("class_name"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    m = sy.filter("symbol_kind = 'method'").select(F.col("file_id").alias("_f"), "start_line")
    return k.join(m, (F.col("file_id") == F.col("_f")) & F.col("start_line").between(F.col("s"), F.col("e"))).groupBy("file_id", "class_name").agg(F.count("*").alias("n_methods"))


@query("SELECT config_key, count(*) AS n, count(DISTINCT repo_id) AS n_repos, max(length(config_value))::INT AS longest FROM km_configs GROUP BY 1")
def agg_config_keys(s, d):
    return table(s, d, "km_configs").groupBy("config_key").agg(F.count("*").alias("n"), F.countDistinct("repo_id").alias("n_repos"), F.max(F.length("config_value")).alias("longest"))


_P90 = """SELECT event_type, count(*) AS n, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, list_extract(list_sort(list(value)), floor(count(*) * 0.9e0)::BIGINT + 1) AS p90_value FROM events WHERE value IS NOT NULL GROUP BY 1"""


@query(_P90)
def eval_latency(s, d):
    return evaluate.order_statistics(table(s, d, "events"), "event_type", "value")


# -------------------------------------------------------------------------------------------- retrieval

_TOK = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9_]+', ' ', 'g')), ' +'), lambda t: length(t) > 1)"
_VOC = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[_\\-./\\\\:@#\\s]+', ' ', 'g')), ' +'), lambda t: length(t) > 1)"


@query(f"SELECT doc_id, len({_TOK.format('text')})::INT AS n_tokens, len(list_distinct({_TOK.format('text')}))::INT AS n_terms FROM documents")
def ret_tokens(s, d):
    t = table(s, d, "documents").select("doc_id", text.code_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


POSTINGS = f"w AS (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2)"


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY 1")
def ret_tf_df(s, d):
    postings = retrieval.postings_of(table(s, d, "documents"), "doc_id", "text").select("doc_id", F.explode(F.split("words", " ")).alias("term"))
    return postings.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_BM25 = POSTINGS + f""", l AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT doc_id AS query_id, unnest({_TOK.format('title')}) AS term FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL), qf AS (SELECT query_id, term, count(*) AS qf FROM q GROUP BY 1, 2),
sc AS (SELECT query_id, tf.doc_id, round(sum(qf * ln((n.n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf.tf * 2.2e0 / (tf.tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score FROM qf JOIN df USING (term) JOIN tf USING (term) JOIN l ON l.doc_id = tf.doc_id, n GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc)"""


def _bm25(s, d, k):
    docs = table(s, d, "documents")
    asked = docs.filter("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.explode(text.code_tokens("title")).alias("term"))
    return retrieval.bm25(retrieval.postings_of(docs, "doc_id", "text"), asked, "doc_id", "query_id", k, docs.count())


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def ret_bm25_top10(s, d):
    return _bm25(s, d, 10)


_DJB = "abs(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((h * 33 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648))"


@query(f"SELECT DISTINCT symbol_name, {_DJB.format('symbol_name')} AS hash FROM km_symbols WHERE symbol_name <> ''")
def ret_djb2(s, d):
    return table(s, d, "km_symbols").filter("symbol_name <> ''").select("symbol_name", text.djb2("symbol_name").alias("hash")).distinct()


_TERMS_SQL = """['auth login token jwt verify password credential mfa authenticate bearer session oauth', 'database connection db db_url sql query table store repository connect schema entity',
  'middleware request response headers dispatch authorization handler route api http fetch axios endpoint', 'predict prediction model inference dataset features train classifier regression estimator calculate',
  'crypto hash salt hmac sha256 secret signature sign digest encrypt decrypt', 'device bluetooth hub settings deeplink pairing hardware beacon adapter sensor peripheral', 'error exception catch raise try throw fault fail fallback validationerror reject',
  'audit log security_event logging logger trace events monitor record debug console', 'config settings env environment debug host port url parameter options constants', 'async await promise then observable stream event emit listen subscribe channel',
  'load read csv parse json dataset records file stream import_data serialize', 'init initialize bootstrap startup main start lifecycle setup index app', 'class base inherit subclass mixin constructor prototype extends implements interface',
  'call caller callee calls invoke execute run pipeline dispatch forward', 'user username account profile role scopes permissions admin tenant member', 'validate_token validate validation check valid expiry authentic assert verify schema']"""
_EMBEDDED = f"""w AS (SELECT key, unnest(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9_]+'), lambda x: length(x) > 1)) AS token FROM i), c AS (SELECT key, token, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2),
  g AS (SELECT key, n, unnest(list_transform(generate_series(1, length(token) - 2), lambda k: substr(token, k, 3))) AS g FROM c WHERE length(token) >= 3), cn AS (SELECT unnest(generate_series(0, 15)) AS c, unnest({_TERMS_SQL}) AS terms), ct AS (SELECT c, unnest(string_split(terms, ' ')) AS term FROM cn),
  tk AS (SELECT key, lower(t) AS low, list_filter(regexp_split_to_array(lower(t), '[^a-z0-9_]+'), lambda x: length(x) > 1) AS tokens FROM i),
  m AS (SELECT key, c, sum(CASE WHEN list_contains(tokens, term) THEN 2e0 ELSE 1e0 END) AS m FROM tk JOIN ct ON list_contains(tokens, term) OR contains(low, term) GROUP BY 1, 2),
  u AS (SELECT key, ({_DJB.format('token')} % 48)::INT AS dim, n AS w FROM c UNION ALL SELECT key, (48 + {_DJB.format('g')} % 48)::INT, n * 0.5e0 FROM g UNION ALL SELECT key, (96 + c * 2)::INT, m FROM m UNION ALL SELECT key, (97 + c * 2)::INT, ln(1 + m) FROM m),
  s AS (SELECT key, dim, sum(w) AS w FROM u GROUP BY 1, 2), z AS (SELECT key, sqrt(sum(w * w)) AS z FROM s GROUP BY 1), em AS (SELECT key, dim, round(w / z, 6) AS weight FROM s JOIN z USING (key))"""


@query(f"""WITH i AS (SELECT DISTINCT symbol_name AS key, array_to_string(list_distinct_in_order, ' ') AS t FROM (SELECT symbol_name, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(symbol_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[_\\-./\\\\:@#\\s]+', ' ', 'g')), ' +'), lambda x: length(x) > 1) AS list_distinct_in_order FROM km_symbols)), {_EMBEDDED} SELECT key AS name, dim, weight FROM em""")
def ret_embed_local(s, d):
    """The words of symbol names, each as often as it occurs."""
    names = table(s, d, "km_symbols").select(F.col("symbol_name").alias("name")).distinct()
    return retrieval.embed(names.select("name", text.spaced_words("name").alias("t")), "name", "t")


_COS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0, least(1, list_dot_product(q.v, e.v))), 6) AS score FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
co AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)"""


def _cosine(s, d, k):
    e = table(s, d, "embeddings")
    return retrieval.cosine_top_k(e, e.filter("vec_id % 20 = 0"), k)


@query(f"WITH {_COS} SELECT query_id, vec_id, score, rank FROM co WHERE rank <= 10")
def ret_cosine_top10(s, d):
    return _cosine(s, d, 10)


@query(f"""WITH {_BM25}, {_COS}, s AS (SELECT query_id, vec_id AS doc_id, score AS semantic FROM co WHERE rank <= 15 AND score > 0.05), x AS (SELECT query_id, doc_id, least(1e0, score / 5) AS lexical FROM bm WHERE rank <= 15),
  f AS (SELECT query_id, doc_id, coalesce(semantic, 0e0) AS semantic, coalesce(lexical, 0e0) AS lexical FROM s FULL JOIN x USING (query_id, doc_id)), t AS (SELECT *, round(semantic * 0.55e0 + lexical * 0.35e0, 6) AS total FROM f),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id)::INT AS rank FROM t WHERE total >= 0.15)
  SELECT query_id, doc_id, total, CASE WHEN semantic > 0.25 AND lexical > 0.25 THEN 'hybrid' WHEN semantic > 0.25 THEN 'semantic' WHEN lexical > 0.25 THEN 'lexical' ELSE 'weak' END AS match_type, rank FROM r WHERE rank <= 5""")
def ret_hybrid(s, d):
    semantic = _cosine(s, d, 15).select("query_id", F.col("vec_id").alias("doc_id"), "score")
    return retrieval.fuse(semantic, _bm25(s, d, 15).select("query_id", "doc_id", "score"), "doc_id").select("query_id", "doc_id", "total", "match_type", "rank")


_CHUNKS = """it AS (SELECT chunk_id, repo_id, lower(file_path) AS path, lower(file_language) AS language, lower(coalesce(symbol_name, '')) AS symbol, concat_ws(' ', file_path, symbol_name, docstring, source_text) AS lexical_text, concat_ws(' ', symbol_name, docstring, left(source_text, 300)) AS semantic_text
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) AS rn FROM chunks) WHERE rn = 1), qs AS (SELECT symbol_id AS query_id, symbol_name AS query_text FROM symbols WHERE symbol_id % 20 = 0)"""
_CHUNK_BM25 = _CHUNKS + f""", w AS (SELECT chunk_id, unnest({_TOK.format('lexical_text')}) AS term FROM it), tf AS (SELECT chunk_id, term, count(*) AS tf FROM w GROUP BY 1, 2), l AS (SELECT chunk_id, sum(tf) AS dl FROM tf GROUP BY 1), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), qw AS (SELECT query_id, unnest({_TOK.format('query_text')}) AS term FROM qs), qf AS (SELECT query_id, term, count(*) AS qf FROM qw GROUP BY 1, 2),
  rw AS (SELECT query_id, tf.chunk_id, round(sum(qf * ln((n.n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf.tf * 2.2e0 / (tf.tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score FROM qf JOIN df USING (term) JOIN tf USING (term) JOIN l ON l.chunk_id = tf.chunk_id, n GROUP BY 1, 2),
  sc AS (SELECT rw.query_id, rw.chunk_id, symbol <> '' AND (contains(lower(query_text), symbol) OR contains(symbol, lower(query_text))) AS symbol_match,
    round(score * CASE WHEN symbol <> '' AND (contains(lower(query_text), symbol) OR contains(symbol, lower(query_text))) THEN 1.8e0 ELSE 1e0 END * CASE WHEN contains(path, lower(query_text)) THEN 1.3e0 ELSE 1e0 END, 6) AS score FROM rw JOIN it USING (chunk_id) JOIN qs USING (query_id)),
  lx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM sc)"""


def _chunk_queries(s, d):
    return _symbols(s, d).filter("symbol_id % 20 = 0").select(F.col("symbol_id").alias("query_id"), F.col("symbol_name").alias("query_text"))


@query(f"WITH {SYMBOLS}, {_CHUNK_BM25} SELECT query_id, chunk_id, score, symbol_match, rank FROM lx WHERE rank <= 10")
def ret_chunk_bm25(s, d):
    """Chunks for the names of every 20th symbol, by boosted BM25."""
    return retrieval.chunk_search(retrieval.delivered_chunks(table(s, d, "chunks")), _chunk_queries(s, d))


_DENSE = "list_transform(generate_series(0, 127), lambda i: coalesce(ws[list_position(ds, i)], 0e0))"


def _embedded(source: str) -> str:
    """The SQL of the embedding over another table of keys and texts."""
    return f"WITH i AS ({source}), {_EMBEDDED.replace('round(w / z, 6)', 'round(w / z, 12)')} SELECT key, dim, weight FROM em"


_CHUNK_POOLS = f"""{_CHUNK_BM25}, cv AS (SELECT key AS chunk_id, {_DENSE} AS v FROM (SELECT key, list(weight ORDER BY dim) AS ws, list(dim ORDER BY dim) AS ds FROM ({_embedded('SELECT chunk_id AS key, semantic_text AS t FROM it')}) GROUP BY 1)),
  qv AS (SELECT key AS query_id, {_DENSE} AS v FROM (SELECT key, list(weight ORDER BY dim) AS ws, list(dim ORDER BY dim) AS ds FROM ({_embedded('SELECT query_id AS key, query_text AS t FROM qs')}) GROUP BY 1)),
  cs AS (SELECT query_id, chunk_id, round(greatest(0, least(1, list_dot_product(qv.v, cv.v))), 6) AS score FROM qv, cv), sm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cs),
  bo AS (SELECT query_id, chunk_id, coalesce(a.score, 0e0) AS semantic, CASE WHEN b.score IS NULL THEN 0e0 ELSE least(1e0, b.score / 5) END AS lexical, CASE WHEN coalesce(symbol_match, false) THEN 1e0 ELSE 0e0 END AS symbol_score FROM (SELECT * FROM sm WHERE rank <= 15 AND score > 0.05) a FULL JOIN (SELECT * FROM lx WHERE rank <= 15) b USING (query_id, chunk_id)),
  kn AS (SELECT DISTINCT repo_id, lower(symbol_name) AS symbol FROM symbols WHERE symbol_kind IN ('function', 'method', 'class')),
  ca AS (SELECT bo.*, CASE WHEN language = 'python' AND kn.symbol IS NOT NULL THEN 0.8e0 ELSE 0e0 END AS structural, CASE WHEN contains(path, lower(query_text)) THEN 0.5e0 ELSE 0e0 END AS path_score FROM bo JOIN it USING (chunk_id) JOIN qs USING (query_id) LEFT JOIN kn ON kn.repo_id = it.repo_id AND kn.symbol = it.symbol),
  fu AS (SELECT preset, query_id, chunk_id, round(semantic * ws + lexical * wl + structural * wt + symbol_score * 0.1e0 + path_score * 0.1e0 + 1e-9, 6) AS total,
    CASE WHEN (semantic > 0.25)::INT + (lexical > 0.25)::INT + (structural > 0.3)::INT >= 2 THEN 'hybrid' WHEN semantic > 0.25 THEN 'semantic' WHEN structural > 0.3 THEN 'structural' WHEN symbol_score > 0 THEN 'symbol' ELSE 'lexical' END AS match_type
    FROM ca, (VALUES ('hybrid', 0.45e0, 0.25e0, 0.20e0), ('semantic', 0.85e0, 0.10e0, 0.05e0), ('symbol', 0.10e0, 0.60e0, 0.30e0)) AS pr(preset, ws, wl, wt)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY preset, query_id ORDER BY total DESC, chunk_id)::INT AS rank FROM fu WHERE total >= 0.15)"""


def _chunk_candidates(s, d):
    known = _symbols(s, d).filter("symbol_kind in ('function', 'method', 'class')").select("repo_id", F.lower("symbol_name").alias("name"))
    return retrieval.chunk_candidates(retrieval.delivered_chunks(table(s, d, "chunks")), _chunk_queries(s, d), known)


@query(f"WITH {SYMBOLS}, {_CHUNK_POOLS} SELECT query_id, chunk_id, total, match_type, rank FROM rk WHERE preset = 'hybrid' AND rank <= 5")
def ret_chunk_hybrid(s, d):
    """Chunks for the names of every 20th symbol, by meaning, words, structure, symbol and path together."""
    return retrieval.by_query(retrieval.fuse_chunks(_chunk_candidates(s, d), ["hybrid"]).drop("preset"), _chunk_queries(s, d))


@query(f"WITH {SYMBOLS}, {_CHUNK_POOLS} SELECT preset, query_id, chunk_id, total, match_type, rank FROM rk WHERE preset <> 'hybrid' AND rank <= 5")
def ret_presets(s, d):
    """The same with the weights of the semantic and of the symbol search."""
    return retrieval.by_query(retrieval.fuse_chunks(_chunk_candidates(s, d), ["semantic", "symbol"]), _chunk_queries(s, d))


@query(f"""WITH {SYMBOLS}, v AS (SELECT symbol_id, unnest(list_distinct({_VOC.format('symbol_name')})) AS token FROM symbols) SELECT token, count(*) AS n_symbols FROM v GROUP BY 1""")
def ret_vocab_build(s, d):
    return _symbols(s, d).select("symbol_id", F.explode(text.vocabulary_tokens("symbol_name")).alias("token")).groupBy("token").agg(F.count("*").alias("n_symbols"))


# ------------------------------------------------------------------------------------------------ graph


@query(f"""WITH {CALLS}, {IMPORTS.split(LINES + ', ')[1]}, e AS (SELECT repo_id, 'DEFINES' AS edge_kind, concat('file:', file_id) AS src, concat('sym:', symbol_name) AS dst FROM symbols UNION SELECT repo_id, 'IMPORTS', concat('file:', file_id), concat('mod:', source_module) FROM imports UNION SELECT repo_id, 'CALLS', concat('sym:', caller), concat('sym:', callee) FROM calls WHERE caller IS NOT NULL)
  SELECT repo_id, edge_kind, count(*) AS n_edges, count(DISTINCT src) AS n_sources FROM e GROUP BY 1, 2""")
def gra_edge_counts(s, d):
    """DEFINES, IMPORTS and CALLS only; the README lists the kinds that are missing."""
    e = graph.relationship_edges(_symbols(s, d), structure.imports_of(_lines(s, d)), _calls(s, d))
    return e.groupBy("repo_id", "edge_kind").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_sources"))


def _part_edges(s, d):
    """Synthetic call graph over the parts of every brand: each part calls two others of the table."""
    p = table(s, d, "part")
    n = p.count()
    k = F.col("p_partkey")
    to = F.explode(F.array((k * 7 + 3) % n, (k * 11 + 5) % n))
    return p.select(F.lit(0).alias("repo_id"), k.alias("src"), to.alias("dst"))


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), e AS (SELECT DISTINCT p_partkey AS src, unnest([(p_partkey * 7 + 3) % n, (p_partkey * 11 + 5) % n]) AS dst FROM part, n),
  r AS (SELECT p_partkey AS source, p_partkey AS node, 0 AS hops FROM part WHERE p_partkey % 20 = 0 UNION SELECT r.source, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 5),
  m AS (SELECT source, node, min(hops) AS hops FROM r GROUP BY 1, 2) SELECT source, hops::INT AS hops, count(*) AS n_nodes, min(node) AS first_node FROM m WHERE hops > 0 GROUP BY 1, 2""")
def gra_reach_depth(s, d):
    sources = table(s, d, "part").filter("p_partkey % 20 = 0").select(F.lit(0).alias("repo_id"), F.col("p_partkey").alias("source"))
    r = graph.shortest_hops(_part_edges(s, d), sources, 5)
    return r.groupBy("source", "hops").agg(F.count("*").alias("n_nodes"), F.min("node").alias("first_node"))


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), e AS (SELECT DISTINCT p_partkey AS src, unnest([(p_partkey * 7 + 3) % n, (p_partkey * 11 + 5) % n]) AS dst FROM part, n), a AS (SELECT p_partkey AS source, (p_partkey * 49 + 24) % n AS target FROM part, n WHERE p_partkey % 20 = 0),
  r AS (SELECT source, source AS node, [source] AS chain FROM a UNION ALL SELECT r.source, e.dst, list_append(r.chain, e.dst) FROM r JOIN e ON e.src = r.node WHERE len(r.chain) <= 5 AND NOT list_contains(r.chain, e.dst)),
  h AS (SELECT a.source, a.target, r.chain FROM a JOIN r ON r.source = a.source AND r.node = a.target), k AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY len(chain), chain) AS rn FROM h)
  SELECT source, target, (len(chain) - 1)::INT AS hops, array_to_string(chain, ' > ') AS chain FROM k WHERE rn = 1""")
def gra_chain_path(s, d):
    """The shortest chain of parts from every 20th part to another that it is asked about, node by node."""
    p = table(s, d, "part")
    n = p.count()
    asked = p.filter("p_partkey % 20 = 0").select(F.lit(0).alias("repo_id"), F.col("p_partkey").alias("source"), ((F.col("p_partkey") * 49 + 24) % n).alias("target"))
    c = graph.shortest_chains(_part_edges(s, d), asked, 5)
    return c.select("source", "target", "hops", F.array_join(F.col("chain").cast("array<string>"), " > ").alias("chain"))


@query(f"""WITH RECURSIVE {CALLS}, ed AS (SELECT DISTINCT repo_id, caller AS src, callee AS dst FROM calls WHERE caller IS NOT NULL), so AS (SELECT DISTINCT repo_id, symbol_name AS source FROM symbols WHERE symbol_kind IN ('function', 'method') AND symbol_id % 20 = 0),
  re AS (SELECT repo_id, source, source AS node, 0 AS hops FROM so UNION SELECT re.repo_id, re.source, ed.dst, re.hops + 1 FROM re JOIN ed ON ed.repo_id = re.repo_id AND ed.src = re.node WHERE re.hops < 8) SELECT repo_id, source, node, min(hops)::INT AS hops FROM re GROUP BY 1, 2, 3 HAVING min(hops) > 0""")
def gra_chain_shortest(s, d):
    sy = _symbols(s, d).filter("symbol_kind in ('function', 'method') and symbol_id % 20 = 0")
    edges = _calls(s, d).filter("caller is not null").select("repo_id", F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return graph.shortest_hops(edges, sy.select("repo_id", F.col("symbol_name").alias("source")))


# ------------------------------------------------------------------------------------------- evaluation


@query(f"""WITH {_COS}, t AS (SELECT q.vec_id AS query_id, (SELECT count(*) FROM embeddings x WHERE x.label = q.label) - 1 AS n FROM embeddings q WHERE q.vec_id % 20 = 0),
  h AS (SELECT co.query_id, count_if(rank <= 1 AND q.label = v.label) AS h1, count_if(rank <= 5 AND q.label = v.label) AS h5, count_if(rank <= 10 AND q.label = v.label) AS h10 FROM co JOIN embeddings q ON q.vec_id = co.query_id JOIN embeddings v ON v.vec_id = co.vec_id WHERE rank <= 10 GROUP BY 1)
  SELECT query_id, CASE WHEN n > 0 THEN round(coalesce(h1, 0) / 1e0, 6) END AS precision_1, CASE WHEN n > 0 THEN round(coalesce(h5, 0) / 5e0, 6) END AS precision_5, CASE WHEN n > 0 THEN round(coalesce(h10, 0) / 10e0, 6) END AS precision_10,
  CASE WHEN n > 0 THEN round(coalesce(h1, 0)::DOUBLE / n, 6) END AS recall_1, CASE WHEN n > 0 THEN round(coalesce(h5, 0)::DOUBLE / n, 6) END AS recall_5, CASE WHEN n > 0 THEN round(coalesce(h10, 0)::DOUBLE / n, 6) END AS recall_10 FROM t LEFT JOIN h USING (query_id)""")
def eval_precision_recall(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label")
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    truth = e.filter("vec_id % 20 = 0").join(sizes, "label").select(F.col("vec_id").alias("query_id"), "n_relevant", F.col("label").alias("want"))
    ranked = _cosine(s, d, 10).join(e, "vec_id").join(truth.select("query_id", "want"), "query_id").withColumn("is_relevant", F.col("label") == F.col("want"))
    return evaluate.precision_recall(ranked, truth.drop("want"), [1, 5, 10])


_PR = f"""{_COS}, t AS (SELECT q.vec_id AS query_id, (SELECT count(*) FROM embeddings x WHERE x.label = q.label) - 1 AS n FROM embeddings q WHERE q.vec_id % 20 = 0), h AS (SELECT co.query_id, count_if(rank <= 1 AND q.label = v.label) AS h1, count_if(rank <= 5 AND q.label = v.label) AS h5, count_if(rank <= 10 AND q.label = v.label) AS h10
  FROM co JOIN embeddings q ON q.vec_id = co.query_id JOIN embeddings v ON v.vec_id = co.vec_id WHERE rank <= 10 GROUP BY 1)"""


@query(f"""WITH {_PR} SELECT count(*) AS n_queries, round(avg(coalesce(h1, 0) / 1e0), 4) AS precision_1, round(avg(coalesce(h5, 0) / 5e0), 4) AS precision_5, round(avg(coalesce(h10, 0) / 10e0), 4) AS precision_10, round(avg(coalesce(h1, 0)::DOUBLE / n), 4) AS recall_1, round(avg(coalesce(h5, 0)::DOUBLE / n), 4) AS recall_5,
  round(avg(coalesce(h10, 0)::DOUBLE / n), 4) AS recall_10 FROM t LEFT JOIN h USING (query_id) WHERE n > 0""")
def eval_macro(s, d):
    """Precision and recall averaged over the queries that have ground truth."""
    per = eval_precision_recall(s, d).filter("precision_1 is not null")
    return per.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 4).alias(c) for c in per.columns if c != "query_id"])


@query(f"""WITH {SYMBOLS}, {FILES}, c AS (SELECT file_id, count(*) AS expected FROM symbols WHERE symbol_kind IN ('function', 'method') GROUP BY 1),
  a AS (SELECT file_id, len(list_filter(file_lines, lambda x: regexp_matches(x, '^ *(?:async +)?def ')))::BIGINT AS actual, ext FROM exts WHERE ext = 'py') SELECT file_id, expected, actual, CASE WHEN expected = actual THEN 1e0 WHEN abs(expected - actual) <= 1 THEN 0.5e0 ELSE 0e0 END AS accuracy FROM c JOIN a USING (file_id)""")
def eval_struct_accuracy(s, d):
    expected = _symbols(s, d).filter("symbol_kind in ('function', 'method')").groupBy("file_id").agg(F.count("*").alias("expected"))
    actual = _files(s, d).filter(detect.extension("file_path") == "py").select("file_id", F.size(F.filter("file_lines", lambda x: x.rlike("^ *(?:async +)?def "))).cast("long").alias("actual"))
    return expected.join(actual, "file_id").withColumn("accuracy", evaluate.count_accuracy("expected", "actual"))


@query(f"""WITH {SYMBOLS}, {FILES}, c AS (SELECT file_id, repo_id, count(*) AS expected FROM symbols WHERE symbol_kind IN ('function', 'method') GROUP BY 1, 2), a AS (SELECT file_id, len(list_filter(file_lines, lambda x: regexp_matches(x, '^ *(?:async +)?def ')))::BIGINT AS actual FROM exts WHERE ext = 'py'),
  j AS (SELECT repo_id, CASE WHEN expected = actual THEN 1e0 WHEN abs(expected - actual) <= 1 THEN 0.5e0 ELSE 0e0 END AS accuracy FROM c JOIN a USING (file_id)) SELECT coalesce(repo_id::VARCHAR, '(all)') AS category, count(*) AS n_items, round(avg(accuracy), 4) AS accuracy FROM j GROUP BY ROLLUP (repo_id)""")
def eval_accuracy_by_category(s, d):
    """Structural accuracy by repository, and over all."""
    expected = _symbols(s, d).filter("symbol_kind in ('function', 'method')").groupBy("file_id", "repo_id").agg(F.count("*").alias("expected"))
    defs = F.size(F.filter("file_lines", lambda x: x.rlike("^ *(?:async +)?def "))).cast("long")
    actual = lines.latest_files(table(s, d, "km_files").filter(detect.extension("file_path") == "py"), actual=defs)
    j = expected.join(actual, "file_id").withColumn("accuracy", evaluate.count_accuracy("expected", "actual"))
    return j.rollup("repo_id").agg(F.count("*").alias("n_items"), F.round(F.avg("accuracy"), 4).alias("accuracy")).select(F.coalesce(F.col("repo_id").cast("string"), F.lit("(all)")).alias("category"), "n_items", "accuracy")


@query(f"""WITH {FILES}, c AS (SELECT DISTINCT chunk_id, file_id, file_language, start_line, end_line FROM chunks), g AS (SELECT file_language, CASE WHEN f.file_lines IS NULL THEN 'fabricated' WHEN start_line < 1 OR end_line < start_line OR end_line > len(f.file_lines) THEN 'unsupported' ELSE 'grounded' END AS status FROM c LEFT JOIN files f USING (file_id))
  SELECT coalesce(file_language, '(all)') AS file_language, count(*) AS n, round(avg((status = 'grounded')::INT), 6) AS grounding_rate FROM g GROUP BY ROLLUP (file_language)""")
def eval_grounding_rate(s, d):
    c = table(s, d, "chunks").select("chunk_id", "file_id", "file_language", "start_line", "end_line").distinct()
    g = evaluate.grounding(c, _line_counts(s, d))
    return g.rollup("file_language").agg(F.count("*").alias("n"), F.round(F.avg((F.col("status") == "grounded").cast("int")), 6).alias("grounding_rate")).withColumn("file_language", F.coalesce("file_language", F.lit("(all)")))


# -------------------------------------------------------------------------------------------- questions

_INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{n}'" for n, p in route.INTENTS) + " ELSE 'general' END"
_QUESTIONS = f"""ql AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), qs AS (SELECT doc_id, regexp_replace(substr(l, 4), '\\s+$', '') AS question FROM ql WHERE starts_with(l, 'Q: ')),
qi AS (SELECT doc_id, question, {_INTENT_SQL} AS intent, {_CLEAN_SQL.format(f"regexp_extract(question, '(?i){route._ENTITY}', 1)")} AS entity FROM qs)"""


@query(f"WITH {_QUESTIONS} SELECT * FROM qi")
def nlq_intent_batch(s, d):
    return route.questions_of(table(s, d, "documents"))


@query(f"""WITH {_QUESTIONS}, {SYMBOLS}, n AS (SELECT lower(symbol_name) AS name, count(*) AS definitions, count(DISTINCT file_id) AS files FROM symbols GROUP BY 1)
  SELECT doc_id, question, intent, entity, coalesce(definitions, 0) AS definitions, CASE WHEN definitions IS NULL THEN concat('No definition of ''', entity, ''' was found') ELSE concat(definitions, ' definitions in ', files, ' files') END AS answer FROM qi LEFT JOIN n ON n.name = lower(entity)""")
def nlq_answers(s, d):
    return route.answer_counts(route.questions_of(table(s, d, "documents")), _symbols(s, d))


# ----------------------------------------------------------------------------------- further operators


@query(f"""WITH {LINES}, h AS (SELECT DISTINCT file_id, line_no FROM lines WHERE contains(lower(line_text), 'ledger')), l AS (SELECT file_id, list_sort(list(line_no)) AS l FROM h GROUP BY 1)
  SELECT file_id, unnest(list_reduce(list_prepend([]::INT[], list_transform(l, lambda x: [x])), lambda a, x: CASE WHEN len(a) = 0 OR x[1] - a[-1] > 2 THEN list_concat(a, x) ELSE a END)) AS line_no FROM l""")
def win_greedy_dedupe(s, d):
    return lines.greedy_spaced(lines.grep(_lines(s, d), "ledger").select("file_id", "line_no"))


_UNQUOTED = """regexp_replace(x, '"[^"]*"', '', 'g')"""


@query(f"""WITH {FILES}, el AS (SELECT file_id, list_transform(file_lines, lambda x, i: {{'o': length(regexp_replace({_UNQUOTED}, '[^\\[{{(]', '', 'g'))::INT, 'c': length(regexp_replace({_UNQUOTED}, '[^\\]}})]', '', 'g'))::INT, 'op': regexp_matches(x, '^[A-Z][A-Z0-9_]* *= *[\\[{{(]\\s*$'), 'full': regexp_matches(x, '\\S'),
  'i': i::INT, 'depth': 0, 'begin': 0, 'items': 0, 'out': []::STRUCT(s INT, e INT, n INT)[]}}) AS l FROM exts WHERE ext = 'py'),
  fo AS (SELECT file_id, list_reduce(list_prepend({{'o': 0, 'c': 0, 'op': false, 'full': false, 'i': 0, 'depth': 0, 'begin': 0, 'items': 0, 'out': []::STRUCT(s INT, e INT, n INT)[]}}, l), lambda a, x: {{'o': 0, 'c': 0, 'op': false, 'full': false, 'i': x.i,
    'depth': CASE WHEN (a.depth = 0 AND x.op) OR a.depth > 0 THEN greatest(a.depth + x.o - x.c, 0) ELSE 0 END, 'begin': CASE WHEN a.depth = 0 AND x.op THEN x.i ELSE a.begin END,
    'items': CASE WHEN a.depth = 0 AND x.op THEN 0 ELSE a.items + (a.depth > 0 AND greatest(a.depth + x.o - x.c, 0) > 0 AND x.full)::INT END,
    'out': CASE WHEN a.depth > 0 AND greatest(a.depth + x.o - x.c, 0) = 0 THEN list_append(a.out, {{'s': a.begin, 'e': x.i, 'n': greatest(a.items, 1)}}) ELSE a.out END}}) AS r FROM el), un AS (SELECT file_id, unnest(r.out) AS b FROM fo) SELECT file_id, b.s AS start_line, b.e AS end_line, b.n AS item_count FROM un""")
def ext_collections(s, d):
    return lines.bracket_ends(_files(s, d).filter(detect.extension("file_path") == "py"))


@query(f"""WITH {FILES}, w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]\\w*\\.(?:py|ts|js|go|java|css|json|md)\\b'))) AS ref FROM documents), r AS (SELECT doc_id, lower(ref) AS name, count(*) AS n FROM w GROUP BY 1, 2),
  t AS (SELECT lower(list_extract(string_split(file_path, '/'), -1)) AS name, count(*) AS n_files FROM files GROUP BY 1) SELECT doc_id, r.name, coalesce(n_files, 0) AS n_files FROM r LEFT JOIN t USING (name)""")
def ext_file_mentions(s, d):
    refs = table(s, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z]\w*\.(?:py|ts|js|go|java|css|json|md)\b"), 0))).alias("ref"))
    counted = refs.select("doc_id", F.lower("ref").alias("name")).distinct()
    known = _paths(s, d).groupBy(F.lower(detect.basename("file_path")).alias("name")).agg(F.count("*").alias("n_files"))
    return counted.join(known, "name", "left").select("doc_id", "name", F.coalesce("n_files", F.lit(0)).alias("n_files"))


@query(f"""WITH {FILES} SELECT file_id, 'module' AS chunk_kind, 1 AS start_line, least(25, len(file_lines))::INT AS end_line, array_to_string(file_lines[1:25], chr(10)) AS chunk_text FROM exts WHERE ext IN ('py','js','ts','java','go') AND len(file_lines) > 0""")
def chk_module(s, d):
    f = _files(s, d).filter(detect.extension("file_path").isin("py", "js", "ts", "java", "go") & (F.size("file_lines") > 0))
    return f.select("file_id", F.lit("module").alias("chunk_kind"), F.lit(1).alias("start_line"), F.least(F.lit(25), F.size("file_lines")).alias("end_line"), F.array_join(F.slice("file_lines", 1, 25), "\n").alias("chunk_text"))


@query(f"""WITH {FILES}, {SYMBOLS} SELECT symbol_id, array_to_string(f.file_lines[start_line:end_line], chr(10)) AS chunk_text FROM symbols s JOIN files f ON f.file_id = s.file_id WHERE start_line >= 1 AND end_line >= start_line""")
def chk_symbols(s, d):
    y = _symbols(s, d).filter("start_line >= 1 and end_line >= start_line").select("symbol_id", "file_id", "start_line", "end_line")
    j = y.join(_files(s, d).select("file_id", "file_lines"), "file_id")
    return j.select("symbol_id", F.array_join(F.slice("file_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("chunk_text"))


@query(f"""WITH {SYMBOLS}, v AS (SELECT DISTINCT repo_id, symbol_id, unnest(list_distinct({_VOC.format('symbol_name')})) AS token FROM symbols), q AS (SELECT repo_id, symbol_id AS query_id, token FROM v WHERE symbol_id % 20 = 0),
  h AS (SELECT q.query_id, v.symbol_id, count(*) AS n FROM q JOIN v USING (repo_id, token) WHERE v.symbol_id <> q.query_id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, symbol_id)::INT AS rank FROM h) SELECT query_id, symbol_id, n, rank FROM r WHERE rank <= 5""")
def ret_vocab_search(s, d):
    v = _symbols(s, d).select("repo_id", "symbol_id", F.explode(text.vocabulary_tokens("symbol_name")).alias("token")).distinct()
    q = v.filter("symbol_id % 20 = 0").withColumnRenamed("symbol_id", "query_id")
    h = q.join(v, ["repo_id", "token"]).filter("symbol_id <> query_id").groupBy("query_id", "symbol_id").agg(F.count("*").alias("n"))
    return retrieval.top_k(h, "query_id", "symbol_id", "n", 5)


_THESAURUS_SQL = """(VALUES ('auth', 'auth authenticate login jwt session token credentials password user'), ('authentication', 'auth authenticate login jwt session token credentials password user'), ('login', 'login authenticate credentials password session token auth'),
  ('predict', 'predict prediction predictor model inference forecast regression pipeline'), ('prediction', 'predict prediction predictor model inference forecast regression pipeline'), ('logo', 'logo icon brand favicon banner mark asset image png svg'),
  ('asset', 'asset logo icon image static public resource svg png'), ('favicon', 'favicon icon logo'), ('server', 'server express listen port host http app routes'), ('entry', 'entry main index app __main__ start run'),
  ('database', 'database db sql sqlite postgres postgresql mongo redis datasource connection'), ('db', 'database db sql sqlite postgres datasource connection'), ('redis', 'redis redis_client redis_url redis_host cache_redis'), ('install', 'install installation setup requirements package.json pip'),
  ('test', 'test tests spec __tests__ pytest unittest assert describe it'), ('tests', 'test tests spec __tests__ pytest unittest assert'), ('error', 'error exception catch raise throw fail failure handler try'), ('exception', 'exception error catch raise throw handler')) AS th(k, v)"""


@query(f"""WITH {SYMBOLS}, en AS (SELECT DISTINCT array_to_string({_VOC.format('symbol_name')}, ' ') AS entity FROM symbols), wd AS (SELECT entity, unnest(list_filter(string_split(lower(entity), ' '), lambda t: length(t) > 2)) AS w FROM en),
  ws AS (SELECT entity, w FROM wd UNION SELECT entity, {_SINGULAR_SQL} FROM wd), sp AS (SELECT entity, lower(entity) AS w FROM en)
  SELECT entity, entity AS keyword FROM en WHERE entity <> '' UNION SELECT entity, lower(entity) FROM en WHERE entity <> '' UNION SELECT entity, {_SINGULAR_SQL} FROM sp WHERE entity <> '' UNION SELECT entity, replace(w, ' ', '_') FROM sp WHERE entity <> '' UNION SELECT entity, replace(w, ' ', '-') FROM sp WHERE entity <> ''
  UNION SELECT entity, w FROM ws UNION SELECT entity, unnest(string_split(v, ' ')) FROM sp JOIN {_THESAURUS_SQL} ON contains(w, k) OR contains(k, w) WHERE entity <> ''""")
def ret_keywords(s, d):
    """Keywords for the spaced name of every symbol."""
    return retrieval.keywords(_symbols(s, d).select(text.spaced_words("symbol_name").alias("entity")).distinct(), "entity")


@query(f"""WITH {SYMBOLS}, {_CHUNK_POOLS} SELECT query_id, chunk_id, rank, concat_ws('; ', CASE WHEN semantic > 0 THEN concat('semantic ', round(semantic * 100)::INT, '%') END, CASE WHEN lexical > 0 THEN concat('lexical ', round(lexical * 100)::INT, '%') END, CASE WHEN structural > 0 THEN 'known definition' END,
  CASE WHEN symbol_score > 0 THEN 'symbol match' END, CASE WHEN path_score > 0 THEN 'path match' END) AS explanation FROM rk JOIN ca USING (query_id, chunk_id) WHERE preset = 'hybrid' AND rank <= 5""")
def ret_explanations(s, d):
    """Why each chunk of ``ret_chunk_hybrid`` was found."""
    return retrieval.by_query(retrieval.explain(retrieval.fuse_chunks(_chunk_candidates(s, d), ["hybrid"], scores=True)), _chunk_queries(s, d))


@query(f"""WITH {SYMBOLS}, vt AS (SELECT repo_id, symbol_id, lower(symbol_name) AS raw, CASE symbol_kind WHEN 'class' THEN 1e0 WHEN 'function' THEN 0.95e0 WHEN 'route' THEN 0.95e0 ELSE 0.85e0 END AS w, list_distinct({_VOC.format('symbol_name')}) AS words FROM symbols),
  en AS (SELECT repo_id, symbol_id, raw AS token, w * 1.2e0 AS weight FROM vt WHERE length(raw) >= 2 UNION ALL SELECT repo_id, symbol_id, t, w FROM (SELECT *, unnest(words) AS t FROM vt) WHERE t <> raw AND length(t) >= 2),
  qt AS (SELECT symbol_id AS query_id, repo_id, unnest(tl) AS token, generate_subscripts(tl, 1) AS token_no FROM (SELECT *, {_VOC.format('symbol_name')} AS tl FROM symbols WHERE symbol_id % 20 = 0)), qd AS (SELECT query_id, repo_id, token, min(token_no) AS token_no FROM qt GROUP BY 1, 2, 3),
  hi AS (SELECT query_id, token_no, CASE WHEN q.token = e.token THEN 0 ELSE 1 END AS phase, e.symbol_id, weight, e.token AS met FROM qd q JOIN en e ON e.repo_id = q.repo_id AND (e.token = q.token OR (length(q.token) >= 4 AND (starts_with(e.token, q.token) OR starts_with(q.token, e.token))))),
  nu AS (SELECT *, row_number() OVER (PARTITION BY query_id, symbol_id ORDER BY token_no, phase, met) AS k FROM hi), sc AS (SELECT query_id, symbol_id, round(sum(weight * CASE WHEN phase = 1 THEN 0.7e0 WHEN k = 1 THEN 1e0 ELSE 1.5e0 END) + 1e-9, 6) AS score FROM nu GROUP BY 1, 2),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id)::INT AS rank FROM sc) SELECT query_id, symbol_id, score, rank FROM rk WHERE rank <= 5""")
def ret_vocab_weighted(s, d):
    """Symbols of the same repository for the words of every 20th symbol's name, exact and by prefix, weighed."""
    sy = _symbols(s, d)
    asked = sy.filter("symbol_id % 20 = 0").select(F.col("symbol_id").alias("query_id"), "repo_id", F.posexplode(text.vocabulary_tokens("symbol_name")).alias("token_no", "token"))
    return retrieval.vocabulary_search(retrieval.vocabulary(sy), asked)


@query(f"""WITH {_QUESTIONS}, {SYMBOLS}, c AS (SELECT qi.doc_id, s.symbol_id, CASE WHEN s.symbol_name = qi.entity THEN 1e0 ELSE 0.9e0 END + CASE WHEN s.symbol_kind = 'class' THEN 0.25e0 WHEN s.symbol_kind = 'function' THEN 0.2e0 ELSE 0e0 END AS confidence FROM qi JOIN symbols s ON lower(s.symbol_name) = lower(qi.entity)),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, symbol_id) AS k, lead(confidence) OVER (PARTITION BY doc_id ORDER BY confidence DESC, symbol_id) AS second FROM c)
  SELECT doc_id, symbol_id, round(confidence, 6) AS confidence, coalesce(confidence - second < 0.35e0, false) AS ambiguous FROM r WHERE k = 1""")
def ret_entity_resolution(s, d):
    q = route.questions_of(table(s, d, "documents")).withColumn("_n", F.lower("entity"))
    y = _symbols(s, d).select("symbol_id", "symbol_name", "symbol_kind", F.lower("symbol_name").alias("_n"))
    boost = F.when(F.col("symbol_kind") == "class", 0.25).when(F.col("symbol_kind") == "function", 0.2).otherwise(0.0)
    c = q.join(y, "_n").select("doc_id", "symbol_id", (F.when(F.col("symbol_name") == F.col("entity"), 1.0).otherwise(0.9) + boost).alias("confidence"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "symbol_id")
    r = c.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("confidence").over(w)).filter("k = 1")
    return r.select("doc_id", "symbol_id", F.round("confidence", 6).alias("confidence"), F.coalesce(F.col("confidence") - F.col("second") < 0.35, F.lit(False)).alias("ambiguous"))


@query(f"""WITH {CALLS}, u AS (SELECT concat(file_id, ':', line_no) AS evidence_id, 0.95e0 AS score FROM calls UNION ALL SELECT concat(file_id, ':', start_line), 1e0 FROM symbols) SELECT evidence_id, max(score) AS score, count(*) AS n_sources FROM u GROUP BY 1""")
def agg_evidence_merge(s, d):
    key = lambda line: F.concat(F.col("file_id").cast("string"), F.lit(":"), F.col(line).cast("string"))
    u = _calls(s, d).select(key("line_no").alias("evidence_id"), F.lit(0.95).alias("score")).unionByName(_symbols(s, d).select(key("start_line").alias("evidence_id"), F.lit(1.0).alias("score")))
    return u.groupBy("evidence_id").agg(F.max("score").alias("score"), F.count("*").alias("n_sources"))


@query(f"""WITH {SYMBOLS}, {_META}, c AS (SELECT repo_id, count(*) AS n FROM symbols GROUP BY 1), k AS (SELECT repo_id, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY 1), b AS (SELECT repo_id, sum(byte_size)::BIGINT AS bytes FROM m GROUP BY 1)
  SELECT repo_id, coalesce(bytes, 0) + 512 * coalesce(k.n, 0) + 256 * coalesce(k.n, 0) + 128 * coalesce(c.n, 0) AS memory_bytes FROM b LEFT JOIN k USING (repo_id) LEFT JOIN c USING (repo_id)""")
def eval_index_metrics(s, d):
    c = _symbols(s, d).groupBy("repo_id").agg(F.count("*").alias("symbols"))
    k = table(s, d, "chunks").groupBy("repo_id").agg(F.countDistinct("chunk_id").alias("chunks"))
    b = _meta(s, d).groupBy("repo_id").agg(F.sum("byte_size").alias("bytes"))
    j = b.join(k, "repo_id", "left").join(c, "repo_id", "left").fillna(0, ["bytes", "chunks", "symbols"])
    return j.select("repo_id", (F.col("bytes") + F.col("chunks") * 768 + F.col("symbols") * 128).alias("memory_bytes"))


@query(f"""WITH {FILES}, e AS (SELECT lower(symbol_name) AS name FROM km_symbols), a AS (SELECT DISTINCT lower(config_key) AS name FROM km_configs) SELECT name FROM a EXCEPT SELECT name FROM e""")
def set_keys_except_symbols(s, d):
    a = table(s, d, "km_configs").select(F.lower("config_key").alias("name")).distinct()
    return a.exceptAll(a.join(table(s, d, "km_symbols").select(F.lower("symbol_name").alias("name")).distinct(), "name", "left_semi"))


@query(f"""WITH {SYMBOLS}, t AS (SELECT symbol_id, repo_id, symbol_kind, symbol_name FROM symbols WHERE symbol_kind = 'class'), i AS (SELECT repo_id, symbol_name FROM symbols WHERE symbol_kind = 'interface' OR symbol_kind = 'class'),
  n AS (SELECT repo_id, symbol_name, count(*) AS n FROM i GROUP BY 1, 2) SELECT t.symbol_id, n.n AS same_name FROM t JOIN n USING (repo_id, symbol_name)""")
def agg_same_name(s, d):
    y = _symbols(s, d)
    n = y.filter("symbol_kind in ('class', 'interface')").groupBy("repo_id", "symbol_name").agg(F.count("*").alias("same_name"))
    return y.filter("symbol_kind = 'class'").join(n, ["repo_id", "symbol_name"]).select("symbol_id", "same_name")


# -------------------------------------------------------------------------------------------- streaming


@query("SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 2) AS total_value FROM events GROUP BY 1, 2")
def str_windowed_counts(s, d):
    return update.windowed_counts(table(s, d, "events"))


@query(f"""WITH {FILES} SELECT file_id, len(file_lines)::INT AS n_lines FROM files""")
def str_incremental_upsert(s, d):
    """The first deliveries as the table, all later ones as an update of it; the result equals the batch build."""
    k = table(s, d, "km_files").select("file_id", "ingested_at", "line_count", F.size("file_lines").alias("n_lines"))
    order = F.struct("ingested_at", "line_count")
    first = k.groupBy("file_id").agg(F.min_by("n_lines", order).alias("n_lines"))
    again = k.groupBy("file_id").agg(F.count("*").alias("c"), F.max_by("n_lines", order).alias("n_lines")).filter("c > 1").drop("c")
    return update.upsert(first, again, "file_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
