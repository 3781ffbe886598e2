"""Languages, categories and roles of files as ordered CASE expressions and a small registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Language, category, extensions, marks of line comments, marks of block comments.
LANGUAGES = [
    ("Python", "source", ["py", "pyi", "pyw"], ["#"], [('"""', '"""'), ("'''", "'''")]),
    ("TypeScript", "source", ["ts"], ["//"], [("/*", "*/")]),
    ("TSX", "source", ["tsx"], ["//"], [("/*", "*/"), ("{/*", "*/}")]),
    ("JavaScript", "source", ["js", "mjs", "cjs", "jsx"], ["//"], [("/*", "*/")]),
    ("Java", "source", ["java"], ["//"], [("/*", "*/")]),
    ("C", "source", ["c", "h"], ["//"], [("/*", "*/")]),
    ("C++", "source", ["cpp", "cc", "cxx", "hpp", "hh"], ["//"], [("/*", "*/")]),
    ("C#", "source", ["cs"], ["//"], [("/*", "*/")]),
    ("Go", "source", ["go"], ["//"], [("/*", "*/")]),
    ("Rust", "source", ["rs"], ["//"], [("/*", "*/")]),
    ("HTML", "source", ["html", "htm"], [], [("<!--", "-->")]),
    ("CSS", "source", ["css"], [], [("/*", "*/")]),
    ("SCSS", "source", ["scss", "sass"], ["//"], [("/*", "*/")]),
    ("SQL", "source", ["sql"], ["--"], [("/*", "*/")]),
    ("Shell", "source", ["sh", "bash", "zsh"], ["#"], []),
    ("CSV", "data", ["csv", "tsv"], [], []),
    ("Jupyter Notebook", "data", ["ipynb"], [], []),
    ("Markdown", "documentation", ["md", "markdown"], [], []),
    ("YAML", "configuration", ["yaml", "yml"], ["#"], []),
    ("JSON", "configuration", ["json"], [], []),
    ("XML", "configuration", ["xml", "svg"], [], [("<!--", "-->")]),
]
# Directories, extensions and file names that ingestion leaves out, extensions that it reads, and those of binary files.
IGNORED = [".git", ".github", "node_modules", "__pycache__", ".venv", "venv", "env", ".env", "dist", "build", "coverage", ".pytest_cache", ".mypy_cache", ".tox", ".idea", ".vscode", ".cache", "eggs", ".eggs"]
IGNORED_EXTENSIONS = (
    "pyc pyo pyd so dll dylib exe bin png jpg jpeg gif ico webp bmp tiff mp4 webm mov mp3 wav ogg zip tar gz bz2 xz 7z rar whl woff woff2 ttf otf eot db sqlite sqlite3 pdf parquet pickle pkl"
).split()
IGNORED_NAMES = [".DS_Store", "Thumbs.db"]
READABLE = "py pyi pyw ts tsx js mjs cjs jsx java c h cpp cc cxx hpp hh cs go rs html htm css scss sass sql sh bash zsh json yaml yml xml svg toml ini cfg txt md markdown csv tsv ipynb dockerfile".split()
BINARY = "png jpg jpeg gif ico webp pdf zip tar gz exe dll so dylib bin pyc pyo pyd db sqlite woff woff2 ttf eot wasm parquet feather".split()
REGISTRY = [(e, language, category) for language, category, extensions, _, _ in LANGUAGES for e in extensions]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "ext string, language string, category string")


def comment_marks(spark: SparkSession) -> DataFrame:
    """The registry with the marks of comments, as :func:`detect_language` joins it."""
    rows = [(e, language, category, marks, [{"opens": a, "closes": b} for a, b in pairs]) for language, category, extensions, marks, pairs in LANGUAGES for e in extensions]
    return spark.createDataFrame(rows, "ext string, language string, category string, line_marks array<string>, block_marks array<struct<opens:string,closes:string>>")


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def extension(path: str) -> Column:
    """Extension of the last path segment in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def safe_path(path: str) -> Column:
    """The path with empty and '.' segments removed, or null where it is empty, absolute, holds a NUL or climbs out."""
    c = F.col(path)
    parts = F.split(F.regexp_replace(c, r"\\", "/"), "/")
    bad = (F.length(F.trim(c)) == 0) | c.contains("\u0000") | c.rlike("^([A-Za-z]:)?[/\\\\]") | F.exists(parts, lambda s: s == "..")
    clean = F.array_join(F.filter(parts, lambda s: (s != "") & (s != ".")), "/")
    return F.when(c.isNotNull() & ~bad, clean)


def file_extension(path: str) -> Column:
    """:func:`extension`, but empty for a name that begins with its only dot, such as .env."""
    return F.lower(F.regexp_extract(basename(F.regexp_replace(path, r"\\\\", "/")), r"^.+\.([^.]*)$", 1))


def is_ignored(path: str) -> Column:
    """Whether ingestion leaves the file out: by a directory of its path (not the last segment), its name or its extension."""
    parts = F.split(F.lower(F.col(path)), "/")
    folder = F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in IGNORED]))
    return folder | basename(path).isin(IGNORED_NAMES) | basename(path).startswith("._") | file_extension(path).isin(IGNORED_EXTENSIONS)


def is_readable(path: str) -> Column:
    return file_extension(path).isin(READABLE) | (F.lower(basename(path)) == "dockerfile")


def detect_language(path: str, names: DataFrame, files: DataFrame) -> DataFrame:
    """``files`` with detected, category and is_binary by a join with the registry; JSON files in data directories or with a data
    suffix are data; unknown extensions are Text, those of binary files Binary."""
    joined = files.withColumn("_ext", file_extension(path)).join(names.withColumnRenamed("ext", "_ext"), "_ext", "left")
    docker = F.lower(basename(path)) == "dockerfile"
    data = (F.col("_ext") == "json") & F.col(path).rlike(r"/(?:data|datasets|records)/|\.(?:dataset|records)\.json$")
    binary = F.col("_ext").isin(BINARY)
    unknown = F.when(binary, "binary").otherwise("unknown")
    return joined.select(
        files["*"],
        *([F.when(docker, F.array(F.lit("#"))).otherwise(F.col("line_marks")).alias("line_marks"), "block_marks"] if "line_marks" in names.columns else []),
        F.when(docker, "Dockerfile").otherwise(F.coalesce("language", F.when(binary, "Binary").otherwise("Text"))).alias("detected"),
        F.when(docker, "configuration").when(data, "data").otherwise(F.coalesce("category", unknown)).alias("category"),
        binary.alias("is_binary"),
    )


def knowledge_type(path: str) -> Column:
    """asset, test, config, documentation, data, entry_point or source: the first rule that holds."""
    p, e = F.lower(F.col(path)), extension(path)
    return (
        F.when(e.isin("png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf"), "asset")
        .when(p.rlike(r"(^|/)(tests?|__tests__|spec)/|(^|/)test_|_test\.|\.test\.|\.spec\."), "test")
        .when(e.isin("json", "yaml", "yml", "toml", "env", "ini", "cfg") | p.endswith("dockerfile"), "config")
        .when(e.isin("md", "rst", "txt"), "documentation")
        .when(e.isin("csv", "tsv", "parquet"), "data")
        .when(p.rlike(r"(^|/)(main|index|app|server|cli)\.[a-z]+$"), "entry_point")
        .otherwise("source")
    )


def modal_flags(path: str) -> list[Column]:
    """Flags of the cross-modal index: assets, docs and configs exclude each other; tests, entry points and sources may overlap."""
    kind = knowledge_type(path)
    p = F.lower(F.col(path))
    return [
        (kind == "asset").alias("is_asset"), (kind == "documentation").alias("is_doc"), (kind == "config").alias("is_config"),
        p.rlike(r"(^|/)tests?/|_test\.|\.test\.").alias("is_test"), p.rlike(r"(^|/)(main|index|app|server|cli)\.[a-z]+$").alias("is_entry_point"),
        extension(path).isin("py", "js", "ts", "java", "go").alias("is_source"),
    ]


def asset_category(path: str) -> Column:
    e = extension(path)
    return F.when(e == "ico", "icon").when(e.isin("png", "jpg", "jpeg", "gif", "svg", "webp"), "image").when(e.isin("woff", "woff2", "ttf", "otf"), "font").otherwise("other")
