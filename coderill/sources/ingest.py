"""Loaders of repositories and benchmarks, and sinks of reports."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coderill.functions import detect

FILES = "archive string, ord int, file_path string, byte_size long, file_lines array<string>, problem string"


def read_zip(spark: SparkSession, paths: str | list[str], most_file_bytes: int = 5 << 20) -> DataFrame:
    """Text files of ZIP archives: a folder that all entries share is taken off, ignored and unsafe paths are left out, line ends become
    newlines.  One row a file; archives are spread over tasks.  :func:`rejected_entries` tells what could not be read."""
    safe = _unpacked(spark, paths, most_file_bytes).filter("problem is null").drop("problem").withColumn("file_path", detect.safe_path("file_path")).filter("file_path is not null")
    return safe.filter(~detect.is_ignored("file_path") & detect.is_readable("file_path"))


def rejected_entries(spark: SparkSession, paths: str | list[str], most_file_bytes: int = 5 << 20) -> DataFrame:
    """What :func:`read_zip` gives no row for although its name is that of a text file: archive, file_path, byte_size, problem (too large,
    binary, unsafe path, or broken archive, without a path)."""
    rows = _unpacked(spark, paths, most_file_bytes)
    unsafe = F.when(F.col("file_path").isNotNull() & detect.safe_path("file_path").isNull(), "unsafe path")
    told = rows.select("archive", "file_path", "byte_size", F.coalesce("problem", unsafe).alias("problem")).filter("problem is not null")
    return told.filter(F.col("file_path").isNull() | ~detect.is_ignored("file_path") & detect.is_readable("file_path"))


def _unpacked(spark: SparkSession, paths: str | list[str], most_file_bytes: int) -> DataFrame:
    """Every entry of the archives with its lines, or with the reason why it has none."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        entries = [e for e in z.infolist() if not e.is_dir()]
                        roots = {e.filename.split("/")[0] if "/" in e.filename else "" for e in entries}
                        cut = len(next(iter(roots))) + 1 if len(roots) == 1 and "" not in roots else 0
                        for i, e in enumerate(entries):
                            data = z.read(e) if e.file_size <= most_file_bytes else None
                            problem = "too large" if data is None else "binary" if b"\0" in data else None
                            lines = None if problem else data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").split("\n")
                            rows.append((name, i, e.filename[cut:], e.file_size, lines, problem))
                except (zipfile.BadZipFile, zlib.error, EOFError):
                    rows.append((name, None, None, None, None, "broken archive"))
                yield pd.DataFrame(rows, columns=["archive", "ord", "file_path", "byte_size", "file_lines", "problem"]).astype({"ord": "Int32", "byte_size": "Int64"})

    raw = spark.read.format("binaryFile").load(paths).select("path", "content")
    return raw.mapInPandas(unpack, FILES)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Text files below a folder with their path relative to it."""
    raw = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.input_file_name().alias("p"), F.col("value"))
    path = F.regexp_replace("p", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    lines = F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")
    return raw.select(path.alias("file_path"), F.octet_length("value").cast("long").alias("byte_size"), lines.alias("file_lines")).filter(~detect.is_ignored("file_path") & detect.is_readable("file_path"))


BENCHMARK = "id string, query string, problem string, question string, expected_symbols array<string>, expected_count int, query_type string, category string"


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark questions from JSON lines or a JSON array, with the text under any of its usual keys."""
    raw = spark.read.schema(BENCHMARK).option("multiLine", "true").json(path)
    return raw.select("id", F.coalesce("query", "problem", "question").alias("query"), "expected_symbols", "expected_count", F.coalesce("query_type", "category", F.lit("general")).alias("query_type")).filter("query is not null")


def parse_repository_url(url: str):
    """Owner and name in a repository address as a struct; nulls where it is none."""
    pattern = r"^(?:https?://)?(?:www\.)?[\w.-]+/([\w.-]+)/([\w.-]+?)(?:\.git)?(?:/.*)?$"
    get = lambda n: F.nullif(F.regexp_extract(url, pattern, n), F.lit(""))
    return F.struct(get(1).alias("owner"), get(2).alias("name"))


def write_json_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def markdown_report(report: DataFrame, title: str, order: list[str], most: int = 10_000) -> str:
    """A Markdown table of a small report; one of more than ``most`` rows is refused rather than cut, and belongs into
    :func:`write_json_report`."""
    rows = report.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the report has more than {most} rows")
    head = ["| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    return "\n".join([f"# {title}", "", *head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows), ""])
