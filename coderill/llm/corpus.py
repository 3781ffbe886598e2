"""The files of a corpus with their language, one row each, as the operators on whole files need them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Extension to language.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript",
    "go": "go", "java": "java", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml",
}


def language_of(language: str = "detected_language", path: str = "file_path"):
    """The language in lower case; that of the extension where it is null or blank."""
    names = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.when(F.trim(language) != "", F.lower(F.trim(language))), F.try_element_at(names, ext))


def files_with_language(files: DataFrame, metadata: DataFrame, languages: list[str]) -> DataFrame:
    """file_id, repo_id, file_path, language and text of every file in one of ``languages``, the last delivery of each.

    Files without a row in the metadata get the language of their extension; a null list of lines is no file, null lines
    count as empty.  The language join uses the small metadata rows; lines are shuffled once, by file_id."""
    told = metadata.groupBy("file_id").agg(F.max_by("detected_language", "ingested_at").alias("detected_language"))
    lines = files.filter("file_lines is not null and file_id is not null").select("file_id", "repo_id", "file_path", F.array_join("file_lines", "\n", "").alias("text"), "ingested_at")
    one = lines.groupBy("file_id").agg(F.max_by(F.struct("repo_id", "file_path", "text"), "ingested_at").alias("f")).select("file_id", "f.*")
    return one.join(told, "file_id", "left").withColumn("language", language_of()).filter(F.col("language").isin(languages)).select("file_id", "repo_id", "file_path", "language", "text")
