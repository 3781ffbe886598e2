"""Problem 5: generated, minified, copied and data files, by a linear support-vector machine.

Features are hashed character n-grams of the whole text with leading comment headers masked, hashed path components with giveaway
name parts masked, measures of shape, and how long a run of lines a known library has too.  Weak labels come from what the features do
not see - what tools and libraries write into headers, giveaway name parts - and from origin: long runs of a library's lines, a folder
that bears a library's name.  Shape never makes a label.  Training uses a bounded sample of labelled rows of the training repositories;
validation uses the headers of other repositories; prediction covers every file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.llm import corpus

LANGUAGES = ["python", "javascript", "typescript", "go", "java", "css"]
GRAM_BITS, PATH_BITS = 12, 11
SHAPES = ("longest line", "mean line", "blanks", "commonest template", "templates", "literals", "library run")
WIDTH = (1 << GRAM_BITS) + (1 << PATH_BITS) + len(SHAPES)
RUN = 6  # matching windows of WINDOW lines in a row that make a copy
WINDOW = 4
MAX_SAMPLE = 4000  # expected number of labelled rows that the machine is fitted on
MAX_LIBRARY_LINES = 2_000_000

_LEAD = re.compile(r"\A(?:﻿)?(?:\s*(?://[^\n]*|#[^\n]*|/\*.*?\*/|--[^\n]*)(?:\n|\Z)|\s*\n)+", re.S)
# Fixed patterns: what tools write into the headers of their output.
_MARK = re.compile(
    r"""code\s+generated\s+by|do\s+not\s+(?:edit|modify)\b|auto-?generated|automatically\s+generated|@generated\s+by|generated\s+(?:by|from)\s+\S+
    |regenerate\s+with|hand\s+edits\s+are|produced\s+by\s+\S+\s+[\d.]+|produit\s+par|ne\s+pas\s+modifier|automatisch\s+(?:erzeugt|generiert)|nicht\s+bearbeiten|generado\s+por|no\s+(?:editar|modificar)
    |^\W*source:\s+\S+\.(?:proto|idl|g4|xsd|thrift)""",
    re.X | re.I | re.M,
)
# Fixed patterns: parts of file names that builds and tools add; the features see only the extension.
_GIVEAWAY = re.compile(r"\.min\.\w+$|_pb2\.py$|\.pb\.go$|\.(?:gen|generated)\.\w+$|_(?:generated|data|assets|table)\.\w+$")
_DECOY = re.compile(r"@generated\s+markers|generated\s+reports|removed\s+in\s+favou?r", re.I)
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[A-Za-z_$]+")
_STRING = re.compile(r""""[^"\n]*"|'[^'\n]*'|`[^`\n]*`""")


class Library:
    """Lines and windows of lines of known third-party files, and the libraries' names."""

    def __init__(self, files: list[list[str]], names: list[str]):
        self.windows: set[tuple[str, ...]] = set()
        self.lines: set[str] = set()
        for lines in files:
            kept = self.clean(lines)
            self.lines.update(kept)
            self.windows.update(tuple(kept[i : i + WINDOW]) for i in range(len(kept) - WINDOW + 1))
        found = "|".join(sorted({re.escape(n.lower()) for n in names if n})) or r"(?!)"
        self.notice = re.compile(rf"(?:^|\W)(?:{found})\W{{1,3}}v?\d+\.\d+", re.I)
        self.folder = re.compile(rf"(?:^|/)(?:{found})(?:[^a-z_/][^/]*)?/")

    @staticmethod
    def clean(lines: list[str]) -> list[str]:
        return [x for x in map(str.strip, lines) if len(x) > 2]

    def longest_run(self, lines: list[str]) -> int:
        """The most windows of lines in a row that a library file has too."""
        kept = self.clean(lines)
        known = [x in self.lines for x in kept]
        best = run = 0
        for i in range(len(kept) - WINDOW + 1):
            if known[i] and known[i + WINDOW - 1] and tuple(kept[i : i + WINDOW]) in self.windows:
                run += 1
                best = max(best, run)
            else:
                run = 0
        return best


def _hash(part: str) -> int:
    h = 0
    for c in part.encode():
        h = (h * 33 + c) & 0xFFFFFFFF
    return (h * 2654435761 & 0xFFFFFFFF) // (1 << (32 - PATH_BITS))


def describe(path: str, text: str, library: Library, labelled: bool = True) -> tuple[np.ndarray, int | None, bool]:
    """Feature vector, weak label (1 not written by hand, 0 written by hand, None unclear) and whether the header says so, of one file.
    Labels are looked for only if ``labelled``."""
    path = (path or "").lower()
    lead = _LEAD.match(text)
    header, body = (lead.group(), text[lead.end() :]) if lead else ("", text)
    x = np.zeros(WIDTH, dtype=np.float64)
    masked = _DIGITS.sub("0", body)
    raw = np.frombuffer(masked.encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(raw) >= 4:
        grams = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        counts = np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS), minlength=1 << GRAM_BITS)
        got = np.log1p(counts)
        x[: 1 << GRAM_BITS] = got / (np.sqrt((got * got).sum()) or 1.0)
    folders, name = path.split("/")[:-1], path.rsplit("/", 1)[-1]
    for part in {*folders, *map("/".join, zip(folders, folders[1:])), "." + name.rsplit(".", 1)[-1]}:
        x[(1 << GRAM_BITS) + _hash(part)] = 0.25
    full = [y for y in map(str.strip, body.split("\n")) if y]
    n = max(1, len(full))
    longest, mean = max(map(len, full), default=0), len(body) / n
    shapes: dict[str, int] = {}
    for y in _NAME.sub("w", _STRING.sub("s", masked)).split("\n"):
        y = y.strip()
        if y:
            shapes[y] = shapes.get(y, 0) + 1
    templates, top = len(shapes) / n, max((c for y, c in shapes.items() if len(y) > 2), default=0) / n
    bare = _STRING.sub("", body)
    kinds = np.bincount(np.frombuffer(bare.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    blank = int(kinds[9:14].sum() + kinds[32])
    inside = len(body) - len(bare) + int(kinds[48:58].sum() + kinds[46])
    literal = inside / max(1, len(body) - blank - int(kinds[44] + kinds[43] + kinds[45]))
    spaces = blank / max(1, len(body))
    run = library.longest_run(text.split("\n"))
    sized = min(1.0, n / 20)  # shares of a few lines say little
    x[WIDTH - len(SHAPES) :] = (min(1.5, longest / 300), min(1.5, mean / 80), max(0.0, 1 - spaces / 0.12) * min(1.0, len(body) / 200), top * sized, max(0.0, 1 - templates / 0.12) * sized, max(0.0, literal - 0.4) * 2 * min(1.0, n / 4), min(1.5, run / RUN))
    if not labelled:
        return x, None, False
    marked = bool(header and _MARK.search(header)) and not _DECOY.search(header)
    noticed = bool(header and library.notice.search(header))
    if marked or run >= RUN or library.folder.search(path) or _GIVEAWAY.search(name):
        return x, 1, marked
    doubtful = noticed or _MARK.search(text) or longest > 300 or literal > 0.6 or templates < 0.08 and n > 12
    return x, None if doubtful else 0, marked


def _library(library_files: DataFrame) -> Library:
    rows = library_files.select("lib_name", "file_lines").filter("file_lines is not null")
    size = rows.agg(F.sum(F.size("file_lines"))).first()[0] or 0
    if size > MAX_LIBRARY_LINES:
        raise ValueError(f"the library files have {size} lines, more than the {MAX_LIBRARY_LINES} that a task may hold")
    got = rows.collect()
    return Library([[y or "" for y in r.file_lines] for r in got], [r.lib_name for r in got])


def _part(seed: int, held_out: int):
    """The part of its repository; part 0 is held out."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce("repo_id", F.lit(-1))), F.lit(held_out))


def sample_of(files: DataFrame, metadata: DataFrame, seed: int = 7, held_out: int = 5, sample: int = MAX_SAMPLE) -> DataFrame:
    """The rows of the file table that are drawn for training: about ``sample`` files of the repositories outside of part 0, by a hash of
    their ids.  The share is told by the metadata, so that no text is read or moved for it."""
    known = metadata.filter(corpus.language_of().isin(LANGUAGES) & (_part(seed, held_out) > 0)).count()
    drawn = F.pmod(F.xxhash64(F.lit(seed), "file_id"), F.lit(1_000_000)) < int(min(1.0, sample / max(1, known)) * 1_000_000)
    return files.filter(drawn & (_part(seed, held_out) > 0))


def train(chosen: DataFrame, library_files: DataFrame):
    """(weights, bias) of a machine fitted on the weakly labelled ones of the files drawn; None where one of the labels does not occur."""
    library = _library(library_files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for p, t in zip(b["file_path"], b["text"]):
                x, y, _ = describe(p, t, library)
                if y is not None:
                    got.append((y, i := np.flatnonzero(x), x[i]))
            yield pd.DataFrame(got, columns=["label", "i", "v"]).astype({"label": "int32"})

    sparse = F.udf(lambda i, v: Vectors.sparse(WIDTH, i, v), VectorUDT())  # the rows of the bounded sample only
    rows = chosen.select("file_path", "text").mapInPandas(run, "label int, i array<int>, v array<double>").select("label", sparse("i", "v").alias("features")).cache()
    try:
        found = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(found) < 2:
            return None
        weighted = rows.withColumn("w", F.when(F.col("label") == 1, F.lit(found[0] / found[1]) ** 0.5).otherwise(F.lit(1.0)))
        model = LinearSVC(maxIter=25, tol=1e-4, regParam=2e-4, standardization=False, weightCol="w").fit(weighted)
        return np.array(model.coefficients.toArray()), float(model.intercept)
    finally:
        rows.unpersist()


def score(files: DataFrame, library_files: DataFrame, model, labelled: bool = True) -> DataFrame:
    """file_id, repo_id, margin and, if ``labelled``, weak_label and header_says of every file; positive margins are files that were not
    written by hand."""
    library = _library(library_files)
    weights, bias = model if model is not None else (np.zeros(WIDTH), -1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for f, r, p, t in zip(b["file_id"], b["repo_id"], b["file_path"], b["text"]):
                x, y, says = describe(p, t, library, labelled)
                got.append((f, r, float(x @ weights) + bias, y, says))
            yield pd.DataFrame(got, columns=["file_id", "repo_id", "margin", "weak_label", "header_says"]).astype({"weak_label": "Int32"})

    return files.select("file_id", "repo_id", "file_path", "text").mapInPandas(run, "file_id long, repo_id long, margin double, weak_label int, header_says boolean")


def validate(scored: DataFrame, seed: int = 7, held_out: int = 5) -> DataFrame:
    """On the held-out repositories: recall of the files whose header says that a tool wrote them, which no feature sees, and
    the share of the files that are flagged although nothing gives them away."""
    hit, is_one = F.col("margin") > 0, F.col("header_says")
    plain = F.coalesce(F.col("weak_label") == 0, F.lit(False))
    share = lambda a, b: F.count_if(a & b) / F.nullif(F.count_if(b), F.lit(0))
    return scored.filter(_part(seed, held_out) == 0).agg(
        F.count("*").alias("files"), F.count_if(is_one).alias("header_says"), share(hit, is_one).alias("header_recall"), F.count_if(plain).alias("plain"), share(hit, plain).alias("plain_flagged")
    )


def not_handwritten(files: DataFrame, chosen: DataFrame, library_files: DataFrame) -> DataFrame:
    """file_id and margin of the files that were not written by hand; ``files`` and ``chosen``, those of them to train with, as of
    ``corpus.files_with_language``.

    Empty files and files of null text are hand-written.  Where the sample shows only one label nothing can be learned, and no
    file is flagged."""
    return score(files, library_files, train(chosen, library_files), False).filter("margin > 0").select("file_id", "margin")
