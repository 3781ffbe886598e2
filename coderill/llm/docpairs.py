"""Problem 4: functions and methods paired with their documentation.

One recursive pattern per language family captures comment, signature and balanced body of a symbol together; strings,
comments and regular-expression literals are matched as units, so brackets inside them do not count.  Documentation is the
docstring column; where that is blank the literal that opens the body, or else the comment directly above the symbol.
Symbols that bring a docstring never touch the file table; for the others each file is walked once, with the lines on which they start,
and gives the comments that end right above them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BRACES = regex.compile(
    r"""(?(DEFINE)
      (?P<str>"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`)
      (?P<rem>//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)
      (?P<rex>(?<=[(=,:\[!&|?]\s?)/(?![*/])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/)
      (?P<round>\((?:[^()"'`/]++|(?&str)|(?&rem)|(?&rex)|/|(?&round))*+\))
      (?P<curly>\{(?:[^{}"'`/]++|(?&str)|(?&rem)|(?&rex)|/|["'`]|(?&curly))*+\})
    )
    (?P<comment>(?:[ \t]*+(?://[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)[ \t\r]*+\n)*+)
    (?P<sig>(?:[^{}()"'`/;]++|(?&str)|(?&rem)|(?&round)|/(?![/*])|\{(?=[^{}\n]*\}[^\n]*\{)[^{}\n]*+\})*?)
    (?P<body>(?&curly))""",
    regex.X | regex.S,
)
_INDENTED = regex.compile(
    r"""(?(DEFINE)
      (?P<text>(?i:[rbfu]{0,2})(?:\"\"\"(?:[^"\\]++|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]++|\\.|'(?!''))*+'''|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'))
      (?P<round>[(\[{](?:[^()\[\]{}"'#]++|(?&text)|\#[^\n]*+|(?&round))*+[)\]}])
    )
    (?P<comment>(?:[ \t]*+\#[^\n]*+\n)*+)
    (?P<sig>(?:[ \t]*+@[^\n(]++(?:(?&round))?[^\n]*+\n|[ \t]*+\#[^\n]*+\n)*+[ \t]*+(?:async[ \t]++)?(?:def|class)\b(?:[^()\[\]{}:"'#]++|(?&text)|(?&round))*+:)
    (?:[ \t]*+(?:\#[^\n]*+)?\n)*+[ \t]*+
    (?P<literal>(?&text)(?=[ \t]*+(?:[;#\r\n]|\Z)))?
    (?P<body>.*)""",
    regex.X | regex.S,
)

# Words that say nothing about a function by themselves.
FILLER = frozenset(
    """a an and are as at by do does for from function functions func def method methods class constructor procedure routine helper
    in into is it its of on or own so that the their then these this those to used using with takes take taking given
    gets get sets set returns return returned result results value values parameter parameters param params argument
    arguments arg args input inputs output outputs none null nil void object objects any str int list dict bool float string number
    boolean array tuple optional type types todo fixme xxx hack tbd wip undocumented description summary documentation docs doc
    docstring document documented n/a na see above below here write stub auto generated autogenerated default placeholder lorem ipsum
    missing empty untitled raises throws note calls""".split()
)
# Fixed patterns: lines that are no description of anything.
_USELESS = re.compile(
    r"""^\s*(?:
      (?:todo|fixme|xxx|hack|tbd|wip)\b.*                                  # placeholders with whatever is promised
    | (?:noqa|pylint|type|mypy|pyright|flake8|isort|fmt|yapf|ruff|pragma|eslint[-\w]*|ts-ignore|ts-expect-error|ts-nocheck|prettier-ignore|nolint[:\w,]*
        |istanbul|jshint|jslint|tslint|webpack\w*|go:\w+|@ts-\w+|\+build|checkstyle|noinspection|suppresswarnings|coverage)\b(?:\s*[:=/(\-].*|\s+(?:ignore|disable|off|on|next-line)\b.*|\s*)
    | @?(?:author|since|version|date|created|license|copyright|generated|inheritdoc|override|deprecated|internal|private|public|api|ignore|hidden)\b[:\s]*(?:[\w.@<>-]*)?(?:\s+@?(?:author|since|version|date)\b\s*[\w.@<>-]*)*\s*
    | @author\b.*
    | \{@?\w+\}
    | (?:auto-?generated|generated)\b.{0,40}\b(?:stub|by|from)\b.*
    | (?:created|written|added|modified|changed|updated|generated|author(?:ed)?)\b\s*(?:by|on|:).*
    | spdx-license-identifier\b.*
    | \(c\)\s.* | ©.* | copyright\b.* | .*\ball\ rights\ reserved\b.*
    | licen[sc]ed\s+under\b.* | permission\ is\ hereby\ granted.* | (?:under|see)\ the\ (?:terms|licen[cs]e).*
    | see\ (?:above|below|base\ class|parent|super\w*)\W* | same\ as\ (?:above|below)\W*
    | no\ (?:description|documentation|docs|comment)\b.{0,30}
    | [-=*\#~_+./\\<>|\s]{3,}.*[-=*\#~_+]{3,}\s* | [\W_]*
    )$""",
    re.X | re.I,
)
_TAG = re.compile(
    r"^\s*(?:[@\\:](?:param|arg|argument|type|rtype|return|returns|raises|throws|exception|keyword|tparam|typeparam|template)\b\s*(?:\{[^}]*\})?\s*(?:(?<=param)\s*|)(?:\[?[\w.$*]+\]?(?=\s|:|$))?:?"
    r"|(?:args|arguments|parameters|params|returns?|raises|yields|notes?|examples?|throws)\s*:?\s*$|[-=~]{3,}\s*$"
    r"|[\w*]+\s*:\s*(?:str|int|list|dict|bool|float|bytes|any|object|tuple|set|optional|string|number|boolean)\b(?:\[[^\]]*\])?\s*,?)",
    re.I,
)
_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!/)|//+[/!]?|#+!?|--|;+|<!--)[ \t]?|[ \t]*(?:\*+/|-->)[ \t]*$", re.M)
_CODE = re.compile(r"^\s*(?:[\w.\[\]]+\s*(?::?=|\+=)\s*\S.*|return\b\s*[\w.\[\]()]*\s*;?|[\w.]+\([^)]*\)\s*;?|(?:if|for|while|switch)\s*\(.*|(?:if|for|while|def|class|import|from)\s.*:?|[{}()\];,]+|(?:var|let|const|int|String)\s.*=.*|.*[;{}]\s*)$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_WIDE = re.compile(r"[฀-໿぀-ヿ㐀-鿿가-힯]")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_HTML = re.compile(r"</?[A-Za-z][^<>\n]*>")
_LITERAL = re.compile(r"^\s*(?i:[rbfu]{0,2})(\"\"\"|'''|\"|')(.*)\1\s*;?\s*$", re.S)


def _parts(name: str) -> set[str]:
    return {w.lower() for p in re.split(r"[\W_\d]+", name or "") for w in _CAMEL.split(p) if w}


def _stem(word: str) -> str:
    for end in ("ing", "ed", "es", "s", "e"):
        if word.endswith(end) and len(word) > len(end) + 2:
            return word[: -len(end)]
    return word


def describe(text: str) -> str:
    """The documentation without quotes, comment marks and mark-up, line by line."""
    text = (text or "").replace("\r", "")
    for _ in range(2):
        hit = _LITERAL.match(text)
        text = hit.group(2) if hit else text
    return _HTML.sub("", _MARKS.sub("", _MARKS.sub("", text)).replace('"""', "").replace("'''", "")).strip()


def is_trivial(text: str, name: str, params: list[str] | None) -> bool:
    """True where :func:`describe` of the text says nothing beyond the names of the function and its parameters."""
    lines = [line for line in describe(text).split("\n") if line.strip()]
    lines = [line for line in lines if not _USELESS.match(line.strip().strip("\"'`").strip())]
    if lines and all(_CODE.match(line) and " " in line.strip() or re.fullmatch(r"\s*[\w.]+\([^)]*\)[;:]?\s*", line) for line in lines):
        return True
    known = _parts(name) | {p for q in (params if params is not None else []) for p in _parts(q)}
    stems = {_stem(w) for w in known}
    rest = " ".join(_TAG.sub(" ", line) for line in lines)
    if len(_WIDE.findall(rest)) >= 4:
        return False
    tokens = re.findall(r"[\w’']+", rest)
    told = 0
    for token in tokens:
        words = {w.lower() for w in _WORD.findall(token)} if token.islower() else _parts(token)
        told += any(w not in FILLER and w not in known and _stem(w) not in stems and len(w) > 1 for w in words)
    return told < 2 and not (told == len(tokens) == 1 and len(tokens[0]) > 5)  # a lone word such as "Idempotent." says something


def comment_above(lines: list[str], start: int) -> str:
    """The comment that ends on the line before line ``start`` (from 1): a run of line comments or one block comment."""
    i = start - 2
    if i < 0 or i >= len(lines):
        return ""
    last = lines[i].strip()
    if last.endswith("*/"):
        j = i
        while j >= 0 and "/*" not in lines[j]:
            j -= 1
        return "\n".join(lines[max(j, 0) : i + 1]) if j >= 0 and lines[j].lstrip().startswith("/*") else ""
    mark = "#" if last.startswith("#") else "//" if last.startswith("//") else None
    j = i
    while mark and j >= 0 and lines[j].lstrip().startswith(mark):
        j -= 1
    return "\n".join(lines[j + 1 : i + 1]) if mark else ""


def capture(path: str, above: str, snippet: str) -> dict[str, str]:
    """Comment, signature, opening literal and balanced body of one symbol.  Where the pattern does not fit - a symbol without a body in
    braces, or broken code - the comment is what stands above, the signature the first line, and there is no body."""
    snippet = (snippet or "").replace("\r", "")
    text = (above + "\n" if above else "") + snippet
    pattern = _INDENTED if (path or "").lower().endswith((".py", ".pyi")) else _BRACES
    hit = pattern.match(text) if text else None
    if hit is None:
        return {"comment": above, "sig": snippet.strip().split("\n")[0], "literal": "", "body": ""}
    return {k: hit.group(k) or "" if k in hit.re.groupindex else "" for k in ("comment", "sig", "literal", "body")}


def _pairs(rows: list[tuple]) -> Iterator[tuple]:
    for symbol_id, file_id, path, name, params, docstring, snippet, ingested_at, above in rows:
        docstring = docstring or ""
        got = capture(path, "" if docstring.strip() else above or "", snippet)
        doc = docstring if docstring.strip() else got["literal"] or got["comment"]
        params = None if params is None else list(params)
        if doc.strip() and not is_trivial(doc, name or "", params):
            yield symbol_id, file_id, name, describe(doc), snippet, got["sig"].strip(), bool(got["body"]), ingested_at


_SCHEMA = "symbol_id long, file_id long, symbol_name string, description string, code string, signature string, is_balanced boolean"
_COLUMNS = ["symbol_id", "file_id", "file_path", "symbol_name", "param_names", "docstring", "snippet", "ingested_at"]


def _frame(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=[*(c.split()[0] for c in _SCHEMA.split(", ")), "ingested_at"])


def _make_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield _frame(list(_pairs(list(b.itertuples(index=False, name=None)))))


def _comments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """file_id, start_line and the comment right above it, of the lines asked for that have one; one walk through each file."""
    for b in batches:
        rows = []
        for file_id, text, starts in zip(b["file_id"], b["text"], b["starts"]):
            lines = [x.rstrip("\r") for x in text.split("\n")]
            rows += [(file_id, k, above) for k in starts if (above := comment_above(lines, k))]
        yield pd.DataFrame(rows, columns=["file_id", "start_line", "above"]).astype({"start_line": "int32"})


def pair_functions(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Code and description of every function and method whose documentation is not trivial, one row per symbol_id.

    Rows with a null symbol_id, name, path, snippet or start line are judged by what is left of them; a null file_id or
    a file without lines means that only the docstring and the body's literal count.  Of the documented deliveries of a symbol the last
    counts.  Symbols of other kinds, and blank documentation, give none."""
    at = symbols.schema["ingested_at"].dataType.simpleString()
    s = symbols.filter(F.col("symbol_kind").isin("function", "method")).select(*_COLUMNS, "start_line")
    blank = ~F.coalesce(F.col("docstring"), F.lit("")).rlike(r"\S")
    joins = F.coalesce(blank & F.col("file_id").isNotNull() & (F.col("start_line") > 1), F.lit(False))
    told = s.filter(~joins).select(*_COLUMNS, F.lit(None).cast("string").alias("above"))
    # no more distinct start lines than a file has lines, however many symbols stand on them
    asked = s.filter(joins).groupBy("file_id").agg(F.collect_set("start_line").alias("starts"))
    ends = F.coalesce(F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)), F.lit(""))
    lines = files.filter(~ends.isin("json", "md", "csv", "yaml", "yml", "toml", "env", "sql") & F.col("file_lines").isNotNull()).select("file_id", "file_lines", "ingested_at")
    lines = lines.groupBy("file_id").agg(F.max_by("file_lines", "ingested_at").alias("file_lines"))
    walked = lines.join(asked, "file_id").select("file_id", F.array_join("file_lines", "\n", "").alias("text"), "starts")
    above = walked.mapInPandas(_comments, "file_id long, start_line int, above string")
    joined = s.filter(joins).join(above, ["file_id", "start_line"], "left").select(*_COLUMNS, "above")
    # only documented symbols are left to be told apart by their deliveries
    pairs = told.unionByName(joined).mapInPandas(_make_pairs, f"{_SCHEMA}, ingested_at {at}")
    row = F.struct(*[c for c in pairs.columns if c not in ("symbol_id", "ingested_at")])
    return pairs.groupBy("symbol_id").agg(F.max_by(row, F.struct("ingested_at", F.xxhash64("code", "description"))).alias("p")).select("symbol_id", "p.*")
