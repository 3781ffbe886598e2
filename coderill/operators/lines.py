"""Operators on files and their lines: scans, slices, search, sections, chunks and line statistics.

The base tables are ``files`` (file_id, repo_id, file_path, file_lines), one row a file, and ``lines``, one row a line from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coderill.functions import detect, text


def latest_files(km_files: DataFrame, **columns: Column | str) -> DataFrame:
    """file_id and the given columns of the last delivery of every file; ties by line count.  The columns are computed before the
    shuffle, so that only they are read and moved."""
    chosen = km_files.select("file_id", F.struct("ingested_at", "line_count").alias("_at"), F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]).alias("_f"))
    return chosen.groupBy("file_id").agg(F.max_by("_f", "_at").alias("f")).select("file_id", "f.*")


def clean_lines() -> Column:
    """The lines of a file without carriage returns at their ends."""
    return F.transform("file_lines", lambda x: F.regexp_replace(x, "\r$", ""))


def paths_of(km_files: DataFrame) -> DataFrame:
    """Repository and path of the last delivery of every file; no lines are read."""
    return latest_files(km_files, repo_id="repo_id", file_path="file_path")


def files_of(km_files: DataFrame) -> DataFrame:
    """The last delivery of every file; ties by line count.  Line ends keep no carriage return."""
    return latest_files(km_files, repo_id="repo_id", file_path="file_path", file_lines=clean_lines())


def lines_of(files: DataFrame) -> DataFrame:
    """One row a line; files without lines give none."""
    return files.select("file_id", "repo_id", "file_path", F.posexplode("file_lines").alias("p", "line_text")).select("file_id", "repo_id", "file_path", (F.col("p") + 1).alias("line_no"), "line_text")


def slice_lines(files: DataFrame, start: int, end: int) -> DataFrame:
    """Lines ``start`` to ``end`` (from 1, both clamped) as one text; empty where the file is shorter."""
    low = max(1, start)
    return files.select("file_id", F.array_join(F.slice("file_lines", low, max(0, end - low + 1)), "\n").alias("slice_text"))


def grep(lines: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Lines that hold the query, with the column from 1 of its first occurrence."""
    hay = F.col("line_text") if case_sensitive else F.lower("line_text")
    needle = query if case_sensitive else query.lower()
    return lines.filter(hay.contains(needle)).select("file_id", "line_no", F.instr(hay, needle).cast("int").alias("column_no"))


def grep_files(km_files: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """:func:`grep` over the last delivery of every file; only the hits of a file are moved, not its lines."""
    needle = query if case_sensitive else query.lower()
    found = F.transform("file_lines", lambda x, i: F.struct((i + 1).alias("line_no"), F.instr(x if case_sensitive else F.lower(x), needle).cast("int").alias("column_no")))
    hits = latest_files(km_files, hits=F.filter(found, lambda h: h["column_no"] > 0))
    return hits.select("file_id", F.explode("hits").alias("h")).select("file_id", "h.*")


def first_hits(hits: DataFrame, by: str, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def tree_of(files: DataFrame) -> DataFrame:
    """Every directory and file once: repo_id, path, parent, name, node_type, depth."""
    parts = F.split("file_path", "/")
    up = files.select("repo_id", parts.alias("s"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    path = F.array_join(F.slice("s", F.lit(1), F.col("depth")), "/")
    return up.select(
        "repo_id", path.alias("path"), F.array_join(F.slice("s", F.lit(1), F.col("depth") - 1), "/").alias("parent"), F.element_at("s", F.col("depth")).alias("name"),
        F.when(F.col("depth") == F.size("s"), "file").otherwise("directory").alias("node_type"), "depth",
    ).distinct()


def running_bytes(metadata: DataFrame, limit: int, span: int = 4096) -> DataFrame:
    """Running total of bytes per repository in the order of file ids, and whether the limit is passed; null sizes count 0.

    File ids are cut into spans; a window runs within each span and another over the sums of the spans, so that no task sees
    all files of a large repository."""
    one = metadata.groupBy("file_id").agg(F.max_by(F.struct("repo_id", "byte_size"), F.struct("ingested_at", "line_count")).alias("m")).select("file_id", "m.*")
    one = one.withColumn("_b", F.coalesce("byte_size", F.lit(0))).withColumn("_s", F.floor(F.col("file_id") / span))
    before = Window.partitionBy("repo_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = one.groupBy("repo_id", "_s").agg(F.sum("_b").alias("_t")).withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inside = Window.partitionBy("repo_id", "_s").orderBy("file_id").rowsBetween(Window.unboundedPreceding, 0)
    total = one.withColumn("_in", F.sum("_b").over(inside)).join(sums, ["repo_id", "_s"]).withColumn("total_bytes", F.col("_in") + F.col("_before"))
    return total.select("file_id", "repo_id", "total_bytes", (F.col("total_bytes") > limit).alias("over_limit"))


def blocks_of(files: DataFrame, size: int = 35, stride: int = 30) -> DataFrame:
    """Overlapping blocks of lines: start_line, end_line, block_text."""
    n = F.size("file_lines")
    at = files.filter(n > 0).select("file_id", "file_lines", F.explode(F.sequence(F.lit(0), n - 1, F.lit(stride))).alias("i"))
    return at.select("file_id", (F.col("i") + 1).alias("start_line"), F.least(F.col("i") + size, n).alias("end_line"), F.array_join(F.slice("file_lines", F.col("i") + 1, size), "\n").alias("block_text"))


def sections_of(lines: DataFrame, heading: Column, keep_lead: bool = True) -> DataFrame:
    """Runs of lines that begin with a heading line: section_no (0 before the first), start_line, end_line, heading_text.

    Windows run per file; the number of a section is the running count of headings."""
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_h", heading).withColumn("section_no", F.sum(F.col("_h").cast("int")).over(w).cast("int"))
    if not keep_lead:
        marked = marked.filter("section_no > 0")
    return marked.groupBy("file_id", "section_no").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.max(F.when(F.col("_h"), F.col("line_text"))).alias("heading_text"))


def heading(levels: int) -> Column:
    return F.col("line_text").rlike(f"^#{{1,{levels}}} +[^ ]")


def doc_sections(lines: DataFrame) -> DataFrame:
    """Markdown sections with title, level and the headings so far, joined by ' > '."""
    s = sections_of(lines.filter(detect.extension("file_path") == "md"), heading(6), keep_lead=False)
    title = F.regexp_replace("heading_text", "^#+ +", "")
    w = Window.partitionBy("file_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("title", title).select("file_id", "section_no", "start_line", "end_line", "title", F.length(F.regexp_extract("heading_text", "^(#+)", 1)).alias("heading_level"), F.array_join(F.collect_list("title").over(w), " > ").alias("trail"))


def css_rules(lines: DataFrame) -> DataFrame:
    """Rules of style sheets: from a line with '{' to the first line with '}' at or after it, or to the file's end."""
    css = lines.filter(detect.extension("file_path") == "css")
    bare = F.regexp_replace("line_text", "\"[^\"]*\"", "")
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(0, Window.unboundedFollowing)
    closing = F.min(F.when(bare.contains("}"), F.col("line_no"))).over(w)
    last = F.max("line_no").over(Window.partitionBy("file_id"))
    return css.withColumn("end_line", F.coalesce(closing, last)).filter(bare.contains("{")).select("file_id", F.col("line_no").alias("start_line"), "end_line", F.trim(F.regexp_extract("line_text", r"^([^{]*)\{", 1)).alias("selector"))


def config_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of YAML by unindented key."""
    y = lines.filter(detect.extension("file_path").isin("yaml", "yml"))
    return sections_of(y, F.col("line_text").rlike(r"^[A-Za-z_][\w.-]*:"), keep_lead=False)


def csv_sample(files: DataFrame, most: int = 50) -> DataFrame:
    """Header, number of rows and a sample of lines of CSV files."""
    c = files.filter((detect.extension("file_path") == "csv") & (F.size("file_lines") > 0))
    return c.select("file_id", F.element_at("file_lines", 1).alias("header_line"), (F.size("file_lines") - 1).alias("row_count"), F.array_join(F.slice("file_lines", 1, most), "\n").alias("sample_text"))


def chunk_validity(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Why a chunk is valid or not: its range against the file and its text against the slice of lines."""
    one = chunks.groupBy("chunk_id").agg(F.max_by(F.struct("file_id", "file_language", "start_line", "end_line", "source_text"), "ingested_at").alias("c")).select("chunk_id", "c.*")
    joined = one.join(files.select("file_id", "file_lines"), "file_id", "left")
    n = F.size("file_lines")
    length = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
    same = F.array_join(F.slice("file_lines", F.greatest(F.col("start_line"), F.lit(1)), length), "\n") == F.regexp_replace("source_text", "\r", "")
    verdict = (
        F.when(F.col("file_lines").isNull(), "no_file").when(F.col("start_line").isNull() | F.col("end_line").isNull(), "no_range").when(F.col("start_line") < 1, "start").when(F.col("end_line") < F.col("start_line"), "order")
        .when(F.col("end_line") > n, "beyond").when(~same, "text").otherwise("valid")
    )
    return joined.select("chunk_id", verdict.alias("verdict"))


def line_categories(files: DataFrame) -> DataFrame:
    """Blank, comment, code, data, config and documentation lines per file; the six add up to all lines.

    Lines of data, documentation and configuration files are told by their first characters; in source files block comments, which
    begin at the start of a line and end on any line that holds the closing mark, are followed by a fold over the lines.  A file of
    unknown language is documentation."""
    marked = detect.detect_language("file_path", detect.comment_marks(files.sparkSession), files)
    trimmed = F.transform("file_lines", lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = marked.select("file_id", "repo_id", "detected", "category", F.coalesce("line_marks", F.array()).alias("_marks"), F.coalesce("block_marks", F.array()).alias("_pairs"), trimmed.alias("_t"))
    starts = lambda t, marks: F.exists(marks, lambda m: t.startswith(m))
    zero = F.struct(F.lit("").alias("close"), F.lit(0).alias("comment"), F.lit(0).alias("code"))

    def step(a: Column, t: Column) -> Column:
        inside, blank = a["close"] != "", t == ""
        opened = F.get(F.filter("_pairs", lambda p: t.startswith(p["opens"])), F.lit(0))
        one = ~inside & starts(t, F.col("_marks"))
        begins = ~inside & ~one & opened.isNotNull()
        stays = begins & ~F.contains(F.substr(t, F.length(opened["opens"]) + 1), opened["closes"])
        close = F.when(blank, a["close"]).when(inside, F.when(F.contains(t, a["close"]), "").otherwise(a["close"])).when(stays, opened["closes"]).otherwise("")
        comment = ~blank & (inside | one | begins)
        return F.struct(close.alias("close"), (a["comment"] + comment.cast("int")).alias("comment"), (a["code"] + (~blank & ~comment).cast("int")).alias("code"))

    source, blanks = F.col("category") == "source", F.size(F.filter("_t", lambda t: t == ""))
    plain = F.size(F.filter("_t", lambda t: starts(t, F.col("_marks"))))
    rows = rows.withColumn("_c", F.when(source, F.aggregate("_t", zero, step)).otherwise(F.struct(F.lit("").alias("close"), plain.alias("comment"), F.lit(0).alias("code"))))
    rest = F.size("_t") - blanks - F.col("_c.comment") - F.col("_c.code")
    of = lambda kinds: F.when(F.col("category").isin(*kinds), rest).otherwise(0)
    return rows.select(
        "file_id", "repo_id", "detected", blanks.alias("blank_lines"), F.col("_c.comment").alias("comment_lines"), F.col("_c.code").alias("code_lines"), of(["data"]).alias("data_lines"),
        of(["configuration"]).alias("config_lines"), of(["documentation", "unknown", "binary"]).alias("documentation_lines"),
    )


def brace_chunks(files: DataFrame) -> DataFrame:
    """Top-level brace blocks of Java and Go files: the scan resets its depth at the end of each block, so a file is folded
    line by line; chunk ends are where the depth comes back to 0."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("begin"), F.expr("cast(array() as array<struct<start_line:int,end_line:int>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        bare = F.regexp_replace(x["t"], r""""(?:\\.|[^"\\])*"|'[^']*'|//.*$""", "")
        opens = F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))
        closes = F.length(bare) - F.length(F.replace(bare, F.lit("}"), F.lit("")))
        depth = F.greatest(a["depth"] + opens - closes, F.lit(0))
        begin = F.when((a["depth"] == 0) & (opens > 0), x["i"]).otherwise(a["begin"])
        ends = (depth == 0) & ((a["depth"] > 0) | (opens > 0))
        out = F.when(ends, F.concat(a["out"], F.array(F.struct(begin.alias("start_line"), x["i"].alias("end_line"))))).otherwise(a["out"])
        return F.struct(depth.alias("depth"), begin.alias("begin"), out.alias("out"))

    f = files.filter(detect.extension("file_path").isin("java", "go"))
    numbered = F.transform("file_lines", lambda t, i: F.struct((i + 1).alias("i"), t.alias("t")))
    return f.select("file_id", F.explode(F.aggregate(numbered, start, step)["out"]).alias("c")).select("file_id", "c.start_line", "c.end_line")


def block_ends(lines: DataFrame, is_start: Column) -> DataFrame:
    """Ends of indented blocks: the line before the next non-blank line that is not indented deeper than the start.

    For every start the next such line is found by a window per file and indentation level, not by joining lines with lines."""
    kept = lines.withColumn("_i", text.indent("line_text")).withColumn("_s", is_start).filter(F.col("line_text").rlike(r"\S"))
    last = F.max("line_no").over(Window.partitionBy("file_id"))
    marked = kept.withColumn("_last", last)
    starts = marked.filter("_s").select("file_id", "line_no", "_i", "_last")
    levels = starts.groupBy("file_id").agg(F.array_distinct(F.collect_list("_i")).alias("_levels"))
    # a line ends the blocks of every level at or above its own indentation; levels of a file are few
    ends = marked.join(levels, "file_id").withColumn("_level", F.explode(F.filter("_levels", lambda x: x >= F.col("_i"))))
    w = Window.partitionBy("file_id", "_level").orderBy("line_no")
    nexts = ends.withColumn("_next", F.lead("line_no").over(w)).filter(F.col("_s") & (F.col("_level") == F.col("_i")))
    return nexts.select("file_id", F.col("line_no").alias("start_line"), F.coalesce(F.col("_next") - 1, F.col("_last")).cast("int").alias("end_line"))


def bracket_ends(files: DataFrame, opener: str = r"^[A-Z][A-Z0-9_]* *= *[\[{(]\s*$") -> DataFrame:
    """Collections that open a bracket at the end of a line: the line on which the depth is back to 0, and an estimate of the number of
    items (lines between that are not blank, at least 1).  A fold over the file's lines; open ends run to the last line."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("begin"), F.lit(0).alias("items"), F.expr("cast(array() as array<struct<start_line:int,end_line:int,item_count:int>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        bare = F.regexp_replace(x["t"], "\"[^\"]*\"", "")
        opens = F.length(F.regexp_replace(bare, r"[^\[{(]", ""))
        closes = F.length(F.regexp_replace(bare, r"[^\]})]", ""))
        begins = (a["depth"] == 0) & x["t"].rlike(opener)
        depth = F.when(begins | (a["depth"] > 0), F.greatest(a["depth"] + opens - closes, F.lit(0))).otherwise(0)
        begin = F.when(begins, x["i"]).otherwise(a["begin"])
        ends = (a["depth"] > 0) & (depth == 0)
        items = F.when(begins, 0).otherwise(a["items"] + ((a["depth"] > 0) & ~ends & x["t"].rlike(r"\S")).cast("int"))
        out = F.when(ends, F.concat(a["out"], F.array(F.struct(begin.alias("start_line"), x["i"].alias("end_line"), F.greatest(items, F.lit(1)).alias("item_count"))))).otherwise(a["out"])
        return F.struct(depth.alias("depth"), begin.alias("begin"), items.alias("items"), out.alias("out"))

    numbered = F.transform("file_lines", lambda t, i: F.struct((i + 1).alias("i"), t.alias("t")))
    return files.select("file_id", F.explode(F.aggregate(numbered, start, step)["out"]).alias("c")).select("file_id", "c.start_line", "c.end_line", "c.item_count")


def greedy_spaced(hits: DataFrame, distance: int = 2) -> DataFrame:
    """Lines of each file kept greedily from the top so that any two are more than ``distance`` apart; order matters, so the
    sorted lines of a file are folded."""
    sorted_lines = hits.groupBy("file_id").agg(F.array_sort(F.collect_set("line_no")).alias("l"))
    start = F.expr("cast(array() as array<int>)")
    kept = F.aggregate("l", start, lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) > distance), F.concat(a, F.array(x))).otherwise(a))
    return sorted_lines.select("file_id", F.explode(kept).alias("line_no"))
