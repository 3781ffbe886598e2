"""Problem 3: oversized items cut into pieces at natural boundaries, range by range.

An item is looked at in ranges of fixed length.  Pass one finds, for each range, the best boundary in a halo after its nominal start;
the boundaries of an item, one small row a range, are stitched into a table: the region of a range goes from its own boundary to
that of the next range, lines and characters before it are prefix sums over the ranges before.  Every inner boundary is
thus decided once.  Pass two takes each region by offset and cuts it into pieces, whatever the length of the item.

Two readers feed the same passes: :func:`split_column` for texts in a table cell, and :func:`split_files` for giant files, of which
each task reads only its own byte range.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

RANGE_CHARS = 1 << 12  # at least four limits are taken, so that few regions end in a short piece
LEAST_HALO = 3  # what :func:`boundary_rank` looks at before a line
_LINE = re.compile(r"\n")
_SPACE = re.compile(r"\s")
_CLOSER = ")]}"

PIECE = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece_text", T.StringType()),
            T.StructField("char_start", T.LongType()),
            T.StructField("char_end", T.LongType()),
            T.StructField("first_line", T.LongType()),
            T.StructField("last_line", T.LongType()),
            T.StructField("shared_lines", T.IntegerType()),
        ]
    )
)


def boundary_rank(text: str, at: int) -> int:
    """How natural a cut before the line that starts at ``at`` is: 4 after a blank line and before an unindented line,
    3 after a blank line, 2 before an unindented line that closes nothing, 1 at any other line."""
    blank = at >= 2 and text[at - 2] == "\n" or at >= 3 and text[at - 3 : at] in ("\n\r\n",)
    flush = at < len(text) and not text[at].isspace() and text[at] not in _CLOSER
    return (3 + flush) if blank else (1 + flush)


def _cut(text: str, starts: list[int], low: int, high: int) -> int:
    """The best cut in (low, high]: the line start of the highest rank in the upper half, the latest of equals; else the latest
    line start below; else after the last white space; else at ``high``."""
    middle = (low + high) // 2
    i, j, k = bisect.bisect_right(starts, low), bisect.bisect_right(starts, middle), bisect.bisect_right(starts, high)
    if j < k:
        return max(starts[j:k], key=lambda s: (boundary_rank(text, s), s))
    if i < j:
        return starts[j - 1]
    for at in range(high, middle, -1):
        if text[at - 1].isspace():
            return at
    return high


def reach_of(limit: int) -> int:
    """How far after its nominal start the boundary of a range may lie."""
    return max(1, limit // 2)


def first_boundary(text: str, nominal: int, reach: int) -> int:
    """The first best boundary in [nominal, nominal + reach): the line start of the highest rank, else after a white space, else
    ``nominal``.  ``text`` holds at least LEAST_HALO characters before ``nominal`` and one after the reach, where the item has them."""
    starts = [m.end() for m in _LINE.finditer(text, max(0, nominal - 1), min(len(text), nominal + reach - 1))]
    if starts:
        return max(starts, key=lambda s: (boundary_rank(text, s), -s))
    hit = _SPACE.search(text, nominal, min(len(text), nominal + reach))
    return hit.end() if hit else nominal


def cut_region(text: str, begin: int, stop: int, at_start: bool, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of the region [begin, stop) as (start, end, shared lines), offsets into ``text``, which holds a limit of characters
    before ``begin`` or, with ``at_start``, all that is before it.

    Each piece is at most ``limit`` characters, its first ``shared`` lines repeat the end of the piece before it.  Sharing is
    given up line by line where the shared lines would take more than half of the limit, and at a cut inside a line, where
    there is no whole line to share."""
    starts = [m.end() for m in _LINE.finditer(text, 0, stop)]
    pieces, at = [], begin
    while at < stop:
        first, shared = at, 0
        k = bisect.bisect_left(starts, at)
        if at > 0 and k < len(starts) and starts[k] == at:
            for back in range(1, overlap + 1):
                line = starts[k - back] if k - back >= 0 else 0 if at_start and k - back == -1 else None
                if line is None or at - line > limit // 2:
                    break
                first, shared = line, back
        room = min(stop, first + limit)
        end = stop if room == stop else _cut(text, starts, at, room)
        pieces.append((first, end, shared))
        at = end
    return pieces


def _region_pieces(text, begin, stop, at_start, limit, overlap, offset, line):
    """Pieces of a region with absolute character offsets and line numbers; ``offset`` and ``line`` are those of ``begin``."""
    out = []
    for first, end, shared in cut_region(text, begin, stop, at_start, limit, overlap):
        a = line + text.count("\n", begin, first) if first >= begin else line - text.count("\n", first, begin)
        inside = text.count("\n", first, end)
        ends_line = end > first and text[end - 1] == "\n"
        out.append((text[first:end], offset + first - begin, offset + end - begin, a, a + inside - ends_line, shared))
    return out


_AHEAD = T.StructType([T.StructField("ahead", T.IntegerType()), T.StructField("lines", T.IntegerType())])


@F.pandas_udf(_AHEAD)
def _boundary_udf(halo: pd.Series, nominal: pd.Series, limit: pd.Series) -> pd.DataFrame:
    rows = []
    for text, at, most in zip(halo, nominal, limit):
        got = first_boundary(text, at, reach_of(most)) if at else 0
        rows.append((got - at, text.count("\n", at, got)))
    return pd.DataFrame(rows, columns=["ahead", "lines"])


@F.pandas_udf(PIECE)
def _pieces_udf(regions: pd.DataFrame) -> pd.Series:
    out = []
    for r in regions.itertuples(index=False):
        text, at = r.before + r.body + r.after, len(r.before)
        begin = at + r.ahead
        out.append(_region_pieces(text, begin, begin + r.size, r.at_start, r.limit, r.overlap, r.offset, r.line))
    return pd.Series(out)


def split_column(items: DataFrame, key: str, text: str, first_line: str, limit: str, overlap: str, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Pieces of every row whose ``text`` is longer than its ``limit``: key, piece_no, piece_count, piece_text,
    char_start, char_end, start_line, end_line, shared_lines.

    Rows with a null text or limit, or a limit below 1, are never oversized and give no row, as do empty texts; a null
    or negative overlap counts as 0, a null first line as line 1.  Repeated keys give the pieces of each row.  Other columns are
    ignored.  Only items of more than one range are shuffled, for the stitching."""
    src = items.select(
        F.col(key).alias("_key"),
        F.col(text).alias("_text"),
        F.coalesce(F.col(first_line), F.lit(1)).cast("long").alias("_line"),
        F.col(limit).cast("int").alias("_limit"),
        F.greatest(F.coalesce(F.col(overlap), F.lit(0)), F.lit(0)).cast("int").alias("_overlap"),
    ).filter((F.col("_limit") >= 1) & (F.length("_text") > F.col("_limit")))
    size = F.greatest(F.lit(range_chars), F.col("_limit") * 4).cast("int")
    # one pass over the text: a substring per range would read it again from its start each time
    ranges = F.regexp_extract_all("_text", F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))
    src = src.select("_key", F.monotonically_increasing_id().alias("_row"), "_line", "_limit", "_overlap", size.cast("long").alias("_size"), F.length("_text").cast("long").alias("_n"), "_text")
    flat = _stitched_pieces(src.filter("_n > _size").withColumn("_ranges", ranges)).unionByName(_single_pieces(src.filter("_n <= _size")))
    return flat.select(F.col("_key").alias(key), "piece_no", "piece_count", "_p.piece_text", "_p.char_start", "_p.char_end", F.col("_p.first_line").cast("int").alias("start_line"), F.col("_p.last_line").cast("int").alias("end_line"), "_p.shared_lines")


def _region(before, body, after, ahead, size, at_start, offset, line):
    parts = {"before": before, "body": body, "after": after, "ahead": ahead, "size": size, "at_start": at_start, "limit": F.col("_limit"), "overlap": F.col("_overlap"), "offset": offset, "line": line}
    return _pieces_udf(F.struct(*[c.alias(name) for name, c in parts.items()])).alias("_pieces")


def _single_pieces(src: DataFrame) -> DataFrame:
    """Pieces of the items that are no longer than a range, which need no stitching."""
    cut = src.select("_key", _region(F.lit(""), F.col("_text"), F.lit(""), F.lit(0), F.col("_n").cast("int"), F.lit(True), F.lit(0).cast("long"), F.col("_line")))
    # posexplode_outer: the filter that posexplode brings would cut every item twice
    flat = cut.select("_key", F.size("_pieces").alias("piece_count"), F.posexplode_outer("_pieces").alias("_at", "_p"))
    return flat.select("_key", (F.col("_at") + 1).alias("piece_no"), "piece_count", "_p")


def _stitched_pieces(src: DataFrame) -> DataFrame:
    """Pieces of the items of more than one range."""
    at = src.select("_key", "_row", "_line", "_limit", "_overlap", "_size", "_n", "_ranges", F.posexplode("_ranges").alias("_no", "_body"))
    other = lambda step: F.coalesce(F.get("_ranges", F.col("_no") + step), F.lit(""))
    reach = F.greatest(F.lit(1), F.floor(F.col("_limit") / 2)).cast("int")
    at = at.select(
        "_key", "_row", "_line", "_limit", "_overlap", "_n", "_no", "_body", (F.col("_no") * F.col("_size")).alias("_start"),
        F.when(F.col("_no") > 0, F.right(other(-1), F.greatest("_limit", F.lit(LEAST_HALO)))).otherwise("").alias("_before"), F.left(other(1), reach).alias("_after"), F.regexp_count("_body", F.lit("\n")).alias("_newlines"),
    )
    halo = F.concat(F.right("_before", F.lit(LEAST_HALO)), F.left("_body", reach + 1))
    found = at.withColumn("_b", _boundary_udf(halo, F.least(F.length("_before"), F.lit(LEAST_HALO)), "_limit"))
    # the stitched boundary table, one row a range
    item = Window.partitionBy("_key", "_row").orderBy("_no")
    begin = F.col("_start") + F.col("_b.ahead")
    stitched = found.select(
        "*", begin.alias("_begin"), F.lead(begin, 1).over(item).alias("_next"),
        (F.col("_line") + F.coalesce(F.sum("_newlines").over(item.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_b.lines")).alias("_first"),
    )
    size = (F.coalesce("_next", "_n") - F.col("_begin")).cast("int")
    cut = stitched.select("_key", "_row", "_no", _region(F.col("_before"), F.col("_body"), F.col("_after"), F.col("_b.ahead"), size, F.col("_start") <= F.length("_before"), F.col("_begin"), F.col("_first")))
    return _numbered(cut, ["_key", "_row"], "_no")


def _numbered(cut: DataFrame, item: list[str], order: str) -> DataFrame:
    """Piece numbers by prefix sums over the piece counts of the ranges."""
    w = Window.partitionBy(*item).orderBy(order)
    n = F.size("_pieces")
    counted = cut.withColumn("_before", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_count", F.sum(n).over(Window.partitionBy(*item)))
    flat = counted.select(item[0], "_before", "_count", F.posexplode("_pieces").alias("_at", "_p"))
    return flat.select(item[0], (F.col("_before") + F.col("_at") + 1).cast("int").alias("piece_no"), F.col("_count").cast("int").alias("piece_count"), "_p")


def _read(path: str, start: int, end: int, size: int) -> tuple[int, str]:
    """(start, text) of the bytes [start, end) of a file on any file system that an address can name, moved forward to whole UTF-8
    characters at both ends.  Invalid bytes are one character each, so that every offset can be told again."""
    start, end = max(0, start), min(end, size)
    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with where.open_input_file(name) as f:
        data = f.read_at(max(0, min(end + 4, size) - start), start)
    whole = lambda i: next((k for k in range(i, min(i + 4, len(data))) if data[k] & 0xC0 != 0x80), min(i + 4, len(data)))
    low = whole(0) if start else 0
    return start + low, data[low : whole(end - start) if end < size else len(data)].decode("utf-8", "surrogateescape")


_ESCAPED = re.compile("[\udc80-\udcff]")
_FOUND = "begin long, ahead_chars int, ahead_lines int, newlines long, chars long"


def _file_boundaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every range of a file its boundary in bytes, the characters and lines from its nominal start to it, and the newlines and
    characters of the whole range."""
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            a, reach, ahead = r.range_no * r.size, reach_of(r.max_chars), 0
            start, body = _read(r.path, a, a + r.size, r.byte_size)
            if a:
                before = _read(r.path, a - 4 * LEAST_HALO, a, r.byte_size)[1][-LEAST_HALO:]
                ahead = first_boundary(before + body[: reach + 1], len(before), reach) - len(before)
            rows.append((start + len(body[:ahead].encode("utf-8", "surrogateescape")), ahead, body.count("\n", 0, ahead), body.count("\n"), len(body)))
        yield b.assign(**dict(zip(("begin", "ahead_chars", "ahead_lines", "newlines", "chars"), map(list, zip(*rows)))))


def _file_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for r in b.itertuples(index=False):
            chars = max(r.max_chars, LEAST_HALO)
            before = _read(r.path, r.begin - 4 * chars, r.begin, r.byte_size)[1][-chars:] if r.begin else ""
            body = _read(r.path, r.begin, r.stop, r.byte_size)[1]
            got = _region_pieces(before + body, len(before), len(before) + len(body), len(before) == r.first_char, r.max_chars, r.overlap_lines, r.first_char, r.first_line)
            pieces = [dict(zip(PIECE.elementType.names, (_ESCAPED.sub("\ufffd", t), *rest))) for t, *rest in got]
            yield pd.DataFrame({"path": [r.path], "range_no": [r.range_no], "_pieces": [pieces]})


def split_files(files: DataFrame, range_bytes: int = 1 << 24) -> DataFrame:
    """Pieces of giant files on a file system that every executor sees: ``files`` has path (a name or a URI), byte_size, max_chars and
    overlap_lines.  The result is that of :func:`split_column` with ``path`` as the key; files within their limit come out as
    one piece, missing sizes and empty files give no rows, bytes that are no UTF-8 count as a character each.

    Pass one reads each range and sends on its boundary, its newlines and its characters, a few bytes a range; the window
    over them is the stitched table; pass two reads each region with its halo by offset.  No task ever holds a whole file."""
    size = F.greatest(F.lit(range_bytes), F.col("max_chars") * 16).cast("long")  # four limits of characters of at most four bytes
    ranges = files.filter("path is not null and byte_size > 0 and max_chars >= 1").select(
        "path", F.col("byte_size").cast("long").alias("byte_size"), F.col("max_chars").cast("int").alias("max_chars"), F.greatest(F.coalesce("overlap_lines", F.lit(0)), F.lit(0)).cast("int").alias("overlap_lines"),
        size.alias("size"), F.explode(F.sequence(F.lit(0), F.floor((F.col("byte_size") - 1) / size).cast("int"))).alias("range_no"),
    ).distinct()
    base = "path string, byte_size long, max_chars int, overlap_lines int, size long, range_no int"
    found = ranges.repartition("path", "range_no").mapInPandas(_file_boundaries, f"{base}, {_FOUND}")
    w = Window.partitionBy("path").orderBy("range_no")
    before = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stitched = found.select(
        "path", "byte_size", "max_chars", "overlap_lines", "range_no", "begin", F.coalesce(F.lead("begin").over(w), "byte_size").alias("stop"),
        (before("chars") + F.col("ahead_chars")).alias("first_char"), (before("newlines") + F.col("ahead_lines") + 1).alias("first_line"),
    )
    cut = stitched.repartition("path", "range_no").mapInPandas(_file_pieces, T.StructType([T.StructField("path", T.StringType()), T.StructField("range_no", T.IntegerType()), T.StructField("_pieces", PIECE)]))
    return _numbered(cut, ["path"], "range_no").select("path", "piece_no", "piece_count", "_p.piece_text", "_p.char_start", "_p.char_end", F.col("_p.first_line").alias("start_line"), F.col("_p.last_line").alias("end_line"), "_p.shared_lines")


def split_chunks(chunks: DataFrame, limits: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """:func:`split_column` for the chunk table: one item per chunk_id (the last delivery of it), the limit by language.

    Start and end lines that are swapped are taken in order; where only the end is known the start follows from the
    number of lines; where both are null lines are counted from 1.  Chunks of a language without a limit stay whole."""
    limit = limits.select(F.lower("file_language").alias("_lang"), F.col("max_chars").alias("_max"), F.col("overlap_lines").alias("_share"))
    limit = limit.groupBy("_lang").agg(F.min("_max").alias("_max"), F.max_by("_share", -F.col("_max")).alias("_share"))
    big = (
        chunks.select("chunk_id", "file_language", "start_line", "end_line", "source_text", "ingested_at")
        .join(limit, F.lower("file_language") == F.col("_lang"))
        .filter(F.length("source_text") > F.col("_max"))
    )
    row = F.struct("start_line", "end_line", "source_text", "_max", "_share")
    big = big.groupBy("chunk_id").agg(F.max_by(row, F.struct("ingested_at", F.xxhash64("source_text"))).alias("r")).select("chunk_id", "r.*")
    lines = F.regexp_count("source_text", F.lit("\n")) + 1
    first = F.coalesce(F.when(F.col("start_line").isNotNull(), F.least("start_line", "end_line")), F.col("end_line") - lines + 1)
    big = big.withColumn("_first", F.when(first >= 1, first))
    return split_column(big, "chunk_id", "source_text", "_first", "_max", "_share", range_chars)
