import random

from pyspark.sql import functions as F

from coderill.llm import pieces


def rebuild(rows):
    """The text that pieces give when the shared lines are taken off, checking order and line numbers on the way."""
    rows = sorted(rows, key=lambda r: r.piece_no)
    text, at = "", 0
    for r in rows:
        assert r.char_end > at or not rows
        fresh = r.piece_text[at - r.char_start :]
        assert r.char_start <= at
        text, at = text + fresh, r.char_end
    return text


def sample(seed, n):
    rnd = random.Random(seed)
    lines = []
    while sum(map(len, lines)) < n:
        lines.append(rnd.choice(["", "def f():", "    x = 1", "    return 'é😀'", "}", "y" * rnd.randint(1, 90)]))
    return "\n".join(lines)


def test_round_trip_over_ranges(spark):
    texts = [sample(i, n) for i, n in enumerate([50, 400, 3000, 20000])] + ["z" * 5000, "a b " * 900, "\n" * 700, ""]
    rows = [(i, t, 10, lim, ov) for i, t in enumerate(texts) for lim, ov in [(100, 2)]]
    df = spark.createDataFrame(rows, "id long, t string, line int, lim int, ov int").withColumn("piece_no", F.lit("clash"))
    for size in (400, 1 << 17, pieces.RANGE_CHARS):
        got = pieces.split_column(df, "id", "t", "line", "lim", "ov", size).collect()
        for i, t in enumerate(texts):
            mine = [r for r in got if r.id == i]
            if len(t) <= 100:
                assert not mine
                continue
            assert rebuild(mine) == t
            assert [r.piece_no for r in sorted(mine, key=lambda r: r.piece_no)] == list(range(1, len(mine) + 1))
            for r in mine:
                assert 0 < len(r.piece_text) <= 100 and r.piece_count == len(mine)
                assert r.piece_text == t[r.char_start : r.char_end]
                assert r.start_line == 10 + t.count("\n", 0, r.char_start)
                assert r.end_line == 10 + t.count("\n", 0, r.char_end - 1)


def test_shared_lines(spark):
    t = "\n".join(f"line {i}" for i in range(100))
    df = spark.createDataFrame([(1, t, None, 100, 3)], "id long, t string, line int, lim int, ov int")
    got = sorted(pieces.split_column(df, "id", "t", "line", "lim", "ov").collect(), key=lambda r: r.piece_no)
    for a, b in zip(got, got[1:]):
        assert b.shared_lines == 3 and b.start_line == a.end_line - 2


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None, None, None, None), (1, "x" * 30, 5, None, 1), (2, "x" * 30, 5, 10, None), (2, "x" * 30, 5, 10, -4)], "id long, t string, line int, lim int, ov int")
    got = pieces.split_column(df, "id", "t", "line", "lim", "ov").collect()
    assert len(got) == 6 and {r.id for r in got} == {2}
    assert pieces.split_column(df.limit(0), "id", "t", "line", "lim", "ov").count() == 0


def test_chunks_swapped_lines_and_repeats(spark):
    body = "\n".join(["abcdefghi"] * 20)
    schema = "chunk_id string, file_language string, start_line int, end_line int, source_text string, ingested_at long, max_chars int"
    rows = [("a", "Go", 30, 11, body, 1, 9), ("a", "Go", 30, 11, body, 2, 9), ("b", "go", None, 40, body, 1, 9), ("c", "xx", 1, 20, body, 1, 9), ("d", "go", None, None, body, 1, 9), ("e", None, 1, 2, None, 1, 9)]
    limits = spark.createDataFrame([("go", 50, 1)], "file_language string, max_chars int, overlap_lines int")
    got = pieces.split_chunks(spark.createDataFrame(rows, schema), limits).collect()
    assert {r.chunk_id: r.start_line for r in got if r.piece_no == 1} == {"a": 11, "b": 21, "d": 1}
    assert max(r.end_line for r in got if r.chunk_id == "a") == 30


def fresh_text(rows):
    """The text of pieces in order without their shared lines."""
    return "".join("".join(r.piece_text.splitlines(keepends=True)[r.shared_lines :]) for r in rows)


def check_pieces(mine, t, limit, first=1):
    """Pieces touch without gap or overlap but for their shared lines, keep the limit, and tell right offsets and lines."""
    mine, at = sorted(mine, key=lambda r: r.piece_no), 0
    assert [r.piece_no for r in mine] == list(range(1, len(mine) + 1)) and {r.piece_count for r in mine} == {len(mine)}
    for r in mine:
        shared = sum(map(len, r.piece_text.splitlines(keepends=True)[: r.shared_lines]))
        assert r.char_start + shared == at and r.piece_text == t[r.char_start : r.char_end] and len(r.piece_text) <= limit
        assert r.start_line == first + t.count("\n", 0, r.char_start) and r.end_line == first + t.count("\n", 0, r.char_end - 1)
        at = r.char_end
    assert at == len(t) and fresh_text(mine) == t


def test_every_tail_and_overlap(spark):
    """Lengths around the ends of ranges, last ranges shorter than limit and reach, several overlaps."""
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        limit = rnd.choice([1, 2, 7, 50, 250, 1000])
        size = max(400, 4 * limit)
        n = max(limit + 1, size * rnd.randint(1, 4) + rnd.choice([-1, 0, 1, 2, limit // 4, limit // 2, limit // 2 + 1, limit - 1, limit + 1]))
        rows.append((i, sample(i, n)[:n], rnd.randint(1, 9), limit, rnd.randint(0, 4)))
    df = spark.createDataFrame(rows, "id long, t string, line int, lim int, ov int")
    got = {}
    for r in pieces.split_column(df, "id", "t", "line", "lim", "ov", 400).collect():
        got.setdefault(r.id, []).append(r)
    for i, t, line, limit, _ in rows:
        check_pieces(got[i], t, limit, line)


def test_repeated_keys(spark):
    t = sample(5, 9000)
    df = spark.createDataFrame([(1, t, 1, 200, 1)] * 2, "id long, t string, line int, lim int, ov int")
    got = pieces.split_column(df, "id", "t", "line", "lim", "ov", 400).collect()
    assert len(got) % 2 == 0 and {r.piece_count for r in got} == {len(got) // 2}


def test_files_by_offset(spark, tmp_path):
    texts = [sample(100 + i, n)[:n] for i, n in enumerate([30000, 4389, 8389, 12001, 16002, 4400, 8600, 12389, 4999, 90, 3])] + ["é😀" * 4000, "\n" * 9000]
    rows = []
    for i, t in enumerate(texts):
        path = tmp_path / f"{i}.txt"
        path.write_bytes(t.encode())
        rows.append((str(path) if i % 2 else f"file://{path}", path.stat().st_size, 120, i % 4))
    (tmp_path / "empty").touch()
    rows += [(str(tmp_path / "empty"), 0, 120, 1), (str(tmp_path / "empty"), None, 120, 1)]
    files = spark.createDataFrame(rows, "path string, byte_size long, max_chars int, overlap_lines int")
    got = {}
    for r in pieces.split_files(files, 1000).collect():
        got.setdefault(r.path, []).append(r)
    assert len(got) == len(texts)
    for (path, *_), t in zip(rows, texts):
        check_pieces(got[path], t, 120)


def test_files_with_invalid_bytes(spark, tmp_path):
    data = b"ab\xff\xfe\n\x80cd\n" * 3000
    (tmp_path / "x").write_bytes(data)
    got = pieces.split_files(spark.createDataFrame([(str(tmp_path / "x"), len(data), 100, 0)], "path string, byte_size long, max_chars int, overlap_lines int"), 1600).collect()
    assert "".join(r.piece_text for r in sorted(got, key=lambda r: r.piece_no)) == data.decode("utf-8", "replace")
